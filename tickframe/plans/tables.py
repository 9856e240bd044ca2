"""Operators that stand alone, as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe import market
from tickframe.config import DEMO, HOUR
from tickframe.functions import scalars as S
from tickframe.operators import audit as AU
from tickframe.operators import features as FE
from tickframe.operators import timeline as TL
from tickframe.plans.oracle import sql
from tickframe.sources import normalize as N
from tickframe.sources import raw as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
A, B = market.VENUE_A, market.VENUE_B


def query(name: str, oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def also(name: str, of: str) -> None:
    """Another operator that the same query shows."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLES:
        ORACLES[name] = ORACLES[of]


def view(spark: SparkSession, d: str) -> DataFrame:
    return market.base(spark, d)


# ------------------------------------------------------------------------------------- raw records


def channel(kind: F.Column) -> F.Column:
    return F.when(kind.isin("click", "purchase"), "trades").when(kind == "view", "mark-price").when(kind == "error", "liquidation-orders").otherwise("books")


def records(spark: SparkSession, d: str) -> DataFrame:
    """The events as raw records (payload: the event's JSON properties and value)."""
    v = view(spark, d).join(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("ord"), "props"), "ord")
    return v.select(
        F.lit(1).cast("smallint").alias("schema_version"), F.concat(F.lit("r"), "ord").alias("record_id"), F.concat(F.lit("raw://r"), "ord").alias("raw_payload_reference"), "exchange", "symbol", channel(F.col("event_type")).alias("channel"), F.lit("data").alias("message_kind"), F.lit("ws").alias("transport"),
        F.timestamp_micros("us").alias("exchange_timestamp"), F.timestamp_micros("recv_us").alias("local_receive_timestamp"), F.col("ord").cast("string").alias("sequence_id"), (F.col("ord") % 3).alias("connection_generation"), F.col("props").cast("binary").alias("raw_payload"), "us", "recv_us", "ord",
    )


_RECORDS = """records AS (SELECT v.*, e.props, 'r' || v.ord AS record_id, CAST(v.ord AS VARCHAR) AS sequence_id, v.ord % 3 AS generation,
  CASE WHEN v.event_type IN ('click', 'purchase') THEN 'trades' WHEN v.event_type = 'view' THEN 'mark-price' WHEN v.event_type = 'error' THEN 'liquidation-orders' ELSE 'books' END AS channel FROM view0 v JOIN events e ON e.event_id = v.ord)"""


def rsql(select: str) -> str:
    return sql("", "market").rstrip() + ",\n" + _RECORDS + "\n" + select


START, END = 1704499200000000, 1705104000000000
SCAN = R.ScanFilter(START, END, frozenset([A]), frozenset(market.SYMBOLS), None, frozenset(["books"]))
_SCAN = f"recv_us BETWEEN {START} AND {END} AND exchange = '{A}' AND channel <> 'books'"


@query("src_02_scan_filter", rsql(f"SELECT record_id, exchange, symbol, channel, recv_us FROM records WHERE {_SCAN}"))
def scan_filter(spark, d):
    return records(spark, d).where(SCAN.condition()).select("record_id", "exchange", "symbol", "channel", "recv_us")


@query("src_01_raw_scan_ordered", rsql(f"SELECT record_id, row_number() OVER (ORDER BY recv_us, recv_us, generation, exchange, symbol, channel, sequence_id, record_id) AS place FROM records WHERE {_SCAN}"))
def raw_scan(spark, d):
    df = records(spark, d).where(SCAN.condition())
    return TL.placed(df, TL.replay_order(df)).select("record_id", "place")


def _ordered(mode: str) -> Query:
    def run(spark, d):
        df = records(spark, d)
        return TL.placed(df, TL.replay_order(df, mode)).select("record_id", "channel", "place")

    return run


for _name, _mode, _at in (("srt_01_replay_order", "RECEIVE_TIME", "recv_us"), ("srt_02_event_time_order", "EVENT_TIME", "coalesce(us, recv_us)")):
    query(_name, rsql(f"SELECT record_id, channel, row_number() OVER (ORDER BY {_at}, recv_us, generation, exchange, symbol, channel, sequence_id, record_id) AS place FROM records"))(_ordered(_mode))


@query("src_03_has_channel", rsql("SELECT c AS channel, count(record_id) > 0 AS present FROM (VALUES ('books'), ('trades'), ('none')) w(c) LEFT JOIN records ON channel = c GROUP BY c"))
def has_channel(spark, d):
    """A probe for each channel, which stops at the first row that it finds."""
    df = records(spark, d)
    return spark.createDataFrame([(c, R.has_channel(df, c)) for c in ("books", "trades", "none")], "channel string, present boolean")


@query("agg_30_raw_audit", rsql("SELECT count(*) AS rows, count(DISTINCT record_id) AS ids, CAST(sum(strlen(props)) AS BIGINT) AS payload_bytes, count(DISTINCT exchange || '/' || symbol || '/' || channel) AS partitions FROM records"))
def raw_audit(spark, d):
    return AU.raw_audit(records(spark, d), "record_id", F.col("raw_payload"), F.concat_ws("/", "exchange", "symbol", "channel")).select("rows", "ids", "payload_bytes", "partitions")


also("aud_01_raw_tree_audit", "agg_30_raw_audit")
_LEAF = ", ".join(f"sum(CAST('0x' || substr(h, {64 - 8 * (i + 1) + 1}, 8) AS BIGINT)) AS l{i}" for i in range(8))
_UP = ["l0"] + [f"l{i} + c{i - 1}" for i in range(1, 8)]
_WITH = "".join(f", LATERAL (SELECT ({_UP[i]}) % 4294967296 AS d{i}, ({_UP[i]}) // 4294967296 AS c{i}) AS x{i}" for i in range(8))
_HEX = " || ".join(f"lower(lpad(hex(CAST(d{i} AS BIGINT)), 8, '0'))" for i in reversed(range(8)))


@query("aud_11_compaction_equivalence", rsql(f"SELECT {_HEX} AS before, {_HEX} AS after, true AS same FROM (SELECT {_LEAF} FROM (SELECT sha256(record_id || chr(31) || props) AS h FROM records)) s{_WITH}"))
def compaction(spark, d):
    """A tree written in many files and its compacted copy, both read back."""
    root = AU.scratch(spark, "raw")
    records(spark, d).repartition(16).write.parquet(root)
    parts = ["exchange", "symbol", "channel"]
    both = AU.compact(spark.read.parquet(root), f"{root}-compact", parts, ["local_receive_timestamp", "record_id"], "record_id", F.col("raw_payload"), F.concat_ws("/", *parts))
    one = both.agg(F.max(F.when(F.col("side") == "before", F.col("digest_sum"))).alias("before"), F.max(F.when(F.col("side") == "after", F.col("digest_sum"))).alias("after"))
    return one.withColumn("same", F.col("before") == F.col("after"))


also("snk_06_compaction_audit", "aud_11_compaction_equivalence")


def two_trees(spark, d):
    """Two stored trees of the records: the right one lacks some, has some others, and some changed."""
    body, n = records(spark, d).select("record_id", "exchange", "channel", "raw_payload", "ord"), F.col("ord")
    changed = F.when(n % 70 == 1, F.concat(F.col("raw_payload"), F.lit(b"!"))).otherwise(F.col("raw_payload"))
    out = []
    for side, df in (("left", body.where(n % 90 != 2)), ("right", body.where(n % 50 != 0).withColumn("raw_payload", changed))):
        path = AU.scratch(spark, side)
        df.drop("ord").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


@query("aud_03_compare_trees", rsql("SELECT record_id, CASE WHEN ord % 50 = 0 THEN 'LEFT_ONLY' WHEN ord % 90 = 2 THEN 'RIGHT_ONLY' ELSE 'DIFFERENT' END AS kind FROM records WHERE (ord % 50 = 0) <> (ord % 90 = 2) OR (ord % 70 = 1 AND ord % 50 <> 0 AND ord % 90 <> 2)"))
def compare_trees(spark, d):
    return AU.differences(*two_trees(spark, d), "record_id")


also("jn_10_tree_consistency", "aud_03_compare_trees")


@query("set_04_audit_equality", rsql("SELECT exchange, channel, count(*) FILTER (WHERE ord % 90 <> 2) = count(*) FILTER (WHERE ord % 50 <> 0) AND count(*) FILTER (WHERE (ord % 50 = 0) <> (ord % 90 = 2) OR ord % 70 = 1 AND ord % 50 <> 0) = 0 AS same FROM records GROUP BY ALL"))
def audit_equality(spark, d):
    """Whether the audits of both trees agree, for each venue and channel."""
    audits = []
    for side, df in zip(("l", "r"), two_trees(spark, d)):
        leaf = F.sha2(F.concat(F.col("record_id").cast("binary"), F.lit(b"\x1f"), F.col("raw_payload")), 256)
        audits.append(df.withColumn("leaf", leaf).groupBy("exchange", "channel").agg(F.count(F.lit(1)).alias("rows"), *S.digest_sum("leaf")).select("exchange", "channel", F.struct("rows", S.carried().alias("digest")).alias(side)))
    return audits[0].join(audits[1], ["exchange", "channel"], "full").select("exchange", "channel", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


@query("aud_10_raw_validation", rsql("""SELECT count(*) FILTER (WHERE ord % 31 = 0) AS missing_required, count(*) FILTER (WHERE ord % 37 = 0) AS wrong_version, count(*) FILTER (WHERE ord % 41 = 0) AS empty_payload, count(*) FILTER (WHERE ord % 43 = 0) AS wrong_reference, count(*) - count(DISTINCT record_id) AS repeated_ids
  FROM (SELECT record_id, ord FROM records UNION ALL SELECT record_id, ord FROM records WHERE ord % 47 = 0)"""))
def validation(spark, d):
    """A tree with violations of every rule."""
    df = records(spark, d)
    df, n = df.unionByName(df.where("ord % 47 = 0")), F.col("ord")
    spoil = lambda name, every, value: F.when(n % every == 0, value).otherwise(F.col(name))
    none = F.lit(None).cast("string")
    return R.quality(df.withColumn("transport", spoil("transport", 31, none)).withColumn("schema_version", spoil("schema_version", 37, F.lit(9))).withColumn("raw_payload", spoil("raw_payload", 41, F.lit(b""))).withColumn("raw_payload_reference", spoil("raw_payload_reference", 43, F.lit("raw://x"))))


@query("agg_39_channel_histogram", rsql("SELECT exchange, channel, count(*) AS n FROM records GROUP BY ALL"))
def histogram(spark, d):
    return records(spark, d).groupBy("exchange", "channel").agg(F.count(F.lit(1)).alias("n"))


also("agg_34_counts_by_type", "agg_39_channel_histogram")
_CRC = "recv_us"


@query("agg_35_stream_health", rsql("SELECT exchange, symbol, channel, count(*) AS messages, CAST(sum(CASE WHEN generation <> g THEN 1 ELSE 0 END) AS BIGINT) AS switches, round(sum((recv_us - us) / 1000.0::DOUBLE), 3) AS latency_sum, round(max((recv_us - us) / 1000.0::DOUBLE), 3) AS latency_max, round(avg((recv_us - us) / 1000.0::DOUBLE), 3) AS latency_avg FROM (SELECT *, lag(generation) OVER (PARTITION BY exchange, symbol, channel ORDER BY recv_us, ord) AS g FROM records) GROUP BY ALL"))
def stream_health(spark, d):
    by = Window.partitionBy("exchange", "symbol", "channel").orderBy("recv_us", "ord")
    df = records(spark, d).withColumn("g", F.lag("connection_generation").over(by)).withColumn("ms", S.latency_ms("recv_us", "us"))
    return df.groupBy("exchange", "symbol", "channel").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.when(F.col("g") != F.col("connection_generation"), 1).otherwise(0)).alias("switches"), F.round(F.sum("ms"), 3).alias("latency_sum"), F.round(F.max("ms"), 3).alias("latency_max"), F.round(F.avg("ms"), 3).alias("latency_avg"))


@query("agg_33_latency_summary", rsql("SELECT count(*) AS samples, round(avg((recv_us - us) / 1000.0::DOUBLE), 3) AS mean_ms, round(min((recv_us - us) / 1000.0::DOUBLE), 3) AS min_ms, round(max((recv_us - us) / 1000.0::DOUBLE), 3) AS max_ms FROM records"))
def latency(spark, d):
    ms = S.latency_ms("recv_us", "us")
    return records(spark, d).agg(F.count(ms).alias("samples"), F.round(F.avg(ms), 3).alias("mean_ms"), F.round(F.min(ms), 3).alias("min_ms"), F.round(F.max(ms), 3).alias("max_ms"))


also("scl_25_latency", "agg_33_latency_summary")


@query("srt_09_monotonic_check", rsql("SELECT exchange, symbol, count(*) FILTER (WHERE us < p) AS backwards FROM (SELECT *, lag(us) OVER (PARTITION BY exchange, symbol ORDER BY recv_us, ord) AS p FROM records) GROUP BY ALL"))
def monotonic(spark, d):
    by = Window.partitionBy("exchange", "symbol").orderBy("recv_us", "ord")
    return records(spark, d).withColumn("p", F.lag("us").over(by)).groupBy("exchange", "symbol").agg(F.count(F.when(F.col("us") < F.col("p"), 1)).alias("backwards"))


# ---------------------------------------------------------------------------------- normalization


def _text(c: F.Column, places: int) -> F.Column:
    return F.format_string(f"%.{places}f", c)


_INST = lambda: F.when(F.col("symbol") == market.SYMBOLS[0], "BTC-USDT-SWAP").otherwise("ETH-USDT-SWAP")
_PAIR = lambda: F.when(F.col("symbol") == market.SYMBOLS[0], "BTCUSDT").otherwise("ETHUSDT")


def payloads_a(spark: SparkSession, d: str) -> DataFrame:
    """Venue A messages that the events would have been."""
    v = view(spark, d).where(F.col("exchange") == A).withColumn("ms", F.expr("us div 1000"))
    p, q = _text(F.col("price"), 4), _text(F.col("qty"), 1)
    pair = _PAIR()
    trade = F.to_json(F.struct(F.lit("x").alias("stream"), F.struct(F.lit("aggTrade").alias("e"), F.col("ord").alias("a"), pair.alias("s"), p.alias("p"), q.alias("q"), F.col("ms").alias("T"), (F.col("event_type") == "purchase").alias("m")).alias("data")))
    mark = F.to_json(F.struct(F.lit("markPriceUpdate").alias("e"), F.col("ms").alias("E"), pair.alias("s"), p.alias("p"), _text(F.col("price") + 1, 4).alias("i"), _text((F.col("k") - 50) / F.lit(100000.0), 5).alias("r")))
    z = F.when(F.col("k") % 3 == 0, F.lit("0")).otherwise(q)
    force = F.to_json(F.struct(F.lit("forceOrder").alias("e"), F.col("ms").alias("E"), F.struct(pair.alias("s"), F.when(F.col("k") % 2 == 0, "SELL").otherwise("BUY").alias("S"), q.alias("q"), p.alias("p"), F.lit("0").alias("ap"), z.alias("z"), F.col("ms").alias("T")).alias("o")))
    best = F.to_json(F.struct(F.lit("bookTicker").alias("e"), F.col("ord").alias("u"), F.col("ms").alias("T"), pair.alias("s"), p.alias("b"), q.alias("B"), _text(F.col("price") + 2, 4).alias("a"), q.alias("A")))
    body = F.when(F.col("event_type").isin("click", "purchase"), trade).when(F.col("event_type") == "view", mark).when(F.col("event_type") == "error", force).otherwise(best)
    oi = v.where("event_type = 'view'").select("ord", "symbol", "recv_us", F.to_json(F.struct(_text(F.lit(1000.0) + F.col("k"), 1).alias("openInterest"), pair.alias("symbol"), F.col("ms").alias("time"))).cast("binary").alias("raw_payload"))
    return v.select("ord", "symbol", "recv_us", body.cast("binary").alias("raw_payload")).unionByName(oi)


def _a(spark, d) -> DataFrame:
    return N.venue_a(payloads_a(spark, d))


def _b(spark, d) -> DataFrame:
    return N.venue_b(payloads_b(spark, d), specs(spark))


def payloads_b(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d).where(F.col("exchange") == B).withColumn("ms", F.expr("cast(us div 1000 as string)"))
    p, q, inst = _text(F.col("price"), 4), _text(F.col("qty"), 1), _INST()
    message = lambda channel, row: F.to_json(F.struct(F.struct(F.lit(channel).alias("channel"), inst.alias("instId")).alias("arg"), F.array(row).alias("data")))
    trade = message("trades", F.struct(inst.alias("instId"), F.col("ord").cast("string").alias("tradeId"), p.alias("px"), q.alias("sz"), F.when(F.col("event_type") == "click", "buy").otherwise("sell").alias("side"), F.col("ms").alias("ts"), F.col("ord").alias("seqId")))
    liq = message("liquidation-orders", F.struct(inst.alias("instId"), F.array(*(F.struct(p.alias("bkPx"), F.lit("net").alias("posSide"), F.when(F.col("k") % 2 == i, "sell").otherwise("buy").alias("side"), q.alias("sz"), F.col("ms").alias("ts")) for i in range(2))).alias("details")))
    mark = message("mark-price", F.struct(inst.alias("instId"), p.alias("markPx"), F.col("ms").alias("ts")))
    body = F.when(F.col("event_type").isin("click", "purchase"), trade).when(F.col("event_type") == "error", liq).otherwise(mark)
    out = v.select("ord", "recv_us", body.alias("m"))
    views = v.where("event_type = 'view'")
    for channel, row in (
        ("open-interest", F.struct(inst.alias("instId"), _text(F.col("k") + 0.5, 1).alias("oi"), q.alias("oiCcy"), _text(F.col("value"), 3).alias("oiUsd"), F.col("ms").alias("ts"))),
        ("funding-rate", F.struct(inst.alias("instId"), _text((F.col("k") - 50) / F.lit(100000.0), 5).alias("fundingRate"), F.col("ms").alias("ts"))),
        ("index-tickers", F.struct(F.regexp_replace(inst, "-SWAP", "").alias("instId"), p.alias("idxPx"), F.col("ms").alias("ts"))),
    ):
        out = out.unionByName(views.select("ord", "recv_us", message(channel, row).alias("m")))
    return out.select("ord", "recv_us", F.col("m").cast("binary").alias("raw_payload"))


INSTRUMENTS = '{"code":"0","msg":"","data":[{"instId":"BTC-USDT-SWAP","instType":"SWAP","ctType":"linear","ctVal":"0.01","ctMult":"1","ctValCcy":"BTC","state":"live"},{"instId":"ETH-USDT-SWAP","instType":"SWAP","ctType":"linear","ctVal":"0.1","ctMult":"1","ctValCcy":"ETH","state":"live"},{"instId":"BTC-USD-SWAP","instType":"SWAP","ctType":"inverse","ctVal":"100","ctMult":"1","ctValCcy":"USD","state":"live"},{"instId":"XRP-USDT-SWAP","instType":"SWAP","ctType":"linear","ctVal":"100","ctMult":"1","ctValCcy":"XRP","state":"suspend"}]}'


def specs(spark: SparkSession) -> DataFrame:
    return N.instruments(spark.createDataFrame([(bytearray(INSTRUMENTS.encode()),)], "raw_payload binary"))


def shown(df: DataFrame, kind: str, *columns: str) -> DataFrame:
    doubles = {"price", "quantity", "contracts", "quote_quantity", "rate"}
    return df.where(F.col("event_type") == kind).select("exchange", "symbol", "us", "recv_us", *((F.round(F.col(c).cast("double"), 8) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in columns))


_MS = "us // 1000 * 1000 AS us, recv_us"
_R = lambda e, c: f"round(CAST({e} AS DOUBLE), 8) + 0.0 AS {c}"
_P, _Q = "round(price, 4)", "round(qty, 1)"
_CT = f"CASE WHEN symbol = '{market.SYMBOLS[0]}' THEN 0.01 ELSE 0.1 END"


def norm(name: str, make, venue: str, kind: str, where: str, **columns: str) -> None:
    doubles = {"price", "quantity", "contracts", "quote_quantity", "rate"}
    picks = ", ".join(_R(e, c) if c in doubles else f"{e} AS {c}" for c, e in columns.items())
    query(name, sql(f"SELECT exchange, symbol, {_MS}, {picks} FROM view0 WHERE exchange = '{venue}' AND {where}", "market"))(lambda spark, d: shown(make(spark, d), kind, *columns))


_TR = "event_type IN ('click', 'purchase')"
norm("nrm_03_agg_trade", _a, A, "TRADE", _TR, trade_id="CAST(ord AS VARCHAR)", side="CASE WHEN event_type = 'purchase' THEN 'SELL' ELSE 'BUY' END", price=_P, quantity=_Q)
norm("nrm_05_book_ticker", _a, A, "BEST", "event_type = 'signup'", price="round(price, 4) + 1", sequence_id="CAST(ord AS VARCHAR)")
norm("nrm_08_force_order", _a, A, "LIQUIDATION", "event_type = 'error'", side="CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END", price=_P, quantity=_Q)
norm("nrm_09_open_interest", _a, A, "OPEN_INTEREST", "event_type = 'view'", contracts="1000 + k")
norm("nrm_11_contract_trades", _b, B, "TRADE", _TR, trade_id="CAST(ord AS VARCHAR)", side="CASE WHEN event_type = 'click' THEN 'BUY' ELSE 'SELL' END", price=_P, quantity=f"{_Q} * {_CT}", contracts=_Q)
norm("nrm_14_open_interest_units", _b, B, "OPEN_INTEREST", "event_type = 'view'", contracts="k + 0.5", quantity=_Q, quote_quantity="round(value, 3)")
norm("nrm_15_funding_rate", _b, B, "FUNDING", "event_type = 'view'", rate="round((k - 50) / 100000.0, 5)")
norm("nrm_16_mark_price", _b, B, "MARK", "event_type IN ('view', 'signup')", price=_P)
norm("nrm_17_index_tickers", _b, B, "INDEX", "event_type = 'view'", price=_P)


@query("nrm_07_mark_price_flatmap", sql(f"SELECT exchange, symbol, {_MS}, kind AS event_type, CASE WHEN kind <> 'FUNDING' THEN round(CAST(CASE WHEN kind = 'MARK' THEN round(price, 4) ELSE round(price + 1, 4) END AS DOUBLE), 8) + 0.0 END AS price, CASE WHEN kind = 'FUNDING' THEN round(CAST(round((k - 50) / 100000.0, 5) AS DOUBLE), 8) + 0.0 END AS rate FROM view0, (VALUES ('MARK'), ('INDEX'), ('FUNDING')) t(kind) WHERE exchange = '{A}' AND event_type = 'view'", "market"))
def mark_flatmap(spark, d):
    e = _a(spark, d).where(F.col("event_type").isin("MARK", "INDEX", "FUNDING"))
    return e.select("exchange", "symbol", "us", "recv_us", "event_type", (F.round(F.col("price").cast("double"), 8) + F.lit(0.0)).alias("price"), (F.round(F.col("rate").cast("double"), 8) + F.lit(0.0)).alias("rate"))


@query("nrm_18_liquidation_explode", sql(f"SELECT exchange, symbol, {_MS}, CASE WHEN symbol = '{market.SYMBOLS[0]}' THEN 'BTC-USDT-SWAP' ELSE 'ETH-USDT-SWAP' END || ':' || CAST(us // 1000 AS VARCHAR) || ':' || pos AS trade_id, CASE WHEN k % 2 = pos THEN 'LONG' ELSE 'SHORT' END AS side, {_R(_P, 'price')}, {_R(f'{_Q} * {_CT}', 'quantity')} FROM view0, (VALUES (0), (1)) t(pos) WHERE exchange = '{B}' AND event_type = 'error'", "market"))
def liquidations(spark, d):
    return shown(_b(spark, d), "LIQUIDATION", "trade_id", "side", "price", "quantity")


@query("nrm_19_instruments", f"SELECT * FROM (VALUES ('BTC-USDT-SWAP', '{market.SYMBOLS[0]}', 0.01::DOUBLE, 1.0::DOUBLE), ('ETH-USDT-SWAP', '{market.SYMBOLS[1]}', 0.1::DOUBLE, 1.0::DOUBLE)) t(venue_symbol, symbol, contract_value, multiplier)")
def instrument_specs(spark, d):
    return specs(spark).select("venue_symbol", "symbol", F.col("contract_value").cast("double").alias("contract_value"), F.col("multiplier").cast("double").alias("multiplier"))


also("set_05_required_instruments", "nrm_19_instruments")


_ROUTES = [(A, e, t) for e, ts in (("click", "TRADE"), ("purchase", "TRADE"), ("view", "MARK INDEX FUNDING OPEN_INTEREST"), ("error", "LIQUIDATION"), ("signup", "BEST")) for t in ts.split()]
_ROUTES += [(B, e, t) for e, ts in (("click", "TRADE"), ("purchase", "TRADE"), ("view", "MARK INDEX FUNDING OPEN_INTEREST"), ("error", "LIQUIDATION LIQUIDATION"), ("signup", "MARK")) for t in ts.split()]


@query("nrm_20_router_counts", sql(f"SELECT exchange, t AS event_type, count(*) AS n FROM view0 JOIN (VALUES {', '.join(str(r) for r in _ROUTES)}) m(x, e, t) ON event_type = e AND exchange = x GROUP BY ALL", "market"))
def router(spark, d):
    """Messages of both venues and of an internal channel through the router."""
    mixed = lambda df, venue: df.select("recv_us", "raw_payload", F.lit(venue).alias("exchange"), F.lit("*").alias("symbol"), F.lit("mixed").alias("channel"))
    a, b = mixed(payloads_a(spark, d), A), mixed(payloads_b(spark, d), B)
    every = a.unionByName(b).unionByName(a.withColumn("channel", F.lit("_lifecycle")))
    return N.normalize(every, specs(spark)).groupBy("exchange", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("nrm_21_symbol_mapping", f"SELECT * FROM (VALUES ('BTCUSDT', '{market.SYMBOLS[0]}'), ('ETHUSDT', '{market.SYMBOLS[1]}'), ('DOGEUSDT', NULL)) t(venue_symbol, symbol)")
def symbol_mapping(spark, d):
    return spark.createDataFrame([("BTCUSDT",), ("ETHUSDT",), ("DOGEUSDT",)], "venue_symbol string").select("venue_symbol", N.canonical(A, F.col("venue_symbol")).alias("symbol"))


@query("jn_05_contract_lookup", sql(f"SELECT ord, CASE WHEN ord % 29 = 0 THEN NULL ELSE symbol END AS symbol, CASE WHEN ord % 29 <> 0 THEN round(round(qty, 1) * {_CT}, 8) + 0.0 END AS quantity FROM view0 WHERE exchange = '{B}'", "market"))
def contract_lookup(spark, d):
    """Contracts to base quantity by the venue's specifications; an instrument without one has no quantity."""
    v = view(spark, d).where(F.col("exchange") == B).withColumn("inst", F.when(F.col("ord") % 29 == 0, "XRP-USDT-SWAP").otherwise(_INST()))
    found = v.drop("symbol").join(specs(spark), F.col("inst") == F.col("venue_symbol"), "left")
    base = S.base_quantity(F.round("qty", 1), F.col("contract_value").cast("double"), F.col("multiplier").cast("double"))
    return found.select("ord", "symbol", (F.round(base, 8) + F.lit(0.0)).alias("quantity"))


# ------------------------------------------------------------------------------ time and lateness

_STREAM = "exchange, symbol, event_type"


@query("str_07_lateness_policy", sql(f"SELECT {_STREAM}, CASE WHEN h IS NULL OR us >= h THEN 'ACCEPTED' WHEN us <= h - {DEMO.retention} THEN 'EXPIRED' WHEN us < h - {120 * 1000000} THEN 'LATE' ELSE 'ACCEPTED' END AS status, count(*) AS n FROM (SELECT *, max(us) OVER (PARTITION BY {_STREAM} ORDER BY recv_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM view0) GROUP BY ALL", "market"))
def lateness(spark, d):
    keys = ["exchange", "symbol", "event_type"]
    return TL.admissibility(view(spark, d), keys, 120 * 1_000_000, DEMO.retention).groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


also("flt_05_lateness", "str_07_lateness_policy")


@query("str_08_ttl_dedup", sql(f"SELECT exchange, symbol, k, ord FROM (SELECT *, lag(recv_us) OVER (PARTITION BY exchange, symbol, k ORDER BY recv_us, ord) AS p FROM view0) WHERE p IS NULL OR recv_us - p > {24 * HOUR}", "market"))
def ttl_dedup(spark, d):
    return TL.fresh(view(spark, d), ["exchange", "symbol", "k"], 24 * HOUR).select("exchange", "symbol", "k", "ord")


@query("str_12_replay_clock", sql("SELECT count(*) AS decisions, 0::BIGINT AS backwards FROM ticks", "ticks"))
def clock(spark, d):
    t = TL.spine(view(spark, d), DEMO).withColumn("before", F.lag("tick_no").over(Window.orderBy("tick_no")))
    return t.agg(F.count(F.lit(1)).alias("decisions"), F.count(F.when(F.col("before") >= F.col("tick_no"), 1)).alias("backwards"))


@query("win_13_running_max", sql(f"SELECT ord, max(us) OVER (PARTITION BY {_STREAM} ORDER BY recv_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_us FROM view0", "market"))
def running_max(spark, d):
    w = Window.partitionBy("exchange", "symbol", "event_type").orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return view(spark, d).select("ord", F.max("us").over(w).alias("high_us"))


@query("flt_06_retention_capacity", sql(f"SELECT {_STREAM}, count(*) AS kept, min(us) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY {_STREAM} ORDER BY us DESC, ord DESC) AS i FROM (SELECT *, max(us) OVER (PARTITION BY {_STREAM}) AS newest FROM view0) WHERE us > newest - {240 * HOUR}) WHERE i <= 50 GROUP BY ALL", "market"))
def retention(spark, d):
    keys = ["exchange", "symbol", "event_type"]
    return TL.retained(view(spark, d), keys, 240 * HOUR, 50).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), F.min("us").alias("oldest"))


also("win_15_capacity_buffer", "flt_06_retention_capacity")


@query("win_14_latest_per_key", sql(f"SELECT {_STREAM}, us, ord FROM view0 QUALIFY row_number() OVER (PARTITION BY {_STREAM} ORDER BY us DESC, ord DESC) = 1", "market"))
def latest(spark, d):
    return TL.latest_per_key(view(spark, d).select("exchange", "symbol", "event_type", "us", "ord"), ["exchange", "symbol", "event_type"], ["us", "ord"])


@query("str_03_decision_ticks", sql(f"SELECT tick_no * {DEMO.tick} AS decision_us, kind FROM ticks, (VALUES ('FEATURE', 1), ('SIGNAL', 5)) t(kind, every) WHERE tick_no % every = 0", "ticks"))
def ticks(spark, d):
    return TL.decision_ticks(view(spark, d), DEMO).select("decision_us", "kind")


@query("agg_36_collection_invariants", sql(f"SELECT exchange, count(DISTINCT tick_no) * 6 AS expected, count(*) FILTER (WHERE exchange = '{A}' OR tick_no % 10 <> 0) AS single_rows, count(DISTINCT tick_no) * 6 = count(*) FILTER (WHERE exchange = '{A}' OR tick_no % 10 <> 0) AS holds FROM grid GROUP BY ALL", "grid"))
def invariants(spark, d):
    """Snapshots of every tick, symbol and window, of which one venue has lost some."""
    i = FE.Inputs(spark, d, DEMO)
    ticks = TL.spine(i.all, DEMO).agg((F.count(F.lit(1)) * 6).alias("expected"))
    lost = (F.col("exchange") == B) & (F.col("tick_no") % 10 == 0)
    rows = FE.trade_flow(i).where(~lost).groupBy("exchange").agg(F.count(F.lit(1)).alias("single_rows"))
    return rows.crossJoin(F.broadcast(ticks)).select("exchange", "expected", "single_rows", (F.col("expected") == F.col("single_rows")).alias("holds"))


@query("flt_10_no_lookahead", sql("SELECT count(*) FILTER (WHERE tick_no % 11 = 0) AS violations, count(*) AS snapshots FROM grid", "grid"))
def lookahead(spark, d):
    """Snapshots, some of them with a source one microsecond after the decision."""
    late = F.when(F.col("tick_no") % 11 == 0, F.col("tick_no") * DEMO.tick + 1).otherwise(F.col("newest_us"))
    one = FE.single_venue(FE.Inputs(spark, d, DEMO)).withColumn("newest_us", late)
    return one.agg(F.count(F.when(AU.looks_ahead(DEMO.tick), 1)).alias("violations"), F.count(F.lit(1)).alias("snapshots"))


@query("flt_09_snapshot_invariants", sql("SELECT exchange, count(*) FILTER (WHERE tick_no % 13 = 0 OR tick_no % 17 = 0) AS violations FROM grid GROUP BY ALL", "grid"))
def snapshot_invariants(spark, d):
    """Snapshots, some of them from the future or with an imbalance above 1."""
    t = F.col("tick_no")
    one = FE.single_venue(FE.Inputs(spark, d, DEMO)).withColumn("data_age_ms", F.when(t % 13 == 0, -1).otherwise(F.col("data_age_ms"))).withColumn("taker_imbalance", F.when(t % 17 == 0, 1.5).otherwise(F.col("taker_imbalance")))
    return one.groupBy("exchange").agg(F.count(F.when(AU.breaks_invariants(), 1)).alias("violations"))


@query("flt_08_level_validation", sql("SELECT exchange, symbol, count(*) FILTER (WHERE qty < 0 OR price <= 0) AS bad, count(*) FILTER (WHERE qty = 0) AS deletes FROM levels0 GROUP BY ALL", "market"))
def validation_levels(spark, d):
    return market.levels(view(spark, d)).groupBy("exchange", "symbol").agg(F.count(F.when((F.col("qty") < 0) | (F.col("price") <= 0), 1)).alias("bad"), F.count(F.when(F.col("qty") == 0, 1)).alias("deletes"))


@query("agg_31_feature_audit", sql("SELECT count(*) AS rows, count(*) AS ids, count(DISTINCT exchange) AS scopes, count(DISTINCT symbol) AS symbols, min(tick_no) AS first_tick, max(tick_no) AS last_tick, CAST(sum(CAST(is_warm AS INT)) AS BIGINT) AS warm, CAST(sum(CAST(is_healthy AS INT)) AS BIGINT) AS healthy FROM single", "single"))
def feature_audit(spark, d):
    return AU.feature_audit(FE.single_venue(FE.Inputs(spark, d, DEMO)))


also("aud_02_feature_tree_audit", "agg_31_feature_audit")


@query("aud_02_reason_histogram", sql("SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM single WHERE reasons <> '') GROUP BY ALL", "single"))
def reasons(spark, d):
    return AU.reason_histogram(FE.single_venue(FE.Inputs(spark, d, DEMO)))


@query("src_05_feature_scan_filter", sql("SELECT exchange, symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no FROM single WHERE symbol = 'BTC-USDT-PERP' AND window_ticks IN (1, 6) AND is_healthy AND len(list_intersect(string_split(reasons, ','), ['NO_TRADES', 'OPEN_INTEREST_STALE'])) > 0", "single"))
def feature_filter(spark, d):
    one = FE.single_venue(FE.Inputs(spark, d, DEMO))
    wanted = F.arrays_overlap("reason_codes", F.array(F.lit("NO_TRADES"), F.lit("OPEN_INTEREST_STALE")))
    return one.where((F.col("symbol") == "BTC-USDT-PERP") & F.col("window_ticks").isin(1, 6) & F.col("is_healthy") & wanted).select("exchange", "symbol", F.col("window_ticks").cast("long").alias("window_ticks"), "tick_no")


also("set_06_reason_intersection", "src_05_feature_scan_filter")


@query("src_04_feature_scan_ordered", sql("SELECT exchange, symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no, row_number() OVER (ORDER BY tick_no, symbol, window_ticks, exchange) AS place FROM grid", "grid"))
def feature_scan(spark, d):
    g = FE.Inputs(spark, d, DEMO).grid
    return TL.placed(g.select("exchange", "symbol", F.col("window_ticks").cast("long").alias("window_ticks"), "tick_no"), ["tick_no", "symbol", "window_ticks", "exchange"])


also("srt_04_feature_order", "src_04_feature_scan_ordered")


@query("win_07_history_reset", sql("SELECT exchange, symbol, segment, count(*) AS samples FROM (SELECT exchange, symbol, sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY recv_us, ord) AS segment FROM view0 WHERE event_type = 'signup') GROUP BY ALL".replace("segment, count", "CAST(segment AS BIGINT) AS segment, count"), "market"))
def history_reset(spark, d):
    """Segments of a stream between generation changes; win_07_reset_zscore has histories partitioned by them."""
    w = Window.partitionBy("exchange", "symbol").orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = F.sum(F.when(F.col("k") % 7 == 0, 1).otherwise(0)).over(w)
    return view(spark, d).where("event_type = 'signup'").withColumn("segment", seg).groupBy("exchange", "symbol", "segment").agg(F.count(F.lit(1)).alias("samples"))


_RESETS = """, e AS (SELECT exchange, symbol, recv_us, sum(CASE WHEN k %% 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY recv_us, ord) AS generation FROM view0 WHERE event_type = 'signup'),
gens AS (SELECT g.exchange, g.symbol, g.tick_no, coalesce(max(generation), 0) AS generation FROM ktick g LEFT JOIN e ON e.exchange = g.exchange AND e.symbol = g.symbol AND e.recv_us <= g.tick_no * %d GROUP BY ALL),
seg AS (SELECT exchange, symbol, tick_no, CAST(sum(CASE WHEN generation <> g THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY tick_no) AS BIGINT) AS segment FROM (SELECT *, lag(generation) OVER (PARTITION BY exchange, symbol ORDER BY tick_no) AS g FROM gens)),
v AS (SELECT exchange, symbol, window_ticks, tick_no, segment, taker_imbalance AS x, lag(tick_no) OVER (PARTITION BY exchange, symbol, window_ticks, segment ORDER BY tick_no) AS tp FROM trade_flow JOIN seg USING (exchange, symbol, tick_no) WHERE taker_imbalance IS NOT NULL)
SELECT v.exchange, v.symbol, CAST(v.window_ticks AS BIGINT) AS window_ticks, v.tick_no, v.segment, round(CASE WHEN count(h.x) >= 2 AND max(h.x) > min(h.x) THEN (any_value(v.x) - avg(h.x)) / stddev_pop(h.x) END, 6) + 0.0 AS z
FROM v LEFT JOIN v h ON h.exchange = v.exchange AND h.symbol = v.symbol AND h.window_ticks = v.window_ticks AND h.segment = v.segment AND h.tick_no <= v.tp AND h.tick_no > v.tp - %d GROUP BY v.exchange, v.symbol, v.window_ticks, v.tick_no, v.segment""" % (HOUR, DEMO.ticks(DEMO.lookback))


@query("win_07_reset_zscore", sql("", "trade_flow", "ktick").rstrip() + _RESETS)
def reset_zscore(spark, d):
    """z-scores of the imbalance whose histories end where a generation of the book does (the segments of win_07_history_reset)."""
    i = FE.Inputs(spark, d, DEMO)
    w = Window.partitionBy("exchange", "symbol").orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i.book_generations = i.all.where("event_type = 'signup'").withColumn("generation", F.sum(F.when(F.col("k") % 7 == 0, 1).otherwise(0)).over(w))
    wide = FE.with_segments(i, FE.trade_flow(i))
    z = TL.prior_zscore(wide, "taker_imbalance", DEMO.ticks(DEMO.lookback), FE.history_keys(wide)).where("taker_imbalance is not null")
    return z.select("exchange", "symbol", F.col("window_ticks").cast("long").alias("window_ticks"), "tick_no", "segment", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@query("win_05_same_decision_replaced", sql(f"SELECT exchange, symbol, (recv_us + {HOUR - 1}) // {HOUR} AS tick_no, round(last(value ORDER BY recv_us, ord), 6) + 0.0 AS value FROM view0 WHERE event_type = 'view' GROUP BY ALL", "market"))
def same_decision(spark, d):
    v = view(spark, d).where("event_type = 'view'").withColumn("tick_no", F.expr(f"(recv_us + {HOUR - 1}) div {HOUR}"))
    return v.groupBy("exchange", "symbol", "tick_no").agg((F.round(F.max_by("value", F.struct("recv_us", "ord")), 6) + F.lit(0.0)).alias("value"))


@query("jn_07_dedup_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01')")
def anti(spark, d):
    old = spark.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate < timestamp_ntz'1995-01-01 00:00:00'").select("l_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").join(old, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")




@query("snk_02_idempotent_sink", sql("SELECT exchange, symbol, count(*) AS rows, CAST(sum(ord) AS BIGINT) AS ords FROM view0 GROUP BY ALL", "market"))
def idempotent_sink(spark, d):
    """Batches that overlap, one of them written twice and with repeated rows: each snapshot is stored once."""
    v = view(spark, d)
    rows = v.select("exchange", "symbol", "ord", F.expr(f"us div {HOUR}").alias("tick_no"), F.lit(1).alias("window_ticks"), F.concat(F.lit("s"), "ord").alias("snapshot_id"), F.sha2(F.concat_ws("/", "ord", "k"), 256).alias("payload_sha256"))
    root = AU.scratch(spark, "features")
    for batch in (rows.where("ord % 3 <> 0"), rows.where("ord % 3 <> 0"), rows.unionByName(rows.where("ord % 5 = 0"))):
        AU.append_features(batch, root)
    return spark.read.parquet(root).groupBy("exchange", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("ord").alias("ords"))


_HEALTH = "SELECT exchange, CASE WHEN ord % 5 = 0 THEN '*' ELSE symbol END AS symbol, 'c' || (ord % 2) AS channel, us, ord, CASE k % 4 WHEN 0 THEN 'STALE' WHEN 1 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS status FROM view0 WHERE event_type = 'signup'"


@query("jn_08_health_as_of", sql("", "ktick").rstrip() + f""", h AS ({_HEALTH}), e AS (SELECT h.exchange, k.symbol, channel, us, ord, status, CASE WHEN h.symbol = '*' THEN 0 ELSE 1 END AS own FROM h JOIN keys k ON h.exchange = k.exchange AND (h.symbol = '*' OR h.symbol = k.symbol))
SELECT g.exchange, g.symbol, e.channel, g.tick_no, last(status ORDER BY us, own, ord) AS status FROM ktick g JOIN e ON e.exchange = g.exchange AND e.symbol = g.symbol AND e.us <= g.tick_no * {HOUR} GROUP BY ALL""")
def health(spark, d):
    i = FE.Inputs(spark, d, DEMO)
    k4 = F.col("k") % 4
    status = F.when(k4 == 0, "STALE").when(k4 == 1, "DISCONNECTED").otherwise("CONNECTED")
    e = i.all.where("event_type = 'signup'").select("exchange", F.when(F.col("ord") % 5 == 0, "*").otherwise(F.col("symbol")).alias("symbol"), F.concat(F.lit("c"), (F.col("ord") % 2).cast("string")).alias("channel"), "us", "ord", status.alias("status"))
    return AU.health_as_of(e, i.ticks(), HOUR)


also("sta_10_health_fan_out", "jn_08_health_as_of")


@query("jn_09_source_coverage", sql("SELECT exchange, symbol, count(*) AS n FROM (SELECT exchange, symbol, us, ord FROM trades UNION SELECT exchange, symbol, us, ord FROM prices) GROUP BY ALL", "trades", "prices"))
def coverage(spark, d):
    i = FE.Inputs(spark, d, DEMO)
    pick = ["exchange", "symbol", "us", "ord"]
    return i.trades.select(pick).unionByName(i.prices.select(pick)).distinct().groupBy("exchange", "symbol").agg(F.count(F.lit(1)).alias("n"))


also("set_03_distinct_sources", "jn_09_source_coverage")


@query("aud_06_journal_audit", sql("SELECT count(*) AS events, count(*) AS journal_rows, 0::BIGINT AS after_end, true AS clean FROM view0", "market"))
def journal(spark, d):
    v = view(spark, d)
    fields = ["exchange", "symbol", "event_type", "us", "recv_us", "ord"]
    path = AU.scratch(spark, "journal")
    R.journal_record(v, fields).write.partitionBy("channel").parquet(path)
    back = R.journal_events(spark.read.parquet(path), ", ".join(f"{c} {t}" for c, t in v.select(*fields).dtypes))
    end = v.agg(F.max("recv_us").alias("end_us"), F.count(F.lit(1)).alias("events"))
    out = back.crossJoin(F.broadcast(end)).groupBy("events").agg(F.count(F.lit(1)).alias("journal_rows"), F.count(F.when(F.col("recv_us") > F.col("end_us"), 1)).alias("after_end"))
    return out.withColumn("clean", (F.col("events") == F.col("journal_rows")) & (F.col("after_end") == 0))


also("snk_07_journal_round_trip", "aud_06_journal_audit")

# ------------------------------------------------------------------------------------------ scalars


@query("scl_scalar_functions", sql(f"""SELECT ord, (us // {HOUR} + 1) * {HOUR} AS boundary, sha256('a' || ord) AS text_digest, (us + recv_us) / 2.0::DOUBLE - us AS skew, least(60.0::DOUBLE, 1.0::DOUBLE * pow(2.0, k % 8)) AS backoff,
  coalesce(100.0::DOUBLE * k / nullif(k % 3, 0), 0.0) AS pct, CASE WHEN k % 5 = 0 THEN 'DISCONNECTED' WHEN k % 5 = 1 THEN 'RESYNCING' WHEN k % 5 = 2 THEN 'STALE' WHEN k % 5 = 3 THEN 'DEGRADED' ELSE 'CONNECTED' END AS health,
  CASE WHEN k % 2 = 0 THEN upper(symbol) END AS canonical, TRY_CAST(CASE WHEN k % 2 = 0 THEN '1.5' ELSE 'x' END AS DOUBLE) AS parsed, round(qty * 0.01 * 1, 8) + 0.0 AS base FROM view0""", "market"))
def scalar_functions(spark, d):
    v = view(spark, d)
    k = F.col("k")
    return v.select(
        "ord", S.next_boundary("us", HOUR).alias("boundary"), F.sha2(F.concat(F.lit("a"), F.col("ord")), 256).alias("text_digest"), S.clock_skew_us("us", "recv_us", "us").alias("skew"), S.backoff_seconds(k % 8 + 1).alias("backoff"), S.percentage(k, k % 3).alias("pct"),
        S.health_status(k % 5 != 0, k % 5 == 1, k % 5 == 2, k % 5 == 3).alias("health"), S.canonical_symbol(F.when(k % 2 == 0, F.concat(F.lit(" "), F.lower("symbol"))).otherwise("bad")).alias("canonical"), S.finite_decimal(F.when(k % 2 == 0, "1.5").otherwise("x")).cast("double").alias("parsed"),
        (F.round(S.base_quantity("qty", 0.01, 1), 8) + F.lit(0.0)).alias("base"),
    )


for _n in ("scl_02_finite_decimal", "scl_03_canonical_symbol", "scl_05_sha256", "scl_24_contracts_to_base", "scl_26_clock_skew", "scl_28_health_precedence", "scl_30_backoff", "scl_31_next_boundary", "scl_32_percentage"):
    also(_n, "scl_scalar_functions")


@query("scl_01_epoch_millis", sql("SELECT ord, us // 1000 * 1000 AS back_us FROM view0", "market"))
def epoch(spark, d):
    return view(spark, d).select("ord", F.unix_micros(S.epoch_millis(F.expr("cast(us div 1000 as string)"))).alias("back_us"))


also("scl_09_epoch_micros", "scl_01_epoch_millis")


@query("scl_08_uuid5", None)
def uuids(spark, d):
    return view(spark, d).select("ord", S.uuid5(F.concat(F.lit("event-"), F.col("ord"))).alias("id"))


@query("scl_27_signed_crc32", None)
def crcs(spark, d):
    return view(spark, d).select("ord", S.signed_crc32(F.concat(F.lit("event-"), F.col("ord"))).alias("crc"))


@query("sta_04_feature_book_machine", None)
def machine(spark, d):
    """Level updates as snapshots (every 25th) and differences, replayed by the exact machine."""
    from tickframe.operators import books

    v = market.levels(view(spark, d))
    n = F.row_number().over(Window.partitionBy("exchange", "symbol").orderBy("recv_us", "ord"))
    e = v.withColumn("n", n).withColumn("is_snapshot", F.col("n") % 25 == 1)
    pair = lambda p, q: F.array(F.struct(p.cast("double").alias("price"), q.cast("double").alias("qty")))
    none = F.array().cast("array<struct<price:double,qty:double>>")
    bids = F.when(F.col("is_snapshot"), pair(F.lit(90), F.lit(5))).when(F.col("side") == "BID", pair(F.col("price"), F.col("qty"))).otherwise(none)
    asks = F.when(F.col("is_snapshot"), pair(F.lit(110), F.lit(5))).when(F.col("side") == "ASK", pair(F.col("price"), F.col("qty"))).otherwise(none)
    return books.replay_books(e.select("exchange", "symbol", "ord", "us", "recv_us", "is_snapshot", F.lit(0).cast("long").alias("generation"), F.col("n").cast("long").alias("sequence"), (F.col("n") - 1).cast("long").alias("previous"), bids.alias("bids"), asks.alias("asks")))


PAIRS = "array<struct<price:string,qty:string>>"


def protocol_rows(spark: SparkSession, d: str, cycle: int):
    """Every event as a row of its book's feed: n counts the rows of a book, m their place in a cycle."""
    v = view(spark, d)
    n = F.row_number().over(Window.partitionBy("exchange", "symbol").orderBy("recv_us", "ord")).cast("long")
    bid = F.array(F.struct(F.lit("99").alias("price"), (F.col("n") % 7 + 1).cast("string").alias("qty")))
    ask = F.array(F.struct(F.lit("101").alias("price"), (F.col("n") % 5 + 1).cast("string").alias("qty")))
    return v.withColumn("n", n).withColumn("m", (F.col("n") - 1) % cycle).withColumn("bids", bid.cast(PAIRS)).withColumn("asks", ask.cast(PAIRS))


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY recv_us, ord) AS n FROM view0"


@query("sta_01_range_book", sql(f"""SELECT exchange, symbol, ord, CASE WHEN m = 0 THEN CASE WHEN n = 1 THEN 'BUFFERED' ELSE 'SEQUENCE_GAP' END WHEN m < 3 THEN 'BUFFERED' WHEN m = 3 THEN 'SNAPSHOT_APPLIED' WHEN m IN (25, 50) THEN 'STALE' ELSE 'APPLIED' END AS status,
  CASE WHEN n < 4 THEN 'BUFFERING' WHEN m < 3 THEN 'RESYNC_REQUIRED' ELSE 'LIVE' END AS book_status, CASE WHEN m < 3 THEN -1 WHEN m IN (3, 25, 50) THEN 10 * (n - 1) ELSE 10 * n END AS sequence FROM (SELECT *, (n - 1) % 70 AS m FROM ({NUMBERED}))""", "market"))
def range_book(spark, d):
    """Feeds with a gap at the start of every cycle of 70 rows, a snapshot that bridges it three rows later, and repeated updates."""
    from tickframe.operators import books

    n, m, rows = F.col("n"), F.col("m"), protocol_rows(spark, d, 70)
    repeats = m.isin(25, 50)
    last = n - repeats.cast("long")  # a repeated update has the ids of the row before
    previous = F.when(m == 0, 10 * n - 15).when(m.isin(4, 26, 51) | repeats, 10 * (n - 2)).otherwise(10 * (n - 1))
    rows = rows.withColumn("is_snapshot", m == 3).withColumn("first_id", 10 * last - 9).withColumn("final_id", F.when(m == 3, 10 * (n - 2) - 4).otherwise(10 * last)).withColumn("previous_id", previous)
    return books.replay_range_books(rows).select("exchange", "symbol", "ord", "status", "book_status", F.coalesce("sequence", F.lit(-1)).alias("sequence"))


@query("sta_02_chain_book", sql(f"""SELECT exchange, symbol, ord, CASE WHEN m = 0 THEN 'SNAPSHOT_APPLIED' WHEN m < 30 THEN 'APPLIED' WHEN m < 40 THEN 'SEQUENCE_GAP' WHEN m = 40 THEN 'SNAPSHOT_APPLIED' WHEN m < 45 THEN 'APPLIED' WHEN m = 45 THEN 'CHECKSUM_MISMATCH' ELSE 'SEQUENCE_GAP' END AS status,
  CASE WHEN m < 30 OR m BETWEEN 40 AND 44 THEN 'LIVE' ELSE 'RESYNC_REQUIRED' END AS book_status, CASE WHEN m < 30 OR m BETWEEN 40 AND 44 THEN n ELSE -1 END AS sequence, CASE WHEN m < 30 OR m BETWEEN 40 AND 44 THEN 99.0::DOUBLE END AS bid, CASE WHEN m < 30 OR m BETWEEN 40 AND 44 THEN 101.0::DOUBLE END AS ask
  FROM (SELECT *, (n - 1) % 50 AS m FROM ({NUMBERED}))""", "market"))
def chain_book(spark, d):
    """Feeds with a broken chain at the 31st and a wrong checksum at the 46th of every 50 rows; the other rows' checksums hold or are 0."""
    from tickframe.operators import books

    n, m, rows = F.col("n"), F.col("m"), protocol_rows(spark, d, 50)
    text = F.concat(F.lit("99:"), F.col("bids")[0]["qty"], F.lit(":101:"), F.col("asks")[0]["qty"])
    crc = F.when(m == 45, 1).when(n % 3 == 0, 0).otherwise(S.signed_crc32(text))
    rows = rows.withColumn("is_snapshot", m.isin(0, 40)).withColumn("sequence", n).withColumn("previous", F.when(m == 30, n - 2).otherwise(n - 1)).withColumn("checksum", crc.cast("long"))
    return books.replay_chain_books(rows).select("exchange", "symbol", "ord", "status", "book_status", F.coalesce("sequence", F.lit(-1)).alias("sequence"), "bid", "ask")


also("jn_06_snapshot_bridge", "sta_01_range_book")
also("srt_07_book_checksum", "sta_02_chain_book")
