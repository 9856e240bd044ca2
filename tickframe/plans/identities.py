"""Identities, routes and row checks as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe import market
from tickframe.operators import identity as I
from tickframe.plans.tables import A, B, Query, records, rsql, view

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_AT = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.%f')"
_ISO = f"""{_AT.format("us")} || '+00:00'"""
_BODY = f"""'{{"channel":"' || channel || '","exchange":"' || exchange || '","exchange_timestamp":"' || {_ISO} || '","raw_payload":{{"bytes_sha256":"' || sha256(props) || '","length":' || strlen(props) || '}},"sequence_id":"' || sequence_id || '","symbol":"' || symbol || '"}}'"""
_EVENT = ["channel", "exchange", "exchange_timestamp", "raw_payload", "sequence_id", "symbol"]


@query("scl_07_canonical_json", rsql(f"SELECT record_id, {_BODY} AS body FROM records"))
def canonical(spark, d):
    df = records(spark, d)
    return df.select("record_id", I.canonical_json(df, _EVENT).alias("body"))


@query("scl_33_event_identity", rsql(f"SELECT sha256({_BODY}) AS identity, 2::BIGINT AS receipts FROM records"))
def event_identity(spark, d):
    """Every event received twice, a second apart: one identity each."""
    df = records(spark, d).select(*_EVENT, "local_receive_timestamp")
    again = df.withColumn("local_receive_timestamp", F.col("local_receive_timestamp") + F.expr("interval 1 second"))
    both = df.unionByName(again)
    return both.groupBy(I.event_identity(both).alias("identity")).agg(F.count(F.lit(1)).alias("receipts"))


@query("scl_29_partition_value", "SELECT c_custkey, url_encode(replace(c_name, '#', '*~#/ ')) AS folder FROM customer")
def partition_value(spark, d):
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("*~#/ "))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", I.partition_value(name).alias("folder"))


@query("flt_03_universe", rsql(f"SELECT exchange, CASE WHEN ord % 11 = 0 THEN '*' WHEN ord % 13 = 0 THEN 'XRP-USDT-PERP' ELSE symbol END AS symbol, CASE WHEN ord % 22 = 0 THEN 'health' ELSE 'trade' END AS kind, count(*) AS n, bool_and(ord % 22 = 0 AND ord % 11 = 0 OR ord % 11 <> 0 AND ord % 13 <> 0) AS known FROM view0 GROUP BY ALL"))
def universe(spark, d):
    """Events with unknown symbols planted, and ``*`` outside of health too."""
    k = F.col("ord")
    e = view(spark, d).withColumn("symbol", F.when(k % 11 == 0, "*").when(k % 13 == 0, "XRP-USDT-PERP").otherwise(F.col("symbol"))).withColumn("kind", F.when(k % 22 == 0, "health").otherwise("trade"))
    known = I.is_known({A: market.SYMBOLS, B: market.SYMBOLS})
    return e.groupBy("exchange", "symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.every(known).alias("known"))


@query("nrm_22_generations", rsql("SELECT ord, CAST(sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY recv_us, ord) AS BIGINT) AS generation FROM view0"))
def generations(spark, d):
    return I.stamp_generations(view(spark, d), F.col("k") % 7 == 0).select("ord", F.col("generation").cast("long").alias("generation"))


_MS = "us // 1000 * 1000"


@query("nrm_23_routes", rsql(f"""SELECT ord, CASE WHEN exchange = '{A}' THEN CASE WHEN ord % 3 = 0 THEN 'aggTrade' ELSE 'depth@100ms' END WHEN ord % 5 = 0 THEN '_control' WHEN ord % 4 = 0 THEN 'liquidation-orders' ELSE 'books' END AS channel,
  CASE WHEN exchange = '{B}' AND (ord % 5 = 0 OR ord % 4 = 0) THEN '*' ELSE symbol END AS symbol, CASE WHEN exchange = '{B}' AND ord % 5 = 0 THEN NULL ELSE {_MS} END AS us, CASE WHEN exchange = '{B}' AND (ord % 5 = 0 OR ord % 4 = 0) THEN NULL ELSE CAST(ord AS VARCHAR) END AS sequence_id FROM view0"""))
def routes(spark, d):
    """Messages of both venues: bare and combined, control, liquidations and books."""
    v, k = view(spark, d), F.col("ord")
    ms, base = F.expr("us div 1000"), F.substring("symbol", 1, 3)
    text = lambda form, *cols: F.format_string(form, *cols)
    a = v.where(F.col("exchange") == A).withColumn("body", F.when(k % 3 == 0, text('{"e":"aggTrade","s":"%sUSDT","T":%d,"a":%d}', base, ms, k)).otherwise(text('{"stream":"x@depth@100ms","data":{"s":"%sUSDT","E":%d,"u":%d}}', base, ms, k)))
    deal = text('{"arg":{"channel":"liquidation-orders"},"data":[{"instId":"%s-USDT-SWAP","details":[{"ts":"%d"}]}]}', base, ms)
    book = text('{"arg":{"channel":"books","instId":"%s-USDT-SWAP"},"data":[{"ts":"%d","seqId":%d}]}', base, ms, k)
    b = v.where(F.col("exchange") == B).withColumn("body", F.when(k % 5 == 0, '{"event":"subscribe"}').when(k % 4 == 0, deal).otherwise(book))
    return I.routes(a.select("ord", "body"), A).unionByName(I.routes(b.select("ord", "body"), B)).drop("body")


@query("snk_08_timeline_end", rsql("SELECT 'whole' AS journal, 1::BIGINT AS ends, 0::BIGINT AS after_end UNION ALL SELECT 'cut', 0, 0 UNION ALL SELECT 'doubled', 2, 0 UNION ALL SELECT 'late', 1, count(*) FILTER (WHERE ord % 100 = 0) FROM records"))
def timeline_end(spark, d):
    """A journal with its end, without, with two, and with rows received after it."""
    df = records(spark, d).select("record_id", "channel", "recv_us", "ord")
    whole = I.with_end(df)
    end = whole.where(F.col("channel") == "_timeline_end")
    late = whole.unionByName(df.where("ord % 100 = 0").withColumn("recv_us", F.lit(1 << 62)))
    out = None
    for name, j in (("whole", whole), ("cut", df), ("doubled", whole.unionByName(end)), ("late", late)):
        one = I.end_violations(j).withColumn("journal", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("aud_04_payload_checks", rsql("""SELECT record_id, concat_ws(',', CASE WHEN ord % 19 = 0 THEN 'payload' END, CASE WHEN ord % 17 = 0 OR ord % 19 = 0 THEN 'payload_sha256' END, CASE WHEN ord % 13 = 0 AND ord % 19 <> 0 THEN 'symbol' END, CASE WHEN ord % 11 = 0 AND ord % 19 <> 0 THEN 'recv_us' END) AS violations
  FROM records WHERE ord % 19 = 0 OR ord % 17 = 0 OR ord % 13 = 0 OR ord % 11 = 0"""))
def payload_checks(spark, d):
    """Stored rows with broken payloads, digests and columns planted."""
    k = F.col("ord")
    df = records(spark, d).select("record_id", "exchange", "symbol", "recv_us", "ord")
    whole = df.withColumn("payload", F.to_json(F.struct("exchange", "symbol", "recv_us")))
    whole = whole.withColumn("payload_sha256", F.when(k % 17 == 0, "0").otherwise(F.sha2("payload", 256))).withColumn("payload", F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("payload")))
    broken = whole.withColumn("symbol", F.when(k % 13 == 0, "OTHER").otherwise(F.col("symbol"))).withColumn("recv_us", F.when(k % 11 == 0, F.col("recv_us") + 1).otherwise(F.col("recv_us")))
    return I.payload_violations(broken, "exchange string, symbol string, recv_us bigint").select("record_id", F.array_join("violations", ",").alias("violations"))


@query("agg_38_stability", "SELECT count(*) AS iterations, CAST(sum(l_linenumber) AS BIGINT) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS seconds, max(l_partkey) AS peak_bytes, bool_and(l_linenumber < 7) AS all_passed, count(DISTINCT l_linestatus) <= 1 AS same_digest FROM lineitem")
def stability(spark, d):
    runs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("long").alias("rows"), F.col("l_orderkey").alias("seconds"), F.col("l_partkey").alias("peak_bytes"), (F.col("l_linenumber") < 7).alias("passed"), F.col("l_linestatus").alias("digest"))
    return I.roll_up(runs)
