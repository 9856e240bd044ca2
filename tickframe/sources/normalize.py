"""Raw payloads of two venues to typed events, in one pass: each payload is parsed once, its message's case makes an
array of events, and the arrays are exploded.

Unknown fields are ignored; a message that lacks a required field, is of no known kind or names no configured
instrument gives no event and is counted by ``rejected``. Prices and quantities are decimals from text; a text that is
no such decimal makes its message a rejected one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions import scalars as S
from tickframe.market import VENUE_A, VENUE_B

DEC = "decimal(24,10)"
EVENT = ["exchange", "symbol", "event_type", "us", "recv_us", "sequence_id", "side", "price", "quantity", "contracts", "quote_quantity", "rate", "trade_id", "bids", "asks", "previous_sequence_id"]
LEVELS = f"array<struct<price:{DEC},quantity:{DEC}>>"
#: Venue symbols of the configured instruments.
SYMBOLS = {VENUE_A: {"BTCUSDT": "BTC-USDT-PERP", "ETHUSDT": "ETH-USDT-PERP"}, VENUE_B: {"BTC-USDT-SWAP": "BTC-USDT-PERP", "ETH-USDT-SWAP": "ETH-USDT-PERP"}}


def canonical(venue: str, symbol: Column) -> Column:
    """Canonical symbol, null if the venue's symbol isn't configured."""
    pairs = [F.lit(x) for kv in SYMBOLS[venue].items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), symbol)


def dec(c: Column) -> Column:
    return c.try_cast(DEC)


TYPES = {"us": "bigint", "recv_us": "bigint", "price": DEC, "quantity": "decimal(38,18)", "contracts": "decimal(38,18)", "quote_quantity": "decimal(38,18)", "rate": "decimal(38,18)", "bids": LEVELS, "asks": LEVELS}


def event(**values: Column) -> Column:
    """An event as a struct of all fields of ``EVENT``."""
    return F.struct(*(values.get(c, F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in EVENT))


def one_of(cases: list[tuple[Column, Column]]) -> Column:
    """The events (an array) of the case that holds, null if none does."""
    return F.coalesce(*(F.when(c, events) for c, events in cases))


def parsed(records: DataFrame, schema: str, body: Column | str = "body") -> DataFrame:
    return records.withColumn("m", F.from_json(body if isinstance(body, Column) else F.col(body), schema, {"mode": "PERMISSIVE"}))


def levels(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(dec(x[0]).alias("price"), dec(x[1]).alias("quantity")))


# ------------------------------------------------------------------------------------------- venue A


def cases_a(records: DataFrame) -> DataFrame:
    """The records with ``kind`` and ``events`` (null: rejected). A payload's ``data`` object is its message if it has one."""
    text = F.col("raw_payload").cast("string")
    top = F.from_json(text, "map<string,string>")  # names that differ in case only can't stand in one struct
    once = lambda df, name, c: df.select(*df.columns, F.explode(F.array(c)).alias(name))  # noqa: E731  (a projection would parse again for each use)
    r = once(once(records, "top", top), "m", F.coalesce(F.from_json(F.col("top")["data"], "map<string,string>"), "top"))
    m = lambda name: F.col("m")[name]
    kind = F.coalesce(m("e"), F.when(m("lastUpdateId").isNotNull(), "depthSnapshot").when(m("openInterest").isNotNull(), "openInterest"))
    r = r.withColumn("kind", kind)
    me, sym, recv = F.lit(VENUE_A), canonical(VENUE_A, m("s")), F.col("recv_us")
    ms = lambda c: c.try_cast("long") * 1000
    pairs = lambda name: levels(F.from_json(m(name), "array<array<string>>"))
    at = F.coalesce(ms(m("T")), ms(m("E")))
    made = lambda **values: event(exchange=me, recv_us=recv, **values)
    wide = lambda c: c.try_cast("decimal(38,18)")

    def case(name: str, needed: list[Column], *events: Column) -> tuple[Column, Column]:
        holds = F.col("kind") == name
        for c in needed:
            holds = holds & c.isNotNull()
        return holds, F.array(*events)

    size = lambda bid, qty: F.array(F.struct(dec(m(bid)).alias("price"), dec(m(qty)).alias("quantity")))
    o = F.from_json(m("o"), "map<string,string>")
    positive = lambda x, y: F.when(dec(o[x]) > 0, dec(o[x])).otherwise(dec(o[y]))
    three = (("MARK", "price", "p"), ("INDEX", "price", "i"), ("FUNDING", "rate", "r"))
    bids, asks = pairs("bids"), pairs("asks")
    cases = [
        case("aggTrade", [sym, ms(m("T")), dec(m("p")), dec(m("q")), m("m")], made(symbol=sym, event_type=F.lit("TRADE"), us=ms(m("T")), sequence_id=m("a"), trade_id=m("a"), side=F.when(m("m") == "true", "SELL").otherwise("BUY"), price=dec(m("p")), quantity=dec(m("q")))),
        case("depthUpdate", [sym, m("u"), m("b"), m("a")], made(symbol=sym, event_type=F.lit("BOOK_UPDATE"), us=at, sequence_id=m("u"), previous_sequence_id=m("pu"), bids=pairs("b"), asks=pairs("a"))),
        case("bookTicker", [sym, dec(m("b")), dec(m("a"))], made(symbol=sym, event_type=F.lit("BEST"), us=at, sequence_id=m("u"), price=((dec(m("b")) + dec(m("a"))) / 2).cast(DEC), bids=size("b", "B"), asks=size("a", "A"))),
        case("depthSnapshot", [F.nullif(F.size(bids), F.lit(0)), F.nullif(F.size(asks), F.lit(0)), F.col("symbol")], made(symbol=F.col("symbol"), event_type=F.lit("BOOK_SNAPSHOT"), us=F.coalesce(at, recv), sequence_id=m("lastUpdateId"), bids=bids, asks=asks)),
        case("markPriceUpdate", [sym, ms(m("E")), dec(m("p")), dec(m("i")), wide(m("r"))], *(made(symbol=sym, event_type=F.lit(k), us=ms(m("E")), **{field: wide(m(c))}) for k, field, c in three)),
        case("forceOrder", [canonical(VENUE_A, o["s"]), o["S"], ms(o["T"])], made(symbol=canonical(VENUE_A, o["s"]), event_type=F.lit("LIQUIDATION"), us=ms(o["T"]), side=F.when(o["S"] == "SELL", "LONG").otherwise("SHORT"), price=positive("ap", "p"), quantity=positive("z", "q"))),
        case("openInterest", [canonical(VENUE_A, m("symbol")), wide(m("openInterest")), ms(m("time"))], made(symbol=canonical(VENUE_A, m("symbol")), event_type=F.lit("OPEN_INTEREST"), us=ms(m("time")), contracts=wide(m("openInterest")))),
    ]
    return r.withColumn("events", one_of(cases)).drop("top", "m")


def venue_a(records: DataFrame) -> DataFrame:
    """Events of venue A's records (raw_payload, recv_us, symbol for messages that don't name it)."""
    return cases_a(records).select(F.explode("events").alias("e")).select("e.*")


# ------------------------------------------------------------------------------------------- venue B


def instruments(records: DataFrame) -> DataFrame:
    """Contract specifications: live linear swaps of the configured symbols whose contract is in the base currency."""
    row = "struct<instId:string,instType:string,ctType:string,ctVal:string,ctMult:string,ctValCcy:string,state:string>"
    r = parsed(records, f"code string, data array<{row}>", F.col("raw_payload").cast("string")).where("m.code = '0'").select(F.explode("m.data").alias("i"))
    ok = (F.col("i.state") == "live") & (F.col("i.ctType") == "linear") & (F.col("i.ctValCcy") == F.split("i.instId", "-")[0]) & (dec(F.col("i.ctVal")) > 0) & (dec(F.col("i.ctMult")) > 0)
    symbol = canonical(VENUE_B, F.col("i.instId"))
    return r.where(ok & symbol.isNotNull()).select(F.col("i.instId").alias("venue_symbol"), symbol.alias("symbol"), dec(F.col("i.ctVal")).cast("decimal(18,8)").alias("contract_value"), dec(F.col("i.ctMult")).cast("decimal(18,8)").alias("multiplier"))


def cases_b(records: DataFrame, specs: DataFrame) -> DataFrame:
    """The rows of the records' data with ``kind`` and ``events`` (null: rejected; an empty book update has none)."""
    text = F.col("raw_payload").cast("string")
    message = F.from_json(text, "arg struct<channel:string,instId:string>, action string, data array<map<string,string>>")
    r = records.withColumn("w", message).select(*(c for c in records.columns if c != "symbol"), F.col("w.arg.channel").alias("kind"), F.col("w.arg.instId").alias("arg_inst"), F.col("w.action").alias("action"), F.explode_outer("w.data").alias("d"))
    d = lambda name: F.col("d")[name]
    inst = F.when(F.col("kind").isin("books", "books5"), F.col("arg_inst")).when(F.col("kind") == "index-tickers", F.concat(d("instId"), F.lit("-SWAP"))).otherwise(d("instId"))
    known = specs.select("venue_symbol", "symbol", (F.col("contract_value") * F.col("multiplier")).cast("decimal(20,10)").alias("factor"))
    r = r.join(F.broadcast(known), inst == F.col("venue_symbol"), "left")  # one row for each configured symbol at most
    wide = lambda c: c.try_cast("decimal(38,18)")
    base = lambda c: dec(c) * F.col("factor")
    ms = lambda c: c.try_cast("long") * 1000
    made = lambda **values: event(exchange=F.lit(VENUE_B), symbol=F.col("symbol"), recv_us=F.col("recv_us"), **values)
    side = lambda name: F.transform(F.from_json(d(name), "array<array<string>>"), lambda x: F.struct(dec(x[0]).alias("price"), base(x[1]).cast(DEC).alias("quantity")))
    bids, asks = side("bids"), side("asks")
    details = F.from_json(d("details"), "array<struct<bkPx:string,posSide:string,side:string,sz:string,ts:string>>")

    def liquidation(x: Column, place: Column) -> Column:
        held = F.when(x["posSide"].isin("long", "short"), F.upper(x["posSide"])).otherwise(F.when(x["side"] == "sell", "LONG").otherwise("SHORT"))
        return made(event_type=F.lit("LIQUIDATION"), us=ms(x["ts"]), trade_id=F.concat_ws(":", d("instId"), x["ts"], place), side=held, price=dec(x["bkPx"]), quantity=base(x["sz"]), contracts=x["sz"])

    def case(names: tuple[str, ...], needed: list[Column], events: Column) -> tuple[Column, Column]:
        holds = F.col("kind").isin(*names) & F.col("symbol").isNotNull()
        for c in needed:
            holds = holds & c.isNotNull()
        return holds, events

    empty = (F.size(bids) + F.size(asks)) == 0
    book = made(event_type=F.when((F.col("kind") == "books5") | (F.col("action") == "snapshot"), "BOOK_SNAPSHOT").otherwise("BOOK_UPDATE"), us=ms(d("ts")), sequence_id=d("seqId"), previous_sequence_id=d("prevSeqId"), bids=bids, asks=asks)
    cases = [
        case(("trades",), [dec(d("px")), dec(d("sz")), ms(d("ts"))], F.array(made(event_type=F.lit("TRADE"), us=ms(d("ts")), sequence_id=d("seqId"), trade_id=d("tradeId"), side=F.upper(d("side")), price=dec(d("px")), quantity=base(d("sz")), contracts=d("sz")))),
        case(("books", "books5"), [d("bids"), d("asks")], F.filter(F.array(book), lambda e: ~empty)),
        case(("open-interest",), [wide(d("oi"))], F.array(made(event_type=F.lit("OPEN_INTEREST"), us=ms(d("ts")), contracts=wide(d("oi")), quantity=wide(d("oiCcy")), quote_quantity=wide(d("oiUsd"))))),
        case(("funding-rate",), [wide(d("fundingRate"))], F.array(made(event_type=F.lit("FUNDING"), us=ms(d("ts")), rate=wide(d("fundingRate"))))),
        case(("mark-price",), [dec(d("markPx"))], F.array(made(event_type=F.lit("MARK"), us=ms(d("ts")), price=dec(d("markPx"))))),
        case(("index-tickers",), [dec(d("idxPx"))], F.array(made(event_type=F.lit("INDEX"), us=ms(d("ts")), price=dec(d("idxPx"))))),
        case(("liquidation-orders",), [d("details")], F.filter(F.transform(details, liquidation), lambda e: e["price"].isNotNull() & e["quantity"].isNotNull())),
    ]
    return r.withColumn("events", one_of(cases)).drop("d", "arg_inst", "action", "venue_symbol", "symbol", "factor")


def venue_b(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Events of venue B's records; contracts become base quantities by the specifications."""
    return cases_b(records, specs).select(F.explode("events").alias("e")).select("e.*")


def rejected(records: DataFrame, specs: DataFrame) -> DataFrame:
    """exchange, kind, n: messages (rows of data at venue B) that give no event because of what they lack or name."""
    market = market_records(records)
    a = cases_a(market.where(F.col("exchange") == VENUE_A)).where("events is null").select(F.lit(VENUE_A).alias("exchange"), "kind")
    b = cases_b(market.where(F.col("exchange") == VENUE_B), specs).where("events is null").select(F.lit(VENUE_B).alias("exchange"), "kind")
    return a.unionByName(b).groupBy("exchange", "kind").agg(F.count(F.lit(1)).alias("n"))


def market_records(records: DataFrame) -> DataFrame:
    return records.where(~F.col("channel").isin("_normalized_event", "_timeline_end", "_lifecycle", "instrument_metadata", "server_time"))


def normalize(records: DataFrame, specs: DataFrame) -> DataFrame:
    """All market events of mixed raw records; internal and metadata channels are left out."""
    market = market_records(records)
    return venue_a(market.where(F.col("exchange") == VENUE_A)).unionByName(venue_b(market.where(F.col("exchange") == VENUE_B), specs))


def valid(events: DataFrame) -> Column:
    """Positive values, sorted sides, uncrossed books."""
    sorted_by = lambda c, up: F.col(c).isNull() | F.forall(F.sequence(F.lit(2), F.greatest(F.size(c), F.lit(2))), lambda i: (F.size(c) < 2) | ((F.try_element_at(F.col(c), i)["price"] > F.try_element_at(F.col(c), i - 1)["price"]) == F.lit(up)))
    best = lambda c: F.try_element_at(F.col(c), F.lit(1))["price"]
    crossed = (F.col("event_type") == "BOOK_SNAPSHOT") & (best("bids") >= best("asks"))
    return (F.col("price").isNull() | (F.col("price") > 0)) & (F.col("quantity").isNull() | (F.col("quantity") >= 0)) & ~F.coalesce(crossed, F.lit(False)) & ((F.col("event_type") != "BOOK_SNAPSHOT") | (sorted_by("bids", False) & sorted_by("asks", True)))
