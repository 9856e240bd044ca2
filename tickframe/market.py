"""A market view over the driver's event table: one wide table of typed market events.

Columns: exchange, symbol, family (the stream an event belongs to), kind, us (event time), recv_us
(receive time), ord (ingest tie-break), and nullable values by kind. A ``view`` row of the source gives
four events (open interest, funding, mark, index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.scalars import micros

VENUE_A, VENUE_B = "BINANCE", "OKX"
SYMBOLS = ("BTC-USDT-PERP", "ETH-USDT-PERP")
KEYS = ["exchange", "symbol"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    us, k = micros("ts"), F.get_json_object("props", "$.k").try_cast("int")
    return e.select(
        F.col("event_id").alias("ord"),
        us.alias("us"),
        (us + (F.col("event_id") * 7919) % 600 * 1_000_000).alias("recv_us"),
        F.when(F.col("user_id") % 2 == 0, VENUE_A).otherwise(VENUE_B).alias("exchange"),
        F.when(F.floor(F.col("user_id") / 2) % 2 == 0, SYMBOLS[0]).otherwise(SYMBOLS[1]).alias("symbol"),
        "event_type",
        "value",
        k.alias("k"),
        (F.lit(100.0) + F.col("value") / 10).alias("price"),
        (F.lit(1.0) + k / 10).alias("qty"),
    )


#: The stream that an event belongs to.
FAMILY = "CASE WHEN event_type IN ('click', 'purchase') THEN 'trade' WHEN event_type = 'view' THEN 'quote' WHEN event_type = 'error' THEN 'liquidation' WHEN event_type = 'signup' THEN 'book' END"


def trades(view: DataFrame) -> DataFrame:
    side = F.when(F.col("event_type") == "click", "BUY").otherwise("SELL")
    return view.where(F.col("event_type").isin("click", "purchase")).select(*KEYS, F.lit("trade").alias("family"), "us", "recv_us", "ord", "price", "qty", side.alias("side"), (F.col("price") * F.col("qty")).alias("notional"))


def quotes(view: DataFrame) -> DataFrame:
    """Open interest, funding, mark and index, which arrive together."""
    shift = F.col("k") - 50
    return view.where("event_type = 'view'").select(
        *KEYS, F.lit("quote").alias("family"), "us", "recv_us", "ord", (F.lit(1000.0) + F.col("value") * 3 + F.col("k")).alias("oi"), (shift / F.lit(100_000.0)).alias("funding"), F.col("price").alias("mark"), (F.col("price") * (F.lit(1.0) + shift / F.lit(10_000.0))).alias("index")
    )


def liquidations(view: DataFrame) -> DataFrame:
    side = F.when(F.col("k") % 2 == 0, "LONG").otherwise("SHORT")
    return view.where("event_type = 'error'").select(*KEYS, F.lit("liquidation").alias("family"), "us", "recv_us", "ord", side.alias("position"), (F.col("price") * F.col("qty")).alias("notional"))


def levels(view: DataFrame) -> DataFrame:
    """Absolute level quantities of the order book; 0 deletes the level."""
    bid = F.col("ord") % 2 == 0
    return view.where("event_type = 'signup'").select(
        *KEYS, F.lit("book").alias("family"), "us", "recv_us", "ord", F.when(bid, "BID").otherwise("ASK").alias("side"), F.when(bid, F.lit(99) - F.col("k") % 10).otherwise(F.lit(101) + F.col("k") % 10).cast("double").alias("price"), F.when(F.col("k") % 7 == 0, F.lit(0.0)).otherwise(F.floor("value").cast("double")).alias("qty")
    )


#: The same view in the oracle's dialect, as common table expressions.
ORACLE = f"""
base AS (
  SELECT event_id AS ord, epoch_us(ts) AS us, epoch_us(ts) + (event_id * 7919) % 600 * 1000000 AS recv_us,
    CASE WHEN user_id % 2 = 0 THEN '{VENUE_A}' ELSE '{VENUE_B}' END AS exchange,
    CASE WHEN (user_id // 2) % 2 = 0 THEN '{SYMBOLS[0]}' ELSE '{SYMBOLS[1]}' END AS symbol,
    event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) AS k, 100.0::DOUBLE + value / 10 AS price
  FROM events),
view0 AS (SELECT *, 1.0::DOUBLE + k::DOUBLE / 10 AS qty FROM base),
trades0 AS (SELECT exchange, symbol, us, recv_us, ord, price, qty, CASE WHEN event_type = 'click' THEN 'BUY' ELSE 'SELL' END AS side, price * qty AS notional
  FROM view0 WHERE event_type IN ('click', 'purchase')),
quotes0 AS (SELECT exchange, symbol, us, recv_us, ord, 1000.0::DOUBLE + value * 3 + k AS oi, (k - 50) / 100000.0::DOUBLE AS funding, price AS mark, price * (1.0::DOUBLE + (k - 50) / 10000.0::DOUBLE) AS index
  FROM view0 WHERE event_type = 'view'),
liquidations0 AS (SELECT exchange, symbol, us, recv_us, ord, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS position, price * qty AS notional FROM view0 WHERE event_type = 'error'),
levels0 AS (SELECT exchange, symbol, us, recv_us, ord, CASE WHEN ord % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
    CAST(CASE WHEN ord % 2 = 0 THEN 99 - k % 10 ELSE 101 + k % 10 END AS DOUBLE) AS price, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE floor(value) END AS qty
  FROM view0 WHERE event_type = 'signup')"""
