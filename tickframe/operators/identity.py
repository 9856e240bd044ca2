"""What identifies an event, a row or a tree of sources, and checks of rows against it; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import scalars as S
from tickframe.operators import timeline as TL
from tickframe.sources.normalize import SYMBOLS
from tickframe.sources.raw import END

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: What receiving and processing an event adds to it.
LOCAL = ("local_receive_timestamp", "normalization_timestamp", "raw_payload_reference", "receive_latency_ms", "recv_us", "ord")
#: Fixed prefix of a lineage reference.
SOURCES_URI = "feature-sources://sha256-sum-xor-v1/"


def canonical_value(c: Column, kind: T.DataType) -> Column:
    """A value as JSON takes it: bytes as digest and length, times as ISO text in UTC, decimals as text, nested alike."""
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.sha2(c, 256).alias("bytes_sha256"), F.octet_length(c).alias("length")))
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros(c)
        utc = F.timestamp_add("MICROSECOND", at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return F.concat(F.date_format(utc, ISO), F.lit("+00:00"))
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, ISO)
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical_value(x, kind.elementType))
    if isinstance(kind, T.StructType):
        names = sorted(kind.names)
        return F.when(c.isNotNull(), F.struct(*(canonical_value(c[n], kind[n].dataType).alias(n) for n in names)))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))  # by key
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].cast("string"), canonical_value(e["value"], kind.valueType))))
    return c


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON of the columns by name, nulls kept, without spaces; the same row gives the same text in any run."""
    return F.to_json(F.struct(*(canonical_value(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def event_identity(df: DataFrame, local: tuple[str, ...] = LOCAL) -> Column:
    """SHA-256 of an event's own values: two receipts of the same event have one identity."""
    return F.sha2(canonical_json(df, [c for c in df.columns if c not in local]), 256)


def payload_hash(df: DataFrame, computed: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a row without the columns that are computed from others."""
    return F.sha2(canonical_json(df, [c for c in df.columns if c not in computed]), 256)


def lineage_uri(count: Column, total: Column, xor: Column, oldest: Column, newest: Column) -> Column:
    """Reference to the sources of a snapshot: the digest of their count, sums and time bounds (microseconds)."""
    return F.concat(F.lit(SOURCES_URI), F.sha2(S.canonical_text(count, total, xor, oldest, newest), 256))


def partition_value(c: Column) -> Column:
    """Percent-encoded text of a partition folder; letters, digits and ``-_.~`` stay."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


# ------------------------------------------------------------------------------- records and streams


def is_known(universe: dict[str, tuple[str, ...]], everywhere: tuple[str, ...] = ("health",), kind: str = "kind") -> Column:
    """Whether (exchange, symbol) is configured; ``*`` stands for all symbols in the kinds ``everywhere`` only."""
    known = F.lit(False)
    for exchange, symbols in universe.items():
        all_symbols = (F.col("symbol") == "*") & F.col(kind).isin(*everywhere)
        known = known | ((F.col("exchange") == exchange) & (F.col("symbol").isin(*symbols) | all_symbols))
    return F.coalesce(known, F.lit(False))


def require_known(events: DataFrame, universe: dict[str, tuple[str, ...]], kind: str = "kind") -> DataFrame:
    """The events; one of an unknown key fails the query."""
    unknown = F.raise_error(F.concat(F.lit("not configured: "), F.coalesce("exchange", F.lit("null")), F.lit(" "), F.coalesce("symbol", F.lit("null"))))
    return events.withColumn("symbol", F.when(is_known(universe, kind=kind), F.col("symbol")).otherwise(unknown))


def stamp_generations(events: DataFrame, opens: Column, keys: list[str] = TL.KEYS) -> DataFrame:
    """``generation`` of each event: how often its stream was opened so far, the opening event included."""
    one = F.when(opens, 1).otherwise(0)
    sliced = TL.with_before(events, keys, {"_opened": one}, agg=F.sum)
    upto = Window.partitionBy(*keys, "slice").orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.withColumn("generation", F.coalesce("_opened", F.lit(0)) + F.sum(one).over(upto)).select(*events.columns, "generation")


def routes(messages: DataFrame, venue: str, body: str = "body") -> DataFrame:
    """Channel, symbol, time and sequence of each websocket message, without decoding the rest of it.

    The first venue names the channel after ``@`` of its stream, or by the event; the second in ``arg``, where
    liquidations, and symbols that aren't configured, are of all symbols (``*``) and anything else is control.
    """
    symbols = F.create_map(*(F.lit(x) for kv in SYMBOLS[venue].items() for x in kv))
    at = lambda path: F.get_json_object(body, path)
    if venue == tuple(SYMBOLS)[0]:
        data = lambda name: F.coalesce(at(f"$.data.{name}"), F.when(at("$.data").isNull(), at(f"$.{name}")))
        stream = at("$.stream")
        channel = F.when(stream.contains("@"), F.regexp_extract(stream, "@(.*)$", 1)).otherwise(F.coalesce(data("e"), F.lit("_unknown")))
        symbol = F.try_element_at(symbols, F.coalesce(data("s"), data("o.s")))
        us, sequence = F.coalesce(data("T"), data("E"), data("o.T")), F.coalesce(data("u"), data("a"))
    else:
        control = at("$.arg").isNull()
        name = F.coalesce(at("$.arg.channel"), F.lit("_unknown"))
        channel = F.when(control, "_control").otherwise(name)
        own = F.try_element_at(symbols, F.coalesce(at("$.arg.instId"), at("$.data[0].instId")))
        symbol = F.when(control | (name == "liquidation-orders"), "*").otherwise(F.coalesce(own, F.lit("*")))
        us = F.when(~control, F.coalesce(at("$.data[0].ts"), at("$.data[0].details[0].ts")))
        sequence = F.when(~control, at("$.data[0].seqId"))
    return messages.select("*", channel.alias("channel"), symbol.alias("symbol"), (us.try_cast("bigint") * 1000).alias("us"), sequence.alias("sequence_id"))


def with_end(records: DataFrame) -> DataFrame:
    """Journal rows (channel, recv_us, record_id) and the one row that ends their timeline, at the last receive time."""
    end = records.agg(F.max("recv_us").alias("recv_us")).where("recv_us is not null").withColumns({"channel": F.lit(END), "record_id": F.lit("timeline-end")})
    return records.unionByName(end, allowMissingColumns=True)


def end_violations(records: DataFrame) -> DataFrame:
    """Whether a journal ends as it must (one row): number of end rows, and of rows received after the end."""
    marks = records.agg(F.sum(F.when(F.col("channel") == END, 1).otherwise(0)).cast("long").alias("ends"), F.max(F.when(F.col("channel") == END, F.col("recv_us"))).alias("end_us"))
    late = records.join(F.broadcast(marks), F.col("recv_us") > F.col("end_us")).agg(F.count(F.lit(1)).alias("after_end"))  # one row on the broadcast side
    return marks.select("ends").join(late)


# ------------------------------------------------------------------------------------- stored rows


def payload_violations(stored: DataFrame, schema: str, payload: str = "payload", digest: str = "payload_sha256") -> DataFrame:
    """Rows whose columns disagree with their JSON payload or its digest, with the names that do (``violations``)."""
    fields = T.StructType.fromDDL(schema).names
    read = stored.withColumn("_p", F.from_json(payload, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    unread = F.col("_p").isNull() | F.col("_p._broken").isNotNull()
    checks = [(unread, "payload"), (~F.sha2(payload, 256).eqNullSafe(F.col(digest)), digest), *((~unread & ~F.col(f"_p.{c}").eqNullSafe(F.col(c)), c) for c in fields)]
    return read.withColumn("violations", S.reasons(*checks)).where(F.size("violations") > 0).drop("_p")


def roll_up(iterations: DataFrame) -> DataFrame:
    """Totals over repeated runs (rows, seconds, peak_bytes, passed, digest; one row): one digest if all agree."""
    return iterations.agg(
        F.count(F.lit(1)).alias("iterations"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.max("peak_bytes").alias("peak_bytes"),
        F.coalesce(F.every("passed"), F.lit(False)).alias("all_passed"), (F.count_distinct("digest") <= 1).alias("same_digest"),
    )
