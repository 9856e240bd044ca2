"""Raw records: schema, scan filters, source choice, journal records; read by Spark from any path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schema of a raw record; the date of receipt is a path column beside it.
RAW_SCHEMA = (
    "schema_version smallint, record_id string, raw_payload_reference string, exchange string, symbol string, channel string, message_kind string, transport string, "
    "exchange_timestamp timestamp, local_receive_timestamp timestamp, normalization_timestamp timestamp, sequence_id string, connection_generation bigint, raw_payload binary"
)
REQUIRED = ("schema_version", "record_id", "raw_payload_reference", "exchange", "symbol", "channel", "message_kind", "transport", "local_receive_timestamp", "connection_generation", "raw_payload")
SCHEMA_VERSION = 1
JOURNAL, END, METADATA = "_normalized_event", "_timeline_end", "instrument_metadata"
INTERNAL = (JOURNAL, END, "_lifecycle")


@dataclass(frozen=True)
class ScanFilter:
    """Inclusive receive-time range in microseconds, allowed values, excluded channels; None allows all."""

    start_us: int | None = None
    end_us: int | None = None
    exchanges: frozenset[str] | None = None
    symbols: frozenset[str] | None = None
    channels: frozenset[str] | None = None
    excluded_channels: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if self.start_us is not None and self.end_us is not None and self.start_us > self.end_us:
            raise ValueError("the range is reversed")
        if self.channels and self.channels & self.excluded_channels:
            raise ValueError("a channel is both wanted and excluded")

    def condition(self, folders: frozenset[str] = frozenset()) -> Column:
        """Plain comparisons on stored columns, pushed down; those on partition folders (``p_<column>``) prune them."""
        c, at = F.lit(True), F.col("local_receive_timestamp")
        if self.start_us is not None:
            c &= at >= F.timestamp_micros(F.lit(self.start_us))
        if self.end_us is not None:
            c &= at <= F.timestamp_micros(F.lit(self.end_us))
        for name, allowed in (("exchange", self.exchanges), ("symbol", self.symbols), ("channel", self.channels)):
            if allowed is not None:
                c &= F.col(name).isin(*sorted(allowed))
                if f"p_{name}" in folders:
                    c &= F.col(f"p_{name}").isin(*sorted(allowed))
        return c & ~F.col("channel").isin(*sorted(self.excluded_channels)) if self.excluded_channels else c


def read(spark: SparkSession, root: str, filters: ScanFilter | None = None) -> DataFrame:
    """Scan a tree of raw records in the fixed schema, never inferred; its folders, if any, are pruned."""
    folders = [f for f in ("p_exchange", "p_symbol", "p_channel") if f in spark.read.parquet(root).columns]
    df = spark.read.schema(", ".join([RAW_SCHEMA, *(f"{f} string" for f in folders)])).parquet(root)
    return df.where((filters or ScanFilter()).condition(frozenset(folders))).drop(*folders)


def has_channel(df: DataFrame, channel: str) -> bool:
    return not df.where(F.col("channel") == channel).select(F.lit(1)).limit(1).isEmpty()


def resolve_source(df: DataFrame, mode: str = "AUTO") -> str:
    """RAW or JOURNAL from what is stored; a journal without its end mark is refused."""
    if mode == "RAW":
        return "RAW"
    journal = has_channel(df, JOURNAL)
    if not journal:
        if mode == "JOURNAL":
            raise ValueError("there is no journal")
        return "RAW"
    if df.where(F.col("channel") == END).count() != 1:
        raise ValueError("a journal needs exactly one end mark")
    return "JOURNAL"


def check_lineage(captured: dict[str, str], runtime: dict[str, str]) -> None:
    """Refuse a journal that other code or other settings captured; what the capture doesn't state differs too."""
    if differ := [k for k in sorted(runtime) if captured.get(k) != runtime[k]]:
        raise ValueError(f"the journal was captured by another engine: {', '.join(differ)}")


def journal_record(events: DataFrame, fields: list[str]) -> DataFrame:
    """Events as journal rows: canonical JSON (fields by name, nulls kept) in the payload."""
    body = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return events.select("exchange", "symbol", F.lit(JOURNAL).alias("channel"), "us", "recv_us", body.cast("binary").alias("raw_payload"))


def journal_events(records: DataFrame, schema: str) -> DataFrame:
    """The events of journal rows; envelope and payload must agree."""
    e = records.where(F.col("channel") == JOURNAL).withColumn("e", F.from_json(F.col("raw_payload").cast("string"), schema))
    agree = (F.col("e.exchange") == F.col("exchange")) & (F.col("e.symbol") == F.col("symbol"))
    return e.select(F.when(agree, F.col("e")).otherwise(F.raise_error(F.lit("journal row disagrees with its payload"))).alias("e")).select("e.*")


def quality(df: DataFrame) -> DataFrame:
    """Violations of each rule over a tree (one row)."""
    bad = lambda c: F.sum(F.when(F.coalesce(c, F.lit(True)), 1).otherwise(0))
    missing = [F.col(c).isNull() for c in REQUIRED]
    anyone = missing[0]
    for m in missing[1:]:
        anyone = anyone | m
    return df.agg(
        bad(anyone).alias("missing_required"), bad(F.col("schema_version") != SCHEMA_VERSION).alias("wrong_version"), bad(F.octet_length("raw_payload") == 0).alias("empty_payload"),
        bad(F.col("raw_payload_reference") != F.concat(F.lit("raw://"), F.col("record_id"))).alias("wrong_reference"), (F.count(F.lit(1)) - F.countDistinct("record_id")).alias("repeated_ids"),
    )
