"""Audits, comparisons, idempotent sinks and compaction of stored trees."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.functions import scalars as S



def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local master may go without one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class SnapshotFilter:
    """Inclusive decisions and allowed values of stored snapshots; None allows all. ``reasons``: any of them."""

    first_tick: int | None = None
    last_tick: int | None = None
    exchanges: frozenset[str] | None = None
    symbols: frozenset[str] | None = None
    windows: frozenset[int] | None = None
    engine_version: str | None = None
    config_hash: str | None = None
    warm: bool | None = None
    healthy: bool | None = None
    reasons: frozenset[str] | None = None

    def __post_init__(self) -> None:
        if self.first_tick is not None and self.last_tick is not None and self.first_tick > self.last_tick:
            raise ValueError("the range is reversed")

    def applied(self, snapshots: DataFrame) -> DataFrame:
        """Plain comparisons on stored columns, which reach the scan; those on partition folders prune them."""
        c = F.lit(True)
        if self.first_tick is not None:
            c &= F.col("tick_no") >= self.first_tick
        if self.last_tick is not None:
            c &= F.col("tick_no") <= self.last_tick
        for name, allowed in (("exchange", self.exchanges), ("symbol", self.symbols), ("window_ticks", self.windows)):
            if allowed is not None:
                for column in {name, f"p_{name}"} & set(snapshots.columns):
                    c &= F.col(column).isin(*sorted(allowed))
        for name, value in (("engine_version", self.engine_version), ("config_hash", self.config_hash), ("is_warm", self.warm), ("is_healthy", self.healthy)):
            if value is not None:
                c &= F.col(name) == value
        if self.reasons is not None:
            c &= F.arrays_overlap("reason_codes", F.array(*(F.lit(r) for r in sorted(self.reasons))))
        return snapshots.where(c)


AUDIT = ["rows", "ids", "payload_bytes", "partitions", "digest_sum"]


def raw_audit(records: DataFrame, id_col: str, payload: Column, partition: Column) -> DataFrame:
    """Rows, distinct ids, payload bytes, partitions and an order-independent digest (one row).

    The digest sums each row's SHA-256 as eight 32-bit limbs: partial sums on every executor, carried once.
    """
    leaf = F.sha2(F.concat(F.col(id_col).cast("string").cast("binary"), F.lit(b"\x1f"), payload.cast("binary")), 256)
    base = records.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("size"), partition.alias("part"), leaf.alias("leaf"))
    agg = base.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.coalesce(F.sum("size"), F.lit(0)).alias("payload_bytes"), F.countDistinct("part").alias("partitions"), *S.digest_sum("leaf"))
    return agg.select("rows", "ids", "payload_bytes", "partitions", S.carried().alias("digest_sum"))


def feature_audit(snapshots: DataFrame) -> DataFrame:
    """Rows, distinct ids, scopes, symbols, time bounds and warm and healthy counts (one row)."""
    return snapshots.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("snapshot_id").alias("ids"), F.countDistinct("exchange").alias("scopes"), F.countDistinct("symbol").alias("symbols"), F.min("tick_no").alias("first_tick"), F.max("tick_no").alias("last_tick"),
        F.sum(F.col("is_warm").cast("long")).alias("warm"), F.sum(F.col("is_healthy").cast("long")).alias("healthy"),
    )


def looks_ahead(tick: int) -> Column:
    """A snapshot that used a source newer than its decision."""
    return F.coalesce(F.col("newest_us") > F.col("tick_no") * tick, F.lit(False))


def breaks_invariants() -> Column:
    """A snapshot that is cold without a reason, from the future, or out of a value's range."""
    rules = (~F.col("is_warm") & (F.size("reason_codes") == 0), F.col("data_age_ms") < 0, F.abs("taker_imbalance") > 1, F.col("spread") <= 0)
    broken = F.lit(False)
    for r in rules:
        broken = broken | F.coalesce(r, F.lit(False))
    return broken


def reason_histogram(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def same_tree(left: DataFrame, right: DataFrame) -> bool:
    """Whether two one-row audits agree."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def differences(left: DataFrame, right: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Ids on one side only, or whose contents differ."""
    body = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256).alias("h"))
    l, r = body(left).withColumnRenamed("h", "l"), body(right).withColumnRenamed("h", "r")
    kind = F.when(F.col("l").isNull(), "RIGHT_ONLY").when(F.col("r").isNull(), "LEFT_ONLY").otherwise("DIFFERENT")
    return l.join(r, key, "full").where("l is null or r is null or l <> r").select(key, kind.alias("kind"))


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "snapshot_id", content: str = "payload_sha256") -> DataFrame:
    """Rows of a batch that are not stored yet; the same id with other content, stored or in the batch, fails the query."""
    once = batch.dropDuplicates([key, content])
    twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    once = once.withColumn(content, F.when(twice, F.raise_error(F.lit("an id has two contents in one batch"))).otherwise(F.col(content)))
    old = stored.select(F.col(key).alias("old_id"), F.col(content).alias("old_content"))
    joined = once.join(old, once[key] == F.col("old_id"), "left")
    clash = F.col("old_content").isNotNull() & (F.col("old_content") != F.col(content))
    return joined.withColumn("old_id", F.when(clash, F.raise_error(F.lit("an id is stored with other content"))).otherwise(F.col("old_id"))).where("old_id is null").drop("old_id", "old_content")


def write_partitioned(df: DataFrame, root: str, partitions: list[str], sort: list[str], mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """zstd Parquet under partition folders. The partition columns' values stay in the rows under ``<name>`` too."""
    folders = [f"p_{p}" for p in partitions]
    copied = df.drop(*folders).select("*", *(F.col(p).alias(f"p_{p}") for p in partitions))
    copied.repartition(*folders).sortWithinPartitions(*folders, *sort).write.mode(mode).partitionBy(*folders).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(root)


def append_features(batch: DataFrame, root: str, key: str = "snapshot_id", content: str = "payload_sha256") -> None:
    """Idempotent sink: rows whose id is stored are left out, so a rerun adds nothing."""
    spark = batch.sparkSession
    stored = spark.read.parquet(root).select(key, content) if exists(spark, root) else batch.select(key, content).limit(0)
    write_partitioned(new_rows(batch, stored, key, content), root, ["symbol", "exchange"], ["tick_no", "window_ticks", key])


def compact(df: DataFrame, output: str, partitions: list[str], sort: list[str], id_col: str, payload: Column, partition: Column, rows_per_file: int = 100_000) -> DataFrame:
    """Rewrite into few files for each partition and return both audits; they must agree."""
    before = raw_audit(df, id_col, payload, partition)
    write_partitioned(df, output, partitions, sort, "errorifexists", rows_per_file)
    after = raw_audit(df.sparkSession.read.parquet(output), id_col, payload, partition)
    if not same_tree(before, after):
        raise ValueError("compaction changed the tree")
    return before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))


def health_as_of(events: DataFrame, ticks: DataFrame, tick: int) -> DataFrame:
    """Latest status of each channel at each decision: exchange-wide rows (symbol '*') reach all symbols.

    At equal times the symbol's own row wins, then the later one. events: exchange, symbol, channel, us, ord, status.
    """
    symbols = ticks.select("exchange", "symbol").distinct()
    wide = events.where("symbol = '*'").drop("symbol").join(symbols, "exchange").withColumn("own", F.lit(0))
    every = wide.unionByName(events.where("symbol <> '*'").withColumn("own", F.lit(1)))
    enters = every.withColumn("tick_no", F.expr(f"(us + {tick - 1}) div {tick}")).groupBy("exchange", "symbol", "channel", "tick_no").agg(F.max(F.struct("us", "own", "ord", "status")).alias("found"))
    asked = ticks.join(every.select("exchange", "symbol", "channel").distinct(), ["exchange", "symbol"])
    kind = enters.schema["found"].dataType
    both = enters.withColumn("asked", F.lit(0)).unionByName(asked.select("exchange", "symbol", "channel", "tick_no").withColumn("found", F.lit(None).cast(kind)).withColumn("asked", F.lit(1)))
    order = Window.partitionBy("exchange", "symbol", "channel").orderBy("tick_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("found", F.max("found").over(order)).where("asked = 1 and found is not null").select("exchange", "symbol", "channel", "tick_no", F.col("found.status").alias("status"))
