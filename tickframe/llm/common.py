"""Shared pieces of the corpus operators: reading tables, Arrow text blocks, words, hashes, components.

Conventions that hold for every operator here:

* an operator selects the columns it needs by name before anything else, so extra columns (also ones
  whose names clash with its own) never reach its joins;
* a null text counts as the empty text unless the operator says otherwise;
* Arrow batches are cut into blocks of at most ``BLOCK_BYTES`` of text, so memory in a Python worker
  depends on the block and on the longest single text, never on the table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python workers (an upper bound; see ``small_batches``).
BATCH_ROWS = 2000
#: Bytes of text that one numpy block holds (a single longer text makes a longer block).
BLOCK_BYTES = 1 << 21
#: Multiplier of the polynomial hash over bytes (any odd number with well mixed bits).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark alone, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the user sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver, may go without: it gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there. Reliable checkpoints outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, share: int = 1) -> DataFrame:
    """``cut`` as Parquet: for tables of which later steps read some columns only. What was shuffled for it is freed at once.

    With ``share``, a task writes the rows of so many shuffle partitions to one file, where that leaves a task for each
    core. A file is not free: Hadoop's local file system forks the executor's JVM for the rights of each one and of its
    checksum, and until the child has its own program, both count as holding the JVM's memory.
    """
    spark = df.sparkSession
    if share > 1:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-partitions(spark) // share)))
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(free, None)
    spark.conf.set(free, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(free) if before is None else spark.conf.set(free, before)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------------------------- text


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of consecutive rows: (first row, end row, bytes as uint8, offsets of the rows in them).

    Null rows are empty. Each block holds ``BLOCK_BYTES`` at most, or one row.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + BLOCK_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row the index of its first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a row begins here
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BYTE_BASE and of its inverse modulo 2**64, n of each at least; kept between calls."""
    if not _POWERS or len(_POWERS["up"]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        base = int(BYTE_BASE)
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.empty(m, np.uint64)
            p[0], k = 1, 1
            while k < m:
                p[k : 2 * k] = p[:k] * np.uint64(pow(x, k, 1 << 64))
                k *= 2
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes: polynomial over prefix sums, then mixed with its length."""
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the k consecutive values from each position (len - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0xC2B2AE3D27D4EB4F
    done, width, out = 0, 1, None
    power = h  # hash of `width` values from each position
    while True:
        if k & width:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + m]
            done += width
        if done == k:
            return out[:n]
        m = len(power) - width
        power = power[:m] * np.uint64(pow(base, width, 1 << 64)) + power[width : width + m]
        width *= 2


# ---------------------------------------------------------------------------------------- components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns ``src``, ``dst`` (bigint); loops and nulls are ignored. Returns ``node``,
    ``component`` (smallest node reachable) for every node that has an edge to another. Each round costs
    aggregations of one row per edge; a node with very many links is never gathered: its minimum comes
    from partial aggregation and goes back by a join that AQE can split. The rounds needed grow with the
    logarithm of the number of nodes.
    """
    both = F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")
    e = cut(edges.where("src is not null and dst is not null and src <> dst").select(*both).distinct())
    state = None
    for _ in range(max_rounds):
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = cut(
            large.join(small, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
