"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most 3 bits, some two of the three segments differ in at most 1 bit each (pigeonhole: the two segments
with the fewest errors have at most 1 each). A segment is a word of the perfect [23, 12, 7] code's space,
padded with zeros. For a word x let K(x) be the codewords within distance 4 of x, which is the nearest one
alone when it is within 2, or 6 of them when it is at 3. If x and y differ in at most 1 bit, the nearest
codeword of y is in K(x): it is within 3 of y, so within 4 of x.

So every fingerprint publishes one key for each pair of segments (its two nearest codeword indices) and
probes with all combinations of K for that pair (about 28 keys of 24 bits), and each link is found by a
probe whichever side it starts from. Joined pairs are verified by counting differing bits.

Scale: equal fingerprints are one node before any key is made, so copies make no pairs. Each link between
two fingerprints is kept from the smaller one only. The tables for the code have 2048 rows and are made
from its generator polynomial.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and links like any
other; repeated rows share a fingerprint; a null doc_id never names a component (a component of nulls only
has a null one); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import components, cut, small_batches, text_blocks, word_bounds

WORDS = 3
SEED = 42
MOST_BITS = 3
#: Bits of the three segments, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23, 12, 7] Golay code, and the length.
GENERATOR, LENGTH = 0b101011100011, 23

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


# ------------------------------------------------------------------------------------- fingerprints


def block_fingerprints(buf: np.ndarray, off: np.ndarray, k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """One 64-bit fingerprint for each row of a text block."""
    rows = len(off) - 1
    out = np.zeros(rows, np.uint64)
    starts, ends, first = word_bounds(buf, off)
    if not len(starts):
        return out
    # words joined by one space, so that a shingle is one stretch of bytes
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[buf[~_is_gap(buf, starts, ends)]]
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    shingle_row = np.repeat(np.arange(rows), count)
    begin_word = np.arange(len(shingle_row)) - np.repeat(np.cumsum(count) - count, count) + first[shingle_row]
    end_word = np.minimum(begin_word + k, first[shingle_row + 1])
    data = joined.tobytes()
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(data[s:e], seed) for s, e in zip(at[begin_word].tolist(), (at[end_word] - 1).tolist(), strict=True)], np.uint64)
    full = np.flatnonzero(count)
    heads = (np.cumsum(count) - count)[full]
    # set bits at each place, summed over the shingles of each row
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > count[full, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def _is_gap(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    gap = np.zeros(len(buf) + 1, np.int8)
    gap[starts] += 1
    gap[ends] -= 1
    return np.cumsum(gap[:-1], dtype=np.int8) == 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (bigint with the 64 bits) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [block_fingerprints(buf, off, k, seed) for _, _, buf, off in text_blocks(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------- Golay code


def _syndrome_table(shift_bytes: int) -> np.ndarray:
    """Syndromes (remainders by the generator) of all values of one byte of a word."""
    table = np.zeros(256, np.int32)
    for v in range(256):
        x = v << (8 * shift_bytes)
        for bit in range(31, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        table[v] = x
    return table


class Golay:
    """Coset tables of the code: for each syndrome the error patterns of weight 4 or less."""

    def __init__(self) -> None:
        self.bytes = [_syndrome_table(i) for i in range(3)]
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for places in combinations(range(LENGTH), weight):
                e = sum(1 << p for p in places)
                s = self.syndrome(np.array([e]))[0]
                if not found[s] or weight == 4 and bin(found[s][0]).count("1") == 3:
                    found[s].append(e)
        self.count = np.array([len(x) for x in found])
        self.errors = np.array([x + [0] * (6 - len(x)) for x in found], np.int64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.bytes[0][x & 255] ^ self.bytes[1][x >> 8 & 255] ^ self.bytes[2][x >> 16 & 255]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Index (12 message bits) of the nearest codeword of each word."""
        return (x ^ self.errors[self.syndrome(x), 0]) >> 11

    def within_4(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within distance 4: (6 columns, how many of them count)."""
        s = self.syndrome(x)
        return (x[:, None] ^ self.errors[s]) >> 11, self.count[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]


def published_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key): one for each pair of segments."""
    near = [golay().nearest(x) for x in segments(fp)]
    keys = [(p << 24) | (near[i] << 12) | near[j] for p, (i, j) in enumerate(combinations(range(3), 2))]
    return np.tile(np.arange(len(fp)), 3), np.concatenate(keys)


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key): all combinations of nearby codewords for each pair of segments."""
    near = [golay().within_4(x) for x in segments(fp)]
    rows, keys = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (a, na), (b, nb) = near[i], near[j]
        use = (np.arange(6) < na[:, None])[:, :, None] & (np.arange(6) < nb[:, None])[:, None, :]
        key = (p << 24) | (a[:, :, None] << 12) | b[:, None, :]
        rows.append(np.nonzero(use)[0])
        keys.append(key[use])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame, make, step: int = 4000) -> DataFrame:
    """key, fp for every key that ``make`` gives to a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), step):
                part = fp[i : i + step]
                rows, keys = make(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key int, fp long")


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs a < b (as signed numbers) of distinct fingerprints that differ in ``most_bits`` (3 at most) bits or fewer."""
    if most_bits > MOST_BITS:
        raise ValueError("three segments find differences of at most 3 bits")
    a = keyed(nodes, probe_keys).withColumnRenamed("fp", "a")
    b = keyed(nodes, published_keys).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    return a.join(b.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = links(nodes, most_bits)
    # components over fingerprints, then their smallest document
    reach = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = nodes.join(reach, nodes["fp"] == reach["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class"))
    smallest = grouped.groupBy("class").agg(F.min("first_id").alias("component_id"))
    label = grouped.join(smallest, "class").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
