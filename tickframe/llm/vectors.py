"""Embedding near-duplicates by binary codes under a randomised rotation.

Unit vectors are rotated by one seeded random orthogonal matrix; the signs of the result are the code, and
the inner product of code and vector is stored as the correction factor. Code times rotated vector over
the factor is an unbiased estimate of the inner product of two vectors, with a standard error that the
factor gives. Only pairs whose estimate plus ``BOUND`` standard errors reaches the threshold are computed
again exactly, in double precision, and only those exact values decide.

Pairs are looked for within cells: every vector goes to the ``CELLS_EACH`` nearest of the centroids, which
are fitted on a bounded sample (``SAMPLE_ROWS``). Every vector is indexed; recall against brute force is
tested. A pair that shares several cells counts in the smallest of them.

Scale: equal vectors are one node with a weight before anything is compared, and links are counted, not
listed: a cell returns a number of links for each node and a star of edges for each group it connects. A
cell of more than ``BLOCK`` nodes is split into blocks whose pairs are tasks of their own, so no task holds
more than two blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing
(0 links, their own component); vectors of different lengths never link; a null vec_id is a node of its own
kind that names no component; repeated rows are equal vectors and link with each other; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import components, cut, small_batches

COSINE = 0.9
CELLS_EACH = 4
#: Rows of the sample on which centroids are fitted at most, and vectors to a cell aimed at.
SAMPLE_ROWS = 32_768
PER_CELL, MOST_CELLS = 128, 4096
#: Standard errors added to an estimate before it is compared with the threshold.
BOUND = 3.0
BLOCK = 2048
SEED = 11
#: Pairs that are computed again together.
EXACT_PAIRS = 1 << 16


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose rows all have ``dim`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (packed bits) and correction factors of rotated unit vectors."""
    signs = rotated > 0
    factor = np.where(signs, rotated, -rotated).sum(axis=1) / np.sqrt(rotated.shape[1])
    return np.packbits(signs, axis=1), factor


def estimates(code: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products (codes x vectors), and the standard error for each code."""
    dim = rotated.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    est = (signs @ rotated.T.astype(np.float32)) / (factor * np.sqrt(dim))[:, None]
    return est, np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(dim - 1, 1)))


def linked(x: np.ndarray, y: np.ndarray, cosine: float, same: bool, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with an exact cosine of the threshold or more; same: only i < j."""
    turn = rotation(x.shape[1])
    code, factor = encode(x @ turn)
    est, error = estimates(code, factor, y @ turn)
    maybe = est >= (cosine - bound * error)[:, None]
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    i, j = np.nonzero(maybe)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), EXACT_PAIRS):
        s = slice(k, k + EXACT_PAIRS)
        keep[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= cosine
    return i[keep], j[keep]


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(centroids)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.maximum(norm, 1e-300), centroids)
    return centroids


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, key (digest of the vector, null if it links with nothing), unit (array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b["v"]
            n = b.num_rows
            keys: list[bytes | None] = [None] * n
            units: list[np.ndarray | None] = [None] * n
            flat = col.values
            values, holes = flat.to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
            off = col.offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
            there = col.is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(there & (np.diff(off) > 0) & (np.diff(bad[off]) == 0)):
                v = values[off[i] : off[i + 1]] + 0.0
                peak = np.abs(v).max()
                if peak > 0:
                    keys[i] = hashlib.md5(v.tobytes()).digest()
                    u = v / peak
                    units[i] = u / np.linalg.norm(u)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "key", "unit"])

    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, key binary, unit array<double>")


def assign(nodes: DataFrame, dim: int, n: int, each: int) -> DataFrame:
    """Nodes of one dimension with their cells, nearest first."""
    cells = int(np.clip(n // PER_CELL, 1, MOST_CELLS))
    rows = min(SAMPLE_ROWS, 16 * cells)
    share = min(1.0, 2.0 * rows / n)
    picked = nodes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("key")).limit(rows).select("unit").toArrow()
    centroids = fit_cells(matrix(picked["unit"].combine_chunks(), dim), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = matrix(b["unit"], dim) @ centroids.T
            k = min(each, len(centroids))
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            yield b.append_column("cells", pa.array(list(np.sort(top, axis=1).astype(np.int32)), pa.list_(pa.int32())))

    return nodes.mapInArrow(run, "node long, weight long, key binary, unit array<double>, cells array<int>")


def block_links(cosine: float, dim: int):
    """Function of one pair of blocks of one cell: links counted for each node, and edges of a star for each group."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        cell = t["cell"][0].as_py()
        first = np.flatnonzero(t["side"].to_numpy() == 0)
        second = np.flatnonzero(t["side"].to_numpy() == 1)
        same = not len(second) and t["b1"][0].as_py() == t["b2"][0].as_py()
        second = first if same else second
        node, weight = t["node"].to_numpy(), t["weight"].to_numpy()
        unit = matrix(t["unit"].combine_chunks(), dim)
        cells = np.stack([np.asarray(c) for c in t["cells"].to_pylist()])
        links = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        if len(first) and len(second):
            i, j = linked(unit[first], unit[second], cosine, same)
            i, j = first[i], second[j]
            for k in range(0, len(i), EXACT_PAIRS):
                a, b = i[k : k + EXACT_PAIRS], j[k : k + EXACT_PAIRS]
                both = cells[a][:, :, None] == cells[b][:, None, :]
                smallest = np.where(both.any(axis=2), cells[a], np.iinfo(np.int32).max).min(axis=1)
                mine = smallest == cell
                np.add.at(links, a[mine], weight[b[mine]])
                np.add.at(links, b[mine], weight[a[mine]])
            while True:  # smallest label among neighbours until nothing changes
                before = label.copy()
                np.minimum.at(label, i, before[j])
                np.minimum.at(label, j, label[i])
                label = label[label]
                if (label == before).all():
                    break
        use = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.table({"node": node[use], "links": links[use], "other": node[label[use]]})

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, each: int = CELLS_EACH, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    small_batches(rows.sparkSession)
    vectors = cut(unit_vectors(rows, id_col, vector_col))
    groups = vectors.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
    # a node is named by its digest: ids may repeat or be null
    name = F.xxhash64("key")
    nodes = cut(groups.select(name.alias("node"), "first_id", "weight", "key", "unit", F.size("unit").alias("dim")))
    dims = [(r["dim"], r["n"]) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]
    found = None
    for dim, n in dims:
        placed = cut(assign(nodes.where(F.col("dim") == dim).select("node", "weight", "key", "unit"), dim, n, each).drop("key"))
        spread = placed.select("*", F.explode("cells").alias("cell"))
        size = {r["cell"]: r["n"] for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = {c: -(-k // block) for c, k in size.items() if k > block}
        parts = F.lit(1)
        if large:
            at = F.create_map(*(F.lit(x) for c in large.items() for x in c))
            parts = F.coalesce(F.try_element_at(at, F.col("cell")), F.lit(1))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        spread = spread.withColumn("parts", parts).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        paired = spread.select("node", "weight", "unit", "cells", "cell", F.least("own", "with").alias("b1"), F.greatest("own", "with").alias("b2"), (F.col("own") > F.col("with")).cast("int").alias("side"))
        part = paired.groupBy("cell", "b1", "b2").applyInArrow(block_links(cosine, dim), "node long, links long, other long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    base = nodes.select("node", "key", "first_id", "weight").join(links, "node", "left").join(reach, "node", "left")
    base = base.select("key", "first_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("class"))
    least = base.groupBy("class").agg(F.min("first_id").alias("component_id"))
    label = base.join(least, "class").select("key", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = vectors.select("vec_id", "key").join(label, "key", "left")
    alone = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("vec_id") == alone, F.lit(True)).alias("kept"))
