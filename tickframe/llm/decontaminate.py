"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case (any script), so punctuation and decoration do not matter; in scripts
without spaces (Chinese, Japanese, Thai and so on) each character is a word. Every 3-word
sequence of a test item is a seed, however common it is: leaking copies make a sequence common, so counts
tell nothing about which ones an edited copy has kept. A seed in a document marks a passage around the place where the whole item would lie, and
item and passage are aligned word by word (match 1, mismatch and gap -0.5). The score is the best local
alignment over the item's length: 1 for a full copy, about 0.6 where a quarter of the words were replaced.
Passages of ``THRESHOLD`` or more are leaks.

A score is at most the share of the item's words that the passage has anywhere, so passages below the
threshold by that share are not aligned; none of them could reach it.

Scale: one narrow scan; no document is shuffled. What reaches the executors is the benchmark, in portions
of ``PORTION_BYTES`` of item text: a larger benchmark is scanned in several portions, each within the bound.

Defined cases: a null text is empty and leaks nothing; an item with fewer than 3 words is one seed as a whole,
so documents that hold just these words in a row leak it; an item without words (or a null one) matches nothing; repeated items and repeated documents are scored alike, a document's best item
is the smallest id among equals; an empty table on either side gives an empty result; rows with a null
doc_id are reported together under null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches, span_hashes, text_blocks, window_hashes, word_bounds

GRAM = 3
THRESHOLD = 0.5
MATCH, MISS, GAP = 1.0, -0.5, -0.5
#: Item text that one scan carries to the executors.
PORTION_BYTES = 16 << 20
#: Cells of one row of the alignment matrices that are computed together.
CELLS = 1 << 20
#: Places of seeds that are looked at together.
PLACES = 1 << 20

FOLD = np.full(256, 0x20, np.uint8)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
FOLD[128:] = np.arange(128, 256)


def unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters of scripts that don't put spaces between words, by their first two UTF-8 bytes."""
    many = np.flatnonzero(buf >= 0xE0)
    a, b = buf[many], buf[np.minimum(many + 1, len(buf) - 1)]
    east = (a >= 0xE3) & (a <= 0xE9)  # kana, ideographs
    south = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F))  # Thai, Lao, Burmese, Khmer
    rare = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)  # further ideographs
    use = east | south | rare
    return many[use], many[use] + np.where(rare[use], 4, 3)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the index of each row's first word."""
    folded = FOLD[buf]
    starts, ends, first = word_bounds(folded, off)
    low, high = unspaced(folded)
    if len(low):
        starts, ends = np.union1d(starts, np.append(low, np.setdiff1d(high, ends))), np.union1d(ends, np.append(high, np.setdiff1d(low, starts)))
        first = np.searchsorted(starts, off)
    return span_hashes(folded, starts, ends), first


def grams_of(h: np.ndarray, first: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of a block, and which of them lie within one row."""
    g = window_hashes(h, n)
    inside = np.ones(len(h), bool)
    for k in range(1, n):
        at = first[1:] - k
        inside[at[at >= 0]] = False
    return g, inside[: len(g)]


class Items:
    """Test items as word hashes, and where each of their seeds stands."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = np.array(ids, np.int64)
        parts = [(words_of(buf, off), i) for i, _, buf, off in text_blocks(pc.utf8_lower(pa.array(texts, pa.large_string())))]
        self.words: list[np.ndarray] = []
        seeds, items, places = [], [], []
        for (h, first), i in parts:
            self.words += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            size = np.diff(first)
            for n in range(1, GRAM + 1):
                g, inside = grams_of(h, first, n)
                at = np.flatnonzero(inside)
                row = np.searchsorted(first, at, side="right") - 1
                if n < GRAM:  # shorter sequences are seeds where they are all of the item
                    at, row = at[size[row] == n], row[size[row] == n]
                seeds.append(g[at])
                items.append(row + i)
                places.append(at - first[row])
        #: Lengths of sequences that are seeds.
        self.lengths = sorted({min(len(w), GRAM) for w in self.words} - {0})
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self._set(cat(seeds, np.uint64), cat(items, np.int32), cat(places, np.int32))

    def _set(self, seed: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, item, seed))
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.known, self.begin = np.unique(self.seed, return_index=True)
        self.end = np.append(self.begin[1:], len(self.seed))
        self.table = np.zeros(1 << 20, bool)  # by the first 20 bits: most sequences fail here
        self.table[self.known >> np.uint64(44)] = True

    def find(self, g: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sequences that are seeds, and which seeds."""
        at = np.flatnonzero(self.table[g >> np.uint64(44)] & inside)
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
        hit = self.known[k] == g[at]
        return at[hit], k[hit]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, over the item's length."""
    out = np.zeros(len(items))
    sizes = np.array([[len(a), len(b)] for a, b in zip(items, passages, strict=True)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    i = 0
    while i < len(order):
        step = max(1, CELLS // max(1, int(sizes[order[i], 1])))
        part = order[i : i + step]
        m, n = sizes[part].max(axis=0)
        if len(part) > 1 and len(part) * n > 4 * CELLS:
            part = part[: max(1, CELLS // n)]
            m, n = sizes[part].max(axis=0)
        a, b = np.zeros((len(part), m), np.uint64), np.ones((len(part), n), np.uint64)  # padding matches nothing
        for k, p in enumerate(part):
            a[k, : sizes[p, 0]], b[k, : sizes[p, 1]] = items[p], passages[p]
        slope = -GAP * np.arange(n)
        above = np.zeros((len(part), n + 1))
        best = np.zeros(len(part))
        for row in range(m):
            cell = np.where(b == a[:, row, None], MATCH, MISS) + above[:, :-1]
            np.maximum(cell, above[:, 1:] + GAP, out=cell)
            np.maximum(cell, 0, out=cell)
            cell = np.maximum.accumulate(cell + slope, axis=1) - slope  # gaps along the row
            best = np.maximum(best, cell.max(axis=1))
            above = np.concatenate([np.zeros((len(part), 1)), cell], axis=1)
        out[part] = best / np.maximum(sizes[part, 0], 1)
        i += len(part)
    return out


def passages(items: Items, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, and word range of each passage that a seed points to (one for each row, item and stretch)."""
    hits, seeds = (np.concatenate(x) for x in zip(*(items.find(*grams_of(h, first, n)) for n in items.lengths or [GRAM]), strict=True))
    sizes = np.array([len(w) for w in items.words], np.int64)
    upto = np.cumsum(items.end[seeds] - items.begin[seeds])
    found, i = np.zeros((3, 0), np.int64), 0
    while i < len(hits):  # a common sequence of many items makes many places: PLACES at a time (or one hit)
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PLACES, side="right")))
        k = seeds[i:j]
        many = items.end[k] - items.begin[k]
        at = np.repeat(hits[i:j], many)
        which = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.begin[k], many)
        item = items.item[which].astype(np.int64)
        row = np.searchsorted(first, at, side="right") - 1
        tile = np.floor_divide(at - first[row] - items.place[which], sizes[item])
        found = _distinct(np.concatenate([found, np.stack([row, item, tile])], axis=1))
        i = j
    row, item, tile = found
    size = sizes[item]
    slack = np.maximum(5, size // 4)
    low = np.maximum(first[row] + tile * size - slack, first[row])
    high = np.minimum(first[row] + (tile + 2) * size + slack, first[row + 1])
    return row, item, low, high


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct columns, in order of the first row, then the second and so on."""
    x = x[:, np.lexsort(x[::-1])]
    return x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0))[: x.shape[1]]]


def within_reach(items: Items, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which passages have so many of their item's words that an alignment could reach the threshold."""
    out = np.zeros(len(item), bool)
    for i, (k, x, y) in enumerate(zip(item.tolist(), low.tolist(), high.tolist(), strict=True)):
        words, have = items.words[k], np.sort(h[x:y])
        at = np.searchsorted(have, words)
        at[at == len(have)] = 0
        out[i] = np.count_nonzero(have[at] == words) >= threshold * len(words)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id (the best), score, n_items for every document that holds a leak."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, -(-size // PORTION_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [_portion(texts, bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == p), threshold) for p in range(portions)]
    best = F.max(F.struct("score", (-F.col("item_id")).alias("less"))).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(best, F.countDistinct("item_id").alias("n_items")).select("doc_id", (-F.col("best.less")).alias("item_id"), F.col("best.score").alias("score"), "n_items")


def _portion(texts: DataFrame, bench: DataFrame, threshold: float) -> DataFrame:
    rows = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in bench.collect())
    items = Items([i for i, _ in rows], [t for _, t in rows])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, which, scores = [], [], []
            for i, _, buf, off in text_blocks(pc.utf8_lower(b["text"])):
                h, first = words_of(buf, off)
                row, item, low, high = passages(items, h, first)
                near = within_reach(items, h, item, low, high, threshold)
                row, item, low, high = row[near], item[near], low[near], high[near]
                s = align([items.words[k] for k in item], [h[x:y] for x, y in zip(low, high, strict=True)])
                ok = s >= threshold
                ids.append(row[ok] + i)
                which.append(items.ids[item[ok]])
                scores.append(s[ok])
            at = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at)), pa.array(np.concatenate(which)), pa.array(np.concatenate(scores))], ["doc_id", "item_id", "score"])

    return texts.mapInArrow(score, "doc_id long, item_id long, score double")
