"""Substring deduplication on a run-length compressed Burrows-Wheeler index.

Removes every byte that a 100-byte string covers which also starts earlier. The shared plan (``repeats``)
confirms the passages that recur and says which of them each document may hold. The passages of a block of
documents, copies included, are indexed: their transform is kept as runs (first row, byte), with the text
positions at both ends of each run. The block's documents are streamed past it, wherever an anchor of a
passage stands, from their ends to their starts and many at a time: row and text position follow each
matching byte by the LF mapping; where the run has another byte, the nearest runs of the wanted byte above
and below are tried and the sampled end with the longer common prefix goes on. That gives the matching
statistics: the length of the longest match at each byte and a place of it. Where it is 100 or more, the
passage at that place says where the string stands first in the corpus; anywhere else it is removed.

Defined cases: a null text is empty; texts shorter than the window lose nothing; a very long text is a block
of its own, indexed in pieces of ``PIECE`` bytes that overlap; repeated rows are one document; rows with the
same id but other texts, or without an id, are ordered by a hash of the content (null ids last); an empty
table gives an empty result; matches never cross documents; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickframe.llm import repeats

WINDOW, GRAM = 100, 32
#: Bytes of the first ranks: 7 codes of 9 bits fit a signed 64-bit key.
FIRST_DEPTH = 7
#: Bytes, beside the overlap, of the pieces in which passages are indexed and documents streamed.
PIECE = 256
#: One row in 2**STEP has its run noted.
STEP = 4


def zero_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes of values other than 0 are 0."""
    low = x & (~x + np.uint64(1))  # the lowest bit
    return (np.frexp(low.astype(np.float64))[1] - 1) >> 3


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one value, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 8, 8), (1, 1)).copy().view("<u8").ravel()


class RunLengthIndex:
    """Run-length compressed transform of several texts, each with an end mark of its own.

    Kept for each run of equal bytes of the transform: its first row, byte, image under the LF mapping, and the
    text positions of its first and last row. Positions are those in ``data``, the documents' bytes that the texts
    are cut from (bounds ``lo`` and ``hi``); they are read only to compare text where a match has to change runs,
    ``most`` bytes of it: matches count as that long where they may be longer.
    """

    def __init__(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 1 << 30) -> None:
        self.most = most
        self.eights = eights(data)
        n_texts, size = len(lo), hi - lo + 1
        position = repeats.ragged(lo, size)  # of each code; an end mark has the end of its text
        mark = np.cumsum(size) - 1
        codes = np.zeros(len(position), np.int16)
        inside = np.ones(len(position), bool)
        inside[mark] = False
        codes[inside] = data[position[inside]].astype(np.int16) + 1
        sa = suffix_order(codes, mark, size)
        bwt = codes[sa - 1]
        first = np.zeros(len(codes), bool)
        first[mark - size + 1] = True
        bwt[first[sa]] = 0  # before a text's first byte stands an end mark
        self.run_row = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.code = bwt[self.run_row].astype(np.int64)
        length = np.diff(np.append(self.run_row, len(sa)))
        self.last_row = self.run_row + length - 1
        # a sampled directory: the run of each 2**STEP-th row, from which a row's own run is few runs away
        self.sampled = (np.searchsorted(self.run_row, np.arange(0, len(sa), 1 << STEP), side="right") - 1).astype(np.int32)
        self.top, self.bottom = position[sa[self.run_row]], position[sa[self.last_row]]
        text_end = np.repeat(hi, size)
        self.top_end, self.bottom_end = text_end[sa[self.run_row]], text_end[sa[self.last_row]]
        # LF: rows of suffixes that begin with smaller codes, and equal codes in earlier runs
        smaller = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=257))])
        order = np.argsort(self.code, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        before -= before[np.searchsorted(self.code[order], self.code[order])]
        self.image = np.empty(len(length), np.int64)
        self.image[order] = smaller[self.code[order]] + before
        self.by_code = self.code[order] * len(length) + order  # sorted: the runs of each code in order
        self.by_code_run = order

    def run_of(self, row: np.ndarray) -> np.ndarray:
        run = self.sampled[row >> STEP].astype(np.int64)
        for k in reversed(range(STEP + 1)):
            ahead = np.minimum(run + (1 << k), len(self.run_row) - 1)
            run = np.where(self.run_row[ahead] <= row, ahead, run)
        return run

    def common(self, a: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the texts at ``a`` and ``b``, up to ``most`` each."""
        out = np.zeros(len(a), np.int64)
        limit = np.minimum(most, b_end - b)
        live = np.flatnonzero(limit > 0)
        x, y = a[live], b[live]
        last = np.zeros(len(a), np.uint64)
        while len(live):  # eight bytes at a time
            other = self.eights[x] ^ self.eights[y]
            last[live] = other
            on = np.flatnonzero(other == 0)
            live, x, y = live[on], x[on] + 8, y[on] + 8
            out[live] += 8
            on = np.flatnonzero(out[live] < limit[live])
            if len(on) < len(live):
                live, x, y = live[on], x[on], y[on]
        return np.minimum(out + np.where(last != 0, zero_bytes(last), 0), limit)

    def statistics(self, patterns: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of ``patterns[lo:hi]``, one after the other: length of the longest match of each suffix,
        up to the pattern's end, and a position where it stands in the indexed texts."""
        size = hi - lo
        out_at = np.cumsum(size) - size
        lengths, places = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
        order = np.argsort(-size, kind="stable")
        n_at = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        runs = len(self.code)
        row, at = np.zeros(len(order), np.int64), np.full(len(order), self.top[0])
        match = np.zeros(len(order), np.int64)
        for step, n in enumerate(n_at):  # all patterns at once, from their ends
            place = hi[order[:n]] - 1 - step
            want = patterns[place].astype(np.int64) + 1
            run = self.run_of(row[:n])
            off = np.flatnonzero(self.code[run] != want)
            if len(off):
                k = np.searchsorted(self.by_code, want[off] * runs + run[off])
                up, down = np.maximum(k - 1, 0), np.minimum(k, runs - 1)
                ok_up = (k > 0) & (self.by_code[up] // runs == want[off])
                ok_down = (k < runs) & (self.by_code[down] // runs == want[off])
                up, down = self.by_code_run[up], self.by_code_run[down]
                samples = np.concatenate([self.bottom[up], self.top[down]])
                ends = np.concatenate([self.bottom_end[up], self.top_end[down]])
                ok = np.concatenate([ok_up, ok_down])
                length = np.where(ok, self.common(np.tile(at[off], 2), samples, ends, np.tile(np.minimum(match[off], self.most), 2) * ok), -1)
                length_up, length_down = length[: len(off)], length[len(off) :]
                use_up = length_up >= length_down
                chosen = np.where(use_up, up, down)
                row[off] = np.where(use_up, self.last_row[chosen], self.run_row[chosen])
                at[off] = np.where(use_up, self.bottom[chosen], self.top[chosen])
                match[off] = np.maximum(length_up, length_down)  # -1: a byte that no text holds
                run[off] = chosen
            row[:n] += self.image[run] - self.run_row[run]
            at[:n] -= 1
            match[:n] += 1
            if len(off):
                lost = off[~(ok_up | ok_down)]
                row[lost], at[lost], match[lost] = 0, self.top[0], 0
            there = out_at[order[:n]] + size[order[:n]] - 1 - step
            lengths[there], places[there] = match[:n], at[:n]
        return lengths, places


def suffix_order(codes: np.ndarray, mark: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix array of texts that end in marks (code 0, an earlier text's the smaller one), by prefix doubling."""
    n, n_texts = len(codes), len(mark)
    at, own_mark = np.arange(n), np.repeat(mark, size)
    depth = FIRST_DEPTH
    key = np.zeros(n, np.int64)
    ahead, left = np.concatenate([codes, np.zeros(depth, codes.dtype)]), own_mark - at
    for k in range(depth):  # codes behind the own end mark don't count
        key <<= 9
        key |= ahead[k : k + n] * (left > k)
    order = np.argsort(key, kind="stable")
    start = group_starts(key[order])
    rank = np.empty(n, np.int64)  # how many suffixes are smaller by their first ``depth`` codes
    rank[order] = start
    rank[mark] = np.arange(n_texts)  # marks come first and differ from each other
    tied = at[(np.bincount(rank, minlength=n)[rank] > 1) & (codes > 0)]
    while len(tied):  # past a text's end mark nothing is compared
        key = rank[tied] * n + rank[np.minimum(tied + depth, own_mark[tied])]
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = key // n
        place = np.arange(len(tied))
        rank[tied] = old + group_starts(key) - group_starts(old)
        depth *= 2
        alone = group_starts(key) == place
        alone &= np.append(alone[1:], True)
        tied = tied[~alone]
    sa = np.empty(n, np.int64)
    sa[rank] = at
    return sa


def group_starts(x: np.ndarray) -> np.ndarray:
    """Of values in order: where the first equal one stands."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))


def pieces(lo: np.ndarray, hi: np.ndarray, length: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches cut into pieces of ``length`` and ``overlap`` bytes more, so that each window is in one piece."""
    count = np.maximum(-(-(hi - lo - overlap) // length), 1)
    which = np.repeat(np.arange(len(lo)), count)
    start = lo[which] + (np.arange(len(which)) - (np.cumsum(count) - count)[which]) * length
    return start, np.minimum(start + length + overlap, hi[which])


def texts(lo: np.ndarray, hi: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order, as one where the windows of the next follow on in the same row."""
    on = (lo[1:] == hi[:-1] - window + 1) & (row[1:] == row[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    return lo[head], hi[np.append(head[1:], len(lo)) - 1]


def locate(block: repeats.Block, ids: np.ndarray, here: repeats.Passages, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which bytes of the documents ``ids`` are in a string that isn't its first occurrence, by the index of the passages."""
    lo, hi = here.lo + block.first[here.row], here.hi + block.first[here.row]
    order = np.argsort(lo, kind="stable")
    lo, hi, doc, at = lo[order], hi[order], here.doc[order], here.at[order]
    # a text has the windows of passages that follow each other, and no other ones
    index = RunLengthIndex(block.data, *texts(lo, hi, here.row[order], window), window)
    # documents are streamed wherever one of the index's anchors stands
    row, h, a, b, _ = repeats.anchors(block, window, gram)
    near = np.isin(h, h[np.searchsorted(a, lo, side="right") - 1])
    patterns = pieces(*texts(a[near], b[near] + window, row[near], window), PIECE, window - 1)
    length, place = index.statistics(block.data, *patterns)
    start = repeats.ragged(patterns[0], patterns[1] - patterns[0])
    long = np.flatnonzero(length >= window)
    start, place = start[long], place[long]
    k = np.searchsorted(lo, place, side="right") - 1  # the passage that the match begins in
    row = np.searchsorted(block.first, start, side="right") - 1
    first = (ids[row] == doc[k]) & (start - block.first[row] == at[k] + place - lo[k])
    edge = np.zeros(len(block.values) + 1, np.int64)
    np.add.at(edge, start[~first], 1)
    np.add.at(edge, start[~first] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary: a cut may fall inside a character) for every row."""

    def report(block: repeats.Block, gone: np.ndarray) -> list[pa.Array]:
        off = block.first
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = off[1:-1][off[1:-1] < len(gone)]
        head[inner] = gone[inner]  # a run of its own in each document
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[off]
        raw = block.data[~gone].tobytes()
        kept = [raw[x:y] for x, y in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        numbers = (np.diff(off), np.diff(off) - np.diff(kept_at), np.diff(np.concatenate([[0], np.cumsum(head)])[off]))
        columns = [*(pa.array(x.astype(np.int64)) for x in numbers), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
        return columns + [pa.array(kept, pa.binary())] * with_bytes

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return repeats.without_repeats(docs, repeats.byte_units, window, gram, lambda *x: locate(*x, window, gram), report, schema, id_col, text_col)
