"""Finding every repeated window of a corpus exactly: what the two substring operators share.

A document is a sequence of units (words or bytes); a window is ``window`` consecutive units of one
document. Each window has an anchor, the leftmost of its ``gram``-unit sequences with the smallest hash.
The anchor depends on the window's content alone, so equal windows have equal anchors wherever they stand,
and consecutive windows with the anchor at one place form a stretch. The plan:

1. documents list their anchors; those that occur twice or more in the corpus are found (``recurring``);
2. documents give the stretches of these anchors, each different one once with how often it stands there
   (``stretches``, written to the shared folder);
3. passages are confirmed (``passages``): runs of windows that occur twice or more, with their first
   occurrence in the corpus. Where an anchor has one text, that is the passage; where it has several, they
   are compared window by window; where it has more than ``HOT`` (a common line with ever new neighbours),
   its windows are counted one by one, so no task holds them all;
4. every document gets the passages it may hold, and all documents are streamed whole past them: an
   operator's ``Locator`` (automata, or a run-length index) finds where they occur. Each place but the first
   occurrence is removed. Nothing is removed that the locator did not find.

Every row that is shuffled is one stretch, window or passage, so the rows grow with the recurring text and
not with the number of partitions. Rows of one key are combined before they are shuffled or joined by joins
that AQE splits. Different texts of one anchor are told apart by two 64-bit hashes. Order is by document
id, then start; where ids repeat or are null, documents are numbered first (by id, nulls last, then a hash
of the content), and rows equal in id and text are one document whose result each of them gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import mix, small_batches, span_hashes, stored, text_blocks, window_hashes, word_bounds

#: Different texts of one anchor that are compared in one piece; more are counted window by window.
HOT = 1 << 14
#: Shuffle partitions of which one task writes a table's rows to one file.
SHARE = 2
#: Bits that a place takes in a sort key beside its hash: windows are worked through in slices of fewer
#: places, whose arrays stay in the processor's cache.
PLACE_BITS = 17

BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

Units = Callable[[np.ndarray, np.ndarray], "Block"]
#: Which units of a block's documents (ids) are occurrences, other than the first, of the passages given to them.
Locator = Callable[["Block", np.ndarray, "Passages"], np.ndarray]


@dataclass
class Block:
    """Units of a text block: values, first unit of each row, and the bytes of units lo:hi as data[begin[lo]:end[hi - 1]]."""

    values: np.ndarray
    first: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def byte_units(buf: np.ndarray, off: np.ndarray) -> Block:
    at = np.arange(len(buf) + 1)
    return Block(BYTE_VALUES[buf], off, buf, at[:-1], at[1:])


def word_units(buf: np.ndarray, off: np.ndarray) -> Block:
    """Words; between two of them the data has one byte, so that a stretch is joined by single spaces."""
    starts, ends, first = word_bounds(buf, off)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.full(int(at[-1]), 0x20, np.uint8)
    inner = np.arange(int(size.sum()))
    gone = np.cumsum(size) - size
    data[inner + np.repeat(np.arange(len(size)), size)] = buf[inner + np.repeat(starts - gone, size)]
    return Block(span_hashes(buf, starts, ends), first, data, at[:-1], at[1:] - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of all rows in order: row, anchor hash, first window, last window, anchor (places in the block)."""
    n = len(block.values)
    parts = []
    limit = (1 << PLACE_BITS) - window
    long = np.diff(block.first)
    for lo in range(0, max(n, 1), limit):
        hi = min(n, lo + limit + window - 1)
        count = hi - lo - window + 1
        if count <= 0:
            break
        g = window_hashes(block.values[lo:hi], gram)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64((1 << PLACE_BITS) - 1)
        key = g & ~low
        key |= np.arange(len(g), dtype=np.uint64)
        place = (sliding_min(key, window - gram + 1)[:count] & low).astype(np.int64)
        edge = np.zeros(count + 1, np.int32)  # windows that lie in one row
        ok = long >= window
        begin = np.clip(block.first[:-1][ok] - lo, 0, count)
        end = np.clip(block.first[1:][ok] - window + 1 - lo, 0, count)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]))
        if not len(at):
            continue
        p = place[at]
        heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        tails = np.append(heads[1:], len(at)) - 1
        parts.append((g[p[heads]], at[heads] + lo, at[tails] + lo, p[heads] + lo))
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e, e
    h, a, b, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a stretch that a slice's end cut is one again: what a row's stretches are depends on the row alone
    heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    tails = np.append(heads[1:], len(p)) - 1
    h, a, b, p = h[heads], a[heads], b[tails], p[heads]
    return np.searchsorted(block.first, a, side="right") - 1, h, a, b, p


# ----------------------------------------------------------------------------------------- arrays


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of stretches one after the other."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows already in order: which are the first with their keys, and for each row that first one's index."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    of = np.empty(len(order), np.int64)
    of[order] = lead  # lexsort is stable, so the lead of a group is its first row
    return of == np.arange(len(of)), of


def of_texts(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a column of binary values without nulls."""
    one = texts.combine_chunks()
    if isinstance(one, pa.ChunkedArray):
        one = one.chunk(0)
    _, offsets, data = one.buffers()
    off = np.frombuffer(offsets, np.int32)[one.offset : one.offset + len(one) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def longs(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()


# -------------------------------------------------------------------------------------------- stages


@dataclass
class Passages:
    """Passages by the documents of a block that may hold them: places [lo, hi) in units of the row's text, and
    the first occurrence in the corpus (document, start)."""

    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id (unique, in order, not null) and text; whether ids had to be made (then doc_id stands beside).

    Ids are made from (doc_id, two hashes of the text); texts are not sorted.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = base.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if count["n"] == count["d"]:
        return base.select(F.col("doc_id").alias("id"), "text"), False
    named = base.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    once = named.dropDuplicates(["doc_id", "h", "g"])
    order = named.select("doc_id", "h", "g").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "h", "g")
    ids = stored(order.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").alias("d"), F.col("h").alias("a"), F.col("g").alias("b")))
    return once.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("a")) & (F.col("g") == F.col("b"))).select("id", "text", "doc_id"), True


def recurring(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """id, numbers: which of its anchors (counted from 0) a document shares with another place of the corpus.

    A batch asks for each hash once and notes by itself what stands in it several times. Rows of which that is
    known get a key of their own, so a common hash has one row for each batch.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = longs(b["id"])
            for i, _, buf, off in text_blocks(b["text"]):
                row, h, *_ = anchors(units(buf, off), window, gram)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                lead, of = firsts(h)
                again = ~lead
                again[of[~lead]] = True
                own = mix(ids[row + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64))
                key = np.where(lead, h, own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row + i]), pa.array(number.astype(np.int32)), pa.array(again)], ["key", "id", "number", "again"])

    asked = docs.select("id", "text").mapInArrow(ask, "key long, id long, number int, again boolean")
    same = Window.partitionBy("key")
    known = asked.select("id", "number", F.count(F.lit(1)).over(same).alias("n"), F.max("again").over(same).alias("some")).where("n > 1 or some")
    return known.groupBy("id").agg(F.collect_list("number").alias("numbers"))


def stretches(docs: DataFrame, numbers: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """h, digest, id, start, size (in units), n, text: the different stretches of recurring anchors of each document.

    ``start`` is the first of the document's ``n`` places of the stretch. The text comes with at least one row
    of each (h, digest): the first one of a block.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = longs(b["id"]), b["numbers"]
            n_off, n_flat = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            for i, j, buf, off in text_blocks(b["text"]):
                block = units(buf, off)
                row, h, lo, hi, _ = anchors(block, window, gram)
                first = np.searchsorted(row, np.arange(j - i + 1))
                take = np.sort(n_flat[n_off[i] : n_off[j]] + np.repeat(first[:-1], np.diff(n_off[i : j + 1])))
                row, h, lo, hi = row[take], h[take], lo[take], hi[take]
                begin, end = block.begin[lo], block.end[hi + window - 1]
                digest = span_hashes(block.data, begin, end)
                lead, of = firsts(row, h, digest)
                n = np.bincount(of, minlength=len(of))[lead]
                row, h, lo, hi, begin, end, digest = (x[lead] for x in (row, h, lo, hi, begin, end, digest))
                shown, _ = firsts(h, digest)
                at = np.concatenate([[0], np.cumsum(np.where(shown, end - begin, 0))]).astype(np.int32)
                data = block.data[ragged(begin[shown], (end - begin)[shown])]
                texts = pa.Array.from_buffers(pa.binary(), len(h), [pa.py_buffer(np.packbits(shown, bitorder="little")), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
                columns = [h.view(np.int64), digest.view(np.int64), ids[row + i], (lo - block.first[row]).astype(np.int32), (hi - lo + window).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), texts], ["h", "digest", "id", "start", "size", "n", "text"])

    return docs.select("id", "text").join(numbers, "id").mapInArrow(send, "h long, digest long, id long, start int, size int, n int, text binary")


def windows_of(t: pa.Table, units: Units, window: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts of (h, text, n, doc, at): row, start in the text, hash with the anchor's, count, document and place of the text's first occurrence."""
    block = units(*of_texts(t["text"]))
    count = np.maximum(np.diff(block.first) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = ragged(block.first[:-1], count)
    key = mix(window_hashes(block.values, window)[place] ^ mix(longs(t["h"]).view(np.uint64))[row])
    start = place - block.first[row]
    return row, start, key, longs(t["n"])[row], longs(t["doc"])[row], longs(t["at"])[row] + start


def compared(t: pa.Table, units: Units, window: int) -> pa.RecordBatch:
    """Passages of anchors with several texts each: runs of recurring windows that the same texts hold."""
    row, start, key, n, doc, at = windows_of(t, units, window)
    order = np.lexsort((at, doc))  # document order
    _, lead, kind = np.unique(key[order], return_index=True, return_inverse=True)
    of = np.empty(len(key), np.int64)
    of[order] = kind
    times = np.bincount(of, weights=n)
    holders = np.zeros(len(times), np.uint64)
    np.add.at(holders, of, mix(row.astype(np.uint64) + np.uint64(1)))
    lead = order[lead]
    first_doc, first_at, held, use = doc[lead][of], at[lead][of], holders[of], times[of] > 1
    on = np.zeros(len(key), bool)  # goes on from the window before
    on[1:] = use[1:] & use[:-1] & (row[1:] == row[:-1]) & (held[1:] == held[:-1]) & (first_doc[1:] == first_doc[:-1]) & (first_at[1:] == first_at[:-1] + 1)
    head = np.flatnonzero(use & ~on)
    tail = np.flatnonzero(use & ~np.append(on[1:], False))
    h, digest = longs(t["h"]), longs(t["digest"])
    columns = [h[row[head]], digest[row[head]], start[head].astype(np.int32), (start[tail] + window).astype(np.int32), first_doc[head], first_at[head].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "digest", "lo", "hi", "doc", "at"])


def passages(found: DataFrame, units: Units, window: int) -> DataFrame:
    """h, digest, lo, hi, doc, at: runs of recurring windows within each stretch's text, and where they stand first."""
    texts = found.groupBy("h", "digest").agg(F.min(F.struct("id", "start")).alias("f"), F.sum("n").alias("n"), F.first("size").alias("size"))
    kinds = texts.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    texts = stored(texts.join(kinds, "h").select("h", "digest", F.col("f.id").alias("doc"), F.col("f.start").alias("at"), "n", "size", "k").where("k > 1 or n > 1"), SHARE)
    alone = texts.where("k = 1").select("h", "digest", F.lit(0).alias("lo"), F.col("size").alias("hi"), "doc", "at")
    shown = found.where("text is not null").select("h", "digest", "text")
    several = texts.where("k > 1").join(shown, ["h", "digest"]).dropDuplicates(["h", "digest"]).select("h", "digest", "text", "n", "doc", "at", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows come by anchor; the last one's may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            h = longs(t["h"])
            whole = int(np.flatnonzero(h != h[-1])[-1]) + 1 if len(h) and (h != h[-1]).any() else 0
            if whole:
                yield compared(t.slice(0, whole), units, window)
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield compared(held, units, window)

    few = several.where(F.col("k") <= HOT).repartition("h").sortWithinPartitions("h").mapInArrow(compare, "h long, digest long, lo int, hi int, doc long, at int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            row, start, key, n, doc, at = windows_of(t, units, window)
            columns = [key.view(np.int64), longs(t["h"])[row], longs(t["digest"])[row], start.astype(np.int32), n, doc, at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "h", "digest", "lo", "n", "doc", "at"])

    each = several.where(F.col("k") > HOT).mapInArrow(spread, "key long, h long, digest long, lo int, n long, doc long, at int")
    often = each.groupBy("key", "h").agg(F.min(F.struct("doc", "at")).alias("f"), F.sum("n").alias("times")).where("times > 1")
    many = each.select("key", "h", "digest", "lo").join(often, ["key", "h"]).select("h", "digest", "lo", (F.col("lo") + window).alias("hi"), "f.doc", "f.at")
    return stored(alone.unionByName(few).unionByName(many), SHARE)


def wanted(found: DataFrame, confirmed: DataFrame) -> DataFrame:
    """id, passages (array of lo, hi, doc, at): what each document may hold, by the first place there.

    A document gets no passage that it holds once and first of all.
    """
    at = F.col("start") + F.col("lo")
    rows = found.select("h", "digest", "id", "start", "n").join(confirmed, ["h", "digest"]).where((F.col("n") > 1) | (F.col("id") != F.col("doc")) | (at != F.col("at")))
    return rows.groupBy("id").agg(F.collect_list(F.struct(at.alias("lo"), (F.col("start") + F.col("hi")).alias("hi"), "doc", "at")).alias("passages"))


def given(column: pa.Array, i: int, j: int) -> Passages:
    """The passages of the rows i:j of a batch."""
    off = column.offsets.to_numpy()
    part = slice(off[i], off[j])
    field = lambda name: column.values.field(name).to_numpy(zero_copy_only=False)[part]
    row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
    return Passages(row, field("lo").astype(np.int64), field("hi").astype(np.int64), field("doc"), field("at").astype(np.int64))


def without_repeats(docs: DataFrame, units: Units, window: int, gram: int, locate: Locator, report, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Run the plan and ``report`` (block, removed units -> columns of ``schema`` after its first, id).

    Returns ``schema`` with id renamed to doc_id, one row for each row of ``docs``.
    """
    small_batches(docs.sparkSession)
    base, made = numbered(docs, id_col, text_col)
    found = stored(stretches(base, recurring(base, units, window, gram), units, window, gram), SHARE)
    none = F.array().cast("array<struct<lo:int,hi:int,doc:bigint,at:int>>")
    names = [c.split()[0] for c in schema.split(",")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = longs(b["id"])
            for i, j, buf, off in text_blocks(b["text"]):
                block = units(buf, off)
                here = given(b["passages"], i, j)
                gone = locate(block, ids[i:j], here) if len(here.row) else np.zeros(len(block.values), bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), *report(block, gone)], names)

    joined = base.select("id", "text").join(wanted(found, passages(found, units, window)), "id", "left").select("id", "text", F.coalesce("passages", none).alias("passages"))
    done = joined.mapInArrow(finish, schema)
    if not made:
        return done.withColumnRenamed("id", "doc_id")
    ids = base.select("id", "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    named = done.join(ids, "id").drop("id").alias("n")
    same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.h") == F.col("n.h")) & (F.col("r.g") == F.col("n.g"))
    return rows.alias("r").join(named, same).select("n.doc_id", *(F.col(f"n.{c}") for c in names if c != "id"))
