"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Whole passes over the source are taken first; the budget that
remains is fitted on the histogram of exact document sizes: a proportional part of each size, then a
bounded-knapsack dynamic program on what is left, which says how many more documents of each size to take.
Where few documents are left, all of them longer than what the program fits, it runs over the whole rest in units
of the lengths' greatest common divisor; where that is too large as well, documents are taken while one fits.
Which ones they are follows from a seeded hash of the document id, so reruns and other partitionings agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 are never taken (0 words either way); an empty table gives an empty result; repeated rows are rows
of their own, each taken 2 times at most; a null doc_id is an id like any other.

Scale: documents are reduced to (doc_id, source, size) in the scan. What reaches a single task is a
source's histogram, one row for each distinct size (bounded by the longest text, not by the number of
documents); what reaches the driver is one row for each source. Documents of one source and size are
ranked within 256 hash ranges, so no task holds all of a common size.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = 20240607
#: Words that the dynamic program fits at most; a larger rest is first reduced by whole documents.
DP_WORDS = 1 << 16
#: Bits of all states of a program over a larger rest, for sources whose documents are too long for that.
DP_BITS = 1 << 29
RANGES_BITS = 8
#: Shortest lengths of which up to 3 documents go back to what the program fits.
GIVEN_BACK = 64


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MAX_COPIES) -> dict[str | None, float]:
    """Words for each source: ``share`` of all sizes by weight, none above ``most`` times its own."""
    named = sorted((s, n) for s, n in sizes if s is not None) + [(s, n) for s, n in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(named)}
    own = dict(named)
    rest, out, free = share * sum(own.values()), {}, dict(weight)
    while free:
        unit = rest / sum(free.values())
        over = [s for s in free if unit * free[s] > most * own[s]]
        if not over:
            out.update({s: unit * w for s, w in free.items()})
            break
        for s in over:
            out[s] = float(most * own[s])
            rest -= out[s]
            del free[s]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length (at most its count) to take for the largest sum not above the budget.

    Reachable sums are the bits of one integer; each item (counts are split into powers of two) shifts
    them. The states before each item are kept for walking back.
    """
    taken = [0] * len(lengths)
    mask, sums, steps = (1 << (budget + 1)) - 1, 1, []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        k = 1
        count = min(count, budget // length) if length > 0 else 0
        while count > 0 and not sums >> budget & 1:
            part = min(k, count)
            steps.append((i, part, sums))
            sums = (sums | sums << (part * length)) & mask
            count -= part
            k *= 2
        if sums >> budget & 1:
            break
    at = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, dp_words: int = DP_WORDS) -> tuple[int, np.ndarray]:
    """Whole passes over all documents, and the further documents of each length."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if not total:
        return 0, extra
    passes = floor(target / total + 1e-9)
    budget = int(target + 1e-6) - passes * total
    if budget <= 0:
        return passes, extra
    extra = np.floor(counts * (budget / total)).astype(np.int64)
    short = np.flatnonzero(lengths > 0)[:GIVEN_BACK]  # lengths are sorted: room for the program to fit exactly
    extra[short] -= np.minimum(extra[short], 3)
    rest = budget - int((extra * lengths).sum())
    left = counts - extra
    more = reduced(lengths, left, rest, dp_words)
    if rest > dp_words and int((more * lengths).sum()) < rest:
        whole = over_all(lengths, left, rest)
        if whole is not None:
            more = max(more, whole, key=lambda m: int((m * lengths).sum()))
    return passes, extra + more


def reduced(lengths: np.ndarray, counts: np.ndarray, rest: int, dp_words: int) -> np.ndarray:
    """Documents of each length for ``rest`` words: longest first down to what the program fits, then the program."""
    more = np.zeros(len(lengths), np.int64)
    for keep in (dp_words // 2, 0):  # where all are too long to leave the program room: while one fits
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= dp_words:
                break
            if lengths[i] > 0:
                n = min(int(counts[i] - more[i]), max(0, rest - keep) // int(lengths[i]))
                more[i] += n
                rest -= n * int(lengths[i])
    if rest <= dp_words:
        fits = np.flatnonzero((lengths > 0) & (lengths <= rest) & (counts > more))
        for i, n in zip(fits, knapsack([int(lengths[i]) for i in fits], [int(counts[i] - more[i]) for i in fits], rest), strict=True):
            more[i] += n
    return more


def over_all(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray | None:
    """The best documents of each length for ``rest`` words, or None where the program would have too large states."""
    fits = np.flatnonzero((lengths > 0) & (lengths <= rest) & (counts > 0))
    most = np.minimum(counts[fits], rest // np.maximum(lengths[fits], 1))
    unit = int(np.gcd.reduce(lengths[fits])) if len(fits) else 1
    if sum(int(n).bit_length() for n in most) * (rest // unit) > DP_BITS:
        return None
    more = np.zeros(len(lengths), np.int64)
    more[fits] = knapsack([int(x) // unit for x in lengths[fits]], [int(n) for n in most], rest // unit)
    return more


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MAX_COPIES, seed=SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")))
    hist = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = {r["source"]: r["s"] for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    goal = targets(list(sums.items()), weights, share, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        source = None if pdf["source"].isna().iloc[0] else pdf["source"].iloc[0]
        pdf = pdf.sort_values("size", kind="stable")
        passes, extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), goal.get(source, 0.0))
        return pd.DataFrame({"source": [source] * len(pdf), "size": pdf["size"], "passes": passes, "extra": extra, "source_size": int(sums.get(source, 0)), "target": goal.get(source, 0.0)})

    plans = hist.groupBy("source").applyInPandas(plan, "source string, size long, passes int, extra long, source_size long, target double")
    key = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - RANGES_BITS)
    ranged = base.withColumn("part", key)
    per = ranged.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).drop("in_part")
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    ranked = ranged.withColumn("place", place).alias("r")
    per, plans = per.alias("p"), plans.alias("q")
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    joined = ranked.join(per, same("r", "p", "source", "size", "part")).join(plans, same("r", "q", "source", "size"))
    copies = F.col("q.passes") + F.when(F.col("r.place") + F.col("p.before") <= F.col("q.extra"), 1).otherwise(0)
    return joined.select("r.doc_id", "r.source", "r.size", "q.source_size", "q.target", F.when(F.col("r.size") > 0, copies).otherwise(0).cast("int").alias("copies")).withColumn(
        "taken", (F.col("copies") * F.col("size")).cast("long")
    )
