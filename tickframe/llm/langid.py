"""Language identification with a string kernel.

The kernel of two texts is the number of blended-spectrum n-grams (1 to 3 bytes of the folded text,
hashed to ``DIM`` places) that both hold, over the geometric mean of how many each holds. A Nyström map on
landmark texts makes it linear, one-versus-rest kernel ridge regression is solved on that map, and a batch
of texts is scored by matrix products of its presence matrix: the products with the landmarks' presence
matrix and with the map's weights are associated into one matrix of ``DIM`` rows, so scoring costs the same
for any number of landmarks.

Training takes a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the smallest seeded hash of id and
text; the first ``LANDMARKS`` of them are the landmarks. Their whole texts are reduced to presence bits on
the executors, so the driver gets DIM / 8 bytes for each.

Defined cases: a null text or one without a letter (any script) is ``und`` with score 0; rows whose label
is null or that are held out never train; without any labelled row every text is ``und``; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches, text_blocks

DIM = 1 << 15
GRAMS = (1, 2, 3)
#: The bound of the training sample, and how many of it are landmarks.
SAMPLE_ROWS = 2000
LANDMARKS = 256
#: Score that a document's best language has at least where one is recognised. A text that shares no n-gram with the
#: languages learned scores what the regressions answer to nothing, about 1 / (number of languages).
LEAST_SCORE = 0.35
RIDGE = 1e-2
#: Rows of a presence matrix at a time.
ROWS = 128
UNKNOWN = "und"

FOLD = np.full(256, 0x20, np.uint8)  # ASCII: letters in lower case, the rest is a gap
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which n-grams each row of a text block holds: booleans, rows x DIM."""
    rows = len(off) - 1
    flags = np.zeros(rows * DIM, bool)
    b = FOLD[buf]
    if len(b) > 1:  # upper case of the Latin-1 letters, whose lead byte is C3
        upper = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        b[1:][upper] += 0x20
    row = np.repeat(np.arange(rows, dtype=np.int64) * DIM, np.diff(off))
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | b[n - 1 :]
        if n not in GRAMS:
            continue
        place = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
        at = row[:m] + place
        flags[at if n == 1 else at[row[:m] == row[n - 1 :]]] = True
    return flags.reshape(rows, DIM)


def presence_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, buf, off in text_blocks(texts):
        for k in range(0, j - i, ROWS):
            part = off[k : min(k + ROWS, j - i) + 1]
            yield i + k, presence(buf[part[0] : part[-1]], part - part[0])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # DIM x labels
    bias: np.ndarray

    def score(self, flags: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(flags.sum(axis=1), 1))
        return (flags.astype(np.float32) @ self.weights) / size[:, None] + self.bias


def fit(flags: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström map on the first rows, then one-versus-rest ridge regression on all. flags: packed bits."""
    names = sorted(set(labels))
    unpack = lambda x: np.unpackbits(x, axis=1).astype(np.float32)
    marks = unpack(flags[:landmarks])
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    kernel = []
    for i in range(0, len(flags), 200):
        x = unpack(flags[i : i + 200])
        kernel.append((x @ marks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None])
    k = np.concatenate(kernel).astype(np.float64)
    values, vectors = np.linalg.eigh(k[: len(marks)])
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    mapped = k @ root
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    mean_x, mean_y = mapped.mean(axis=0), y.mean(axis=0)
    c = mapped - mean_x
    w = np.linalg.solve(c.T @ c + ridge * len(c) * np.eye(c.shape[1]) / 100, c.T @ (y - mean_y))
    return Model(names, (marks.T @ (root @ w).astype(np.float32)), mean_y - mean_x @ w)


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on the bounded sample of labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    sample = (
        docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), order.alias("h"))
        .orderBy("h", "doc_id", "lang")
        .limit(rows)
    )
    chosen = {(r["doc_id"], r["h"]) for r in sample.select("doc_id", "h").collect()}
    if not chosen:
        return None
    last = max(h for _, h in chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [r.tobytes() for _, flags in presence_blocks(b["text"]) for r in np.packbits(flags, axis=1)]
            yield pa.RecordBatch.from_arrays([b["h"], b["lang"], pa.array(bits, pa.binary())], ["h", "lang", "bits"])

    found = (
        docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (order <= last))
        .select(order.alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(run, "h long, lang string, bits binary")
        .orderBy("h", "lang", "bits")
        .limit(rows)
        .collect()
    )
    flags = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), DIM // 8)
    return fit(flags, [r["lang"] for r in found])


def classify(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each text."""
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if model is None:
        return pred, score
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    names = np.array(model.labels, object)
    for i, flags in presence_blocks(texts):
        s = model.score(flags)
        best = s.argmax(axis=1)
        at = slice(i, i + len(flags))
        pred[at] = np.where(letters[at], names[best], UNKNOWN)
        score[at] = np.where(letters[at], np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0)
    return pred, score


def predict(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from its text alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = classify(model, b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model | None, text_col="text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, whole, whose language is recognised: some language scores ``least`` or more. Nothing is joined back."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = classify(model, b.column(at))
            yield b.filter(pa.array((pred != UNKNOWN) & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
