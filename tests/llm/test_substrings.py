import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from tests.llm.data import SCHEMA, corpus, words
from tickframe.llm import phrases, repeats, suffixes
from tickframe.llm.common import shared_folder

ORDER = lambda r: (r[0] is None, r[0] or 0)


def removed(units, window, seen):
    gone = [False] * len(units)
    for k in range(len(units) - window + 1):
        x = tuple(units[k : k + window])
        if x in seen:
            gone[k : k + window] = [True] * window
        else:
            seen.add(x)
    return gone


def by_words(rows):
    seen, out = set(), {}
    for r in sorted(rows, key=ORDER):
        w = words(r[1])
        gone = removed(w, 20, seen)
        out[r[0]] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def by_bytes(rows):
    seen, out = set(), {}
    for r in sorted(rows, key=ORDER):
        b = (r[1] or "").encode()
        gone = removed(b, 100, seen)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[r[0]] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in phrases.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == by_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == by_bytes(rows)


@pytest.mark.parametrize("operator", [phrases.deduplicate, suffixes.deduplicate])
def test_repeated_and_missing_ids(spark, operator):
    text = " ".join(f"w{i}" for i in range(60))
    other = text + " and more of it"
    rows = [(7, text), (7, text), (None, other), (None, None), (8, "x"), (None, None)]
    got = operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    gone = sorted((r[0] is None, r[0] or 0, r[1], r["n_removed"]) for r in got)
    assert [g[3] > 0 for g in gone if g[1] == 7] == [False, False]  # a repeated row is the same document
    assert sum(g[3] > 0 for g in gone) == 1  # the one without an id comes later


def test_very_long_texts(spark):
    """Texts longer than a slice, one repeated within another, and a periodic one."""
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(2, long[50_000:90_000] + " tail"), (1, long), (3, "ab " * 60_000), (4, "x y " + long[-30_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in suffixes.deduplicate(docs).collect()} == by_bytes(rows)
    assert {r[0]: tuple(r)[1:] for r in phrases.deduplicate(docs).collect()} == by_words(rows)


@pytest.mark.parametrize("operator", [phrases.deduplicate, suffixes.deduplicate])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stretches_depend_on_the_row_alone(monkeypatch):
    """Neither slices nor the other rows of a block change a row's stretches: both passes number them alike."""
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 40, 3000), np.zeros(900, int), np.tile(rng.integers(0, 9, 7), 200)]).astype(np.uint64)
    first = np.array([0, 1700, 1700, 2500, 4100, len(values)])
    whole = repeats.anchors(repeats.Block(values, first, None, None, None), 20, 6)
    for bits in (6, 8, 10):
        monkeypatch.setattr(repeats, "PLACE_BITS", bits)
        cut = repeats.anchors(repeats.Block(values, first, None, None, None), 20, 6)
        assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    row, h, lo, hi, at = whole
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert np.array_equal(windows, np.concatenate([np.arange(a, b - 19) for a, b in zip(first[:-1], first[1:]) if b - a >= 20]))
    assert ((hi <= at) & (at <= lo + 14)).all()
    for r in (0, 2, 3, 4):
        alone = repeats.anchors(repeats.Block(values[first[r] : first[r + 1]], np.array([0, first[r + 1] - first[r]]), None, None, None), 20, 6)
        mine = row == r
        assert np.array_equal(h[mine], alone[1]) and all(np.array_equal(x[mine] - first[r], y) for x, y in zip((lo, hi, at), alone[2:]))


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = by_bytes(rows)
    for parts in (1, 5):
        got = {r[0]: tuple(r)[1:] for r in suffixes.deduplicate(docs.repartition(parts)).collect()}
        assert got == want


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        patterns = texts + [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30))) for _ in range(5)]
        data = np.frombuffer(b"".join(patterns), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in patterns])])
        index = suffixes.RunLengthIndex(data, off[: len(texts)], off[1 : len(texts) + 1])
        length, place = index.statistics(data, off[:-1], off[1:])
        want = [max(k for k in range(len(p) - i + 1) if any(p[i : i + k] in t for t in texts)) for p in patterns for i in range(len(p))]
        assert length.tolist() == want
        for i, (n, at) in enumerate(zip(length, place)):
            assert n == 0 or bytes(data[i : i + n]) == bytes(data[at : at + n])


def test_index_of_copies_is_small():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(700))
    data = np.frombuffer(text * 50, np.uint8)
    bounds = np.arange(51) * 700
    one, many = (suffixes.RunLengthIndex(data, bounds[:k], bounds[1 : k + 1]) for k in (1, 50))
    assert len(many.code) < 2 * len(one.code)


@pytest.mark.parametrize("operator, brute", [(phrases.deduplicate, by_words), (suffixes.deduplicate, by_bytes)])
def test_common_line_with_many_neighbours(spark, monkeypatch, operator, brute):
    """More texts of one anchor than are compared in one piece; some of their windows recur."""
    monkeypatch.setattr(repeats, "HOT", 4)
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(16)) + " fixed words of the license that stand everywhere"
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        end = own[20:] if i % 5 else [f"same{k}" for k in range(20)]
        rows.append((i, " ".join(own[:20]) + " " + line + " " + " ".join(end)))
    got = {r[0]: tuple(r)[1:] for r in operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("operator, brute", [(phrases.deduplicate, by_words), (suffixes.deduplicate, by_bytes)])
def test_lines_that_repeat_within_documents(spark, operator, brute):
    """Lines in ever new orders: documents hold a line several times, between lines that recur elsewhere."""
    rng = random.Random(21)
    lines = [" ".join(f"{chr(97 + k)}{rng.randrange(300)}" for _ in range(26)) for k in range(6)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {i} {k}" for k in range(8))) for i in range(40)]
    got = {r[0]: tuple(r)[1:] for r in operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("operator, brute", [(phrases.deduplicate, by_words), (suffixes.deduplicate, by_bytes)])
def test_written_tables_have_few_files(spark, operator, brute):
    """Each file forks the JVM that writes it: there are half as many as shuffle partitions at most."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = corpus(4)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r[0]: tuple(r)[1:] for r in operator(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = sorted(len(list(t.glob("part-*"))) for t in set(folder.glob("table-*")) - before)
    assert len(files) == 3 and files[-1] <= 32, files
    assert got == brute(rows)
