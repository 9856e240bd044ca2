import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import prose
from tests.llm.test_texts import classes
from tickframe.llm import chat, vectors

HARD = ["", None, "plain", r"\### Assistant: </turn> ok", "####", "</turn></turn>\n", "\\\\", "### user: x", "é漢\\\n</turn>", ": ", "a" * 3000, "\\"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a: ### b\\", None, ""]), rng.choice(HARD), "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    turns = chat.format_turns(frame)
    for r, t in zip(sorted(rows, key=str), sorted(zip(frame.collect(), turns.collect()), key=lambda p: str(tuple(p[0])))):
        role, text = chat.read_turn(t[1]["formatted"])
        assert (role, text) == (r[2] or "", r[3] or "")
        raw = t[1]["formatted"].encode()
        assert raw[t[1]["content_begin"] : t[1]["content_end"]].endswith(raw[t[1]["content_begin"] : -8])
        bare = re.sub(rb"\\.", b"", raw, flags=re.S)  # without escaped characters
        assert bare.count(b"</turn>") == 1 and bare.count(b"###") == 1
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        want = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(mine), want)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(frame.limit(0))).collect() == []


def test_loss_digest_follows_the_mask(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", r"a ### b\\ c")], "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(frame)
    whole, part = chat.read_back(turns).first(), chat.read_back(turns.withColumn("content_end", turns["content_begin"] + 1)).first()
    assert whole["turns_sha256"] == part["turns_sha256"]
    assert (part["loss_chars"], part["loss_sha256"]) == (1, hashlib.sha256(b"a").hexdigest()) and whole["loss_chars"] > 1


def clouds(rng, dim=32):
    base = rng.standard_normal((150, dim))
    near = [base[k] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * np.linalg.norm(base[k]) / np.sqrt(dim) * rng.uniform(0.05, 0.6) for k in rng.integers(0, 40, 300)]
    return np.concatenate([base, near, base[:20], np.repeat(base[:1], 30, axis=0)]).astype(np.float32)


def test_vectors_recall_and_precision(spark):
    x = clouds(np.random.default_rng(3))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] + [1.0] * 31, 1), (904, [None] + [1.0] * 31, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int"), block=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    count = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (count <= near.sum(axis=1)).all() and count.sum() >= 0.99 * near.sum()
    if count.sum() == near.sum():
        want = classes(list(range(len(x))), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
        assert all(got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905


def test_vectors_recall_in_a_thousand_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(rng.standard_normal((60, 64))[rng.integers(0, 60, 3000)] * 0.5 + rng.standard_normal((3000, 64)))
    aside = rng.standard_normal((2000, 64))
    aside = unit(aside - (aside * base[:2000]).sum(axis=1, keepdims=True) * base[:2000])
    c = rng.uniform(0.9005, 0.98, (2000, 1))
    x = np.concatenate([base, c * base[:2000] + np.sqrt(1 - c**2) * aside]).astype(np.float32)
    monkeypatch.setattr(vectors, "PER_CELL", 4)  # 1,250 cells, of which each vector goes to 4
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 1300)  # most pairs are not among the rows that cells are fitted on
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(rows).collect()}
    u = unit(x.astype(float))
    near = u @ u.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    count = np.array([got[i] for i in range(len(x))])
    assert near.sum() >= 4000 - 20 and (count <= near.sum(axis=1)).all() and count.sum() >= 0.9 * near.sum()


def test_vectors_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert vectors.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()[0]["kept"]


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1, 64))
    x /= np.linalg.norm(x)
    y = x + rng.standard_normal((1, 64)) * 0.05
    y /= np.linalg.norm(y)
    errors, bounds = [], []
    for seed in range(300):
        turn = vectors.rotation(64, seed)
        est, error = vectors.estimates(*vectors.encode(x @ turn), y @ turn)
        errors.append(est[0, 0] - (x @ y.T)[0, 0])
        bounds.append(error[0])
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(300) + 1e-3
    assert np.mean(np.abs(errors) <= 3 * np.array(bounds)) > 0.99


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(5)]
    docs = [(i, prose(rng, rng.randrange(60, 200)), "en" if i % 4 else None, f"s{i % 3}", 0) for i in range(150)]
    docs[10] = (10, docs[9][1], "en", "s1", 0)  # a copy
    docs[20] = (20, docs[20][1] + " " + items[2][1], "en", "s1", 0)  # a leak
    docs[30] = (30, docs[30][1] + " token=abcdefgh12", "en", "s1", 0)
    docs[40], docs[41] = (40, None, None, None, 0), (41, "123 456", "en", None, 0)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_pipeline_stages(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "source_mix":
            assert docs.columns == columns
        left.append({r["doc_id"] for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert left[0] == everything - {40, 41}
    assert left[1] == left[0] - {10}
    assert left[2] == left[1] - {20}
    assert left[3] == left[2]
    assert left[4] <= left[3]
    whole = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in whole.collect()} == left[4]


def test_pipeline_masks_secrets(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = corpus_pipeline.secret_scan(spark, docs, path).where("doc_id = 30").first()["text"]
    assert text.endswith("[REDACTED]")


def test_pipeline_keeps_rows_with_null_or_repeated_ids(spark, tmp_path):
    rng = random.Random(31)
    text = [prose(rng, 90) for _ in range(9)]
    item = prose(rng, 40)
    leak = text[8] + " " + item
    rows = [(1, text[0]), (2, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (None, leak)]  # null ids: texts 1 and 2 are nobody else's
    rows += [(5, text[3]), (5, text[4]), (4, text[4]), (7, text[5]), (7, text[5]), (9, leak), (9, text[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row_number int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for parts in (1, 5):
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), str(tmp_path))
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted([(1, text[0]), (None, text[1]), (None, text[2]), (5, text[3]), (4, text[4]), (7, text[5]), (9, leak), (9, text[6])], key=str)
        clean = corpus_pipeline.decontamination(spark, docs.repartition(parts), str(tmp_path))
        assert clean.columns == docs.columns
        assert sorted(r["row_number"] for r in clean.collect()) == [k for k, (_, t) in enumerate(rows) if t != leak]
