"""Windows, as-of, lateness, history: against plain Python over random events."""

import random
import statistics

import pytest

from tickframe.config import Config
from tickframe.operators import timeline as TL

CFG = Config(tick=10, signal_tick=50, windows=(10, 30, 60), lookback=80, breakout=20, atr_period=40, atr_bar=10, lateness=3)
SCHEMA = "exchange string, symbol string, ord long, us long, recv_us long, v double"


def events(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        us = rng.choice([rng.randrange(100, 500), rng.randrange(10, 50) * 10])
        rows.append((rng.choice("AB"), "S", i, us, us + rng.choice([0, 0, 1, 5, 10, 37]), float(rng.randrange(1, 9))))
    return rows


def test_window_aggregate_equals_definition(spark):
    rows = events(1)
    df = spark.createDataFrame(rows, SCHEMA)
    for previous in (False, True):
        got = {(r["exchange"], r["window_ticks"], r["tick_no"]): (r["n"], r["s"], r["first"]["ord"], r["last"]["ord"]) for r in TL.window_aggregate(df, CFG, list(CFG.windows), {"s": df["v"]}, {"first": __import__("pyspark.sql.functions", fromlist=["x"]).struct("us", "ord")}, {"last": __import__("pyspark.sql.functions", fromlist=["x"]).struct("us", "ord")}, previous=previous).collect()}
        want = {}
        for e in "AB":
            for w in CFG.windows:
                for t in range(0, 800, 10):
                    lo, hi = (t - 2 * w, t - w) if previous else (t - w, t)
                    hit = sorted((r[3], r[2], r[5]) for r in rows if r[0] == e and lo < r[3] <= hi and r[4] <= t)
                    if hit:
                        want[e, w // 10, t // 10] = (len(hit), sum(h[2] for h in hit), hit[0][1], hit[-1][1])
        assert got == want


def test_as_of_equals_definition(spark):
    rows = events(2)
    df = spark.createDataFrame(rows, SCHEMA)
    ticks = spark.createDataFrame([(e, "S", t) for e in "AB" for t in range(5, 70)], "exchange string, symbol string, tick_no long")
    for lag in (0, 3):
        got = {(r["exchange"], r["tick_no"]): (r["us"], r["v"]) for r in TL.as_of(df, ticks, CFG, ["v"], lag_ticks=lag).collect()}
        for e in "AB":
            for t in range(5, 70):
                hit = max(((r[3], r[2], r[5]) for r in rows if r[0] == e and r[3] <= (t - lag) * 10 and r[4] <= t * 10), default=None)
                assert got[e, t] == ((hit[0], hit[2]) if hit else (None, None))


def test_late_events(spark):
    rows = [("A", "S", i, us, 1000 + i, 1.0) for i, us in enumerate([2, 1, 2, 5, 3, 9])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["us"] for r in TL.accepted(df).orderBy("ord").collect()] == [2, 2, 5, 9]
    assert [r["us"] for r in TL.accepted(df, policy="insert", lateness=2).orderBy("ord").collect()] == [2, 1, 2, 5, 3, 9]
    status = [r["status"] for r in TL.admissibility(df, ["exchange"], 1, 2).orderBy("ord").collect()]
    assert status == ["ACCEPTED", "ACCEPTED", "ACCEPTED", "ACCEPTED", "EXPIRED", "ACCEPTED"]


def test_retention_and_capacity(spark):
    df = spark.createDataFrame([("A", "S", i, i, i, 1.0) for i in range(5)], SCHEMA)
    assert sorted(r["us"] for r in TL.retained(df, ["exchange"], 5, 3).collect()) == [2, 3, 4]
    more = df.unionByName(spark.createDataFrame([("A", "S", 9, 8, 8, 1.0)], SCHEMA))
    assert sorted(r["us"] for r in TL.retained(more, ["exchange"], 5, 3).collect()) == [4, 8]


def test_prior_zscore_equals_definition(spark):
    rng = random.Random(3)
    rows = [("A", t, rng.choice([None, float(rng.randrange(5)), float(rng.randrange(5))])) for t in range(0, 120) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "exchange string, tick_no long, x double")
    got = {r["tick_no"]: (r["z"], r["z_warm"]) for r in TL.prior_zscore(df, "x", 8, ["exchange"]).collect()}
    history = []
    for _, t, x in rows:
        z = warm = None
        if x is not None:
            if len(history) >= 2 and statistics.pstdev([h[1] for h in history]) > 0:
                values = [h[1] for h in history]
                z = (x - statistics.fmean(values)) / statistics.pstdev(values)
            warm = z is not None and history[0][0] <= t - 8
            history = [h for h in history + [(t, x)] if h[0] > t - 8]
        assert got[t][0] == (pytest.approx(z) if z is not None else None) and got[t][1] == bool(warm)


def test_ticks(spark):
    df = spark.createDataFrame([("A", "S", 1, 10, 10, 1.0), ("A", "S", 2, 31, 31, 1.0)], SCHEMA)
    assert [r["tick_no"] for r in TL.spine(df, CFG).orderBy("tick_no").collect()] == [2, 3, 4]
    kinds = [(r["decision_us"], r["kind"]) for r in TL.decision_ticks(spark.createDataFrame([("A", "S", 1, 45, 45, 1.0)], SCHEMA), CFG).orderBy("decision_us", "rank").collect()]
    assert kinds == [(50, "FEATURE"), (50, "SIGNAL")]
    assert TL.spine(df.limit(0), CFG).collect() == []


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(events(5), SCHEMA)
    one = sorted(map(str, TL.window_aggregate(TL.accepted(df), CFG, [30], {"s": df["v"]}).collect()))
    assert one == sorted(map(str, TL.window_aggregate(TL.accepted(df.repartition(7)), CFG, [30], {"s": df["v"]}).collect()))


def test_config_rejects_odd_windows():
    with pytest.raises(ValueError):
        Config(tick=10, windows=(15,))


def test_accepted_in_slices_equals_one_pass(spark):
    rows = spark.createDataFrame([("A", "S", i, (i * 7919) % 300, i * 10 + (i * 31) % 40) for i in range(400)] + [("B", "S", 1, 5, 3_000)], "exchange string, symbol string, ord long, us long, recv_us long")
    want, high = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r["exchange"], r["recv_us"], r["ord"])):
        if r["us"] >= high.get(r["exchange"], r["us"]):
            want.append((r["exchange"], r["ord"]))
        high[r["exchange"]] = max(r["us"], high.get(r["exchange"], r["us"]))
    width = TL.SLICE
    try:
        for TL.SLICE in (7, 100, width):
            got = TL.accepted(rows)
            assert got.columns == rows.columns
            assert sorted((r["exchange"], r["ord"]) for r in got.collect()) == sorted(want)
    finally:
        TL.SLICE = width
    assert TL.accepted(rows.limit(0)).count() == 0


def test_sums_of_the_window_before_come_in_the_same_pass(spark):
    df = spark.createDataFrame(events(3), SCHEMA)
    both = TL.window_aggregate(df, CFG, list(CFG.windows), {"s": df["v"]}, before={"b": df["v"]})
    got = {tuple(r[:3]): (r["window_ticks"], r["n"], r["s"], r["n_before"], r["b"]) for r in both.select("exchange", "window_ticks", "tick_no", "n", "s", "n_before", "b").collect()}
    for back, (n, s) in ((False, (1, 2)), (True, (3, 4))):
        alone = {(r["exchange"], r["window_ticks"], r["tick_no"]): (r["n"], r["s"]) for r in TL.window_aggregate(df, CFG, list(CFG.windows), {"s": df["v"]}, previous=back).collect()}
        assert {k: (v[n], v[s]) for k, v in got.items() if v[n] is not None} == alone
