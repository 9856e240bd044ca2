"""z-scores whose histories end with a generation of the book."""

import statistics

import pytest
from pyspark.sql import functions as F

from tests.test_features import CFG, SECOND, T, Golden, at
from tests.test_orders import events, oracle, rows_of  # noqa: F401
from tickframe import market
from tickframe.operators import cross, features


def z(value, history):
    s = statistics.pstdev(history) if len(history) >= 2 else 0
    return (value - statistics.fmean(history)) / s if s else None


def generations(spark, rows, venue=market.VENUE_A):
    return spark.createDataFrame([(venue, "BTC-USDT-PERP", at(t), at(t), i, g) for i, (t, g) in enumerate(rows)], "exchange string, symbol string, us long, recv_us long, ord long, generation long")


def test_a_new_generation_drops_metric_histories(spark):
    trades = [(k + 0.5, 100.0, float(1 + k * k % 7), "BUY" if k % 3 else "SELL") for k in range(18)]
    g = Golden(spark, trades, [(19, 100.0, 0.0, 100.0, 100.0)], [(1, "LONG", 1.0)], [(19, "BID", 99.0, 1.0), (19, "ASK", 101.0, 1.0)])
    plain = features.with_zscores(features.metrics(g), CFG)
    assert "segment" not in plain.columns
    # a reset at T - 9, one and back again (no change from decision to decision) before T - 4
    g.book_generations = generations(spark, [(18, 0), (9.5, 1), (4.6, 2), (4.4, 1)])
    rows = features.with_zscores(features.metrics(g), CFG).orderBy("tick_no").collect()
    assert [r["segment"] for r in rows] == [int(r["tick_no"] >= T - 9) for r in rows]
    assert [r["book_resets"] for r in rows] == [1 * (r["tick_no"] >= T - 9) + 2 * (r["tick_no"] >= T - 4) for r in rows]
    for r in rows:
        before = [x["taker_imbalance"] for x in rows if x["tick_no"] < r["tick_no"] and x["segment"] == r["segment"] and x["taker_imbalance"] is not None]
        want = z(r["taker_imbalance"], before) if r["taker_imbalance"] is not None else None
        assert r["taker_imbalance_z"] == (want if want is None else pytest.approx(want))
    mixed = {r["tick_no"]: r["taker_imbalance_z"] for r in plain.collect()}
    assert mixed[T - 9] is not None and next(r for r in rows if r["tick_no"] == T - 9)["taker_imbalance_z"] is None


def test_a_new_generation_of_either_venue_drops_the_spread_history(spark):
    mids = [100.0, 102.0, 104.0, 103.0, 107.0, 101.0, 105.0]
    resets = [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (0, None), (0, 1)]
    rows = [("S", 5, t, m, 100.0, *r) for t, (m, r) in enumerate(zip(mids, resets))]
    p = cross.spread_zscore(spark.createDataFrame(rows, "symbol string, window_ticks int, tick_no long, a_mid_price double, b_mid_price double, a_book_resets long, b_book_resets long"), CFG)
    got = {r["tick_no"]: (r["spread_samples"], r["spread_z"]) for r in p.collect()}
    assert [got[t][0] for t in range(7)] == [0, 1, 2, 0, 1, 2, 3] and got[3][1] is None
    spread = [(m - 100) / ((m + 100) / 2) for m in mids]
    assert got[5][1] == pytest.approx(z(spread[5], spread[3:5])) and got[6][1] == pytest.approx(z(spread[6], spread[3:6]))


def test_resets_reach_the_cross_snapshots(spark):
    g = Golden(spark, [(7, 100.0, 1.0, "BUY")], [(5, 100.0, 0.0, 100.0, 100.0)], [(1, "LONG", 1.0)], [(10, "BID", 99.0, 2.0), (10, "ASK", 101.0, 3.0)])
    g.book_generations = generations(spark, [(18, 0), (3.5, 1)])
    one = features.single_venue(g)
    both = one.unionByName(one.withColumn("exchange", F.lit(market.VENUE_B)))
    samples = {r["tick_no"]: r["spread_samples"] for r in cross.cross_venue(both, CFG).collect()}
    assert samples[T - 4] > 1 and samples[T - 3] == 0 and samples[T] == 3


def test_query_equals_its_sql(spark, events):  # noqa: F811
    got = rows_of(spark, events, "win_07_reset_zscore")
    assert len({r["segment"] for r in got}) > 1 and any(r["z"] is not None for r in got)
    assert sorted(map(str, got)) == oracle(events, "win_07_reset_zscore")
