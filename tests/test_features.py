"""Golden values of one venue and of a pair, checkable by hand."""

import pytest
from pyspark.sql import functions as F

from tickframe import market
from tickframe.config import Config
from tickframe.operators import cross, features

SECOND = 1_000_000
CFG = Config(large_trade=150.0, walk_notional=100.0, windows=(5 * SECOND,), cross_min_samples=2)
T = 1_000


def at(seconds_before):
    return int((T - seconds_before) * SECOND)


class Golden(features.Inputs):
    """Inputs made of given events at one key."""

    def __init__(self, spark, trades, quotes, liquidations, levels, venue=market.VENUE_A, cfg=CFG):
        self.cfg = cfg
        make = lambda rows, cols: spark.createDataFrame([(venue, "BTC-USDT-PERP", at(t), at(t), i, *v) for i, (t, *v) in enumerate(rows)], "exchange string, symbol string, us long, recv_us long, ord long, " + cols)
        self.trades = make(trades, "price double, qty double, side string").withColumn("notional", F.col("price") * F.col("qty"))
        self.quotes = make(quotes, "oi double, funding double, mark double, index double")
        self.liquidations = make(liquidations, "position string, notional double")
        self.levels = make(levels, "side string, price double, qty double")
        self.keys = spark.createDataFrame([(venue, "BTC-USDT-PERP")], "exchange string, symbol string")
        self.spine = spark.range(T - 20, T + 1).select(F.col("id").alias("tick_no"))
        self.grid = self.spine.crossJoin(self.keys).withColumn("window_ticks", F.lit(5))


@pytest.fixture(scope="module")
def golden(spark):
    book = [(10, "BID", 99.0, 2.0), (10, "BID", 98.0, 3.0), (10, "ASK", 101.0, 3.0), (10, "ASK", 102.0, 4.0), (1.8, "BID", 99.0, 4.0), (1.8, "ASK", 101.0, 1.0)]
    trades = [(7, 100.0, 1.0, "BUY"), (4, 100.0, 2.0, "BUY"), (2, 101.0, 1.0, "SELL")]
    quotes = [(5, 100.0, 0.0, 100.0, 100.0), (1.3, 110.0, 0.001, 102.0, 100.0)]
    return Golden(spark, trades, quotes, [(1.5, "LONG", 200.0), (1.4, "SHORT", 101.0)], book)


def at_t(df):
    return df.where(F.col("tick_no") == T).first()


def test_trade_flow(golden):
    r = at_t(features.trade_flow(golden))
    assert (r["aggressive_buy_notional"], r["aggressive_sell_notional"]) == (200, 101)
    assert r["taker_imbalance"] == pytest.approx(99 / 301) and r["trade_notional_impulse"] == pytest.approx(2.01) and r["trade_count_impulse"] == 1
    assert r["average_trade_notional"] == 150.5 and r["large_trade_share"] == pytest.approx(200 / 301)


def test_empty_window_is_zero_or_null(golden):
    r = features.trade_flow(golden).where(F.col("tick_no") == T - 20).first()
    assert r["aggressive_buy_notional"] == 0 and r["taker_imbalance"] is None and r["average_trade_notional"] is None


def test_book(golden):
    r = at_t(features.book(golden))
    assert r["weighted_bid_depth"] == pytest.approx(6.4) and r["weighted_ask_depth"] == pytest.approx(4.2) and r["depth_imbalance"] == pytest.approx(2.2 / 10.6)
    assert (r["spread"], r["relative_spread"], r["mid_price"]) == (2, 0.02, 100) and r["microprice"] == pytest.approx(100.6)
    assert r["buy_slippage_bps"] == pytest.approx(100) and r["sell_slippage_bps"] == pytest.approx(100)


def test_book_flow(golden):
    r = at_t(features.book_flow(golden))
    assert (r["bid_liquidity_change"], r["ask_liquidity_change"], r["liquidity_added"], r["liquidity_removed"], r["ofi"]) == (2, -2, 2, 2, 4)
    assert r["recovery_per_second"] == 0


def test_recovery_after_the_first_removal(spark, golden):
    book = [(10, "BID", 99.0, 2.0), (10, "BID", 98.0, 3.0), (10, "ASK", 101.0, 3.0), (10, "ASK", 102.0, 4.0), (1.8, "BID", 99.0, 4.0), (1.8, "ASK", 101.0, 1.0), (0.5, "BID", 98.0, 4.0), (0.5, "ASK", 102.0, 5.0)]
    r = at_t(features.book_flow(Golden(spark, [(4, 1.0, 1.0, "BUY")], [(5, 1.0, 0.0, 1.0, 1.0)], [(1, "LONG", 1.0)], book)))
    assert (r["liquidity_added"], r["liquidity_removed"]) == (4, 2) and r["recovery_per_second"] == pytest.approx(2 / 1.8)


def test_open_interest_premium_liquidation(golden):
    oi, p, q = at_t(features.open_interest(golden)), at_t(features.premium(golden)), at_t(features.liquidation(golden))
    assert oi["oi_change"] == 10 and oi["oi_pct_change"] == pytest.approx(0.1) and oi["oi_age_ms"] == pytest.approx(1300)
    assert p["premium"] == pytest.approx(0.02) and p["funding_rate"] == 0.001
    assert (q["long_notional"], q["short_notional"]) == (200, 101)


def test_price_window_excludes_its_left_edge(spark):
    marks = [(6, 10.0), (5, 1000.0), (4, 100.0), (3, 110.0), (2, 121.0)]
    g = Golden(spark, [(100, 1.0, 1.0, "BUY")], [(t, 1.0, 0.0, m, 1.0) for t, m in marks], [(1, "LONG", 1.0)], [(1, "BID", 1.0, 1.0)])
    r = at_t(features.price(g))
    import math

    assert r["return_value"] == pytest.approx(0.21) and r["realized_volatility"] == pytest.approx(math.sqrt(2 * math.log(1.1) ** 2))


def test_states_of_the_snapshot(golden):
    r = at_t(features.single_venue(golden))
    assert r["price_oi_state"] == "PRICE_UP_OI_UP" and r["crowding_state"] == "CROWDED_LONG" and r["activity_with_oi_decline"] is False
    assert not r["is_warm"] and "NOT_WARM" in r["reason_codes"]


def test_spread_zscore(spark):
    rows = [("S", 5, t, 100.0, b) for t, b in ((8, 100.0), (9, 98.0392156862745), (10, 96.15384615384616))]
    rows = [(s, w, t, {8: 100.0, 9: 102.0, 10: 104.0}[t], 100.0) for s, w, t, _, _ in rows]
    p = cross.spread_zscore(spark.createDataFrame(rows, "symbol string, window_ticks int, tick_no long, a_mid_price double, b_mid_price double"), CFG)
    r = p.where("tick_no = 10").first()
    history = [0.0, 2 / 101]
    mean = sum(history) / 2
    deviation = (sum((x - mean) ** 2 for x in history) / 2) ** 0.5
    assert r["spread_z"] == pytest.approx((4 / 102 - mean) / deviation) and r["spread_samples"] == 2
    flat = cross.spread_zscore(spark.createDataFrame([("S", 5, t, 100.0, 100.0) for t in range(5)], "symbol string, window_ticks int, tick_no long, a_mid_price double, b_mid_price double"), CFG)
    assert flat.where("spread_z is not null").count() == 0
