"""The engine's operators as named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.config import DEMO
from tickframe.operators import cross as X
from tickframe.operators import features as FE
from tickframe.plans import oracle
from tickframe.plans.oracle import sql

Query = Callable[[SparkSession, str], DataFrame]
CELL = ("exchange", "symbol", "window_ticks", "tick_no")
TICK = ("exchange", "symbol", "tick_no")
PAIR = ("symbol", "window_ticks", "tick_no")
PLACES = 6
#: Averages of amounts with few digits often lie half-way at 6 places, where the last bit decides.
MORE_PLACES = {"average_trade_notional": 9}


def tidy(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Chosen columns in the types that both engines share: long, double (rounded), string, boolean."""
    kinds, out = dict(df.dtypes), []
    for c in columns:
        k, col = kinds[c], F.col(c)
        if k.startswith(("double", "float", "decimal")):
            col = F.round(col.cast("double"), MORE_PLACES.get(c, PLACES)) + F.lit(0.0)
        elif k in ("int", "bigint", "smallint", "tinyint"):
            col = col.cast("long")
        elif k.startswith("array"):
            col = F.concat_ws(",", col)
        out.append(col.alias(c))
    return df.select(*out)


DOUBLES = {
    "aggressive_buy_notional", "aggressive_sell_notional", "taker_imbalance", "trade_notional_impulse", "trade_count_impulse", "average_trade_notional", "large_trade_share", "return_value", "realized_volatility", "trailing_high", "trailing_low", "atr", "recent_move_atr",
    "oi", "oi_change", "oi_pct_change", "oi_age_ms", "funding_rate", "premium", "long_notional", "short_notional", "activity", "ofi", "bid_liquidity_change", "ask_liquidity_change", "liquidity_added", "liquidity_removed", "recovery_per_second",
    "weighted_bid_depth", "weighted_ask_depth", "spread", "mid_price", "relative_spread", "microprice", "depth_imbalance", "buy_slippage_bps", "sell_slippage_bps", "data_age_ms", *(f"{m}_z" for m in FE.Z_METRICS),
}
LONGS = {"window_ticks", "tick_no", "trades", "prices", "liquidations", "oi_us", "newest_us", "source_event_count", "oldest_us"}


def shown(columns: tuple[str, ...], renamed: dict[str, str] | None = None) -> str:
    """The same choice in SQL."""
    out = []
    for c in columns:
        e = (renamed or {}).get(c, c)
        out.append(f"round(CAST({e} AS DOUBLE), {MORE_PLACES.get(c, PLACES)}) + 0.0 AS {c}" if c in DOUBLES else f"CAST({e} AS BIGINT) AS {c}" if c in LONGS else f"{e} AS {c}")
    return ", ".join(out)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def family(make: Callable[[FE.Inputs], DataFrame], keys: tuple[str, ...], source: str, needs: tuple[str, ...], **queries: tuple[str, ...]) -> None:
    """Queries that show some columns of one operator's result."""
    for name, columns in queries.items():
        every = (*keys, *columns)
        QUERIES[name] = lambda spark, d, every=every: tidy(make(FE.Inputs(spark, d, DEMO)), every)
        ORACLES[name] = sql(f"SELECT {shown(every)} FROM {source}", *needs)


family(
    FE.trade_flow, CELL, "trade_flow", ("trade_flow",),
    agg_01_aggressive_buy_notional=("aggressive_buy_notional",), agg_02_aggressive_sell_notional=("aggressive_sell_notional",), agg_03_taker_imbalance=("taker_imbalance",), agg_04_trade_notional_impulse=("trade_notional_impulse",), agg_05_trade_count_impulse=("trade_count_impulse",),
    agg_06_average_trade_notional=("average_trade_notional",), agg_07_large_trade_share=("large_trade_share",), win_01_trailing_range_window=("aggressive_buy_notional", "aggressive_sell_notional", "trades"), win_02_previous_range_window=("trade_notional_impulse", "trade_count_impulse"),
    jn_02_range_join=("trades", "taker_imbalance"), str_11_hopping_windows=("trades", "average_trade_notional"), str_04_visibility=("trades",), flt_04_window_membership=("trades", "aggressive_buy_notional"),
)
family(FE.price, CELL, "price", ("price",), agg_16_return_value=("return_value",), agg_17_realized_volatility=("realized_volatility",), win_10_first_last_in_frame=("return_value", "prices"), win_11_lag_returns=("realized_volatility", "prices"), fea_04_price_group=("return_value", "realized_volatility", "prices"), set_01_price_stream_union=("prices",), fea_19_price_cache=("return_value", "realized_volatility"))
family(FE.price_range, TICK, "price_range", ("price_range",), agg_19_trailing_high_low=("trailing_high", "trailing_low"))
family(FE.atr, TICK, "atr", ("atr",), agg_18_atr=("atr",), win_12_tumbling_bars=("atr",))
family(FE.move_in_atr, CELL, "(SELECT exchange, symbol, window_ticks, tick_no, move / nullif(atr, 0) AS recent_move_atr FROM price JOIN atr USING (exchange, symbol, tick_no))", ("price", "atr"), agg_20_recent_move_atr=("recent_move_atr",))
family(FE.open_interest, CELL, "open_interest", ("open_interest",), agg_22_open_interest_change=("oi_change", "oi_pct_change"), agg_23_open_interest_age=("oi_age_ms",), jn_01_asof_open_interest=("oi", "oi_us"), fea_05_open_interest_group=("oi", "oi_change", "oi_pct_change", "oi_age_ms"))
family(FE.premium, TICK, "oi_now", ("oi_now",), agg_24_premium=("premium",), fea_06_crowding_inputs=("funding_rate", "premium"))
family(FE.liquidation, CELL, "liquidation", ("liquidation",), agg_25_liquidation_notionals=("long_notional", "short_notional", "activity"), fea_07_liquidation_group=("long_notional", "short_notional", "activity", "liquidations"))
family(FE.book_flow, CELL, "book_flow", ("book_flow",), agg_12_ofi=("ofi",), agg_13_liquidity_changes=("bid_liquidity_change", "ask_liquidity_change", "liquidity_added", "liquidity_removed"), agg_14_recovery_per_second=("recovery_per_second",), sta_07_level_deltas=("liquidity_added", "liquidity_removed"))
family(FE.book, TICK, "book", ("book",), agg_08_weighted_depth=("weighted_bid_depth", "weighted_ask_depth"), agg_09_depth_imbalance=("depth_imbalance",), agg_10_spread_mid=("spread", "mid_price", "relative_spread"), agg_11_microprice=("microprice",), agg_15_depth_walk_slippage=("buy_slippage_bps", "sell_slippage_bps"), fea_03_order_book_group=("weighted_bid_depth", "weighted_ask_depth", "mid_price", "microprice", "depth_imbalance"), sta_08_book_view=("mid_price", "spread"), srt_06_top_k_levels=("weighted_bid_depth", "weighted_ask_depth"))
family(
    FE.single_venue, CELL, "single", ("single",),
    win_03_prior_zscore=("taker_imbalance_z", "ofi_z", "return_value_z"), win_06_zscored_metrics=tuple(f"{m}_z" for m in FE.Z_METRICS), agg_21_abnormal_jump=("abnormal_jump",), agg_26_activity_with_oi_decline=("activity_with_oi_decline",), agg_27_data_age=("data_age_ms",),
    scl_17_price_oi_state=("price_oi_state",), scl_18_crowding_state=("crowding_state",), scl_23_funding_zscore=("funding_rate_z",), sta_12_snapshot_readiness=("is_warm", "is_healthy"), fea_01_single_venue=("aggressive_buy_notional", "taker_imbalance", "taker_imbalance_z", "ofi", "mid_price", "return_value", "oi_change", "premium", "activity", "price_oi_state", "crowding_state", "is_warm", "is_healthy", "data_age_ms"),
    fea_02_calculate_all=("trades", "is_warm"),
)


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    one = FE.single_venue(FE.Inputs(spark, d, DEMO))
    return tidy(one.withColumnRenamed("reason_codes", "reasons"), (*CELL, "reasons"))


for _name in ("sta_11_availability_reasons", "set_02_distinct_reasons"):
    QUERIES[_name] = _reasons
    ORACLES[_name] = sql("SELECT exchange, symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no, reasons FROM single", "single")


def _warm(spark: SparkSession, d: str) -> DataFrame:
    one = FE.single_venue(FE.Inputs(spark, d, DEMO))
    return tidy(one, (*CELL, "taker_imbalance_z_warm", "premium_z_warm"))


QUERIES["win_04_zscore_warm"] = _warm
ORACLES["win_04_zscore_warm"] = sql("SELECT exchange, symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no, taker_imbalance_warm AS taker_imbalance_z_warm, premium_warm AS premium_z_warm FROM single", "single")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    return tidy(FE.lineage(FE.Inputs(spark, d, DEMO)), (*CELL, "source_event_count", "oldest_us", "newest_us", "digest_sum"))


_SOURCES = """sources AS (SELECT *, sha256('tickframe/source/v1' || chr(30) || concat_ws(chr(31), stream, exchange, symbol, CAST(us AS VARCHAR), CAST(recv_us AS VARCHAR), CAST(ord AS VARCHAR))) AS digest FROM (
  SELECT 'trade' AS stream, exchange, symbol, us, recv_us, ord FROM trades UNION ALL SELECT 'quote', exchange, symbol, us, recv_us, ord FROM quotes UNION ALL SELECT 'liquidation', exchange, symbol, us, recv_us, ord FROM liquidations UNION ALL SELECT 'book', exchange, symbol, us, recv_us, ord FROM levels))"""
_LIMBS = ", ".join(f"coalesce(sum(CAST('0x' || substr(digest, {64 - 8 * (i + 1) + 1}, 8) AS BIGINT)), 0) AS l{i}" for i in range(8))
_CARRY = []
for _i in range(8):
    _CARRY.append(f"l{_i} + c{_i - 1}" if _i else "l0")
_CARRIES = "".join(f", LATERAL (SELECT ({_CARRY[i]}) % 4294967296 AS d{i}, ({_CARRY[i]}) // 4294967296 AS c{i}) AS x{i}" for i in range(8))
QUERIES["agg_29_lineage_digest"] = QUERIES["fea_08_source_lineage"] = lineage
ORACLES["agg_29_lineage_digest"] = ORACLES["fea_08_source_lineage"] = (
    sql("", "grid", "trades", "quotes", "liquidations", "levels").rstrip() + ",\n" + _SOURCES
    + f""", s AS (SELECT g.exchange, g.symbol, g.window_ticks, g.tick_no, count(e.us) AS n, min(e.us) AS oldest, max(e.us) AS newest, {_LIMBS} FROM grid g LEFT JOIN sources e ON e.exchange = g.exchange AND e.symbol = g.symbol
      AND e.us <= g.tick_no * {DEMO.tick} AND e.recv_us <= g.tick_no * {DEMO.tick} AND e.us > (g.tick_no - g.window_ticks) * {DEMO.tick} GROUP BY ALL)
SELECT exchange, symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no, n AS source_event_count, oldest AS oldest_us, newest AS newest_us, """
    + " || ".join(f"lower(lpad(hex(CAST(d{i} AS BIGINT)), 8, '0'))" for i in reversed(range(8))) + f" AS digest_sum FROM s{_CARRIES}"
)


def lineage_reference(spark: SparkSession, d: str) -> DataFrame:
    return tidy(FE.lineage(FE.Inputs(spark, d, DEMO)), (*CELL, "digest_xor", "sources"))


_XOR = " || ".join(f"lower(lpad(hex(coalesce(bit_xor(CAST('0x' || substr(digest, {64 - 8 * (i + 1) + 1}, 8) AS BIGINT)), 0)), 8, '0'))" for i in reversed(range(8)))
QUERIES["scl_35_lineage_reference"] = lineage_reference
ORACLES["scl_35_lineage_reference"] = (
    sql("", "grid", "trades", "quotes", "liquidations", "levels").rstrip() + ",\n" + _SOURCES
    + f""", x AS (SELECT g.exchange, g.symbol, CAST(g.window_ticks AS BIGINT) AS window_ticks, g.tick_no, {_XOR} AS digest_xor FROM grid g LEFT JOIN sources e ON e.exchange = g.exchange AND e.symbol = g.symbol
      AND e.us <= g.tick_no * {DEMO.tick} AND e.recv_us <= g.tick_no * {DEMO.tick} AND e.us > (g.tick_no - g.window_ticks) * {DEMO.tick} GROUP BY ALL)
SELECT x.exchange, x.symbol, x.window_ticks, x.tick_no, digest_xor, 'feature-sources://sha256-sum-xor-v1/' || sha256(concat_ws(chr(31), CAST(source_event_count AS VARCHAR), digest_sum, digest_xor, coalesce(CAST(oldest_us AS VARCHAR), chr(0)), coalesce(CAST(newest_us AS VARCHAR), chr(0)))) AS sources
FROM x JOIN ({ORACLES['agg_29_lineage_digest']}) USING (exchange, symbol, window_ticks, tick_no)"""
)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return tidy(FE.lineage(FE.Inputs(spark, d, DEMO)), (*CELL, "source_event_count", "oldest_us", "newest_us"))


QUERIES["agg_28_source_counts"] = counts
ORACLES["agg_28_source_counts"] = f"SELECT exchange, symbol, window_ticks, tick_no, source_event_count, oldest_us, newest_us FROM ({ORACLES['agg_29_lineage_digest']})"

# --------------------------------------------------------------------------------------- cross venue


def cross(spark: SparkSession, d: str) -> DataFrame:
    return X.cross_venue(FE.single_venue(FE.Inputs(spark, d, DEMO)), DEMO)


_EPS, _LIMIT, _APART = DEMO.epsilon, DEMO.cross_max_age / 1000, DEMO.cross_max_difference / 1000


def _dir(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'UNAVAILABLE' WHEN {x} > {_EPS} THEN 'POSITIVE' WHEN {x} < -{_EPS} THEN 'NEGATIVE' ELSE 'FLAT' END"


def _agree(n: str) -> str:
    a, b = _dir(f"a_{n}"), _dir(f"b_{n}")
    return f"CASE WHEN a_{n} IS NULL OR b_{n} IS NULL THEN 'UNAVAILABLE' WHEN ({a}) <> ({b}) THEN 'DIVERGENT' ELSE 'BOTH_' || ({a}) END"


_VALUES = {
    "spread_difference": "a_mid_price - b_mid_price", "pct_spread": "pct_spread", "spread_z": "spread_z", "return_agreement": _agree("return_value"), "impulse_agreement": _agree("return_value_z"), "impulse_difference": "a_return_value_z - b_return_value_z",
    "volatility_difference": "a_realized_volatility - b_realized_volatility", "relative_spread_difference": "a_relative_spread - b_relative_spread", "taker_agreement": _agree("taker_imbalance"), "taker_difference": "a_taker_imbalance - b_taker_imbalance",
    "taker_strength": f"CASE WHEN a_taker_imbalance IS NULL OR b_taker_imbalance IS NULL THEN 'UNAVAILABLE' WHEN abs(abs(a_taker_imbalance) - abs(b_taker_imbalance)) <= {DEMO.tolerance} THEN 'CONSISTENT' ELSE 'DIVERGENT' END",
    "ofi_agreement": _agree("ofi"), "ofi_difference": "a_ofi - b_ofi", "depth_imbalance_difference": "a_depth_imbalance - b_depth_imbalance", "added_difference": "a_liquidity_added - b_liquidity_added", "removed_difference": "a_liquidity_removed - b_liquidity_removed", "recovery_difference": "a_recovery_per_second - b_recovery_per_second",
    "liquidity_status": f"CASE WHEN ({_dir('(a_liquidity_added - a_liquidity_removed)')}) <> ({_dir('(b_liquidity_added - b_liquidity_removed)')}) THEN 'DIVERGENT' ELSE CASE {_dir('(a_liquidity_added - a_liquidity_removed)')} WHEN 'POSITIVE' THEN 'CONFIRMED_ADDITION' WHEN 'NEGATIVE' THEN 'CONFIRMED_REMOVAL' ELSE 'NEUTRAL' END END",
    "price_oi_agreement": "CASE WHEN a_price_oi_state IS NULL OR b_price_oi_state IS NULL THEN 'UNAVAILABLE' WHEN a_price_oi_state = b_price_oi_state THEN 'MATCHED' ELSE 'CONFLICT' END", "a_oi_direction": _dir("a_oi_pct_change"), "b_oi_direction": _dir("b_oi_pct_change"),
    "funding_agreement": _agree("funding_rate"), "a_funding_abnormality": "abs(a_funding_rate_z)", "b_funding_abnormality": "abs(b_funding_rate_z)", "funding_abnormality_difference": "abs(a_funding_rate_z) - abs(b_funding_rate_z)", "premium_difference": "a_premium - b_premium",
    "crowding_agreement": "CASE WHEN a_crowding_state IS NULL OR b_crowding_state IS NULL THEN 'UNAVAILABLE' WHEN a_crowding_state = b_crowding_state THEN 'BOTH_' || replace(a_crowding_state, 'CROWDED_', '') WHEN 'MIXED' IN (a_crowding_state, b_crowding_state) THEN 'ONE_SIDED' ELSE 'DIVERGENT' END",
    "liquidation_agreement": f"CASE WHEN a_activity_z IS NULL OR b_activity_z IS NULL THEN 'UNAVAILABLE' WHEN least(a_activity_z, b_activity_z) >= {DEMO.jump_z} THEN 'BOTH_ELEVATED' WHEN greatest(a_activity_z, b_activity_z) >= {DEMO.jump_z} AND least(a_activity_z, b_activity_z) <= -{DEMO.jump_z} THEN 'DIVERGENT' WHEN greatest(a_activity_z, b_activity_z) >= {DEMO.jump_z} THEN 'ONE_SIDED' ELSE 'BOTH_NORMAL' END",
}
_TEXT = {k for k, v in _VALUES.items() if k.endswith(("agreement", "direction", "status", "strength"))}
_VOTE = lambda c, zero: f"CASE WHEN {c} = 'UNAVAILABLE' THEN NULL WHEN {c} IN ('DIVERGENT', 'CONFLICT') THEN -1.0 WHEN {c} IN ({zero}) THEN 0.0 ELSE 1.0 END"
_VOTES = [_VOTE(c, "'BOTH_FLAT'") for c in ("return_agreement", "impulse_agreement", "taker_agreement", "ofi_agreement")] + [_VOTE("price_oi_agreement", "''"), _VOTE("crowding_agreement", "'ONE_SIDED'"), _VOTE("liquidation_agreement", "'ONE_SIDED'")]
_CROSS = (
    sql("", "pair").rstrip()
    + f""", aged AS (SELECT *, greatest(0, tick_no * {DEMO.tick} - a_newest_us) / 1000.0::DOUBLE AS a_age_ms, greatest(0, tick_no * {DEMO.tick} - b_newest_us) / 1000.0::DOUBLE AS b_age_ms, abs(a_newest_us - b_newest_us) / 1000.0::DOUBLE AS time_difference_ms,
    (a_mid_price - b_mid_price) / nullif((abs(a_mid_price) + abs(b_mid_price)) / 2, 0) AS pct_spread FROM pair),
aged2 AS (SELECT *, CASE WHEN a_newest_us IS NULL THEN NULL ELSE a_age_ms END AS aa, CASE WHEN b_newest_us IS NULL THEN NULL ELSE b_age_ms END AS ba FROM aged),
hist AS (SELECT x.symbol, x.window_ticks, x.tick_no, count(h.pct_spread) AS n, CASE WHEN count(h.pct_spread) >= {DEMO.cross_min_samples} AND max(h.pct_spread) > min(h.pct_spread) THEN (any_value(x.pct_spread) - avg(h.pct_spread)) / stddev_pop(h.pct_spread) END AS spread_z
  FROM aged x LEFT JOIN aged h ON h.symbol = x.symbol AND h.window_ticks = x.window_ticks AND h.tick_no < x.tick_no AND h.tick_no > x.tick_no - {DEMO.ticks(DEMO.lookback)} GROUP BY ALL),
st AS (SELECT *, CASE WHEN coalesce(aa > {_LIMIT}, false) AND coalesce(ba > {_LIMIT}, false) THEN 'UNAVAILABLE' WHEN coalesce(aa > {_LIMIT}, false) THEN 'STALE_{oracle.A}' WHEN coalesce(ba > {_LIMIT}, false) THEN 'STALE_{oracle.B}'
    WHEN a_newest_us IS NULL OR b_newest_us IS NULL OR coalesce(time_difference_ms > {_APART}, false) OR NOT (a_is_warm AND b_is_warm AND a_is_healthy AND b_is_healthy) THEN 'DEGRADED' ELSE 'ALIGNED' END AS status,
    CASE WHEN aa IS NULL OR ba IS NULL OR time_difference_ms IS NULL THEN 0.0 ELSE 1 / (1 + greatest(aa / {_LIMIT}, ba / {_LIMIT}, time_difference_ms / {_APART})) END AS quality,
    concat_ws(',', CASE WHEN a_newest_us IS NULL OR b_newest_us IS NULL THEN 'FEATURE_INPUT_MISSING' END, CASE WHEN aa > {_LIMIT} THEN 'STALE_{oracle.A}_SNAPSHOT' END, CASE WHEN ba > {_LIMIT} THEN 'STALE_{oracle.B}_SNAPSHOT' END, CASE WHEN NOT a_is_warm THEN '{oracle.A}_NOT_WARM' END, CASE WHEN NOT b_is_warm THEN '{oracle.B}_NOT_WARM' END,
      CASE WHEN NOT a_is_healthy THEN '{oracle.A}_UNHEALTHY' END, CASE WHEN NOT b_is_healthy THEN '{oracle.B}_UNHEALTHY' END, CASE WHEN time_difference_ms > {_APART} THEN 'TIME_ALIGNMENT' END) AS alignment
  FROM aged2 JOIN hist USING (symbol, window_ticks, tick_no)),
vals AS (SELECT symbol, window_ticks, tick_no, status, quality, aa, ba, time_difference_ms, alignment, CASE WHEN pct_spread IS NULL THEN 0 ELSE n END AS spread_samples, {', '.join(f"CASE WHEN status <> 'UNAVAILABLE' THEN {v} END AS {k}" for k, v in _VALUES.items())} FROM st),
vv AS (SELECT *, list_filter([{', '.join(_VOTES)}], lambda x: x IS NOT NULL) AS votes FROM vals),
fin AS (SELECT *, CASE WHEN status <> 'UNAVAILABLE' AND len(votes) > 0 THEN list_sum(votes) / len(votes) END AS confirmation, CASE WHEN status <> 'UNAVAILABLE' AND len(votes) > 0 THEN len(list_filter(votes, lambda x: x < 0)) / len(votes) END AS divergence FROM vv)
"""
)


def cross_family(**queries: tuple[str, ...]) -> None:
    for name, columns in queries.items():
        every = (*PAIR, *columns)
        QUERIES[name] = lambda spark, d, every=every: tidy(cross(spark, d), every)
        rename = {"a_age_ms": "aa", "b_age_ms": "ba"}
        out = []
        for c in every:
            e = rename.get(c, c)
            text = c in _TEXT or c in ("status", "symbol")
            out.append(f"{e} AS {c}" if text else f"CAST({e} AS BIGINT) AS {c}" if c in (*PAIR, "spread_samples") else f"round(CAST({e} AS DOUBLE), {PLACES}) + 0.0 AS {c}")
        ORACLES[name] = _CROSS + f"SELECT {', '.join(out)} FROM fin"


cross_family(
    jn_03_venue_pair=("status", "a_age_ms", "b_age_ms"), jn_04_paired_spread_history=("pct_spread", "spread_samples"), win_08_cross_spread_zscore=("spread_z", "spread_samples"), fea_10_alignment=("status", "quality", "time_difference_ms"), scl_15_alignment_quality=("quality",), scl_14_symmetric_spread=("pct_spread",),
    scl_10_direction=("a_oi_direction", "b_oi_direction"), scl_11_direction_agreement=("return_agreement", "taker_agreement"), scl_12_null_difference=("impulse_difference", "premium_difference"), scl_16_strength_agreement=("taker_strength",), scl_19_crowding_agreement=("crowding_agreement",),
    scl_20_liquidation_agreement=("liquidation_agreement",), scl_21_liquidity_divergence=("liquidity_status",), scl_22_context_agreement=("price_oi_agreement",), scl_23_funding_abnormality=("a_funding_abnormality", "b_funding_abnormality", "funding_abnormality_difference"),
    agg_32_confirmation=("confirmation", "divergence"), scl_13_votes=("confirmation",), fea_11_cross_price=("spread_difference", "pct_spread", "spread_z", "return_agreement", "volatility_difference", "relative_spread_difference"),
    fea_12_cross_order_flow=("taker_agreement", "taker_difference", "taker_strength", "ofi_agreement", "ofi_difference", "added_difference", "removed_difference", "recovery_difference", "liquidity_status"),
    fea_13_cross_positioning=("price_oi_agreement", "a_oi_direction", "b_oi_direction", "funding_agreement", "premium_difference", "crowding_agreement", "liquidation_agreement"), fea_14_confirmation=("confirmation", "divergence", "quality"), fea_17_unavailable_suppresses=("status", "taker_difference"),
    fea_09_cross_venue=("status", "quality", "pct_spread", "spread_z", "return_agreement", "taker_agreement", "ofi_agreement", "price_oi_agreement", "crowding_agreement", "liquidation_agreement", "confirmation", "divergence"),
)


def alignment_reasons(spark: SparkSession, d: str) -> DataFrame:
    return tidy(cross(spark, d), (*PAIR, "alignment_reasons"))


QUERIES["fea_16_pair_reasons"] = alignment_reasons
ORACLES["fea_16_pair_reasons"] = _CROSS + "SELECT symbol, CAST(window_ticks AS BIGINT) AS window_ticks, tick_no, alignment AS alignment_reasons FROM fin"


def lead_lag(spark: SparkSession, d: str) -> DataFrame:
    return cross(spark, d).groupBy("lead_lag_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_contains("reason_codes", "LEAD_LAG_INSUFFICIENT").cast("long")).alias("flagged"))


QUERIES["fea_15_lead_lag"] = lead_lag
ORACLES["fea_15_lead_lag"] = _CROSS + "SELECT 'UNAVAILABLE' AS lead_lag_status, count(*) AS n, CAST(count(*) AS BIGINT) AS flagged FROM fin"


def queries() -> dict[str, Query]:
    from tickframe.plans import identities, tables

    return QUERIES | tables.QUERIES | identities.QUERIES


def oracle_sql() -> dict[str, str]:
    from tickframe.plans import identities, tables

    return ORACLES | tables.ORACLES | identities.ORACLES
