"""Cross-venue features: both venues' snapshots of the same symbol, window and decision side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe import market
from tickframe.config import Config
from tickframe.functions import scalars as S

PAIR = ["symbol", "window_ticks", "tick_no"]


def paired(single: DataFrame) -> DataFrame:
    """a_* and b_* columns of the two venues; a venue's equal decisions keep the largest id."""
    names = [c for c in single.columns if c not in ("exchange", *PAIR)]
    one = lambda e: F.max_by(F.when(F.col("exchange") == e, F.struct(*names)), F.when(F.col("exchange") == e, F.col("snapshot_id")))
    both = single.groupBy(*PAIR).agg(one(market.VENUE_A).alias("a"), one(market.VENUE_B).alias("b"))
    return both.select(*PAIR, *(F.col(f"{v}.{n}").alias(f"{v}_{n}") for v in "ab" for n in names))


def aligned(pair: DataFrame, cfg: Config) -> DataFrame:
    """Ages, status (strict limits: equality passes), quality and reasons."""
    t = F.col("tick_no") * cfg.tick
    age = lambda v: F.when(F.col(f"{v}_newest_us").isNotNull(), F.greatest(F.lit(0), t - F.col(f"{v}_newest_us")) / F.lit(1000.0))
    p = pair.withColumn("a_age_ms", age("a")).withColumn("b_age_ms", age("b")).withColumn("time_difference_ms", F.abs(F.col("a_newest_us") - F.col("b_newest_us")) / F.lit(1000.0))
    limit, apart = cfg.cross_max_age / 1000, cfg.cross_max_difference / 1000
    missing_a, missing_b = F.col("a_snapshot_id").isNull(), F.col("b_snapshot_id").isNull()
    old_a, old_b = F.coalesce(F.col("a_age_ms") > limit, F.lit(False)), F.coalesce(F.col("b_age_ms") > limit, F.lit(False))
    far = F.coalesce(F.col("time_difference_ms") > apart, F.lit(False))
    known = ~missing_a & ~missing_b
    bad = F.col("a_newest_us").isNull() | F.col("b_newest_us").isNull() | far | ~(F.col("a_is_warm") & F.col("b_is_warm") & F.col("a_is_healthy") & F.col("b_is_healthy"))
    status = F.when(~known | (old_a & old_b), "UNAVAILABLE").when(old_a, f"STALE_{market.VENUE_A}").when(old_b, f"STALE_{market.VENUE_B}").when(bad, "DEGRADED").otherwise("ALIGNED")
    why = S.reasons(
        (missing_a, f"MISSING_{market.VENUE_A}_SNAPSHOT"), (missing_b, f"MISSING_{market.VENUE_B}_SNAPSHOT"),
        (known & (F.col("a_newest_us").isNull() | F.col("b_newest_us").isNull()), "FEATURE_INPUT_MISSING"),
        (known & old_a, f"STALE_{market.VENUE_A}_SNAPSHOT"), (known & old_b, f"STALE_{market.VENUE_B}_SNAPSHOT"),
        (known & ~F.col("a_is_warm"), f"{market.VENUE_A}_NOT_WARM"), (known & ~F.col("b_is_warm"), f"{market.VENUE_B}_NOT_WARM"),
        (known & ~F.col("a_is_healthy"), f"{market.VENUE_A}_UNHEALTHY"), (known & ~F.col("b_is_healthy"), f"{market.VENUE_B}_UNHEALTHY"), (known & far, "TIME_ALIGNMENT"),
    )
    quality = S.alignment_quality("a_age_ms", "b_age_ms", "time_difference_ms", limit, apart)
    return p.withColumn("status", status).withColumn("quality", quality).withColumn("alignment_reasons", why).withColumn("age_difference_ms", F.abs(F.col("a_age_ms") - F.col("b_age_ms")))


def spread_zscore(p: DataFrame, cfg: Config) -> DataFrame:
    """z of the percentage spread of mids against prior decisions strictly within the lookback.

    A new generation of either venue's book (``book_resets`` of the snapshots, if given) drops the history of the symbol.
    """
    p = p.withColumn("pct_spread", S.symmetric_spread("a_mid_price", "b_mid_price"))
    by = ["symbol", "window_ticks"]
    if {"a_book_resets", "b_book_resets"} <= set(p.columns):
        upto = Window.partitionBy(*by).orderBy("tick_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        so_far = lambda v: F.coalesce(F.max(f"{v}_book_resets").over(upto), F.lit(0))
        p = p.withColumn("segment", so_far("a") + so_far("b"))
        by = [*by, "segment"]
    back = Window.partitionBy(*by).orderBy("tick_no").rangeBetween(-(cfg.ticks(cfg.lookback) - 1), -1)
    v = F.col("pct_spread")
    n, lo, hi = F.count(v).over(back), F.min(v).over(back), F.max(v).over(back)
    z = F.when((n >= cfg.cross_min_samples) & (hi > lo), F.try_divide(v - F.avg(v).over(back), F.stddev_pop(v).over(back)))
    return p.withColumn("spread_z", z).withColumn("spread_samples", F.when(v.isNull(), 0).otherwise(n))


def cross_venue(single: DataFrame, cfg: Config) -> DataFrame:
    """The cross-venue snapshot of every symbol, window and decision."""
    p = spread_zscore(aligned(paired(single), cfg), cfg)
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    diff = lambda n: a(n) - b(n)
    agree = lambda n: S.direction_agreement(a(n), b(n), cfg.epsilon)
    values = {
        "spread_difference": diff("mid_price"), "pct_spread": F.col("pct_spread"), "spread_z": F.col("spread_z"),
        "return_agreement": agree("return_value"), "impulse_agreement": agree("return_value_z"), "impulse_difference": diff("return_value_z"),
        "volatility_difference": diff("realized_volatility"), "relative_spread_difference": diff("relative_spread"),
        "taker_agreement": agree("taker_imbalance"), "taker_difference": diff("taker_imbalance"), "taker_strength": S.strength_agreement(a("taker_imbalance"), b("taker_imbalance"), cfg.tolerance),
        "ofi_agreement": agree("ofi"), "ofi_difference": diff("ofi"), "depth_imbalance_difference": diff("depth_imbalance"),
        "added_difference": diff("liquidity_added"), "removed_difference": diff("liquidity_removed"), "recovery_difference": diff("recovery_per_second"),
        "liquidity_status": S.liquidity_divergence(a("liquidity_added"), a("liquidity_removed"), b("liquidity_added"), b("liquidity_removed"), cfg.epsilon),
        "price_oi_agreement": S.context_agreement(a("price_oi_state"), b("price_oi_state")), "a_oi_direction": S.direction(a("oi_pct_change"), cfg.epsilon), "b_oi_direction": S.direction(b("oi_pct_change"), cfg.epsilon),
        "funding_agreement": agree("funding_rate"), "a_funding_abnormality": F.abs(a("funding_rate_z")), "b_funding_abnormality": F.abs(b("funding_rate_z")),
        "funding_abnormality_difference": F.abs(a("funding_rate_z")) - F.abs(b("funding_rate_z")), "premium_difference": diff("premium"),
        "crowding_agreement": S.crowding_agreement(a("crowding_state"), b("crowding_state")), "liquidation_agreement": S.liquidation_agreement(a("activity_z"), b("activity_z"), cfg.jump_z),
    }
    shown = F.col("status") != "UNAVAILABLE"  # an unavailable pair has no numbers
    p = p.select(*PAIR, "status", "quality", "a_age_ms", "b_age_ms", "age_difference_ms", "time_difference_ms", "alignment_reasons", "spread_samples", "a_mid_price", "b_mid_price", *(F.when(shown, v).alias(k) for k, v in values.items()))
    flat = ("BOTH_FLAT",)
    votes = F.array_compact(F.array(S.vote("return_agreement", flat), S.vote("impulse_agreement", flat), S.vote("taker_agreement", flat), S.vote("ofi_agreement", flat), S.vote("price_oi_agreement", ()), S.vote("crowding_agreement", ("ONE_SIDED",)), S.vote("liquidation_agreement", ("ONE_SIDED",))))
    p = p.withColumn("votes", F.when(shown, votes))
    total = F.aggregate("votes", F.lit(0.0), lambda x, y: x + y)
    negative = F.size(F.filter("votes", lambda v: v < 0))
    p = p.withColumn("confirmation", F.when(shown & (F.size("votes") > 0), S.ratio(total, F.size("votes")))).withColumn("divergence", F.when(shown & (F.size("votes") > 0), S.ratio(negative, F.size("votes"))))
    missing = lambda x, y, code: (shown & (F.col(x).isNull() | F.col(y).isNull()), code)
    more = S.reasons(missing("a_mid_price", "b_mid_price", "FEATURE_INPUT_MISSING"), (shown & F.col("spread_z").isNull() & F.col("pct_spread").isNotNull(), "INSUFFICIENT_HISTORY"), (F.lit(True), "LEAD_LAG_INSUFFICIENT"))
    return p.withColumn("reason_codes", F.array_distinct(F.concat("alignment_reasons", more))).withColumn("lead_lag_status", F.lit("UNAVAILABLE"))
