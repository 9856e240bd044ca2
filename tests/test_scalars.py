import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from tickframe.functions import scalars as S


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def n(x):
    return F.lit(x).cast("double")


def test_directions_and_agreements(spark):
    assert [value(spark, S.direction(n(x))) for x in (1e-13, 0.1, -0.1, None)] == ["FLAT", "POSITIVE", "NEGATIVE", "UNAVAILABLE"]
    assert [value(spark, S.direction_agreement(n(a), n(b))) for a, b in ((1, 2), (-1, -2), (0, 0), (1, 0), (1, None))] == ["BOTH_POSITIVE", "BOTH_NEGATIVE", "BOTH_FLAT", "DIVERGENT", "UNAVAILABLE"]
    assert [value(spark, S.strength_agreement(n(a), n(b), 0.25)) for a, b in ((0.5, 0.2), (0.5, -0.25), (None, 1))] == ["DIVERGENT", "CONSISTENT", "UNAVAILABLE"]
    assert [value(spark, S.liquidity_divergence(n(a), n(b), n(c), n(d))) for a, b, c, d in ((12, 3, 8, 2), (1, 3, 1, 2), (1, 1, 2, 2), (1, 0, 0, 1), (None, 1, 1, 1))] == ["CONFIRMED_ADDITION", "CONFIRMED_REMOVAL", "NEUTRAL", "DIVERGENT", "UNAVAILABLE"]
    assert [value(spark, S.crowding_agreement(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("MIXED", "MIXED"), ("CROWDED_LONG", "CROWDED_LONG"), ("MIXED", "CROWDED_LONG"), ("CROWDED_SHORT", "CROWDED_LONG"), (None, "MIXED"))] == ["BOTH_MIXED", "BOTH_LONG", "ONE_SIDED", "DIVERGENT", "UNAVAILABLE"]
    assert [value(spark, S.liquidation_agreement(n(a), n(b))) for a, b in ((4, 5), (4, -4), (4, 0), (1, 1), (None, 4))] == ["BOTH_ELEVATED", "DIVERGENT", "ONE_SIDED", "BOTH_NORMAL", "UNAVAILABLE"]
    assert [value(spark, S.vote(F.lit(a), ("BOTH_FLAT", "ONE_SIDED"))) for a in ("UNAVAILABLE", "DIVERGENT", "CONFLICT", "BOTH_FLAT", "MATCHED")] == [None, -1, -1, 0, 1]


def test_states(spark):
    assert [value(spark, S.price_oi_state(n(a), n(b))) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1), (0, 1), (None, 1))] == ["PRICE_UP_OI_UP", "PRICE_UP_OI_DOWN", "PRICE_DOWN_OI_UP", "PRICE_DOWN_OI_DOWN", "FLAT", None]
    assert [value(spark, S.crowding_state(*map(n, x))) for x in ((1, 1, 1, 1), (-1, -1, -1, -1), (1, 1, 0, 1), (1, None, 1, 1))] == ["CROWDED_LONG", "CROWDED_SHORT", "MIXED", None]


def test_ratios(spark):
    assert value(spark, S.symmetric_spread(n(102), n(98))) == pytest.approx(0.04)
    assert value(spark, S.symmetric_spread(n(0), n(0))) is None and value(spark, S.ratio(n(1), n(0))) is None
    assert value(spark, S.percentage(n(1), n(0))) == 0 and value(spark, S.percentage(n(1), n(4))) == 25
    assert value(spark, S.alignment_quality(n(2000), n(0), n(0), 2000, 500)) == pytest.approx(0.5)
    assert value(spark, S.alignment_quality(n(None), n(0), n(0), 2000, 500)) == 0


def test_identity(spark):
    space = uuid.UUID(hex=S.NAMESPACE)
    for name in ("", "x", "event-17", "é"):
        assert value(spark, S.uuid5(F.lit(name))) == str(uuid.uuid5(space, name))
        c = zlib.crc32(name.encode())
        assert value(spark, S.signed_crc32(F.lit(name))) == (c if c < 1 << 31 else c - (1 << 32))


def test_digest_sum_is_exact(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    total = sum(int(r["h"], 16) for r in df.collect()) % (1 << 256)
    assert df.repartition(9).agg(*S.digest_sum("h")).select(S.carried().alias("x")).first()["x"] == f"{total:064x}"
    assert df.limit(0).agg(*S.digest_sum("h")).select(S.carried().alias("x")).first()["x"] == "0" * 64


def test_time_and_symbols(spark):
    assert [value(spark, S.next_boundary(F.lit(x), 10)) for x in (9, 10, 11)] == [10, 20, 20]
    assert [value(spark, S.canonical_symbol(F.lit(x))) for x in (" btc-usdt-perp ", "BTCUSDT")] == ["BTC-USDT-PERP", None]
    assert value(spark, S.reasons((F.lit(True), "A"), (F.lit(False), "B"), (F.lit(True), "A"), (F.lit(None).cast("boolean"), "C"))) == ["A"]
    assert [value(spark, S.health_status(F.lit(a), F.lit(b), F.lit(c), F.lit(True))) for a, b, c in ((False, True, True), (True, True, True), (True, False, True), (True, False, False))] == ["DISCONNECTED", "RESYNCING", "STALE", "DEGRADED"]
