"""Scalar functions as JVM-side column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- time

def epoch_millis(ms: C) -> Column:
    """UTC timestamp of epoch milliseconds given as a number or text."""
    return F.timestamp_millis(_c(ms).try_cast("long"))


def micros(ts: C) -> Column:
    """Epoch microseconds of a timestamp without time zone, read as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))


def next_boundary(us: C, interval: int) -> Column:
    """The first multiple of the interval strictly after."""
    return ((F.floor(_c(us) / F.lit(interval)) + 1) * interval).cast("long")


def latency_ms(later_us: C, earlier_us: C) -> Column:
    return (_c(later_us) - _c(earlier_us)) / F.lit(1000.0)


def clock_skew_us(sent_us: C, received_us: C, server_us: C) -> Column:
    """Midpoint of a round trip minus the server's time."""
    return (_c(sent_us) + _c(received_us)) / F.lit(2.0) - _c(server_us)


def backoff_seconds(attempt: C, initial: float = 1.0, most: float = 60.0) -> Column:
    """Exponential and capped; jitter is added by the caller."""
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(2.0), _c(attempt) - 1))


# --- parsing

def finite_decimal(text: C, scale: int = 8) -> Column:
    return _c(text).try_cast(f"decimal(38,{scale})")


SYMBOL = r"^[A-Z0-9]+-[A-Z0-9]+-PERP$"


def canonical_symbol(text: C) -> Column:
    """Trimmed and in upper case, or null if it is no BASE-QUOTE-PERP symbol."""
    s = F.upper(F.trim(_c(text)))
    return F.when(s.rlike(SYMBOL), s)


def base_quantity(contracts: C, value: C, multiplier: C) -> Column:
    return _c(contracts) * _c(value) * _c(multiplier)


# --- ratios

def ratio(a: C, b: C) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def percentage(part: C, whole: C) -> Column:
    """100 * part / whole; 0 when the whole is 0."""
    return F.coalesce(F.try_divide(_c(part) * F.lit(100.0), _c(whole).cast("double")), F.lit(0.0))


def imbalance(a: C, b: C) -> Column:
    return ratio(_c(a) - _c(b), _c(a) + _c(b))


def symmetric_spread(a: C, b: C) -> Column:
    """(a - b) over the mean of their magnitudes."""
    return ratio(_c(a) - _c(b), (F.abs(_c(a)) + F.abs(_c(b))) / F.lit(2.0))


def alignment_quality(age_a: C, age_b: C, difference: C, max_age: float, max_difference: float) -> Column:
    """1 / (1 + the largest share of a limit); 0 when anything is unknown (``greatest`` alone skips nulls)."""
    a, b, d = _c(age_a), _c(age_b), _c(difference)
    worst = F.greatest(a / F.lit(max_age), b / F.lit(max_age), d / F.lit(max_difference))
    return F.when(a.isNull() | b.isNull() | d.isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + worst))


# --- classifiers

def direction(value: C, epsilon: float = 1e-12) -> Column:
    v = _c(value)
    return F.when(v.isNull(), "UNAVAILABLE").when(v > epsilon, "POSITIVE").when(v < -epsilon, "NEGATIVE").otherwise("FLAT")


def direction_agreement(a: C, b: C, epsilon: float = 1e-12) -> Column:
    x, y = direction(a, epsilon), direction(b, epsilon)
    none = (x == "UNAVAILABLE") | (y == "UNAVAILABLE")
    return F.when(none, "UNAVAILABLE").when(x != y, "DIVERGENT").otherwise(F.concat(F.lit("BOTH_"), x))


def strength_agreement(a: C, b: C, tolerance: float) -> Column:
    return F.when(F.abs(F.abs(_c(a)) - F.abs(_c(b))) <= tolerance, "CONSISTENT").when(_c(a).isNotNull() & _c(b).isNotNull(), "DIVERGENT").otherwise("UNAVAILABLE")


def price_oi_state(ret: C, oi_change: C) -> Column:
    r, o = _c(ret), _c(oi_change)
    quadrant = F.concat(F.when(r > 0, "PRICE_UP").otherwise("PRICE_DOWN"), F.when(o > 0, "_OI_UP").otherwise("_OI_DOWN"))
    return F.when(r.isNull() | o.isNull(), F.lit(None).cast("string")).when((r == 0) | (o == 0), "FLAT").otherwise(quadrant)


def crowding_state(*values: C) -> Column:
    """All above 0, all below, or mixed; null when any is null."""
    vs = [_c(v) for v in values]
    every = lambda f: reduce(lambda a, b: a & b, map(f, vs))
    return F.when(~every(lambda v: v.isNotNull()), F.lit(None).cast("string")).when(every(lambda v: v > 0), "CROWDED_LONG").when(every(lambda v: v < 0), "CROWDED_SHORT").otherwise("MIXED")


def crowding_agreement(a: C, b: C) -> Column:
    x, y = _c(a), _c(b)
    return (
        F.when(x.isNull() | y.isNull(), "UNAVAILABLE")
        .when(x == y, F.when(x == "MIXED", "BOTH_MIXED").when(x == "CROWDED_LONG", "BOTH_LONG").otherwise("BOTH_SHORT"))
        .when((x == "MIXED") | (y == "MIXED"), "ONE_SIDED")
        .otherwise("DIVERGENT")
    )


def liquidation_agreement(za: C, zb: C, limit: float = 4.0) -> Column:
    a, b = _c(za), _c(zb)
    return (
        F.when(a.isNull() | b.isNull(), "UNAVAILABLE")
        .when((a >= limit) & (b >= limit), "BOTH_ELEVATED")
        .when(((a >= limit) & (b <= -limit)) | ((b >= limit) & (a <= -limit)), "DIVERGENT")
        .when((a >= limit) | (b >= limit), "ONE_SIDED")
        .otherwise("BOTH_NORMAL")
    )


def liquidity_divergence(added_a: C, removed_a: C, added_b: C, removed_b: C, epsilon: float = 1e-12) -> Column:
    x, y = direction(_c(added_a) - _c(removed_a), epsilon), direction(_c(added_b) - _c(removed_b), epsilon)
    none = (x == "UNAVAILABLE") | (y == "UNAVAILABLE")
    return F.when(none, "UNAVAILABLE").when(x != y, "DIVERGENT").when(x == "POSITIVE", "CONFIRMED_ADDITION").when(x == "NEGATIVE", "CONFIRMED_REMOVAL").otherwise("NEUTRAL")


def context_agreement(a: C, b: C) -> Column:
    return F.when(_c(a).isNull() | _c(b).isNull(), "UNAVAILABLE").when(_c(a) == _c(b), "MATCHED").otherwise("CONFLICT")


def vote(agreement: C, neutral: tuple[str, ...]) -> Column:
    """-1 for divergence or conflict, 0 for the neutral values, else 1; null when unavailable."""
    a = _c(agreement)
    return F.when(a == "UNAVAILABLE", F.lit(None).cast("double")).when(a.isin("DIVERGENT", "CONFLICT"), -1.0).when(a.isin(*neutral) if neutral else F.lit(False), 0.0).otherwise(1.0)


def health_status(connected: C, resyncing: C, stale: C, degraded: C) -> Column:
    return F.when(~_c(connected), "DISCONNECTED").when(_c(resyncing), "RESYNCING").when(_c(stale), "STALE").when(_c(degraded), "DEGRADED").otherwise("CONNECTED")


# --- arrays, identity

def reasons(*conditions: tuple[Column, str]) -> Column:
    """Codes of the conditions that hold, in the given order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in conditions))))


def signed_crc32(data: C) -> Column:
    c = F.crc32(_c(data).cast("binary"))
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)


def canonical_text(*columns: C) -> Column:
    """Values as text joined by unit separators, nulls as a mark of their own."""
    return F.concat_ws("\x1f", *(F.coalesce(_c(c).cast("string"), F.lit("\x00")) for c in columns))


def leaf_digest(*columns: C, domain: str = "tickframe/source/v1") -> Column:
    return F.sha2(F.concat(F.lit(domain + "\x1e"), canonical_text(*columns)), 256)


#: Namespace of the ids made here (a fixed random UUID of this project).
NAMESPACE = "5b0d6c0e8f7c4b7a9b3fd7a1c2e4f605"


def uuid5(name: C, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), _c(name).cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


LIMBS = 8


def limbs(digest_hex: C) -> list[Column]:
    """A 256-bit digest as eight 32-bit numbers, the lowest first."""
    return [F.conv(F.substring(_c(digest_hex), 64 - 8 * (i + 1) + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]


def digest_sum(digest_hex: C) -> list[Column]:
    """Aggregates whose carried value is the sum modulo 2**256; order and partitioning don't matter."""
    return [F.sum(x).alias(f"sum_{i}") for i, x in enumerate(limbs(digest_hex))]


def digest_xor(digest_hex: C) -> list[Column]:
    return [F.bit_xor(x).alias(f"xor_{i}") for i, x in enumerate(limbs(digest_hex))]


def carried(prefix: str = "sum_") -> Column:
    """Hex of the limbs after carrying; zeros for an empty input."""
    carry, out = F.lit(0).cast("decimal(38,0)"), []
    for i in range(LIMBS):
        total = F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).cast("decimal(38,0)") + carry
        low = F.pmod(total, F.lit(1 << 32).cast("decimal(38,0)"))
        carry = F.floor((total - low) / F.lit(1 << 32).cast("decimal(38,0)")).cast("decimal(38,0)")
        out.append(F.lower(F.lpad(F.hex(low.cast("long")), 8, "0")))
    return F.concat(*reversed(out))
