"""Time operators: decision ticks, late data, windows, as-of values, history, order.

Windows are (T - w, T] in event time; a decision at T sees events received at T or before. Windows are
whole numbers of ticks, so an event with slot es = ceil(us / tick) and visibility slot
vs = max(es, ceil(recv / tick)) belongs to the ticks from vs to es - 1 + w / tick. Events are summed by
(key, es, vs) first and only these partial rows are copied to their ticks and summed again: equi-aggregations
in place of a range join, whose cost doesn't grow with the number of events in a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.config import Config
from tickframe.functions.scalars import next_boundary

KEYS = ["exchange", "symbol"]


def ceil_div(us: Column, tick: int) -> Column:
    return F.ceil(us / F.lit(tick)).cast("long")


def with_slots(events: DataFrame, tick: int) -> DataFrame:
    # integer arithmetic: micros beyond 2**53 would lose a unit in a double
    up = lambda c: F.expr(f"({c} + {tick - 1}) div {tick}")
    return events.withColumn("es", up("us")).withColumn("vs", F.greatest(up("us"), up("recv_us")))


#: Width of the receive-time slices in which running values are computed.
SLICE = 3_600_000_000


def with_before(events: DataFrame, keys: list[str], carry: dict[str, Column], width: int | None = None, agg=F.max) -> DataFrame:
    """The events with their ``slice`` of receive time and, for each of ``carry``, its maximum (``agg``) over all earlier slices.

    A running value over a whole stream is then what was before its slice and what the slice adds, so the windows that
    follow are as many as keys times slices, and no task holds a stream. ``keys`` hold no nulls.
    """
    sliced = events.withColumn("slice", F.expr(f"recv_us div {width or SLICE}"))
    tops = sliced.groupBy(*keys, "slice").agg(*(agg(c).alias(k) for k, c in carry.items()))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    return sliced.join(tops.select(*keys, "slice", *(agg(k).over(earlier).alias(k) for k in carry)), [*keys, "slice"], "left")


def accepted(events: DataFrame, keys: list[str] = KEYS, policy: str = "drop", lateness: int = 0) -> DataFrame:
    """Events of each stream that are not late in ingest order (recv_us, ord).

    drop: an event before the running maximum of its stream is late; insert: only if by more than ``lateness``.
    """
    order = Window.partitionBy(*keys, "slice").orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, -1)
    limit = lateness if policy == "insert" else 0
    sliced = with_before(events, keys, {"before_us": F.col("us")})
    high = F.greatest("before_us", F.max("us").over(order))  # nulls are skipped
    return sliced.withColumn("high_us", high).where(F.col("high_us").isNull() | (F.col("us") >= F.col("high_us") - limit)).select(*events.columns)


def admissibility(events: DataFrame, keys: list[str], lateness: int, retention: int) -> DataFrame:
    """ACCEPTED, LATE or EXPIRED for each event under the insert policy."""
    order = Window.partitionBy(*keys).orderBy("recv_us", "ord").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("us").over(order)
    status = F.when(high.isNull() | (F.col("us") >= high), "ACCEPTED").when(F.col("us") <= high - retention, "EXPIRED").when(F.col("us") < high - lateness, "LATE").otherwise("ACCEPTED")
    return events.withColumn("status", status)


def retained(events: DataFrame, keys: list[str], retention: int, capacity: int) -> DataFrame:
    """What a bounded buffer holds at the end: us > newest - retention, the newest ``capacity`` of them."""
    every = Window.partitionBy(*keys)
    kept = events.withColumn("newest", F.max("us").over(every)).where(F.col("us") > F.col("newest") - retention).drop("newest")
    place = F.row_number().over(every.orderBy(F.col("us").desc(), F.col("ord").desc()))
    return kept.withColumn("place", place).where(F.col("place") <= capacity).drop("place")


def tick_bounds(events: DataFrame, tick: int) -> DataFrame:
    """First tick strictly after the first receive time, last tick at or after the last one (one row)."""
    b = events.agg(F.min("recv_us").alias("lo"), F.max("recv_us").alias("hi")).where("lo is not null")
    return b.select((next_boundary("lo", tick) / tick).cast("long").alias("first_tick"), F.expr(f"(hi + {tick - 1}) div {tick}").alias("last_tick"))


def spine(events: DataFrame, cfg: Config) -> DataFrame:
    """tick_no for every decision (tick_no * tick is its time)."""
    return tick_bounds(events, cfg.tick).select(F.explode(F.sequence("first_tick", F.greatest("first_tick", "last_tick"))).alias("tick_no"))


def decision_ticks(events: DataFrame, cfg: Config) -> DataFrame:
    """All decisions with their kinds, features before signals at the same time."""
    per = cfg.signal_tick // cfg.tick
    ticks = spine(events, cfg)
    both = ticks.select("tick_no", F.lit("FEATURE").alias("kind"), F.lit(0).alias("rank")).unionByName(ticks.where(F.col("tick_no") % per == 0).select("tick_no", F.lit("SIGNAL").alias("kind"), F.lit(1).alias("rank")))
    return both.select((F.col("tick_no") * cfg.tick).alias("decision_us"), "kind", "rank")


def known_spine(events: DataFrame, cfg: Config) -> DataFrame:
    """The spine as a range whose bounds (one row) are fetched now, so plans that use it often don't scan for them again."""
    b = tick_bounds(events, cfg.tick).first()
    lo, hi = (0, -1) if b is None else (b["first_tick"], max(b["first_tick"], b["last_tick"]))
    return events.sparkSession.range(lo, hi + 1).select(F.col("id").alias("tick_no"))


def grid(ticks: DataFrame, cfg: Config, keys: DataFrame) -> DataFrame:
    """Every key, window and decision, whether or not anything happened (constant rows for each tick)."""
    windows = F.explode(F.array(*(F.lit(cfg.ticks(w)) for w in cfg.windows))).alias("window_ticks")
    return ticks.crossJoin(F.broadcast(keys)).select("*", windows)


def window_aggregate(events: DataFrame, cfg: Config, windows: list[int], sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, keys: list[str] = KEYS, previous: bool = False, before: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """Sums, minima, maxima and exclusive-ors over (T - w, T], or over (T - 2w, T - w] when ``previous``, with n (rows).

    ``before``: sums over (T - 2w, T - w] found in the same pass, with n_before; n is null where only these are.
    """
    sums, mins, maxs, older, xors = sums or {}, mins or {}, maxs or {}, before or {}, xors or {}
    partial = with_slots(events, cfg.tick).groupBy(*keys, "es", "vs").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in (sums | older).items()), *(F.min(c).alias(k) for k, c in mins.items()), *(F.max(c).alias(k) for k, c in maxs.items()), *(F.bit_xor(c).alias(k) for k, c in xors.items())
    )
    frames = F.array(*(F.struct(F.lit(cfg.ticks(x)).alias("window_ticks"), F.lit(back).alias("back")) for x in windows for back in ((0, 1) if older else (int(previous),))))
    wide = partial.select("*", F.explode(frames).alias("_frame")).select("*", "_frame.*")
    low = F.greatest(F.col("vs"), F.col("es") + F.col("window_ticks") * F.col("back"))
    high = F.col("es") - 1 + F.col("window_ticks") * (F.col("back") + 1)
    ticks = wide.withColumn("_from", low).withColumn("_to", high).where("_from <= _to").withColumn("tick_no", F.explode(F.sequence("_from", "_to")))
    now = (lambda c: F.when(F.col("back") == 0, F.col(c))) if older else F.col
    then = lambda c: F.sum(F.when(F.col("back") == 1, F.col(c)))
    return ticks.groupBy(*keys, "window_ticks", "tick_no").agg(
        F.sum(now("n")).alias("n"), *(F.sum(now(k)).alias(k) for k in sums), *(F.min(now(k)).alias(k) for k in mins), *(F.max(now(k)).alias(k) for k in maxs), *(F.bit_xor(now(k)).alias(k) for k in xors), *([then("n").alias("n_before"), *(then(k).alias(k) for k in older)] if older else [])
    )


def as_of_lags(events: DataFrame, ticks: DataFrame, cfg: Config, payload: list[str], lags: list[int], keys: list[str] = KEYS) -> DataFrame:
    """For each row of ``ticks`` (keys, tick_no; each once) and lag: the latest event with us <= T - lag that T sees.

    Columns ``at_<lag>``: (us, ord, payload), null if there is none. Events enter at their slot; one running maximum
    for each key over slots and ticks in order finds the latest, so no pair of event and tick is ever formed, and all
    lags share one pass.
    """
    entry = F.explode(F.array(*(F.struct(F.lit(x).alias("lag"), F.greatest(F.col("vs"), F.col("es") + x).alias("tick_no")) for x in lags)))
    copies = with_slots(events, cfg.tick).select(*keys, F.struct("us", "ord", *payload).alias("_row"), entry.alias("_entry")).select(*keys, "_row", "_entry.*")
    entering = copies.groupBy(*keys, "tick_no").agg(*(F.max(F.when(F.col("lag") == x, F.col("_row"))).alias(f"at_{x}") for x in lags))
    asked = ticks.select(*keys, "tick_no", *(F.lit(None).cast(entering.schema[f"at_{x}"].dataType).alias(f"at_{x}") for x in lags), F.lit(1).alias("asked"))
    order = Window.partitionBy(*keys).orderBy("tick_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = entering.withColumn("asked", F.lit(0)).unionByName(asked)
    return both.select(*keys, "tick_no", "asked", *(F.max(f"at_{x}").over(order).alias(f"at_{x}") for x in lags)).where("asked = 1").drop("asked")


def as_of(events: DataFrame, ticks: DataFrame, cfg: Config, payload: list[str], keys: list[str] = KEYS, lag_ticks: int = 0) -> DataFrame:
    """``as_of_lags`` for one lag, its columns by name."""
    at = as_of_lags(events, ticks, cfg, payload, [lag_ticks], keys)
    return at.select(*keys, "tick_no", *(F.col(f"at_{lag_ticks}.{p}").alias(p) for p in ("us", *payload)))


def prior_zscores(rows: DataFrame, names: dict[str, str], lookback_ticks: int, keys: list[str]) -> DataFrame:
    """z and warm flag of each value (column: name of its z) against its prior history, all in the same two windows.

    History: non-null samples before T within (t - lookback, t], t being the time of the last of them;
    population deviation; null for fewer than 2 samples or no variance. Warm: the earliest of them is at
    T - lookback or before and z is known.
    """
    by = Window.partitionBy(*keys).orderBy("tick_no")
    back, older = by.rangeBetween(-(lookback_ticks - 1), 0), by.rowsBetween(Window.unboundedPreceding, -1)

    def stats(c: str) -> Column:
        v = F.col(c)
        return F.struct(F.count(v).over(back).alias("n"), F.avg(v).over(back).alias("m"), F.stddev_pop(v).over(back).alias("s"), F.min(v).over(back).alias("lo"), F.max(v).over(back).alias("hi"), F.min(F.when(v.isNotNull(), F.col("tick_no"))).over(back).alias("t0"))

    held = rows.select("*", *(F.when(F.col(c).isNotNull(), stats(c)).alias(f"_{c}") for c in names))
    prior = held.select(*rows.columns, *(F.last(f"_{c}", ignorenulls=True).over(older).alias(f"_{c}") for c in names))
    out = []
    for c, name in names.items():
        v, p = F.col(c), F.col(f"_{c}")
        z = F.when((p["n"] >= 2) & (p["hi"] > p["lo"]), F.try_divide(v - p["m"], p["s"]))
        out += [z.alias(name), F.coalesce(z.isNotNull() & (p["t0"] <= F.col("tick_no") - lookback_ticks), F.lit(False)).alias(f"{name}_warm")]
    return prior.select(*rows.columns, *out)


def prior_zscore(rows: DataFrame, value: str, lookback_ticks: int, keys: list[str], name: str = "z") -> DataFrame:
    """``prior_zscores`` of one value."""
    return prior_zscores(rows, {value: name}, lookback_ticks, keys)


def generation_resets(book: DataFrame, ticks: DataFrame, cfg: Config, keys: list[str] = KEYS) -> DataFrame:
    """segment and book_resets for each row of ``ticks``, from book events with their ``generation``.

    segment: decisions so far at which the book's generation was not that of the decision before (0 before the
    first event). book_resets: changes so far from event to event, in order of receipt.
    """
    by = Window.partitionBy(*keys).orderBy("recv_us", "ord")
    changed = F.when(F.col("generation") != F.lag("generation").over(by), 1).otherwise(0)
    events = book.withColumn("_changed", changed).withColumn("book_resets", F.sum("_changed").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = as_of(events.withColumn("us", F.col("recv_us")), ticks, cfg, ["generation", "book_resets"], keys)
    at = at.withColumn("generation", F.coalesce("generation", F.lit(0).cast("long"))).withColumn("book_resets", F.coalesce("book_resets", F.lit(0).cast("long")))
    then = Window.partitionBy(*keys).orderBy("tick_no")
    moved = F.when(F.col("generation") != F.lag("generation").over(then), 1).otherwise(0)
    return at.withColumn("_moved", moved).select(*keys, "tick_no", F.sum("_moved").over(then.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("segment"), "book_resets")


def latest_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``: a partial aggregation, so a common key doesn't gather."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def fresh(events: DataFrame, id_cols: list[str], ttl: int) -> DataFrame:
    """First of each id within its lifetime, which every sight of the id renews (in ingest order)."""
    last = F.lag("recv_us").over(Window.partitionBy(*id_cols).orderBy("recv_us", "ord"))
    return events.withColumn("last_us", last).where(F.col("last_us").isNull() | (F.col("recv_us") - F.col("last_us") > ttl)).drop("last_us")


def replay_order(records: DataFrame, mode: str = "RECEIVE_TIME") -> list[Column]:
    """Columns of the total replay order: metadata first, the end marker last, sequences as text."""
    at = F.coalesce("exchange_timestamp", "local_receive_timestamp") if mode == "EVENT_TIME" else F.col("local_receive_timestamp")
    rank = F.when(F.col("channel") == "instrument_metadata", 0).when(F.col("channel") == "_timeline_end", 2).otherwise(1)
    return [rank, at, F.col("local_receive_timestamp"), F.col("connection_generation"), F.col("exchange"), F.col("symbol"), F.col("channel"), F.coalesce("sequence_id", F.lit("")), F.col("record_id")]


def placed(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in a total order, numbered by no single task.

    Rows are sorted by ranges and written down; a row's place is its place in its range and the rows of the ranges before.
    """
    from tickframe.operators.audit import scratch

    path, at = scratch(df.sparkSession, "order"), "range_and_row"
    df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).write.parquet(path, compression="zstd")
    rows = df.sparkSession.read.parquet(path).withColumn("in_range", F.shiftright(at, 33))
    sizes = rows.groupBy("in_range").agg(F.count(F.lit(1)).alias("size"))  # one row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("in_range", before.alias("before"))
    number = F.col("before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return rows.join(starts, "in_range").withColumn(name, number.cast("long")).drop("in_range", "before", at)
