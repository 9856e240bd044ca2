"""Single-venue features at every decision, as joins of window aggregates and as-of values on one grid."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe import market
from tickframe.config import Config
from tickframe.functions import scalars as S
from tickframe.operators import timeline as TL
from tickframe.operators.audit import scratch
from tickframe.operators.identity import lineage_uri

KEYS = TL.KEYS
CELL = [*KEYS, "window_ticks", "tick_no"]


class Inputs:
    """Accepted events of every stream, and the decision grid.

    ``book_generations``, if set (keys, us, recv_us, ord, generation of book events): histories restart where it changes.
    """

    book_generations: DataFrame | None = None

    def __init__(self, spark, sf_dir: str, cfg: Config, start_us: int | None = None, end_us: int | None = None) -> None:
        """``start_us`` and ``end_us`` bound the receive times, inclusively."""
        self.cfg = cfg
        self.all = market.base(spark, sf_dir)
        if start_us is not None:
            self.all = self.all.where(F.col("recv_us") >= start_us)
        if end_us is not None:
            self.all = self.all.where(F.col("recv_us") <= end_us)
        self.keys = spark.createDataFrame([(e, s) for e in (market.VENUE_A, market.VENUE_B) for s in market.SYMBOLS], "exchange string, symbol string")
        self.spine = TL.known_spine(self.all, cfg)
        self.grid = TL.grid(self.spine, cfg, self.keys)

    @cached_property
    def events(self) -> DataFrame:
        """Accepted events of all streams, found in one pass and written down by type, for every operator to read."""
        rows = self.all.withColumn("family", F.expr(market.FAMILY)).where("family is not null")
        return kept(TL.accepted(rows, [*KEYS, "family"]), "event_type")

    @cached_property
    def trades(self) -> DataFrame:
        return market.trades(self.events)

    @cached_property
    def quotes(self) -> DataFrame:
        return market.quotes(self.events)

    @cached_property
    def liquidations(self) -> DataFrame:
        return market.liquidations(self.events)

    @cached_property
    def levels(self) -> DataFrame:
        return market.levels(self.events)

    @cached_property
    def prices(self) -> DataFrame:
        """Trades and marks as one stream of prices, late ones of the joint stream dropped again, with the squared log return ``r2``."""
        one = self.trades.select(*KEYS, "us", "recv_us", "ord", "price").unionByName(self.quotes.select(*KEYS, "us", "recv_us", "ord", F.col("mark").alias("price")))
        stream = TL.with_before(kept(TL.accepted(one)), KEYS, {"last": F.struct("recv_us", "ord", "price")})
        by = Window.partitionBy(*KEYS, "slice").orderBy("recv_us", "ord")
        prev = F.when(F.row_number().over(by) == 1, F.col("last.price")).otherwise(F.lag("price").over(by))
        return kept(stream.select(*KEYS, "us", "recv_us", "ord", "price", F.pow(F.ln(F.col("price") / prev), 2).alias("r2")))

    @cached_property
    def quotes_at(self) -> DataFrame:
        """The latest quote at every decision, and at each window's start."""
        return TL.as_of_lags(self.quotes, self.ticks(), self.cfg, ["oi", "funding", "mark", "index"], [0, *(self.cfg.ticks(w) for w in self.cfg.windows)])

    def ticks(self) -> DataFrame:
        """Every key and decision."""
        return self.spine.crossJoin(F.broadcast(self.keys)).select(*KEYS, "tick_no")


def kept(df: DataFrame, *folders: str) -> DataFrame:
    """The rows, written to the shared folder and read back by their schema."""
    path = scratch(df.sparkSession, "market")
    df.write.partitionBy(*folders).parquet(path, compression="zstd") if folders else df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Operators by window take the cells to add their columns to (``on``), by default the bare grid.


def trade_flow(i: Inputs, on: DataFrame | None = None) -> DataFrame:
    """Aggressive notionals, imbalance, impulses against the previous window, average and large share."""
    cfg, n = i.cfg, F.col("notional")
    sums = {"buy": F.when(F.col("side") == "BUY", n).otherwise(0.0), "sell": F.when(F.col("side") == "SELL", n).otherwise(0.0), "large": F.when(n >= cfg.large_trade, n).otherwise(0.0)}
    flow = TL.window_aggregate(i.trades, cfg, list(cfg.windows), sums, before={"prev_total": n}).withColumnsRenamed({"n": "trades", "n_before": "prev_trades"})
    on = i.grid if on is None else on
    j = on.join(flow, CELL, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = zero("buy") + zero("sell")
    count, prev = F.coalesce("trades", F.lit(0)), F.coalesce("prev_trades", F.lit(0))
    return j.select(
        *on.columns,
        zero("buy").alias("aggressive_buy_notional"),
        zero("sell").alias("aggressive_sell_notional"),
        S.imbalance(zero("buy"), zero("sell")).alias("taker_imbalance"),
        (S.ratio(total, zero("prev_total")) - 1).alias("trade_notional_impulse"),
        (S.ratio(count, prev) - 1).alias("trade_count_impulse"),
        S.ratio(total, count).alias("average_trade_notional"),
        S.ratio(zero("large"), total).alias("large_trade_share"),
        count.cast("long").alias("trades"),
    )


def price(i: Inputs, on: DataFrame | None = None) -> DataFrame:
    """Return, realized volatility (pairs within the window), count of prices."""
    cfg, on = i.cfg, i.grid if on is None else on
    point = F.struct("us", "recv_us", "ord", "price", "r2")
    w = TL.window_aggregate(i.prices, cfg, list(cfg.windows), {"squares": F.col("r2"), "returns": F.when(F.col("r2").isNotNull(), 1).otherwise(0)}, {"first": point}, {"last": point})
    own = F.coalesce(F.col("first.r2"), F.lit(0.0))
    valid = F.col("returns") - F.when(F.col("first.r2").isNotNull(), 1).otherwise(0)
    out = w.select(*CELL, (S.ratio("last.price", "first.price") - 1).alias("return_value"), F.when(valid >= 2, F.sqrt(F.greatest(F.col("squares") - own, F.lit(0.0)))).alias("realized_volatility"), F.col("n").alias("prices"))
    return on.join(out, CELL, "left").withColumn("prices", F.coalesce("prices", F.lit(0)).cast("long"))


def price_range(i: Inputs) -> DataFrame:
    """Trailing high and low over the breakout lookback, for each decision."""
    w = TL.window_aggregate(i.prices, i.cfg, [i.cfg.breakout], {}, {"trailing_low": F.col("price")}, {"trailing_high": F.col("price")})
    return i.ticks().join(w.drop("window_ticks", "n"), [*KEYS, "tick_no"], "left")


def atr(i: Inputs) -> DataFrame:
    """Mean true range of the bars of the period; null with fewer than 2 prices."""
    cfg = i.cfg
    keys = [*KEYS, "bar"]
    stream = i.prices.withColumn("bar", F.expr(f"us div {cfg.atr_bar}"))
    bars = TL.window_aggregate(stream, cfg, [cfg.atr_period], {}, {"low": F.col("price")}, {"high": F.col("price"), "close": F.struct("us", "recv_us", "ord", "price")}, keys=keys)
    by = Window.partitionBy(*KEYS, "tick_no").orderBy("bar")
    prev = F.lag("close.price").over(by)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    per = bars.withColumn("range", reach).groupBy(*KEYS, "tick_no").agg(F.avg("range").alias("mean"), F.sum("n").alias("points"))
    out = per.select(*KEYS, "tick_no", F.when(F.col("points") >= 2, F.col("mean")).alias("atr"))
    return i.ticks().join(out, [*KEYS, "tick_no"], "left")


def move_in_atr(i: Inputs) -> DataFrame:
    """(last - first) of the window over the period's ATR."""
    point = F.struct("us", "recv_us", "ord", "price")
    w = TL.window_aggregate(i.prices, i.cfg, list(i.cfg.windows), {}, {"first": point}, {"last": point})
    moved = w.select(*CELL, (F.col("last.price") - F.col("first.price")).alias("move"))
    return i.grid.join(moved, CELL, "left").join(atr(i), [*KEYS, "tick_no"]).select(*CELL, S.ratio("move", "atr").alias("recent_move_atr"))


def open_interest(i: Inputs, on: DataFrame | None = None) -> DataFrame:
    """Latest open interest, its change since T - w and its age; funding rate and mark / index - 1 too."""
    cfg, on = i.cfg, i.grid if on is None else on
    lag = F.col("window_ticks")
    anchor = F.coalesce(*(F.when(lag == cfg.ticks(w), F.col(f"at_{cfg.ticks(w)}.oi")) for w in cfg.windows))
    j = on.join(i.quotes_at.withColumnRenamed("at_0", "q"), [*KEYS, "tick_no"], "left").withColumn("anchor", anchor)
    oi, age = F.col("q.oi"), F.greatest(F.lit(0), F.col("tick_no") * cfg.tick - F.col("q.us")) / F.lit(1000.0)
    return j.select(
        *on.columns, oi.alias("oi"), F.col("q.us").alias("oi_us"), (oi - F.col("anchor")).alias("oi_change"), F.when(oi.isNotNull(), S.ratio(oi, "anchor") - 1).alias("oi_pct_change"), age.alias("oi_age_ms"),
        F.col("q.us").alias("quote_us"), F.col("q.funding").alias("funding_rate"), (S.ratio("q.mark", "q.index") - 1).alias("premium"),
    )


def premium(i: Inputs) -> DataFrame:
    """Funding rate and mark / index - 1 as of each decision."""
    q = TL.as_of(i.quotes, i.ticks(), i.cfg, ["funding", "mark", "index"])
    return q.select(*KEYS, "tick_no", F.col("us").alias("quote_us"), F.col("funding").alias("funding_rate"), (S.ratio("mark", "index") - 1).alias("premium"))


def liquidation(i: Inputs, on: DataFrame | None = None) -> DataFrame:
    n, on = F.col("notional"), i.grid if on is None else on
    w = TL.window_aggregate(i.liquidations, i.cfg, list(i.cfg.windows), {"l": F.when(F.col("position") == "LONG", n).otherwise(0.0), "s": F.when(F.col("position") == "SHORT", n).otherwise(0.0)})
    long, short = F.coalesce("l", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return on.join(w, CELL, "left").select(*on.columns, long.alias("long_notional"), short.alias("short_notional"), (long + short).alias("activity"), F.coalesce("n", F.lit(0)).cast("long").alias("liquidations"))


def level_changes(i: Inputs) -> DataFrame:
    """Change of each level's quantity against what it was (0 if absent), in ingest order."""
    by = Window.partitionBy(*KEYS, "side", "price").orderBy("recv_us", "ord")
    delta = F.col("qty") - F.coalesce(F.lag("qty").over(by), F.lit(0.0))
    return i.levels.withColumn("delta", delta)


def book_view(i: Inputs) -> DataFrame:
    """Top levels of both sides as of each decision: arrays of (price, qty), best first."""
    cfg = i.cfg
    places = i.levels.select(*KEYS, "side", "price").distinct()
    wanted = i.ticks().join(places, KEYS)
    now = TL.as_of(i.levels, wanted, cfg, ["qty"], keys=[*KEYS, "side", "price"]).where("qty > 0")
    side = lambda s, sign: F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct((F.col("price") * sign).alias("rank"), "price", "qty")))), 1, cfg.depth)
    return now.groupBy(*KEYS, "tick_no").agg(side("BID", -1).alias("bids"), side("ASK", 1).alias("asks"), F.max("us").alias("book_us"))


def walk_bps(levels: str, mid: F.Column, notional: float, sell: bool) -> F.Column:
    """Slippage of taking a notional from the levels, in basis points of mid; null if they don't hold it."""
    zero = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))

    def take(acc, x):
        cash = F.least(acc["left"], x["price"] * x["qty"])
        return F.struct((acc["left"] - cash).alias("left"), (acc["qty"] + cash / x["price"]).alias("qty"))

    done = F.aggregate(F.col(levels), zero, take)
    move = S.ratio(F.lit(float(notional)), done["qty"]) / mid - 1
    return F.when(done["left"] <= 1e-9, (-move if sell else move) * 10_000)


def book(i: Inputs) -> DataFrame:
    """Depths, spread, microprice, slippages (as of T) for each decision; null without both sides."""
    cfg = i.cfg
    v = book_view(i).where((F.size("bids") > 0) & (F.size("asks") > 0))
    weights = F.array(*(F.lit(x) for x in cfg.depth_weights))
    depth = lambda c: F.aggregate(F.zip_with(F.col(c), F.slice(weights, 1, F.size(c)), lambda l, w: l["qty"] * w), F.lit(0.0), lambda a, x: a + x)
    bid, ask = F.col("bids")[0], F.col("asks")[0]
    mid = (bid["price"] + ask["price"]) / 2
    out = v.select(
        *KEYS, "tick_no",
        depth("bids").alias("weighted_bid_depth"), depth("asks").alias("weighted_ask_depth"),
        (ask["price"] - bid["price"]).alias("spread"), mid.alias("mid_price"), ((ask["price"] - bid["price"]) / mid).alias("relative_spread"),
        S.ratio(ask["price"] * bid["qty"] + bid["price"] * ask["qty"], bid["qty"] + ask["qty"]).alias("microprice"),
        walk_bps("asks", mid, cfg.walk_notional, False).alias("buy_slippage_bps"), walk_bps("bids", mid, cfg.walk_notional, True).alias("sell_slippage_bps"), "book_us",
    )
    out = out.withColumn("depth_imbalance", S.imbalance("weighted_bid_depth", "weighted_ask_depth"))
    return i.ticks().join(out, [*KEYS, "tick_no"], "left")


def book_flow(i: Inputs, on: DataFrame | None = None) -> DataFrame:
    """Order-flow imbalance, liquidity changes, and recovery after the first removal of the window."""
    cfg, d = i.cfg, F.col("delta")
    changes = level_changes(i)
    bid = F.col("side") == "BID"
    sums = {"bid_change": F.when(bid, d).otherwise(0.0), "ask_change": F.when(~bid, d).otherwise(0.0), "added": F.greatest(d, F.lit(0.0)), "removed": F.greatest(-d, F.lit(0.0))}
    w = TL.window_aggregate(changes, cfg, list(cfg.windows), sums, {"t0": F.when(d < 0, F.col("us"))})
    # additions after the first removal: the window's partial sums by event time, again
    per = TL.with_slots(changes, cfg.tick).groupBy(*KEYS, "es", "vs", "us").agg(F.sum(F.greatest(d, F.lit(0.0))).alias("added"))
    wide = per.select("*", F.explode(F.array(*(F.lit(cfg.ticks(x)) for x in cfg.windows))).alias("window_ticks")).where("vs <= es - 1 + window_ticks")
    at = wide.withColumn("tick_no", F.explode(F.sequence("vs", F.col("es") - 1 + F.col("window_ticks")))).select(*CELL, "us", "added")
    after = at.join(w.select(*CELL, "t0"), CELL).where("us > t0").groupBy(*CELL).agg(F.sum("added").alias("after"))
    on = i.grid if on is None else on
    j = on.join(w, CELL, "left").join(after, CELL, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    seconds = (F.col("tick_no") * cfg.tick - F.col("t0")) / F.lit(1e6)
    return j.select(
        *on.columns, (zero("bid_change") - zero("ask_change")).alias("ofi"), zero("bid_change").alias("bid_liquidity_change"), zero("ask_change").alias("ask_liquidity_change"),
        zero("added").alias("liquidity_added"), zero("removed").alias("liquidity_removed"), F.when(F.col("t0").isNotNull(), S.ratio(zero("after"), seconds)).alias("recovery_per_second"),
    )


Z_METRICS = ("taker_imbalance", "ofi", "return_value", "oi_change", "premium", "funding_rate", "activity")


def metrics(i: Inputs) -> DataFrame:
    """All raw metrics of the grid in one wide table."""
    wide = None
    for group in (trade_flow, price, book_flow, liquidation, open_interest):
        wide = group(i, wide)
    return with_segments(i, wide.join(book(i), [*KEYS, "tick_no"], "left"))


def with_segments(i: Inputs, wide: DataFrame) -> DataFrame:
    """segment and book_resets of every decision, where the book's generations are given."""
    if i.book_generations is None:
        return wide
    return wide.join(TL.generation_resets(i.book_generations, i.grid.select(*KEYS, "tick_no").distinct(), i.cfg), [*KEYS, "tick_no"], "left")


def history_keys(wide: DataFrame) -> list[str]:
    """What the histories of the metrics are kept by: a new generation of the book drops them."""
    return [*KEYS, "window_ticks", *(["segment"] if "segment" in wide.columns else [])]


def with_zscores(wide: DataFrame, cfg: Config) -> DataFrame:
    """z-scores and warm flags of all metrics: the windows share one partitioning and one sort."""
    return TL.prior_zscores(wide, {m: f"{m}_z" for m in Z_METRICS}, cfg.ticks(cfg.lookback), history_keys(wide))


def single_venue(i: Inputs) -> DataFrame:
    """The feature snapshot of every venue, symbol, window and decision."""
    cfg = i.cfg
    wide = with_zscores(metrics(i), cfg)
    first_book = i.levels.groupBy(*KEYS).agg(F.min(F.expr(f"(greatest(us, recv_us) + {cfg.tick - 1}) div {cfg.tick}")).alias("book_tick"))
    wide = wide.join(F.broadcast(first_book), KEYS, "left")
    decision = F.col("tick_no") * cfg.tick
    warmup = F.coalesce(F.col("book_tick") > F.col("tick_no") - cfg.ticks(max(cfg.windows)), F.lit(True))
    last_trade = TL.as_of(i.trades, i.ticks(), cfg, ["price"]).select(*KEYS, "tick_no", F.col("us").alias("trade_us"))
    wide = wide.join(last_trade, [*KEYS, "tick_no"], "left")
    stale = decision - F.col("oi_us") > cfg.oi_stale_after
    cold = ~(F.col("taker_imbalance_z_warm") & F.col("ofi_z_warm") & F.col("return_value_z_warm") & F.col("oi_change_z_warm") & F.col("premium_z_warm") & F.col("activity_z_warm"))
    no_trades = (F.col("trades") == 0) | F.col("trade_us").isNull()
    available_warm = F.col("trade_us").isNotNull() & ~warmup & F.col("oi").isNotNull()
    newest = F.greatest("trade_us", "oi_us", "book_us", "quote_us")
    out = wide.select(
        "*",
        S.price_oi_state("return_value", "oi_change").alias("price_oi_state"),
        S.crowding_state("taker_imbalance", "return_value", "oi_change", "funding_rate").alias("crowding_state"),
        F.when(F.abs("return_value_z").isNotNull(), F.abs("return_value_z") >= cfg.jump_z).alias("abnormal_jump"),
        F.when((F.col("liquidations") > 0) & F.col("oi_change").isNotNull(), F.col("oi_change") < 0).alias("activity_with_oi_decline"),
        newest.alias("newest_us"),
        (F.greatest(F.lit(0), decision - newest) / F.lit(1000.0)).alias("data_age_ms"),
        F.coalesce(available_warm & ~cold & (F.col("trades") > 0), F.lit(False)).alias("is_warm"),
        F.coalesce(F.col("mid_price").isNotNull() & ~stale, F.col("mid_price").isNotNull()).alias("is_healthy"),
        S.reasons((F.col("trade_us").isNull(), "NO_TRADES"), (F.col("mid_price").isNull(), "BOOK_UNSYNCHRONIZED"), (warmup, "BOOK_GENERATION_WARMUP"), (F.col("oi").isNull(), "OPEN_INTEREST_MISSING"), (stale, "OPEN_INTEREST_STALE"), (no_trades, "NO_TRADES"), (cold, "NOT_WARM")).alias("reason_codes"),
    )
    ident = S.canonical_text("exchange", "symbol", "window_ticks", "tick_no", F.round("taker_imbalance", 9), F.round("return_value", 9), F.round("mid_price", 9), "newest_us")
    return out.withColumn("snapshot_id", S.uuid5(ident))


def sources(i: Inputs) -> DataFrame:
    """Every accepted source event with its leaf digest (receive and event time bound in, processing time not)."""
    leaf = lambda df, name, *cols: df.select(*KEYS, F.lit(name).alias("stream"), "us", "recv_us", "ord", S.leaf_digest(F.lit(name), *KEYS, "us", "recv_us", "ord").alias("digest"))
    return leaf(i.trades, "trade").unionByName(leaf(i.quotes, "quote")).unionByName(leaf(i.liquidations, "liquidation")).unionByName(leaf(i.levels, "book"))


def lineage(i: Inputs) -> DataFrame:
    """Count, oldest, newest and order-independent digests of the sources of every snapshot's window."""
    cfg = i.cfg
    s = sources(i)
    for k, x in enumerate(S.limbs("digest")):
        s = s.withColumn(f"limb_{k}", x)
    w = TL.window_aggregate(s, cfg, list(cfg.windows), {f"sum_{k}": F.col(f"limb_{k}") for k in range(S.LIMBS)}, {"oldest_us": F.col("us")}, {"newest_us": F.col("us")}, xors={f"xor_{k}": F.col(f"limb_{k}") for k in range(S.LIMBS)})
    xor = F.concat(*(F.lower(F.lpad(F.hex(F.coalesce(f"xor_{k}", F.lit(0).cast("long"))), 8, "0")) for k in reversed(range(S.LIMBS))))
    out = i.grid.join(w, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).cast("long").alias("source_event_count"), "oldest_us", "newest_us", S.carried().alias("digest_sum"), xor.alias("digest_xor"))
    return out.withColumn("sources", lineage_uri(F.col("source_event_count"), F.col("digest_sum"), F.col("digest_xor"), F.col("oldest_us"), F.col("newest_us")))
