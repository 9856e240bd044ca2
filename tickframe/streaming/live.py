"""Structured Streaming: late-data policy that fails, duplicate filter with refreshed lifetime, tick features.

Event-time windows of the engine are (start, end]; Spark's are [start, end), so events are shifted by one
microsecond before ``window``. The stateful parts keep bounded state for each key.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickframe.config import Config


def hopping_trade_flow(trades: DataFrame, cfg: Config) -> DataFrame:
    """Sums of each (T - w, T] as the stream passes T by the allowed lateness: exchange, symbol, window, decision."""
    n, parts = F.col("notional"), None
    held = trades.withColumn("shifted", F.col("event_time") - F.expr("interval 1 microsecond")).withWatermark("shifted", f"{cfg.lateness} microseconds")
    for w in cfg.windows:
        win = F.window("shifted", f"{w} microseconds", f"{cfg.tick} microseconds")
        one = held.groupBy("exchange", "symbol", win.alias("win")).agg(F.sum(F.when(F.col("side") == "BUY", n).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", n).otherwise(0.0)).alias("sell"), F.count(F.lit(1)).alias("trades"))
        one = one.select("exchange", "symbol", F.lit(w // cfg.tick).alias("window_ticks"), F.col("win.end").alias("decision"), "buy", "sell", "trades")
        parts = one if parts is None else parts.unionByName(one)
    return parts


#: ``ord`` of rows that are no events: the clock moves on, or the stream is finished.
CLOCK, FINISH = -1, -2


def signal(keys: DataFrame, kind: int, at_us: int) -> DataFrame:
    """A ``CLOCK`` or ``FINISH`` row for each key (exchange, symbol), to go into the stream of ``fail_on_late``."""
    return keys.select("exchange", "symbol", F.lit(kind).cast("long").alias("ord"), F.lit(None).cast("long").alias("us"), F.lit(at_us).cast("long").alias("recv_us"))


def fail_on_late(events: DataFrame, lateness_us: int, most_held: int = 100_000, quiet_ms: int | None = None) -> DataFrame:
    """Reorder by receive time within the bound; an event at or behind the watermark fails the query.

    events: exchange, symbol, ord, us, recv_us. Rows come out in order once the watermark has passed them. The
    watermark is the latest receive time less the bound; a ``CLOCK`` row moves it as an event would, and so does the
    wall clock when a key was quiet for ``quiet_ms``. A ``FINISH`` row lets out all that is held up to the latest of
    its time and what was seen, and seals the key: an event after it fails the query, another ``FINISH`` does nothing.
    """
    schema = "exchange string, symbol string, ord long, us long, recv_us long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, sealed, held = state.get if state.exists else (-(1 << 62), False, [])
        held = [tuple(h) for h in zip(*[iter(held)] * 3, strict=True)]
        seen, through = mark + lateness_us, None
        if state.hasTimedOut:
            seen = max(seen, time.time_ns() // 1000)
        for f in frames:
            for o, u, r in zip(f["ord"], f["us"], f["recv_us"], strict=True):
                if o == FINISH:
                    through = max(int(r), through or int(r))
                    continue
                seen = max(seen, int(r))
                if o == CLOCK:
                    continue
                if r <= mark or sealed:
                    raise RuntimeError(f"event {o} is behind the watermark" if r <= mark else f"event {o} came after the end")
                held.append((int(r), int(o), int(u)))
        held.sort()
        mark = max(mark, seen - lateness_us)
        if through is not None:
            mark, sealed = max(mark, seen, through), True
        if len(held) > most_held:
            raise RuntimeError("the reorder buffer is full")
        out = [h for h in held if h[0] <= mark]
        state.update((mark, sealed, [x for h in held if h[0] > mark for x in h]))
        if quiet_ms is not None and not sealed:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"exchange": [key[0]] * len(out), "symbol": [key[1]] * len(out), "ord": [h[1] for h in out], "us": [h[2] for h in out], "recv_us": [h[0] for h in out]})

    timeout = GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("exchange", "symbol").applyInPandasWithState(step, schema, "mark long, sealed boolean, held array<long>", "append", timeout)


def drop_duplicates_refreshed(events: DataFrame, ttl_us: int, capacity: int) -> DataFrame:
    """First of each id within its lifetime; a duplicate renews the lifetime, the oldest ids beyond capacity go.

    events: exchange, symbol, event_key, recv_us.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = state.get if state.exists else ([], [])
        seen = dict(zip(ids, times, strict=True))  # in order of last sight
        out = []
        rows = pd.concat(list(frames)).sort_values(["recv_us", "event_key"])
        for k, r in zip(rows["event_key"], rows["recv_us"], strict=True):
            r = int(r)
            while seen and next(iter(seen.values())) < r - ttl_us:
                seen.pop(next(iter(seen)))
            fresh = k not in seen
            seen.pop(k, None)
            seen[k] = r
            if len(seen) > capacity:
                seen.pop(next(iter(seen)))
            if fresh:
                out.append((key[0], key[1], k, r))
        state.update((list(seen), list(seen.values())))
        yield pd.DataFrame(out, columns=["exchange", "symbol", "event_key", "recv_us"])

    schema = "exchange string, symbol string, event_key string, recv_us long"
    return events.groupBy("exchange", "symbol").applyInPandasWithState(step, schema, "ids array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, write, checkpoint: str) -> None:
    """Process all that is there through ``foreachBatch`` and stop; reruns go on where the checkpoint ends."""
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
