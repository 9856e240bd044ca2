import pytest
from pyspark.sql import functions as F

from tickframe.config import Config
from tickframe.operators import timeline as TL
from tickframe.streaming import live

CFG = Config(tick=1_000_000, windows=(1_000_000, 3_000_000), lookback=5_000_000, breakout=2_000_000, atr_period=2_000_000, lateness=250_000)


def stream(spark, tmp_path, rows, schema, files=2):
    df = spark.createDataFrame(rows, schema)
    for k in range(files):
        df.where(F.pmod("ord", F.lit(files)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_hopping_windows_equal_batch(spark, tmp_path):
    rows = [("A", "S", i, i * 370_000, i * 370_000, "BUY" if i % 3 else "SELL", float(i)) for i in range(60)] + [("A", "S", 60, 10_000_000, 10_000_000, "BUY", 2.0)]
    schema = "exchange string, symbol string, ord long, us long, recv_us long, side string, notional double"
    batch = TL.window_aggregate(spark.createDataFrame(rows, schema), CFG, list(CFG.windows), {"buy": F.when(F.col("side") == "BUY", F.col("notional")).otherwise(0.0)})
    want = {(r["window_ticks"], r["tick_no"]): r["buy"] for r in batch.collect()}
    s = stream(spark, tmp_path, rows, schema).withColumn("event_time", F.timestamp_micros("us"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    finish(live.hopping_trade_flow(s, CFG), "hops")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r["window_ticks"], r["t"]): r["buy"] for r in spark.sql("select *, unix_micros(decision) div 1000000 as t from hops").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) > 0.6 * len(want)  # the rest waits for the watermark


def test_late_event_fails_the_query(spark, tmp_path):
    schema = "exchange string, symbol string, ord long, us long, recv_us long"
    spark.createDataFrame([("A", "S", 0, 1, 1_000_000), ("A", "S", 1, 1, 900_000)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = live.fail_on_late(s, 250_000).writeStream.format("memory").queryName("late").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("A", "S", 2, 1, 2_000_000)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert [r["ord"] for r in spark.sql("select ord from late").collect()] == [1, 0]
        spark.createDataFrame([("A", "S", 3, 1, 1_000_000)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with pytest.raises(Exception, match="behind the watermark"):
            q.processAllAvailable()
    finally:
        q.stop()


def test_duplicates_refresh_their_lifetime(spark, tmp_path):
    schema = "exchange string, symbol string, ord long, event_key string, recv_us long"
    rows = [("A", "S", i, k, t) for i, (k, t) in enumerate([("x", 0), ("y", 1), ("x", 90), ("x", 180), ("y", 200), ("x", 300)])]
    s = stream(spark, tmp_path, rows, schema, 1)
    finish(live.drop_duplicates_refreshed(s, 100, 10), "once")
    assert [(r["event_key"], r["recv_us"]) for r in spark.sql("select * from once order by recv_us").collect()] == [("x", 0), ("y", 1), ("y", 200), ("x", 300)]


def test_foreach_batch_appends_once(spark, tmp_path):
    schema = "exchange string, symbol string, ord long, us long, recv_us long"
    s = stream(spark, tmp_path, [("A", "S", i, i, i) for i in range(10)], schema)
    out = str(tmp_path / "out")
    for _ in range(2):
        live.run_available(s, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 10


LATE = "exchange string, symbol string, ord long, us long, recv_us long"


def reorder(spark, tmp_path, name, **how):
    spark.createDataFrame([("A", "S", 0, 1, 1_000_000), ("A", "S", 1, 1, 900_000)], LATE).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(LATE).parquet(str(tmp_path / "in"))
    q = live.fail_on_late(s, 250_000, **how).writeStream.format("memory").queryName(name).start()
    add = lambda df: (df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in")), q.processAllAvailable())
    out = lambda: [r["ord"] for r in spark.sql(f"select ord from {name}").collect()]
    if "quiet_ms" not in how:  # else there is always another batch
        q.processAllAvailable()
    return q, add, out


def test_clock_and_finish_let_held_rows_out(spark, tmp_path):
    q, add, out = reorder(spark, tmp_path, "ends")
    keys = spark.createDataFrame([("A", "S"), ("B", "S")], "exchange string, symbol string")
    try:
        assert out() == []
        add(live.signal(keys, live.CLOCK, 1_200_000))
        assert out() == [1]
        add(live.signal(keys, live.FINISH, 0))
        assert out() == [1, 0]
        add(live.signal(keys, live.FINISH, 5_000_000))  # nothing is left
        assert out() == [1, 0]
        with pytest.raises(Exception, match="behind the watermark|after the end"):
            add(spark.createDataFrame([("A", "S", 7, 1, 9_000_000)], LATE))
    finally:
        q.stop()


def test_a_quiet_key_moves_with_the_wall_clock(spark, tmp_path):
    import time

    q, add, out = reorder(spark, tmp_path, "quiet", quiet_ms=200)
    try:
        for _ in range(100):
            time.sleep(0.2)
            if out() == [1, 0]:
                break
        assert out() == [1, 0]
    finally:
        q.stop()


def test_a_full_reorder_buffer_fails(spark, tmp_path):
    with pytest.raises(Exception, match="buffer is full"):
        q, _, _ = reorder(spark, tmp_path, "full", most_held=1)
