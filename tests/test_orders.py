"""Orders over all of their input, held against plain sorting and against their SQL."""

import datetime

import pytest

from tickframe.config import DEMO
from tickframe.operators import features
from tickframe.plans import tables

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    kinds = ["click", "view", "error", "signup", "purchase"]
    rows = [(i, START + datetime.timedelta(minutes=i // 2 * 40), i * 7 % 11, kinds[i % 5], float(i % 9), f'{{"k": {i * 3 % 20}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def oracle(path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    found = con.execute(tables.ORACLES[name])
    return sorted(map(str, (dict(zip([c[0] for c in found.description], r)) for r in found.fetchall())))


def rows_of(spark, path, name):
    return [r.asDict() for r in tables.QUERIES[name](spark, path).collect()]


@pytest.mark.parametrize("name", ["src_04_feature_scan_ordered", "srt_04_feature_order"])
def test_feature_scan_reads_every_decision(spark, events, name):
    key = lambda r: (r["tick_no"], r["symbol"], r["window_ticks"], r["exchange"])
    got = rows_of(spark, events, name)
    want = sorted(map(key, features.Inputs(spark, events, DEMO).grid.collect()))
    assert [key(r) for r in sorted(got, key=lambda r: r["place"])] == want
    assert [r["place"] for r in sorted(got, key=key)] == list(range(1, len(want) + 1))
    assert sorted(map(str, got)) == oracle(events, name)


@pytest.mark.parametrize(("name", "mode"), [("srt_01_replay_order", "receive"), ("srt_02_event_time_order", "event")])
def test_replay_order_mixes_channels(spark, events, name, mode):
    records = tables.records(spark, events).collect()
    at = lambda r: r["local_receive_timestamp"] if mode == "receive" else r["exchange_timestamp"]
    records.sort(key=lambda r: (at(r), r["local_receive_timestamp"], r["connection_generation"], r["exchange"], r["symbol"], r["channel"], r["sequence_id"], r["record_id"]))
    got = rows_of(spark, events, name)
    assert [(r["record_id"], r["channel"]) for r in sorted(got, key=lambda r: r["place"])] == [(r["record_id"], r["channel"]) for r in records]
    assert {r["channel"] for r in got} == {"books", "trades", "mark-price", "liquidation-orders"}
    assert sorted(map(str, got)) == oracle(events, name)
