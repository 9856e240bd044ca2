import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickframe.operators import audit, books
from tickframe.plans import tables
from tickframe.sources import normalize as N
from tickframe.sources import raw as R


def feature_book(**settings):
    b = books.FeatureBook(**settings)
    levels = lambda x: [(Decimal(p), Decimal(q)) for p, q in x]
    b.update = lambda us, gen, seq, prev, bids, asks: b.feed(books.Step(False, us, gen, seq, prev, levels(bids), levels(asks)))
    b.snapshot = lambda us, gen, seq, bids, asks: b.feed(books.Step(True, us, gen, seq, None, levels(bids), levels(asks)))
    return b


def test_feature_book_states():
    b = feature_book()
    assert b.update(1, 1, 101, 100, [(99, 4)], [(101, 1)]) == "BUFFERED"
    assert b.snapshot(2, 1, 100, [(99, 2), (98, 3)], [(101, 3), (102, 4)]) == "ACCEPTED"
    assert b.sequence == 101 and b.synchronized and b.ladder.sides[0][99] == 4 and b.chain.moves == (2, -2, 2, 2)
    epoch, since = b.epoch, b.since
    assert b.snapshot(3, 1, 102, [(99, 2)], [(101, 3)]) == "ACCEPTED" and (b.epoch, b.since) == (epoch, since)
    assert b.snapshot(3, 1, 102, [(99, 2)], [(101, 3)]) == "STALE_SEQUENCE"
    assert b.update(4, 1, 102, 101, [], []) == "STALE_SEQUENCE"
    assert b.update(4, 0, 200, 199, [], []) == "STALE_GENERATION"
    assert b.update(5, 1, 1000, 999, [(99, 1)], []) == "BUFFERED" and not b.synchronized
    assert b.snapshot(6, 1, 1000, [(99, 2)], [(101, 3)]) == "ACCEPTED" and b.epoch == epoch + 1
    assert b.update(7, 1, 1001, 1000, [(102, 1)], []) == "BOOK_INVALIDATED" and b.error == "crossed"
    assert b.update(8, 2, 1, 0, [], [(101, 1)]) == "BUFFERED" and b.generation == 2
    small = feature_book(most_waiting=1)
    assert [small.update(1, 0, i, i - 1, [], []) for i in (1, 2)] == ["BUFFERED", "BOOK_INVALIDATED"]
    assert small.epoch == 1 and not small.waiting


def test_feature_book_one_sided_and_gapped_snapshots():
    b = feature_book()
    b.update(1, 0, 11, 10, [], [(101, 1)])
    assert b.snapshot(2, 0, 10, [(99, 1)], []) == "BOOK_INVALIDATED"  # closed, though what waited filled the other side
    assert b.sequence == 11 and b.ladder.best() == (99, 101) and not b.synchronized
    b.update(3, 0, 15, 14, [], [])
    assert b.snapshot(4, 0, 12, [(99, 1)], [(101, 1)]) == "BOOK_INVALIDATED" and b.error == "gap among waiting updates"
    assert b.snapshot(5, 0, 13, [(101, 1)], [(101, 1)]) == "BOOK_INVALIDATED" and b.error == "crossed"
    exact = feature_book()
    exact.snapshot(1, 0, 1, [("0.1", "0.3")], [("0.2", "1")])
    exact.update(2, 0, 2, 1, [("0.1", "0.1")], [])
    assert exact.chain.moves[0] == Decimal("-0.2")  # not as binary fractions


def test_range_book():
    b = books.RangeBook()
    assert [b.update(*u, [], []) for u in ((1, 5, 0), (6, 9, 5), (10, 12, 9))] == ["BUFFERED"] * 3
    assert b.snapshot(7, [(99, 1)], [(101, 1)]) == "SNAPSHOT_APPLIED" and b.sequence == 12 and b.status == "LIVE"
    assert b.update(10, 12, 9, [], []) == "STALE"
    assert b.update(13, 14, 12, [(99, 0), (98, 2)], []) == "APPLIED" and b.bids == {98: 2}
    assert b.update(20, 21, 19, [], []) == "SEQUENCE_GAP" and b.status == "RESYNC_REQUIRED" and b.bids == {}
    assert b.snapshot(5, [(1, 1)], [(2, 1)]) == "RETRY_SNAPSHOT"
    assert b.snapshot(20, [(1, 1)], [(2, 1)]) == "SNAPSHOT_APPLIED"


def test_chain_book_and_checksum():
    bids, asks = [("99.5", "2"), ("99", "1")], [("100", "3")]
    crc = books.checksum(bids, asks)
    b = books.ChainBook()
    assert b.apply(False, 2, 1, bids, asks) == "SEQUENCE_GAP"
    assert b.apply(True, 1, -1, bids, asks, crc) == "SNAPSHOT_APPLIED"
    assert b.apply(False, 2, 1, [("99", "0")], [], books.checksum(bids[:1], asks)) == "APPLIED"
    assert b.apply(False, 3, 2, [], [("101", "1")], 12345) == "CHECKSUM_MISMATCH" and b.status == "RESYNC_REQUIRED"
    assert b.apply(True, 9, -1, bids, asks) == "SNAPSHOT_APPLIED" and b.apply(False, 11, 10, [], []) == "SEQUENCE_GAP"


def test_replayed_books_follow_the_machine(spark):
    rows = []
    for sym in ("X", "Y"):
        for k in range(60):
            snap = k % 20 == 0
            rows.append(("E", sym, k, k, k, snap, 0, k, k - 1, [(90.0, 5.0)] if snap else [(91.0 + k % 3, float(k % 4))], [(110.0, 5.0)] if snap else []))
    schema = "exchange string, symbol string, ord long, us long, recv_us long, is_snapshot boolean, generation long, sequence long, previous long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    got = {(r["symbol"], r["ord"]): r for r in books.replay_books(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    machine = feature_book()
    for r in rows[:60]:
        status = machine.snapshot(r[3], 0, r[7], r[9], r[10]) if r[5] else machine.update(r[3], 0, r[7], r[8], r[9], r[10])
        assert got["X", r[2]]["status"] == got["Y", r[2]]["status"] == status
        assert got["X", r[2]]["bid"] == machine.ladder.best()[0]


def records(spark, exchange, channel, *messages):
    rows = [(exchange, "BTC-USDT-PERP", channel, 5, bytearray(json.dumps(m).encode())) for m in messages]
    return spark.createDataFrame(rows, "exchange string, symbol string, channel string, recv_us long, raw_payload binary")


def test_venue_a_messages(spark):
    messages = [
        {"stream": "s", "data": {"e": "aggTrade", "E": 1, "a": 9, "s": "BTCUSDT", "p": "31007.25", "q": "0.004", "f": 1, "l": 1, "T": 1700000000123, "m": True}},
        {"stream": "s", "data": {"e": "depthUpdate", "E": 2, "T": 3, "s": "BTCUSDT", "U": 1, "u": 2, "pu": 0, "b": [["1.5", "0.000"]], "a": [["2.5", "1"]]}},
        {"lastUpdateId": 7, "E": 4, "T": 5, "bids": [["1", "2"], ["0.5", "1"]], "asks": [["3", "1"]]},
        {"e": "markPriceUpdate", "E": 6, "s": "BTCUSDT", "p": "10", "i": "9", "r": "0.0001", "T": 7},
        {"e": "forceOrder", "E": 8, "o": {"s": "BTCUSDT", "S": "SELL", "q": "1", "p": "9910", "ap": "0", "z": "0", "T": 9}},
        {"openInterest": "10.5", "symbol": "BTCUSDT", "time": 11},
        {"e": "aggTrade", "a": 9, "s": "BTCUSDT", "q": "1", "T": 1, "m": False},
    ]
    e = {r["event_type"]: r for r in N.venue_a(records(spark, N.VENUE_A, "x", *messages)).collect()}
    assert sorted(e) == ["BOOK_SNAPSHOT", "BOOK_UPDATE", "FUNDING", "INDEX", "LIQUIDATION", "MARK", "OPEN_INTEREST", "TRADE"]
    t = e["TRADE"]
    assert (t["side"], float(t["price"]), float(t["quantity"]), t["us"], t["symbol"]) == ("SELL", 31007.25, 0.004, 1700000000123000, "BTC-USDT-PERP")
    assert float(e["BOOK_UPDATE"]["bids"][0]["quantity"]) == 0 and e["BOOK_UPDATE"]["previous_sequence_id"] == "0"
    assert (e["LIQUIDATION"]["side"], float(e["LIQUIDATION"]["price"]), float(e["LIQUIDATION"]["quantity"])) == ("LONG", 9910, 1)
    assert float(e["FUNDING"]["rate"]) == 0.0001 and e["FUNDING"]["price"] is None


def test_rejected_messages_are_counted_and_large_prices_kept(spark):
    trade = {"e": "aggTrade", "a": 1, "s": "BTCUSDT", "p": "12345678901.5", "q": "1", "T": 1, "m": False}
    bad = [{**trade, "p": "x"}, {**trade, "s": "DOGEUSDT"}, {"e": "unheard"}, {"openInterest": "1", "symbol": "BTCUSDT"}]
    a = records(spark, N.VENUE_A, "x", trade, *bad)
    arg = {"channel": "trades", "instId": "BTC-USDT-SWAP"}
    row = {"instId": "BTC-USDT-SWAP", "tradeId": "1", "px": "98765432109.25", "sz": "1", "side": "buy", "ts": "5"}
    b = records(spark, N.VENUE_B, "x", {"arg": arg, "data": [row, {**row, "instId": "XRP-USDT-SWAP"}, {**row, "sz": None}]}, {"arg": {**arg, "channel": "books"}, "action": "update", "data": [{"asks": [], "bids": [], "ts": "5"}]})
    every = a.unionByName(b)
    events = N.normalize(every, tables.specs(spark)).collect()
    assert sorted(str(e["price"]) for e in events) == ["12345678901.5000000000", "98765432109.2500000000"]
    left = {(r["exchange"], r["kind"]): r["n"] for r in N.rejected(every, tables.specs(spark)).collect()}
    assert left == {(N.VENUE_A, "aggTrade"): 2, (N.VENUE_A, "unheard"): 1, (N.VENUE_A, "openInterest"): 1, (N.VENUE_B, "trades"): 2}


def test_sink_refuses_two_contents_in_one_batch_and_scans_prune(spark, tmp_path):
    schema = "snapshot_id string, exchange string, symbol string, tick_no long, window_ticks int, payload_sha256 string"
    with pytest.raises(Exception, match="two contents"):
        audit.append_features(spark.createDataFrame([("a", "E", "S", 1, 1, "x"), ("a", "E", "S", 1, 1, "y")], schema), str(tmp_path / "t"))
    raw = spark.createDataFrame([(f"r{i}", "EF"[i % 2], "S", "c") for i in range(8)], "record_id string, exchange string, symbol string, channel string")
    audit.write_partitioned(raw, str(tmp_path / "raw"), ["exchange", "symbol", "channel"], ["record_id"])
    one = R.read(spark, str(tmp_path / "raw"), R.ScanFilter(exchanges=frozenset("E")))
    assert one.count() == 4 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p_exchange" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_venue_b_messages(spark):
    arg = lambda c: {"channel": c, "instId": "BTC-USDT-SWAP"}
    messages = [
        {"arg": arg("trades"), "data": [{"instId": "BTC-USDT-SWAP", "tradeId": "1", "px": "100", "sz": "19.7", "side": "buy", "ts": "5", "seqId": 4}]},
        {"arg": arg("books"), "action": "snapshot", "data": [{"asks": [["2", "10", "0", "1"]], "bids": [["1", "10", "0", "1"]], "ts": "5", "checksum": 1, "seqId": 4, "prevSeqId": -1}]},
        {"arg": arg("books"), "action": "update", "data": [{"asks": [], "bids": [], "ts": "5", "seqId": 4, "prevSeqId": 4}]},
        {"arg": arg("open-interest"), "data": [{"instId": "BTC-USDT-SWAP", "oi": "1", "oiCcy": "0.12345678901234567", "oiUsd": "2", "ts": "5"}]},
        {"arg": arg("liquidation-orders"), "data": [{"instId": "BTC-USDT-SWAP", "details": [{"bkPx": "31050.5", "posSide": "short", "side": "buy", "sz": "13", "ts": "7"}]}, {"instId": "XRP-USDT-SWAP", "details": [{"bkPx": "1", "posSide": "long", "side": "sell", "sz": "1", "ts": "7"}]}]},
    ]
    e = {r["event_type"]: r for r in N.venue_b(records(spark, N.VENUE_B, "x", *messages), tables.specs(spark)).collect()}
    assert sorted(e) == ["BOOK_SNAPSHOT", "LIQUIDATION", "OPEN_INTEREST", "TRADE"]
    assert float(e["TRADE"]["quantity"]) == pytest.approx(0.197) and float(e["BOOK_SNAPSHOT"]["bids"][0]["quantity"]) == pytest.approx(0.1)
    assert (e["LIQUIDATION"]["side"], e["LIQUIDATION"]["trade_id"]) == ("SHORT", "BTC-USDT-SWAP:7:0")
    assert str(e["OPEN_INTEREST"]["quantity"]).startswith("0.12345678901234567")


def test_scan_filter_and_journal(spark):
    with pytest.raises(ValueError):
        R.ScanFilter(start_us=2, end_us=1)
    with pytest.raises(ValueError):
        R.ScanFilter(channels=frozenset("a"), excluded_channels=frozenset("a"))
    ev = spark.createDataFrame([("E", "S", 1, 2, None)], "exchange string, symbol string, us long, recv_us long, note string")
    j = R.journal_record(ev, ev.columns)
    assert R.journal_events(j, "exchange string, symbol string, us long, recv_us long, note string").collect() == ev.collect()
    assert R.resolve_source(spark.createDataFrame([("x",)], "channel string")) == "RAW"
    with pytest.raises(ValueError):
        R.resolve_source(spark.createDataFrame([(R.JOURNAL,)], "channel string"))


def test_idempotent_sink_and_compaction(spark, tmp_path):
    rows = [(f"id{i}", "E", "S", i, 1, f"h{i}") for i in range(20)]
    schema = "snapshot_id string, exchange string, symbol string, tick_no long, window_ticks int, payload_sha256 string"
    df, root = spark.createDataFrame(rows, schema), str(tmp_path / "t")
    audit.append_features(df, root)
    audit.append_features(df.unionByName(spark.createDataFrame([("new", "E", "S", 99, 1, "h")], schema)), root)
    assert spark.read.parquet(root).count() == 21
    with pytest.raises(Exception, match="other content"):
        audit.append_features(spark.createDataFrame([("id1", "E", "S", 1, 1, "changed")], schema), root)
    stored = spark.read.parquet(root)
    both = audit.compact(stored, str(tmp_path / "c"), ["symbol"], ["tick_no"], "snapshot_id", F.col("payload_sha256"), F.col("symbol"))
    assert both.select("digest_sum").distinct().count() == 1
    assert audit.differences(df, stored.select(*df.columns)).collect()[0]["kind"] == "RIGHT_ONLY"
