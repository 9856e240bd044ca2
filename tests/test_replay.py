import pytest

from tickframe.config import DEMO, HOUR
from tickframe.operators import audit
from tickframe.plans import replay
from tickframe.sources import raw

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """A replay of two days, run twice: the second adds nothing."""
    out = str(tmp_path_factory.mktemp("replay"))
    start = 1704499200000000
    for _ in range(2):
        replay.replay(spark, TABLES, out, start_us=start, end_us=start + 48 * HOUR)
    return out, start


def test_replay_keeps_to_its_range_and_is_idempotent(spark, tree):
    out, start = tree
    df = spark.read.parquet(f"{out}/single")
    ticks = [r["tick_no"] for r in df.select("tick_no").distinct().collect()]
    assert min(ticks) * DEMO.tick > start and max(ticks) * DEMO.tick <= start + 49 * HOUR
    assert df.count() == len(ticks) * 12 == df.select("snapshot_id").distinct().count()
    assert spark.read.parquet(f"{out}/cross").count() == len(ticks) * 6


def test_snapshot_filters(spark, tree):
    df = spark.read.parquet(f"{tree[0]}/single")
    rows = df.collect()
    first = min(r["tick_no"] for r in rows)
    cases = [
        (dict(first_tick=first + 2, last_tick=first + 3), lambda r: first + 2 <= r["tick_no"] <= first + 3),
        (dict(exchanges=frozenset(["OKX"]), windows=frozenset([1, 6])), lambda r: r["exchange"] == "OKX" and r["window_ticks"] in (1, 6)),
        (dict(symbols=frozenset(["BTC-USDT-PERP"]), healthy=True), lambda r: r["symbol"] == "BTC-USDT-PERP" and r["is_healthy"]),
        (dict(warm=False, reasons=frozenset(["NO_TRADES"])), lambda r: not r["is_warm"] and "NO_TRADES" in r["reason_codes"]),
        (dict(engine_version="other"), lambda r: False), (dict(config_hash=rows[0]["config_hash"]), lambda r: True),
    ]
    for given, wanted in cases:
        assert audit.SnapshotFilter(**given).applied(df).count() == sum(map(wanted, rows))
    with pytest.raises(ValueError):
        audit.SnapshotFilter(first_tick=2, last_tick=1)


def test_commands_and_exit_codes(tree, capsys):
    single = f"{tree[0]}/single"
    assert replay.main(["compare-features", "--left", single, "--right", single]) == 0
    assert replay.main(["compare-features", "--left", single, "--right", f"{tree[0]}/cross"]) == 1
    assert replay.main(["audit-features", "--input", single, "--symbols", "BTC-USDT-PERP", "--warm", "no", "--windows", "1,6"]) == 0
    assert replay.main(["audit-features", "--input", single, "--first-tick", "2", "--last-tick", "1"]) == 2
    assert replay.main(["audit-features", "--input", single + "-missing"]) == 2
    assert replay.main(["audit-features"]) == 2 and replay.main(["unknown"]) == 2


def test_a_capture_of_other_code_or_settings_is_refused():
    here = replay.runtime_lineage(DEMO)
    raw.check_lineage(here | {"more": "x"}, here)
    for bad in (here | {"code_sha256": "0"}, {k: v for k, v in here.items() if k != "settings_sha256"}):
        with pytest.raises(ValueError, match="sha256"):
            raw.check_lineage(bad, here)
