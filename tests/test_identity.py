import datetime as dt
import hashlib
import json
from decimal import Decimal
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tickframe.operators import identity as I


def test_canonical_json_of_nested_values(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(Decimal("1.50"), b"ab", at, [{"b": 1, "a": None}], None)], "price decimal(9,2), raw binary, at timestamp, list array<map<string,int>>, none string")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = df.select(I.canonical_json(df, df.columns).alias("j")).first()["j"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        want = {"at": "2024-01-02T03:04:05.000678+00:00", "list": [{"a": None, "b": 1}], "none": None, "price": "1.50", "raw": {"bytes_sha256": hashlib.sha256(b"ab").hexdigest(), "length": 2}}
        assert got == json.dumps(want, separators=(",", ":"))


def test_identity_leaves_receipt_out(spark):
    df = spark.createDataFrame([(1, 5, 100), (1, 5, 200), (1, 6, 100)], "us long, price long, recv_us long")
    a, b, c = (r["i"] for r in df.select(I.event_identity(df).alias("i")).collect())
    assert a == b != c


def test_partition_values_are_quoted(spark):
    texts = ["BTC-USDT-PERP", "*", "a b/c", "x+y~z_1.0", "é%"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(I.partition_value(F.col("t")).alias("v")).collect()]
    assert got == [quote(t, safe="-_.") for t in texts]


def test_unknown_keys_fail(spark):
    rows = [("A", "S", "trade"), ("A", "*", "health")]
    schema = "exchange string, symbol string, kind string"
    universe = {"A": ("S",)}
    assert I.require_known(spark.createDataFrame(rows, schema), universe).count() == 2
    for bad in (("A", "*", "trade"), ("B", "S", "trade"), (None, "S", "trade"), ("A", "X", "health")):
        with pytest.raises(Exception, match="not configured"):
            I.require_known(spark.createDataFrame([*rows, bad], schema), universe).collect()


def test_payload_violations_name_the_columns(spark):
    body = '{"a":1,"b":"x"}'
    h = hashlib.sha256(body.encode()).hexdigest()
    rows = [(1, "x", body, h), (2, "x", body, h), (1, None, body, "0"), (1, "x", "{", h), (1, "x", None, None)]
    got = I.payload_violations(spark.createDataFrame(rows, "a int, b string, payload string, payload_sha256 string"), "a int, b string")
    assert sorted(map(tuple, (r["violations"] for r in got.collect()))) == [("a",), ("payload",), ("payload", "payload_sha256"), ("payload_sha256", "b")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "exchange string, symbol string, us long, recv_us long, ord long, opens boolean")
    assert I.stamp_generations(none, F.col("opens")).count() == 0
    journal = spark.createDataFrame([], "record_id string, channel string, recv_us long")
    assert I.with_end(journal).count() == 0 and I.end_violations(journal).count() == 1
