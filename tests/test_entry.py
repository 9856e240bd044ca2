import __spark_entry__ as entry


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert "fea_09_cross_venue" in q


def test_entry_is_declarative(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    assert "status" in entry.entry(spark).columns
