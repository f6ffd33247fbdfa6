"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p2_found", "p4_found", "fraud_detection"} <= set(q)


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
