"""Driver contract: entry() runs on sf0.001, every query key has a callable."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) >= {"label", "token", "n", "rank"}


def test_registry_shapes():
    qs, os_ = entry.queries(), entry.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 80
