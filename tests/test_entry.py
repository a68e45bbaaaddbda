"""Driver contract: entry, queries and oracle keys."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 10
    assert set(df.columns) >= {"group_id", "size_each", "n_members", "reclaimable"}


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 30
