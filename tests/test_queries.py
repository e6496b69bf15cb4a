"""Every core query runs on the smallest tables; those with SQL give the SQL's rows."""

import pytest

from kgweave.plans import problems, registry

QUERIES = {**problems.queries(), **registry.queries()}
SQL = {**problems.SQL, **registry.sql()}
SLOW = {"m15_train_decoder", "m10_novel_links", "m12_sage_embeddings"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(name, spark):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0
