import pytest

from kgweave.llm import queries as Q
from kgweave.llm import sql as S

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(S.SQL))
def test_same_as_sql(name, same):
    same(Q.queries()[name], S.SQL[name])


COLUMNS = {
    "p1_found": ["src", "group_key", "item_id"], "p2_found": ["key_a", "key_b"], "p3_found": ["src", "item_id"], "p4_found": ["request_id", "field", "pos", "term_id"],
    "p6_found": ["id", "field", "record_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind", "value"],
}


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(S.SQL)))
def test_runs(name, spark):
    df = Q.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
