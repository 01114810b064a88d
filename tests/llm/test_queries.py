import pytest

from tessera import shared
from tessera.llm import queries

SMALL = "/root/testdata/sf0.001"
# The columns that the queries of true cases must have.
FOUND = {
    "p1_found": ["ord_a", "ord_b"], "p2_found": ["ord_a", "ord_b"], "p4_found": ["record_kind", "record_id", "attempt_number"], "p5_found": ["id_a", "id_b"], "p6_found": ["id", "cluster_id"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_whole(spark, name):
    out = queries.queries()[name](spark, SMALL)
    if name in FOUND:
        assert out.columns == FOUND[name]
        rows = [str(r) for r in out.collect()]
        assert rows and len(rows) == len(set(rows))
    else:
        assert out.count() > 0
    shared.clear(spark)
