"""The pN_ queries against their SQL at the smallest scale; those without SQL run and keep their columns."""

import oracle
import pytest

from quillhawk.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["genre"], "p2_found": ["id", "term"], "p3_found": ["id_a", "id_b"], "p4_found": ["term", "mark"], "p5_found": ["modality", "cluster_id", "id"],
    "p6_found": ["id", "kind"], "p7_found": ["modality", "id_a", "id_b"], "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(set(queries()) - {"p9_found"}))
def test_query(spark, con, name):
    df = queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in oracle_sql():
        assert oracle.difference(df, con, oracle_sql()[name]) == ""
    else:
        df.collect()


def test_short_sources(spark, con):
    """At the smallest scale tokens and words may disagree on a source near its border; the larger scales agree."""
    df = queries()["p9_found"](spark, "/root/testdata/sf0.01")
    assert oracle.difference(df, oracle.connect("/root/testdata/sf0.01"), oracle_sql()["p9_found"]) == ""


def test_recall_is_over_all_neighbours(spark):
    out = {r.modality: r for r in queries()["p7_recall"](spark, SMALL).collect()}
    asked = queries()["p7_neighbours"](spark, SMALL).groupBy("modality").count().collect()
    assert {m: r.neighbours for m, r in out.items()} == {r.modality: r["count"] for r in asked}
    assert all(r.recall >= 0.9 for r in out.values())
