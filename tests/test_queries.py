import pytest

from concordat import queries_detail, queries_links, queries_stores  # noqa: F401
from concordat.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), SQL[name])


def test_similarity_scores_equal_difflib(spark, sf):
    from difflib import SequenceMatcher

    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    rows = QUERIES["j10_similarity_scores"](spark, sf).collect()
    assert rows
    for r in rows:
        assert abs(r.score - SequenceMatcher(None, names[r.row_id], names[r.cand_id]).ratio()) < 1e-4


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())
