"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from oracle import connection, differences

from provenant.plans.queries import document_hashes
from provenant.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert differences(df, con, ORACLE_SQL[name]) is None
    else:
        assert df.columns and df.collect()


def test_flagship(spark, sf_dir):
    assert FLAGSHIP(spark, sf_dir).count() > 1


def test_greedy_equals_a_greedy_pass(spark, sf_dir):
    kept = []
    for r in sorted(document_hashes(spark, sf_dir).collect(), key=lambda r: (r.priority, r.doc_id)):
        if all(((r.h ^ other) & (1 << 64) - 1).bit_count() > 4 for _, other in kept):
            kept.append((r.doc_id, r.h))
    assert sorted(r.doc_id for r in QUERIES["greedy_near_dup"](spark, sf_dir).collect()) == sorted(k for k, _ in kept)
    assert len(kept) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_queries_read_whole_tables(spark, sf_dir):
    """Rows come from every part of a table, however its ids lie."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert QUERIES["isolation_knn"](spark, sf_dir).count() == n
    assert QUERIES["audit_query_materialisation"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    pairs = {r.mode: r.n for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type AS mode", "user_id").distinct().groupBy("mode").count().withColumnRenamed("count", "n").collect()}
    assert {r.mode: r.n_pairs for r in QUERIES["bootstrap_signflip"](spark, sf_dir).collect()} == pairs
