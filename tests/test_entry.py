from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def oracle(sql):
    connection = duckdb.connect()
    for path in DATA.iterdir():
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([row[k] for k in order]) for row in result.fetchall())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 500


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    "name", ["p1_found", "p3_found", "p3_report", "p5_found", "p6_found", "degree", "connected_components", "bfs_order", "spanning_tree", "aligned_embedding", "snapshot_counts"]
)
def test_query_equals_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert (columns, got) == oracle(__spark_entry__.oracle_sql()[name])


@pytest.mark.parametrize("name", ["spread_clustering_trade", "hierarchical_agglomerative_trade", "hierarchical_divisive_trade"])
def test_clusterings_cover_the_large_graph(spark, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = df.collect()
    assert got[0].n_nodes > 25
    assert (columns, [repr([r[c] for c in columns]) for r in got]) == oracle(__spark_entry__.oracle_sql()[name])


def test_models_are_trained_on_many_patches(spark):
    name = "gae_patch_embedding_trade"
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = df.collect()
    assert got[0].n_patches == 10
    assert (columns, [repr([r[c] for c in columns]) for r in got]) == oracle(__spark_entry__.oracle_sql()[name])
