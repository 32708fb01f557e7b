import numpy as np
import pytest

from tessera.llm.markov import cluster_report, flow_matrix, grid_cells, majority_labels, markov_clusters, markov_step, similarity_links, vector_clusters
from tessera.llm.vectors import node_vectors

VECTORS = "node long, vector array<double>"


def groups(seed, sizes, spread=0.3, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-60, 60, (len(sizes), dim))
    rows, truth, node = [], {}, 0
    for g, n in enumerate(sizes):
        direction = rng.normal(size=(n, dim))
        radius = rng.uniform(0, 1, (n, 1)) * (1.0 if spread is None else spread)
        for x in centres[g] + direction / np.linalg.norm(direction, axis=1, keepdims=True) * radius:
            rows.append((node, x.tolist()))
            truth[node] = g
            node += 1
    return rows, truth


def brute(rows, min_size=10):
    ids = np.array([n for n, _ in rows])
    x = np.array([v for _, v in rows])
    out = set()
    for i in range(len(x)):
        near = ids[np.sqrt(((x - x[i]) ** 2).sum(1)) <= 2.0]
        if len(near) >= min_size:
            out.add((int(near.min()), int(ids[i])))
    return out


@pytest.mark.parametrize("seed,sizes", [(1, [300, 40, 12, 10, 9, 3, 1]), (2, [150, 150, 11]), (3, [10] * 8)])
def test_groups_are_found_exactly(spark, seed, sizes):
    rows, _ = groups(seed, sizes, spread=None)
    found = {(r.cluster_node, r.node) for r in vector_clusters(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found == brute(rows)


def test_groups_of_long_vectors(spark):
    rows, _ = groups(6, [120, 30, 12, 4], spread=None, dim=64)
    found = {(r.cluster_node, r.node) for r in vector_clusters(spark.createDataFrame(rows, VECTORS), dim=64).collect()}
    assert found == brute(rows)


def test_a_column_keeps_few_entries_and_groups_stay_whole(spark):
    rows, _ = groups(7, [400, 60], spread=None)
    members, cells = grid_cells(spark.createDataFrame(rows, VECTORS), 8, 3.0)
    links = similarity_links(cells, 8, 2.0)
    assert links.count() == links.distinct().count() == links.where("a < b").count()
    flow = markov_step(flow_matrix(cells, links, 2.0, 4), 2.0, 1e-3, 4)
    assert flow.groupBy("j").count().agg({"count": "max"}).first()[0] <= 4
    labels, _ = markov_clusters(cells, links, 2.0, column_entries=2, links_decide=True)
    assert labels.select("label").distinct().count() == 2


def test_unsettled_flow_is_an_error(spark):
    cells = spark.createDataFrame([(i, 1) for i in range(12)], "cell long, mass long")
    links = spark.createDataFrame([(i, i + 1, 0.5) for i in range(11)], "a long, b long, d double")
    with pytest.raises(RuntimeError):
        markov_clusters(cells, links, 1.0, max_rounds=1)


def test_copies_are_members(spark):
    rows = [(n, [5.0] * 8) for n in range(200)] + [(n, [-9.0] * 8) for n in range(200, 205)]
    found = vector_clusters(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.cluster_node, r.size) for r in found} == {(0, 200)} and len(found) == 200


def test_no_vectors(spark):
    assert vector_clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_flow_separates_two_communities_of_a_graph(spark):
    cells = spark.createDataFrame([(i, 1) for i in range(8)], "cell long, mass long")
    edges = [(a, b) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4)]
    links = spark.createDataFrame([(a, b, 0.5 if (a, b) != (3, 4) else 1.9) for a, b in edges], "a long, b long, d double")
    labels, _ = markov_clusters(cells, links, 1.0)
    by_cell = {r.cell: r.label for r in labels.collect()}
    assert len(set(by_cell.values())) == 2 and len({by_cell[i] for i in range(4)}) == 1


def test_report_and_labels(spark):
    rows, _ = groups(5, [30, 12])
    clusters = vector_clusters(spark.createDataFrame(rows, VECTORS))
    report = cluster_report(clusters, 3).collect()
    assert {(r.cluster_node, r["size"]) for r in report} == {(0, 30), (30, 12)} and len(report) == 6
    nodes = spark.createDataFrame([(n, 4 if n % 3 else 2) for n in range(30)] + [(1, None), (None, 7)], "id long, y long")
    got = {r.cluster_node: (r.y, r.n_rows) for r in majority_labels(clusters, nodes).collect()}
    assert got == {0: (4, 20), 30: (None, None)}
    tied = spark.createDataFrame([(0, 3), (1, 2)], "id long, y long")
    assert majority_labels(clusters, tied).where("cluster_node = 0").first().y == 2


def test_usable_vectors(spark):
    nan, inf, ok = float("nan"), float("inf"), [1.0] * 8
    rows = [
        (0, 1, None), (1, 1, ok[:7]), (2, 1, [nan] + ok[1:]), (3, 1, [0.0] * 8), (4, 1, [2.0] * 8), (5, 1, ok), (4, 1, [2.0] * 8), (0, 2, [inf] + ok[1:]), (0, None, ok),
        (None, 3, ok), (1, 4, ok + [1.0]), (1, 5, [None] + ok[1:]), (None, 6, ok), (7, 6, [3.0] * 8),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "patch_id int, node long, coordinates array<double>, vector int, NODE int")
    got = {r.node: r.vector[0] for r in node_vectors(df).collect()}
    assert got == {1: 2.0, 3: 1.0, 6: 3.0}


def test_a_column_keeps_all_its_entries(spark):
    cells = spark.createDataFrame([(i, 1) for i in range(10)], "cell long, mass long")
    links = spark.createDataFrame([(a, b, 0.5) for a in range(10) for b in range(a + 1, 10)], "a long, b long, d double")
    flow = markov_step(flow_matrix(cells, links, 2.0), 2.0, 1e-3)
    assert {r["count"] for r in flow.groupBy("j").count().collect()} == {10}
