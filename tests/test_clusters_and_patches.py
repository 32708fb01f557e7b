import random

import numpy as np
import pytest

from tessera.graph import PropertyGraph
from tessera.operators import clustering as C
from tessera.operators import patches as P
from tessera.operators import sparsify as S
from tessera.operators.spanning import UnionFind
from tessera.operators.synthetic import cluster_points


def communities(spark, sizes=(12, 12, 12), seed=1, between=0.02):
    rng = random.Random(seed)
    label = [c for c, n in enumerate(sizes) for _ in range(n)]
    edges = [(a, b, 1.0) for a in range(len(label)) for b in range(a) if rng.random() < (0.8 if label[a] == label[b] else between)]
    edges += [(0, sizes[0], 1.0), (sizes[0], sizes[0] + sizes[1], 1.0)] if len(sizes) > 2 else []
    frame = spark.createDataFrame(edges, "src long, dst long, w double").dropDuplicates(["src", "dst"])
    nodes = spark.range(len(label))
    return PropertyGraph.from_edges(frame, nodes, False, "w"), label


def by_node(partition):
    return {r.node: r.cluster for r in partition.collect()}


def agrees(found, label):
    pairs = {(label[n], c) for n, c in found.items()}
    return len({c for _, c in pairs}) == len(set(label)) == len(pairs)


def test_fennel_respects_its_cap(spark):
    g, label = communities(spark)
    found = by_node(C.fennel(g, 3, num_iters=5))
    sizes = np.bincount(list(found.values()), minlength=3)
    assert sorted(found) == list(range(36)) and sizes.max() <= int(np.ceil(1.1 * 36 / 3))


def test_fennel_starts_from_given_clusters(spark):
    g, label = communities(spark, between=0.0)
    truth = spark.createDataFrame(list(enumerate(label)), "node long, cluster long")
    assert by_node(C.fennel(g, 3, alpha=0.0, initial=truth)) == dict(enumerate(label))


def test_balanced_cut_beats_an_arbitrary_one(spark):
    g, label = communities(spark)
    found = by_node(C.balanced_cut(g, 3))
    cut = lambda part: sum(part[r.src] != part[r.dst] for r in g.edges.collect())
    assert max(np.bincount(list(found.values()))) <= 13
    assert cut(found) < 0.5 * cut({n: n % 3 for n in range(36)})


def test_spread_and_label_spread_find_communities(spark):
    g, label = communities(spark, between=0.0)
    assert len(by_node(C.spread(g, 3))) == 36
    seeds = spark.createDataFrame([(1, 0), (13, 1), (25, 2)], "node long, cluster long")
    assert len(by_node(C.label_spread(g, seeds))) == 36
    lonely = PropertyGraph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.range(4), False)
    found = by_node(C.label_spread(lonely, spark.createDataFrame([(0, 5)], "node long, cluster long")))
    assert found[0] == found[1] == 5 and found[2] != found[3] and 5 not in (found[2], found[3])
    assert len(set(by_node(C.spread(lonely, 1)).values())) == 3


def test_modularity_clusters(spark):
    g, label = communities(spark)
    partition = C.modularity_clusters(g)
    assert agrees(by_node(partition), label)
    truth = spark.createDataFrame(list(enumerate(label)), "node long, cluster long")
    assert abs(C.modularity(g, partition) - C.modularity(g, truth)) < 1e-9


def test_hierarchies(spark):
    g, label = communities(spark)
    levels = C.hierarchical_agglomerative(g, C.fennel, [2, 3])
    assert [lv.select("cluster").distinct().count() for lv in levels] == [6, 2]
    whole = by_node(C.compose_hierarchy(levels))
    assert len(whole) == 36 and len(set(whole.values())) == 2
    paths = C.hierarchical_divisive(g, C.fennel, 10).groupBy("path").count().collect()
    assert sum(r["count"] for r in paths) == 36 and max(r["count"] for r in paths) <= 10
    with pytest.raises(ValueError):
        C.hierarchical_agglomerative(g, C.fennel)


def test_merge_small_clusters(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    g = PropertyGraph.from_edges(edges, spark.range(7), False)
    partition = spark.createDataFrame([(0, 5), (1, 5), (2, 3), (3, 9), (4, 9), (5, 9), (6, 7)], "node long, cluster long")
    merged = by_node(C.merge_small_clusters(g, partition, 2))
    assert set(merged.values()) == set(range(len(set(merged.values()))))
    assert min(np.bincount(list(merged.values()))) >= 2
    assert merged[0] == merged[1] and merged[3] == merged[4] == merged[5]


def nations(spark, n=12, seed=3):
    rng = random.Random(seed)
    edges = [(a, b, float(rng.randrange(1, 6))) for a in range(n) for b in range(a) if rng.random() < 0.7]
    return PropertyGraph.from_edges(spark.createDataFrame(edges, "src long, dst long, w double"), spark.range(n), False, "w")


def connected(g):
    sets = UnionFind()
    for r in g.edges.collect():
        sets.union(r.src, r.dst)
    return sets.n_sets(r.id for r in g.nodes.collect()) == 1


def test_effective_resistance(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    g = PropertyGraph.from_edges(edges, None, False, "w")
    r = {(x.src, x.dst): x.resistance for x in S.effective_resistance(g).collect()}
    assert np.allclose([r[0, 1], r[1, 2], r[2, 0], r[2, 3]], [1 / 3, 1 / 3, 1 / 3, 1 / 2])
    b, root = S.incidence(g)
    assert b.shape == (8, 4) and np.allclose(b.sum(1), 0) and np.allclose(root, 1)


@pytest.mark.parametrize("method", [S.resistance_sparsify, S.conductance_sparsify])
def test_sampling_sparsifiers(spark, method):
    g = nations(spark)
    thin = method(g, 4)
    assert thin.num_edges == S._target_edges(g, 4) and connected(thin) and thin.is_symmetric()
    assert method(g, 1000) is g
    assert thin.edges.join(g.edges, ["src", "dst", "weight"], "left_anti").isEmpty()


def test_neighbour_sparsify_and_relaxed_tree(spark):
    g = nations(spark)
    thin = S.neighbour_sparsify(g, 2)
    assert connected(thin) and thin.is_symmetric() and thin.num_edges < g.num_edges
    tree = S.relaxed_spanning_tree(g, 0.0)
    assert connected(tree) and tree.num_edges >= 2 * 11
    assert S.relaxed_spanning_tree(g, 10.0).num_edges == g.num_edges


def test_gumbel_top_k(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0 if i else 1e9) for i in range(20)], "src long, dst long, weight double")
    drawn = S.gumbel_top_k(edges, 5)
    assert drawn.count() == 5 and drawn.where("src = 0").count() == 1
    assert S.gumbel_top_k(edges, 50).count() == 20


def test_hierarchical_sparsify_keeps_the_graph_connected(spark):
    g, label = communities(spark)
    level = spark.createDataFrame(list(enumerate(label)), "node long, cluster long")
    thin = S.hierarchical_sparsify(g, [level], 4, 2)
    assert connected(thin) and thin.num_edges < g.num_edges


def test_multi_range(spark, rows):
    df = spark.createDataFrame([(1, 3), (5, 5), (7, 8)], "start long, stop long")
    assert rows(S.multi_range(df), "value") == [(1,), (2,), (7,)]


def test_patch_data(spark):
    g, label = communities(spark)
    partition = spark.createDataFrame(list(enumerate(label)), "node long, cluster long")
    for method in ("resistance", "rmst", "sample", "neighbors", "none"):
        patches, edges = P.create_patch_data(g, partition, min_overlap=4, target_overlap=6, sparsify=method)
        members = {}
        for r in patches.collect():
            members.setdefault(r.patch_id, set()).add(r.node)
        assert all({n for n, c in enumerate(label) if c == p} <= m for p, m in members.items())
        for r in edges.collect():
            assert len(members[r.i] & members[r.j]) >= 4
    with pytest.raises(ValueError):
        P.create_patch_data(g, partition, 4, 6, sparsify="other")
    with pytest.raises(ValueError, match="Minimum overlap"):
        P.create_patch_data(g, partition, 60, 60, min_patch_size=1)


def test_patch_data_of_a_disconnected_graph(spark):
    edges = [(a, b) for s in (0, 10) for a in range(s, s + 10) for b in range(s, a)]
    g = PropertyGraph.from_edges(spark.createDataFrame(edges, "src long, dst long"), None, False)
    partition = spark.createDataFrame([(n, n // 10) for n in range(20)], "node long, cluster long")
    patches, patch_edges = P.create_patch_data(g, partition, 4, 4)
    assert patches.groupBy("node").count().where("count = 2").count() >= 4 and patch_edges.count() == 2


def test_rolling_windows(spark, rows):
    assert rows(P.rolling_window_graph(spark, 4, 2)) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]
    assert rows(P.rolling_window_graph(spark, 4, [3])) == [(0, 3), (3, 0)]
    assert P.rolling_window_graph(spark, 4, 1).count() == 0


def test_voronoi_patches(spark):
    points = cluster_points(spark, 2, 3, 60, seed=2).select("node", "coords").cache()
    patches = P.voronoi_patches(points, 2, 4, 1.3, min_overlap=4, min_size=30, min_degree=1)
    sizes = {r.patch_id: r["count"] for r in patches.groupBy("patch_id").count().collect()}
    assert patches.select("node").distinct().count() == points.count()
    assert min(sizes.values()) >= 30 and patches.count() == patches.distinct().count()


def test_patch_subgraphs(spark, rows):
    g = PropertyGraph.from_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), None, False)
    patches = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "patch_id int, node long")
    edges, nodes = P.patch_subgraphs(g, patches)
    assert rows(edges) == [(0, 0, 1), (0, 1, 0), (1, 1, 2), (1, 2, 1)] and nodes.count() == 4


def test_label_spread_reaches_the_end_of_a_long_chain(spark):
    chain = PropertyGraph.from_edges(spark.range(60).selectExpr("id AS src", "id + 1 AS dst"), spark.range(61), False)
    seed = spark.createDataFrame([(0, 7)], "node long, cluster long")
    assert by_node(C.label_spread(chain, seed)) == {n: 7 for n in range(61)}
    with pytest.raises(RuntimeError):
        C.label_spread(chain, seed, rounds=3)


def test_division_has_no_silent_depth(spark):
    g = PropertyGraph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.range(24), False)

    def peel(part, branches):
        # The smallest node leaves: as deep as there are nodes.
        first = part.nodes.agg({"id": "min"}).first()[0]
        return part.nodes.selectExpr("id AS node", f"cast(id > {first} AS long) AS cluster")

    sizes = [r["count"] for r in C.hierarchical_divisive(g, peel, 1).groupBy("path").count().collect()]
    assert sizes == [1] * 24
    with pytest.raises(RuntimeError):
        C.hierarchical_divisive(g, peel, 1, max_depth=2)


def test_modularity_arguments(spark):
    ring = [(6 * c + a, 6 * c + b) for c in range(6) for a in range(6) for b in range(a + 1, 6)] + [(6 * c, (6 * c + 7) % 36) for c in range(6)]
    graph = PropertyGraph.from_edges(spark.createDataFrame(ring, "src long, dst long"), directed=False)

    def sizes(**kwargs):
        return sorted(r.n for r in C.modularity_clusters(graph, **kwargs).groupBy("cluster").agg({"node": "count"}).toDF("cluster", "n").collect())

    start = graph.nodes.selectExpr("id as node", "id div 6 as cluster")
    assert sizes(initial=start, seed=5) == [6] * 6
    assert len(sizes(initial=start, resolution=0.1)) < 6
    with pytest.raises(RuntimeError):
        C.modularity_clusters(graph, max_levels=0)


@pytest.mark.parametrize("method", [C.fennel, C.balanced_cut, C.spread])
def test_sequential_methods_take_any_number_of_edges(spark, monkeypatch, method):
    monkeypatch.setattr(C, "MAX_SEQUENTIAL_EDGES", 10, raising=False)
    g, label = communities(spark)
    assert sorted(by_node(method(g, 3))) == list(range(36))


def test_hierarchies_in_one_task_equal_those_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_SEQUENTIAL_EDGES", 10, raising=False)
    g, _ = communities(spark)

    def by_jobs(graph, k):
        return C.fennel(graph, k)

    divided, apart = (C.hierarchical_divisive(g, method, 10) for method in (C.fennel, by_jobs))
    assert {tuple(r) for r in divided.collect()} == {tuple(r) for r in apart.collect()}
    for one, other in zip(C.hierarchical_agglomerative(g, C.fennel, [2, 3]), C.hierarchical_agglomerative(g, by_jobs, [2, 3])):
        assert by_node(one) == by_node(other)
