import random
from collections import defaultdict

import pytest

from tessera.graph import PropertyGraph, dense_ids
from tessera.operators import components as K
from tessera.operators.spanning import UnionFind, kruskal, spanning_forest, spanning_tree_edges

EDGES = "src long, dst long"
WEIGHTED = "src long, dst long, w double"


def graph(spark, edges, directed=False, nodes=None, **kwargs):
    schema = WEIGHTED if edges and len(edges[0]) == 3 else EDGES
    n = spark.createDataFrame([(x,) for x in nodes], "id long") if nodes is not None else None
    if schema == WEIGHTED:
        kwargs.setdefault("weight", "w")
    return PropertyGraph.from_edges(spark.createDataFrame(edges, schema), n, directed, **kwargs)


def test_undirected_stores_both_directions(spark, rows):
    g = graph(spark, [(0, 1), (1, 2), (2, 2), (None, 3), (3, None)])
    assert rows(g.edges) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 2)]
    assert g.is_symmetric() and not graph(spark, [(0, 1)], directed=True).is_symmetric()
    assert not PropertyGraph.from_edges(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], WEIGHTED), weight="w").is_symmetric()


def test_weights_everywhere_or_nowhere(spark):
    with pytest.raises(RuntimeError, match="missing weight"):
        graph(spark, [(0, 1, 1.0), (1, 2, None)])
    assert not graph(spark, [(0, 1, None)]).weighted
    with pytest.raises(ValueError):
        PropertyGraph.from_edges(spark.range(3))


def test_degree_strength_and_neighbours(spark, rows):
    g = graph(spark, [(0, 1, 2.0), (0, 2, 3.0)], nodes=[0, 1, 2, 9])
    assert rows(g.degree()) == [(0, 2), (1, 1), (2, 1), (9, 0)]
    assert rows(g.strength()) == [(0, 5.0), (1, 2.0), (2, 3.0), (9, 0.0)]
    assert rows(g.adjacency().where("src = 0")) == [(0, 0, 1, 2.0), (0, 1, 2, 3.0)]
    assert rows(g.neighbours_of(0)) == [(1, 2.0), (2, 3.0)]
    assert rows(g.neighbours(spark.createDataFrame([(1,), (2,)], "id long"))) == [(0,)]
    pairs = spark.createDataFrame([(0, 1), (1, 2), (7, 0), (None, 1)], EDGES)
    assert sorted(r.is_edge for r in g.is_edge(pairs).collect()) == [False, False, False, True]


def test_k_hop(spark, rows):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (5, 0)], directed=True)
    assert rows(g.k_hop(spark.createDataFrame([(0,)], "id long"), 2)) == [(0, 0), (1, 1), (2, 2), (3, 1)]
    into = g.induced_with_hops(spark.createDataFrame([(0,)], "id long"), 1)
    assert rows(into.edges) == [(5, 0)]


def test_induced_and_relabelled(spark, rows):
    g = graph(spark, [(10, 20, 1.0), (20, 30, 2.0), (30, 40, 3.0)])
    chosen = spark.createDataFrame([(40,), (20,), (30,), (20,)], "id long")
    assert rows(g.induced(chosen).edges) == [(20, 30, 2.0), (30, 20, 2.0), (30, 40, 3.0), (40, 30, 3.0)]
    again = g.induced(chosen, relabel=True)
    assert rows(again.edges, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(again.nodes, "id", "label") == [(0, 20), (1, 30), (2, 40)]
    ordered = spark.createDataFrame([(40, 0), (20, 1), (30, 2)], "id long, position int")
    assert rows(g.induced(ordered, relabel=True).nodes, "id", "label") == [(0, 40), (1, 20), (2, 30)]


def test_quotient_and_conductance(spark, rows):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    partition = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)], "node long, cluster long")
    assert rows(g.quotient(partition).edges) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert rows(g.quotient(partition, self_loops=True).edges) == [(0, 0, 6.0), (0, 1, 1.0), (1, 0, 1.0)]
    assert rows(g.quotient(partition).nodes) == [(0,), (1,), (2,)]
    one = spark.createDataFrame([(3,)], "id long")
    assert g.conductance(one) == 1.0
    assert g.conductance(one, spark.createDataFrame([(0,), (1,)], "id long")) == 0.0
    assert rows(g.cluster_conductance(partition), "cluster", "cut", "volume", "conductance") == [(0, 1, 7, 1.0), (1, 1, 1, 1.0)]


def test_samples(spark):
    g = graph(spark, [(i, i + 1) for i in range(20)])
    edges = {tuple(r) for r in g.edges.collect()}
    drawn = g.sample_edges(100).collect()
    assert len(drawn) == 100 and all((r.src, r.dst) in edges for r in drawn)
    others = g.sample_non_edges(100).collect()
    assert len(others) == 100 and not any((r.src, r.dst) in edges or r.src == r.dst for r in others)
    assert sorted(g.sample_edges(50, 3).collect()) == sorted(g.sample_edges(50, 3).collect())
    with pytest.raises(ValueError):
        graph(spark, [(0, 1), (1, 2), (0, 2)]).sample_non_edges(1)


def test_dense_ids(spark, rows):
    assert rows(dense_ids(spark.createDataFrame([(7,), (3,), (100,)], "id long"), "id")) == [(3, 0), (7, 1), (100, 2)]


def components_by_hand(edges, nodes):
    sets = UnionFind()
    for n in nodes:
        sets.find(n)
    for a, b in edges:
        sets.union(a, b)
    members = defaultdict(list)
    for n in nodes:
        members[sets.find(n)].append(n)
    ranked = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    return sorted((n, k, len(m), min(m)) for k, m in enumerate(ranked) for n in m)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, rows, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    got = rows(K.connected_components(graph(spark, edges, nodes=range(60))), "id", "component", "size", "root")
    assert got == components_by_hand(edges, range(60))


def test_components_of_special_graphs(spark, rows):
    assert rows(K.connected_components(graph(spark, [(0, 1)])), "id", "component") == [(0, 0), (1, 0)]
    path = [(i, i + 1) for i in range(200)]
    assert K.component_roots(graph(spark, path, directed=True)).where("root <> 0").count() == 0
    star = [(0, i) for i in range(1, 300)]
    assert K.component_roots(graph(spark, star, directed=True)).where("root <> 0").count() == 0
    assert rows(K.connected_components(graph(spark, [], nodes=[4, 2])), "id", "component", "size") == [(2, 0, 1), (4, 1, 1)]


def test_largest_component(spark, rows):
    g = graph(spark, [(0, 1), (1, 2), (8, 9)], nodes=[0, 1, 2, 5, 8, 9])
    assert rows(K.largest_component(g).nodes) == [(0,), (1,), (2,)]


def bfs_by_hand(edges, nodes, start):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order, seen = [], set()
    for first in [start, *sorted(nodes)]:
        queue = [first] if first not in seen else []
        seen |= set(queue)
        for n in queue:
            order.append(n)
            for m in sorted(near[n]):
                if m not in seen:
                    seen.add(m)
                    queue.append(m)
    return order


@pytest.mark.parametrize("start", [0, 13])
def test_bfs_order_equals_a_queue(spark, start):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    got = [r.id for r in K.bfs_order(graph(spark, edges, nodes=range(40)), start).orderBy("position").collect()]
    assert got == bfs_by_hand([e for e in edges if e[0] != e[1]], range(40), start)


def test_directed_bfs_order(spark):
    edges = [(2, 0), (2, 5), (0, 3), (5, 3), (3, 2), (4, 2), (1, 4)]
    got = [r.id for r in K.directed_bfs_order(graph(spark, edges, directed=True), 2).orderBy("position").collect()]
    assert got == [2, 0, 5, 3, 1, 4]


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("maximise", [False, True])
def test_spanning_forest_equals_kruskal(spark, monkeypatch, maximise, limit):
    monkeypatch.setattr("tessera.operators.spanning.KRUSKAL_EDGES", limit)
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(5))) for _ in range(70)]
    got = {(r.u, r.v) for r in spanning_forest(graph(spark, edges), maximise).collect()}
    assert got == kruskal(edges, maximise)


def test_spanning_tree_of_a_triangle_with_a_tail(spark, rows):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0)])
    assert rows(spanning_tree_edges(g), "src", "dst") == [(0, 1), (0, 2), (1, 0), (2, 0), (2, 3), (3, 2)]
