from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions.vectors import register_sql_functions
from tessera.graph import PropertyGraph
from tessera.operators.embedding import AutoEncoder, EarlyStopping, GraphModel, SpectralEmbedding, bipartite_svd, embed_graph, orthonormal_completion, patch_embeddings, rate_search, singular_triplets
from tessera.operators.in_task import RowSums, SparseRows, in_one_task
from tessera.operators.metrics import reconstruction_auc
from tessera.operators.synthetic import cluster_points, random_frames
from tessera.plans import alignment
from tessera.sources import convert, files
from tessera.sources.datasets import Dataset, get_dataset, list_available_datasets, register_dataset
from tessera.streaming.snapshots import edge_stream, run_once, windowed_counts


def two_rings(n=8):
    edges = [(s + i, s + (i + k) % n) for s in (0, n) for i in range(n) for k in (1, 2)] + [(0, n)]
    both = edges + [(b, a) for a, b in edges]
    return np.array([a for a, _ in both]), np.array([b for _, b in both]), 2 * n


@pytest.mark.parametrize("model", ["GAE", "VGAE"])
@pytest.mark.parametrize("distance", [False, True])
def test_gradients(model, distance):
    src, dst, n = two_rings()
    m = GraphModel(AutoEncoder(model=model, dim=3, hidden=5, distance=distance, seed=3), n, src, dst, None)
    m.p["b1"] = m.p["b1"] + 0.1
    rng = np.random.default_rng(1)
    negative, noise = m.negatives(rng), rng.normal(size=(n, 3)) if model == "VGAE" else None
    _, grads = m.loss(negative, noise)
    for name, g in grads.items():
        at = tuple(rng.integers(0, k) for k in g.shape)
        keep = m.p[name][at]
        values = []
        for step in (1e-6, -1e-6):
            m.p[name][at] = keep + step
            values.append(m.loss(negative, noise)[0])
        m.p[name][at] = keep
        assert abs((values[0] - values[1]) / 2e-6 - g[at]) < 1e-4 * max(1.0, abs(g[at])), name


def test_patch_models_learn(spark):
    src, dst, n = two_rings()
    rows = [(p, int(a), int(b)) for p in (0, 1) for a, b in zip(src, dst)]
    edges = spark.createDataFrame(rows, "patch_id int, src long, dst long")
    nodes = spark.createDataFrame([(p, i) for p in (0, 1, 2) for i in range(n)], "patch_id int, id long")
    out = patch_embeddings(edges, nodes, AutoEncoder(model="GAE", dim=4, epochs=150, rate=0.02, patience=200)).collect()
    assert len(out) == 3 * n
    assert all(r.loss_last < r.loss_first for r in out if r.patch_id < 2)
    assert all(r.loss_last is None for r in out if r.patch_id == 2)
    with pytest.raises(ValueError, match="Invalid model"):
        AutoEncoder(model="other")
    best, table = rate_search(edges, nodes.where("patch_id < 2"), [1e-5, 2e-2], 1, AutoEncoder(model="GAE", epochs=40))
    assert best == 2e-2 and len(table) == 2


def test_reconstruction_auc(spark):
    src, dst, n = two_rings()
    g = PropertyGraph.from_edges(spark.createDataFrame(list(zip(src.tolist(), dst.tolist())), "src long, dst long"))
    z = embed_graph(g, AutoEncoder(model="GAE", dim=4, epochs=150, rate=0.02, patience=200)).select("node", "coords").cache()
    assert reconstruction_auc(z, g) > 0.7


def test_early_stopping_restores_the_best():
    stop, state = EarlyStopping(1), {"w": np.array([0.0])}
    for t, loss in enumerate([3.0, 1.0, 2.0, 2.5]):
        state["w"][0] = t
        ended = stop(loss, state)
    assert ended and stop.state["w"][0] == 1


def test_bipartite_svd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    for shape in ((9, 6), (5, 8)):
        a = rng.random(shape) * (rng.random(shape) < 0.8) + 0.01
        rows = [(i, 100 + j, float(a[i, j])) for i in range(shape[0]) for j in range(shape[1])] + [(50, 200, 0.0)]
        left, right, values = bipartite_svd(spark.createDataFrame(rows, "row long, col long, value double"), 3)
        d1, d2 = a.sum(1), a.sum(0)
        u, s, vt = np.linalg.svd(a / np.sqrt(np.outer(d1, d2)))
        assert np.allclose(values, s[1:4][::-1])
        x = np.array([r.coords for r in left.orderBy("node").collect()]) * np.sqrt(d1)[:, None]
        y = np.array([r.coords for r in right.orderBy("node").collect()]) * np.sqrt(d2)[:, None]
        assert np.allclose(x.T @ x, np.eye(3), atol=1e-8) and np.allclose(y.T @ y, np.eye(3), atol=1e-8)
        assert np.allclose((x * values) @ y.T, (u[:, 1:4] * s[1:4]) @ vt[1:4])
    with pytest.raises(ValueError):
        bipartite_svd(spark.createDataFrame(rows, "row long, col long, value double"), 9)
    model = SpectralEmbedding(2).fit(spark.createDataFrame(rows, "row long, col long, value double"))
    assert model.transform(spark.createDataFrame([(0,), (77,)], "node long")).where("coords is null").count() == 1


def test_orthonormal_completion():
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 2)))[0]
    full = orthonormal_completion(q, 5)
    assert np.allclose(full.T @ full, np.eye(5)) and np.allclose(full[:, :2], q)


def test_raw_snapshots_to_dataset(spark, tmp_path, rows):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "as20210305.txt").write_text("# comment\n1\t2\n3\t1\n")
    (raw / "as20210306.txt").write_text("2\t3\n")
    (raw / "other.txt").write_text("9\t9\n")
    data = get_dataset("as-733", spark, f"file://{tmp_path}")
    edges, nodes = data.to("spark")
    a, b = datetime(2021, 3, 5), datetime(2021, 3, 6)
    assert rows(edges, "timestamp", "src", "dst") == [(a, 0, 1), (a, 2, 0), (b, 1, 2)]
    assert rows(nodes, "timestamp", "id") == [(a, 0), (a, 2), (b, 1)]
    assert [(w, g.num_edges) for w, g in data.to("snapshots")] == [(a, 2), (b, 1)]
    assert data.to("graph").num_edges == 3 and len(data.to("pandas")[0]) == 3
    assert rows(files.snapshot_nodes(edges, "both")) == [(a, 0), (a, 1), (a, 2), (b, 1), (b, 2)]
    assert rows(files.read_edge_list(spark, f"file://{raw}/as20210305.txt")) == [(1, 2), (3, 1)]
    with pytest.raises(ValueError):
        data.to("other")


def test_registry(spark):
    assert {"as-733", "Cora", "DGraph"} <= set(list_available_datasets())
    with pytest.raises(ValueError, match="available"):
        get_dataset("none")

    @register_dataset("mine")
    class Mine(Dataset):
        pass

    assert repr(get_dataset("mine", spark, "/x/")) == "Mine('/x')"


def test_table_dataset_with_transforms(spark, tmp_path):
    t = datetime(2021, 1, 1)
    spark.createDataFrame([(t, 0, 1, 2.0)], "timestamp timestamp_ntz, src long, dst long, edge_feature_0 double").write.parquet(f"{tmp_path}/raw/edges")
    data = get_dataset("Cora", spark, f"file://{tmp_path}", transform=lambda e, n: (e.where("src = 0"), n))
    assert data.graph().edges.columns == ["src", "dst", "edge_feature_0"] and data.graph().num_nodes == 2


def test_round_trips(spark, tmp_path, rows):
    base = f"file://{tmp_path}"
    g = PropertyGraph.from_edges(spark.createDataFrame([(0, 1, 2.0)], "src long, dst long, w double"), None, False, "w")
    files.save_graph(g, f"{base}/g")
    again = files.load_graph(spark, f"{base}/g")
    assert rows(again.edges) == rows(g.edges) and not again.directed
    patches = spark.createDataFrame([(0, 5, [1.0, 2.0]), (1, 5, [0.1, 3.0]), (1, 6, [1e-9, 4.0])], "patch_id int, node long, coords array<double>")
    path = files.save_patches(patches, f"{base}/p")
    assert path.endswith(".json")
    assert rows(files.load_patches(spark, path).selectExpr("patch_id", "node", "coords[0]", "coords[1]")) == rows(patches.selectExpr("patch_id", "node", "coords[0]", "coords[1]"))
    assert rows(files.patches_from_json(files.patches_to_json(patches)).selectExpr("patch_id", "node", "coords[1]")) == [(0, 5, 2.0), (1, 5, 3.0), (1, 6, 4.0)]
    e = files.save_embedding(patches.where("patch_id = 1"), f"{base}/e.json")
    assert files.load_embedding(spark, e).count() == 2
    frames = random_frames([0, 1, 2], 3)
    files.save_frames(spark, frames, f"{base}/f")
    assert np.allclose(files.load_frames(spark, f"{base}/f").rot, frames.rot)
    assert spark.read.option("header", True).csv(files.save_points(patches, f"{base}/x", 2)).columns == ["node", "x0", "x1"]
    with pytest.raises(ValueError):
        files.save_embedding(patches, f"{base}/e.csv")


def test_conversions(spark, rows):
    a, b = datetime(2021, 1, 1), datetime(2021, 1, 2)
    edges = spark.createDataFrame([(a, 0, 1, 2.0), (a, 0, 1, 1.0), (b, 1, 2, 3.0), (b, None, 2, 3.0)], "timestamp timestamp_ntz, src long, dst long, f double")
    assert rows(convert.coalesced_edges(edges)) == [(a, 0, 1, 1.0), (b, 1, 2, 3.0)]
    assert convert.node_count(edges) == 3 and convert.node_count(edges.where("false")) == 0
    stacked, nodes = convert.frames_from_snapshots(list(convert.snapshots(edges)))
    assert stacked.count() == 2 and nodes.count() == 4
    assert rows(convert.temporal_statistics(edges.where("src is not null")), "n_nodes", "n_edges", "n_temporal_edges") == [(3, 2, 3)]
    features = spark.createDataFrame([(b, 0, 5.0), (a, 0, 4.0), (a, None, 1.0)], "timestamp timestamp_ntz, id long, x double")
    assert rows(convert.first_node_features(features)) == [(0, 4.0)]
    assert rows(convert.previous_snapshot(edges)) == [(a, None), (b, a)]
    g = PropertyGraph.from_edges(edges.where("src is not null"), None, False)
    assert convert.to_edge_list(g)[0] == (0, 1, 1.0)


def test_from_networkx_like_object(spark, rows):
    class Fake:
        nodes = [0, 1, 5]

        def edges(self, data):
            return [(0, 1, {"w": 2.0})]

        def is_directed(self):
            return False

    g = convert.from_networkx(spark, Fake(), "w")
    assert rows(g.edges) == [(0, 1, 2.0), (1, 0, 2.0)] and g.num_nodes == 3


def test_stream(spark, tmp_path):
    a, b = datetime(2021, 1, 1, 5), datetime(2021, 1, 2, 7)
    edges = spark.createDataFrame([(a, 0, 1), (a, 0, 1), (b, 1, 2), (None, 1, 2)], "timestamp timestamp_ntz, src long, dst long")
    edges.write.parquet(f"{tmp_path}/e")
    run_once(windowed_counts(edge_stream(spark, f"{tmp_path}/e", edges.schema)), "counts")
    assert sorted((r.n_edges, r.n_pairs) for r in spark.table("counts").collect()) == [(1, 1), (2, 1)]


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)), vec_add(array(1D), array(2D)), mat_vec(array(array(0D, 1D), array(1D, 0D)), array(5D, 6D))").first()
    assert (row[0], list(row[1]), list(row[2])) == (11.0, [3.0], [6.0, 5.0])


def test_synthetic_points(spark):
    assert cluster_points(spark, 3, 2, 50).select("cluster").distinct().count() == 2
    with pytest.raises(ValueError):
        cluster_points(spark, 1)


def test_vanishing_singular_values_are_completed(spark):
    entries = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(100, 104)], "row long, col long, value double")
    rows_, columns, values = bipartite_svd(entries, 2)
    assert np.allclose(values, 0, atol=1e-7)
    for side, degree in ((rows_, 4.0), (columns, 6.0)):
        x = np.array([r.coords for r in side.orderBy("node").collect()]) * np.sqrt(degree)
        assert np.allclose(x.T @ x, np.eye(2), atol=1e-8)
        assert np.allclose(x.sum(0), 0, atol=1e-8)


def test_training_callbacks():
    src, dst = np.array([0, 1, 1, 2, 2, 3, 3, 0]), np.array([1, 0, 2, 1, 3, 2, 0, 3])
    told, config = [], AutoEncoder(model="GAE", epochs=5, patience=1)
    model = GraphModel(config, 6, src, dst, None)
    doubled = model.train(
        loss=lambda m, negatives, noise: tuple(2 * x if isinstance(x, float) else x for x in m.loss(negatives, noise)), validation=lambda m: 1.0, logger=told.append
    )
    plain = GraphModel(config, 6, src, dst, None).train()
    assert doubled[0] == 2 * plain[0]
    # The validation never improves after the first epoch, so training ends after the patience.
    assert [t["epoch"] for t in told] == [1, 2, 3] and told[0]["val_loss"] == 1.0 and told[0]["loss"] == doubled[0]


def test_citation_files(spark, tmp_path, rows):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "cora.content").write_text("".join(f"p{i}\t{i % 2}\t1\t{'ab'[i % 2]}\n" for i in range(60)))
    (raw / "cora.cites").write_text("p1\tp0\np0\tp1\np2\tp0\np3\tp3\nunknown\tp1\n")
    edges, nodes = get_dataset("Cora", spark, str(tmp_path)).tables()
    assert rows(edges, "src", "dst") == [(0, 1), (0, 12), (1, 0), (12, 0)]
    first = nodes.where("label = 'p1'").first()
    assert (first.id, first.x, first.y, first.train_mask) == (1, [0, 1], 1, True)
    assert nodes.where("train_mask").count() == 40 and nodes.where("val_mask").count() == 20 and nodes.where("test_mask").count() == 0


def test_financial_archive(spark, tmp_path, rows):
    path = tmp_path / "graph.npz"
    np.savez(
        path, edge_index=np.array([[0, 1], [1, 2]]), edge_type=np.array([3, 4]), edge_timestamp=np.array([0, 2]), x=np.ones((3, 2)), y=np.array([0, 1, 2]),
        train_mask=np.array([0]), valid_mask=np.array([1]), test_mask=np.array([2]),
    )
    edges, nodes = get_dataset("DGraph", spark, str(tmp_path / "data"), source_file=str(path)).tables()
    assert rows(edges, "timestamp", "src", "dst", "edge_type") == [(datetime(1970, 1, 1), 0, 1, 3), (datetime(1970, 1, 3), 1, 2, 4)]
    assert rows(nodes, "id", "y", "train_mask", "val_mask", "test_mask") == [(0, 0, True, False, False), (1, 1, False, True, False), (2, 2, False, False, True)]
    with pytest.raises(FileNotFoundError):
        get_dataset("DGraph", spark, str(tmp_path / "other"), source_file="/nowhere.npz").tables()


def test_snapshots_are_transformed_before_they_are_written(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "as19990101.txt").write_text("1\t2\n3\t4\n")
    seen = []

    def keep_first(edges, nodes):
        seen.append(edges.count())
        return edges.where("src = 0"), nodes.where("id = 0")

    edges, nodes = get_dataset("as-733", spark, str(tmp_path), pre_transform=keep_first).tables()
    assert seen == [2] and edges.count() == 1 and nodes.count() == 1


def test_graphs_of_array_objects(spark, rows):
    class Data:
        edge_index = np.array([[0, 1], [1, 0]])
        x = np.eye(3)

    graph = convert.from_data(spark, Data())
    assert not graph.directed and graph.num_nodes == 3 and rows(graph.edges) == [(0, 1), (1, 0)]
    Data.edge_index, Data.x = np.array([[0], [2]]), None
    assert convert.from_data(spark, Data()).directed


def test_all_dates_at_once_equal_the_stacked_snapshots(spark, rows):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    edges = spark.createDataFrame([(a, 1, 2, 0.5), (a, 1, 2, 0.1), (b, 2, 3, 0.2)], "timestamp timestamp_ntz, src long, dst long, f double")
    nodes = spark.createDataFrame([(a, 1, 7.0), (b, 1, 8.0), (b, 2, 9.0)], "timestamp timestamp_ntz, id long, g double")
    for n in (None, nodes):
        together, stacked = convert.frames_by_date(edges, n), convert.frames_from_snapshots(list(convert.snapshots(edges, n)))
        assert rows(together[0], "timestamp", "src", "dst", "f") == rows(stacked[0], "timestamp", "src", "dst", "f")
        assert rows(together[1].select(*sorted(together[1].columns))) == rows(stacked[1].select(*sorted(stacked[1].columns)))


def test_singular_triplets_of_a_long_side_by_blocks():
    rng = np.random.default_rng(4)
    # Three equal components, so that every value is there three times and 1 twice more.
    part = rng.random((70, 50)) * (rng.random((70, 50)) < 0.3) + np.eye(70, 50) * 0.1 + (np.arange(70)[:, None] % 50 == np.arange(50)) * 0.1
    for table in (np.kron(np.eye(3), part), np.kron(np.eye(3), part).T):
        row, col = np.nonzero(table)
        start = np.searchsorted(row, np.arange(len(table) + 1))
        rows_ = SparseRows(np.arange(len(table)), np.arange(table.shape[1]), start, col.astype(np.int32), table[row, col])
        left, right, values = singular_triplets(rows_, 4, basis=48)
        d1, d2 = table.sum(1), table.sum(0)
        unit = table / np.sqrt(np.outer(d1, d2))
        assert np.allclose(values, np.linalg.svd(unit)[1][1:5][::-1], atol=1e-9)
        x, y = left * np.sqrt(d1)[:, None], right * np.sqrt(d2)[:, None]
        assert np.allclose(x.T @ x, np.eye(4), atol=1e-8) and np.allclose(unit @ y, x * values, atol=1e-8)


def test_bipartite_svd_collects_no_gram_matrix(spark):
    # More members of the smaller side than the Gram matrix on the driver took.
    entries = spark.range(9_000).selectExpr("id AS row", "explode(array(id, (id * 7 + 1) % 9000, (id * 31 + 5) % 9000)) AS col", "1D AS value")
    rows_, columns, values = bipartite_svd(entries, 2)
    assert rows_.count() == columns.count() == 9_000 and (values <= 1 + 1e-9).all()


def test_row_sums_of_hubs_and_of_the_turned_table():
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((70, 50)) < 0.3, rng.random((70, 50)), 0) + 0.01 * np.eye(70, 50)
    dense[3], dense[:, 5] = 0.5, 0.25
    for a in (dense, (dense > 0).astype(float)):
        row, col = np.nonzero(a)
        table = SparseRows(np.arange(70), np.arange(50), np.searchsorted(row, np.arange(71)), col.astype(np.int32), a[row, col] if a is dense else None)
        turned = table.turned()
        assert np.allclose(turned.sums(), a.sum(0))
        x, y = rng.normal(size=(50, 3)), rng.normal(size=(70, 3))
        for most in (4, 64):
            assert np.allclose(RowSums(table, most, 8)(x), a @ x) and np.allclose(RowSums(turned, most, 8)(y), a.T @ y)


def test_tables_arrive_whole_in_packed_lists(spark):
    # A row of more entries than a list holds, weights of one and others, an order that isn't that of rows.
    entries = spark.range(2_000).selectExpr("id % 3 AS src", "id AS dst", "CASE WHEN id % 3 = 1 THEN 2D ELSE 1D END AS weight")

    def kernel(table):
        yield pa.record_batch({"src": pa.array(np.repeat(table.ids, np.diff(table.start))), "dst": pa.array(table.columns[table.v]), "weight": pa.array(table.w)})

    got = in_one_task(entries, kernel, "src long, dst long, weight double", square=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, entries.collect()))


def test_few_products_until_the_singular_vectors_settle(monkeypatch):
    # A random table: its values lie close together.  With whole blocks all the way it took 408 products.
    rng = np.random.default_rng(7)
    row, col = np.divmod(np.unique(rng.integers(0, 20_000 * 2_000, 200_000)), 2_000)
    ids, row = np.unique(row, return_inverse=True)
    table = SparseRows(ids, np.arange(2_000), np.searchsorted(row, np.arange(len(ids) + 1)), col.astype(np.int32))
    products, plain = [], RowSums.__call__
    monkeypatch.setattr(RowSums, "__call__", lambda self, x: products.append(x.shape[1]) or plain(self, x))
    left, right, values = singular_triplets(table, 4)
    assert sum(products) // 2 < 380
    d1, d2 = np.sqrt(np.diff(table.start))[:, None], np.sqrt(np.bincount(col))[:, None]
    x, y, back = left * d1, right * d2, np.zeros((len(ids), 4))
    np.add.at(back, row, right[col])
    assert np.allclose(y.T @ y, np.eye(4), atol=1e-8) and np.allclose(back / d1, x * values, atol=1e-8)


def test_bipartite_svd_keeps_parts_and_suppliers_apart(spark, tmp_path, monkeypatch):
    # Parts with the ids that suppliers have in the graph were on either side.
    items = [(1_000_000 + p, s) for p in range(40) for s in range(p % 3, 12, 2)]
    spark.createDataFrame(items + items[:5] + [(None, 1), (2, None)], "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    monkeypatch.setattr(alignment, "bipartite_svd", lambda entries, k: seen.append(sorted((r.row, r.col, r.value) for r in entries.collect())) or bipartite_svd(entries, k))
    assert tuple(alignment.queries()["bipartite_svd"](spark, str(tmp_path)).first()) == (4, True, True)
    assert seen == [sorted((p, s, 1.0) for p, s in items)]
