from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.llm.queries import oracle_sql, p4_found
from tessera.llm.quantised_search import QuantisedList, SearchParameters, fit_codebooks, nearest_neighbours, neighbour_pairs

VECTORS = "node long, vector array<double>"


def brute(rows, k):
    ids = np.array([n for n, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[b]), d[b]) for b in best if np.isfinite(d[b])]
    return out


def cloud(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=20, size=(12, dim))
    return [(i, (centres[rng.integers(12)] * (rng.random() > 0.1) + rng.normal(scale=0.5, size=dim)).tolist()) for i in range(n)]


def test_recall_and_exact_distances(spark):
    rows = cloud(1, 1500)
    truth = brute(rows, 5)
    got = nearest_neighbours(spark.createDataFrame(rows, VECTORS), 5, SearchParameters(block_rows=100, query_rows=64, recall=1.0)).collect()
    assert len(got) == 1500 * 5
    hits = sum((r.neighbour in {n for n, _ in truth[r.node]}) for r in got)
    assert hits == len(got)
    x = dict(rows)
    for r in got[::50]:
        assert abs(r.d - np.linalg.norm(np.array(x[r.node]) - x[r.neighbour])) < 1e-9


def test_small_training_sample_still_indexes_every_row(spark):
    rows = cloud(2, 800)
    truth = brute(rows, 5)
    got = nearest_neighbours(spark.createDataFrame(rows, VECTORS), 5, SearchParameters(train_rows=60)).collect()
    assert len({r.node for r in got}) == 800
    assert sum(r.neighbour in {n for n, _ in truth[r.node]} for r in got) / len(got) >= 0.95


def test_copies_and_ties(spark):
    rows = [(n, [1.0] * 8) for n in range(40)] + [(100, [1.0] * 7 + [2.0]), (101, [1.0] * 7 + [0.0]), (102, [50.0] * 8)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, VECTORS), 5).collect():
        got.setdefault(r.node, []).append(r.neighbour)
    expected = {n: [m for m, _ in v] for n, v in brute(rows, 5).items()}
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(v) for n, v in expected.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_fewer_than_k(spark, n):
    rows = [(i, [float(i)] * 8) for i in range(n)]
    out = nearest_neighbours(spark.createDataFrame(rows, VECTORS), 5).collect()
    assert len(out) == n * max(0, n - 1)
    assert all(r.node != r.neighbour for r in out)


def test_pairs(spark):
    out = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, neighbour long")
    assert sorted(tuple(r) for r in neighbour_pairs(out).collect()) == [(1, 2), (1, 3)]


def test_more_levels_leave_less_error():
    x = np.random.default_rng(0).normal(size=(3000, 8))
    errors = []
    for levels in (1, 2, 4):
        p = SearchParameters(levels=levels, entries=64)
        books = fit_codebooks(x, 16, p)
        cell, codes, norm, error = books.encode(x, p.beam)
        rebuilt = books.coarse[cell] + sum(b[codes[:, i]] for i, b in enumerate(books.levels))
        assert np.allclose(((rebuilt - books.coarse[cell]) ** 2).sum(1), norm)
        assert np.allclose(((rebuilt - x) ** 2).sum(1), error**2)
        errors.append(((x - rebuilt) ** 2).sum(1).mean())
    assert errors[0] > errors[1] > errors[2]


def test_a_wider_beam_encodes_better():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    books = fit_codebooks(x, 8, SearchParameters(levels=4, entries=16))

    def error(beam):
        cell, codes, _, _ = books.encode(x, beam)
        return ((x - books.coarse[cell] - sum(b[codes[:, i]] for i, b in enumerate(books.levels))) ** 2).sum()

    assert error(8) < error(1)


def quantised(x, cells, p):
    """The books and, per cell, its rows and their quantised list."""
    books = fit_codebooks(x, cells, p)
    cell, codes, norm, error = books.encode(x, p.beam)
    return books, {c: (np.flatnonzero(cell == c), QuantisedList(books, c, codes[cell == c], norm[cell == c], error[cell == c])) for c in set(cell.tolist())}


def test_stored_norms_and_tables_keep_every_neighbour_of_a_long_list():
    x = np.random.default_rng(3).normal(size=(3000, 8))
    _, lists = quantised(x, 1, SearchParameters(entries=64))
    rows, listed = lists[0]
    q = np.arange(200)
    near, at = listed.candidates(x[q], q[:, None] == rows, np.full(len(q), np.inf), 5, 3.0)
    d = ((x[q][:, None] - x) ** 2).sum(2)
    d[q, q] = np.inf
    kept = set(zip(near.tolist(), at.tolist()))
    assert all((i, j) in kept for i in q for j in np.argsort(d[i])[:5])
    # The tables exclude most of the list, so few rows are reranked.
    assert len(kept) / len(q) < 0.1 * len(x)


def test_long_vectors_in_long_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(scale=3, size=(20, 64))
    x = centres[rng.integers(20, size=2000)] + rng.normal(size=(2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    truth = brute(rows, 5)
    got = nearest_neighbours(spark.createDataFrame(rows, VECTORS), 5, SearchParameters(cells_per_root=0.5, entries=64)).collect()
    assert sum(r.neighbour in {n for n, _ in truth[r.node]} for r in got) / (5 * len(x)) >= 0.99


def test_probes_are_bounded_where_the_bounds_exclude_nothing(spark):
    from pyspark.sql import functions as F

    from tessera.llm.quantised_search import _other_cells, _probes, encode_index

    rng = np.random.default_rng(5)
    centres = rng.normal(scale=3, size=(40, 64))
    x = centres[rng.integers(40, size=2000)] + rng.normal(size=(2000, 64))
    p = SearchParameters(entries=32)
    books = fit_codebooks(x, 40, p)
    shared = spark.sparkContext.broadcast((books.coarse, books.levels))
    index = encode_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), shared, p)
    probes = _probes(index, (np.arange(200), x[:200]), shared, 5, p)
    asked = index.select(F.col("node").alias("query"), F.col("vector").alias("qvector"), "cell", F.lit(1e6).alias("bound"))
    few = _other_cells(asked, shared, np.full(40, 50), np.full(40, 20.0), 5, probes).count()
    assert few <= 2000 * (probes - 1) < 2000 * 39


def test_pairs_of_the_test_tables_equal_their_sql(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    connection.execute(f"create view patch as select * from '{folder}/patch.parquet'")
    wanted = connection.execute(oracle_sql()["p4_found"]).fetchall()
    assert sorted(map(tuple, p4_found(spark, str(folder)).collect())) == sorted(wanted)
