import random
from collections import defaultdict

import pytest

from tessera.operators.hot_keys import heavy_keys, key_stats

SCHEMA = "src long, dst long, edge_feature_0 double"


def brute(edges):
    stats = defaultdict(lambda: [0, set(), 0.0, False])
    for s, d, v in edges:
        for side, key, partner in (("src", s, d), ("dst", d, s)):
            if key is None:
                continue
            e = stats[side, key]
            e[0] += 1
            if partner is not None:
                e[1].add(partner)
            if v is not None:
                e[2], e[3] = e[2] + v, True
    return sorted((side, key, n, len(p), round(v, 6) if any_v else None) for (side, key), (n, p, v, any_v) in stats.items())


def result(df):
    return sorted((r.side, r.id, r.n_rows, r.n_partners, None if r.sum_value is None else round(r.sum_value, 6)) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_matches_brute_force_with_hubs_nulls_and_repeats(spark, chunk):
    rng = random.Random(chunk)
    edges = []
    for _ in range(600):
        s = 5 if rng.random() < 0.4 else rng.randrange(40)
        d = 7 if rng.random() < 0.4 else rng.randrange(40)
        edges.append((None if rng.random() < 0.05 else s, None if rng.random() < 0.05 else d, None if rng.random() < 0.1 else float(rng.randrange(100))))
    edges += edges[:50]
    assert result(key_stats(spark.createDataFrame(edges, SCHEMA), chunk_rows=chunk)) == brute(edges)


def test_one_pair_holds_all_rows(spark):
    edges = [(1, 2, 0.5)] * 500
    assert result(key_stats(spark.createDataFrame(edges, SCHEMA), chunk_rows=2)) == [("dst", 2, 500, 1, 250.0), ("src", 1, 500, 1, 250.0)]


def test_empty_table_and_only_nulls(spark):
    assert key_stats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert key_stats(spark.createDataFrame([(None, None, None)], SCHEMA)).count() == 0
    assert heavy_keys(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 9, 8, 7)], "src long, dst long, edge_feature_0 double, id long, n long, SRC long")
    assert result(key_stats(df)) == [("dst", 2, 1, 1, 1.0), ("src", 1, 1, 1, 1.0)]


def test_heavy_keys_count_every_row(spark):
    edges = [(1, d, 1.0) for d in range(2, 4)] + [(None, None, None)] * 98
    found = heavy_keys(spark.createDataFrame(edges, SCHEMA), 0.02)
    assert [(r.side, r.id) for r in found.collect()] == [("src", 1)]
    assert heavy_keys(spark.createDataFrame(edges + [(None, None, None)], SCHEMA), 0.02).count() == 0


def test_nan_values_and_bad_chunk(spark):
    out = key_stats(spark.createDataFrame([(1, 2, float("nan")), (1, 3, 1.0)], SCHEMA)).where("side = 'src'").first()
    assert out.sum_value != out.sum_value
    with pytest.raises(ValueError):
        key_stats(spark.createDataFrame([], SCHEMA), chunk_rows=0)
