import random
from datetime import datetime, timedelta

from tessera.operators.snapshot_diff import latest_states, snapshot_changes

SCHEMA = "timestamp timestamp_ntz, src long, dst long, edge_feature_0 double, loaded_at timestamp_ntz"


def day(d, h=0):
    return datetime(2021, 3, d, h)


def brute(data):
    state = {}
    for t, s, d, v, at in data:
        if None in (t, s, d):
            continue
        key, rank = (t.date(), s, d), (at is not None, at, v is not None, v)
        if key not in state or rank > state[key][0]:
            state[key] = rank, v
    days = sorted({k[0] for k in state})
    out = set()
    for old, new in zip(days, days[1:]):
        number = new.year * 10000 + new.month * 100 + new.day
        a = {k[1:]: v for k, (_, v) in state.items() if k[0] == old}
        b = {k[1:]: v for k, (_, v) in state.items() if k[0] == new}
        out |= {(number, *k, "added") for k in b.keys() - a.keys()} | {(number, *k, "removed") for k in a.keys() - b.keys()}
        for k in a.keys() & b.keys():
            if (a[k] is None) != (b[k] is None) or (a[k] is not None and abs(a[k] - b[k]) > 1e-6):
                out.add((number, *k, "changed"))
    return sorted(out)


def changes(spark, data, schema=SCHEMA):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(data, schema)).select("snapshot", "src", "dst", "change").collect())


def test_matches_brute_force(spark):
    rng = random.Random(1)
    data = []
    for _ in range(900):
        null = lambda x, p=0.03: None if rng.random() < p else x
        data.append(
            (null(day(rng.choice([1, 2, 5, 9]), rng.randrange(24))), null(rng.randrange(6)), null(rng.randrange(6)), null(rng.choice([1.0, 1.0 + 1e-9, 2.0]), 0.1), day(10) + timedelta(seconds=rng.randrange(50)))
        )
    data += data[:60]
    assert changes(spark, data) == brute(data)


def test_late_delivery_and_ties(spark, rows):
    data = [(day(1), 1, 2, 5.0, day(1)), (day(1), 1, 2, 6.0, day(20)), (day(1), 1, 2, 7.0, day(2)), (day(1), 3, 4, 1.0, day(1)), (day(1), 3, 4, None, day(1)), (day(1), 5, 6, 2.0, None)]
    assert rows(latest_states(spark.createDataFrame(data, SCHEMA)), "k0", "k1", "value") == [(1, 2, 6.0), (3, 4, 1.0), (5, 6, 2.0)]


def test_nan_and_infinity(spark):
    nan, inf = float("nan"), float("inf")
    data = [(day(d), k, 0, v, day(d)) for d, vs in ((1, (nan, nan, inf, inf)), (2, (nan, 1.0, inf, 1.0))) for k, v in enumerate(vs)]
    assert [(s, c) for _, s, _, c in changes(spark, data)] == [(1, "changed"), (3, "changed")]


def test_empty_single_and_null_only(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(day(1), 1, 2, 1.0, day(1))]) == []
    assert changes(spark, [(None, 1, 2, 1.0, day(1)), (day(2), None, 2, 1.0, day(1)), (day(3), 1, None, 1.0, day(1))]) == []


def test_clashing_extra_columns(spark):
    data = [(day(1), 1, 2, 1.0, day(1), 9, 9, "x"), (day(2), 1, 2, 2.0, day(1), 8, 8, "y")]
    assert changes(spark, data, SCHEMA + ", day long, value long, sign string") == [(20210302, 1, 2, "changed")]
