import pytest

from tessera.llm.mixing import Source, expand_uses, mix, share_report, water_fill

DOCS = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def test_water_fill_meets_shares_when_it_can():
    s = [Source("a", 0.5, 1, 1000), Source("b", 0.5, 4, 200)]
    assert water_fill(s, 1000) == {"a": 500, "b": 500}


def test_water_fill_clamps_and_redistributes():
    s = [Source("a", 0.6, 1, 1000), Source("b", 0.2, 1, 1000), Source("c", 0.2, 2, 10), Source("d", 0.0, 5, 10)]
    got = water_fill(s, 1000)
    assert got["c"] == 20 and got["d"] == 0
    assert abs(got["a"] - 735) < 1e-9 and abs(got["b"] - 245) < 1e-9
    assert water_fill(s, 10_000) == {"a": 1000, "b": 1000, "c": 20, "d": 0}
    assert water_fill([], 10) == {}


def docs(spark, spec, extra=()):
    rows, k = [], 0
    for source, n, size in spec:
        for i in range(n):
            rows.append((k, source, size + i % 3))
            k += 1
    return spark.createDataFrame(rows + list(extra), DOCS)


def test_shares_and_caps(spark):
    df = docs(spark, [(" Big", 3000, 20), ("small ", 300, 20), ("other", 50, 5)], [(9001, None, 5), (9002, "big", 0), (9003, "big", None)])
    targets = spark.createDataFrame([("BIG", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 5)], TARGETS)
    used, plans = mix(df, targets, total=30_000)
    report = {r.source: r for r in share_report(used, plans).collect()}
    assert report["none"].n_tokens == 0 and report["none"].actual_share == 0
    assert abs(report["small"].actual_share / report["big"].actual_share - 0.5) < 0.01
    assert report["small"].most_uses <= 3 and report["big"].most_uses == 1
    total = sum(r.n_tokens for r in report.values())
    assert abs(total - 30_000) < 50
    rows = expand_uses(used).collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) == total
    assert {r.doc_id for r in rows}.isdisjoint({9001, 9002, 9003})


def test_same_result_for_any_partitioning_and_another_for_another_seed(spark):
    df = docs(spark, [("a", 1000, 10), ("b", 1000, 10)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    one, two, three = (sorted(r.doc_id for r in mix(d, targets, 5_000, seed)[0].collect()) for d, seed in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == two != three


def test_huge_document_does_not_block_a_source(spark):
    df = spark.createDataFrame([(0, "a", 5000)] + [(i, "a", 10) for i in range(1, 600)], DOCS)
    used, plans = mix(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=4000)
    assert abs(share_report(used, plans).first().n_tokens - 4000) <= 10


def test_empty_and_bad_targets(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    used, plans = mix(spark.createDataFrame([], DOCS), targets)
    assert used.count() == 0 and share_report(used, plans).first().n_tokens == 0
    df = docs(spark, [("a", 5, 10)])
    used, plans = mix(df, spark.createDataFrame([], TARGETS))
    assert used.count() == 0
    with pytest.raises(ValueError):
        mix(df, spark.createDataFrame([("a", 1.0, 1), ("A ", 0.5, 1)], TARGETS))
    with pytest.raises(ValueError):
        mix(df, spark.createDataFrame([("a", -1.0, 1)], TARGETS))


def test_nulls_in_targets_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a", 10, 1, "x") for i in range(20)], DOCS + ", h long, bucket string")
    targets = spark.createDataFrame([("a", 1.0, None, 3), (None, 0.5, 1, 3), ("b", None, 1, 3)], TARGETS + ", cap int")
    used, plans = mix(df, targets)
    assert used.count() == 20 and {p["source"] for p in plans} == {"a", "b"}


def test_every_size_class_is_used_at_the_same_rate(spark):
    sizes = [1 << (i % 10) for i in range(20_000)]
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], n) for i, n in enumerate(sizes)], DOCS)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 5)], TARGETS)
    used, plans = mix(df, targets)
    uses = {r.doc_id: r.uses for r in used.collect()}
    for p in plans:
        mine = [i for i in range(20_000) if ("ab"[i % 3 == 0]) == p["source"]]
        rate = p["wanted"] / p["available"]
        for size in {sizes[i] for i in mine}:
            these = [i for i in mine if sizes[i] == size]
            assert abs(sum(uses.get(i, 0) for i in these) / len(these) - rate) < 0.01
        got = sum(uses.get(i, 0) * sizes[i] for i in mine)
        assert abs(got - p["wanted"]) <= 512
        whole = int(rate)
        assert {uses.get(i, 0) for i in mine} <= {whole, whole + 1}


def test_a_sample_is_no_choice_by_size_within_a_class(spark):
    df = spark.createDataFrame([(i, "a", 256 + i % 256) for i in range(20_000)], DOCS)
    used, _ = mix(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=20_000 * 192)
    drawn = [r.n_tokens for r in used.collect()]
    assert abs(sum(drawn) / len(drawn) - 383.5) < 3


def test_repeated_rows_are_drawn_together(spark):
    df = spark.createDataFrame([(i % 50, "a", 10) for i in range(150)], DOCS)
    used, _ = mix(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=700)
    keys = [r.doc_id for r in used.collect()]
    assert abs(len(keys) * 10 - 700) <= 30 and all(keys.count(k) == 3 for k in keys)
