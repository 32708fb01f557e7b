from datetime import datetime

from tessera.operators.references import Parent, orphan_cases, orphan_references, orphan_report, orphans_by_parent

E = "timestamp timestamp_ntz, src long, dst long"
N = "timestamp timestamp_ntz, id long"


def day(d, h=0):
    return datetime(2021, 3, d, h)


def found(spark, edges, nodes):
    return orphan_cases(orphan_references(spark.createDataFrame(edges, E), spark.createDataFrame(nodes, N)))


def test_reasons_and_counts(spark, rows):
    nodes = [(day(1), 1), (day(2), 1), (day(3), 1), (day(1), 2), (day(3), 3), (day(1), 4), (day(3), 4), (day(3, 5), 4)]
    edges = [(day(2, 3), 1, 2), (day(2), 3, 4), (day(2), 9, 1), (day(2), 9, 1), (day(2), 2, 9)]
    got = rows(found(spark, edges, nodes), "snapshot", "side", "id", "reason", "n_refs")
    s = 20210302
    assert got == sorted(
        [(s, "dst", 2, "deleted", 1), (s, "src", 3, "late", 1), (s, "dst", 4, "gap", 1), (s, "src", 9, "missing", 2), (s, "src", 2, "deleted", 1), (s, "dst", 9, "missing", 1)]
    )


def test_nulls(spark, rows):
    nodes = [(None, 1), (day(1), None)]
    edges = [(None, 1, 2), (day(1), None, 1), (day(1), None, None)]
    assert rows(found(spark, edges, nodes), "snapshot", "side", "id", "reason") == [(20210301, "dst", 1, "missing")]


def test_empty_tables(spark):
    assert found(spark, [], [(day(1), 1)]).count() == 0
    assert found(spark, [], []).count() == 0
    assert found(spark, [(day(1), 1, 1)], []).count() == 2


def test_clashing_extra_columns(spark, rows):
    edges = spark.createDataFrame([(day(1), 1, 2, 5, 6, 7)], E + ", id long, parent long, n_src long")
    nodes = spark.createDataFrame([(day(1), 1, 3, 4)], N + ", src long, day long")
    assert rows(orphan_cases(orphan_references(edges, nodes)), "side", "id") == [("dst", 2)]


def test_report_sums_cases(spark, rows):
    edges = [(day(1), 1, 2), (day(1), 1, 3), (day(2), 1, 3)]
    report = orphan_report(found(spark, edges, [(day(1), 3)]))
    assert rows(report, "side", "snapshot", "reason", "n_ids", "n_refs") == [
        ("dst", 20210301, "missing", 1, 1), ("dst", 20210302, "deleted", 1, 1), ("src", 20210301, "missing", 1, 2), ("src", 20210302, "missing", 1, 1)
    ]


def test_several_parent_tables_in_one_pass(spark, rows):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    children = spark.createDataFrame([(a, 1, 1), (a, 2, 2), (b, 3, None), (None, 9, 9)], "timestamp timestamp_ntz, src long, dst long")
    people = spark.createDataFrame([(1, a), (3, a)], "id long, timestamp timestamp_ntz")
    places = spark.createDataFrame([(2, b, 0), (None, a, 0)], "place long, seen timestamp_ntz, id long")
    got = orphans_by_parent(children, {"src": "people", "dst": "places"}, {"people": Parent(people), "places": Parent(places, "place", "seen")})
    assert rows(got) == [
        ("people", 20240101, 2, "missing", 1, 0), ("people", 20240102, 3, "deleted", 1, 0), ("places", 20240101, 1, "missing", 0, 1), ("places", 20240101, 2, "late", 0, 1)
    ]
