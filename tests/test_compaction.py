import pytest

from tessera.sources.compaction import ConflictError, VersionedTable, consolidate_raw_files, raw_records

FILES = "file_name string, content string"


def records(spark, files, schema=FILES):
    return sorted(tuple(r) for r in raw_records(spark.createDataFrame(files, schema)).collect())


def test_record_syntax(spark):
    text = "﻿1\t2\r\n# 3\t4\n 5  6 \n7\t8\t9\n10\n\n11 12\r\n a\tb\n13\t14"
    assert records(spark, [("k1/as20210305.txt", text)]) == [(20210305, 0, 1), (20210305, 4, 5), (20210305, 10, 11), (20210305, 12, 13)]


def test_only_exact_names(spark):
    names = ["as20210305.txt~", "as20210305.TXT", "as20210305.txt.bak", "README", "as2021.txt", "xas20210305.txt", None]
    assert records(spark, [(n, "1\t2") for n in names]) == []
    assert records(spark, [("as20210305.txt", None), ("a/as20210305.txt", "")]) == []


def test_lone_carriage_return_and_huge_numbers(spark):
    assert records(spark, [("as20210305.txt", "1\t2\r\r\n99999999999999999999\t1\n3\t4\r5\t6")]) == []


def test_very_long_file(spark):
    text = "\n".join(f"{i}\t{i + 1}" for i in range(1, 20001))
    assert len(records(spark, [("as20210305.txt", text)])) == 20000


def test_clashing_columns(spark):
    assert records(spark, [("as20210305.txt", "1 2", "x", "y")], FILES + ", name string, line string") == [(20210305, 0, 1)]


def test_consolidation_keeps_every_record_once(spark, tmp_path, rows):
    files = [(f"k{i}/as2021030{1 + i % 3}.txt", "\n".join(f"{j}\t{j + i % 5}" for j in range(1, 40))) for i in range(30)]
    raw = spark.createDataFrame(files, FILES).repartition(6)
    table = consolidate_raw_files(raw, f"file://{tmp_path}/t")
    got = rows(table.read(), "snapshot", "src", "dst")
    assert got == sorted(set(records(spark, files)))
    per_day = {r["partition"]: r["count"] for r in table.files().groupBy("partition").count().collect()}
    assert per_day == {"20210301": 1, "20210302": 1, "20210303": 1}


def test_target_size_gives_several_files(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "p")
    table.append(spark.range(20000).selectExpr("id", "hash(id) as h", "0 as p").repartition(12))
    result = table.compact(target_bytes=60_000, small_bytes=1 << 30)
    assert result.files_before == 12 and 1 < result.files_after < 12 and result.rows == 20000


def test_only_crowded_partitions_are_rewritten(spark, tmp_path, rows):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "p")
    table.append(spark.range(100).selectExpr("id", "'a' as p", "'x' as partition").repartition(5))
    table.append(spark.range(100).selectExpr("id", "'b' as p", "'x' as partition").coalesce(1))
    table.append(spark.range(50).selectExpr("id", "'a' as p", "'x' as partition").coalesce(1))
    untouched = rows(table.files().where("partition = 'b'"), "path", "modified")
    before = rows(table.read(), "id", "p")
    result = table.compact()
    assert (result.partitions, result.files_before, result.files_after, result.rows) == (1, 6, 1, 150)
    assert rows(table.read(), "id", "p") == before  # repeated rows stay repeated
    assert rows(table.files().where("partition = 'b'"), "path", "modified") == untouched
    assert table.compact() is None


def test_conflicts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    table = VersionedTable(spark, path, "p")
    table.append(spark.range(10).selectExpr("id", "1 as p").repartition(3))
    with pytest.raises(ConflictError):
        table.commit(0, {"operation": "append"})
    stage = VersionedTable._stage

    def interfere(self, *args):
        out = stage(self, *args)
        VersionedTable(spark, path, "p").append(spark.range(1).selectExpr("id", "1 as p"))
        return out

    monkeypatch.setattr(VersionedTable, "_stage", interfere)
    with pytest.raises(ConflictError):
        table.compact()
    assert table.read().count() == 11

    def foreign(self, *args):
        out = stage(self, *args)
        spark.range(5).selectExpr("id", "1 as p").write.mode("append").partitionBy("p").parquet(path)
        return out

    monkeypatch.setattr(VersionedTable, "_stage", foreign)
    with pytest.raises(ConflictError):
        table.compact()
    assert table.read().count() == 16


def test_recovery_after_a_lost_writer(spark, tmp_path, monkeypatch, rows):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "p")
    table.append(spark.range(30).selectExpr("id", "1 as p").repartition(4))
    replace = VersionedTable._replace

    def die(self, staged):
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, "_replace", die)
    with pytest.raises(KeyboardInterrupt):
        table.compact()
    monkeypatch.setattr(VersionedTable, "_replace", replace)
    with pytest.raises(ConflictError):
        table.compact()
    assert table.recover() and not table.recover()
    assert rows(table.read(), "id") == [(i,) for i in range(30)]
    assert table.files().count() == 1


def test_empty_input(spark, tmp_path):
    table = consolidate_raw_files(spark.createDataFrame([], FILES), f"file://{tmp_path}/t")
    assert table.read("src long, dst long, snapshot long").count() == 0
