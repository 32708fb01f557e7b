"""Queries of the general data problems over the test tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hot_keys import heavy_keys, key_stats
from tessera.operators.references import orphan_cases, orphan_references, orphan_report
from tessera.operators.snapshot_diff import snapshot_changes
from tessera.session import scratch_path
from tessera.sources.compaction import consolidate_raw_files

RECORD_SCHEMA = "src long, dst long, snapshot long"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_table(spark, sf_dir, "edge_df"), 0.02).select("side", "id")


def p1_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = key_stats(_table(spark, sf_dir, "edge_df"))
    return stats.withColumn("sum_value", F.round("sum_value", 4) + F.lit(0.0))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_cases(orphan_references(_table(spark, sf_dir, "edge_df"), _table(spark, sf_dir, "node_df")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("snapshot", "side", "id", "reason")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(_table(spark, sf_dir, "edge_df")).select("snapshot", "src", "dst", "change")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(_table(spark, sf_dir, "edge_df"))
    return changes.groupBy("snapshot", "change").agg(F.count(F.lit(1)).alias("n_edges"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = consolidate_raw_files(_table(spark, sf_dir, "raw_file"), scratch_path(spark, "raw-table"))
    return table.read(RECORD_SCHEMA).select("snapshot", "src", "dst")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_key_stats": p1_key_stats,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p5_found": p5_found,
        "p5_report": p5_report,
        "p6_found": p6_found,
    }


_P1_LONG = """
  SELECT 'src' AS side, src AS id, dst AS partner, edge_feature_0 AS v FROM edge_df WHERE src IS NOT NULL
  UNION ALL
  SELECT 'dst', dst, src, edge_feature_0 FROM edge_df WHERE dst IS NOT NULL
"""

_P3_CASES = """
WITH refs AS (
  SELECT CAST(strftime("timestamp", '%Y%m%d') AS BIGINT) AS snapshot, 'src' AS side, src AS id
  FROM edge_df WHERE "timestamp" IS NOT NULL AND src IS NOT NULL
  UNION ALL
  SELECT CAST(strftime("timestamp", '%Y%m%d') AS BIGINT), 'dst', dst
  FROM edge_df WHERE "timestamp" IS NOT NULL AND dst IS NOT NULL
), counted AS (
  SELECT snapshot, side, id, count(*) AS n_refs FROM refs GROUP BY ALL
), present AS (
  SELECT DISTINCT CAST(strftime("timestamp", '%Y%m%d') AS BIGINT) AS snapshot, id
  FROM node_df WHERE "timestamp" IS NOT NULL AND id IS NOT NULL
), lives AS (
  SELECT id, min(snapshot) AS born, max(snapshot) AS died FROM present GROUP BY id
), cases AS (
  SELECT c.snapshot, c.side, c.id, c.n_refs,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN l.died < c.snapshot THEN 'deleted'
         WHEN l.born > c.snapshot THEN 'late' ELSE 'gap' END AS reason
  FROM counted c
  LEFT JOIN lives l ON l.id = c.id
  WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.id = c.id AND p.snapshot = c.snapshot)
)
"""

_P5_CHANGES = """
WITH ranked AS (
  SELECT CAST("timestamp" AS DATE) AS day, src, dst, edge_feature_0 AS v,
    row_number() OVER (PARTITION BY CAST("timestamp" AS DATE), src, dst
                       ORDER BY loaded_at DESC NULLS LAST, edge_feature_0 DESC NULLS LAST) AS r
  FROM edge_df WHERE "timestamp" IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL
), state AS (
  SELECT day, src, dst, v FROM ranked WHERE r = 1
), days AS (
  SELECT day, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM state)
), old AS (
  SELECT d.next AS day, s.src, s.dst, s.v, TRUE AS here FROM state s JOIN days d ON d.day = s.day WHERE d.next IS NOT NULL
), new AS (
  SELECT s.day, s.src, s.dst, s.v, TRUE AS here FROM state s
  WHERE s.day > (SELECT min(day) FROM state)
), both_ways AS (
  SELECT coalesce(n.day, o.day) AS day, coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst,
    CASE WHEN o.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed'
         WHEN (o.v IS NULL) <> (n.v IS NULL) OR abs(o.v - n.v) > 0.000001 THEN 'changed' END AS change
  FROM new n FULL JOIN old o ON n.day = o.day AND n.src = o.src AND n.dst = o.dst
), changes AS (
  SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) AS snapshot, src, dst, change FROM both_ways WHERE change IS NOT NULL
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH long AS ({_P1_LONG})
SELECT side, id FROM long GROUP BY side, id
HAVING count(*) >= 0.02 * (SELECT count(*) FROM edge_df)
""",
        "p1_key_stats": f"""
WITH long AS ({_P1_LONG})
SELECT side, id, count(*) AS n_rows, count(DISTINCT partner) AS n_partners, round(sum(v), 4) + 0.0 AS sum_value
FROM long GROUP BY side, id
""",
        "p3_found": _P3_CASES + "SELECT snapshot, side, id, reason FROM cases",
        "p3_report": _P3_CASES
        + """SELECT side, snapshot, reason, count(*) AS n_ids, CAST(sum(n_refs) AS BIGINT) AS n_refs
FROM cases GROUP BY side, snapshot, reason""",
        "p5_found": _P5_CHANGES + "SELECT snapshot, src, dst, change FROM changes",
        "p5_report": _P5_CHANGES + "SELECT snapshot, change, count(*) AS n_edges FROM changes GROUP BY snapshot, change",
        "p6_found": r"""
WITH raw AS (
  SELECT CAST(regexp_extract(file_name, 'as(\d{8})\.txt$', 1) AS BIGINT) AS snapshot,
         string_split(regexp_replace(content, '^' || chr(65279), ''), chr(10)) AS lines
  FROM raw_file WHERE regexp_matches(file_name, '(^|/)as\d{8}\.txt$')
), cut AS (
  SELECT snapshot, unnest(lines) AS line, unnest(range(len(lines))) < len(lines) - 1 AS ended FROM raw
), clean AS (
  SELECT snapshot, CASE WHEN ended AND ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS line FROM cut
)
SELECT DISTINCT snapshot,
  CAST(regexp_extract(line, '^[ \t]*(\d+)[ \t]+(\d+)[ \t]*$', 1) AS BIGINT) - 1 AS src,
  CAST(regexp_extract(line, '^[ \t]*(\d+)[ \t]+(\d+)[ \t]*$', 2) AS BIGINT) - 1 AS dst
FROM clean WHERE regexp_full_match(line, '[ \t]*\d+[ \t]+\d+[ \t]*')
""",
    }
