"""Queries of the text and vector problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.markov import cluster_report, majority_labels, vector_clusters
from tessera.llm.mixing import expand_uses, mix, share_report
from tessera.llm.packing import class_report, pack, packing_audit, packing_report
from tessera.llm.quantised_search import nearest_neighbours, neighbour_pairs
from tessera.llm.residue import answer_evidence, copied_bodies, find_residue, without_residue
from tessera.llm.tokens import with_token_counts
from tessera.llm.vectors import node_vectors
from tessera.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_clusters(node_vectors(_table(spark, sf_dir, "patch"))).select("cluster_node", "node")


def p2_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = vector_clusters(node_vectors(_table(spark, sf_dir, "patch")))
    return cluster_report(clusters)


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = materialize(vector_clusters(node_vectors(_table(spark, sf_dir, "patch"))), "clusters")
    typical = cluster_report(clusters).join(clusters.select("cluster_node", "node", F.lit(1).alias("inside")), ["cluster_node", "node"], "left")
    return typical.groupBy("cluster_node", "size").agg(
        F.count(F.lit(1)).alias("n_typical"), F.countDistinct("node").alias("n_nodes"), F.sum(F.coalesce("inside", F.lit(0))).alias("n_inside")
    )


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = vector_clusters(node_vectors(_table(spark, sf_dir, "patch")))
    return majority_labels(clusters, _table(spark, sf_dir, "node_df"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest_neighbours(node_vectors(_table(spark, sf_dir, "patch")), 5))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in tokens; texts are tokenised once."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return materialize(with_token_counts(documents).drop("text"), "token-counts")


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    # A parameter table of a few rows.
    rows = _table(spark, sf_dir, "pack_size").where("pack_name is not null and capacity > 0").orderBy("capacity", "pack_name").collect()
    return [(r["pack_name"], r["capacity"]) for r in rows]


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir), _capacities(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = _capacities(spark, sf_dir)
    return packing_report(pack(_sized(spark, sf_dir), capacities), capacities)


def _sized_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in characters, which SQL can count as well."""
    return _table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_tokens"))


def p7_pieces_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_sized_chars(spark, sf_dir), _capacities(spark, sf_dir))
    return packed.select("pack_name", "doc_id", "piece", "start", "n_tokens")


def p7_audit_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = _capacities(spark, sf_dir)
    return packing_audit(pack(_sized_chars(spark, sf_dir), capacities), capacities)


def p7_plain_classes_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_sized_chars(spark, sf_dir), _capacities(spark, sf_dir), refined=False)
    return class_report(packed.where("class_bound > 0"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = mix(_sized(spark, sf_dir), _table(spark, sf_dir, "mix_target"))
    return expand_uses(used)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, plans = mix(_sized(spark, sf_dir), _table(spark, sf_dir, "mix_target"))
    return share_report(used, plans)


def p8_mix_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = mix(_sized_chars(spark, sf_dir), _table(spark, sf_dir, "mix_target"))
    return expand_uses(used)


def p8_shares_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, plans = mix(_sized_chars(spark, sf_dir), _table(spark, sf_dir, "mix_target"))
    return share_report(used, plans)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(_table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"))


def p9_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted evidence of every text; the grammar is tested on wordings."""
    answers = materialize(answer_evidence(_table(spark, sf_dir, "documents")), "answers")
    n_slugs = F.coalesce("n_slugs", F.lit(1)).alias("n_slugs")
    return answers.join(copied_bodies(answers), "body", "left").select(F.col("key").alias("doc_id"), "n_words", "mismatch", n_slugs)


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(_table(spark, sf_dir, "documents")).select("doc_id", "title", "text", "source", "item_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_typical": p2_typical,
        "p2_sizes": p2_sizes,
        "p2_labels": p2_labels,
        "p4_found": p4_found,
        "p7_packed": p7_packed,
        "p7_report": p7_report,
        "p7_pieces_chars": p7_pieces_chars,
        "p7_audit_chars": p7_audit_chars,
        "p7_plain_classes_chars": p7_plain_classes_chars,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p8_mix_chars": p8_mix_chars,
        "p8_shares_chars": p8_shares_chars,
        "p9_found": p9_found,
        "p9_answers": p9_answers,
        "p9_clean": p9_clean,
    }


_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT node, patch_id, coordinates AS v FROM patch
  WHERE node IS NOT NULL AND len(coordinates) = 8
    AND len(list_filter(coordinates, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(coordinates, lambda x: x <> 0)) > 0
), vectors AS MATERIALIZED (
  SELECT node, arg_min(v, patch_id)::DOUBLE[8] AS v FROM usable GROUP BY node
)"""

_GROUPS = (
    _VECTORS
    + """, named AS (
  SELECT a.node, min(b.node) AS cluster_node, count(*) AS size
  FROM vectors a JOIN vectors b ON array_distance(a.v, b.v) <= 2.0
  GROUP BY a.node
)"""
)


_ANSWERS = r"""
WITH forms AS (
  SELECT doc_id, coalesce(item_id, '') AS slug,
    trim(regexp_replace(regexp_replace(lower(text), '\p{L}*\p{N}[\p{L}\p{N}]*', ' ', 'g'), '[^\p{L}]+', ' ', 'g')) AS form,
    trim(regexp_replace(regexp_replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(item_id, ''))), '\p{L}*\p{N}[\p{L}\p{N}]*', ' ', 'g'), '[^\p{L}]+', ' ', 'g')) AS asked
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT doc_id, slug, form,
    CASE WHEN form = '' THEN [] ELSE list_distinct(string_split(form, ' ')) END AS words,
    CASE WHEN asked = '' THEN [] ELSE list_distinct(string_split(asked, ' ')) END AS asked
  FROM forms
), copies AS (
  SELECT form, count(DISTINCT slug) AS n_slugs FROM words WHERE form <> '' GROUP BY form
)
SELECT doc_id, len(words) AS n_words, coalesce(n_slugs, 1) AS n_slugs,
  CASE WHEN len(asked) = 0 THEN 1.0 ELSE (len(asked) - len(list_intersect(asked, words))) / len(asked) END::DOUBLE AS mismatch
FROM words w LEFT JOIN copies c ON c.form = w.form"""

_PIECES = """
WITH sized AS (
  SELECT doc_id, coalesce(length(text), 0) AS n FROM documents
), packs AS (
  SELECT pack_name, capacity::BIGINT AS capacity FROM pack_size WHERE pack_name IS NOT NULL AND capacity > 0
), pieces AS (
  SELECT pack_name, capacity, doc_id, piece, piece * capacity AS start, least(capacity, n - piece * capacity) AS n_tokens
  FROM (
    SELECT *, unnest(range(greatest(1, (n + capacity - 1) // capacity))) AS piece FROM sized, packs
  )
)"""

# The plain classes of a block take capacity // size texts a bin; a block's number comes from the same hash digits.
_PLAIN_CLASSES = (
    _PIECES
    + """, blocks AS (
  SELECT pack_name, greatest(1, (count(*) + 32767) // 32768) AS n_blocks FROM pieces GROUP BY pack_name
), dealt AS (
  SELECT p.pack_name, capacity // n_tokens AS each, n_tokens, capacity // (capacity // n_tokens) AS class_bound,
    ('0x' || substr(md5(doc_id || ':' || piece), 1, 7))::BIGINT % n_blocks AS block
  FROM pieces p JOIN blocks b ON b.pack_name = p.pack_name WHERE n_tokens > 0
), per_block AS (
  SELECT pack_name, class_bound, each, block, count(*) AS n, sum(n_tokens) AS t FROM dealt GROUP BY ALL
)
SELECT pack_name, class_bound, sum(n)::BIGINT AS n_items, sum((n + each - 1) // each)::BIGINT AS n_bins, sum(t)::BIGINT AS n_tokens
FROM per_block GROUP BY ALL"""
)

_MIX = """
WITH usable AS (
  SELECT doc_id, lower(trim(source)) AS source, length(text) AS n, length(bin(length(text))) AS stratum, md5('1:' || doc_id) AS h
  FROM documents WHERE source IS NOT NULL AND length(text) > 0
), targets AS (
  SELECT lower(trim(source)) AS source, coalesce(target_share, 0) AS share, coalesce(max_repeats, 1) AS cap
  FROM mix_target WHERE source IS NOT NULL
), sources AS (
  SELECT t.source, any_value(share) AS share, any_value(cap) AS cap, coalesce(sum(n), 0)::BIGINT AS available
  FROM targets t LEFT JOIN usable u ON u.source = t.source GROUP BY t.source
), levels AS (
  SELECT *, (SELECT sum(available) FROM sources) - coalesce(sum(available * cap) OVER before, 0) AS size_left,
    (SELECT sum(share) FROM sources) - coalesce(sum(share) OVER before, 0) AS share_left,
    row_number() OVER (ORDER BY available * cap / share, source) AS k
  FROM sources WHERE share > 0
  WINDOW before AS (ORDER BY available * cap / share, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fill AS (
  SELECT min(k) AS k, arg_min(size_left / share_left, k) AS level FROM levels WHERE available * cap / share > size_left / share_left
), given AS (
  SELECT source, share, cap, available,
    CASE WHEN share <= 0 THEN 0 WHEN l.k < coalesce(f.k, 1000000) THEN available * cap ELSE share * f.level END AS wanted
  FROM (SELECT s.*, l.k FROM sources s LEFT JOIN levels l ON l.source = s.source) l, fill f
), plans AS (
  SELECT *, share > 0 AND wanted >= available * cap AS clamped,
    CASE WHEN whole < cap THEN greatest(0, floor(wanted - whole * available + 1e-6)::BIGINT) ELSE 0 END AS part
  FROM (SELECT *, CASE WHEN available > 0 THEN least(floor(wanted / available + 1e-9)::BIGINT, cap) ELSE 0 END AS whole FROM given)
), upto AS (
  SELECT u.*, p.part, p.available, sum(n) OVER (PARTITION BY u.source, stratum ORDER BY h) AS upto
  FROM usable u JOIN plans p ON p.source = u.source WHERE p.part > 0
), first_wants AS (
  SELECT source, stratum, sum(n)::BIGINT AS have, count(*) AS texts, any_value(part) AS part,
    (sum(n)::HUGEINT * any_value(part) // any_value(available))::BIGINT AS wanted
  FROM upto GROUP BY ALL
), first_got AS (
  SELECT w.source, w.stratum, w.have, w.texts, w.part, w.wanted,
    coalesce(sum(n) FILTER (u.upto <= wanted OR (u.upto - n <= wanted AND u.upto - wanted < wanted - (u.upto - n))), 0)::BIGINT AS got
  FROM first_wants w JOIN upto u ON u.source = w.source AND u.stratum = w.stratum GROUP BY ALL
), missing AS (
  SELECT *, part - sum(got) OVER (PARTITION BY source) AS missing, texts * 20 >= sum(texts) OVER (PARTITION BY source) AS many FROM first_got
), spread AS (
  SELECT *, CASE WHEN many AND missing <> 0
    THEN greatest(0, least(have, got + sign(missing) * (abs(missing)::HUGEINT * have // sum(have) FILTER (many) OVER (PARTITION BY source))))::BIGINT ELSE wanted END AS again
  FROM missing
), second_got AS (
  SELECT w.source, w.stratum, w.have, w.texts, w.part, w.again,
    coalesce(sum(n) FILTER (u.upto <= again OR (u.upto - n <= again AND u.upto - again < again - (u.upto - n))), 0)::BIGINT AS got
  FROM spread w JOIN upto u ON u.source = w.source AND u.stratum = w.stratum GROUP BY ALL
), gaps AS (
  SELECT *, got + gap BETWEEN 0 AND have AS able FROM (SELECT *, part - sum(got) OVER (PARTITION BY source) AS gap FROM second_got)
), wants AS (
  SELECT source, stratum, CASE WHEN gap <> 0 AND able AND r = 1 THEN got + gap ELSE again END AS wanted
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY able DESC, texts DESC, stratum DESC) AS r FROM gaps)
), extras AS (
  SELECT u.doc_id FROM upto u JOIN wants w ON w.source = u.source AND w.stratum = u.stratum
  WHERE u.upto <= wanted OR (u.upto - n <= wanted AND u.upto - wanted < wanted - (u.upto - n))
), used AS (
  SELECT u.doc_id, u.source, u.n AS n_tokens, p.whole + (e.doc_id IS NOT NULL)::INT AS uses
  FROM usable u JOIN plans p ON p.source = u.source LEFT JOIN extras e ON e.doc_id = u.doc_id
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_pieces_chars": _PIECES + " SELECT pack_name, doc_id, piece, start, n_tokens FROM pieces",
        "p7_audit_chars": _PIECES
        + """
SELECT pack_name, count(*) AS n_items, sum(n_tokens)::BIGINT AS n_tokens, 0 AS n_over, 0 AS n_misfits, 0 AS n_off_pattern FROM pieces GROUP BY pack_name""",
        "p7_plain_classes_chars": _PLAIN_CLASSES,
        "p9_answers": _ANSWERS,
        "p8_mix_chars": _MIX + " SELECT doc_id, source, n_tokens, unnest(range(1, uses + 1)) AS copy_no FROM used WHERE uses > 0",
        "p8_shares_chars": _MIX
        + """, per_source AS (
  SELECT source, count(*) AS n_docs, max(uses) AS most_uses, sum(uses * n_tokens)::BIGINT AS n_tokens FROM used WHERE uses > 0 GROUP BY source
), joined AS (
  SELECT p.source, p.share AS target_share, p.cap AS max_repeats, p.available, p.clamped,
    coalesce(n_docs, 0) AS n_docs, coalesce(most_uses, 0) AS most_uses, coalesce(n_tokens, 0) AS n_tokens
  FROM plans p LEFT JOIN per_source s ON s.source = p.source
)
SELECT *, n_tokens / sum(n_tokens) OVER () AS actual_share FROM joined""",
        "p2_sizes": _GROUPS
        + " SELECT DISTINCT cluster_node, size, 3 AS n_typical, 3 AS n_nodes, 3 AS n_inside FROM named WHERE size >= 10",
        "p2_found": _GROUPS + " SELECT cluster_node, node FROM named WHERE size >= 10",
        "p4_found": _VECTORS
        + """, near AS (
  SELECT a.node AS node, b.node AS other,
    row_number() OVER (PARTITION BY a.node ORDER BY array_distance(a.v, b.v), b.node) AS r
  FROM vectors a JOIN vectors b ON a.node <> b.node
)
SELECT DISTINCT least(node, other) AS node_a, greatest(node, other) AS node_b FROM near WHERE r <= 5""",
        "p2_labels": _GROUPS
        + """, counts AS (
  SELECT n.cluster_node, d.y, count(*) AS n_rows
  FROM named n JOIN node_df d ON d.id = n.node WHERE n.size >= 10 AND d.y IS NOT NULL GROUP BY ALL
), best AS (
  SELECT cluster_node, y, n_rows, row_number() OVER (PARTITION BY cluster_node ORDER BY n_rows DESC, y) AS r FROM counts
)
SELECT g.cluster_node, g.size, b.y, b.n_rows
FROM (SELECT DISTINCT cluster_node, size FROM named WHERE size >= 10) g
LEFT JOIN best b ON b.cluster_node = g.cluster_node AND b.r = 1""",
    }
