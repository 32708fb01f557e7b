"""Mixing sources to target weights.

Capped water-filling: a source whose target needs more than its documents used
``max_repeats`` times is clamped there, and the weight it leaves is spread over
the others in proportion, until nobody is above its cap.  A source that gives r
times its size contributes every document floor(r) times and a seeded sample of
them once more.

The sample takes the same part of every size class, in the order of a seeded
hash, so short and long texts keep their proportion.  A class is drawn by one
hash threshold: sums by hash prefix lead down to it, two digits at a time, and
no rows are put in order.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import pick
from tessera.session import materialize

PREFIX_DIGITS = 2
HASH_DIGITS = 32
# A class has many texts if it has at least this part, one in so many, of its source's.
MANY_TEXTS = 20
# Comes after every hexadecimal digit.
BEYOND = "g"


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    max_repeats: int
    available: int


def water_fill(sources: list[Source], total: float) -> dict[str, float]:
    """Size that each source contributes to ``total``.

    Less than ``total`` comes out only when every source is at its cap.
    """
    given = {s.name: 0.0 for s in sources}
    left, weight = float(total), sum(s.share for s in sources if s.share > 0)
    # The source that is full at the lowest common level is clamped first.
    by_level = sorted((s for s in sources if s.share > 0), key=lambda s: (s.available * s.max_repeats / s.share, s.name))
    for k, s in enumerate(by_level):
        cap = float(s.available * s.max_repeats)
        if cap / s.share > left / weight:
            given |= {o.name: o.share * left / weight for o in by_level[k:]}
            break
        given[s.name] = cap
        left -= cap
        weight -= s.share
    return given


def read_targets(targets: DataFrame, sized: DataFrame, source: str, size: str) -> list[Source]:
    """Targets with the size their sources have; one row per listed source."""
    rows = pick(targets, "source", "target_share", "max_repeats").select(
        F.lower(F.trim("source")).alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap")
    ).where("name is not null")
    have = sized.groupBy(F.lower(F.trim(F.col(source))).alias("name")).agg(F.sum(size).alias("available"))
    found = rows.join(have, "name", "left").collect()
    names = [r["name"] for r in found]
    if len(set(names)) != len(names):
        raise ValueError("a source is listed twice")
    if any(r["share"] < 0 or r["cap"] < 0 for r in found):
        raise ValueError("shares and repeats must not be negative")
    return [Source(r["name"], r["share"], int(r["cap"]), int(r["available"] or 0)) for r in found]


def mix(
    sized: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    seed: int = 1,
    key: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
) -> tuple[DataFrame, list[dict]]:
    """Documents of the mixture with the number of their uses, and the plan of each source.

    ``sized`` has a unique key, a source and a size per document; ``targets``
    has ``source, target_share, max_repeats``.  Sources are compared trimmed
    and in lower case.  ``total`` is the wanted size, by default that of all
    documents of listed sources.  The first result has ``key, source,
    n_tokens, uses``, one row per document that is used.

    Documents of other or null sources, and those of size 0 or null, have
    nothing to give and are not used.  A listed source without documents gives
    nothing and its weight goes to the others.  The part of a source that is
    used once more is drawn from each size class in the order of a seeded
    hash; it depends on seed, keys and sizes only, not on partitioning.
    Repeated rows of a key are drawn together.
    """
    usable = pick(sized, key, source, size).select(
        F.col(key).alias("key"), F.lower(F.trim(F.col(source))).alias("source"), F.col(size).cast("long").alias("n_tokens")
    ).where("n_tokens > 0 and source is not null")
    sources = read_targets(targets, usable, "source", "n_tokens")
    total = sum(s.available for s in sources) if total is None else total
    given = water_fill(sources, total)
    plans = []
    for s in sources:
        repeats = given[s.name] / s.available if s.available else 0.0
        whole = min(int(repeats + 1e-9), s.max_repeats)
        part = max(0, int(given[s.name] - whole * s.available + 1e-6)) if whole < s.max_repeats else 0
        plans.append(
            {"source": s.name, "target_share": s.share, "max_repeats": s.max_repeats, "available": s.available, "wanted": given[s.name], "whole": whole, "part": part,
             "clamped": bool(s.share > 0 and given[s.name] >= s.available * s.max_repeats)}
        )
    spark = sized.sparkSession
    # One row per listed source.
    plan_rows = spark.createDataFrame([(p["source"], p["whole"], p["part"]) for p in plans], "source string, whole int, part long")
    hashed = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("key").cast("string")))
    listed = usable.join(F.broadcast(plan_rows), "source").withColumn("stratum", F.length(F.bin("n_tokens"))).withColumn("h", hashed)
    draws = _draws(materialize(listed.where("part > 0").select("source", "stratum", "h", "n_tokens"), "mix"), plans)
    # At most 64 size classes per listed source.
    limits = spark.createDataFrame([(*g, limit) for g, (limit, _) in draws.items()], "source string, stratum int, drawn_below string")
    extra = F.coalesce((F.col("h") < F.col("drawn_below")).cast("int"), F.lit(0))
    used = listed.join(F.broadcast(limits), ["source", "stratum"], "left").withColumn("uses", F.col("whole") + extra).where("uses > 0")
    return used.select(F.col("key").alias(key), "source", "n_tokens", "uses"), plans


Group = tuple[str, int]


def _draws(listed: DataFrame, plans: list[dict]) -> dict[Group, tuple[str, int]]:
    """Hash limit of each (source, size class) and the size drawn below it.

    Every class of a source is to give the same part of what it has.  Whole
    texts miss that by up to half a text each.  What is missing then in total
    is spread over the classes with many texts in proportion to their sizes,
    and the little that their whole texts leave of it goes to the class with
    most texts.
    """
    tree = _PrefixSums(listed)
    roots = tree.roots()
    have = {g: sum(t for _, t, _ in children) for g, children in roots.items()}
    texts = {g: sum(n for _, _, n in children) for g, children in roots.items()}
    by_source: dict[str, list[Group]] = {p["source"]: [] for p in plans}
    for g in have:
        by_source[g[0]].append(g)
    part = {p["source"]: p["part"] for p in plans}
    draws = _descend(tree, {g: have[g] * p["part"] // p["available"] for p in plans for g in by_source[p["source"]]})

    def missing(source: str) -> int:
        return part[source] - sum(draws[g][1] for g in by_source[source])

    spread = {}
    for source, classes in by_source.items():
        many = [g for g in classes if texts[g] * MANY_TEXTS >= sum(texts[c] for c in classes)]
        size, gap = sum(have[g] for g in many), missing(source)
        for g in many if gap else []:
            step = abs(gap) * have[g] // size
            spread[g] = max(0, min(have[g], draws[g][1] + (step if gap > 0 else -step)))
    draws |= _descend(tree, spread)
    last = {}
    for source, classes in by_source.items():
        gap = missing(source)
        able = [g for g in classes if 0 <= draws[g][1] + gap <= have[g]]
        if gap and able:
            best = max(able, key=lambda g: (texts[g], g[1]))
            last[best] = draws[best][1] + gap
    return draws | _descend(tree, last)


class _PrefixSums:
    """Sizes by hash prefix of each (source, size class), read level by level where they are needed."""

    def __init__(self, listed: DataFrame):
        self.listed = listed
        self.known: dict[tuple[Group, str], list[tuple[str, int, int]]] = {}

    def roots(self) -> dict[Group, list[tuple[str, int, int]]]:
        self._read(self.listed, 0)
        return {g: children for (g, prefix), children in self.known.items() if not prefix}

    def load(self, nodes: Iterable[tuple[Group, str]]) -> None:
        """All nodes have prefixes of one length; each has at most 16 ** PREFIX_DIGITS children."""
        new = [n for n in nodes if n not in self.known]
        if new:
            length = len(new[0][1])
            at = self.listed.sparkSession.createDataFrame([(*g, prefix) for g, prefix in new], "source string, stratum int, at string")
            inside = self.listed.withColumn("at", F.substring("h", 1, length)).join(F.broadcast(at), ["source", "stratum", "at"], "left_semi")
            self._read(inside, length)

    def _read(self, rows: DataFrame, length: int) -> None:
        below = F.substring("h", 1, length + PREFIX_DIGITS).alias("child")
        for r in rows.groupBy("source", "stratum", below).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            self.known.setdefault(((r["source"], r["stratum"]), r["child"][:length]), []).append((r["child"], r["t"], r["n"]))


def _descend(tree: _PrefixSums, wanted: dict[Group, int]) -> dict[Group, tuple[str, int]]:
    """The limit below which a class has the wanted size, to the nearest text, and the size it has there."""
    done: dict[Group, tuple[str, int]] = {}
    open_groups = {g: ("", 0) for g in wanted}
    while open_groups:
        tree.load([(g, prefix) for g, (prefix, _) in open_groups.items()])
        deeper = {}
        for g, (prefix, taken) in open_groups.items():
            limit = prefix + BEYOND
            for child, t, n in sorted(tree.known[g, prefix]):
                if taken + t <= wanted[g]:
                    taken += t
                    continue
                if n > 1 and len(child) < HASH_DIGITS:
                    deeper[g] = child, taken
                    break
                # One text, or repeated rows of one key: in or out, whichever is nearer.
                nearer = taken + t - wanted[g] < wanted[g] - taken
                limit, taken = (child + BEYOND, taken + t) if nearer else (child, taken)
                break
            if g not in deeper:
                done[g] = limit, taken
        open_groups = deeper
    return done


def expand_uses(used: DataFrame) -> DataFrame:
    """One row per use, with ``copy_no`` from 1."""
    return used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("uses")))).drop("uses")


def share_report(used: DataFrame, plans: list[dict]) -> DataFrame:
    """``source, target_share, max_repeats, available, n_docs, n_tokens, actual_share, clamped`` of each listed source."""
    spark = used.sparkSession
    rows = spark.createDataFrame(
        [(p["source"], float(p["target_share"]), int(p["max_repeats"]), int(p["available"]), p["clamped"]) for p in plans],
        "source string, target_share double, max_repeats int, available long, clamped boolean",
    )
    got = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens")
    )
    joined = rows.join(got, "source", "left").fillna(0, ["n_docs", "most_uses", "n_tokens"])
    everything = Window.partitionBy()
    # One row per listed source.
    total = F.sum("n_tokens").over(everything)
    return joined.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))
