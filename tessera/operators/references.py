"""References to records that do not exist.

Parent and child keys are stacked in one long table, tagged, and grouped by
parent table and key; a group without a parent row is an orphan.  Counting is
done in the same aggregate, so a key that most rows refer to is reduced to one
row per input task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import pick


def snapshot_number(timestamp) -> F.Column:
    """The calendar date of a timestamp as a bigint ``yyyymmdd``."""
    day = F.to_date(timestamp)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")


@dataclass(frozen=True)
class Parent:
    """A parent table with its key and time column."""

    table: DataFrame
    key: str = "id"
    time: str = "timestamp"


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_columns: tuple[str, ...] = ("src", "dst"),
    child_time: str = "timestamp",
    parent_key: str = "id",
    parent_time: str = "timestamp",
) -> DataFrame:
    """Each key referred to on a date on which the parent table lacks it.

    Returns ``snapshot, id, reason`` and one count column ``n_<column>`` per
    child column with the number of referring rows.  ``reason`` comes from the
    dates on which the parent table has the key: ``missing`` none, ``deleted``
    only earlier ones, ``late`` only later ones, ``gap`` both.

    * Child rows without a time and null references refer to nothing.  The
      other columns of such a row still count.
    * Parent rows with a null time or key don't count; repeated ones count once.
    * An empty parent table makes every reference ``missing``; an empty child
      table gives no rows.  Extra columns are ignored.
    """
    only = {"parent": Parent(parents, parent_key, parent_time)}
    return orphans_by_parent(children, {c: "parent" for c in child_columns}, only, child_time).drop("parent_table")


def orphans_by_parent(children: DataFrame, references: dict[str, str], parents: dict[str, Parent], child_time: str = "timestamp") -> DataFrame:
    """The same for several parent tables in one pass: ``parent_table, snapshot, id, reason`` and the counts.

    ``references`` names the parent table of each child column.  The keys of
    all tables are stacked and grouped by parent table and key.
    """
    unknown = set(references.values()) - set(parents)
    if unknown:
        raise ValueError(f"references to unknown parent tables {sorted(unknown)}")
    children = pick(children, child_time, *references)
    counts = [f"n_{c}" for c in references]
    several = len(parents) > 1
    # With one parent table its name is no part of the key that is shuffled.
    keys = ["parent_no", "id"] if several else ["id"]
    number = {name: k for k, name in enumerate(parents)}
    lived = None
    for name, p in parents.items():
        rows = pick(p.table, p.time, p.key).select(F.lit(number[name]).alias("parent_no"), F.col(p.key).cast("long").alias("id"), F.to_date(F.col(p.time)).alias("day"))
        lived = rows if lived is None else lived.unionByName(rows)
    lived = lived.where("id is not null and day is not null")
    tagged = lived.select("*", F.lit(1).alias("parent"), *[F.lit(0).cast("long").alias(c) for c in counts])
    for column, count in zip(references, counts):
        tagged = tagged.unionByName(
            children.select(
                F.lit(number[references[column]]).alias("parent_no"),
                F.col(column).cast("long").alias("id"),
                F.to_date(F.col(child_time)).alias("day"),
                F.lit(0).alias("parent"),
                *[F.lit(int(c == count)).cast("long").alias(c) for c in counts],
            ).where("id is not null and day is not null")
        )
    groups = tagged.groupBy(*keys, "day").agg(F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in counts])
    orphans = groups.where("parent = 0")
    # The parent keys alone are read once more: taking their dates from the groups would shuffle all groups again.
    lives = lived.groupBy(*keys).agg(F.min("day").alias("born"), F.max("day").alias("died"))
    reason = (
        F.when(F.col("born").isNull(), "missing")
        .when(F.col("died") < F.col("day"), "deleted")
        .when(F.col("born") > F.col("day"), "late")
        .otherwise("gap")
    )
    names = F.lit(next(iter(parents)))
    for name, k in number.items() if several else ():
        names = F.when(F.col("parent_no") == k, name).otherwise(names)
    return orphans.join(lives, keys, "left").select(
        names.alias("parent_table"), snapshot_number(F.col("day")).alias("snapshot"), "id", reason.alias("reason"), *counts
    )


def orphan_cases(orphans: DataFrame, child_columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """One row per ``snapshot, side, id`` with its reason and referring rows."""
    sides = ", ".join(f"'{c}', n_{c}" for c in child_columns)
    return orphans.selectExpr(
        "snapshot", f"stack({len(child_columns)}, {sides}) as (side, n_refs)", "id", "reason"
    ).where("n_refs > 0")


def orphan_report(cases: DataFrame) -> DataFrame:
    """Orphan keys and referring rows per side, snapshot and reason."""
    return cases.groupBy("side", "snapshot", "reason").agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum("n_refs").alias("n_refs")
    )
