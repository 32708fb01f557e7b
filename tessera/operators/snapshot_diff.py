"""What changed between consecutive full snapshots.

Every snapshot is reduced to one state per key.  A state enters the comparison
with its own date as new (+1) and with the following date as old (-1); the
signed sum over all columns is EXCEPT ALL in both directions at once and leaves
only the rows that differ.  The residues are full-joined by key and labelled.
States are partitioned by key alone, so the difference is taken where the
states already are; only its residues move again, for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.references import snapshot_number
from tessera.schema import pick
from tessera.session import materialize


def latest_states(
    rows: DataFrame,
    keys: tuple[str, ...] = ("src", "dst"),
    value: str = "edge_feature_0",
    time: str = "timestamp",
    loaded: str = "loaded_at",
) -> DataFrame:
    """One row per date and key: ``day, k0.., value``, the latest delivery.

    A later ``loaded`` wins, however late it is; a null one loses to any other.
    Of rows with equal ``loaded`` the largest value wins, null counting as the
    smallest and NaN as the largest.  Rows with a null time or key don't count.
    """
    rows = pick(rows, time, *keys, value, loaded)
    named = [F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    usable = rows.select(
        F.to_date(F.col(time)).alias("day"),
        *named,
        F.col(value).cast("double").alias("value"),
        F.col(loaded).cast("timestamp_ntz").alias("loaded"),
    ).where(" and ".join(f"{c} is not null" for c in ["day", *names]))
    return (
        usable.groupBy("day", *names)
        .agg(F.max(F.struct("loaded", "value")).alias("last"))
        .select("day", *names, F.col("last.value").alias("value"))
    )


def snapshot_changes(
    rows: DataFrame,
    keys: tuple[str, ...] = ("src", "dst"),
    value: str = "edge_feature_0",
    time: str = "timestamp",
    loaded: str = "loaded_at",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Keys added, removed or changed between consecutive dates.

    Returns ``snapshot, <keys>, change, old_value, new_value``; snapshot is the
    later date as ``yyyymmdd``.  Changed means that the value differs by more
    than ``tolerance`` or is null on one of the dates only.  Two NaN are equal,
    a NaN and a number differ.  The first date has no rows, so a table with one
    date, or none, gives an empty result.  Extra columns are ignored.
    """
    rows = pick(rows, time, *keys, value, loaded)
    names = [f"k{i}" for i in range(len(keys))]
    states = latest_states(rows, keys, value, time, loaded).repartition(*names)
    days = (
        rows.where(" and ".join(f"`{c}` is not null" for c in [time, *keys]))
        .groupBy(F.to_date(F.col(time)).alias("day"))
        .agg(F.lit(1).alias("one"))
        .select("day", F.lead("day").over(Window.orderBy("day")).alias("next"), F.lag("day").over(Window.orderBy("day")).alias("prev"))
    )
    # One row per calendar date of the table: bounded by the calendar, not by the rows.
    dated = states.join(F.broadcast(days), "day")
    signed = dated.select(
        *names,
        "value",
        F.explode(
            F.array(
                F.struct(F.when(F.col("prev").isNotNull(), F.col("day")).alias("at"), F.lit(1).alias("sign")),
                F.struct(F.col("next").alias("at"), F.lit(-1).alias("sign")),
            )
        ).alias("e"),
    ).select(*names, "value", F.col("e.at").alias("at"), F.col("e.sign").alias("sign")).where("at is not null")
    residue = signed.groupBy(*names, "at", "value").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    # Both sides of the join read the residue; it is far smaller than the states it comes from.
    residue = materialize(residue, "residue")
    new = residue.where("sign > 0").select(*names, "at", F.col("value").alias("new_value"), F.lit(True).alias("is_new"))
    old = residue.where("sign < 0").select(*names, "at", F.col("value").alias("old_value"), F.lit(True).alias("is_old"))
    joined = new.join(old, [*names, "at"], "full")
    differs = F.abs(F.col("new_value") - F.col("old_value")) > F.lit(tolerance)
    one_null = F.col("new_value").isNull() != F.col("old_value").isNull()
    change = (
        F.when(F.col("is_old").isNull(), "added")
        .when(F.col("is_new").isNull(), "removed")
        .when(one_null | differs, "changed")
    )
    return (
        joined.withColumn("change", change)
        .where("change is not null")
        .select(
            snapshot_number(F.col("at")).alias("snapshot"),
            *[F.col(n).alias(k) for n, k in zip(names, keys)],
            "change",
            "old_value",
            "new_value",
        )
    )
