"""Filling containers of fixed capacity with texts.

Harmonic packing.  Texts fall into size classes whose upper bounds are the
capacity divided by 1, 2, 3, ..., and a bin takes a fixed number of texts of a
class, whatever their exact sizes.  Plain harmonic packing gives a bin one
class only and leaves up to half of it empty where a text is just above half
the capacity.  Refined classes mend that: the gaps between the reciprocals are
cut further, and a bin follows a pattern, a fixed number of texts of each of
several classes whose upper bounds fit together.

Patterns are planned ahead from the number of texts in each class, class by
class and bound by bound; no single text is looked at.  Then the n-th text of a
class goes to the n-th place that the plan has for it.  Texts are dealt to
blocks of bounded size by a hash, and each block is planned and packed on its
own: no order, count or bin is shared between workers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import pick

BLOCK_ITEMS = 32_768
_BIN_BITS = 24
# Neighbouring class bounds differ by at most this part.
REFINEMENT = 64


def class_bounds(capacity: int, refined: bool = True) -> np.ndarray:
    """Upper bounds of the size classes, ascending: the capacity over 1, 2, 3, ..., and steps between them if refined."""
    reciprocals = {capacity // j for j in range(1, int(np.sqrt(capacity)) + 1)} | set(range(1, int(np.sqrt(capacity)) + 1))
    bounds, at = sorted(x for x in reciprocals if x), capacity
    if refined:
        steps = []
        while at > 0:
            steps.append(at)
            at = min(at - 1, at - at // REFINEMENT)
        bounds = sorted({*bounds, *steps})
    return np.array(bounds, np.int64)


class _Plan:
    """Ranges of bins with one pattern each: first bin, number of bins and space that no class has reserved."""

    def __init__(self) -> None:
        self.first, self.n, self.free = (np.zeros(0, np.int64) for _ in range(3))
        self.n_bins = 0

    def place(self, n: int, bound: int, capacity: int, fill: bool) -> list[np.ndarray]:
        """Places for n texts of one class: arrays of first bins, numbers of bins and texts a bin.

        A range that is needed in part is cut, so all bins of a range keep one
        pattern.  Ranges with the least space are filled first.
        """
        places = []
        if fill and len(self.first):
            order = np.argsort(self.free, kind="stable")
            each = self.free[order] // bound
            order, each = order[each > 0], each[each > 0]
            upto = np.cumsum(self.n[order] * each)
            whole = int(np.searchsorted(upto, n, side="right"))
            chosen = order[:whole]
            places.append(np.stack([self.first[chosen], self.n[chosen], each[:whole]]))
            self.free[chosen] -= each[:whole] * bound
            n -= int(upto[whole - 1]) if whole else 0
            if n and whole < len(order):
                places += self._part(int(order[whole]), int(each[whole]), n, bound)
                n = 0
        if n:
            self._open(-(-n // (capacity // bound)), capacity)
            places += self._part(len(self.first) - 1, capacity // bound, n, bound)
        return places

    def _open(self, n: int, capacity: int) -> None:
        self.first, self.n, self.free = np.append(self.first, self.n_bins), np.append(self.n, n), np.append(self.free, capacity)
        self.n_bins += n

    def _part(self, at: int, each: int, n: int, bound: int) -> list[np.ndarray]:
        """Put n texts into the first bins of a range, each of them full but the last."""
        first, left = int(self.first[at]), int(self.n[at])
        free = int(self.free[at])
        cuts = [(n // each, each), (int(n % each > 0), n % each)]
        cuts = [(m, k) for m, k in cuts if m] + [(left - sum(m for m, _ in cuts), 0)]
        ranges = [(first + sum(m for m, _ in cuts[:i]), m, k) for i, (m, k) in enumerate(cuts) if m]
        columns = np.array(ranges, np.int64).reshape(-1, 3).T
        keep = np.arange(len(self.first)) != at
        self.first = np.append(self.first[keep], columns[0])
        self.n = np.append(self.n[keep], columns[1])
        self.free = np.append(self.free[keep], free - columns[2] * bound)
        return [columns[:, columns[2] > 0]]


def harmonic_bins(sizes: np.ndarray, capacity: int, refined: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, pattern and class bound of each item of sizes 0..capacity; bins are numbered from 0.

    A pattern is named by its first bin.  Plain harmonic packing without
    ``refined``.  Items of size 0 have the bound 0 and are spread over the bins.
    """
    bounds = class_bounds(capacity, refined)
    kind = np.searchsorted(bounds, sizes)
    bins = np.zeros(len(sizes), np.int64)
    order = np.argsort(kind, kind="stable")
    order = order[sizes[order] > 0]
    counts = np.bincount(kind[order], minlength=len(bounds))
    ends = np.cumsum(counts)
    plan = _Plan()
    for c in np.flatnonzero(counts)[::-1]:
        items = order[ends[c] - counts[c] : ends[c]]
        first, n_bins, each = np.concatenate(plan.place(len(items), int(bounds[c]), capacity, refined), axis=1)
        upto = np.cumsum(n_bins * each)
        rank = np.arange(len(items))
        at = np.searchsorted(upto, rank, side="right")
        bins[items] = first[at] + (rank - (upto[at] - n_bins[at] * each[at])) // each[at]
    nothing = np.flatnonzero(sizes == 0)
    bins[nothing] = np.arange(len(nothing)) % max(1, plan.n_bins)
    starts = np.sort(plan.first) if plan.n_bins else np.zeros(1, np.int64)
    pattern = starts[np.searchsorted(starts, bins, side="right") - 1]
    return bins, pattern, np.where(sizes > 0, bounds[np.minimum(kind, len(bounds) - 1)], 0)


def packing_items(sized: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``pack_name, capacity, key, piece, start, n_tokens``: what has to be placed.

    Only a text larger than the capacity is split, into full pieces and one
    rest.  An empty text is one item of size 0.
    """
    packs = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in capacities])
    each = pick(sized, key, size).select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.explode(packs).alias("p")).select(
        "key", "size", "p.*"
    )
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("capacity")) - 1)
    return each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "pack_name",
        "capacity",
        "key",
        "piece",
        (F.col("piece") * F.col("capacity")).alias("start"),
        F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
    )


def pack(
    sized: DataFrame,
    capacities: list[tuple[str, int]],
    key: str = "doc_id",
    size: str = "n_tokens",
    block_items: int = BLOCK_ITEMS,
    refined: bool = True,
) -> DataFrame:
    """``pack_name, bin, pattern, class_bound, key, piece, start, n_tokens``: every text in a bin of each capacity.

    ``sized`` holds one row per text with its key and size; repeated rows are
    packed as often as they come.  Capacities are named and positive.  Every
    token of every text is in exactly one bin of each capacity, no bin holds
    more than its capacity, and only larger texts are split.  Null sizes count
    as 0 and texts of size 0 are placed too.  An empty table has no bins.
    Bins of one ``pattern`` hold the same number of texts of each
    ``class_bound``, apart from those of size 0, and the bounds of a bin's
    texts sum up to the capacity at most.
    """
    if len({n for n, _ in capacities}) != len(capacities) or any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities need different names and positive sizes")
    columns = "pack_name string, bin long, pattern long, class_bound long, key long, piece long, start long, n_tokens long"
    if not capacities:
        return sized.sparkSession.createDataFrame([], columns).withColumnRenamed("key", key)
    items = packing_items(sized, capacities, key, size)
    counts = items.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n"))
    # One row per capacity.
    blocks = {r["pack_name"]: max(1, -(-r["n"] // block_items)) for r in counts.collect()}
    n_blocks = F.lit(1)
    for name, n in blocks.items():
        n_blocks = F.when(F.col("pack_name") == name, F.lit(n)).otherwise(n_blocks)
    digits = F.substring(F.md5(F.concat_ws(":", F.col("key").cast("string"), F.col("piece").cast("string"))), 1, 7)
    dealt = items.withColumn("block", F.conv(digits, 16, 10).cast("long") % n_blocks)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "piece"], kind="stable")
        bins, pattern, bound = harmonic_bins(rows["n_tokens"].to_numpy(), int(rows["capacity"].iloc[0]), refined)
        base = rows["block"].to_numpy() << _BIN_BITS
        rows = rows.assign(bin=base + bins, pattern=base + pattern, class_bound=bound)
        return rows[["pack_name", "bin", "pattern", "class_bound", "key", "piece", "start", "n_tokens"]]

    return dealt.groupBy("pack_name", "block").applyInPandas(run, columns).withColumnRenamed("key", key)


def packing_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """``pack_name, capacity, n_bins, n_items, n_tokens, fill`` of each capacity."""
    sizes = packed.sparkSession.createDataFrame([(n, int(c)) for n, c in capacities], "pack_name string, capacity long")
    per_bin = packed.groupBy("pack_name", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return (
        per_bin.groupBy("pack_name")
        .agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
        .join(sizes, "pack_name")
        .select("pack_name", "capacity", "n_bins", "n_items", "n_tokens", "fullest", (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill"))
    )


def packing_audit(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """``pack_name, n_items, n_tokens, n_over, n_misfits, n_off_pattern`` of each capacity that has bins.

    ``n_over`` counts bins above the capacity, ``n_misfits`` texts above their
    class bound and bins whose bounds don't fit together, and
    ``n_off_pattern`` patterns whose bins differ in what they take.
    """
    sizes = packed.sparkSession.createDataFrame([(n, int(c)) for n, c in capacities], "pack_name string, capacity long")
    by_class = packed.groupBy("pack_name", "bin", "pattern", "class_bound").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.sum((F.col("n_tokens") > F.col("class_bound")).cast("int")).alias("above")
    )
    takes = F.when(F.col("class_bound") > 0, F.struct("class_bound", "n"))
    per_bin = by_class.groupBy("pack_name", "bin", "pattern").agg(
        F.sum("n").alias("n"),
        F.sum("t").alias("t"),
        F.sum("above").alias("above"),
        F.sum(F.col("class_bound") * F.col("n")).alias("reserved"),
        # At most one entry per class.
        F.sort_array(F.collect_list(takes)).alias("takes"),
    )
    per_bin = per_bin.join(F.broadcast(sizes), "pack_name")
    per_pattern = per_bin.groupBy("pack_name", "pattern").agg(
        F.sum("n").alias("n"),
        F.sum("t").alias("t"),
        F.sum((F.col("t") > F.col("capacity")).cast("int")).alias("over"),
        F.sum(F.col("above") + (F.col("reserved") > F.col("capacity")).cast("int")).alias("misfits"),
        (F.min("takes") != F.max("takes")).cast("int").alias("off"),
    )
    return per_pattern.groupBy("pack_name").agg(
        F.sum("n").alias("n_items"),
        F.sum("t").alias("n_tokens"),
        F.sum("over").alias("n_over"),
        F.sum("misfits").alias("n_misfits"),
        F.sum("off").alias("n_off_pattern"),
    )


def class_report(packed: DataFrame) -> DataFrame:
    """``pack_name, class_bound, n_items, n_bins, n_tokens`` of each size class."""
    return packed.groupBy("pack_name", "class_bound").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens")
    )
