"""The k nearest vectors of every vector, by additive quantisation.

A coarse codebook routes every vector to a cell.  What the cell centre leaves
over is encoded as a sum of entries of full-dimensional codebooks, one per
level, found by beam search.  Stored with the codes are the squared norm of the
reconstruction and its error.  A query's inner products with all codebook
entries are one lookup table, so the distance to a reconstruction costs a few
lookups and the stored norm; no vector is decoded.  That distance and the
stored error give a lower and an upper bound of the true distance.  A row whose
lower bound is within the k-th smallest upper bound is reranked with its exact
vector, so the number of reranked rows follows the list and has no cap.

Each query first searches its own cell.  The k-th distance found there bounds
which other cells can hold anything closer: by the radius of a cell, and by the
hyperplane between its centre and the query's nearest centre.  In many
dimensions these bounds exclude little; where a share of the true neighbours is
enough, the cells are also taken in the order of their centres' distance, and
only as many of them as hold that share for sampled queries, which are searched
exactly.
Codebooks are fitted on a bounded sample; every vector is encoded and searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import pick
from tessera.session import materialize


@dataclass(frozen=True)
class SearchParameters:
    """Sizes of the index and the accepted loss; every row is indexed and is a query."""

    train_rows: int = 65_536  # rows the codebooks are fitted on
    cells_per_root: float = 4.0  # coarse cells per square root of the number of vectors
    codebook_bytes: int = 64 << 20  # of the coarse codebook, which every task reads; fewer cells only mean longer lists
    levels: int = 4
    entries: int = 256
    beam: int = 4
    deviations: float = 3.0  # of a reconstruction's error that the bounds allow for; from the root of the dimension on they are exact
    recall: float = 1.0  # 1.0 probes by the exact bounds alone; below, the share of the sampled queries' true neighbours that the probed cells hold
    probe_queries: int = 1_024  # sampled queries
    block_rows: int = 2_048  # rows of a list that are scored together
    query_rows: int = 8_192  # queries that are scored together
    train_rounds: int = 8
    seed: int = 7


def _nearest(x: np.ndarray, centres: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    chunk = max(1, cells // len(centres))
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), chunk):
        out[s : s + chunk] = (half - x[s : s + chunk] @ centres.T).argmin(1)
    return out


def fit_codebook(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; an empty cell restarts at a row far from its centre."""
    k = max(1, min(k, len(x)))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: (~full).sum()]
            centres[~full] = x[far]
    return centres


@dataclass(frozen=True)
class Codebooks:
    coarse: np.ndarray  # cells x dim
    levels: list[np.ndarray]  # each entries x dim

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes, squared norm of the reconstruction from the cell's centre and its error, by beam search over the levels."""
        n = len(x)
        cell = _nearest(x, self.coarse)
        rest = (x - self.coarse[cell])[:, None, :]
        codes = np.zeros((n, 1, 0), np.int16)
        for book in self.levels:
            width = rest.shape[1]
            error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
            keep = min(beam, width * len(book))
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
            parent, entry = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[entry]
            codes = np.concatenate([codes[rows, parent], entry[:, :, None].astype(np.int16)], 2)
        first = (rest**2).sum(2).argmin(1)
        rows = np.arange(n)
        rebuilt = x - self.coarse[cell] - rest[rows, first]
        return cell, codes[rows, first], (rebuilt**2).sum(1), np.sqrt((rest[rows, first] ** 2).sum(1))


def fit_codebooks(sample: np.ndarray, n_cells: int, p: SearchParameters) -> Codebooks:
    rng = np.random.default_rng(p.seed)
    coarse = fit_codebook(sample, n_cells, p.train_rounds, rng)
    rest = sample - coarse[_nearest(sample, coarse)]
    levels = []
    for _ in range(p.levels):
        book = fit_codebook(rest, p.entries, p.train_rounds, rng)
        levels.append(book)
        rest = rest - book[_nearest(rest, book)]
    return Codebooks(coarse, levels)


_INDEX_SCHEMA = "node long, vector array<double>, cell int, codes array<short>, norm double, error double, off double"


def encode_index(points: DataFrame, shared: Broadcast, p: SearchParameters) -> DataFrame:
    """``node, vector, cell, codes, norm, error, off``; off is the distance from the cell's centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = Codebooks(*shared.value)
        for batch in batches:
            for s in range(0, len(batch), 2048):
                part = batch.iloc[s : s + 2048]
                x = np.array(part["vector"].tolist(), float)
                cell, codes, norm, error = books.encode(x, p.beam)
                off = np.sqrt(((x - books.coarse[cell]) ** 2).sum(1))
                yield pd.DataFrame(
                    {"node": part["node"].to_numpy(), "vector": part["vector"].to_numpy(), "cell": cell, "codes": list(codes), "norm": norm, "error": error, "off": off}
                )

    return points.select("node", "vector").mapInPandas(run, _INDEX_SCHEMA)


_HIT_SCHEMA = "query long, node long, d double"


def _score(queries: DataFrame, index: DataFrame, sizes: DataFrame, shared: Broadcast, k: int, p: SearchParameters) -> DataFrame:
    """The best k of each (query, list block) that are within the query's bound: ``query, node, d``.

    ``queries(query, qvector, bound, cell)``.  A list is scored in blocks of
    bounded size and so are its queries, so no cell, however full, is one
    task's work.
    """
    asked = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n_queries"))
    plan = sizes.join(asked, "cell").select(
        "cell",
        F.ceil(F.col("n_rows") / F.lit(p.block_rows)).cast("int").alias("blocks"),
        F.ceil(F.col("n_queries") / F.lit(p.query_rows)).cast("int").alias("parts"),
    )
    lists = (
        index.join(plan, "cell")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*[F.col(c).alias(f"list_{c}") for c in ("cell", "block", "part")], "node", "vector", "codes", "norm", "error")
    )
    asks = (
        queries.join(plan, "cell")
        .withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "block", "part", "query", "qvector", "bound")
    )

    def run(asking: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(listed):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "d": np.zeros(0)})
        books = Codebooks(*shared.value)
        dim = books.coarse.shape[1]
        x = np.array(listed["vector"].tolist(), float).reshape(-1, dim)
        nodes = listed["node"].to_numpy()
        quantised = QuantisedList(
            books, int(listed["list_cell"].iloc[0]), np.array(listed["codes"].tolist(), np.int64), listed["norm"].to_numpy(), listed["error"].to_numpy()
        )
        q = np.array(asking["qvector"].tolist(), float).reshape(-1, dim)
        ids, bounds = asking["query"].to_numpy(), asking["bound"].to_numpy()
        found = []
        step = max(1, 4_000_000 // len(nodes))
        for s in range(0, len(q), step):
            near, at = quantised.candidates(q[s : s + step], ids[s : s + step, None] == nodes, bounds[s : s + step], k, p.deviations)
            d = np.sqrt(((x[at] - q[near + s]) ** 2).sum(1))
            order = np.lexsort((nodes[at], d, near))
            near, at, d = near[order], at[order], d[order]
            rank = np.arange(len(near)) - np.searchsorted(near, near)
            ok = (rank < k) & (d <= bounds[near + s])
            found.append((ids[near[ok] + s], nodes[at[ok]], d[ok]))
        return pd.DataFrame({"query": np.concatenate([f[0] for f in found]), "node": np.concatenate([f[1] for f in found]), "d": np.concatenate([f[2] for f in found])})

    listed_by = lists.groupBy("list_cell", "list_block", "list_part")
    return asks.groupBy("cell", "block", "part").cogroup(listed_by).applyInPandas(run, _HIT_SCHEMA)


class QuantisedList:
    """Rows of one cell, scored by lookup tables."""

    def __init__(self, books: Codebooks, cell: int, codes: np.ndarray, norm: np.ndarray, error: np.ndarray):
        # Distances are taken from the cell's centre, where 32 bits are precise enough.
        self.centre = books.coarse[cell]
        self.books = np.concatenate(books.levels).astype(np.float32)
        self.codes = codes + np.cumsum([0, *[len(b) for b in books.levels[:-1]]])
        self.norm, self.error = norm.astype(np.float32), error.astype(np.float32)

    def candidates(self, q: np.ndarray, is_self: np.ndarray, bounds: np.ndarray, k: int, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may be among the query's k nearest within its bound.

        The squared distance to a row is that to its reconstruction, plus the
        squared error, plus or minus twice their product times the cosine
        between both; the cosine is at most 1, and ``deviations`` times the
        inverse root of the dimension but for rare directions.
        """
        moved = (q - self.centre).astype(np.float32)
        table = moved @ self.books.T
        own = (moved**2).sum(1)
        d2 = own[:, None] + self.norm
        slack = d2 * np.float32(1e-5)
        for level in range(self.codes.shape[1]):
            d2 -= 2 * table[:, self.codes[:, level]]
        cosine = min(1.0, deviations / np.sqrt(q.shape[1]))
        wide = np.sqrt(np.maximum(d2, 0)) * (2 * cosine * self.error) + slack
        d2 += self.error**2
        upper = np.where(is_self, np.inf, d2 + wide)
        limit = bounds.astype(float) ** 2 * (1 + 1e-6)
        if upper.shape[1] > k:
            limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
        return np.nonzero((d2 - wide <= limit[:, None]) & ~is_self)


def _probes(index: DataFrame, sample: tuple[np.ndarray, np.ndarray], shared: Broadcast, k: int, p: SearchParameters) -> int:
    """How many cells, in the order of their centres' distance, hold ``p.recall`` of the true neighbours of sampled queries."""
    ids, q = sample
    width = k + 1

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d, best_cell = np.full((len(q), width), np.inf), np.full((len(q), width), -1)
        own = (q**2).sum(1)[:, None]
        for batch in batches:
            for s in range(0, len(batch), 8192):
                part = batch.iloc[s : s + 8192]
                x = np.array(part["vector"].tolist(), float)
                d2 = own + (x**2).sum(1) - 2 * q @ x.T
                d2[ids[:, None] == part["node"].to_numpy()] = np.inf
                d = np.concatenate([best_d, d2], 1)
                cell = np.concatenate([best_cell, np.broadcast_to(part["cell"].to_numpy(), d2.shape)], 1)
                top = np.argpartition(d, width - 1, axis=1)[:, :width]
                best_d, best_cell = np.take_along_axis(d, top, 1), np.take_along_axis(cell, top, 1)
        row, col = np.nonzero(np.isfinite(best_d))
        yield pd.DataFrame({"query": row.astype(np.int64), "node": best_cell[row, col].astype(np.int64), "d": best_d[row, col]})

    hits = index.select("node", "vector", "cell").mapInPandas(nearest, _HIT_SCHEMA)
    # At most probe_queries x k rows.
    true = _top(hits, k).select("query", "node").toPandas()
    if not len(true):
        return 1
    coarse, _ = shared.value
    d2 = 0.5 * (coarse**2).sum(1) - q @ coarse.T
    row, cell = true["query"].to_numpy(), true["node"].to_numpy()
    rank = (d2[row] < d2[row, cell][:, None]).sum(1) + 1
    return int(np.quantile(rank, p.recall, method="higher"))


def _other_cells(
    queries: DataFrame, shared: Broadcast, counts: np.ndarray, radius: np.ndarray, k: int, probes: int | None
) -> DataFrame:
    """For each query every further cell that can hold something within its bound.

    ``queries(query, qvector, cell, bound)``; a bound may be null.  It is then,
    and wherever that is smaller, the distance within which the nearest cells
    hold k rows for certain.  Only the ``probes`` nearest cells are asked if
    that is given, and as many as are needed to find k rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse, _ = shared.value
        gaps_half = 0.5 * (coarse**2).sum(1)
        step = max(1, 4_000_000 // len(coarse))
        for batch in batches:
            for s in range(0, len(batch), step):
                part = batch.iloc[s : s + step]
                q = np.array(part["qvector"].tolist(), float)
                home = part["cell"].to_numpy()
                bound = part["bound"].to_numpy(float, na_value=np.inf)
                d2 = np.maximum((q**2).sum(1)[:, None] + 2 * (gaps_half - q @ coarse.T), 0)
                d = np.sqrt(d2)
                loose = np.flatnonzero(~np.isfinite(bound))
                if len(loose):
                    reach = np.where(counts > 0, d[loose] + radius, np.inf)
                    by_reach = np.argsort(reach, axis=1)
                    enough = (np.cumsum(counts[by_reach], 1) >= k + 1).argmax(1)
                    sure = np.take_along_axis(reach, by_reach, 1)[np.arange(len(loose)), enough]
                    total = counts.sum() > k
                    bound[loose] = sure if total else np.inf
                possible = (d - radius - 1e-9 * (1 + d) <= bound[:, None]) & (counts > 0)
                if probes is not None and probes < len(coarse):
                    near = d2 <= np.partition(d2, probes - 1, axis=1)[:, probes - 1 : probes]
                    near[loose] = True
                    possible &= near
                possible[np.arange(len(q)), home] = False
                row, cell = np.nonzero(possible)
                between = np.sqrt(np.maximum(((coarse[home[row]] - coarse[cell]) ** 2).sum(1), 1e-30))
                plane = (d2[row, cell] - d2[row, home[row]]) / (2 * between)
                ok = plane - 1e-9 * (1 + d[row, cell]) <= bound[row]
                row, cell = row[ok], cell[ok]
                yield pd.DataFrame(
                    {"query": part["query"].to_numpy()[row], "qvector": part["qvector"].to_numpy()[row], "bound": bound[row], "cell": cell.astype(np.int32)}
                )

    return queries.mapInPandas(run, "query long, qvector array<double>, bound double, cell int")


def _top(hits: DataFrame, k: int, by: str = "query") -> DataFrame:
    order = Window.partitionBy(by).orderBy("d", "node")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, k: int = 5, p: SearchParameters = SearchParameters()) -> DataFrame:
    """``node, neighbour, d, rank``: the k nearest other nodes of every node.

    ``vectors(node, vector)`` with unique nodes and usable vectors of one
    length.  Distances are Euclidean and exact; ties go to the smaller node.
    A true neighbour may be missed only if ``p.recall`` is below 1 and the
    cells probed don't hold it, or, beyond ``p.deviations`` squared dimensions, where a
    reconstruction errs in a rare direction.
    Nodes with the same vector are indexed once; each of them still gets the
    others as neighbours at distance 0, without the pairs of such a group
    being formed.  Fewer than k other nodes give fewer rows, no vectors none.
    """
    vectors = pick(vectors, "node", "vector")
    groups = vectors.groupBy("vector").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"))
    points = materialize(groups, "distinct-vectors")
    n = points.count()
    spark = vectors.sparkSession
    if n == 0:
        return spark.createDataFrame([], "node long, neighbour long, d double, rank int")
    # The rows with the smallest hashes; those far above can't be among them and aren't sorted.
    low = F.lit(-(1 << 63) + int(min(1.0, 1.5 * p.train_rows / n) * (1 << 53)) * (1 << 11) - 1)
    hashed = points.where(F.xxhash64("node") <= low)
    sample = hashed.orderBy(F.xxhash64("node"), "node").limit(p.train_rows).select("node", "vector").toArrow()
    if not sample.num_rows:
        sample = points.limit(1).select("node", "vector").toArrow()
    train = sample["vector"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    train_nodes = sample["node"].to_numpy()
    most = max(1, p.codebook_bytes // (8 * train.shape[1]))
    n_cells = int(max(1, min(most, len(train), p.cells_per_root * np.sqrt(n))))
    books = fit_codebooks(train, n_cells, p)
    # The codebooks have at most codebook_bytes and levels x entries vectors more.
    shared = spark.sparkContext.broadcast((books.coarse, books.levels))
    index = materialize(encode_index(points, shared, p), "vector-index")
    sizes = materialize(index.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"), F.max("off").alias("radius")), "cell-sizes")
    # One row per coarse cell: bounded by codebook_bytes.
    stats = sizes.toPandas()
    counts, radius = np.zeros(len(books.coarse), np.int64), np.zeros(len(books.coarse))
    counts[stats["cell"]], radius[stats["cell"]] = stats["n_rows"], stats["radius"]
    asking = slice(0, p.probe_queries)
    probes = _probes(index, (train_nodes[asking], train[asking]), shared, k, p) if p.recall < 1 else None

    asked = index.select(F.col("node").alias("query"), F.col("vector").alias("qvector"), "cell")
    home = materialize(_score(asked.withColumn("bound", F.lit(float("inf"))), index, sizes, shared, k, p), "home-hits")
    bounds = _top(home, k).groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("bound"))
    bounded = asked.join(bounds, "query", "left")
    asked_cells = materialize(_other_cells(bounded, shared, counts, radius, k, probes), "probes")
    hits = home.unionByName(_score(asked_cells, index, sizes, shared, k, p))
    return _top(_with_copies(vectors, points, hits, k), k).select(
        F.col("query").alias("node"), F.col("node").alias("neighbour"), "d", "rank"
    )


def _with_copies(vectors: DataFrame, points: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Hits between distinct vectors spread to all nodes that have them.

    Of a group of copies only the k + 1 smallest nodes can be anybody's
    neighbours; they are found per task before anything is shuffled.
    """
    several = points.where("copies > 1").select("vector", F.col("node").alias("rep"))
    members = materialize(vectors.join(several, "vector").select("rep", "node"), "copies")
    by_node = Window.partitionBy("rep").orderBy("node")
    chosen = members.withColumn("r", F.row_number().over(by_node)).where(F.col("r") <= k + 1).drop("r")
    near = hits.join(chosen.select(F.col("rep").alias("node"), F.col("node").alias("copy")), "node", "left").select(
        "query", F.coalesce("copy", "node").alias("node"), "d"
    )
    near = _top(near, k).drop("rank")
    spread = near.join(members.select(F.col("rep").alias("query"), F.col("node").alias("asking")), "query", "left").select(
        F.coalesce("asking", "query").alias("query"), "node", "d"
    )
    own = (
        members.select("rep", F.col("node").alias("query"))
        .join(chosen, "rep")
        .where("query <> node")
        .select("query", "node", F.lit(0.0).alias("d"))
    )
    return spread.unionByName(own)


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """``node_a < node_b``, of which at least one is a neighbour of the other."""
    return neighbours.select(
        F.least("node", "neighbour").alias("node_a"), F.greatest("node", "neighbour").alias("node_b")
    ).distinct()
