"""Embedding models: small graph auto-encoders per patch, and spectral embedding of bipartite tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.in_task import RowSums, SparseRows, in_batches, in_one_task
from tessera.session import materialize


@dataclass(frozen=True)
class AutoEncoder:
    """Hyperparameters of a graph auto-encoder."""

    model: str = "VGAE"  # or GAE
    dim: int = 2
    hidden: int = 32
    epochs: int = 200
    rate: float = 1e-3
    weight_decay: float = 0.0
    patience: int = 20
    delta: float = 0.0
    distance: bool = False  # decoder exp(-distance) instead of sigmoid(inner product)
    add_self_loops: bool = True
    normalise: bool = True
    bias: bool = True
    seed: int = 1

    def __post_init__(self):
        if self.model not in ("GAE", "VGAE"):
            raise ValueError(f"Invalid model: {self.model}")


class EarlyStopping:
    """Stops after more than ``patience`` epochs without an improvement by ``delta``; keeps the best state."""

    def __init__(self, patience: int, delta: float = 0.0):
        self.patience, self.delta = patience, delta
        self.best, self.state, self.waited = np.inf, None, 0

    def __call__(self, loss: float, state: dict) -> bool:
        if loss < self.best - self.delta:
            self.waited = 0
        else:
            self.waited += 1
        if loss < self.best:
            self.best, self.state = loss, {k: v.copy() for k, v in state.items()}
        return self.waited > self.patience


class GraphModel:
    """Two graph convolutions with hand-written gradients.

    Convolution k computes ``A @ H @ W_k + b_k`` with the symmetrically
    normalised adjacency; ReLU lies between.  The variational model has two
    second layers, for means and log deviations.
    """

    def __init__(self, config: AutoEncoder, n: int, src: np.ndarray, dst: np.ndarray, features: np.ndarray | None, weight: np.ndarray | None = None):
        self.config, self.n = config, n
        keep = src != dst
        self.src, self.dst = src[keep], dst[keep]
        w = np.ones(len(src)) if weight is None else np.asarray(weight, float)
        rows, cols, values = src, dst, w
        if config.add_self_loops:
            rows, cols = np.concatenate([self.src, np.arange(n)]), np.concatenate([self.dst, np.arange(n)])
            values = np.concatenate([w[keep], np.ones(n)])
        if config.normalise:
            degree = np.bincount(cols, values, n)
            root = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-12)), 0)
            values = values * root[rows] * root[cols]
        self.rows, self.cols, self.values = rows, cols, values
        self.x = features  # None stands for one-hot features
        rng = np.random.default_rng(config.seed)
        d_in = n if features is None else features.shape[1]

        def glorot(a: int, b: int) -> np.ndarray:
            return rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))

        self.p = {"w1": glorot(d_in, config.hidden), "w2": glorot(config.hidden, config.dim)}
        if config.model == "VGAE":
            self.p["w3"] = glorot(config.hidden, config.dim)
        if config.bias:
            self.p |= {"b1": np.zeros(config.hidden), "b2": np.zeros(config.dim)}
            if config.model == "VGAE":
                self.p["b3"] = np.zeros(config.dim)

    def spread(self, h: np.ndarray, back: bool = False) -> np.ndarray:
        """Adjacency (or its transpose) times a matrix."""
        to, of = (self.rows, self.cols) if back else (self.cols, self.rows)
        out = np.zeros((self.n, h.shape[1]))
        np.add.at(out, to, self.values[:, None] * h[of])
        return out

    def _forward(self):
        p = self.p
        xw = p["w1"] if self.x is None else self.x @ p["w1"]
        pre = self.spread(xw) + p.get("b1", 0.0)
        h = np.maximum(pre, 0)
        sh = self.spread(h)
        mu = sh @ p["w2"] + p.get("b2", 0.0)
        logstd = np.minimum(sh @ p["w3"] + p.get("b3", 0.0), 10.0) if "w3" in p else None
        return pre, h, sh, mu, logstd

    def embed(self) -> np.ndarray:
        return self._forward()[3]

    def score(self, z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.config.distance:
            return np.exp(-np.sqrt(((z[a] - z[b]) ** 2).sum(1) + 1e-12))
        return 1 / (1 + np.exp(-np.clip((z[a] * z[b]).sum(1), -30, 30)))

    def _pair_gradient(self, z, a, b, positive: bool):
        """Mean cross entropy of pairs and its gradient with respect to z."""
        eps, m = 1e-15, max(len(a), 1)
        s = self.score(z, a, b)
        loss = -np.log((s if positive else 1 - s) + eps).sum() / m
        ds = (-1 / (s + eps) if positive else 1 / (1 - s + eps)) / m
        g = np.zeros_like(z)
        if self.config.distance:
            diff = z[a] - z[b]
            d = np.sqrt((diff**2).sum(1) + 1e-12)
            pull = (ds * -s / d)[:, None] * diff
            np.add.at(g, a, pull)
            np.add.at(g, b, -pull)
        else:
            dot = (ds * s * (1 - s))[:, None]
            np.add.at(g, a, dot * z[b])
            np.add.at(g, b, dot * z[a])
        return loss, g

    def loss(self, negative: tuple[np.ndarray, np.ndarray], noise: np.ndarray | None) -> tuple[float, dict]:
        """Reconstruction loss, for the variational model with the KL term, and all gradients."""
        p = self.p
        pre, h, sh, mu, logstd = self._forward()
        std = np.exp(logstd) if logstd is not None else None
        z = mu if noise is None or std is None else mu + noise * std
        loss_p, g_p = self._pair_gradient(z, self.src, self.dst, True)
        loss_n, g_n = self._pair_gradient(z, *negative, False)
        loss, gz = loss_p + loss_n, g_p + g_n
        g_mu, grads = gz, {}
        gsh = np.zeros_like(sh)
        if logstd is not None:
            n2 = self.n * self.n
            loss += -0.5 / n2 * (1 + 2 * logstd - mu**2 - std**2).sum()
            g_mu = gz + mu / n2
            g_log = (gz * noise * std if noise is not None else 0.0) - (1 - std**2) / n2
            g_log = np.where(logstd >= 10.0, 0.0, g_log)
            grads["w3"] = sh.T @ g_log
            if "b3" in p:
                grads["b3"] = g_log.sum(0)
            gsh += g_log @ p["w3"].T
        grads["w2"] = sh.T @ g_mu
        if "b2" in p:
            grads["b2"] = g_mu.sum(0)
        gsh += g_mu @ p["w2"].T
        gpre = self.spread(gsh, back=True) * (pre > 0)
        if "b1" in p:
            grads["b1"] = gpre.sum(0)
        gxw = self.spread(gpre, back=True)
        grads["w1"] = gxw if self.x is None else self.x.T @ gxw
        return float(loss), grads

    def negatives(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """As many pairs that are no edges as there are edges, where there are any."""
        m, n = len(self.src), self.n
        known = np.unique(self.src * n + self.dst)
        if n < 2 or len(known) >= n * (n - 1):
            return np.zeros(0, int), np.zeros(0, int)
        got = np.zeros(0, np.int64)
        while len(got) < m:
            c = rng.integers(0, n * n, 2 * m + 16)
            c = c[(c // n != c % n) & ~np.isin(c, known)]
            got = np.concatenate([got, c])
        return got[:m] // n, got[:m] % n

    def train(
        self,
        loss: Callable[[GraphModel, tuple[np.ndarray, np.ndarray], np.ndarray | None], tuple[float, dict]] | None = None,
        validation: Callable[[GraphModel], float] | None = None,
        logger: Callable[[dict], None] | None = None,
    ) -> list[float]:
        """Adam with early stopping; the loss of an epoch is that before its step.

        ``loss(model, negatives, noise)`` gives a loss and its gradients, by
        default those of the model.  ``validation(model)`` gives what early
        stopping looks at, by default the loss.  ``logger`` is told of every
        epoch: ``epoch, loss`` and, if there is a validation, ``val_loss``.
        """
        loss_of = loss or GraphModel.loss
        c = self.config
        rng = np.random.default_rng(c.seed + 1)
        stop = EarlyStopping(c.patience, c.delta)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        history = []
        if not len(self.src):
            return history
        for t in range(1, c.epochs + 1):
            noise = rng.normal(size=(self.n, c.dim)) if c.model == "VGAE" else None
            value, grads = loss_of(self, self.negatives(rng), noise)
            history.append(value)
            checked = validation(self) if validation else value
            if logger:
                logger({"epoch": t, "loss": value} | ({"val_loss": checked} if validation else {}))
            if stop(checked, self.p):
                self.p = stop.state
                break
            for k, g in grads.items():
                g = g + c.weight_decay * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - c.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return history


def patch_embeddings(
    edges: DataFrame, nodes: DataFrame, config: AutoEncoder = AutoEncoder(), features: str | None = None, **callbacks: Callable | None
) -> DataFrame:
    """``patch_id, node, coords, loss_first, loss_last``: one model per patch, trained in parallel.

    ``edges(patch_id, src, dst)`` with both directions, ``nodes(patch_id, id)``
    with an optional array column of features; without it features are one-hot.
    A patch without edges keeps its initial weights and has null losses.
    ``callbacks`` are those of :meth:`GraphModel.train`; they run where the
    patch is trained.
    """
    left = edges.select("patch_id", "src", "dst", *([F.col("weight")] if "weight" in edges.columns else []))
    right = nodes.select(F.col("patch_id").alias("node_patch"), F.col("id").alias("node"), *([F.col(features).alias("x")] if features else []))

    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node")
        ids = v["node"].to_numpy(np.int64)
        x = np.array(v["x"].tolist(), float) if "x" in v else None
        src, dst = np.searchsorted(ids, e["src"].to_numpy(np.int64)), np.searchsorted(ids, e["dst"].to_numpy(np.int64))
        model = GraphModel(config, len(ids), src, dst, x, e["weight"].to_numpy(float) if "weight" in e else None)
        history = model.train(**callbacks)
        z = model.embed()
        return pd.DataFrame(
            {"patch_id": v["node_patch"].to_numpy(), "node": ids, "coords": list(z), "loss_first": history[0] if history else None, "loss_last": history[-1] if history else None}
        )

    schema = "patch_id int, node long, coords array<double>, loss_first double, loss_last double"
    return left.groupBy("patch_id").cogroup(right.groupBy("node_patch")).applyInPandas(run, schema)


def rate_search(edges: DataFrame, nodes: DataFrame, rates: list[float], runs: int = 3, config: AutoEncoder = AutoEncoder()) -> tuple[float, pd.DataFrame]:
    """The learning rate with the smallest mean final loss, and the losses of all."""
    rows = []
    for rate in rates:
        for r in range(runs):
            out = patch_embeddings(edges, nodes, replace(config, rate=rate, seed=config.seed + r))
            rows.append((rate, r, out.groupBy("patch_id").agg(F.max("loss_last").alias("l")).agg(F.avg("l")).first()[0]))
    table = pd.DataFrame(rows, columns=["rate", "run", "loss"])
    return float(table.groupby("rate")["loss"].mean().idxmin()), table


def distance_scores(embedding: DataFrame, pairs: DataFrame, raw: bool = False) -> DataFrame:
    """``pairs`` with ``score``: exp of minus the distance of the ends, or the distance itself if ``raw``."""
    from tessera.functions.vectors import vec_distance

    a = embedding.select(F.col("node").alias("src"), F.col("coords").alias("a"))
    b = embedding.select(F.col("node").alias("dst"), F.col("coords").alias("b"))
    d = vec_distance(F.col("a"), F.col("b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", d if raw else F.exp(-d)).drop("a", "b")


# -- spectral -----------------------------------------------------------------------------------

def bipartite_svd(entries: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``(rows(node, coords), columns(node, coords), values)`` of a sparse table ``row, col, value``.

    The table is normalised by the square roots of its row and column sums; of
    its singular triplets the trivial first one is left out and the next k are
    kept, values ascending.  Coordinates are divided by the roots once more.
    Signs are fixed by making the largest entry of each vector of the smaller
    side positive; columns for singular values that vanish are completed
    orthonormally on both sides.  It runs in one task, which has the table in
    mapped files and some hundred vectors of the smaller side in memory; only
    the values come to the driver.
    """
    rows = entries.groupBy(F.col("row").cast("long").alias("src"), F.col("col").cast("long").alias("dst")).agg(F.sum("value").cast("double").alias("weight")).where("weight <> 0")

    def run(table: SparseRows) -> Iterator[pa.RecordBatch]:
        sizes = [float(len(table.ids)), float(len(table.columns))]
        values = []
        if 1 <= k < min(sizes):
            left, right, values = singular_triplets(table, k, seed)
            for side, ids, x in ((0, table.ids, left), (1, table.columns, right)):
                coords = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * k + 1, k, dtype=np.int32)), pa.array(x.ravel()))
                yield from in_batches({"side": np.full(len(ids), side, np.int32), "node": ids, "coords": coords})
        yield from in_batches({"side": np.array([2, 3], np.int32), "node": np.zeros(2, np.int64), "coords": pa.array([list(values), sizes], pa.list_(pa.float64()))})

    found = materialize(in_one_task(rows, run, "side int, node long, coords array<double>", square=False), "triplets")
    facts = {r["side"]: np.array(r["coords"]) for r in found.where("side >= 2").collect()}
    if not 1 <= k < facts[3].min():
        raise ValueError(f"k must be in [1, {int(facts[3].min())})")
    return found.where("side = 0").select("node", "coords"), found.where("side = 1").select("node", "coords"), facts[2]


def singular_triplets(table: SparseRows, k: int, seed: int = 1, basis: int = 192, rounds: int = 5_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of rows and columns and the values of :func:`bipartite_svd`.

    Up to twice ``basis`` members of the smaller side the Gram matrix is solved
    as a whole; beyond, by a block of vectors, so that equal values are all
    found, whose space grows by the residuals and is cut to its best half at
    ``basis`` vectors, fewer on a side of more than 2^25 / ``basis`` members.
    Once it was cut it grows only by the residuals that have not settled.  Vectors that have not settled after ``rounds`` are an error.
    """
    turned = table.turned()
    roots = np.sqrt(table.sums()), np.sqrt(turned.sums())
    products = RowSums(table), RowSums(turned)

    def to_rows(x: np.ndarray) -> np.ndarray:
        return products[0](x / roots[1][:, None]) / roots[0][:, None]

    def to_columns(y: np.ndarray) -> np.ndarray:
        return products[1](y / roots[0][:, None]) / roots[1][:, None]

    flipped = len(table.ids) < len(table.columns)
    to_big, to_small = (to_columns, to_rows) if flipped else (to_rows, to_columns)
    small_root, big_root = roots if flipped else roots[::-1]
    n = len(small_root)
    trivial = (small_root / np.linalg.norm(small_root))[:, None]
    rng = np.random.default_rng(seed)
    block = k + 2
    basis = max(min(basis, (1 << 25) // n), 4 * block)

    def away(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Orthonormal columns away from those of ``q``; what vanishes becomes a random one."""
        x = x / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
        while True:
            for _ in range(3):
                x = x - q @ (q.T @ x)
                x, r = np.linalg.qr(x)
                lost = np.abs(np.diag(r)) < 1e-12
                if lost.any():
                    break
            else:
                return x
            x[:, lost] = rng.normal(size=(len(x), lost.sum()))

    if n <= 2 * basis:
        wide = max(1, min(64, (1 << 23) // len(big_root)))
        gram = np.concatenate([to_small(to_big(np.eye(n)[:, s : s + wide])) for s in range(0, n, wide)], 1)
        gram = (gram + gram.T) / 2
        # The trivial vector gets the eigenvalue -1, so it isn't among those of vanishing ones either.
        gram -= trivial @ trivial.T * (1 + trivial.T @ gram @ trivial)
        small = np.linalg.eigh(gram)[1][:, -k:]
    else:
        # Column 0 of q is the trivial vector, those of g are their products.
        q, g = np.zeros((n, basis + 1), order="F"), np.zeros((n, basis + 1), order="F")
        h = np.zeros((basis + 1, basis + 1))
        q[:, :1], m, cut = trivial, 1, False
        more = rng.normal(size=(n, block))
        for _ in range(rounds):
            new = slice(m, m + more.shape[1])
            q[:, new] = away(more, q[:, :m])
            g[:, new] = to_small(to_big(q[:, new]))
            m = new.stop
            h[1:m, new] = q[:, 1:m].T @ g[:, new]
            h[new, 1:m] = h[1:m, new].T
            theta, y = np.linalg.eigh((h[1:m, 1:m] + h[1:m, 1:m].T) / 2)
            rest = g[:, 1:m] @ y[:, -block:] - q[:, 1:m] @ (y[:, -block:] * theta[-block:])
            rest -= trivial @ (trivial.T @ rest)
            open_ = np.flatnonzero(np.linalg.norm(rest[:, -k:], axis=0) > 1e-10) + block - k
            if not len(open_):
                break
            if m + block > basis + 1:
                best, cut = y[:, -(basis // 2) :], True
                q[:, 1 : 1 + best.shape[1]], g[:, 1 : 1 + best.shape[1]] = q[:, 1:m] @ best, g[:, 1:m] @ best
                m = 1 + best.shape[1]
                h[1:m, 1:m] = np.diag(theta[1 - m :])
            more = rest[:, open_] if cut else rest
        else:
            raise RuntimeError(f"the singular vectors have not settled after {rounds} rounds")
        small = q[:, 1 : 1 + len(y)] @ y[:, -k:]
    # The triplets of the chosen space, values from the table itself: those of the Gram matrix lose half the digits.
    u, values, turn = np.linalg.svd(to_big(small), full_matrices=False)
    big, values, small = u[:, ::-1].copy(), values[::-1].copy(), small @ turn.T[:, ::-1]
    signs = np.where(small[np.abs(small).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    big, small = big * signs, small * signs
    gone = values < 1e-8
    if gone.any():
        if len(big_root) <= k:
            raise ValueError("there is no further direction to complete the coordinates with")
        kept = np.concatenate([(big_root / np.linalg.norm(big_root))[:, None], big[:, ~gone]], 1)
        big[:, gone] = away(rng.normal(size=(len(big), gone.sum())), kept)
    small, big = small / small_root[:, None], big / big_root[:, None]
    return (small, big, values) if flipped else (big, small, values)


def orthonormal_completion(q: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """``q`` with further orthonormal columns up to k."""
    have = q.shape[1]
    if k > q.shape[0]:
        raise ValueError("more columns than rows")
    extra = np.random.default_rng(seed).normal(size=(q.shape[0], k - have))
    for _ in range(2):
        extra -= q @ (q.T @ extra)
    return np.concatenate([q, np.linalg.qr(extra)[0]], 1)


class SpectralEmbedding:
    """Estimator with ``fit`` and ``transform`` over a graph's two sides."""

    def __init__(self, dim: int):
        self.dim = dim
        self.rows: DataFrame | None = None
        self.columns: DataFrame | None = None
        self.values: np.ndarray | None = None

    def fit(self, entries: DataFrame) -> SpectralEmbedding:
        self.rows, self.columns, self.values = bipartite_svd(entries, self.dim)
        return self

    def transform(self, nodes: DataFrame, side: str = "rows") -> DataFrame:
        """Nodes with their coordinates, null for unknown ones."""
        if self.rows is None:
            raise RuntimeError("fit first")
        return nodes.join(self.rows if side == "rows" else self.columns, "node", "left")

    def fit_transform(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.fit(entries)
        return self.rows, self.columns


def embed_graph(graph: PropertyGraph, config: AutoEncoder, features: str | None = None) -> DataFrame:
    """One model over a whole small graph."""
    out = patch_embeddings(graph.edges.withColumn("patch_id", F.lit(0)), graph.nodes.withColumn("patch_id", F.lit(0)), config, features)
    return out.drop("patch_id")
