"""From overlapping patches in unrelated frames to one embedding."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import vec_mean, vec_median
from tessera.operators import synchronise as sync
from tessera.operators.affine import Frames, apply_frames
from tessera.operators.pair_stats import PairStats, pair_statistics
from tessera.operators.spanning import UnionFind
from tessera.schema import require


class AlignmentProblem:
    """Scales, rotations and translations that make the overlaps agree.

    ``patches(patch_id, node, coords)`` with unique ``(patch_id, node)``.
    Pairs that share fewer than ``min_overlap`` nodes (default: dimension + 1)
    are not used; if ``patch_edges(i, j)`` names such a pair, or the remaining
    patch graph does not connect all patches, ``RuntimeError`` is raised.
    Coordinates are never rewritten: results are frames, applied on reading.
    ``pair_transform`` maps the statistics of all pairs to their relative
    rotations, by default the orthogonal ones nearest to the covariances.
    """

    n_sync = 0

    def __init__(
        self,
        patches: DataFrame,
        patch_edges: DataFrame | None = None,
        min_overlap: int | None = None,
        dim: int | None = None,
        pair_transform: Callable[[PairStats], np.ndarray] | None = None,
    ):
        self.pair_transform = pair_transform or (lambda stats: sync.relative_orthogonal(stats.cov))
        self.patches = require(patches, "patch_id", "node", "coords")
        if dim is None:
            first = patches.select(F.size("coords").alias("n")).first()
            if first is None:
                raise ValueError("there are no patches")
            dim = first["n"]
        self.dim = dim
        self.min_overlap = dim + 1 if min_overlap is None else min_overlap
        stats = pair_statistics(patches, dim, patch_edges)
        enough = stats.n >= self.min_overlap
        if patch_edges is not None:
            named = patch_edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().count()
            if not enough.all() or named > len(stats.n):
                raise RuntimeError("Patch edges do not satisfy minimum overlap")
        self.start: PairStats = stats.kept(enough)
        sets = UnionFind()
        for a, b in zip(self.start.i, self.start.j):
            sets.union(int(a), int(b))
        if sets.n_sets(range(len(stats.ids))) > 1:
            raise RuntimeError("patch graph is not connected")
        self.frames = Frames.identity(stats.ids, dim)
        self.stats = self.start
        self._aligned: DataFrame | None = None

    # -- what varies between problems ---------------------------------------------

    def weights(self, stats: PairStats) -> np.ndarray:
        """Weight of each pair in the synchronisation of scales and rotations."""
        return np.ones(len(stats.n))

    def solve_rotations(self, blocks: np.ndarray) -> np.ndarray:
        s = self.stats
        return sync.synchronise_rotations(len(s.ids), s.i, s.j, blocks, self.weights(s))

    # -- synchronisation ---------------------------------------------------------------

    def synchronised_scales(self, clamp: float = 1e8) -> np.ndarray:
        s = self.stats
        ratio = sync.relative_scale(np.trace(s.s_i, axis1=1, axis2=2), np.trace(s.s_j, axis1=1, axis2=2), clamp)
        return sync.synchronise_scales(len(s.ids), s.i, s.j, ratio, self.weights(s), clamp)

    def synchronised_rotations(self) -> np.ndarray:
        return self.solve_rotations(self.pair_transform(self.stats))

    def synchronised_translations(self) -> np.ndarray:
        s = self.stats
        return sync.synchronise_translations(len(s.ids), s.i, s.j, s.mean_i - s.mean_j)

    def scale_patches(self, factors: np.ndarray | None = None) -> AlignmentProblem:
        """Multiply patches by ``factors``, by default by what undoes their scales."""
        factors = 1 / self.synchronised_scales() if factors is None else np.asarray(factors, float)
        self.frames, self.stats = self.frames.scaled(factors), self.stats.scaled(factors)
        return self

    def rotate_patches(self, rotations: np.ndarray | None = None) -> AlignmentProblem:
        """Replace coordinates by ``coords @ rotation.T``, by default by the synchronised ones."""
        matrices = self.synchronised_rotations() if rotations is None else np.asarray(rotations, float).transpose(0, 2, 1)
        self.frames, self.stats = self.frames.rotated(matrices), self.stats.rotated(matrices)
        return self

    def translate_patches(self, vectors: np.ndarray | None = None) -> AlignmentProblem:
        vectors = self.synchronised_translations() if vectors is None else np.asarray(vectors, float)
        s = self.stats
        self.frames = self.frames.translated(vectors)
        self.stats = PairStats(s.ids, s.i, s.j, s.n, s.mean_i + vectors[s.i], s.mean_j + vectors[s.j], s.cov, s.s_i, s.s_j)
        return self

    def align_patches(self, scale: bool = False) -> AlignmentProblem:
        if scale:
            self.scale_patches()
        return self.rotate_patches().translate_patches()

    def copy(self) -> AlignmentProblem:
        """A problem with the same state; what is done to one does not change the other."""
        # Every step replaces frames and statistics, none changes them in place.
        return copy(self)

    # -- results -------------------------------------------------------------------------

    def aligned_patches(self, frame_of: int | None = None) -> DataFrame:
        """Patches in the common frame, or in that of one patch."""
        frames = self.frames if frame_of is None else self.frames.relative_to(frame_of)
        return apply_frames(self.patches, frames)

    def mean_embedding(self, frame_of: int | None = None) -> DataFrame:
        return mean_embedding(self.aligned_patches(frame_of), self.dim)

    def median_embedding(self, frame_of: int | None = None) -> DataFrame:
        return median_embedding(self.aligned_patches(frame_of), self.dim)

    def get_aligned_embedding(self, scale: bool = False, realign: bool = False, frame_of: int | None = None) -> DataFrame:
        """The mean embedding after alignment; aligned once unless ``realign``."""
        if realign or self._aligned is None:
            self.frames, self.stats = Frames.identity(self.start.ids, self.dim), self.start
            self.align_patches(scale)
        self._aligned = self.mean_embedding(frame_of)
        return self._aligned


def mean_embedding(patches: DataFrame, dim: int) -> DataFrame:
    """``node, coords``: the centroid of each node over its patches."""
    return patches.groupBy("node").agg(vec_mean(F.col("coords"), dim).alias("coords"))


def median_embedding(patches: DataFrame, dim: int) -> DataFrame:
    """``node, coords``: the median of each coordinate over a node's patches."""
    return patches.groupBy("node").agg(vec_median(F.col("coords"), dim).alias("coords"))


def complete_embedding(embedding: DataFrame, n_nodes: int) -> DataFrame:
    """Rows for all nodes 0..n_nodes-1, null coordinates for those in no patch."""
    every = embedding.sparkSession.range(n_nodes).withColumnRenamed("id", "node")
    return every.join(embedding, "node", "left")


class WeightedAlignmentProblem(AlignmentProblem):
    """Pairs weigh as much as the nodes they share."""

    def weights(self, stats: PairStats) -> np.ndarray:
        return stats.n


class SVDAlignmentProblem(WeightedAlignmentProblem):
    """Rotations from the smallest singular vectors instead of eigenvectors."""

    def solve_rotations(self, blocks: np.ndarray) -> np.ndarray:
        s = self.stats
        return sync.synchronise_rotations_svd(len(s.ids), s.i, s.j, blocks, self.weights(s))


# -- learned alignment ---------------------------------------------------------------------


class LearnedAlignmentProblem(AlignmentProblem):
    """Maps ``x @ W.T + b`` fitted by gradient descent on the overlap disagreement.

    The loss is a quadratic form of the pair statistics, so an epoch costs the
    same whatever the number of nodes.  ``kind`` is ``affine`` (the first patch
    stays as it is) or ``orthogonal``.
    """

    def __init__(self, patches: DataFrame, patch_edges: DataFrame | None = None, min_overlap: int | None = None, dim: int | None = None, kind: str = "affine", num_epochs: int = 1000, learning_rate: float = 1e-3):
        if kind not in ("affine", "orthogonal"):
            raise ValueError(f"unknown kind {kind}")
        super().__init__(patches, patch_edges, min_overlap, dim)
        self.kind, self.num_epochs, self.learning_rate = kind, num_epochs, learning_rate
        self.loss_history: list[float] = []

    def align_patches(self, scale: bool = False) -> LearnedAlignmentProblem:
        if scale:
            self.scale_patches()
        s = self.stats
        w, b, self.loss_history = fit_affine(s, self.kind, self.num_epochs, self.learning_rate)
        turned = w.transpose(0, 2, 1)
        self.frames = self.frames.rotated(turned).translated(b)
        moved = s.rotated(turned)
        self.stats = PairStats(s.ids, s.i, s.j, s.n, moved.mean_i + b[s.i], moved.mean_j + b[s.j], moved.cov, moved.s_i, moved.s_j)
        return self


def affine_loss(s: PairStats, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed squared disagreement and its gradients."""
    wi, wj = w[s.i], w[s.j]
    gap = np.einsum("eij,ej->ei", wi, s.mean_i) + b[s.i] - np.einsum("eij,ej->ei", wj, s.mean_j) - b[s.j]
    wi_si, wj_sj, wj_ct, wi_c = wi @ s.s_i, wj @ s.s_j, wj @ s.cov.transpose(0, 2, 1), wi @ s.cov
    loss = (s.n * (gap**2).sum(1)).sum() + (wi_si * wi).sum() + (wj_sj * wj).sum() - 2 * (wi_c * wj).sum()
    pull = s.n[:, None] * gap
    gw, gb = np.zeros_like(w), np.zeros_like(b)
    np.add.at(gw, s.i, 2 * (wi_si - wj_ct + np.einsum("ei,ej->eij", pull, s.mean_i)))
    np.add.at(gw, s.j, 2 * (wj_sj - wi_c - np.einsum("ei,ej->eij", pull, s.mean_j)))
    np.add.at(gb, s.i, 2 * pull)
    np.add.at(gb, s.j, -2 * pull)
    return float(loss), gw, gb


def fit_affine(s: PairStats, kind: str, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Full-batch Adam; orthogonal maps are pulled back to the group after every step."""
    n, d = len(s.ids), s.dim
    w, b = np.tile(np.eye(d), (n, 1, 1)), np.zeros((n, d))
    moments = [np.zeros_like(x) for x in (w, w, b, b)]
    history = []
    for t in range(1, epochs + 1):
        loss, gw, gb = affine_loss(s, w, b)
        history.append(loss)
        if kind == "affine":
            gw[0], gb[0] = 0, 0
        steps = []
        for k, g in ((0, gw), (2, gb)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * g * g
            steps.append(rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.999**t)) + 1e-8))
        w, b = w - steps[0], b - steps[1]
        if kind == "orthogonal":
            w = nearest(w)
    return w, b, history


def nearest(w: np.ndarray) -> np.ndarray:
    return sync.nearest_orthogonal(w)


# -- registry --------------------------------------------------------------------------------

_ALIGNERS: dict[str, Callable[..., AlignmentProblem]] = {}


def register_aligner(name: str):
    """Decorator that makes an aligner available under a name."""

    def add(factory):
        _ALIGNERS[name] = factory
        return factory

    return add


def get_aligner(name: str, *args, **kwargs) -> AlignmentProblem:
    if name not in _ALIGNERS:
        raise ValueError(f"unknown aligner {name}, available: {', '.join(sorted(_ALIGNERS))}")
    return _ALIGNERS[name](*args, **kwargs)


for _name, _factory in (
    ("sync", AlignmentProblem), ("weighted", WeightedAlignmentProblem), ("svd", SVDAlignmentProblem), ("geo", LearnedAlignmentProblem),
):
    register_aligner(_name)(_factory)
