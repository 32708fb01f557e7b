import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import synchronise as sync
from tessera.operators.affine import Frames, apply_frames, mean_patches, stored_patches
from tessera.operators.alignment import (
    AlignmentProblem,
    SVDAlignmentProblem,
    WeightedAlignmentProblem,
    affine_loss,
    complete_embedding,
    get_aligner,
    median_embedding,
)
from tessera.operators.pair_stats import overlap_counts, pair_statistics
from tessera.operators.synthetic import add_noise, cluster_points, random_frames, random_patches

PROBLEMS = [AlignmentProblem, WeightedAlignmentProblem, SVDAlignmentProblem]
TOL = 1e-5


@pytest.fixture(scope="module")
def clouds(spark):
    out = {}
    for dim in (2, 4, 8):
        points = cluster_points(spark, dim, 5, 120, seed=dim).cache()
        out[dim] = points, random_patches(points, 12, 3, seed=dim).cache()
    return out


@pytest.mark.parametrize("dim", [2, 4, 8])
@pytest.mark.parametrize("problem", PROBLEMS)
def test_frames_are_recovered(clouds, dim, problem):
    points, patches = clouds[dim]
    truth = random_frames(list(range(12)), dim, seed=5)
    moved = apply_frames(patches, truth)
    p = problem(moved, dim=dim)
    s = p.synchronised_scales()
    assert M.deviation((truth.scale / s)[:, None]) / np.mean(truth.scale / s) < TOL
    p.scale_patches()
    assert M.orthogonal_mse(truth.rot.transpose(0, 2, 1), p.synchronised_rotations()) < TOL
    assert M.procrustes_error(points, p.get_aligned_embedding(scale=True, realign=True), dim) < TOL
    inside = p.get_aligned_embedding(scale=True, frame_of=0)
    assert M.local_error(points, inside).agg(F.max("error")).first()[0] < 1e-6


@pytest.mark.parametrize("problem", PROBLEMS)
def test_translations_are_recovered(clouds, problem):
    points, patches = clouds[4]
    truth = random_frames(list(range(12)), 4, seed=8)
    shifts = Frames.identity(truth.ids, 4).translated(truth.shift)
    p = problem(apply_frames(patches, shifts), dim=4)
    assert M.deviation(p.synchronised_translations() + truth.shift) < TOL


@pytest.mark.parametrize("noise", [0.01, 0.1])
def test_noise_is_averaged(clouds, noise):
    points, patches = clouds[4]
    noisy = add_noise(patches, noise, seed=3)
    worst = M.local_error(noisy.where("patch_id = 0").select("node", "coords"), points).agg(F.avg("error")).first()[0]
    moved = apply_frames(noisy, random_frames(list(range(12)), 4, seed=5))
    for problem in PROBLEMS:
        embedding = problem(moved, dim=4).get_aligned_embedding(scale=True)
        assert M.procrustes_error(points, embedding, 4) < max(worst**2, TOL)


def test_errors_and_restrictions(spark, clouds):
    points, patches = clouds[2]
    apart = patches.where("patch_id in (0, 6)")
    with pytest.raises(RuntimeError, match="not connected"):
        AlignmentProblem(apart, dim=2)
    named = spark.createDataFrame([(0, 6), (6, 0)], "i int, j int")
    with pytest.raises(RuntimeError, match="minimum overlap"):
        AlignmentProblem(patches, named, dim=2)
    ring = overlap_counts(patches).where("n_overlap > 10 and abs(i - j) in (1, 11)")
    p = AlignmentProblem(patches, ring, dim=2)
    assert len(p.start.n) == 12
    with pytest.raises(ValueError):
        AlignmentProblem(patches.where("false"))
    with pytest.raises(ValueError, match="available"):
        get_aligner("none")


def test_manual_steps_compose(clouds):
    points, patches = clouds[2]
    p = AlignmentProblem(patches, dim=2)
    turn = np.tile(np.array([[0.0, -1.0], [1.0, 0.0]]), (12, 1, 1))
    p.scale_patches(np.full(12, 2.0)).rotate_patches(turn).translate_patches(np.tile([1.0, 0.0], (12, 1)))
    before = {(r.patch_id, r.node): np.array(r.coords) for r in patches.collect()}
    for r in p.aligned_patches().collect():
        assert np.allclose(r.coords, 2 * before[r.patch_id, r.node] @ turn[0].T + [1, 0])
    again = pair_statistics(p.aligned_patches(), 2)
    assert np.allclose(again.mean_i, p.stats.mean_i) and np.allclose(again.cov, p.stats.cov) and np.allclose(again.s_j, p.stats.s_j)


def test_statistics_far_from_the_origin(clouds):
    _, patches = clouds[4]
    far = Frames.identity(list(range(12)), 4).translated(np.full((12, 4), 1e6))
    a, b = pair_statistics(patches, 4), pair_statistics(apply_frames(patches, far), 4)
    assert np.allclose(a.cov, b.cov, atol=1e-6) and np.allclose(a.s_i, b.s_i, atol=1e-6)


def test_large_patch_graph_solvers_agree(monkeypatch):
    rng = np.random.default_rng(0)
    n, d = 30, 3
    i = np.concatenate([np.arange(n - 1), rng.integers(0, 10, 20)])
    j = np.concatenate([np.arange(1, n), rng.integers(10, n, 20)])
    s = np.stack([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(n)])
    scale, shift = rng.uniform(1, 5, n), rng.normal(size=(n, d))
    blocks, w = s[i] @ s[j].transpose(0, 2, 1), np.ones(len(i))
    results = []
    for limit in (4000, 1):
        monkeypatch.setattr(sync, "DENSE_ROWS", limit)
        r = sync.synchronise_rotations(n, i, j, blocks, w)
        assert M.orthogonal_mse(s, r) < 1e-8
        k = sync.synchronise_scales(n, i, j, scale[i] / scale[j], w)
        assert np.allclose(k, scale / scale.mean())
        results.append(sync.synchronise_translations(n, i, j, shift[j] - shift[i]))
    assert np.allclose(results[0], results[1], atol=1e-8) and np.allclose(results[0], shift - shift.mean(0))


def test_learned_alignment(clouds):
    points, patches = clouds[2]
    moved = apply_frames(patches, random_frames(list(range(12)), 2, seed=1, scale=False))
    stats = pair_statistics(moved, 2)
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(12, 2, 2)), rng.normal(size=(12, 2))
    loss, gw, gb = affine_loss(stats, w, b)
    for g, x in ((gw, w), (gb, b)):
        at = tuple(rng.integers(0, k) for k in x.shape)
        step = np.zeros_like(x)
        step[at] = 1e-5
        up = affine_loss(stats, w + step if x is w else w, b + step if x is b else b)[0]
        down = affine_loss(stats, w - step if x is w else w, b - step if x is b else b)[0]
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))
    affine = get_aligner("geo", moved, dim=2, num_epochs=300, learning_rate=0.5).align_patches()
    assert affine.loss_history[-1] < 0.1 * affine.loss_history[0]
    shifts = Frames.identity(list(range(12)), 2).translated(rng.normal(size=(12, 2)))
    rigid = get_aligner("geo", apply_frames(patches, shifts), dim=2, kind="orthogonal", num_epochs=300, learning_rate=0.05).align_patches()
    assert rigid.loss_history[-1] < 0.05 * rigid.loss_history[0]
    assert np.allclose(rigid.frames.rot @ rigid.frames.rot.transpose(0, 2, 1), np.eye(2))


def test_embeddings(spark, rows):
    patches = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [3.0, 2.0]), (2, 1, [8.0, 5.0]), (0, 2, [0.0, 0.0])], "patch_id int, node long, coords array<double>")
    assert [(r.node, list(r.coords)) for r in median_embedding(patches, 2).orderBy("node").collect()] == [(1, [3.0, 2.0]), (2, [0.0, 0.0])]
    grouping = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "patch_id int, super_patch int")
    got = {(r.patch_id, r.node): r.coords for r in mean_patches(patches, grouping, 2).collect()}
    assert got == {(0, 1): [2.0, 2.0], (1, 1): [8.0, 5.0], (0, 2): [0.0, 0.0]}
    full = complete_embedding(median_embedding(patches, 2), 4).orderBy("node").collect()
    assert [r.coords is None for r in full] == [True, False, False, True]


def test_measures(spark):
    scores = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert M.auc(scores) == 0.875
    assert M.auc(scores.where("label = 1")) is None
    entries = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (0, 1, 5.0), (1, 1, 5.0)], "patch_id int, position int, value double")
    assert M.transform_error(entries) == 0.5
    a = spark.createDataFrame([(0, [1.0, 0.0])], "node long, coords array<double>")
    assert M.procrustes_error(a, a, 2) is None


def test_copies_are_independent_and_pair_transforms_are_asked(clouds):
    truth, patches = clouds(2) if callable(clouds) else clouds[2]
    asked = []

    def transform(stats):
        asked.append(len(stats.n))
        return sync.relative_orthogonal(stats.cov)

    problem = AlignmentProblem(patches, pair_transform=transform)
    other = problem.copy()
    problem.align_patches(scale=True)
    assert asked == [len(problem.start.n)]
    assert np.allclose(other.frames.rot, np.eye(2)) and not np.allclose(problem.frames.rot, np.eye(2))


def test_unsettled_solvers_raise():
    n = 40
    i, j = np.arange(n - 1), np.arange(1, n)
    with pytest.raises(RuntimeError):
        sync._orthogonal_iteration(n, i, j, np.tile(np.eye(2), (n - 1, 1, 1)) * 0.5, 2, rounds=2)


def test_stored_patches_are_read_in_any_frames(spark, tmp_path, rows):
    path = str(tmp_path / "patches")
    spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0])], "patch_id int, node long, coords array<double>").write.parquet(path)
    frames = Frames.identity([0, 1], 2).scaled(np.array([1.0, 2.0]))
    assert rows(stored_patches(spark, path, frames)) == [(0, 1, [1.0, 2.0]), (1, 1, [6.0, 8.0])]
    assert rows(stored_patches(spark, path, patch_ids=[1])) == [(1, 1, [3.0, 4.0])]
