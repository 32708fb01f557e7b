"""Solves over the patch graph: one small matrix per patch, on the driver.

Inputs are blocks of the patch graph, so their size follows the number of
patches and their overlaps, never that of nodes.  Up to ``DENSE_ROWS`` rows the
eigenproblems are solved densely, beyond by orthogonal iteration over the
blocks.
"""

from __future__ import annotations

import numpy as np

DENSE_ROWS = 4_000
# An iterative solution that still changes by more is an error.
UNSETTLED = 1e-7


def nearest_orthogonal(m: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition, reflections allowed."""
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def relative_orthogonal(cov: np.ndarray) -> np.ndarray:
    """R with ``x_i @ R`` nearest to ``x_j``, from the centred cross-covariance."""
    return nearest_orthogonal(cov)


def relative_scale(ss_i: np.ndarray, ss_j: np.ndarray, clamp: float = 1e8) -> np.ndarray:
    """Ratio of spreads, kept within ``[1 / clamp, clamp]``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.sqrt(ss_i / ss_j)
    ratio = np.where((ss_i <= 0) & (ss_j <= 0), 1.0, ratio)
    return np.clip(np.nan_to_num(ratio, nan=1.0, posinf=clamp), 1 / clamp, clamp)


def _both_ways(i: np.ndarray, j: np.ndarray, blocks: np.ndarray, back: np.ndarray, w: np.ndarray):
    return np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([blocks, back]), np.concatenate([w, w])


def synchronise_rotations(n: int, i, j, blocks: np.ndarray, w: np.ndarray) -> np.ndarray:
    """S with ``S_i`` near ``R_ij S_j``: leading eigenvectors of the symmetrically normalised block matrix."""
    d = blocks.shape[1]
    rows, cols, mats, weights = _both_ways(i, j, blocks, blocks.transpose(0, 2, 1), w)
    total = np.bincount(rows, weights, n)
    total[total == 0] = 1.0
    mats = mats * (weights / np.sqrt(total[rows] * total[cols]))[:, None, None]
    if n * d <= DENSE_ROWS:
        full = np.zeros((n, d, n, d))
        full[rows, :, cols, :] += mats
        _, vectors = np.linalg.eigh(full.reshape(n * d, n * d))
        found = vectors[:, -d:].reshape(n, d, d)
    else:
        found = _orthogonal_iteration(n, rows, cols, mats, d)
    return nearest_orthogonal(found)


def _orthogonal_iteration(n, rows, cols, mats, d, rounds: int = 2_000, tol: float = 1e-12) -> np.ndarray:
    """The leading d-dimensional eigenspace of (M + I) / 2; the shift keeps eigenvalue -1 of bipartite graphs out."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(n * d, d)))[0]
    change = np.inf
    for _ in range(rounds):
        x = q.reshape(n, d, d)
        y = x.copy()
        np.add.at(y, rows, mats @ x[cols])
        new = np.linalg.qr(y.reshape(n * d, d))[0]
        change = np.linalg.norm(new - q @ (q.T @ new))
        q = new
        if change < tol:
            break
    if change > UNSETTLED:
        raise RuntimeError(f"rotations still change by {change:.1e} after {rounds} rounds")
    return q.reshape(n, d, d)


def synchronise_rotations_svd(n: int, i, j, blocks: np.ndarray, w: np.ndarray) -> np.ndarray:
    """S from the smallest right singular vectors of the row-stochastic block matrix minus the identity."""
    d = blocks.shape[1]
    if n * d > DENSE_ROWS:
        raise RuntimeError(f"{n} patches of dimension {d} are too many for the singular value variant")
    rows, cols, mats, weights = _both_ways(i, j, blocks, blocks.transpose(0, 2, 1), w)
    total = np.bincount(rows, weights, n)
    total[total == 0] = 1.0
    full = np.zeros((n, d, n, d))
    full[rows, :, cols, :] += mats * (weights / total[rows])[:, None, None]
    _, _, vt = np.linalg.svd(full.reshape(n * d, n * d) - np.eye(n * d))
    return nearest_orthogonal(vt[-d:].T.reshape(n, d, d))


def synchronise_scales(n: int, i, j, ratio: np.ndarray, w: np.ndarray, clamp: float = 1e8) -> np.ndarray:
    """s with ``s_i`` near ``ratio_ij s_j``, of mean 1: the Perron vector of the row-stochastic ratios."""
    rows, cols, values, weights = _both_ways(i, j, ratio, 1 / ratio, w)
    total = np.bincount(rows, weights, n)
    total[total == 0] = 1.0
    values = values * weights / total[rows]
    if n <= DENSE_ROWS:
        full = np.zeros((n, n))
        np.add.at(full, (rows, cols), values)
        # Logarithms first: a near diagonal scaling keeps the eigenproblem well conditioned.
        guess = _log_scales(n, i, j, ratio)
        full = full * guess[None, :] / guess[:, None]
        eigenvalues, vectors = np.linalg.eig((full + np.eye(n)) / 2)
        s = np.abs(np.real(vectors[:, np.argmax(np.real(eigenvalues))])) * guess
    else:
        s = _log_scales(n, i, j, ratio)
        for _ in range(10_000):
            new = (s + np.bincount(rows, values * s[cols], n)) / 2
            new /= new.mean()
            change = np.abs(new - s).max() / np.abs(s).max()
            s = new
            if change < 1e-14:
                break
        if change > UNSETTLED:
            raise RuntimeError(f"scales still change by {change:.1e}")
    s = np.abs(s) / np.abs(s).mean()
    return np.clip(s, 1 / clamp, clamp)


def _log_scales(n, i, j, ratio) -> np.ndarray:
    """Least squares of ``log s_i - log s_j = log ratio``."""
    return np.exp(synchronise_translations(n, i, j, -np.log(ratio)[:, None])[:, 0])


def synchronise_translations(n: int, i, j, offset: np.ndarray) -> np.ndarray:
    """t of minimal norm with ``t_j - t_i`` nearest to ``offset``, every pair weighing the same."""
    rhs = np.zeros((n, offset.shape[1]))
    np.add.at(rhs, j, offset)
    np.add.at(rhs, i, -offset)
    if n <= DENSE_ROWS:
        laplacian = np.zeros((n, n))
        np.add.at(laplacian, (i, i), 1)
        np.add.at(laplacian, (j, j), 1)
        np.add.at(laplacian, (i, j), -1)
        np.add.at(laplacian, (j, i), -1)
        return np.linalg.lstsq(laplacian, rhs, rcond=None)[0]
    return _conjugate_gradients(n, i, j, rhs)


def _conjugate_gradients(n, i, j, rhs: np.ndarray, tol: float = 1e-13) -> np.ndarray:
    degree = (np.bincount(i, minlength=n) + np.bincount(j, minlength=n)).astype(float)

    def times(x: np.ndarray) -> np.ndarray:
        y = degree[:, None] * x
        np.add.at(y, i, -x[j])
        np.add.at(y, j, -x[i])
        return y

    x = np.zeros_like(rhs)
    r = rhs.copy()
    p = r.copy()
    rs = (r * r).sum(0)
    goal = tol**2 * np.maximum(rs, 1e-300)
    for _ in range(10 * n):
        if (rs <= goal).all():
            break
        ap = times(p)
        alpha = np.where(rs > goal, rs / np.maximum((p * ap).sum(0), 1e-300), 0)
        x += alpha * p
        r -= alpha * ap
        new = (r * r).sum(0)
        p = r + np.where(rs > 0, new / np.maximum(rs, 1e-300), 0) * p
        rs = new
    if (rs > UNSETTLED**2 * goal / tol**2).any():
        raise RuntimeError("translations have not converged")
    return x - x.mean(0)
