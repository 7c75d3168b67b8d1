"""Dense kernels on sufficient statistics; tables of few rows and very many features are taken in their row space."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

TOL, MAX_TURNS = 1e-6, 500
_TINY = np.finfo(float).eps


@dataclass
class Stats:
    """n, feature sums, X'X and per-class sums and counts of a labelled table (uncentred).

    With ``basis`` (orthonormal columns that span all rows) sums and products are those of ``x @ basis``: tables of few
    rows and very many features are modelled in their row space, which loses nothing.
    """

    n: float
    sums: np.ndarray  # p
    xx: np.ndarray  # p x p
    classes: list[str]
    class_n: np.ndarray  # k
    class_sums: np.ndarray  # p x k
    basis: np.ndarray | None = None  # features x p

    def inner(self, x: np.ndarray) -> np.ndarray:
        """Rows in the coordinates of these statistics."""
        return x if self.basis is None else x @ self.basis

    def outer(self, a: np.ndarray) -> np.ndarray:
        """Vectors (columns) back in the coordinates of the features."""
        return a if self.basis is None else self.basis @ a

    def without(self, x: np.ndarray, label: str) -> Stats:
        """Down-dated by one row."""
        x = self.inner(x)
        k = self.classes.index(label)
        n, s = self.class_n.copy(), self.class_sums.copy()
        n[k] -= 1
        s[:, k] -= x
        return Stats(self.n - 1, self.sums - x, self.xx - np.outer(x, x), self.classes, n, s, self.basis)

    def minus(self, other: Stats) -> Stats:
        return Stats(self.n - other.n, self.sums - other.sums, self.xx - other.xx, self.classes, self.class_n - other.class_n, self.class_sums - other.class_sums, self.basis)

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def centred(self) -> np.ndarray:
        return self.xx - np.outer(self.sums, self.sums) / self.n

    def targets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centred X'Y and Y'Y of the one-hot labels (two classes: one column for the second), and their means."""
        pick = [1] if len(self.classes) == 2 else list(range(len(self.classes)))
        m = self.class_n[pick] / self.n
        xy = self.class_sums[:, pick] - np.outer(self.sums, m)
        yy = np.diag(self.class_n[pick]) - self.n * np.outer(m, m)
        return xy, yy, m


def flip_sign(v: np.ndarray) -> float:
    """+1 or -1 so that the entry of largest magnitude becomes positive; of equals (but for rounding) the first counts."""
    size = np.abs(v)
    return -1.0 if v[(size >= size.max() * (1 - 1e-9)).argmax()] < 0 else 1.0


def principal_components(stats: Stats, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(variance shares of the leading components, unit loadings p x k)."""
    centred = stats.centred()
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[: min(k, len(values))]
    v = stats.outer(vectors[:, order])
    v = v * np.array([flip_sign(v[:, i]) for i in range(v.shape[1])])
    return np.clip(values[order], 0, None) / max(np.trace(centred), _TINY), v


@dataclass
class Pls:
    weights: np.ndarray  # p x a
    loadings: np.ndarray  # p x a
    y_loadings: np.ndarray  # k x a
    score_ss: np.ndarray  # a: t't
    rotations: np.ndarray  # p x a
    coef: np.ndarray  # p x k
    x_mean: np.ndarray
    y_mean: np.ndarray

    def vip(self) -> np.ndarray:
        ss = self.score_ss * (self.y_loadings**2).sum(0)
        return np.sqrt(len(self.weights) * ((self.weights**2) * ss).sum(1) / max(ss.sum(), _TINY))


def pls(stats: Stats, n_components: int) -> Pls:
    """PLS2 by NIPALS on cross-products: one pass over the rows gives every component."""
    s = stats.centred()
    c, yy, y_mean = stats.targets()
    c0 = c
    w_all, p_all, q_all, tt_all = [], [], [], []
    for _ in range(n_components):
        live = np.flatnonzero(np.diag(yy) > 1e-12 * max(stats.n, 1))
        if not len(live) or np.abs(c).max(initial=0) < 1e-14:
            break
        q = np.zeros(c.shape[1])
        q[live[0]] = 1.0
        old = None
        for _turn in range(MAX_TURNS):
            w = c @ q
            w = w / (np.linalg.norm(w) + _TINY)
            tt = w @ s @ w
            q = c.T @ w / tt
            if old is not None and ((w - old) ** 2).sum() < TOL or c.shape[1] == 1:
                break
            old = w
        w = w * flip_sign(stats.outer(w))
        tt = float(w @ s @ w)
        p, q = s @ w / tt, c.T @ w / tt
        s = s - tt * np.outer(p, p)
        c = c - tt * np.outer(p, q)
        yy = yy - tt * np.outer(q, q)
        for out, x in zip((w_all, p_all, q_all, tt_all), (w, p, q, tt), strict=True):
            out.append(x)
    if not w_all:
        z = stats.outer(np.zeros((len(s), 0)))
        return Pls(z, z, np.zeros((c0.shape[1], 0)), np.zeros(0), z, np.zeros((len(z), c0.shape[1])), stats.outer(stats.mean), y_mean)
    w, p, q = np.stack(w_all, 1), np.stack(p_all, 1), np.stack(q_all, 1)
    rot = stats.outer(w @ np.linalg.pinv(p.T @ w))
    return Pls(stats.outer(w), stats.outer(p), q, np.array(tt_all), rot, rot @ q.T, stats.outer(stats.mean), y_mean)


def predict_class(y_hat: np.ndarray, classes: list[str]) -> np.ndarray:
    """First class of largest response; two classes: the second above one half."""
    if len(classes) == 2:
        return np.array(classes, dtype=object)[(y_hat[:, 0] > 0.5).astype(int)]
    return np.array(classes, dtype=object)[y_hat.argmax(1)]


def soft_keep(a: np.ndarray, keep: int) -> np.ndarray:
    """Soft-thresholded so that ``keep`` entries stay, scaled to length one."""
    if keep < len(a):
        order = np.argsort(-np.abs(a), kind="stable")
        cut = np.abs(a[order[keep]])
        out = np.sign(a) * np.clip(np.abs(a) - cut, 0, None)
        if not out.any():  # ties at the cut
            out[order[:keep]] = a[order[:keep]]
        a = out
    return a / max(np.linalg.norm(a), _TINY)


def _ascend(a: list[np.ndarray], cross: Callable[[int, int, np.ndarray], np.ndarray], design: np.ndarray, keep: list[int | None], tol: float, turns: int) -> list[np.ndarray]:
    """Block by block, the weights that agree best with the linked blocks; ``cross(i, j, v)`` is the product of X_i'X_j and v."""
    for _turn in range(turns):
        change = 0.0
        for i in range(len(a)):
            grad = sum((design[i, j] * cross(i, j, a[j]) for j in range(len(a)) if j != i and design[i, j]), np.zeros(len(a[i])))
            if not np.abs(grad).max(initial=0):
                continue
            new = soft_keep(grad, keep[i] if keep[i] is not None else len(grad))
            change += float(((new - a[i]) ** 2).sum())
            a[i] = new
        if change < tol:
            break
    return a


def sparse_multiblock(s: np.ndarray, ranges: list[tuple[int, int]], design: np.ndarray, keep: list[int | None], n_components: int, tol: float = 1e-6, turns: int = 100) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sparse generalised canonical correlation (Horst scheme) on the centred cross-product of all blocks.

    Returns per block the loadings (p_j x a) and the rotations (p_j x a) that give variates from
    undeflated data. Blocks with ``keep`` None are dense and not deflated (the label block).
    """
    j_all = range(len(ranges))
    part = lambda m, i, j: m[ranges[i][0] : ranges[i][1], ranges[j][0] : ranges[j][1]]
    move = [np.eye(b - a) for a, b in ranges]
    loadings, rotations = [[] for _ in j_all], [[] for _ in j_all]
    for _ in range(n_components):
        g = {(i, j): move[i].T @ part(s, i, j) @ move[j] for i in j_all for j in j_all}
        a = []
        for i in j_all:
            first = np.linalg.eigh(g[i, i])[1][:, -1]
            a.append(soft_keep(first * flip_sign(first), keep[i] if keep[i] is not None else len(first)))
        a = _ascend(a, lambda i, j, v: g[i, j] @ v, design, keep, tol, turns)  # noqa: B023
        for i in j_all:
            sign = flip_sign(a[i]) if i == 0 else (1.0 if a[0] @ g[0, i] @ a[i] >= 0 else -1.0)
            a[i] = a[i] * sign
        for i in j_all:
            loadings[i].append(a[i])
            rotations[i].append(move[i] @ a[i])
            if keep[i] is not None:
                tt = float(a[i] @ g[i, i] @ a[i])
                if tt > _TINY:
                    move[i] = move[i] @ (np.eye(len(a[i])) - np.outer(a[i], g[i, i] @ a[i] / tt))
    return [np.stack(x, 1) for x in loadings], [np.stack(x, 1) for x in rotations]


def sparse_multiblock_rows(z: list[np.ndarray], design: np.ndarray, keep: list[int | None], n_components: int, tol: float = 1e-6, turns: int = 100) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``sparse_multiblock`` on the centred blocks themselves (n x p_j), for few rows and many features."""
    z, j_all = list(z), range(len(z))
    loadings, rotations, moved = [[] for _ in j_all], [[] for _ in j_all], [[] for _ in j_all]
    for _ in range(n_components):
        a = []
        for i in j_all:
            values, vectors = np.linalg.eigh(z[i] @ z[i].T)
            first = z[i].T @ vectors[:, -1]
            first = first / max(np.linalg.norm(first), _TINY)
            a.append(soft_keep(first * flip_sign(first), keep[i] if keep[i] is not None else len(first)))
        a = _ascend(a, lambda i, j, v: z[i].T @ (z[j] @ v), design, keep, tol, turns)
        for i in j_all:
            sign = flip_sign(a[i]) if i == 0 else (1.0 if (z[0] @ a[0]) @ (z[i] @ a[i]) >= 0 else -1.0)
            a[i] = a[i] * sign
        for i in j_all:
            r = a[i]
            for w, c in reversed(moved[i]):
                r = r - w * (c @ r)
            loadings[i].append(a[i])
            rotations[i].append(r)
            if keep[i] is not None:
                t = z[i] @ a[i]
                if t @ t > _TINY:
                    c = z[i].T @ t / (t @ t)
                    moved[i].append((a[i], c))
                    z[i] = z[i] - np.outer(t, c)
    return [np.stack(x, 1) for x in loadings], [np.stack(x, 1) for x in rotations]


# --- many small models at once: the last axis counts them ------------------------------------------------------


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("pqb,qb->pb", m, v)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(0)


def flip_sign_each(v: np.ndarray) -> np.ndarray:
    size = np.abs(v)
    at = (size >= size.max(0) * (1 - 1e-9)).argmax(0)
    return np.where(np.take_along_axis(v, at[None], 0)[0] < 0, -1.0, 1.0)


def soft_keep_each(a: np.ndarray, keep: int) -> np.ndarray:
    if keep < len(a):
        order = np.argsort(-np.abs(a), axis=0, kind="stable")
        least = np.take_along_axis(np.abs(a), order[keep : keep + 1], 0)
        out = np.sign(a) * np.clip(np.abs(a) - least, 0, None)
        tied = ~out.any(0)
        if tied.any():
            first = np.zeros(a.shape, dtype=bool)
            np.put_along_axis(first, order[:keep], True, 0)
            out = np.where(tied & first, a, out)
        a = out
    return a / np.maximum(np.sqrt(_dot(a, a)), _TINY)


def leading_each(g: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the largest eigenvalues of symmetric matrices (p x p x b)."""
    if len(g) == 1:
        return np.ones(g.shape[1:])
    return np.linalg.eigh(np.moveaxis(g, -1, 0))[1][:, :, -1].T


def _ascend_each(a: list[np.ndarray], g: dict, design: np.ndarray, keep: list[int | None], tol: float, turns: int) -> list[np.ndarray]:
    """``_ascend`` for every model until its own end; those that have ended are left out when they are many."""
    out, at, done = [v.copy() for v in a], np.arange(a[0].shape[1]), np.zeros(a[0].shape[1], dtype=bool)
    for _turn in range(turns):
        change = np.zeros(len(at))
        for i in range(len(a)):
            linked = [j for j in range(len(a)) if j != i and design[i, j]]
            if not linked:
                continue
            grad = sum(design[i, j] * _times(g[i, j], a[j]) for j in linked)
            new = soft_keep_each(grad, keep[i] if keep[i] is not None else len(grad))
            new = np.where(done | (np.abs(grad).max(0) == 0), a[i], new)
            change += ((new - a[i]) ** 2).sum(0)
            a[i] = new
        done |= change < tol
        if 2 * done.sum() >= len(done):
            for v, w in zip(out, a, strict=True):
                v[:, at[done]] = w[:, done]
            live = np.flatnonzero(~done)
            if not len(live):
                return out
            a, g, at, done = [v[:, live] for v in a], {k: m[:, :, live] for k, m in g.items()}, at[live], done[live]
    for v, w in zip(out, a, strict=True):
        v[:, at] = w
    return out


def sparse_multiblock_each(s: np.ndarray, ranges: list[tuple[int, int]], design: np.ndarray, keep: list[int | None], n_components: int, kinds: np.ndarray | None = None, tol: float = 1e-6, turns: int = 100) -> list[np.ndarray]:
    """Rotations (p_j x a x b) of ``sparse_multiblock`` on each of many cross-products (q x q x b).

    Models of one of ``kinds`` have equal products of the dense block.
    """
    j_all, linked = range(len(ranges)), lambda i, j: i == j or i == 0 or j == 0 or design[i, j]
    raw = {(i, j): s[ranges[i][0] : ranges[i][1], ranges[j][0] : ranges[j][1]] for i in j_all for j in j_all if linked(i, j)}
    move: list[np.ndarray | None] = [None for _ in j_all]
    rotations = [[] for _ in j_all]
    for _ in range(n_components):
        g = {}
        for (i, j), m in raw.items():
            m = m if move[i] is None else np.einsum("pab,pqb->aqb", move[i], m)
            g[i, j] = m if move[j] is None else np.einsum("pqb,qab->pab", m, move[j])
        a = []
        for i in j_all:
            if keep[i] is None and kinds is not None:
                _, some, which = np.unique(kinds, return_index=True, return_inverse=True)
                first = leading_each(g[i, i][:, :, some])[:, which]
            else:
                first = leading_each(g[i, i])
            a.append(soft_keep_each(first * flip_sign_each(first), keep[i] if keep[i] is not None else len(first)))
        a = _ascend_each(a, g, design, keep, tol, turns)
        for i in j_all:
            a[i] = a[i] * (flip_sign_each(a[i]) if i == 0 else np.where(_dot(a[0], _times(g[0, i], a[i])) >= 0, 1.0, -1.0))
        for i in j_all:
            rotations[i].append(a[i] if move[i] is None else _times(move[i], a[i]))
            if keep[i] is not None and len(rotations[i]) < n_components:
                ga = _times(g[i, i], a[i])
                tt = _dot(a[i], ga)
                ga = np.where(tt > _TINY, ga / np.where(tt > _TINY, tt, 1.0), 0.0)
                old = np.broadcast_to(np.eye(len(ga))[:, :, None], (len(ga), *ga.shape)) if move[i] is None else move[i]
                move[i] = old - rotations[i][-1][:, None] * ga[None]
    return [np.stack(r, 1) for r in rotations]
