"""Support vector machine with a radial kernel on rows at hand: two classes by sequential minimal optimisation."""

from __future__ import annotations

import numpy as np

_TAU = 1e-12
#: Rows whose kernel is formed at once (128 MB of doubles).
WHOLE_KERNEL_ROWS = 4000
#: Cells of the kernel between a working set and all rows (96 MB).
WORKING_CELLS = 12_000_000


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.clip(d, 0, None))


def _steps(kernel: np.ndarray, y: np.ndarray, alpha: np.ndarray, grad: np.ndarray, c: float, tol: float, turns: int) -> None:
    """Moves multipliers and gradient, in place, until no pair violates optimality by ``tol``.

    Each turn moves the pair that violates it most, the second chosen by its gain.
    """
    diag = np.diag(kernel)
    for _ in range(turns):
        up = np.where(y > 0, alpha < c, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < c)
        pull = -y * grad
        i = int(np.where(up, pull, -np.inf).argmax())
        gap = np.where(low, pull[i] - pull, -np.inf)
        if gap.max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * kernel[i], _TAU)
        j = int(np.where(gap > 0, gap * gap / curve, -np.inf).argmax())
        step = min(gap[j] / curve[j], c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * step * (kernel[i] - kernel[j])


def _machine(alpha: np.ndarray, grad: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    alpha = np.clip(alpha, 0, c)
    free = (alpha > 0) & (alpha < c)
    if free.any():
        offset = float((y * grad)[free].mean())
    else:
        up = np.where(y > 0, alpha < c, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < c)
        offset = float(((y * grad)[up].min() + (y * grad)[low].max()) / 2)
    return alpha * y, offset


def two_class(kernel: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-3, turns: int = 1_000_000) -> tuple[np.ndarray, float]:
    """(coefficients, offset) of the decision ``kernel @ coefficients - offset`` for labels +1 and -1."""
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    _steps(kernel, y, alpha, grad, c, tol, turns)
    return _machine(alpha, grad, y, c)


def two_class_rows(x: np.ndarray, y: np.ndarray, gamma: float, c: float = 1.0, tol: float = 1e-3, whole: int = WHOLE_KERNEL_ROWS, cells: int = WORKING_CELLS) -> tuple[np.ndarray, float]:
    """``two_class`` on rows, to the same tolerance; of more than ``whole`` rows only the kernel of a working set is formed at a time.

    A working set holds the rows that violate optimality most on either side, and half of the one before.
    """
    n = len(y)
    if n <= whole:
        return two_class(radial(x, x, gamma), y, c, tol)
    alpha, grad = np.zeros(n), -np.ones(n)
    size = max(16, min(1024, cells // n, n // 2))
    kept, rows = np.zeros(0, dtype=int), np.zeros((0, n))
    while True:
        pull = -y * grad
        high = np.where(np.where(y > 0, alpha < c, alpha > 0), pull, -np.inf)
        low = np.where(np.where(y > 0, alpha > 0, alpha < c), pull, np.inf)
        gap = high.max() - low.min()
        if gap < tol:
            break
        stays = len(kept) // 2
        kept, rows = kept[-stays:] if stays else kept[:0], rows[-stays:] if stays else rows[:0]
        high[kept], low[kept] = -np.inf, np.inf
        some = (size - stays) // 2
        first = np.argpartition(-high, some - 1)[:some]
        first = first[np.isfinite(high[first])]
        low[first] = np.inf
        second = np.argpartition(low, some - 1)[:some]
        new = np.concatenate([first, second[np.isfinite(low[second])]])
        kept, rows = np.concatenate([kept, new]), np.concatenate([rows, radial(x[new], x, gamma)])
        before, part = alpha[kept], grad[kept]
        after = before.copy()
        _steps(rows[:, kept], y[kept], after, part, c, max(tol / 2, gap / 10), 100 * len(kept))
        alpha[kept] = after
        grad += y * (((after - before) * y[kept]) @ rows)
    return _machine(alpha, grad, y, c)
