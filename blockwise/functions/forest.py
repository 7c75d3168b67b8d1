"""Classification trees on features that are cut into bins, grown level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature (codes are bytes).
BINS = 32


def split_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` thresholds, midway between neighbouring values: all of them if they are few, else at equal counts."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) <= bins:
        return (v[1:] + v[:-1]) / 2
    upto, stride = np.cumsum(n), n.sum() / bins
    at = np.searchsorted(upto[:-1] + upto[1:], 2 * stride * np.arange(1, bins), side="right")
    at = np.unique(at[at < len(v) - 1])
    return (v[at] + v[at + 1]) / 2


def codes_of(x: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: a value is at or under threshold k if its bin is at most k."""
    return np.stack([np.searchsorted(p, x[:, i]) for i, p in enumerate(points)], 1).astype(np.uint8)


@dataclass
class Tree:
    """Nodes with feature (-1: leaf), threshold and left child (the right one follows); leaves with a class, mixed ones with shares."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    cls: np.ndarray  # class of a pure leaf; of a mixed one -1 - its row of ``mixed``
    mixed: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """(rows x classes) shares of the classes in each row's leaf."""
        node, at = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(at):
            at = at[self.feature[node[at]] >= 0]
            here = node[at]
            node[at] = self.left[here] + ~(x[at, self.feature[here]] <= self.threshold[here])
        c, out = self.cls[node], np.zeros((len(x), self.mixed.shape[1]))
        pure = np.flatnonzero(c >= 0)
        out[pure, c[pure]] = 1.0
        rest = np.flatnonzero(c < 0)
        out[rest] = self.mixed[-1 - c[rest]]
        return out


def grow(codes: np.ndarray, y: np.ndarray, n_classes: int, points: list[np.ndarray], r: np.random.RandomState, per_node: int, depth: int = 30) -> tuple[Tree, np.ndarray]:
    """(tree, decrease of impurity by feature): Gini impurity, rows drawn with replacement (Poisson weights), ``per_node`` features tried at each node."""
    n, p = codes.shape
    w = r.poisson(1.0, n).astype(float)
    if not w.any():
        w[:] = 1.0
    rows = np.flatnonzero(w)
    w, lab, node, c = w[rows], y[rows], np.zeros(len(rows), dtype=np.int64), n_classes
    flat, gains, levels, before, size = np.ascontiguousarray(codes).ravel(), np.zeros(p), [], 0, 1
    for d in range(depth + 1):
        count = np.bincount(node * c + lab, w, size * c).reshape(size, c)
        feature, threshold, left = np.full(size, -1, dtype=np.int32), np.zeros(size), np.zeros(size, dtype=np.int64)
        live = ((count > 0).sum(1) > 1) & (d < depth)
        new = 0
        if live.any():
            keep = live[node]
            rows, w, lab, node = rows[keep], w[keep], lab[keep], (np.cumsum(live) - 1)[node[keep]]
            own, m = count[live], int(live.sum())
            start, base = np.searchsorted(node, np.arange(m)), (own**2).sum(1) / own.sum(1)
            picks = r.random_sample((m, p)).argpartition(per_node - 1, axis=1)[:, :per_node] if per_node < p else np.broadcast_to(np.arange(p), (m, p))
            best, by, upto = np.full(m, 1e-9), np.full(m, -1), np.zeros(m, dtype=np.int64)
            for s in range(per_node):
                key = node * 256 + flat[rows * p + picks[node, s]]
                order = np.argsort(key, kind="stable")
                key = key[order]
                at = np.flatnonzero((key[1:] != key[:-1]) & (node[1:] == node[:-1])) + 1  # rows stay sorted by node
                if not len(at):
                    continue
                run = np.zeros((len(rows) + 1, c))
                run[np.arange(1, len(rows) + 1), lab[order]] = w[order]
                np.cumsum(run, axis=0, out=run)
                of = node[at]
                lc = run[at] - run[start[of]]
                rc = own[of] - lc
                gain = (lc**2).sum(1) / lc.sum(1) + (rc**2).sum(1) / rc.sum(1) - base[of]
                seg = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
                most = np.maximum.reduceat(gain, seg)
                which = np.flatnonzero(gain == np.repeat(most, np.diff([*seg, len(of)])))
                ids, first = np.unique(of[which], return_index=True)
                better = most > best[ids]
                ids, which = ids[better], which[first[better]]
                best[ids], by[ids], upto[ids] = gain[which], picks[ids, s], key[at[which] - 1] % 256
            split = by >= 0
            np.add.at(gains, by[split], best[split])
            new = int(split.sum())
            rank, where = np.cumsum(split) - 1, np.flatnonzero(live)[split]
            feature[where], left[where] = by[split], before + size + 2 * rank[split]
            threshold[where] = [points[f][k] for f, k in zip(by[split].tolist(), upto[split].tolist(), strict=True)]
            go = split[node]
            rows, w, lab, node = rows[go], w[go], lab[go], node[go]
            node = 2 * rank[node] + (flat[rows * p + by[node]] > upto[node])
            order = np.argsort(node, kind="stable")
            rows, w, lab, node = rows[order], w[order], lab[order], node[order]
        levels.append((feature, threshold, left, count))
        before, size = before + size, 2 * new
        if not new:
            break
    feature, threshold, left, count = (np.concatenate([lev[i] for lev in levels]) for i in range(4))
    cls = count.argmax(1).astype(np.int32)
    some = np.flatnonzero((feature < 0) & ((count > 0).sum(1) > 1))
    cls[some] = -1 - np.arange(len(some))
    return Tree(feature, threshold, left.astype(np.int32), cls, count[some] / count[some].sum(1, keepdims=True)), gains
