"""One pass over labelled vectors: counts, sums, cross-products, by label and optionally by fold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.linalg import Stats

#: Widest matrix whose cross-product is formed (32 MB of doubles).
MAX_WIDTH = 2000
#: Largest table that is taken to the driver or into a task (64 MB of doubles).
MAX_CELLS = 8_000_000


#: Most numbers that leave-one-out by down-dating may touch (rows times squared width: an hour on some 100 cores).
MAX_LOO = 1e15


def refuse_loo(n: float, width: int) -> None:
    """Leave-one-out refits a model of ``width`` squared numbers for every row: beyond MAX_LOO use folds."""
    if n * width * width > MAX_LOO:
        raise ValueError(f"leave-one-out of {int(n)} rows and {width} features; use folds")


def cross_products(vectors: DataFrame, width: int, fold: str | None = None, basis: np.ndarray | None = None) -> dict[object, Stats]:
    """Stats of (grp, x[, fold]) rows, per fold (or under None).

    Above MAX_WIDTH features the rows, of at most MAX_CELLS cells, give statistics in their row space; ``basis`` is that of
    earlier statistics which these shall be subtracted from.

    Each task sums its rows in blocks, over several splits of the input, so the number of partial matrices is that of the
    cores and does not grow with the input; matrix rows are added up on executors, and the driver gets one matrix per
    fold. For leave-one-out use totals and down-dating instead of folds.
    """
    if width > MAX_WIDTH:
        return _row_space(vectors, width, fold, basis)
    f = F.col(fold).cast("long") if fold else F.lit(0).cast("long")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx: dict[int, np.ndarray] = {}
        by: dict[tuple[int, str], list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(b.num_rows, -1)
            folds, labels = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), dtype=object)
            for k in np.unique(folds).tolist():
                at = folds == k
                part = x[at]
                xx[k] = xx.get(k, 0) + part.T @ part
                for g in set(labels[at].tolist()):
                    rows = x[at & (labels == g)]
                    cell = by.setdefault((k, g), [0, np.zeros(width)])
                    cell[0] += len(rows)
                    cell[1] = cell[1] + rows.sum(0)
        out = [(k, i, None, 0, m[i]) for k, m in xx.items() for i in range(width)] + [(k, -1, g, n, s) for (k, g), (n, s) in by.items()]
        for at in range(0, len(out), 512):
            part = out[at : at + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.string()), pa.array([r[3] for r in part], pa.int64()), pa.array([r[4].astype("<f8").tobytes() for r in part])],
                names=["fold", "i", "grp", "n", "v"],
            )

    def add(g: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x.as_buffer(), "<f8") for x in g.column("v"))
        return pa.table({"fold": g.column("fold")[:1], "i": g.column("i")[:1], "grp": g.column("grp")[:1], "n": pa.array([sum(g.column("n").to_pylist())], pa.int64()), "v": pa.array([np.asarray(v, "<f8").tobytes()])})

    schema = "fold long, i int, grp string, n long, v binary"
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    rows = vectors.select(f.alias("fold"), "grp", "x").coalesce(tasks).mapInArrow(sums, schema).groupBy("fold", "i", "grp").applyInArrow(add, schema).collect()
    classes = sorted({r["grp"] for r in rows if r["i"] == -1})
    out = {}
    for k in sorted({r["fold"] for r in rows}):
        xx, n, s = np.zeros((width, width)), np.zeros(len(classes)), np.zeros((width, len(classes)))
        for r in rows:
            if r["fold"] == k:
                v = np.frombuffer(r["v"], "<f8")
                if r["i"] >= 0:
                    xx[r["i"]] = v
                else:
                    n[classes.index(r["grp"])], s[:, classes.index(r["grp"])] = r["n"], v
        out[k if fold else None] = Stats(float(n.sum()), s.sum(1), xx, classes, n, s)
    return out


def local_rows(vectors: DataFrame, *more: str) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(x, grp, other columns) of all rows, in the order of ``more``; refused beyond MAX_CELLS cells."""
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n * width > MAX_CELLS:
        raise ValueError(f"{n} x {width} cells: above {MAX_WIDTH} features, up to {MAX_CELLS} cells are taken; select features first")
    rows = vectors.select("grp", "x", *more).orderBy(*(more or ("grp",))).collect()
    return np.array([r["x"] for r in rows], dtype=float).reshape(n, width), np.array([r["grp"] for r in rows], dtype=object), [tuple(r)[2:] for r in rows]


def row_stats(x: np.ndarray, y: np.ndarray, classes: list[str], basis: np.ndarray | None = None) -> Stats:
    """Stats of rows at hand; ``basis`` as in ``Stats``."""
    z = x if basis is None else x @ basis
    return Stats(float(len(z)), z.sum(0), z.T @ z, classes, np.array([float((y == c).sum()) for c in classes]), np.stack([z[y == c].sum(0) for c in classes], 1), basis)


def row_basis(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns (features x rows) that span the rows."""
    return np.linalg.qr(x.T)[0]


def _row_space(vectors: DataFrame, width: int, fold: str | None, basis: np.ndarray | None) -> dict[object, Stats]:
    x, y, more = local_rows(vectors, *([fold] if fold else []))
    if not len(x):
        return {}
    classes = sorted(set(y.tolist()))
    basis = row_basis(x) if basis is None else basis
    if not fold:
        return {None: row_stats(x, y, classes, basis)}
    f = np.array([m[0] for m in more])
    return {int(k): row_stats(x[f == k], y[f == k], classes, basis) for k in np.unique(f)}


def literal(values: np.ndarray) -> Column:
    """A constant array as one parsed expression: thousands of literal columns would take seconds to build."""
    if not np.isfinite(values).all():
        return F.array(*map(F.lit, values.tolist()))
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values.tolist()) + ")")


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, out: str, offset: np.ndarray | None = None) -> DataFrame:
    """Adds the array ``out``: (x - mean) . axes [+ offset], by array functions on the JVM."""
    centred = F.zip_with("x", literal(mean), lambda a, b: a - b)
    dots = []
    for j in range(axes.shape[1]):
        prod = F.zip_with(F.col("_c"), literal(axes[:, j]), lambda a, b: a * b)
        dots.append(F.aggregate(prod, F.lit(0.0 if offset is None else float(offset[j])), lambda acc, v: acc + v))
    return vectors.withColumn("_c", centred).withColumn(out, F.array(*dots)).drop("_c")
