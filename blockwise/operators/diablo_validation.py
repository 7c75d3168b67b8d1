"""Validation of the sparse multi-block model: held-out error, permutation test, choice of kept features.

The model and its class centroids are functions of the sufficient statistics alone, so a held-out row or fold is
subtracted from the totals; rows are never shuffled to be refitted.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.linalg import Stats, sparse_multiblock_each
from blockwise.operators.diablo import fit_products, fit_rows, keep_grid, keep_rule, links
from blockwise.operators.layer import cut
from blockwise.operators.ranks import row_numbers
from blockwise.operators.resample import folds, local_matrix, run_tasks
from blockwise.operators.statistics import MAX_CELLS, MAX_WIDTH, cross_products, local_rows, refuse_loo, row_stats as _stats_of


class Labels(NamedTuple):
    classes: list[str]
    class_n: np.ndarray


def fit_stats(stats: Stats, sizes: list[int], keep: list[int], n_components: int, design: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: (mean, rotations, class centroids in variate space)."""
    _, rotations = fit_products(stats, sizes, keep, n_components, design)
    means = stats.class_sums / np.maximum(stats.class_n, 1)
    return _centroids(rotations, sizes, stats.mean, means)


def fit_few(x: np.ndarray, y: np.ndarray, classes: list[str], sizes: list[int], keep: list[int], n_components: int, design: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same from few rows of many features."""
    _, rotations = fit_rows(x, y, classes, sizes, keep, n_components, design)
    means = np.stack([x[y == c].mean(0) if (y == c).any() else np.zeros(x.shape[1]) for c in classes], 1)
    return _centroids(rotations, sizes, x.mean(0), means)


def _centroids(rotations: list[np.ndarray], sizes: list[int], mean: np.ndarray, class_means: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out, at = [], 0
    for r, size in zip(rotations, sizes, strict=True):
        m = mean[at : at + size]
        out.append((m, r, (class_means[at : at + size] - m[:, None]).T @ r))
        at += size
    return out


def predict_rows(model: list, x: np.ndarray, sizes: list[int], stats: Stats | Labels) -> list[str]:
    """Vote of the blocks by nearest centroid; ties by the least total distance. Empty classes are not chosen."""
    return [stats.classes[i] for i in _classes_of(model, x, sizes, stats.class_n)]


def _classes_of(model: list, x: np.ndarray, sizes: list[int], class_n: np.ndarray) -> np.ndarray:
    distances, at = [], 0
    for (mean, rot, cen), size in zip(model, sizes, strict=True):
        distances.append((((x[:, at : at + size] - mean) @ rot)[:, None] - cen).__pow__(2).sum(2))
        at += size
    return _vote(distances, class_n)


def _vote(distances: list[np.ndarray], class_n: np.ndarray) -> np.ndarray:
    """Class numbers from the blocks' distances (rows x classes)."""
    votes, total = np.zeros(distances[0].shape), np.zeros(distances[0].shape)
    for d in distances:
        d = np.where(class_n <= 0, np.inf, d)
        votes[np.arange(len(d)), d.argmin(1)] += 1
        total += d
    return np.lexsort((np.broadcast_to(np.arange(votes.shape[1]), votes.shape), total, -votes), axis=1)[:, 0]


#: Numbers of the cross-products that are held at once when many models are fitted together (64 MB).
MODEL_CELLS = 8_000_000


def held_out_classes(stats: Stats, x: np.ndarray, y: np.ndarray, sizes: list[int], keep: list[int], n_components: int, design: float) -> np.ndarray:
    """Class numbers of rows of classes ``y``, each by the model of all rows of ``stats`` but itself.

    The down-dated models of many rows are fitted at once.
    """
    width, k = len(stats.sums), len(stats.classes)
    step, out = max(1, min(4096, MODEL_CELLS // (width + k) ** 2)), np.zeros(len(x), dtype=int)
    ends = np.cumsum([0, *sizes, k]).tolist()
    ranges, linked = list(zip(ends, ends[1:], strict=False)), links(len(sizes), design)
    for at in range(0, len(x), step):
        r, own = np.ascontiguousarray(x[at : at + step].T), np.eye(k)[:, y[at : at + step]]
        n, class_n = stats.n - 1, stats.class_n[:, None] - own
        sums, share = stats.sums[:, None] - r, class_n / (stats.n - 1)
        class_sums = stats.class_sums[:, :, None] - r[:, None] * own[None]
        s = np.empty((width + k, width + k, r.shape[1]))
        s[:width, :width] = stats.xx[:, :, None] - r[:, None] * r[None] - sums[:, None] * sums[None] / n
        s[:width, width:] = class_sums - sums[:, None] * share[None]
        s[width:, :width] = np.swapaxes(s[:width, width:], 0, 1)
        s[width:, width:] = np.eye(k)[:, :, None] * class_n[None] - n * share[:, None] * share[None]
        rotations = sparse_multiblock_each(s, ranges, linked, [*keep, None], n_components, y[at : at + step])[:-1]
        centre, means = sums / n, class_sums / np.maximum(class_n, 1)
        distances = []
        for rot, (a, b) in zip(rotations, ranges, strict=False):
            score = np.einsum("pb,pab->ab", r[a:b] - centre[a:b], rot)
            mids = np.einsum("pkb,pab->kab", means[a:b] - centre[a:b, None], rot)
            distances.append(((score[None] - mids) ** 2).sum(1).T)
        out[at : at + step] = _vote(distances, class_n.T)
    return out


def _keep(sizes: list[int], n: float, keep: list[int] | None) -> list[int]:
    return keep if keep is not None else [keep_rule(p, int(n)) for p in sizes]


def loo_predictions(joined: DataFrame, features: dict[str, list[str]], n_components: int = 2, design: float = 0.1, keep: list[int] | None = None) -> DataFrame:
    """(sample_id, grp, pred) by leave-one-out: one pass for the totals, one that down-dates them row by row.

    Above MAX_WIDTH features in all, each row is a task that fits the model on the others.
    """
    sizes = [len(v) for v in features.values()]
    rows = joined.select("sample_id", "grp", F.concat(*[F.col(n) for n in features]).alias("x"))
    if sum(sizes) > MAX_WIDTH:
        x, y, more = local_rows(rows, "sample_id")
        ids, spark = [m[0] for m in more], joined.sparkSession
        data, few = spark.sparkContext.broadcast((x, y)), _keep(sizes, len(y), keep)

        def one(t: int) -> list[tuple]:
            x, y = data.value
            return [(ids[t], y[t], _held_out(x, y, np.arange(len(y)) == t, sizes, few, n_components, design)[0])]

        return run_tasks(spark, len(y), one, f"sample_id {dict(rows.dtypes)['sample_id']}, grp string, pred string")
    stats = cross_products(rows, sum(sizes))[None]
    kept = _keep(sizes, stats.n, keep)
    refuse_loo(stats.n, sum(sizes))
    shared = joined.sparkSession.sparkContext.broadcast(stats)  # width is limited by cross_products

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        classes = np.array(s.classes, dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(b.num_rows, -1)
            y = np.searchsorted(classes, np.array(b.column(1).to_pylist(), dtype=object))
            pred = classes[held_out_classes(s, x, y, sizes, kept, n_components, design)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string())], names=["sample_id", "grp", "pred"])

    return rows.mapInArrow(run, f"sample_id {dict(rows.dtypes)['sample_id']}, grp string, pred string")


def _held_out(x: np.ndarray, y: np.ndarray, at: np.ndarray, sizes: list[int], keep: list[int], n_components: int, design: float) -> list[str]:
    classes = sorted(set(y.tolist()))
    model = fit_few(x[~at], y[~at], classes, sizes, keep, n_components, design)
    return predict_rows(model, x[at], sizes, Labels(classes, np.array([(y[~at] == c).sum() for c in classes])))


def _error(x: np.ndarray, y: np.ndarray, sizes: list[int], keep: list[int], n_components: int, design: float, strategy: str, k: int) -> float:
    classes, f = sorted(set(y.tolist())), folds(y, strategy, k)
    wide, wrong = x.shape[1] > min(len(x), MAX_WIDTH), 0
    total = None if wide else _stats_of(x, y, classes)
    for j in np.unique(f):
        at = f == j
        if wide:
            pred = _held_out(x, y, at, sizes, keep, n_components, design)
        else:
            part = total.minus(_stats_of(x[at], y[at], classes))
            pred = predict_rows(fit_stats(part, sizes, keep, n_components, design), x[at], sizes, part)
        wrong += sum(p != t for p, t in zip(pred, y[at], strict=True))
    return wrong / len(y)


class Trial(NamedTuple):
    """A held-out error to find: with labels as they are (0) or permuted by this seed, and settings of the model."""

    labels: int
    keep: list[int]
    n_components: int


#: Numbers of the cross-products by labels and fold that a task adds up at once (256 MB).
SUM_CELLS = 32_000_000
#: Cells of the rows that make up one row of a block table (8 MB).
BLOCK_CELLS = 1_000_000


def trial_errors(joined: DataFrame, features: dict[str, list[str]], trials: list[Trial], design: float, strategy: str, k: int, strict: bool = False) -> DataFrame:
    """(trial, error) by cross-validation; a model that cannot be fitted gives no error, or with ``strict`` is raised.

    Up to MAX_CELLS cells every trial is a task on all rows. Larger tables stay where they lie: a pass sums their
    cross-products by labels and fold, the models are fitted on these, and a pass counts what they get wrong.
    """
    sizes = [len(v) for v in features.values()]
    rows = joined.select("sample_id", "grp", F.concat(*[F.col(n) for n in features]).alias("x"))
    spark, width = joined.sparkSession, sum(sizes)
    if width <= MAX_WIDTH and rows.count() * width > MAX_CELLS:
        return _trials_in_place(rows, sizes, trials, design, strategy, k, strict)
    x, y = local_matrix(rows)
    data = spark.sparkContext.broadcast((x, y))

    def one(t: int) -> list[tuple]:
        x, y = data.value
        seed, keep, n_components = trials[t]
        if seed:
            y = np.random.RandomState(seed).permutation(y)
        try:
            return [(t, _error(x, y, sizes, keep, n_components, design, strategy, k))]
        except (np.linalg.LinAlgError, ValueError):
            if strict:
                raise
            return [(t, None)]

    return run_tasks(spark, len(trials), one, "trial long, error double")


def _label_codes(rows: DataFrame) -> tuple[np.ndarray, list[str]]:
    """(class numbers in row order, classes); the driver gets as many bytes as there are rows."""
    classes = sorted(r["grp"] for r in rows.select("grp").distinct().collect())  # one row per class
    kind = np.min_scalar_type(len(classes))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, y = b.column(0).to_numpy(), np.searchsorted(np.array(classes, dtype=object), np.array(b.column(1).to_pylist(), dtype=object)).astype(kind)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([at[part[0]]]), pa.array([y[part].tobytes()])], names=["first", "y"])

    parts = rows.select("_row", "grp").mapInArrow(codes, "first long, y binary").collect()
    return np.frombuffer(b"".join(bytes(p["y"]) for p in sorted(parts, key=lambda p: p["first"])), kind), classes


def _blocks(rows: DataFrame, codes: np.ndarray, width: int, seeds: list[int], strategy: str, k: int) -> tuple[DataFrame, np.dtype]:
    """(x, y, f): a row per block of rows, with its cells and, per seed, the class and the fold of each row. Written once."""
    spark, per = rows.sparkSession, max(1, BLOCK_CELLS // width)
    shared, kind = spark.sparkContext.broadcast(codes), codes.dtype
    number = np.min_scalar_type(k)

    def deal(s: int) -> list[tuple]:
        y = np.random.RandomState(seeds[s]).permutation(shared.value) if seeds[s] else shared.value
        f = np.zeros(len(y), number) if strategy == "loo" else folds(y, strategy, k).astype(number)
        return [(at // per, s, y[at : at + per].tobytes(), f[at : at + per].tobytes()) for at in range(0, len(y), per)]

    def pack(g: pa.Table) -> pa.Table:
        g = g.sort_by("_row")
        x = g.column("x").combine_chunks()
        cells = np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype="<f8")
        return pa.table({"block": g.column("block")[:1], "x": pa.array([cells.tobytes()])})

    dealt = run_tasks(spark, len(seeds), deal, "block long, s long, y binary, f binary")
    dealt = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("s", "y", "f"))).alias("dealt"))
    parts = min(-(-len(codes) // per), 4 * spark.sparkContext.defaultParallelism)
    packed = rows.select(F.floor(F.col("_row") / per).cast("long").alias("block"), "_row", "x").repartition(parts, "block").groupBy("block").applyInArrow(pack, "block long, x binary")
    return cut(packed.join(dealt, "block").select("x", F.col("dealt.y").alias("y"), F.col("dealt.f").alias("f"))), np.dtype(kind)


def _trials_in_place(rows: DataFrame, sizes: list[int], trials: list[Trial], design: float, strategy: str, k: int, strict: bool) -> DataFrame:
    spark, width, loo = rows.sparkSession, sum(sizes), strategy == "loo"
    numbered = row_numbers(rows, ["sample_id"], "_row")
    codes, classes = _label_codes(numbered)
    n, c, n_folds = len(codes), len(classes), 1 if loo else min(k, len(codes))
    if loo:
        refuse_loo(n * len(trials), width)
    seeds = sorted({t.labels for t in trials})
    blocks, kind = _blocks(numbered, codes, width, seeds, strategy, n_folds)
    number, shape = np.min_scalar_type(n_folds), width * width + width * c + c

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, list]]:
        for b in batches:
            for x, y, f in zip(*b.columns, strict=True):
                yield np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width), [np.frombuffer(v.as_buffer(), kind) for v in y], [np.frombuffer(v.as_buffer(), number) for v in f]

    def fitted(at: list[int]) -> dict[int, list]:
        """Models of the trials on these seeds, by trial: one per fold (mean, rotations, centroids by block, and the classes' sizes), or for leave-one-out the sums."""

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for x, y, f in read(batches):
                for s in at:
                    own = np.eye(c)[y[s]]
                    for j in range(n_folds):
                        here = f[s] == j
                        part, mine = x[here], own[here]
                        got = np.concatenate([(part.T @ part).ravel(), (part.T @ mine).ravel(), mine.sum(0)])
                        total[s, j] = total[s, j] + got if (s, j) in total else got
            for (s, j), v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([j], pa.int64()), pa.array([v.tobytes()])], names=["s", "fold", "v"])

        def fit(g: pa.Table) -> pa.Table:
            s, part = g.column("s")[0].as_py(), np.zeros((n_folds, shape))
            for j, v in zip(g.column("fold").to_pylist(), g.column("v"), strict=True):
                part[j] += np.frombuffer(v.as_buffer())
            stats = [Stats(v[-c:].sum(), v[width * width : -c].reshape(width, c).sum(1), v[: width * width].reshape(width, width), classes, v[-c:], v[width * width : -c].reshape(width, c)) for v in (*part, part.sum(0))]
            out = []
            for t, trial in enumerate(trials):
                if trial.labels != seeds[s]:
                    continue
                try:
                    if loo:
                        models = [stats[-1]]
                    else:
                        rest = [stats[-1].minus(p) for p in stats[:-1]]
                        models = [(fit_stats(p, sizes, trial.keep, trial.n_components, design), p.class_n) for p in rest]
                except (np.linalg.LinAlgError, ValueError):
                    if strict:
                        raise
                    models = None
                out.append((t, pickle.dumps(models)))
            return pa.table({"trial": pa.array([o[0] for o in out], pa.int64()), "models": pa.array([o[1] for o in out], pa.binary())})

        summed = blocks.mapInArrow(sums, "s long, fold long, v binary").groupBy("s").applyInArrow(fit, "trial long, models binary")
        return {r["trial"]: pickle.loads(bytes(r["models"])) for r in summed.collect()}

    errors: dict[int, float | None] = {}
    step = max(1, SUM_CELLS // (n_folds * shape))
    for first in range(0, len(seeds), step):
        models = fitted(list(range(first, min(first + step, len(seeds)))))
        errors |= {t: None for t, m in models.items() if m is None}
        shared = spark.sparkContext.broadcast({t: m for t, m in models.items() if m is not None})

        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrong = dict.fromkeys(shared.value, 0)  # noqa: B023
            for x, y, f in read(batches):
                for t, m in shared.value.items():  # noqa: B023
                    s = seeds.index(trials[t].labels)
                    if loo:
                        pred = held_out_classes(m[0], x, y[s].astype(int), sizes, trials[t].keep, trials[t].n_components, design)
                        wrong[t] += int((pred != y[s]).sum())
                        continue
                    for j in range(n_folds):
                        here = f[s] == j
                        if here.any():
                            model, class_n = m[j]
                            wrong[t] += int((_classes_of(model, x[here], sizes, class_n) != y[s][here]).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(wrong), pa.int64()), pa.array(list(wrong.values()), pa.int64())], names=["trial", "wrong"])

        errors |= {r["trial"]: r["wrong"] / n for r in blocks.mapInArrow(judge, "trial long, wrong long").groupBy("trial").agg(F.sum("wrong").alias("wrong")).collect()}  # one row per trial
        shared.unpersist()
    return spark.createDataFrame(sorted(errors.items()), "trial long, error double")


def permutation_error_test(joined: DataFrame, features: dict[str, list[str]], n_permutations: int = 50, n_components: int = 2, design: float = 0.1, strategy: str = "loo", k: int = 5) -> DataFrame:
    """(true_error, perm_mean_error, perm_sd_error, p_value, n_permutations, significant).

    p = (permuted errors at or below the true one + 1) / (successes + 1). A permutation that fails does not
    count; with fewer than ten successes the p-value is null.
    """
    keep = _keep([len(v) for v in features.values()], joined.count(), None)
    trials = [Trial(t, keep, n_components) for t in range(n_permutations + 1)]
    scores = trial_errors(joined, features, trials, design, strategy, k).withColumnRenamed("trial", "permutation")
    true = F.max(F.when(F.col("permutation") == 0, F.col("error"))).over(_everything())
    perm = scores.withColumn("true_error", true).where("permutation > 0 and error is not null")
    n = F.count(F.lit(1))
    out = perm.groupBy("true_error").agg(
        F.avg("error").alias("perm_mean_error"), F.stddev_samp("error").alias("perm_sd_error"),
        F.when(n >= 10, (F.sum((F.col("error") <= F.col("true_error")).cast("int")) + 1) / (n + 1)).alias("p_value"), n.alias("n_permutations"),
    )
    return out.withColumn("significant", F.col("p_value") < 0.05)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row per permutation


def component_errors(joined: DataFrame, features: dict[str, list[str]], most: int = 3, design: float = 0.1, strategy: str = "stratified", k: int = 5) -> DataFrame:
    """(component, overall_error) with 1, 2 ... components, each by cross-validation."""
    keep = _keep([len(v) for v in features.values()], joined.count(), None)
    errors = trial_errors(joined, features, [Trial(0, keep, c + 1) for c in range(most)], design, strategy, k)
    return errors.select((F.col("trial") + 1).alias("component"), F.col("error").alias("overall_error"))


def choose_components(errors: Sequence[tuple[int, float | None]] | None, default: int = 2) -> int:
    """The number of components of least error, the largest of equals; without a usable error, or below one, the default."""
    usable = [(e, -c) for c, e in errors or [] if e is not None and e == e and c >= 1]
    return -min(usable)[1] if usable else default


def tune_keep(joined: DataFrame, features: dict[str, list[str]], n_components: int = 2, design: float = 0.1, strategy: str = "stratified", k: int = 5) -> DataFrame:
    """(keep, n_kept, error) of every combination of the blocks' grids, least error first, then fewest features."""
    grid = list(itertools.product(*[keep_grid(len(v)) for v in features.values()]))
    errors = trial_errors(joined, features, [Trial(0, list(g), n_components) for g in grid], design, strategy, k, strict=True)
    names = joined.sparkSession.createDataFrame([(t, ",".join(map(str, g)), int(sum(g))) for t, g in enumerate(grid)], "trial long, keep string, n_kept long")
    return names.join(errors, "trial").select("keep", "n_kept", "error").orderBy("error", "n_kept", "keep")
