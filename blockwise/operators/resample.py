"""Resampling as plans: leave-one-out, stratified folds, permutations, bootstrap, feature stability.

A *plan* is a table of tasks. Models that are sums (nearest centroid) run wholly as aggregates, with the
test row or fold subtracted from the totals. Other models run as Python callables, one task per resample, over a
data matrix that is checked to be small enough to send to every task (``MAX_CELLS``). Selection by variance runs over the
rows where they lie, at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from blockwise.functions import metrics
from blockwise.functions.linalg import pls, predict_class
from blockwise.operators.layer import cut
from blockwise.operators.ranks import row_numbers
from blockwise.operators.statistics import MAX_CELLS, row_basis, row_stats

#: Rows that are drawn from together: more than 64 features within MAX_CELLS ever had.
BLOCK_ROWS = 1 << 17


# --- nearest centroid, relational ---------------------------------------------------------------------------


def centroid_cv(cells: DataFrame, fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """(by, sample_id, grp, fold, pred) from cells (by, sample_id, grp, fold, feature, value), apart for each value of ``by``.

    A class's centroid without a fold is its total minus the fold's part, so each is aggregated once.
    """
    by = list(by)
    part = cells.groupBy(*by, "feature", F.col("grp").alias("cls"), F.col(fold).alias("fold_")).agg(F.sum("value").alias("fs"), F.count("value").alias("fn"))
    total = part.groupBy(*by, "feature", "cls").agg(F.sum("fs").alias("s"), F.sum("fn").alias("n"))
    rows = cells.select(*by, "sample_id", "grp", F.col(fold).alias("fold_"), "feature", "value")
    near = rows.join(total, [*by, "feature"]).join(part, [*by, "feature", "cls", "fold_"], "left")
    mid = F.try_divide(F.col("s") - F.coalesce("fs", F.lit(0.0)), (F.col("n") - F.coalesce("fn", F.lit(0))).cast("double"))
    return _nearest(near.withColumn("mid", mid), [*by, "sample_id", "grp", "fold_"]).withColumnRenamed("fold_", "fold")


def _nearest(near: DataFrame, row: list[str]) -> DataFrame:
    """The class of the nearest centroid per row, from (row, cls, value, mid) per feature; of equal distances the first class."""
    d = near.groupBy(*row, "cls").agg(F.round(F.sum((F.col("value") - F.col("mid")) ** 2), 9).alias("d"))
    return d.where("d is not null").groupBy(*row).agg(F.min_by("cls", F.struct("d", "cls")).alias("pred"))


# --- resampling, relational ---------------------------------------------------------------------------------


def hashed(*parts) -> Column:
    """A number below 2**32 that any engine with md5 gives for these values."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def permuted_labels(labels: DataFrame, n: int) -> DataFrame:
    """(round, sample_id, grp) for rounds 0 (as they are) to ``n``: the label of the i-th sample goes to the one that is i-th by the round's hash.

    A round's samples are sorted in one task.
    """
    every = labels.select("sample_id", "grp", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("round"))
    order = F.when(F.col("round") > 0, hashed("round", "sample_id")).otherwise(0)
    rank = F.row_number().over(W.partitionBy("round").orderBy("sample_id"))
    drawn = F.row_number().over(W.partitionBy("round").orderBy(order, "sample_id"))
    return every.select("round", "sample_id", rank.alias("i")).join(every.select("round", "grp", drawn.alias("i")), ["round", "i"]).drop("i")


def permutation_scores(cells: DataFrame, n: int, fold: str = "fold") -> DataFrame:
    """(round, score): held-out accuracy of the nearest centroid with labels as they are (round 0) and permuted, all rounds in one plan."""
    labels = permuted_labels(cells.select("sample_id", "grp").distinct(), n)
    pred = centroid_cv(cells.drop("grp").join(labels, "sample_id"), fold, ["round"])
    return pred.groupBy("round").agg(F.avg((F.col("grp") == F.col("pred")).cast("double")).alias("score"))


def bootstrap_draws(samples: DataFrame, n: int) -> DataFrame:
    """(round, sample_id, times) for rounds 1 to ``n``: as many draws with replacement as samples; those never drawn have 0."""
    ids = samples.select("sample_id").distinct()
    ranked = row_numbers(ids, ["sample_id"], "i")
    size = ids.count()
    rounds = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("round")
    drawn = ranked.select("i", rounds).select("round", F.pmod(hashed("round", "i"), F.lit(max(size, 1))).alias("i")).groupBy("round", "i").agg(F.count(F.lit(1)).alias("times"))
    return ranked.select("sample_id", "i", rounds).join(drawn, ["round", "i"], "left").select("round", "sample_id", F.coalesce("times", F.lit(0)).alias("times"))


def bootstrap_scores(cells: DataFrame, n: int) -> DataFrame:
    """(round, score): accuracy on the samples left out of the nearest centroid of those drawn; rounds that leave none out are absent."""
    drawn = cells.join(bootstrap_draws(cells, n), "sample_id")
    mid = drawn.where("times > 0").groupBy("round", "feature", F.col("grp").alias("cls")).agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mid"))
    pred = _nearest(drawn.where("times = 0").select("round", "sample_id", "grp", "feature", "value").join(mid, ["round", "feature"]), ["round", "sample_id", "grp"])
    return pred.groupBy("round").agg(F.avg((F.col("grp") == F.col("pred")).cast("double")).alias("score"))


def variance_selections(cells: DataFrame, n: int, top: int) -> DataFrame:
    """(round, feature): the features of largest variance in each draw; ties by name."""
    drawn = cells.join(bootstrap_draws(cells, n).where("times > 0"), "sample_id")
    w, x = F.col("times"), F.col("value")
    moments = drawn.groupBy("round", "feature").agg(F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("ss"))
    spread = F.round(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, 9)
    rank = F.row_number().over(W.partitionBy("round").orderBy(F.desc(spread), "feature"))  # one row per feature
    return moments.withColumn("rank", rank).where(F.col("rank") <= top).select("round", "feature")


def fold_scores(pred: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' accuracies, with the number of folds."""
    per = pred.groupBy("fold").agg(F.avg((F.col("grp") == F.col("pred")).cast("double")).alias("score"))
    return per.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n_splits"))


# --- summaries ----------------------------------------------------------------------------------------------


def permutation_p(scores: DataFrame, true_score: float | Column) -> DataFrame:
    """p = (permuted scores at or above the true one + 1) / (permutations + 1); failed (null) ones do not count."""
    t = F.lit(true_score) if not isinstance(true_score, Column) else true_score
    ok = scores.where("score is not null")
    out = ok.agg(
        ((F.coalesce(F.sum((F.col("score") >= t).cast("bigint")), F.lit(0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.avg("score").alias("perm_mean"), F.stddev_pop("score").alias("perm_std"), F.count(F.lit(1)).alias("n_permutations"),
    )
    return out.withColumn("significant", F.col("p_value") < 0.05)


def bootstrap_interval(scores: DataFrame) -> DataFrame:
    return scores.where("score is not null").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.expr("percentile(score, 0.025)").alias("ci_lower"), F.expr("percentile(score, 0.975)").alias("ci_upper"), F.count(F.lit(1)).alias("n_bootstrap")
    )


def stability(selections: DataFrame, n_rounds: int, top_k: int = 20) -> DataFrame:
    """(Feature, Selection_Frequency, Times_Selected) from one row per round and selected feature."""
    n = selections.groupBy(F.col("feature").alias("Feature")).agg(F.count(F.lit(1)).alias("Times_Selected"))
    return n.select("Feature", (F.col("Times_Selected") / n_rounds).alias("Selection_Frequency"), "Times_Selected").orderBy(F.desc("Times_Selected"), "Feature").limit(top_k)


# --- callables ----------------------------------------------------------------------------------------------


class PlsModel:
    """fit/predict on arrays, for tasks."""

    def __init__(self, n_components: int = 2):
        self.n_components = n_components

    def fit(self, x: np.ndarray, y: np.ndarray) -> PlsModel:
        classes = sorted(set(y.tolist()))
        self.classes = classes
        if len(classes) < 2:
            return self
        basis = row_basis(x) if x.shape[1] > 2 * len(x) else None
        self.m = pls(row_stats(x, y, classes, basis), self.n_components)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.array([self.classes[0]] * len(x), dtype=object)
        return predict_class((x - self.m.x_mean) @ self.m.coef + self.m.y_mean, self.classes)


class CentroidModel:
    def fit(self, x: np.ndarray, y: np.ndarray) -> CentroidModel:
        self.classes = sorted(set(y.tolist()))
        self.mid = np.stack([x[y == c].mean(0) for c in self.classes])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.classes, dtype=object)[((x[:, None] - self.mid) ** 2).sum(2).argmin(1)]


def local_matrix(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) in key order, for resampling; refused beyond MAX_CELLS cells."""
    n = vectors.count()
    width = vectors.select(F.max(F.size("x"))).first()[0] or 0
    if n * width > MAX_CELLS:
        raise ValueError(f"{n} x {width} cells: resampling by callables takes up to {MAX_CELLS}; aggregate or sample first")
    keys = [c for c in vectors.columns if c not in ("grp", "x")]
    rows = (vectors.orderBy(*keys) if keys else vectors).select("grp", "x").collect()
    return np.array([r["x"] for r in rows], dtype=float).reshape(n, width), np.array([r["grp"] for r in rows], dtype=object)


def cv_predictions(x: np.ndarray, y: np.ndarray, model: Callable, fold: np.ndarray) -> np.ndarray:
    out = np.empty(len(y), dtype=object)
    for k in np.unique(fold):
        test = fold == k
        out[test] = model().fit(x[~test], y[~test]).predict(x[test])
    return out


def folds(y: np.ndarray, strategy: str, k: int = 5) -> np.ndarray:
    """loo, or stratified (of which kfold is another name)."""
    if strategy == "loo":
        return np.arange(len(y))
    if strategy in ("stratified", "kfold"):
        k, out, r = min(k, len(y)), np.zeros(len(y), dtype=int), np.random.RandomState(42)
        for c in sorted(set(y.tolist())):
            at = np.flatnonzero(y == c)
            out[r.permutation(at)] = np.arange(len(at)) % k
        return out
    raise ValueError(f"unknown strategy: {strategy}")


def run_tasks(spark, n_tasks: int, one: Callable[[int], list[tuple]], schema: str) -> DataFrame:
    """``one(task)`` for each task number, spread over the cluster; a lost task is run anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = [r for t in f["id"].tolist() for r in one(int(t))]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    parts = min(n_tasks, 4 * spark.sparkContext.defaultParallelism) or 1
    return spark.range(0, n_tasks, 1, parts).mapInPandas(run, schema)


def permutation_test(vectors: DataFrame, model: Callable = PlsModel, n_permutations: int = 1000, strategy: str = "loo", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, scores): labels are shuffled without replacement, with the permutation's number as seed."""
    x, y = local_matrix(vectors)
    spark = vectors.sparkSession
    data = spark.sparkContext.broadcast((x, y))

    def one(t: int) -> list[tuple]:
        x, y = data.value
        if t:
            y = np.random.RandomState(t - 1).permutation(y)
        try:
            return [(t - 1, float((cv_predictions(x, y, model, folds(y, strategy, k)) == y).mean()))]
        except (np.linalg.LinAlgError, ValueError):
            return [(t - 1, None)]

    scores = cut(run_tasks(spark, n_permutations + 1, one, "permutation long, score double"))
    true = scores.where("permutation = -1").first()["score"]
    return permutation_p(scores.where("permutation >= 0"), float(true)).withColumn("true_score", F.lit(float(true))), scores.where("permutation >= 0")


def bootstrap(vectors: DataFrame, model: Callable = PlsModel, n_bootstrap: int = 1000) -> DataFrame:
    """(round, score): trained on a draw with replacement, tested on the rows left out; rounds without any are absent."""
    x, y = local_matrix(vectors)
    spark = vectors.sparkSession
    data = spark.sparkContext.broadcast((x, y))

    def one(t: int) -> list[tuple]:
        x, y = data.value
        at = np.random.RandomState(t).randint(0, len(y), len(y))
        out = np.setdiff1d(np.arange(len(y)), at)
        return [(t, float((model().fit(x[at], y[at]).predict(x[out]) == y[out]).mean()))] if len(out) else []

    return run_tasks(spark, n_bootstrap, one, "round long, score double")


def variance_selector(x: np.ndarray, y: np.ndarray, top: int = 20) -> np.ndarray:
    return np.argsort(-x.var(0), kind="stable")[:top]


def block_draws(rounds: Sequence[int], n: int, block: int, block_rows: int) -> np.ndarray:
    """(rounds x rows of the block) times drawn: ``n`` draws with replacement from ``n`` rows, a block's share by a multinomial draw.

    A table of one block is drawn from as a whole, with the round as seed.
    """
    sizes = np.full(-(-n // block_rows), block_rows)
    sizes[-1] = n - block_rows * (len(sizes) - 1)
    out = np.zeros((len(rounds), sizes[block]), dtype=np.int32)
    for k, t in enumerate(rounds):
        if len(sizes) == 1:
            at = np.random.RandomState(t).randint(0, n, n)
        else:
            share = np.random.RandomState([t, 1]).multinomial(n, sizes / n)[block]
            at = np.random.RandomState([t, 2, block]).randint(0, sizes[block], share)
        out[k] = np.bincount(at, minlength=sizes[block])
    return out


def variance_rounds(vectors: DataFrame, names: list[str], n_rounds: int = 100, top: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(round, feature): the features of largest variance in each draw, ties by position, for tables of any size.

    A task sums the rows it reads for all rounds, under the draws of their block; rows are in key order. Partial means and
    squares are merged about a common point, so constant features have no variance at all.
    """
    keys = [c for c in vectors.columns if c not in ("grp", "x")] or ["grp", "x"]
    rows = row_numbers(vectors, keys, "_row").select("_row", "x")
    n, width = rows.count(), len(names)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, s, ss, shift, drawn = np.zeros(n_rounds), np.zeros((n_rounds, width)), np.zeros((n_rounds, width)), None, (-1, None)
        bad = np.zeros((n_rounds, width), dtype=bool)
        for b in batches:
            at = b.column(0).to_numpy()
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(at), -1)
            fine = np.isfinite(x)
            if shift is None and len(x):
                shift = np.nan_to_num(np.median(x[:1001], axis=0), nan=0.0, posinf=0.0, neginf=0.0)
            for block in np.unique(at // block_rows).tolist():
                if drawn[0] != block:
                    drawn = (block, block_draws(range(n_rounds), n, block, block_rows))
                own = at // block_rows == block
                times = drawn[1][:, at[own] - block * block_rows].astype(float)
                d = np.where(fine[own], x[own] - shift, 0.0)
                count += times.sum(1)
                s += times @ d
                ss += times @ (d * d)
                if not fine[own].all():
                    bad |= times @ ~fine[own] > 0
        if shift is not None:
            some = np.maximum(count, 1)[:, None]
            cells = np.stack([shift + s / some, np.where(bad, np.nan, ss - s * s / some)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(n_rounds), pa.int64()), pa.array(count), pa.array([c.tobytes() for c in cells], pa.binary())], names=["round", "n", "v"])

    def choose(g: pa.Table) -> pa.Table:
        k = g.column("n").to_numpy()
        v = np.stack([np.frombuffer(c.as_buffer()).reshape(2, width) for c in g.column("v")])[k > 0]
        k = k[k > 0][:, None]
        d = v[:, 0] - v[0, 0]
        spread = (v[:, 1].sum(0) + (k * (d - (k * d).sum(0) / k.sum()) ** 2).sum(0)) / k.sum()
        best = np.argsort(-spread, kind="stable")[:top]
        return pa.table({"round": pa.array([g.column("round")[0].as_py()] * len(best), pa.int64()), "feature": pa.array([names[int(i)] for i in best], pa.string())})

    return rows.mapInArrow(sums, "round long, n double, v binary").groupBy("round").applyInArrow(choose, "round long, feature string")


def stability_rounds(vectors: DataFrame, names: list[str], selector: Callable = variance_selector, n_rounds: int = 100) -> DataFrame:
    """(round, feature) selected in each draw: by variance at any size, by other callables on up to MAX_CELLS cells."""
    if selector is variance_selector:
        return variance_rounds(vectors, names, n_rounds)
    x, y = local_matrix(vectors)
    spark = vectors.sparkSession
    data = spark.sparkContext.broadcast((x, y))

    def one(t: int) -> list[tuple]:
        x, y = data.value
        at = np.random.RandomState(t).randint(0, len(y), len(y))
        return [(t, names[int(i)]) for i in selector(x[at], y[at])]

    return run_tasks(spark, n_rounds, one, "round long, feature string")


def compare_models(vectors: DataFrame, models: dict[str, Callable], strategy: str = "stratified", k: int = 5, scoring: Sequence[str] = ("accuracy",)) -> DataFrame:
    """(Model, {score}_mean, {score}_std ...) over the folds for every score of ``scoring`` (see ``metrics.SCORERS``), best by the first one first."""
    x, y = local_matrix(vectors)
    spark = vectors.sparkSession
    data = spark.sparkContext.broadcast((x, y))
    names = list(models)

    def one(t: int) -> list[tuple]:
        x, y = data.value
        f = folds(y, strategy, k)
        return [(names[t], int(j), g, p) for j, g, p in zip(f, y, cv_predictions(x, y, models[names[t]], f), strict=True)]

    pred = cut(run_tasks(spark, len(names), one, "Model string, fold long, grp string, pred string"))
    pred = pred.withColumn("fold", F.struct("Model", "fold"))
    out = None
    for name in scoring:
        per = metrics.fold_scores_by(pred, name).groupBy(F.col("fold.Model").alias("Model")).agg(F.avg("score").alias(f"{name}_mean"), F.stddev_pop("score").alias(f"{name}_std"))
        out = per if out is None else out.join(per, "Model")
    return out.orderBy(F.desc(f"{scoring[0]}_mean"), "Model")
