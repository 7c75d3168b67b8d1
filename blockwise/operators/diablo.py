"""Sparse multi-block discriminant analysis, and the tables derived from its scores and loadings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwise.functions.linalg import Stats, sparse_multiblock, sparse_multiblock_rows
from blockwise.operators.statistics import MAX_WIDTH, cross_products, local_rows, project


def keep_rule(n_features: int, n_samples: int) -> int:
    """Features kept per block on small samples."""
    p = n_features
    if p < 10:
        return p
    if p < 50:
        return min(3, p)
    if p < 200:
        return min(5, p)
    return min(max(10, int(1.5 * n_samples)), p)


def keep_rule_column(p, n):
    """The same rule as a column expression."""
    return F.when(p < 10, p).when(p < 50, F.least(F.lit(3), p)).when(p < 200, F.least(F.lit(5), p)).otherwise(F.least(F.greatest(F.lit(10), F.floor(n * 1.5)), p)).cast("int")


def keep_grid(n_features: int) -> list[int]:
    """Numbers of features tried on larger samples; limited to what the block has, without repeats."""
    grid = (5, 10, n_features) if n_features < 20 else (5, 10, 20, 30) if n_features < 100 else (10, 20, 50, 100)
    return sorted({min(g, n_features) for g in grid})


def design_table(spark, blocks: list[str], off_diagonal: float = 0.1) -> DataFrame:
    rows = [(a, b, 0.0 if a == b else off_diagonal) for a in blocks for b in blocks]
    return spark.createDataFrame(rows, "block_i string, block_j string, c double")


def links(n_blocks: int, design: float) -> np.ndarray:
    """Blocks are linked by ``design``, each with the labels (the last one) by 1, none with itself."""
    c = np.full((n_blocks + 1, n_blocks + 1), float(design))
    c[-1, :] = c[:, -1] = 1.0
    np.fill_diagonal(c, 0.0)
    return c


def fit_products(stats: Stats, sizes: list[int], keep: list[int], n_components: int, design: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Loadings and rotations of each block from cross-products."""
    m = stats.class_n / stats.n
    xy = stats.class_sums - np.outer(stats.sums, m)
    s = np.block([[stats.centred(), xy], [xy.T, np.diag(stats.class_n) - stats.n * np.outer(m, m)]])
    ends = np.cumsum([0, *sizes, len(stats.classes)]).tolist()
    loadings, rotations = sparse_multiblock(s, list(zip(ends, ends[1:], strict=False)), links(len(sizes), design), [*keep, None], n_components)
    return loadings[:-1], rotations[:-1]


def fit_rows(x: np.ndarray, y: np.ndarray, classes: list[str], sizes: list[int], keep: list[int], n_components: int, design: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same from few rows of many features."""
    one_hot = np.stack([(y == c).astype(float) for c in classes], 1)
    blocks = [*np.split(x - x.mean(0), np.cumsum(sizes)[:-1], axis=1), one_hot - one_hot.mean(0)]
    loadings, rotations = sparse_multiblock_rows(blocks, links(len(sizes), design), [*keep, None], n_components)
    return loadings[:-1], rotations[:-1]


@dataclass
class Diablo:
    """``joined`` has sample_id, grp and one array column per block; ``features`` names their entries."""

    joined: DataFrame
    features: dict[str, list[str]]
    loadings_: list[np.ndarray]
    rotations: list[np.ndarray]
    mean: np.ndarray
    classes: list[str]

    @staticmethod
    def fit(joined: DataFrame, features: dict[str, list[str]], n_components: int = 2, design: float = 0.1, keep: dict[str, int] | None = None) -> Diablo:
        """All updates are products of cross-block cross-products, so one pass over the samples is enough.

        Above MAX_WIDTH features in all, the rows themselves (at most MAX_CELLS cells) are used instead.
        """
        sizes = [len(v) for v in features.values()]
        one = joined.select("grp", F.concat(*[F.col(n) for n in features]).alias("x"))
        wanted = lambda n: [(keep or {}).get(b, keep_rule(len(fs), int(n))) for b, fs in features.items()]
        if sum(sizes) > MAX_WIDTH:
            x, y, _ = local_rows(one)
            classes = sorted(set(y.tolist()))
            loadings, rotations = fit_rows(x, y, classes, sizes, wanted(len(x)), n_components, design)
            return Diablo(joined, features, loadings, rotations, x.mean(0), classes)
        stats = cross_products(one, sum(sizes))[None]
        loadings, rotations = fit_products(stats, sizes, wanted(stats.n), n_components, design)
        return Diablo(joined, features, loadings, rotations, stats.mean, stats.classes)

    def variates(self) -> DataFrame:
        """(sample_id, grp, block, comp, score)."""
        at, out = 0, None
        for i, (name, cols) in enumerate(self.features.items()):
            one = project(self.joined.select("sample_id", "grp", F.col(name).alias("x")), self.mean[at : at + len(cols)], self.rotations[i], "t")
            one = one.select("sample_id", "grp", F.lit(name).alias("block"), F.posexplode("t").alias("comp", "score")).withColumn("comp", F.col("comp") + 1)
            out = one if out is None else out.unionByName(one)
            at += len(cols)
        return out

    def loadings(self) -> DataFrame:
        """(block, feature, comp, loading)."""
        rows = [(b, f, c + 1, float(self.loadings_[i][j, c])) for i, (b, fs) in enumerate(self.features.items()) for j, f in enumerate(fs) for c in range(self.loadings_[i].shape[1])]
        return self.joined.sparkSession.createDataFrame(rows, "block string, feature string, comp int, loading double")

    def predict(self) -> DataFrame:
        """Vote of the blocks, each by its nearest class centroid over all components; ties by the least total distance."""
        return centroid_vote(self.variates())


def centroid_vote(variates: DataFrame) -> DataFrame:
    cen = variates.groupBy("block", "comp", F.col("grp").alias("cls")).agg(F.avg("score").alias("mid"))
    d = variates.join(cen, ["block", "comp"]).groupBy("sample_id", "grp", "block", "cls").agg(F.sum((F.col("score") - F.col("mid")) ** 2).alias("d"))
    votes = d.withColumn("best", (F.row_number().over(W.partitionBy("sample_id", "block").orderBy("d", "cls")) == 1).cast("int"))
    total = votes.groupBy("sample_id", "grp", "cls").agg(F.sum("best").alias("votes"), F.sum("d").alias("d"))
    return total.groupBy("sample_id", "grp").agg(F.min_by("cls", F.struct(-F.col("votes"), F.col("d"), F.col("cls"))).alias("pred"))


def selected_features(loadings: DataFrame, comp: int = 1) -> DataFrame:
    """Features with a loading, by signed value; ``vip_parity`` is that value, ``abs_loading`` its size."""
    one = loadings.where((F.col("comp") == comp) & (F.col("loading") != 0))
    return one.select("block", "feature", "loading", F.abs("loading").alias("abs_loading"), F.col("loading").alias("vip_parity"), (F.col("loading") > 1).alias("important"))


def top_per_block(loadings: DataFrame, top_n: int = 20, by: str = "vip_parity") -> DataFrame:
    w = W.partitionBy("block").orderBy(F.desc(by), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def block_correlations(variates: DataFrame, comp: int = 1) -> DataFrame:
    """(block_i, block_j, corr): Pearson correlation of the variates of every pair of blocks."""
    one = variates.where(F.col("comp") == comp)
    a, b = (one.select("sample_id", F.col("block").alias(f"block_{x}"), F.col("score").alias(x)) for x in ("i", "j"))
    return a.join(b, "sample_id").groupBy("block_i", "block_j").agg(F.corr("i", "j").alias("corr"))


def consensus(variates: DataFrame) -> DataFrame:
    return variates.groupBy("sample_id", "comp").agg(F.avg("score").alias("score"))


def arrows(variates: DataFrame) -> DataFrame:
    """From each block's score to the mean over blocks."""
    return variates.withColumn("mean_score", F.avg("score").over(W.partitionBy("sample_id", "comp"))).select("sample_id", "grp", "block", "comp", F.col("score").alias("start"), F.col("mean_score").alias("end"))
