"""Plots as queries: the data that a figure would show."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwise.operators.layer import q
from blockwise.operators.statistics import MAX_WIDTH, cross_products


def scree(variance: DataFrame, line: float = 80.0) -> DataFrame:
    return variance.select("PC", "Variance_Explained", "Cumulative_Variance", (F.col("Cumulative_Variance") >= line).alias("over_line"))


def score_points(scores: DataFrame, array: str = "pc", x: int = 1, y: int = 2) -> DataFrame:
    return scores.select(*[c for c in scores.columns if c != array], F.col(array)[x - 1].alias("x"), F.col(array)[y - 1].alias("y"))


def loading_bars(top: DataFrame) -> DataFrame:
    return top.withColumn("positive", F.col("Loading") >= 0)


def biplot_arrows(loadings: DataFrame, scores: DataFrame, array: str = "pc", x: int = 1, y: int = 2, top_n: int = 10) -> DataFrame:
    """Union of the top features of both components, scaled to 0.7 of the largest score."""
    wide = loadings.groupBy("feature").agg(F.max(F.when(F.col("pc") == x, F.col("loading"))).alias("lx"), F.max(F.when(F.col("pc") == y, F.col("loading"))).alias("ly"))
    r = [F.row_number().over(W.orderBy(F.desc(F.abs(c)), "feature")) <= top_n for c in ("lx", "ly")]  # one row per feature
    big = scores.agg((F.max(F.greatest(F.abs(F.col(array)[x - 1]), F.abs(F.col(array)[y - 1]))) * 0.7).alias("scale"))
    return wide.withColumn("keep", r[0] | r[1]).where("keep").crossJoin(F.broadcast(big)).select("feature", (F.col("lx") * F.col("scale")).alias("x"), (F.col("ly") * F.col("scale")).alias("y"))


def sample_overview(cells: DataFrame) -> DataFrame:
    """(layer, grp, samples, features)."""
    f = cells.groupBy("layer").agg(F.count_distinct("feature").alias("features"))
    return cells.groupBy("layer", "grp").agg(F.count_distinct("sample_id").alias("samples")).join(f, "layer")


def missing_cells(cells: DataFrame) -> DataFrame:
    return cells.select("layer", "sample_id", "feature", F.col("value").isNull().cast("int").alias("is_missing"))


def missing_percent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer").agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("percent_missing"))


def histograms(cells: DataFrame, top_n: int = 6, bins: int = 10) -> DataFrame:
    """(feature, grp, bin, n): equal-width bins over each label's own range of the features of largest variance; the last bin is closed."""
    top = cells.groupBy("feature").agg(F.var_pop("value").alias("v")).orderBy(F.desc("v"), "feature").limit(top_n).select("feature")
    some = cells.where("value is not null").join(top, "feature", "left_semi")
    lim = some.groupBy("feature", "grp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("value") - F.col("lo")) * bins / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return some.join(lim, ["feature", "grp"]).select("feature", "grp", at.alias("bin")).groupBy("feature", "grp", "bin").agg(F.count(F.lit(1)).alias("n"))


def correlation_pairs(wide: DataFrame, features: list[str]) -> DataFrame:
    """(feature_i, feature_j, r) of every pair i <= j, from one pass of cross-products over the rows that have all features.

    A constant feature has a null correlation. Up to ``MAX_WIDTH`` features; the matrix is finished on the driver.
    """
    if len(features) > MAX_WIDTH:
        raise ValueError(f"{len(features)} features: correlations are formed for up to {MAX_WIDTH}; select features first")
    x = F.array(*[q(c).cast("double") for c in features])
    stats = cross_products(wide.select(F.lit("all").alias("grp"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))), len(features)).get(None)
    i, j = np.triu_indices(len(features))
    r = np.full(len(i), np.nan)
    if stats is not None:
        s = stats.centred()
        size = np.sqrt(np.clip(np.diag(s), 0, None))
        scale = size[i] * size[j]
        r = np.divide(s[i, j], scale, out=r, where=scale > 0)
    names = np.array(features, dtype=object)
    rows = pa.table({"feature_i": pa.array(names[i], pa.string()), "feature_j": pa.array(names[j], pa.string()), "r": pa.array(np.clip(r, -1, 1), pa.float64(), from_pandas=True)})
    return wide.sparkSession.createDataFrame(rows)


def correlation_network(wide: DataFrame, features: list[str], threshold: float = 0.7) -> DataFrame:
    return correlation_pairs(wide, features).where(F.abs("r") >= threshold)


def volcano(table: DataFrame, fc: str = "fold_change", p: str = "p_value", fc_threshold: float = 1.5, p_threshold: float = 0.05, top_n: int = 10) -> DataFrame:
    x = F.log2(F.col(fc) + 1e-10)
    y = -F.log10(F.col(p) + 1e-10)
    out = table.withColumn("log2_fc", x).withColumn("neg_log10_p", y)
    out = out.withColumn("significant", (F.abs("log2_fc") > F.log2(F.lit(fc_threshold))) & (F.col(p) < p_threshold))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("neg_log10_p") * F.abs("log2_fc"), 9)), "feature"))  # one row per feature
    return out.withColumn("labelled", rank <= top_n)


def ellipses(points: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Per label with more than two points: centre, full widths of the major and minor axis, angle in degrees."""
    g = points.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("d"), F.covar_samp("x", "y").alias("b")
    ).where("n > 2")
    half, off = (F.col("a") + F.col("d")) / 2, F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") ** 2)
    q = -2 * F.log(F.lit(1 - confidence))
    return g.select(
        "grp", "n", "cx", "cy", (2 * F.sqrt(q * (half + off))).alias("major"), (2 * F.sqrt(q * F.greatest(half - off, F.lit(0.0)))).alias("minor"),
        F.degrees(F.atan2(half + off - F.col("a"), F.col("b"))).alias("angle"),
    )


def circos_edges(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Block pairs i < j with strong correlation."""
    e = correlations.where((F.col("block_i") < F.col("block_j")) & (F.abs("corr") >= threshold))
    return e.select("block_i", "block_j", "corr", F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("sign"), F.abs("corr").alias("alpha"))


def loading_heatmap(loadings: DataFrame, top_n: int = 10) -> DataFrame:
    """(feature, one column per block): top features of each block by size, others 0."""
    w = W.partitionBy("block").orderBy(F.desc(F.abs("loading")), "feature")
    top = loadings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    return top.groupBy("feature").pivot("block").agg(F.avg("loading")).na.fill(0.0)


def importance_comparison(loadings: DataFrame, top_n: int = 10) -> DataFrame:
    w = W.partitionBy("block").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("block", "feature", "loading", "rank")


def performance(methods: DataFrame) -> DataFrame:
    return methods.select("Method", "Accuracy", "Std", (F.col("Accuracy") - F.col("Std")).alias("low"), (F.col("Accuracy") + F.col("Std")).alias("high"))


def variable_correlations(cells: DataFrame, variates: DataFrame) -> DataFrame:
    """(block, feature, comp, corr): each feature (sample_id, block, feature, value) with the variates of its own block."""
    both = cells.select("sample_id", "block", "feature", "value").join(variates.select("sample_id", "block", "comp", "score"), ["sample_id", "block"])
    return both.groupBy("block", "feature", "comp").agg(F.corr("value", "score").alias("corr"))


def similarity_edges(correlations: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(block_i, feature_i, block_j, feature_j, similarity): features of different blocks, by the sum over components of the products of
    their correlations with the variates; edges of at least ``threshold`` in size. Give it the selected features, not whole layers.
    """
    side = lambda x: correlations.select("comp", F.col("block").alias(f"block_{x}"), F.col("feature").alias(f"feature_{x}"), F.col("corr").alias(x))
    pairs = side("i").join(side("j"), "comp").where("block_i < block_j")
    out = pairs.groupBy("block_i", "feature_i", "block_j", "feature_j").agg(F.sum(F.col("i") * F.col("j")).alias("similarity"))
    return out.where(F.abs("similarity") >= threshold)


def cluster_order(values: np.ndarray) -> list[int]:
    """Order of the rows of a small matrix in which complete-linkage clusters (Euclidean) lie together; of equal distances the first pair merges first."""
    n = len(values)
    groups = {i: [i] for i in range(n)}
    d = np.sqrt(((values[:, None] - values[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        a, b = divmod(int(d.argmin()), n)
        a, b = min(a, b), max(a, b)
        groups[a] += groups.pop(b)
        d[a] = np.maximum(d[a], d[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
    return next(iter(groups.values())) if groups else []


def clustered_map(joined: DataFrame, blocks: dict[str, list[str]], most: int = 200_000) -> DataFrame:
    """(sample_id, block, feature, value, row, column) of aligned blocks with rows and columns in cluster order; for up to ``most`` cells."""
    names = [(b, f) for b, fs in blocks.items() for f in fs]
    n = joined.count()
    if n * len(names) > most:
        raise ValueError(f"{n} x {len(names)} cells: a clustered map shows up to {most}; select features first")
    rows = joined.select("sample_id", F.concat(*[F.col(b) for b in blocks]).alias("x")).orderBy("sample_id").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(n, len(names))
    row_at, col_at = np.empty(n, int), np.empty(len(names), int)
    row_at[cluster_order(x)], col_at[cluster_order(x.T)] = np.arange(n), np.arange(len(names))
    cells = [(str(r["sample_id"]), *names[j], float(x[i, j]), int(row_at[i]), int(col_at[j])) for i, r in enumerate(rows) for j in range(len(names))]
    return joined.sparkSession.createDataFrame(cells, "sample_id string, block string, feature string, value double, row int, column int")
