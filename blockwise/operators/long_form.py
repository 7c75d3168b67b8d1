"""The same preprocessing on the long form (one row per cell), for layers of any width.

Statistics are grouped aggregates by (layer, feature) or (layer, label, feature) joined back; features are
pruned as rows by a semi join, so no plan grows with the number of features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.operators.layer import VectorLayer, cut, q
from blockwise.operators.ranks import group_medians
from blockwise.operators.preprocess import MAX_DOUBLE, Config, Log, log_of

_KEY = ["layer", "feature"]


def drop_missing(cells: DataFrame, threshold: float) -> DataFrame:
    kept = cells.groupBy(*_KEY).agg(F.avg(F.col("value").isNull().cast("double")).alias("m")).where(F.col("m") <= threshold)
    return cells.join(kept, _KEY, "left_semi")


def drop_constant(cells: DataFrame) -> DataFrame:
    kept = cells.groupBy(*_KEY).agg(F.var_pop("value").alias("v")).where((F.col("v") > 0) & ~F.isnan("v"))
    return cells.join(kept, _KEY, "left_semi")


def impute(cells: DataFrame, mode: str = "group_median", fill_value: float | None = 0.0) -> DataFrame:
    key = ["layer", "grp", "feature"]
    by = group_medians(cells, key).withColumnRenamed("median", "_m")
    if mode == "conservative":
        half = cells.groupBy(*key).agg((F.count("value") >= 0.5 * F.count(F.lit(1))).alias("_half"))
        by = by.join(half, key).select(*key, F.when(F.col("_half"), F.col("_m")).alias("_m"))
    out = cells.join(by, key)
    if fill_value is None:
        out = out.join(group_medians(cells, _KEY).withColumnRenamed("median", "_g"), _KEY)
        last = F.col("_g")
    else:
        last = F.lit(float(fill_value))
    return out.withColumn("value", F.coalesce("value", "_m", last)).select(*cells.columns)


def shift_negative(cells: DataFrame) -> DataFrame:
    low = cells.groupBy(*_KEY).agg(F.min("value").alias("_lo"))
    return cells.join(low, _KEY).withColumn("value", F.col("value") + F.when(F.col("_lo") < 0, F.abs("_lo") + 1).otherwise(0.0)).select(*cells.columns)


def transform(cells: DataFrame, how: str) -> DataFrame:
    return cells.withColumn("value", log_of(F.col("value"), how == "log2")) if how in ("log", "log2") else cells


def scale(cells: DataFrame, scaling: str) -> DataFrame:
    if scaling == "minmax":
        stats = cells.groupBy(*_KEY).agg(F.min("value").alias("_a"), (F.max("value") - F.min("value")).alias("_b"))
        by = F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_b"))
    elif scaling in ("standard", "pareto"):
        stats = cells.groupBy(*_KEY).agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_b"))
        flat = F.lit(1.0) if scaling == "standard" else F.raise_error(F.lit("a feature without variance cannot be Pareto scaled")).cast("double")
        by = F.when(F.col("_b") == 0, flat).otherwise(F.col("_b") if scaling == "standard" else F.sqrt("_b"))
    else:
        return cells
    return cells.join(stats, _KEY).withColumn("value", (F.col("value") - F.col("_a")) / by).select(*cells.columns)


def quality_check(cells: DataFrame) -> DataFrame:
    v = F.col("value")
    return cells.withColumn("value", F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), MAX_DOUBLE).when(v == float("-inf"), -MAX_DOUBLE).otherwise(v))


def preprocess(cells: DataFrame, config: Config) -> DataFrame:
    return _after_filter(drop_missing(cells, config.drop_threshold), config)


def _after_filter(cells: DataFrame, config: Config) -> DataFrame:
    out = drop_constant(impute(cells, config.impute, config.fill_value))
    if config.handle_negatives:
        out = shift_negative(out)
    return quality_check(scale(transform(out, config.transform), config.scaling))


def preprocess_vectors(layer: VectorLayer, config: Config, log: Log) -> VectorLayer:
    """The pipeline on a vector layer; its last key must tell rows apart."""
    key = layer.keys[-1]
    filtered = cut(drop_missing(layer.long(key), config.drop_threshold))
    cells = cut(_after_filter(filtered, config))
    kept = sorted(r[0] for r in cells.select("feature_ix").distinct().collect())  # at most the layer's features
    some = sorted(r[0] for r in filtered.select("feature_ix").distinct().collect())
    log.pipeline(config, layer.features, [layer.features[i] for i in some], [layer.features[i] for i in kept])
    rows = cells.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_ix", "value"))), lambda c: c["value"]).alias("x"))
    back = layer.df.drop("x").withColumn("_id", q(key).cast("string"))
    # Rows stay where no feature does, as in the wide form.
    none = F.array().cast("array<double>")
    out = back.join(rows, back._id == rows.sample_id, "left").select(*[back[f"`{c}`"] for c in layer.df.columns if c != "x"], F.coalesce(rows.x, none).alias("x"))
    return layer.with_df(out, [layer.features[i] for i in kept])
