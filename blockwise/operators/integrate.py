"""Integration of layers: alignment on sample keys, concatenation, block ranges and weights.

Tables are in long form (layer, sample_id, grp, feature, feature_ix, value) or, where noted, one row
per sample. The order of layers is that of the given list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwise.operators.ranks import row_numbers


def _order(names: Sequence[str]):
    return F.coalesce(*[F.when(F.col("layer") == n, F.lit(i)) for i, n in enumerate(names)])


def union_layers(layers: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


def common_samples(samples: DataFrame) -> DataFrame:
    """(layer, sample_id) rows -> sample ids present in every layer."""
    n = samples.select(F.count_distinct("layer").alias("n_layers"))
    return samples.groupBy("sample_id").agg(F.count_distinct("layer").alias("k")).crossJoin(F.broadcast(n)).where("k = n_layers").select("sample_id")


def excluded_counts(samples: DataFrame) -> DataFrame:
    """Per layer: ids that some other layer lacks."""
    ids = samples.select("layer", "sample_id").distinct()
    out = ids.join(common_samples(samples), "sample_id", "left_anti").groupBy("layer").agg(F.count(F.lit(1)).alias("n_excluded"))
    return ids.select("layer").distinct().join(out, "layer", "left").select("layer", F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"))


def last_per_sample(samples: DataFrame) -> DataFrame:
    """Of repeated ids within a layer the last row (by row_ix) counts."""
    w = W.partitionBy("layer", "sample_id").orderBy(F.desc("row_ix"))
    return samples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def align(layers: Mapping[str, DataFrame], positional: bool = False) -> DataFrame:
    """One row per common sample: sample_id, then ``{layer}_grp`` and ``{layer}_x``.

    Inputs have (sample_id, row_ix, grp, x). With ``positional`` rows are paired by their rank in
    ``row_ix``, which is only right if all layers have the same sample order.
    """
    sides = []
    for name, df in layers.items():
        one = last_per_sample(df.withColumn("layer", F.lit(name)))
        if positional:
            one = row_numbers(one, ["row_ix"], "_rank")
        key = (F.col("_rank") + 1).cast("string") if positional else F.col("sample_id")
        sides.append(one.select(key.alias("sample_id"), F.col("grp").alias(f"{name}_grp"), F.col("x").alias(f"{name}_x")))
    return reduce(lambda a, b: a.join(b, "sample_id"), sides)


def label_conflicts(aligned: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per layer after the first: aligned samples whose label differs from the first layer's."""
    first = F.col(f"{names[0]}_grp")
    row = aligned.agg(*[F.coalesce(F.sum((first != F.col(f"{n}_grp")).cast("bigint")), F.lit(0)).alias(n) for n in names[1:]])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("n_conflicts")) for n in names[1:]])))


def concatenate(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells of all layers under prefixed names ``layer_feature``; aligned samples only; the first layer's label counts."""
    shared = common_samples(cells.select("layer", "sample_id"))
    label = cells.where(F.col("layer") == names[0]).groupBy("sample_id").agg(F.max("grp").alias("grp"))
    kept = cells.where(F.col("layer").isin(*names)).join(shared, "sample_id", "left_semi").drop("grp")
    return kept.join(label, "sample_id").select("sample_id", "grp", F.concat_ws("_", "layer", "feature").alias("feature"), "layer", "feature_ix", "value")


def block_ranges(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(layer, start, end): half-open column ranges in concatenation order."""
    n = cells.groupBy("layer").agg(F.count_distinct("feature").alias("n")).withColumn("ord", _order(names))
    upto = F.sum("n").over(W.orderBy("ord"))  # one row per layer
    return n.select("layer", (upto - F.col("n")).cast("bigint").alias("start"), upto.cast("bigint").alias("end"))


def layer_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer").agg(
        F.count_distinct("sample_id").alias("samples"), F.count_distinct("feature").alias("features"), F.count_distinct("grp").alias("groups"), F.sum(F.col("value").isNull().cast("bigint")).alias("missing_values")
    )


def block_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer").agg(F.count_distinct("feature").alias("features"), F.count("value").alias("total_values"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def weighted(cells: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Every cell times its layer's weight; a layer without one has weight 1."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
    by = F.coalesce(F.try_element_at(table, F.col("layer")), F.lit(1.0)) if weights else F.lit(1.0)
    return cells.withColumn("value", F.col("value") * by)


def early_integration(cells: DataFrame, strategy: str = "simple") -> DataFrame:
    """simple: as they are; weighted: times 1/sqrt(features of the layer); normalized: over the standard deviation of all its cells."""
    if strategy == "simple":
        return cells
    if strategy == "weighted":
        stats = cells.groupBy("layer").agg((1 / F.sqrt(F.count_distinct("feature"))).alias("_by"))
    elif strategy == "normalized":
        stats = cells.groupBy("layer").agg((1 / (F.stddev_pop("value") + 1e-10)).alias("_by"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return cells.join(stats, "layer").withColumn("value", F.col("value") * F.col("_by")).drop("_by")


def select_by_variance(cells: DataFrame, n_features: int) -> DataFrame:
    """The features of largest population variance over all layers, with their rank; ties by name."""
    v = cells.groupBy("layer", "feature").agg(F.var_pop("value").alias("variance"))
    return v.orderBy(F.desc("variance"), "layer", "feature").limit(n_features)


def select_by_mutual_information(cells: DataFrame, n_features: int, bins: int = 10) -> DataFrame:
    """The features that tell most about the label: mutual information of the label and equal-width bins of the feature."""
    key = ["layer", "feature"]
    lim = cells.where("value is not null").groupBy(*key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    binned = cells.where("value is not null").join(lim, key).withColumn("bin", F.coalesce(F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1)), F.lit(0)))
    joint = binned.groupBy(*key, "grp", "bin", "n").agg(F.count(F.lit(1)).alias("c"))
    joint = joint.withColumn("cg", F.sum("c").over(W.partitionBy(*key, "grp"))).withColumn("cb", F.sum("c").over(W.partitionBy(*key, "bin")))
    mi = joint.groupBy(*key).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cg") * F.col("cb")))).alias("mutual_information"))
    return mi.orderBy(F.desc("mutual_information"), *key).limit(n_features)
