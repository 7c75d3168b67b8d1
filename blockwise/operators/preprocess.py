"""Preprocessing of a layer (wide form): filter, impute, shift, transform, scale, check.

Each step is a plan over one or two aggregates of the layer; statistics reach the rows as a
one-row (or one-row-per-label) table by a join, so nothing is collected. Only the two steps that
decide which columns exist read a row of statistics on the driver. The order of the
pipeline is: missing filter, impute, constant filter, shift, transform, scale, check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.operators.layer import Layer, VectorLayer, cut, q
from blockwise.operators.ranks import STATE_ROWS, group_medians

# The guard added before a logarithm, and the limits put in place of infinities.
EPS = 1e-10
MAX_DOUBLE = 1.7976931348623157e308
#: Expressions per aggregate, to stay under the JVM's limit for generated methods.
CHUNK = 300
#: Medians (8 bytes each) that go to every task by label and feature.
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class Config:
    drop_threshold: float = 0.5
    fill_value: float | None = 0.0
    transform: str = "log"
    scaling: str = "pareto"
    handle_negatives: bool = False
    impute: str = "group_median"  # group_median, conservative, proteomics, none

    def merged(self, **changes) -> Config:
        return replace(self, **changes)


# The defaults for the three kinds of layers.
PRESETS = {
    "metabolomics": Config(0.5, 0.0, "log", "pareto", True, "group_median"),
    "volatiles": Config(0.6, 0.0, "log", "pareto", False, "conservative"),
    "proteomics": Config(0.3, None, "log2", "pareto", False, "proteomics"),
}


def preset(kind: str, **changes) -> Config:
    if kind not in PRESETS:
        raise ValueError(f"unknown kind of layer: {kind}")
    return PRESETS[kind].merged(**changes)


def one_row(layer: Layer, stats: dict[str, callable], features: Sequence[str] | None = None) -> DataFrame:
    """One row of statistics ``{name}_{i}`` for feature ``i``; chunks of the layer's columns are aggregated apart and joined."""
    features = layer.features if features is None else features
    per = max(1, CHUNK // max(len(stats), 1))
    out = None
    for at in range(0, max(len(features), 1), per):
        part = layer.df.agg(*[fn(q(c)).alias(f"{n}_{i}") for i, c in enumerate(features) if at <= i < at + per for n, fn in stats.items()] or [F.lit(1).alias("_none")])
        out = part if out is None else out.crossJoin(part)
    return out


def _with_row(layer: Layer, stats: DataFrame, fn) -> Layer:
    """Features as ``fn(column, i)``, where the one row of ``stats`` is in scope."""
    joined = layer.df.crossJoin(F.broadcast(stats))  # one row
    return layer.with_df(joined.select(*[q(k) for k in layer.keys], q(layer.group), *[fn(q(c), i).alias(c) for i, c in enumerate(layer.features)]))


# --- filters ------------------------------------------------------------------------------------------------


def missing_profile(layer: Layer, threshold: float) -> DataFrame:
    """(feature, feature_ix, missing_fraction, kept): kept at or under the threshold."""
    row = one_row(layer, {"m": lambda c: F.avg(c.isNull().cast("double"))})
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_ix"), q(f"m_{i}").alias("missing_fraction")) for i, c in enumerate(layer.features)])
    return row.select(F.inline(cells)).withColumn("kept", F.coalesce(F.col("missing_fraction") <= threshold, F.lit(False)))


def drop_missing(layer: Layer, threshold: float) -> Layer:
    kept = {r["feature"] for r in missing_profile(layer, threshold).where("kept").collect()}
    return layer.pruned([c for c in layer.features if c in kept])


def variance_profile(layer: Layer) -> DataFrame:
    """(feature, feature_ix, variance, kept): population variance above zero; a NaN or missing variance is not kept."""
    row = one_row(layer, {"v": F.var_pop})
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_ix"), q(f"v_{i}").alias("variance")) for i, c in enumerate(layer.features)])
    return row.select(F.inline(cells)).withColumn("kept", F.coalesce((F.col("variance") > 0) & ~F.isnan("variance"), F.lit(False)))


def drop_constant(layer: Layer) -> Layer:
    kept = {r["feature"] for r in variance_profile(layer).where("kept").collect()}
    return layer.pruned([c for c in layer.features if c in kept])


# --- imputation ---------------------------------------------------------------------------------------------


def _medians(layer: Layer, conservative: bool, overall: bool) -> tuple[DataFrame, DataFrame | None]:
    """(_g, _m0, _m1 ...): a row of medians per label, null where ``conservative`` finds too few values; and one row (g_0 ...) over all labels.

    Written once, for later steps of a pipeline would rank all cells for the medians again. An aggregate holds all values of
    a label and feature, so labels of more than ``STATE_ROWS`` rows are ranked by counts instead, with equal results.
    """
    names = layer.features
    enough = lambda i, m: F.when(F.col(f"_n{i}") >= 0.5 * F.col("_n"), m) if conservative else m
    count = layer.df.groupBy(q(layer.group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *[F.count(q(c)).alias(f"_n{i}") for i, c in enumerate(names)])
    sizes = count.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    if ((sizes["all"] if overall else sizes["most"]) or 0) <= STATE_ROWS:
        middle = layer.df.groupBy(q(layer.group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(names) for x in (F.count(q(c)).alias(f"_n{i}"), F.median(q(c)).alias(f"_x{i}"))])
        every = one_row(layer, {"g": F.median}) if overall else None
    else:
        cells = layer.df.select(q(layer.group).alias("_g"), F.posexplode(F.array(*[q(c) for c in names])).alias("ix", "value"))
        wide = lambda df, *by: df.groupBy(*by).agg(*[F.max(F.when(F.col("ix") == i, F.col("median"))).alias(f"_x{i}") for i in range(len(names))])
        middle = count.join(wide(group_medians(cells, ["_g", "ix"]), "_g"), "_g")
        every = wide(group_medians(cells, ["ix"])).select(*[F.col(f"_x{i}").alias(f"g_{i}") for i in range(len(names))]) if overall else None
    by = middle.select("_g", *[enough(i, F.col(f"_x{i}")).alias(f"_m{i}") for i in range(len(names))])
    return cut(by), every


def impute(layer: Layer, mode: str = "group_median", fill_value: float | None = 0.0) -> Layer:
    """Missing cells become the median of their label's rows, where the mode allows it, then ``fill_value``.

    ``conservative`` uses the median only where at least half of the label's rows have a value;
    without a ``fill_value`` the feature's global median fills the rest.
    """
    if mode == "none":
        return layer if fill_value is None else layer.map_features(lambda c, _: F.coalesce(c, F.lit(float(fill_value))))
    by, last_row = _medians(layer, mode == "conservative", fill_value is None)
    small = by.count() * max(len(layer.features), 1) <= BROADCAST_CELLS
    df = layer.df.join(F.broadcast(by) if small else by, q(layer.group) == F.col("_g"))
    last = [F.lit(float(fill_value))] * len(layer.features) if fill_value is not None else [q(f"g_{i}") for i in range(len(layer.features))]
    if fill_value is None:
        df = df.crossJoin(F.broadcast(last_row))  # one row
    cells = [F.coalesce(q(c), q(f"_m{i}"), last[i]).alias(c) for i, c in enumerate(layer.features)]
    return layer.with_df(df.select(*[q(k) for k in layer.keys], q(layer.group), *cells))


# --- transforms ---------------------------------------------------------------------------------------------


def shift_negative(layer: Layer) -> Layer:
    """A feature with a value below zero is raised by ``|min| + 1``."""
    return _with_row(layer, one_row(layer, {"lo": F.min}), lambda c, i: c + F.when(q(f"lo_{i}") < 0, F.abs(q(f"lo_{i}")) + 1).otherwise(F.lit(0.0)))


def log_of(c: Column, base2: bool = False) -> Column:
    """Logarithm of ``c + 1e-10``; not positive gives NaN, which then spreads through the feature's statistics."""
    x = c + F.lit(EPS)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(x > 0, F.log2(x) if base2 else F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def transform(layer: Layer, how: str) -> Layer:
    if how not in ("log", "log2"):
        return layer
    return layer.map_features(lambda c, _: log_of(c, how == "log2"))


# --- scaling ------------------------------------------------------------------------------------------------

_SCALERS = {
    "standard": ({"a": F.avg, "b": F.stddev_pop}, lambda c, a, b: (c - a) / F.when(b == 0, F.lit(1.0)).otherwise(b)),
    "minmax": ({"a": F.min, "b": F.max}, lambda c, a, b: (c - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a)),
    "pareto": (
        {"a": F.avg, "b": F.stddev_pop},
        lambda c, a, b: (c - a) / F.when(b == 0, F.raise_error(F.lit("a feature without variance cannot be Pareto scaled")).cast("double")).otherwise(F.sqrt(b)),
    ),
}


@dataclass(frozen=True)
class FittedScaler:
    """Parameters of a scaling as a one-row table, so that new data can be scaled by them."""

    scaling: str
    params: DataFrame | None

    @staticmethod
    def fit(layer: Layer, scaling: str) -> FittedScaler:
        return FittedScaler(scaling, one_row(layer, _SCALERS[scaling][0]) if scaling in _SCALERS else None)

    def apply(self, layer: Layer) -> Layer:
        if self.params is None:
            return layer
        return _with_row(layer, self.params, lambda c, i: _SCALERS[self.scaling][1](c, q(f"a_{i}"), q(f"b_{i}")))


def scale(layer: Layer, scaling: str) -> Layer:
    return FittedScaler.fit(layer, scaling).apply(layer)


def quality_check(layer: Layer) -> Layer:
    """NaN and missing become 0, infinities the largest doubles."""

    def fixed(c: Column, _: str) -> Column:
        return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).when(c == float("inf"), F.lit(MAX_DOUBLE)).when(c == float("-inf"), F.lit(-MAX_DOUBLE)).otherwise(c)

    return layer.map_features(fixed)


# --- pipeline -----------------------------------------------------------------------------------------------


@dataclass
class Log:
    """Structured log: (step, metric, value)."""

    rows: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, step: str, metric: str, value: object) -> None:
        self.rows.append((step, metric, str(value)))

    def pipeline(self, config: Config, first: Sequence[str], filtered: Sequence[str], kept: Sequence[str]) -> None:
        """The decisions of a pipeline, step by step: features at the start, after the missing and after the constant filter, and the settings."""
        gone = lambda a, b: ", ".join(sorted(set(a) - set(b), key=list(a).index))
        for step, metric, value in (
            ("start", "features", len(first)), ("missing filter", "threshold", config.drop_threshold), ("missing filter", "features", len(filtered)), ("missing filter", "dropped", gone(first, filtered)),
            ("impute", "mode", config.impute), ("impute", "fill", config.fill_value), ("constant filter", "features", len(kept)), ("constant filter", "dropped", gone(filtered, kept)),
            ("shift", "negatives", config.handle_negatives), ("transform", "method", config.transform), ("scale", "method", config.scaling),
        ):
            self.add(step, metric, value)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, metric string, value string")


def preprocess(layer: Layer | VectorLayer, config: Config, log: Log | None = None) -> Layer:
    """The whole pipeline; the result is lazy apart from the two column decisions. Vector layers go through the long form."""
    if isinstance(layer, VectorLayer):
        from blockwise.operators.long_form import preprocess_vectors

        return preprocess_vectors(layer, config, log or Log())
    log = log or Log()
    out = drop_missing(layer, config.drop_threshold)
    filtered = impute(out, config.impute, config.fill_value)
    kept = drop_constant(filtered)
    log.pipeline(config, layer.features, out.features, kept.features)
    if config.handle_negatives:
        kept = shift_negative(kept)
    return quality_check(scale(transform(kept, config.transform), config.scaling))
