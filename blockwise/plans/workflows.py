"""Workflows: the operators composed as an analyst runs them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions import metrics
from blockwise.operators import integrate, preprocess
from blockwise.operators.classifiers import Classifier
from blockwise.operators.diablo import Diablo, block_correlations, consensus, arrows, selected_features, top_per_block
from blockwise.operators.diablo_validation import choose_components, component_errors, loo_predictions
from blockwise.operators.layer import Layer, cut
from blockwise.operators.pca import Pca
from blockwise.operators.plsda import PlsDa
from blockwise.operators.ranks import row_numbers, stratified_folds
from blockwise.operators.resample import fold_scores
from blockwise.plans import plotdata

#: Models that leave-one-out of a classifier may fit.
MAX_LOO_FITS = 500


@dataclass
class SingleLayerWorkflow:
    kind: str = "metabolomics"
    changes: dict = field(default_factory=dict)
    results: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.config = preprocess.preset(self.kind, **self.changes)
        self.log = preprocess.Log()

    def run_preprocessing(self, layer: Layer) -> Layer:
        self.layer = preprocess.preprocess(layer, self.config, self.log)
        self.layer = self.layer.with_df(cut(self.layer.df))  # read by every later step
        return self.layer

    def run_pca(self, n_components: int = 5) -> dict:
        m = self.pca = Pca.fit(self.layer, n_components)
        got = {"pca_variance_explained": m.variance(), "pca_loadings_pc1": m.top_loadings(1), "pca_loadings_pc2": m.top_loadings(2), "fig_scree": plotdata.scree(m.variance()), "fig_scores": plotdata.score_points(m.scores())}
        got["fig_biplot"] = plotdata.biplot_arrows(m.loadings_table(), m.scores())
        self.results |= got
        return got

    def run_plsda(self, n_components: int = 2, cv: int | None = None) -> dict:
        m = self.plsda = PlsDa.fit(self.layer, n_components)
        pred = cut(m.cross_validate(cv))
        got = {"plsda_vip_scores": m.vip(), "plsda_cv": pred, "plsda_accuracy": metrics.accuracy(pred), "plsda_report": metrics.report(pred), "plsda_confusion": metrics.confusion(pred), "fig_plsda_scores": plotdata.score_points(m.scores(), "lv")}
        self.results |= got
        return got

    def run_full_analysis(self, layer: Layer, n_components: int = 5) -> dict:
        self.run_preprocessing(layer)
        self.run_pca(n_components)
        self.run_plsda()
        return self.results


@dataclass
class MultiLayerWorkflow:
    layers: dict[str, Layer] = field(default_factory=dict)
    sample_cols: dict[str, str] = field(default_factory=dict)
    results: dict = field(default_factory=dict)

    def add_layer(self, name: str, layer: Layer, kind: str, sample_col: str, equal_n: int | None = None, **changes) -> None:
        """A preprocessed layer; with ``equal_n`` its rows must be that many, as positional pairing needs."""
        if name in self.layers:
            raise ValueError(f"there is a layer {name} already")
        if equal_n is not None and (n := layer.df.count()) != equal_n:
            raise ValueError(f"layer {name} has {n} rows, not {equal_n}")
        layer = layer.with_df(cut(layer.df))  # every statistic of the preprocessing reads it
        self.layers[name] = preprocess.preprocess(layer, preprocess.preset(kind, **changes))
        self.sample_cols[name] = sample_col

    def _vectors(self, name: str) -> DataFrame:
        layer = self.layers[name]
        row = F.col("row_ix") if "row_ix" in layer.keys else F.lit(0)
        v = layer.vectors(*layer.keys)
        return v.select(F.col(self.sample_cols[name]).cast("string").alias("sample_id"), row.cast("bigint").alias("row_ix"), "grp", "x")

    def prepare_integration(self, positional: bool = False, strict: bool = False) -> DataFrame:
        """One row per aligned sample: sample_id, grp and one array per layer; strict raises on conflicting labels."""
        names = list(self.layers)
        aligned = cut(integrate.align({n: self._vectors(n) for n in names}, positional))
        self.results["label_conflicts"] = integrate.label_conflicts(aligned, names) if len(names) > 1 else None
        if strict and len(names) > 1 and not self.results["label_conflicts"].where("n_conflicts > 0").isEmpty():
            raise ValueError("layers disagree on labels")
        if aligned.isEmpty():
            raise ValueError("the layers share no sample")
        self.joined = aligned.select("sample_id", F.col(f"{names[0]}_grp").alias("grp"), *[F.col(f"{n}_x").alias(n) for n in names])
        return self.joined

    @property
    def features(self) -> dict[str, list[str]]:
        return {n: list(x.features) for n, x in self.layers.items()}

    def block(self, name: str) -> DataFrame:
        """sample_id and x of one aligned block."""
        if name not in self.layers:
            raise KeyError(name)
        return self.joined.select("sample_id", F.col(name).alias("x"))

    def labels(self) -> DataFrame:
        return self.joined.select("sample_id", "grp")

    def set_labels(self, labels: DataFrame) -> None:
        """Replaces the labels by (sample_id, grp); every aligned sample must have one, and only one."""
        got = self.joined.drop("grp").join(labels.select("sample_id", "grp"), "sample_id", "left").select(*self.joined.columns)
        if got.count() != self.joined.count() or not got.where("grp is null").isEmpty():
            raise ValueError("every sample needs one label")
        self.joined = got

    def statistical_report(self) -> DataFrame:
        p = sum(len(x.features) for x in self.layers.values())
        return limitations(self.joined, p)

    def model_summary(self, n_components: int) -> DataFrame:
        """(block, n_samples, n_components, n_features, n_selected) of the fitted model."""
        kept = selected_features(self.diablo.loadings()).groupBy("block").agg(F.count(F.lit(1)).alias("n_selected"))
        sizes = self.joined.sparkSession.createDataFrame([(n, n_components, len(f)) for n, f in self.features.items()], "block string, n_components int, n_features int")
        return sizes.join(kept, "block", "left").crossJoin(self.joined.agg(F.count(F.lit(1)).alias("n_samples"))).select("block", "n_samples", "n_components", "n_features", F.coalesce("n_selected", F.lit(0)).alias("n_selected"))

    def run_diablo(self, n_components: int | None = 2, design: float = 0.1) -> dict:
        if n_components is None:
            self.results["diablo_performance"] = errors = component_errors(self.joined, self.features, design=design)
            n_components = choose_components([tuple(r) for r in errors.collect()])  # one row per number of components
        m = self.diablo = Diablo.fit(self.joined, self.features, n_components, design)
        v = m.variates()
        corr = block_correlations(v)
        got = {"diablo_correlations": corr, "diablo_vips": top_per_block(selected_features(m.loadings()), 10), "diablo_predictions": m.predict(), "fig_circos": plotdata.circos_edges(corr, 0.5)}
        got |= {"diablo_loo": loo_predictions(self.joined, self.features, n_components, design), "diablo_summary": self.model_summary(n_components)}
        got |= {"fig_samples": v, "fig_consensus": consensus(v), "fig_arrows": arrows(v), "fig_loading_heatmap": plotdata.loading_heatmap(m.loadings().where("comp = 1")), "fig_importance": plotdata.importance_comparison(m.loadings().where("comp = 1"))}
        self.results |= got
        return got

    def run_concatenation(self, kind: str = "random_forest", k: int | None = None, trees: int = 500, cv: bool = True) -> dict:
        """The classifier on all features side by side; held-out scores by leave-one-out, or by ``k`` stratified folds.

        Leave-one-out fits a model for every sample, so it is refused beyond ``MAX_LOO_FITS`` samples.
        """
        names = [f"{n}_{f}" for n, x in self.layers.items() for f in x.features]
        rows = self.joined.select("sample_id", "grp", F.concat(*[F.col(n) for n in self.layers]).alias("x")).persist()
        got = {}
        if cv:
            if k is None:
                n = rows.count()
                if n > MAX_LOO_FITS:
                    raise ValueError(f"leave-one-out of {n} samples would fit {n} models; give a number of folds")
                folded, k = row_numbers(rows, ["sample_id"], "fold"), n
            else:
                folded = stratified_folds(rows, F.pmod(F.xxhash64("sample_id"), F.lit(1 << 40)), "grp", k)
            folded = cut(folded)
            parts = [Classifier(kind, trees=trees).fit(folded.where(F.col("fold") != i).drop("fold"), names).predict(folded.where(F.col("fold") == i)) for i in range(k)]
            pred = cut(reduce(DataFrame.unionByName, parts))
            got |= {"concatenation_cv": fold_scores(pred), "concatenation_predictions": pred, "concatenation_report": metrics.report(pred), "concatenation_confusion": metrics.confusion(pred)}
        self.baseline = Classifier(kind, trees=trees).fit(rows, names)
        if kind == "random_forest":
            got["concatenation_importance"] = self.baseline.importances(20)
        rows.unpersist()
        self.results |= got
        return got

    def compare_methods(self) -> DataFrame:
        """(Method, Accuracy, Std) on held-out samples: concatenation by its folds, the multi-block model by leave-one-out."""
        parts = []
        if "concatenation_cv" in self.results:
            parts.append(self.results["concatenation_cv"].select(F.lit("Concatenation").alias("Method"), F.col("mean").alias("Accuracy"), F.col("std").alias("Std")))
        if "diablo_loo" in self.results:
            ok = (F.col("grp") == F.col("pred")).cast("double")
            parts.append(self.results["diablo_loo"].agg(F.lit("DIABLO").alias("Method"), F.avg(ok).alias("Accuracy"), F.stddev_pop(ok).alias("Std")))
        if not parts:
            raise ValueError("no method has been run")
        self.results["method_comparison"] = reduce(DataFrame.unionByName, parts)
        return self.results["method_comparison"]

    def run_full_integration(self, n_components: int | None = 2, design: float = 0.1, kind: str = "random_forest", k: int | None = None, trees: int = 500, positional: bool = False) -> dict:
        """All steps on the layers added so far: alignment, report, multi-block model, concatenation, comparison."""
        self.prepare_integration(positional)
        self.results["limitations"] = self.statistical_report()
        self.run_diablo(n_components, design)
        self.run_concatenation(kind, k, trees)
        self.compare_methods()
        return self.results


def limitations(samples: DataFrame, n_features: int) -> DataFrame:
    """(n_samples, total_features, n_classes, ratio, high_risk): more features than samples is a high risk of overfitting."""
    g = samples.agg(F.count_distinct("sample_id").alias("n_samples"), F.lit(n_features).cast("bigint").alias("total_features"), F.count_distinct("grp").alias("n_classes"))
    return g.withColumn("ratio", F.try_divide("total_features", "n_samples")).withColumn("high_risk", F.col("total_features") > F.col("n_samples"))


def config_sweep(layer: Layer, configs: Mapping[str, preprocess.Config], n_components: int = 2) -> DataFrame:
    """(Config_ID, Accuracy, Std) by leave-one-out PLS-DA of each configuration, best first."""
    parts = []
    for name, c in configs.items():
        pred = PlsDa.fit(preprocess.preprocess(layer, c), n_components).cross_validate()
        ok = (F.col("grp") == F.col("pred")).cast("double")
        parts.append(pred.agg(F.lit(name).alias("Config_ID"), F.avg(ok).alias("Accuracy"), F.stddev_pop(ok).alias("Std")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("Accuracy"), "Config_ID")


def summary_report(single: Mapping[str, dict], correlations: DataFrame | None = None) -> DataFrame:
    """(ord, section, key, value) rows of the text report over result tables."""
    parts, at = [], 0
    for name, r in single.items():
        var = r["pca_variance_explained"].where("PC = 'PC2'").select(F.lit("PC1+PC2 variance (%)").alias("key"), F.round("Cumulative_Variance", 2).cast("string").alias("value"))
        acc = r["plsda_accuracy"].select(F.lit("cross-validated accuracy (%)").alias("key"), F.round(F.col("accuracy") * 100, 1).cast("string").alias("value"))
        vip = r["plsda_vip_scores"].agg(F.lit("features with VIP > 1").alias("key"), F.sum(F.col("Important").cast("int")).cast("string").alias("value"))
        top = r["plsda_vip_scores"].agg(F.lit("top feature").alias("key"), F.max_by("Feature", "VIP").alias("value"))
        for p in (var, acc, vip, top):
            parts.append(p.select(F.lit(at).alias("ord"), F.lit(name).alias("section"), "key", "value"))
            at += 1
    if correlations is not None:
        c = correlations.where("block_i < block_j").select(F.lit(at).alias("ord"), F.lit("block correlations").alias("section"), F.concat_ws(" - ", "block_i", "block_j").alias("key"), F.round("corr", 4).cast("string").alias("value"))
        parts.append(c)
    return reduce(DataFrame.unionByName, parts)
