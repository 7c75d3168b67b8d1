"""Principal components of a layer: one cross-product pass, a small eigenproblem, projected scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.linalg import principal_components
from blockwise.operators.layer import Layer
from blockwise.operators.statistics import cross_products, project


@dataclass
class Pca:
    layer: Layer
    ratio: np.ndarray
    loadings: np.ndarray
    mean: np.ndarray

    @staticmethod
    def fit(layer: Layer, n_components: int = 5) -> Pca:
        stats = cross_products(layer.vectors(), len(layer.features))[None]
        ratio, loadings = principal_components(stats, min(n_components, int(stats.n)))
        return Pca(layer, ratio, loadings, stats.outer(stats.mean))

    @property
    def _spark(self):
        return self.layer.df.sparkSession

    def variance(self) -> DataFrame:
        """(PC, Variance_Explained, Cumulative_Variance) in percent of the total variance."""
        cum = np.cumsum(self.ratio) * 100
        return self._spark.createDataFrame([(f"PC{i + 1}", float(r * 100), float(c)) for i, (r, c) in enumerate(zip(self.ratio, cum, strict=True))], "PC string, Variance_Explained double, Cumulative_Variance double")

    def scores(self) -> DataFrame:
        """Keys, grp and ``pc``: the array of scores."""
        return project(self.layer.vectors(), self.mean, self.loadings, "pc").drop("x")

    def loadings_table(self) -> DataFrame:
        rows = [(f, i, j + 1, float(self.loadings[i, j])) for i, f in enumerate(self.layer.features) for j in range(self.loadings.shape[1])]
        return self._spark.createDataFrame(rows, "feature string, feature_ix int, pc int, loading double")

    def top_loadings(self, pc: int = 1, top_n: int = 10) -> DataFrame:
        return top_loadings(self.loadings_table(), pc, top_n)


def top_loadings(loadings: DataFrame, pc: int = 1, top_n: int = 10) -> DataFrame:
    """(Feature, Loading, Abs_Loading) of a component, largest magnitude first; ties by name."""
    one = loadings.where(F.col("pc") == pc).select(F.col("feature").alias("Feature"), F.col("loading").alias("Loading"), F.abs("loading").alias("Abs_Loading"))
    return one.orderBy(F.desc("Abs_Loading"), "Feature").limit(top_n)
