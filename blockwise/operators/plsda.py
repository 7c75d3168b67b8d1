"""PLS discriminant analysis: fit on cross-products, VIP, prediction, cross-validation by down-dating."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.linalg import Pls, Stats, pls, predict_class
from blockwise.operators.layer import Layer, q
from blockwise.operators.ranks import row_numbers
from blockwise.operators.statistics import cross_products, project, refuse_loo


def one_hot(df: DataFrame, group: str, classes: list[str]) -> DataFrame:
    """Columns ``y_{class}`` in the order of the sorted classes; two classes give one column for the second."""
    pick = classes[1:] if len(classes) == 2 else classes
    return df.select("*", *[F.when(q(group) == c, 1.0).otherwise(0.0).alias(f"y_{c}") for c in pick])


@dataclass
class PlsDa:
    layer: Layer
    model: Pls
    stats: Stats

    @staticmethod
    def fit(layer: Layer, n_components: int = 2) -> PlsDa:
        stats = cross_products(layer.vectors(), len(layer.features))[None]
        return PlsDa(layer, pls(stats, n_components), stats)

    @property
    def classes(self) -> list[str]:
        return self.stats.classes

    def scores(self) -> DataFrame:
        return project(self.layer.vectors(), self.model.x_mean, self.model.rotations, "lv").drop("x")

    def loadings_table(self) -> DataFrame:
        rows = [(f, i, j + 1, float(self.model.loadings[i, j])) for i, f in enumerate(self.layer.features) for j in range(self.model.loadings.shape[1])]
        return self.layer.df.sparkSession.createDataFrame(rows, "feature string, feature_ix int, pc int, loading double")

    def vip(self) -> DataFrame:
        """(Feature, VIP, Important), largest first; ties by name."""
        rows = [(f, float(v), bool(v > 1)) for f, v in zip(self.layer.features, self.model.vip(), strict=True)]
        return self.layer.df.sparkSession.createDataFrame(rows, "Feature string, VIP double, Important boolean").orderBy(F.desc("VIP"), "Feature")

    def predict(self, layer: Layer | None = None) -> DataFrame:
        """Keys, grp and pred of a layer with the same features."""
        out = project((layer or self.layer).vectors(), self.model.x_mean, self.model.coef, "y_hat", self.model.y_mean)
        return out.withColumn("pred", _class_of(F.col("y_hat"), self.classes)).drop("x", "y_hat")

    def cross_validate(self, cv: int | None = None) -> DataFrame:
        """Keys, grp, fold, pred. ``cv`` None is leave-one-out; an int is contiguous folds of the row order.

        Leave-one-out down-dates the totals by one row at a time inside the tasks; k folds subtract the fold's own statistics. Rows
        are read once more, never shuffled.
        """
        a, width = self.model.weights.shape[1], len(self.layer.features)
        totals, spark = self.stats, self.layer.df.sparkSession
        if cv is None:
            refuse_loo(totals.n, len(totals.sums))
            shared = spark.sparkContext.broadcast(totals)  # at most MAX_WIDTH squared or MAX_CELLS numbers
            vec = self.layer.vectors()
            keys = [f for f in vec.schema.fields if f.name != "x"]

            def loo(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                t = shared.value
                for b in batches:
                    x = np.asarray(b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(b.num_rows, width) if b.num_rows else np.zeros((0, width))
                    labels = b.column(b.schema.get_field_index("grp")).to_pylist()
                    pred = []
                    for row, g in zip(x, labels, strict=True):
                        m = pls(t.without(row, g), a)
                        pred.append(predict_class(((row - m.x_mean) @ m.coef + m.y_mean)[None], t.classes)[0])
                    cols = [b.column(b.schema.get_field_index(f.name)) for f in keys]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string())], names=[*(f.name for f in keys), "pred"])

            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", pred string"
            return vec.mapInArrow(loo, schema)
        numbered = row_numbers(self.layer.vectors(), [self.layer.keys[-1]], "_row")
        rows = numbered.withColumn("fold", F.floor(F.col("_row") * cv / int(totals.n)).cast("int")).drop("_row")
        parts = cross_products(rows, width, "fold", totals.basis)
        out = None
        for k, part in parts.items():
            m = pls(totals.minus(part), a)
            one = project(rows.where(F.col("fold") == k), m.x_mean, m.coef, "y_hat", m.y_mean).withColumn("pred", _class_of(F.col("y_hat"), self.classes)).drop("x", "y_hat")
            out = one if out is None else out.unionByName(one)
        return out


def _class_of(y: Column, classes: list[str]) -> Column:
    if len(classes) == 2:
        return F.when(y[0] > 0.5, F.lit(classes[1])).otherwise(F.lit(classes[0]))
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(y, F.array_max(y)).cast("int"))


def vip_from_tables(weights: DataFrame, ss: DataFrame) -> DataFrame:
    """(feature, vip) from (feature, comp, w) and (comp, ss)."""
    n = weights.select(F.count_distinct("feature").alias("p"))
    got = weights.join(ss, "comp").crossJoin(F.broadcast(n)).groupBy("feature", "p").agg(F.sqrt(F.col("p") * F.sum(F.col("ss") * F.col("w") * F.col("w")) / F.sum("ss")).alias("vip"))
    return got.select("feature", "vip")
