"""Classifiers on concatenated blocks: a forest, logistic regression by Spark ML, and two kernel machines.

The forest's trees are grown in tasks and kept as a table, since the nodes of deep trees on many rows do not fit the driver.

``svm`` is the exact machine with a radial kernel, one class against another: every pair of classes is a task, and the
machine is a table. ``svm_features`` is a linear machine on random Fourier features, an approximation for tables of any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.functions.forest import codes_of, grow, split_points
from blockwise.functions.svm import radial, two_class_rows
from blockwise.operators.layer import cut
from blockwise.operators.parts import SMALL_BLOCK_BITS, matrix, numbered_rows, predict_by_parts
from blockwise.operators.statistics import project

#: Rows of two classes that a task takes (0.5 GB at 64 features); the time grows with the square of their number.
MAX_KERNEL_ROWS = 1_000_000
#: Support vectors of one part of a machine.
PART_ROWS = 8192


@dataclass
class KernelMachine:
    """Support vectors with their coefficients in each pair of classes, as a table of ``n_parts`` parts, and the pairs' offsets."""

    parts: DataFrame | None
    n_parts: int
    gamma: float
    labels: list[str]
    pairs: list[tuple[int, int]]
    offsets: np.ndarray

    @staticmethod
    def fit(vectors: DataFrame) -> KernelMachine:
        """Every pair of classes is a task that gets their rows; no row comes to the driver."""
        size = {r["grp"]: r["n"] for r in vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
        labels = sorted(size)
        most = sum(sorted(size.values())[-2:])
        if most > MAX_KERNEL_ROWS:
            raise ValueError(f"{most} rows of two classes: the exact kernel machine takes up to {MAX_KERNEL_ROWS}; use svm_features")
        pairs = list(combinations(range(len(labels)), 2))
        if not pairs:
            return KernelMachine(None, 0, 1.0, labels, [], np.zeros(0))
        spark = vectors.sparkSession
        rows = numbered_rows(vectors.select("grp", "x"))
        width, spread = rows.select(F.size("x").alias("w"), F.explode("x").alias("v")).agg(F.max("w"), F.var_pop("v")).first()
        gamma = 1.0 / (max(width or 0, 1) * max(spread or 0.0, 1e-12))
        of = F.create_map(*[F.lit(v) for i, g in enumerate(labels) for v in (g, [k for k, p in enumerate(pairs) if i in p])])
        first = F.create_map(*[F.lit(v) for k, (a, _) in enumerate(pairs) for v in (k, labels[a])])
        each = rows.select("_id", "x", "grp", F.explode(of[F.col("grp")]).alias("pair"))
        each = each.select("_id", "x", "pair", F.when(F.col("grp") == first[F.col("pair")], 1.0).otherwise(-1.0).alias("y"))

        def one(g: pa.Table) -> pa.Table:
            g = g.sort_by("_id")
            coef, offset = two_class_rows(matrix(g.column("x"), g.num_rows), g.column("y").to_numpy(), gamma)
            used = np.flatnonzero(coef)
            ids = np.concatenate([[-1], g.column("_id").to_numpy()[used]])
            return pa.table({"pair": pa.array(np.full(len(ids), g.column("pair")[0].as_py()), pa.int32()), "_id": pa.array(ids, pa.int64()), "coef": pa.array(np.concatenate([[offset], coef[used]]))})

        # More partitions than pairs, so that few pairs share one.
        got = cut(each.repartition(4 * len(pairs), "pair").groupBy("pair").applyInArrow(one, "pair int, _id long, coef double"))
        offsets = np.zeros(len(pairs))
        for r in got.where("_id < 0").collect():
            offsets[r["pair"]] = r["coef"]
        used = got.where("_id >= 0").groupBy("_id").agg(F.collect_list("pair").alias("pairs"), F.collect_list("coef").alias("coefs"))
        n_parts = max(1, -(-got.where("_id >= 0").select("_id").distinct().count() // PART_ROWS))
        n_pairs = len(pairs)

        def pack(g: pa.Table) -> pa.Table:
            g = g.sort_by("_id")
            coef = np.zeros((g.num_rows, n_pairs))
            at = np.repeat(np.arange(g.num_rows), [len(v) for v in g.column("pairs")])
            coef[at, g.column("pairs").combine_chunks().flatten().to_numpy()] = g.column("coefs").combine_chunks().flatten().to_numpy()
            return pa.table({"part": g.column("part")[:1], "m": pa.array([pickle.dumps((matrix(g.column("x"), g.num_rows), coef))])})

        parts = used.join(rows.select("_id", "x"), "_id").withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(n_parts)))
        parts = cut(parts.groupBy("part").applyInArrow(pack, "part long, m binary"))
        return KernelMachine(parts, n_parts, gamma, labels, pairs, offsets)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Votes of the pairs; of equally many the first class."""
        if not self.pairs:
            return vectors.drop("x").withColumn("pred", F.lit(self.labels[0] if self.labels else None).cast("string"))
        gamma, labels, pairs, offsets = self.gamma, self.labels, self.pairs, self.offsets

        def score(x: np.ndarray, m: bytes) -> np.ndarray:
            own, coef = pickle.loads(m)
            return np.concatenate([radial(x[at : at + 512], own, gamma) @ coef for at in range(0, len(x), 512)])

        def choose(said: np.ndarray) -> list[str]:
            votes = np.zeros((len(said), len(labels)))
            for k, (a, b) in enumerate(pairs):
                votes[:, a] += said[:, k] > offsets[k]
                votes[:, b] += said[:, k] <= offsets[k]
            return [labels[i] for i in votes.argmax(1)]

        return predict_by_parts(vectors, self.parts, self.n_parts, score, choose, SMALL_BLOCK_BITS)


@dataclass
class Forest:
    """Trees as a table of ``n_parts`` parts, and the features' importances (each tree's decreases of impurity sum to one)."""

    parts: DataFrame
    n_parts: int
    labels: list[str]
    importances: np.ndarray

    @staticmethod
    def fit(vectors: DataFrame, trees: int, seed: int, depth: int = 30) -> Forest:
        """Features are cut into bins over all rows; every task gets the bins of all rows, a byte a cell, and grows some of the trees."""
        spark = vectors.sparkSession
        rows = numbered_rows(vectors.select("grp", "x").where("grp is not null"))
        labels = sorted(r["grp"] for r in rows.select("grp").distinct().collect())  # one row per class
        if not labels:
            raise ValueError("no labelled rows")

        def columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0), b.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in x.T], pa.binary())], names=["ix", "v"])

        def cuts(g: pa.Table) -> pa.Table:
            return pa.table({"ix": g.column("ix")[:1], "v": pa.array([split_points(np.concatenate([np.frombuffer(v.as_buffer()) for v in g.column("v")])).tobytes()])})

        found = rows.select("x").mapInArrow(columns, "ix int, v binary").groupBy("ix").applyInArrow(cuts, "ix int, v binary").collect()  # up to 31 numbers a feature
        points = [np.frombuffer(bytes(f["v"])) for f in sorted(found, key=lambda f: f["ix"])]
        shared, width = spark.sparkContext.broadcast(points), len(points)
        per_node = max(1, int(np.ceil(np.sqrt(width))))

        def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = np.searchsorted(np.array(labels, dtype=object), np.array(b.column(1).to_pylist(), dtype=object)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([codes_of(matrix(b.column(2), b.num_rows), shared.value).tobytes()]), pa.array([y.tobytes()])], names=["at", "codes", "y"])

        n_parts = max(1, min(trees, 2 * spark.sparkContext.defaultParallelism))

        def grown(g: pa.Table) -> pa.Table:
            g, part = g.sort_by("at"), g.column("part")[0].as_py()
            all_codes = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8) for v in g.column("codes")]).reshape(-1, width)
            y = np.concatenate([np.frombuffer(v.as_buffer(), np.int32) for v in g.column("y")])
            got = [grow(all_codes, y, len(labels), shared.value, np.random.RandomState([seed, t]), per_node, depth) for t in range(part, trees, n_parts)]
            share = sum((gain / gain.sum() for _, gain in got if gain.sum() > 0), np.zeros(width))
            return pa.table({"part": pa.array([part], pa.int64()), "m": pa.array([pickle.dumps([t for t, _ in got])]), "gain": pa.array([share.tobytes()])})

        packed = cut(rows.select("_id", "grp", "x").mapInArrow(codes, "at long, codes binary, y binary"))
        each = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
        parts = cut(each.repartition(4 * n_parts, "part").groupBy("part").applyInArrow(grown, "part long, m binary, gain binary"))
        gains = sum(np.frombuffer(bytes(r["gain"])) for r in parts.orderBy("part").select("gain").collect())
        return Forest(parts.select("part", "m"), n_parts, labels, gains / gains.sum() if width and gains.sum() > 0 else gains)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """The class of the largest sum of the trees' leaf shares; of equal sums the first."""
        labels = self.labels

        def score(x: np.ndarray, m: bytes) -> np.ndarray:
            return sum(t.votes(x) for t in pickle.loads(m))

        def choose(votes: np.ndarray) -> list[str]:
            return [labels[i] for i in np.round(votes, 9).argmax(1)]

        return predict_by_parts(vectors, self.parts, self.n_parts, score, choose)


@dataclass
class Classifier:
    """kind: random_forest, logistic, svm (exact, radial kernel) or svm_features (random Fourier features, one against the rest)."""

    kind: str = "random_forest"
    seed: int = 42
    trees: int = 500
    n_random: int = 256
    model: PipelineModel | None = None
    labels: list[str] | None = None
    names: list[str] | None = None
    machine: KernelMachine | None = None
    forest: Forest | None = None
    _map: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _prepared(self, vectors: DataFrame) -> DataFrame:
        if self._map is not None:
            mean, axes, phase = self._map
            vectors = project(vectors, mean, axes, "z", phase).withColumn("x", F.transform("z", lambda v: F.cos(v) * float(np.sqrt(2.0 / axes.shape[1])))).drop("z")
        return vectors.withColumn("features", array_to_vector("x"))

    def fit(self, vectors: DataFrame, names: list[str]) -> Classifier:
        """``vectors``: grp and x."""
        if self.kind == "svm":
            self.machine, self.names = KernelMachine.fit(vectors), names
            self.labels = self.machine.labels
            return self
        if self.kind == "random_forest":
            self.forest, self.names = Forest.fit(vectors, self.trees, self.seed), names
            self.labels = self.forest.labels
            return self
        if self.kind == "logistic":
            est = LogisticRegression(family="multinomial", maxIter=100, labelCol="label")
        elif self.kind == "svm_features":
            v = array_to_vector("x")
            row = vectors.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(v).alias("mean"), Summarizer.normL2(v).alias("norm")).first()
            n, mean = row["n"], row["mean"].toArray()
            var = (row["norm"].toArray() ** 2).sum() / (n * len(names)) - mean.mean() ** 2
            gamma = 1.0 / (len(names) * max(var, 1e-12))
            r = np.random.default_rng(self.seed)
            self._map = (mean, r.standard_normal((len(names), self.n_random)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, self.n_random))
            est = OneVsRest(classifier=LinearSVC(maxIter=50, regParam=1.0 / max(n, 1)), labelCol="label")
        else:
            raise ValueError(f"unknown classifier: {self.kind}")
        self.names = names
        index = StringIndexer(inputCol="grp", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
        ready = self._prepared(vectors).select("grp", "features").persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads it
        try:
            self.model = Pipeline(stages=[index, est]).fit(ready)
        finally:
            ready.unpersist()
        self.labels = self.model.stages[0].labels
        return self

    def predict(self, vectors: DataFrame) -> DataFrame:
        """The rows with ``pred``; unknown labels are kept out of the index only."""
        if self.machine is not None or self.forest is not None:
            return (self.machine or self.forest).predict(vectors)
        ready = self._prepared(vectors)
        est = self.model.stages[1]
        return est.transform(ready).withColumn("pred", F.element_at(F.array(*map(F.lit, self.labels)), F.col("prediction").cast("int") + 1)).select(*[c for c in vectors.columns if c != "x"], "pred")

    def importances(self, top_n: int = 20) -> DataFrame:
        """(Feature, Importance) of a forest, largest first."""
        if self.kind != "random_forest":
            raise ValueError("only tree models have feature importances")
        from pyspark.sql import SparkSession

        rows = [(n, float(v)) for n, v in zip(self.names, self.forest.importances, strict=True)]
        return SparkSession.active().createDataFrame(rows, "Feature string, Importance double").orderBy(F.desc("Importance"), "Feature").limit(top_n)


@dataclass
class WeightedConcatenation:
    """A classifier on blocks that are multiplied by their weights (1 where none is given) and joined in the order of the fit."""

    weights: dict[str, float]
    kind: str = "random_forest"
    trees: int = 500
    order: list[str] | None = None
    classifier: Classifier | None = None

    def _joined(self, blocks: DataFrame) -> DataFrame:
        parts = [F.transform(F.col(n), lambda v, w=float(self.weights.get(n, 1.0)): v * w) for n in self.order]
        return blocks.select(*[c for c in blocks.columns if c not in self.order], F.concat(*parts).alias("x"))

    def fit(self, blocks: DataFrame, features: dict[str, list[str]]) -> WeightedConcatenation:
        """``blocks``: grp and one array column per block of ``features``."""
        self.order = list(features)
        names = [f"{b}_{f}" for b, fs in features.items() for f in fs]
        self.classifier = Classifier(self.kind, trees=self.trees).fit(self._joined(blocks), names)
        return self

    def predict(self, blocks: DataFrame) -> DataFrame:
        return self.classifier.predict(self._joined(blocks))
