"""The layer: one labelled table of numeric features, in wide, long or vector form."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Layer:
    """A lazy wide table: label ``group``, ``keys`` that travel with each row, and double ``features``.

    Missing values are NULL everywhere in the table stage.
    """

    df: DataFrame
    group: str
    features: tuple[str, ...]
    keys: tuple[str, ...] = ()
    name: str = "layer"

    @staticmethod
    def from_wide(df: DataFrame, group: str, sample_col: str | None = None, row_col: str | None = None, features: Sequence[str] | None = None, name: str = "layer", strict: bool = False) -> Layer:
        """Numeric columns become features (cast to double, NaN to NULL), strings stay as keys; the label is cast to string.

        Rows with a null label are dropped, or with ``strict`` rejected when they are read.
        """
        numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
        kept = {group, sample_col, row_col}
        chosen = list(features) if features is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in kept]
        keys = [f.name for f in df.schema.fields if f.name != group and f.name not in chosen]
        label = q(group).cast("string")
        if strict:
            label = F.when(q(group).isNull(), F.raise_error(F.lit("a row has no label"))).otherwise(label)
        cells = [F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")).alias(c) for c in chosen]
        out = df.select(*[q(k) for k in keys], label.alias(group), *cells)
        return Layer(out if strict else out.where(q(group).isNotNull()), group, tuple(chosen), tuple(keys), name)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> Layer:
        return replace(self, df=df, features=tuple(features) if features is not None else self.features)

    def map_features(self, fn) -> Layer:
        """Every feature replaced by ``fn(column, name)``; one projection, no shuffle."""
        return self.with_df(self.df.select(*[q(k) for k in self.keys], q(self.group), *[fn(q(c), c).alias(c) for c in self.features]))

    def pruned(self, features: Sequence[str]) -> Layer:
        return self.with_df(self.df.select(*[q(k) for k in self.keys], q(self.group), *[q(c) for c in features]), features)

    def long(self, key: str | None = None) -> DataFrame:
        """(layer, sample_id, grp, feature, feature_ix, value): one row per cell, missing ones as NULL."""
        key = key or self.keys[0]
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_ix"), q(c).alias("value")) for i, c in enumerate(self.features)])
        return self.df.select(F.lit(self.name).alias("layer"), q(key).cast("string").alias("sample_id"), q(self.group).alias("grp"), F.explode(cells).alias("c")).select(
            "layer", "sample_id", "grp", "c.feature", "c.feature_ix", "c.value"
        )

    def vectors(self, *keep: str) -> DataFrame:
        """(keys, grp, x): features as one array of doubles, in feature order."""
        return self.df.select(*[q(k) for k in (keep or self.keys)], q(self.group).alias("grp"), F.array(*[q(c) for c in self.features]).alias("x"))


def layer_from_vectors(df: DataFrame, vector: str, width: int, group: str, key: str, name: str = "layer", prefix: str = "f") -> Layer:
    """A layer over an array column, element by element (``f0``, ``f1`` ...)."""
    cells = [q(vector)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)]
    return Layer(df.select(q(key), q(group).cast("string").alias(group), *cells), group, tuple(f"{prefix}{i}" for i in range(width)), (key,), name)


#: From this many features on, scans give a ``VectorLayer``: plans of thousands of columns take minutes to build.
WIDE = 1000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else (in local mode only) a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockwise-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the shared folder, which outlives lost executors.

    ``checkpoint()`` would compute the rows twice. Columns are written under plain names, for theirs may hold any character.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    plain.write.parquet(at)
    return spark.read.schema(plain.schema).parquet(at).toDF(*names)


@dataclass(frozen=True)
class VectorLayer:
    """A layer whose features are one array column: ``df`` has the keys, ``grp`` and ``x``. Missing values are NULL."""

    df: DataFrame
    group: str
    features: tuple[str, ...]
    keys: tuple[str, ...] = ()
    name: str = "layer"

    @staticmethod
    def from_wide(df: DataFrame, group: str, features: Sequence[str], name: str = "layer") -> VectorLayer:
        """As ``Layer.from_wide``, by an Arrow function, since Catalyst's rules walk an expression of thousands of columns many times.

        Rows with a null label are dropped.
        """
        chosen = set(features)
        keys = [f for f in df.schema.fields if f.name != group and f.name not in chosen]
        names = [f.name for f in keys]
        at = {c: i for i, c in enumerate(df.columns)}
        plain = df.toDF(*[f"c{i}" for i in range(len(at))])  # Arrow functions take no names with dots or quotes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(b.column(at[group]).is_valid())
                x = np.full((b.num_rows, len(features)), np.nan)
                for i, c in enumerate(features):
                    x[:, i] = b.column(at[c]).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(features)
                cells = pa.array(x.ravel(), from_pandas=True)  # NaN becomes NULL
                yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in names), b.column(at[group]).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), cells)], names=[*names, "grp", "x"])

        schema = T.StructType([*keys, T.StructField("grp", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
        out = cut(plain.mapInArrow(run, schema))  # else every later plan is analysed with the columns of the scan
        return VectorLayer(out, group, tuple(features), tuple(names), name)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> VectorLayer:
        return replace(self, df=df, features=tuple(features) if features is not None else self.features)

    def long(self, key: str | None = None) -> DataFrame:
        """(layer, sample_id, grp, feature, feature_ix, value): one row per cell, as from a wide layer."""
        cells = self.df.select(F.lit(self.name).alias("layer"), q(key or self.keys[0]).cast("string").alias("sample_id"), "grp", F.posexplode("x").alias("feature_ix", "value"))
        # One string, split once when the plan is made: thousands of literals would take seconds to build.
        names = F.get(F.split(F.lit("\u0000".join(self.features)), "\u0000"), F.col("feature_ix"))
        return cells.select("layer", "sample_id", "grp", names.alias("feature"), "feature_ix", "value")

    def vectors(self, *keep: str) -> DataFrame:
        return self.df.select(*[q(k) for k in (keep or self.keys)], "grp", "x")
