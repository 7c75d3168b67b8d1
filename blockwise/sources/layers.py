"""Scans and sinks: CSV layers, Parquet tables, result tables and the text report."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.operators.layer import WIDE, Layer, VectorLayer, q


def read_csv_layer(spark: SparkSession, path: str, group_col: str = "Groups", sample_col: str | None = None, name: str = "layer", schema: T.StructType | None = None) -> Layer | VectorLayer:
    """CSV with a header, quoted names, ``NA`` or empty for missing and an optional byte-order mark.

    An unnamed first header becomes ``sample``. String columns besides the label are ids, not
    features; numeric ones become doubles (from ``WIDE`` features on, one array). Rows keep their file order in ``row_ix``: the
    byte at which the row's split of the file starts, plus its number in the split. Types are inferred by a pass of their own unless a ``schema`` is given.
    """
    read = spark.read.schema(schema).csv(path, header=True, nullValue="NA") if schema is not None else spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")
    names = [c.lstrip("﻿") for c in read.columns]
    names = ["sample" if c in ("_c0", "") else c for c in names]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df = read.select(*[q(c).alias(n) for c, n in zip(read.columns, names, strict=True)], (F.col("_metadata.file_block_start") + within).alias("row_ix"))
    cells = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (group_col, sample_col, "row_ix")]
    if len(cells) >= WIDE:
        return VectorLayer.from_wide(df, group_col, cells, name)
    return Layer.from_wide(df, group_col, sample_col=sample_col, row_col="row_ix", name=name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_results(results: dict[str, object], out_dir: str) -> list[str]:
    """Every DataFrame of ``results`` as one CSV folder with a header (one file each; result tables are small)."""
    written = []
    for key, value in results.items():
        if isinstance(value, DataFrame):
            flat = value.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in value.dtypes])
            flat.coalesce(1).write.mode("overwrite").csv(os.path.join(out_dir, key), header=True)
            written.append(key)
    return written


def report_lines(report: DataFrame) -> list[str]:
    """Text lines of a report table (section, key, value)."""
    lines, last = [], None
    for r in report.orderBy("ord").collect():
        if r["section"] != last:
            lines += ["", str(r["section"]).upper()]
            last = r["section"]
        lines.append(f"  {r['key']}: {r['value']}")
    return lines[1:]
