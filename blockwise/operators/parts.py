"""Prediction by models that are tables: every block of rows meets every part of the model, and the parts' scores are added up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.operators.layer import cut, q

#: Rows of a block, as a power of two, where a part gives few scores a row and where it gives many.
BLOCK_BITS, SMALL_BLOCK_BITS = 16, 12


def numbered_rows(vectors: DataFrame) -> DataFrame:
    """The rows with ``_id``, written once, so that numbers do not change; blocks of them have equal higher bits."""
    return cut(vectors.coalesce(vectors.sparkSession.sparkContext.defaultParallelism).withColumn("_id", F.monotonically_increasing_id()))


def matrix(x: pa.ChunkedArray | pa.ListArray, n: int) -> np.ndarray:
    """An array column as rows of doubles; missing cells as NaN."""
    return np.asarray((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(n, -1)


def predict_by_parts(vectors: DataFrame, model: DataFrame, n_parts: int, score: Callable[[np.ndarray, bytes], np.ndarray], choose: Callable[[np.ndarray], list[str]], bits: int = BLOCK_BITS) -> DataFrame:
    """``vectors`` without x, with ``pred``. ``model``: part (from 0), m. ``score`` gives a matrix of a row per row; ``choose`` the classes from the parts' sum."""
    rows = numbered_rows(vectors)
    spark = rows.sparkSession
    kept = [c for c in vectors.columns if c != "x"]
    block = F.shiftright("_id", bits).alias("block")
    blocks = cut(rows.select(block).distinct())
    tasks = 4 * spark.sparkContext.defaultParallelism
    left = rows.select("_id", "x", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("part")).repartition(tasks, "block", "part")
    right = model.select(F.col("part").cast("long").alias("part"), "m").join(F.broadcast(blocks)).repartition(tasks, "block", "part")  # a number per block

    def meet(r: pa.Table, m: pa.Table) -> pa.Table:
        if not r.num_rows or not m.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
        r = r.sort_by("_id")
        got = score(matrix(r.column("x"), r.num_rows), m.column("m")[0].as_buffer())
        return pa.table({"block": r.column("block")[:1], "ids": pa.array([r.column("_id").to_numpy().tobytes()]), "v": pa.array([np.asarray(got, dtype="<f8").tobytes()])})

    def add(g: pa.Table) -> pa.Table:
        ids = np.frombuffer(g.column("ids")[0].as_buffer(), dtype=np.int64)
        total = sum(np.frombuffer(v.as_buffer(), "<f8") for v in g.column("v")).reshape(len(ids), -1)
        return pa.table({"_id": pa.array(ids), "pred": pa.array(choose(total), pa.string())})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "block long, ids binary, v binary")
    pred = met.groupBy("block").applyInArrow(add, "_id long, pred string")
    return rows.select("_id", *map(q, kept)).join(pred, "_id").select(*map(q, kept), "pred")
