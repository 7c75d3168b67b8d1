"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; paths are joined as strings, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests only) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockwise-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables saved inside are deleted at the end, but for those taken off the list."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.pop()
        for at in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores until no column has it (column names are compared without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def tree_merge(rows: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str, fan: int = 64) -> DataFrame:
    """(part, task, bits) -> one row per part: arrays merged ``fan`` tasks at a time, so no group grows with the number of tasks.

    ``rows`` is read more than once, so it should be a saved table.
    """

    def merge(g: pa.Table) -> pa.Table:
        out = None
        for x in g.column("bits"):
            one = np.frombuffer(x.as_buffer(), dtype)
            out = one.copy() if out is None else combine(out, one)
        return pa.table({"part": g.column("part").slice(0, 1), "task": g.column("level").slice(0, 1), "bits": pa.array([out.tobytes()])})

    tasks = rows.agg(F.max("task")).first()[0]
    while tasks is not None:
        tasks //= fan
        dealt = rows.select("part", F.expr(f"cast(task div {fan} as int)").alias("level"), "bits")
        rows = dealt.groupBy("part", "level").applyInArrow(merge, "part int, task int, bits binary")
        if not tasks:
            break
        rows = saved(rows, "merge")
    return rows
