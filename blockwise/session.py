"""Session factory with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "blockwise", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; on a cluster ``master`` and sizes come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
