"""Sharding (operator 10): a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells. Every shard owns ``vnodes`` points on it, and
a row starts at the cell of its text's hash, so equal texts start together.
Each shard takes exactly its share of rows (counts differ by one at most,
law ``rows``). Rows are taken in ring order; rows that meet a full shard continue
clockwise to the next different shard, so after at most as many rounds as shards
all rows are placed, and only overflow moves.

Placement works on counts per cell (``CELLS`` rows at any corpus size): a cell that
straddles a limit is split by rank, however many copies it holds. A cell of many rows is numbered in
parallel, in *lanes* of about ``LANE`` rows: lanes go by the hash of the id, and an id that fills a lane by itself
(null, or repeated with one text) by the task that read the row. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwise.llm.frames import saved, scratch, table

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Rows that are numbered in one task.
LANE = 4_000


def ring_preferences(shards: int, vnodes: int) -> list[tuple[int, int, list[int]]]:
    """(first cell, last cell, shards clockwise) of each arc; depends on the two numbers only."""
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"shard {s} point {v}".encode()).digest()[:8], "big") >> (64 - CELL_BITS)
            while at in points:
                at = (at + 1) % CELLS
            points[at] = s
    order = sorted(points)
    arcs = []
    for i, at in enumerate(order):
        seen = list(dict.fromkeys(points[order[(i + k) % len(order)]] for k in range(len(order))))
        arcs.append((order[i - 1] + 1 if i else 0, at, seen))
    if order[-1] < CELLS - 1:
        arcs.append((order[-1] + 1, CELLS - 1, arcs[0][2]))
    return [a for a in arcs if a[0] <= a[1]]


def ring_cell(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).cast("int")


def in_lanes(rows: DataFrame, lane: int) -> DataFrame:
    """``rows`` (cell, h, task, ...) with their lane: by, nth, part. No lane grows with a cell or with the rows of one id; ``rows`` is a saved table."""
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / lane).alias("lanes"))
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("nth", F.pmod("h", "lanes")).drop("lanes")  # at most CELLS rows
    full = dealt.groupBy("cell", "nth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * lane).drop("n")
    hot = saved(dealt.join(full, ["cell", "nth"], "left_semi").groupBy("cell", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > lane).select("cell", "h", F.lit(1).alias("by")), "hot")
    if hot.isEmpty():
        return dealt.select("*", F.lit(0).alias("by"), F.lit(0).alias("part"))
    dealt = dealt.join(hot, ["cell", "h"], "left").withColumn("by", F.coalesce("by", F.lit(0)))
    alone = F.col("by") == 1
    return dealt.withColumn("nth", F.when(alone, F.col("h")).otherwise(F.col("nth"))).withColumn("part", F.when(alone, F.col("task")).otherwise(0))


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text", lane: int = LANE) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    A null text counts as empty. Rows that are equal in all columns are interchangeable;
    null ids are placed like others; an empty table gives an empty result; other columns are not read. Working tables are
    deleted, the result stays.
    """
    with scratch(docs.sparkSession) as made:
        out = saved(_placed(docs, shards, vnodes, id_col, text_col, lane), "shards")
        made.pop()
    return out


def _placed(docs: DataFrame, shards: int, vnodes: int, id_col: str, text_col: str, lane: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = saved(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            ring_cell(text).alias("cell"),
            F.xxhash64(docs[id_col]).alias("h"),
            F.spark_partition_id().alias("task"),
        ),
        "ring",
    )
    rows = in_lanes(rows, lane)
    where = ["cell", "by", "nth", "part"]
    lanes = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("cell").orderBy("by", "nth", "part")) - F.col("n")
    lanes = saved(lanes.withColumn("before", before), "lanes")
    arcs = spark.createDataFrame(ring_preferences(shards, vnodes), "first int, last int, pref array<int>")
    pref = arcs.select(F.explode(F.sequence("first", "last")).alias("cell"), "pref")
    cells = lanes.groupBy("cell").agg(F.sum("n").alias("n"))
    waiting = cells.join(F.broadcast(pref), "cell").select("cell", F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"), "pref")
    total = lanes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = (
        spark.range(shards).select(F.col("id").cast("int").alias("shard")).crossJoin(total)  # one row per shard
        .select("shard", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)").alias("room"), F.lit(0).cast("bigint").alias("used"))
    )
    taken: list[DataFrame] = []
    for turn in range(shards):
        asked = waiting.withColumn("shard", F.col("pref")[turn]).join(F.broadcast(room), "shard")
        ahead = F.sum(F.col("hi") - F.col("lo")).over(W.partitionBy("shard").orderBy("cell")) - (F.col("hi") - F.col("lo"))
        met = saved(
            asked.withColumn("ahead", ahead).withColumn("got", F.greatest(F.lit(0), F.least(F.col("hi") - F.col("lo"), F.col("room") - F.col("ahead")))).drop("room"), "turn"
        )
        taken.append(met.where("got > 0").select("cell", "lo", (F.col("lo") + F.col("got")).alias("hi"), "shard", (F.col("used") + F.col("ahead")).alias("slot")))
        waiting = met.where("lo + got < hi").select("cell", (F.col("lo") + F.col("got")).alias("lo"), "hi", "pref")
        if waiting.isEmpty():
            break
        spent = met.groupBy("shard").agg(F.sum("got").alias("got"))
        room = room.join(F.broadcast(spent), "shard", "left").select(
            "shard", (F.col("room") - F.coalesce("got", F.lit(0))).alias("room"), (F.col("used") + F.coalesce("got", F.lit(0))).alias("used")
        )
    runs = taken[0]
    for t in taken[1:]:
        runs = runs.unionByName(t)
    rank = F.row_number().over(W.partitionBy(*where).orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(lanes.select(*where, "before"), where).withColumn("rank", F.col("rank") + F.col("before"))
    runs = runs.withColumnsRenamed({"cell": "run_cell", "slot": "run_slot"})  # at most CELLS rows and shards**2 splits
    placed = ranked.join(F.broadcast(runs), (F.col("cell") == F.col("run_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("run_slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
