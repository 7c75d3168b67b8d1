"""Ranks, medians and folds without a window over all rows of a table or of a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockwise.operators.layer import cut, q

#: Values of one group that an aggregate may hold at once (some 100 MB).
STATE_ROWS = 2_000_000
BUCKETS = 4096
#: Rows of a table of groups that goes to every task.
BROADCAST_ROWS = 200_000
#: Cells that shuffled keys are dealt over: ranks within a label are taken inside one of them.
SPREAD = 10007


def row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in this order: sorted ranges are numbered apart and get the counts before them added.

    The sorted rows are written once, so numbers do not change when a task is run anew.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = df.repartitionByRange(*[q(c) for c in order]).sortWithinPartitions(*[q(c) for c in order])
    rows = cut(parts.select("*", F.spark_partition_id().alias("_part"), within.alias("_within")))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def stratified_folds(df: DataFrame, key: Column, grp: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1 within each label, in an order shuffled by modular arithmetic on a numeric key.

    The rank in a label is the count of its rows in the cells before and the rank in the own cell.
    """
    rows = df.withColumn("_cell", F.pmod(key * 7919 + seed, F.lit(SPREAD)))
    sizes = rows.groupBy(q(grp).alias("_g"), "_cell").agg(F.count(F.lit(1)).alias("_n"))  # at most SPREAD rows per label
    before = sizes.select("_g", F.col("_cell").alias("_c"), (F.sum("_n").over(W.partitionBy("_g").orderBy("_cell")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy(q(grp), "_cell").orderBy(key)) - 1
    placed = rows.withColumn("_rank", rank).join(before, (q(grp) == F.col("_g")) & (F.col("_cell") == F.col("_c")))
    return placed.withColumn("fold", ((F.col("_before") + F.col("_rank")) % k).cast("int")).drop("_cell", "_g", "_c", "_before", "_rank")


def group_medians(cells: DataFrame, keys: Sequence[str], value: str = "value", state_rows: int = STATE_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(keys, median) of the values of each group, exact at any size; a group without values has a null median.

    Small groups are aggregates. Beyond ``state_rows`` values in a group, the two middle ranks are found by counts: a pass
    counts values in ``buckets`` ranges per rank, and only the range that holds the rank goes on, until it has one value or
    fits an aggregate. Keys must not be null.
    """
    keys = list(keys)
    n = cells.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    largest = n.agg(F.max("_n")).first()[0] or 0
    if largest <= state_rows:
        return cells.groupBy(*keys).agg(F.median(value).alias("median"))
    groups = cut(n)
    live = cells.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    mid = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    todo = groups.where("_n > 0").select(*keys, F.explode(mid).alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"))
    found: DataFrame | None = None
    id_ = [*keys, "_rank"]
    while True:
        ranks = F.broadcast(todo) if todo.count() <= BROADCAST_ROWS else todo
        some = live.join(ranks, keys).where("_v between _lo and _hi")
        at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
        got = some.withColumn("_b", at).groupBy(*id_, "_before", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
        got = got.withColumn("_at", F.col("_before") + F.sum("_c").over(W.partitionBy(*id_).orderBy("_b")) - F.col("_c"))  # at most ``buckets`` rows per rank
        got = cut(got.where("_at <= _rank and _rank < _at + _c").select(*id_, "_at", "_c", "_mn", "_mx"))
        edge = F.when(F.col("_rank") == F.col("_at"), F.col("_mn")).when((F.col("_rank") == F.col("_at") + F.col("_c") - 1) | (F.col("_mn") == F.col("_mx")), F.col("_mx"))
        done = got.withColumn("_x", edge).where("_x is not null").select(*id_, "_x")
        open_ = got.withColumn("_x", edge).where("_x is null")
        small = open_.where(F.col("_c") <= state_rows)
        inside = live.join(small.select(*id_, "_at", "_mn", "_mx"), keys).where("_v between _mn and _mx")
        # Of few values the sorted list gives the rank.
        done = done.unionByName(inside.groupBy(*id_).agg(F.array_sort(F.collect_list("_v")).alias("_l"), F.first("_at").alias("_at")).select(*id_, F.get("_l", (F.col("_rank") - F.col("_at")).cast("int")).alias("_x")))
        found = done if found is None else found.unionByName(done)
        todo = cut(open_.where(F.col("_c") > state_rows).select(*keys, "_rank", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), F.col("_at").alias("_before")))
        if todo.isEmpty():
            break
    middle = found.groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias("median"))
    return groups.select(*keys).join(middle, keys, "left")
