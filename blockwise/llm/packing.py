"""Best-fit packing (operator 9): hierarchical residual packing.

1. Each task cuts its documents into pieces of at most ``size`` tokens (only
   longer documents are cut; the first piece takes the remainder) and packs
   them best-fit, longest first, in windows of ``window`` pieces.
2. Bins with at most ``slack`` free tokens are final. Underfull bins go on as
   items: they are dealt anew into groups of about ``group`` and packed
   best-fit again, with ever fewer groups, until all that is left fits one group or a round
   saves less than one bin in ``STOP``.
3. Pieces of merged bins get their new bin and offset by a join on the bin.

No group grows with the corpus: a round has ``ceil(bins / group)`` groups.
Bins that never fill simply stay as they are, so every piece is placed. Piece
tables and rounds are written to the shared folder, so lost executors recompute
one stage at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.llm.frames import saved, scratch, table
from blockwise.llm.tokens import byte_balanced, default_tokenizer, encoder


#: Rounds end when one saves fewer than one bin in so many.
STOP = 1000


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, longest first: (bin of each item, offset in it, fill of each bin)."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free tokens
    some = 0  # bit r: a bin with r free tokens exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            b, r = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        r -= n
        if r:
            free[r].append(b)
            some |= 1 << r
    return bins, offsets, np.asarray(fill, dtype=np.int64)


_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, fill bigint, `offset` bigint"


def _local(docs: DataFrame, tokenizer: str, size: int, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId() << 34
        ids: list = []
        rows: list[tuple[int, int, int, int]] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            bins, offsets, fill = best_fit(length, size)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(piece.astype(np.int32)), *(pa.array(x) for x in (start, length, crc, task + made + bins, fill[bins], offsets))],
                names=[id_col, "piece", "start", "length", "ids_crc32", "bin", "fill", "offset"],
            )
            made += len(fill)
            ids.clear()
            rows.clear()
            return out

        for b in batches:
            id_type = b.schema.types[0]
            names = b.column(0).to_pylist()
            for at, texts in byte_balanced(b.column(1)):
                for i, got in enumerate(enc.ids(texts)):
                    tokens = np.append(got, np.uint32(end_id)).astype("<u4")
                    n = len(tokens)
                    cut = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                        ids.append(names[at + i])
                        rows.append((k, lo, hi - lo, zlib.crc32(tokens[lo:hi].tobytes())))
                if len(rows) >= window:
                    yield flush()
        if rows:
            yield flush()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, {_PIECES}")


def _merge_round(items: DataFrame, groups: int, turn: int, size: int) -> DataFrame:
    """One round: each group of underfull bins is packed best-fit; a merged bin takes the id of its first item."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, fill = best_fit(g["fill"].to_numpy(), size)
        _, first = np.unique(bins, return_index=True)
        name = g["bin"].to_numpy()[first]
        return pd.DataFrame({"bin": g["bin"], "merged": name[bins], "base": offsets, "merged_fill": fill[bins]})

    dealt = items.withColumn("_g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(pack, "bin bigint, merged bigint, base bigint, merged_fill bigint")


def pack(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, slack: int = 8, window: int = 100_000, group: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has its end token only. Repeated rows and repeated or null ids
    are packed one by one (bins never refer to ids); an empty table gives an empty result; other columns are not
    read. Working tables are deleted, the result stays.
    """
    with scratch(docs.sparkSession) as made:
        out = saved(_packed(docs, tokenizer, size, end_id, slack, window, group, id_col, text_col), "packed")
        made.pop()
    return out


def _packed(docs: DataFrame, tokenizer: str, size: int, end_id: int, slack: int, window: int, group: int, id_col: str, text_col: str) -> DataFrame:
    pieces = saved(_local(docs, tokenizer, size, end_id, window, id_col, text_col), "pieces")
    # A bin's fill is on each of its pieces; the piece at offset 0 stands for it.
    items = pieces.where((F.col("offset") == 0) & (F.col("fill") < size - slack)).select("bin", "fill")
    moves: DataFrame | None = None
    n = items.count()
    turn = 0
    while n:
        groups = -(-n // group)
        done = saved(_merge_round(items, groups, turn, size), "merge")
        step = done.select(F.col("bin").alias("_from"), "merged", "base")
        if moves is None:
            moves = done.select("bin", F.col("merged").alias("sequence_id"), F.col("base"))
        else:
            moves = saved(
                moves.join(step, moves.sequence_id == step._from, "left").select(
                    "bin", F.coalesce("merged", "sequence_id").alias("sequence_id"), (moves.base + F.coalesce(step.base, F.lit(0))).alias("base")
                ),
                "moves",
            )
        items = done.where((F.col("base") == 0) & (F.col("merged") == F.col("bin")) & (F.col("merged_fill") < size - slack)).select("bin", F.col("merged_fill").alias("fill"))
        left = items.count()
        saves = done.where("merged <> bin").count()  # each such bin went into another
        turn += 1
        if groups == 1 or saves * STOP < n:
            break
        n = left
    out = [id_col, "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    full = pieces.where(F.col("fill") >= size - slack).select(*out, F.col("bin").alias("sequence_id"), "offset")
    moved = pieces.where(F.col("fill") < size - slack).join(moves, "bin").select(*out, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return full.unionByName(moved)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
