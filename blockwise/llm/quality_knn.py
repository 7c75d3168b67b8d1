"""Quality classifier (operator 6): nearest-neighbour voting on latent-semantic vectors.

Terms of a text are hashed into ``DIM`` buckets of three kinds: lower-cased words,
word shapes (classes of the first and the last three characters) and binned text
statistics. Inverse document frequencies come from *all* documents. At most
``sample`` labelled rows outside the held-out fold (those of smallest
hash; the bound is a parameter) are projected by a truncated SVD of their own
TF-IDF matrix and sent to every task: ``sample * rank`` floats plus a ``DIM * rank``
basis, whatever the corpus size. Every document is projected and compared with
all labelled vectors by exact blocked products; its ``k`` nearest vote with
weights that grow with cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.llm.frames import table
from blockwise.llm.quality_rules import block_stats
from blockwise.llm.textblocks import Block, blocks, mix64, word_hashes, words

DIM = 4096
#: Buckets of words, then of shapes, then of statistics.
WORD_DIM, SHAPE_DIM = 3072, 960
KIND_WEIGHT = np.array([0.6, 1.0, 1.0], dtype=np.float32)
STAT_BINS = 8

_CLASS = np.full(256, 5, dtype=np.uint64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x80:] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x2E, 0x2C]] = 3
_CLASS[[0x21, 0x3F]] = 4
for _i, _c in enumerate(b"#*$%&|<>="):
    _CLASS[_c] = 6 + _i


def block_terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row start, bucket, term frequency): the sorted sparse rows of a block's documents."""
    s = block_stats(block)
    w = words(block)
    doc = np.repeat(np.arange(block.n_docs, dtype=np.int64), np.diff(w.first))
    h = (word_hashes(block, w) >> np.uint64(11)) % np.uint64(WORD_DIM)
    c = _CLASS[block.buf]
    last = [c[np.maximum(w.end - i, w.start)] for i in (1, 2, 3)]
    shape = mix64(c[w.start] | last[0] << np.uint64(8) | last[1] << np.uint64(16) | last[2] << np.uint64(24)) % np.uint64(SHAPE_DIM)
    one = np.maximum(s["n_words"], 1)
    stats = np.stack([
        s["n_symbols"] / one, s["n_bangs"] / one, s["n_upper"] / np.maximum(s["n_letters"], 1), s["n_dup_lines"] / s["n_lines"],
        s["n_repeat_words"] / one, s["n_stray"] / one, s["n_mixed"] / one, 1 - s["n_letters"] / np.maximum(s["word_chars"], 1),
    ])
    bins = np.clip(np.floor(np.sqrt(np.clip(stats, 0, 1)) * STAT_BINS), 0, STAT_BINS - 1).astype(np.int64)
    stat = WORD_DIM + SHAPE_DIM + np.arange(len(bins))[:, None] * STAT_BINS + bins
    some = s["n_words"] > 0
    docs = np.arange(block.n_docs, dtype=np.int64)[some]
    key = np.concatenate([doc * DIM + h.astype(np.int64), doc * DIM + WORD_DIM + shape.astype(np.int64), *(docs * DIM + x[some] for x in stat)])
    key, tf = np.unique(key, return_counts=True)
    return np.searchsorted(key, np.arange(block.n_docs + 1, dtype=np.int64) * DIM), key % DIM, tf


def dense_rows(start: np.ndarray, bucket: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows; each kind of term is scaled to its weight, then rows to length one (or zero)."""
    n = len(start) - 1
    x = np.zeros((n, DIM), dtype=np.float32)
    x[np.repeat(np.arange(n), np.diff(start)), bucket] = (1 + np.log(tf)) * idf[bucket]
    for (lo, hi), weight in zip(((0, WORD_DIM), (WORD_DIM, WORD_DIM + SHAPE_DIM), (WORD_DIM + SHAPE_DIM, DIM)), KIND_WEIGHT, strict=True):
        x[:, lo:hi] *= weight / np.maximum(np.linalg.norm(x[:, lo:hi], axis=1, keepdims=True), 1e-9)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def svd_basis(x: np.ndarray, rank: int, turns: int = 4) -> np.ndarray:
    """Leading right singular vectors (DIM x rank) by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(turns):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank])


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def vote(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, power: float, block: int = 256) -> np.ndarray:
    """Weighted vote of the k nearest labelled vectors and of all that tie with the k-th; rows of zeros get the mean label."""
    out = np.full(len(z), float(labels.mean()) if len(labels) else 0.5)
    if not len(labels):
        return out
    k = min(k, len(labels))
    for at in range(0, len(z), block):
        part = z[at : at + block]
        sims = part @ vectors.T
        least = np.partition(sims, len(labels) - k, axis=1)[:, len(labels) - k, None]
        row, near = np.nonzero(sims >= least)
        s = np.clip(sims[row, near], 0, 1).astype(np.float64) ** power
        total = np.bincount(row, s, len(part))
        got = np.divide(np.bincount(row, s * labels[near], len(part)), total, out=np.full(len(part), out[at]), where=total > 0)
        out[at : at + block] = np.where(np.abs(part).sum(1) > 0, got, out[at])
    return np.clip(out, 0, 1)


def _document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Bucket frequencies over all documents: one vector of DIM counts per task, summed by bucket range."""
    parts = 16

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for block in blocks(b.column(0)):
                _, bucket, _ = block_terms(block)
                df += np.bincount(bucket, minlength=DIM)
                n += block.n_docs
        wide = DIM // parts
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([df[i * wide : (i + 1) * wide].tolist() for i in range(parts)], pa.list_(pa.int64())), pa.array([n] * parts, pa.int64())],
            names=["part", "df", "n"],
        )

    got = docs.select(text_col).mapInArrow(count, "part int, df array<bigint>, n bigint").select("part", F.posexplode("df").alias("at", "df"), "n")
    rows = got.groupBy("part", "at").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()  # DIM rows
    df = np.zeros(DIM)
    for r in rows:
        df[r["part"] * (DIM // parts) + r["at"]] = r["df"]
    return df, max((r["n"] for r in rows), default=0)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Everything the tasks need; its size does not depend on the corpus."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, power: float):
        self.idf, self.basis, self.vectors, self.labels, self.k, self.power = idf, basis, vectors, labels, k, power

    def score(self, block: Block) -> np.ndarray:
        out = np.zeros(block.n_docs)
        start, bucket, tf = block_terms(block)
        for at in range(0, block.n_docs, 512):
            to = min(at + 512, block.n_docs)
            s, e = start[at], start[to]
            x = dense_rows(start[at : to + 1] - s, bucket[s:e], tf[s:e], self.idf)
            out[at:to] = vote(unit(x @ self.basis), self.vectors, self.labels, self.k, self.power)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, rank: int = 64, k: int = 15, power: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``labels``: id and ``quality``. Rows of the held-out fold and rows without a label are never read.

    An id with several labels has the largest; an id with several texts counts with one of them, chosen by content.
    """
    df, n = _document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    chosen = (
        labels.where(~is_held_out(F.col(id_col)) & F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(id_col), id_col).limit(sample)
    )

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(2)):
                start, bucket, tf = block_terms(block)
                rows = [(bucket[s:e].astype("<u2").tobytes(), tf[s:e].astype("<u4").tobytes()) for s, e in zip(start, start[1:], strict=False)]
                part = b.slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "quality", "bucket", "tf"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"), text_col)
    terms = found.mapInArrow(project, f"id {kind}, quality int, bucket binary, tf binary")
    # Of a repeated id one row counts (the least), so at most ``sample`` rows reach the driver.
    got = [r["r"] for r in terms.groupBy("id").agg(F.min(F.struct("bucket", "tf", "quality")).alias("r")).collect()]
    got.sort(key=lambda r: (bytes(r["bucket"]), bytes(r["tf"]), r["quality"]))
    if not got:
        return Model(idf, np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k, power)
    bucket = [np.frombuffer(r["bucket"], "<u2").astype(np.int64) for r in got]
    tf = [np.frombuffer(r["tf"], "<u4").astype(np.int64) for r in got]
    start = np.concatenate([[0], np.cumsum([len(x) for x in bucket])])
    x = dense_rows(start, np.concatenate(bucket), np.concatenate(tf), idf)
    basis = svd_basis(x, min(rank, len(got)))
    return Model(idf, basis, unit(x @ basis), np.array([float(r["quality"]) for r in got]), k, power)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted.

    Null and empty texts score the mean label of the labelled rows (0.5 without any);
    repeated rows get equal scores; a null id is never held out; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for block in blocks(b.column(2)):
                part = b.slice(block.first, block.n_docs)
                score = model.score(block)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
                )

    return docs.select(docs[id_col], is_held_out(docs[id_col]).alias("held_out"), docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
