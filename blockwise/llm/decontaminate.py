"""Benchmark decontamination (operator 5): BM25 with block-max pruning, then overlap.

The test items are the indexed side, and every training document is a query with its distinct words.
Impacts are divided by the item's score against itself, so a score is the share of the item's BM25 weight that
the document holds. Document frequencies, the number of items and their mean length come from *all* items, so a
score does not depend on how the index is cut.

What leaks
    A pair leaks when the document holds, anywhere in its text, at least ``min_overlap`` of the item's 5-word shingles,
    or nearly all (``SPECIFIC_SHARE``) of its question or of its answer where that part is long enough to name the
    item (``SPECIFIC`` shingles). The answer is the item's last sentence, the question all before it.

Retrieval
    Each item has its own threshold: the least score that a leak can have. A leak covers some number of the item's
    word positions; the cheapest distinct words that fill as many positions (a fractional knapsack) bound its score from
    below. So what is retrieved is a superset of the leaks, and the overlap, counted exactly, decides.

Pruning is the test of block-max WAND, taken for all documents of a batch at once instead of by cursors: items
form blocks, each term has its largest impact per block, and a block is opened for a document only if these
bounds reach the least threshold in the block. Opened blocks are scored exactly.

The index reaches every task, so it is built from at most about ``index_bytes`` of items at a time; larger benchmarks
are handled block of items by block of items, each with its own pass over the documents, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from blockwise.llm.frames import saved, table
from blockwise.llm.textblocks import Block, Words, blocks, combine, word_hashes, words

K1, B_LEN = 1.2, 0.75
SHINGLE = 5
#: A question or an answer of so many shingles leaks by itself if the document holds nine tenths of them.
SPECIFIC, SPECIFIC_SHARE = 8, (9, 10)
#: Items are put into at most so many blocks for the upper bounds.
MAX_BLOCKS = 32
#: Postings expanded at once.
EXPANDED = 1 << 22
_SPACES = " \t\n\v\f\r"


def question_words(text: str, n_words: int) -> int:
    """Words before the answer, which is the last sentence."""
    whole = text.rstrip(_SPACES)
    body = whole.rstrip(".!?")
    answer = whole[max(body.rfind(c) for c in ".!?\n") + 1 :]
    for c in _SPACES[1:]:
        answer = answer.replace(c, " ")
    return max(n_words - sum(map(bool, answer.split(" "))), 0)


@dataclass
class Statistics:
    """Of all items: their number and mean length, and the document frequencies of the hashed words (sorted) that a block of items needs."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _ranges(start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, index) of every index in ``start[row] + range(count[row])``, at most about ``EXPANDED`` at a time."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EXPANDED, side="right")), lo + 1)
        n = count[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        yield row, np.arange(n.sum()) + np.repeat(start[lo:hi] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        lo = hi


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of values."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 3))
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    values = np.concatenate([p[1] for p in parts])
    return key, np.stack([np.bincount(inverse, v, len(key)) for v in values.T], axis=1)


class Index:
    """Normalised BM25 impacts of a set of items with block maxima, thresholds, and the items' shingles."""

    def __init__(self, items: list[tuple[int, str]], min_overlap: float = 0.5, statistics: Statistics | None = None):
        self.ids = [i for i, _ in items]
        self.min_overlap = min_overlap
        n = len(items)
        block = next(blocks(pa.array([t or "" for _, t in items], pa.string()), 1 << 62))
        w = words(block)
        h = word_hashes(block, w, latin=True)
        size = np.diff(w.first)
        self.k = np.minimum(SHINGLE, size)
        self.question = np.array([question_words(t or "", m) for (_, t), m in zip(items, size.tolist(), strict=True)], dtype=np.int64)
        self._impacts(h, size, statistics)
        self.grams = {int(k): self._shingles(h, w, np.flatnonzero(self.k == k), int(k)) for k in np.unique(self.k[self.k > 0])}
        self.shingles = np.stack([np.maximum(m - self.k + 1, 0) for m in (size, self.question, size - self.question)], axis=1)
        self.threshold = self._thresholds(h, w)
        self.n_blocks = min(MAX_BLOCKS, n)
        self.block_of = np.arange(n) * self.n_blocks // n
        self.least = np.full(self.n_blocks, np.inf)
        np.minimum.at(self.least, self.block_of, self.threshold)
        self.bounds = np.zeros((len(self.vocab), self.n_blocks), dtype=np.float32)
        np.maximum.at(self.bounds, (self.term, self.block_of[self.item]), (self.impact * (1 + 1e-5)).astype(np.float32))
        order = np.lexsort((self.item, self.term))
        self.posting = np.searchsorted(self.term[order], np.arange(len(self.vocab) + 1))
        self.post_item, self.post_impact = self.item[order], self.impact[order]
        self.seen = self._prefixes(self.vocab)

    @staticmethod
    def _prefixes(hashes: np.ndarray) -> np.ndarray:
        """Which 16-bit prefixes occur: a cheap test before the search."""
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
        return seen

    def _impacts(self, h: np.ndarray, size: np.ndarray, given: Statistics | None) -> None:
        self.vocab, term = np.unique(h, return_inverse=True)
        item = np.repeat(np.arange(len(size)), size)
        key, tf = np.unique(item.astype(np.int64) * len(self.vocab) + term, return_counts=True)
        self.item, self.term = key // len(self.vocab), key % len(self.vocab)
        self.tf = tf
        if given is None:
            given = Statistics(len(size), float(size.mean()), self.vocab, np.bincount(self.term, minlength=len(self.vocab)))
        df = given.df[np.searchsorted(given.terms, self.vocab)]
        idf = np.log1p((given.n - df + 0.5) / (df + 0.5))
        impact = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B_LEN + B_LEN * size[self.item] / given.mean))
        self.impact = impact / np.bincount(self.item, impact, len(size))[self.item]

    def _shingles(self, h: np.ndarray, w: Words, items: np.ndarray, k: int) -> tuple:
        """Postings of the shingles of items with ``k``: vocabulary, its prefixes, offsets, items, counts (in all, in the question, in the answer)."""
        n = np.diff(w.first)[items] - k + 1
        item = np.repeat(items, n)
        at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        first = w.first[item] + at
        gram = combine([h[first + i] for i in range(k)], k)
        vocab, gram = np.unique(gram, return_inverse=True)
        q = self.question[item]
        key, counts = _summed([(gram.astype(np.int64) * len(self.ids) + item, np.stack([np.ones(len(item)), at + k <= q, at >= q], axis=1))])
        gram, item = key // len(self.ids), key % len(self.ids)
        return vocab, self._prefixes(vocab), np.searchsorted(gram, np.arange(len(vocab) + 1)), item, counts

    def _thresholds(self, h: np.ndarray, w: Words) -> np.ndarray:
        """Per item the least score of a leak, by the whole item, its question or its answer."""
        n = len(self.ids)
        low = np.full(n, np.inf)
        of_term = np.searchsorted(self.vocab, h)
        by_item = np.searchsorted(self.item, np.arange(n + 1))
        for i in range(n):
            a, b = w.first[i], w.first[i + 1]
            lo, hi = by_item[i], by_item[i + 1]
            if a == b:
                continue
            q, k = int(self.question[i]), int(self.k[i])
            m = self.shingles[i].tolist()
            # So many different shingles cover at least that number and k - 1 more word positions.
            needs = [(a, b, max(int(np.ceil(m[0] * self.min_overlap - 1e-9)), 1) + k - 1)]
            for part, (x, y) in enumerate(((a, a + q), (a + q, b)), start=1):
                if m[part] >= SPECIFIC:
                    needs.append((x, y, -(-m[part] * SPECIFIC_SHARE[0] // SPECIFIC_SHARE[1]) + k - 1))
            weight = self.impact[lo:hi]
            for x, y, need in needs:
                tf = np.bincount(np.searchsorted(self.term[lo:hi], of_term[x:y]), minlength=hi - lo)
                some = tf > 0
                order = np.argsort(weight[some] / tf[some], kind="stable")
                filled = np.cumsum(tf[some][order])
                cost = np.cumsum(weight[some][order])
                j = int(np.searchsorted(filled, need))
                j = min(j, len(filled) - 1)
                over = max(filled[j] - need, 0)  # the last word counts by the part that is needed
                low[i] = min(low[i], cost[j] - weight[some][order][j] * over / tf[some][order][j])
        return low

    def retrieved(self, block: Block, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document * items + item, score) of every pair at or above the item's threshold."""
        n, nothing = len(self.ids), (np.zeros(0, np.int64), np.zeros(0))
        pos = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[pos]), len(self.vocab) - 1)
        hit = self.vocab[at] == h[pos]
        pos, term = pos[hit], at[hit]
        if not len(pos):
            return nothing
        doc = np.searchsorted(w.first, pos, side="right") - 1
        key = np.unique(doc * len(self.vocab) + term)
        doc, term = key // len(self.vocab), key % len(self.vocab)
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        opened = np.zeros((block.n_docs, self.n_blocks), dtype=bool)
        for lo in range(0, len(starts), 1024):
            part = starts[lo : lo + 1024]
            end = starts[lo + 1024] if lo + 1024 < len(starts) else len(term)
            opened[doc[part]] = np.add.reduceat(self.bounds[term[part[0] : end]], part - part[0], axis=0) >= self.least * (1 - 1e-5)  # the pivot test
        use = opened.any(1)[doc]
        doc, term = doc[use], term[use]
        parts = []
        for row, index in _ranges(self.posting[term], self.posting[term + 1] - self.posting[term]):
            item = self.post_item[index]
            keep = opened[doc[row], self.block_of[item]]
            key, inverse = np.unique(doc[row][keep] * n + item[keep], return_inverse=True)
            parts.append((key, np.bincount(inverse, self.post_impact[index][keep], len(key))[:, None]))
        if not parts:
            return nothing
        key, score = _summed(parts)
        keep = score[:, 0] >= self.threshold[key % n] - 1e-9
        return key[keep], score[keep, 0]

    def search(self, block: Block) -> Iterator[tuple[int, int, float, float, float, float, bool]]:
        """(document of the block, item, score, overlap, question overlap, answer overlap, leaks) of every retrieved pair."""
        n = len(self.ids)
        w = words(block)
        h = word_hashes(block, w, latin=True)
        if not len(h):
            return
        wanted, score = self.retrieved(block, w, h)
        if not len(wanted):
            return
        asked = np.zeros(block.n_docs, dtype=bool)
        asked[wanted // n] = True
        doc = np.repeat(np.arange(block.n_docs), np.diff(w.first))
        found = []
        for k, (vocab, seen, offsets, items, counts) in self.grams.items():
            if len(h) < k:
                continue
            first = np.flatnonzero((doc[k - 1 :] == doc[: len(doc) - k + 1]) & asked[doc[k - 1 :]])
            gram = combine([h[first + i] for i in range(k)], k)
            first, gram = (x[seen[(gram >> np.uint64(48)).astype(np.int64)]] for x in (first, gram))
            at = np.minimum(np.searchsorted(vocab, gram), len(vocab) - 1)
            hit = vocab[at] == gram
            key = np.unique(doc[first[hit]] * len(vocab) + at[hit])
            d, at = key // len(vocab), key % len(vocab)
            for row, index in _ranges(offsets[at], offsets[at + 1] - offsets[at]):
                key = d[row] * n + items[index]
                use = np.isin(key, wanted)
                if use.any():
                    found.append(_summed([(key[use], counts[index[use]])]))
        have = np.zeros((len(wanted), 3))
        key, total = _summed(found)
        have[np.searchsorted(wanted, key)] = total
        of = self.shingles[wanted % n]
        share = np.divide(have, of, out=np.zeros_like(have), where=of > 0)
        specific = (of[:, 1:] >= SPECIFIC) & (have[:, 1:] * SPECIFIC_SHARE[1] >= of[:, 1:] * SPECIFIC_SHARE[0])
        leaks = (have[:, 0] >= of[:, 0] * self.min_overlap - 1e-9) | specific.any(1)
        for j in range(len(wanted)):
            yield int(wanted[j] // n), int(wanted[j] % n), float(score[j]), *(float(x) for x in share[j]), bool(leaks[j])

    def leaked(self, block: Block) -> Iterator[tuple[int, int, float, float, float, float]]:
        """The retrieved pairs that leak, without the last column."""
        for *g, leaks in self.search(block):
            if leaks:
                yield tuple(g)


def _item_blocks(items: DataFrame, index_bytes: int, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """Items with words, repeated ones once, in blocks of about ``index_bytes``, and what their scores need to know of all items; one block is on the driver at a time."""
    kind = dict(items.dtypes)[id_col]
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // index_bytes)
    if n > 1:
        items = saved(items, "items")

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                w = words(block)
                h = word_hashes(block, w, latin=True).astype(np.int64)
                doc = np.repeat(np.arange(block.n_docs), np.diff(w.first))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
                # A null term carries the length of its item.
                size = np.diff(w.first)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(h[once]), pa.nulls(len(size), pa.int64())]), pa.concat_arrays([pa.nulls(int(once.sum()), pa.int64()), pa.array(size.astype(np.int64))])], names=["term", "size"])

    known = None
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        rows = sorted(((r[0], r[1]) for r in part.select("id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        if not rows:
            continue
        if n == 1:
            yield rows, None
            continue
        if known is None:
            known = saved(items.select(F.col("id").cast(kind), "text").mapInArrow(terms, "term bigint, size bigint").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("size")), "terms")
            count, length = known.where("term is null").select("df", "size").first()
        own = part.select("id", "text").mapInArrow(terms, "term bigint, size bigint").where("term is not null").select("term").distinct()
        got = known.join(own, "term").select("term", "df").collect()  # the words of one block of items
        hashes, df = np.array([r["term"] for r in got], dtype=np.int64).astype(np.uint64), np.array([r["df"] for r in got], dtype=np.int64)
        order = np.argsort(hashes)
        yield rows, Statistics(int(count), length / count, hashes[order], df[order])


def leaks(docs: DataFrame, items: DataFrame, min_overlap: float = 0.5, index_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per leaked pair: id, item_id, score, overlap, question_overlap, answer_overlap.

    The overlaps are shares of the shingles that lie wholly in the item, its question, its answer (0 where there are none).
    Null or empty texts and items match nothing; repeated rows of documents give repeated pairs, repeated items
    count once; null ids stay null; an empty benchmark or corpus gives an empty result. Whole texts are searched, however long; columns
    other than the id and the text are not read.
    """
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    slim = docs.select(docs[id_col], docs[text_col])
    item_type = to_arrow_type(items.schema[item_col].dataType)
    out: DataFrame | None = None
    for rows, statistics in _item_blocks(items, index_bytes, item_col, "text"):
        shared = spark.sparkContext.broadcast(Index(rows, min_overlap, statistics))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for block in blocks(b.column(1)):
                    got = list(index.leaked(block))
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([block.first + g[0] for g in got])), pa.array([index.ids[g[1]] for g in got], item_type), *(pa.array([g[j] for g in got], pa.float64()) for j in range(2, 6))],
                            names=[id_col, item_col, "score", "overlap", "question_overlap", "answer_overlap"],
                        )

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaked(docs: DataFrame, items: DataFrame, min_overlap: float = 0.5, index_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns; nothing is shuffled. Odd cases are as in ``leaks``: rows with null or empty texts stay."""
    at = docs.columns.index(text_col)
    for rows, statistics in _item_blocks(items, index_bytes, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows, min_overlap, statistics))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for block in blocks(b.column(at)):
                    keep[[block.first + g[0] for g in shared.value.leaked(block)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))
