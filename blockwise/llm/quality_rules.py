"""Quality rules (operator 8): weak supervision instead of all-must-pass filtering.

Every rule votes good, bad or abstains on each document. The votes of a
document form a *pattern*; patterns are counted over all documents (at most
3**rules of them, so the counts fit the driver at any corpus size) and
expectation-maximisation on the counts estimates the prior and every rule's
votes given the hidden quality. A document is kept when the posterior
probability of good quality is at least ``threshold``.

The statistics and votes are computed by vectorised kernels over whole texts,
one Arrow batch at a time. Null and empty texts have zero words and fail the
base rules. Repeated rows are judged one by one; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.llm.frames import saved, table
from blockwise.llm.textblocks import Block, blocks, combine, mix64, word_hashes, words, Words

# The symbols that the contract counts.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[0x41:0x5B] = True
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = True
_IS_LETTER[0xC0:] = True  # lead bytes: code points beyond ASCII count as letters
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

GOOD, BAD, ABSTAIN = 1, 2, 0
#: (statistic, good if at most, bad if at least); between the two the rule abstains.
RATIO_RULES = (
    ("symbols_per_word", 0.05, 0.20),
    ("stray_share", 0.02, 0.15),
    ("mixed_share", 0.02, 0.15),
    ("not_letter_share", 0.07, 0.12),
    ("bangs_per_word", 0.05, 0.25),
    ("upper_share", 0.15, 0.50),
    ("dup_line_share", 0.20, 0.40),
    ("repeat_share", 0.20, 0.40),
    ("short_by", 0.0, 0.50),
    ("word_length_off", 0.0, 0.50),
)
RULES = tuple(r[0] for r in RATIO_RULES)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _line_repeats(block: Block) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    n = block.n_bytes
    if not n:
        return np.zeros(block.n_docs, dtype=np.int64)
    buf = block.buf[:n]
    breaks = np.flatnonzero(buf == 0x0A)
    start = np.union1d(block.offsets[:-1], breaks + 1)
    start = start[start < n]
    end = np.append(start[1:], n)
    end = end - (buf[end - 1] == 0x0A)  # the break is not part of the line
    solid = np.concatenate([[0], np.cumsum(~_SPACE[buf], dtype=np.int64)])
    keep = solid[end] > solid[start]
    start, end = start[keep], end[keep]
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    h = word_hashes(block, Words(start, end, start), lower=False)
    key = h ^ mix64(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    k = key[order]
    later = np.zeros(len(k), dtype=bool)
    later[1:] = k[1:] == k[:-1]
    return np.bincount(doc[order[later]], minlength=block.n_docs).astype(np.int64)


def _repeat_words(block: Block, w: Words, h: np.ndarray) -> np.ndarray:
    """Per document: words covered by 3-word windows that occur twice or more in it."""
    n_docs = block.n_docs
    if len(h) < 3:
        return np.zeros(n_docs, dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(w.first))
    win = combine([h[:-2], h[1:-1], h[2:]], 3)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = win[at] ^ mix64(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(h), dtype=bool)
    for i in range(3):
        covered[hit + i] = True
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """Exact counts per document of a block."""
    n = block.n_bytes
    buf = block.buf[:n]
    w = words(block)
    h = word_hashes(block, w, lower=False)
    n_words = np.diff(w.first).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_IS_SYMBOL[buf], dtype=np.int64)])
    named = np.concatenate([[0], np.cumsum(_IS_LETTER[buf] | _IS_DIGIT[buf], dtype=np.int64)])
    has_mark, has_name = marks[w.end] > marks[w.start], named[w.end] > named[w.start]
    return {
        "n_words": n_words,
        "word_chars": _per_doc(~_SPACE[buf] & ((buf & 0xC0) != 0x80), block.offsets),
        "n_symbols": _per_doc(_IS_SYMBOL[buf], block.offsets),
        "n_dup_lines": _line_repeats(block),
        "n_repeat_words": _repeat_words(block, w, h),
        "n_lines": _per_doc(buf == 0x0A, block.offsets) + 1,
        "n_bangs": _per_doc(buf == 0x21, block.offsets),
        "n_upper": _per_doc(_IS_UPPER[buf], block.offsets),
        "n_stray": _per_doc(~has_name, w.first),
        "n_mixed": _per_doc(has_mark & has_name, w.first),
        "n_letters": _per_doc(_IS_LETTER[buf], block.offsets),
    }


def votes(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vote pattern as a base-3 number with the first rule lowest, base_failed)."""
    words_, one = s["n_words"], np.maximum(s["n_words"], 1)
    mean = s["word_chars"] / one
    value = {
        "symbols_per_word": s["n_symbols"] / one,
        "stray_share": s["n_stray"] / one,
        "mixed_share": s["n_mixed"] / one,
        "not_letter_share": 1 - s["n_letters"] / np.maximum(s["word_chars"], 1),
        "bangs_per_word": s["n_bangs"] / one,
        "upper_share": s["n_upper"] / np.maximum(s["n_letters"], 1),
        "dup_line_share": s["n_dup_lines"] / s["n_lines"],
        "repeat_share": s["n_repeat_words"] / one,
        "short_by": np.clip((80 - words_) / 60, 0, 1),
        "word_length_off": np.clip(np.maximum(3.0 - mean, (mean - 8.0) / 2), 0, None),
    }
    pattern = np.zeros(len(words_), dtype=np.int64)
    for i, (name, good, bad) in enumerate(RATIO_RULES):
        v = value[name]
        pattern += 3**i * np.where(v >= bad, BAD, np.where(v <= good, GOOD, ABSTAIN))
    failed = (words_ < 50) | (100 * s["n_repeat_words"] > 50 * words_)
    return pattern, failed


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, vote pattern and base verdict of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                s = block_stats(block)
                pattern, failed = votes(s)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(block.first, block.n_docs), *(pa.array(s[c]) for c in _COUNTS), pa.array(failed), pa.array(pattern)],
                    names=[id_col, *_COUNTS, "base_failed", "pattern"],
                )

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, pattern bigint"
    )


#: Counts of (abstain, good, bad) added to the votes of every rule in the good and in the bad class.
PRIOR = np.array([[0.5, 3.0, 0.25], [0.5, 1.5, 1.5]])


def fit_label_model(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """EM over pattern counts: the posterior probability of good quality for each pattern.

    Rules are taken as independent given the hidden class. Starts from the majority vote;
    the class in which rules say *good* more often is the good one. Votes start from
    ``PRIOR`` counts (rules are better than chance), which matter on small corpora only.
    """
    if not counts:
        return {}
    keys = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[k] for k in keys.tolist()], dtype=float)
    v = np.stack([(keys // 3**i) % 3 for i in range(len(RULES))])  # rules x patterns
    good, bad = (v == GOOD).sum(0), (v == BAD).sum(0)
    post = np.clip((good + 1.0) / (good + 4.0 * bad + 2.0), 0.02, 0.98)
    for _ in range(rounds):
        prior = (weight * post).sum() / weight.sum()
        log = np.log(np.clip([prior, 1 - prior], 1e-9, None))[:, None].repeat(len(keys), 1)
        for r in range(len(RULES)):
            for c, q in enumerate((post, 1 - post)):
                p = np.array([PRIOR[c, k] + (weight * q)[v[r] == k].sum() for k in range(3)])
                log[c] += np.log(p / p.sum())[v[r]]
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    if (post * weight * (good - bad)).sum() / max((post * weight).sum(), 1e-9) < ((1 - post) * weight * (good - bad)).sum() / max(((1 - post) * weight).sum(), 1e-9):
        post = 1 - post
    return dict(zip(keys.tolist(), post.tolist(), strict=True))


def pattern_posteriors(stats: DataFrame) -> dict[int, float]:
    """Posteriors from the counts of all rows that pass the base rules; at most 3**rules numbers reach the driver."""
    rows = stats.where(~F.col("base_failed")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_label_model({r["pattern"]: r["n"] for r in rows})


def _with_posterior(stats: DataFrame, post: dict[int, float], threshold: float) -> DataFrame:
    spark = stats.sparkSession
    known = spark.createDataFrame(sorted(post.items()) or [(-1, 0.0)], "pattern bigint, quality_probability double")
    return (
        stats.join(F.broadcast(known), "pattern", "left")  # at most 3**rules rows
        .withColumn("quality_probability", F.when(F.col("base_failed"), 0.0).otherwise(F.coalesce("quality_probability", F.lit(0.0))))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
        .drop("pattern")
    )


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts, base_failed, quality_probability and kept."""
    stats = saved(rule_stats(docs, id_col, text_col), "rules")
    return _with_posterior(stats, pattern_posteriors(stats), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; votes are counted in one pass, applied in a second, nothing is shuffled."""
    one = docs.select(F.lit(0).alias("_row"), F.col(text_col).alias("_text"))
    good = {k for k, p in pattern_posteriors(rule_stats(one, "_row", "_text")).items() if p >= threshold}
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for block in blocks(b.column(at)):
                pattern, failed = votes(block_stats(block))
                keep[block.first : block.first + block.n_docs] = ~failed & np.isin(pattern, list(good))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
