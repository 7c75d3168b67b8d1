"""Corpus cleaning in stages: each takes the documents that the one before it kept.

Order: quality rules, near-duplicate removal, benchmark decontamination, secret masking, packing. All but
the last return the columns of ``documents``, whatever further columns there are.

Odd rows, stage by stage: null, empty and blank texts fail the base rules and go in the first stage (given to a later one,
they stay). Repeated rows are judged one by one and are one group of the second stage, which keeps one of them;
an id on two texts counts as two documents there. Null ids are kept like others. Ties have fixed winners: the least
id (nulls last) stands for its group. Empty tables give empty tables, and an empty benchmark drops nothing. Whole texts are
read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockwise.llm.decontaminate import drop_leaked
from blockwise.llm.frames import saved, table
from blockwise.llm.jaccard_join import one_per_group
from blockwise.llm.packing import pack
from blockwise.llm.quality_rules import keep_good
from blockwise.llm.secrets_crf import mask
from blockwise.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep (operator 8); a posterior of exactly one half is kept."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join (operator 3); texts without words are no copies of each other."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` (operator 5); repeated, null and empty items change nothing."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and ``n_chars`` counted anew where it changed (operator 4)."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens (operator 9); a null text is its end token."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Statistical and sequential stages have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
