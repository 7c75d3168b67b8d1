"""License scans (operator 1): sparse TF-IDF cosine to templates, then directory inheritance.

A text is compared with names, notices and whole bodies of licences by the cosine of TF-IDF vectors over lower-cased
tokens. What is compared are *units* of the text that hold a naming word (licence, copyright, warranty ...):

    lines, and the sentences of a line that has several;
    windows: runs of such lines, at most ``GAP`` other lines apart, joined with all between them, alone and with the
    next line, so that wrapped notices, titles over two lines and whole licence bodies are seen in one piece;
    the whole text of a file whose name says that it is a licence.

A file takes the licence of its best unit at or above ``threshold``; a licence goes before a bare "all rights reserved". A file is a
*licence file* if its name says so or its words lie mostly in matching units; its licence covers its directory. Files
without a header inherit from the nearest ancestor directory that has one, by equi-joins on ancestor paths.

Inverse document frequencies are those of the templates, so a line's score depends on nothing but the line. Only
DataFrame functions are used. Equal units are scored once, however many documents repeat them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.llm.frames import saved, table
from blockwise.llm.license_texts import NAMING, TEMPLATES

TOKEN = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
NAMES = r"(?i)(^|/)(licen[sc]e|copying|copyright|unlicense|notice)([.-][^/]*)?$"
SENTENCE_END = r"(?<=[.;:!?])\s+"
NAMED = r"(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, NAMING)) + r")(?![a-z0-9])"
#: Lines without a naming word that a window may hold in a row.
GAP = 2
#: Kinds of units.
LINE, SENTENCE, WINDOW, WHOLE = range(4)
#: Scored units (64 bytes each) that go to every task; more are joined by a salted shuffle.
BROADCAST_ROWS, SALTS = 500_000, 64


class Templates:
    """TF-IDF vectors of the templates; their number is fixed, so they are literals of the plan."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        rows = [(name, Counter(re.findall(TOKEN, t.lower()))) for name in sorted(templates) for t in templates[name]]
        for name, c in rows:
            if not any(t in NAMING for t in c):
                raise ValueError(f"a template of {name} holds no naming word")
        df = Counter(t for _, c in rows for t in c)
        self.unknown = math.log(1 + len(rows)) + 1
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in sorted(df.items())}
        self.weights: list[tuple[str, int, str, float, float]] = []  # token, template, licence, unit weight, idf
        for i, (name, c) in enumerate(rows):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            self.weights += [(t, i, name, n * self.idf[t] / norm, self.idf[t]) for t, n in sorted(c.items())]


def score_units(units: DataFrame, known: Templates, threshold: float) -> DataFrame:
    """(u, unit) of distinct units -> (u, license, score) of those at or above the threshold; ties go to the first name."""
    spark = units.sparkSession
    weights = spark.createDataFrame(known.weights, "token string, template int, license string, unit double, idf double")
    tokens = (
        units.select("u", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TOKEN), F.lit(0))).alias("token"))
        .groupBy("u", "token").agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = weights.select("token", "idf").distinct()
    weighed = tokens.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(known.unknown))).drop("idf")
    dots = weighed.join(F.broadcast(weights), "token").groupBy("u", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    norms = weighed.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    best = dots.join(norms, "u").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    first = F.min(F.struct((F.col("license") == "proprietary").alias("last"), (-F.col("score")).alias("s"), "license"))
    return best.groupBy("u").agg(first.alias("b")).select("u", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _named_lines(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, tid (hash of the text), solid, lines and the places of the lines with a naming word; empty arrays for texts without one."""
    text = F.coalesce(files[text_col], F.lit(""))
    none = F.array().cast("array<string>")
    lines = F.when(text.rlike(NAMED), F.split(text, "\n")).otherwise(none)
    return files.select(
        files[path_col].alias("path"),
        F.xxhash64(text).alias("tid"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")).alias("solid"),
        lines.alias("lines"),
        F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(NAMED), i))).alias("at"),
    )


def units_of(slim: DataFrame) -> DataFrame:
    """(path, tid, solid, kind, unit) rows from ``_named_lines``, which must be a saved table: array functions would split a text anew for each of its lines."""
    starts = F.filter("at", lambda x, k: (k == 0) | (x - F.get("at", k - 1) > GAP + 1))
    ends = F.filter("at", lambda x, k: (k == F.size("at") - 1) | (F.get("at", k + 1) - x > GAP + 1))
    windows = slim.select("path", "tid", "solid", "lines", "at", F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("w"))
    line = lambda i: F.trim(F.get("lines", i))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    joined = lambda w, more: F.array_join(F.slice("lines", w["a"] + 1, w["b"] - w["a"] + 1 + more), " ")
    sentences = F.flatten(F.transform("at", lambda i: F.filter(F.split(line(i), SENTENCE_END), lambda x: x.rlike(NAMED) & (x != line(i)))))
    whole = F.when(F.col("path").rlike(NAMES) & (F.size("at") > 0), F.array(F.array_join("lines", " "))).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.transform("at", lambda i: unit(LINE, line(i))),
        F.transform(sentences, lambda x: unit(SENTENCE, x)),
        F.transform(F.filter("w", lambda w: w["b"] > w["a"]), lambda w: unit(WINDOW, joined(w, 0))),
        F.transform(F.filter("w", lambda w: w["b"] + 1 < F.size("lines")), lambda w: unit(WINDOW, joined(w, 1))),
        F.transform(whole, lambda x: unit(WHOLE, x)),
    )
    return windows.select("path", "tid", "solid", F.explode(every).alias("e")).select("path", "tid", "solid", "e.kind", "e.unit")


def scan(files: DataFrame, threshold: float = 0.75, covered: float = 0.5, templates: dict[str, tuple[str, ...]] | None = None, path_col: str = "path", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``files``: path, license, how (header, file, inherited, none), score, license_dir, n_license_lines.

    Null and empty texts have no header and inherit; a row without a path may have a header but inherits nothing and
    covers nothing. Rows of one path with different texts are judged apart; of several
    licence files in a directory the best score, then the first name and path, counts. Repeated rows give repeated
    rows; an empty table gives an empty result; other columns are not read. Whole texts are scanned, however long.
    """
    known = Templates(templates or TEMPLATES)
    slim = saved(_named_lines(files, path_col, text_col), "lines")
    solid = F.length(F.regexp_replace("unit", "[\\x20\\x09-\\x0D]", ""))
    found = units_of(slim.where(F.size("at") > 0)).withColumn("u", F.xxhash64("unit"))
    scored = saved(score_units(found.groupBy("u").agg(F.first("unit").alias("unit")), known, threshold), "scored")
    hits = found.select("path", "tid", "solid", "kind", "u", solid.alias("chars"))
    if scored.count() <= broadcast_rows:
        hits = hits.join(F.broadcast(scored), "u")
    else:  # a line that very many files repeat is dealt over SALTS tasks
        salted = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("path", "tid"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])
    of_kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("chars")).otherwise(0))
    per_file = hits.groupBy("path", "tid").agg(
        F.min(F.struct((F.col("license") == "proprietary").alias("last"), (-F.col("score")).alias("s"), "license")).alias("b"),
        F.count_if(F.col("kind") == LINE).alias("n_lines"),
        # Windows come twice, alone and with the next line; the larger share counts.
        (F.greatest(of_kind(LINE), F.max(F.when(F.col("kind") >= WINDOW, F.col("chars")).otherwise(0))) / F.max("solid")).alias("cover"),
    ).select("path", "tid", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score"), "n_lines", "cover")
    per_file = saved(per_file, "headers")
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    is_file = F.col("path").rlike(NAMES) | (F.col("cover") >= covered)
    of_dir = (
        per_file.where(F.col("path").isNotNull() & is_file)
        .groupBy(parent.alias("dir")).agg(F.min(F.struct((F.col("own") == "proprietary").alias("last"), (-F.col("own_score")).alias("s"), "own", "path")).alias("b"))
        .select("dir", F.col("b.own").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    )
    # Every directory with files, and its ancestors: far fewer rows than files.
    dirs = slim.select(parent.alias("at")).where("at is not null").distinct()
    parts = F.split("at", "/")
    up = dirs.select("at", F.explode(F.when(F.col("at") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    up = up.withColumn("dir", F.array_join(F.slice(F.split("at", "/"), 1, F.col("depth")), "/"))
    near = up.join(of_dir, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score")).alias("b")).select("at", "b.dir", "b.dir_license", "b.dir_score")
    own = per_file.withColumnsRenamed({"path": "own_path", "tid": "own_tid"})
    rows = slim.select("path", "tid", parent.alias("at"))
    out = rows.join(own, F.col("path").eqNullSafe(F.col("own_path")) & (F.col("tid") == F.col("own_tid")), "left").join(near, "at", "left")
    return out.select(
        F.col("path").alias(path_col),
        F.coalesce("own", "dir_license").alias("license"),
        F.when(F.col("own").isNotNull(), F.when(F.coalesce(is_file, F.lit(False)), "file").otherwise("header")).when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("own_score", "dir_score").alias("score"),
        F.when(F.col("own").isNull(), F.col("dir")).alias("license_dir"),
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_license_lines"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``: the table has no paths, so its groups stand for directories.

    ``how`` tells a document's own licence (header, file) from one that comes from such a group (inherited).
    """
    docs = table(spark, sf_dir, "documents")
    got = scan(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))
    return got.select(F.substring_index("path", "/", -1).cast("bigint").alias("doc_id"), "path", "license", "how", "score", "license_dir", "n_license_lines")
