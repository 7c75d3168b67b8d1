"""The corpus operators' queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockwise.llm import decontaminate, html_text, jaccard_join, licenses, packing, quality_knn, quality_rules, secrets_crf, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
        "op4_secret_scan": secrets_crf.op4_secret_scan,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_quality_classifier": quality_knn.op6_quality_classifier,
        "op7_html_extraction": html_text.op7_html_extraction,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_sharding": sharding.op10_sharding,
    }


#: Shingle sets, all overlaps by a join on shingles, and the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w
), e AS (SELECT doc_id, unnest(g) AS g FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_FOLD = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Overlaps by a join on shingles of whole texts, BM25 weights by aggregates.
OP5_SQL = rf"""
WITH b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE regexp_matches(text, '[^\x20\x09-\x0D]')),
i AS (SELECT row_number() OVER () AS i, item_id, {_WORDS.format(_FOLD.format("text"))} AS ws, len({_WORDS.format("regexp_extract(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), '[^.!?\n]*[.!?]*$')")}) AS na FROM b),
n AS (SELECT *, len(ws) AS n, greatest(len(ws) - na, 0) AS q, least(5, len(ws)) AS k FROM i),
g AS (SELECT i, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g, p + k - 1 <= q AS asked, p > q AS answered FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM n)),
m AS (SELECT i, count(*) AS m, count(*) FILTER (WHERE asked) AS mq, count(*) FILTER (WHERE answered) AS ma FROM g GROUP BY i),
d AS (SELECT doc_id, {_WORDS.format(_FOLD.format("text"))} AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM n))),
h AS (SELECT e.doc_id, g.i, count(*) AS h, count(*) FILTER (WHERE asked) AS hq, count(*) FILTER (WHERE answered) AS ha FROM e JOIN g ON e.g = g.g AND e.k = g.k GROUP BY 1, 2),
l AS (SELECT * FROM h JOIN m USING (i) WHERE 2 * h >= m OR mq >= 8 AND 10 * hq >= 9 * mq OR ma >= 8 AND 10 * ha >= 9 * ma),
t AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(ws) AS t FROM n) GROUP BY 1, 2),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t),
c AS (SELECT count(*) AS items, avg(n) AS mean FROM n),
w AS (SELECT i, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS w FROM t JOIN f USING (t) JOIN n USING (i) CROSS JOIN c),
u AS (SELECT i, t, w / sum(w) OVER (PARTITION BY i) AS w FROM w),
x AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(ws) AS t FROM d WHERE doc_id IN (SELECT doc_id FROM l))),
s AS (SELECT l.doc_id, l.i, sum(u.w) AS score FROM l JOIN u ON u.i = l.i JOIN x ON x.doc_id = l.doc_id AND x.t = u.t GROUP BY 1, 2)
SELECT l.doc_id, n.item_id, round(s.score, 6) AS score, h / m AS overlap, CASE WHEN mq > 0 THEN hq / mq ELSE 0.0 END AS question_overlap, CASE WHEN ma > 0 THEN ha / ma ELSE 0.0 END AS answer_overlap
FROM l JOIN s ON s.doc_id = l.doc_id AND s.i = l.i JOIN n ON n.i = l.i
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the tests hold the others against brute force."""
    return {"op3_ngram_jaccard_join": OP3_SQL, "op5_benchmark_decontamination": OP5_SQL}
