"""Queries over the driver's tables, one for each operator, with the equal SQL where there is one.

The tables have no missing values, so the ``lineitem`` layer gets a mask from its keys that both engines can compute.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise import sql_models
from blockwise.functions import metrics
from blockwise.operators import diablo, diablo_validation, integrate, long_form, preprocess, resample
from blockwise.operators.classifiers import Classifier, WeightedConcatenation
from blockwise.operators.layer import Layer, cut, layer_from_vectors, q, shared_dir
from blockwise.operators.pca import Pca, top_loadings
from blockwise.operators.plsda import PlsDa, one_hot, vip_from_tables
from blockwise.operators.ranks import stratified_folds
from blockwise.plans import plotdata, workflows
from blockwise.sources.layers import read_csv_layer, read_table, write_results
from blockwise.streaming.profile import windowed_profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Added before rounding sums of doubles, in both engines: an exact half would go either way with the order of summation.
NUDGE = 1e-9


def near(c, digits: int = 4):
    """Rounded for comparison; no negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits) + 0.0


def near_sql(x: str, digits: int = 4) -> str:
    return f"round({x} + {NUDGE}, {digits}) + 0.0"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- layers -------------------------------------------------------------------------------------------------

FEATURES = ("quantity", "price", "discount", "tax")
MASKED = {
    "quantity": "CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 = 0 THEN NULL ELSE l_quantity END",
    "price": "CASE WHEN (l_orderkey * 3 + l_linenumber) % 4 = 0 THEN NULL ELSE l_extendedprice / 1000 END",
    "discount": "CASE WHEN (l_orderkey * 11 + l_linenumber) % 20 < 9 THEN NULL ELSE l_discount * 100 END",
    "tax": "CASE WHEN (l_orderkey * 5 + l_linenumber) % 10 < 7 THEN NULL ELSE l_tax * 100 + 1 END",
}
PLAIN = {"quantity": "l_quantity", "price": "l_extendedprice / 1000", "discount": "l_discount * 100 + 1", "tax": "l_tax * 100 + 1"}
_M = "m AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, " + ", ".join(f"{e} AS {c}" for c, e in MASKED.items()) + " FROM lineitem)"
_P = "m AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, " + ", ".join(f"{e} AS {c}" for c, e in PLAIN.items()) + " FROM lineitem)"


def lineitem(spark: SparkSession, sf: str, cols: dict[str, str] = MASKED) -> Layer:
    df = read_table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS grp", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in cols.items()])
    return Layer(df, "grp", tuple(cols), ("l_orderkey", "l_linenumber"), "lineitem")


def summary(layer: Layer, digits: int = 4) -> DataFrame:
    """(grp, feature, n, mean, lo, hi, std) of a layer, from one aggregate by label."""
    names = layer.features
    row = layer.df.groupBy(q(layer.group).alias("grp")).agg(*[x for i, c in enumerate(names) for x in (F.count(q(c)).alias(f"n{i}"), F.avg(q(c)).alias(f"m{i}"), F.min(q(c)).alias(f"l{i}"), F.max(q(c)).alias(f"h{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), *[near(f"{k}{i}", digits).alias(v) for k, v in (("m", "mean"), ("l", "lo"), ("h", "hi"), ("s", "std"))]) for i, c in enumerate(names)])
    return row.select("grp", F.inline(cells))


def summary_sql(ctes: str, table: str, cols: tuple[str, ...] = FEATURES, digits: int = 4) -> str:
    parts = [
        f"SELECT grp, '{c}' AS feature, count({c}) AS n, " + ", ".join(f"{near_sql(f'{f}({c})', digits)} AS {v}" for f, v in (("avg", "mean"), ("min", "lo"), ("max", "hi"), ("stddev_pop", "std"))) + f" FROM {table} GROUP BY grp"
        for c in cols
    ]
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


def _each(template: str, cols: tuple[str, ...] = FEATURES) -> str:
    return ", ".join(template.format(c=c) + f" AS {c}" for c in cols)


# --- B: preprocessing ---------------------------------------------------------------------------------------

_FRACTIONS = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS f FROM m" for c in FEATURES)


@query("b02_missing_filter_profile", f"WITH {_M}, f AS ({_FRACTIONS}) SELECT feature, round(f, 6) AS missing_fraction, f <= 0.5 AS kept FROM f")
def b02(spark, sf):
    return preprocess.missing_profile(lineitem(spark, sf), 0.5).select("feature", F.round("missing_fraction", 6).alias("missing_fraction"), "kept")


_GM = "g AS (SELECT grp AS gg, " + ", ".join(f"median({c}) AS m_{c}, count({c}) AS n_{c}" for c in FEATURES) + ", count(*) AS nn FROM m GROUP BY grp), t AS (SELECT " + ", ".join(f"median({c}) AS t_{c}" for c in FEATURES) + " FROM m)"


def _impute_sql(cell: str) -> str:
    return summary_sql(f"{_M}, {_GM}, i AS (SELECT grp, {_each(cell)} FROM m JOIN g ON m.grp = g.gg CROSS JOIN t)", "i")


@query("b03_group_median_impute", _impute_sql("coalesce({c}, m_{c}, 0)"))
def b03(spark, sf):
    return summary(preprocess.impute(lineitem(spark, sf)))


@query("b04_conservative_impute", _impute_sql("coalesce({c}, CASE WHEN n_{c} >= 0.5 * nn THEN m_{c} END, 0)"))
def b04(spark, sf):
    return summary(preprocess.impute(lineitem(spark, sf), "conservative"))


@query("b05_proteomics_impute", _impute_sql("coalesce({c}, m_{c}, t_{c})"))
def b05(spark, sf):
    return summary(preprocess.impute(lineitem(spark, sf), "proteomics", None))


@query("b06_numeric_columns", "SELECT 's_acctbal' AS feature UNION ALL SELECT 's_nationkey' UNION ALL SELECT 's_suppkey'")
def b06(spark, sf):
    layer = Layer.from_wide(read_table(spark, sf, "supplier"), "s_name")
    return spark.createDataFrame([(c,) for c in layer.features], "feature string")


@query("b07_label_cast", "SELECT CAST(c_nationkey AS VARCHAR) AS grp, count(*) AS n FROM customer GROUP BY 1")
def b07(spark, sf):
    layer = Layer.from_wide(read_table(spark, sf, "customer"), "c_nationkey", features=["c_acctbal"])
    return layer.df.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b08_zero_variance",
    f"WITH {_P}, v AS (SELECT 'constant' AS feature, 0.0 AS v UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', var_pop({c}) FROM m" for c in FEATURES) + ") SELECT feature, round(v, 3) + 0.0 AS variance, v > 0 AS kept FROM v",
)
def b08(spark, sf):
    layer = lineitem(spark, sf, PLAIN | {"constant": "7.0"})
    return preprocess.variance_profile(layer).select("feature", (F.round("variance", 3) + 0.0).alias("variance"), "kept")


@query(
    "b09_negative_shift",
    "SELECT s_suppkey, round(s_acctbal + CASE WHEN (SELECT min(s_acctbal) FROM supplier) < 0 THEN abs((SELECT min(s_acctbal) FROM supplier)) + 1 ELSE 0 END, 4) AS s_acctbal FROM supplier",
)
def b09(spark, sf):
    layer = Layer.from_wide(read_table(spark, sf, "supplier"), "s_nationkey", sample_col="s_suppkey")
    return preprocess.shift_negative(layer).df.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@query("b10_log", summary_sql(f"{_P}, i AS (SELECT grp, {_each('ln({c} + 1e-10)')} FROM m)", "i"))
def b10(spark, sf):
    return summary(preprocess.transform(lineitem(spark, sf, PLAIN), "log"))


@query("b11_log2", summary_sql(f"{_P}, i AS (SELECT grp, {_each('log2({c} + 1e-10)')} FROM m)", "i"))
def b11(spark, sf):
    return summary(preprocess.transform(lineitem(spark, sf, PLAIN), "log2"))


@query("b12_identity_transform", summary_sql(_P, "m"))
def b12(spark, sf):
    return summary(preprocess.transform(lineitem(spark, sf, PLAIN), "none"))


_ST = "t AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS l_{c}, max({c}) AS h_{c}" for c in FEATURES) + " FROM m)"
_SCALE = {"b13_standard": ("standard", "({c} - a_{c}) / s_{c}"), "b14_minmax": ("minmax", "({c} - l_{c}) / (h_{c} - l_{c})"), "b15_pareto": ("pareto", "({c} - a_{c}) / sqrt(s_{c})"), "b16_no_scaling": ("none", "{c}")}
for _name, (_how, _cell) in _SCALE.items():
    query(_name, summary_sql(f"{_P}, {_ST}, i AS (SELECT grp, {_each(_cell)} FROM m CROSS JOIN t)", "i"))(lambda spark, sf, how=_how: summary(preprocess.scale(lineitem(spark, sf, PLAIN), how)))


_HALF = "t AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM m WHERE grp = 'N')"


@query("b17_fit_then_transform", summary_sql(f"{_P}, {_HALF}, i AS (SELECT grp, {_each('({c} - a_{c}) / sqrt(s_{c})')} FROM m CROSS JOIN t WHERE grp <> 'N')", "i"))
def b17(spark, sf):
    layer = lineitem(spark, sf, PLAIN)
    fitted = preprocess.FittedScaler.fit(layer.with_df(layer.df.where("grp = 'N'")), "pareto")
    return summary(fitted.apply(layer.with_df(layer.df.where("grp <> 'N'"))))


@query("b18_quality", summary_sql(f"{_M}, i AS (SELECT grp, {_each('coalesce({c}, 0)')} FROM m)", "i"))
def b18(spark, sf):
    layer = lineitem(spark, sf)
    return summary(preprocess.quality_check(layer.map_features(lambda c, _: F.when(c.isNull(), F.lit(float("nan"))).otherwise(c))))


def _pipeline_sql(kept: tuple[str, ...], cell: str, log: str) -> str:
    st = "t2 AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in kept) + " FROM l)"
    return summary_sql(f"{_M}, {_GM}, i AS (SELECT grp, {_each(cell, kept)} FROM m JOIN g ON m.grp = g.gg CROSS JOIN t), l AS (SELECT grp, {_each(log + '({c} + 1e-10)', kept)} FROM i), {st}, z AS (SELECT grp, {_each('({c} - a_{c}) / sqrt(s_{c})', kept)} FROM l CROSS JOIN t2)", "z", kept)


# Which features survive follows from the mask: a tenth, a quarter, nine twentieths and seven tenths are missing.
for _kind, _kept, _cell, _log in (
    ("metabolomics", FEATURES[:3], "coalesce({c}, m_{c}, 0)", "ln"),
    ("volatiles", FEATURES[:3], "coalesce({c}, CASE WHEN n_{c} >= 0.5 * nn THEN m_{c} END, 0)", "ln"),
    ("proteomics", FEATURES[:2], "coalesce({c}, m_{c}, t_{c})", "log2"),
):
    query(f"b19_pipeline_{_kind}", _pipeline_sql(_kept, _cell, _log))(lambda spark, sf, kind=_kind: summary(preprocess.preprocess(lineitem(spark, sf), preprocess.preset(kind))))


@query("b19_pipeline_long_form", _pipeline_sql(FEATURES[:3], "coalesce({c}, m_{c}, 0)", "ln"))
def b19_long(spark, sf):
    layer = lineitem(spark, sf)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cells = layer.with_df(layer.df.withColumn("l_orderkey", key)).long("l_orderkey")
    out = long_form.preprocess(cells, preprocess.preset("metabolomics"))
    return out.groupBy("grp", "feature").agg(F.count("value").alias("n"), *[near(f("value")).alias(n) for f, n in ((F.avg, "mean"), (F.min, "lo"), (F.max, "hi"), (F.stddev_pop, "std"))])


# --- C: integration -----------------------------------------------------------------------------------------

BLOCKS = ("orders", "lines", "customer")
_L = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderpriority AS grp, o_totalprice / 1000 AS total, o_custkey FROM orders),
l AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, avg(l_quantity) AS qty, sum(l_extendedprice) / 1000 AS price, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o.sample_id, o.grp, c_acctbal / 100 AS acct FROM o JOIN customer ON o_custkey = c_custkey),
cells AS (SELECT 'orders' AS layer, sample_id, grp, 'total' AS feature, total AS value FROM o
 UNION ALL SELECT 'lines', l.sample_id, o.grp, f, CASE f WHEN 'qty' THEN qty WHEN 'price' THEN price ELSE lines END FROM l JOIN o ON l.sample_id = o.sample_id CROSS JOIN (VALUES ('qty'), ('price'), ('lines')) v(f)
 UNION ALL SELECT 'customer', sample_id, grp, 'acct', acct FROM c),
k AS (SELECT sample_id FROM cells GROUP BY sample_id HAVING count(DISTINCT layer) = 3)"""


def block_cells(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") / 1000).alias("total"), "o_custkey")
    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id")).agg(F.avg("l_quantity").alias("qty"), (F.sum("l_extendedprice") / 1000).alias("price"), F.count(F.lit(1)).cast("double").alias("lines"))
    cu = read_table(spark, sf, "customer")
    one = Layer(o.drop("o_custkey"), "grp", ("total",), ("sample_id",), "orders").long()
    two = Layer(li.join(o.select("sample_id", "grp"), "sample_id"), "grp", ("qty", "price", "lines"), ("sample_id",), "lines").long()
    three = Layer(o.join(cu, o.o_custkey == cu.c_custkey).select("sample_id", "grp", (F.col("c_acctbal") / 100).alias("acct")), "grp", ("acct",), ("sample_id",), "customer").long()
    return integrate.union_layers([one, two, three])


def block_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per aligned sample: sample_id, grp and an array per block."""
    cells = integrate.concatenate(block_cells(spark, sf), BLOCKS)
    x = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == b, F.struct("feature_ix", "value")))), lambda s: s["value"]).alias(b)
    return cells.groupBy("sample_id", "grp").agg(*[x(b) for b in BLOCKS])


def _samples(spark, sf):
    return block_cells(spark, sf).select("layer", "sample_id").distinct()


@query("c02_common_samples", f"WITH {_L} SELECT sample_id FROM k")
def c02(spark, sf):
    return integrate.common_samples(_samples(spark, sf))


@query("c03_excluded_counts", f"WITH {_L} SELECT layer, count(DISTINCT CASE WHEN sample_id NOT IN (SELECT sample_id FROM k) THEN sample_id END) AS n_excluded FROM cells GROUP BY layer")
def c03(spark, sf):
    return integrate.excluded_counts(_samples(spark, sf))


@query("c04_align", f"WITH {_L} SELECT o.sample_id, round(total, 6) AS total, round(acct, 6) AS acct FROM o JOIN c ON o.sample_id = c.sample_id JOIN l ON l.sample_id = o.sample_id")
def c04(spark, sf):
    cells = cut(block_cells(spark, sf))  # each side reads it
    sides = {b: cells.where(F.col("layer") == b).groupBy("sample_id", "grp").agg(F.lit(0).alias("row_ix"), F.max(F.when(F.col("feature_ix") == 0, F.col("value"))).alias("x")) for b in BLOCKS}
    return integrate.align(sides).select("sample_id", F.round("orders_x", 6).alias("total"), F.round("customer_x", 6).alias("acct"))


@query("c05_label_conflicts", f"WITH {_L} SELECT 'shifted' AS layer, count(*) FILTER (WHERE grp <> CASE WHEN CAST(sample_id AS BIGINT) % 7 = 0 THEN 'other' ELSE grp END) AS n_conflicts FROM o")
def c05(spark, sf):
    o = block_cells(spark, sf).where("layer = 'orders'").select("sample_id", "grp", F.lit(0).alias("row_ix"), F.col("value").alias("x"))
    other = o.withColumn("grp", F.when(F.col("sample_id").cast("bigint") % 7 == 0, "other").otherwise(F.col("grp")))
    return integrate.label_conflicts(integrate.align({"orders": o, "shifted": other}), ["orders", "shifted"])


@query("c06_concatenate", f"WITH {_L} SELECT layer || '_' || feature AS feature, count(*) AS n, {near_sql('avg(value)')} AS mean FROM cells WHERE sample_id IN (SELECT sample_id FROM k) GROUP BY 1")
def c06(spark, sf):
    return integrate.concatenate(block_cells(spark, sf), BLOCKS).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), near(F.avg("value")).alias("mean"))


@query("c07_block_ranges", f"""WITH {_L}, w AS (SELECT layer, count(DISTINCT feature) AS p, CASE layer WHEN 'orders' THEN 1 WHEN 'lines' THEN 2 ELSE 3 END AS o FROM cells GROUP BY layer)
SELECT a.layer, CAST(coalesce((SELECT sum(p) FROM w b WHERE b.o < a.o), 0) AS BIGINT) AS "start", CAST((SELECT sum(p) FROM w b WHERE b.o <= a.o) AS BIGINT) AS "end" FROM w a""")
def c07(spark, sf):
    return integrate.block_ranges(block_cells(spark, sf), BLOCKS)


@query("c08_layer_summary", f"WITH {_L} SELECT layer, count(DISTINCT sample_id) AS samples, count(DISTINCT feature) AS features, count(DISTINCT grp) AS groups, CAST(count(*) - count(value) AS BIGINT) AS missing_values FROM cells GROUP BY layer")
def c08(spark, sf):
    return integrate.layer_summary(block_cells(spark, sf))


@query("c12_block_summary", f"WITH {_L} SELECT layer, count(DISTINCT feature) AS features, count(value) AS total_values, {near_sql('avg(value)')} AS mean, {near_sql('stddev_pop(value)')} AS std FROM cells GROUP BY layer")
def c12(spark, sf):
    return integrate.block_summary(block_cells(spark, sf)).select("layer", "features", "total_values", near("mean").alias("mean"), near("std").alias("std"))


def _cells_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer", "feature").agg(F.count("value").alias("n"), near(F.avg("value")).alias("mean"), near(F.stddev_pop("value")).alias("std"))


def _cells_sql(value: str, extra: str = "") -> str:
    return f"WITH {_L}{extra}, w AS (SELECT cells.layer, feature, {value} AS v FROM cells{' JOIN st ON cells.layer = st.layer' if extra else ''}) SELECT layer, feature, count(v) AS n, {near_sql('avg(v)')} AS mean, {near_sql('stddev_pop(v)')} AS std FROM w GROUP BY layer, feature"


_STATS = ", st AS (SELECT layer, count(DISTINCT feature) AS p, stddev_pop(value) AS sd FROM cells GROUP BY layer)"


@query("c15_weighted", _cells_sql("value * CASE cells.layer WHEN 'orders' THEN 2.0 WHEN 'lines' THEN 0.5 ELSE 1.0 END"))
def c15(spark, sf):
    return _cells_summary(integrate.weighted(block_cells(spark, sf), {"orders": 2.0, "lines": 0.5}))


@query("c16_early_simple", _cells_sql("value"))
def c16(spark, sf):
    return _cells_summary(integrate.early_integration(block_cells(spark, sf), "simple"))


@query("c17_sqrt_weighted", _cells_sql("value / sqrt(p)", _STATS))
def c17(spark, sf):
    return _cells_summary(integrate.early_integration(block_cells(spark, sf), "weighted"))


@query("c18_block_normalised", _cells_sql("value / (sd + 1e-10)", _STATS))
def c18(spark, sf):
    return _cells_summary(integrate.early_integration(block_cells(spark, sf), "normalized"))


@query("c19_variance_select", f"WITH {_L} SELECT layer, feature, round(var_pop(value), 3) AS variance FROM cells GROUP BY layer, feature ORDER BY var_pop(value) DESC, layer, feature LIMIT 3")
def c19(spark, sf):
    return integrate.select_by_variance(block_cells(spark, sf), 3).select("layer", "feature", F.round("variance", 3).alias("variance"))


@query("c19_mutual_information_select")
def c19_mi(spark, sf):
    return integrate.select_by_mutual_information(block_cells(spark, sf), 3)


# --- D: single-layer models ---------------------------------------------------------------------------------

_TWO = "m AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem), s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS d, covar_pop(x, y) AS b FROM m), e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l2 FROM s)"


def two_features(spark, sf) -> Layer:
    df = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    return Layer(df, "grp", ("x", "y"), ("l_orderkey", "l_linenumber"))


def embeddings(spark, sf) -> Layer:
    return layer_from_vectors(read_table(spark, sf, "embeddings"), "embedding", 64, "label", "vec_id", "embeddings")


_EMB = "e AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) r(i))"
_PCS = f"WITH RECURSIVE {_EMB}, {sql_models.principal('e', 5)}"


@query("d01_pca_embeddings", f"{_PCS}, x AS (" + " UNION ALL ".join(f"SELECT {a} AS a, l FROM pc{a}" for a in range(1, 6)) + ") SELECT 'PC' || a AS pc, round(100 * l / t, 5) AS variance, round(100 * sum(l) OVER (ORDER BY a) / t, 5) AS cumulative FROM x CROSS JOIN total")
def d01(spark, sf):
    return Pca.fit(embeddings(spark, sf), 5).variance().select(F.col("PC").alias("pc"), F.round("Variance_Explained", 5).alias("variance"), F.round("Cumulative_Variance", 5).alias("cumulative"))


@query("d02_scores_64d", f"{_PCS}, mu AS (SELECT i, avg(v) AS mu FROM e GROUP BY i) SELECT vec_id, " + ", ".join(f"round(sum((e.v - mu) * (SELECT v FROM pc{a})[e.i + 1]), 5) + 0.0 AS pc{a}" for a in (1, 2)) + " FROM e JOIN mu USING (i) GROUP BY vec_id")
def d02e(spark, sf):
    return Pca.fit(embeddings(spark, sf), 2).scores().select("vec_id", *[(F.round(F.col("pc")[i], 5) + 0.0).alias(f"pc{i + 1}") for i in range(2)])


@query("d02_scores_2d", f"WITH {_TWO} SELECT l_orderkey, l_linenumber, round(abs((x - mx) * b + (y - my) * (l1 - a)) / sqrt(b * b + (l1 - a) * (l1 - a)), 4) AS abs_score FROM m CROSS JOIN e")
def d02(spark, sf):
    return Pca.fit(two_features(spark, sf), 1).scores().select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("pc")[0]), 4).alias("abs_score"))


@query("d03_loadings_2d", f"WITH {_TWO} SELECT 'x' AS feature, round(abs(b) / sqrt(b * b + (l1 - a) * (l1 - a)), 6) AS abs_loading FROM e UNION ALL SELECT 'y', round(abs(l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)), 6) FROM e")
def d03(spark, sf):
    return Pca.fit(two_features(spark, sf), 1).loadings_table().select("feature", F.round(F.abs("loading"), 6).alias("abs_loading"))


@query("d04_variance_2d", f"WITH {_TWO} SELECT 'PC1' AS pc, round(l1 / (a + d) * 100, 6) AS variance, round(l1 / (a + d) * 100, 6) AS cumulative FROM e UNION ALL SELECT 'PC2', round(l2 / (a + d) * 100, 6), round(100.0, 6) FROM e")
def d04(spark, sf):
    return Pca.fit(two_features(spark, sf), 2).variance().select(F.col("PC").alias("pc"), F.round("Variance_Explained", 6).alias("variance"), F.round("Cumulative_Variance", 6).alias("cumulative"))


@query("d05_top_loadings", f"{_PCS}, x AS (SELECT 'f' || (i - 1) AS f, v[i] AS l FROM pc1 CROSS JOIN range(1, 65) r(i)) SELECT f AS \"Feature\", round(l, 5) AS \"Loading\", round(abs(l), 5) AS \"Abs_Loading\" FROM x ORDER BY abs(l) DESC, f LIMIT 10")
def d05(spark, sf):
    return Pca.fit(embeddings(spark, sf), 5).top_loadings(1, 10).select("Feature", F.round("Loading", 5).alias("Loading"), F.round("Abs_Loading", 5).alias("Abs_Loading"))


@query("d06_one_hot", "SELECT l_returnflag AS grp, count(*) AS n, sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS y_a, sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS y_n, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS y_r FROM lineitem GROUP BY 1")
def d06(spark, sf):
    df = one_hot(read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp")), "grp", ["A", "N", "R"])
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y_A").alias("y_a"), F.sum("y_N").alias("y_n"), F.sum("y_R").alias("y_r"))


_PLS = f"WITH RECURSIVE {_EMB}, {sql_models.pls('e', 2)}, ss AS (SELECT w1.tt * list_dot_product(w1.q, w1.q) AS s1, w2.tt * list_dot_product(w2.q, w2.q) AS s2 FROM w1 CROSS JOIN w2)"
_VIP = "vip AS (SELECT 'f' || (i - 1) AS f, sqrt(64 * (s1 * w1.w[i] * w1.w[i] + s2 * w2.w[i] * w2.w[i]) / (s1 + s2)) AS vip FROM w1 CROSS JOIN w2 CROSS JOIN ss CROSS JOIN range(1, 65) r(i))"
# Rotations: the second weight less its share along the first loading.
_ROT = "rot AS (SELECT i, w1.w[i] AS r1, w2.w[i] - list_dot_product(w1.p, w2.w) * w1.w[i] AS r2 FROM w1 CROSS JOIN w2 CROSS JOIN range(1, 65) r(i)), mu AS (SELECT i + 1 AS i, avg(v) AS mu FROM e GROUP BY i)"
_LV = f"{_ROT}, lv AS (SELECT vec_id, grp, sum((v - mu) * r1) AS l1, sum((v - mu) * r2) AS l2 FROM e JOIN mu ON mu.i = e.i + 1 JOIN rot ON rot.i = e.i + 1 GROUP BY vec_id, grp)"


@query("d07_plsda_embeddings", f"{_PLS}, {_VIP} SELECT f AS \"Feature\", round(vip, 6) AS \"VIP\", vip > 1 AS \"Important\" FROM vip")
def d07(spark, sf):
    return PlsDa.fit(embeddings(spark, sf), 2).vip().withColumn("VIP", F.round("VIP", 6))


@query("d08_plsda_scores", f"{_PLS}, {_LV} SELECT vec_id, round(l1, 5) + 0.0 AS lv1, round(l2, 5) + 0.0 AS lv2 FROM lv")
def d08(spark, sf):
    return PlsDa.fit(embeddings(spark, sf), 2).scores().select("vec_id", *[(F.round(F.col("lv")[i], 5) + 0.0).alias(f"lv{i + 1}") for i in range(2)])


@query("d09_predict_classes", f"{_PLS}, {_LV}, y AS (SELECT vec_id, lv.grp, lab.grp AS cls, l1 * w1.q[g] + l2 * w2.q[g] + n / (SELECT count(*) FROM lv) AS y FROM lv CROSS JOIN lab CROSS JOIN w1 CROSS JOIN w2) SELECT vec_id, grp AS label, arg_max(cls, (y, -CAST(cls AS INTEGER))) AS pred FROM y GROUP BY vec_id, grp")
def d09c(spark, sf):
    return PlsDa.fit(embeddings(spark, sf), 2).predict().select("vec_id", F.col("grp").alias("label"), "pred")


def _labelled(spark, sf) -> Layer:
    df = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("grp"), (F.col("n_chars") / 1000).alias("chars"), (F.size(F.split("text", " ")) / 100).alias("blanks"))
    return Layer(df, "grp", ("chars", "blanks"), ("doc_id",))


_LAB = "x AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, n_chars / 1000.0 AS chars, len(string_split(text, ' ')) / 100.0 AS blanks FROM labels JOIN documents USING (doc_id)), w AS (SELECT covar_pop(chars, y) AS a, covar_pop(blanks, y) AS b FROM x)"


# Sums over the rows, for one component on two features.
_SUMS = "t AS (SELECT count(*) AS n, sum(chars) AS a, sum(blanks) AS b, sum(chars * chars) AS aa, sum(chars * blanks) AS ab, sum(blanks * blanks) AS bb, sum(y) AS y, sum(chars * y) AS wy, sum(blanks * y) AS zy FROM x)"


def _one_component(source: str) -> str:
    """Response of a row (chars, blanks) from sums n, a, b, aa, ab, bb, y, wy, zy: one weight per feature, one score, one slope."""
    return f"""c AS (SELECT *, wy - a * y / n AS ca, zy - b * y / n AS cb, aa - a * a / n AS saa, ab - a * b / n AS sab, bb - b * b / n AS sbb FROM {source}),
h AS (SELECT *, (chars - a / n) * ca + (blanks - b / n) * cb AS t, (ca * ca + cb * cb) / (ca * ca * saa + 2 * ca * cb * sab + cb * cb * sbb) AS slope FROM c),
p AS (SELECT doc_id, CAST(CAST(label AS INTEGER) AS VARCHAR) AS grp, CASE WHEN t * slope + y / n > 0.5 THEN '1' ELSE '0' END AS pred FROM h)"""


@query("d09_predict_binary", f"WITH {_LAB}, {_SUMS}, r AS (SELECT doc_id, x.y AS label, chars, blanks, t.* FROM x CROSS JOIN t), {_one_component('r')} SELECT * FROM p")
def d09(spark, sf):
    return PlsDa.fit(_labelled(spark, sf), 1).predict()


# The same sums without the row itself.
_LEFT_OUT = "r AS (SELECT doc_id, x.y AS label, chars, blanks, n - 1 AS n, a - chars AS a, b - blanks AS b, aa - chars * chars AS aa, ab - chars * blanks AS ab, bb - blanks * blanks AS bb, t.y - x.y AS y, wy - chars * x.y AS wy, zy - blanks * x.y AS zy FROM x CROSS JOIN t)"


@query("d10_plsda_loo", f"WITH {_LAB}, {_SUMS}, {_LEFT_OUT}, {_one_component('r')} SELECT doc_id, grp, pred FROM p")
def d10(spark, sf):
    return PlsDa.fit(_labelled(spark, sf), 1).cross_validate().select("doc_id", "grp", "pred")


# Two components on two features are least squares; a row left out has the residual over one less its leverage.
_OLS = "m AS (SELECT *, a / n AS ma, b / n AS mb, y / n AS my, aa - a * a / n AS saa, ab - a * b / n AS sab, bb - b * b / n AS sbb, wy - a * y / n AS ca, zy - b * y / n AS cb FROM t), k AS (SELECT *, saa * sbb - sab * sab AS det FROM m), o AS (SELECT doc_id, x.y AS label, my + ((chars - ma) * (sbb * ca - sab * cb) + (blanks - mb) * (saa * cb - sab * ca)) / det AS fit, 1 / n + ((chars - ma) * (chars - ma) * sbb - 2 * (chars - ma) * (blanks - mb) * sab + (blanks - mb) * (blanks - mb) * saa) / det AS h FROM x CROSS JOIN k), p AS (SELECT doc_id, CAST(CAST(label AS INTEGER) AS VARCHAR) AS grp, CASE WHEN label - (label - fit) / (1 - h) > 0.5 THEN '1' ELSE '0' END AS pred FROM o)"


@query("d10_plsda_loo_two_components", f"WITH {_LAB}, {_SUMS}, {_OLS} SELECT round(avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def d10t(spark, sf):
    return metrics.accuracy(PlsDa.fit(_labelled(spark, sf), 2).cross_validate()).select(F.round("accuracy", 6).alias("accuracy"))


@query("d10_plsda_folds", f"WITH {_LAB}, f AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) * 4 / count(*) OVER ()) AS INTEGER) AS fold FROM x), t AS (SELECT k.fold AS kf, " + ", ".join(f"sum({e}) AS {n}" for e, n in (("1", "n"), ("chars", "a"), ("blanks", "b"), ("chars * chars", "aa"), ("chars * blanks", "ab"), ("blanks * blanks", "bb"), ("f.y", "y"), ("chars * f.y", "wy"), ("blanks * f.y", "zy"))) + f" FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold), r AS (SELECT doc_id, f.y AS label, chars, blanks, fold, t.* FROM f JOIN t ON kf = fold), {_one_component('r')} SELECT * FROM p")
def d10f(spark, sf):
    return PlsDa.fit(_labelled(spark, sf), 1).cross_validate(4).select("doc_id", "grp", "pred")


@query("d11_vip_1comp", f"WITH {_LAB} SELECT 'chars' AS feature, round(sqrt(2) * abs(a) / sqrt(a * a + b * b), 6) AS vip FROM w UNION ALL SELECT 'blanks', round(sqrt(2) * abs(b) / sqrt(a * a + b * b), 6) FROM w")
def d11(spark, sf):
    return PlsDa.fit(_labelled(spark, sf), 1).vip().select(F.col("Feature").alias("feature"), F.round("VIP", 6).alias("vip"))


@query("d11_vip_from_tables", "WITH w AS (SELECT 'f' || i AS feature, c AS comp, ((i * 7 + c * 3) % 10) / 10.0 AS w FROM range(8) a(i) CROSS JOIN range(1, 3) b(c)), s AS (SELECT c AS comp, c * 2.5 AS ss FROM range(1, 3) b(c)) SELECT feature, round(sqrt(8 * sum(ss * w * w) / sum(ss)), 6) AS vip FROM w JOIN s USING (comp) GROUP BY feature")
def d11b(spark, sf):
    w = spark.range(8).select(F.concat(F.lit("f"), "id").alias("feature"), "id").crossJoin(spark.range(1, 3).select(F.col("id").alias("comp"))).select("feature", "comp", ((F.col("id") * 7 + F.col("comp") * 3) % 10 / 10.0).alias("w"))
    return vip_from_tables(w, spark.range(1, 3).select(F.col("id").alias("comp"), (F.col("id") * 2.5).alias("ss"))).select("feature", F.round("vip", 6).alias("vip"))


# Leave-one-out with one component after three ways of preprocessing.
_ZONES = """s AS (SELECT s_suppkey AS doc_id, CAST(s_nationkey % 2 AS DOUBLE) AS y, s_acctbal + CASE WHEN min(s_acctbal) OVER () < 0 THEN abs(min(s_acctbal) OVER ()) + 1 ELSE 0 END AS p, CAST(s_nationkey AS DOUBLE) AS q FROM supplier),
l AS (SELECT doc_id, y, ln(p + 1e-10) AS p, ln(q + 1e-10) AS q FROM s)"""
_WAYS = {
    "pareto": "SELECT doc_id, y, (p - avg(p) OVER ()) / sqrt(stddev_pop(p) OVER ()) AS chars, (q - avg(q) OVER ()) / sqrt(stddev_pop(q) OVER ()) AS blanks FROM l",
    "standard": "SELECT doc_id, y, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS chars, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS blanks FROM l",
    "raw": "SELECT doc_id, y, p AS chars, q AS blanks FROM s",
}


def _swept(name: str) -> str:
    ok = "CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END"
    return f"SELECT '{name}' AS \"Config_ID\", round(avg({ok}), 6) AS \"Accuracy\", round(stddev_pop({ok}), 6) AS \"Std\" FROM (WITH {_ZONES}, x AS ({_WAYS[name]}), {_SUMS}, {_LEFT_OUT}, {_one_component('r')} SELECT * FROM p)"


@query("b20_log", f"WITH {_M}, f AS ({_FRACTIONS}), k AS (SELECT count(*) AS n, string_agg(feature, ', ' ORDER BY CASE feature WHEN 'quantity' THEN 1 WHEN 'price' THEN 2 WHEN 'discount' THEN 3 ELSE 4 END) FILTER (WHERE f > 0.5) AS gone, count(*) FILTER (WHERE f <= 0.5) AS kept FROM f) SELECT 'start' AS step, 'features' AS metric, CAST(n AS VARCHAR) AS value FROM k UNION ALL SELECT 'missing filter', 'features', CAST(kept AS VARCHAR) FROM k UNION ALL SELECT 'missing filter', 'dropped', coalesce(gone, '') FROM k UNION ALL SELECT 'constant filter', 'features', CAST(kept AS VARCHAR) FROM k UNION ALL SELECT * FROM (VALUES ('missing filter', 'threshold', '0.5'), ('impute', 'mode', 'group_median'), ('impute', 'fill', '0.0'), ('constant filter', 'dropped', ''), ('shift', 'negatives', 'True'), ('transform', 'method', 'log'), ('scale', 'method', 'pareto')) v(step, metric, value)")
def b20(spark, sf):
    log = preprocess.Log()
    preprocess.preprocess(lineitem(spark, sf), preprocess.preset("metabolomics"), log)
    return log.frame(spark)


@query("b24_config_sweep", " UNION ALL ".join(map(_swept, _WAYS)))
def b24(spark, sf):
    layer = Layer.from_wide(read_table(spark, sf, "supplier").withColumn("zone", F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd")), "zone", sample_col="s_suppkey", features=["s_acctbal", "s_nationkey"])
    base = preprocess.preset("metabolomics")
    return workflows.config_sweep(layer, {"pareto": base, "standard": base.merged(scaling="standard"), "raw": base.merged(transform="none", scaling="none")}, 1).select("Config_ID", F.round("Accuracy", 6).alias("Accuracy"), F.round("Std", 6).alias("Std"))


_RULE = "p AS (SELECT l_returnflag AS grp, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END AS pred FROM lineitem)"


def rule(spark, sf) -> DataFrame:
    """A rule-based classifier, to have predictions both engines agree on."""
    return read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.when(F.col("l_quantity") > 30, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R").alias("pred"))


@query("d12_accuracy", f"WITH {_RULE} SELECT round(avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def d12(spark, sf):
    return metrics.accuracy(rule(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


_REPORT = f"""WITH {_RULE}, c AS (SELECT l.grp AS label, count(*) FILTER (WHERE p.grp = l.grp AND p.pred = l.grp) AS tp, count(*) FILTER (WHERE p.pred = l.grp) AS predicted, count(*) FILTER (WHERE p.grp = l.grp) AS support FROM (SELECT DISTINCT grp FROM p) l CROSS JOIN p GROUP BY l.grp),
r AS (SELECT label, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall, 2 * tp / nullif(predicted + support, 0) AS f1, support FROM c), a AS (SELECT avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END) AS v, count(*) AS n FROM p), u AS (
SELECT * FROM r UNION ALL SELECT 'accuracy', v, v, v, n FROM a UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT label, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM u"""


@query("d13_report", _REPORT)
def d13(spark, sf):
    return metrics.report(rule(spark, sf)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("d14_confusion", f"WITH {_RULE}, l AS (SELECT DISTINCT grp AS l FROM p) SELECT a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM p WHERE grp = a.l AND pred = b.l) AS n FROM l a CROSS JOIN l b")
def d14(spark, sf):
    return metrics.confusion(rule(spark, sf))


# --- E: validation ------------------------------------------------------------------------------------------

_SUP = "s AS (SELECT s_suppkey, CASE WHEN n_regionkey < 2 THEN 'low' ELSE 'high' END AS grp, s_acctbal / 1000 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def supplier_cells(spark, sf) -> DataFrame:
    s = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("sample_id"), F.when(F.col("n_regionkey") < 2, "low").otherwise("high").alias("grp"), F.lit("acctbal").alias("feature"), (F.col("s_acctbal") / 1000).alias("value"))


def _centroid_sql(fold: str, out: str) -> str:
    return f"""WITH {_SUP}, f AS (SELECT s_suppkey AS sample_id, grp, v, {fold} AS fold FROM s),
c AS (SELECT a.sample_id, a.grp, a.fold, b.grp AS cls, any_value(a.v) AS v, avg(b.v) AS mid FROM f a JOIN f b ON b.fold <> a.fold GROUP BY a.sample_id, a.grp, a.fold, b.grp),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round((v - mid) * (v - mid), 9), cls) AS k FROM c), p AS (SELECT sample_id, grp, fold, cls AS pred FROM r WHERE k = 1) {out}"""


_SCORES = "SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(*) AS n_splits FROM (SELECT fold, avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY fold)"


def _rounded_scores(pred: DataFrame) -> DataFrame:
    return resample.fold_scores(pred).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_splits")


@query("e01_cv_scores", _centroid_sql("s_suppkey % 5", _SCORES))
def e01(spark, sf):
    return _rounded_scores(resample.centroid_cv(supplier_cells(spark, sf).withColumn("fold", F.col("sample_id") % 5)))


@query("e02_loo_centroid", _centroid_sql("s_suppkey", "SELECT sample_id, grp, pred FROM p"))
def e02(spark, sf):
    return resample.centroid_cv(supplier_cells(spark, sf).withColumn("fold", F.col("sample_id"))).select("sample_id", "grp", "pred")


_STRAT = "(row_number() OVER (PARTITION BY grp ORDER BY (s_suppkey * 7919 + 42) % 10007, s_suppkey) - 1) % 5"


@query("e03_strat_kfold_centroid", _centroid_sql(_STRAT, "SELECT sample_id, grp, CAST(fold AS INTEGER) AS fold, pred FROM p"))
def e03(spark, sf):
    cells = supplier_cells(spark, sf)
    return resample.centroid_cv(stratified_folds(cells, F.col("sample_id"), "grp", 5)).select("sample_id", "grp", "fold", "pred")


ROUNDS = 60
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_CELLS = f"{_SUP}, f AS (SELECT s_suppkey AS sample_id, grp, v, s_suppkey % 5 AS fold FROM s)"
_PERM = f"""{_CELLS}, ev AS (SELECT sample_id, grp, t FROM f CROSS JOIN range({ROUNDS + 1}) r(t)),
pe AS (SELECT t, sample_id, row_number() OVER (PARTITION BY t ORDER BY sample_id) AS i FROM ev), pd AS (SELECT t, grp, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN t > 0 THEN {_HASH.format("t || ':' || sample_id")} ELSE 0 END, sample_id) AS i FROM ev),
pf AS (SELECT t, sample_id, pd.grp, v, fold FROM pe JOIN pd USING (t, i) JOIN (SELECT sample_id, v, fold FROM f) USING (sample_id)),
pc AS (SELECT a.t, a.sample_id, a.grp, b.grp AS cls, any_value(a.v) AS v, avg(b.v) AS mid FROM pf a JOIN pf b ON a.t = b.t AND b.fold <> a.fold GROUP BY 1, 2, 3, 4),
pr AS (SELECT *, row_number() OVER (PARTITION BY t, sample_id ORDER BY round((v - mid) * (v - mid), 9), cls) AS k FROM pc), q AS (SELECT t, avg(CASE WHEN grp = cls THEN 1.0 ELSE 0.0 END) AS score FROM pr WHERE k = 1 GROUP BY t)"""
_DRAWS = """n AS (SELECT count(*) AS n FROM ids), rk AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM ids), dr AS (SELECT t, {hash} % (SELECT n FROM n) AS i, count(*) AS times FROM rk CROSS JOIN range(1, {rounds}) r(t) GROUP BY 1, 2),
ti AS (SELECT t, sample_id, coalesce(times, 0) AS times FROM rk CROSS JOIN range(1, {rounds}) r(t) LEFT JOIN dr USING (t, i))""".format(hash=_HASH.format("t || ':' || i"), rounds=ROUNDS + 1)
_BOOT = f"""{_CELLS}, ids AS (SELECT sample_id FROM f), {_DRAWS}, bm AS (SELECT t, grp AS cls, sum(v * times) / sum(times) AS mid FROM f JOIN ti USING (sample_id) WHERE times > 0 GROUP BY 1, 2),
br AS (SELECT ti.t, sample_id, grp, cls, row_number() OVER (PARTITION BY ti.t, sample_id ORDER BY round((v - mid) * (v - mid), 9), cls) AS k FROM f JOIN ti USING (sample_id) JOIN bm ON bm.t = ti.t WHERE times = 0), q AS (SELECT t, avg(CASE WHEN grp = cls THEN 1.0 ELSE 0.0 END) AS score FROM br WHERE k = 1 GROUP BY t)"""
_STAB = f"""{_EMB}, ids AS (SELECT vec_id AS sample_id FROM embeddings), {_DRAWS}, mo AS (SELECT t, i, sum(times) AS n, sum(times * v) AS s, sum(times * v * v) AS ss FROM e JOIN ti ON sample_id = vec_id WHERE times > 0 GROUP BY 1, 2),
se AS (SELECT t, 'f' || i AS f, row_number() OVER (PARTITION BY t ORDER BY round(ss / n - (s / n) * (s / n), 9) DESC, 'f' || i) AS k FROM mo)"""


def _folded_cells(spark, sf) -> DataFrame:
    return supplier_cells(spark, sf).withColumn("fold", F.col("sample_id") % 5)


@query("e05_perm_pvalue", f"WITH {_PERM}, z AS (SELECT (SELECT score FROM q WHERE t = 0) AS true_score), y AS (SELECT score, true_score FROM q CROSS JOIN z WHERE t > 0) SELECT round((count(*) FILTER (WHERE score >= true_score) + 1) / (count(*) + 1), 6) AS p_value, round(avg(score), 6) AS perm_mean, round(stddev_pop(score), 6) AS perm_std, count(*) AS n_permutations, (count(*) FILTER (WHERE score >= true_score) + 1) / (count(*) + 1) < 0.05 AS significant FROM y")
def e05(spark, sf):
    scores = cut(resample.permutation_scores(_folded_cells(spark, sf), ROUNDS))
    true = scores.where("round = 0").first()["score"]
    return resample.permutation_p(scores.where("round > 0"), true).select(F.round("p_value", 6).alias("p_value"), F.round("perm_mean", 6).alias("perm_mean"), F.round("perm_std", 6).alias("perm_std"), "n_permutations", "significant")


@query("e10_label_permutation", f"WITH {_PERM} SELECT CAST(t AS INTEGER) AS round, sample_id, grp FROM pf")
def e10(spark, sf):
    return resample.permuted_labels(supplier_cells(spark, sf), ROUNDS)


@query("e06_boot_ci", f"WITH {_BOOT} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.025), 6) AS ci_lower, round(quantile_cont(score, 0.975), 6) AS ci_upper, count(*) AS n_bootstrap FROM q")
def e06(spark, sf):
    return resample.bootstrap_interval(resample.bootstrap_scores(_folded_cells(spark, sf), ROUNDS)).select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")], "n_bootstrap")


@query("e07_stability", f"WITH {_STAB} SELECT f AS \"Feature\", round(count(*) / {ROUNDS}, 6) AS \"Selection_Frequency\", count(*) AS \"Times_Selected\" FROM se WHERE k <= 20 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
def e07(spark, sf):
    cells = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "v")).select("sample_id", F.concat(F.lit("f"), "i").alias("feature"), F.col("v").cast("double").alias("value"))
    return resample.stability(resample.variance_selections(cells, ROUNDS, 20), ROUNDS, 20).select("Feature", F.round("Selection_Frequency", 6).alias("Selection_Frequency"), "Times_Selected")


def _small_vectors(spark, sf) -> DataFrame:
    one = supplier_cells(spark, sf)
    return one.select("sample_id", "grp", F.array("value", (F.col("sample_id") % 7).cast("double")).alias("x"))


@query("e05_permutation_test")
def e05t(spark, sf):
    return resample.permutation_test(_small_vectors(spark, sf), resample.CentroidModel, strategy="stratified")[0]


@query("e06_bootstrap")
def e06t(spark, sf):
    return resample.bootstrap_interval(resample.bootstrap(_small_vectors(spark, sf), resample.CentroidModel))


@query("e07_stability_rounds")
def e07t(spark, sf):
    v = embeddings(spark, sf)
    return resample.stability(resample.stability_rounds(v.vectors(), list(v.features), n_rounds=100), 100)


@query("e08_compare_models")
def e08(spark, sf):
    return resample.compare_models(_small_vectors(spark, sf), {"centroid": resample.CentroidModel, "plsda": resample.PlsModel})


@query("e09_balanced_accuracy", f"WITH {_RULE} SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY grp)")
def e09(spark, sf):
    return metrics.balanced_accuracy(rule(spark, sf)).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("e15_stat_report", f"WITH {_L} SELECT count(*) AS n_samples, CAST(5 AS BIGINT) AS total_features, count(DISTINCT grp) AS n_classes, round(5 / count(*), 9) AS ratio, 5 > count(*) AS high_risk FROM o WHERE sample_id IN (SELECT sample_id FROM k)")
def e15(spark, sf):
    joined = block_vectors(spark, sf)
    return workflows.limitations(joined, 5).withColumn("ratio", F.round("ratio", 9))


# --- F: multi-layer models ----------------------------------------------------------------------------------

_BF = {"orders": ["total"], "lines": ["qty", "price", "lines"], "customer": ["acct"]}


# Standardised blocks, so that the linked blocks' scales do not decide; the model itself only centres.
_Z = f"{_L}, zc AS (SELECT layer, sample_id, grp, feature, value FROM cells WHERE sample_id IN (SELECT sample_id FROM k)), z AS (SELECT sample_id, first_value(grp) OVER (PARTITION BY sample_id ORDER BY layer DESC) AS grp, layer AS block, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM zc WINDOW w AS (PARTITION BY layer, feature))"
_MB = f"WITH RECURSIVE {_Z}, {sql_models.multiblock('z', [('orders', 'bo', ['total']), ('lines', 'bl', ['qty', 'price', 'lines']), ('customer', 'bc', ['acct'])])}"


def scaled_blocks(spark, sf) -> DataFrame:
    """The aligned blocks, one row per sample, each feature standardised."""
    cells = integrate.concatenate(block_cells(spark, sf), BLOCKS)
    st = cells.groupBy("layer", "feature").agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_s"))
    cells = cells.join(F.broadcast(st), ["layer", "feature"]).withColumn("value", (F.col("value") - F.col("_a")) / F.col("_s"))  # one row per feature
    x = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == b, F.struct("feature_ix", "value")))), lambda s: s["value"]).alias(b)
    return cut(cells.groupBy("sample_id", "grp").agg(*[x(b) for b in BLOCKS]))  # the fit and every block's variates read it


def multiblock_model(spark, sf) -> diablo.Diablo:
    return diablo.Diablo.fit(scaled_blocks(spark, sf), _BF, 1)


@query("f01_diablo", f"{_MB} SELECT block, feature, CAST(1 AS INTEGER) AS comp, round(loading, 5) + 0.0 AS loading FROM lo")
def f01(spark, sf):
    return multiblock_model(spark, sf).loadings().withColumn("loading", F.round("loading", 5) + 0.0)


@query("f07_variates", f"{_MB} SELECT sample_id, grp, block, round(score, 4) + 0.0 AS score FROM va")
def f07(spark, sf):
    return multiblock_model(spark, sf).variates().select("sample_id", "grp", "block", (F.round("score", 4) + 0.0).alias("score"))


@query("f17_diablo_predict", f"{_MB}, ce AS (SELECT block, grp AS cls, avg(score) AS mid FROM va GROUP BY 1, 2), di AS (SELECT sample_id, grp, va.block, cls, (score - mid) * (score - mid) AS d FROM va JOIN ce ON va.block = ce.block), vo AS (SELECT *, row_number() OVER (PARTITION BY sample_id, block ORDER BY d, cls) AS r FROM di), su AS (SELECT sample_id, grp, cls, count(*) FILTER (WHERE r = 1) AS votes, sum(d) AS d FROM vo GROUP BY 1, 2, 3) SELECT grp, cls AS pred, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, d, cls) AS r FROM su) WHERE r = 1 GROUP BY 1, 2")
def f17(spark, sf):
    return multiblock_model(spark, sf).predict().groupBy("grp", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("f02_design", "SELECT a.n AS block_i, b.n AS block_j, CASE WHEN a.n = b.n THEN 0.0 ELSE 0.1 END AS c FROM (VALUES ('orders'), ('lines'), ('customer')) a(n) CROSS JOIN (VALUES ('orders'), ('lines'), ('customer')) b(n)")
def f02(spark, sf):
    return diablo.design_table(spark, list(BLOCKS))


@query("f03_keepx_rule", "SELECT p_size, CAST(count(*) AS BIGINT) AS n, CAST(CASE WHEN p_size * 6 < 10 THEN p_size * 6 WHEN p_size * 6 < 50 THEN least(3, p_size * 6) WHEN p_size * 6 < 200 THEN least(5, p_size * 6) ELSE least(greatest(10, floor(9 * 1.5)), p_size * 6) END AS INTEGER) AS keepx FROM part GROUP BY p_size")
def f03(spark, sf):
    return read_table(spark, sf, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).withColumn("keepx", diablo.keep_rule_column(F.col("p_size") * 6, F.lit(9)))


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY {by} DESC, feature) AS k FROM lo WHERE loading <> 0)"


@query("f08_selected_features", f"{_MB} SELECT block, feature, round(loading, 5) + 0.0 AS loading, loading > 1 AS important FROM lo WHERE loading <> 0")
def f08(spark, sf):
    return diablo.selected_features(multiblock_model(spark, sf).loadings()).select("block", "feature", (F.round("loading", 5) + 0.0).alias("loading"), "important")


@query("f10_top_per_block", f"{_MB}, {_RANKED.format(by='loading')} SELECT block, feature, round(loading, 5) + 0.0 AS loading, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 2")
def f10(spark, sf):
    return diablo.top_per_block(diablo.selected_features(multiblock_model(spark, sf).loadings()), 2).select("block", "feature", (F.round("loading", 5) + 0.0).alias("loading"), "rank")


def variates(spark, sf) -> DataFrame:
    return multiblock_model(spark, sf).variates()


@query("f11_block_corr", f"{_MB} SELECT a.block AS block_i, b.block AS block_j, round(corr(a.score, b.score), 5) + 0.0 AS corr FROM va a JOIN va b ON a.sample_id = b.sample_id GROUP BY 1, 2")
def f11(spark, sf):
    return diablo.block_correlations(variates(spark, sf)).select("block_i", "block_j", (F.round("corr", 5) + 0.0).alias("corr"))


@query("f12_consensus", f"{_MB} SELECT sample_id, round(avg(score), 6) AS score FROM va GROUP BY sample_id")
def f12(spark, sf):
    return diablo.consensus(variates(spark, sf)).select("sample_id", F.round("score", 6).alias("score"))


@query("f13_arrows", f"{_MB} SELECT sample_id, block, round(score, 6) AS \"start\", round(avg(score) OVER (PARTITION BY sample_id), 6) AS \"end\" FROM va")
def f13(spark, sf):
    return diablo.arrows(variates(spark, sf)).select("sample_id", "block", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _forest(spark, sf, kind, **kw) -> DataFrame:
    v = embeddings(spark, sf)
    rows = v.vectors().withColumn("fold", F.pmod("vec_id", F.lit(5)))
    return metrics.accuracy(Classifier(kind, **kw).fit(rows.where("fold > 0"), list(v.features)).predict(rows.where("fold = 0")))


@query("f14_random_forest")
def f14(spark, sf):
    return _forest(spark, sf, "random_forest", trees=50)


@query("f15_svm")
def f15(spark, sf):
    return _forest(spark, sf, "svm")


@query("f16_logistic")
def f16(spark, sf):
    return _forest(spark, sf, "logistic")


@query("f18_importance")
def f18(spark, sf):
    v = embeddings(spark, sf)
    return Classifier("random_forest", trees=20).fit(v.vectors(), list(v.features)).importances(20)


def _halves(spark, sf) -> tuple[DataFrame, dict[str, list[str]]]:
    """The embeddings as two blocks of 32 dimensions."""
    df = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("grp"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return df.select("sample_id", "grp", F.slice("e", 1, 32).alias("low"), F.slice("e", 33, 32).alias("high")), {"low": [f"f{i}" for i in range(32)], "high": [f"f{i}" for i in range(32, 64)]}


@query("e11_diablo_loo_error")
def e11(spark, sf):
    return diablo_validation.loo_predictions(*_halves(spark, sf), 1).agg((1 - F.avg((F.col("grp") == F.col("pred")).cast("double"))).alias("overall_error"))


@query("e12_diablo_permutation")
def e12(spark, sf):
    return diablo_validation.permutation_error_test(*_halves(spark, sf), n_components=1, strategy="stratified")


@query("f04_keepx_tuning")
def f04(spark, sf):
    return diablo_validation.tune_keep(*_halves(spark, sf), 1)


@query("f19_weighted_concatenation")
def f19(spark, sf):
    blocks, names = _halves(spark, sf)
    return metrics.accuracy(WeightedConcatenation({"low": 2.0}, "random_forest", 20).fit(blocks, names).predict(blocks))


# --- I: plot data -------------------------------------------------------------------------------------------


@query("i12_circos_edges", f"{_MB}, cc AS (SELECT a.block AS block_i, b.block AS block_j, corr(a.score, b.score) AS corr FROM va a JOIN va b ON a.sample_id = b.sample_id AND a.block < b.block GROUP BY 1, 2) SELECT block_i, block_j, round(corr, 6) AS corr, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS sign FROM cc WHERE abs(corr) >= 0.0001")
def i12(spark, sf):
    return plotdata.circos_edges(diablo.block_correlations(variates(spark, sf)), 0.0001).select("block_i", "block_j", F.round("corr", 6).alias("corr"), "sign")


@query("i14_loading_heatmap", f"{_MB}, {_RANKED.format(by='abs(loading)')} SELECT feature, " + ", ".join(f"round(coalesce(avg(CASE WHEN block = '{b}' THEN loading END), 0), 5) + 0.0 AS {b}" for b in BLOCKS) + " FROM r WHERE k <= 2 GROUP BY feature")
def i14(spark, sf):
    return plotdata.loading_heatmap(multiblock_model(spark, sf).loadings(), 2).select("feature", *[(F.round(b, 5) + 0.0).alias(b) for b in BLOCKS])


@query("i15_importance_comparison", f"{_MB}, {_RANKED.format(by='abs(loading)')} SELECT block, feature, round(loading, 5) + 0.0 AS loading, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 2")
def i15(spark, sf):
    return plotdata.importance_comparison(multiblock_model(spark, sf).loadings(), 2).withColumn("loading", F.round("loading", 5) + 0.0)


@query("i13_samples_enhanced", f"{_MB} SELECT sample_id, block, round(score, 6) AS score FROM va UNION ALL SELECT sample_id, 'consensus', round(avg(score), 6) FROM va GROUP BY sample_id")
def i13(spark, sf):
    v = variates(spark, sf)
    return v.select("sample_id", "block", F.round("score", 6).alias("score")).unionByName(diablo.consensus(v).select("sample_id", F.lit("consensus").alias("block"), F.round("score", 6).alias("score")))


@query("i16_correlation_matrix", f"{_MB} SELECT a.block AS block_i, b.block AS block_j, round(corr(a.score, b.score), 2) + 0.0 AS corr FROM va a JOIN va b ON a.sample_id = b.sample_id GROUP BY 1, 2")
def i16(spark, sf):
    return diablo.block_correlations(variates(spark, sf)).select("block_i", "block_j", (F.round("corr", 2) + 0.0).alias("corr"))


@query("i17_overview", f"WITH {_L} SELECT layer, grp, count(DISTINCT sample_id) AS samples, (SELECT count(DISTINCT feature) FROM cells c2 WHERE c2.layer = c1.layer) AS features FROM cells c1 GROUP BY layer, grp")
def i17(spark, sf):
    return plotdata.sample_overview(block_cells(spark, sf))


@query("i18_missing_heatmap", f"WITH {_M} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, count(*) AS n FROM m" for c in FEATURES))
def i18(spark, sf):
    return plotdata.missing_cells(lineitem(spark, sf).long("l_orderkey")).groupBy("feature").agg(F.sum("is_missing").alias("n_missing"), F.count(F.lit(1)).alias("n"))


@query("i18_missing_percent", f"WITH {_M} SELECT 'lineitem' AS layer, round(100.0 * (" + " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in FEATURES) + ") / (4 * count(*)), 6) AS percent_missing FROM m")
def i18p(spark, sf):
    return plotdata.missing_percent(lineitem(spark, sf).long("l_orderkey")).withColumn("percent_missing", F.round("percent_missing", 6))


_HIST = "h AS (SELECT l_returnflag AS grp, 'quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'size', CAST(l_linenumber AS DOUBLE) FROM lineitem), b AS (SELECT feature, grp, min(v) AS lo, max(v) AS hi FROM h GROUP BY feature, grp)"


@query("i19_histograms", f"WITH {_HIST} SELECT h.feature, h.grp, CAST(coalesce(least(floor((v - lo) * 10 / nullif(hi - lo, 0)), 9), 0) AS INTEGER) AS bin, count(*) AS n FROM h JOIN b ON h.feature = b.feature AND h.grp = b.grp GROUP BY 1, 2, 3")
def i19(spark, sf):
    df = read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("size"))
    return plotdata.histograms(Layer(df, "grp", ("quantity", "size"), ("l_orderkey",)).long(), 2)


_VC = f"{_MB}, vc AS (SELECT block, feature, corr(value, score) AS r FROM z JOIN va USING (sample_id, block) GROUP BY 1, 2)"


def _variable_correlations(spark, sf) -> DataFrame:
    blocks = scaled_blocks(spark, sf)
    cells = None
    for b, names in _BF.items():
        one = blocks.select("sample_id", F.lit(b).alias("block"), F.posexplode(b).alias("at", "value")).withColumn("feature", F.get(F.array(*map(F.lit, names)), F.col("at")))
        cells = one if cells is None else cells.unionByName(one)
    return plotdata.variable_correlations(cells, diablo.Diablo.fit(blocks, _BF, 1).variates())


@query("i24_variable_correlations", f"{_VC} SELECT block, feature, round(r, 5) + 0.0 AS corr FROM vc")
def i24(spark, sf):
    return _variable_correlations(spark, sf).select("block", "feature", (F.round("corr", 5) + 0.0).alias("corr"))


@query("i24_similarity_edges", f"{_VC} SELECT a.block AS block_i, a.feature AS feature_i, b.block AS block_j, b.feature AS feature_j, round(a.r * b.r, 5) + 0.0 AS similarity FROM vc a JOIN vc b ON a.block < b.block WHERE abs(a.r * b.r) >= 0.3")
def i24e(spark, sf):
    return plotdata.similarity_edges(_variable_correlations(spark, sf)).withColumn("similarity", F.round("similarity", 5) + 0.0)


# The figures' data of one layer.


@query("i01_scree", f"{_PCS}, x AS (" + " UNION ALL ".join(f"SELECT {a} AS a, l FROM pc{a}" for a in range(1, 6)) + ") SELECT 'PC' || a AS pc, round(100 * l / t, 5) AS variance, 100 * sum(l) OVER (ORDER BY a) / t >= 80 AS over_line FROM x CROSS JOIN total")
def i01(spark, sf):
    return plotdata.scree(Pca.fit(embeddings(spark, sf), 5).variance()).select(F.col("PC").alias("pc"), F.round("Variance_Explained", 5).alias("variance"), "over_line")


_SC = "mu AS (SELECT i, avg(v) AS mu FROM e GROUP BY i), sc AS (SELECT vec_id, grp, " + ", ".join(f"sum((e.v - mu) * (SELECT v FROM pc{a})[e.i + 1]) AS s{a}" for a in (1, 2)) + " FROM e JOIN mu USING (i) GROUP BY vec_id, grp)"


@query("i02_pca_scores", f"{_PCS}, {_SC} SELECT vec_id, grp, round(s1, 5) + 0.0 AS x, round(s2, 5) + 0.0 AS y FROM sc")
def i02(spark, sf):
    return plotdata.score_points(Pca.fit(embeddings(spark, sf), 2).scores()).select("vec_id", "grp", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"])


@query("i03_pca_loadings", f"{_PCS}, x AS (SELECT 'f' || (i - 1) AS f, v[i] AS l FROM pc2 CROSS JOIN range(1, 65) r(i)) SELECT f AS feature, round(l, 5) + 0.0 AS loading, l >= 0 AS positive FROM x ORDER BY abs(l) DESC, f LIMIT 10")
def i03(spark, sf):
    top = plotdata.loading_bars(Pca.fit(embeddings(spark, sf), 2).top_loadings(2, 10))
    return top.select(F.col("Feature").alias("feature"), (F.round("Loading", 5) + 0.0).alias("loading"), "positive")


@query("i04_biplot", f"{_PCS}, {_SC}, big AS (SELECT 0.7 * max(greatest(abs(s1), abs(s2))) AS k FROM sc), lo AS (SELECT 'f' || (i - 1) AS f, (SELECT v FROM pc1)[i] AS lx, (SELECT v FROM pc2)[i] AS ly FROM range(1, 65) r(i)), ra AS (SELECT *, row_number() OVER (ORDER BY abs(lx) DESC, f) AS rx, row_number() OVER (ORDER BY abs(ly) DESC, f) AS ry FROM lo) SELECT f AS feature, round(lx * k, 5) + 0.0 AS x, round(ly * k, 5) + 0.0 AS y FROM ra CROSS JOIN big WHERE rx <= 10 OR ry <= 10")
def i04(spark, sf):
    m = Pca.fit(embeddings(spark, sf), 2)
    return plotdata.biplot_arrows(m.loadings_table(), m.scores()).select("feature", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"])


@query("i05_plsda_scores", f"{_PLS}, {_LV} SELECT vec_id, grp, round(l1, 5) + 0.0 AS x, round(l2, 5) + 0.0 AS y FROM lv")
def i05(spark, sf):
    return plotdata.score_points(PlsDa.fit(embeddings(spark, sf), 2).scores(), "lv").select("vec_id", "grp", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"])


@query("i06_plsda_loadings", f"{_PLS}, x AS (SELECT 'f' || (i - 1) AS f, w1.p[i] AS l FROM w1 CROSS JOIN range(1, 65) r(i)) SELECT f AS feature, round(l, 5) + 0.0 AS loading, l >= 0 AS positive FROM x ORDER BY abs(l) DESC, f LIMIT 15")
def i06(spark, sf):
    top = plotdata.loading_bars(top_loadings(PlsDa.fit(embeddings(spark, sf), 2).loadings_table(), 1, 15))
    return top.select(F.col("Feature").alias("feature"), (F.round("Loading", 5) + 0.0).alias("loading"), "positive")


@query("i07_vip_bars", f"{_PLS}, {_VIP} SELECT f AS feature, round(vip, 6) AS vip, vip > 1 AS important FROM vip ORDER BY vip DESC, f LIMIT 20")
def i07(spark, sf):
    return PlsDa.fit(embeddings(spark, sf), 2).vip().limit(20).select(F.col("Feature").alias("feature"), F.round("VIP", 6).alias("vip"), F.col("Important").alias("important"))


_CP = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


@query("i20_corr_network", f"WITH {_P}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, corr({a}, {b}) AS r FROM m" for a, b in _CP) + ") SELECT feature_i, feature_j, round(r, 6) AS r FROM c WHERE abs(r) >= 0.7")
def i20(spark, sf):
    return plotdata.correlation_network(lineitem(spark, sf, PLAIN).df, list(FEATURES)).withColumn("r", F.round("r", 6))


_VOL = "t AS (SELECT 'p' || p_partkey AS feature, p_retailprice / 1000 AS fold_change, (p_partkey % 100) / 1000.0 AS p_value FROM part), x AS (SELECT *, log2(fold_change + 1e-10) AS log2_fc, -log10(p_value + 1e-10) AS neg_log10_p FROM t)"


@query("i21_volcano", f"WITH {_VOL} SELECT feature, round(log2_fc, 6) AS log2_fc, round(neg_log10_p, 6) AS neg_log10_p, abs(log2_fc) > log2(1.5) AND p_value < 0.05 AS significant, row_number() OVER (ORDER BY round(neg_log10_p * abs(log2_fc), 9) DESC, feature) <= 10 AS labelled FROM x")
def i21(spark, sf):
    t = read_table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("feature"), (F.col("p_retailprice") / 1000).alias("fold_change"), ((F.col("p_partkey") % 100) / 1000.0).alias("p_value"))
    return plotdata.volcano(t).select("feature", F.round("log2_fc", 6).alias("log2_fc"), F.round("neg_log10_p", 6).alias("neg_log10_p"), "significant", "labelled")


_ELL = "p AS (SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), g AS (SELECT grp, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p GROUP BY grp HAVING count(*) > 2), e AS (SELECT *, (a + d) / 2 AS h, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS o FROM g)"


@query("i22_ellipses", f"WITH {_ELL} SELECT grp, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(2 * sqrt(-2 * ln(0.05) * (h + o)), 4) AS major, round(2 * sqrt(-2 * ln(0.05) * greatest(h - o, 0)), 4) AS minor, round(degrees(atan2(h + o - a, b)), 4) AS angle FROM e")
def i22(spark, sf):
    p = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return plotdata.ellipses(p).select("grp", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "major", "minor", "angle")])


@query("i23_performance", _centroid_sql("s_suppkey % 5", "SELECT 'centroid' AS \"Method\", round(avg(s), 6) AS \"Accuracy\", round(avg(s) - stddev_pop(s), 6) AS low, round(avg(s) + stddev_pop(s), 6) AS high FROM (SELECT fold, avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY fold)"))
def i23(spark, sf):
    got = resample.fold_scores(resample.centroid_cv(supplier_cells(spark, sf).withColumn("fold", F.col("sample_id") % 5)))
    return plotdata.performance(got.select(F.lit("centroid").alias("Method"), F.col("mean").alias("Accuracy"), F.col("std").alias("Std"))).select("Method", *[F.round(c, 6).alias(c) for c in ("Accuracy", "low", "high")])


# --- A: scans and sinks --------------------------------------------------------------------------------------


@query("a01_csv_layer", "SELECT s_name AS id, CAST(s_nationkey AS VARCHAR) AS grp, round(s_acctbal, 2) AS acctbal, s_suppkey AS suppkey FROM supplier")
def a01(spark, sf):
    """The table written by the result sink and read back as a layer."""
    out = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    source = read_table(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("Groups"), "s_acctbal", "s_suppkey")
    write_results({"supplier": source}, out)
    layer = read_csv_layer(spark, f"{out}/supplier")
    return layer.df.select("id", F.substring("Groups", 2, 9).alias("grp"), F.round("s_acctbal", 2).alias("acctbal"), F.col("s_suppkey").cast("bigint").alias("suppkey"))


# --- J, streaming -------------------------------------------------------------------------------------------


# The report of two features: two components explain all of them, and two discriminant components are least squares.
_J05 = f"""WITH {_LAB}, raw AS (SELECT doc_id, y, ln(chars + 1e-10) AS chars, ln(blanks + 1e-10) AS blanks FROM x), sc AS (SELECT doc_id, y, (chars - avg(chars) OVER ()) / sqrt(stddev_pop(chars) OVER ()) AS chars, (blanks - avg(blanks) OVER ()) / sqrt(stddev_pop(blanks) OVER ()) AS blanks FROM raw),
{_SUMS.replace('FROM x', 'FROM sc')}, {_OLS.replace('FROM x CROSS', 'FROM sc AS x CROSS')}, v AS (SELECT ca * ca / (ca * ca + cb * cb) AS w, (ca * ca + cb * cb) * (ca * ca + cb * cb) / (ca * ca * saa + 2 * ca * cb * sab + cb * cb * sbb) AS s1, (ca * ca * sbb - 2 * ca * cb * sab + cb * cb * saa) / det AS s FROM k),
f AS (SELECT 'chars' AS feature, sqrt(2 * (w * s1 + (1 - w) * (s - s1)) / s) AS vip FROM v UNION ALL SELECT 'blanks', sqrt(2 * ((1 - w) * s1 + w * (s - s1)) / s) FROM v)
SELECT 0 AS ord, 'documents' AS section, 'PC1+PC2 variance (%)' AS key, '100.0' AS value UNION ALL SELECT 1, 'documents', 'cross-validated accuracy (%)', CAST(round(100 * avg(CASE WHEN grp = pred THEN 1.0 ELSE 0.0 END), 1) AS VARCHAR) FROM p
UNION ALL SELECT 2, 'documents', 'features with VIP > 1', CAST(count(*) FILTER (WHERE vip > 1) AS VARCHAR) FROM f UNION ALL SELECT 3, 'documents', 'top feature', arg_max(feature, vip) FROM f"""


@query("j05_single_workflow", _J05)
def j05(spark, sf):
    w = workflows.SingleLayerWorkflow("metabolomics")
    w.run_full_analysis(_labelled(spark, sf), 2)
    return workflows.summary_report({"documents": w.results})


@query("j10_multi_workflow")
def j10(spark, sf):
    w = workflows.MultiLayerWorkflow()
    cells = block_cells(spark, sf)
    for b in BLOCKS:
        wide = cells.where(F.col("layer") == b).groupBy("sample_id", "grp").pivot("feature", _BF[b]).agg(F.max("value"))
        w.add_layer(b, Layer.from_wide(wide, "grp", sample_col="sample_id", features=_BF[b], name=b), "metabolomics", "sample_id")
    w.prepare_integration()
    w.run_diablo(1)
    w.run_concatenation("logistic", 2)
    return w.compare_methods()


@query("s01_windowed_profile", "SELECT date_trunc('day', ts) AS \"start\", event_type, count(*) AS n, CAST(count(*) - count(value) AS BIGINT) AS n_missing, " + near_sql("avg(value)") + " AS mean, " + near_sql("var_pop(value)", 3) + " AS variance FROM events GROUP BY 1, 2")
def s01(spark, sf):
    out = windowed_profile(read_table(spark, sf, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "n_missing", near("mean").alias("mean"), near("variance", 3).alias("variance"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The preprocessing pipeline of the lineitem layer, summarised by label and feature."""
    return QUERIES["b19_pipeline_metabolomics"](spark, sf)
