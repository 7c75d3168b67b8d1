"""Plans for large tables give what the plans for small ones give; workflows, scores and layers beyond the queries."""

import os
import statistics as st
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwise.functions import metrics
from blockwise.operators import diablo_validation, integrate, long_form, preprocess, ranks, resample
from blockwise.operators.layer import Layer, VectorLayer, cut
from blockwise.plans import plotdata, workflows
from blockwise.sources.layers import read_csv_layer
from blockwise.streaming.profile import windowed_profile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_medians_by_counts_equal_aggregates(spark):
    r = np.random.default_rng(0)
    rows = [("a", float(v)) for v in np.exp(r.normal(0, 4, 301))] + [("b", float(v)) for v in r.integers(0, 3, 200)] + [("c", 5.0)] + [("d", None)] * 3 + [("e", 1.0), ("e", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    want = {g: st.median([v for h, v in rows if h == g and v is not None]) if g != "d" else None for g in "abcde"}
    for limits in ({}, {"state_rows": 20, "buckets": 8}):
        got = {x["g"]: x["median"] for x in ranks.group_medians(df, ["g"], **limits).collect()}
        assert got == {g: pytest.approx(v) if v is not None else None for g, v in want.items()}


def test_imputation_by_counts_equals_aggregates(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(f"s{i:03d}", "ab"[i % 2], float(v[0]) if i % 3 else None, float(v[1]) if i % 7 else None) for i, v in enumerate(r.normal(5, 2, (90, 2)))]
    lay = Layer.from_wide(spark.createDataFrame(rows, "id string, g string, x double, y double"), "g", sample_col="id")
    modes = (("group_median", 0.0), ("conservative", 0.0), ("proteomics", None))
    take = lambda out: [tuple(q) for q in out.df.select("id", "x", "y").orderBy("id").collect()]
    want = [take(preprocess.impute(lay, *m)) for m in modes]
    monkeypatch.setattr(preprocess, "STATE_ROWS", 5)
    monkeypatch.setattr(preprocess, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(preprocess, "group_medians", lambda c, k: ranks.group_medians(c, k, state_rows=5, buckets=4))
    for m, w in zip(modes, want, strict=True):
        for a, b in zip(take(preprocess.impute(lay, *m)), w, strict=True):
            assert a == pytest.approx(b)


def test_row_numbers_and_stratified_folds(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 1009).alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g")).repartition(5)
    got = ranks.row_numbers(df, ["k"], "n").orderBy("k").collect()
    assert [x["n"] for x in got] == list(range(500))
    rows = [(x["k"], x["g"]) for x in df.collect()]
    want = {}
    for g in "ab":
        for i, k in enumerate(sorted((k for k, h in rows if h == g), key=lambda k: ((k * 7919 + 42) % 10007, k))):
            want[k] = i % 4
    assert {x["k"]: x["fold"] for x in ranks.stratified_folds(df, F.col("k"), "g", 4).collect()} == want


def test_cut_keeps_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double").toDF("x (nM), y=1;", "T`ick")
    assert cut(df).columns == df.columns and tuple(cut(df).first()) == (1, 2.0)


def test_correlations_equal_pairwise_aggregates(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 4)) @ r.normal(size=(4, 4))
    df = spark.createDataFrame([(*map(float, v), 3.0) for v in x], "a double, b double, c double, d double, e double")
    got = {(q["feature_i"], q["feature_j"]): q["r"] for q in plotdata.correlation_pairs(df, list("abcde")).collect()}
    assert len(got) == 15
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"[i:], start=i):
            assert got[a, b] == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1])
    assert got["a", "e"] is None and got["e", "e"] is None
    with pytest.raises(ValueError, match="select features"):
        plotdata.correlation_pairs(df, [f"f{i}" for i in range(2001)])


def test_leave_one_out_has_a_bound():
    from blockwise.operators.statistics import refuse_loo

    refuse_loo(1000, 1000)
    with pytest.raises(ValueError, match="folds"):
        refuse_loo(1e9, 2000)


def _vector_and_wide(spark, rows, names):
    df = spark.createDataFrame(rows, "id string, g string, " + ", ".join(f"{n} double" for n in names))
    return Layer.from_wide(df, "g", sample_col="id"), VectorLayer.from_wide(df, "g", names)


def test_both_forms_agree_on_flat_and_missing_layers(spark):
    names = ["x", "y"]
    flat = [(f"s{i}", "ab"[i % 2], 4.0, 4.0) for i in range(6)]
    wide, vector = _vector_and_wide(spark, flat, names)
    assert [c["feature"] for c in vector.long().orderBy("sample_id", "feature").take(2)] == names
    for lay in (wide, vector):  # every feature goes, every row stays
        out = preprocess.preprocess(lay, preprocess.preset("metabolomics"))
        assert out.features == () and out.df.count() == 6
    with pytest.raises(Exception, match="Pareto"):
        long_form.scale(vector.long(), "pareto").collect()
    wide, vector = _vector_and_wide(spark, [(f"s{i}", "a", None, float(i)) for i in range(6)], names)
    for lay in (wide, vector):
        assert preprocess.preprocess(lay, preprocess.preset("metabolomics")).features == ("y",)
    cells = integrate.concatenate(vector.long().fillna(0.0), ["layer"])
    assert {c["feature"] for c in cells.collect()} == {"layer_x", "layer_y"}


def test_csv_rows_keep_their_order_in_many_splits(spark, tmp_path):
    at = tmp_path / "rows.csv"
    at.write_text("id,Groups,v\n" + "".join(f"s{i},g{i % 3},{i}.5\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        layer = read_csv_layer(spark, str(at), sample_col="id")
        got = [q["id"] for q in layer.df.orderBy("row_ix").select("id").collect()]
        assert layer.df.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"s{i}" for i in range(3000)] and layer.df.select("row_ix").distinct().count() == 3000


def test_scores_by_name(spark):
    rows = [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (1, "b", "a"), (1, "c", "c"), (1, "c", "c")]
    pred = spark.createDataFrame(rows, "fold int, grp string, pred string")
    for name in metrics.SCORERS:
        per = {q["fold"]: q["score"] for q in metrics.fold_scores_by(pred, name).collect()}
        for f in (0, 1):
            assert per[f] == pytest.approx(metrics.score(pred.where(F.col("fold") == f), name).first()["score"]), name
    for fn in (metrics.score, metrics.fold_scores_by):
        with pytest.raises(ValueError, match="unknown score"):
            fn(pred, "auc")


def test_models_compared_by_several_scores(spark):
    r = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], [float(v + 2 * (i % 2)) for v in r.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp string, x array<double>")
    got = resample.compare_models(df, {"centroid": resample.CentroidModel, "plsda": resample.PlsModel}, scoring=("f1_macro", "accuracy")).collect()
    assert {q["Model"] for q in got} == {"centroid", "plsda"} and all(0 <= q["f1_macro_mean"] <= 1 and q["accuracy_std"] >= 0 for q in got)


def test_number_of_components():
    choose = diablo_validation.choose_components
    assert choose([(1, 0.4), (2, 0.1), (3, 0.1)]) == 3 and choose([(1, 0.1), (2, None)]) == 1
    assert choose(None) == choose([]) == choose([(1, None), (2, float("nan"))]) == choose([(0, 0.0)]) == 2


def test_full_integration_in_one_call(spark):
    r = np.random.default_rng(6)
    y = ["a", "b"] * 6
    work = workflows.MultiLayerWorkflow()
    for name, width in (("one", 3), ("two", 4)):
        rows = [(f"s{i:02d}", g, *[float(np.exp(v + (g == "b"))) for v in r.normal(0, 0.3, width)]) for i, g in enumerate(y)]
        lay = Layer.from_wide(spark.createDataFrame(rows, "id string, g string, " + ", ".join(f"f{j} double" for j in range(width))), "g", sample_col="id", name=name)
        work.add_layer(name, lay, "metabolomics", "id", equal_n=12)
    with pytest.raises(ValueError, match="already"):
        work.add_layer("one", lay, "metabolomics", "id")
    with pytest.raises(ValueError, match="rows"):
        work.add_layer("three", lay, "metabolomics", "id", equal_n=5)
    got = work.run_full_integration(None, kind="logistic", k=3)
    table = {q["Method"]: (q["Accuracy"], q["Std"]) for q in got["method_comparison"].collect()}
    assert set(table) == {"Concatenation", "DIABLO"} and all(0 <= a <= 1 for a, _ in table.values())
    assert got["diablo_performance"].count() == 3 and {q["block"] for q in got["diablo_summary"].collect()} == {"one", "two"}
    assert got["limitations"].first()["n_samples"] == 12 and work.block("one").count() == 12
    with pytest.raises(KeyError):
        work.block("none")
    work.set_labels(work.labels().withColumn("grp", F.upper("grp")))
    assert {q["grp"] for q in work.labels().collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="label"):
        work.set_labels(work.labels().limit(3))


def test_concatenation_by_leave_one_out(spark):
    work = workflows.MultiLayerWorkflow()
    rows = [(f"s{i}", "ab"[i % 2], float(10 * (i % 2) + i + 1), float(i * i % 5 + 1)) for i in range(6)]
    lay = Layer.from_wide(spark.createDataFrame(rows, "id string, g string, x double, y double"), "g", sample_col="id", name="one")
    work.add_layer("one", lay, "metabolomics", "id", transform="none", scaling="standard")
    work.prepare_integration()
    got = work.run_concatenation("logistic")
    one = got["concatenation_cv"].first()
    assert one["n_splits"] == 6 and one["mean"] == 1.0 and got["concatenation_predictions"].count() == 6


def test_kernel_machine_is_optimal_and_separates_rings(spark, monkeypatch):
    from blockwise.functions.svm import radial, two_class
    from blockwise.operators import classifiers

    r = np.random.default_rng(8)
    x = r.normal(size=(80, 2))
    y = np.where((x**2).sum(1) > 1.2, 1.0, -1.0)
    y[:5] *= -1  # some on the wrong side
    k = radial(x, x, 0.5)
    coef, offset = two_class(k, y)
    alpha, margin = coef * y, y * (k @ coef - offset)
    assert alpha.min() >= 0 and alpha.max() <= 1 and abs(coef.sum()) < 1e-9
    for a, m in zip(alpha, margin, strict=True):  # conditions of the optimum
        assert m >= 1 - 2e-3 if a == 0 else m <= 1 + 2e-3 if a == 1 else abs(m - 1) < 2e-3
    rows = [(i, ("in", "mid", "out")[int(rad)], [float((rad + 1) * np.cos(t)), float((rad + 1) * np.sin(t))]) for i, (rad, t) in enumerate((i % 3, 0.37 * i) for i in range(120))]
    df = spark.createDataFrame(rows, "id long, grp string, x array<double>")
    m = classifiers.Classifier("svm").fit(df.where("id % 4 > 0"), ["a", "b"])
    got = m.predict(df.where("id % 4 = 0").select("id", "grp", "x"))
    assert got.columns == ["id", "grp", "pred"] and metrics.accuracy(got).first()["accuracy"] == 1.0
    monkeypatch.setattr(classifiers, "MAX_KERNEL_ROWS", 10)
    with pytest.raises(ValueError, match="svm_features"):
        classifiers.Classifier("svm").fit(df, ["a", "b"])


def test_example_runs(tmp_path):
    r = np.random.default_rng(7)
    for name in ("one", "two"):
        lines = ["sample,Groups,x,y,z"] + [f"s{i},{'gh'[i % 2]},{1 + i % 2 + r.random():.4f},{1 + r.random():.4f},{2 + r.random():.4f}" for i in range(8)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    code = f"""
import sys; sys.path[:0] = [{ROOT!r}, {ROOT + "/examples"!r}]
from complete_analysis import analyse
from blockwise.session import get_session
spark = get_session("example", "local[2]", 2, **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / "cp")!r}}})
at = {str(tmp_path)!r}
lines = analyse(spark, at + "/out", [(n, "metabolomics", at + "/" + n + ".csv", "sample") for n in ("one", "two")], kind="logistic", k=2)
print("REPORT", len(lines))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "REPORT" in out.stdout, out.stderr[-2000:]
    assert (tmp_path / "out/multi/method_comparison").is_dir() and (tmp_path / "out/single/one/plsda_vip_scores").is_dir()


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[("2024-01-01 10:00:00", "a", 1.0), ("2024-01-03 10:00:00", "a", 3.0)], [("2024-01-01 11:00:00", "a", 100.0), ("2024-01-03 09:30:00", "a", 5.0)], [("2024-01-09 00:00:00", "b", None)], [("2024-01-20 00:00:00", "b", 0.0)]]
    (tmp_path / "in").mkdir()
    stream = windowed_profile(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = {(str(x["start"])[:10], x["event_type"]): (x["n"], x["n_missing"], x["mean"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The second row of the first day came after the watermark had passed that day.
    assert got["2024-01-01", "a"] == (1, 0, 1.0) and got["2024-01-03", "a"] == (2, 0, 4.0) and got["2024-01-09", "b"][:2] == (1, 1)


def test_stability_rounds_at_any_size(spark, monkeypatch):
    """One block draws as the callable on all rows does; beyond MAX_CELLS and in several blocks the draws are still n of n."""
    r = np.random.default_rng(7)
    x = r.normal(1e6, 1 + np.arange(30) / 40, (400, 30))
    x[:, 3], x[5, 29] = 0.1, np.nan
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, grp string, x array<double>").repartition(5)
    names = [f"f{i}" for i in range(30)]
    want = {(t, names[i]) for t in range(6) for i in resample.variance_selector(x[np.random.RandomState(t).randint(0, 400, 400)], None)}
    monkeypatch.setattr(resample, "MAX_CELLS", 100)
    assert {tuple(q) for q in resample.stability_rounds(df, names, n_rounds=6).collect()} == want
    drawn = [np.concatenate([resample.block_draws([t], 400, b, 150)[0] for b in range(3)]) for t in range(6)]
    assert [d.sum() for d in drawn] == [400] * 6
    want = {(t, names[i]) for t in range(6) for i in resample.variance_selector(np.repeat(x, drawn[t], axis=0), None)}
    assert {tuple(q) for q in resample.variance_rounds(df, names, 6, block_rows=150).collect()} == want


def test_multiblock_loo_fits_many_models_at_once(spark):
    """The same classes as from a model fitted apart for every row, with several components, ties and constant features; fast enough for millions of rows."""
    import time

    dv, r, classes = diablo_validation, np.random.default_rng(0), list("abcd")
    for sizes, keep, comps in (([1, 3, 1], [1, 3, 1], 1), ([4, 3], [2, 3], 2), ([6, 2, 5], [1, 2, 5], 3), ([3], [2], 2)):
        y = np.concatenate([np.arange(4), r.integers(0, 4, 36)])
        x = r.normal(size=(40, sum(sizes))) + y[:, None] * r.normal(size=sum(sizes))
        x[:, -1] = 1.0 if comps == 2 else np.round(x[:, -1])
        s = dv._stats_of(x, np.array(classes, dtype=object)[y], classes)
        for i, got in enumerate(dv.held_out_classes(s, x, y, sizes, keep, comps, 0.1)):
            part = s.without(x[i], classes[y[i]])
            assert dv.predict_rows(dv.fit_stats(part, sizes, keep, comps, 0.1), x[i : i + 1], sizes, part)[0] == classes[got]
    y = r.integers(0, 4, 50000)
    x = r.normal(size=(50000, 5))
    s, began = dv._stats_of(x, np.array(classes, dtype=object)[y], classes), time.process_time()
    assert dv.held_out_classes(s, x, y, [1, 3, 1], [1, 3, 1], 1, 0.1).shape == (50000,)
    assert time.process_time() - began < 8  # one by one they take 24 s or more


def test_layers_of_a_workflow_are_read_from_one_table(spark, tmp_path):
    rows = [(f"s{i}", "ab"[i % 2], float(i + 1), float(i % 5 + 1)) for i in range(20)]
    w = workflows.MultiLayerWorkflow()
    spark.createDataFrame(rows, "id string, g string, u double, v double").write.parquet(f"{tmp_path}/source")
    w.add_layer("one", Layer.from_wide(spark.read.parquet(f"{tmp_path}/source"), "g", sample_col="id", name="one"), "metabolomics", "id")
    files = w.layers["one"].df.inputFiles()
    assert files and all("/cut-" in f for f in files)
    assert w.layers["one"].df.count() == 20


def _two_blocks(spark, n=230):
    r = np.random.default_rng(4)
    y = r.integers(0, 3, n)
    x = r.normal(size=(n, 12)) + 0.6 * y[:, None] * r.normal(size=12)
    rows = [(int(i), "abc"[g], v[:6].tolist(), v[6:].tolist()) for i, g, v in zip(r.permutation(n), y, x, strict=True)]
    return spark.createDataFrame(rows, "sample_id long, grp string, one array<double>, two array<double>").repartition(3), {"one": list("abcdef"), "two": list("ghijkl")}


def test_keep_tuning_beyond_max_cells(spark, monkeypatch):
    """The errors of tables that stay where they lie are those of the tasks on all rows."""
    df, names = _two_blocks(spark)
    took = lambda: ([tuple(q) for q in diablo_validation.tune_keep(df, names, 2).collect()], [tuple(q) for q in diablo_validation.component_errors(df, names).orderBy("component").collect()])
    want = took()
    for module in (diablo_validation, resample):
        monkeypatch.setattr(module, "MAX_CELLS", 100)
    monkeypatch.setattr(diablo_validation, "BLOCK_CELLS", 300)
    assert took() == want and len(want[0]) == 4


@pytest.mark.parametrize(("strategy", "n"), [("stratified", 12), ("loo", 3)])
def test_block_permutations_beyond_max_cells(spark, monkeypatch, strategy, n):
    df, names = _two_blocks(spark, 90)
    took = lambda: diablo_validation.permutation_error_test(df, names, n, 1, strategy=strategy, k=4).first().asDict()
    want = took()
    for module in (diablo_validation, resample):
        monkeypatch.setattr(module, "MAX_CELLS", 100)
    monkeypatch.setattr(diablo_validation, "BLOCK_CELLS", 300)
    monkeypatch.setattr(diablo_validation, "SUM_CELLS", 3000)
    assert took() == pytest.approx(want) and want["n_permutations"] == n


def test_kernel_machine_of_many_rows(spark, monkeypatch):
    """The machine by working sets is that of the whole kernel; 4,500 rows (refused before) are fitted, and predicted by several parts of the machine."""
    from blockwise.functions.svm import radial, two_class, two_class_rows
    from blockwise.operators import classifiers

    r = np.random.default_rng(9)
    x = r.normal(size=(700, 4))
    y = np.where(x[:, 0] + 0.5 * r.normal(size=700) > 0, 1.0, -1.0)
    whole, sets = two_class(radial(x, x, 0.2), y), two_class_rows(x, y, 0.2, whole=10, cells=700 * 64)
    said = [radial(x, x, 0.2) @ coef - offset for coef, offset in (whole, sets)]
    assert said[0] == pytest.approx(said[1], abs=5e-3)

    rows = [(i, ("in", "mid", "out")[int(rad)], [float((rad + 1) * np.cos(t)), float((rad + 1) * np.sin(t))]) for i, (rad, t) in enumerate((i % 3, 0.37 * i) for i in range(4800))]
    df = spark.createDataFrame(rows, "id long, grp string, x array<double>").repartition(3)
    monkeypatch.setattr(classifiers, "PART_ROWS", 50)
    m = classifiers.Classifier("svm").fit(df.where("id % 16 > 0"), ["a", "b"])
    assert m.machine.n_parts > 1
    got = m.predict(df.where("id % 16 = 0").select("id", "grp", "x"))
    assert got.count() == 300 and metrics.accuracy(got).first()["accuracy"] == 1.0


def test_forest_is_grown_in_tasks_and_kept_as_a_table(spark):
    """Nothing of the trees is kept by the driver; shares of the leaves, importances and seeds are as stated."""
    from blockwise.functions.forest import codes_of, grow, split_points
    from blockwise.operators.classifiers import Classifier

    r = np.random.default_rng(10)
    x = r.normal(size=(900, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    x[:, 4] = np.round(x[:, 4])
    assert len(split_points(x[:, 0])) == 31 and split_points(np.array([1.0, 3.0, 3.0, 7.0])).tolist() == [2.0, 5.0] and not len(split_points(np.ones(4)))
    points = [split_points(x[:, i]) for i in range(5)]
    tree, gains = grow(codes_of(x, points), y, 3, points, np.random.RandomState(1), 5)
    drawn = np.random.RandomState(1).poisson(1.0, 900) > 0
    got = tree.votes(x)
    assert got.sum(1) == pytest.approx(1) and (got[drawn, y[drawn]] > 0).all() and gains[:3].sum() > 0.8 * gains.sum()
    assert (codes_of(x, points)[:, 0] <= 3).tolist() == (x[:, 0] <= points[0][3]).tolist()
    twice = np.concatenate([x[:40], x[:40]])  # equal rows of two classes: mixed leaves
    mixed, _ = grow(codes_of(twice, points), np.repeat([0, 1], 40), 2, points, np.random.RandomState(3), 2)
    assert mixed.votes(twice).sum(1) == pytest.approx(1) and (mixed.cls[mixed.feature < 0] < 0).any()

    rows = [(i, "abc"[g], v.tolist()) for i, (g, v) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, grp string, x array<double>")
    model = Classifier("random_forest", trees=15).fit(df.where("id % 3 > 0"), list("vwxyz"))
    pred = model.predict(df.where("id % 3 = 0"))
    assert model.model is None and model.forest.parts.count() == model.forest.n_parts > 1
    assert pred.columns == ["id", "grp", "pred"] and pred.count() == 300 and metrics.accuracy(pred).first()["accuracy"] > 0.85
    again = Classifier("random_forest", trees=15).fit(df.where("id % 3 > 0"), list("vwxyz"))
    assert again.importances(5).collect() == model.importances(5).collect() and {q["Feature"] for q in model.importances(3).collect()} == set("vwx")
    assert sum(q["Importance"] for q in model.importances(5).collect()) == pytest.approx(1)
