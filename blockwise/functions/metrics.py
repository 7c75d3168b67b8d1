"""Classification metrics of a prediction table (grp, pred), as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, *by: str) -> DataFrame:
    return pred.groupBy(*by).agg(F.avg((F.col("grp") == F.col("pred")).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame) -> DataFrame:
    """(true_label, pred_label, n) over the full product of labels, zeros included."""
    labels = pred.select(F.col("grp").alias("l")).union(pred.select("pred")).distinct()
    grid = labels.select(F.col("l").alias("true_label")).crossJoin(labels.select(F.col("l").alias("pred_label")))  # labels, not rows
    seen = pred.groupBy(F.col("grp").alias("true_label"), F.col("pred").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def report(pred: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy, macro avg and weighted avg; undefined ratios are 0."""
    c = confusion(pred)
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    true = c.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = c.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    per = true.join(said, "label").select(
        "label",
        zero(F.try_divide("tp", "predicted")).alias("precision"),
        zero(F.try_divide("tp", "support")).alias("recall"),
        zero(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support"))).alias("f1"),
        "support",
    )
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        *[zero(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support"))).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    acc = F.coalesce(F.avg((F.col("grp") == F.col("pred")).cast("double")), F.lit(0.0))
    total = pred.agg(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.count(F.lit(1)).alias("support"))
    return per.unionByName(total).unionByName(macro).unionByName(weighted)


#: Scores by name: a row of the report and its column.
_OF_REPORT = {f"{m}_{a}": (f"{a} avg", m) for m in ("precision", "recall", "f1") for a in ("macro", "weighted")}
SCORERS = ("accuracy", "balanced_accuracy", *_OF_REPORT)


def score(pred: DataFrame, name: str = "accuracy") -> DataFrame:
    """One row (score) by a metric's name: accuracy, balanced_accuracy, or precision, recall, f1 with ``_macro`` or ``_weighted``."""
    if name == "accuracy":
        return accuracy(pred).withColumnRenamed("accuracy", "score")
    if name == "balanced_accuracy":
        return balanced_accuracy(pred).withColumnRenamed("balanced_accuracy", "score")
    if name not in _OF_REPORT:
        raise ValueError(f"unknown score: {name}")
    label, column = _OF_REPORT[name]
    return report(pred).where(F.col("label") == label).select(F.col(column).alias("score"))


def fold_scores_by(pred: DataFrame, name: str = "accuracy") -> DataFrame:
    """(fold, score) by a metric's name, in one plan: counts per fold, label and prediction."""
    if name != "balanced_accuracy" and name != "accuracy" and name not in _OF_REPORT:
        raise ValueError(f"unknown score: {name}")
    n = pred.groupBy("fold", "grp", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = n.select("fold", F.col("grp").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("grp") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(n.select("fold", F.col("pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("tp")))
    per = sides.groupBy("fold", "label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "tp")])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    of = {"precision": zero(F.try_divide("tp", "said")), "recall": zero(F.try_divide("tp", "support")), "f1": zero(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("said")))}
    if name == "accuracy":
        value = F.sum("tp") / F.sum("support")
    elif name == "balanced_accuracy":
        value = F.avg(F.when(F.col("support") > 0, of["recall"]))
    else:
        label, metric = _OF_REPORT[name]
        value = F.avg(of[metric]) if label == "macro avg" else F.sum(of[metric] * F.col("support")) / F.sum("support")
    return per.groupBy("fold").agg(value.alias("score"))


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    per = pred.groupBy("grp").agg(F.avg((F.col("grp") == F.col("pred")).cast("double")).alias("r"))
    return per.agg(F.avg("r").alias("balanced_accuracy"))
