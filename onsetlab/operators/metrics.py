"""Scores of predictions: rows have regressor_label, predicted_label and scores
(array of label and score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.functions import sigmoid, softmax


def accuracy(pred: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.avg((F.col("predicted_label") == F.col("regressor_label")).cast("double"))
    return pred.groupBy(*keys).agg(hit.alias("accuracy"))


def class_grid(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_label, col_label) for all pairs of trained classes; their number is that of categories squared."""
    names = pred.groupBy(*keys).agg(F.first(F.transform("scores", lambda s: s["label"])).alias("names"))
    return names.select(*keys, "names", F.explode("names").alias("row_label")).select(*keys, "row_label", F.explode("names").alias("col_label"))


def confusion(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Row-normalised over all trained classes; a class without rows is a row of zeros."""
    counts = pred.groupBy(*keys, F.col("regressor_label").alias("row_label"), F.col("predicted_label").alias("col_label")).agg(F.count("*").alias("n"))
    grid = class_grid(pred, keys).join(counts, [*keys, "row_label", "col_label"], "left")
    total = F.sum("n").over(Window.partitionBy(*keys, "row_label"))
    return grid.select(*keys, "row_label", "col_label", F.coalesce(F.col("n") / total, F.lit(0.0)).alias("value"))


def scoring_evidence(two_classes: bool) -> Column:
    """Sigmoids of the decision values; with two classes [1 - p, p] of the second's."""
    if two_classes:
        p = sigmoid(F.col("scores")[1]["score"])
        return F.array(1.0 - p, p)
    return F.transform("scores", lambda s: sigmoid(s["score"]))


def with_evidence(pred: DataFrame) -> DataFrame:
    """Adds evidence (array, in the order of scores): a softmax of the scores."""
    return pred.withColumn("evidence", softmax(F.transform("scores", lambda s: s["score"])))


def by_class(pred: DataFrame, value: str = "evidence") -> DataFrame:
    """One row per prediction and class: cat and value."""
    pairs = F.zip_with("scores", value, lambda s, e: F.struct(s["label"].alias("cat"), e.alias("value")))
    return pred.withColumn("p", F.explode(pairs)).withColumn("cat", F.col("p.cat")).withColumn("value", F.col("p.value")).drop("p")


def evidence_matrix(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Mean evidence for a class among rows of a class, on the grid of trained classes."""
    means = by_class(pred).groupBy(*keys, F.col("regressor_label").alias("row_label"), F.col("cat").alias("col_label")).agg(F.avg("value").alias("value"))
    grid = class_grid(pred, keys).join(means, [*keys, "row_label", "col_label"], "left")
    return grid.withColumn("value", F.coalesce("value", F.lit(0.0)))


def rounded(x, rint=F.rint):
    """Scores to twelve decimals, as a column or an array: what differs by less ties in ranks."""
    return rint(x * 1e12) / 1e12


def auc(pred: DataFrame, keys: list[str]) -> DataFrame:
    """One-vs-rest area under the curve per class, by ranks with ties (see rounded) averaged; NaN where
    a side has no rows. Windows are by class, so no sort spans all rows."""
    each = by_class(pred).withColumn("value", rounded(F.col("value"))).withColumn("y", (F.col("cat") == F.col("regressor_label")).cast("long"))
    group, ties = Window.partitionBy(*keys, "cat").orderBy("value"), Window.partitionBy(*keys, "cat", "value")
    each = each.withColumn("rank", F.rank().over(group) + (F.count("*").over(ties) - 1) / 2.0)
    s = each.groupBy(*keys, "cat").agg(F.sum("y").alias("a"), F.count("*").alias("n"), F.sum(F.col("rank") * F.col("y")).alias("r"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    area = (F.col("r") - a * (a + 1) / 2.0) / (a * b)
    return s.select(*keys, F.col("cat").alias("label"), F.when((a == 0) | (b == 0), float("nan")).otherwise(area).alias("auc"))


def macro_auc(areas: DataFrame, keys: list[str]) -> DataFrame:
    return areas.groupBy(*keys).agg(F.avg("auc").alias("macro_auc"))


def tidy(pred: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics as (keys, metric, row_label, col_label, value)."""
    none = F.lit("")
    out = accuracy(pred, keys).select(*keys, F.lit("total_scores").alias("metric"), none.alias("row_label"), none.alias("col_label"), F.col("accuracy").alias("value"))
    for name, m in (("accuracy", confusion(pred, keys)), ("evidence", evidence_matrix(pred, keys))):
        out = out.unionByName(m.select(*keys, F.lit(name).alias("metric"), "row_label", "col_label", "value"))
    a = auc(pred, keys)
    return out.unionByName(a.select(*keys, F.lit("auc").alias("metric"), F.col("label").alias("row_label"), none.alias("col_label"), F.col("auc").alias("value")))


def fold_average(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over folds of each metric's entry; NaN in one fold is NaN in the mean."""
    return metrics.groupBy(*keys, "metric", "row_label", "col_label").agg(F.avg("value").alias("value"))
