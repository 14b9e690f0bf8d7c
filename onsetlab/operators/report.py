"""The numbers of a report, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.operators.patterns import array_stats


def accuracy_table(scores: DataFrame, n_classes: int) -> DataFrame:
    """Accuracy by stage for each subject, and the group's mean as subject ``group``; with chance."""
    each = scores.groupBy("stage", "subject").agg(F.avg("accuracy").alias("accuracy"))
    group = each.groupBy("stage").agg(F.avg("accuracy").alias("accuracy")).withColumn("subject", F.lit("group"))
    return each.unionByName(group).withColumn("chance", F.lit(1.0 / n_classes))


def fold_values(scores: DataFrame) -> DataFrame:
    """(stage, subject, fold, accuracy): the single folds behind an accuracy, and by how much each
    differs from its subject's mean."""
    mean = F.avg("accuracy").over(Window.partitionBy("stage", "subject"))
    return scores.select("stage", "subject", "fold", "accuracy", (F.col("accuracy") - mean).alias("from_mean"))


def auc_quartiles(areas: DataFrame) -> DataFrame:
    """Five-number summary of the areas per class; undefined ones don't count."""
    p = F.percentile("auc", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = areas.where(~F.isnan("auc")).groupBy("label").agg(p.alias("p"))
    return out.select("label", *(F.col("p")[k].alias(n) for k, n in enumerate(("least", "q1", "median", "q3", "most"))), F.lit(0.5).alias("chance"))


def median_duration(events: DataFrame, by: str = "trial_type") -> DataFrame:
    """Median event length per condition; rows are one per event."""
    return events.groupBy(by).agg(F.median("duration").alias("median_duration"))


def majority_tr(recordings: DataFrame) -> DataFrame:
    """The repeat time that most recordings have; of equals the one seen first by file."""
    counted = recordings.groupBy("tr").agg(F.count("*").alias("n"), F.min("boldfile").alias("first"))
    order = Window.orderBy(F.desc("n"), "first")  # one row per distinct repeat time
    return counted.withColumn("place", F.row_number().over(order)).withColumn("several", F.count("*").over(Window.partitionBy()) > 1).where("place = 1").drop("place")


def group_matrix(matrices: DataFrame) -> DataFrame:
    """Mean over subjects of confusion or evidence matrices."""
    return matrices.groupBy("row_label", "col_label").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def group_importance(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean map per label over subjects in the shared space and on the first such subject's
    grid (grid_key where the maps have it, and the number of voxels); and the subjects left out."""
    own = F.struct(*(["grid_key"] if "grid_key" in maps.columns else []), F.size("weights").alias("size"))
    shared = maps.where("space = 'mni'").withColumn("__grid", own)
    grid = shared.select(F.min_by("__grid", "subject").alias("grid"))
    fits = shared.join(grid, F.col("__grid").eqNullSafe(F.col("grid")), "left_semi").drop("__grid")
    mean = array_stats(fits, ["label"], "weights").select("label", F.col("mean").alias("weights"), "n")
    return mean, maps.select("subject").distinct().join(fits.select("subject").distinct(), "subject", "left_anti")
