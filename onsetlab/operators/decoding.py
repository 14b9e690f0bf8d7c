"""Decoding of a time course around each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from onsetlab.functions import volume_range
from onsetlab.operators import conditions
from onsetlab.operators.sampling import one_per_trial


def window_times(window: dict) -> tuple[Column, Column]:
    """Start and end seconds of a window: onset or end of the event, and an offset."""

    def at(side):
        base = F.col("onset") if side["reference"] == "onset" else F.col("onset") + F.col("duration")
        return base + F.lit(float(side.get("offset_seconds", 0)))

    return at(window["start"]), at(window["end"])


def timecourse_rows(labelled: DataFrame, recordings: DataFrame, window: dict, order: list[str] = ("volume_of_interest",)) -> DataFrame:
    """One row per trial and frame of its window, with window_index from 0."""
    one = one_per_trial(labelled, ["boldfile", "trial_index"], list(order)).drop("volume_of_interest")
    start, stop = window_times(window)
    timed = one.join(recordings.select("boldfile", "tr", "n_frames"), "boldfile").withColumn("start", start).withColumn("stop", stop)
    first, after = volume_range(F.col("start"), F.col("stop"), F.col("tr"), F.col("n_frames"))
    ranged = timed.withColumn("first", first).withColumn("after", after).where("after > first")
    out = ranged.withColumn("volume_of_interest", F.explode(F.sequence("first", F.col("after") - 1)))
    return out.withColumn("window_index", F.col("volume_of_interest") - F.col("first")).drop("start", "stop", "first", "after", "n_frames", "tr")


#: Columns of a decoding table about the features that were chosen.
CHOSEN = ("threshold_p", "threshold_used", "selected_voxels", "whole_voxels", "feature_percent")


def decoding_table(pred: DataFrame, categories: list[str], chosen: DataFrame, keys: list[str], descr: str) -> DataFrame:
    """Predictions with evidence (array by class) as the decoding table: correct,
    evidence_<category> (null for a class that was not trained), model_descr, and of the
    key's choice of features the thresholds (NaN without one) and numbers of voxels."""
    by = F.map_from_arrays(F.transform("scores", lambda s: s["label"]), F.col("evidence"))
    about = chosen.select(*keys, "threshold_p", "threshold_used", "selected_voxels", "whole_voxels", (100.0 * F.col("selected_voxels") / F.col("whole_voxels")).alias("feature_percent"))
    shown = pred.select(
        "*",
        (F.col("predicted_label") == F.col("regressor_label")).alias("correct"),
        *(F.element_at(by, F.lit(c)).alias(f"evidence_{c}") for c in categories),
        F.lit(descr).alias("model_descr"),
    )
    return shown.join(about, list(keys))


def summary(decoded: DataFrame, evidence: list[str], keys: list[str]) -> DataFrame:
    """trial_count, Accuracy, mean evidence and mean numbers of chosen features (where the table
    has them) by key, window_index and label. Over all
    rows of a key, so pooled folds weigh by their rows."""
    hit = F.avg(F.col("correct").cast("double")).alias("Accuracy")
    return decoded.groupBy(*keys, "window_index", "regressor_label").agg(F.count("*").alias("trial_count"), hit, *(F.avg(c).alias(c) for c in (*evidence, *CHOSEN) if c in decoded.columns))


def standard_error(value: str) -> Column:
    """Of the mean; 0 for one row. All rows count, also those without a value."""
    return F.coalesce(F.stddev_samp(value) / F.sqrt(F.count("*")), F.lit(0.0))


def within_unit(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and standard error of evidence by key (unit, label, class, window_index, overlay)."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), standard_error(value).alias("se"), F.count("*").alias("n"))


def timecourse(decoded: DataFrame, evidence: list[str], overlay: dict[str, dict] | None = None, unit: list[str] = ("subject",)) -> tuple[DataFrame, Observation | None]:
    """(unit, window_index, regressor_label[, overlay_label], cat, mean, se, n) from the raw decoding
    rows: mean and standard error of each evidence column. Overlay conditions are a further key; rows of
    none of them go, and the observation counts them once the table is made."""
    keys, seen = [*unit, "window_index", "regressor_label"], None
    if overlay:
        decoded, seen = conditions.label_rows_counted(decoded, overlay, "overlay_label")
        keys.append("overlay_label")
    each = F.array(*(F.struct(F.lit(c.removeprefix("evidence_")).alias("cat"), F.col(c).alias("value")) for c in evidence))
    rows = decoded.select(*keys, F.explode(each).alias("x")).select(*keys, "x.cat", "x.value")
    return within_unit(rows, [*keys, "cat"]), seen


def units(decoded: DataFrame) -> list[str]:
    """The unit whose spread a time course shows: folds where one subject alone has several, else subjects."""
    if "fold" not in decoded.columns:
        return ["subject"]
    n = decoded.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("fold").alias("folds")).first()
    return ["subject", "fold"] if n["subjects"] == 1 and n["folds"] > 1 else ["subject"]


def across_units(within: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over units, its standard error, and the mean of the units' own errors."""
    return within.groupBy(*keys).agg(F.avg("mean").alias("group_mean"), standard_error("mean").alias("group_se"), F.avg("se").alias("mean_within_se"), F.count("*").alias("n_units"))
