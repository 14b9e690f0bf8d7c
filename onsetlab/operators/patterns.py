"""Pattern tables: one row per frame, its features an array."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def array_stats(df: DataFrame, keys: list[str], features: str = "features", weight: Column | None = None) -> DataFrame:
    """Per key: n, and elementwise mean, sum, var (sample) and sumsq of the features, as arrays.
    Elements are combined in each task before the shuffle; nothing is exploded."""
    v = array_to_vector(F.col(features))
    s = Summarizer.metrics("count", "mean", "sum", "variance", "normL2").summary(v)
    out = df.groupBy(*keys).agg(s.alias("s"))
    arr = lambda m: vector_to_array(F.col(f"s.{m}"))
    return out.select(*keys, F.col("s.count").alias("n"), arr("mean").alias("mean"), arr("sum").alias("sum"), arr("variance").alias("var"), F.transform(arr("normL2"), lambda x: x * x).alias("sumsq"))


def slice_patterns(volumes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of the volume table with their frame's features; frames outside a recording go."""
    frames = patterns.select("boldfile", F.col("volume").alias("volume_of_interest"), "features")
    return volumes.where("volume_of_interest >= 0").join(frames, ["boldfile", "volume_of_interest"])


def resolve_masks(wanted: DataFrame, masks: DataFrame) -> DataFrame:
    """One mask for each (subject, session) of wanted; raises where there is none or more than one."""
    keys = ["subject", "session"]
    found = wanted.select(*keys).distinct().join(masks, keys, "left").groupBy(*keys).agg(F.count("voxel_idx").alias("n"), F.first("voxel_idx").alias("voxel_idx"))
    bad = found.where("n <> 1").limit(5).collect()
    if bad:
        raise ValueError(f"masks missing or ambiguous: {[(r['subject'], r['session'], r['n']) for r in bad]}")
    return found.drop("n")


def apply_mask(patterns: DataFrame, masks: DataFrame, keys: list[str] = ("subject",)) -> DataFrame:
    picked = F.transform("voxel_idx", lambda i: F.get("features", i))
    return patterns.join(masks, list(keys)).withColumn("features", picked).drop("voxel_idx")


def zscore(patterns: DataFrame, key: str = "boldfile") -> DataFrame:
    """Standard scores over all frames of a run, with the population's deviation; constant
    features and missing values become 0."""
    s = array_stats(patterns, [key])
    sd = F.transform("var", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")))
    s = s.select(key, F.arrays_zip("mean", sd.alias("sd")).alias("scale"))
    z = F.zip_with("features", "scale", lambda x, m: F.when((m["sd"] == 0) | F.isnan(m["sd"]), 0.0).otherwise(F.coalesce(F.nanvl((x - m["mean"]) / m["sd"], F.lit(0.0)), F.lit(0.0))))
    return patterns.join(s, key).withColumn("features", z).drop("scale")


def class_stats(df: DataFrame, keys: list[str], label: str = "regressor_label") -> DataFrame:
    """(keys, label, n, sum, sumsq): what selection and centroids need of the rows."""
    return array_stats(df, [*keys, label]).select(*keys, label, "n", "sum", "sumsq")


def added(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of units added up by key."""
    total = lambda c: Summarizer.metrics("sum").summary(array_to_vector(F.col(c))).alias(c)
    out = stats.groupBy(*keys).agg(F.sum("n").alias("n"), total("sum"), total("sumsq"))
    return out.select(*keys, "n", *(vector_to_array(F.col(c)["sum"]).alias(c) for c in ("sum", "sumsq")))


def stats_outside(by_unit: DataFrame, folds: DataFrame, unit: list[str] = ("run",), label: str = "regressor_label") -> DataFrame:
    """(subject, fold, label, n, sum, sumsq) of the rows outside each fold, from statistics by
    (subject, unit, label): all of the subject's less those of the fold's units. The
    rows themselves are read once to make ``by_unit``, however many folds there are."""
    unit = list(unit)
    total = added(by_unit, ["subject", label]).toDF("subject", label, "n", "sum", "sumsq")
    held = added(by_unit.join(folds.select("subject", "fold", *unit).distinct(), ["subject", *unit]), ["subject", "fold", label])
    held = held.toDF("subject", "fold", label, "n_held", "sum_held", "sumsq_held")
    every = total.join(folds.select("subject", "fold").distinct(), "subject").join(held, ["subject", "fold", label], "left")
    less = lambda c: F.when(F.col("n_held").isNull(), F.col(c)).otherwise(F.zip_with(c, f"{c}_held", lambda a, b: a - b)).alias(c)
    return every.select("subject", "fold", label, (F.col("n") - F.coalesce("n_held", F.lit(0))).alias("n"), less("sum"), less("sumsq")).where("n > 0")


def class_means(stats: DataFrame, keys: list[str], label: str = "regressor_label") -> DataFrame:
    """(keys, label, mean)."""
    return stats.select(*keys, label, F.transform("sum", lambda x: x / F.col("n")).alias("mean"))


def anova(df: DataFrame, label: str = "regressor_label", keys: list[str] = ("subject",)) -> DataFrame:
    """F of each feature over the classes, per key, with its degrees of freedom:
    (keys, voxel, f, between, within)."""
    return anova_of(class_stats(df, list(keys), label), keys)


def anova_of(s: DataFrame, keys: list[str]) -> DataFrame:
    """The same from statistics by class."""
    keys = list(keys)
    flat = s.select(*keys, "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("voxel", "m"))
    g = flat.groupBy(*keys, "voxel").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("m.sum").alias("t"), F.sum("m.sumsq").alias("q"), F.sum(F.col("m.sum") * F.col("m.sum") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("t") * F.col("t") / F.col("n"), F.col("q") - F.col("b")
    error = F.try_divide(within, F.col("n") - F.col("k"))
    # a feature that doesn't vary within classes: infinite, or undefined if it doesn't vary at all
    ratio = F.when(error > 0, F.try_divide(F.try_divide(between, F.col("k") - 1), error)).when(between > 0, float("inf")).otherwise(float("nan"))
    f = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), ratio)
    return g.select(*keys, "voxel", f.alias("f"), (F.col("k") - 1).alias("between"), (F.col("n") - F.col("k")).alias("within"))


def upper_tail(f: np.ndarray, between: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Probability that an F value is larger, by the continued fraction of the incomplete beta
    function; NaN where f is."""
    a, b, x = within / 2.0, between / 2.0, within / (within + between * f)
    swap = x > (a + 1) / (a + b + 2)  # where the fraction of the complement settles sooner
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c, total = np.ones_like(x), d.copy()
        for m in range(1, 400):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                total *= d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
                break
        part = np.where(x <= 0, 0.0, front * total)
    return np.where(swap, 1 - part, part)


def anova_p(df: DataFrame, label: str = "regressor_label", keys: list[str] = ("subject",)) -> DataFrame:
    """(keys, voxel, p, f) of all keys in one job; an undefined p is 1."""
    return anova_p_of(class_stats(df, list(keys), label), keys)


def anova_p_of(stats: DataFrame, keys: list[str]) -> DataFrame:

    @F.pandas_udf("double")
    def tail(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series(upper_tail(*(np.maximum(x.to_numpy(float), 0.0) for x in (f, between, within))))

    p = tail("f", F.col("between").cast("double"), F.col("within").cast("double"))
    return anova_of(stats, keys).select(*keys, "voxel", F.coalesce(F.nanvl(p, F.lit(1.0)), F.lit(1.0)).alias("p"), "f")


def select_below(p: DataFrame, threshold: float, least: int = 5, keys: list[str] = ("subject",)) -> DataFrame:
    """Features with p below the threshold, which is widened by a tenth for each key until at
    least ``least`` are, or it is over 1; with the threshold used. A key has as many rows as voxels."""
    nth = F.get(F.sort_array(F.collect_list("p")), F.lit(least - 1))
    wider = lambda t, _: F.when((t > 1) | F.coalesce(F.col("nth") < t, F.lit(False)), t).otherwise(t * 1.1)
    steps = int(math.log(1 / threshold) / math.log(1.1)) + 2 if threshold < 1 else 1
    used = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(float(threshold)), wider)
    widened = p.groupBy(*keys).agg(nth.alias("nth")).select(*keys, used.alias("threshold_used"))
    return p.join(widened, list(keys)).where("p < threshold_used")


def select_best(f: DataFrame, n: int, keys: list[str] = ("subject",)) -> DataFrame:
    """The n features with the highest F per key; undefined ones last, ties by number."""
    order = Window.partitionBy(*keys).orderBy(F.when(F.isnan("f"), None).otherwise(F.col("f")).desc_nulls_last(), "voxel")
    return f.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def select_features(train: DataFrame, keys: list[str], n_voxels: int | None = None, feat_p: float | None = None, label: str = "regressor_label") -> DataFrame:
    """(keys, voxel_idx, threshold_p, threshold_used, selected_voxels, whole_voxels) of all keys in
    one job: the n_voxels best by F, else those below feat_p, widened; all without either."""
    return select_by(class_stats(train, list(keys), label), keys, n_voxels, feat_p)


def select_by(stats: DataFrame, keys: list[str], n_voxels: int | None = None, feat_p: float | None = None) -> DataFrame:
    """The same from statistics by class."""
    whole = stats.groupBy(*keys).agg(F.max(F.size("sum")).alias("whole_voxels"))
    if n_voxels is None and feat_p is None:
        chosen = whole.select(*keys, F.sequence(F.lit(0), F.col("whole_voxels") - 1).alias("voxel_idx"), F.lit(None).cast("double").alias("threshold_used"))
    else:
        kept = select_best(anova_of(stats, keys), n_voxels, keys).withColumn("threshold_used", F.lit(None).cast("double")) if n_voxels else select_below(anova_p_of(stats, keys), feat_p, keys=keys)
        chosen = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("voxel").cast("int"))).alias("voxel_idx"), F.first("threshold_used").alias("threshold_used"))
    nan = F.lit(float("nan"))
    threshold = nan if n_voxels or feat_p is None else F.lit(float(feat_p))
    none = F.array().cast("array<int>")
    out = whole.join(chosen, list(keys), "left").withColumn("voxel_idx", F.coalesce("voxel_idx", none))
    return out.select(*keys, "voxel_idx", threshold.alias("threshold_p"), F.coalesce("threshold_used", nan).alias("threshold_used"), F.size("voxel_idx").alias("selected_voxels"), "whole_voxels")


def trend(patterns: DataFrame, key: str = "boldfile", time: str = "volume") -> DataFrame:
    """Intercept and slope over time of each feature: (key, mid, intercept, slope) as arrays,
    the ramp centred at the run's mean time ``mid``."""
    mid = patterns.groupBy(key).agg(F.avg(F.col(time).cast("double")).alias("mid"), F.var_pop(F.col(time).cast("double")).alias("tt"), F.count("*").alias("n"))
    c = F.col(time).cast("double") - F.col("mid")
    moved = patterns.join(mid, key).withColumn("tx", F.transform("features", lambda x: x * c))
    sx = array_stats(moved, [key]).select(key, F.col("mean").alias("intercept"))
    st = array_stats(moved, [key], "tx").select(key, F.col("mean").alias("tx"))
    slope = F.transform("tx", lambda x: F.when(F.col("tt") == 0, 0.0).otherwise(x / F.col("tt")))
    return sx.join(st, key).join(mid, key).select(key, "mid", "intercept", slope.alias("slope"))


def detrend(patterns: DataFrame, key: str = "boldfile", time: str = "volume") -> DataFrame:
    """Residuals of each feature from its line over time."""
    t = trend(patterns, key, time).select(key, "mid", F.arrays_zip("intercept", "slope").alias("line"))
    c = F.col(time).cast("double") - F.col("mid")
    left = F.zip_with("features", "line", lambda x, m: x - (m["intercept"] + m["slope"] * c))
    return patterns.join(t, key).withColumn("features", left).drop("mid", "line")


def offset_in_mask(patterns: DataFrame, voxels: Column, by: float = 10000.0) -> DataFrame:
    """A constant added to the features in a mask (an array of indices)."""
    moved = F.transform("features", lambda x, i: F.when(F.array_contains(voxels, i), x + by).otherwise(x))
    return patterns.withColumn("features", moved)


def temporal_mean(patterns: DataFrame, key: str = "boldfile") -> DataFrame:
    return array_stats(patterns, [key]).select(key, F.col("mean").alias("features"))


def grand_mean(means: DataFrame) -> DataFrame:
    """Mean of the runs' means, as one row."""
    return array_stats(means.withColumn("all", F.lit(0)), ["all"]).select(F.col("mean").alias("features"))


def detrended_check(patterns: DataFrame, key: str = "boldfile", least: float = 1.0) -> DataFrame:
    """(key, mean, detrended): whether a run's overall mean is near zero."""
    each = F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")
    return patterns.groupBy(key).agg(F.avg(each).alias("mean")).withColumn("detrended", F.abs("mean") < least)
