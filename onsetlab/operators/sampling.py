"""Balancing, splits, run pairs and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balance(df: DataFrame, label: str = "regressor_label", unit: str = "subject", volume: str = "volume_of_interest", trial: tuple[str, ...] = ("run", "trial_index")) -> DataFrame:
    """As many rows of each class as the smallest class of the unit has: fuller trials
    first, then by run, trial, the highest volume, and file."""
    group = Window.partitionBy(unit, label, *trial)
    order = Window.partitionBy(unit, label).orderBy(F.desc("pair_n"), *trial, F.desc(volume), "boldfile")
    sizes = df.groupBy(unit, label).count().groupBy(unit).agg(F.min("count").alias("k"))
    ranked = df.withColumn("pair_n", F.count("*").over(group)).withColumn("nth", F.row_number().over(order))
    return ranked.join(sizes, unit).where("nth <= k").drop("nth", "k", "pair_n")


def split_runs(df: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of each fold (subject, fold, run): all but its runs, and its runs."""
    numbers = folds.select("subject", "fold").distinct()
    every = df.join(numbers, "subject")
    keys = ["subject", "fold", "run"]
    return every.join(folds.select(*keys), keys, "left_anti"), every.join(folds.select(*keys), keys, "left_semi")


def split_trials(df: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for folds of trials (subject, fold, run, trial_index)."""
    numbers = folds.select("subject", "fold").distinct()
    every = df.join(numbers, "subject")
    keys = ["subject", "fold", "run", "trial_index"]
    return every.join(folds.select(*keys), keys, "left_anti"), every.join(folds.select(*keys), keys, "left_semi")


def held_rows(df: DataFrame, folds: DataFrame, unit: list[str] = ("run",)) -> DataFrame:
    """Rows with the fold that holds their unit out; a row goes as often as folds hold it."""
    keys = ["subject", *unit]
    return df.join(folds.select(*keys, "fold").distinct(), keys)


def outside_codes(df: DataFrame, folds: DataFrame, code: Column, unit: list[str] = ("run",)) -> DataFrame:
    """Adds fold_numbers (the subject's folds, ascending) and codes: for each of them the row's
    code, or -1 if the fold holds the row out. Rows aren't multiplied by folds."""
    keys = ["subject", *unit]
    numbers = folds.groupBy("subject").agg(F.sort_array(F.collect_set("fold")).alias("fold_numbers"))
    held = folds.groupBy(*keys).agg(F.collect_set("fold").alias("__held"))
    own = df.withColumn("__code", code).join(numbers, "subject").join(held, keys, "left")
    out = lambda f: F.coalesce(F.array_contains("__held", f), F.lit(False))
    return own.withColumn("codes", F.transform("fold_numbers", lambda f: F.when(out(f), -1).otherwise(F.col("__code")))).drop("__code", "__held")


def one_per_trial(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def pair_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """The nth run of task a with the nth of task b, per subject and session."""
    order = Window.partitionBy("subject", "session", "task").orderBy("run")
    nth = runs.where(F.col("task").isin(a, b)).withColumn("nth", F.row_number().over(order))
    keys = ["subject", "session", "nth"]
    rest = [c for c in runs.columns if c not in ("subject", "session", "task")]
    side = lambda t, tag: nth.where(F.col("task") == t).select(*keys, *(F.col(c).alias(f"{c}_{tag}") for c in rest))
    return side(a, "a").join(side(b, "b"), keys, "full")


#: What two runs must have in common to be joined, as far as the recordings tell it.
COMMON = ("tr", "grid_key")


def pair_problems(pairs: DataFrame, equal: tuple[str, ...] = COMMON) -> DataFrame:
    """Adds problem: null, or why the two runs can't be joined."""
    known = [c for c in equal if f"{c}_a" in pairs.columns]
    problem = F.when(F.col("boldfile_a").isNull() | F.col("boldfile_b").isNull(), "no partner")
    for c in known:
        problem = problem.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), f"{c} differs")
    return pairs.withColumn("problem", problem)


def check_pairs(pairs: DataFrame, equal: tuple[str, ...] = COMMON) -> None:
    """Raise on runs without a partner, and on pairs that differ in grid or repeat time."""
    bad = pair_problems(pairs, equal).where("problem is not null").limit(5).collect()
    if bad:
        raise ValueError(f"runs that don't pair: {bad}")


def concat_patterns(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """b's frames after a's, under a's file."""
    moved = b.join(pairs.select(F.col("boldfile_b").alias("boldfile"), "boldfile_a", "n_frames_a"), "boldfile")
    moved = moved.withColumn("volume", (F.col("volume") + F.col("n_frames_a")).cast(dict(b.dtypes)["volume"])).withColumn("boldfile", F.col("boldfile_a")).drop("boldfile_a", "n_frames_a")
    return a.unionByName(moved.select(*a.columns))


def concat_events(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """b's events after a's recording, under a's file."""
    moved = b.join(pairs.select(F.col("boldfile_b").alias("boldfile"), "boldfile_a", "n_frames_a", "tr_a"), "boldfile")
    moved = moved.withColumn("onset", F.col("onset") + F.col("n_frames_a") * F.col("tr_a")).withColumn("boldfile", F.col("boldfile_a"))
    return a.unionByName(moved.select(*a.columns))


def fold_universe(*tables: DataFrame) -> DataFrame:
    """Distinct (subject, run) of the tables."""
    out = tables[0].select("subject", "run")
    for t in tables[1:]:
        out = out.unionByName(t.select("subject", "run"))
    return out.distinct()


def per_run(universe: DataFrame) -> DataFrame:
    return universe.withColumn("fold", F.dense_rank().over(Window.partitionBy("subject").orderBy("run")))


def group_folds(universe: DataFrame, n_splits: int) -> DataFrame:
    """Contiguous groups of runs, larger groups first. Subjects with fewer runs than groups
    have no folds (see short_subjects); raises if all are such."""
    if n_splits < 2:
        raise ValueError(f"{n_splits} groups; at least 2 are needed")
    enough = universe.join(short_subjects(universe, n_splits).select("subject"), "subject", "left_anti")
    if enough.isEmpty():
        raise ValueError(f"no subject has {n_splits} runs")
    return enough.withColumn("fold", F.ntile(n_splits).over(Window.partitionBy("subject").orderBy("run")))


def short_subjects(universe: DataFrame, n_splits: int) -> DataFrame:
    """(subject, n_runs) of the subjects with too few runs for so many groups."""
    return universe.groupBy("subject").agg(F.count_distinct("run").alias("n_runs")).where(F.col("n_runs") < n_splits)


def explicit_folds(spark: SparkSession, universe: DataFrame, held_out: list[list]) -> tuple[DataFrame, DataFrame]:
    """Folds by lists of held-out runs, and what is uncovered or unknown as (subject, run, problem)."""
    rows = [(k, str(r)) for k, runs in enumerate(held_out, 1) for r in runs]
    given = spark.createDataFrame(rows, "fold int, run_text string")
    known = universe.withColumn("run_text", F.col("run").cast("string"))
    folds = known.join(given, "run_text").select("subject", "run", "fold")
    uncovered = known.join(given, "run_text", "left_anti").select("subject", "run_text", F.lit("uncovered").alias("problem"))
    unknown = given.join(known, "run_text", "left_anti").select(F.lit(None).cast("string").alias("subject"), "run_text", F.lit("unknown").alias("problem"))
    return folds, uncovered.unionByName(unknown)


def validate_strategy(cv: dict | None) -> list[str]:
    if not isinstance(cv, dict):
        return ["kfold_cv is missing"]
    kind = cv.get("strategy")
    if kind not in ("per_run", "group_kfold", "explicit_groups"):
        return [f"unknown strategy {kind!r}"]
    n = cv.get("n_splits")
    if kind == "group_kfold" and (isinstance(n, bool) or not isinstance(n, int) or n < 2):
        return ["group_kfold needs a whole n_splits of 2 or more"]
    groups = cv.get("held_out_runs")
    if kind == "explicit_groups" and (not isinstance(groups, list) or not groups or not all(isinstance(g, list) and g for g in groups)):
        return ["explicit_groups needs lists of held_out_runs"]
    return []


def fold_status(folds: DataFrame, train: DataFrame, test: DataFrame, decode: DataFrame | None = None) -> DataFrame:
    """Rows of each fold by use, and whether it is skipped. Tables of counts have them in ``n_rows``."""
    keys = ["subject", "fold"]
    count = lambda d, n: d.groupBy(*keys).agg((F.sum("n_rows") if "n_rows" in d.columns else F.count("*")).alias(n))
    out = folds.select(*keys).distinct().join(count(train, "n_train"), keys, "left").join(count(test, "n_test"), keys, "left")
    out = out.join(count(decode, "n_decode"), keys, "left") if decode is not None else out.withColumn("n_decode", F.lit(0))
    out = out.fillna(0, ["n_train", "n_test", "n_decode"])
    status = F.when(F.col("n_train") == 0, "no training rows").when((F.col("n_test") == 0) & (F.col("n_decode") == 0), "nothing to score").otherwise("run")
    return out.withColumn("status", status)


def homogeneous_runs(df: DataFrame, label: str = "regressor_label") -> DataFrame:
    """(subject, homogeneous): whether all runs of a subject have the same classes."""
    sets = df.groupBy("subject", "run").agg(F.concat_ws("|", F.sort_array(F.collect_set(label))).alias("s"))
    return sets.groupBy("subject").agg((F.count_distinct("s") == 1).alias("homogeneous"))


def shuffled(seed: int, *columns: str) -> Column:
    """A reproducible order: the digest of a seed and a key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def trial_folds(trials: DataFrame, label: str = "regressor_label", most: int = 4, seed: int = 0) -> DataFrame:
    """(subject, run, trial_index, label, fold): each class's trials dealt in a shuffled
    order; at most ``most`` folds, and no more than the rarest class has trials. Subjects with a
    class of one trial have no folds (see rare_classes); raises if all are such."""
    one = one_per_trial(trials, ["subject", "run", "trial_index"], [label]).select("subject", "run", "trial_index", label)
    k = one.groupBy("subject", label).count().groupBy("subject").agg(F.least(F.lit(most), F.min("count")).cast("int").alias("k"))
    least = k.agg(F.max("k")).first()[0]
    if least is not None and least < 2:
        raise ValueError("no subject has two trials of each class to make folds of")
    order = Window.partitionBy("subject", label).orderBy(shuffled(seed, "run", "trial_index"), "run", "trial_index")
    dealt = one.withColumn("nth", F.row_number().over(order)).join(k, "subject")
    return dealt.where("k >= 2").withColumn("fold", F.pmod(F.col("nth") - 1, F.col("k")) + 1).drop("nth", "k")


def rare_classes(trials: DataFrame, label: str = "regressor_label", least: int = 2) -> DataFrame:
    """(subject, label, n_trials) of classes with fewer trials than folds need; their subjects have none."""
    one = trials.select("subject", "run", "trial_index", label).distinct()
    return one.groupBy("subject", label).agg(F.count("*").alias("n_trials")).where(F.col("n_trials") < least)


def fold_manifest(folds: DataFrame) -> DataFrame:
    return folds.groupBy("subject", "fold").agg(F.sort_array(F.collect_set("run")).alias("runs"))
