"""Whole workflows: the operators chained under one configuration object.

Tables in, tables out: volumes (build_volumes), patterns (boldfile, volume, features; with
subject and session where masks are given), recordings (boldfile, tr, n_frames), masks
(subject, session, voxel_idx). All subjects and folds are keys of the same jobs. Statistics are
made once by the unit that folds hold out; choosing features and mean patterns subtract a fold's units from
all, so training rows are never multiplied by folds. Fits of all folds share
their subject's rows (see fits), and predicting is one join with a table of coefficients.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.functions import decision_evidence
from onsetlab.operators import conditions, decoding, metrics, models, patterns, report, sampling, volumes
from onsetlab.sources.frames import drop_frames, store_frames
from onsetlab.sources.store import settled

KEYS = ["subject", "fold"]


def sections(table: DataFrame, frames: DataFrame, recordings: DataFrame, config: dict, masks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Labelled rows with features of each section of model_conditions, written once. Standard scores are
    over all frames of a run, whichever the sections choose. Raises on a wrong configuration."""
    table = volumes.drop_bad_volumes(table)
    errors, _ = conditions.validate_config(config, table)
    if errors:
        raise ValueError("; ".join(errors))
    if masks is not None:
        frames = patterns.apply_mask(frames, patterns.resolve_masks(frames, masks), ["subject", "session"])
    # written by frame once (numbers as long, which those of rows are made to meet); sections bring their rows to the frames, each to its own
    scored = store_frames(patterns.zscore(frames.withColumn("volume", F.col("volume").cast("long"))), by=("boldfile", "volume"))
    out = {}
    for name, section in config["model_conditions"].items():
        rows = conditions.label_rows(table, section["conditions"])
        if name == "timecourse_decoding":
            rows = decoding.timecourse_rows(rows, recordings, section["window"])
        out[name] = settled(patterns.slice_patterns(rows, scored))
    drop_frames(table.sparkSession, scored)
    return out


def inner_folds(train: DataFrame) -> DataFrame:
    """(subject, fold, run, trial_index): each run held out once where all runs of the
    subject have the same classes, else trials dealt by class. Subjects of the second kind with a
    class of one trial have none (see not_validated)."""
    same = sampling.homogeneous_runs(train)
    trials = train.select("subject", "run", "trial_index").distinct()
    runs = sampling.per_run(sampling.fold_universe(train.join(same.where("homogeneous"), "subject", "left_semi")))
    by_run = trials.join(runs, ["subject", "run"])
    others = train.join(same.where("not homogeneous"), "subject", "left_semi")
    by_trial = sampling.trial_folds(others.join(sampling.rare_classes(others), "subject", "left_anti"))
    return by_run.select(*KEYS, "run", "trial_index").unionByName(by_trial.select(*KEYS, "run", "trial_index"))


def not_validated(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """(subject, problem) of subjects without any scored fold."""
    same = sampling.homogeneous_runs(rows)
    rare = sampling.rare_classes(rows.join(same.where("not homogeneous"), "subject", "left_semi"))
    told = rare.groupBy("subject").agg(F.concat(F.lit("one trial of "), F.array_join(F.sort_array(F.collect_set("regressor_label")), ", ")).alias("problem"))
    left = rows.select("subject").distinct().join(scored.select("subject").distinct(), "subject", "left_anti").join(told, "subject", "left")
    return left.select("subject", F.coalesce("problem", F.lit("no fold leaves rows to train on")).alias("problem"))


def outer_folds(universe: DataFrame, cv: dict | None) -> tuple[DataFrame, DataFrame]:
    """(subject, run, fold) by the strategy of kfold_cv, and warnings (subject, run_text, problem)."""
    errors = sampling.validate_strategy(cv)
    if errors:
        raise ValueError("; ".join(errors))
    if universe.isEmpty():
        raise ValueError("no runs to fold over")
    if cv["strategy"] == "explicit_groups":
        return sampling.explicit_folds(universe.sparkSession, universe, cv["held_out_runs"])
    none = F.lit(None).cast("string")
    if cv["strategy"] == "per_run":
        return sampling.per_run(universe), universe.limit(0).select("subject", none.alias("run_text"), none.alias("problem"))
    short = sampling.short_subjects(universe, cv["n_splits"])
    return sampling.group_folds(universe, cv["n_splits"]), short.select("subject", none.alias("run_text"), F.lit("too few runs").alias("problem"))


class Fitted:
    """What the rows outside each (subject, fold) fit: chosen features, class weights and maps. Without
    folds all rows are trained on, as fold 0. ``unit``: the columns that folds hold out."""

    def __init__(self, rows: DataFrame, categories: list[str], model: dict, folds: DataFrame | None = None, unit: list[str] = ("run",)):
        self.categories, how, chosen = categories, model["classifier"], model["featureSelection"]
        self.centroid = how["name"] == "nearest_centroid"
        self.descr = model.get("desc", how["name"])
        rows = rows.where(F.col("regressor_label").isin(list(categories)))
        if folds is None:
            self.stats = settled(patterns.class_stats(rows.withColumn("fold", F.lit(0)), KEYS))
        else:
            self.stats = settled(patterns.stats_outside(settled(patterns.class_stats(rows, ["subject", *unit])), folds, unit))
        # without selection the centroid classifier sees all features
        self.chosen = settled(patterns.select_by(self.stats, KEYS, *(() if self.centroid else (chosen.get("n_voxels"), chosen.get("feat_p")))))
        if self.centroid:
            self.coefficients = None
        elif folds is None:
            self.coefficients = models.fit_coefficients(rows.withColumn("fold", F.lit(0)), self.chosen, KEYS, categories, how["name"], how.get("params"))
        else:
            self.coefficients = models.fit_folds(rows, folds, self.chosen, categories, how["name"], how.get("params"), unit)

    def predict(self, test: DataFrame) -> DataFrame:
        """Predictions for the test rows by their key's fit, written once; keys without one are left out."""
        if self.centroid:
            return settled(models.centroid_scores(self.stats, test, KEYS))
        return settled(models.predict(test, self.chosen, self.coefficients, KEYS, self.categories))

    def maps(self) -> DataFrame:
        """(subject, fold, label, weights) in the full feature space: class weights, or mean patterns."""
        if self.centroid:
            return patterns.class_means(self.stats, KEYS).toDF(*KEYS, "label", "weights")
        return models.importance(self.coefficients, self.chosen, KEYS)

    def decoded(self, pred: DataFrame) -> DataFrame:
        """The decoding table of predictions; evidence is a probability over the classes."""
        two = len(self.categories) == 2
        values = F.array(F.col("scores")[1]["score"]) if two else F.transform("scores", lambda s: s["score"])
        return decoding.decoding_table(pred.withColumn("evidence", decision_evidence(values, len(self.categories))), self.categories, self.chosen, KEYS, self.descr).drop("evidence")


def mean_maps(maps: DataFrame) -> DataFrame:
    """(subject, label, weights): each subject's maps averaged over its folds."""
    return patterns.array_stats(maps, ["subject", "label"], "weights").select("subject", "label", F.col("mean").alias("weights"))


def scores(pred: DataFrame, categories: list[str]) -> DataFrame:
    """Tidy metrics by subject and fold."""
    return metrics.tidy(pred.withColumn("evidence", metrics.scoring_evidence(len(categories) == 2)), KEYS)


def significance(train: DataFrame, test: DataFrame, categories: list[str], model: dict) -> DataFrame:
    """(subject, metric, real, p, n): the permutation test of both metrics; labels are shuffled
    among a subject's training and test rows together."""
    asked, how, chosen = model["permutation_test"], model["classifier"], model["featureSelection"]
    both = train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("subject").orderBy("held", "boldfile", "volume_of_interest", "trial_index", "regressor_label")
    rows = settled(both.select("subject", "held", "regressor_label", "features", F.row_number().over(order).alias("volume")))
    held, n, seed = F.col("held"), asked["n_permutations"], asked["random_state"]
    if how["name"] == "nearest_centroid":
        each = models.permutation_centroid(rows, held, n, seed)
    else:
        each = models.permutation_fitted(rows, held, n, categories, how["name"], how.get("params"), chosen.get("n_voxels"), chosen.get("feat_p"), seed)
    return models.permutation_p(each, ["subject", "metric"])


def run_generalization(table: DataFrame, frames: DataFrame, recordings: DataFrame, config: dict, masks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cross-validate on the balanced training section; fit on all of it; score on the testing
    section; decode.

    cv_metrics and cv_importance (means over the inner folds), fold_metrics (each of them),
    cv_skipped (subjects that could not be cross-validated, and why),
    metrics and importance (testing, fold 0), where the configuration asks for it
    permutation_test, and where the section is given decoding and decoding_summary."""
    parts = sections(table, frames, recordings, config, masks)
    model = conditions.model_config(config.get("model"))
    categories = list(config["model_conditions"]["training"]["conditions"])
    train = parts["training"]
    balanced, unit = settled(sampling.balance(train)), ["run", "trial_index"]
    folds = settled(inner_folds(balanced))
    inner = Fitted(balanced, categories, model, folds, unit)
    each = settled(scores(inner.predict(sampling.held_rows(balanced, folds, unit)), categories))
    if each.isEmpty():
        raise ValueError(f"no subject can be cross-validated: {not_validated(balanced, each).limit(5).collect()}")
    out = {"cv_metrics": metrics.fold_average(each, ["subject"]), "fold_metrics": each, "cv_skipped": not_validated(balanced, each), "cv_importance": mean_maps(inner.maps())}
    whole = lambda df: df.withColumn("fold", F.lit(0))
    final = Fitted(train, categories, model)  # not balanced: its fit weighs the classes
    out |= {"metrics": scores(final.predict(whole(parts["testing"])), categories), "importance": final.maps()}
    if "permutation_test" in model:
        out["permutation_test"] = significance(train, parts["testing"], categories, model)
    if "timecourse_decoding" in parts:
        out |= _decoding(final, whole(parts["timecourse_decoding"]))
    return out


def _decoding(fitted: Fitted, rows: DataFrame) -> dict[str, DataFrame]:
    table = fitted.decoded(fitted.predict(rows))
    return {"decoding": table, "decoding_summary": decoding.summary(table, [f"evidence_{c}" for c in fitted.categories], ["subject", "model_descr"])}


def run_kfold(table: DataFrame, frames: DataFrame, recordings: DataFrame, config: dict, masks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each fold is fitted on the training rows outside its runs (not balanced) and scored
    and decoded on the rows within them. Folds that can't be fitted or scored are skipped;
    raises where no fold has rows to score.

    folds (with their status), fold_warnings, manifest, fold_metrics, metrics (mean over folds),
    importance (by fold), mean_importance (over the scored folds), where the configuration asks
    for it permutation_test (by fold), and where the section is given decoding and
    decoding_summary (over the rows of all folds)."""
    parts = sections(table, frames, recordings, config, masks)
    model = conditions.model_config(config.get("model"))
    categories = list(config["model_conditions"]["training"]["conditions"])
    train = parts.pop("training")
    folds, warnings = outer_folds(sampling.fold_universe(*parts.values()), model.get("kfold_cv"))
    folds = settled(folds)
    within = {n: sampling.held_rows(t, folds) for n, t in parts.items()}
    tally = lambda t: t.groupBy("subject", "run").agg(F.count("*").alias("n_rows"))
    light = {n: sampling.held_rows(tally(t), folds) for n, t in parts.items()}
    status = settled(sampling.fold_status(folds, sampling.split_runs(tally(train), folds)[0], light["testing"], light.get("timecourse_decoding")))
    if status.where("status = 'run' and n_test > 0").isEmpty():
        raise ValueError("every fold was skipped: none has rows to train on and rows to score")
    run = status.where("status = 'run'").select(*KEYS)
    fitted = Fitted(train, categories, model, folds.join(run, KEYS, "left_semi"))
    each = settled(scores(fitted.predict(within["testing"]), categories))
    scored = fitted.maps().join(status.where("n_test > 0").select(*KEYS), KEYS, "left_semi")
    out = {"folds": status, "fold_warnings": warnings, "manifest": sampling.fold_manifest(folds), "fold_metrics": each, "metrics": metrics.fold_average(each, ["subject"]), "importance": fitted.maps(), "mean_importance": mean_maps(scored)}
    if "permutation_test" in model:
        # a fold of a subject is shuffled for itself
        unit = lambda df: df.join(run, KEYS, "left_semi").withColumn("subject", F.concat_ws("\0", "subject", "fold"))
        tested = significance(unit(sampling.split_runs(train, folds)[0]), unit(within["testing"]), categories, model)
        parts_of = F.split("subject", "\0")
        out["permutation_test"] = tested.withColumn("fold", parts_of[1].cast("int")).withColumn("subject", parts_of[0])
    if "timecourse_decoding" in within:
        out |= _decoding(fitted, within["timecourse_decoding"])
    return out


def timecourse_tables(results: dict[str, DataFrame], categories: list[str], overlay: dict[str, dict] | None = None) -> dict:
    """The time course of a result's raw decoding rows: ``within`` each unit and ``group`` over them, by
    overlay where overlay conditions are given; ``unit`` says what the units are (folds where one subject
    alone has several) and ``dropped`` how many rows no overlay condition holds for."""
    raw = results["decoding"]
    unit = decoding.units(raw)
    within, seen = decoding.timecourse(raw, [f"evidence_{c}" for c in categories], overlay, unit)
    within = settled(within)
    keys = [c for c in within.columns if c not in (*unit, "mean", "se", "n")]
    return {"within": within, "group": decoding.across_units(within, keys), "unit": unit[-1], "dropped": seen.get["dropped"] if seen else 0}


def report_tables(results: dict[str, DataFrame], n_classes: int) -> dict[str, DataFrame]:
    """Tables of a report from what the two functions above return."""
    staged = {s: results[n] for s, n in (("cv", "cv_metrics"), ("test", "metrics")) if n in results}
    total = lambda s, d, *more: d.where("metric = 'total_scores'").select(F.lit(s).alias("stage"), "subject", *more, F.col("value").alias("accuracy"))
    m = results["metrics"]
    areas = m.where("metric = 'auc'").select(F.col("row_label").alias("label"), F.col("value").alias("auc"))
    return {
        "accuracy": report.accuracy_table(reduce(DataFrame.unionByName, [total(s, d) for s, d in staged.items()]), n_classes),
        "fold_accuracy": report.fold_values(total("cv", results["fold_metrics"], "fold")),
        "auc": report.auc_quartiles(areas),
        "confusion": report.group_matrix(m.where("metric = 'accuracy'")),
        "evidence": report.group_matrix(m.where("metric = 'evidence'")),
    }
