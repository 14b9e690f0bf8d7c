import numpy as np
import pytest

from onsetlab.operators import patterns
from onsetlab.operators import workflows as W
from test_sources import exchanges

NAMES = ["a", "b", "c"]
LEAF = {n: {"column": "trial_type", "match": "exact", "value": n} for n in NAMES}
WINDOW = {"start": {"reference": "onset", "offset_seconds": 0}, "end": {"reference": "onset", "offset_seconds": 4}}


@pytest.fixture(scope="module")
def study(spark):
    """Two subjects, three runs of twelve trials of two frames; three features tell the class."""
    rng = np.random.default_rng(3)
    rows, frames = [], []
    for s in ("01", "02"):
        for run in (1, 2, 3):
            f = f"{s}-{run}"
            for t in range(12):
                for v in (2 * t, 2 * t + 1):
                    x = rng.normal(size=6)
                    x[t % 3] += 5.0
                    rows.append((s, run, t + 1, f, NAMES[t % 3], 4.0 * t, 4.0, v))
                    frames.append((f, v, x.tolist()))
    table = spark.createDataFrame(rows, "subject string, run int, trial_index int, boldfile string, trial_type string, onset double, duration double, volume_of_interest int")
    recordings = spark.createDataFrame([(f"{s}-{r}", 2.0, 24) for s in ("01", "02") for r in (1, 2, 3)], "boldfile string, tr double, n_frames int")
    return table.cache(), spark.createDataFrame(frames, "boldfile string, volume int, features array<double>").cache(), recordings.cache()


def config(**model):
    return {"model_conditions": {"training": {"conditions": LEAF}, "testing": {"conditions": LEAF}, "timecourse_decoding": {"conditions": LEAF, "window": WINDOW}}, "model": {"classifier": {"name": "nearest_centroid"}, **model}}


def overall(m):
    return {r.subject: r.value for r in m.where("metric = 'total_scores'").collect()}


def test_generalization(study):
    got = W.run_generalization(*study, config())
    assert min(overall(got["cv_metrics"]).values()) > 0.85 and set(overall(got["metrics"])) == {"01", "02"}
    s = got["decoding_summary"].collect()
    assert {r.window_index for r in s} == {0, 1} and sum(r.trial_count for r in s) == 2 * 3 * 12 * 2
    tables = W.report_tables(got, 3)
    acc = {(r.stage, r.subject) for r in tables["accuracy"].collect()}
    assert acc == {(a, b) for a in ("cv", "test") for b in ("01", "02", "group")}
    assert tables["confusion"].count() == 9 and tables["fold_accuracy"].count() == 6
    assert got["cv_importance"].count() == got["importance"].count() == 6 and "permutation_test" not in got


def test_sections_meet_frames_one_by_one(spark, study, monkeypatch):
    """No list of a recording's rows stands beside each of its frames, and no features are dealt anew."""
    plans, write = [], W.settled
    monkeypatch.setattr(W, "settled", lambda df: plans.append((exchanges(df), df._jdf.queryExecution().optimizedPlan().toString())) or write(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = W.sections(*study, config())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(plans) == 3 and not any("collect_list" in plan for _, plan in plans)
    assert all(moved and not any("features" in x for x in moved) for moved, _ in plans)
    want = {(r.boldfile, r.volume): np.round(r.features, 9).tolist() for r in patterns.zscore(study[1]).collect()}
    rows = got["training"].collect()
    assert len(rows) == 144 and all(np.round(r.features, 9).tolist() == want[r.boldfile, r.volume_of_interest] for r in rows)


def test_permutation_test_in_the_workflow(study):
    got = W.run_generalization(*study, config(permutation_test={"n_permutations": 9}))["permutation_test"].collect()
    assert sorted((r.subject, r.metric, r.n) for r in got) == [(s, m, 9) for s in ("01", "02") for m in ("accuracy", "roc_auc_ovr")] and {r.p for r in got} == {0.1}
    got = W.run_kfold(*study, config(kfold_cv={"strategy": "explicit_groups", "held_out_runs": [[1]]}, permutation_test={"n_permutations": 4}))["permutation_test"].collect()
    assert sorted((r.subject, r.fold, r.metric) for r in got) == [(s, 1, m) for s in ("01", "02") for m in ("accuracy", "roc_auc_ovr")]


def test_final_fit_is_on_all_rows(study):
    """Classes of unequal size: the folds are balanced, the last fit is not."""
    table, frames, recordings = study
    fewer = table.where("trial_type <> 'a' or trial_index > 9")
    seen = {}

    class Watched(W.Fitted):
        def __init__(self, *given):
            super().__init__(*given)
            seen[len(seen)] = {(r.subject, r.fold, r.regressor_label): r.n for r in self.stats.collect()}

    W.Fitted, kept = Watched, W.Fitted
    try:
        W.run_generalization(fewer, frames, recordings, config())
    finally:
        W.Fitted = kept
    assert {k[2]: n for k, n in seen[1].items() if k[:2] == ("01", 0)} == {"a": 6, "b": 24, "c": 24}
    per_class = {}
    for (s, _, label), n in seen[0].items():
        per_class.setdefault((s, label), []).append(n)
    assert all(sum(per_class["01", x]) == sum(per_class["01", "a"]) for x in NAMES)


def test_subjects_that_cannot_be_cross_validated(study):
    """Runs that differ in their classes, and a class with one trial: one subject is left out and told."""
    table, frames, recordings = study
    lone = "trial_type <> 'a' or (run = 1 and trial_index = 1)"
    rows = table.withColumnRenamed("trial_type", "regressor_label")
    few = rows.where("subject = '01' or regressor_label <> 'a' or (run = 1 and trial_index = 1)")
    assert {r.subject for r in W.inner_folds(few).collect()} == {"01"}
    assert [tuple(r) for r in W.not_validated(few, few.where("subject = '01'")).collect()] == [("02", "one trial of a")]
    part = table.where("subject = '01'").unionByName(table.where("subject = '02'").where(lone))
    got = W.run_generalization(part, frames, recordings, config())
    assert set(overall(got["cv_metrics"])) == {"01"} and set(overall(got["metrics"])) == {"01", "02"}
    # balanced with one trial of each class in one run, nothing is left to train on
    assert [tuple(r) for r in got["cv_skipped"].collect()] == [("02", "no fold leaves rows to train on")]
    with pytest.raises(ValueError, match="cross-validated"):
        W.run_generalization(table.where("subject = '02'").where(lone), frames, recordings, config())


def test_kfold(study):
    table, frames, recordings = study
    got = W.run_kfold(table, frames, recordings, config(kfold_cv={"strategy": "per_run"}))
    assert [r.status for r in got["folds"].collect()] == ["run"] * 6
    assert min(overall(got["metrics"]).values()) > 0.85
    one = table.where("subject = '01'")
    assert got["manifest"].count() == 6 and got["fold_warnings"].count() == 0 and got["mean_importance"].count() == 6
    lr = config(kfold_cv={"strategy": "explicit_groups", "held_out_runs": [[1], [9]]}, classifier={"name": "logistic_regression", "params": {"C": 1.0, "max_iter": 20}}, featureSelection={"feat_p": 1e-9})
    got = W.run_kfold(one, frames, recordings, lr)
    assert overall(got["metrics"])["01"] > 0.85
    assert {r.problem for r in got["fold_warnings"].collect()} == {"uncovered", "unknown"}
    weights = {r.label: r.weights for r in got["mean_importance"].collect()}
    assert set(weights) == set(NAMES) and all(np.argmax(w) == NAMES.index(n) for n, w in weights.items())
    r = got["decoding"].first()
    assert r.threshold_p == 1e-9 and r.threshold_used >= 1e-9 and r.selected_voxels >= 3 and r.whole_voxels == 6 and r.feature_percent == pytest.approx(100 * r.selected_voxels / 6)
    assert got["decoding_summary"].first().selected_voxels == r.selected_voxels


def test_timecourse_by_overlay_and_unit(study):
    table, frames, recordings = study
    got = W.run_kfold(table, frames, recordings, config(kfold_cv={"strategy": "per_run"}))
    overlay = {"first": {"column": "run", "match": "exact", "value": "1"}, "a": {"column": "regressor_label", "match": "exact", "value": "a"}}
    made = W.timecourse_tables(got, NAMES, overlay)
    assert made["unit"] == "subject" and made["dropped"] == 2 * 2 * 8 * 2  # two subjects, two runs, trials of b and c, two frames
    assert {(r.overlay_label, r.regressor_label) for r in made["within"].collect()} == {("first", n) for n in NAMES} | {("a", "a")}
    raw = got["decoding"].where("subject = '01' and run = 1 and regressor_label = 'b' and window_index = 1").collect()
    r = made["within"].where("subject = '01' and overlay_label = 'first' and regressor_label = 'b' and window_index = 1 and cat = 'c'").first()
    values = [x.evidence_c for x in raw]
    assert (r["mean"], r.se, r.n) == (pytest.approx(np.mean(values)), pytest.approx(np.std(values, ddof=1) / len(values) ** 0.5), len(values))
    assert {x.n_units for x in made["group"].collect()} == {2}
    # folds are the unit where one subject has several
    one = W.run_kfold(table.where("subject = '01'"), frames, recordings, config(kfold_cv={"strategy": "per_run"}))
    made = W.timecourse_tables(one, NAMES)
    assert made["unit"] == "fold" and made["dropped"] == 0 and {x.n_units for x in made["group"].collect()} == {3}
    single = W.timecourse_tables(W.run_generalization(table.where("subject = '01'"), frames, recordings, config()), NAMES)
    assert single["unit"] == "subject"


def test_skipped_folds(study):
    table, frames, recordings = study
    cv = {"strategy": "explicit_groups", "held_out_runs": [[1, 2, 3], [2]]}
    got = W.run_kfold(table, frames, recordings, config(kfold_cv=cv))
    assert {(r.fold, r.status) for r in got["folds"].collect()} == {(1, "no training rows"), (2, "run")}
    assert {r.fold for r in got["fold_metrics"].collect()} == {2}
    with pytest.raises(ValueError, match="every fold was skipped"):
        W.run_kfold(table, frames, recordings, config(kfold_cv={"strategy": "explicit_groups", "held_out_runs": [[1, 2, 3]]}))


def test_wrong_configuration(study):
    bad = config()
    del bad["model_conditions"]["testing"]
    with pytest.raises(ValueError, match="testing: missing"):
        W.run_generalization(*study, bad)
    with pytest.raises(ValueError, match="kfold_cv is missing"):
        W.run_kfold(*study, config())
    with pytest.raises(ValueError, match="unknown strategy"):
        W.run_kfold(*study, config(kfold_cv={"strategy": "other"}))
