import pytest
from pyspark.sql import functions as F

from onsetlab.operators import sampling as S


def test_balance_prefers_fuller_trials(spark):
    rows = [("s", "a", 1, 1, v, "r") for v in range(3)] + [("s", "a", 1, 2, 9, "r")] + [("s", "b", 1, 3, v, "r") for v in (5, 6)]
    df = spark.createDataFrame(rows, "subject string, regressor_label string, run int, trial_index int, volume_of_interest int, boldfile string")
    out = sorted((r.regressor_label, r.trial_index, r.volume_of_interest) for r in S.balance(df).collect())
    assert out == [("a", 1, 1), ("a", 1, 2), ("b", 3, 5), ("b", 3, 6)]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("s", r) for r in (1, 2, 3, 4, 5)], "subject string, run int")


def test_folds(spark, runs):
    assert sorted((r.run, r.fold) for r in S.group_folds(runs, 2).collect()) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
    with pytest.raises(ValueError):
        S.group_folds(runs, 6)
    with pytest.raises(ValueError):
        S.group_folds(runs, 1)
    more = runs.unionByName(spark.createDataFrame([("few", 1), ("few", 2)], runs.schema))
    assert {r.subject for r in S.group_folds(more, 3).collect()} == {"s"}  # one subject doesn't stop the others
    assert [tuple(r) for r in S.short_subjects(more, 3).collect()] == [("few", 2)]
    folds, problems = S.explicit_folds(spark, runs, [[1, 2], [2, 3, 9]])
    assert sorted((r.run, r.fold) for r in folds.collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]
    assert sorted((r.run_text, r.problem) for r in problems.collect()) == [("4", "uncovered"), ("5", "uncovered"), ("9", "unknown")]
    train, test = S.split_runs(runs, S.per_run(runs))
    assert (train.count(), test.count()) == (20, 5)
    status = S.fold_status(S.per_run(runs), train, test.where("fold <> 2"))
    assert {r.fold: r.status for r in status.collect()} == {1: "run", 2: "nothing to score", 3: "run", 4: "run", 5: "run"}
    assert all(S.validate_strategy(x) for x in (None, {}, {"strategy": "group_kfold", "n_splits": 1}, {"strategy": "explicit_groups", "held_out_runs": [[]]}))
    assert S.validate_strategy({"strategy": "group_kfold", "n_splits": True}) and not S.validate_strategy({"strategy": "per_run"})


def test_trial_folds(spark):
    rows = [("s", 1, t, "a") for t in range(6)] + [("s", 2, t, "rare") for t in range(2)]
    df = spark.createDataFrame(rows + rows, "subject string, run int, trial_index int, regressor_label string")
    out = S.trial_folds(df).collect()
    assert len(out) == 8 and {r.fold for r in out} == {1, 2}
    assert sorted(r.fold for r in out if r.regressor_label == "rare") == [1, 2]


def test_too_few_trials_are_told(spark):
    cols = "subject string, run int, trial_index int, regressor_label string"
    rare = [("r", 1, t, "a") for t in range(6)] + [("r", 2, 7, "b")]
    df = spark.createDataFrame([("s", 1, t, "ab"[t % 2]) for t in range(6)] + rare, cols)
    assert {r.subject for r in S.trial_folds(df).collect()} == {"s"}
    assert [tuple(r) for r in S.rare_classes(df).collect()] == [("r", "b", 1)]
    with pytest.raises(ValueError, match="two trials"):
        S.trial_folds(df.where("subject = 'r'"))
    assert S.trial_folds(df.limit(0)).count() == 0


def test_pairs(spark):
    cols = "subject string, session string, task string, run int, boldfile string, tr double"
    df = spark.createDataFrame([("s", "", "a", 1, "a1", 2.0), ("s", "", "a", 3, "a3", 2.0), ("s", "", "b", 2, "b2", 2.0), ("s", "", "b", 4, "b4", 1.0)], cols)
    pairs = S.pair_runs(df, "a", "b")
    assert sorted((r.boldfile_a, r.boldfile_b) for r in pairs.collect()) == [("a1", "b2"), ("a3", "b4")]
    with pytest.raises(ValueError):
        S.check_pairs(pairs)
    S.check_pairs(pairs.where("nth = 1"))
    grids = pairs.where("nth = 1").withColumn("grid_key_a", F.lit("2x3x4 a"))
    assert S.pair_problems(grids.withColumn("grid_key_b", F.lit("2x3x4 a"))).first().problem is None
    assert S.pair_problems(grids.withColumn("grid_key_b", F.lit("2x3x4 b"))).first().problem == "grid_key differs"
    assert [r.homogeneous for r in S.homogeneous_runs(df.withColumnRenamed("boldfile", "regressor_label")).collect()] == [False]


def test_trial_split_keeps_trials_whole(spark):
    rows = [("s", 1 + t % 2, t, "ab"[t % 2], v) for t in range(6) for v in (2 * t, 2 * t + 1)]
    df = spark.createDataFrame(rows, "subject string, run int, trial_index int, regressor_label string, volume int")
    folds = S.trial_folds(df)
    train, test = S.split_trials(df, folds)
    held = {(r.fold, r.volume) for r in test.collect()}
    assert len(held) == 12 and {(f, v ^ 1) for f, v in held} == held  # every row once, both frames of a trial together
    assert {(r.fold, r.volume) for r in train.collect()} == {(f, v) for f in {f for f, _ in held} for v in range(12)} - held
