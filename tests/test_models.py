import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.operators import decoding as T
from onsetlab.operators import metrics as M
from onsetlab.operators import models
from onsetlab.operators import patterns as P
from onsetlab.operators import report as R

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Three classes, 12 features of which the first three are shifted by the class."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(90):
        x = rng.normal(size=12)
        x[k % 3] += 4.0
        rows.append(("s", 1 + k % 9 // 3, k, f"r{k % 2}", NAMES[k % 3], x.tolist()))
    return spark.createDataFrame(rows, "subject string, run int, volume int, boldfile string, regressor_label string, features array<double>").cache()


def test_zscore_and_detrend(planted):
    z = P.zscore(planted).where("boldfile = 'r0'").collect()
    x = np.array([r.features for r in z])
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0), 1)
    ramp = planted.withColumn("features", F.transform("features", lambda x: 3.0 * F.col("volume") + 2.0))
    assert np.allclose([r.features for r in P.detrend(ramp).collect()], 0, atol=1e-8)
    const = P.zscore(planted.withColumn("features", F.transform("features", lambda x: F.lit(7.0))))
    assert np.allclose([r.features for r in const.collect()], 0)


def test_selection(planted):
    best = {r.voxel for r in P.select_best(P.anova(planted), 3).collect()}
    assert best == {0, 1, 2}
    p = P.anova_p(planted).cache()
    # against the engine's own test, which knows one group only
    jvm = planted.sparkSession._jvm.org.apache.spark.ml.stat.ANOVATest
    given = planted.select((F.ascii("regressor_label") - 97).cast("double").alias("label"), array_to_vector("features").alias("features"))
    want = {r.featureIndex: (r.pValue, r.fValue) for r in DataFrame(jvm.test(given._jdf, "features", "label", True), planted.sparkSession).collect()}
    assert all(r.p == pytest.approx(want[r.voxel][0], rel=1e-9, abs=1e-15) and r.f == pytest.approx(want[r.voxel][1]) for r in p.collect())
    kept = P.select_below(p, 1e-9, least=5).collect()
    used = 1e-9
    while sum(r.p < used for r in p.collect()) < 5:
        used *= 1.1
    assert len(kept) >= 5 and all(r.threshold_used == pytest.approx(used) for r in kept)
    assert P.select_below(p, 0.999, least=50).count() == p.where("p < 1.0989").count()  # widened past 1 once
    assert P.select_below(p, 1.0).count() == p.where("p < 1").count()


def test_selection_is_by_subject(planted):
    """A second subject whose classes are told by other features; and a constant feature."""
    moved = planted.withColumn("subject", F.lit("t")).withColumn("features", F.concat(F.slice("features", 4, 9), F.slice("features", 1, 3)))
    both = planted.unionByName(moved).withColumn("features", F.transform("features", lambda x, i: F.when(i == 4, 1.0).otherwise(x)))
    p = P.anova_p(both).cache()
    alone = {(r.subject, r.voxel): r.p for r in P.anova_p(both.where("subject = 't'")).collect()}
    assert {(r.subject, r.voxel): r.p for r in p.where("subject = 't'").collect()} == pytest.approx(alone)
    assert {r.p for r in p.where("voxel = 4").collect()} == {1.0}
    chosen = {r.subject: r for r in P.select_features(both, ["subject"], n_voxels=3).collect()}
    assert chosen["s"].voxel_idx == [0, 1, 2] and chosen["t"].voxel_idx == [9, 10, 11] and np.isnan(chosen["s"].threshold_p)
    below = {r.subject: r for r in P.select_features(both, ["subject"], feat_p=1e-30).collect()}
    assert all(r.selected_voxels >= 5 and r.threshold_used > r.threshold_p == 1e-30 and r.whole_voxels == 12 and 4 not in r.voxel_idx for r in below.values())
    assert P.select_features(both, ["subject"]).first().selected_voxels == 12


def test_masks(spark, planted):
    wanted = spark.createDataFrame([("s", "")], "subject string, session string")
    masks = spark.createDataFrame([("s", "", [0, 2])], "subject string, session string, voxel_idx array<int>")
    assert len(P.apply_mask(planted, P.resolve_masks(wanted, masks)).first().features) == 2
    with pytest.raises(ValueError):
        P.resolve_masks(wanted, masks.limit(0))


def test_classifiers(planted):
    train, test = planted.where("run < 3"), planted.where("run = 3")
    chosen = P.select_features(train, ["subject"], n_voxels=3).cache()
    for name in ("logistic_regression", "linear_svc"):
        fitted = models.fit_coefficients(train, chosen, ["subject"], [*NAMES, "untrained"], name, {"max_iter": 50})
        p = models.predict(test, chosen, fitted, ["subject"], [*NAMES, "untrained"])
        assert M.accuracy(p, ["subject"]).first().accuracy > 0.9
        assert [x.label for x in p.first().scores] == NAMES
        maps = {r.label: r.weights for r in models.importance(fitted, chosen, ["subject"]).collect()}
        assert set(maps) == set(NAMES) and all(len(w) == 12 and np.count_nonzero(w) <= 3 for w in maps.values())
    two = train.where("regressor_label <> 'c'")
    fitted = models.fit_coefficients(two, chosen, ["subject"], NAMES)
    p = models.predict(test.where("regressor_label <> 'c'"), chosen, fitted, ["subject"], NAMES)
    assert M.accuracy(p, ["subject"]).first().accuracy > 0.9
    maps = {r.label: np.array(r.weights) for r in models.importance(fitted, chosen, ["subject"]).collect()}
    assert np.allclose(maps["a"], -maps["b"]) and maps["a"][1] > 0 > maps["a"][0]  # the first row points to the second class
    # the optimum of the stated objective: its gradient is near 0
    x, y = np.array([r.features[:3] for r in two.orderBy("volume").collect()]), np.array([r.regressor_label == "b" for r in two.orderBy("volume").collect()], float)
    c = next(r for r in fitted.collect() if r.label == "b")
    # one value for two classes; both weigh the same as they have as many rows
    left = 1 / (1 + np.exp(-(x @ np.array(c.weights) + c.intercept))) - y
    assert np.abs(x.T @ left / len(x) + np.array(c.weights) / len(x)).max() < 1e-3 and abs(left.mean()) < 1e-3
    assert models.fit_coefficients(train.where("regressor_label = 'a'"), chosen, ["subject"], NAMES).count() == 0
    with pytest.raises(ValueError):
        models.fit_coefficients(train, chosen, ["subject"], NAMES, "other")
    p = M.with_evidence(models.centroid_predict(train, test)).cache()
    assert M.accuracy(p, ["subject"]).first().accuracy > 0.9
    assert sum(r.value for r in M.confusion(p, ["subject"]).collect()) == pytest.approx(3)
    assert M.macro_auc(M.auc(p, ["subject"]), ["subject"]).first().macro_auc > 0.9
    assert {r.metric for r in M.tidy(p, ["subject"]).collect()} == {"total_scores", "accuracy", "evidence", "auc"}
    table = T.decoding_table(p, [*NAMES, "untrained"], chosen, ["subject"], "m")
    assert table.where("evidence_untrained is not null").count() == 0
    r = table.first()
    assert (r.selected_voxels, r.whole_voxels, r.feature_percent, r.model_descr) == (3, 12, 25.0, "m") and np.isnan(r.threshold_p)


def test_permutations(planted, monkeypatch):
    want = _brute_permutations(planted, 9)
    # whole patterns; slices of five features in chunks of four permutations, in one task each and in blocks of rows
    for size, columns, alone in ((64_000_000, 8192, 90), (3 * 8 * 4 * 5, 12, 90), (3 * 8 * 4 * 5, 12, 89)):
        monkeypatch.setattr(models, "CHUNK_BYTES", size)
        monkeypatch.setattr(models, "COLUMNS", columns)
        monkeypatch.setattr(models, "ALONE", alone)
        monkeypatch.setattr(models, "TRAIN_ROWS", 7)
        monkeypatch.setattr(models, "TEST_ROWS", 5)
        monkeypatch.setattr(models, "LISTED", 4)
        scores = models.permutation_centroid(planted, [3], 9).cache()
        assert {(r.perm, r.metric): r.value for r in scores.collect()} == pytest.approx(want)
    p = {r.metric: (r.p, r.n) for r in models.permutation_p(scores, ["subject", "metric"]).collect()}
    assert p == {"accuracy": (pytest.approx(0.1), 9), "roc_auc_ovr": (pytest.approx(0.1), 9)}
    fitted = models.permutation_fitted(planted, F.col("run") == 3, 4, NAMES, feat_p=0.05, params={"max_iter": 20})
    assert {r.metric: r.p for r in models.permutation_p(fitted, ["subject", "metric"]).collect()} == {"accuracy": pytest.approx(0.2), "roc_auc_ovr": pytest.approx(0.2)}


def test_scores_that_differ_by_noise_tie(spark):
    """Equal patterns may get scores that differ in their last digits."""
    scores = np.array([[0.3, 0.1], [0.3 + 4e-16, 0.1 - 3e-17], [0.2, 0.4]])
    truth = np.array([0, 1, 1])
    assert models.scored(scores, truth, np.array([0, 1])) == (pytest.approx(2 / 3), pytest.approx(0.75))
    rows = [("s", "ab"[t], [("a", float(r[0])), ("b", float(r[1]))], [float(v) for v in r]) for r, t in zip(scores, truth)]
    p = spark.createDataFrame(rows, "subject string, regressor_label string, scores array<struct<label:string,score:double>>, evidence array<double>")
    assert {r.label: r.auc for r in M.auc(p, ["subject"]).collect()} == {"a": 0.75, "b": 0.75}


@pytest.mark.parametrize("alone", [2048, 1])
def test_permutations_without_a_test_row_of_a_class(spark, monkeypatch, alone):
    """Their area is NaN, not null, and counts as no less than the real one."""
    monkeypatch.setattr(models, "ALONE", alone)
    rng = np.random.default_rng(2)
    rows = [("s", 1 + k // 8, k, "abc"[0 if k in (1, 12) else 1 + k % 2], rng.normal(size=4).tolist()) for k in range(16)]
    df = spark.createDataFrame(rows, "subject string, run int, volume int, regressor_label string, features array<double>")
    for got in (models.permutation_centroid(df, [2], 12), models.permutation_fitted(df, [2], 12, ["a", "b", "c"], params={"max_iter": 3})):
        area = {r.perm: r.value for r in got.where("metric = 'roc_auc_ovr'").collect()}
        none = {k for k, v in area.items() if v is not None and np.isnan(v)}
        assert None not in area.values() and none and 0 not in none and len(area) == 13
        hits = sum(k in none or v >= area[0] for k, v in area.items() if k)
        p = {r.metric: r.p for r in models.permutation_p(got, ["subject", "metric"]).collect()}
        assert p["roc_auc_ovr"] == pytest.approx((1 + hits) / 13)


def test_feature_slices(planted):
    """Each value is in one slice, whatever the width."""
    for wide, sizes in ((5, [5, 5, 2]), (12, [12]), (64, [12])):
        got = planted.select("features", models.feature_slices(F.col("features"), wide).alias("s")).first()
        assert [len(x) for x in got.s] == sizes and sum(got.s, []) == got.features
    empty = planted.select(models.feature_slices(F.array().cast("array<double>"), 5).alias("s"), models.centred(F.col("features")).alias("c")).first()
    assert empty.s == [[]] and sum(empty.c) == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("score_bytes", [16_000_000, 2 * 30 * 24, 1])
def test_permutations_of_large_subjects(planted, monkeypatch, score_bytes):
    """Scored in tasks, all permutations or two at a time; only test rows too many for a task are listed by permutation."""
    listed, both = [], models.both_metrics
    monkeypatch.setattr(models, "both_metrics", lambda pred, keys: listed.append(pred.count()) or both(pred, keys))
    monkeypatch.setattr(models, "ALONE", 1)
    monkeypatch.setattr(models, "SCORE_BYTES", score_bytes)
    got = models.permutation_centroid(planted, [3], 5).collect()
    assert {(r.perm, r.metric): r.value for r in got} == pytest.approx(_brute_permutations(planted, 5)) and len(got) == 12
    assert (listed[0] > 0) == (score_bytes == 1)


@pytest.mark.parametrize("score_bytes", [16_000_000, 2 * 30 * 24])
def test_permutations_whose_patterns_are_not_moved(planted, monkeypatch, score_bytes):
    """Patterns too large for a task: products with the means are moved to where they are scored."""
    monkeypatch.setattr(models, "ALONE", 1)
    monkeypatch.setattr(models, "PATTERN_BYTES", 30 * 12 * 8 - 1)
    monkeypatch.setattr(models, "SCORE_BYTES", score_bytes)
    got = models.permutation_centroid(planted, [3], 5).collect()
    assert {(r.perm, r.metric): r.value for r in got} == pytest.approx(_brute_permutations(planted, 5)) and len(got) == 12


def _shuffled_place(volumes, perm, seed):
    """The volumes in the order whose labels go to the first, second, ... volume."""
    return sorted(volumes, key=lambda v: ("" if perm == 0 else hashlib.md5(f"{seed}|{perm}|{v}".encode()).hexdigest(), v))


@pytest.mark.parametrize("rows_of_a_task", [131_072, 40])
def test_permuted_codes(spark, monkeypatch, rows_of_a_task):
    """In tasks for four permutations at a time, or by windows; ids whose texts have another order, labels that are none or not asked for."""
    monkeypatch.setattr(models, "SHUFFLED_ROWS", rows_of_a_task)
    monkeypatch.setattr(models, "PERMS", 4)
    own = {s: {v: [None, "a", "b", "c"][(v * v + len(s)) % 4] for v in volumes} for s, volumes in (("s", range(-3, 110, 2)), ("tt", range(95, 125)))}
    rows = spark.createDataFrame([(s, v, c) for s, of in own.items() for v, c in of.items()], "subject string, volume int, regressor_label string")
    codes = models.permuted_codes(rows, 9, ["c", "a"], 3).collect()
    labels = {(r.subject, r.volume): r.given for r in models.permuted_labels(rows, 9, 3).collect()}
    assert len(codes) == len(labels) == rows.count()
    for s, of in own.items():
        got = {r.volume: r.codes for r in codes if r.subject == s}
        for perm in range(10):
            want = dict(zip(sorted(of), (of[v] for v in _shuffled_place(of, perm, 3))))
            assert {v: c[perm] for v, c in got.items()} == {v: {"c": 0, "a": 1}.get(c, -1) for v, c in want.items()}
            assert {v: labels[s, v][perm] for v in of} == want


@pytest.mark.parametrize("rows_of_a_task", [131_072, 1])
@pytest.mark.parametrize("test", ["centroid", "fitted"])
def test_no_permutations_are_broadcast(planted, monkeypatch, capsys, test, rows_of_a_task):
    """Rows by permutation, and rows with the codes of all, are estimated as small as the table; through the driver they don't fit."""
    plans, settled = [], models.settled

    def explained(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return settled(df)

    monkeypatch.setattr(models, "SHUFFLED_ROWS", rows_of_a_task, raising=False)
    monkeypatch.setattr(models, "settled", explained)
    if test == "centroid":
        models.permutation_centroid(planted, [3], 3).collect()
    else:
        models.permutation_fitted(planted, [3], 3, NAMES, params={"max_iter": 2}).collect()
    joins = [line for plan in plans for line in plan.splitlines() if "HashJoin" in line or "NestedLoopJoin" in line]
    assert len(plans) > 1 and joins and not [line for line in joins if "perm" in line or "volume" in line]


def _brute_permutations(planted, n):
    rows = sorted(planted.collect(), key=lambda r: r.volume)
    x, held = np.array([r.features for r in rows]), np.array([r.run == 3 for r in rows])
    out = {}
    for perm in range(n + 1):
        order = sorted(range(len(rows)), key=lambda k: ("" if perm == 0 else hashlib.md5(f"0|{perm}|{rows[k].volume}".encode()).hexdigest(), rows[k].volume))
        y = np.array([rows[k].regressor_label for k in order])
        means = np.array([x[~held & (y == c)].mean(axis=0) for c in NAMES])
        r = np.corrcoef(x[held], means)[: held.sum(), held.sum() :]
        out[perm, "accuracy"] = np.mean([NAMES[k] == t for k, t in zip(r.argmax(axis=1), y[held])])
        areas = [np.mean([(p > q) + (p == q) / 2 for p in r[y[held] == c, k] for q in r[y[held] != c, k]]) for k, c in enumerate(NAMES)]
        out[perm, "roc_auc_ovr"] = np.mean(areas)
    return out


def test_baselines(planted):
    got = {(r.method, r.protocol, r.metric): r.value for r in models.compare_baselines(planted, [3], NAMES, params={"max_iter": 20}).collect()}
    assert set(got) == {(m, p, k) for m in ("nearest_centroid", "linear_svc") for p in ("matched_split", "leave_one_run_out") for k in ("accuracy", "roc_auc_ovr")}
    assert min(got.values()) > 0.85


def test_auc_with_ties_and_one_side(spark):
    rows = [("x", "a", [("a", 0.9), ("b", 0.1)]), ("x", "a", [("a", 0.5), ("b", 0.5)]), ("x", "b", [("a", 0.5), ("b", 0.5)])]
    p = spark.createDataFrame(rows, "subject string, regressor_label string, scores array<struct<label:string,score:double>>").withColumn("evidence", F.transform("scores", lambda s: s["score"]))
    assert {r.label: r.auc for r in M.auc(p, ["subject"]).collect()} == {"a": 0.75, "b": 0.75}
    one = M.auc(p.where("regressor_label = 'a'"), ["subject"]).collect()
    assert all(np.isnan(r.auc) for r in one)


def test_errors_and_majority(spark):
    rows = spark.createDataFrame([("u", v) for v in (0.8, 0.6, 0.4, 0.2)] + [("one", 0.5)], "unit string, value double")
    w = {r.unit: (r["mean"], r.se) for r in T.within_unit(rows, ["unit"]).collect()}
    assert w["u"] == (pytest.approx(0.5), pytest.approx(np.std([0.8, 0.6, 0.4, 0.2], ddof=1) / 2)) and w["one"] == (0.5, 0.0)
    tr = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 2.0)], "boldfile string, tr double")
    assert tuple(R.majority_tr(tr).select("tr", "several").first()) == (2.0, True)
    maps = spark.createDataFrame([("1", "a", [1.0, 3.0], "mni"), ("2", "a", [3.0, 5.0], "mni"), ("3", "a", [9.0], "mni"), ("4", "a", [9.0, 9.0], "unasserted")], "subject string, label string, weights array<double>, space string")
    mean, left = R.group_importance(maps)
    assert mean.first().weights == [2.0, 4.0] and {r.subject for r in left.collect()} == {"3", "4"}
