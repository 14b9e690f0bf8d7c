"""The optimiser of many fits against MLlib and brute force, and what its jobs read."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from onsetlab.operators import fits, models
from onsetlab.operators import patterns as P
from onsetlab.operators import sampling as S

NAMES = ["a", "b", "c"]


def _rows(spark, subjects, n=60, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        for k in range(n):
            x = rng.normal(size=d)
            x[k % 3] += 1.0
            # one class is rarer, so that weights matter
            if k % 3 < 2 or k % 2:
                rows.append((f"s{s}", 1 + k // 3 % 4, k, NAMES[k % 3], x.tolist()))
    return spark.createDataFrame(rows, "subject string, run int, volume int, regressor_label string, features array<double>").cache()


def _mllib(df, classes):
    n = df.count()
    sizes = {r.regressor_label: r["count"] for r in df.groupBy("regressor_label").count().collect()}
    number = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i)))), F.col("regressor_label"))
    weight = F.element_at(F.create_map(*(F.lit(x) for c in classes for x in (c, n / (len(classes) * sizes[c])))), F.col("regressor_label"))
    lr = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=5000, tol=1e-12)
    m = lr.fit(df.select(array_to_vector("features").alias("vector"), number.alias("label"), weight.alias("weight")))
    return m.coefficientMatrix.toArray(), m.interceptVector.toArray()


@pytest.mark.parametrize("block_bytes", [64_000_000, 8 * 8 * 12])
def test_weights_are_mllibs(spark, monkeypatch, block_bytes):
    """In one block, and in several that take a job for each step."""
    monkeypatch.setattr(fits, "BLOCK_BYTES", block_bytes)
    rows = _rows(spark, 2)
    chosen = P.select_features(rows, ["subject"])
    got = models.fit_coefficients(rows, chosen, ["subject"], NAMES).collect()
    for s in ("s0", "s1"):
        w, b = _mllib(rows.where(F.col("subject") == s), NAMES)
        for r in (r for r in got if r.subject == s):
            assert np.allclose(r.weights, w[NAMES.index(r.label)], atol=1e-4) and r.intercept == pytest.approx(b[NAMES.index(r.label)], abs=1e-4)
    two = rows.where("regressor_label <> 'b' and subject = 's0'")
    got = {r.label: r for r in models.fit_coefficients(two, chosen, ["subject"], NAMES).collect()}
    w, b = _mllib(two, ["a", "c"])  # two classes have one vector
    assert np.allclose(got["c"].weights, w[0], atol=1e-4) and got["c"].intercept == pytest.approx(b[0], abs=1e-4)
    assert np.allclose(got["a"].weights, -w[0], atol=1e-4)


def test_blocks_and_whole_keys_agree(spark, monkeypatch):
    rows = _rows(spark, 1)
    chosen = P.select_features(rows, ["subject"], n_voxels=4)
    for name in fits.FITTED:
        monkeypatch.setattr(fits, "BLOCK_BYTES", 64_000_000)
        one = {r.label: r for r in models.fit_coefficients(rows, chosen, ["subject"], NAMES, name, {"max_iter": 6}).collect()}
        monkeypatch.setattr(fits, "BLOCK_BYTES", 8 * 8 * 10)
        many = {r.label: r for r in models.fit_coefficients(rows, chosen, ["subject"], NAMES, name, {"max_iter": 6}).collect()}
        assert set(one) == set(many) == set(NAMES)
        for c in NAMES:
            assert np.allclose(one[c].weights, many[c].weights, atol=1e-5) and one[c].intercept == pytest.approx(many[c].intercept, abs=1e-5)


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    x[np.arange(90), y] += 0.5
    state = fits.Chunk(0, 1, 3, 5, "linear_svc", {"C": 2.0}, [np.arange(5)], None)
    block = fits.Block(x, y[:, None])
    while not state.done:
        state.advance(state.of_block(block))
    for _, c, w, b, _ in state.results():
        v, sign = np.array([*w, b]), np.where(y == c, 1.0, -1.0)
        cost = 2.0 * np.where(sign > 0, 90 / (3 * (y == c).sum()), 1.0)
        one = np.concatenate([x, np.ones((90, 1))], axis=1)
        value = lambda v: (cost * np.square(np.maximum(0, 1 - sign * (one @ v)))).sum() + v @ v / 2  # noqa: E731,B023
        assert all(value(v) <= value(v + 1e-3 * e) + 1e-9 for e in np.concatenate([np.eye(6), -np.eye(6)]))


@pytest.mark.parametrize("block_bytes", [64_000_000, 8 * 8 * 20])
def test_jobs_do_not_grow_with_keys(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(fits, "BLOCK_BYTES", block_bytes)
    tracker = spark.sparkContext.statusTracker()

    def jobs(subjects, seed):
        rows = _rows(spark, subjects, seed=seed)
        chosen = P.select_features(rows, ["subject"]).cache()
        chosen.count()
        group = f"fits-{subjects}-{block_bytes}"
        spark.sparkContext.setJobGroup(group, group)
        models.fit_coefficients(rows, chosen, ["subject"], NAMES, params={"max_iter": 4}).count()
        spark.sparkContext.setJobGroup("other", "other")
        return len(tracker.getJobIdsForGroup(group))

    few, many = jobs(2, 1), jobs(24, 1)
    assert many <= few + 2


def test_folds_are_problems_over_the_same_rows(spark):
    rows = _rows(spark, 2)
    folds = S.per_run(S.fold_universe(rows))
    stats = P.stats_outside(P.class_stats(rows, ["subject", "run"]), folds)
    chosen = P.select_by(stats, ["subject", "fold"], n_voxels=3).cache()
    got = {(r.subject, r.fold, r.label): r for r in models.fit_folds(rows, folds, chosen, NAMES).collect()}
    train, _ = S.split_runs(rows, folds)
    alone = P.select_features(train, ["subject", "fold"], n_voxels=3)
    assert sorted(map(str, alone.collect())) == sorted(map(str, chosen.collect()))
    want = {(r.subject, r.fold, r.label): r for r in models.fit_coefficients(train, alone, ["subject", "fold"], NAMES).collect()}
    assert set(got) == set(want) and len(got) == 2 * 4 * 3
    for k, r in got.items():
        assert np.allclose(r.weights, want[k].weights, atol=1e-5) and r.intercept == pytest.approx(want[k].intercept, abs=1e-5)


def test_statistics_outside_folds(spark):
    rows = _rows(spark, 2)
    # a class that only run 4 has, and one fold that holds two runs out
    rows = rows.withColumn("regressor_label", F.when((F.col("run") == 4) & (F.col("regressor_label") == "c"), "only").otherwise(F.col("regressor_label")))
    folds = spark.createDataFrame([(s, r, f) for s in ("s0", "s1") for r, f in ((1, 1), (2, 1), (4, 2), (1, 3))], "subject string, run int, fold int")
    got = {(r.subject, r.fold, r.regressor_label): r for r in P.stats_outside(P.class_stats(rows, ["subject", "run"]), folds).collect()}
    train, _ = S.split_runs(rows, folds)
    want = {(r.subject, r.fold, r.regressor_label): r for r in P.class_stats(train, ["subject", "fold"]).collect()}
    assert set(got) == set(want) and ("s0", 2, "only") not in got
    for k, r in want.items():
        assert got[k].n == r.n and np.allclose(got[k]["sum"], r["sum"]) and np.allclose(got[k].sumsq, r.sumsq)


def test_rows_read_do_not_grow_with_folds(spark):
    """The number of rows that leave the table of patterns, counted while the query runs."""
    from pyspark.sql import Observation

    def read(n_folds):
        seen = Observation()
        rows = _rows(spark, 2).observe(seen, F.count("*").alias("n"))
        folds = S.fold_universe(_rows(spark, 2)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds)))).where("pmod(run, 4) = pmod(fold, 4)")
        by_run = P.class_stats(rows, ["subject", "run"]).cache()
        assert by_run.count() and P.stats_outside(by_run, folds).count()
        return seen.get["n"]

    assert read(3) == read(12) == _rows(spark, 2).count()


def test_permutations_against_fits_of_their_own(spark, monkeypatch):
    rows = _rows(spark, 2, n=48)
    labels = {(r.subject, r.volume): r.given for r in models.permuted_labels(rows, 5).collect()}
    given = {}
    for size, n_voxels in ((64_000_000, 3), (8 * 8 * 15, 3)):  # one block of rows, and several
        monkeypatch.setattr(fits, "BLOCK_BYTES", size)
        got = models.permutation_fitted(rows, [4], 5, NAMES, n_voxels=n_voxels, params={"max_iter": 12}).collect()
        given[size] = {(r.subject, r.perm, r.metric): r.value for r in got}
        assert len(given[size]) == len(got) == 2 * 6 * 2
    a, b = given.values()
    assert a == pytest.approx(b, abs=1e-9)
    of = F.udf(lambda s, v, p: labels[s, v][p], "string")
    perm = 3
    moved = rows.withColumn("regressor_label", of("subject", "volume", F.lit(perm)))
    train, test = moved.where("run <> 4"), moved.where("run = 4")
    chosen = P.select_features(train, ["subject"], n_voxels=3)
    pred = models.predict(test, chosen, models.fit_coefficients(train, chosen, ["subject"], NAMES, params={"max_iter": 12}), ["subject"], NAMES)
    for r in models.both_metrics(pred, ["subject"]).collect():
        assert a[r.subject, perm, r.metric] == pytest.approx(r.value, abs=1e-9)
    below = models.permutation_fitted(rows, [4], 3, NAMES, feat_p=0.2).collect()
    real = {r.subject: r for r in P.select_features(rows.where("run <> 4"), ["subject"], None, 0.2).collect()}
    assert {r.subject for r in below} == set(real) and len(below) == 2 * 4 * 2


def test_chunks_get_their_own_codes(spark, monkeypatch):
    """A row goes to a chunk's task with the codes of that chunk's problems, not with all."""
    sizes, block = spark.sparkContext.accumulator(0), fits._block
    monkeypatch.setattr(fits, "_block", lambda pdf: sizes.add(sum(map(len, pdf["codes"]))) or block(pdf))
    rows = _rows(spark, 1, n=24)
    codes = F.array(*(F.array_position(F.array(*map(F.lit, NAMES)), F.col("regressor_label")).cast("int") - 1 for _ in range(7)))
    given = {}
    for per in (64, 3):
        monkeypatch.setattr(fits, "CHUNK", per)
        before = sizes.value
        got = fits.fit_many(rows.select("subject", "features", codes.alias("codes")), ["subject"], NAMES, params={"max_iter": 5}).collect()
        assert sizes.value - before == 7 * rows.count()
        given[per] = {(r.problem, r.label): [*r.weights, r.intercept] for r in got}
    assert set(given[64]) == set(given[3]) and len(given[3]) == 21
    assert all(given[3][k] == pytest.approx(v, abs=1e-9) for k, v in given[64].items())


@pytest.mark.parametrize("block_bytes", [64_000_000, 8 * 8 * 6])
def test_test_rows_get_their_own_codes(spark, monkeypatch, block_bytes):
    """A test row goes to where some permutations are scored with their codes, not with all; in one block of rows and in several."""
    rows = _rows(spark, 1, n=48)
    given, tests = {}, rows.where("run = 4").count()
    for per in (64, 3):
        monkeypatch.setattr(models, "SCORED", per)
        monkeypatch.setattr(fits, "BLOCK_BYTES", block_bytes)
        sizes, array = spark.sparkContext.accumulator(0), np.array

        class Counting:
            def __getattr__(self, name):
                return getattr(np, name)

            def array(self, x, *a):
                out = array(x, *a)
                if a == (int,):  # codes
                    sizes.add(out.size)
                return out

        monkeypatch.setattr(models, "np", Counting())
        got = models.permutation_fitted(rows, [4], 6, NAMES, params={"max_iter": 5}).collect()
        monkeypatch.setattr(models, "np", np)
        given[per] = {(r.perm, r.metric): r.value for r in got}
        assert sizes.value == 7 * tests and len(got) == 14
    assert given[64] == pytest.approx(given[3])


def test_ranks_with_ties():
    x = np.array([[1.0, 5.0], [1.0, 4.0], [0.0, 5.0], [2.0, 5.0]])
    assert models.ranks(x).tolist() == [[2.5, 3.0], [2.5, 1.0], [1.0, 3.0], [4.0, 3.0]]


def test_nothing_to_fit(spark):
    rows = _rows(spark, 1)
    chosen = P.select_features(rows, ["subject"], n_voxels=3)
    assert models.fit_coefficients(rows.limit(0), chosen, ["subject"], NAMES).count() == 0
    assert models.fit_coefficients(rows.where("regressor_label = 'a'"), chosen, ["subject"], NAMES).count() == 0
    none = chosen.withColumn("voxel_idx", F.array().cast("array<int>"))
    got = models.fit_coefficients(rows, none, ["subject"], NAMES).collect()
    assert [(r.label, r.weights, r.intercept) for r in sorted(got, key=lambda r: r.label)] == [(c, [], 0.0) for c in NAMES]
