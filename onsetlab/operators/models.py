"""Classifiers: nearest centroid by correlation, logistic regression, linear SVM,
cross-validation and permutation tests."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.functions import let, pearson, total
from onsetlab.operators import fits, metrics, patterns, sampling
from onsetlab.operators.sampling import shuffled
from onsetlab.sources.store import settled

ESTIMATORS = (*fits.FITTED, "nearest_centroid")


def centroids(stats: DataFrame, keys: list[str], label: str = "regressor_label") -> DataFrame:
    """(keys, classes): for each key its classes with their mean patterns, in one array, from statistics by class."""
    means = patterns.class_means(stats, keys, label)
    return means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col("mean").alias("centre")))).alias("classes"))


def centroid_predict(train: DataFrame, test: DataFrame, keys: list[str] = ("subject",), label: str = "regressor_label") -> DataFrame:
    """Test rows with scores (array of label and correlation) and predicted_label; of equal
    scores the first label counts. Classes are few and join by key, not by pair."""
    return centroid_scores(patterns.class_stats(train, list(keys), label), test, keys, label)


def centroid_scores(stats: DataFrame, test: DataFrame, keys: list[str] = ("subject",), label: str = "regressor_label") -> DataFrame:
    """The same from statistics by class."""
    keys = list(keys)
    given = test.join(centroids(stats, keys, label), keys)
    scores = F.transform("classes", lambda c: F.struct(c["label"].alias("label"), pearson(F.col("features"), c["centre"]).alias("score")))
    given = given.withColumn("scores", scores).drop("classes", "features")
    best = F.array_min(F.transform("scores", lambda s: F.struct((-s["score"]).alias("s"), s["label"].alias("label"))))
    return given.withColumn("predicted_label", best["label"])


def class_code(categories: list[str], label: str = "regressor_label") -> Column:
    """The label's place among the categories, -1 for none."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, categories)).cast("array<string>"), F.col(label)), F.lit(0)) - 1).cast("int")


def with_chosen(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a vector of their key's chosen features."""
    given = rows.join(chosen.select(*keys, "voxel_idx"), keys)
    return given.withColumn("vector", F.transform("voxel_idx", lambda i: F.get("features", i).cast("double"))).drop("voxel_idx")


def fit_coefficients(train: DataFrame, chosen: DataFrame, keys: list[str], categories: list[str], name: str = "logistic_regression", params: dict | None = None) -> DataFrame:
    """(keys, label, weights, intercept) of each key's fit on its chosen features, in the order
    of categories; a category that the key's rows lack is not trained. Without a chosen feature
    all classes score 0. All keys are fitted by the same jobs (see fits)."""
    rows = with_chosen(train, chosen, keys).select(*keys, F.col("vector").alias("features"), F.array(class_code(categories)).alias("codes")).where("codes[0] >= 0")
    return fits.fit_many(rows, keys, categories, name, params).select(*keys, "label", "weights", "intercept")


def fit_folds(rows: DataFrame, folds: DataFrame, chosen: DataFrame, categories: list[str], name: str = "logistic_regression", params: dict | None = None, unit: list[str] = ("run",)) -> DataFrame:
    """(subject, fold, label, weights, intercept): for each fold the fit on the rows outside it.
    A subject's folds are problems over the same rows, which keep the features that any of its folds chose."""
    folds, unit = folds.select("subject", "fold", *unit).distinct(), list(unit)
    union = chosen.groupBy("subject").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("voxel_idx")))).alias("kept"))
    coded = sampling.outside_codes(rows.select("subject", *unit, "features", "regressor_label"), folds, class_code(categories), unit)
    slim = coded.join(union, "subject").select("subject", "codes", F.transform("kept", lambda i: F.get("features", i)).alias("features")).where(F.exists("codes", lambda c: c >= 0))
    numbers = folds.select("subject", "fold").distinct().withColumn("problem", F.row_number().over(Window.partitionBy("subject").orderBy("fold")) - 1)
    places = chosen.join(numbers, ["subject", "fold"]).join(union, "subject")
    places = places.select("subject", "problem", F.transform("voxel_idx", lambda i: (F.array_position("kept", i) - 1).cast("int")).alias("voxel_idx"))
    fitted = fits.fit_many(slim, ["subject"], categories, name, params, places)
    return fitted.join(numbers, ["subject", "problem"]).select("subject", "fold", "label", "weights", "intercept")


def predict(test: DataFrame, chosen: DataFrame, coefficients: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Test rows of all keys with scores (decision values by trained label, in the order of
    categories) and predicted_label, by one join; rows of a key without a fit are left out."""
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("label"))
    classes = coefficients.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "label", "weights", "intercept"))).alias("classes"))
    given = with_chosen(test, chosen, keys).join(classes, keys)
    dot = lambda c: F.aggregate(F.zip_with("vector", c["weights"], lambda x, w: x * w), c["intercept"], lambda s, y: s + y)
    scores = F.transform("classes", lambda c: F.struct(c["label"].alias("label"), dot(c).alias("score")))
    best = F.array_min(F.transform("scores", lambda s, i: F.struct((-s["score"]).alias("s"), i.alias("i"), s["label"].alias("label"))))
    return given.withColumn("scores", scores).drop("classes", "vector", "features").withColumn("predicted_label", best["label"])


def importance(coefficients: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, weights): class weights in the full feature space, 0 where not chosen. Two
    classes give the first class the weights that point to the second, and the second their negative."""

    @F.pandas_udf("array<double>")
    def spread(weights: pd.Series, at: pd.Series, whole: pd.Series, sign: pd.Series) -> pd.Series:
        out = []
        for w, k, n, s in zip(weights, at, whole, sign):
            x = np.zeros(int(n))
            x[np.asarray(k, int)] = s * np.asarray(w, float)
            out.append(x)
        return pd.Series(out)

    two = F.count("*").over(Window.partitionBy(*keys)) == 2
    given = coefficients.join(chosen.select(*keys, "voxel_idx", "whole_voxels"), keys).withColumn("sign", F.when(two, -1.0).otherwise(1.0))
    return given.select(*keys, "label", spread("weights", "voxel_idx", "whole_voxels", "sign").alias("weights"))


#: Rows of a key whose labels are shuffled in one task for PERMS permutations at a time; labels of larger keys are shuffled by windows.
SHUFFLED_ROWS, PERMS = 131_072, 32


def permuted_codes(rows: DataFrame, n: int, names: list[str], seed: int = 0, keys: tuple[str, ...] = ("subject",), row: str = "volume", label: str = "regressor_label") -> DataFrame:
    """(keys, row, codes): by permutation the place among ``names`` of the row's label, -1 for none. Number 0 are
    the real labels, and 1 .. n are shuffled within the key. No patterns are moved, and a row's id and label
    once for PERMS permutations. Estimates of size know nothing of the permutations, so joins
    with the result should be told to merge, or it may be broadcast."""
    keys = list(keys)
    kinds = dict(rows.dtypes)
    ids = rows.select(*keys, row, class_code(names, label).cast("smallint").alias("code"), F.coalesce(F.concat(F.lit("|"), F.col(row).cast("string")), F.lit("")).alias("tail"))
    ids = ids.join(F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("rows"))), keys)
    few = F.col("rows") <= SHUFFLED_ROWS

    def moved(key, pdf):
        first, pdf = int(key[-1]), pdf.sort_values(row, na_position="first", kind="stable")
        real, tails = pdf["code"].to_numpy(np.int16), [t.encode() for t in pdf["tail"]]
        out = np.empty((len(pdf), min(PERMS, n + 1 - first)), np.int16)
        for k in range(out.shape[1]):
            start = f"{seed}|{first + k}".encode()
            # as the order of shuffled(): the digest's two halves, then the row's place
            digests = np.frombuffer(b"".join([hashlib.md5(start + t).digest() for t in tails]), ">u8").reshape(-1, 2)
            out[:, k] = real[np.lexsort((digests[:, 1], digests[:, 0]))] if first + k else real
        return pdf[[*keys, row]].assign(first=first, part=list(out))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, row)) + ", first int, part array<smallint>"
    dealt = ids.where(few).select(*keys, row, "code", "tail", F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(PERMS))).alias("first"))
    parts = dealt.groupBy(*keys, "first").applyInPandas(moved, schema)
    place = Window.partitionBy(*keys, "perm").orderBy(row)
    shuffle = Window.partitionBy(*keys, "perm").orderBy(F.when(F.col("perm") == 0, F.lit("")).otherwise(shuffled(seed, "perm", row)), row)
    every = ids.where(~few).select(*keys, row, "code").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a = every.select(*keys, "perm", row, F.row_number().over(place).alias("nth"))
    b = every.select(*keys, "perm", "code", F.row_number().over(shuffle).alias("nth"))
    single = a.join(b.hint("merge"), [*keys, "perm", "nth"]).select(*keys, row, F.col("perm").alias("first"), F.array("code").alias("part"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first", "part"))), lambda x: x["part"]))
    return parts.unionByName(single).groupBy(*keys, row).agg(joined.alias("codes"))


def permuted_labels(rows: DataFrame, n: int, seed: int = 0, keys: tuple[str, ...] = ("subject",), row: str = "volume", label: str = "regressor_label") -> DataFrame:
    """(keys, row, given): the labels themselves (see permuted_codes)."""
    names = rows.agg(F.sort_array(F.collect_set(label)).alias("names")).first()["names"]
    place = F.array(*map(F.lit, names)).cast("array<string>")
    return permuted_codes(rows, n, names, seed, keys, row, label).select(*keys, row, F.transform("codes", lambda c: F.get(place, c)).alias("given"))


def permutation_p(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, real, p, n) from scores by permutation, number 0 being the real one."""
    real = scores.where("perm = 0").select(*keys, F.col(value).alias("real"))
    joined = scores.where("perm > 0").join(real, keys)
    hits = F.sum((F.col(value) >= F.col("real")).cast("long"))
    return joined.groupBy(*keys, "real").agg(((1 + hits) / (1 + F.count("*"))).alias("p"), F.count("*").alias("n"))


def held_out(test: list[int] | Column) -> Column:
    """Test rows, by a list of runs or by a condition."""
    return test if isinstance(test, Column) else F.col("run").isin(test)


#: Bytes of class means that a task holds, classes of permutations worked on together, rows of a block
#: that are multiplied, test rows that are listed by permutation in one task, and rows of a subject whose slices are worked on in one task each.
CHUNK_BYTES, COLUMNS, TEST_ROWS, TRAIN_ROWS, LISTED, ALONE = 64_000_000, 8192, 1024, 4096, 64, 2048
#: Bytes of a larger subject's test scores that a task holds: of as many permutations as fit; and of its test patterns, where these go to the permutations.
SCORE_BYTES, PATTERN_BYTES = 16_000_000, 64_000_000


def centred(x: Column) -> Column:
    """An array less its mean."""
    return let(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))


def feature_slices(x: Column, wide: int) -> Column:
    """An array as the array of its stretches of ``wide`` values, one at least."""
    last = F.greatest(F.lit(0), F.ceil(F.size(x) / wide).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(x, k * wide + 1, wide))


def permuted_centroids(rows: DataFrame, test: list[int] | Column, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The centroid classifier under each permutation: (subject, perm, metric, value) of subjects whose
    test scores of one permutation are at most SCORE_BYTES, and of the others (subject, perm, volume, regressor_label, predicted_label, scores) of test rows.

    Where every pattern is less its own mean, so are the class means, and both the product of a
    pattern with one and the mean's norm are sums over features. So patterns are cut into slices
    of features, narrow enough for all permutations' means in a task, and each slice is moved once.
    Training rows are multiplied with indicator matrices of the labels, test rows
    with the means, and the products are added up over slices. Of a subject of at most ALONE rows the means
    stay in the task that makes them; larger ones are worked on in blocks of rows, whose sums and means
    are shuffled, and scored some permutations at a time. Where a subject's test patterns are one slice, of PATTERN_BYTES
    at most and with fewer features than SCORED permutations have classes, they are moved to each SCORED permutations and multiplied where they are scored; else
    their products with the means are moved. Only more than COLUMNS classes of permutations are worked on in chunks, with a copy of
    the patterns for each."""
    names, features = rows.agg(F.sort_array(F.collect_set("regressor_label")), F.max(F.size("features"))).first()
    per = max(1, COLUMNS // max(1, len(names)))
    wide = max(1, CHUNK_BYTES // (8 * max(1, len(names)) * min(per, n + 1)))
    given = rows.select("subject", "volume", held_out(test).alias("held"), centred(F.col("features")).alias("x")).join(permuted_codes(rows, n, names, seed).hint("merge"), ["subject", "volume"])
    norm = F.sqrt(total(F.transform("x", lambda v: v * v)))
    each = 8 * max(1, len(names))
    counts = rows.groupBy("subject").agg(F.count("*").alias("rows"), F.count_if(held_out(test)).alias("tests"))
    counts = counts.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(SCORED), F.floor(F.lit(SCORE_BYTES) / (each * F.greatest("tests", F.lit(1)))))).cast("int"))
    few, one_slice = F.col("tests") * each <= SCORE_BYTES, (features or 0) <= wide
    near = few & F.lit(one_slice and features is not None and features <= SCORED * len(names)) & (F.col("tests") * (8 * (features or 0)) <= PATTERN_BYTES)
    counts = counts.withColumn("near", near)
    coded = given.select("subject", "volume", "held", "x", "codes", norm.alias("norm")).join(F.broadcast(counts), "subject")
    # written once: labels are shuffled by permutation once, and training and test rows are read from there
    whole_rows = settled(coded.select("subject", "volume", "held", "rows", "width", "near", "codes", "norm", F.posexplode(feature_slices(F.col("x"), wide)).alias("slice", "x")))
    dealt = whole_rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n // per))))
    block = lambda size: F.pmod(F.xxhash64("volume"), F.ceil(F.col("rows") / size)).cast("int")

    def matrix(pdf, chunk):
        labels = np.array(pdf["codes"].tolist(), np.int16)[:, chunk * per : (chunk + 1) * per]
        return np.array(pdf["x"].tolist(), float), labels

    def alone(key, pdf):
        """Products of a subject's test rows with all means, and as the row without a volume the means' squares (NaN: not trained)."""
        chunk, held = int(key[1]), pdf["held"].to_numpy(bool)
        x, labels = matrix(pdf, chunk)
        n_perms = labels.shape[1]
        dots, squares = np.zeros((held.sum(), n_perms, len(names))), np.full((n_perms, len(names)), np.nan)
        for c in range(len(names)):
            own = labels[~held] == c
            size = own.sum(axis=0)
            k = np.flatnonzero(size)
            mean = own[:, k].T.astype(float) @ x[~held] / size[k, None]
            dots[:, k, c], squares[k, c] = x[held] @ mean.T, np.square(mean).sum(axis=1)
        tests = pdf[held]
        out = pd.DataFrame({"volume": tests["volume"].astype("Int64"), "norm": tests["norm"], "codes": list(labels[held]), "dots": list(dots.reshape(len(dots), -1))})
        out.loc[len(pdf)] = [pd.NA, 0.0, [], squares.ravel()]
        return out.assign(subject=key[0], chunk=chunk)[["subject", "chunk", "volume", "norm", "codes", "dots"]]

    def sums(key, pdf):
        subject, chunk, at = key[0], int(key[1]), int(key[2])
        x, labels = matrix(pdf, chunk)
        out = []
        for c in range(len(names)):
            own = labels == c
            size, whole = own.sum(axis=0), own.T.astype(float) @ x
            out += [(subject, chunk, at, chunk * per + k, c, int(size[k]), whole[k]) for k in np.flatnonzero(size)]
        return pd.DataFrame(out, columns=["subject", "chunk", "slice", "perm", "code", "n", "total"])

    key = ["subject", "chunk", "slice"]
    added = Summarizer.metrics("sum").summary(array_to_vector("dots"))
    over_slices = lambda d, at: d.groupBy("subject", at, "volume").agg(F.first("norm").alias("norm"), F.first("codes").alias("codes"), added.alias("s")).withColumn("dots", vector_to_array("s.sum")).drop("s")
    schema = "subject string, chunk int, volume long, norm double, codes array<smallint>, dots array<double>"
    small = settled(over_slices(dealt.where(F.col("rows") <= ALONE).groupBy(*key).applyInPandas(alone, schema), "chunk"))
    squares = small.where("volume is null").select("subject", "chunk", F.posexplode("dots").alias("at", "square")).where(~F.isnan("square"))
    perm, code = F.col("chunk") * per + F.floor(F.col("at") / len(names)), F.col("at") % len(names)
    small_norms = squares.select("subject", "chunk", perm.cast("int").alias("perm"), code.cast("int").alias("code"), F.sqrt("square").alias("norm"))

    dealt = dealt.where(F.col("rows") > ALONE)
    total_of = Summarizer.metrics("sum").summary(array_to_vector("total"))
    parts = dealt.where(~F.col("held")).groupBy(*key, block(TRAIN_ROWS).alias("block")).applyInPandas(sums, "subject string, chunk int, slice int, perm int, code int, n long, total array<double>")
    means = parts.groupBy(*key, "perm", "code").agg(F.sum("n").alias("n"), total_of.alias("s"))
    means = settled(means.select(*key, "perm", "code", F.transform(vector_to_array("s.sum"), lambda v: v / F.col("n")).alias("mean")))
    tests = dealt.where("held and not near").withColumn("block", block(TEST_ROWS))

    def products(key, centres, pdf):
        columns = ["subject", "first", "volume", "norm", "codes", "dots"]
        if not len(pdf) or not len(centres):
            return pd.DataFrame(columns=columns)
        x, labels = matrix(pdf, int(key[1]))
        width = int(pdf["width"].iloc[0])
        dots = np.zeros((len(x), labels.shape[1] * len(names)))
        at = (centres["perm"].to_numpy() - int(key[1]) * per) * len(names) + centres["code"].to_numpy()
        dots[:, at] = x @ np.array(centres["mean"].tolist(), float).T
        cut = lambda k: {"codes": list(labels[:, k : k + width]), "dots": list(dots[:, k * len(names) : (k + width) * len(names)])}
        parts = [pd.DataFrame({"subject": key[0], "first": int(key[1]) * per + k, "volume": pdf["volume"], "norm": pdf["norm"]} | cut(k)) for k in range(0, labels.shape[1], width)]
        return pd.concat(parts)[columns]

    by = [*key, "block"]
    spread = means.join(tests.select(*by).distinct(), key)
    pieces = spread.toDF(*spread.columns).groupBy(*by).cogroup(tests.groupBy(*by)).applyInPandas(products, schema.replace("chunk", "first"))
    norms = means.groupBy("subject", "chunk", "perm", "code").agg(F.sqrt(F.sum(total(F.transform("mean", lambda v: v * v)))).alias("norm"))
    start = F.col("chunk") * per
    norms = norms.join(counts.where("not near"), "subject").withColumn("first", (start + F.floor((F.col("perm") - start) / F.col("width")) * F.col("width")).cast("int"))
    norms = settled(norms.select("subject", "first", "perm", "code", "norm", "rows", "tests"))
    whole = (pieces if one_slice else over_slices(pieces, "first")).join(F.broadcast(counts), "subject")
    # every block that the subject's rows may be in
    many_norms = norms.where(~few).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / LISTED).cast("int") - 1)))

    def correlations(first, own, pdf):
        """By permutation: its number, codes of trained classes, test rows' correlations with them, and their labels' codes."""
        dots, labels = np.array(pdf["dots"].tolist(), float), np.array(pdf["codes"].tolist(), int)
        x_norm = pdf["norm"].to_numpy()
        for perm, found in own.sort_values(["perm", "code"]).groupby("perm"):
            code, both = found["code"].to_numpy(), x_norm[:, None] * found["norm"].to_numpy()[None, :]
            yield int(perm), code, dots[:, (perm - first) * len(names) + code] / np.where(both == 0, 1.0, both), labels[:, perm - first]

    def measured(key, own, pdf, size=1):
        out = []
        if len(pdf) and len(own):
            for perm, code, r, truth in correlations(int(key[1]) * size, own, pdf):
                out += [(key[0], perm, m, v) for m, v in zip(("accuracy", "roc_auc_ovr"), scored(r, truth, code))]
        return pd.DataFrame(out, columns=["subject", "perm", "metric", "value"])

    def compared(key, centres, pdf):
        """The same of test rows that lie beside the means."""
        out = []
        if len(pdf) and len(centres):
            x, labels, x_norm = np.array(pdf["x"].tolist(), float), np.array(pdf["codes"].tolist(), int), pdf["norm"].to_numpy()
            for perm, found in centres.sort_values(["perm", "code"]).groupby("perm"):
                mean = np.array(found["mean"].tolist(), float)
                both = x_norm[:, None] * np.sqrt(np.square(mean).sum(axis=1))[None, :]
                r = x @ mean.T / np.where(both == 0, 1.0, both)
                out += [(key[0], int(perm), m, v) for m, v in zip(("accuracy", "roc_auc_ovr"), scored(r, labels[:, perm - int(key[1])], found["code"].to_numpy()))]
        return pd.DataFrame(out, columns=["subject", "perm", "metric", "value"])

    def score(key, own, pdf):
        columns = ["subject", "perm", "volume", "regressor_label", "predicted_label", "scores"]
        if not len(pdf) or not len(own):
            return pd.DataFrame(columns=columns)
        out = []
        for perm, code, r, truth in correlations(int(key[1]), own, pdf):
            trained, best = [names[c] for c in code], r.argmax(axis=1)
            for k, volume in enumerate(pdf["volume"]):
                out.append((key[0], perm, int(volume), names[truth[k]] if truth[k] >= 0 else None, trained[best[k]], [{"label": a, "score": float(b)} for a, b in zip(trained, r[k])]))
        return pd.DataFrame(out, columns=columns)

    by = ["subject", "first", "block"]
    schema = "subject string, perm int, volume long, regressor_label string, predicted_label string, scores array<struct<label:string,score:double>>"
    listed = whole.where(~few).withColumn("block", block(LISTED))
    many = many_norms.select(*by, "perm", "code", "norm").toDF(*by, "perm", "code", "norm").groupBy(*by).cogroup(listed.groupBy(*by)).applyInPandas(score, schema)
    schema = "subject string, perm int, metric string, value double"
    by = by[:2]
    some = norms.where(few).select(*by, "perm", "code", "norm").toDF(*by, "perm", "code", "norm").groupBy(*by).cogroup(whole.where(few).groupBy(*by)).applyInPandas(lambda key, own, pdf: measured(key, own, pdf), schema)
    first = F.floor(F.col("perm") / SCORED).cast("int") * SCORED
    beside = whole_rows.where((F.col("rows") > ALONE) & F.col("held") & F.col("near")).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(SCORED))))
    beside = beside.select(*by, "x", "norm", F.slice("codes", F.col("first") + 1, F.lit(SCORED)).alias("codes"))
    centres = means.join(F.broadcast(counts.where("near")), "subject").select("subject", first.alias("first"), "perm", "code", "mean")
    some = some.unionByName(centres.toDF(*centres.columns).groupBy(*by).cogroup(beside.groupBy(*by)).applyInPandas(compared, schema))
    tests = small.where("volume is not null")
    one = small_norms.toDF(*small_norms.columns).groupBy("subject", "chunk").cogroup(tests.groupBy("subject", "chunk")).applyInPandas(lambda key, own, pdf: measured(key, own, pdf, per), schema)
    return one.unionByName(some), many


def both_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): accuracy and macro one-vs-rest AUC of the same predictions."""
    raw = pred.withColumn("evidence", F.transform("scores", lambda s: s["score"]))
    acc = metrics.accuracy(raw, keys).select(*keys, F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    area = metrics.macro_auc(metrics.auc(raw, keys), keys).select(*keys, F.lit("roc_auc_ovr").alias("metric"), F.col("macro_auc").alias("value"))
    return acc.unionByName(area)


def with_nan(scores: DataFrame) -> DataFrame:
    """Scores from pandas, whose NaN arrive as null; as NaN they are at least as large as any real one, as in SQL."""
    return scores.withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def permutation_centroid(rows: DataFrame, test: list[int] | Column, n: int, seed: int = 0) -> DataFrame:
    """Both metrics of the centroid classifier by permutation: (subject, perm, metric, value)."""
    one, many = permuted_centroids(rows, test, n, seed)
    return with_nan(one).unionByName(both_metrics(settled(many), ["subject", "perm"]).select("subject", "perm", "metric", "value"))


#: Permutations that a task scores at one time.
SCORED = 64


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each column, those of equal values averaged."""
    order = np.argsort(x, axis=0, kind="stable")
    y = np.take_along_axis(x, order, axis=0)
    new = np.concatenate([np.ones((1, x.shape[1]), bool), y[1:] != y[:-1]])
    place = np.arange(len(x))[:, None]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    last = np.minimum.accumulate(np.where(np.concatenate([new[1:], new[:1]]), place, len(x))[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return out


def scored(scores: np.ndarray, truth: np.ndarray, trained: np.ndarray) -> tuple[float, float]:
    """Accuracy, and mean one-vs-rest area under the curve of the trained classes (NaN if one has one side only)."""
    own = truth[:, None] == trained[None, :]
    # equal rows may differ in their last digits by where they stand in a matrix product
    a, r = own.sum(axis=0), (ranks(metrics.rounded(scores, np.rint)) * own).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        area = np.where((a == 0) | (a == len(own)), np.nan, (r - a * (a + 1) / 2) / (a * (len(own) - a)))
    return float((trained[scores.argmax(axis=1)] == truth).mean()), float(area.mean())


def permutation_fitted(rows: DataFrame, test: list[int] | Column, n: int, categories: list[str], name: str = "logistic_regression", params: dict | None = None, n_voxels: int | None = None, feat_p: float | None = None, seed: int = 0) -> DataFrame:
    """As permutation_centroid, for fitted classifiers: selection and fit are done anew for each
    (subject, permutation), a threshold being widened on the subject's real labels. Patterns have the labels
    of all permutations beside them, which are problems of one optimiser (see fits)."""
    held = held_out(test)
    coded = rows.select("subject", "volume", held.alias("held"), "features").join(permuted_codes(rows, n, categories, seed).hint("merge"), ["subject", "volume"])
    coded = settled(coded)
    if n_voxels:
        select, threshold = ("best", n_voxels), None
    elif feat_p is not None:
        real = patterns.select_features(rows.where(~held), ["subject"], None, feat_p)
        select, threshold = ("below", feat_p), real.select("subject", F.col("threshold_used").alias("threshold"))
    else:
        select = threshold = None
    fitted = fits.fit_many(coded.where("not held"), ["subject"], categories, name, params, None, select, threshold)
    one, many = _scored_permutations(coded.where("held"), fitted, categories)
    return with_nan(one).unionByName(both_metrics(settled(many), ["subject", "perm"]).select("subject", "perm", "metric", "value"))


def _scored_permutations(tests: DataFrame, fitted: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Metrics by permutation where a subject's test rows are one block, and predictions for the other subjects."""
    about = settled(tests.groupBy("subject").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.max(F.size("features")) * 8 / fits.BLOCK_BYTES)).cast("int").alias("blocks")))
    by = ["subject", "chunk", "block"]
    deal = fitted.withColumn("chunk", F.floor(F.col("problem") / SCORED).cast("int"))
    chunks = deal.select("subject", "chunk").distinct()
    # test rows go to each chunk with its codes alone
    dealt = tests.join(F.broadcast(about), "subject").withColumn("block", F.pmod(F.xxhash64("volume"), F.col("blocks")).cast("int")).join(F.broadcast(chunks), "subject")
    dealt = dealt.withColumn("codes", F.slice("codes", F.col("chunk") * SCORED + 1, F.lit(SCORED)))
    models_of = deal.join(about.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "subject")
    models_of = models_of.toDF(*models_of.columns)

    def each(fit: pd.DataFrame, pdf: pd.DataFrame):
        x, codes = np.array(pdf["features"].tolist(), float), np.array(pdf["codes"].tolist(), int)
        for problem, own in fit.groupby("problem"):
            trained = np.array([categories.index(c) for c in own["label"]])
            order = np.argsort(trained)
            idx = np.asarray(own["voxel_idx"].iloc[0], int)
            w = np.array(own["weights"].tolist(), float).reshape(len(own), -1)[order]
            yield int(problem), trained[order], x[:, idx] @ w.T + own["intercept"].to_numpy()[order], codes[:, int(problem) % SCORED]

    def measured(key, fit, pdf):
        out = []
        if len(fit) and len(pdf):
            for problem, trained, scores, truth in each(fit, pdf):
                out += [(key[0], problem, m, v) for m, v in zip(("accuracy", "roc_auc_ovr"), scored(scores, truth, trained))]
        return pd.DataFrame(out, columns=["subject", "perm", "metric", "value"])

    def predicted(key, fit, pdf):
        out = []
        if len(fit) and len(pdf):
            for problem, trained, scores, truth in each(fit, pdf):
                names = [categories[c] for c in trained]
                for volume, row, t in zip(pdf["volume"], scores, truth):
                    out.append((key[0], problem, int(volume), categories[t] if t >= 0 else None, names[int(row.argmax())], [{"label": a, "score": float(b)} for a, b in zip(names, row)]))
        return pd.DataFrame(out, columns=["subject", "perm", "volume", "regressor_label", "predicted_label", "scores"])

    side = lambda d, which: d.where(which).groupBy(*by)
    one = side(models_of, "blocks = 1").cogroup(side(dealt, "blocks = 1")).applyInPandas(measured, "subject string, perm int, metric string, value double")
    schema = "subject string, perm int, volume long, regressor_label string, predicted_label string, scores array<struct<label:string,score:double>>"
    return one, side(models_of, "blocks > 1").cogroup(side(dealt, "blocks > 1")).applyInPandas(predicted, schema)


def compare_baselines(rows: DataFrame, test_runs: list[int], categories: list[str], methods: tuple[str, ...] = ("nearest_centroid", "linear_svc"), params: dict | None = None) -> DataFrame:
    """(subject, method, protocol, metric, value): each method on the split by test_runs and, as
    a mean over folds, with each run left out once. No features are selected."""
    matched = sampling.fold_universe(rows).where(F.col("run").isin(test_runs)).withColumn("fold", F.lit(0))
    by_run, out = settled(patterns.class_stats(rows, ["subject", "run"])), []
    for protocol, folds in (("matched_split", matched), ("leave_one_run_out", sampling.per_run(sampling.fold_universe(rows)))):
        stats, test = patterns.stats_outside(by_run, folds), sampling.held_rows(rows, folds)
        for method in methods:
            if method == "nearest_centroid":
                pred = centroid_scores(stats, test, ["subject", "fold"])
            else:
                chosen = patterns.select_by(stats, ["subject", "fold"])
                pred = predict(test, chosen, fit_folds(rows, folds, chosen, categories, method, params), ["subject", "fold"], categories)
            each = both_metrics(settled(pred), ["subject", "fold"]).groupBy("subject", "metric").agg(F.avg("value").alias("value"))
            out.append(each.select("subject", F.lit(method).alias("method"), F.lit(protocol).alias("protocol"), "metric", "value"))
    return reduce(DataFrame.unionByName, out)
