"""Operator 2: quality classifier by co-training.

Two views of a document that share nothing: its text (shares of characters by kind, lengths
and repeats of words and lines) and its page's metadata (source and language). Each view has a logistic
regression. In each round, each one's confident predictions for unlabelled documents are
added, at a lower weight, to what the other is fitted to. Then both views are calibrated
on labelled documents set aside (a logistic curve over the view's log odds), and the
calibrated log odds, less the base rate counted twice, score every document.

All labelled documents, and in each round all unlabelled ones, take part, as Spark jobs
over a table of features and labels that is joined and written once to the shared folder.
Features are worked out once: the filter writes them beside its rows.

Defined cases: null text is empty; null metadata is a value of its own; several labels of
an id count as their mean, rounded half up; an id without a label, or with a null one, is
unlabelled; sources fall into ``SOURCE_BUCKETS`` features and languages into
``LANG_BUCKETS`` by hash, so that some of different names share one (the text view tells such
pages apart, the metadata view can't); with labels of one kind only (or none), every document's score is 1 and it is
kept, as nothing can be learned; where the labelled documents that fit, or those that
calibrate, are of one kind only, all labelled documents do both; a very long text is
measured whole, one text at a time; repeated rows give a row each; an empty table gives no
rows; further columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.llm.common import cut, text_udf, worker_tables

ROUNDS = 2
#: Predictions at least this sure are exchanged, at this weight.
CONFIDENT, EXCHANGED_WEIGHT = 0.98, 0.2
#: One in so many labelled documents calibrates.
CALIBRATION = 5
LEAST_SCORE = 0.5
#: Of a view's fit.
MOST_STEPS, PENALTY, TOLERANCE = 20, 1e-3, 1e-5
SOURCE_BUCKETS, LANG_BUCKETS = 64, 8
SIGNS = "!*#$%&|@<>{}[]()=+_/\\~^\"'.,;:?-"
N_TEXT = 22 + len(SIGNS)


def text_features(text: str) -> list[float]:
    """Numbers about the text alone, each within a bounded range."""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    chars = Counter(text)
    at_least = max(1, n)
    letters = sum(v for c, v in chars.items() if c.isalpha())
    upper = sum(v for c, v in chars.items() if c.isupper())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    blanks = sum(v for c, v in chars.items() if c.isspace())
    wide = sum(v for c, v in chars.items() if ord(c) > 0x2FF)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    plain = sum(v for w, v in counts.items() if w.isalpha())
    shouted = sum(v for w, v in counts.items() if w.isupper() and len(w) > 1)
    ended = sum(v for w, v in counts.items() if w[-1] in "!*#$%&")
    top = counts.most_common(3)
    by_line = Counter(lines)
    m = max(1, len(lines))
    out = [
        np.log1p(n) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, min(lengths.mean(), 50) / 10, min(lengths.std(), 50) / 10,
        letters / at_least, upper / at_least, digits / at_least, blanks / at_least, wide / at_least,
        (n - letters - digits - blanks) / at_least, repeats / k, plain / k, shouted / k, ended / k,
        len(counts) / k, (top[0][1] if top else 0) / k, sum(v for _, v in top) / k,
        1 - len(by_line) / m if lines else 0.0, (by_line.most_common(1)[0][1] if lines else 0) / m,
        min(len(words) / m, 200) / 100, float(n == 0),
    ]
    return [float(x) for x in out] + [chars[c] / at_least for c in SIGNS]


def _metadata_view() -> Column:
    """One-hot hashes of source and language as an array."""
    source = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(SOURCE_BUCKETS))
    lang = F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\0"))), F.lit(LANG_BUCKETS))
    one_hot = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (at == i).cast("double"))
    return F.concat(one_hot(source, SOURCE_BUCKETS), one_hot(lang, LANG_BUCKETS))


def _text_view():
    def make():
        worker_tables("quality classifier")
        return lambda texts: [text_features(t or "") for t in texts]

    return text_udf(make, "array<double>")(F.col("text"))


def with_metadata(docs: DataFrame) -> DataFrame:
    """docs with the columns of the metadata view, null where the table has none of that name."""
    for name in ("source", "lang"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    return docs


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_view and page_view (arrays)."""
    return with_metadata(docs).select("doc_id", _text_view().alias("text_view"), _metadata_view().alias("page_view"))


def labelled_features(given: DataFrame, labels: DataFrame) -> DataFrame:
    """A table of features() with the label y (null where a row has none), written once. Every
    fit reads this table, so labels and features meet in one join however many fits follow."""
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    return cut(given.join(y, "doc_id", "left"))


def _fit(rows: DataFrame, view: str):
    lr = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", maxIter=MOST_STEPS, regParam=PENALTY, tol=TOLERANCE)
    return lr.fit(rows.select(array_to_vector(F.col(view)).alias("v"), "y", "w"))


def _probability(model, view: str) -> Column:
    """The model's probability of quality as a plain expression over the view's array."""
    weights = F.array(*(F.lit(float(x)) for x in model.coefficients))
    z = F.aggregate(F.zip_with(F.col(view), weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, x: s + x)
    return 1.0 / (1.0 + F.exp(-z))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


class CoTrained:
    """Fitted views: columns of probability and score over text_view and page_view."""

    def __init__(self, text, page, text_curve, page_curve, base: float):
        self.text, self.page, self.text_curve, self.page_curve, self.base = text, page, text_curve, page_curve, base

    def views(self) -> tuple[Column, Column]:
        """Calibrated probabilities of the text and of the page view."""
        out = []
        for model, curve, view in ((self.text, self.text_curve, "text_view"), (self.page, self.page_curve, "page_view")):
            z = _log_odds(_probability(model, view)) * float(curve.coefficients[0]) + float(curve.intercept)
            out.append(1.0 / (1.0 + F.exp(-z)))
        return out[0], out[1]

    def score(self) -> Column:
        text, page = self.views()
        prior = float(np.log(self.base / (1 - self.base)))
        return 1.0 / (1.0 + F.exp(-(_log_odds(text) + _log_odds(page) - prior)))


def co_train(table: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit on a table of labelled_features(); None where labels have one kind only."""
    aside = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(CALIBRATION)) == 0
    known = table.where("y is not null").withColumn("aside", aside)
    kinds = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(kinds) < 2:
        return None
    fitted_to = known.where(~F.col("aside"))
    if fitted_to.select("y").distinct().count() < 2:
        fitted_to = known
    n = kinds[0.0] + kinds[1.0]
    # both kinds weigh the same in fitting; calibration restores the base rate
    balance = F.when(F.col("y") == 1.0, n / (2.0 * kinds[1.0])).otherwise(n / (2.0 * kinds[0.0]))
    labelled = fitted_to.withColumn("w", balance).select("text_view", "page_view", "y", "w")
    unknown = table.where("y is null").select("text_view", "page_view")
    text, page = _fit(labelled, "text_view"), _fit(labelled, "page_view")
    for _ in range(rounds):
        taught = {}
        for model, view in ((text, "text_view"), (page, "page_view")):
            p = _probability(model, view)
            sure = unknown.withColumn("p", p).where((F.col("p") >= CONFIDENT) | (F.col("p") <= 1 - CONFIDENT))
            taught[view] = sure.withColumn("y", (F.col("p") >= 0.5).cast("double")).withColumn("w", F.lit(EXCHANGED_WEIGHT)).select("text_view", "page_view", "y", "w")
        text, page = _fit(labelled.unionByName(taught["page_view"]), "text_view"), _fit(labelled.unionByName(taught["text_view"]), "page_view")
    held = known.where("aside")
    if held.select("y").distinct().count() < 2:
        held = known
    curves = []
    for model, view in ((text, "text_view"), (page, "page_view")):
        one = held.select(F.array(_log_odds(_probability(model, view))).alias("z"), "y", F.lit(1.0).alias("w"))
        curves.append(_fit(one, "z"))
    return CoTrained(text, page, *curves, base=kinds[1.0] / n)


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, least: float = LEAST_SCORE) -> DataFrame:
    """Per row: doc_id, both views' calibrated probabilities, the score, and whether it is kept."""
    table = labelled_features(features(docs), labels)
    model = co_train(table, rounds)
    if model is None:
        one = F.lit(1.0)
        return table.select("doc_id", one.alias("p_text"), one.alias("p_page"), one.alias("score"), F.lit(True).alias("kept"))
    text, page = model.views()
    return table.select("doc_id", text.alias("p_text"), page.alias("p_page"), model.score().alias("score")).withColumn("kept", F.col("score") >= least)


def quality_filter(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of docs, all columns as they are, that score at least ``least``. Decided from
    each row itself, so repeated and null ids need no join."""
    # the row travels as one struct, so no column of docs can clash with a view's name
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    views = cut(with_metadata(docs).select(row, _text_view().alias("text_view"), _metadata_view().alias("page_view")))
    model = co_train(labelled_features(views.select("row.doc_id", "text_view", "page_view"), labels), rounds)
    return docs if model is None else views.where(model.score() >= least).select("row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
