"""Event files, tables of results, and their catalog."""

from __future__ import annotations

import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from onsetlab.functions import safe_name, space_tag
from onsetlab.operators.volumes import coerce

EVENT_COLUMNS = ("onset", "duration", "trial_type")
TEXT_COLUMNS = ("subject", "session", "task", "trial_type", "desc", "stage", "space")
# Texts of an event file that mean a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: A cell after its tab: what quotes enclose may have tabs in it.
CELL = r'\t("(?:[^"]|"")*"[^\t]*|[^\t]*)'


def unquoted(cell: Column) -> Column:
    """A cell's text: without the quotes around it, two quotes within them being one."""
    inner = F.regexp_replace(F.regexp_extract(cell, r'^"((?:[^"]|"")*)"', 1), '""', '"')
    return F.when(F.regexp_like(cell, F.lit(r'^"(?:[^"]|"")*"')), F.concat(inner, F.regexp_replace(cell, r'^"(?:[^"]|"")*"', ""))).otherwise(cell)


def read_events(spark: SparkSession, root: str, name_glob: str = "*_events.tsv") -> DataFrame:
    """All event files below root in one scan: eventfile (its path), event_id (the row's place
    in its file), onset and duration (null for what is no number), trial_type, and a map
    ``extra`` of all further columns.

    Each file's columns go by its own header, so files may differ in their order and number.
    A file is one row until it is split, so it must fit in a task; event logs do."""
    files = spark.read.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True).text(root, wholetext=True)
    lines = F.filter(F.split("value", r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0)
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(CELL), F.lit(1)), unquoted)
    split = files.select(F.col("_metadata.file_path").alias("eventfile"), lines.alias("lines"))
    header = F.regexp_replace(F.get("lines", F.lit(0)), "^\ufeff", "")
    rows = split.select("eventfile", cells(header).alias("names"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("event_id", "line"))
    # short rows lack their last columns, and of a repeated name the first counts
    pairs = F.arrays_zip("names", cells("line").alias("cells"))
    first = F.filter(pairs, lambda p, i: p["names"].isNotNull() & (F.array_position("names", p["names"]) == i + 1))
    value = lambda p: F.when(~p["cells"].isin(*MISSING), p["cells"])
    found = rows.withColumn("found", F.map_from_entries(F.transform(first, lambda p: F.struct(p["names"].alias("k"), value(p).alias("v")))))
    extra = F.map_filter("found", lambda k, _: ~k.isin(*EVENT_COLUMNS))
    return coerce(found.select("eventfile", "event_id", *(F.col("found")[c].alias(c) for c in EVENT_COLUMNS), extra.alias("extra")))


def expected_values(spark: SparkSession, text: str) -> DataFrame:
    """The expected trial types of a JSON list, or of an object that has one."""
    given = json.loads(text)
    if isinstance(given, dict):
        given = given.get("expected_trial_types", given.get("trial_types", []))
    return spark.createDataFrame([(str(x),) for x in given], "trial_type string")


def write_volumes(volumes: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet by subject, or CSV sorted within its parts."""
    if csv:
        volumes.repartition("subject").sortWithinPartitions("subject", "task", "run", "volume_of_interest").write.option("header", True).csv(path)
    else:
        volumes.write.partitionBy("subject").parquet(path)


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table whose text columns are text: names of folders aren't taken for numbers."""
    found = spark.read.option("basePath", path).parquet(path).schema
    kinds = [StructField(f.name, StringType(), f.nullable) if f.name in TEXT_COLUMNS else f for f in found.fields]
    return spark.read.schema(StructType(kinds)).option("basePath", path).parquet(path)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """The volume table with text columns as text ("001" stays), a missing session empty."""
    v = _typed(spark, path)
    return v.withColumn("session", F.coalesce("session", F.lit(""))) if "session" in v.columns else v


RESULT_KEYS = ("desc", "subject", "stage", "fold")


def write_metrics(metrics: DataFrame, path: str, categories: list[str] | None = None) -> None:
    """Tidy metrics in folders by desc, subject, stage and fold, so that a listing tells what there is; the
    order of the categories is kept beside them."""
    given = metrics if "fold" in metrics.columns else metrics.withColumn("fold", F.lit(None).cast("int"))
    given.write.mode("append").partitionBy(*RESULT_KEYS).parquet(path)
    if categories:
        spark = metrics.sparkSession
        descs = [r["desc"] for r in metrics.select("desc").distinct().collect()]  # names of models
        rows = [(d, k, c) for d in descs for k, c in enumerate(categories)]
        spark.createDataFrame(rows, "desc string, place int, category string").coalesce(1).write.mode("append").json(_order_place(path))


def _order_place(path: str) -> str:
    return f"{path.rstrip('/')}-categories"


def read_categories(spark: SparkSession, path: str, desc: str) -> list[str]:
    """A model's categories in their order; no result is read."""
    kept = spark.read.schema("desc string, place int, category string").json(_order_place(path)).where(F.col("desc") == desc)
    return [r["category"] for r in kept.dropDuplicates(["place"]).orderBy("place").collect()]


def read_metrics(spark: SparkSession, path: str, **where) -> DataFrame:
    """Tidy metrics; conditions on desc, subject, stage and fold prune folders."""
    m = _typed(spark, path)
    for k, v in where.items():
        m = m.where(F.col(k) == v)
    return m


def listed(spark: SparkSession, path: str, keys: tuple[str, ...] = RESULT_KEYS) -> DataFrame:
    """The folders' values of the keys, as texts (null where the value is), from a listing of files alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def value(k):
        raw = F.nullif(F.regexp_extract("path", rf"/{k}=([^/]*)", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
        return F.when(raw != "", F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))  # as writers escape names

    return files.select(*(value(k).alias(k) for k in keys)).distinct()


def listed_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(desc, subject, stage, n_folds, has_folds) of the results below a path; their data aren't read."""
    return listed(spark, path).groupBy("desc", "subject", "stage").agg(F.count_distinct("fold").alias("n_folds"), (F.count("fold") > 0).alias("has_folds"))


def listed_maps(spark: SparkSession, path: str) -> DataFrame:
    """(desc, subject, space) of importance maps; those in the shared space can be averaged over subjects."""
    return listed(spark, path, ("desc", "subject", "space"))


#: Of a result's file: keys, metric, and its text.
WIDE_KEYS = (*RESULT_KEYS, "metric")


def write_wide(metrics: DataFrame, path: str, categories: list[str]) -> None:
    """A text for each metric of a result, in a folder of its keys: matrices over the classes with
    labelled rows and columns, values by class with labelled rows, single values to six decimals."""
    place = {c: k for k, c in enumerate(categories)}
    given = metrics if "fold" in metrics.columns else metrics.withColumn("fold", F.lit(None).cast("int"))

    def text(key, pdf):
        rows, columns = pdf["row_label"].fillna(""), pdf["col_label"].fillna("")
        if (rows == "").all():
            lines = [f"{v:.6f}" for v in pdf["value"]]
        else:
            wide = pdf.assign(row_label=rows, col_label=columns.where(columns != "", key[-1])).pivot(index="row_label", columns="col_label", values="value")
            order = lambda names: sorted(names, key=lambda c: place.get(c, len(place)))
            wide = wide.reindex(index=order(wide.index), columns=order(wide.columns))
            lines = wide.rename_axis(index=None, columns=None).to_csv().splitlines()
        return pd.DataFrame([(*key, "\n".join(lines))], columns=[*WIDE_KEYS, "value"])

    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in WIDE_KEYS) + ", value string"
    given.groupBy(*WIDE_KEYS).applyInPandas(text, schema).write.mode("append").partitionBy(*WIDE_KEYS).text(path)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """What write_wide wrote, tidy again: (desc, subject, stage, fold, metric, row_place, row_label,
    col_place, col_label, value); the places keep the order of rows and columns."""
    kinds = StructType([StructField("value", StringType()), *(StructField(k, IntegerType() if k == "fold" else StringType()) for k in WIDE_KEYS)])
    texts = spark.read.schema(kinds).option("basePath", path).option("wholetext", True).format("text").load(path)

    def tidy(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                key = tuple(None if pd.isna(r[k]) else r[k] for k in WIDE_KEYS)
                lines = r["value"].splitlines()
                if not lines[0].startswith(","):
                    out += [(*key, k, "", 0, "", float(x)) for k, x in enumerate(lines)]
                    continue
                wide = pd.read_csv(io.StringIO(r["value"]), index_col=0, keep_default_na=False, dtype=str)
                for a, (row, values) in enumerate(wide.iterrows()):
                    for b, (column, x) in enumerate(values.items()):
                        out.append((*key, a, str(row), b, "" if column == key[-1] else column, float(x) if x else float("nan")))
            yield pd.DataFrame(out, columns=[*WIDE_KEYS, "row_place", "row_label", "col_place", "col_label", "value"])

    out = texts.mapInPandas(tidy, "desc string, subject string, stage string, fold int, metric string, row_place int, row_label string, col_place int, col_label string, value double")
    return out.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # what pandas takes for missing


def wide_matrix(metrics: DataFrame, categories: list[str], keys: list[str] = ()) -> DataFrame:
    """A matrix of metrics with a column per class."""
    return metrics.groupBy(*keys, "row_label").pivot("col_label", categories).agg(F.first("value"))


def catalog(metrics: DataFrame) -> DataFrame:
    """What results there are: (desc, subject, stage, n_folds)."""
    return metrics.groupBy("desc", "subject", "stage").agg(F.count_distinct("fold").alias("n_folds"))


def missing_results(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (desc, subject, stage) that have no results."""
    keys = ["desc", "subject", "stage"]
    return wanted.select(*keys).join(metrics.select(*keys).distinct(), keys, "left_anti")


def write_decoding(decoded: DataFrame, path: str) -> None:
    decoded.write.partitionBy("desc", "subject").parquet(path)


def read_decoding(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path)


def write_folds(manifest: DataFrame, path: str) -> None:
    """The runs that each fold holds out, as JSON lines by subject."""
    manifest.write.partitionBy("subject").json(path)


def write_importance(maps: DataFrame, path: str) -> None:
    """Maps in folders by desc, subject and space, which is told by the column mni where there is one."""
    given = maps if "space" in maps.columns else maps.withColumn("space", space_tag(F.col("mni") if "mni" in maps.columns else F.lit(False)))
    given.drop("mni").write.mode("append").partitionBy("desc", "subject", "space").parquet(path)


def result_name(df: DataFrame, *parts: str) -> DataFrame:
    """Adds a safe file name made of columns."""
    return df.withColumn("name", safe_name(F.concat_ws("_", *parts)))
