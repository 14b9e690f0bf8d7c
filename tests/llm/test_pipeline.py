import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from onsetlab.llm import common, entries, jaccard, packing, secrets
from onsetlab.llm.common import cut

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_shrink(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, DIR))
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == n


def test_eleven_queries():
    names = list(entries.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entries.oracle_sql()) <= set(names)


def _stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, DIR))
        assert out.columns == docs.columns
        docs = out
    return docs, cut(corpus_pipeline.STAGES[-1][1](spark, docs, DIR))


def test_null_repeated_long_and_further(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name in ("rep", "n", "score", "features", "lang_pred", "component_id", "piece"):
        docs = docs.withColumn(name, F.lit("clash").cast("string"))
    docs = cut(docs)
    nothing = spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema)
    empty = nothing.limit(1).withColumn("doc_id", F.lit(10**9).cast("long")).withColumn("text", F.lit(""))
    long = docs.limit(1).withColumn("doc_id", F.lit(10**9 + 1).cast("long")).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(300)))
    rows = docs.unionByName(docs.limit(5)).unionByName(nothing).unionByName(empty).unionByName(long)
    kept, packed = _stages(spark, cut(rows))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids)) and None not in ids and 10**9 not in ids
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    kept, packed = _stages(spark, docs)
    assert kept.count() == 0 and packed.count() == 0


def test_long_texts_come_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 4000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    for start in (lambda: common.map_rows(docs, list, "n long"), lambda: common.text_udf(list, "string"), lambda: secrets.word_bits(docs.limit(0)), lambda: jaccard.runs(docs, ["doc_id"], ["text"], "n long", None)):
        spark.conf.unset(common.BATCH_KEY)
        start()
        found = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 3000 and max(r["bytes"] for r in found) <= common.BATCH_BYTES + 5000
    spark.conf.set(common.BATCH_KEY, "1m")
    common.small_batches(spark)
    assert spark.conf.get(common.BATCH_KEY) == "1m"
    spark.conf.unset(common.BATCH_KEY)


def test_packing_takes_no_further_python_workers(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 10)
    rows = spark.range(0, 2000, 1, 4).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id < 1300, 700L, 3000 + id % 7) as length", "id as ids_crc32")
    packed = packing.pack(cut(rows))
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    found = packed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len({r["doc_id"] for r in found}) == 2000
    by = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096 and len(by) == 820  # 700 beside one of 3000 to 3006, and five of 700 alone
