"""Frames laid out by recording, or by frame: bucketed and sorted by time, once.

By recording, what works by recording (standard scores, detrending, means) reads its buckets as they lie, and
a section's rows are moved to the frames, not the frames to the rows: no features are
shuffled again after the table is written. A recording's rows are then one list beside each of its frames, so this is for
few rows of a recording; many meet frames that are laid out by frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.sources.store import drop_folder, shared_folder


def store_frames(frames: DataFrame, folder: str | None = None, name: str | None = None, buckets: int | None = None, by: tuple[str, ...] = ("boldfile",)) -> DataFrame:
    """Write frames (boldfile, volume, features, ...) as a table in the folder and read it. One
    recording (or by boldfile and volume: one frame, see slice_patterns) is in one bucket; there are as many as shuffle partitions unless told (with fewer, a join may deal the frames anew)."""
    spark = frames.sparkSession
    name = name or f"frames_{uuid.uuid4().hex}"
    folder = folder or f"{shared_folder(spark)}/{name}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy("boldfile", "volume").option("path", folder).saveAsTable(name)
    return spark.table(name)


def drop_frames(spark: SparkSession, frames: DataFrame) -> None:
    """Take away a stored table and its files; nothing may read it any more."""
    files = frames.inputFiles()
    name = next((t.name for t in spark.catalog.listTables() if t.name.startswith("frames_") and set(spark.table(t.name).inputFiles()) == set(files)), None)
    if name:
        spark.sql(f"drop table {name}")
    for folder in {f.rpartition("/")[0] for f in files}:
        drop_folder(spark, folder)


def slice_stored(volumes: DataFrame, frames: DataFrame) -> DataFrame:
    """As patterns.slice_patterns, for stored frames: rows are gathered by recording (without features)
    and meet the frames where those lie; frames that no row asks for go."""
    kept = volumes.where("volume_of_interest >= 0")
    own = kept.withColumnRenamed("boldfile", "__file").groupBy(F.col("__file").alias("boldfile")).agg(F.collect_list(F.struct("volume_of_interest", *(c for c in volumes.columns if c not in ("boldfile", "volume_of_interest")))).alias("__rows"))
    met = frames.select("boldfile", "volume", "features").join(own, "boldfile")
    mine = F.filter("__rows", lambda r: r["volume_of_interest"] == F.col("volume"))
    out = met.select("boldfile", F.explode(mine).alias("__row"), "features")
    return out.select("boldfile", *(F.col("__row")[c].alias(c) for c in ("volume_of_interest", *(c for c in volumes.columns if c not in ("boldfile", "volume_of_interest")))), "features")
