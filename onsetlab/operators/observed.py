"""Filters that count what they drop, within the job that runs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def kept(df: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    """Rows where ``keep`` holds, and an observation whose ``get`` has the numbers of rows and of
    dropped ones once some action on the result has run."""
    seen = Observation()
    hold = F.coalesce(keep, F.lit(False))
    return df.observe(seen, F.count("*").alias("rows"), F.count_if(~hold).alias("dropped")).where(hold), seen
