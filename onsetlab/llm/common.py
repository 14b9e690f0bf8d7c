"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from onsetlab.sources.store import shared_folder

#: Texts that are Python objects at one time in a task.
SLICE_ROWS = 256
#: Bytes of rows that Spark hands a Python worker at a time, and Spark's own bound (64 MB), which
#: executors hold for each task, in buffers that double, outside their heap and in the worker again.
BATCH_BYTES, BATCH_KEY, BATCH_DEFAULT = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def vocab_path(name: str) -> str:
    """Place of a public vocabulary file; every node has the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that what follows
    neither recomputes it nor depends on the executors that made it."""
    return written_at(df, new_place(df.sparkSession))


def new_place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"


def written_at(df: DataFrame, place: str) -> DataFrame:
    """As cut(), at a place that drop_written() can take away once nothing reads it."""
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def drop_written(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python ``BATCH_BYTES`` at a time, however long they are. A session
    that names a bound of its own keeps it."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterator[tuple]]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Arrow batches through a function of columns.

    ``make()`` runs once in each task and returns ``f(columns)``, which takes a list of
    Python lists (one for each column of df) and yields output rows as tuples. Rows
    are handed over ``slice_rows`` at a time, so a batch of very long texts is never
    expanded as a whole."""
    small_batches(df.sparkSession)
    out = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = list(f([c.to_pylist() for c in part.columns]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), out)], schema=out)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    return [pa.field(x.name, to_arrow_type(x.dataType)) for x in StructType.fromDDL(schema).fields]


def texts(df: DataFrame) -> DataFrame:
    """Id and text only, so that further columns of any name never matter. A null text is empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


_tables: dict = {}


def worker_tables(owner: str) -> dict:
    """What the operator ``owner`` keeps in this Python worker. A worker is used for one
    operator after another and holds the tables of one at a time: the first call for
    another operator lets go of all that was there."""
    if owner not in _tables:
        if _tables:
            _tables.clear()
            give_back()
        _tables[owner] = {}
    return _tables[owner]


def give_back() -> None:
    """Return to the system what this process has freed: allocators keep it otherwise, and the next
    operator's tables come on top of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def worker_cached(owner: str):
    """Remember a function's results by its arguments, in the worker's tables of ``owner``."""

    def of(fn):
        def call(*args):
            own, key = worker_tables(owner), (fn.__qualname__, args)
            if key not in own:
                own[key] = fn(*args)
            return own[key]

        return call

    return of


def text_udf(make: Callable[[], Callable[[list], pa.Array | list]], returns: str) -> Callable:
    """An Arrow UDF of one column. ``make()`` runs once in each task and returns ``f(values)``,
    which gets at most ``SLICE_ROWS`` values as a list, so that long texts are never Python
    objects by the batch, and returns as many results. Spark takes it for a function that may
    differ from call to call, so that a filter on its result doesn't make it run twice."""

    small_batches(SparkSession.active())
    kind = to_arrow_type(DataType.fromDDL(returns))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for column in columns:
            parts = []
            for at in range(0, max(1, len(column)), SLICE_ROWS):
                part = f(column.slice(at, SLICE_ROWS).to_pylist())
                parts.append(part if isinstance(part, pa.Array) else pa.array(part, kind))
            yield pa.concat_arrays(parts)
            del parts, column
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, returns).asNondeterministic()


class Recent(dict):
    """Results of ``f`` that were asked for lately, by key, within a bound in bytes.

    There are two generations of at most ``most_bytes`` each. When the younger is full it
    becomes the older, whose results are let go of unless they are asked for again."""

    #: Bytes of an entry besides the key's and the value's own: slots, headers.
    ENTRY = 160

    def __init__(self, f: Callable, most_bytes: int, size: Callable = len):
        super().__init__()
        self.f, self.most_bytes, self.size = f, most_bytes, size
        self.older: dict = {}
        self.bytes = 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.f(key)
        cost = self.ENTRY + len(key) + self.size(value)
        if cost > self.most_bytes // 64:
            return value
        if self.bytes + cost > self.most_bytes:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += cost
        self[key] = value
        return value


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
