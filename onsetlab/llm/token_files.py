"""Operator 11: token ids as files of fixed-width bit-packed blocks.

Every id takes the minimum of bits that the vocabulary's size asks for. 64 ids of w bits fill
w whole 64-bit words, so a block is packed and unpacked by 64 column operations on numpy
arrays, and any id's place follows from its number.

A file, all numbers little-endian::

    magic (8 bytes), width of an id in bits, ids in a block (two uint32)
    blocks of packed ids, the last one filled up to a multiple of 64 ids
    offsets of the blocks (uint64), their crc32 (uint32)
    number of each document's first id in the file (uint64), doc_id (int64), null doc_id (uint8)
    ids, documents, blocks, place of the offsets (four uint64), magic

How it runs: rows are dealt over range partitions of (doc_id, digest of the text), so ids
are in ascending doc_id order over all files, and a doc_id that many rows share is dealt over
several partitions. Each task sorts its rows, encodes them and streams full blocks to files
of its own; a document is never divided between files. A file's name is new for each attempt of
a task, and the row that names it (partition, place, counts) is committed by Spark's own writer
in the same job: files of attempts that were lost are in no row, and nobody reads them.
The driver holds one row a file (counts only) to add up the files' first ids.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; rows with
equal doc_id are in the order of the digest and text, each a document of its own; a very long
text passes through in chunks of blocks; an empty table makes no files and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.llm.bpe import byte_letters
from onsetlab.llm.common import SLICE_ROWS, new_place, texts, vocab_path, worker_cached, written_at

END_ID = 2
MAGIC = b"IDBITS01"
BLOCK_IDS = 4096
#: Blocks that are packed, or unpacked, at one time.
CHUNK_BLOCKS = 64
#: A file is closed after so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "part int, nth int, place string, n_docs long, n_ids long"

#: Texts with so long a stretch with, or without, white space go to the tokenizers library as they are.
LONG = 4000
STRETCH = re.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")


class ByteIds:
    """Little-endian uint32 ids of whole texts by a byte-level vocabulary file of the tokenizers
    library; its special strings inside a text become their ids, as they do there by default.

    Pairs merge in the order of ids (else it raises), so ids are ranks, and tiktoken's core
    merges by them at about a fifth of the time; the tests hold it against the library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("ids are not in the order of merges")
        byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        ranks = {s.translate(byte_of).encode("latin-1"): i for s, i in vocab.items() if s not in special}
        self.library = Tokenizer.from_file(path)
        self.core = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG and STRETCH.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=()).tobytes()


@worker_cached("token files")
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))


def width_of(size: int) -> int:
    """Bits that hold every id below ``size``."""
    return max(1, (size - 1).bit_length())


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """For each of 64 ids: its word, its shift there, and bits that go over into the next word."""
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        yield word, shift, max(0, shift + width - 64)


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, filled up with zeros to a multiple of 64 ids."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), "<u8")
    for lane, (word, shift, over) in enumerate(_lanes(width)):
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if over:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(width - over)
    return out.tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    words = np.frombuffer(raw, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << width) - 1)
    for lane, (word, shift, over) in enumerate(_lanes(width)):
        value = words[:, word] >> np.uint64(shift)
        if over:
            value = value | words[:, word + 1] << np.uint64(width - over)
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


def _file_system(place: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(place)


class Writer:
    """One file: documents are added in order, full blocks are written as they come."""

    def __init__(self, place: str, width: int):
        fs, path = _file_system(place)
        self.out, self.width, self.place = fs.open_output_stream(path), width, place
        self.at = self.out.write(MAGIC + struct.pack("<II", width, BLOCK_IDS)) and 16
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.offsets, self.sums, self.starts, self.doc_ids, self.nulls = (array(k) for k in "QIQqB")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document, its ids as little-endian uint32."""
        self.starts.append(self.n_ids)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= BLOCK_IDS * CHUNK_BLOCKS:
            self._flush(self.n_waiting - self.n_waiting % BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        for at in range(0, n, BLOCK_IDS * CHUNK_BLOCKS):
            part = ids[at : min(n, at + BLOCK_IDS * CHUNK_BLOCKS)]
            raw, size = memoryview(pack(part, self.width)), BLOCK_IDS // 8 * self.width
            for k in range(0, len(raw), size):
                self.offsets.append(self.at + k)
                self.sums.append(zlib.crc32(raw[k : k + size]))
            self.out.write(raw)
            self.at += len(raw)
        self.waiting, self.n_waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[str, int, int]:
        """Write what is left and the tables; place, documents and ids of the file."""
        if self.n_waiting:
            self._flush(self.n_waiting)
        columns = (("<u8", self.offsets), ("<u4", self.sums), ("<u8", self.starts), ("<i8", self.doc_ids), ("u1", self.nulls))
        for kind, values in columns:
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<4Q", self.n_ids, len(self.doc_ids), len(self.offsets), self.at) + MAGIC)
        self.out.close()
        return self.place, len(self.doc_ids), self.n_ids


class TokenFile:
    """A file that was written; its tables are read at once, its ids as they are asked for."""

    def __init__(self, place: str):
        fs, path = _file_system(place)
        self.file = fs.open_input_file(path)
        magic, self.width, self.block_ids = struct.unpack("<8sII", self.file.read_at(16, 0))
        size = self.file.size()
        self.n_ids, n_docs, n_blocks, at, tail = struct.unpack("<4Q8s", self.file.read_at(40, size - 40))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{place} is no whole file of token ids")

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += out.nbytes
            return out

        self.end = at
        self.offsets, self.sums = column("<u8", n_blocks), column("<u4", n_blocks)
        self.starts, self.doc_ids, self.nulls = column("<u8", n_docs), column("<i8", n_docs), column("u1", n_docs)
        self.ends = np.append(self.starts[1:], np.uint64(self.n_ids)) if n_docs else self.starts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start up to stop, reading the blocks that hold them and no others."""
        stop = min(stop, self.n_ids)
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        begin, until = int(self.offsets[first]), int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        raw = memoryview(self.file.read_at(until - begin, begin))
        for k in range(first, last + 1):
            at = int(self.offsets[k]) - begin
            if zlib.crc32(raw[at : int(self.offsets[k + 1]) - begin if k < last else len(raw)]) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
        skip = first * self.block_ids
        return unpack(raw, stop - skip, self.width)[start - skip :]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.ends[k]))

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first id, ids) through the whole file."""
        step = self.block_ids * CHUNK_BLOCKS
        for at in range(0, self.n_ids, step):
            yield at, self.ids(at, at + step)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode documents and write their ids as files in the folder; a row for each file
    (part, nth, place, n_docs, n_ids), which is also kept as a table in the folder."""
    width = width_of(vocabulary_size(vocabulary))
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("place", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    end = array("I", [end_id]).tobytes()
    folder = folder if "://" in folder else f"file://{folder}"
    docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/ids"))

    def write(batches):
        encode = byte_ids(vocabulary).encode
        part, nth, file = TaskContext.get().partitionId(), 0, None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, nth, *file.close()), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                for i, t in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    if file is None:
                        file = Writer(f"{folder}/ids/{part:06d}-{nth:04d}-{uuid.uuid4().hex}.bits", width)
                    file.add(i, encode(t) + end)
                    if file.n_ids >= FILE_IDS or len(file.doc_ids) >= FILE_DOCS:
                        yield closed()
                        file, nth = None, nth + 1
        if file is not None:
            yield closed()

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    order = [F.col("doc_id").asc_nulls_first(), "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return written_at(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), f"{folder}/files")


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files, a task for each file: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and, if asked for, ids."""
    spark = files.sparkSession
    known, first = [], 0
    for r in sorted(files.collect(), key=lambda r: (r["part"], r["nth"])):
        known.append((r["place"], first))
        first += r["n_ids"]
    given = spark.createDataFrame(spark.sparkContext.parallelize(known, max(1, len(known))), "place string, first long")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(kinds)

    def read(batches):
        for batch in batches:
            for place, before in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _documents(TokenFile(place), before, schema, with_ids)

    return given.mapInArrow(read, SCHEMA + ", ids array<int>" * with_ids)


def _documents(file: TokenFile, before: int, schema: pa.Schema, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the documents that end in each chunk; a checksum, or ids, of one that goes on are carried over."""
    k, crc, held = 0, 0, []
    for at, ids in file.chunks():
        raw = memoryview(ids.tobytes())
        stop = int(np.searchsorted(file.ends, at + len(ids), "right"))
        sums, lists = [], []
        for d in range(k, stop):
            own = raw[max(0, int(file.starts[d]) - at) * 4 : (int(file.ends[d]) - at) * 4]
            sums.append(zlib.crc32(own, crc))
            crc = 0
            if with_ids:
                lists.append(np.frombuffer(b"".join([*held, own]), "<i4"))
                held = []
        rest = raw[max(0, int(file.ends[stop - 1]) - at if stop else 0) * 4 :]
        crc = zlib.crc32(rest, crc)
        if with_ids and len(rest):
            held.append(rest)
        if stop > k:
            nulls = file.nulls[k:stop].astype(bool)
            columns = [pa.array(file.doc_ids[k:stop], mask=nulls), pa.array((file.starts[k:stop] + np.uint64(before)).astype(np.int64)), pa.array((file.ends[k:stop] - file.starts[k:stop]).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.int32()))] if with_ids else columns, schema=schema)
        k = stop


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path("byte_bpe_50k.json"), new_place(spark))
    return read_token_files(files)
