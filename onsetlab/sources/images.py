"""Images of a public binary format: headers, frames in a mask, and masks, read by listing.

Spark lists the files and deals them out; a task opens each one itself and reads it as a stream, so no
file is ever a row. A header takes a file's first bytes; frames are inflated, scaled and cut to the mask
one after another, so memory is bounded by a frame, whatever the file's length or compression.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.functions import entity

#: Data type codes of the format's header, and those of types that aren't numbers of one value.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
OTHER_KINDS = {0: "unknown", 1: "bits", 32: "complex", 128: "colours", 1536: "128-bit floats", 1792: "complex", 2048: "complex", 2304: "colours"}
HEADER = 348
#: Bytes that are asked of a file at one time: for a header, for frames.
FIRST, PART = 512, 1 << 20
#: Frames that leave a task together, by values.
BATCH_VALUES = 2_000_000
ABOUT = "tr double, n_frames int, grid array<int>, sizes array<double>, sform array<double>"
PATTERNS = f"boldfile string, volume int, {ABOUT}, features array<float>"


class Stream:
    """A file's bytes in order, inflated if they are compressed; counts what was read of the file."""

    def __init__(self, file: BinaryIO, part: int = PART):
        self.file, self.part, self.read_bytes = file, part, 0
        self.rest, self.over = b"", False
        self.inflate = None
        first = self._more()
        if first[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
            self.packed = first
        else:
            self.rest = first

    def _more(self) -> bytes:
        raw = self.file.read(self.part)
        self.read_bytes += len(raw)
        self.over = not raw
        return raw

    def read(self, n: int) -> bytes:
        """The next n bytes; fewer at the end."""
        parts, have = [self.rest], len(self.rest)
        while have < n:
            if self.inflate is None:
                new = self._more()
            else:
                packed = self.packed or self._more()
                # at most what is wanted, so that a part that inflates much isn't held whole
                new = self.inflate.decompress(packed, n - have) if packed else b""
                self.packed = self.inflate.unconsumed_tail
                if self.inflate.eof:  # another member may follow
                    self.packed = self.inflate.unused_data
                    self.inflate = zlib.decompressobj(31)
            if not new and self.over:
                break
            parts.append(new)
            have += len(new)
        whole = b"".join(parts)
        self.rest = whole[n:]
        return whole[:n]


def header_of(head: bytes) -> dict:
    """About a file from its first 348 bytes, in either byte order."""
    if len(head) < HEADER:
        raise ValueError("too short for a header")
    order = next((o for o in "<>" if struct.unpack(f"{o}i", head[:4])[0] == HEADER), None)
    if order is None:
        raise ValueError("no header of the format")
    of = lambda kind, at: struct.unpack_from(f"{order}{kind}", head, at)
    dims, steps, (code,) = of("8h", 40), of("8f", 76), of("h", 70)
    if code not in KINDS:
        raise ValueError(f"values of data type {code} ({OTHER_KINDS.get(code, 'none of the format')}) can't be read")
    start, slope, shift = of("3f", 108)
    qform, sform = of("2h", 252)
    sizes = [float(s) for s in steps[1:4]]
    if sform > 0:
        rows = list(map(float, of("12f", 280)))
    elif qform > 0:
        rows = _rows_of(of("6f", 256), sizes, -1.0 if steps[0] < 0 else 1.0)
    else:
        rows = [sizes[0], 0.0, 0.0, 0.0, 0.0, sizes[1], 0.0, 0.0, 0.0, 0.0, sizes[2], 0.0]
    grid = [max(1, d) for d in dims[1:4]]
    return {
        "grid": grid, "sizes": sizes, "sform": rows, "tr": float(steps[4]), "n_frames": max(1, dims[4]) if dims[0] >= 4 else 1, "kind": np.dtype(KINDS[code]).newbyteorder(order),
        "start": int(start), "scale": (slope, shift if np.isfinite(shift) else 0.0) if np.isfinite(slope) and slope != 0 else None,
    }


def _rows_of(quaternion: tuple, sizes: list[float], side: float) -> list[float]:
    """The three rows of the transform that a rotation, an offset and voxel sizes give."""
    b, c, d, *offset = quaternion
    a = max(0.0, 1.0 - (b * b + c * c + d * d)) ** 0.5
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
    return np.concatenate([r * [sizes[0], sizes[1], sizes[2] * side], np.array(offset)[:, None]], axis=1).reshape(-1).tolist()


def frames_of(stream: Stream, voxels: np.ndarray | None = None) -> Iterator[tuple[dict, np.ndarray]]:
    """(about the file, values of one frame in the mask) after another."""
    head = stream.read(HEADER)
    about = header_of(head)
    stream.read(about["start"] - HEADER)
    n = int(np.prod(about["grid"]))
    if voxels is not None and len(voxels) and (voxels[-1] >= n or voxels[0] < 0):
        raise ValueError(f"the mask has voxel {voxels[-1]}, the grid has {n}")
    for k in range(about["n_frames"]):
        raw = stream.read(n * about["kind"].itemsize)
        if len(raw) < n * about["kind"].itemsize:
            raise ValueError(f"ends within frame {k} of {about['n_frames']}")
        x = np.frombuffer(raw, about["kind"])
        x = (x if voxels is None else x[voxels]).astype(np.float32)
        if about["scale"] is not None:
            slope, shift = about["scale"]
            x = x * np.float32(slope) + np.float32(shift)
        yield about, x


def encode(x: np.ndarray, grid: list[int], tr: float, slope: float = 1.0, shift: float = 0.0, sform: list[float] | None = None, quaternion: tuple | None = None) -> bytes:
    """A file of 32-bit floats, as tests and exports need."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, 4, *grid, len(x), 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, tr, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, slope, shift)
    struct.pack_into("<2h", head, 252, int(quaternion is not None), int(sform is not None))
    struct.pack_into("<6f", head, 256, *(quaternion or (0.0,) * 6))
    struct.pack_into("<12f", head, 280, *(sform or (0.0,) * 12))
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(x, "<f4").tobytes()


def open_file(path: str) -> BinaryIO:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")
    return fs.open_input_file(inner)


def list_files(spark: SparkSession, path: str, name_glob: str) -> DataFrame:
    """(path) of the files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", True).load(path).select("path")


def _each_file(files: DataFrame, made: Callable, schema: str) -> DataFrame:
    """Tables of ``made(row, stream)`` for each file, of which a task opens one at a time; an error names its file."""

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                with open_file(row["path"]) as file:
                    try:
                        yield from made(row, file)
                    except ValueError as e:
                        raise ValueError(f"{row['path']}: {e}") from e

    return files.repartition("path").mapInPandas(run, schema)


def scan_headers(spark: SparkSession, path: str, name_glob: str = "*bold.nii*") -> DataFrame:
    """The recordings table from headers alone: boldfile, tr, n_frames, grid, sizes, sform, grid_key and
    read_bytes, what was read of the file for it."""

    def made(row, file):
        stream = Stream(file, FIRST)
        about = header_of(stream.read(HEADER))
        yield pd.DataFrame([{"boldfile": row["path"], **{k: about[k] for k in ("tr", "n_frames", "grid", "sizes", "sform")}, "read_bytes": stream.read_bytes}])

    return _each_file(list_files(spark, path, name_glob), made, f"boldfile string, {ABOUT}, read_bytes long").withColumn("grid_key", grid_key())


def read_patterns(spark: SparkSession, path: str, name_glob: str = "*bold.nii*", masks: DataFrame | None = None) -> DataFrame:
    """One row per frame, with its features in the mask of the file's subject and session (masks:
    subject, session, voxel_idx), or all without masks; files without a mask are left out (see
    patterns.resolve_masks, which raises on them)."""
    files = list_files(spark, path, name_glob)
    if masks is not None:
        named = files.withColumn("subject", entity(F.col("path"), "sub")).withColumn("session", F.coalesce(entity(F.col("path"), "ses"), F.lit("")))
        files = named.join(masks, ["subject", "session"]).select("path", "voxel_idx")

    def made(row, file):
        voxels = np.asarray(row["voxel_idx"], int) if "voxel_idx" in row else None
        held: list[np.ndarray] = []
        volume = 0
        for about, x in frames_of(Stream(file), voxels):
            held.append(x)
            if len(held) * max(1, len(x)) >= BATCH_VALUES:
                yield _rows(row["path"], volume, about, held)
                volume, held = volume + len(held), []
        if held:
            yield _rows(row["path"], volume, about, held)

    return _each_file(files, made, PATTERNS).withColumn("grid_key", grid_key())


def _rows(path: str, volume: int, about: dict, held: list[np.ndarray]) -> pd.DataFrame:
    n = len(held)
    return pd.DataFrame({"boldfile": path, "volume": range(volume, volume + n), "tr": about["tr"], "n_frames": about["n_frames"], **{c: [about[c]] * n for c in ("grid", "sizes", "sform")}, "features": held})


def grid_key(grid: str | Column = "grid", sizes: str | Column = "sizes", sform: str | Column = "sform") -> Column:
    """A text that two images share where they are on one grid: dimensions, voxel sizes to six
    decimals, and the rows of the transform to three."""
    text = lambda x, d: F.format_string(f"%.{d}f", F.round(x.cast("double"), d) + 0.0)
    sized = F.array_join(F.transform(sizes, lambda x: text(x, 6)), ",")
    return F.concat_ws(" ", F.array_join(F.transform(grid, lambda x: x.cast("string")), "x"), sized, F.array_join(F.transform(sform, lambda x: text(x, 3)), ","))


def recordings_of(patterns: DataFrame) -> DataFrame:
    """The recordings table of ingested patterns."""
    return patterns.select("boldfile", "tr", "n_frames", "grid", "sizes", "sform", "grid_key").dropDuplicates(["boldfile"])


def mask_paths(wanted: DataFrame, template: str) -> DataFrame:
    """(subject, session, path): the mask files of each (subject, session). A template is a path with
    ``{subject}``, ``{session}`` and the wildcards of a file search; a key that it has twice must be the same
    in both places. Files are listed once, below the part of the template before its first key or
    wildcard, and meet the wanted keys by what the template reads from their paths."""
    spark = wanted.sparkSession
    root = re.match(r"[^{*?]*", template)[0].rpartition("/")[0]
    pattern, keys = "", []
    for text, wild, key in re.findall(r"([^{*?]+)|(\*\*/|\*\*|[*?])|\{(subject|session)\}", template):
        if key:
            pattern += f"\\k<{key}>" if key in keys else f"(?<{key}>[^/_]*)"
            keys += [key] * (key not in keys)
        else:
            pattern += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(wild) or re.escape(text)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root or "/").select("path")
    local = F.regexp_replace("path", r"^file:(?://(?=/))?", "")
    pattern = "^" + re.sub(r"^file:(?://(?=/))?", "", pattern) + "$"
    found = files.where(local.rlike(pattern)).select("path", *(F.regexp_extract(local, pattern, k + 1).alias(c) for k, c in enumerate(keys)))
    each = wanted.select("subject", "session").distinct()
    # a template without keys is one file for all
    pairs = each.join(found, keys) if keys else each.withColumn("all", F.lit(1)).join(found.withColumn("all", F.lit(1)), "all").drop("all")
    return pairs.select("subject", "session", "path")


def read_masks(wanted: DataFrame, template: str) -> DataFrame:
    """(subject, session, voxel_idx, grid_key): the voxels, ascending, where each one's mask image is not 0. Raises
    unless every (subject, session) has just one file, before any image is read."""
    found = mask_paths(wanted, template)
    keys = ["subject", "session"]
    counted = wanted.select(*keys).distinct().join(found, keys, "left").groupBy(*keys).agg(F.count("path").alias("n"), F.min("path").alias("path"))
    bad = counted.where("n <> 1").limit(5).collect()
    if bad:
        raise ValueError(f"masks missing or ambiguous for {template}: {[(r['subject'], r['session'], r['n']) for r in bad]}")

    def made(row, file):
        about, x = next(frames_of(Stream(file)))
        yield pd.DataFrame([{"subject": row["subject"], "session": row["session"], "voxel_idx": np.flatnonzero(x), **{k: about[k] for k in ("grid", "sizes", "sform")}}])

    out = _each_file(counted.select(*keys, "path"), made, "subject string, session string, voxel_idx array<int>, grid array<int>, sizes array<double>, sform array<double>")
    return out.select(*keys, "voxel_idx", grid_key().alias("grid_key"))
