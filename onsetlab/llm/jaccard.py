"""Operator 9: n-gram Jaccard join, heavy and light by set size.

A document's set is its distinct 3-word shingles. Sets that are equal are one *class*
with the smallest id as its representative. Of the classes:

* light (small sets): every subset of a fixed size that a partner of at least the wanted
  similarity could share is enumerated; who shares one is linked, with the smallest set of
  those who share it, which loses no connection, as any two that link by this subset also
  link with that one;
* heavy (large sets): inverted lists, scanned only for as many of a set's rarest elements
  as a partner must share at least one of. Lists are merged by a member they have in
  common, and within a merged list pairs of fitting size are counted by scanning the
  inverted lists of their elements, in blocks of bounded size: first each block with itself
  and the next one, which joins the copies of one text however many they are, by as many
  block pairs as there are blocks; then, of lists with more blocks, only the members that
  are not yet in their list's main component against all others. Before texts are moved,
  sets meet as counts of elements by hash bucket, and those go whose counts have too little
  in common with any other's: two sets share at most the sum of the smaller counts.

The boundary between the two is the size at which enumerating costs more than scanning,
by the histogram of set sizes. Rarity comes from a fixed-size table of shingle counts over
all documents; it only sets the order, so the result doesn't depend on it.

Output is one row per document with its component, never pairs. Broadcast: the table of
rarity and a table of wanted ids (1 MB each).

Defined cases: documents without words, or with null text, have size 0 and link with
nothing; fewer than three words are one shingle; a null id has a null component and
links with nothing; a very long text is one set, hashed at once; repeated rows give a row
each; an id repeated with other text is
one node; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.llm.common import cut, map_rows, small_batches, worker_tables
from onsetlab.llm.components import Forest, components

#: Similarity as a fraction of integers: links need TOP/BOTTOM at least.
TOP, BOTTOM = 9, 10
WORDS = 3
#: Buckets of the table of rarity, and the rows it is sent in.
BUCKETS, CHUNKS = 1 << 20, 256
#: No set above this size is enumerated, whatever the histogram says.
MOST_LIGHT = 29
#: Cost of a scanned list entry in enumerated subsets.
SCAN_COST = 8
#: A set's elements are counted in buckets of about so many, by a power of two of buckets.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4, 32, 4096
#: A block of a merged list has at most so many sets, and about so many elements.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 400_000
#: Blocks are numbered in steps of so many parts; those of a hub's main component come after MAIN.
PARTS, MAIN = 1 << 20, 1 << 60
MEMO_ROWS = 300_000
#: Bits of the table that chooses whose texts are sent.
ID_BITS = 1 << 23


class _Hashes(dict):
    """Hashes of words, remembered in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO_ROWS:
                self.clear()
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Lower case is for A-Z, and words are
    split at the six ASCII blanks, as bytes.lower and bytes.split do."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    split = raw.lower().split() if raw else []
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = worker_tables("n-gram Jaccard join").setdefault("words", _Hashes())
    h = np.fromiter(map(hashes.__getitem__, split), np.uint64, n)
    k = min(n, words)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out + h[j : n - k + 1 + j])
    return np.unique(out)


def sizes_allowed(n: int, top: int = TOP, bottom: int = BOTTOM) -> int:
    """Elements that a set of n must share at least with any partner."""
    return -(-top * n // bottom)


def rarity(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Quarter-octave level of each bucket's count of shingles, over all documents."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = [shingle_hashes(t, words) for t in batch.column(0).slice(at, 256).to_pylist()]
                if some:
                    buckets, n = np.unique(np.concatenate(some) >> np.uint64(44), return_counts=True)
                    total[buckets.astype(np.int64)] += n.astype(np.uint32)
        if total.any():
            parts = total.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "part": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(part.as_py()), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        for chunk, x in sums.items():
            level = np.floor(4 * np.log2(x.astype(float) + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([level.tobytes()], pa.binary())})

    small_batches(docs.sparkSession)
    schema = "chunk int, part binary"
    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.uint8)
    for r in docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["part"], np.uint8)
    return out.ravel()


def elements(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Elements in the order of rarity: the level above 56 bits of the hash, sorted. As signed integers."""
    e = level[(hashes >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    e.sort()
    return e.view(np.int64)


def _bounded(x: np.ndarray) -> int:
    return int(x.view(np.uint64).sum(dtype=np.uint64).astype(np.int64))


def sketch(e: np.ndarray) -> bytes:
    """Counts of a set's elements by their last bits, a byte each; empty where one doesn't fit a byte."""
    width = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (len(e) // PER_BUCKET).bit_length()))
    counts = np.bincount(e & (width - 1), minlength=width)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Elements that each pair of sets shares at most, by their sketches. Of two widths the
    wider is folded; an empty sketch allows as many as the smaller set has."""
    out = np.minimum(n_a[:, None], n_b[None, :])
    wide_a, wide_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])

    def counts(side, at, width):
        return np.array([np.frombuffer(side[k], np.uint8).reshape(-1, width).sum(axis=0) for k in at], np.uint16)

    for wa in np.unique(wide_a[wide_a > 0]):
        for wb in np.unique(wide_b[wide_b > 0]):
            i, j, width = np.flatnonzero(wide_a == wa), np.flatnonzero(wide_b == wb), int(min(wa, wb))
            x, y = counts(a, i, width), counts(b, j, width)
            for k, row in zip(i, x):
                out[k, j] = np.minimum(row, y).sum(axis=1)
    return out


def signatures(docs: DataFrame, level, words: int, top: int, bottom: int) -> DataFrame:
    """doc_id, n, two sums that tell sets apart, the set's first elements (all, if it may be light) and its sketch."""

    def make():
        def rows(c):
            table = level.value
            for i, t in zip(*c):
                e = elements(shingle_hashes(t, words), table)
                n = len(e)
                first = e if n <= MOST_LIGHT * bottom // top else e[: n - sizes_allowed(n, top, bottom) + 1]
                yield i, n, _bounded(e), _bounded(mix(e.view(np.uint64))), first.tolist(), sketch(e)

        return rows

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n int, s1 long, s2 long, first array<long>, sketch binary")


def boundary(histogram: dict[int, int], top: int = TOP, bottom: int = BOTTOM) -> int:
    """Largest size that is light, at the least cost over all sets."""

    def subsets(n: int) -> int:
        return sum(math.comb(n, a) for a in range(n * (bottom - top) // bottom + 1))

    def cost(x: int) -> int:
        small = sum(k * subsets(n) for n, k in histogram.items() if n * top <= x * bottom)
        return small + SCAN_COST * sum(k * (n - sizes_allowed(n, top, bottom) + 1) for n, k in histogram.items() if n > x)

    return min(range(MOST_LIGHT + 1), key=cost)


def light_links(classes: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """Links (a, b) of pairs whose smaller set has at most ``most`` elements. Sets somewhat
    larger take part as partners."""

    def make():
        def rows(c):
            for rep, n, s1, s2, first in zip(*c):
                e = np.array(first, np.int64).view(np.uint64)
                m = mix(e)
                for a in range(n * (bottom - top) // bottom + 1):
                    for left_out in itertools.combinations(range(n), a):
                        k = list(left_out)
                        yield rep, n, n - a, (s1 - int(e[k].sum(dtype=np.uint64))) % 2**64 - 2**63, (s2 - int(m[k].sum(dtype=np.uint64))) % 2**64 - 2**63

        return rows

    light = classes.where(F.col("n").between(1, most * bottom // top)).select("rep", "n", "s1", "s2", "first")
    subsets = map_rows(light, make, "rep long, n int, shared int, s1 long, s2 long")
    key = ["shared", "s1", "s2"]
    smallest = subsets.groupBy(*key).agg(F.min(F.struct("n", "rep")).alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = subsets.join(smallest, key)
    fits = bottom * F.col("shared") >= top * (F.col("n") + F.col("least.n") - F.col("shared"))
    return pairs.where(fits & (F.col("rep") != F.col("least.rep"))).select(F.col("rep").alias("a"), F.col("least.rep").alias("b"))


def merged_lists(classes: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """(hub, rep, n): inverted lists of the heavy sets' rarest elements, merged by the
    member with the smallest hash; any two sets that could link share a hub. One element's
    postings (an id and a size for each set, no texts) are sorted in one task."""
    heavy = classes.where(F.col("n") > most)
    prefix = (F.col("n") - F.ceil(F.lit(top) * F.col("n") / bottom) + 1).cast("int")
    postings = heavy.select("rep", "n", F.explode(F.slice("first", F.lit(1), prefix)).alias("element"))
    by = Window.partitionBy("element")
    near = by.orderBy("n", "rep")
    fits = (bottom * F.lag("n").over(near) >= top * F.col("n")) | (bottom * F.col("n") >= top * F.lead("n").over(near))
    postings = postings.withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits")
    hub = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("r"))).over(by)["r"]
    return postings.withColumn("hub", hub).select("hub", "rep", "n").distinct()


def in_blocks(lists: DataFrame) -> DataFrame:
    """(hub, rep, n, block): members in blocks of about BLOCK_SETS, in order of size. Blocks are
    numbered from the counts by hub and size; sets of one size that fill more than a block
    are dealt by hash, so no task sorts a hub."""
    sizes = lists.groupBy("hub", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("hub").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    base = F.floor(earlier(F.col("c")) / BLOCK_SETS) + F.floor(earlier(F.col("c") * F.col("n")) / BLOCK_ELEMENTS)
    parts = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("c") * F.col("n") / BLOCK_ELEMENTS))
    placed = sizes.select("hub", "n", (base * PARTS).alias("base"), parts.alias("parts"))
    return lists.join(placed, ["hub", "n"]).select("hub", "rep", "n", (F.col("base") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))


def block_pairs(members: DataFrame, top: int, bottom: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (hub, i, j) of blocks whose sizes may fit: each with itself and the next one, and
    the others, whose number grows with the square of a hub's blocks."""
    span = members.groupBy("hub", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("k"))
    order = Window.partitionBy("hub").orderBy("block")  # of blocks, not of their members
    span = span.withColumn("next", F.lead("block").over(order)).withColumn("next_low", F.lead("low").over(order))
    follows = F.when(bottom * F.col("high") >= top * F.col("next_low"), F.col("next"))
    near = span.select("hub", F.col("block").alias("i"), F.explode(F.array_compact(F.array(F.when(F.col("k") > 1, F.col("block")), follows))).alias("j"))
    a = span.select("hub", F.col("block").alias("i"), F.col("high").alias("below"), "next").where("next is not null")
    b = span.select("hub", F.col("block").alias("j"), F.col("low").alias("above"))
    far = a.join(b, "hub").where((F.col("j") > F.col("next")) & (bottom * F.col("below") >= top * F.col("above")))
    return near, far.select("hub", "i", "j")


def deal(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hub, i, j, rep, is_i): members by block pair."""
    sides = pairs.select("hub", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("block"))
    return members.join(sides, ["hub", "block"]).select("hub", "i", "j", "rep", (F.col("block") == F.col("i")).alias("is_i"))


def apart(members: DataFrame, far: DataFrame, reached: DataFrame, top: int, bottom: int) -> DataFrame:
    """As deal(), for what the far pairs can still add: of hubs that have such pairs, members
    that are not yet in the component that most of their hub's members are in, against all."""
    own = members.join(far.select("hub").distinct(), "hub", "left_semi").join(reached, members["rep"] == reached["node"], "left")
    own = own.select("hub", "rep", "n", F.coalesce("component", "rep").alias("component"))
    counts = own.groupBy("hub", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("hub").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    told = own.join(main, "hub")
    others = in_blocks(told.where("component <> main").select("hub", "rep", "n"))
    rest = in_blocks(told.where("component = main").select("hub", "rep", "n")).withColumn("block", F.col("block") + MAIN)
    spans = lambda m: m.groupBy("hub", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("k"))
    a = spans(others).select("hub", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.col("k").alias("k_i"))
    b = spans(others).unionByName(spans(rest)).withColumnRenamed("block", "j")
    fits = (bottom * F.col("high_i") >= top * F.col("low")) & (bottom * F.col("high") >= top * F.col("low_i"))
    pairs = a.join(b, "hub").where(fits & ((F.col("i") < F.col("j")) | (F.col("i") == F.col("j")) & (F.col("k_i") > 1))).select("hub", "i", "j")
    return deal(others.unionByName(rest), pairs)


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Shared elements of each pair of sets, by scanning the inverted lists of the elements
    that occur in more than one set, some thousands at a time. b: None for pairs within a."""
    sets = a + (b or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, column = owner[keep], number[place[keep]]
    width = int(often.sum())
    out = np.zeros((len(a), len(b or a)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, width - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1.0
        out += m[: len(a)] @ (m[len(a) :] if b else m).T
    return out


def _links(ids: list[int], sides: list[bool], sets: list[np.ndarray], within: bool, top: int, bottom: int):
    """A forest of the pairs that link, as (a, b)."""
    n = len(ids)
    if n == 2:
        o = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if bottom * o >= top * (len(sets[0]) + len(sets[1]) - o):
            yield ids[0], ids[1]
        return
    first = list(range(n)) if within else [k for k in range(n) if sides[k]]
    second = first if within else [k for k in range(n) if not sides[k]]
    if not first or not second:
        return
    o = overlaps([sets[k] for k in first], None if within else [sets[k] for k in second])
    size = np.array([len(s) for s in sets], np.float64)
    hit = bottom * o.astype(np.float64) >= top * (size[first][:, None] + size[second][None, :] - o)
    if within:
        hit &= np.triu(np.ones(hit.shape, bool), 1)
    forest = Forest(n)
    for x, y in zip(*map(np.ndarray.tolist, np.nonzero(hit))):
        if forest.join(first[x], second[y]):
            yield ids[first[x]], ids[second[y]]


def runs(df: DataFrame, key: list[str], columns: list[str], schema: str, of_group) -> DataFrame:
    """Rows dealt by key and sorted, each run of equal keys handed to ``of_group(key, rows)``,
    which returns output rows. Only one run, of bounded size, is held at a time."""

    def find(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

        def batch_of(out):
            return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(names, types, zip(*out))})

        now, group = None, []
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if row[: len(key)] != now:
                        if len(group) > 1:
                            out += of_group(now, group)
                        now, group = row[: len(key)], []
                    group.append(row[len(key) :])
            if out:
                yield batch_of(out)
        if len(group) > 1 and (out := of_group(now, group)):
            yield batch_of(out)

    small_batches(df.sparkSession)
    return df.repartition(*key).sortWithinPartitions(*key).select(*key, *columns).mapInArrow(find, schema)


def possible(dealt: DataFrame, classes: DataFrame, most: int, top: int, bottom: int) -> DataFrame:
    """The rows of dealt whose set has a partner in its block pair that it may link with by
    their sketches, which are much smaller than texts and leave few pairs of unlike sets."""
    heavy = classes.where(F.col("n") > most).select("rep", "n", "sketch")

    def prune(key, group):
        reps, is_i, n, sketches = zip(*group)
        within = key[1] == key[2]
        n = np.array(n, np.int64)
        a = list(range(len(reps))) if within else [k for k, s in enumerate(is_i) if s]
        b = a if within else [k for k, s in enumerate(is_i) if not s]
        if not a or not b:
            return []
        shared = most_shared([sketches[k] for k in a], [sketches[k] for k in b], n[a], n[b])
        may = shared * (top + bottom) >= top * (n[a][:, None] + n[b][None, :])
        if within:
            np.fill_diagonal(may, False)
        rows = {a[k] for k in np.flatnonzero(may.any(axis=1))} | {b[k] for k in np.flatnonzero(may.any(axis=0))}
        return [(*key, reps[k], is_i[k]) for k in sorted(rows)]

    key = ["hub", "i", "j"]
    return runs(dealt.join(heavy, "rep"), key, ["rep", "is_i", "n", "sketch"], "hub long, i long, j long, rep long, is_i boolean", prune)


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, packed): compressed texts of the ids in wanted and, as a bitmap of hashed ids
    (1 MB) does the choosing here, a few others; a join follows."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    bits = wanted.select(slot("rep").alias("s")).groupBy(F.shiftright("s", 5).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("x")).toPandas()
    table = np.zeros(ID_BITS // 32, np.uint64)
    table[bits["at"].to_numpy(int)] = bits["x"].to_numpy(np.int64).view(np.uint64)
    given = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        table = given.value.tolist()

        def rows(c):
            for i, s, t in zip(*c):
                if t and table[s >> 5] >> (s & 31) & 1:
                    yield i, pack.compress(t.encode("utf-8", "surrogatepass"))

        return rows

    return map_rows(docs.where(F.col("doc_id").isNotNull()).select("doc_id", slot("doc_id").alias("s"), "text"), make, "rep long, packed binary")


def heavy_links(docs: DataFrame, dealt: DataFrame, words: int, top: int, bottom: int) -> DataFrame:
    """Links of the block pairs: texts meet their blocks, and each pair of blocks is one
    run of rows in a partition, of bounded size."""

    def find(key, group):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        sets = {}
        for rep, is_i, packed in group:
            if (rep, is_i, packed) not in sets:  # an id repeated with the same text is one set
                sets[rep, is_i, packed] = shingle_hashes(unpack.decompress(packed), words)
        ids, sides, _ = zip(*sets)
        return list(_links(list(ids), list(sides), list(sets.values()), key[1] == key[2], top, bottom))

    found = packed_texts(docs, dealt).join(dealt, "rep")
    return runs(found, ["hub", "i", "j"], ["rep", "is_i", "packed"], "a long, b long", find)


def jaccard_components(docs: DataFrame, words: int = WORDS, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach), class_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    level = spark.sparkContext.broadcast(rarity(docs, words))
    signed = cut(signatures(docs, level, words, top, bottom))
    real = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # classes are found by sums alone; only the representative's elements are looked up
    found = real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = cut(real.select("doc_id", "n", "s1", "s2").distinct().join(found, ["n", "s1", "s2"]))
    key = ["n", "s1", "s2"]
    # not written: a reader moves only the columns that it takes
    firsts = real.join(member.where("doc_id = rep").select("doc_id", *key), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    classes = firsts.withColumnRenamed("doc_id", "rep")
    histogram = {r["n"]: r["count"] for r in found.where(F.col("n") <= MOST_LIGHT * bottom // top).groupBy("n").count().collect()}
    most = boundary(histogram, top, bottom)
    lists = cut(merged_lists(classes, most, top, bottom))
    members = cut(in_blocks(lists))
    near, far = block_pairs(members, top, bottom)
    find = lambda dealt: heavy_links(docs, cut(possible(dealt, classes, most, top, bottom)), words, top, bottom)
    reached = components(light_links(classes, most, top, bottom).unionByName(find(deal(members, near))))
    if not (far := cut(far)).isEmpty():
        more = find(cut(apart(members, far, reached, top, bottom)))
        reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = member.join(reached, member["rep"] == reached["node"], "left").select("doc_id", "n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n", "s1", "s2").join(named, ["doc_id", *key], "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs whose id is their component's smallest; rows with a null id stay. An id
    repeated with one text is one row, with other texts one row of each text; if any of these
    texts links to a smaller id, none of them stays."""
    kept = jaccard_components(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    with_id = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return with_id.join(kept, with_id["doc_id"] == kept["__kept"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
