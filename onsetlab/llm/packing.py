"""Operator 10: best-fit packing with exact-complement hashing.

A document is its ids and one end id; only what is longer than a sequence is cut. How
pieces combine depends on their lengths alone, and there are at most ``room`` different
lengths however many documents there are. So the plan is made from the histogram of
lengths (``room`` rows at most) and says "so many sequences of this combination":

1. the longest length left begins a sequence; the gap it leaves is looked up in the index
   of single lengths, of sums of two and of sums of three, and a combination that fills the
   gap exactly is taken, as often as all its lengths are available;
2. where there is none, the gap takes the longest length that fits (best fit), and what is
   left of it is looked up again;
3. if best fit alone, longest first into the open sequences with the smallest gap that holds
   a piece, needs fewer sequences, its plan is taken instead.

Pieces then take the places of their length in order. The order is made in two steps
(count by length and bucket, then number within a bucket), so one very common length is
dealt over all its buckets, of which it has more the more pieces it has. Broadcast: the counts by
length and bucket, one for ``BUCKET_PIECES`` pieces besides ``room * BUCKETS`` at most; the plan is joined by range of places, at block level.

Defined cases: null and empty text is a piece of just the end id; repeated rows and ids
are packed each for itself; a very long text is cut into full sequences and a rest; a
null id is passed through; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.llm.bpe import Encoder, Splitter, byte_letters
from onsetlab.llm.common import cut, give_back, map_rows, texts, vocab_path, worker_cached

ROOM = 4096
END_ID = 1
#: One length's pieces are numbered in so many buckets at least, and in more beyond so many pieces a bucket.
BUCKETS, BUCKET_PIECES = 64, 200_000
#: Bytes of encoded chunks that a worker remembers in each of two generations.
MEMO_BYTES = 72_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@worker_cached("packing")
def library_words(path: str, memo_bytes: int) -> Encoder:
    """Encoder whose words are merged by the tokenizers library."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    letters = byte_letters()
    splitter = Splitter(path)
    give_back()  # the parsed file, before texts come on top of it

    def encode_word(word: str) -> array:
        if not word.isascii() or not word.isprintable():
            word = "".join([letters[b] for b in word.encode("utf-8")])
        return array("I", [t.id for t in model.tokenize(word)])

    return Encoder(splitter, False, memo_bytes, encode_word)


def pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    end = array("I", [end_id]).tobytes()

    def make():
        e = library_words(vocabulary, MEMO_BYTES)

        def rows(c):
            for i, t in zip(*c):
                ids = b"".join(e.parts(t)) + end
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    row = (i, k, at // 4, len(part) // 4, zlib.crc32(part))
                    yield (*row, array("I", part).tolist()) if with_ids else row

        return rows

    return map_rows(texts(docs), make, PIECES + ", ids array<int>" * with_ids)


class Sums:
    """Index of the available lengths by their sums: ``pairs[s]`` is the number of pairs of
    different available lengths, or of one length twice, that add up to s. A third length
    makes it the index of triples. It shrinks as lengths are used up."""

    def __init__(self, count: np.ndarray):
        self.there = count > 0
        self.pairs = np.zeros(2 * len(count), np.int32)
        for x in np.flatnonzero(self.there):
            self.pairs[x : 2 * x + 1] += self.there[: x + 1]

    def gone(self, x: int) -> None:
        """No piece of length x is left."""
        self.pairs[x : x + len(self.there)] -= self.there
        self.there[x] = False

    def pair(self, total: int, left: np.ndarray, most: int) -> tuple[int, ...]:
        """Two lengths of at most ``most`` with this sum, the most unequal; () for none."""
        if total < 2 or not self.pairs[total]:
            return ()
        high = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        for b in high[(left[high] > 0) & (left[total - high] > 0)]:
            if 2 * b != total or left[b] > 1:
                return int(b), total - int(b)
        return ()

    def filling(self, total: int, left: np.ndarray) -> tuple[int, ...]:
        """One, two or three lengths with this sum, as left has them; () for none."""
        if left[total] > 0:
            return (total,)
        if found := self.pair(total, left, total):
            return found
        third = np.arange(total - 2, 0, -1)
        for b in third[(left[third] > 0) & (self.pairs[total - third] > 0)]:
            left[b] -= 1
            found = self.pair(total - int(b), left, int(b))
            left[b] += 1
            if found:
                return (int(b), *found)
        return ()


def _exact_first(count: np.ndarray, room: int):
    """Combinations (lengths, times), begun by the longest piece left. A gap is filled exactly
    from the index of sums if it can be; else it takes the longest piece that fits, and what is
    left of it is looked up anew."""
    index = Sums(count)
    for a in range(room, 0, -1):
        while count[a]:
            lengths, gap = [a], room - a
            count[a] -= 1
            while gap:
                more = index.filling(gap, count)
                if not more:
                    fits = np.flatnonzero(count[: gap + 1])
                    if not len(fits):
                        break
                    more = (int(fits[-1]),)
                for x in more:
                    count[x] -= 1
                lengths += more
                gap -= sum(more)
            again = min(int(count[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                count[x] -= again
            yield tuple(lengths), again + 1
            for x in set(lengths):
                if not count[x] and index.there[x]:
                    index.gone(x)


def _best_fit(count: np.ndarray, room: int):
    """Longest first into the smallest gap that holds it; equal sequences go together."""
    open_by_gap: dict[int, list] = {}
    gaps = np.zeros(room + 1, bool)
    for x in range(room, 0, -1):
        left = int(count[x])
        while left:
            fits = np.flatnonzero(gaps[x:])
            if len(fits):
                gap = x + int(fits[0])
                lengths, n = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps[gap] = False
                used = min(n, left)
                if n > used:
                    open_by_gap[gap].append((lengths, n - used))
                    gaps[gap] = True
                left -= used
                new = [((*lengths, x), used)]
            else:
                each = room // x
                full, rest = divmod(left, each)
                gap, left = room, 0
                new = [((x,) * each, full)] * (full > 0) + [((x,) * rest, 1)] * (rest > 0)
            for lengths, n in new:
                gap = room - sum(lengths)
                open_by_gap.setdefault(gap, []).append((lengths, n))
                gaps[gap] = True
    for groups in open_by_gap.values():
        yield from groups


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences hold each: by exact complements, or
    by best fit alone where that takes fewer sequences."""
    count = np.zeros(room + 1, np.int64)
    for x, n in histogram.items():
        count[x] = n
    made = (list(way(count.copy(), room)) for way in (_exact_first, _best_fit))
    return min(made, key=lambda m: sum(n for _, n in m))


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, blocks of its places: the first rank, the first sequence and the
    offset there. Ranks within a block are in successive sequences."""
    by: dict[int, list] = {}
    first = 0
    seen: dict[int, int] = {}
    for lengths, n in made:
        at = 0
        for x in lengths:
            rank = seen.get(x, 0)
            by.setdefault(x, []).append((rank, first, at))
            seen[x] = rank + n
            at += x
        first += n
    return {x: tuple(np.array(v, np.int64).T) for x, v in by.items()}


def pack(cut_pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...)."""
    spark = cut_pieces.sparkSession
    # at most as many rows as a sequence has tokens; they stay with Spark for the join, as rows made from
    # a Python list would take further Python workers beside those that hold tables
    lengths = cut(cut_pieces.groupBy("length").count())
    histogram = {r["length"]: r["count"] for r in lengths.collect()}
    sizes = [(x, max(BUCKETS, -(-n // BUCKET_PIECES))) for x, n in sorted(histogram.items())]
    first_of = dict(zip((x for x, _ in sizes), np.cumsum([0] + [n for _, n in sizes]).tolist()))
    buckets = F.broadcast(lengths.selectExpr("length", f"cast(greatest({BUCKETS}, (`count` + {BUCKET_PIECES - 1}) div {BUCKET_PIECES}) as int) as buckets"))
    dealt = cut_pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")).cast("int"))
    counts = dealt.groupBy("length", "bucket").count().toPandas()
    flat = np.zeros(sum(n for _, n in sizes), np.int64)
    flat[[first_of[x] + b for x, b in zip(counts["length"], counts["bucket"])]] = counts["count"]
    before = flat.cumsum() - flat
    before = before - np.repeat(before[list(first_of.values())], [n for _, n in sizes]) if len(flat) else before
    given = spark.sparkContext.broadcast((places(plan(histogram, room)), before, first_of))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("rank", F.row_number().over(within) - 1)
    columns = cut_pieces.columns

    def make():
        by, before, first_of = given.value

        def rows(c):
            named = dict(zip([*columns, "bucket", "rank"], c))
            for k, (length, bucket, rank) in enumerate(zip(named["length"], named["bucket"], named["rank"])):
                ranks, sequences, offsets = by[length]
                rank += before[first_of[length] + bucket]
                b = int(np.searchsorted(ranks, rank, "right")) - 1
                yield (*(named[x][k] for x in columns), int(sequences[b] + rank - ranks[b]), int(offsets[b]))

        return rows

    kinds = dict(numbered.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return map_rows(numbered.select(*columns, "bucket", "rank"), make, schema)


def pack_documents(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack; the pieces are written to the shared folder once, as the
    histogram and the numbering both read them."""
    return pack(cut(pieces(docs, vocabulary, room, end_id)), room)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path("word_bpe_49k.json"))
