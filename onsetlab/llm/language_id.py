"""Operator 3: language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its words. The pieces' probabilities are the expected piece
counts over all segmentations (forward and backward) of all training words, from a start
that only knows the vocabulary's order, smoothed towards that start.

Work on Spark: counts of (language, word) over all training texts (combined in each task
before one shuffle), expected counts per word, one sum by (language, piece). A model has
languages x pieces numbers for at most ``MOST_LANGUAGES`` labels, so what is collected and
broadcast has a fixed bound; where more labels were learned there is a model for each block
of them, and texts are scored by one block after another, each reading them once more.

Words are runs of letters in lower case; longer ones are cut into parts of ``CUT``
characters. Learned from: text and non-null lang of documents whose crc32(doc_id as
text) mod 4 is not 2 (a null id is never learned from).

Defined cases: text that is null or without letters is ``und`` with score 0, and so is
all text when nothing could be learned; equal scores go to the language first in the
alphabet; repeated rows give a row each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.llm.common import cut, map_rows, text_udf, vocab_path, worker_cached, worker_tables

UNDETERMINED = "und"
MOST_LANGUAGES = 200
CUT = 24
LONGEST = 12
#: Words that a worker remembers, and bytes of their log probabilities at most.
MEMO_ROWS, MEMO_BYTES = 300_000, 64_000_000
ROUNDS = 1
#: Words (short rows) that are handed over at a time.
WORD_ROWS = 10_000
#: Share of the start in each language's probabilities, and of any character not in the vocabulary.
SMOOTHING = 0.02
UNSEEN = 1e-8
#: Least mean log ratio of a word of a kept text, its language against the start.
FAMILIAR = 0.0
#: Multipliers of the sums that find pieces, and bits of a slot's number.
BASE, SPREAD, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03, 20
POWERS = np.cumprod(np.array([1] + [BASE] * LONGEST, np.uint64), dtype=np.uint64)
#: Letters, and numbers that are no decimal digits, such as ½; words() leaves the latter out.
WORD = re.compile(r"[^\W\d_]+")
#: What scoring finds: the language, its log probability, by how much the logarithm of the sum
#: over languages exceeds it, and its mean log ratio of a word to the start.
FOUND = "struct<lang:string,best:double,over:double,more:double>"
Model = tuple[list[str], np.ndarray]


def code_points(strings: list[str], width: int) -> np.ndarray:
    """Code points by (string, place), 0 after a string's end."""
    return np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial sums (modulo 2**64) of each string's prefixes, the empty one's first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + codes[:, k]
    return out


def slots_of(sums: np.ndarray, times: np.uint64) -> np.ndarray:
    return (sums * times >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class PieceIndex(dict):
    """Ids (from 0, without gaps) by piece, with tables that find many pieces at a time."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        names = sorted(ids, key=ids.__getitem__)
        self.codes = code_points(names, LONGEST)
        self.sizes = np.array([len(p) for p in names], np.int32)
        self.sums = prefix_sums(self.codes)[np.arange(len(names)), self.sizes]
        #: Ids by slot of a piece's sum, -1 where none; pieces that share a slot are in further tables.
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(names))
        while len(left):
            times = np.uint64(SPREAD + 2 * len(self.tables))
            table = np.full(1 << SLOT_BITS, -1, np.int32)
            slots = slots_of(self.sums[left], times)
            table[slots] = left
            self.tables.append((times, table))
            left = left[table[slots] != left]

    def having(self, sums: np.ndarray) -> np.ndarray:
        """The piece that has each sum, -1 for none."""
        out = np.full(sums.shape, -1, np.int32)
        flat, at = sums.reshape(-1), None
        for times, table in self.tables:
            k = table[slots_of(flat, times)]
            taken = np.flatnonzero(k >= 0)
            k, flat = k[taken], flat[taken]
            at = taken if at is None else at[taken]
            same = self.sums[k] == flat
            out.reshape(-1)[at[same]] = k[same]
            # what a further table has shares a slot of each table before it
            flat, at = flat[~same], at[~same]
        return out


class Pieces:
    """The vocabulary's pieces of letters, by string; a word begins with a space sign."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
        keep = [p for p in names if len(p) <= LONGEST and (p == "▁" or p.lstrip("▁").isalpha()) and p.count("▁") <= 1]
        self.index = PieceIndex({p: k for k, p in enumerate(keep)})
        #: Zipf's law over the vocabulary's order.
        start = 1.0 / (np.arange(len(keep)) + 10.0)
        self.start = start / start.sum() * (1 - UNSEEN)


@worker_cached("language ID")
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def words(text: str) -> list[str]:
    """Stretches of letters, in lower case."""
    found = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ("".join([c if c.isalpha() else " " for c in x]).split() if not x.isalpha() else (x,))]


def parts(word: str) -> list[str]:
    word = "▁" + word
    return [word[k : k + CUT] for k in range(0, len(word), CUT)]


def by_length(batch: list[str]) -> tuple[list[int], list[str]]:
    """All parts of the words, short ones first, each with its word's place: words of about
    one length take no steps for longer ones."""
    owner, flat = list(range(len(batch))), ["▁" + w for w in batch]
    for k in range(len(flat)):
        if len(flat[k]) > CUT:
            flat[k], *more = parts(batch[k])
            owner += [k] * len(more)
            flat += more
    order = np.argsort(np.fromiter(map(len, flat), np.int64, len(flat)), kind="stable").tolist()
    return [owner[k] for k in order], [flat[k] for k in order]


def lattice(batch: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids by (word, end, length): those of a missing piece are the number of pieces, a
    single unknown character's is one more; and the words' lengths.

    Substrings are sought by their sums, all words at a time, and found pieces are then
    compared character by character."""
    pieces = index if isinstance(index, PieceIndex) else PieceIndex(index)
    none, unseen = len(index), len(index) + 1
    sizes = np.array([len(w) for w in batch])
    most = int(sizes.max())
    codes = code_points(batch, most)
    sums = prefix_sums(codes)
    found = np.full((len(batch), most + 1, LONGEST + 1), none, np.int32)
    for k in range(1, min(LONGEST, most) + 1):
        ids = pieces.having(sums[:, k:] - sums[:, :-k] * POWERS[k])
        row, begin = np.nonzero(ids >= 0)
        ids = ids[row, begin]
        same = pieces.sizes[ids] == k
        for at in range(k):
            same &= pieces.codes[ids, at] == codes[row, begin + at]
        if k == 1:
            found[:, 1:, 1] = np.where(codes > 0, unseen, none)
        found[row[same], begin[same] + k, k] = ids[same]
    return found, sizes


def forward(found: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]: the summed probability of all segmentations up to there."""
    n, width, _ = found.shape
    alpha = np.zeros((width, n, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, width):
        for k in range(1, min(end, LONGEST) + 1):
            at = found[:, end, k]
            if (at < len(p) - 2).any() or k == 1:
                alpha[end] += alpha[end - k] * p[at]
    return alpha


def _padded(p: np.ndarray) -> np.ndarray:
    """Rows for a missing piece (0) and an unknown character."""
    return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNSEEN)])


def word_scores(batch: list[str], index: dict[str, int], padded: np.ndarray) -> np.ndarray:
    """log probability of each word in each language."""
    owner, flat = by_length(batch)
    out = np.zeros((len(batch), padded.shape[1]))
    for at in range(0, len(flat), 4096):
        some = flat[at : at + 4096]
        found, sizes = lattice(some, index)
        alpha = forward(found, padded)
        np.add.at(out, owner[at : at + 4096], np.log(alpha[sizes, np.arange(len(some))]))
    return out


def expected_counts(batch: list[str], times: np.ndarray, index: dict[str, int], padded: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of the words, for one language's
    probabilities (padded has one column)."""
    total = np.zeros(len(padded))
    owner, flat = by_length(batch)
    p = padded[:, 0]
    for at in range(0, len(flat), 4096):
        some = flat[at : at + 4096]
        weight = times[owner[at : at + 4096]].astype(float)
        found, sizes = lattice(some, index)
        n, width, _ = found.shape
        alpha = forward(found, padded)[:, :, 0]
        beta = np.zeros((width + LONGEST + 1, n))
        beta[sizes, np.arange(n)] = 1.0
        whole = alpha[sizes, np.arange(n)]
        seen, times_seen = [], []
        for begin in range(width - 1, -1, -1):
            for k in range(1, min(LONGEST, width - 1 - begin) + 1):
                ids = found[:, begin + k, k]
                share = p[ids] * beta[begin + k]
                beta[begin] += share
                hit = np.flatnonzero(share > 0)
                if len(hit):
                    seen.append(ids[hit])
                    times_seen.append((alpha[begin] * share / whole * weight)[hit])
        total += np.bincount(np.concatenate(seen), np.concatenate(times_seen), len(total))
    return total


def _training(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return docs.where(F.col("doc_id").isNotNull() & ~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def fit(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, most: int = MOST_LANGUAGES) -> Iterator[Model]:
    """Models of at most ``most`` languages each, in the order of the languages: their names
    and probabilities by (piece, language), from all training rows. One without languages
    where nothing could be learned."""
    words_of = _word_counts(_training(docs))
    if rounds > 1:
        words_of = cut(words_of)
    first = _expected(words_of, ([], np.zeros((0, 0))), vocabulary)
    langs = sorted(r["lang"] for r in first.select("lang").distinct().collect())
    for at in range(0, max(1, len(langs)), most):
        some = langs[at : at + most]
        model = _probabilities(first, some, vocabulary)
        for _ in range(rounds - 1):
            model = _probabilities(_expected(words_of.where(F.col("lang").isin(some)), model, vocabulary), some, vocabulary)
        yield model


def _word_counts(training: DataFrame) -> DataFrame:
    def make():
        def rows(c):
            by: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*c):
                by[lang].update(words(text))
            for lang, counts in by.items():
                for w, n in counts.items():
                    yield lang, w, n

        return rows

    return map_rows(training, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counted: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """(lang, piece, n): expected counts of pieces by a model, or the start for languages not in it."""
    given = counted.sparkSession.sparkContext.broadcast(model)

    def make():
        known, given_p = given.value
        pieces = pieces_of(vocabulary)

        def rows(c):
            by: dict[str, tuple[list, list]] = {}
            for lang, w, n in zip(*c):
                ws, ns = by.setdefault(lang, ([], []))
                ws.append(w)
                ns.append(n)
            for lang, (ws, ns) in by.items():
                p = given_p[:, known.index(lang)] if lang in known else pieces.start
                total = expected_counts(ws, np.array(ns), pieces.index, _padded(p[:, None]))[: len(pieces.index)]
                yield lang, -1, 0.0  # a language whose words have no known piece
                for k in np.flatnonzero(total):
                    yield lang, int(k), float(total[k])

        return rows

    return cut(map_rows(counted, make, "lang string, piece int, n double", WORD_ROWS).groupBy("lang", "piece").agg(F.sum("n").alias("n")))


def _probabilities(sums: DataFrame, langs: list[str], vocabulary: str) -> Model:
    start = pieces_of(vocabulary).start
    p = np.zeros((len(start), len(langs)))
    if langs:
        found = sums.where((F.col("piece") >= 0) & F.col("lang").isin(langs)).toPandas()
        place = {lang: k for k, lang in enumerate(langs)}
        p[found["piece"].to_numpy(int), [place[x] for x in found["lang"]]] = found["n"]
        p /= np.maximum(p.sum(axis=0), 1e-300)
    return langs, (1 - SMOOTHING) * p + SMOOTHING * start[:, None]


class Scorer:
    """Scores texts; log probabilities of words are remembered in a bounded table. With
    ``start`` a total has one more column, that of the start, which knows the vocabulary's
    order only."""

    def __init__(self, langs: list[str], p: np.ndarray, vocabulary: str, start: bool = False):
        pieces = pieces_of(vocabulary)
        width = len(langs) + start
        self.langs, self.index, self.memo_rows = langs, pieces.index, min(MEMO_ROWS, MEMO_BYTES // (8 * max(1, width)))
        self.padded = _padded(np.column_stack([p, pieces.start]) if start else p) if langs else None
        self.row: dict[str, int] = {}
        self.table = np.zeros((self.memo_rows, width))

    def _learn(self, new: list[str]) -> None:
        if len(self.row) + len(new) > self.memo_rows:
            self.row.clear()
        scores = word_scores(new, self.index, self.padded)
        at = len(self.row)
        if len(new) <= self.memo_rows:
            self.table[at : at + len(new)] = scores
            self.row.update(zip(new, range(at, at + len(new))))

    def totals(self, some: list[str | None]):
        """Of each text its number of words and its log probabilities, None without words."""
        split = [words(t) if t else [] for t in some]
        if not self.langs:
            yield from ((len(ws), None) for ws in split)
            return
        row = self.row
        new = list(set().union(*split).difference(row))
        for at in range(0, len(new), self.memo_rows // 4):
            self._learn(new[at : at + self.memo_rows // 4])
        for ws in split:
            if not ws:
                yield 0, None
                continue
            try:
                total = self.table[np.fromiter(map(row.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            except KeyError:  # forgotten meanwhile
                counts = Counter(ws)
                total = np.zeros(self.table.shape[1])
                some_words = list(counts)
                for at in range(0, len(some_words), 20_000):
                    part = some_words[at : at + 20_000]
                    total += np.array([counts[w] for w in part]) @ word_scores(part, self.index, self.padded)
            yield len(ws), total

    def judge(self, some: list[str | None]) -> list[tuple[str, float, float, float] | None]:
        """FOUND of each text (its last field 0 without the start), None without words."""
        out = []
        for n, total in self.totals(some):
            if total is None:
                out.append(None)
                continue
            own, start = total[: len(self.langs)], total[len(self.langs) :]
            best = int(np.argmax(own))
            over = float(np.log(np.exp(own - own[best]).sum()))
            out.append((self.langs[best], float(own[best]), over, float(own[best] - start[0]) / n if len(start) else 0.0))
        return out


def _scorer(key: str, model: Model, vocabulary: str, start: bool) -> Scorer:
    kept = worker_tables("language ID")
    if kept.get("scorer of") != key:
        kept["scorer of"], kept["scorer"] = key, Scorer(*model, vocabulary, start)
    return kept["scorer"]


def with_found(df: DataFrame, text: str, models: Iterable[Model], vocabulary: str, start: bool = False) -> DataFrame:
    """df, which has no column named found or now, with a column ``found`` for its field ``text``,
    null for texts without words. No shuffle. Of several models the better is kept, the earlier one of equals."""
    for k, model in enumerate(models):
        given, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

        def make(given=given, key=key):
            return _scorer(key, given.value, vocabulary, start).judge

        now = text_udf(make, FOUND)(F.col(text))
        if k == 0:
            df = df.withColumn("found", now)
            continue
        # written in between, so that a Python worker holds one model at a time
        old = [F.col(f"`{c}`") for c in df.columns if c != "found"]
        both = cut(df).withColumn("now", now)
        pick = F.when(F.col("now.best") > F.col("found.best"), _beside("now", "found")).otherwise(_beside("found", "now"))
        df = both.select(*old, F.when(F.col("found").isNotNull(), pick).alias("found"))
    return df


def _beside(better: str, other: str) -> Column:
    """``better`` of two findings, with the sum over the languages of both."""
    a, b = (lambda x: F.col(f"{better}.{x}")), (lambda x: F.col(f"{other}.{x}"))
    over = F.log(F.exp(a("over")) + F.exp(b("over") + b("best") - a("best")))
    return F.struct(a("lang").alias("lang"), a("best").alias("best"), over.alias("over"), a("more").alias("more"))


def _posterior() -> Column:
    return F.coalesce(F.exp(-F.col("found.over")), F.lit(0.0))


def language_id(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, most: int = MOST_LANGUAGES) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    found = with_found(rows, "text", fit(docs, vocabulary, rounds, most), vocabulary)
    return found.select("doc_id", "held_out", F.coalesce("found.lang", F.lit(UNDETERMINED)).alias("lang_pred"), _posterior().alias("score"))


def language_filter(docs: DataFrame, vocabulary: str, least: float = 0.5, familiar: float = FAMILIAR, most: int = MOST_LANGUAGES) -> DataFrame:
    """Rows of docs whose language is determined with a posterior of at least ``least`` and
    whose words are more probable in it than by the start, by ``familiar`` in the mean of
    their logarithms. A posterior alone is near 1 for any text of some words, in whatever
    language; a text in none that was learned, or of random letters, fails the second.
    Columns stay as they are, but a null lang becomes the one found."""
    # the row travels as one struct, so no column of docs can clash with what is found
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = with_found(docs.select(row), "row.text", fit(docs, vocabulary, most=most), vocabulary, start=True)
    kept = found.where(F.col("found").isNotNull() & (_posterior() >= least) & (F.col("found.more") >= familiar))
    column = lambda c: F.col("row").getField(c)
    return kept.select(*((F.coalesce(column(c), "found.lang") if c == "lang" else column(c)).alias(c) for c in docs.columns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path("piece_bpe_32k.model"))
