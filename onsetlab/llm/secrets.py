"""Operator 4: secret scans with password guess costs.

Three base patterns give spans whatever their cost. Besides, values in a credential's
context ("password is ...", "pwd: ...", "api key = ...", and with a sign of assignment any
identifier that has such a word in it, as DB_PASSWORD=...) are priced by a dynamic program:
the cheapest way to cut the value into dictionary words, dates, repeats, keyboard walks
and brute-force spans, where a segment costs the logarithm of the guesses it takes and a
value of n segments also the orders they can be tried in. Values that would take at least
``LEAST_BITS`` are added as spans of kind ``guess``. A base span stays in any case.

The dictionary is that of the documents: words of 3 to ``LOOK_BACK`` letters that at least
``LEAST_DOCS`` documents have outside a credential's value, ranked by how many have them,
the ``MOST_WORDS`` commonest (words of one count all or none), beside the fixed ``WORDS``. A
word costs log2 of its rank. They are counted in one job with a shuffle of (word, documents)
sums, and broadcast. So an ordinary word that fewer documents have is priced as any string
of letters.

Defined cases: null and empty text have no spans; repeated rows give a row each; a null
id is passed through; an empty table gives no rows; further columns are ignored. Values
are priced whole, up to any length: the program looks back at most ``LOOK_BACK``
characters for a segment, and repeats and walks that go on are extended step by step.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.llm.common import SLICE_ROWS, cut, map_rows, small_batches, text_udf, texts, worker_tables

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
LEAST_BITS = 30.0
LOOK_BACK = 24
MEMO_ROWS = 100_000
#: Documents that a word of the dictionary is in, and words that are broadcast (at most 24
#: letters each, so a few MB).
LEAST_DOCS, MOST_WORDS = 3, 100_000
#: Words that a task counts before it hands them on.
COUNTED = 200_000

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run fails and touches no other match
KINDS = ("assign", "access", "hex", "guess")

#: Contexts of a credential beyond the base pattern's.
CONTEXT = re.compile(r"""\b(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_ -]?key|access[_ -]?key)\b["']?\s*(?:is|was|are|:=|=>|=|:)\s*["']?([^\s"'<>,;]{8,})""", re.I | re.A)
#: An identifier and a sign of assignment; a context if one of the words is in the identifier.
ASSIGNED = re.compile(r"""(?<![\w.-])([\w.-]++)["']?\s*+(?::=|=>|=|:)\s*+["']?""", re.A)
NAMED = re.compile(r"password|passwd|passphrase|passcode|pwd|secret|token|credential|api[_.-]?key|access[_.-]?key", re.I | re.A)
VALUE = re.compile(r"""[^\s"'<>,;]{8,}""")
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")

# Very common passwords and words of credentials, the commonest first.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine "
    "football shadow iloveyou secret token access server system default changeme example test "
    "user root guest public private account database backup service manager office company "
    "summer winter spring autumn january february march april june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday please hello world "
    "apple orange banana cookie summer pass word love super star blue green black white silver gold"
).split()
#: Bits of a word by its rank.
RANK = {w: math.log2(k + 2) for k, w in reversed(list(enumerate(WORDS)))}
WORD = re.compile(r"(?<!\w)[^\W\d_]++(?:[-'’][^\W\d_]++)*+(?!\w)")
JOINS = re.compile("[-'’]")
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("0134578@$!", "oieastbasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-_.]?(?:0[1-9]|1[0-2])(?:[-_.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-_.]?(?:0[1-9]|1[0-2])[-_.]?(?:19|20)\d\d")
DATE_BITS = math.log2(365 * 120)


def _neighbours() -> set[tuple[str, str]]:
    out = set()
    for r, row in enumerate(ROWS):
        for k, a in enumerate(row):
            near = [(r, k + 1), (r + 1, k - 1), (r + 1, k)]
            for r2, k2 in near:
                if r2 < len(ROWS) and 0 <= k2 < len(ROWS[r2]):
                    out |= {(a, ROWS[r2][k2]), (ROWS[r2][k2], a)}
    return out


NEXT_KEYS = _neighbours()


def _brute_bits(c: str) -> float:
    """Bits of one character by the class it is drawn from."""
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26) if c.isascii() else math.log2(100)
    return math.log2(33)


def segments(value: str, rank: dict[str, float] = RANK):
    """Cheap segments (begin, end, bits) of a value: words, dates, repeats, walks."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for begin in range(n):
        for end in range(begin + 3, min(n, begin + LOOK_BACK) + 1):
            for form, more in ((low, 0.0), (plain, 1.0)):
                bits = rank.get(form[begin:end])
                if bits is not None:
                    capitals = sum(c.isupper() for c in value[begin:end])
                    yield begin, end, bits + more + (1.0 if capitals else 0.0) + (1.0 if 1 < capitals < end - begin else 0.0)
                    break
        m = DATE.match(value, begin)
        if m:
            yield begin, m.end(), DATE_BITS + (1.0 if re.search(r"\D", m[0]) else 0.0)
    begin = 0
    while begin < n - 1:  # a walk over neighbouring keys
        end = begin + 1
        while end < n and (low[end - 1], low[end]) in NEXT_KEYS:
            end += 1
        if end - begin >= 3:
            yield begin, end, math.log2(47) + 1.6 * math.log2(end - begin) + 2.0
        begin = max(begin + 1, end - 1)
    for size in range(1, 9):  # a block and its repeats
        begin = 0
        while begin + 2 * size <= n:
            end = begin + size
            while value[end : end + size] == value[begin : begin + size]:
                end += size
            if end - begin >= max(3, 2 * size):
                bits = sum(map(_brute_bits, value[begin : begin + size]))
                yield begin, end, bits + math.log2((end - begin) // size)
                begin = end - size + 1
            else:
                begin += 1


def guess_bits(value: str, rank: dict[str, float] = RANK) -> float:
    """Logarithm (base 2) of the guesses of the cheapest segmentation."""
    n = len(value)
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for begin, end, bits in segments(value, rank):
        by_end[end].append((begin, bits))
    # cost by (end, segments so far), the last counted together beyond a few; a brute-force
    # span that goes on is no new segment
    most = 8
    other = [[math.inf] * (most + 1) for _ in range(n + 1)]
    brute = [[math.inf] * (most + 1) for _ in range(n + 1)]
    other[0][0] = 0.0
    for end in range(1, n + 1):
        bits = _brute_bits(value[end - 1])
        for k in range(most + 1):
            best = brute[end - 1][k] + bits
            if k:
                best = min(best, other[end - 1][k - 1] + bits)
            if k == most:
                best = min(best, other[end - 1][k] + bits)
            brute[end][k] = best
        for begin, bits in by_end[end]:
            for k in range(most + 1):
                at = min(k + 1, most)
                other[end][at] = min(other[end][at], min(other[begin][k], brute[begin][k]) + bits)
    return min(min(other[n][k], brute[n][k]) + math.lgamma(k + 1) / math.log(2) for k in range(most + 1))


def values(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the values in a credential's context, in order; of values with the same
    end only the longest."""
    found: dict[int, int] = {}
    for m in CONTEXT.finditer(text):
        found[m.end(1)] = m.start(1)
    for m in ASSIGNED.finditer(text):
        if NAMED.search(m[1]) and (v := VALUE.match(text, m.end())):
            found[v.end()] = min(v.start(), found.get(v.end(), v.start()))
    return sorted((a, b) for b, a in found.items())


def words(text: str) -> set[str]:
    """Words of a text and parts of joined ones, in lower case, without credentials' values."""
    low = text.lower()
    if any(h in low for h in HINTS):
        out, at = [], 0
        for a, b in sorted([*values(text), *(m.span(2) for m in ASSIGN.finditer(text))]):
            out.append(text[at : max(at, a)])
            at = max(at, b)
        low = " ".join([*out, text[at:]]).lower()
    found = set(WORD.findall(low))
    found |= {part for w in found for part in JOINS.split(w)}
    return {w for w in found if 3 <= len(w) <= LOOK_BACK}


def word_bits(docs: DataFrame, least_docs: int = LEAST_DOCS, most_words: int = MOST_WORDS) -> dict[str, float]:
    """Bits of the dictionary's words: the fixed ones and those of the documents, by rank."""

    def run(batches):
        worker_tables("secret scans")
        counts: Counter[str] = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    counts.update(words(text))
                    if len(counts) >= COUNTED:
                        yield told()
                        counts.clear()
        if counts:
            yield told()

    small_batches(docs.sparkSession)
    each = docs.select("text").where("text is not null").mapInArrow(run, "word string, n long")
    known = cut(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs))
    # the least count at which no more than most_words are left; there are few different counts
    least, total = least_docs, 0
    for n, k in sorted(((r["n"], r["count"]) for r in known.groupBy("n").count().collect()), reverse=True):
        total += k
        if total > most_words:
            least = n + 1
            break
    ranked = sorted((-r["n"], r["word"]) for r in known.where(F.col("n") >= least).collect())  # at most most_words rows
    bits = {w: math.log2(k + 2) for k, (_, w) in enumerate(ranked)}
    return bits | {w: min(b, bits.get(w, b)) for w, b in RANK.items()}


class Scanner:
    def __init__(self, least_bits: float, memo_rows: int = MEMO_ROWS, rank: dict[str, float] = RANK):
        self.least_bits, self.memo_rows, self.rank = least_bits, memo_rows, rank
        self.bits: dict[str, float] = {}

    def price(self, value: str) -> float:
        found = self.bits.get(value)
        if found is None:
            found = guess_bits(value, self.rank)
            if len(value) <= 256:
                if len(self.bits) >= self.memo_rows:
                    self.bits.clear()
                self.bits[value] = found
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, kind, end) of every span, in order of begin and kind."""
        out = []
        low = text.lower()
        if any(h in low for h in HINTS):
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= ASSIGN_LEAST:
                    out.append((m.start(), 0, m.end()))
            out += [(a, 3, b) for a, b in values(text) if self.price(text[a:b]) >= self.least_bits]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        out.sort()
        return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """Per row: doc_id, counts by kind, digest of the base spans and all spans. The words are counted before."""
    rank = docs.sparkSession.sparkContext.broadcast(word_bits(docs))

    def make():
        s = Scanner(least_bits, rank=rank.value)

        def rows(c):
            for i, t in zip(*c):
                found = s.spans(t)
                n = [sum(k == x for _, k, _ in found) for x in range(4)]
                base = _joined([x for x in found if x[1] < 3])
                yield i, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), _joined(found), n[3]

        return rows

    return map_rows(texts(docs), make, SCHEMA)


def redact(docs: DataFrame, least_bits: float = LEAST_BITS, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, each span in the text replaced by ``mark`` (overlapping
    spans by one); n_chars, where there is one, is the new length. Null text stays null."""
    rank = docs.sparkSession.sparkContext.broadcast(word_bits(docs))

    def make():
        worker_tables("secret scans")
        s = Scanner(least_bits, rank=rank.value)

        def one(t):
            if t is None or not (found := s.spans(t)):
                return t
            out, at, until = [], 0, -1
            for a, _, b in found:
                if a >= until:
                    out += [t[at:a], mark]
                    until = at = b
                elif b > until:
                    until = at = b
            return "".join([*out, t[at:]])

        return lambda texts: list(map(one, texts))

    cleaned = text_udf(make, "string")
    done = docs.withColumn("text", cleaned(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return done


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
