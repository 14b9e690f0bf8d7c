"""Operator 12: runs of repeating words, found by string synchronising sets.

At each dyadic scale t a set S of positions is chosen by hashes alone: i is in S where the
least hash of the t + 1 stretches of t words that begin at i .. i + t is the first's or the
last's. So whether i is in S depends on the 2t words from i on (its *context*) and nothing else, and two
equal contexts are chosen alike. Stretches with a period of at most t/4 are left out (else S
would be dense there). They are known: they lie in runs that smaller scales have supplied, and
periods below 4 are found before all scales by comparing words 1, 2 and 3 apart.

A run of period t <= p < 2t and length of at least 4p has a position of S among its first t words: else
every stretch of t words that begins among its first 2t would have a period of at most t/4, and
so would the run. That position's context appears again p words later within the run, and not
between, as the repeated word is primitive and the context longer than p. So successive
equal contexts of S, at a distance of t .. 2t-1, propose every period; each proposal is
verified by comparing words to both sides as far as they agree.

Documents are put together into long arrays with a separator of its own after each, so one
numpy pass serves many short texts and no run crosses texts. No shuffle.

Defined cases: null and empty texts have no words and no runs; repeated rows give a row each; a
null doc_id is passed through (and its text is never made periodic); a very long text is an array of its own, with memory
in proportion to its words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm.common import map_rows, texts

#: Runs are at least so long, and hold their period so often.
LEAST, TIMES = 6, 4
#: Periods found by direct comparison.
DIRECT = 3
#: Texts are put together up to so many words.
BATCH_WORDS = 1 << 17
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` successive values, size being a power of two."""
    step = 1
    while step < size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def _stretches(same: np.ndarray) -> np.ndarray:
    """(begin, end) of the longest stretches of True."""
    edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    return edge.reshape(-1, 2)


def _agree(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on, in direction ``step``, are the same."""
    most = len(codes) - max(a, b) if step > 0 else min(a, b) + 1
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = codes[a + done : a + done + n] != codes[b + done : b + done + n]
        else:
            differ = codes[a - done - n + 1 : a - done + 1][::-1] != codes[b - done - n + 1 : b - done + 1][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += n
        size *= 4
    return done


def sync_set(ids: np.ndarray, t: int, known: np.ndarray) -> np.ndarray:
    """Positions of the scale t by ids of all stretches of t words; ``known``: begins of stretches with a small period."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = _mix(ids)
    np.minimum(h, most - np.uint64(1), out=h)
    h[known] = most
    least = _window_min(h, t)
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero((least != most) & ((least == h[:n]) | (least == h[t : t + n])))


def runs(codes: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All (start, end, period) with a length of TIMES periods at least. ``longest``: no
    run is longer than this."""
    codes = codes.astype(np.uint64)
    small = [(int(b), int(e) + p, p) for p in range(1, DIRECT + 1) for b, e in _stretches(codes[:-p] == codes[p:]) if e - b >= (TIMES - 1) * p and not _has_shorter(codes, b, p)]
    longest = len(codes) if longest is None else longest
    ids, t = _mix(codes + np.uint64(1)), 1
    odd = np.uint64(0x9E3779B97F4A7C15)
    while TIMES * t <= longest and 2 * t <= len(codes):
        if t > DIRECT:
            known = np.zeros(len(ids), bool)
            for b, e, p in small:
                if TIMES * p <= t <= e - b:
                    known[b : e - t + 1] = True
            at = sync_set(ids, t, known)
            context = ids[at] + _mix(ids[at + t]) * odd
            order = np.lexsort((at, context))
            near, key = at[order], context[order]
            gap = near[1:] - near[:-1]
            pick = np.flatnonzero((key[1:] == key[:-1]) & (gap >= t) & (gap < 2 * t))
            reach: dict[int, int] = {}
            for s, p in sorted(zip(near[pick].tolist(), gap[pick].tolist())):
                if s < reach.get(p, 0):
                    continue
                right = s + p + _agree(codes, s, s + p, 1)
                left = s - _agree(codes, s - 1, s + p - 1, -1) if s else 0
                reach[p] = right - p
                if right - left >= TIMES * p and not _has_shorter(codes, left, p):
                    small.append((left, right, p))
        if 4 * t > len(codes):
            break
        ids = ids[: len(ids) - t] + _mix(ids[t:]) * odd
        t *= 2
    return sorted((b, e, p) for b, e, p in small if e - b >= max(LEAST, TIMES * p))


def _has_shorter(codes: np.ndarray, at: int, p: int) -> bool:
    """Whether p words from ``at`` on are themselves a repeated shorter stretch."""
    word = codes[at : at + p]
    return any(p % q == 0 and (word[q:] == word[:-q]).all() for d in range(2, int(p**0.5) + 1) if p % d == 0 for q in (d, p // d)) or (p > 1 and bool((word == word[0]).all()))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's stretches that repeat, by a digest of the id."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = words[a : a + p]
    return words[:a] + (own * (-(-(n - a) // p)))[: n - a]


def grouped(docs: Iterator[tuple], most: int = BATCH_WORDS) -> Iterator[list[tuple]]:
    """Rows (…, words) in groups of at most ``most`` words, a longer one alone."""
    group, size = [], 0
    for row in docs:
        if group and size + len(row[-1]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[-1])
    if group:
        yield group


def runs_of_each(all_words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of some texts, worked out together."""
    number = count(len(all_words))
    seen: dict[bytes, int] = {}
    codes = np.empty(sum(map(len, all_words)) + len(all_words), np.int64)
    begins, at = [], 0
    for k, words in enumerate(all_words):
        begins.append(at)
        codes[at : at + len(words)] = [c if (c := seen.get(w)) is not None else seen.setdefault(w, next(number)) for w in words]
        codes[at + len(words)] = k  # a code that no word has
        at += len(words) + 1
    out: list[list] = [[] for _ in all_words]
    if not at:
        return out
    found = runs(codes, max(map(len, all_words)))
    owner = np.searchsorted(begins, [b for b, _, _ in found], "right") - 1
    for (b, e, p), k in zip(found, owner):
        out[k].append((b - begins[k], e - b, p))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: in each run, all after the first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return [words[i] for i in kept]


def _longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; of equal ones the first, then the shortest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """Per row: doc_id, runs as arrays of (start, length, period) and the collapsed text.
    ``change(words, doc_id)`` may alter the words first."""

    def rows(words, found):
        return [{"start": b, "length": n, "period": p} for b, n, p in found], b" ".join(collapsed(words, found)).decode("utf-8")

    return _mapped(docs, change, rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def run_digests(docs: DataFrame, change=None) -> DataFrame:
    """Per row: number of runs, the longest by exponent, digests of all runs and of the collapsed text."""

    def rows(words, found):
        best = _longest(found)
        own = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        listed = "".join(f"{b},{n},{p}\n" for b, n, p in found)
        return len(found), *own, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()

    return _mapped(docs, change, rows, SCHEMA)


def _mapped(docs: DataFrame, change, rows, schema: str) -> DataFrame:
    def make():
        def of(c):
            # bytes are split at ASCII white space alone
            split = ((i, change(w, i) if change else w) for i, t in zip(*c) for w in [t.encode("utf-8").split()])
            for group in grouped(split):
                for (i, words), found in zip(group, runs_of_each([w for _, w in group])):
                    yield i, *rows(words, found)

        return of

    return map_rows(texts(docs), make, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
