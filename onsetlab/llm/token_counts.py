"""Operator 1: token counts with a whole-token shortcut.

A pre-token is a run of spaces with the word that follows it; no vocabulary string
holds a space after another character, so no merge ever crosses a pre-token's edge.
The same holds for every character that no longer string of the vocabulary contains,
such as a line break. Offline (once, on the driver) each vocabulary string is merged
on its own: those that end as one token are the *whole tokens*. While counting, a
pre-token that is a whole token counts 1 at once; only the rest are merged, and their
counts are remembered in a bounded table.

Defined cases: null and empty text count 0 bytes and 0 tokens; repeated rows and
repeated ids give a row each; a null id is passed through; an empty table gives no
rows; further columns are ignored. Control strings such as ``</s>`` inside a text
are ordinary text, as in the library's default.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm.common import map_rows, texts, vocab_path, worker_cached

SPACE = "▁"
#: Counts of merged pre-tokens that a worker remembers.
MEMO_ROWS = 400_000
#: Longer pre-tokens are merged with a heap, and not remembered.
LONG = 96
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def read_vocabulary(path: str) -> dict[str, float]:
    """Ordinary strings of a piece model, with their merge scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}


def merge(word: str, score: dict[str, float]) -> list[str]:
    """Merge the best-scored neighbours (the leftmost of equals) until none is in the vocabulary."""
    parts = list(word)
    if len(parts) > LONG:
        return _merge_long(parts, score)
    get = score.get
    pair = [get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for k, s in enumerate(pair):
            if s is not None and (best is None or s > best):
                best, at = s, k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = get(parts[at - 1] + parts[at])


def _merge_long(parts: list, score: dict[str, float]) -> list[str]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (s := score.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


def whole_tokens(score: dict[str, float]) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token."""
    return frozenset(v for v in score if len(merge(v, score)) == 1)


def check_edges(score: dict[str, float]) -> None:
    """The proof that pre-tokens can be counted apart: no string has a space, or a line
    break in a longer string, after another character."""
    if any(SPACE in v.lstrip(SPACE) or ("\n" in v and len(v) > 1) for v in score):
        raise ValueError("the vocabulary has strings that cross pre-tokens")


class Counter(dict):
    """Tokens of a pre-token (spaces as blanks): whole tokens are there from the start."""

    PRE = re.compile(r"\n| *[^ \n]+| +")

    def __init__(self, score: dict[str, float], whole: frozenset[str], memo_rows: int = MEMO_ROWS):
        self.score, self.memo_rows = score, memo_rows
        self.whole = {w.replace(SPACE, " "): 1 for w in whole}
        self.at_start = len(self.whole)
        super().__init__(self.whole)

    def __missing__(self, pre: str) -> int:
        score = self.score
        n = 0
        for part in merge(pre.replace(" ", SPACE), score):
            n += 1 if part in score else len(part.encode("utf-8", "surrogatepass"))
        if len(pre) <= LONG:
            if len(self) - self.at_start >= self.memo_rows:
                self.clear()
                self.update(self.whole)
            self[pre] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return sum(map(self.__getitem__, self.PRE.findall(" " + text)))


@worker_cached("token counts")
def _counter(path: str, whole: frozenset[str], memo_rows: int) -> Counter:
    return Counter(read_vocabulary(path), whole, memo_rows)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, memo_rows: int = MEMO_ROWS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and whether the tokens are more than ``limit``.

    No shuffle. Broadcast: the whole tokens, at most as many strings as the vocabulary has."""
    score = read_vocabulary(model)
    check_edges(score)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(score))

    def make():
        count = _counter(model, whole.value, memo_rows).count
        return lambda c: ((i, len(t.encode("utf-8")), n := count(t), n > limit) for i, t in zip(*c))

    return map_rows(texts(docs), make, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path("piece_bpe_32k.model"))
