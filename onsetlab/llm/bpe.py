"""Operator 7: BPE encoding by dynamic programming over prefixes, and decoding.

Merging is deterministic, so each prefix of a word has one encoding, and that encoding
has one last token. A suffix automaton over the vocabulary lists, for
each prefix, the tokens that end there. The one that is the last token is the one whose
pair with the last token of the remaining shorter prefix is *compatible*: merging the
two tokens' symbols together would end with just these two. The last tokens are stored
for every prefix; following them back from the end emits the ids.

A word's final symbol is another symbol than the same byte inside a word. Text is
normalised as the vocabulary file says (NFC, white space, lower case by character),
special strings are taken out first, and words come from the file's pattern. No word
crosses white space, so ids are remembered for white-space-separated chunks, in
tables bounded in bytes. Very long texts go chunk by chunk, and a chunk without white
space takes memory in proportion to its length.

Defined cases: null and empty texts have no ids and decode to an empty string; repeated
rows give a row each; a null id is passed through; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm.common import Recent, map_rows, texts, vocab_path, worker_cached

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of chunks that a worker remembers in each of two generations; a quarter of it for words.
MEMO_BYTES = 64_000_000
PAIR_ROWS = 1_000_000
#: White space as the vocabulary's pattern language has it; Python also splits at 1c to 1f.
BLANKS = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Suffixes(dict):
    """Automaton of the vocabulary: ``ends[state]`` has the tokens that end the text read so
    far, the longest first. As a mapping it gives the next state of ``state << 9 | symbol``;
    steps that fall back to a shorter suffix are worked out when first taken."""

    MOST = 2_000_000

    def __init__(self, tokens: dict[str, int]):
        super().__init__()
        self.child: dict[int, int] = {}
        depth, own, parent = [0], [()], [(0, 0)]
        for s, token in tokens.items():
            state = 0
            for c in map(ord, s):
                key = state << 9 | c
                if key not in self.child:
                    self.child[key] = len(depth)
                    parent.append((state, c))
                    depth.append(depth[state] + 1)
                    own.append(())
                state = self.child[key]
            own[state] = ((token, len(s)),)
        self.fall = [0] * len(depth)
        self.ends = own
        for state in sorted(range(1, len(depth)), key=depth.__getitem__):
            up, c = parent[state]
            if up:
                self.fall[state] = self._next(self.fall[up], c)
            self.ends[state] = own[state] + self.ends[self.fall[state]]

    def _next(self, state: int, c: int) -> int:
        while (to := self.child.get(state << 9 | c)) is None and state:
            state = self.fall[state]
        return to or 0

    def __missing__(self, key: int) -> int:
        if len(self) >= self.MOST:
            self.clear()
        to = self[key] = self._next(key >> 9, key & 511)
        return to


class Splitter:
    """What a vocabulary file says about texts before and after merging: normal form,
    special strings, words, and the tokens' strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.strings = {i: s for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.learn_merges(spec["model"])

    def learn_merges(self, model: dict) -> None:
        """Tables for merging; here there are none."""

    def normalize(self, text: str) -> list[str]:
        """Chunks of normal text: NFC, lower case by character, split at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if ODD.search(text):
            return [c for c in BLANKS.split(text.lower()) if c]
        return text.lower().split()

    def decode(self, ids) -> str:
        """The file names no decoder: the tokens' strings with blanks between them."""
        return " ".join(map(self.strings.__getitem__, ids))


class Bpe(Splitter):
    """Tables of one vocabulary file."""

    def learn_merges(self, model: dict) -> None:
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        symbols: dict[int, str] = {i: chr(b) for b, i in enumerate(self.inner)}
        symbols.update({i: chr(256 + b) for b, i in enumerate(self.final)})
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves = {i: (i, i) for i in symbols}
        last = max(symbols)
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if both <= last or both in symbols:
                raise ValueError("ids are not in the order of merges")
            last = both
            self.pairs[left, right] = both
            self.halves[both] = (left, right)
            symbols[both] = symbols[left] + symbols[right]
        self._known: dict[int, bool] = {}
        # a token that merging never leaves whole is not a match
        self.automaton = Suffixes({s: i for i, s in symbols.items() if len(s) == 1 or self._stays(i)})

    def _stays(self, token: int) -> bool:
        left, right = self.halves[token]
        return self._compatible(left, right, token)

    def _compatible(self, left: int, right: int, top: int) -> bool:
        """Whether no merge earlier than ``top`` joins symbols across the edge of two tokens.

        Both tokens are undone from their latest merge on; at each step the pair that
        touches the edge must not be one that would have been merged by then."""
        pairs, halves = self.pairs, self.halves
        while True:
            both = pairs.get((left, right))
            if both is not None and both < top:
                return False
            (_, near_left), (near_right, _) = halves[left], halves[right]
            if left > right and near_left != left:
                left, top = near_left, min(top, left)
            elif near_right != right:
                right, top = near_right, min(top, right + 1)
            elif near_left != left:
                left, top = near_left, min(top, left)
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= PAIR_ROWS:
                self._known.clear()
            found = self._known[key] = self._compatible(left, right, 1 << 60)
        return found

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n = len(symbols)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        known, compatible, ends, step, state = self._known, self.compatible, self.automaton.ends, self.automaton, 0
        for at, c in enumerate(map(ord, symbols), 1):
            state = step[state << 9 | c]
            for token, k in ends[state]:
                start = at - k
                if start:
                    left = last[start]
                    ok = known.get(left << 20 | token)
                    if ok is None:
                        ok = compatible(left, token)
                    if not ok:
                        continue
                last[at], size[at] = token, k
                break
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return ids


class Encoder:
    """Ids (as little-endian unsigned 32-bit integers) of texts. Ids of chunks and of words
    are remembered within a bound in bytes."""

    def __init__(self, bpe: Splitter, decoded: bool, memo_bytes: int = MEMO_BYTES, encode_word=None):
        self.bpe, self.decoded = bpe, decoded
        words = self.words = Recent(encode_word or bpe.encode_word, memo_bytes // 4, lambda ids: 8 * len(ids))

        def encode(chunk: str):
            ids = array("I")
            for word in bpe.pattern.findall(chunk):
                ids.extend(words[word])
            return (ids.tobytes(), bpe.decode(ids)) if decoded else ids.tobytes()

        self.chunks = Recent(encode, memo_bytes, (lambda v: 100 + len(v[0]) + len(v[1])) if decoded else len)

    def parts(self, text: str) -> list:
        """Of each chunk: its ids, or ids and decoded string."""
        if "<|" not in text:
            return list(map(self.chunks.__getitem__, self.bpe.normalize(text)))
        out = []
        for piece in self.bpe.special_pattern.split(text):
            i = self.bpe.special.get(piece)
            if i is not None:
                raw = array("I", [i]).tobytes()
                out.append((raw, piece) if self.decoded else raw)
            elif piece:
                out.extend(map(self.chunks.__getitem__, self.bpe.normalize(piece)))
        return out


@worker_cached("BPE encoding")
def encoder(path: str, decoded: bool, memo_bytes: int) -> Encoder:
    return Encoder(Bpe(path), decoded, memo_bytes)


def encode_decode(docs: DataFrame, vocabulary: str, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Per row: doc_id, ids as array<int> and the decoded text. No shuffle."""

    def make():
        e = encoder(vocabulary, True, memo_bytes)

        def rows(c):
            for i, t in zip(*c):
                parts = e.parts(t)
                ids = array("I", b"".join([p[0] for p in parts]))
                yield i, ids.tolist(), " ".join([p[1] for p in parts if p[1]])

        return rows

    return map_rows(texts(docs), make, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary: str, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """As encode_decode, but digests of ids and decoded text in their place."""

    def make():
        e = encoder(vocabulary, True, memo_bytes)

        def rows(c):
            for i, t in zip(*c):
                parts = e.parts(t)
                ids = b"".join([p[0] for p in parts])
                decoded = " ".join([p[1] for p in parts if p[1]])
                yield i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return rows

    return map_rows(texts(docs), make, SCHEMA)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path("word_bpe_49k.json"))
