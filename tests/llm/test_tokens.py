import hashlib
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from onsetlab.llm import bpe, packing, token_counts
from onsetlab.llm.common import vocab_path

PIECES, WORDS = vocab_path("piece_bpe_32k.model"), vocab_path("word_bpe_49k.json")
SP, TK = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
SCORE = token_counts.read_vocabulary(PIECES)
COUNTER = token_counts.Counter(SCORE, token_counts.whole_tokens(SCORE), 50)
ENCODER = bpe.Encoder(bpe.Bpe(WORDS), True, 40_000)
ODD = st.text(st.sampled_from("ab  \n\t▁éÉΣσİßﬁ½²٣一龘😀́\x1c\x85\xa0'sTte.,!<|>/w0"), max_size=60)
DOCS = "doc_id long, text string, n_tokens string"
ROWS = [(1, "The quick <|endoftext|> fox</s>", "x"), (1, "The quick <|endoftext|> fox</s>", "x"), (2, None, "x"), (3, "", None), (None, "it's  a\n\nlong " + "thth" * 300, "x"), (4, "word " * 9000, "x")]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_as_the_library(text):
    assert COUNTER.count(text) == len(SP.encode(text))


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_and_text_as_the_library(text):
    parts = ENCODER.parts(text)
    ids = list(array("I", b"".join(p[0] for p in parts)))
    assert ids == TK.encode(text, add_special_tokens=False).ids
    assert " ".join(p[1] for p in parts if p[1]) == TK.decode(ids, skip_special_tokens=False)


def test_long_pre_tokens():
    for text in ("a" * 5000, "th" * 700 + "é" * 300, " " * 500 + "x", "ab" * 3000 + "<|endoftext|>"):
        assert COUNTER.count(text) == len(SP.encode(text))
        assert array("I", b"".join(p[0] for p in ENCODER.parts(text))).tolist() == TK.encode(text, add_special_tokens=False).ids


def test_queries(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = token_counts.token_counts(docs, PIECES).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for _, t, _ in ROWS)
    got = bpe.encoding_digests(docs, WORDS).collect()
    want = [TK.encode(t or "", add_special_tokens=False).ids for _, t, _ in ROWS]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((len(i), hashlib.sha256(array("I", i).tobytes()).hexdigest(), hashlib.sha256(TK.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in want)
    assert bpe.encode_decode(docs.where("doc_id = 1"), WORDS).first().ids == want[0]
    empty = docs.limit(0)
    assert token_counts.token_counts(empty, PIECES).count() == bpe.encoding_digests(empty, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_holds_everything(histogram):
    made = packing.plan(histogram, 40)
    used = {}
    for lengths, n in made:
        assert sum(lengths) <= 40 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    count = np.zeros(41, np.int64)
    for x, n in histogram.items():
        count[x] = n
    assert sum(n for _, n in made) <= sum(n for _, n in packing._best_fit(count, 40))


def test_exact_complements_fill():
    assert sorted(packing.plan({10: 2, 7: 1, 3: 1, 5: 2, 4: 1, 2: 3}, 10)) == sorted([((10,), 2), ((7, 3), 1), ((5, 5), 1), ((4, 2, 2, 2), 1)])
    # best fit alone puts 40 with 32 and 28; the index finds 40 + 30 + 30 and 38 + 32 + 28 + 2
    assert sum(n for _, n in packing.plan({40: 5, 38: 5, 32: 5, 30: 10, 28: 5, 2: 5}, 100)) == 10


def test_plan_is_near_the_bound():
    rng = random.Random(7)
    for room, lengths in ((4096, [rng.randrange(1, 4097) for _ in range(1500)]), (4096, [min(4096, int(rng.lognormvariate(6, 1))) for _ in range(5000)]), (512, [rng.randrange(100, 400) for _ in range(3000)])):
        histogram = Counter(lengths)
        count = np.zeros(room + 1, np.int64)
        for x, n in histogram.items():
            count[x] = n
        made, fit = sum(n for _, n in packing.plan(histogram, room)), sum(n for _, n in packing._best_fit(count, room))
        large = sum(n for x, n in histogram.items() if 2 * x > room)
        bound = max(large, -(-sum(lengths) // room))
        assert bound <= made <= fit and made <= 1.02 * bound + 1


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = packing.pack_documents(docs, WORDS).collect()
    ids = [TK.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in ROWS]
    assert sum(r.length for r in got) == sum(map(len, ids))
    want = sorted((d if d is not None else -1, at // 4096, at, len(p), zlib.crc32(array("I", p).tobytes())) for (d, _, _), i in zip(ROWS, ids) for at in range(0, len(i), 4096) for p in [i[at : at + 4096]])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) == -(-sum(map(len, ids)) // 4096)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
