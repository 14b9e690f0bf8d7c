import hashlib
import math
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from onsetlab.llm import entries, lexical_search, periodic_runs, token_files
from onsetlab.llm.common import new_place, vocab_path

BYTES = vocab_path("byte_bpe_50k.json")
TK, IDS = Tokenizer.from_file(BYTES), token_files.ByteIds(BYTES)
ODD = st.text(st.sampled_from("ab  \n\t▁éÉΣσİßﬁ½²٣一龘😀́\x1c\x85\xa0'sTtedmlv.,!<|>/w0　​"), max_size=50)
DOCS = "doc_id long, text string, start string, length int"


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=20), st.just("a<|endoftext|> b <|endoftext|>")))
def test_byte_ids_as_the_library(text):
    assert array("I", IDS.encode(text)).tolist() == TK.encode(text, add_special_tokens=False).ids


def test_byte_ids_of_long_stretches():
    for text in ("a" * 9000, " " * 9000 + "x", "\n" * 4001, "ab <|endoftext|>" * 900):
        assert array("I", IDS.encode(text)).tolist() == TK.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 99))
def test_packed_ids(width, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n, np.uint32)
    raw = token_files.pack(ids, width)
    assert (token_files.unpack(raw, n, width) == ids).all() and len(raw) == -(-n // 64) * 8 * width


def test_width():
    assert [token_files.width_of(n) for n in (1, 2, 3, 4, 256, 257, 50257)] == [1, 1, 2, 2, 8, 9, 16]


def _file(tmp_path, docs, width=17):
    w = token_files.Writer(f"file://{tmp_path}/x.bits", width)
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4").tobytes())
    return token_files.TokenFile(w.close()[0])


def test_token_file_by_place(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", 2)
    rng = np.random.default_rng(1)
    docs = [(None if k == 3 else k, rng.integers(0, 1 << 17, n).tolist()) for k, n in enumerate([5, 1, 30000, 0, 4096, 8192, 1, 1])]
    f = _file(tmp_path, docs)
    assert f.n_ids == sum(len(x) for _, x in docs) and f.width == 17 and len(f.offsets) == -(-f.n_ids // token_files.BLOCK_IDS)
    flat = [x for _, ids in docs for x in ids]
    for k, (_, ids) in enumerate(docs):
        assert f.document(k).tolist() == ids
    for a, b in ((0, 0), (7, 9), (4095, 4097), (30000, 99999999)):
        assert f.ids(a, b).tolist() == flat[a:b]
    rows = [r for t in token_files._documents(f, 100, _read_schema(), True) for r in t.to_pylist()]
    at = 100
    for r, (i, ids) in zip(rows, docs, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (i, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    raw = bytearray(open(f"{tmp_path}/x.bits", "rb").read())
    raw[40] ^= 1
    open(f"{tmp_path}/x.bits", "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(f"file://{tmp_path}/x.bits").ids(0, 9)
    open(f"{tmp_path}/x.bits", "wb").write(raw[:-9] + b"\0" * 9)
    with pytest.raises(ValueError, match="no whole file"):
        token_files.TokenFile(f"file://{tmp_path}/x.bits")


def _read_schema():
    import pyarrow as pa

    return pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + [("ids", pa.list_(pa.int32()))])


ROWS = [(7, "The quick fox", "x", 1), (7, "The quick fox", "x", 1), (7, "another", "y", 2), (2, None, None, None), (3, "", "x", 1), (None, "no id " * 3, "x", 1), (-4, "word " * 9000, "x", 1), (9, "end<|endoftext|>", "x", 1)]


def test_token_files(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, DOCS)
    files = token_files.write_token_files(docs, BYTES, new_place(spark))
    rows = token_files.read_token_files(files, True).collect()
    at, seen = 0, []
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
        seen.append((r.doc_id, r.ids))
    want = [(i, TK.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in ROWS]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    order = [i for i, _ in seen]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BYTES, new_place(spark))).count() == 0


def test_lost_attempts_leave_no_rows(spark):
    """A file that no committed row names, as a lost attempt leaves it, changes nothing."""
    folder = new_place(spark)
    files = token_files.write_token_files(spark.createDataFrame(ROWS, DOCS), BYTES, folder)
    before = sorted(map(tuple, token_files.read_token_files(files).collect()), key=repr)
    w = token_files.Writer(f"file://{folder}/ids/000000-0000-lost.bits".replace("file://file:", "file:"), 16)
    w.add(1, b"\1\0\0\0")
    w.close()
    assert sorted(map(tuple, token_files.read_token_files(spark.read.parquet(f"{folder}/files")).collect()), key=repr) == before


def _brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - b >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(b, e - r)) for r in range(1, q)):
                out.add((b, e - b, q))
    return sorted(out)


def _repeating(rng):
    a = rng.choice((2, 2, 3, 5, 50))
    w = [rng.randrange(a) for _ in range(rng.randrange(0, 90))]
    for _ in range(rng.randrange(0, 4)):
        p = rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 16, 17, 24, 31, 40))
        s = [rng.randrange(a) for _ in range(p)]
        if rng.random() < 0.3 and p > 3:
            s = (s[: p // 3] * 3 + s)[:p]
        k = rng.choice((3, 4, 4, 5, 6, 9))
        at = rng.randrange(len(w) + 1)
        w = w[:at] + (s * (k + 1))[: p * k + rng.randrange(-1, p)] + w[at:]
    return [b"%d" % x for x in w]


def test_runs_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        texts = [_repeating(rng) for _ in range(20)]
        for t, found in zip(texts, periodic_runs.runs_of_each(texts)):
            assert found == _brute_runs(t)


def test_sync_set_is_consistent_and_dense():
    rng = np.random.default_rng(2)
    codes = np.concatenate([rng.integers(0, 3, 200), np.tile(rng.integers(0, 9, 5), 12), rng.integers(0, 3, 200), np.zeros(60, int), rng.integers(0, 3, 99)]).astype(np.uint64)
    t = 16
    windows = np.lib.stride_tricks.sliding_window_view(codes, t)
    ids = np.unique(windows, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
    small = np.array([any((w[p:] == w[:-p]).all() for p in range(1, t // 4 + 1)) for w in windows])
    chosen = set(periodic_runs.sync_set(ids, t, small).tolist())
    alike = {}
    for i in range(len(codes) - 2 * t + 1):
        assert alike.setdefault(codes[i : i + 2 * t].tobytes(), i in chosen) == (i in chosen)
    for i in range(len(codes) - 3 * t):
        assert small[i : i + 2 * t].all() or any(x in chosen for x in range(i, i + t))


def test_periodic_runs(spark):
    rows = [(k, " ".join(x.decode() for x in _repeating(random.Random(k))), "x", 1) for k in range(60)]
    rows += [(70, None, "x", 1), (71, "", "x", 1), (None, "a b " * 9, "x", 1), (72, " \t\n\x0b\x0c\r", "x", 1), (73, "a\x1cb a\xa0b " * 5, "x", 1), (74, "w " * 300000, "x", 1), (75, "rep eat " * 9, "x", 1), (75, "rep eat " * 9, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, periodic_runs.run_digests(docs, periodic_runs.planted).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = [(0, n, 1)] if n > 1000 else _brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        gone = {k for b, m, q in found for k in range(b + q, b + m)}
        listed = "".join(f"{b},{m},{q}\n" for b, m, q in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60))
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert plain[75].text == "rep eat" and [tuple(x) for x in plain[75].runs] == [(0, 18, 2)] and plain[70].text == ""
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0


ITEM_ROWS = [(1, "the quick brown fox", "a"), (2, None, "a"), (3, "--- !", "a"), (4, "Über straße 42 THE", "a"), (1, "the quick brown fox", "a"), (5, "nowhere-to-be-found", "a"), (None, "fox", "a")]


def _scores(docs, items, k):
    of = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in of), sum(len(w) for _, w in of)
    out = []
    for item, t in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        scores = []
        for i, w in of:
            s = 0
            for x in terms & set(w):
                df, tf = sum(x in v for _, v in of), w.count(x)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + 50 * len(w) * n_docs // n_terms)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    rng = random.Random(4)
    words = "the quick brown fox über straße 42 dog ÜBER lazy x1 y2 z3".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), "s", 1) for k in range(150)]
    rows += [(200, None, "s", 1), (201, "", "s", 1), (202, "?!", "s", 1), (None, "fox fox", "s", 1), (203, "fox " * 20000, "s", 1), (5, rows[5][1], "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame(ITEM_ROWS, "item_id long, text string, rank string")
    want = _scores([r[:2] for r in rows], [r[:2] for r in ITEM_ROWS], 20)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 40)
    for most in (1 << 17, 30):
        got = sorted(map(tuple, lexical_search.lexical_search(docs, items, 20, most).collect()), key=repr)
        assert got == want
    assert lexical_search.lexical_search(docs.limit(0), items).count() == lexical_search.lexical_search(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(400)]
    queries = lexical_search.Queries([" ".join(rng.choice(vocabulary[20 * k % 400 : 20 * k % 400 + 40], 25)) for k in range(30)])
    n = len(queries.number)
    x = np.zeros((3000, n), np.float32)
    for k in range(len(x)):
        x[k, rng.integers(0, n, 12) % n] = rng.integers(1, 900000, 12)
        if k % 6 == 0:
            x[k, queries.terms[k % 30]] = rng.integers(300000, 900000, len(queries.terms[k % 30]))
    search = lexical_search.Search(queries, rng.integers(1, 9000, n).astype(float), 10)
    for at in range(0, len(x), 1000):
        search.block(x[at : at + 1000], list(range(at, at + 1000)))
    scores = x.astype(float) @ search.q
    for j in range(30):
        best = sorted(range(len(x)), key=lambda i: (-scores[i, j], i))[:10]
        assert sorted((i, s) for q, i, s in search.results() if q == j) == sorted((i, int(scores[i, j])) for i in best)
    assert search.scored < 0.6 * search.pairs


def test_new_ops_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    sql = entries.oracle_sql()["op13_lexical_search"]
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(map(tuple, lexical_search.op13_lexical_search(spark, d).select(*names).collect())) == sorted(r.fetchall())
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert token_files.op11_token_files(spark, d).count() == periodic_runs.op12_periodic_runs(spark, d).count() == docs
