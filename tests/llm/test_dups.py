import random

import numpy as np
from pyspark.sql import functions as F

from onsetlab.llm import embedding_dups, jaccard
from onsetlab.llm.components import components


def _brute(texts, words, top, bottom):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if bottom * o >= top * (len(sets[a]) + len(sets[b]) - o):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def _texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 11, 12, 13, 20, 22, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(x)) if x else 0
                x[k : k + 1] = rng.choice([[], ["edit"], [w.upper() for w in x[k : k + 1]], ["an", "insert"]])
            out.append(" ".join(x))
    hot = [f"h{k}" for k in range(60)]
    out += [" ".join(hot[:k] + ["q"] * (k % 3) + hot[k:]) for k in range(60)]
    return list(enumerate(out)) + [(9001, None), (9002, ""), (9003, "  \n"), (9004, "One"), (9005, "one")]


def test_jaccard_join(spark, monkeypatch):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, component_id string")
    for words, top, bottom, block in ((3, 9, 10, 512), (5, 4, 5, 7)):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words, top, bottom).collect()}
        assert got == _brute(texts, words, top, bottom)


def test_jaccard_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (None, "a b c d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    kept = jaccard.one_of_each(docs).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1, 3]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_far_blocks(spark, monkeypatch):
    """A hub of many blocks: chains of edits, and members that only link across far blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        x = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            x[rng.randrange(30, 60)] = f"e{k}_{rng.randrange(5)}"
        texts.append(" ".join(x[: rng.choice([58, 59, 60])]))
    texts = [(k, t) for k, t in enumerate(texts)] + [(100, " ".join(["odd", *base[:28], *(f"z{k}" for k in range(31))])), (101, " ".join(["odd", *base[:28], *(f"z{k}" for k in range(31))]) + " end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for words, top, bottom in ((3, 9, 10), (5, 4, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words, top, bottom).collect()}
        assert got == _brute(texts, words, top, bottom)


def test_most_shared_is_a_bound():
    """Never below what two sets share, whatever their widths; an empty sketch allows all of the smaller set."""
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**62, 3000)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 2, 30, 130, 140, 500, 1000, 2500)] + [np.arange(600) << 20]
    assert jaccard.sketch(sets[-1]) == b"" and len(jaccard.sketch(sets[2])) < len(jaccard.sketch(sets[6]))
    n = np.array([len(s) for s in sets])
    bound = jaccard.most_shared([jaccard.sketch(s) for s in sets], [jaccard.sketch(s) for s in sets[::-1]], n, n[::-1])
    real = np.array([[len(np.intersect1d(x, y)) for y in sets[::-1]] for x in sets])
    assert (bound >= real).all() and (bound <= np.minimum(n[:, None], n[None, ::-1])).all()
    assert (bound[:, ::-1].diagonal() == n).all()


def test_unlike_texts_are_not_moved(spark, monkeypatch):
    """Texts of sizes a tenth apart that share one rare passage meet, but only the near copies' texts are sent."""
    rng, seen, links = random.Random(4), set(), jaccard.heavy_links
    texts = [(k, f"rare{k // 4} short passage{k // 4} {' '.join(f'x{rng.randrange(12)}' for _ in range(200 - 7 * (k % 4)))}") for k in range(60)]
    texts.append((100, texts[7][1] + " end"))

    def watched(docs, dealt, *how):
        seen.update(r.rep for r in dealt.collect())
        return links(docs, dealt, *how)

    monkeypatch.setattr(jaccard, "heavy_links", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _brute(texts, 3, 9, 10)
    assert seen == {7, 100}


def test_one_of_each_keeps_other_texts(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "a b c d e f")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5, top=4, bottom=5).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "a b c d e f")] * 2 + [(1, "a b c d e f"), (1, "u v w x y z")]


def test_boundary_follows_cost():
    assert jaccard.boundary({12: 5, 60: 9}) >= 12
    assert jaccard.boundary({28: 1000}) < 26


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def _vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.3])).tolist(), int(k % 3)))
    n = len(rows)
    bad = [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, rows[0][1], None), (n + 4, [], 0), (n + 5, [1.0, None] * 4, 0), (n + 6, rows[0][1], 0), (n + 7, [1.0] * 3, 0)]
    return rows + bad


def _check(got, rows):
    ok = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, x, p in ok:
        for b, y, q in ok:
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a].add(b)
    assert {i: r.n_links for i, r in got.items()} == {i: len(s) for i, s in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))


def test_embedding_links(spark, monkeypatch):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    _check({r.vec_id: r for r in embedding_dups.near_duplicates(df).collect()}, rows)
    # many small cells, blocks and leaves: the top level's visitors and the pruning
    monkeypatch.setattr(embedding_dups, "PER_CENTRE", 8)
    monkeypatch.setattr(embedding_dups, "BLOCK", 6)
    monkeypatch.setattr(embedding_dups, "LEAF", 2)
    _check({r.vec_id: r for r in embedding_dups.near_duplicates(df).collect()}, rows)
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0


def test_dual_traversal_is_exact(monkeypatch):
    monkeypatch.setattr(embedding_dups, "LEAF", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) + rng.normal(size=(12, 6)).repeat(25, axis=0) * 4
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dups.Node(x, np.arange(300), 2.0)
    found = set()
    for rows, others, hit in embedding_dups.dual(x, tree, x, tree, 0.93):
        for p, q in zip(*np.nonzero(hit)):
            pair = tuple(sorted((int(rows[p]), int(others[q]))))
            assert pair not in found
            found.add(pair)
    assert found == {(a, b) for a in range(300) for b in range(a + 1, 300) if x[a] @ x[b] >= 0.93}
    assert tree.children


def test_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(df).where(F.lit(True)).collect()}
    assert got == {None: (0, None, False), 1: (0, 1, True)}


def test_repeated_ids_of_other_vectors(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 1), (2, [1.0, 0.01], 0), (9, [0.01, 1.0], 1), (7, [1.0, 0.02], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(df).collect()]
    assert len(got) == 5 and {(v, c, k) for v, _, c, k in got} == {(5, 2, False), (2, 2, True), (9, 2, False), (7, 2, False)}
    assert all(2 <= n <= 3 for v, n, _, _ in got if v == 5) and {n for v, n, _, _ in got if v == 2} == {2}
