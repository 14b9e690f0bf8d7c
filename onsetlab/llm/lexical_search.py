"""Operator 13: ranked lexical search by exact inner products in sparse ball trees.

A query's vector holds its terms' weights, a document's vector the impacts of its terms, and the
score is their inner product, in whole numbers below 2**53 and so exact in doubles. Documents
are taken in blocks; a block's vectors are split into a tree. Each node keeps
its centroid and, for each group of terms, the radius of its vectors around it; terms of
one query tend to lie in one group. By the Cauchy-Schwarz inequality in each group no document of the node scores more than

    sum over groups of  q . centroid + |q| * radius

With bounds rounded up by more than the arithmetic can be off, a node whose bound is below
the score that a query needs to enter its k best is left out with all that is below it. Nodes
are taken best-first, by the largest bound over what their queries need; at leaves scores are exact.

How it runs: one pass over the texts keeps of each document its id, its number of terms and the terms that
some query has, which is written to the shared folder; counts over that table are the collection's
statistics; a second pass builds and searches the trees, carrying what each query needs from
block to block, and emits the k best of each query and task; a window over these ranks them.
Queries are taken in blocks of at most QUERY_BYTES of text (a longer one alone), which
bounds what is broadcast; each block is a pass of its own over all documents.

Defined cases: null texts hold no term; a document or query without terms is in no result; each row is a
document of its own, also where ids or texts repeat, and rows with equal score and doc_id have their
ranks in any order; null doc_ids come last among equal scores; each row of queries is ranked for itself, so a repeated item_id has its
ranks once for each row; very long texts are read whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.llm.common import cut, map_rows, table, texts

TOP = 50
#: Text of the queries that are searched for at one time.
QUERY_BYTES = 1 << 17
#: Documents of a block, cells of its vectors (documents x terms of the queries), and of a leaf.
BLOCK_DOCS, BLOCK_CELLS, LEAF_DOCS = 2048, 12_000_000, 8
#: Terms of so many queries are a group with a radius of its own.
COMMON = 3
#: Bounds are larger than what is worked out by this share, and by one.
SLACK = 1e-3
FOUND = "query int, doc_id long, score long"
#: Fixed values of the score.
SCALE, TF_SCALE, LENGTH_SCALE, SLOPE, WHOLE = 1_000_000_000, 1000, 20, 50, 100

#: Letters A-Z lower-cased; all other ASCII characters but letters and digits part terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, of: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number weights of terms that documents hold tf times; n: the documents' lengths, of: each term's document."""
    m = np.array([WHOLE - SLOPE + SLOPE * x * n_docs // n_terms for x in n.tolist()], np.int64)
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m[of])


class Queries:
    """Terms of a block of queries: their numbers, and the queries that hold each."""

    def __init__(self, items: list[str]):
        self.sets = [sorted(set(terms_of(t))) for t in items]
        held = Counter(w for s in self.sets for w in s)
        self.number = {w: k for k, w in enumerate(held)}  # in the order of the queries that name them first
        self.terms = [np.array([self.number[w] for w in s], np.int64) for s in self.sets]
        # a term that many queries hold is a group of its own, the others go with the query that names them first
        self.group = np.zeros(len(self.number), np.int64)
        for k in range(len(self.sets) - 1, -1, -1):
            for w, t in zip(self.sets[k], self.terms[k]):
                self.group[t] = k if held[w] < COMMON else len(self.sets) + t

    def matrix(self, weight: np.ndarray) -> np.ndarray:
        """Terms x queries."""
        q = np.zeros((len(self.number), len(self.terms)))
        for k, s in enumerate(self.terms):
            q[s, k] = weight[s]
        return q


class Tree:
    """Ball tree of a block: rows are documents, columns terms. Node 0 is the root."""

    def __init__(self, x: np.ndarray, columns: np.ndarray, edges: np.ndarray):
        """columns: the terms in the order of their groups; edges: where each group begins there."""
        self.x, self.columns, self.edges = x, columns, edges
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroid: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        self._add(np.arange(len(x)))

    def _add(self, rows: np.ndarray) -> int:
        at = len(self.rows)
        own = self.x[rows]
        centre = own.mean(axis=0, dtype=np.float64).astype(np.float32)
        apart = np.add.reduceat(np.square(own - centre)[:, self.columns], self.edges, axis=1, dtype=np.float64)
        self.rows.append(rows)
        self.centroid.append(centre)
        self.radius.append(np.sqrt(apart.max(axis=0)))
        self.children.append(None)
        whole = apart.sum(axis=1)
        if len(rows) > LEAF_DOCS and whole.max() > 0:
            # a member far from the centre and one far from that; each row goes to the nearer
            a = own[whole.argmax()]
            b = own[(np.square(a).sum() - 2 * (own @ a) + np.square(own).sum(axis=1)).argmax()]
            along = own @ (a - b)
            side = along >= (np.square(a).sum() - np.square(b).sum()) / 2
            if not LEAF_DOCS // 4 <= side.sum() <= len(rows) - LEAF_DOCS // 4:  # too uneven: halves
                side = np.zeros(len(rows), bool)
                side[np.argsort(along, kind="stable")[len(rows) // 2 :]] = True
            self.children[at] = (self._add(rows[side]), self._add(rows[~side]))
        return at


class Search:
    """The k best documents of each query, over blocks."""

    def __init__(self, queries: Queries, weight: np.ndarray, k: int):
        self.q, self.k = queries.matrix(weight), k
        self.by_query = np.ascontiguousarray(self.q.T)
        self.columns = np.argsort(queries.group, kind="stable")
        self.edges = np.unique(queries.group[self.columns], return_index=True)[1]
        self.norms = np.sqrt(np.add.reduceat(np.square(self.q)[self.columns], self.edges, axis=0))
        n = self.q.shape[1]
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in range(n)]  # heaps: the worst first
        self.need = np.ones(n)
        self.scored = self.pairs = 0

    def block(self, x: np.ndarray, ids: list) -> None:
        """Search a block: rows of impacts (float32, which holds them exactly), and their doc_ids."""
        tree = Tree(x, self.columns, self.edges)
        self.pairs += x.shape[0] * self.q.shape[1]
        # no document of a node scores more
        bounds = np.array(tree.centroid, float) @ self.q + np.array(tree.radius) @ self.norms
        bounds = bounds * (1 + SLACK) + 1
        heap = [(-math.inf, 0, np.arange(self.q.shape[1]))]
        while heap:
            _, node, of = heapq.heappop(heap)
            of = of[bounds[node, of] >= self.need[of]]
            if not len(of):
                continue
            if tree.children[node] is None:
                self._leaf(x, ids, tree.rows[node], of)
                continue
            for child in tree.children[node]:
                over = bounds[child, of] / self.need[of]
                if (top := over.max()) >= 1:
                    heapq.heappush(heap, (-float(top), child, of[over >= 1]))

    def _leaf(self, x: np.ndarray, ids: list, rows: np.ndarray, of: np.ndarray) -> None:
        self.scored += len(rows) * len(of)
        own = x[rows].astype(np.float64)
        scores = own @ self.by_query[of].T if 4 * len(of) < len(self.by_query) else (own @ self.q)[:, of]
        for r, c in zip(*np.nonzero(scores >= self.need[of])):
            j, i = int(of[c]), ids[rows[r]]
            # larger is better: the score, then the smaller id
            entry = (int(scores[r, c]), -math.inf if i is None else -i, i)
            heap = self.best[j]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.need[j] = max(1, heap[0][0])

    def results(self) -> Iterator[tuple[int, int | None, int]]:
        for j, heap in enumerate(self.best):
            for score, _, i in heap:
                yield j, i, score


def held_terms(docs: DataFrame, queries: Queries) -> DataFrame:
    """Of each document: doc_id, n (terms with repeats), and terms of the queries with their counts."""
    number = docs.sparkSession.sparkContext.broadcast(queries.number)

    def make():
        get = number.value.get

        def rows(c):
            for i, t in zip(*c):
                words = terms_of(t)
                held = Counter(k for k in map(get, words) if k is not None)
                yield i, len(words), list(held), list(held.values())

        return rows

    return map_rows(texts(docs), make, "doc_id long, n long, terms array<int>, counts array<int>")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ``most`` at a time."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= most:
            whole = pa.concat_batches(waiting)
            for at in range(0, n - n % most, most):
                yield whole.slice(at, most)
            waiting, n = [whole.slice(n - n % most)], n % most
    if n:
        yield pa.concat_batches(waiting)


def search_block(docs: DataFrame, items: list[str], k: int = TOP) -> DataFrame:
    """(query, doc_id, score): the k best of each query in each task, for one block of queries."""
    spark = docs.sparkSession
    queries = Queries(items)
    held = cut(held_terms(docs, queries))
    about = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = about["docs"], about["terms"] or 0
    weight = np.zeros(len(queries.number))
    # at most as many rows as the queries have terms
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[r["t"]] = term_weight(n_docs, r["count"])
    given = spark.sparkContext.broadcast((queries, weight))
    most = max(LEAF_DOCS, min(BLOCK_DOCS, BLOCK_CELLS // max(1, len(queries.number))))
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries, weight = given.value
        search = Search(queries, weight, k)
        for rows in _blocks(batches, most):
            of = np.repeat(np.arange(len(rows)), rows.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            x = np.zeros((len(rows), len(weight)), np.float32)
            x[of, rows.column("terms").flatten().to_numpy()] = impacts(rows.column("counts").flatten().to_numpy(), rows.column("n").to_numpy(), of, n_docs, n_terms)
            search.block(x, rows.column("doc_id").to_pylist())
        if found := list(search.results()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

    return held.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def query_blocks(items: DataFrame, most: int = QUERY_BYTES) -> Iterator[list[tuple]]:
    """Rows (item_id, text) in blocks of at most ``most`` bytes of text, a longer text alone."""
    block, size = [], 0
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        n = len(r["text"].encode("utf-8"))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


#: Results of tasks are ranked within so many parts first.
PARTS = 64


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Per item the k documents with the highest score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    out = []
    for block in query_blocks(items, query_bytes):
        if not any(terms_of(t) for _, t in block):
            continue
        found = search_block(docs, [t for _, t in block], k).withColumn("part", F.spark_partition_id() % PARTS)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "query int, item_id long")
        out.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # as many rows as the block has queries
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, map(cut, out)) if len(out) > 1 else out[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
