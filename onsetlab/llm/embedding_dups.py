"""Operator 8: embedding near-duplicates by cover-tree dual traversal.

Equal vectors of a label are one point with a count. Points of a label lie on the unit
sphere, where a cosine is a distance. The tree's top level has bounded centres for each
label (chosen by hash, in proportion to its points); a point belongs to its nearest
centre's node, whose covering radius is its farthest point. Two points within the wanted
distance ``eps`` are in one node, or the one of the lower node is a *visitor* of the
higher: only where both the covering radius (d(x, c) - r <= eps) and the bisecting plane
(d(x, c) <= d(x, own c) + 2 eps) allow it. A node with very many points is dealt in
blocks, and each pair of blocks is a task's work of bounded size.

There, cover trees with halving radii, down to half of eps, are built over both blocks and
traversed together: a pair of tree nodes is pruned when its centres are farther apart than
the radii and eps together; leaves are compared as matrices, in double precision. A task
gives counts of links and a spanning forest of them, never the pairs.

Broadcast: at most about 2 * ``CENTRES`` centres.

Defined cases: null labels, and vectors that are null, empty, zero or have null or
non-finite parts, link with nothing; so do vectors of different length; a null vec_id has
a null component, no links and is not kept; repeated rows are vectors each; a vec_id that is
repeated with other vectors or labels is one node of the components, and each of its rows
has at least the links of any of its vectors and at most their sum; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.llm.common import cut, map_rows
from onsetlab.llm.components import components

COSINE = 0.93
#: Centres over all labels, and points for which a label gets one more.
CENTRES, PER_CENTRE = 4096, 16384
#: Points of one block.
BLOCK = 8192
#: Tree nodes of so few points are leaves.
LEAF = 64
#: Rows of a matrix of distances at one time.
AT_ONCE = 256
#: Distances of nearly equal unit vectors, as roots, are right to some 2e-8.
SLACK = 1e-7


def chord(cosine: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine))


#: Within a node of this radius all points are neighbours.
FINEST = chord(COSINE) / 2


def points(vectors: DataFrame) -> DataFrame:
    """Valid vectors: vec_id, label, a key of the exact vector, and the vector in doubles."""

    def make():
        def rows(c):
            for i, label, v in zip(*c):
                if i is None or label is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    norm = np.sqrt(x @ x)
                if np.isfinite(x).all() and norm > 0 and np.isfinite(norm):
                    raw = x.tobytes()
                    yield i, label, hashlib.md5(raw).digest(), raw

        return rows

    label = F.col("label").cast("string")
    return map_rows(vectors.select("vec_id", label, "embedding"), make, "vec_id long, label string, key binary, x binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _nets(x: np.ndarray, rows: np.ndarray, half: float) -> list[np.ndarray]:
    """Rows by centres that are more than ``half`` apart; each net's first row is its centre
    and its others lie within ``half`` of it."""
    nets = []
    while len(rows):
        near = _far(x[rows[:AT_ONCE]], x[rows]) <= half
        left = np.ones(len(rows), bool)
        for k in range(len(near)):
            if left[k]:
                own = near[k] & left
                own[k] = False
                nets.append(np.concatenate([rows[k : k + 1], rows[own]]))
                left &= ~own
                left[k] = False
        rows = rows[left]
    return nets


class Node:
    """A node of a cover tree: its centre, covering radius and points; its children have
    centres more than half its level apart and cover half its level. Levels go on to
    ``finest``, where all points of a node are neighbours; nodes of few points are leaves."""

    __slots__ = ("centre", "radius", "rows", "children", "centres", "radii")

    def __init__(self, x: np.ndarray, rows: np.ndarray, level: float, finest: float = FINEST):
        self.centre, self.rows, self.children = x[rows[0]], rows, []
        self.radius = float(_far(x[rows], self.centre[None]).max()) if len(rows) > 1 else 0.0
        if len(rows) > LEAF and self.radius > finest:
            half = level / 2
            while half >= self.radius:
                half /= 2
            self.children = [Node(x, net, half, finest) for net in _nets(x, rows, half)]
            self.centres = np.stack([k.centre for k in self.children])
            self.radii = np.array([k.radius for k in self.children])
        else:
            self.centres, self.radii = self.centre[None], np.array([self.radius])

    def below(self) -> list[Node]:
        return self.children or [self]

    def small(self) -> bool:
        return not self.children and len(self.rows) <= LEAF


def _leaves(left: list[Node], right: list[Node], near: np.ndarray):
    """Matrices of bounded size (rows, others, which pairs are open) over the points of
    those leaves that are near each other."""
    sizes = np.array([len(k.rows) for k in right])
    at = 0
    while at < len(left):
        n, size = 1, len(left[at].rows)
        while at + n < len(left) and size + len(left[at + n].rows) <= AT_ONCE:
            size += len(left[at + n].rows)
            n += 1
        some = np.flatnonzero(near[at : at + n].any(axis=0))
        if len(some):
            open_ = np.repeat(np.repeat(near[at : at + n, some], sizes[some], axis=1), [len(k.rows) for k in left[at : at + n]], axis=0)
            yield np.concatenate([k.rows for k in left[at : at + n]]), np.concatenate([right[k].rows for k in some]), open_
        at += n


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float, tally: dict | None = None):
    """Blocks (rows of x, rows of y, which link) of all pairs with at least this cosine;
    x is y and a is b for pairs within one tree, whose pairs come once, in either order.
    ``tally`` gets how many pairs of nodes were ``tested`` and pairs of points ``compared``."""
    eps = chord(cosine) + SLACK
    tally = {} if tally is None else tally
    tally.setdefault("tested", 0), tally.setdefault("compared", 0)
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        same = a is b
        if not a.children and not b.children:
            for at in range(0, len(a.rows), 1024):
                rows = a.rows[at : at + 1024]
                hit = x[rows] @ y[b.rows].T >= cosine
                tally["compared"] += hit.size
                if same:
                    hit &= np.arange(at, at + len(rows))[:, None] < np.arange(len(b.rows))[None, :]
                if hit.any():
                    yield rows, b.rows, hit
            continue
        # the children of both, and of them the pairs that radii and eps together don't keep apart
        left, right = a.below(), b.below()
        j = [k for k in range(len(right)) if right[k].small()]
        if same:
            place = np.zeros(len(x), np.int64)
            place[np.concatenate([k.rows for k in right])] = np.arange(sum(len(k.rows) for k in right))
        for at in range(0, len(left), AT_ONCE):
            cosines = a.centres[at : at + AT_ONCE] @ b.centres.T
            near = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines)) <= a.radii[at : at + AT_ONCE, None] + b.radii + eps
            tally["tested"] += near.size
            if same:  # each pair once, and every child with itself
                near &= np.arange(at, at + len(near))[:, None] <= np.arange(len(right))[None, :]
            # small leaves among them are compared by the matrix
            i = [k for k in range(len(near)) if left[at + k].small()]
            if i and j:
                some = np.ix_(i, j)
                for rows, others, open_ in _leaves([left[at + k] for k in i], [right[k] for k in j], near[some]):
                    if same:
                        open_ &= place[rows][:, None] < place[others][None, :]
                    tally["compared"] += int(open_.sum())
                    hit = open_ & (x[rows] @ y[others].T >= cosine)
                    if hit.any():
                        yield rows, others, hit
                near[some] = False
            todo += [(left[at + i], right[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)))]


def compare(ids: list[int], times: list[int], raw: list[bytes], side: list[int], cosine: float):
    """Counts (a, null, links) and forest links (a, b, null) among one block's members and
    between members (side 0) and others (side 1; for a block on its own there are none)."""
    if len({len(r) for r in raw}) > 1:  # vectors of different length
        for size in {len(r) for r in raw}:
            k = [i for i, r in enumerate(raw) if len(r) == size]
            yield from compare([ids[i] for i in k], [times[i] for i in k], [raw[i] for i in k], [side[i] for i in k], cosine)
        return
    x, t, s = unit(raw), np.array(times), np.array(side)
    first, second = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
    if not len(first) or (s.any() and not len(second)):
        return
    count = np.zeros(len(ids), np.int64)
    part = np.arange(len(ids))
    finest = chord(cosine) / 2
    top = Node(x, first, 2.0, finest)
    for rows, others, hit in dual(x, top, x, Node(x, second, 2.0, finest) if len(second) else top, cosine):
        np.add.at(count, rows, hit @ t[others])
        np.add.at(count, others, hit.T @ t[rows])
        for k in np.flatnonzero(hit.any(axis=1)):
            p, linked = rows[k], others[hit[k]]
            for q in linked[np.unique(part[linked], return_index=True)[1]]:
                if part[p] != part[q]:
                    yield ids[p], ids[q], None
                    part[part == part[q]] = part[p]
    for k in np.flatnonzero(count):
        yield ids[k], None, int(count[k])


def _centres(reps: DataFrame) -> dict[str, tuple[list[bytes]]]:
    """Centres by label, for labels with a noticeable share of all points only."""
    sizes = reps.groupBy("label").count()
    total = reps.count()
    large = sizes.where((F.col("count") > PER_CENTRE) & (F.col("count") * CENTRES >= total))
    wanted = large.select("label", F.least(F.ceil(F.col("count") / PER_CENTRE), F.ceil(F.col("count") * CENTRES / max(1, total))).alias("k"))
    wanted = {r["label"]: r["k"] for r in wanted.collect()}
    by: dict[str, list[bytes]] = {}
    if wanted:
        some = reps.where(F.col("label").isin(*wanted)).withColumn("h", F.xxhash64("key"))
        # the points with the smallest hashes: a threshold by share, then exactly k
        share = max(k / n for k, n in ((wanted[r["label"]], r["count"]) for r in large.collect()))
        limit = min(2**63 - 1, -(2**63) + int(min(1.0, 8 * share + 1e-6) * 2**64))
        for r in some.where(F.col("h") <= limit).groupBy("label").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "x"))), 1, max(wanted.values())).alias("c")).collect():
            by[r["label"]] = [bytes(c["x"]) for c in r["c"][: wanted[r["label"]]]]
    return by


def _dealt(reps: DataFrame, cosine: float) -> DataFrame:
    """(label, cell, i, j, side, rep, times, x): points by pair of blocks."""
    spark = reps.sparkSession
    centres = spark.sparkContext.broadcast(_centres(reps))
    eps = chord(cosine) + SLACK

    def owner():
        near = {label: unit(c) for label, c in centres.value.items()}

        def rows(c):
            for label, rep, times, x in zip(*c):
                d = 0.0
                cell = 0
                if label in near and near[label].shape[1] * 8 == len(x):
                    all_d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (near[label] @ unit([x])[0])))
                    cell = int(all_d.argmin())
                    d = float(all_d[cell])
                yield label, cell, d, rep, times, x

        return rows

    owned = cut(map_rows(reps.select("label", "rep", "times", "x"), owner, "label string, cell int, d double, rep long, times long, x binary"))
    nodes = owned.groupBy("label", "cell").agg(F.max("d").alias("radius"), F.count("*").alias("n"))
    # only labels with centres have cells to visit, so this is bounded as they are
    radius = {(r["label"], r["cell"]): r["radius"] for r in nodes.where(F.col("label").isin(*centres.value) if centres.value else F.lit(False)).collect()}
    radii = spark.sparkContext.broadcast(radius)

    def visits():
        near = {label: unit(c) for label, c in centres.value.items()}

        def rows(c):
            for label, cell, d, rep, times, x in zip(*c):
                yield label, cell, 0, rep, times, x
                if label in near and near[label].shape[1] * 8 == len(x):
                    all_d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (near[label] @ unit([x])[0])))
                    for k in range(cell + 1, len(all_d)):
                        r = radii.value.get((label, k))
                        if r is not None and all_d[k] - r <= eps and all_d[k] <= d + 2 * eps:
                            yield label, k, 1, rep, times, x

        return rows

    placed = map_rows(owned.select("label", "cell", "d", "rep", "times", "x"), visits, "label string, cell int, side int, rep long, times long, x binary")
    # blocks by hash: members 0 .. m-1, visitors m .. m+v-1; member blocks meet each other
    # and all visitor blocks. Numbers of blocks follow from counts.
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)) / BLOCK).cast("int").alias("m"),
        F.ceil(F.sum("side") / BLOCK).cast("int").alias("v"),
    )
    b = placed.join(sizes, ["label", "cell"])
    h = F.xxhash64("rep")
    b = b.withColumn("block", F.when(F.col("side") == 0, F.pmod(h, F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(h, F.greatest("v", F.lit(1)))).cast("int"))
    last = F.col("m") + F.col("v") - 1
    lower = F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("m")) - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))
    upper = F.when((F.col("side") == 0) & (F.col("block") < last), F.transform(F.sequence(F.col("block") + 1, last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    own = F.when(F.col("side") == 0, F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    pairs = F.concat(F.coalesce(own, none), F.coalesce(lower, none), F.coalesce(upper, none))
    return b.select("label", "cell", F.explode(pairs).alias("p"), "rep", "times", "x").select("label", "cell", "p.i", "p.j", "p.side", "rep", "times", "x")


def links(reps: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links of a spanning forest (n null), or counts of a's links (b null)."""
    key = ["label", "cell", "i", "j"]
    ordered = _dealt(reps, cosine).repartition(*key).sortWithinPartitions(*key)

    def find(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_pydict({k: pa.array(c, pa.int64()) for k, c in zip("abn", zip(*rows))})

        now, group = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for *k, side, rep, times, x in zip(*(c.to_pylist() for c in batch.slice(at, 2048).columns)):
                    if k != now:
                        if len(group) > 1 and (found := list(compare(*map(list, zip(*group)), cosine))):
                            yield out(found)
                        now, group = k, []
                    group.append((rep, times, x, side))
        if len(group) > 1 and (found := list(compare(*map(list, zip(*group)), cosine))):
            yield out(found)

    return ordered.select(*key, "side", "rep", "times", "x").mapInArrow(find, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, and rep_id (the smallest id of equal vectors)."""
    valid = cut(points(vectors))
    found = valid.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    reps = cut(valid.join(found, ["label", "key"]).where("vec_id = rep").dropDuplicates(["label", "key"]).select("label", "key", "rep", "times", "x"))
    made = cut(links(reps, cosine))
    reached = components(made.where("b is not null").select("a", "b"))
    counted = made.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    about = found.join(counted, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("label", "key", "rep", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    each = valid.select("vec_id", "label", "key").join(about, ["label", "key"]).select("vec_id", "n_links", "component", "rep")
    # every row, valid or not; an id may repeat
    valid_by_id = each.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"), F.min("rep").alias("rep"))
    rows = vectors.select("vec_id").join(valid_by_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("rep", "vec_id").alias("rep_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
