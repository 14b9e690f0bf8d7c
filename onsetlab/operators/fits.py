"""Many linear classifiers at once: logistic regressions and linear SVMs by key.

A *problem* is one classifier: of a fold, of a permutation, or of a whole key. All problems
of a key share its rows: each row has its features once and, beside them, an array of codes with
its class in each problem (-1 where a problem doesn't train on the row). Problems go in chunks, whose
products with a block of rows are one batched matrix product.

An optimiser (L-BFGS over a chunk's problems, preconditioned by a bound of the curvature) asks for
sums over rows: class counts first, then curvature, then losses and gradients. Where a
key's rows are one block (at most BLOCK_BYTES), the task that holds it runs the optimiser
to its end, so all such keys are one job. Keys with more blocks write them once; then
each step is one job for all of them, which adds up the blocks' sums by key in the shuffle, and chunks
that have converged take no part in the next. The number of jobs depends on the steps, never on the number of keys.

The loss of a logistic regression is the mean over rows, weighted so that classes count
alike, plus |w|^2 / (2 C n); that of a class's SVM is its squared hinge against the rest,
C times, plus |w|^2 / 2 with the intercept in w.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from onsetlab.operators.patterns import upper_tail
from onsetlab.sources.store import settled

FITTED = ("logistic_regression", "linear_svc")
#: Bytes of features in a block of rows, and of a chunk's features side by side.
BLOCK_BYTES, STACK_BYTES = 64_000_000, 48_000_000
#: Problems of a chunk at most.
CHUNK = 64
#: The curvature is a whole matrix up to so many features, else its diagonal.
WHOLE_CURVATURE = 512
HISTORY = 10


def check(name: str) -> None:
    if name not in FITTED:
        raise ValueError(f"unknown classifier {name!r}; fitted are {FITTED}")


class Lbfgs:
    """Minimises many functions at once: ``point`` is where each wants its value and gradient next."""

    def __init__(self, x: np.ndarray, inverse, tol: float, steps: int):
        self.x = self.point = x
        self.inverse, self.tol, self.left = inverse, tol, steps
        self.f = self.g = self.d = None
        self.t = np.ones(len(x))
        self.tries = np.zeros(len(x), int)
        self.s, self.y, self.rho = [], [], []
        self.done = np.zeros(len(x), bool)

    def tell(self, f: np.ndarray, g: np.ndarray) -> None:
        dot = lambda a, b: np.einsum("bi,bi->b", a, b)
        if self.f is None:
            self.f, self.g = f.copy(), g.copy()
            moved = ~self.done
        else:
            ok = (f <= self.f + 1e-4 * self.t * dot(self.g, self.d) + 1e-13 * np.abs(self.f)) & ~self.done
            s, y = self.point - self.x, g - self.g
            curved = dot(s, y)
            use = ok & (curved > 1e-14)
            self.s.append(np.where(use[:, None], s, 0))
            self.y.append(np.where(use[:, None], y, 0))
            self.rho.append(np.divide(1.0, curved, out=np.zeros_like(curved), where=use))
            self.s, self.y, self.rho = self.s[-HISTORY:], self.y[-HISTORY:], self.rho[-HISTORY:]
            still = ok & (np.abs(self.f - f) <= 1e-15 * np.abs(self.f))
            self.x = np.where(ok[:, None], self.point, self.x)
            self.f, self.g = np.where(ok, f, self.f), np.where(ok[:, None], g, self.g)
            self.tries = np.where(ok, 0, self.tries + 1)
            self.t = np.where(ok, 1.0, self.t / 2)
            self.done |= still | (self.tries > 30)
            moved = ok
        self.left -= 1
        self.done |= (np.abs(self.g).max(axis=1, initial=0) <= self.tol) | (self.left <= 0)
        if moved.any():
            d = self._direction()
            up = dot(d, self.g) >= 0
            d[up] = -self.g[up]
            self.d = d if self.d is None else np.where(moved[:, None], d, self.d)
        self.point = np.where(self.done[:, None], self.x, self.x + self.t[:, None] * self.d)

    def _direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y, rho in zip(reversed(self.s), reversed(self.y), reversed(self.rho)):
            a = rho * np.einsum("bi,bi->b", s, q)
            q -= a[:, None] * y
            kept.append(a)
        r = self.inverse(q)
        for s, y, rho, a in zip(self.s, self.y, self.rho, reversed(kept)):
            r += s * (a - rho * np.einsum("bi,bi->b", y, r))[:, None]
        return -r


class Inverse:
    """Application of each problem's inverse curvature to each of its classes."""

    def __init__(self, curvature: np.ndarray, classes: int):
        self.classes, self.whole = classes, curvature.ndim == 3
        self.of = np.linalg.inv(curvature) if self.whole else 1.0 / curvature

    def __call__(self, q: np.ndarray) -> np.ndarray:
        by_class = q.reshape(len(self.of), self.classes, -1)
        return (by_class @ self.of if self.whole else by_class * self.of[:, None, :]).reshape(q.shape)


class Block:
    """Rows of a key: features, and classes by problem."""

    def __init__(self, x: np.ndarray, codes: np.ndarray):
        self.x, self.codes = x, codes
        self._stack: tuple[np.ndarray, np.ndarray] | None = None

    def groups(self, idx: np.ndarray, problems: np.ndarray):
        """(problems, their chosen features beside each other and a column of ones) within STACK_BYTES."""
        each = 8 * max(1, len(self.x)) * (idx.shape[1] + 1)
        size = max(1, STACK_BYTES // each)
        if self._stack is not None and 2 * len(problems) > len(self._stack[0]) and np.isin(problems, self._stack[0]).all():
            yield self._stack
            return
        self._stack = None
        padded = np.concatenate([self.x, np.zeros((len(self.x), 1))], axis=1)  # the last column stands for no feature
        for at in range(0, len(problems), size):
            own = problems[at : at + size]
            stack = np.ones((len(own), len(self.x), idx.shape[1] + 1))
            stack[:, :, :-1] = padded[:, idx[own]].transpose(1, 0, 2)
            if size >= len(problems):
                self._stack = (own, stack)
            yield own, stack


def f_values(counts: np.ndarray, totals: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F of each feature (problems x features) from class counts and sums, and its degrees of freedom."""
    n, k = counts.sum(axis=1), (counts > 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = (np.square(totals) / np.maximum(counts, 1)[:, :, None]).sum(axis=1)
        between = b - np.square(totals.sum(axis=1)) / np.maximum(n, 1)[:, None]
        error = (squares - b) / (n - k)[:, None]
        f = np.where(error > 0, between / (k - 1)[:, None] / error, np.where(between > 0, np.inf, np.nan))
    f[(k < 2) | (n <= k)] = np.nan
    return f, k - 1, n - k


class Chunk:
    """The state of a chunk's fits. It asks for sums over rows (of_block) and goes on by them (advance)."""

    def __init__(self, first: int, n_problems: int, n_classes: int, width: int, name: str, params: dict, idx: list | None, select: tuple | None):
        self.first, self.p, self.k, self.width, self.name, self.params, self.select = first, n_problems, n_classes, width, name, params, select
        self.at = first  # of its problems in the codes of rows
        self.idx = None if idx is None else self._padded(idx)
        self.phase, self.best, self.done = "classes", None, False

    def _padded(self, idx: list) -> np.ndarray:
        out = np.full((len(idx), max(map(len, idx), default=0)), self.width)
        for k, own in enumerate(idx):
            out[k, : len(own)] = own
        return out

    def own(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, self.at : self.at + self.p]

    # -- sums over a block

    def of_block(self, block: Block) -> np.ndarray:
        """What the present phase needs of the block's rows, flat."""
        return np.concatenate([np.asarray(a, float).reshape(-1) for a in getattr(self, f"_{self.phase}")(block)])

    def _classes(self, block: Block):
        y = self.own(block.codes)
        hot = y.T[:, None, :] == np.arange(self.k)[None, :, None]  # problems x classes x rows
        parts = [hot.sum(axis=2)]
        if self.select:
            parts += [hot.astype(float) @ block.x, (y.T >= 0).astype(float) @ np.square(block.x)]
        return parts

    def _weights(self, y: np.ndarray) -> np.ndarray:
        """Weight of each row in some problems: classes count alike, rows outside not at all."""
        w = self.class_weight[:, None, :] if y.ndim == 3 else self.class_weight
        return np.where(y >= 0, np.take_along_axis(w, np.maximum(y, 0), axis=1), 0.0)

    def _curvature(self, block: Block):
        out = np.zeros((self.p, self.d1, self.d1) if self.whole else (self.p, self.d1))
        y = self.own(block.codes).T
        w = self._weights(y)
        for own, x in block.groups(self.idx, self.active()):
            out[own] = (x * w[own][:, :, None]).transpose(0, 2, 1) @ x if self.whole else np.einsum("bnd,bn->bd", np.square(x), w[own])
        return [out]

    def _step(self, block: Block):
        logistic = self.name == "logistic_regression"
        f = np.zeros(self.p if logistic else (self.p, self.k))
        g = np.zeros((self.p, self.k, self.d1))
        y = self.own(block.codes).T
        points = self.best.point.reshape(self.p, self.k, self.d1)
        for own, x in block.groups(self.idx, self.active()):
            score = x @ points[own].transpose(0, 2, 1)  # problems x rows x classes
            at, inside = np.maximum(y[own], 0)[:, :, None], y[own] >= 0
            if logistic:
                w = self._weights(y)[own]
                score += np.where(self.trained[own], 0.0, -np.inf)[:, None, :]
                top = score.max(axis=2, keepdims=True)
                e = np.exp(score - top)
                total = e.sum(axis=2, keepdims=True)
                # rows that a problem doesn't train on may be of a class it doesn't have
                gap = np.where(inside, np.log(total[:, :, 0]) + top[:, :, 0] - np.take_along_axis(score, at, 2)[:, :, 0], 0.0)
                f[own] = (w * gap).sum(axis=1)
                e /= total
                np.put_along_axis(e, at, np.take_along_axis(e, at, 2) - 1, 2)
                g[own] = (e * w[:, :, None]).transpose(0, 2, 1) @ x
            else:
                sign = np.where(np.arange(self.k) == y[own][:, :, None], 1.0, -1.0)
                cost = np.where(sign > 0, self.cost[own][:, None, :, 0], self.cost[own][:, None, :, 1]) * inside[:, :, None]
                short = np.maximum(0.0, 1 - sign * score)
                f[own] = (cost * np.square(short)).sum(axis=1)
                g[own] = (-2 * cost * sign * short).transpose(0, 2, 1) @ x
        return [f, g]

    # -- what follows from the sums over all rows

    def active(self) -> np.ndarray:
        if self.best is None:
            return np.arange(self.p)
        still = ~self.best.done
        return np.flatnonzero(still if self.name == "logistic_regression" else still.reshape(self.p, self.k).any(axis=1))

    def advance(self, sums: np.ndarray) -> None:
        getattr(self, f"_after_{self.phase}")(np.asarray(sums, float))

    def _after_classes(self, sums: np.ndarray) -> None:
        self.counts = sums[: self.p * self.k].reshape(self.p, self.k)
        if self.select:
            size = self.p * self.k * self.width
            totals = sums[self.counts.size : self.counts.size + size].reshape(self.p, self.k, self.width)
            f, between, within = f_values(self.counts, totals, sums[self.counts.size + size :].reshape(self.p, self.width))
            how, much = self.select
            if how == "best":
                order = np.argsort(np.where(np.isnan(f), np.inf, -f), axis=1, kind="stable")
                self.idx = np.sort(order[:, : int(much)], axis=1)
            else:
                p = np.stack([upper_tail(np.maximum(a, 0.0), np.full(self.width, float(max(b, 0))), np.full(self.width, float(max(w, 0)))) for a, b, w in zip(f, between, within)])
                self.idx = self._padded([np.flatnonzero(np.where(np.isnan(x), 1.0, x) < much) for x in p])
        self.trained = self.counts > 0
        n, k = self.counts.sum(axis=1), self.trained.sum(axis=1)
        self.n = np.maximum(n, 1)
        self.class_weight = np.divide(n[:, None], k[:, None] * self.counts, out=np.zeros_like(self.counts), where=self.trained)
        self.d1 = self.idx.shape[1] + 1
        self.whole = self.d1 <= WHOLE_CURVATURE
        c = float(self.params.get("C", 1.0))
        # two classes have one vector, whose square counts once: half of what two of opposite sign count
        self.reg = np.where(k == 2, 2.0, 1.0) / (c * self.n)
        # the rest of one class weighs 1; with two classes each has its own weight
        rest = np.where(k[:, None] == 2, (self.class_weight * self.trained).sum(axis=1, keepdims=True) - self.class_weight, 1.0)
        self.cost = c * np.stack([self.class_weight, rest], axis=2)
        self.phase = "curvature"
        self.done = not (k > 1).any()

    def _after_curvature(self, sums: np.ndarray) -> None:
        h = sums.reshape((self.p, self.d1, self.d1) if self.whole else (self.p, self.d1))
        logistic = self.name == "logistic_regression"
        h = h / (2 * self.n.reshape(-1, *(1,) * (h.ndim - 1))) if logistic else 2 * h
        add = np.tile((self.reg if logistic else np.ones(self.p))[:, None], (1, self.d1))
        if logistic:
            add[:, -1] = 1e-6
        none = np.concatenate([self.idx == self.width, np.zeros((self.p, 1), bool)], axis=1)
        add[none] += 1.0
        h = h + add[:, :, None] * np.eye(self.d1) if self.whole else h + add
        tol, steps = float(self.params.get("tol", 1e-7)), int(self.params.get("max_iter", 5000))
        classes = self.k if logistic else 1
        if not logistic:
            h = np.repeat(h, self.k, axis=0)
        size = classes * self.d1
        self.best = Lbfgs(np.zeros((self.p if logistic else self.p * self.k, size)), Inverse(h, classes), tol, steps)
        unfit = (self.trained.sum(axis=1) < 2) | (self.idx == self.width).all(axis=1)
        self.best.done |= unfit if logistic else np.repeat(unfit, self.k) | ~self.trained.reshape(-1)
        self.phase = "step"
        self.done = bool(self.best.done.all())

    def _after_step(self, sums: np.ndarray) -> None:
        logistic = self.name == "logistic_regression"
        n_f = self.p if logistic else self.p * self.k
        f, g = sums[:n_f], sums[n_f:].reshape(self.p, self.k, self.d1)
        w = self.best.point.reshape(self.p, self.k, self.d1)
        if logistic:
            inner = np.concatenate([w[:, :, :-1], np.zeros((self.p, self.k, 1))], axis=2)  # the intercept is free
            f = f / self.n + self.reg / 2 * np.square(inner).sum(axis=(1, 2))
            g = (g / self.n[:, None, None] + self.reg[:, None, None] * inner) * self.trained[:, :, None]
            self.best.tell(f, g.reshape(self.p, -1))
        else:
            self.best.tell(f + np.square(w).sum(axis=2).reshape(-1) / 2, (g + w).reshape(self.p * self.k, -1))
        self.done = bool(self.best.done.all())

    def results(self):
        """(problem, class, weights, intercept, chosen features) of each trained class."""
        for p in range(self.p):
            trained = np.flatnonzero(self.trained[p])
            if len(trained) < 2:
                continue
            kept = self.idx[p] < self.width
            w = self.best.x.reshape(self.p, self.k, self.d1)[p] if self.best is not None else np.zeros((self.k, self.d1))
            if len(trained) == 2:  # the one value points to the second
                one = w[trained[1]] - w[trained[0]] if self.name == "logistic_regression" else w[trained[1]]
                w = w.copy()
                w[trained[0]], w[trained[1]] = -one, one
            elif self.name == "logistic_regression":
                w = w - np.where(np.arange(self.d1) == self.d1 - 1, w[trained].mean(axis=0), 0.0)  # intercepts add up to 0
            for c in trained:
                weights = w[c][:-1][kept]
                yield self.first + p, int(c), weights.tolist(), float(w[c][-1]) if len(weights) else 0.0, self.idx[p][kept].tolist()


# ---- by key on Spark


def fit_many(rows: DataFrame, keys: list[str], categories: list[str], name: str = "logistic_regression", params: dict | None = None, chosen: DataFrame | None = None, select: tuple | None = None, threshold: DataFrame | None = None) -> DataFrame:
    """(keys, problem, label, weights, intercept, voxel_idx) of all problems of all keys.

    rows: keys, features, codes (the row's class number in each problem, -1 for none). Features are
    those of ``chosen`` (keys, problem, voxel_idx), or chosen anew in each problem by ``select``: ("best", n) by F,
    or ("below", p), where ``threshold`` (keys, threshold) may give each key its own p; else all."""
    check(name)
    keys, params, k = list(keys), dict(params or {}), len(categories)
    about = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.max(F.size("codes")).alias("problems"))
    # so few problems that their class sums, or all their features side by side, are bounded
    per = F.greatest(F.lit(1), F.least(F.lit(CHUNK), (F.lit(STACK_BYTES) / (8 * k * F.greatest("width", F.lit(1)))).cast("int")))
    about = about.withColumn("per", per).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("width") * 8 / BLOCK_BYTES)).cast("int"))
    about = settled(about)
    chunks = about.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("problems") / F.col("per")).cast("int") - 1)))
    if threshold is not None:
        chunks = chunks.join(threshold.select(*keys, "threshold"), keys, "left")
    if chosen is not None:
        own = chosen.join(about.select(*keys, "per"), keys).groupBy(*keys, F.floor(F.col("problem") / F.col("per")).cast("int").alias("chunk"))
        chunks = chunks.join(own.agg(F.collect_list(F.struct("problem", "voxel_idx")).alias("given")), [*keys, "chunk"], "left")
    kinds = dict(rows.dtypes)
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    has_threshold, has_chosen = threshold is not None, chosen is not None

    def begin(r) -> Chunk:
        first, p = int(r["chunk"]) * int(r["per"]), min(int(r["per"]), int(r["problems"]) - int(r["chunk"]) * int(r["per"]))
        how, idx = select, None
        if has_threshold and r["threshold"] is not None:
            how = (select[0], float(r["threshold"]))
        if has_chosen:
            of = {x["problem"]: x["voxel_idx"] for x in (r["given"] if r["given"] is not None else ())}
            idx = [np.sort(np.asarray(of.get(first + q, ()), int)) for q in range(p)]
        elif how is None:
            idx = [np.arange(int(r["width"]))] * p
        return Chunk(first, p, k, int(r["width"]), name, params, idx, how)

    out_schema = f"{key_schema}, problem int, label string, weights array<double>, intercept double, voxel_idx array<int>"

    def shown(key: tuple, state: Chunk) -> pd.DataFrame:
        made = [(*key, p, categories[c], w, b, idx) for p, c, w, b, idx in state.results()]
        return pd.DataFrame(made, columns=[*keys, "problem", "label", "weights", "intercept", "voxel_idx"])

    def whole(key, state_rows, pdf):
        if not len(pdf) or not len(state_rows):
            return shown(tuple(key[:-1]), _none(k))
        state, block = begin(state_rows.iloc[0]), _block(pdf)
        state.at = 0
        while not state.done:
            state.advance(state.of_block(block))
        return shown(tuple(key[:-1]), state)

    # a key's chunks are further problems of the same rows, each with its own codes alone
    spread = rows.select(*keys, "features", "codes").join(about.where("blocks = 1").select(*keys, "problems", "per"), keys)
    spread = spread.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("problems") / F.col("per")).cast("int") - 1)))
    spread = spread.select(*keys, "chunk", "features", F.slice("codes", F.col("chunk") * F.col("per") + 1, F.col("per")).alias("codes"))
    by = [*keys, "chunk"]
    small = chunks.where("blocks = 1")
    small = small.toDF(*small.columns)  # its keys come from the same rows
    out = small.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(whole, out_schema)
    large = chunks.where("blocks > 1")
    if large.isEmpty():
        return settled(out)
    return settled(out.unionByName(_by_steps(rows, about, large, keys, key_schema, begin, shown, out_schema)))


def _none(k: int) -> Chunk:
    state = Chunk(0, 0, k, 0, FITTED[0], {}, [], None)
    state.trained = np.zeros((0, k), bool)
    return state


def _block(pdf: pd.DataFrame) -> Block:
    return Block(np.array(pdf["features"].tolist(), float), np.array(pdf["codes"].tolist(), np.int64))


def _by_steps(rows: DataFrame, about: DataFrame, chunks: DataFrame, keys: list[str], key_schema: str, begin, shown, out_schema: str) -> DataFrame:
    """Fits of keys with several blocks: blocks are written once, each step is a job over them."""
    dealt = rows.select(*keys, "features", "codes").join(about.where("blocks > 1").select(*keys, "blocks"), keys)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("features", "codes", F.monotonically_increasing_id()), F.col("blocks")).cast("int"))

    def packed(key, pdf):
        return pd.DataFrame([(*key, pickle.dumps(_block(pdf)))], columns=[*keys, "block", "data"])

    blocks = settled(dealt.select(*keys, "block", "features", "codes").groupBy(*keys, "block").applyInPandas(packed, f"{key_schema}, block int, data binary"))
    by = [*keys, "chunk"]
    state_schema = f"{key_schema}, chunk int, state binary, active boolean"

    def started(batches):
        for pdf in batches:
            yield pd.DataFrame([(*(r[c] for c in by), pickle.dumps(begin(r)), True) for _, r in pdf.iterrows()], columns=[*by, "state", "active"])

    def sums(batches):
        for pdf in batches:
            made = [pickle.loads(s).of_block(pickle.loads(d)) for s, d in zip(pdf["state"], pdf["data"])]
            yield pdf[by].assign(sums=made)

    def advanced(batches):
        for pdf in batches:
            out = []
            for s, total in zip(pdf["state"], pdf["total"]):
                state = pickle.loads(s)
                state.advance(total)
                out.append((pickle.dumps(state), not state.done))
            yield pdf[by].assign(state=[a for a, _ in out], active=[b for _, b in out])

    states = settled(chunks.mapInPandas(started, state_schema))
    finished = []
    while True:
        pairs = states.join(blocks, keys).select(*by, "state", "data")
        each = pairs.mapInPandas(sums, f"{key_schema}, chunk int, sums array<double>")
        total = each.groupBy(*by).agg(Summarizer.metrics("sum").summary(array_to_vector("sums")).alias("s")).select(*by, vector_to_array("s.sum").alias("total"))
        seen = Observation()
        after = states.select(*by, "state").join(total, by).mapInPandas(advanced, state_schema)
        states = settled(after.observe(seen, F.count_if("active").alias("active"), F.count("*").alias("all")))
        left = seen.get
        if left["active"] < left["all"]:
            finished.append(states.where("not active"))
            states = states.where("active")
        if not left["active"]:
            break

    def told(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                yield shown(tuple(r[c] for c in keys), pickle.loads(r["state"]))

    every = finished[0]
    for f in finished[1:]:
        every = every.unionByName(f)
    return every.mapInPandas(told, out_schema)
