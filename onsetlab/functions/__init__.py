"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def volume_range(start: Column, stop: Column, tr: Column, n_frames: Column) -> tuple[Column, Column]:
    """First frame and the frame after the last of [start, stop) seconds: the count is
    rounded half to even and 1 at least; the end is clipped to the recording, the start is not."""
    first = F.floor(start / tr).cast("long")
    count = F.greatest(F.lit(1), F.rint((stop - start) / tr).cast("long"))
    return first, F.greatest(F.least(first + count, n_frames.cast("long")), first)


def safe_name(c: Column) -> Column:
    """A name with every character outside letters, digits, dot, underscore and hyphen replaced."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def space_tag(mni: Column) -> Column:
    """Name of the space of an importance map."""
    return F.when(mni, F.lit("mni")).otherwise(F.lit("unasserted"))


def entities(path: Column) -> Column:
    """Map of the key-value pairs in a file's base name; of a repeated key the last counts."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    pattern = F.lit(r"(?:^|_)([a-zA-Z]+)-([^_.]+)")
    keys, values = F.regexp_extract_all(name, pattern, F.lit(1)), F.regexp_extract_all(name, pattern, F.lit(2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def entity(path: Column, key: str) -> Column:
    """One entity of a file's base name, the last of its key; null where there is none."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/)(?:[^/]*_)?{key}-([^_./]+)[^/]*$", 1), F.lit(""))


def entity_names(path: Column) -> Column:
    """The keys of the entities in a file's base name, as an array."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(r"(?:^|_)([a-zA-Z]+)-[^_.]+"), F.lit(1)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, also where f uses it for each element of an array."""
    return F.transform(F.array(value), f)[0]


def total(x: Column) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def softmax(scores: Column) -> Column:
    """Of an array of numbers."""
    exps = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(total(e), lambda all_: F.transform(e, lambda x: x / all_)))


def decision_evidence(scores: Column, n_classes: int) -> Column:
    """Evidence from decision values: two classes give sigmoids of the single value, more a softmax."""
    if n_classes == 2:
        p = sigmoid(scores[0])
        return F.array(1.0 - p, p)
    return softmax(scores)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; a zero norm counts as 1."""

    def of(m: Column) -> Column:
        x, y = m["a"], m["b"]
        product = total(F.zip_with(a, b, lambda p, q: (p - x) * (q - y)))
        norms = F.sqrt(total(F.transform(a, lambda p: (p - x) * (p - x)))) * F.sqrt(total(F.transform(b, lambda q: (q - y) * (q - y))))
        return let(norms, lambda n: product / F.when(n == 0, 1.0).otherwise(n))

    return let(F.struct((total(a) / F.size(a)).alias("a"), (total(b) / F.size(b)).alias("b")), of)
