"""Events to the volume table: which frame of which recording belongs to which trial."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from onsetlab.functions import entities, entity, entity_names, volume_range
from onsetlab.operators import observed

#: Names of administrative rows, as whole names and as parts of names.
ADMIN_EXACT = ("start_block", "end_block")
ADMIN_PARTS = ("fixation", "postrt")
REQUIRED = ("sub", "task", "run")
#: Entities that have columns of their own.
HANDLED = ("sub", "ses", "task", "run")


def parse_entities(files: DataFrame, path: str = "eventfile") -> DataFrame:
    """Adds a map column of the name's entities."""
    return files.withColumn("entities", entities(F.col(path)))


def require_entities(files: DataFrame, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Files with all required entities and a run number, and the others with the reason."""
    lacking = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.map_contains_key("entities", k))
    run_ok = F.expr("try_cast(entities['run'] as int)").isNotNull()
    reason = F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ","))).when(~run_ok, F.lit("run is no number"))
    told = files.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def promote_entities(files: DataFrame, names: list[str]) -> DataFrame:
    """Named entities as columns; session is empty where there is none."""
    out = files
    for n in names:
        out = out.withColumn(n, F.col("entities")[n])
    return out.withColumn("session", F.coalesce(F.col("entities")["ses"], F.lit("")))


#: What counts as a number in a text.
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def coerce(events: DataFrame, *columns: str) -> DataFrame:
    """Numbers from text; what is no number is null."""
    kinds = dict(events.dtypes)
    for c in columns or ("onset", "duration"):
        number = F.col(c).try_cast("double")
        events = events.withColumn(c, F.when(F.col(c).rlike(NUMBER), number) if kinds[c] == "string" else number)
    return events


def not_admin(exact=ADMIN_EXACT, parts=ADMIN_PARTS) -> Column:
    """Whether trial_type is none of the administrative rows; a null one isn't."""
    low = F.lower("trial_type")
    hit = low.isin(*exact)
    for p in parts:
        hit = hit | low.contains(p)
    return ~F.coalesce(hit, F.lit(False))


def valid() -> Column:
    """Finite onset and duration."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return finite("onset") & finite("duration")


def number_trials(events: DataFrame, key: str = "eventfile", tiebreak: str = "event_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy("onset", tiebreak)
    return events.withColumn("trial_index", F.row_number().over(order))


def match_recordings(files: DataFrame, recordings: DataFrame, template: str | None = None) -> DataFrame:
    """Event files with every recording (boldfile) that is theirs, null
    for none. The rule without a template: the recording's name has ``bold`` and the file's
    sub, task, run and, if it has one, ses. A template is a path with ``{subject}``, ``{session}``,
    ``{task}``, ``{run}`` or any entity in braces, and ``*``, ``?`` and ``**`` as in a file search;
    it is compared with the end of the path. Both sides meet on the subject."""
    name = F.regexp_extract("boldfile", r"([^/]*)$", 1)
    own = lambda k: entity(F.col("eventfile"), k)
    theirs = lambda k: entity(F.col("boldfile"), k)
    r = recordings.select("boldfile", name.alias("name"), theirs("sub").alias("sub"))
    f = files.select("eventfile").distinct().withColumn("sub", own("sub"))
    if template is None:
        same = F.contains("name", F.lit("bold")) & (own("task") == theirs("task")) & (own("run") == theirs("run")) & (own("ses").isNull() | own("ses").eqNullSafe(theirs("ses")))
    else:
        alias = {"subject": own("sub"), "session": F.coalesce(own("ses"), F.lit("")), "task": own("task"), "run": own("run")}
        parts = []
        for text, key in re.findall(r"([^{]+)|\{(\w+)\}", template):
            if key:
                value = alias.get(key, own(key))
                parts.append(F.concat(F.lit(r"\Q"), value, F.lit(r"\E")))
            else:
                wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
                parts.append(F.lit("".join(wild.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|[*?]|[^*?]+", text))))
        same = F.coalesce(F.rlike("boldfile", F.concat(F.lit("(?:^|/)"), *parts, F.lit("$"))), F.lit(False))
    hits = f.join(r, "sub").where(same).select("eventfile", "boldfile")
    return f.select("eventfile").join(hits, "eventfile", "left")


def one_recording(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event files with just one recording, and the others (eventfile, n, reason)."""
    counted = matched.groupBy("eventfile").agg(F.count("boldfile").alias("n"), F.min("boldfile").alias("boldfile"))
    told = counted.withColumn("reason", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous"))
    return told.where("n = 1").select("eventfile", "boldfile"), told.where("n <> 1").select("eventfile", "n", "reason")


def study_volumes(events: DataFrame, recordings: DataFrame, lag: float = 0.0, template: str | None = None, exact=ADMIN_EXACT, parts=ADMIN_PARTS) -> tuple[DataFrame, DataFrame]:
    """From event rows (eventfile, event_id, onset, duration, trial_type) to the volume table, and
    the files that were skipped (eventfile, reason). Further entities of the files' names are
    columns of their own, null where a name lacks one."""
    own = lambda k: entity(F.col("eventfile"), k)
    lacking = F.array_compact(F.array(*(F.when(own(k).isNull(), k) for k in REQUIRED)))
    reason = F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ","))).when(own("run").try_cast("int").isNull(), F.lit("run is no number"))
    files = events.select("eventfile").distinct().withColumn("reason", reason)
    right, wrong = files.where("reason is null").select("eventfile"), files.where("reason is not null")
    one, other = one_recording(match_recordings(right, recordings, template))
    # one row for each entity that any name has
    found = right.select(F.explode(entity_names(F.col("eventfile"))).alias("k")).distinct().collect()
    names = sorted(r["k"] for r in found if r["k"] not in HANDLED)
    about = right.join(one, "eventfile").select("eventfile", "boldfile", own("sub").alias("subject"), F.coalesce(own("ses"), F.lit("")).alias("session"), own("task").alias("task"), own("run").cast("int").alias("run"), *(own(k).alias(k) for k in names))
    volumes = build_volumes(events.join(about, "eventfile"), recordings, lag, exact, parts, "eventfile")
    return volumes, wrong.select("eventfile", "reason").unionByName(other.select("eventfile", "reason"))


def build_volumes(events: DataFrame, recordings: DataFrame, lag: float = 0.0, exact=ADMIN_EXACT, parts=ADMIN_PARTS, key: str = "boldfile", tiebreak: str = "event_id") -> DataFrame:
    """One row per event and active frame. Trials keep their number if they have no frame.

    One shuffle on the file's key serves the numbering; recordings join on the same side
    by broadcast where Spark finds them small."""
    kept = number_trials(events.where(not_admin(exact, parts) & valid()), key, tiebreak)
    start = F.col("onset") + F.lit(float(lag))
    timed = kept.join(recordings.select("boldfile", "tr", "n_frames"), "boldfile").withColumn("start", start).withColumn("stop", F.col("start") + F.col("duration"))
    first, after = volume_range(F.col("start"), F.col("stop"), F.col("tr"), F.col("n_frames"))
    ranged = timed.withColumn("first", first).withColumn("after", after).where("after > first")
    exploded = ranged.withColumn("volume_of_interest", F.explode(F.sequence("first", F.col("after") - 1)))
    return exploded.drop("start", "stop", "first", "after", "tr", "n_frames")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Tables with differing extra columns as one, in the order of the volume table's file."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy("subject", "task", "run", "volume_of_interest")


def expected_diff(observed: DataFrame, expected: DataFrame, column: str = "trial_type") -> DataFrame:
    """Values that only one side has: (value, side); nulls don't count."""
    a = observed.select(F.col(column).alias("value")).where("value is not null").distinct()
    b = expected.select(F.col(column).alias("value")).where("value is not null").distinct()
    unexpected = a.join(b, "value", "left_anti").withColumn("side", F.lit("unexpected"))
    return unexpected.unionByName(b.join(a, "value", "left_anti").withColumn("side", F.lit("missing")))


def usable(column: str = "volume_of_interest") -> Column:
    """A finite frame number."""
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def drop_bad_volumes(volumes: DataFrame, column: str = "volume_of_interest") -> DataFrame:
    return volumes.where(usable(column))


def drop_bad_volumes_counted(volumes: DataFrame, column: str = "volume_of_interest") -> tuple[DataFrame, Observation]:
    """As drop_bad_volumes, with an observation of how many rows it drops."""
    return observed.kept(volumes, usable(column))


def of_subject(volumes: DataFrame, subject: str) -> DataFrame:
    out = volumes.where(F.col("subject") == subject)
    if out.isEmpty():
        raise ValueError(f"no rows of subject {subject}")
    return out


def trial_pivot(volumes: DataFrame, keys: list[str], width: int | None = None, carried: list[str] = ()) -> DataFrame:
    """One row per event, its volumes ascending in vol_of_interest_1 .. width; missing ones are
    null. Without a width it is that of the event with most volumes, so that none is lost."""
    width = widest(volumes, keys) if width is None else width
    each = volumes.groupBy(*keys).agg(*(F.min(c).alias(c) for c in carried), F.sort_array(F.collect_list("volume_of_interest")).alias("v"))
    return each.select(*keys, *carried, *(F.get("v", F.lit(i)).alias(f"vol_of_interest_{i + 1}") for i in range(width)))


def widest(volumes: DataFrame, keys: list[str]) -> int:
    """Most volumes of an event."""
    return volumes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def single_volume(events: DataFrame, recordings: DataFrame, lag: float) -> DataFrame:
    """The frame nearest to each event's shifted onset, clipped to the recording."""
    near = F.rint((F.col("onset") + F.lit(float(lag))) / F.col("tr")).cast("long")
    timed = events.join(recordings.select("boldfile", "tr", "n_frames"), "boldfile")
    return timed.withColumn("volume", F.least(F.greatest(near, F.lit(0)), F.col("n_frames") - 1)).drop("tr", "n_frames")


def recording_lookup(files: DataFrame, recordings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files with exactly one recording of equal entities; the others with the reason."""
    matched = files.join(recordings.select(*keys, "boldfile"), keys, "left")
    return one_recording(matched)
