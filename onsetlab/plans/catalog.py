"""Registered queries: each operator over the views, and the same in SQL.

Numbers are rounded to six places on both sides, so that the order of summation
doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.functions import decision_evidence, safe_name
from onsetlab.operators import conditions as C
from onsetlab.operators import decoding as T
from onsetlab.operators import metrics as M
from onsetlab.operators import models
from onsetlab.operators import patterns as P
from onsetlab.operators import report as R
from onsetlab.operators import sampling as S
from onsetlab.operators import volumes as V
from onsetlab.operators import workflows
from onsetlab.plans import views as W
from onsetlab.sources import frames, images, tables
from onsetlab.sources.store import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- events to volumes


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    return V.build_volumes(W.trials(spark, d), W.recordings(spark, d), W.LAG, W.EXACT, W.PARTS)


@query(f"with {W.VOLUMES} select subject, session, task, run, trial_type, cast(trial_index as bigint) as trial_index, round(onset, 6) as onset, round(duration, 6) as duration, volume_of_interest, boldfile from v")
def volume_table(spark, d):
    return _volumes(spark, d).select("subject", "session", "task", "run", "trial_type", F.col("trial_index").cast("long").alias("trial_index"), r6("onset").alias("onset"), r6("duration").alias("duration"), "volume_of_interest", "boldfile")


NAME = "concat('d/sub-', subject, '_task-', task, case when event_id % 10 = 0 then '' else concat('_run-', cast(run as {text})) end, '_acq-', event_type, case when event_id % 3 = 0 then '_task-again' else '' end, '_events.tsv')"


@query(
    f"""with {W.TRIALS}, n as (select event_id, {NAME.format(text="varchar").replace("event_type", "trial_type")} as eventfile from t),
 e as (select *, regexp_extract_all(parse_filename(eventfile), '(?:^|_)([a-zA-Z]+)-([^_.]+)', 1) as ks, regexp_extract_all(parse_filename(eventfile), '(?:^|_)([a-zA-Z]+)-([^_.]+)', 2) as vs from n)
 select event_id, vs[len(ks) + 1 - list_position(list_reverse(ks), 'sub')] as sub, vs[len(ks) + 1 - list_position(list_reverse(ks), 'task')] as task,
 vs[len(ks) + 1 - list_position(list_reverse(ks), 'run')] as run, vs[len(ks) + 1 - list_position(list_reverse(ks), 'acq')] as acq,
 regexp_replace(eventfile, '[^A-Za-z0-9._-]', '_', 'g') as safe from e where list_contains(ks, 'run')"""
)
def entity_parse(spark, d):
    t = W.trials(spark, d).withColumn("eventfile", F.expr(NAME.format(text="string").replace("event_type", "trial_type")))
    right, _ = V.require_entities(V.parse_entities(t))
    return right.select("event_id", *(F.col("entities")[k].alias(k) for k in ("sub", "task", "run", "acq")), safe_name(F.col("eventfile")).alias("safe"))


@query(
    f"""with {W.TRIALS}, {W.RECORDINGS}, files as (select distinct boldfile as eventfile, user_id from t),
 rec as (select * from r where user_id % 11 <> 3 union all select * from r where user_id % 13 = 5)
 select eventfile, count(rec.boldfile) as n, case when count(rec.boldfile) = 0 then 'missing' when count(rec.boldfile) > 1 then 'ambiguous' else 'matched' end as reason
 from files left join rec using (user_id) group by eventfile"""
)
def recording_lookup(spark, d):
    files = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.concat(F.lit("rec-"), F.col("user_id").cast("string")).alias("eventfile")).distinct()
    r = W.recordings(spark, d)
    some = r.where("user_id % 11 <> 3").unionByName(r.where("user_id % 13 = 5"))
    matched, others = V.recording_lookup(files, some, ["user_id"])
    return matched.select("eventfile", F.lit(1).cast("long").alias("n"), F.lit("matched").alias("reason")).unionByName(others)


#: An event file for each recording; one in seven lacks a run; one in eleven has no first recording, one in thirteen has a second.
EVENT_FILE = "concat('in/sub-', subject, '/sub-', subject, '_task-', task, case when user_id % 7 = 5 then '' else concat('_run-', cast(user_id as {text})) end, case when user_id % 2 = 0 then concat('_dir-', cast(user_id % 3 as {text})) else '' end, '_events.tsv')"


@query(
    f"""with {W.TRIALS}, {W.RECORDINGS}, n as (select *, {EVENT_FILE.format(text="varchar")} as eventfile from t where user_id % 7 <> 5 and (case when user_id % 11 <> 3 then 1 else 0 end) + (case when user_id % 13 = 5 then 1 else 0 end) = 1),
 kept as (select n.*, tr, n_frames from n join r using (boldfile) where not coalesce(lower(trial_type) = 'error' or contains(lower(trial_type), 'sign'), false) and onset is not null and duration is not null),
 numbered as (select *, row_number() over (partition by eventfile order by onset, event_id) as trial_index, onset + 900.0::double as s0, (onset + 900.0::double) + duration as s1 from kept),
 ranged as (select *, cast(floor(s0 / tr) as bigint) as s, greatest(1, cast(round_even((s1 - s0) / tr, 0) as bigint)) as c from numbered)
 select eventfile, event_id, subject, session, task, user_id as run, case when user_id % 2 = 0 then cast(user_id % 3 as varchar) end as dir, cast(trial_index as bigint) as trial_index, unnest(range(s, greatest(least(s + c, n_frames), s))) as volume_of_interest from ranged"""
)
def study_volumes(spark, d):
    """Event rows with their file's name, entities, recording lookup by entities, and volumes, in one plan."""
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id").join(W.trials(spark, d), "event_id")
    events = t.select(F.expr(EVENT_FILE.format(text="string")).alias("eventfile"), "event_id", "onset", "duration", "trial_type")
    r = W.recordings(spark, d)
    subject, task = "lpad(cast(user_id % 5 as string), 2, '0')", "case when user_id % 2 = 0 then 'loc' else 'WM' end"
    named = r.withColumn("boldfile", F.expr(f"concat('out/sub-', {subject}, '_task-', {task}, '_run-', cast(user_id as string), '_desc-x_bold.nii.gz')"))
    twice = named.where("user_id % 13 = 5").withColumn("boldfile", F.regexp_replace("boldfile", "desc-x", "desc-y"))
    volumes, _ = V.study_volumes(events, named.where("user_id % 11 <> 3").unionByName(twice).drop("user_id"), W.LAG, None, W.EXACT, W.PARTS)
    return volumes.select("eventfile", "event_id", "subject", "session", "task", F.col("run").cast("long").alias("run"), "dir", F.col("trial_index").cast("long").alias("trial_index"), "volume_of_interest")


#: Texts that end, or begin, as no number does.
ODD_NUMBER = "case when event_id % 9 = 0 then 'n/a' when event_id % 9 = 1 then concat({0}, 'd') when event_id % 9 = 2 then concat('0x', {0}) when event_id % 9 = 3 then concat({0}, 'f') when event_id % 9 = 4 then concat(' +', {0}, 'e1 ') else {0} end"


@query(
    f"""with {W.TRIALS}, x as (select event_id, onset, {ODD_NUMBER.format("cast(round(duration, 3) as varchar)")} as text from t),
 c as (select event_id, onset, case when regexp_full_match(trim(text), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(ltrim(trim(text), '+') as double) end as duration from x)
 select event_id, round(duration, 6) as duration from c where duration is not null and isfinite(duration) and onset is not null"""
)
def coerce_numeric(spark, d):
    t = W.trials(spark, d).withColumn("duration", F.expr(ODD_NUMBER.format("cast(round(duration, 3) as string)")))
    return V.coerce(t, "duration").where(V.valid()).select("event_id", r6("duration").alias("duration"))


@query(f"with {W.TRIALS}, x as (select unnest(['click', 'view', 'nothing']) as value) (select distinct trial_type as value, 'unexpected' as side from t where trial_type is not null and trial_type not in (select value from x)) union all (select value, 'missing' as side from x where value not in (select trial_type from t where trial_type is not null))")
def expected_diff(spark, d):
    return V.expected_diff(W.trials(spark, d), tables.expected_values(spark, '{"expected_trial_types": ["click", "view", "nothing"]}'))


@query(f"with {W.VOLUMES} select event_id, volume_of_interest from v where subject = '01' and volume_of_interest % 10 <> 0")
def clean_and_subject(spark, d):
    v = _volumes(spark, d)
    bad = v.withColumn("volume_of_interest", F.when(F.col("volume_of_interest") % 10 == 0, float("nan")).otherwise(F.col("volume_of_interest").cast("double")))
    return V.of_subject(V.drop_bad_volumes(bad), "01").select("event_id", F.col("volume_of_interest").cast("long").alias("volume_of_interest"))


@query(f"with {W.VOLUMES}, g as (select boldfile, trial_index, min(trial_type) as trial_type, list_sort(list(volume_of_interest)) as a from v group by all) select boldfile, cast(trial_index as bigint) as trial_index, trial_type, array_to_string(a, ',') as volumes from g")
def trial_pivot(spark, d):
    """The pivot at the width of the widest event; its columns, as many as the data asks for, are shown as one text."""
    wide = V.trial_pivot(_volumes(spark, d), ["boldfile", "trial_index"], carried=["trial_type"])
    volumes = F.concat_ws(",", *(F.col(c).cast("string") for c in wide.columns if c.startswith("vol_of_interest_")))
    return wide.select("boldfile", F.col("trial_index").cast("long").alias("trial_index"), "trial_type", volumes.alias("volumes"))


@query(f"with {W.TRIALS}, {W.RECORDINGS} select event_id, least(greatest(cast(round_even((onset + 900.0::double) / tr, 0) as bigint), 0), n_frames - 1) as volume from t join r using (boldfile)")
def single_volume(spark, d):
    return V.single_volume(W.trials(spark, d), W.recordings(spark, d).drop("user_id"), W.LAG).select("event_id", F.col("volume").cast("long").alias("volume"))


# ---- conditions

CLICK = {"and": [{"column": "trial_type", "match": "exact", "value": "click"}, {"not": {"column": "task", "match": "exact", "value": "WM"}}]}
VIEW = {"or": [{"column": "trial_type", "match": "regex", "value": "vi.*"}, {"column": "run", "match": "in", "values": [2, 3]}]}
CONDITIONS = {"click": CLICK, "view": VIEW, "rest": {"not": {"column": "trial_type", "match": "exact", "value": "purchase"}}}
CLICK_SQL = "(coalesce(trial_type = 'click', false) and not coalesce(task = 'WM', false))"
VIEW_SQL = "(coalesce(regexp_full_match(trial_type, 'vi.*'), false) or coalesce(cast(run as varchar) in ('2', '3'), false))"
REST_SQL = "(not coalesce(trial_type = 'purchase', false))"
LABEL_SQL = f"case when {CLICK_SQL} then 'click' when {VIEW_SQL} then 'view' when {REST_SQL} then 'rest' end"


@query(f"with {W.TRIALS}, n as (select * replace (case when event_id % 7 = 0 then null else trial_type end as trial_type) from t) select event_id, {CLICK_SQL} as click, {VIEW_SQL} as view, {REST_SQL} as rest from n")
def query_dsl(spark, d):
    t = W.trials(spark, d).withColumn("trial_type", F.when(F.col("event_id") % 7 != 0, F.col("trial_type")))
    return t.select("event_id", *(C.condition(q).alias(k) for k, q in CONDITIONS.items()))


@query(f"with {W.VOLUMES}, l as (select *, {LABEL_SQL} as regressor_label from v) select event_id, volume_of_interest, regressor_label, coalesce(list_position(['click', 'view'], regressor_label), 0) as regressor from l where regressor_label is not null")
def label_codes(spark, d):
    labelled = C.class_codes(C.label_rows(_volumes(spark, d), CONDITIONS), ["click", "view"])
    return labelled.select("event_id", "volume_of_interest", "regressor_label", "regressor")


@query(f"with {W.TRIALS} select event_id, case when run in (1, 2) then 'early' when run in (5, 6) then 'late' end as overlay_label from t where run in (1, 2, 5, 6)")
def overlay_label(spark, d):
    overlay = {"early": {"column": "run", "match": "in", "values": [1, 2]}, "late": {"column": "run", "match": "in", "values": [5, 6]}}
    return C.label_rows(W.trials(spark, d), overlay, "overlay_label").select("event_id", "overlay_label")


@query(
    f"with {W.VOLUMES} select s.section, n.name, coalesce(sum(cast(case n.name when 'click' then {CLICK_SQL} when 'view' then {VIEW_SQL} else {REST_SQL} end as integer)), 0)::bigint as n "
    "from v, (select unnest(['training', 'testing']) as section) s, (select unnest(['click', 'view', 'rest']) as name) n group by all"
)
def condition_counts(spark, d):
    return C.condition_counts(_volumes(spark, d), {"training": CONDITIONS, "testing": CONDITIONS})


@query(f"with {W.VOLUMES} select 'click' as a, 'view' as b, count(*) filter ({CLICK_SQL} and {VIEW_SQL}) as n from v union all select 'click', 'rest', count(*) filter ({CLICK_SQL} and {REST_SQL}) from v union all select 'view', 'rest', count(*) filter ({VIEW_SQL} and {REST_SQL}) from v")
def condition_overlap(spark, d):
    return C.condition_overlaps(_volumes(spark, d), CONDITIONS)


# ---- sampling and folds


@query(
    f"""with {W.VOLUMES}, l as (select *, {LABEL_SQL} as regressor_label from v), w as (select *, count(*) over (partition by subject, regressor_label, run, trial_index) as pair_n,
 count(*) over (partition by subject, regressor_label) as class_n from l where regressor_label is not null),
 z as (select *, row_number() over (partition by subject, regressor_label order by pair_n desc, run, trial_index, volume_of_interest desc, boldfile) as nth, min(class_n) over (partition by subject) as k from w)
 select subject, regressor_label, run, cast(trial_index as bigint) as trial_index, volume_of_interest, boldfile from z where nth <= k"""
)
def balance(spark, d):
    labelled = C.label_rows(_volumes(spark, d), CONDITIONS)
    return S.balance(labelled).select("subject", "regressor_label", "run", F.col("trial_index").cast("long").alias("trial_index"), "volume_of_interest", "boldfile")


@query(f"with {W.OBSERVATIONS}, k as (select distinct subject, run, dense_rank() over (partition by subject order by run) as fold from o) select k.subject, k.fold, case when o.run = k.run then 'test' else 'train' end as part, count(*) as n, sum(volume)::bigint as volumes from o join k using (subject) group by k.subject, k.fold, part".replace("o join k using (subject)", "o join k on o.subject = k.subject"))
def fold_split(spark, d):
    o = W.observations(spark, d).drop("features")
    train, test = S.split_runs(o, S.per_run(S.fold_universe(o)))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("subject", F.col("fold").cast("long").alias("fold"), "part").agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volumes"))


@query(f"with {W.OBSERVATIONS}, u as (select distinct subject, run from o) select subject, run, ntile(4) over (partition by subject order by run) as fold from u")
def group_folds(spark, d):
    return S.group_folds(S.fold_universe(W.observations(spark, d)), 4).withColumn("fold", F.col("fold").cast("long"))


@query(f"with {W.OBSERVATIONS}, u as (select distinct subject, cast(run as varchar) as run_text from o), g as (select * from (values (1, '1'), (1, '2'), (2, '2'), (2, '5'), (3, '9')) g(fold, run_text)) select subject, run_text, cast(fold as bigint) as fold, 'held out' as problem from u join g using (run_text) union all select subject, run_text, null, 'uncovered' from u where run_text not in (select run_text from g) union all select distinct null, run_text, null, 'unknown' from g where run_text not in (select run_text from u)")
def explicit_folds(spark, d):
    folds, problems = S.explicit_folds(spark, S.fold_universe(W.observations(spark, d)), [[1, 2], [2, 5], [9]])
    held = folds.select("subject", F.col("run").cast("string").alias("run_text"), F.col("fold").cast("long").alias("fold"), F.lit("held out").alias("problem"))
    return held.unionByName(problems.select("subject", "run_text", F.lit(None).cast("long").alias("fold"), "problem"))


@query(f"with {W.OBSERVATIONS}, u as (select distinct subject, run from o), g as (select subject, ntile(3) over (partition by subject order by run) as fold, run from u) select subject, fold, string_agg(cast(run as varchar), ',' order by run) as runs from g group by all")
def fold_manifest(spark, d):
    m = S.fold_manifest(S.group_folds(S.fold_universe(W.observations(spark, d)), 3))
    return m.select("subject", F.col("fold").cast("long").alias("fold"), F.array_join(F.transform("runs", lambda r: r.cast("string")), ",").alias("runs"))


@query(f"with {W.OBSERVATIONS}, s as (select subject, run, string_agg(distinct regressor_label, '|' order by regressor_label) as s from o group by all) select subject, count(distinct s) = 1 as homogeneous from s group by all")
def run_homogeneity(spark, d):
    return S.homogeneous_runs(W.observations(spark, d))


@query(
    f"""with {W.OBSERVATIONS}, n as (select *, row_number() over (partition by subject, run, trial_index order by regressor_label) as nth from o), one as (select subject, run, trial_index, regressor_label from n where nth = 1),
 c as (select subject, regressor_label, count(*) as c from one group by all), k as (select subject, least(4, min(c)) as k from c group by all),
 z as (select one.*, k, row_number() over (partition by one.subject, regressor_label order by md5(concat_ws('|', '0', cast(run as varchar), cast(trial_index as varchar))), run, trial_index) as place from one join k on one.subject = k.subject)
 select subject, run, trial_index, regressor_label, cast((place - 1) % k + 1 as bigint) as fold from z where k >= 2"""
)
def stratified_trial_folds(spark, d):
    return S.trial_folds(W.observations(spark, d).drop("features")).withColumn("fold", F.col("fold").cast("long"))


#: Recordings on grids that differ in the rotation (beyond and below the third decimal) or the dimensions.
GRID_SQL = """concat(cast(64 + r.user_id % 11 // 10 as varchar), 'x64x40 3.000000,3.000000,3.500000 ', printf('%.3f', round(3 * cos(r.user_id % 4 // 3 * 0.01), 3)), ',', printf('%.3f', round(r.user_id % 3 * 0.0001, 3) + 0.0), ',0.000,-90.000,0.000,3.000,0.000,-126.000,0.000,0.000,3.500,-72.000')"""
RUNS_SQL = f"""{W.TRIALS}, {W.RECORDINGS}, runs as (select distinct t.subject, t.session, t.task, r.user_id as run, r.boldfile, r.tr, r.n_frames, {GRID_SQL} as grid_key from t join r using (boldfile)),
 nth as (select *, row_number() over (partition by subject, session, task order by run) as nth from runs),
 pairs as (select a.subject, a.nth, a.boldfile as boldfile_a, a.tr as tr_a, a.n_frames as n_frames_a, a.grid_key as grid_key_a, b.boldfile as boldfile_b, b.tr as tr_b, b.grid_key as grid_key_b from nth a join nth b on a.subject = b.subject and a.session = b.session and a.nth = b.nth and a.task = 'loc' and b.task = 'WM')"""


def _rotated() -> Column:
    """Rows of a recording's transform, some of them rotated."""
    some = F.array(3 * F.cos((F.col("user_id") % 4 >= 3).cast("int") * 0.01), F.col("user_id") % 3 * 0.0001)
    return F.concat(some, F.array(*map(F.lit, (0.0, -90.0, 0.0, 3.0, 0.0, -126.0, 0.0, 0.0, 3.5, -72.0))))


def _pairs(spark, d):
    t = W.trials(spark, d).select("subject", "session", "task", "boldfile").distinct()
    runs = t.join(W.recordings(spark, d), "boldfile").select("subject", "session", "task", F.col("user_id").alias("run"), "boldfile", "tr", "n_frames")
    runs = runs.join(W.recordings(spark, d).select("boldfile", images.grid_key(F.array(F.lit(64) + (F.col("user_id") % 11 >= 10).cast("int"), F.lit(64), F.lit(40)), F.array(*map(F.lit, (3.0, 3.0, 3.5))), _rotated()).alias("grid_key")), "boldfile")
    return S.pair_runs(runs, "loc", "WM").where("boldfile_a is not null and boldfile_b is not null")


@query(f"with {RUNS_SQL} select subject, nth, boldfile_a, boldfile_b, case when tr_a <> tr_b then 'tr differs' when grid_key_a <> grid_key_b then 'grid_key differs' end as problem from pairs")
def pair_runs(spark, d):
    checked = S.pair_problems(_pairs(spark, d))
    return checked.select("subject", F.col("nth").cast("long").alias("nth"), "boldfile_a", "boldfile_b", "problem")


@query(f"with {RUNS_SQL} select event_id, boldfile, round(onset, 6) as onset from t where task = 'loc' union all select event_id, boldfile_a, round(onset + n_frames_a * tr_a, 6) from t join pairs on t.boldfile = pairs.boldfile_b where task = 'WM'")
def concat_events(spark, d):
    t = W.trials(spark, d)
    out = S.concat_events(t.where("task = 'loc'"), t.where("task = 'WM'"), _pairs(spark, d))
    return out.select("event_id", "boldfile", r6("onset").alias("onset"))


@query(
    f"""with {W.FLAT}, r as (select subject, case when run % 2 = 1 then 'loc' else 'WM' end as task, run, boldfile, max(volume) + 1 as n_frames from o group by all),
 nth as (select *, row_number() over (partition by subject, task order by run) as nth from r),
 pairs as (select a.boldfile as boldfile_a, a.n_frames as n_frames_a, b.boldfile as boldfile_b from nth a join nth b on a.subject = b.subject and a.nth = b.nth and a.task = 'loc' and b.task = 'WM')
 select boldfile, cast(volume as bigint) as volume, cast(voxel as bigint) as voxel, round(x, 6) + 0.0 as value from f where run % 2 = 1
 union all select boldfile_a, cast(volume + n_frames_a as bigint), cast(voxel as bigint), round(x, 6) + 0.0 from f join pairs on f.boldfile = pairs.boldfile_b"""
)
def concat_patterns(spark, d):
    """All recordings: odd runs are one task and even runs the other, paired within the
    subject; a recording has as many frames as its last frame's number tells."""
    o = W.observations(spark, d)
    task = F.when(F.col("run") % 2 == 1, "loc").otherwise("WM")
    runs = o.groupBy("subject", task.alias("task"), "run", "boldfile").agg((F.max("volume") + 1).alias("n_frames")).withColumn("session", F.lit(""))
    pairs = S.pair_runs(runs, "loc", "WM")
    S.check_pairs(pairs, [])
    out = S.concat_patterns(o.where(task == "loc"), o.where(task == "WM"), pairs)
    return _long(out.withColumn("volume", F.col("volume").cast("long")), "boldfile", "volume")


# ---- patterns


def _long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("features").alias("voxel", "value")).select(*keys, F.col("voxel").cast("long").alias("voxel"), r6("value").alias("value"))


@query(f"with {W.FLAT} select boldfile, volume, voxel // 2 as voxel, round(x, 6) + 0.0 as value from f where voxel % 2 = 0 and run <= 4")
def slice_patterns(spark, d):
    o = W.observations(spark, d)
    wanted = o.where("run <= 4").select("subject", F.lit("").alias("session"), "boldfile", F.col("volume").alias("volume_of_interest"))
    masks = wanted.select("subject", "session").distinct().withColumn("voxel_idx", F.sequence(F.lit(0), F.lit(62), F.lit(2)))
    sliced = P.apply_mask(P.slice_patterns(wanted, o.select("boldfile", "volume", "features")), P.resolve_masks(wanted, masks), ["subject", "session"])
    return _long(sliced.withColumnRenamed("volume_of_interest", "volume"), "boldfile", "volume")


@query(f"with {W.FLAT}, s as (select boldfile, voxel, avg(x) as m, stddev_pop(x) as sd from f group by all) select volume, f.voxel, round(case when sd = 0 then 0 else (x - m) / sd end, 6) + 0.0 as value from f join s on f.boldfile = s.boldfile and f.voxel = s.voxel")
def zscore(spark, d):
    return _long(P.zscore(W.observations(spark, d)), "volume")


@query(f"with {W.FLAT}, s as (select boldfile, voxel, avg(x) as m, stddev_pop(x) as sd from f group by all) select f.boldfile, volume, run, f.voxel, round(case when sd = 0 then 0 else (x - m) / sd end, 6) + 0.0 as value from f join s on f.boldfile = s.boldfile and f.voxel = s.voxel where run <= 4")
def frame_store(spark, d):
    """Frames stored by recording, scored where they lie; rows of some runs are brought to them."""
    o = W.observations(spark, d)
    stored = frames.store_frames(o.select("boldfile", "volume", "features"))
    wanted = o.where("run <= 4").select("boldfile", F.col("volume").alias("volume_of_interest"), "run")
    out = settled(frames.slice_stored(wanted, P.zscore(stored)))
    frames.drop_frames(spark, stored)
    return _long(out.withColumnRenamed("volume_of_interest", "volume"), "boldfile", "volume", "run")


ANOVA_SQL = f"""{W.FLAT}, g as (select subject, voxel, regressor_label, count(*) as n, sum(x) as t, sum(x * x) as q from f group by all),
 a as (select subject, voxel, sum(n) as n, count(*) as k, sum(t) as t, sum(q) as q, sum(t * t / n) as b from g group by all),
 fv as (select subject, voxel, ((b - t * t / n) / (k - 1)) / ((q - b) / (n - k)) as f from a)"""


@query(f"with {ANOVA_SQL} select subject, voxel, round(f, 6) as f from fv")
def anova_f(spark, d):
    return P.anova(W.observations(spark, d)).select("subject", F.col("voxel").cast("long").alias("voxel"), r6("f").alias("f"))


@query(f"with {ANOVA_SQL}, z as (select *, row_number() over (partition by subject order by f desc, voxel) as place from fv) select subject, voxel, place from z where place <= 10")
def kbest(spark, d):
    return P.select_best(P.anova(W.observations(spark, d)), 10).select("subject", F.col("voxel").cast("long").alias("voxel"), F.col("place").cast("long").alias("place"))


# the density of F, in an angle in which it has no poles, summed by Simpson's rule
TAIL_SQL = f"""{ANOVA_SQL}, d as (select subject, voxel, ((b - t * t / n) / (k - 1)) / ((q - b) / (n - k)) as f, (k - 1)::double as d1, (n - k)::double as d2 from a), e as (select *, asin(sqrt(d2 / (d2 + d1 * f))) as e from d),
 pv as (select subject, voxel, f, exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)) * e / 30000 * sum(case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end * pow(sin(e * i / 20000), d2 - 1) * pow(cos(e * i / 20000), d1 - 1)) as p from e, range(20001) s(i) group by subject, voxel, f, d1, d2, e)"""


@query(f"with {TAIL_SQL} select subject, voxel, round(p, 6) as p, round(f, 6) as f from pv")
def anova_p(spark, d):
    return P.anova_p(W.observations(spark, d)).select("subject", F.col("voxel").cast("long").alias("voxel"), r6("p").alias("p"), r6("f").alias("f"))


@query(
    f"""with {TAIL_SQL}, fifth as (select subject, list_sort(list(p))[5] as nth from pv group by subject), w as (select subject, min(0.05 * pow(1.1::double, i)) as threshold_used from fifth, range(50) s(i) where 0.05 * pow(1.1::double, i) > 1 or nth < 0.05 * pow(1.1::double, i) group by subject)
 select pv.subject, voxel, round(p, 6) as p, round(f, 6) as f, round(threshold_used, 6) as threshold_used from pv join w using (subject) where p < threshold_used"""
)
def threshold_select(spark, d):
    chosen = P.select_below(P.anova_p(W.observations(spark, d)), 0.05)
    return chosen.select("subject", F.col("voxel").cast("long").alias("voxel"), *(r6(c).alias(c) for c in ("p", "f", "threshold_used")))


DETREND_SQL = f"{W.FLAT}, l as (select boldfile, voxel, regr_slope(x, volume) as b, regr_intercept(x, volume) as a from f group by all), rest as (select f.*, x - (a + b * volume) as e from f join l on f.boldfile = l.boldfile and f.voxel = l.voxel)"


@query(f"with {DETREND_SQL} select volume, voxel, round(e, 6) + 0.0 as value from rest")
def detrend(spark, d):
    return _long(P.detrend(W.observations(spark, d)), "volume")


@query(f"with {W.FLAT}, m as (select boldfile, voxel, avg(x + case when voxel % 4 = 0 then 10000.0 else 0.0 end) as m from f group by all) select boldfile, voxel, round(m, 6) as value from m union all select 'all', voxel, round(avg(m), 6) from m group by voxel")
def temporal_mean(spark, d):
    moved = P.offset_in_mask(W.observations(spark, d), F.sequence(F.lit(0), F.lit(60), F.lit(4)))
    means = P.temporal_mean(moved)
    return _long(means, "boldfile").unionByName(_long(P.grand_mean(means).withColumn("boldfile", F.lit("all")), "boldfile"))


@query(f"with {DETREND_SQL} select boldfile, abs(avg(e + case when boldfile = 'emb-1' then 5.0 else 0.0 end)) < 1 as detrended from rest group by all")
def detrend_check(spark, d):
    done = P.detrend(W.observations(spark, d))
    moved = done.withColumn("features", F.when(F.col("boldfile") == "emb-1", F.transform("features", lambda x: x + 5.0)).otherwise(F.col("features")))
    return P.detrended_check(moved).select("boldfile", "detrended")


# ---- centroid classifier and scores


def _predicted(spark, d) -> DataFrame:
    o = W.observations(spark, d)
    held = F.col("run").isin(W.TEST_RUNS)
    return M.with_evidence(models.centroid_predict(o.where(~held), o.where(held)))


def _run_stats(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folds that leave each run out once, and statistics by class outside each."""
    folds = S.fold_universe(o).withColumn("fold", F.col("run"))
    return folds, P.stats_outside(P.class_stats(o, ["subject", "run"]), folds)


def _kfold(spark, d) -> DataFrame:
    o = W.observations(spark, d)
    folds, stats = _run_stats(o)
    return M.with_evidence(models.centroid_scores(stats, S.held_rows(o, folds), ["subject", "fold"]))


PRED = W.centroid_sql()


@query(f"with {PRED} select volume, regressor_label, predicted_label from b")
def centroid_predict(spark, d):
    return _predicted(spark, d).select("volume", "regressor_label", "predicted_label")


@query(f"with {PRED} select subject, round(avg(cast(predicted_label = regressor_label as integer)), 6) as accuracy from b group by all")
def accuracy(spark, d):
    return M.accuracy(_predicted(spark, d), ["subject"]).select("subject", r6("accuracy").alias("accuracy"))


GRID = "g as (select distinct a.subject, a.cat as row_label, b2.cat as col_label from (select distinct subject, cat from p) a join (select distinct subject, cat from p) b2 on a.subject = b2.subject)"
CONFUSION = f"{GRID}, n as (select subject, regressor_label as row_label, predicted_label as col_label, count(*) as n from b group by all), cm as (select g.subject, g.row_label, g.col_label, coalesce(n / sum(n) over (partition by g.subject, g.row_label), 0) as value from g left join n on g.subject = n.subject and g.row_label = n.row_label and g.col_label = n.col_label)"


@query(f"with {PRED}, {CONFUSION} select subject, row_label, col_label, round(value, 6) as value from cm")
def confusion(spark, d):
    return M.confusion(_predicted(spark, d), ["subject"]).withColumn("value", r6("value"))


@query(f"with {PRED}, {GRID}, e as (select subject, regressor_label as row_label, cat as col_label, avg(evidence) as value from p group by all) select g.subject, g.row_label, g.col_label, round(coalesce(value, 0), 6) as value from g left join e on g.subject = e.subject and g.row_label = e.row_label and g.col_label = e.col_label")
def evidence_matrix(spark, d):
    return M.evidence_matrix(_predicted(spark, d), ["subject"]).withColumn("value", r6("value"))


def _auc_sql(keys: str) -> str:
    return f"""rk as (select {keys}, cat, evidence, cast(cat = regressor_label as integer) as y, rank() over (partition by {keys}, cat order by round(evidence, 12)) + (count(*) over (partition by {keys}, cat, round(evidence, 12)) - 1) / 2.0 as rank from p),
 au as (select {keys}, cat as label, sum(y) as a, count(*) - sum(y) as z, sum(rank * y) as r from rk group by all),
 ar as (select {keys}, label, case when a = 0 or z = 0 then 'nan'::double else (r - a * (a + 1) / 2.0) / (a * z) end as auc from au)"""


@query(f"with {PRED}, {_auc_sql('subject')} select subject, label, isnan(auc) as one_sided, round(case when isnan(auc) then -1 else auc end, 6) as auc from ar")
def auc(spark, d):
    a = M.auc(_predicted(spark, d), ["subject"])
    return a.select("subject", "label", F.isnan("auc").alias("one_sided"), r6(F.when(F.isnan("auc"), -1.0).otherwise(F.col("auc"))).alias("auc"))


@query(f"with {PRED}, {_auc_sql('subject')}, ma as (select subject, avg(auc) as a from ar group by all) select subject, isnan(a) as one_sided, round(case when isnan(a) then -1 else a end, 6) as macro_auc from ma")
def macro_auc(spark, d):
    m = M.macro_auc(M.auc(_predicted(spark, d), ["subject"]), ["subject"])
    return m.select("subject", F.isnan("macro_auc").alias("one_sided"), r6(F.when(F.isnan("macro_auc"), -1.0).otherwise(F.col("macro_auc"))).alias("macro_auc"))


def _baseline_sql(protocol: str) -> str:
    """Both metrics of the centroid classifier from p (a row per test row and class, with fold)."""
    return f"""ba as (select subject, fold, avg(cast(predicted_label = regressor_label as integer)) as value from (select distinct volume, subject, fold, regressor_label, predicted_label from p) group by all),
 bk as (select subject, fold, cat, cast(cat = regressor_label as integer) as y, rank() over w + (count(*) over (partition by subject, fold, cat, round(score, 12)) - 1) / 2.0 as rank from p window w as (partition by subject, fold, cat order by round(score, 12))),
 bu as (select subject, fold, cat, sum(y) as a, count(*) - sum(y) as z, sum(rank * y) as r from bk group by all),
 bv as (select subject, fold, avg(case when a = 0 or z = 0 then 'nan'::double else (r - a * (a + 1) / 2.0) / (a * z) end) as value from bu group by all),
 both_metrics as (select subject, 'accuracy' as metric, avg(value) as value from ba group by all union all select subject, 'roc_auc_ovr', avg(value) from bv group by all)
 select subject, 'nearest_centroid' as method, '{protocol}' as protocol, metric, isnan(value) as one_sided, round(case when isnan(value) then -1 else value end, 6) as value from both_metrics"""


@query(f"select * from (with {PRED.replace('p as (select *,', 'p as (select *, 0 as fold,', 1)}, {_baseline_sql('matched_split')}) union all select * from (with {W.KFOLD}, {_baseline_sql('leave_one_run_out')})")
def baseline_comparison(spark, d):
    out = models.compare_baselines(W.observations(spark, d), W.TEST_RUNS, CATEGORIES, ("nearest_centroid",))
    return out.select("subject", "method", "protocol", "metric", F.isnan("value").alias("one_sided"), r6(F.when(F.isnan("value"), -1.0).otherwise(F.col("value"))).alias("value"))


@query()
def baseline_comparison_svm(spark, d):
    """The other method of the comparison: linear SVMs on both protocols."""
    return models.compare_baselines(W.observations(spark, d), W.TEST_RUNS, CATEGORIES, ("linear_svc",))


@query(f"with {PRED} select volume, cat, round(case when cat in ('c0', 'c1') and n2 then null else evidence end, 6) as evidence, round(1 / (1 + exp(-score)), 6) as sigmoid from (select *, false as n2 from p)")
def decision_evidence_scores(spark, d):
    p = _predicted(spark, d)
    scores = F.transform("scores", lambda s: s["score"])
    p = p.withColumn("e", decision_evidence(scores, 3)).withColumn("s", M.scoring_evidence(False))
    each = F.explode(F.zip_with("scores", F.arrays_zip("e", "s"), lambda a, b: F.struct(a["label"].alias("cat"), b["e"].alias("evidence"), b["s"].alias("sigmoid"))))
    return p.select("volume", each.alias("x")).select("volume", "x.cat", r6("x.evidence").alias("evidence"), r6("x.sigmoid").alias("sigmoid"))


@query(f"with {W.KFOLD}, m1 as (select subject, fold, avg(cast(predicted_label = regressor_label as integer)) as value from b group by all) select subject, round(avg(value), 6) as value from m1 group by all")
def fold_average(spark, d):
    t = M.accuracy(_kfold(spark, d), ["subject", "fold"]).select("subject", "fold", F.lit("total_scores").alias("metric"), F.lit("").alias("row_label"), F.lit("").alias("col_label"), F.col("accuracy").alias("value"))
    return M.fold_average(t, ["subject"]).select("subject", r6("value").alias("value"))


@query(f"with {W.KFOLD}, i as (select subject, cat as label, voxel, avg(m) as value from m group by all) select subject, label, voxel, round(value, 6) as value from i")
def importance_average(spark, d):
    o = W.observations(spark, d)
    maps = P.class_means(_run_stats(o)[1], ["subject", "fold"]).select("subject", F.col("regressor_label").alias("label"), F.col("mean").alias("features"))
    return _long(P.array_stats(maps, ["subject", "label"]).select("subject", "label", F.col("mean").alias("features")), "subject", "label")


N_PERM = 1000


@query(
    f"""with {W.OBSERVATIONS}, pm as (select unnest(range(0, {N_PERM + 1})) as perm), e as (select o.subject, o.run, o.volume, o.regressor_label, perm from o, pm),
 a as (select *, row_number() over (partition by subject, perm order by volume) as nth, row_number() over (partition by subject, perm order by case when perm = 0 then '' else md5(concat_ws('|', '0', cast(perm as varchar), cast(volume as varchar))) end, volume) as mth from e),
 l as (select x.subject, x.perm, x.run, x.volume, y.regressor_label from a x join a y on x.subject = y.subject and x.perm = y.perm and x.nth = y.mth),
 f as (select volume, unnest(features) as x, generate_subscripts(features, 1) as voxel from o),
 m as (select l.subject, perm, regressor_label as cat, voxel, avg(x) as m from l join f using (volume) where run <= 4 group by all),
 c as (select subject, perm, cat, voxel, m - avg(m) over (partition by subject, perm, cat) as c from m),
 q as (select volume, voxel, x - avg(x) over (partition by volume) as d from f),
 p as (select l.subject, l.perm, l.volume, l.regressor_label, c.cat, sum(d * c) / sqrt(sum(d * d)) / sqrt(sum(c * c)) as score from l join c on l.subject = c.subject and l.perm = c.perm join q on q.volume = l.volume and q.voxel = c.voxel where l.run > 4 group by all),
 b as (select distinct subject, perm, volume, regressor_label, first_value(cat) over (partition by perm, volume order by score desc, cat) as g from p),
 k as (select subject, perm, cat, cast(cat = regressor_label as integer) as y, rank() over w + (count(*) over (partition by subject, perm, cat, round(score, 12)) - 1) / 2.0 as rank from p window w as (partition by subject, perm, cat order by round(score, 12))),
 u as (select subject, perm, cat, sum(y) as a, count(*) - sum(y) as z, sum(rank * y) as r from k group by all),
 s as (select subject, perm, 'accuracy' as metric, round(avg(cast(g = regressor_label as integer)), 9) as value from b group by all
   union all select subject, perm, 'roc_auc_ovr', round(avg(case when a = 0 or z = 0 then 'nan'::double else (r - a * (a + 1) / 2.0) / (a * z) end), 9) from u group by all)
 select r.subject, r.metric, round(r.value, 6) as real, round((1 + count(*) filter (s.value >= r.value)) / (1.0 + count(*)), 6) as p from s join s r on s.subject = r.subject and s.metric = r.metric and r.perm = 0 and s.perm > 0 where not isnan(r.value) group by all"""
)
def permutation_centroid(spark, d):
    scores = settled(models.permutation_centroid(W.observations(spark, d), W.TEST_RUNS, N_PERM)).withColumn("value", F.round("value", 9))
    p = models.permutation_p(scores, ["subject", "metric"]).where(~F.isnan("real"))
    return p.select("subject", "metric", r6("real").alias("real"), r6("p").alias("p"))


# ---- fitted models

CATEGORIES = [f"c{k}" for k in range(10)]
PARAMS = {"C": 1.0}


def _fitted(spark, d, name):
    """Chosen features and predictions of one fit for each subject."""
    o = W.observations(spark, d)
    held = F.col("run").isin(W.TEST_RUNS)
    chosen = P.select_features(o.where(~held), ["subject"], n_voxels=16)
    fitted = models.fit_coefficients(o.where(~held), chosen, ["subject"], CATEGORIES, name, PARAMS)
    return chosen, models.predict(o.where(held), chosen, fitted, ["subject"], CATEGORIES)


@query()
def logistic_fit(spark, d):
    chosen, p = _fitted(spark, d, "logistic_regression")
    return T.decoding_table(M.with_evidence(p), CATEGORIES, chosen, ["subject"], "logistic_regression").drop("scores", "evidence")


@query()
def linear_svc_fit(spark, d):
    return M.accuracy(_fitted(spark, d, "linear_svc")[1], ["subject"])


@query()
def kfold_logistic(spark, d):
    """Every run of every subject is left out once."""
    o = W.observations(spark, d)
    folds, keys = S.per_run(S.fold_universe(o)), ["subject", "fold"]
    chosen = settled(P.select_by(P.stats_outside(P.class_stats(o, ["subject", "run"]), folds), keys, n_voxels=16))
    fitted = models.fit_folds(o, folds, chosen, CATEGORIES, "logistic_regression", PARAMS)
    return M.accuracy(models.predict(S.held_rows(o, folds), chosen, fitted, keys, CATEGORIES), keys)


@query()
def permutation_logistic(spark, d):
    """Selection and fit anew for each permutation, as many as the centroid's test has."""
    scores = models.permutation_fitted(W.observations(spark, d), W.TEST_RUNS, N_PERM, CATEGORIES, "logistic_regression", PARAMS, n_voxels=16)
    return models.permutation_p(settled(scores), ["subject", "metric"])


def _workflow_tables(spark, d):
    """The observations as volumes, frames and recordings, and a configuration over them."""
    o = W.observations(spark, d)
    table = o.select("subject", "run", "trial_index", "boldfile", F.col("regressor_label").alias("trial_type"), F.col("volume").cast("double").alias("onset"), F.lit(1.0).alias("duration"), F.col("volume").alias("volume_of_interest"))
    recordings = o.groupBy("boldfile").agg((F.max("volume") + 1).alias("n_frames")).withColumn("tr", F.lit(1.0))
    leaf = lambda c, runs: {"and": [{"column": "trial_type", "match": "exact", "value": c}, {"column": "run", "match": "in", "values": runs}]}
    part = lambda runs: {"conditions": {c: leaf(c, runs) for c in CATEGORIES}}
    config = {"model_conditions": {"training": part(list("1234")), "testing": part(list("56"))}, "model": {"featureSelection": {"n_voxels": 16}}}
    return table, o.select("boldfile", "volume", "features"), recordings, config


@query()
def generalization_workflow(spark, d):
    """The whole stage: cross-validation, final fit and scores of every subject."""
    out = workflows.run_generalization(*_workflow_tables(spark, d))
    return out["cv_metrics"].withColumn("stage", F.lit("cv")).unionByName(out["metrics"].drop("fold").withColumn("stage", F.lit("test")))


# standard scores by file; each trial's window holds its own frame and those twelve before and after, as far as the file has them
KFOLD_WORKFLOW_SQL = f"""with {W.FLAT}, st as (select boldfile, voxel, avg(x) as m, stddev_pop(x) as sd from f group by all),
 z as (select f.* exclude (x), case when sd = 0 then 0 else (x - m) / sd end as x from f join st using (boldfile, voxel)), k as (select distinct subject, run as fold from o),
 zm as (select k.subject, k.fold, regressor_label as cat, voxel, avg(x) as m from z join k on z.subject = k.subject and z.run <> k.fold group by all),
 zc as (select subject, fold, cat, voxel, m - avg(m) over (partition by subject, fold, cat) as c from zm), zd as (select *, x - avg(x) over (partition by volume) as d from z),
 frame as (select zd.volume, any_value(zd.boldfile) as boldfile, zc.subject, zc.fold, zc.cat, sum(d * c) / (case when sqrt(sum(d * d)) * sqrt(sum(c * c)) = 0 then 1 else sqrt(sum(d * d)) * sqrt(sum(c * c)) end) as score
   from zd join zc on zd.subject = zc.subject and zd.voxel = zc.voxel and zd.run = zc.fold group by all),
 said as (select *, exp(score) / sum(exp(score)) over w as soft, first_value(cat) over (w order by score desc, cat) as predicted_label from frame window w as (partition by volume)),
 p as (select said.volume, said.subject, said.fold, o.regressor_label, cat, 1 / (1 + exp(-score)) as evidence, predicted_label from said join o on o.volume = said.volume),
 b as (select distinct volume, subject, fold, regressor_label, predicted_label from p), {_auc_sql("subject, fold")},
 kc as (select distinct subject, fold, cat from p), g as (select a.subject, a.fold, a.cat as row_label, c.cat as col_label from kc a join kc c on a.subject = c.subject and a.fold = c.fold),
 n as (select subject, fold, regressor_label as row_label, predicted_label as col_label, count(*) as n from b group by all), e as (select subject, fold, regressor_label as row_label, cat as col_label, avg(evidence) as e from p group by all),
 by_fold as (select subject, fold, 'total_scores' as metric, '' as row_label, '' as col_label, avg(cast(predicted_label = regressor_label as integer)) as value from b group by all
  union all select subject, fold, 'accuracy', row_label, col_label, coalesce(n / sum(n) over (partition by subject, fold, row_label), 0) from g left join n using (subject, fold, row_label, col_label)
  union all select subject, fold, 'evidence', row_label, col_label, coalesce(e, 0) from g left join e using (subject, fold, row_label, col_label)
  union all select subject, fold, 'auc', label, '', auc from ar),
 w as (select said.subject, (step + 1) * 12 as window_index, o.regressor_label, said.volume, cat, soft, predicted_label from o cross join range(-1, 2) s(step) join said on said.volume = o.volume + step * 12 and said.boldfile = o.boldfile),
 course as (select subject, window_index, regressor_label, avg(cast(predicted_label = regressor_label as integer)) as hit, avg(soft) filter (cat = 'c0') as c0 from w group by all),
 every as (select 'fold' as stage, subject, fold, metric, row_label, col_label, value from by_fold
  union all select 'mean', subject, 0, metric, row_label, col_label, avg(value) from by_fold group by all
  union all select 'decoding', subject, 0, 'accuracy', regressor_label, cast(window_index as varchar), hit from course union all select 'decoding', subject, 0, 'evidence_c0', regressor_label, cast(window_index as varchar), c0 from course)
 select stage, subject, cast(fold as integer) as fold, metric, row_label, col_label, isnan(value) as undefined, round(case when isnan(value) then -1 else value end, 6) as value from every"""


@query(KFOLD_WORKFLOW_SQL)
def kfold_workflow(spark, d):
    """The whole stage with every run left out once: standard scores, folds, mean patterns, scores
    by fold and over folds, and a decoded time course of every trial of the runs left out."""
    table, frames, recordings, config = _workflow_tables(spark, d)
    both = {c: {"column": "trial_type", "match": "exact", "value": c} for c in CATEGORIES}
    window = {"start": {"reference": "onset", "offset_seconds": -12}, "end": {"reference": "onset", "offset_seconds": 13}}
    config["model_conditions"] = {"training": {"conditions": both}, "testing": {"conditions": both}, "timecourse_decoding": {"conditions": both, "window": window}}
    config["model"] = {"classifier": {"name": "nearest_centroid"}, "kfold_cv": {"strategy": "per_run"}}
    out = workflows.run_kfold(table, frames, recordings, config)
    labels = ["metric", "row_label", "col_label", "value"]
    course = out["decoding_summary"].select("subject", "window_index", "regressor_label", F.explode(F.create_map(F.lit("accuracy"), F.col("Accuracy"), F.lit("evidence_c0"), F.col("evidence_c0"))).alias("metric", "value"))
    course = course.select("subject", "metric", F.col("regressor_label").alias("row_label"), F.col("window_index").cast("string").alias("col_label"), "value")
    stages = [out["fold_metrics"].select(F.lit("fold").alias("stage"), "subject", F.col("fold").cast("int").alias("fold"), *labels)]
    stages += [t.select(F.lit(s).alias("stage"), "subject", F.lit(0).alias("fold"), *labels) for s, t in (("mean", out["metrics"]), ("decoding", course))]
    every = reduce(DataFrame.unionByName, stages)
    return every.select("stage", "subject", "fold", *labels[:3], F.isnan("value").alias("undefined"), r6(F.when(F.isnan("value"), -1.0).otherwise(F.col("value"))).alias("value"))


# ---- time courses

WINDOW = {"start": {"reference": "onset", "offset_seconds": -600}, "end": {"reference": "offset_end", "offset_seconds": 1200}}


@query(
    f"""with {W.VOLUMES}, n as (select *, row_number() over (partition by boldfile, trial_index order by volume_of_interest) as nth from v), x as (select n.*, tr, n_frames, onset - 600.0 as s0, onset + duration + 1200.0 as s1 from n join r using (boldfile) where nth = 1),
 y as (select *, cast(floor(s0 / tr) as bigint) as s, greatest(1, cast(round_even((s1 - s0) / tr, 0) as bigint)) as c from x), z as (select event_id, s, unnest(range(s, greatest(least(s + c, n_frames), s))) as volume_of_interest from y) select event_id, volume_of_interest, volume_of_interest - s as window_index from z"""
)
def timecourse_rows(spark, d):
    out = T.timecourse_rows(_volumes(spark, d), W.recordings(spark, d).drop("user_id"), WINDOW)
    return out.select("event_id", "volume_of_interest", "window_index")


def _decoded(p: DataFrame) -> DataFrame:
    return p.withColumn("correct", F.col("predicted_label") == F.col("regressor_label")).withColumn("evidence_c0", F.filter(F.arrays_zip("scores", "evidence"), lambda x: x["scores"]["label"] == "c0")[0]["evidence"])


@query(f"with {PRED} select subject, window_index, regressor_label, count(*) as trial_count, round(avg(cast(predicted_label = regressor_label as integer)), 6) as accuracy, round(avg(evidence), 6) as evidence_c0 from p where cat = 'c0' group by all")
def decode_summary(spark, d):
    s = T.summary(_decoded(_predicted(spark, d)), ["evidence_c0"], ["subject"])
    return s.select("subject", "window_index", "regressor_label", "trial_count", r6("Accuracy").alias("accuracy"), r6("evidence_c0").alias("evidence_c0"))


@query(f"with {W.KFOLD} select subject, window_index, regressor_label, count(*) as trial_count, round(avg(cast(predicted_label = regressor_label as integer)), 6) as accuracy, round(avg(evidence), 6) as evidence_c0 from p where cat = 'c0' group by all")
def decode_summary_pooled(spark, d):
    s = T.summary(_decoded(_kfold(spark, d)), ["evidence_c0"], ["subject"])
    return s.select("subject", "window_index", "regressor_label", "trial_count", r6("Accuracy").alias("accuracy"), r6("evidence_c0").alias("evidence_c0"))


SE_SQL = "w as (select subject, regressor_label, cat, window_index, avg(evidence) as mean, coalesce(stddev_samp(evidence) / sqrt(count(*)), 0) as se from p group by all)"
UNIT = ["subject", "regressor_label", "cat", "window_index"]


@query(f"with {PRED}, {SE_SQL} select subject, regressor_label, cat, window_index, round(mean, 6) as mean, round(se, 6) as se from w")
def timecourse_se(spark, d):
    w = T.within_unit(M.by_class(_predicted(spark, d)), UNIT)
    return w.select(*UNIT, r6("mean").alias("mean"), r6("se").alias("se"))


OVERLAY = {"late": {"and": [{"column": "run", "match": "exact", "value": "6"}, {"not": {"column": "window_index", "match": "exact", "value": "4"}}]}, "edge": {"column": "window_index", "match": "in", "values": ["0", "3"]}}
OVERLAY_SQL = """w as (select subject, regressor_label, case when run = 6 and window_index <> 4 then 'late' when window_index in (0, 3) then 'edge' end as overlay_label, cat, window_index, avg(evidence) as mean, coalesce(stddev_samp(evidence) / sqrt(count(*)), 0) as se, count(*) as n from p
 where cat in ('c0', 'c1') and ((run = 6 and window_index <> 4) or window_index in (0, 3)) group by all)"""


def _overlaid(spark, d) -> DataFrame:
    p = _decoded(_predicted(spark, d)).withColumn("evidence_c1", F.filter(F.arrays_zip("scores", "evidence"), lambda x: x["scores"]["label"] == "c1")[0]["evidence"])
    return T.timecourse(p, ["evidence_c0", "evidence_c1"], OVERLAY)[0]


@query(f"with {PRED}, {OVERLAY_SQL} select subject, regressor_label, overlay_label, cat, window_index, round(mean, 6) as mean, round(se, 6) as se, n from w")
def timecourse_overlay(spark, d):
    """Evidence by a further key that conditions make from the raw decoding rows."""
    return _overlaid(spark, d).select("subject", "regressor_label", "overlay_label", "cat", "window_index", r6("mean").alias("mean"), r6("se").alias("se"), "n")


@query(f"with {PRED}, {OVERLAY_SQL} select regressor_label, overlay_label, cat, window_index, round(avg(mean), 6) as group_mean, round(coalesce(stddev_samp(mean) / sqrt(count(*)), 0), 6) as group_se, round(avg(se), 6) as mean_within_se, count(*) as n_units from w group by all")
def timecourse_overlay_group(spark, d):
    keys = ["regressor_label", "overlay_label", "cat", "window_index"]
    return T.across_units(_overlaid(spark, d), keys).select(*keys, *(r6(c).alias(c) for c in ("group_mean", "group_se", "mean_within_se")), "n_units")


@query(f"with {PRED}, {SE_SQL} select regressor_label, cat, window_index, round(avg(mean), 6) as group_mean, round(coalesce(stddev_samp(mean) / sqrt(count(*)), 0), 6) as group_se, round(avg(se), 6) as mean_within_se from w group by all")
def timecourse_group(spark, d):
    g = T.across_units(T.within_unit(M.by_class(_predicted(spark, d)), UNIT), UNIT[1:])
    return g.select(*UNIT[1:], *(r6(c).alias(c) for c in ("group_mean", "group_se", "mean_within_se")))


@query(f"with {W.OBSERVATIONS}, {W.RECORDINGS}, m as (select tr from r group by tr order by count(*) desc, min(boldfile) limit 1) select distinct window_index, window_index * tr as seconds from o, m")
def timecourse_axis(spark, d):
    tr = R.majority_tr(W.recordings(spark, d)).select("tr")
    steps = W.observations(spark, d).select("window_index").distinct().withColumn("one", F.lit(1))
    return steps.join(tr.withColumn("one", F.lit(1)), "one").select("window_index", (F.col("window_index") * F.col("tr")).alias("seconds"))


# ---- report


@query(f"with {W.TRIALS} select trial_type, round(median(duration), 6) as median_duration from t group by all")
def median_duration(spark, d):
    return R.median_duration(W.trials(spark, d)).withColumn("median_duration", r6("median_duration"))


@query(f"with {W.RECORDINGS} select tr, count(*) as n, count(*) over () > 1 as several from r group by tr order by count(*) desc, min(boldfile) limit 1")
def majority_tr(spark, d):
    return R.majority_tr(W.recordings(spark, d)).select("tr", "n", "several")


@query(f"with {W.KFOLD}, s as (select subject, avg(cast(predicted_label = regressor_label as integer)) as a from b group by subject, fold), e as (select subject, avg(a) as a from s group by all) select 'cv' as stage, subject, round(a, 6) as accuracy, 0.1 as chance from e union all select 'cv', 'group', round(avg(a), 6), 0.1 from e".replace("0.1", "0.1::double"))
def accuracy_table(spark, d):
    scores = M.accuracy(_kfold(spark, d), ["subject", "fold"]).withColumn("stage", F.lit("cv"))
    return R.accuracy_table(scores, len(CATEGORIES)).select("stage", "subject", r6("accuracy").alias("accuracy"), "chance")


@query(f"with {W.KFOLD}, {_auc_sql('subject, fold')} select label, round(min(auc), 6) as least, round(quantile_cont(auc, 0.25), 6) as q1, round(quantile_cont(auc, 0.5), 6) as median, round(quantile_cont(auc, 0.75), 6) as q3, round(max(auc), 6) as most from ar where not isnan(auc) group by all")
def auc_quartiles(spark, d):
    q = R.auc_quartiles(M.auc(_kfold(spark, d), ["subject", "fold"]))
    return q.select("label", *(r6(c).alias(c) for c in ("least", "q1", "median", "q3", "most")))


@query(f"with {PRED}, {CONFUSION} select row_label, col_label, round(avg(value), 6) as value from cm group by all")
def group_confusion(spark, d):
    return R.group_matrix(M.confusion(_predicted(spark, d), ["subject"])).select("row_label", "col_label", r6("value").alias("value"))


@query(f"with {W.FLAT}, m as (select run, regressor_label as label, voxel, avg(x) as m from f where run not in (2, 5) group by all) select label, voxel, round(avg(m), 6) as value from m group by all")
def group_importance(spark, d):
    """A map by run, each as a subject's; one run is in another space and one on another grid."""
    maps = P.array_stats(W.observations(spark, d), ["run", "regressor_label"]).select(F.col("run").cast("string").alias("subject"), F.col("regressor_label").alias("label"), F.col("mean").alias("weights"), F.when(F.col("run") == 2, "unasserted").otherwise("mni").alias("space"), F.when(F.col("run") == 5, "turned").otherwise("straight").alias("grid_key"))
    mean, _ = R.group_importance(maps)
    return _long(mean.withColumnRenamed("weights", "features"), "label")


@query(f"with {PRED}, {CONFUSION} select subject, row_label, " + ", ".join(f"round(max(case when col_label = 'c{k}' then value end), 6) as c{k}" for k in range(10)) + " from cm group by all")
def metrics_wide(spark, d):
    m = M.confusion(_predicted(spark, d), ["subject"])
    return tables.wide_matrix(m, CATEGORIES, ["subject"]).select("subject", "row_label", *(r6(c).alias(c) for c in CATEGORIES))


@query(f"with {W.OBSERVATIONS}, k as (select distinct subject, run from o) select 'lr' as descr, subject, count(distinct run) as n_folds from k group by all")
def result_catalog(spark, d):
    m = W.observations(spark, d).select(F.lit("lr").alias("desc"), "subject", F.lit("cv").alias("stage"), F.col("run").alias("fold"))
    return tables.catalog(m).select(F.col("desc").alias("descr"), "subject", "n_folds")
