"""Trials, recordings and observations over the given tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAG = 900.0
EXACT, PARTS = ("error",), ("sign",)
TEST_RUNS = [5, 6]


def trials(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "event_id",
        "lpad(cast(user_id % 5 as string), 2, '0') as subject",
        "'' as session",
        "case when user_id % 2 = 0 then 'loc' else 'WM' end as task",
        "cast(1 + (user_id div 5) % 6 as int) as run",
        "event_type as trial_type",
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D as onset",
        "value * 30.0D as duration",
        "concat('rec-', cast(user_id as string)) as boldfile",
    )


def recordings(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    named = users.selectExpr("concat('rec-', cast(user_id as string)) as boldfile", "case when user_id % 7 = 0 then 300.0D else 600.0D end as tr", "user_id")
    return named.selectExpr("boldfile", "tr", "cast(2592000 / tr as int) as n_frames", "user_id")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").selectExpr(
        "cast(vec_id as int) as volume",
        "lpad(cast(vec_id % 2 as string), 2, '0') as subject",
        "cast(1 + (vec_id div 2) % 6 as int) as run",
        "cast(1 + vec_id div 12 as int) as trial_index",
        "concat('emb-', cast(vec_id % 12 as string)) as boldfile",
        "cast(vec_id % 5 as int) as window_index",
        "concat('c', cast(label as string)) as regressor_label",
        "cast(embedding as array<double>) as features",
    )


TRIALS = """t as (select event_id, lpad(cast(user_id % 5 as varchar), 2, '0') as subject, '' as session,
  case when user_id % 2 = 0 then 'loc' else 'WM' end as task, cast(1 + (user_id // 5) % 6 as integer) as run, event_type as trial_type,
  (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as onset, value * 30.0::double as duration,
  concat('rec-', cast(user_id as varchar)) as boldfile, user_id from events)"""
RECORDINGS = """r as (select boldfile, tr, cast(2592000 / tr as integer) as n_frames, user_id
  from (select distinct user_id, concat('rec-', cast(user_id as varchar)) as boldfile, case when user_id % 7 = 0 then 300.0::double else 600.0::double end as tr from events))"""
OBSERVATIONS = """o as (select cast(vec_id as integer) as volume, lpad(cast(vec_id % 2 as varchar), 2, '0') as subject,
  cast(1 + (vec_id // 2) % 6 as integer) as run, cast(1 + vec_id // 12 as integer) as trial_index,
  concat('emb-', cast(vec_id % 12 as varchar)) as boldfile, cast(vec_id % 5 as integer) as window_index,
  concat('c', cast(label as varchar)) as regressor_label, cast(embedding as double[]) as features from embeddings)"""
VOLUMES = f"""{TRIALS}, {RECORDINGS},
 kept as (select * from t where not coalesce(lower(trial_type) = 'error' or contains(lower(trial_type), 'sign'), false)
   and onset is not null and duration is not null and isfinite(onset) and isfinite(duration)),
 numbered as (select *, row_number() over (partition by boldfile order by onset, event_id) as trial_index from kept),
 timed as (select n.*, r.tr, r.n_frames, onset + 900.0::double as s0, (onset + 900.0::double) + duration as s1 from numbered n join r using (boldfile)),
 ranged as (select *, cast(floor(s0 / tr) as bigint) as s, greatest(1, cast(round_even((s1 - s0) / tr, 0) as bigint)) as c from timed),
 v as (select event_id, subject, session, task, run, trial_type, trial_index, onset, duration, boldfile, unnest(range(s, greatest(least(s + c, n_frames), s))) as volume_of_interest from ranged)"""
#: Frames by voxel.
FLAT = f"""{OBSERVATIONS}, f as (select volume, subject, run, trial_index, window_index, boldfile, regressor_label,
  unnest(features) as x, generate_subscripts(features, 1) - 1 as voxel from o)"""


def centroid_sql(train: str = "run <= 4", test: str = "run > 4") -> str:
    """CTEs p (one row per test row and class: cat, score, evidence) and b (one per test row: predicted_label)."""
    return f"""{FLAT}, m as (select subject, regressor_label as cat, voxel, avg(x) as m from f where {train} group by all),
 c as (select subject, cat, voxel, m - avg(m) over (partition by subject, cat) as c from m),
 q as (select f.*, x - avg(x) over (partition by volume) as d from f where {test}),
 p0 as (select q.volume, q.subject, q.run, q.trial_index, q.window_index, q.boldfile, q.regressor_label, c.cat,
   sum(d * c) / (case when sqrt(sum(d * d)) * sqrt(sum(c * c)) = 0 then 1 else sqrt(sum(d * d)) * sqrt(sum(c * c)) end) as score
   from q join c on q.subject = c.subject and q.voxel = c.voxel group by all),
 p as (select *, exp(score) / sum(exp(score)) over (partition by volume) as evidence,
   first_value(cat) over (partition by volume order by score desc, cat) as predicted_label from p0),
 b as (select distinct volume, subject, run, trial_index, window_index, boldfile, regressor_label, predicted_label from p)"""


#: Leave-one-run-out: p and b with a fold each.
KFOLD = f"""{FLAT}, k as (select distinct subject, run as fold from o),
 m as (select k.subject, k.fold, regressor_label as cat, voxel, avg(x) as m from f join k on f.subject = k.subject and f.run <> k.fold group by all),
 c as (select subject, fold, cat, voxel, m - avg(m) over (partition by subject, fold, cat) as c from m),
 q as (select f.*, x - avg(x) over (partition by volume) as d from f),
 p0 as (select q.volume, q.subject, c.fold, q.window_index, q.regressor_label, c.cat,
   sum(d * c) / (case when sqrt(sum(d * d)) * sqrt(sum(c * c)) = 0 then 1 else sqrt(sum(d * d)) * sqrt(sum(c * c)) end) as score
   from q join c on q.subject = c.subject and q.voxel = c.voxel and q.run = c.fold group by all),
 p as (select *, exp(score) / sum(exp(score)) over (partition by volume) as evidence,
   first_value(cat) over (partition by volume order by score desc, cat) as predicted_label from p0),
 b as (select distinct volume, subject, fold, window_index, regressor_label, predicted_label from p)"""
