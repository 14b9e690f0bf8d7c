"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from onsetlab.llm import bpe, chat, embedding_dups, jaccard, language_id, lexical_search, media, packing, periodic_runs, quality, secrets, token_counts, token_files


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds by its three base patterns, which SQL can express."""
    return secrets.op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_language_id": language_id.op3_language_id,
        "op4_secret_scans": secrets.op4_secret_scans,
        "secret_base_spans": secret_base_spans,
        "op5_media_columns": media.op5_media_columns,
        "op6_chat_formatting": chat.op6_chat_formatting,
        "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
        "op8_embedding_near_dedup": embedding_dups.op8_embedding_near_dedup,
        "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_token_files": token_files.op11_token_files,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_lexical_search": lexical_search.op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# letters in either case, without folding any others to them
KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The base patterns of op4; single quotes are doubled for SQL.
BASES = (rf"""({KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")

#: Links from a CTE ``l`` (a, b, both ways) and all nodes from ``v`` (id): the smallest id each reaches.
REACH = "r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), least_of as (select a, min(b) as m from r group by a)"


def oracle_sql() -> dict[str, str]:
    """The others are models, library tokens or digests of stored forms, which SQL can't express."""
    escaped = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')".format
    return {
        "op6_chat_formatting": f"""with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, case when i = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)),
 t as (select *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]')) + {chat.TURN_TOKENS} as tokens,
  length('{chat.TURN}') + length(replace({escaped("role")}, chr(10), '&#10;')) + 1 + length({escaped("text")}) + length('{chat.END}') as size from said),
 o as (select *, row_number() over w as nth, sum(tokens) over (w rows unbounded preceding) as upto from t window w as (partition by conv_id order by turn nulls first, role, text)),
 c as (select *, upto - tokens as before, (upto - tokens) // {chat.SPAN_TOKENS} as f, (upto - 1) // {chat.SPAN_TOKENS} as g from o),
 p as (select *, case when f = g then 2 * f else 2 * f + 1 end as span, min(case when role = 'system' then nth end) over (partition by conv_id) as system_at from c),
 s as (select conv_id, span, min(before) as starts, min(nth) as first_at, sum(size) as own from p group by all),
 h as (select s.conv_id, s.span, any_value(s.own) as own, any_value(s.first_at) as first_at, coalesce(sum(p.size) filter (p.nth < s.first_at and s.starts - p.before <= {chat.HISTORY_TOKENS}), 0) as history,
  coalesce(sum(p.size) filter (p.nth = p.system_at and p.nth < s.first_at and s.starts - p.before > {chat.HISTORY_TOKENS}), 0) as system
  from s join p on p.conv_id is not distinct from s.conv_id and (p.nth = p.system_at or p.before between s.starts - {chat.HISTORY_TOKENS} and s.starts) group by all),
 z as (select conv_id, sum(own + history + system) as formatted_chars, count(*) as n_windows from h group by conv_id),
 d as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by nth) as turns, coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '') as loss from o group by conv_id)
 select d.conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars, n_windows
 from d join z on z.conv_id is not distinct from d.conv_id""",
        "secret_base_spans": f"""with t as (select doc_id, row_number() over () as r, coalesce(text, '') as x from documents),
 p(k, kind, pattern) as (values (0, 'assign', '{BASES[0]}'), (1, 'access', '{BASES[1]}'), (2, 'hex', '{BASES[2]}')),
 f as (select r, 0 as k, regexp_extract_all(x, '{BASES[0]}') as found, regexp_split_to_array(x, '{BASES[0]}') as rest from t
  union all select r, 1, regexp_extract_all(x, '{BASES[1]}'), regexp_split_to_array(x, '{BASES[1]}') from t union all select r, 2, regexp_extract_all(x, '{BASES[2]}'), regexp_split_to_array(x, '{BASES[2]}') from t),
 e as (select r, k, generate_subscripts(found, 1) as i, unnest(found) as m, unnest(rest[:len(found)]) as gap from f where len(found) > 0),
 s as (select *, sum(length(gap) + length(m)) over (partition by r, k order by i rows unbounded preceding) as upto from e),
 b as (select r, k, m, upto - length(m) as a, upto as z from s where case k when 0 then length(regexp_extract(m, '{BASES[0]}', 2)) >= 12 when 1 then length(m) >= 18 else length(m) >= 16 end),
 g as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || a || ':' || z, ',' order by a, k) as spans from b join p using (k) group by r)
 select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from t left join g using (r)""",
        "op8_embedding_near_dedup": f"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93), {REACH},
 n as (select a, count(*) as n from l group by a), x as (select vec_id, label, md5(cast(e as varchar)) as k from v), same as (select label, k, min(vec_id) as rep from x group by all)
 select v.vec_id, coalesce(n.n, 0) as n_links, least(v.vec_id, coalesce(least_of.m, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(least_of.m, v.vec_id)) as kept, coalesce(same.rep, v.vec_id) as rep_id
 from v left join n on n.a = v.vec_id left join least_of on least_of.a = v.vec_id left join x on x.vec_id = v.vec_id left join same on same.label = x.label and same.k = x.k""",
        "op9_ngram_jaccard_join": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
 z as (select doc_id, count(*) as n, md5(string_agg(g, '|' order by g)) as k from s group by doc_id),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
 l as (select o.a, o.b from o join z x on x.doc_id = o.a join z y on y.doc_id = o.b where 100 * o >= 90 * (x.n + y.n - o)), {REACH}, same as (select k, min(doc_id) as rep from z group by k)
 select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(least_of.m, d.doc_id)) as component_id, coalesce(same.rep, d.doc_id) as class_id
 from documents d left join z on z.doc_id = d.doc_id left join least_of on least_of.a = d.doc_id left join same on same.k = z.k""",
        "op13_lexical_search": f"""with t as (select doc_id, row_number() over () as r, translate(text, '{UPPER}', '{LOWER}') as x from documents where text is not null),
 d as (select r, doc_id, unnest(regexp_extract_all(x, '{TERM}')) as term from t), n as (select r, doc_id, count(*) as n from d group by all), tot as (select count(*)::bigint as nd, sum(n)::bigint as nt from n),
 tf as (select r, term, count(*) as tf from d group by all), df as (select term, count(*) as df from tf group by term),
 q as (select distinct i, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from (select row_number() over () as i, * from benchmark)),
 w as (select i, item_id, term, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double)) as bigint) as w from q join df using (term), tot),
 s as (select w.i, w.item_id, n.doc_id, n.r, sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * n.n * nd) // nt))))::bigint as score from w join tf using (term) join n on n.r = tf.r, tot group by all),
 o as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0)
 select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 50""",
    }
