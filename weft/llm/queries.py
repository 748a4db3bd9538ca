"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clusters, divergence, extract, jaccard, lm, mixing, nearcopies, packing, quality, substring, topk, urlfilter

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", extract.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), TOKENIZER)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_read(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select(
        "doc_id", "source", F.col("_weft_round").alias("round"), F.col("_weft_block").alias("block"),
        F.col("_weft_rank").alias("rank"), F.col("_weft_tokens").alias("n_tokens"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select(
        "doc_id", F.col("_weft_words").alias("n_words"), F.col("_weft_removed").alias("n_removed"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_read(spark, sf_dir, "documents"))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(_read(spark, sf_dir, "documents"))


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = (
        op1_chat_format, op2_html_extract, op3_sum_of_squares_packing, op4_exact_topk, op5_url_filter,
        op6_temperature_mixing, op7_substring_dedup, op8_host_rules, op9_jaccard_join, op10_backoff_scores,
        op11_source_divergence, op12_superminhash, op13_drake_clusters,
    )
    return {f.__name__: f for f in own}


_CHAT = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, coalesce(lag(role) over w <> role, true) as begins,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|ROLE\]|AND\])', '\1\\\2\3', 'g')) as n,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|ROLE\]|AND\])', '\1\\\2\3', 'g')) as r
  from said window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n + case when not begins then 5 when role = 'assistant' then 7 else 19 + r end)::bigint as formatted_chars
from marked group by conv_id
"""

_TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint) as x from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x::double[], c.x::double[])::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

_URLS = r"""
with cut as (
  select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) t(h, p, verdict)
), fits as (
  select page_id, h || p as rule, verdict,
    row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as k
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and k = 1
"""

_SUBSTRING = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), starts as (
  select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50
), hashed as (
  select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from starts
), first as (
  select h, min(doc_id) as low from hashed group by h having min(doc_id) < max(doc_id)
), gone as (
  select distinct doc_id, i + unnest(range(0, 50)) as pos
  from hashed join first using (h) where doc_id > low
), removed as (
  select doc_id, list(pos) as ats from gone group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ats), 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: ats is null or not list_contains(ats, i)), ' ')) as kept_sha256
from w left join removed using (doc_id)
"""

_QUALITY = r"""
with w as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents
), starts as (
  select doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) as h
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)
), twice as (
  select doc_id, h from starts group by doc_id, h having count(*) > 1
), covered as (
  select doc_id, count(distinct pos) as n
  from (select doc_id, i + unnest(range(0, 8)) as pos from starts join twice using (doc_id, h)) group by doc_id
), m as (
  select doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
    )::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from w left join covered using (doc_id)
), judged as (
  select *, n_words < 20 as short, 100 * n_repeat_words > 30 * n_words as repeats, n_symbols > 4 * n_words as symbols,
    5 * n_dup_lines > n_words as lines, word_chars < 2 * n_words or word_chars > 20 * n_words as lengths,
    short or repeats as base_failed from m
), hosts as (
  unpivot (select source, count(*) as docs, sum(short::int) as short, sum(repeats::int) as repeats,
    sum(symbols::int) as symbols, sum(lines::int) as lines, sum(lengths::int) as lengths from judged group by source)
  on short, repeats, symbols, lines, lengths into name rule value failed
), prior as (
  select rule, sum(failed) / sum(docs) as mean, case when var_samp(failed / docs) > 0 then
    greatest(1.0, avg(failed / docs) * (1 - avg(failed / docs)) / var_samp(failed / docs) - 1) else 1.0 end as strength
  from hosts group by rule
), rates as (
  select *, (failed + mean * strength) / (docs + strength) as rate from hosts join prior using (rule)
), bad as (
  select distinct source from rates
  where rate - 2 * sqrt(rate * (1 - rate) / (docs + strength + 1)) > greatest(3 * mean, 0.5)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and source not in (select source from bad where source is not null)
    and not (source is null and exists (select 1 from bad where source is null)) as kept
from judged
"""

_JACCARD = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), grams as (
  select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ') || (case when len(ws) < 5 then len(ws)::varchar else '' end)) as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 180 * o >= 80 * (x.n + y.n)
), reach as (
  select doc_id, doc_id as c from w union select r.doc_id, l.b from reach r join links l on l.a = r.c
)
select w.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.c) as component_id
from w join reach r using (doc_id) left join sizes s using (doc_id) group by w.doc_id
"""


_SCORES = r"""
with crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)
    order by i) as t from (select unnest(range(256)) as i)
), d as (
  select row_number() over () as r, doc_id, coalesce(xor(list_reduce(list_transform(string_split(doc_id::varchar, ''),
      lambda ch: ascii(ch)::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295), 0)
      % 10 = 0 as held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)]) as ws from documents, crc_table
), tok as (
  select r, held_out, w, lag(w) over o as b, lag(w, 2) over o as a
  from (select r, held_out, unnest(ws) as w, unnest(range(len(ws))) as pos from d) window o as (partition by r order by pos)
), one as (
  select w, count(*) as c from tok where not held_out group by w
), two as (
  select b, w, count(*) as c from tok where not held_out and b is not null group by b, w
), three as (
  select a, b, w, count(*) as c from tok where not held_out and a is not null group by a, b, w
), train as (
  select coalesce(sum(c), 0)::bigint as n, count(*) as v from one
), counted as (
  select tok.r, n, coalesce(one.c, 0) as c1, h1.c as ch1, coalesce(two.c, 0) as c2, h2.c as ch2, coalesce(three.c, 0) as c3,
    (coalesce(one.c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)) as p1
  from tok cross join train left join one on one.w = tok.w left join one h1 on h1.w = tok.b
    left join two on two.b = tok.b and two.w = tok.w left join two h2 on h2.b = tok.a and h2.w = tok.b
    left join three on three.a = tok.a and three.b = tok.b and three.w = tok.w
), smoothed as (
  select *, case when ch1 is null then p1 else (c2 + 50 * p1) / (ch1 + 50) end as p2 from counted
), scored as (
  select r, any_value(n) as n, count(*) as n_tokens, count(*) filter (where c1 > 0) as n_known, sum(log10(p1)) as base_score,
    sum(log10(case when ch2 is null then p2 else (c3 + 5 * p2) / (ch2 + 5) end)) as score
  from smoothed group by r
)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, base_score, score from d join scored using (r)
"""


_NEAR_COPIES = f"select *, doc_id = component_id as kept from ({_JACCARD.replace('180 * o >= 80', '185 * o >= 85')})"


_DIVERGENCE = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), t as (
  select r, lang, source, unnest(ws) as w from d
), kept as (
  select lang, w, count(*)::hugeint as n from t group by lang, w having count(distinct r) >= 10
), v as (
  select lang, count(*) as v, sum(n) as n from kept group by lang
), c as (
  select lang, source, w, count(*)::hugeint as c from t semi join kept using (lang, w) group by lang, source, w
), g as (
  select lang, source, coalesce(sum(c), 0) as n from (select distinct lang, source from d) left join c using (lang, source)
  group by lang, source
), p as (
  select g.lang, g.source, k.w, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) as p
  from g join v using (lang) join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.w = k.w
), q as (
  select k.lang, k.w, 1 + (1000000000 * (k.n + 2)) // (v.n + 2 * v.v) as q from kept k join v using (lang)
), met as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.w = b.w and a.source <> b.source group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source
  union all
  select p.lang, p.source, 'term', p.w, ((p - q) * (p - q)) // (p + q) from p join q using (lang, w) where c > 0 and p > q
), ranked as (
  select lang, source, part, item, value::bigint as value,
    row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found
)
select * from ranked where part = 'pair' or rank <= 10
"""


def _clustering(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds written out: a(i) assigns to the centroids c(i), which the round before made."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} as materialized (
  select r, c, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from v cross join c{i}
), a{i} as materialized (
  select r, c, d from (select *, row_number() over (partition by r order by d, c) as k from d{i}) where k = 1
)""")
        if i < rounds:
            steps.append(f"""s{i} as (
  select c, pos, sum(e)::hugeint as s, count(*)::hugeint as n
  from (select c, unnest(x) as e, unnest(range(len(x))) as pos from v join a{i} using (r)) group by c, pos
), c{i + 1} as materialized (
  select c{i}.c, coalesce(m.y, c{i}.y) as y from c{i} left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as y from s{i} group by c) m using (c)
)""")
    return f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
), c0 as materialized (
  select (row_number() over (order by h nulls last, x) - 1)::int as c, x as y
  from (select sha256('3:' || vec_id::varchar) as h, x from v order by h nulls last, x limit {k})
), {", ".join(steps)}, shas as (
  select c, sha256(array_to_string(y, ',')) as sha from c{rounds}
)
select vec_id, c as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia,
  sum(d) over ()::bigint as inertia, sha as centroid_sha256
from a{rounds} join v using (r) join shas using (c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": _CHAT, "op4_exact_topk": _TOPK, "op5_url_filter": _URLS, "op7_substring_dedup": _SUBSTRING,
        "op8_host_rules": _QUALITY, "op9_jaccard_join": _JACCARD, "op10_backoff_scores": _SCORES,
        "op11_source_divergence": _DIVERGENCE, "op12_superminhash": _NEAR_COPIES, "op13_drake_clusters": _clustering(),
    }
