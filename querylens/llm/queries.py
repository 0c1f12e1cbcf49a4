"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, mixing, ngram_join, pii, quality_fm, quality_rules, token_store, url_filter
from .common import table, vocabulary, work_path
from .labelled import fold


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    judged = exact_dedup.dedup_files(spark, path, spark.read.parquet(path).schema)
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.PAGE_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_store.checksums(token_store.read(spark, path))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mixing.with_copies(docs.select("doc_id", "source", "text"), mixing.mix_plan(docs))
    return rows.select("row.doc_id", "size", "p.source_size", "p.target", (F.col("size") * F.col("copies")).alias("taken"), "chance")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_fm.with_score(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op1_ngram_jaccard_links, op2_exact_dedup, op3_url_filter, op4_quality_rules, op5_bpe, op6_token_files, op7_pii, op8_pareto_mix, op9_license_scan, op10_quality_fm)
}

SQL: dict[str, str] = {}

SQL["op2_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

SQL["op3_url_filter"] = r"""
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(verdict, r_host, r_path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best as (
  select distinct on (host, path) host, path, r_host || r_path as rule, verdict
  from (select distinct host, path from parts) join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  order by host, path, length(r_host || r_path) desc, length(r_host) desc, verdict desc)
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from parts p left join best b on p.host = b.host and p.path = b.path
"""

SQL["op1_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
flat as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s) as n_shingles, min(r.b) as component_id from sets s join reach r on s.doc_id = r.a group by s.doc_id, s.s
"""

SQL["op1_ngram_jaccard_links"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
flat as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*)))
select s.doc_id, len(s.s) as n_shingles, count(l.b) as n_links from sets s left join links l on s.doc_id = l.a group by s.doc_id, s.s
"""

SQL["op8_pareto_mix"] = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, sha256('8:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
sources as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from docs group by source),
-- Capped are the sources of the least 3 * size / weight, until what is left shares out below the next one's cap.
ordered as (
  select *, 3 * source_size as cap, row_number() over o as nth, sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as due, sum(weight) over (o rows between current row and unbounded following) as weights
  from sources window o as (order by 3 * source_size / weight, source nulls last)),
level as (select due, weights from ordered where due * weight <= cap * weights order by nth limit 1),
targets as (
  select o.source, o.source_size, case when o.due * o.weight <= o.cap * o.weights then (o.weight * l.due)::double / l.weights::double else o.cap::double end as target from ordered o, level l),
plan as (
  select *, greatest(target - certain * source_size, 0) as due
  from (select *, least(floor(case when source_size > 0 then target / source_size else 0 end + 1e-12), 3)::bigint as certain from targets)),
-- Down the sizes, all above the first that the factor of the rest leaves below 1 are certain.
sizes as (select source, size, count(*) * size as words, (count(*) * size * size)::double as weighted from docs where size > 0 group by source, size),
levels as (
  select s.source, s.size, coalesce(sum(words) over (down rows between unbounded preceding and 1 preceding), 0) as sure,
         (p.due - coalesce(sum(words) over (down rows between unbounded preceding and 1 preceding), 0)) / sum(weighted) over (partition by s.source order by s.size) as c
  from sizes s join plan p on s.source is not distinct from p.source where p.due > 0 window down as (partition by s.source order by s.size desc)),
factor as (select source, max_by(c, size) as c, max_by(sure, size) as sure from levels where c * size < 1 group by source),
chances as (
  select d.*, p.source_size, p.target, p.certain, p.due, coalesce(f.sure, 0) as sure, least(coalesce(f.c, 1.0::double) * d.size::double, 1.0::double) as chance,
         (('0x' || substr(h, 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from docs d join plan p on d.source is not distinct from p.source left join factor f on d.source is not distinct from f.source),
odds as (select *, case when chance < 1 and size > 0 then (u * (1 - greatest(chance, 1e-12::double))) / ((1 - u) * greatest(chance, 1e-12::double)) end as odds from chances),
ranked as (
  select *, sure + sum(case when odds is null then 0 else size end) over (partition by source order by odds / (1 + odds) nulls first, doc_id rows unbounded preceding) as so_far from odds)
select doc_id, size, source_size, target, chance,
       (size * least(certain + case when due > 0 and (chance >= 1 or so_far - size / 2 <= due) then 1 else 0 end, 3))::bigint as taken
from ranked
"""


def _license_sql() -> str:
    grams = [(q, i, label, len(w) - license_scan.K + 1, w[q : q + license_scan.K]) for i, (label, w) in enumerate(license_scan.template_words()) for q in range(len(w) - license_scan.K + 1)]
    rows = ", ".join(f"({q}, {i}, '{label}', {n}, {w})" for q, i, label, n, w in grams)
    phrases = ", ".join(f"({p.split(' ')}, '{label}')" for p, label in license_scan.PHRASES)
    return rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
stands as (select doc_id, pos - 1 as pos, w[pos:pos + {license_scan.K - 1}] as gram from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from words)),
grams(t_pos, template, label, t_grams, t_words) as (values {rows}),
phrases(p_words, label) as (values {phrases}),
places as (select doc_id, pos, label from stands join phrases on gram[1:len(p_words)] = p_words),
votes as (select doc_id, template, label, t_grams, pos - t_pos as diagonal, pos, t_pos from stands join grams on gram = t_words),
diagonals as (select doc_id, template, label, t_grams, diagonal, list(distinct t_pos) as found, min(pos) as first, max(pos) as last from votes group by all),
cut as (
  select *, case when lag(diagonal) over w is null or diagonal - lag(diagonal) over w > {license_scan.SHIFT} or first - lag(last) over w > {license_scan.GAP} then 1 else 0 end as new
  from diagonals window w as (partition by doc_id, template order by diagonal, first)),
numbered as (select *, sum(new) over (partition by doc_id, template order by diagonal, first rows unbounded preceding) as span from cut),
spans as (select doc_id, label, len(list_distinct(flatten(list(found)))) / t_grams as score from numbered group by doc_id, template, label, t_grams, span),
best as (select doc_id, label, max(score) as score from spans group by all),
base as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels from places group by all),
labels_of as (
  select doc_id, array_to_string(list_sort(list(distinct label)), ',') as labels
  from (select doc_id, label from places union all select doc_id, label from best where score >= {license_scan.MIN_SCORE}) group by all),
scores as (select doc_id, max(score) as score from best group by all)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       greatest(coalesce(score, 0), case when n_base > 0 then {license_scan.PHRASE_SCORE} else 0 end)::double as score
from words left join base using (doc_id) left join labels_of using (doc_id) left join scores using (doc_id)
"""


SQL["op9_license_scan"] = _license_sql()
