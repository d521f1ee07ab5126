"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, html, jaccard, langid, lattice, quality, tokenfile, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))


def op4_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality.fit(quality.sample(docs, labels.where(langid.fold() != 0)))
    return quality.score(docs, net).select("doc_id", langid.in_fold(0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of the pages' archives in which some records were damaged and some lost."""
    record = lambda html: F.sha2(warc.record_bytes(F.col("page_id"), F.col("url"), html), 256)
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    first = warc.archive(table(spark, sf_dir, "pages"), keep=("page_id",), digest=record(F.col("html")), other=record(damaged))
    second = first.where(~F.coalesce(F.col("page_id") % 97 == 17, F.lit(False)))
    return warc.audit(warc.leaves(first, F.col("digest")), warc.leaves(second, F.col("other")))


def op6_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"), train=docs.where(~langid.in_fold(1)), keep=("doc_id",))
    return scored.withColumn("held_out", langid.in_fold(1))


def op7_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.fit(docs.where(langid.fold() != 0))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", langid.in_fold(0).alias("held_out"), "lang_pred", "score")


def op8_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode and decode every text; the ids and the decoded bytes as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "text"), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokenfile.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, manifest, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_pruned_top_k": op1_block_pruned_top_k,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_network": op4_quality_network,
    "op5_warc_merkle_audit": op5_warc_merkle_audit,
    "op6_lattice_score": op6_lattice_score,
    "op7_language_profiles": op7_language_profiles,
    "op8_html_layout_text": op8_html_layout_text,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_token_files": op10_token_files,
}

_OP3_SQL = """
with recursive
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as m
  from shingles x join shingles y on x.g = y.g and x.doc_id < y.doc_id
  group by 1, 2),
links as (
  select a, b from shared join sizes s on s.doc_id = a join sizes t on t.doc_id = b
  where 100 * m >= 90 * (s.n + t.n - m)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, seen) as (
  select a, a from both_ways
  union
  select r.node, e.b from reach r join both_ways e on e.a = r.seen),
lowest as (select node, min(seen) as c from reach group by node)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.c, d.doc_id)) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join lowest l on l.node = d.doc_id
"""

_OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({body})::varchar
  || chr(13) || chr(10) || chr(13) || chr(10) || {body} || chr(13) || chr(10) || chr(13) || chr(10)"""

_OP5_SQL = f"""
with bodies as (
  select page_id, url, coalesce(html, '') as body, case when page_id % 97 = 5 then '?' || substr(coalesce(html, ''), 2) else coalesce(html, '') end as other
  from pages),
records as (
  select coalesce(floor(page_id / 1024)::bigint, -1 - ('0x' || sha256(body)[1:8])::bigint % 4096) as archive, page_id, url, sha256(body) as h, {_RECORD.format(body="body")} as a, {_RECORD.format(body="other")} as b
  from bodies),
placed as (
  select *, strlen(a)::bigint as n_bytes,
    coalesce(sum(strlen(a)) over (partition by archive order by page_id, url, h rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset
  from records)
select archive, byte_offset, n_bytes, case when page_id % 97 = 17 then 'missing' else 'changed' end as state, sha256(a) as digest_a, case when page_id % 97 = 17 then null else sha256(b) end as digest_b
from placed
where page_id % 97 = 17 or sha256(a) <> sha256(b)
"""

ORACLE_SQL: dict[str, str] = {"op5_warc_merkle_audit": _OP5_SQL, "op1_block_pruned_top_k": _OP1_SQL, "op3_ngram_jaccard_join": _OP3_SQL}
