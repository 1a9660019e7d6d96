"""The queries opN_<name> over the test tables, each through its operator, with the columns that their contracts fix."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, license_scan, line_dedup, near_dedup, packing, prefix_trie, quality, secret_scan, token_counts, token_files, topk
from .common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its id, what went, and the text that stays."""
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_chunks_removed", "n_chars_removed", "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many licence paragraphs, their families, and each one's line, family and probability; and how many lines name an unknown licence."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_license"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"), F.to_json("found").alias("found"), "n_unknown")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page: kind, doc_id or page_id, lang, probability."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(language_id.evidence(docs, _table(spark, sf_dir, "pages")), language_id.fit(docs))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(_table(spark, sf_dir, "conversations"))))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a folder of its own, then every row is read back from those files."""
    folder = scratch(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return token_files.documents(spark, folder)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_topk, op3_benchmark_decontamination, op4_secret_scan, op5_line_dedup, op6_token_counts, op7_language_id, op8_quality_classifier, op9_near_dedup, op10_best_fit_packing, op11_conversation_trie, op12_token_files)}
ORACLES: dict[str, str] = {
    "op2_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, sqrt(list_dot_product(e, e)) as l from v),
s as (select q.vec_id as query_id, r.vec_id, case when len(q.e) = len(r.e) and q.l * r.l < 4503599627370496 then list_dot_product(q.e, r.e)::bigint
  else list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1]::hugeint * p[2]::hugeint))::bigint end as score from n q, n r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify rank <= 5""",
    "op11_conversation_trie": r"""
with recursive own as (select *, row_number() over (partition by conv_id order by turn nulls first, dg) - 1 as i from
  (select conv_id::bigint as conv_id, turn, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)),
ids as (select conv_id, count(*) as n_own from own group by 1),
crc as (select conv_id, conv_id::varchar as s, 0 as k, 4294967295::bigint as c from ids union all
  select conv_id, s, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from
    (select conv_id, s, k, case when k % 8 = 0 then xor(c, ascii(substr(s, k // 8 + 1, 1))::bigint) else c end as x from crc where k < 8 * length(s))),
h as (select conv_id, conv_id - conv_id % 20 as b, xor(c, 4294967295) % 4 as h from crc where k = 8 * length(s)),
convs as (select h.*, least(h.h, coalesce(ids.n_own, 0)) as m from h left join ids on ids.conv_id = h.b),
turns as (select c.conv_id, i, dg, words from convs c join own on own.conv_id = c.b where i < c.m union all
  select c.conv_id, i - c.h + c.m, dg, words from convs c join own using (conv_id) where i >= c.h),
pre as (select conv_id, i + 1 as depth, words, sha256(string_agg(dg, '') over (partition by conv_id order by i)) as key from turns union all select conv_id, 0, 0, 'root' from convs),
ends as (select conv_id, arg_max(key, depth) as key from pre group by 1),
node as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, max(words) * (count(*) - 1) as own from pre group by 1, 2),
up as (select node.key, p.key as parent from node join pre p on p.conv_id = node.conv_id and p.depth = node.depth - 1),
kids as (select parent as key, count(*) as n from up group by 1),
below as (select p.key, sum(node.own) as saved, count(*) filter (kids.n is null) as leaves from node join pre p on p.conv_id = node.conv_id and p.depth <= node.depth left join kids on kids.key = node.key group by 1),
said as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as hash from ends group by 1)
select node.conv_id, node.depth::bigint as depth, par.conv_id as parent_conv_id, node.n_convs, coalesce(kids.n, 0) as n_children, below.leaves as n_leaves, below.saved::bigint as saved_tokens, coalesce(said.hash, sha256('')) as ends_sha256
from node join below using (key) left join kids on kids.key = node.key left join up on up.key = node.key left join node par on par.key = up.parent left join said on said.key = node.key""",
}
