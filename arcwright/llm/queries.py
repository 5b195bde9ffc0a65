"""The operators' queries over the shared tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, near_duplicates, packing, quality_rules, sentencepiece_fst, tokenfile, toxicity, url_reputation, warc, zstd_quality
from .common import spool_path, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spool_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.histories(spark, path)


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), url_reputation.outcomes_from_labels(table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"), width=4)


def op8_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spool_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.digest(spark, path)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and the longest rule of every page."""
    return url_reputation.ruled(table(spark, sf_dir, "pages"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every text, and whether they fail."""
    return quality_rules.counted(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that fingerprints are compared with."""
    return fingerprints.edited_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


SQL = {
    "url_rules": """with p as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
 h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p)
 select page_id, host, path, case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
 when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
 when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
 when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from h""",
    "quality_counts": """with d as (select doc_id, coalesce(text, '') as t from documents),
 w as (select doc_id, t, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as ls from d),
 g as (select doc_id, i, list_slice(ws, i, i + 4) as five from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
 r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from (select *, count(*) over (partition by doc_id, five) as k from g) where k > 1) group by 1),
 c as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join r using (doc_id))
 select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c""",
    "edited_texts": """with d as (select doc_id, coalesce(text, '') as t from documents), n as (select *, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as follows from d)
 select doc_id, length(t)::bigint as n_chars, sha256(substr(t, 1, length(t) - length(t) // 2)||substr(follows, 1, length(t) // 2)) as edited_sha256 from n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_sentencepiece, op2_packing, op3_toxicity, op4_warc, op5_url_reputation, op6_quality_rules, op7_near_duplicates, op8_zstd_quality, op9_fingerprints, op10_token_orc, url_rules, quality_counts, edited_texts)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
