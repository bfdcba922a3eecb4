"""The registered queries of this folder: (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logquarry.llm import collocations, compression, decontaminate, jaccard, langid, merkle, mixing, sanitise, simhash, suffixes, toxicity, turns, urlrules
from logquarry.shipping import shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, one word of 64 bits, links at 4 differing bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, words=1, bits=4, blocks=7, chosen=3)


def op4_mixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.sampled(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op6_quality_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op10_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(_table(spark, sf_dir, "documents"))


def op11_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links from 90 in 100."""
    return jaccard.similar_texts(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return turns.report(turns.damaged(rows), rows)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (
        op1_merkle_fingerprints,
        op2_url_filter,
        op3_simhash_components,
        op4_mixed_sample,
        op5_suffix_dedup,
        op6_quality_by_compression,
        op7_toxicity_trees,
        op8_benchmark_matches,
        op9_language_pieces,
        op10_private_terms,
        op11_jaccard_components,
        op12_conversation_repair,
        op13_collocations,
    )
}

ORACLE: dict[str, str] = {
    "op2_url_filter": """
        with rules(action, host, path) as (values
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        parts as (
            select page_id,
                translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
            from pages),
        numbered as (select *, row_number() over () as n from parts),
        fits as (
            select n, r.host || r.path as rule, r.action
            from numbered p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)),
        best as (select n, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from fits group by n)
        select page_id, host, path, rule, coalesce(action, 'allow') as verdict from numbered left join best using (n)""",
    "op4_mixed_sample": mixing.oracle(),
    "op11_jaccard_components": jaccard.ORACLE,
    "op12_conversation_repair": turns.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
