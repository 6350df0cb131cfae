"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, sources at their target weights."""
    from keelson.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.near_dups import join_near_copies
    return join_near_copies(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.toxicity import judge_documents
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.chat import format_conversations
    return format_conversations(spark, table(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.warc import archive
    return archive(table(spark, sf_dir, "pages"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.quality import judge_documents
    return judge_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.pii import find_documents
    return find_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.decontam import judge_documents
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.urls import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.search import rank_documents
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.negatives import mine_embeddings
    return mine_embeddings(table(spark, sf_dir, "embeddings"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.fingerprints import compare_documents
    return compare_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix, op2_ngram_join, op3_toxicity, op4_chat_format, op5_warc, op6_shard,
                                                   op7_pii, op8_decontaminate, op9_quality_rules, op10_url_filter,
                                                   op11_ranked_search, op12_hard_negatives, op13_fingerprint)}
