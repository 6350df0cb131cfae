"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes what the one before it kept, as a table with the columns of
``documents``; the last returns where each row goes. Near duplicates are judged
on five-word shingles at a similarity of 0.8. Mixing repeats the rows of sources
that are scarce for their weight, so a document may come more than once at the
end; each copy has a slot of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.decontam import clean_documents
from keelson.llm.mixing import mix_documents
from keelson.llm.near_dups import keep_one
from keelson.llm.quality import keep_documents
from keelson.llm.shared import stored, table
from keelson.llm.sharding import shard_documents

SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one(docs, width=SHINGLE_WORDS, num=SIMILARITY, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark items go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights; scarce ones are repeated."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard and its slot there."""
    return shard_documents(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources", mixture), ("sharding", sharding)]

#: Components of near copies, a schedule and the hash of a shard are not for plain SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
