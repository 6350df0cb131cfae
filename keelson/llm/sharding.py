"""Sharding by rendezvous hashing over weighted shards (DataFrame functions only).

Each (record key, shard) pair gets a uniform number u in (0, 1) from a hash;
the record goes to the shard with the largest ``-weight / ln(u)``. A shard's
share follows its weight, and since the scores of the other shards do not
change when one is added, a new shard only takes rows into itself.

Defined results: a null key counts as the empty text; rows with equal keys go
to one shard; repeated rows each get a slot of their own; an empty table gives
an empty result; extra columns are carried along, those named ``shard``,
``grown_shard`` or ``slot`` are replaced. Texts are read only for their size and
checksum, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import number_rows

SHARDS = 16


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a record key (ties: the smaller)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for j, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(j)), 12).cast("double") + 0.5) / float(2 ** 52)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("s"), F.lit(-j).alias("j")))
    return -F.array_max(F.array(*scores))["j"] if len(scores) > 1 else F.lit(0)


def assign(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, new_weight: float | None = None,
           shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with its shard, and its shard once another (of ``new_weight``,
    default the mean weight) has been added."""
    weights = weights or [1.0] * SHARDS
    more = [*weights, new_weight or sum(weights) / len(weights)]
    df = df.drop(shard, grown)
    return df.withColumns({shard: rendezvous(F.col(key), weights), grown: rendezvous(F.col(key), more)})


def shard_slots(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None) -> DataFrame:
    """``df`` with shard, grown_shard and slot: the row's place in its shard,
    gapless from 0, in the order of the hash of the row. (A hash of the key alone
    would put all rows of a hot key into one range, which one task numbers.)"""
    return number_rows(assign(df, key, weights), ["shard"], "slot")


def shard_documents(df: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shard_slots(narrow, "doc_id", weights)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
