"""Helpers of the training-data operators: the shared folder, stored
intermediate tables, and a gapless numbering that never sorts a group in one
task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What the contracts call whitespace: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only if that is
    unset and the session itself is local (tests, a laptop)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = "file://" + os.path.join(tempfile.gettempdir(), "keelson-llm")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other job writes to."""
    return f"{shared_dir(spark)}/keelson-llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later reads survive
    a lost executor and repeat no work."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(nullable).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``: inside the array
    functions a plain column expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, ws: str = WS, ws_chars: str = WS_CHARS) -> Column:
    """The words of a text; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ws_chars))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, ws + "+"))


def hash_bits(spark: SparkSession) -> int:
    """So many leading hash bits that a group holding all rows still spreads
    over four times the shuffle partitions."""
    return max(1, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def number_rows(df: DataFrame, groups: list[str], index: str, order: list[str] | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a hash
    of ``order`` (default: all columns), ties by the hash of the whole row.

    A group is cut by its leading hash bits into ranges; each range is numbered
    by itself and starts after the rows of the ranges before it, which come
    from a small table of counts. Equal rows are counted before the shuffle and
    unfolded at the end, so neither a hot group nor a hot row meets in one
    task. The numbers do not depend on the number of partitions. Column names
    that begin with ``__kl_`` are reserved; a column named ``index`` is replaced.
    """
    spark, cols = df.sparkSession, [c for c in df.columns if c != index]
    n, h, t, b, start, first = (f"__kl_{x}" for x in ("n", "h", "t", "b", "start", "first"))
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    counted = (counted.withColumn(h, F.xxhash64(*(order or cols))).withColumn(t, F.xxhash64(*cols))
               .withColumn(b, F.shiftrightunsigned(h, 64 - hash_bits(spark))))
    sums = counted.groupBy(*groups, b).agg(F.sum(n).alias("__kl_s"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__kl_g{i}") for i, g in enumerate(groups)], F.col(b).alias("__kl_bb"),
                         F.coalesce(F.sum("__kl_s").over(before), F.lit(0)).alias(start))
    same = F.col(b) == F.col("__kl_bb")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__kl_g{i}"))
    inside = Window.partitionBy(*groups, b).orderBy(h, t).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col(start) + F.sum(n).over(inside) - F.col(n)
    return (counted.join(starts, same).withColumn(first, place)
            .select(*cols, F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1)).alias(index)))


def smallest(df: DataFrame, by: Column, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows of ``df`` with the smallest hash ``by`` (a bigint), ties by
    the columns ``ties``: a sample that depends on the rows alone.

    Rows are counted first, and then only hashes below a threshold that leaves
    about twice the limit are ordered, so that tasks send their share of these and
    not ``limit`` rows each. If repeated rows leave too few below the threshold, it
    is raised."""
    n, span = df.count(), 1 << 64
    share = 2 * limit / max(n, 1)
    while share < 1:
        under = df.where(by < F.lit(int(share * span) - (span >> 1)))
        if under.count() >= limit:
            df = under
            break
        share *= 4
    return df.orderBy(by, *ties).limit(limit)


def aside(df: DataFrame, *needed: str) -> DataFrame:
    """All columns under names that clash with nothing, and ``needed`` under their own."""
    return df.select(*[F.col(f"`{c}`").alias(f"__in_{c}") for c in df.columns], *needed)


def row_key(df: DataFrame, name: str = "__kl_key") -> DataFrame:
    """``df`` with a 128-bit key of the whole row, the same for equal rows."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(name, F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b")))


#: A stored table of so many rows of a few numbers (about 64 MB as a hash table) is broadcast, after it has been counted;
#: larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def back(df: DataFrame) -> DataFrame:
    """The columns that ``aside`` put away, under their names."""
    return df.select(*[F.col(f"`{c}`").alias(c.removeprefix("__in_")) for c in df.columns if c.startswith("__in_")])
