"""Ingest: materialise the four-table model once, then query the files.

The original workflow imports its CSV exports into database tables and runs
every metric against those tables. The Spark equivalent writes the model as
parquet into the cluster's shared folder: usage partitioned by month
(``usage_month=yyyy-MM``) so that date windows prune whole partitions, the
other tables unpartitioned. Metrics then scan files instead of re-deriving
the model from its sources on every query.

A model is keyed by its source files (path, length and modification time of each
file, asked of the file system that holds them; listed once per session while the
table's path does not change) and by ``FORMAT_VERSION``, which is raised by hand when the mapping or the layout changes. A table is
written to a folder of its own and moved to its place when it is complete, so
two drivers never write into one folder: the first to finish is the one that
counts. ``remove_old`` deletes the models of earlier versions and sources.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources import driver_tables as dt
from keelson.sources import schema as S

FORMAT_VERSION = "3"
USAGE_PARTITION = "usage_month"
SOURCES = ("customer", "orders", "lineitem", "part", "events")
USAGE_TABLES = ("usage_events", "usage_orders", "usage_brands")


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def files(spark: SparkSession, path: str) -> list[str]:
    """Path, length and modification time of each file of a table."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return [f"{path}: none"]
    walk, out = fs.listFiles(hpath, True), []
    while walk.hasNext():
        f = walk.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(out)


#: The listing of each table, and what the table's path was like when it was listed.
_LISTED: dict[tuple[str, str], tuple[tuple, list[str]]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple | None:
    """Kind, length and modification time of the path itself; None where that does not
    tell whether files were added or replaced: missing paths, partitioned folders and
    stores that keep no time for a folder."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return None
    s = fs.getFileStatus(hpath)
    return (s.isDirectory(), s.getLen(), s.getModificationTime()) if s.getModificationTime() else None


def _nested(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return any(s.isDirectory() for s in fs.listStatus(hpath))


def listing(spark: SparkSession, path: str) -> list[str]:
    """``files`` of ``path``, listed again only if the file, or the folder that holds all
    files, has changed since. Files of a folder are taken to be replaced by new
    files, as Spark does, not written over; ``forget`` has everything listed again."""
    at, stamp = (spark.sparkContext.applicationId, path), _stamp(spark, path)
    held = _LISTED.get(at)
    if held and stamp and held[0] == stamp:
        return held[1]
    found = files(spark, path)
    if stamp and not (stamp[0] and _nested(spark, path)):
        _LISTED[at] = (stamp, found)
    return found


def forget() -> None:
    """Have every source listed again at its next use."""
    _LISTED.clear()


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Key of a stored model: its source files and the format's version."""
    h = hashlib.sha1(FORMAT_VERSION.encode())
    for name in SOURCES:
        for line in listing(spark, f"{sf_dir.rstrip('/')}/{name}.parquet"):
            h.update(line.encode())
    return h.hexdigest()[:16]


def _complete(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(hpath)


def _publish(spark: SparkSession, writer, path: str) -> None:
    """Write to a folder of its own, then move it to ``path`` unless another
    driver's copy has got there."""
    own = f"{path}.{uuid.uuid4().hex}"
    writer.parquet(own)
    fs, src = _fs(spark, own)
    _, dst = _fs(spark, path)
    if _complete(spark, path) or not fs.rename(src, dst):
        fs.delete(src, True)


def remove_old(spark: SparkSession, sf_dir: str, root: str) -> list[str]:
    """Delete the stored models under ``root`` but that of ``sf_dir`` as it is now."""
    fs, top = _fs(spark, f"{root.rstrip('/')}/keelson/model")
    if not fs.exists(top):
        return []
    old = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName() != fingerprint(spark, sf_dir)]
    for p in old:
        fs.delete(p, True)
    return [p.getName() for p in old]


def _builders(spark: SparkSession, sf_dir: str):
    return {
        "customers": lambda: dt.customers(spark, sf_dir),
        "usage_events": lambda: dt.usage_from_events(spark, sf_dir),
        "usage_orders": lambda: dt.usage_from_orders(spark, sf_dir),
        "usage_brands": lambda: dt.usage_from_orders(spark, sf_dir, "p_brand"),
        "subscription_events": lambda: dt.subscription_events(spark, sf_dir),
        "support_tickets": lambda: dt.support_tickets(spark, sf_dir),
    }


SCHEMAS = {
    "customers": S.CUSTOMERS,
    "usage_events": T.StructType(list(S.FEATURE_USAGE.fields)).add(USAGE_PARTITION, T.StringType()),
    "usage_orders": T.StructType(list(S.FEATURE_USAGE.fields)).add(USAGE_PARTITION, T.StringType()),
    "usage_brands": T.StructType(list(S.FEATURE_USAGE.fields)).add(USAGE_PARTITION, T.StringType()),
    "subscription_events": S.SUBSCRIPTION_EVENTS,
    "support_tickets": S.SUPPORT_TICKETS,
}


_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock(path: str) -> threading.Lock:
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def model_dir(spark: SparkSession, sf_dir: str, root: str) -> str:
    return f"{root.rstrip('/')}/keelson/model/{fingerprint(spark, sf_dir)}"


def stored(spark: SparkSession, path: str, build, schema=None) -> DataFrame:
    """Write ``build()`` to ``path`` unless a complete copy is there; scan it.

    Write-once: a complete table is never rewritten (its path is keyed by
    everything it depends on), so readers are never disturbed, and
    concurrent first uses in one driver wait for a single writer.
    """
    if not _complete(spark, path):
        with _lock(path):
            if not _complete(spark, path):
                df = build()
                _publish(spark, df.write, path)
                schema = schema or df.schema
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def model_table(spark: SparkSession, sf_dir: str, root: str, name: str) -> DataFrame:
    """One table of the model of ``sf_dir``, written under ``root`` first if
    it is not there yet; read with its declared schema (no inference).

    The path is keyed by the sources, so a complete table is never rewritten;
    concurrent first uses in one driver wait for a single writer.
    """
    path = f"{model_dir(spark, sf_dir, root)}/{name}"
    if not _complete(spark, path):
        with _lock(path):
            if not _complete(spark, path):
                _write(spark, sf_dir, name, path)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def _write(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    df = _builders(spark, sf_dir)[name]()
    w = df.write
    if name in USAGE_TABLES:
        # a month is written as a few large files; all columns are range keys, so
        # that a month, or a customer with a third of all rows, still spreads
        # over many write tasks. One shuffle, once
        df = df.withColumn(USAGE_PARTITION, F.date_format("session_date", "yyyy-MM"))
        df = df.repartitionByRange(USAGE_PARTITION, "customer_id", "session_date", "feature", "duration_seconds")
        w = df.write.partitionBy(USAGE_PARTITION)
    _publish(spark, w, path)


def model_tables(spark: SparkSession, sf_dir: str, root: str) -> dict[str, DataFrame]:
    """The whole four-table model of ``sf_dir`` (usage twice: events- and
    order-based), written under ``root`` where missing."""
    return {name: model_table(spark, sf_dir, root, name) for name in SCHEMAS}
