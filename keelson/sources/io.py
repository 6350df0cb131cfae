"""Readers and writers.

CSV is the reference's interchange format; parquet is what a cluster should
store. Both go through one typed schema so that dates are parsed exactly once
at ingest and never inside a filter (a parse expression blocks predicate
pushdown; a typed DATE column does not).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.dates import parse_date
from keelson.sources import schema as S


def typed_from_text(df: DataFrame, name: str) -> DataFrame:
    target = S.TABLES[name]
    cols = []
    for field in target.fields:
        c = F.col(field.name)
        if field.name in S.DATE_COLUMNS.get(name, []):
            c = parse_date(c)
        elif field.name in S.TIMESTAMP_COLUMNS.get(name, []):
            c = F.try_to_timestamp(F.trim(c)).cast("timestamp_ntz")
        elif field.name in S.CATEGORY_COLUMNS.get(name, []):
            c = F.trim(F.lower(c))
        elif isinstance(field.dataType, T.StringType) or field.name == "customer_id":
            cols.append(F.trim(c).alias(field.name))  # ids are text in CSV, whatever they look like
            continue
        elif field.name == "duration_seconds":
            cols.append(F.expr(f"try_cast(trim(`{field.name}`) AS {S.DURATION.simpleString()})").alias(field.name))
            continue
        else:
            c = F.expr(f"try_cast(`{field.name}` AS {field.dataType.simpleString()})")
        cols.append(c.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """Load one of ``customers``, ``feature_usage``, ``subscription_events``,
    ``support_tickets`` (S01).

    ``fmt="csv"``: header row, every column read as text and converted with
    NULL-on-error rules (bad dates become NULL, ``2024-1-5 10:00`` keeps its
    date part); ids are text and durations may have decimals. Columns are
    found by the header's names. ``fmt="parquet"``: columns are selected and
    cast to the schema, ids keep their type, durations their decimals; dates and numbers
    stored as text are converted as in CSV; a missing optional column (``event_id``) is filled with NULL.
    """
    if name not in S.TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted(S.TABLES)}")
    target = S.TABLES[name]
    if fmt == "csv":
        # Read as text and convert once; no schema inference pass over the data.
        raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
               .csv(path))
        for field in target.fields:
            if field.name not in raw.columns:
                raw = raw.withColumn(field.name, F.lit(None).cast("string"))
        return typed_from_text(raw, name)
    df = spark.read.format(fmt).load(path)
    return df.select(*_as_schema(df, target, name))


def _as_schema(df: DataFrame, target: T.StructType, name: str | None = None) -> list:
    """The columns of ``target``, cast; text ids stay text, durations keep their
    decimals, missing columns are NULL. Text where a date or number belongs is
    converted as in CSV: what cannot be read is NULL."""
    kinds, out = dict(df.dtypes), []
    for f in target.fields:
        c, kind, to = F.col(f.name), kinds.get(f.name), f.dataType
        if kind is None:
            c = F.lit(None).cast(to)
        elif f.name == "customer_id" and kind == "string":
            pass
        elif f.name == "duration_seconds" and (kind in ("string", "double", "float") or kind.startswith("decimal")):
            c = F.expr(f"try_cast({'trim(duration_seconds)' if kind == 'string' else 'duration_seconds'} AS {S.DURATION.simpleString()})")
        elif kind == "string" and f.name in S.DATE_COLUMNS.get(name, []):
            c = parse_date(c)
        elif kind == "string" and f.name in S.TIMESTAMP_COLUMNS.get(name, []):
            c = F.try_to_timestamp(F.trim(c)).cast("timestamp_ntz")
        elif kind == "string" and not isinstance(to, T.StringType):
            c = F.expr(f"try_cast(trim(`{f.name}`) AS {to.simpleString()})")
        else:
            c = c.cast(to)
        out.append(c.alias(f.name))
    return out


#: Where a record that does not have as many cells as the header has is kept whole.
_RECORD = "__keelson_record"


def rejects(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What ``read_table`` cannot use of a CSV export: (column, rule, value), a row per
    rejected cell or record. ``read_table`` itself keeps these rows, with NULL cells.

    Rules: ``row_shape`` (a record with fewer or more cells than the header; column is
    NULL, value the record), ``no_id`` (blank customer id), ``bad_date``, ``bad_timestamp``
    and ``bad_number`` (a cell that is not blank and cannot be read). Cells that a
    short record does have are judged too. A column that the export lacks rejects nothing.
    """
    if name not in S.TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted(S.TABLES)}")
    cells = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, _RECORD]])
    # without pruning: a record's cells are counted only if all of them are parsed
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", _RECORD).csv(path))

    def rejected(cond, column: str | None, rule: str, value: str):
        return F.when(cond, F.struct(F.lit(column).cast("string").alias("column"), F.lit(rule).alias("rule"), F.col(value).alias("value")))

    checks = [rejected(F.col(_RECORD).isNotNull(), None, "row_shape", _RECORD)]
    for field in S.TABLES[name].fields:
        c, kind = field.name, field.dataType
        if c not in cells:
            continue
        blank = F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        if c == "customer_id":
            checks.append(rejected(blank, c, "no_id", c))
        elif c in S.DATE_COLUMNS.get(name, []):
            checks.append(rejected(~blank & parse_date(F.col(c)).isNull(), c, "bad_date", c))
        elif c in S.TIMESTAMP_COLUMNS.get(name, []):
            checks.append(rejected(~blank & F.try_to_timestamp(F.trim(F.col(c))).isNull(), c, "bad_timestamp", c))
        elif not isinstance(kind, T.StringType):
            to = S.DURATION if c == "duration_seconds" else kind
            checks.append(rejected(~blank & F.expr(f"try_cast(trim(`{c}`) AS {to.simpleString()})").isNull(), c, "bad_number", c))
    return raw.select(F.explode(F.filter(F.array(*checks), F.isnotnull)).alias("r")).select("r.*")


def reject_counts(found: DataFrame) -> DataFrame:
    """(column, rule, rejected, example) of ``rejects``: a row per column and rule,
    with the least rejected value."""
    return found.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("rejected"), F.min("value").alias("example"))


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load a materialised health-score table."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)  # columns by name; ids stay text
    df = reader.load(path)
    return df.select(*_as_schema(df, S.HEALTH_SCORES))


def write_scores(df: DataFrame, target: str, fmt: str = "parquet", as_table: bool = False) -> None:
    """Replace-and-materialise the score table (S03, DROP IF EXISTS + CREATE AS).

    ``as_table=True`` saves a catalog table named ``target``; otherwise
    ``target`` is a path. Tasks lost with an executor are re-run and only
    committed task output becomes visible; a job that fails as a whole leaves
    the target replaced or missing (as after DROP without CREATE) and is
    simply re-run.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    ``default`` is only used where the session leaves it unset (tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if default is None:
            raise RuntimeError("spark.checkpoint.dir is not set")
        d = default
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")
