"""Document fingerprints by I-Match (DataFrame functions only).

1. ``lexicon``: the terms whose inverse document frequency ln(documents / df) lies
   within a chosen band. Terms so common that they tell nothing, and terms so rare
   that they may be slips, are out. As each lexicon term is in at least
   ``documents / e^max_idf`` documents, the lexicon holds at most
   ``e^max_idf`` times the mean number of distinct terms of a document, however
   large the corpus: it is small enough to be a value of the query.
2. A document's distinct lexicon terms are sorted, and hashed. Besides the whole
   lexicon, ``SEEDS`` chains of ``LEVELS`` randomised subsets are hashed, each of
   which keeps a random half of the one before: subsets with few terms survive a
   large edit, those with many tell close texts apart.
3. The likeness of two fingerprints is the share of equal hashes among the
   subsets in which at least one of both has a term.

A document with fewer than ``MIN_TERMS`` lexicon terms is fingerprinted by all its
terms. Terms are told apart by 64-bit hashes.

Defined results: null and empty texts, and texts without a term, have a
fingerprint without hashes, which is wholly like another such one (1) and not like
any other (0); equal texts have equal fingerprints; very long texts are taken whole;
an empty table gives an empty result; extra columns are ignored. Next documents: rows
go by descending doc_id (null last), rows with one doc_id by the hash of their
text; equal rows follow each other; the only row of a table is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.shared import let, stored

#: Inverse document frequencies of lexicon terms: in a tenth to a thousandth of the documents.
MIN_IDF, MAX_IDF = 2.302, 6.908
MIN_TERMS = 8
SEEDS, LEVELS = 8, 8
LEXICON_BUCKETS = 1 << 14
#: Terms are runs of ASCII letters, digits and all characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_hashes(text: Column) -> Column:
    """The hashes of the distinct terms of a text, sorted."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    hashes = F.array_distinct(F.transform(parts, lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF, text: str = "text") -> DataFrame:
    """(term, df, idf) of the band, stored: document frequencies over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return stored(counts.withColumn("idf", F.log(F.lit(float(max(n, 1))) / F.col("df"))).where(F.col("idf").between(min_idf, max_idf)), "lexicon")


def lookup(terms: DataFrame, buckets: int = LEXICON_BUCKETS) -> Column:
    """The lexicon as one value: an array with the terms of each hash bucket."""
    lists = terms.groupBy(F.pmod("term", F.lit(buckets)).alias("b")).agg(F.collect_list("term").alias("t"))
    every = terms.sparkSession.range(buckets).select(F.col("id").alias("b")).join(lists, "b", "left")
    rows = F.collect_list(F.struct("b", F.coalesce("t", F.array().cast("array<bigint>")).alias("t")))
    return every.agg(F.transform(F.sort_array(rows), lambda x: x["t"]).alias("t")).scalar()


def hashes(text: Column, known: Column, buckets: int = LEXICON_BUCKETS, min_terms: int = MIN_TERMS) -> Column:
    """The hashes (ints; null for a subset without a term) of a text: whole lexicon first, then the chains."""
    def of(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.hash(terms))

    def chain(terms: Column, level: int) -> Column:
        half = F.filter(terms, lambda x: F.shiftright(x, level).bitwiseAND(F.lit(1)) == 0)
        return let(half, lambda h: F.concat(F.array(of(h)), chain(h, level + 1)) if level + 1 < LEVELS else F.array(of(h)))

    def chosen(terms: Column) -> Column:
        inside = F.filter(terms, lambda x: F.array_contains(F.get(known, F.pmod(x, F.lit(buckets)).cast("int")), x))
        return let(inside, lambda i: F.when(F.size(i) >= min_terms, i).otherwise(terms))

    def all_of(terms: Column) -> Column:
        mixed = lambda seed: F.transform(terms, lambda x: F.xxhash64(x, F.lit(seed)))
        return F.concat(F.array(of(terms)), *[let(mixed(k), lambda x: chain(x, 0)) for k in range(SEEDS)])

    return let(let(term_hashes(text), chosen), all_of)


def written(h: Column) -> Column:
    """A fingerprint as text: its hashes in order, ``-`` for none."""
    return F.array_join(h.cast("array<string>"), " ", "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of hashes."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
    return let(F.filter(same, F.isnotnull), lambda s: F.when(F.size(s) == 0, F.lit(1.0)).otherwise(
        F.aggregate(s, F.lit(0), lambda n, x: n + x) / F.size(s)))


def fingerprints(docs: DataFrame, known: DataFrame | None = None, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text, over the lexicon ``known`` (default: that of ``docs``)."""
    rows = docs.drop(out).withColumn("__kl_known", lookup(lexicon(docs, text=text) if known is None else known))
    return rows.withColumn(out, written(hashes(F.col(text), F.col("__kl_known")))).drop("__kl_known")


def at_most(cuts: Column, key: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``cuts`` are not above ``key``, by bisection."""
    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        return let(mid, lambda m: F.when(s["low"] >= s["high"], s).when(
            F.get(cuts, m) <= key, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), m.alias("high"))))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda s: s["low"])


def with_next(rows: DataFrame, doc_id: str, carry: list[str]) -> DataFrame:
    """``rows`` with a struct ``__kl_next`` of the columns ``carry`` of the next row, by
    descending ``doc_id``, after the last the first.

    Rows are cut into ranges of that order at sampled keys, more of them than
    shuffle partitions, so that a doc_id with many texts is cut too. The first row of
    each range also goes to the end of the range before it."""
    spark = rows.sparkSession
    place = F.struct(F.bitwise_not(F.coalesce(F.col(doc_id).cast("long"), F.lit(-2 ** 63).cast("long"))).alias("o"), F.xxhash64(*carry[:1]).alias("h"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(place.alias("k")).repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    cuts = stored(keys.select("k"), "ranges")  # n rows at most
    many = cuts.count()
    first = F.col("__kl_first")
    rows = rows.withColumn("__kl_first", cuts.agg(F.sort_array(F.collect_list("k")).alias("k")).scalar())
    rows = rows.withColumn("__kl_k", place).withColumn("__kl_r", at_most(first, F.col("__kl_k"), many) - 1)
    own = F.struct(F.col("__kl_r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("__kl_r") - 1, F.lit(max(many, 1))).alias("r"), F.lit(True).alias("guest"))
    starts = F.get(first, F.col("__kl_r")) == F.col("__kl_k")
    rows = rows.withColumn("__kl_at", F.explode(F.when(starts, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("__kl_at.r").orderBy("__kl_at.guest", "__kl_k")
    rows = rows.withColumn("__kl_next", F.lead(F.struct(*carry)).over(order))
    return rows.where("NOT __kl_at.guest").drop("__kl_k", "__kl_r", "__kl_at", "__kl_first")


def compare_documents(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of each document, over the lexicon of ``docs``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lookup(lexicon(docs, min_idf, max_idf))
    rows = docs.withColumn("known", known).select("doc_id", "text", hashes(F.col("text"), F.col("known")).alias("hashes"))
    rows = with_next(rows, "doc_id", ["text", "hashes"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("__kl_next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "hashes", F.col("__kl_next.hashes").alias("next"), edited.alias("edited"))
    rows = rows.withColumn("known", known).withColumn("edited_hashes", hashes(F.col("edited"), F.col("known"))).drop("known")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("hashes")).alias("fingerprint"),
        written(F.col("edited_hashes")).alias("edited_fingerprint"), likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next")).alias("near_next"))
