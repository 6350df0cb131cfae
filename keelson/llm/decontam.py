"""Benchmark decontamination by a distributed positional inverted index.

1. ``build_index``: each document's postings, (term, position) sorted by term,
   for the terms of the test set. The index is partitioned by document and
   stored in the shared folder; a frequent term is spread like the documents.
2. ``plan_phrases``: term frequencies come from the stored postings. Of each
   window of a test item its rarest term becomes the anchor, and the two next
   rare ones its checks.
3. ``match_phrases``: lists are intersected after subtracting the offset within
   the item, from the rarest term on: anchor, then its checks, then all other
   terms around it. What is left are exact phrase matches. Proximity matches
   (anchor and checks within ``near`` words, in any order) are counted too.

The test set is read in blocks of ``BLOCK_BYTES`` of text, each with an index
of its own, so what tasks hold is bounded; the results are joined by row.

Defined results: null or wordless documents have no word and no hit; items
without words have no window; repeated documents are judged each by itself,
repeated items count once per item_id (null: the empty string); an empty
benchmark hits nothing; an empty table of documents gives an empty result;
extra columns are ignored or, with ``carry``, handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.shared import aside, back, row_key, small, stored

WINDOW = 13
NEAR = 26
BLOCK_BYTES = 8 << 20
ADDED = ("n_words", "n_hit", "items", "near_items", "contaminated", "spans")

#: Lower-cases A-Z and turns the contract's separators (00-2F, 3A-60, 7B-7F) into spaces.
_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items, dealt into tables of about ``block_bytes`` of text each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text.alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct() for k in range(n)]


def read_block(block: DataFrame) -> tuple[list[tuple[str, list[bytes]]], dict[bytes, int]]:
    """The items of a block as (item_id, words), and the numbers of their terms."""
    items = [(r["item_id"], w) for r in sorted(block.collect()) if (w := words_of(r["text"]))]
    return items, {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}


def build_index(df: DataFrame, vocabulary: dict[bytes, int], carry: list[str]) -> DataFrame:
    """Stored index: ``carry`` columns, __kl_row (unique), n_words, terms, places
    (arrays of equal length: postings of the vocabulary, sorted by term)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    fields = df.select(*carry).schema.fields
    text_at = len(carry)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            lengths, sizes, terms, places = [], [0], [], []
            for text in batch.column(text_at):
                ws = words_of(text.as_py())
                ids = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                by_term = np.argsort(ids[at], kind="stable")
                lengths.append(len(ws))
                sizes.append(sizes[-1] + len(at))
                places.append(at[by_term])
                terms.append(ids[at][by_term])
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32())
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:text_at], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, flat(terms)),
                 pa.ListArray.from_arrays(ends, flat(places))], names=[*carry, "n_words", "terms", "places"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("terms", ints), T.StructField("places", ints)])
    rows = df.select(*carry, F.col("text").alias("__kl_text")).mapInArrow(index, schema)
    return stored(rows.withColumn("__kl_row", F.monotonically_increasing_id()), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """How often each term of the vocabulary stands in all documents."""
    return index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


class Phrases:
    """Items as term numbers with their anchors: arrays with an entry per
    (anchor term, item, offset), sorted by term."""

    def __init__(self, items: list[tuple[str, list[bytes]]], vocabulary: dict[bytes, int], counts: dict[int, int], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.terms = [np.array([vocabulary[w] for w in ws], np.int32) for _, ws in items]
        anchors = {}
        for k, ts in enumerate(self.terms):
            rarity = [(counts.get(int(t), 0), o) for o, t in enumerate(ts)]
            for s in range(max(1, len(ts) - window + 1)):
                (_, o), *rest = sorted(rarity[s:s + window])[:3]
                rest = [x for _, x in rest] + [o] * (2 - len(rest))
                anchors.setdefault((int(ts[o]), k, o, *rest))
        table = np.array(sorted(anchors) or np.empty((0, 5)), np.int64).reshape(-1, 5)
        self.anchor, self.item, self.offset = table[:, 0], table[:, 1], table[:, 2]
        self.checks = table[:, 3:]
        self.flag = np.zeros(len(vocabulary) + 1, bool)
        self.flag[self.anchor] = True
        self.flat = np.concatenate([*self.terms, np.empty(0, np.int32)])
        self.first = np.cumsum([0, *map(len, self.terms)])
        self.length = np.diff(self.first)

    def match(self, n_words: int, terms: np.ndarray, places: np.ndarray, near: int) -> tuple[np.ndarray, set[int], set[int]]:
        """Whether each word is hit; items with exact, and with near matches."""
        hit, exact, close = np.zeros(n_words, bool), set(), set()
        seed = self.flag[terms]
        if not seed.any():
            return hit, exact, close
        at, of = places[seed].astype(np.int64), terms[seed]
        lo, hi = np.searchsorted(self.anchor, of, "left"), np.searchsorted(self.anchor, of, "right")
        entry = np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
        at = np.repeat(at, hi - lo)
        dense = np.full(n_words + 2 * near + 2 * self.window, -1, np.int32)  # padded on both sides
        pad = near + self.window
        dense[places + pad] = terms
        for part in range(0, len(entry), 4096):  # bounds the matrices
            e, p = entry[part:part + 4096], at[part:part + 4096]
            item, offset = self.item[e], self.offset[e]
            wanted = self.flat[self.first[item][:, None] + self.checks[e]]
            around = dense[p[:, None] + pad + np.arange(-near, near + 1)]
            together = (around == wanted[:, :1]).any(1) & (around == wanted[:, 1:]).any(1)
            close.update(np.unique(item[together]).tolist())
            start = p - offset  # offset-adjusted
            fits = together & (dense[np.clip(start[:, None] + self.checks[e] + pad, 0, len(dense) - 1)] == wanted).all(1)
            item, offset, start, p = item[fits], offset[fits], start[fits], p[fits]
            if not len(item):
                continue
            steps = np.arange(1 - self.window, self.window)
            o = offset[:, None] + steps
            inside = (o >= 0) & (o < self.length[item][:, None])
            same = inside & (dense[p[:, None] + pad + steps] == self.flat[np.clip(self.first[item][:, None] + o, 0, len(self.flat) - 1)])
            for row, k, s, off in zip(same, item.tolist(), start.tolist(), offset.tolist()):
                wrong = np.flatnonzero(~row)
                left = wrong[wrong < self.window - 1]
                right = wrong[wrong > self.window - 1]
                a = off + (steps[left[-1]] + 1 if len(left) else 1 - self.window)
                b = off + (steps[right[0]] if len(right) else self.window)
                if b - a >= min(self.window, int(self.length[k])):
                    hit[s + a:s + b] = True
                    exact.add(k)
        return hit, exact, close


def plan_phrases(items, vocabulary: dict[bytes, int], index: DataFrame, window: int = WINDOW) -> Phrases:
    counts = {r["term"]: r["n"] for r in term_counts(index).collect()}  # a row per term of the block at most
    return Phrases(items, vocabulary, counts, window)


def match_phrases(index: DataFrame, phrases: Phrases, carry: list[str], near: int = NEAR) -> DataFrame:
    """``carry``, __kl_row, n_words, spans (hit words: arrays of start, end),
    items and near_items (arrays of item_id) for each row of the index."""
    shared = index.sparkSession.sparkContext.broadcast(cloudpickle.dumps(phrases))
    kept = [*carry, "__kl_row", "n_words"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = cloudpickle.loads(shared.value)
        for batch in batches:
            spans, items, close = [], [], []
            at = len(kept)
            for n, ts, ps in zip(batch.column(at - 1), batch.column(at), batch.column(at + 1)):
                hit, exact, nigh = ph.match(n.as_py(), ts.values.to_numpy(), ps.values.to_numpy(), near)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                items.append(sorted({ph.ids[k] for k in exact}))
                close.append(sorted({ph.ids[k] for k in nigh}))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(close, pa.list_(pa.string()))],
                names=[*kept, "spans", "items", "near_items"])

    text = T.ArrayType(T.StringType())
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*index.select(*kept).schema.fields, T.StructField("spans", span), T.StructField("items", text), T.StructField("near_items", text)])
    return index.select(*kept, "terms", "places").mapInArrow(search, schema)


def covered(spans: Column) -> Column:
    """How many words an array of spans covers, spans may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.sort_array(spans), zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"),
        F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["n"])


def find_contamination(df: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW,
                       near: int = NEAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` (its columns ``carry``, default all) with n_words, n_hit, spans (hit
    words), items, near_items and contaminated (hit words are at least a twentieth)."""
    carry = [c for c in carry or df.columns if c not in ADDED]
    blocks = item_blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        found = search_block(df, blocks[0], carry, window, near)
    else:  # each block searches all rows; what it finds is joined by a stored row number
        rows = stored(df.select(*carry, F.col("text").alias("__kl_text")).withColumn("__kl_id", F.monotonically_increasing_id()), "rows")
        parts = [search_block(rows.select("__kl_id", F.col("__kl_text").alias("text")), b, ["__kl_id"], window, near).drop("__kl_row") for b in blocks]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        merged = both.groupBy("__kl_id").agg(F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])
        merged = merged.withColumns({c: F.sort_array(F.array_distinct(c)) for c in ("items", "near_items")})
        found = rows.drop("__kl_text").join(merged, "__kl_id")
    out = found.withColumn("n_hit", covered(F.col("spans")).cast("long"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(*carry, *ADDED)


def search_block(df: DataFrame, block: DataFrame, carry: list[str], window: int, near: int) -> DataFrame:
    items, vocabulary = read_block(block)
    index = build_index(df, vocabulary, carry)
    return match_phrases(index, plan_phrases(items, vocabulary, index, window), carry, near)


def judge_documents(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(df, benchmark, carry=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"),
                        "contaminated")


def clean_documents(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` that are not contaminated, unchanged."""
    rows = row_key(aside(df)).withColumn("text", F.col("`__in_text`"))
    found = find_contamination(rows.select("__kl_key", "text"), benchmark, carry=["__kl_key"])
    gone = stored(found.where("contaminated").select("__kl_key").distinct(), "contaminated")
    return back(rows.join(small(gone), "__kl_key", "left_anti"))
