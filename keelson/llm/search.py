"""Ranked lexical search by range-maximum tables over posting lists.

1. ``build_index``: each task cuts its documents into index blocks of at most
   ``POSTINGS`` postings, and stores a block as one row: the documents (by length), and for
   each term that a query asks for its posting list (document, occurrences). The
   numbers of documents and terms, and the document frequencies, are sums over blocks.
2. ``search``: each task opens its blocks one by one. A list's impacts get a sparse
   table of the places of range maxima. For each query, intervals of documents go by a bound:
   the sum of the weighted range maxima of its terms. The best interval is split at
   the document of its largest impact; documents next to it (``LEAF`` of them) are scored
   exactly, and the two rests are bounded anew by their own ranges. It ends when no bound reaches the
   k-th best score that the task has for the query, over all its blocks.
3. The best k of each task meet in a window that ranks them per query.

Queries are taken in blocks of ``BLOCK_BYTES`` of text, each with an index of its
own, so what tasks and driver hold is bounded. Scores are whole numbers; the bounds
are exact, so no document is lost.

Defined results: null or empty documents and those without a term take no part;
repeated documents are ranked each by itself; equal scores go by doc_id, null last.
Queries without a term have no result; an item_id with several texts is one query of
all its different texts' terms, equal texts once; a null item_id is a query of its own. Very long texts are
read in pieces, whole. Without documents or without queries the result is empty. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.shared import stored

K = 20
BLOCK_BYTES = 8 << 20
POSTINGS = 1 << 20
LEAF = 256
PIECE = 1 << 20

#: Lower-cases A-Z and turns the other ASCII characters but digits and a-z into spaces.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def read_items(items: DataFrame) -> dict[str | None, Counter]:
    """The terms of each item of a block, by item_id as text."""
    out: dict[str | None, Counter] = {}
    for r in items.collect():  # BLOCK_BYTES of text, or one item
        terms = Counter(t for part in pieces(r["text"]) for t in part)
        out[r["item_id"]] = out.get(r["item_id"], Counter()) + terms
    return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // block_bytes))
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct() for k in range(n)]


INDEX = ("n_docs bigint, n_terms bigint, docs array<bigint>, lengths array<bigint>, terms array<int>, sizes array<int>, places array<int>, "
         "tfs array<int>")
_INDEX = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    *[(c, pa.list_(pa.int32())) for c in ("terms", "sizes", "places", "tfs")]])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], postings: int = POSTINGS) -> DataFrame:
    """Stored index blocks of ``docs`` (doc_id, text) for the terms of ``vocabulary``.

    ``n_docs`` and ``n_terms`` count all documents of a block with a term, and all their
    terms; ``docs`` are those with a term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, lengths: list, terms: list, tfs: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
        order = np.argsort(lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        empty = np.empty(0, np.int64)
        term, tf = np.concatenate([*terms, empty]), np.concatenate([*tfs, empty])
        at = np.repeat(place, [len(t) for t in terms])
        by = np.lexsort((at, term))
        own, sizes = np.unique(term, return_counts=True)
        row = {"n_docs": n_docs, "n_terms": n_terms, "docs": [ids[i] for i in order], "lengths": [lengths[i] for i in order],
               "terms": own, "sizes": sizes, "places": at[by], "tfs": tf[by]}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _INDEX], schema=_INDEX)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids, lengths, terms, tfs, held, n_docs, n_terms = [], [], [], [], 0, 0, 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                n, found = 0, []
                for part in pieces(text.as_py()):
                    n += len(part)
                    mine = np.fromiter((get(t, -1) for t in part), np.int64, len(part))
                    found.append(mine[mine >= 0])
                if not n:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + n
                term, tf = np.unique(np.concatenate(found), return_counts=True)
                if len(term):
                    ids.append(doc_id.as_py())
                    lengths.append(n)
                    terms.append(term)
                    tfs.append(tf)
                    held += len(term)
                if held >= postings:
                    yield block(ids, lengths, terms, tfs, n_docs, n_terms)
                    ids, lengths, terms, tfs, held, n_docs, n_terms = [], [], [], [], 0, 0, 0
        if n_docs:
            yield block(ids, lengths, terms, tfs, n_docs, n_terms)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX), "search-index")


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, their terms with repeats, and the document frequency of each
    term of the vocabulary (one number per term)."""
    n = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l"))
    df = lists.groupBy(F.col("l.terms").alias("term")).agg(F.sum("l.sizes").alias("df"))
    return n["docs"] or 0, n["terms"] or 0, {r["term"]: r["df"] for r in df.collect()}


class Block:
    """An index block, opened for a corpus of ``n`` documents with ``total`` terms."""

    def __init__(self, docs: list, lengths: np.ndarray, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, tfs: np.ndarray, n: int, total: int):
        self.docs, self.size = docs, len(docs)
        self.terms, self.ends, self.places = terms, np.cumsum(sizes), places.astype(np.int64)
        self.starts = self.ends - sizes
        m = 100 - 25 + 25 * lengths.astype(np.int64) * n // total
        tf = tfs.astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.places])
        self.keys = np.repeat(np.arange(len(terms)), sizes) * self.size + self.places
        # table[k][i]: where the largest impact of the postings i to i + 2^k - 1 is; only read within a list
        self.table = [np.arange(len(places), dtype=np.int32)]
        for k in range(int(sizes.max(initial=1)).bit_length() - 1):
            last = self.table[-1]
            ahead = last[np.minimum(np.arange(len(places)) + (1 << k), len(places) - 1)]
            self.table.append(np.where(self.impacts[ahead] > self.impacts[last], ahead, last))
        self.table = np.stack(self.table)

    def largest(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Where the largest impact of each range (not empty) of postings is."""
        k = np.frexp((z - a).astype(np.float64))[1] - 1
        left, right = self.table[k, a], self.table[k, z - (1 << k)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def leaf(self, weights: np.ndarray, a: np.ndarray, z: np.ndarray, low: int, high: int) -> np.ndarray:
        """The scores of the documents from ``low`` to before ``high``, whose postings are given."""
        n = z - a
        at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        scores = np.zeros(high - low, np.int64)
        np.add.at(scores, self.places[at] - low, np.repeat(weights, n) * self.impacts[at])
        return scores


class Best:
    """The k best (score, document) of a query so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, docs: list, low: int) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at):
            new = [(-int(scores[i]), docs[low + i] is None, docs[low + i] or 0) for i in at.tolist()]
            self.rows = heapq.nsmallest(self.k, [*self.rows, *new])
            if len(self.rows) == self.k:
                self.least = -self.rows[-1][0]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, best: Best, leaf: int = LEAF) -> int:
    """Bring ``best`` up to date for a query (distinct terms, ascending, and weights above 0).
    Returns how many documents were scored."""
    at = np.searchsorted(block.terms, terms)
    own = at < len(block.terms)
    own[own] = block.terms[at[own]] == terms[own]
    at, w = at[own], weights[own]
    if not len(at):
        return 0
    base = at * block.size
    cut = lambda place: np.searchsorted(block.keys, base + place)

    def bound(a: np.ndarray, z: np.ndarray) -> tuple[int, int]:
        """The sum of the weighted range maxima, and the document of the largest."""
        some = np.flatnonzero(z > a)
        if not len(some):
            return 0, 0
        top = block.largest(a[some], z[some])
        part = w[some] * block.impacts[top]
        return int(part.sum()), int(block.places[top[part.argmax()]])

    a, z, scored, ties = block.starts[at], block.ends[at], 0, 0
    most, split = bound(a, z)
    heap = [(-most, ties, split, 0, block.size, a, z)]
    while heap:
        most, _, split, low, high, a, z = heapq.heappop(heap)
        if -most < best.least:
            break
        x = max(low, min(split - leaf // 2, high - leaf))
        y = min(high, x + leaf)
        b, c = a if x == low else cut(x), z if y == high else cut(y)
        best.add(block.leaf(w, b, c, x, y), block.docs, x)
        scored += y - x
        for lo, hi, p, q in ((low, x, a, b), (y, high, c, z)):
            if hi > lo:
                most, split = bound(p, q)
                if most >= best.least:
                    ties += 1
                    heapq.heappush(heap, (-most, ties, split, lo, hi, p, q))
    return scored


def weigh(items: dict[str | None, Counter], vocabulary: dict[bytes, int], n: int, df: dict[int, int]) -> list[tuple[str | None, np.ndarray, np.ndarray]]:
    """The terms, ascending, and weights times occurrences, of each query; weights of 0 add nothing."""
    out = []
    for item, terms in items.items():
        rows = sorted((vocabulary[t], c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[vocabulary[t]] + 1)))) for t, c in terms.items() if vocabulary[t] in df)
        rows = [(t, w) for t, w in rows if w > 0]
        if rows:
            out.append((item, np.array([t for t, _ in rows], np.int64), np.array([w for _, w in rows], np.int64)))
    return out


def search(index: DataFrame, queries: list[tuple[str | None, np.ndarray, np.ndarray]], n: int, total: int, k: int = K, leaf: int = LEAF) -> DataFrame:
    """(item_id as text, doc_id, score): the best k of each task for each query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(c)[row].values.to_numpy() for c in ("lengths", "terms", "sizes", "places", "tfs")]
                if not len(lists[0]):
                    continue
                block = Block(batch.column("docs")[row].as_py(), *lists, n, total)
                for q, (_, terms, weights) in enumerate(queries):
                    search_block(block, terms, weights, best[q], leaf)
        rows = [(item, None if none else doc, -score) for (item, _, _), b in zip(queries, best) for score, none, doc in b.rows]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["item_id", "doc_id", "score"])

    columns = [c for c in index.columns if not c.startswith("n_")]
    return index.select(*columns).mapInArrow(run, "item_id string, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, postings: int = POSTINGS, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each item."""
    kind, found = items.schema["item_id"].dataType.simpleString(), []
    for part in item_blocks(items, block_bytes):
        queries = read_items(part)
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in queries.values() for t in terms}))}
        if vocabulary:
            index = build_index(docs, vocabulary, postings)
            n, total, df = statistics(index)
            if weighed := weigh(queries, vocabulary, n, df):
                found.append(search(index, weighed, n, total, k, leaf))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
