"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

1. Vectors are ordered along a Hilbert curve through their ``CURVE_DIMS`` dimensions of the
   widest spread, and stored in Parquet as blocks of ``BLOCK`` rows: one row per block
   with its vectors and its zone map, the least and greatest value of each dimension.
2. Interval arithmetic bounds the inner products of an anchor with a block, from its zone map
   alone. A block is read for an anchor only if these bounds meet what the anchor is
   looking for: first the positives, then the windows of negative scores that follow
   from them. The anchor's own block is read first: what is found there bounds from
   below what another block must reach.
3. The best rows of each task meet in a window per anchor (and positive).

Anchors are taken in chunks of ``CHUNK_BYTES`` of vectors; the zone maps choose the blocks
for a chunk in tasks, and blocks that no anchor needs are dropped by the join with that choice. The
bounds are exact: no row is lost, and ties go by vec_id.

Components become floor(256 x). Defined results: rows with a null vec_id, a null label, a null
vector, or a null or non-finite component take no part, nor do those with a component
beyond +-2^18, whose products might not fit into 64 bits; vectors that are
shorter than the longest count as if zeros followed; equal rows count once; rows that share a vec_id
and differ are rows of their own, but none is a positive of the other; an anchor without positives or without
rows in its windows has no result; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.shared import stored

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, OF = 30, 90, 100
ANCHOR_EVERY = 100
BLOCK = 512
CURVE_DIMS, CURVE_BITS = 8, 6
CHUNK_BYTES = 4 << 20
MAX_COMPONENT = float(1 << 18)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows; values below 2^bits), by
    turning the axes level by level and Gray-decoding."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level & 1)
    return key


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as whole numbers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: F.coalesce(F.abs(c) <= MAX_COMPONENT, F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dims`` numbers, zeros behind short ones."""
    out = np.zeros((len(column), dims), np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return out


BLOCKS = "block bigint, ids array<bigint>, labels array<bigint>, vectors binary, low binary, high binary, kinds array<bigint>"


def store_blocks(rows: DataFrame, dims: int, block: int = BLOCK, curve_dims: int = CURVE_DIMS, bits: int = CURVE_BITS) -> DataFrame:
    """The rows (vec_id, label, v) in blocks along the curve, stored."""
    at = [F.coalesce(F.get("v", F.lit(i)), F.lit(0)).cast("double") for i in range(dims)]
    wide = rows.agg(F.array(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in at]).alias("s"), F.array(*[F.mean(c) for c in at]).alias("m")).first()
    axes = sorted(range(dims), key=lambda i: (-wide["s"][i], i))[:curve_dims]
    mean, spread = np.array([wide["m"][i] for i in axes]), np.array([max(wide["s"][i], 1e-9) for i in axes])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dims)
            cells = np.clip((v[:, axes] - mean) / (5 * spread) + 0.5, 0, 1 - 1e-9) * (1 << bits)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(list(v.astype("<i4")), pa.list_(pa.int32())),
                                              pa.array(hilbert(cells.astype(np.int64), bits))], names=["vec_id", "label", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, n = [], None, spark_partition() << 32
        for b in batches:
            v = matrix(b.column("v"), dims).astype("<i4")
            for i, (vec, label) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist())):
                row = (vec, label, v[i].tobytes())
                if row == last:
                    continue  # an equal row
                held.append(row)
                last = row
                if len(held) == block:
                    yield made(held, n)
                    held, n = [], n + 1
        if held:
            yield made(held, n)

    def made(held: list[tuple[int, int, bytes]], n: int) -> pa.RecordBatch:
        v = np.frombuffer(b"".join(x for _, _, x in held), "<i4").reshape(len(held), dims)
        labels = [x for _, x, _ in held]
        row = [n, [x for x, _, _ in held], labels, v.tobytes(), v.min(0).tobytes(), v.max(0).tobytes(), sorted(set(labels))]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["block", "ids", "labels", "vectors", "low", "high", "kinds"])

    placed = stored(rows.mapInArrow(place, "vec_id bigint, label bigint, v array<int>, place bigint"), "vectors")
    order = ["place", "vec_id", "label", "v"]
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "v").mapInArrow(cut, BLOCKS), "blocks")


def spark_partition() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


class Anchors:
    """A chunk of anchors: vectors and what they look for."""

    def __init__(self, ids: list[int], labels: list[int], vectors: np.ndarray, blocks: list[int]):
        self.ids, self.labels, self.vectors, self.blocks = np.array(ids), np.array(labels), vectors, np.array(blocks)

    def scores(self, of: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Inner products of the anchors ``of`` (rows) with vectors (columns)."""
        a, v = self.vectors[of], vectors.astype(np.int64)
        if int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0)) * a.shape[1] < 1 << 52:
            return (a.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)  # exact, and much faster
        return a @ v.T

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product of each anchor with a vector between ``low`` and ``high``."""
        up, down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        low, high = low.astype(np.int64), high.astype(np.int64)
        return up @ low + down @ high, up @ high + down @ low


Test = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def choose(blocks: DataFrame, test: Test) -> DataFrame:
    """(block, anchors): the anchors (4-byte numbers) for which each block must be read, from its zone map alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, wanted = [], []
            for block, low, high, kinds in zip(*b.columns):
                hit = np.flatnonzero(test(block.as_py(), np.frombuffer(low.as_py(), "<i4"), np.frombuffer(high.as_py(), "<i4"), kinds.values.to_numpy()))
                if len(hit):
                    names.append(block.as_py())
                    wanted.append(hit.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(wanted, pa.binary())], names=["block", "anchors"])

    return stored(blocks.select("block", "low", "high", "kinds").mapInArrow(run, "block bigint, anchors binary"), "chosen")


def first(found: dict, key: tuple, scores: np.ndarray, ids: np.ndarray, n: int) -> None:
    """Keep the n best of ``found[key]`` and the new rows: higher scores first, then smaller ids."""
    if key in found:
        scores, ids = np.append(found[key][0], scores), np.append(found[key][1], ids)
    at = np.lexsort((ids, -scores))[:n]
    found[key] = scores[at], ids[at]


def read(blocks: DataFrame, chosen: DataFrame, anchors, window: Callable[[Anchors, int], list[tuple[int, int]]] | None) -> DataFrame:
    """(anchor, p, vec_id, score): of the chosen blocks the best positives of each
    anchor (p null), or the best negatives within each of its windows (p: the window's number), per task."""
    n = POSITIVES if window is None else NEGATIVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, found = anchors.value, {}
        for b in batches:
            for ids, labels, vectors, wanted in zip(*b.columns):
                of, ids, labels = np.frombuffer(wanted.as_py(), "<i4"), ids.values.to_numpy(), labels.values.to_numpy()
                scores = mine.scores(of, np.frombuffer(vectors.as_py(), "<i4").reshape(len(ids), -1))
                for a, s in zip(of.tolist(), scores):
                    same = labels == mine.labels[a]
                    if window is None:
                        at = np.flatnonzero(same & (ids != mine.ids[a]))
                        if len(at):
                            first(found, (a, 0), s[at], ids[at], n)
                        continue
                    at = np.flatnonzero(~same)
                    at = at[np.lexsort((ids[at], -s[at]))]
                    t = -s[at]
                    for p, (low, high) in enumerate(window(mine, a)):
                        x, y = np.searchsorted(t, -high, "left"), np.searchsorted(t, -low, "right")
                        if x < y:
                            y = min(y, x + n)
                            first(found, (a, p), s[at[x:y]], ids[at[x:y]], n)
        parts = [(np.full(len(s), a), np.full(len(s), p), i, s) for (a, p), (s, i) in found.items()]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "p", "vec_id", "score"])

    rows = blocks.select("block", "ids", "labels", "vectors").join(chosen, "block").select("ids", "labels", "vectors", "anchors")
    found = rows.mapInArrow(run, "anchor bigint, p bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def anchor_rows(blocks: DataFrame, dims: int, every: int) -> DataFrame:
    """(vec_id, label, v, block) of the anchors, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for block, ids, labels, vectors in zip(*b.columns):
                ids, labels = ids.values.to_numpy(), labels.values.to_numpy()
                v = np.frombuffer(vectors.as_py(), "<i4").reshape(len(ids), dims)
                rows += [{"vec_id": int(ids[i]), "label": int(labels[i]), "v": v[i].tobytes(), "block": block.as_py()} for i in np.flatnonzero(ids % every == 0)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("block", pa.int64())]))

    return stored(blocks.select("block", "ids", "labels", "vectors").mapInArrow(run, "vec_id bigint, label bigint, v binary, block bigint"), "anchors")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine_chunk(blocks: DataFrame, chunk: DataFrame) -> DataFrame | None:
    """The result for one chunk of anchors; None if none of them has a positive."""
    spark = blocks.sparkSession
    rows = sorted(chunk.collect())  # CHUNK_BYTES of vectors
    if not rows:
        return None
    anchors = Anchors([r["vec_id"] for r in rows], [r["label"] for r in rows], np.stack([np.frombuffer(r["v"], "<i4") for r in rows]).astype(np.int64),
                      [r["block"] for r in rows])
    shared = spark.sparkContext.broadcast(anchors)

    own = choose(blocks, lambda block, low, high, kinds: shared.value.blocks == block)
    # the last positive that the own block has to offer
    start = np.full(len(rows), np.iinfo(np.int64).min)
    for r in read(blocks, own, shared, None).where(F.col("rank") == POSITIVES).collect():
        start[r["anchor"]] = r["score"]

    def near(block: int, low: np.ndarray, high: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.isin(shared.value.labels, kinds) & (shared.value.bounds(low, high)[1] >= start)

    positives = read(blocks, choose(blocks, near), shared, None).collect()  # POSITIVES rows per anchor of the chunk
    if not positives:
        return None
    by_anchor: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(positives, key=lambda r: (r["anchor"], r["rank"])):
        by_anchor.setdefault(r["anchor"], []).append((r["vec_id"], r["score"]))
    # whole scores within LOW * positive <= OF * negative <= HIGH * positive; empty for a score below 0
    windows = {a: [(-(-LOW * s // OF), HIGH * s // OF) for _, s in ps] for a, ps in by_anchor.items()}
    window = lambda _, a: windows.get(a, [])
    least, most = np.full((len(rows), POSITIVES), np.iinfo(np.int64).max), np.full((len(rows), POSITIVES), np.iinfo(np.int64).min)
    for a, ws in windows.items():
        for p, (low, high) in enumerate(ws):
            if low <= high:
                least[a, p], most[a, p] = low, high
    # the last negative that the own block has to offer
    for r in read(blocks, own, shared, window).where(F.col("rank") == NEGATIVES).collect():
        least[r["anchor"], r["p"]] = max(least[r["anchor"], r["p"]], r["score"])

    def within(block: int, low: np.ndarray, high: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        lower, upper = shared.value.bounds(low, high)
        other = (len(kinds) > 1) | (shared.value.labels != kinds[0])
        return other & ((upper[:, None] >= least) & (lower[:, None] <= most)).any(1)

    found = read(blocks, choose(blocks, within), shared, window)
    names = [(a, p, int(anchors.ids[a]), v, s) for a, ps in by_anchor.items() for p, (v, s) in enumerate(ps)]
    named = spark.createDataFrame(names, "anchor bigint, p bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    out = found.join(F.broadcast(named), ["anchor", "p"])  # POSITIVES rows per anchor of the chunk
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, every: int = ANCHOR_EVERY, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hard negatives of the anchors (vec_id divisible by ``every``) among ``rows`` (vec_id, label, v)."""
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    out = spark.createDataFrame([], RESULT)
    if not dims:
        return out
    blocks = store_blocks(rows, dims, block)
    anchors = anchor_rows(blocks, dims, every)
    chunks = -(-anchors.count() * 4 * dims // chunk_bytes)
    for k in range(chunks):
        part = mine_chunk(blocks, anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(chunks)) == k))
        out = out if part is None else part if k == 0 else out.unionByName(part)
    return out


def mine_embeddings(vectors: DataFrame) -> DataFrame:
    """The hard negatives of ``vectors`` (vec_id, embedding, label), after every seventh
    row's label has been moved on by one."""
    rows = whole_vectors(vectors)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))
