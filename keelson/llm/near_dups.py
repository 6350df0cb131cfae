"""N-gram Jaccard join by parity sketches.

1. Each text becomes its set of word shingles (64-bit hashes), and the set two
   parity sketches: one for its size band, one for the band below, where its
   smaller partners are. Equal sets have one number (62 bits of a digest) and form
   a class at once. Parity bits are stored; sets are made anew where they are needed.
2. Two sets that link differ in at most D shingles, D from the size band, so of
   D + 1 sketch words one is equal: classes are joined on (band, block, word). Tasks pack
   these keys, 14 bytes each, and they are shuffled once; keys that no other class has
   end there, and so do pairs that share fewer words than a link must.
3. Within such a bucket the Hamming distance of the sketches, a lower bound of
   the symmetric difference, rules out most pairs. The others are verified by
   the exact intersection of the sets.
4. Links make components. Pairs within a component need no check, so:
   round 1 looks at pairs within chunks of a bucket (and with its first class),
   of which it proposes a spanning forest; round 2 does so for classes that are
   still apart, chunk against chunk; the last round verifies all pairs that
   are still apart and within the bound. Nothing is capped.

Buckets are cut into chunks of ``CHUNK`` classes, so no task holds a group. Work
beyond the rows is done only for classes that share a sketch word with others
but do not link with most of them.

Defined results: null and wordless texts have an empty set and link with
nothing; texts with fewer than ``width`` words are one shingle; rows with a null
doc_id are returned, but take no part (component_id null); repeated rows are
returned as often as they come; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import parity
from keelson.llm.components import components
from keelson.llm.shared import aside, back, small, stored

WIDTH, NUM, DEN = 3, 90, 100
CHUNK = 512


def over_texts(rows: DataFrame, of_set: Callable[[np.ndarray], dict], schema: str, names: list[str], width: int) -> DataFrame:
    """For each row (carried columns, then ``text`` last), the carried columns and what ``of_set`` makes of its shingles."""
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of_set(parity.shingles(t.as_py(), width)) for t in batch.column(n)]
            arrays = [[m[name] for m in made] for name in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[_column(x) for x in arrays]], names=[*batch.schema.names[:n], *names])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{carried}, {schema}")


def _column(values: list) -> pa.Array:
    if values and isinstance(values[0], np.ndarray):
        ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).view(np.int64), pa.int64()))
    return pa.array(values, pa.int64() if not values or values[0] is None or isinstance(values[0], int) else pa.binary())


def _own(h: np.ndarray) -> dict:
    return {"n": len(h), "node": parity.node(h) if len(h) else None}


def set_ids(docs: DataFrame, width: int, *carry: str) -> DataFrame:
    """The columns ``carry``, doc_id, n (size of the set) and node (number of the set, null if empty) of each row."""
    return over_texts(docs.select(*carry, "doc_id", "text"), _own, "n bigint, node bigint", ["n", "node"], width)


def sketches(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, node, own, below (the parity bits of both sketches) of each row."""
    def of_set(h: np.ndarray) -> dict:
        bands = parity.Bands(num, den)
        return _own(h) | {"own": parity.parity_bits(h, bands, 0) if len(h) else b"", "below": parity.parity_bits(h, bands, 1) if len(h) else b""}

    return over_texts(docs, of_set, "n bigint, node bigint, own binary, below binary", ["n", "node", "own", "below"], width)


#: A key's row within its part: 40 bits of the key, how many more words a link of the member shares, and the member.
_ENTRY = np.dtype([("key", "<u4"), ("more", "u1"), ("extra", "u1"), ("member", "<i8")])
KEYS_PER_PART, HELD_KEYS = 1_000_000, 4_000_000


def bucket_keys(docs: DataFrame, width: int, num: int, den: int, parts: int, batch_keys: int = KEYS_PER_PART) -> DataFrame:
    """(part, entries): the sketch words of each set that others may share, packed by
    the task: ``entries`` are the key and member of many words whose keys fall into one part.

    ``member`` is 2 * node, plus 1 if the word is of the band below. Of the D + 1
    + spare words of a set D at most differ from its partner's, so up to
    ``spare`` words may be left out: those of blocks without shingles."""
    def packed(key: list[np.ndarray], member: list[np.ndarray], extra: list[np.ndarray]) -> pa.RecordBatch:
        k, m, x = np.concatenate(key), np.concatenate(member), np.concatenate(extra)
        part = ((k >> parity.U(32)) * parity.U(parts) >> parity.U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        entries = np.empty(len(k), _ENTRY)
        entries["key"], entries["more"] = k[order] & parity.U(0xFFFFFFFF), k[order] >> parity.U(32) & parity.U(0xFF)
        entries["member"], entries["extra"] = m[order], x[order]
        own, start = np.unique(part[order], return_index=True)
        ends = [*start[1:], len(k)]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([entries[a:z].tobytes() for a, z in zip(start, ends)], pa.binary())], names=["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = parity.Bands(num, den)
        key, member, extra, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                h = parity.shingles(text.as_py(), width)
                if not len(h) or not doc_id.is_valid:
                    continue
                node = parity.node(h)
                for down in (0, 1):
                    words, at, band, more = parity.key_words(h, bands, down)
                    key.append(parity.mix(words ^ parity.mix(at + parity.U(band << 32))))
                    member.append(np.full(len(words), 2 * node + down, np.int64))
                    extra.append(np.full(len(words), min(more, 255), np.uint8))
                    held += len(words)
                if held >= batch_keys:
                    yield packed(key, member, extra)
                    key, member, extra, held = [], [], [], 0
        if held:
            yield packed(key, member, extra)

    return docs.mapInArrow(run, "part bigint, entries binary")


class Part:
    """The entries of one part. Lone keys go; what is kept is bounded, whatever one key holds:
    beyond ``most`` entries the members of shared keys are handed out, and those keys noted."""

    def __init__(self, most: int = HELD_KEYS):
        self.most, self.held, self.n, self.known = most, [], 0, np.empty(0, np.int64)

    def add(self, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(key, member) of shared keys that cannot be held longer."""
        e = np.frombuffer(data, _ENTRY)
        key, member, extra, out = e["key"].astype(np.int64) | e["more"].astype(np.int64) << 32, e["member"].astype(np.int64), e["extra"].copy(), None
        if len(self.known):
            shared = np.isin(key, self.known)
            out, key, member, extra = (key[shared], member[shared]), key[~shared], member[~shared], extra[~shared]
        self.held.append((key, member, extra))
        self.n += len(key)
        if self.n > self.most:
            key, member, extra, first, size = self.sorted()
            lone = np.repeat(size == 1, size)
            self.known = np.union1d(self.known, key[first[size > 1]])
            self.held, self.n = [(key[lone], member[lone], extra[lone])], int(lone.sum())
            self.most = max(self.most, 2 * self.n)
            more = key[~lone], member[~lone]
            out = more if out is None else tuple(map(np.concatenate, zip(out, more)))
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, member, extra) in order, and where each key begins and how many members it has."""
        key, member, extra = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((member, key))
        key, member, extra = key[order], member[order], extra[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])]) if len(key) else np.empty(0, bool)
        key, member, extra = key[new], member[new], extra[new]
        _, first, size = np.unique(key, return_index=True, return_counts=True)
        return key, member, extra, first, size

    def rest(self) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y, keys they share, keys that a link shares at least) of keys with
        two members, and (key, member) of larger ones."""
        key, member, extra, first, size = self.sorted()
        two, more = first[size == 2], np.repeat(size > 2, size)
        pairs = np.stack([member[two], member[two + 1], 1 + np.minimum(extra[two], extra[two + 1]).astype(np.int64)], 1)
        pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(two) else (np.empty((0, 3), np.int64), np.empty(0, np.int64))
        return (pairs[:, 0], pairs[:, 1], times.astype(np.int64), pairs[:, 2]), (key[more], member[more])


def shared_keys(entries: DataFrame, parts: int, most: int = HELD_KEYS) -> DataFrame:
    """(key, x, y, times, need): x is a member of the shared key; without a key, x
    and y share ``times`` of them that no other has, and a link shares ``need`` at least."""
    names = ["key", "x", "y", "times", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(n: int, **columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(n, pa.int64()) for c in names], names=names)

        def ended(part: int, mine: Part) -> Iterator[pa.RecordBatch]:
            (x, y, times, need), (key, member) = mine.rest()
            yield rows(len(x), x=x, y=y, times=times, need=need)
            yield rows(len(key), key=key | part << 40, x=member)

        at, mine = None, None
        for batch in batches:
            for part, data in zip(*batch.columns):
                if part.as_py() != at:
                    if mine:
                        yield from ended(at, mine)
                    at, mine = part.as_py(), Part(most)
                if (out := mine.add(data.as_buffer())) is not None and len(out[0]):
                    yield rows(len(out[0]), key=out[0] | at << 40, x=out[1])
        if mine:
            yield from ended(at, mine)

    schema = ", ".join(f"{c} bigint" for c in names)
    return entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def bucket_members(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that share a key (key, member, node), and the buckets (key, size,
    first). Most buckets hold two sets: these pairs are taken once, and only if they
    share as many words as a link does. A link that shares fewer words in buckets of
    two shares others in larger buckets, and is found there. Of larger buckets with the
    same members (told apart by 128 bits) one stands for all: it holds the same pairs."""
    pairs = shared.where("key IS NULL").groupBy("x", "y").agg(F.sum("times").alias("times"), F.min("need").alias("need"))
    pairs = pairs.where("times >= need").select("x", "y", F.xxhash64("x", "y", F.lit("pair")).alias("key"))
    larger = stored(shared.where("key IS NOT NULL").select("key", F.col("x").alias("member")).distinct(), "larger")
    signs = [F.bit_xor(F.xxhash64("member", F.lit(i))).alias(f"sign{i}") for i in (0, 1)]
    alike = larger.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("first"), *signs)
    once = stored(alike.groupBy("size", "first", "sign0", "sign1").agg(F.min("key").alias("key")).select("key"), "larger-once")
    larger = larger.join(small(once), "key", "left_semi")
    members = stored(pairs.select("key", F.explode(F.array("x", "y")).alias("member")).unionByName(larger), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("member").alias("first"))
    return members.withColumn("node", F.expr("member div 2")), sizes


def _tiles(batches: Iterator[pd.DataFrame], all_pairs: bool, num: int, den: int) -> Iterator[pd.DataFrame]:
    """Pairs proposed by each tile of rows sorted by (key, tile): those within the
    bound whose components differ, all or a spanning forest of them."""
    def propose(t: pd.DataFrame) -> pd.DataFrame | None:
        if len(t) < 2:
            return None
        blocks = t["words"].map(len)
        if blocks.nunique() > 1:  # keys of two bands that agree in the bits kept
            parts = [p for _, one in t.groupby(blocks) if (p := propose(one)) is not None]
            return pd.concat(parts) if parts else None
        node, comp, n, side = (t[c].to_numpy() for c in ("node", "comp", "n", "side"))
        words = np.stack([np.frombuffer(x, np.uint8) for x in t["words"]])
        found = []
        for i in range(len(t) - 1):
            rest = slice(i + 1, None)
            open_ = (comp[rest] != comp[i]) & ((side[rest] != side[i]) | (side[i] == 0))
            at = np.flatnonzero(open_) + i + 1
            if not len(at):
                continue
            most = (n[at] + n[i]) * (den - num) // (den + num)
            at, most = at[abs(n[at] - n[i]) <= most], most[abs(n[at] - n[i]) <= most]
            apart = np.bitwise_count(words[at] ^ words[i]).sum(1, dtype=np.int64)
            ok = apart <= most
            found += [(d - m, i, j) for d, m, j in zip(apart[ok].tolist(), most[ok].tolist(), at[ok].tolist())]
        if not all_pairs:
            root = {c: c for c in comp.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            forest = []
            for _, i, j in sorted(found):
                a, b = top(int(comp[i])), top(int(comp[j]))
                if a != b:
                    root[a] = b
                    forest.append((0, i, j))
            found = forest
        if not found:
            return None
        i, j = np.array([x[1] for x in found]), np.array([x[2] for x in found])
        return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        ends = np.flatnonzero((np.diff(rows["key"].to_numpy()) != 0) | (np.diff(rows["tile"].to_numpy()) != 0)) + 1
        out = [p for x, y in zip([0, *ends[:-1]], ends) if (p := propose(rows.iloc[x:y])) is not None]
        held = rows.iloc[ends[-1]:] if len(ends) else rows
        if out:
            yield pd.concat(out).drop_duplicates()
    if held is not None and (p := propose(held)) is not None:
        yield p


def proposals(tiles: DataFrame, bits: DataFrame, all_pairs: bool, num: int, den: int) -> DataFrame:
    """``tiles`` (key, tile, side, member, node, comp) to distinct pairs (a, b) of
    nodes. Rows are compared if their sides differ or are both 0."""
    words = F.when(F.col("member") % 2 == 1, F.col("below")).otherwise(F.col("own")).alias("words")
    rows = tiles.join(bits, "node").select("key", "tile", "side", "node", "comp", "n", words)
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    return rows.mapInPandas(lambda it: _tiles((b for b in it if len(b)), all_pairs, num, den), "a bigint, b bigint").distinct()


def first_tiles(members: DataFrame, buckets: DataFrame, chunk: int) -> DataFrame:
    """The chunks of each bucket, each with the bucket's first class."""
    rows = members.join(buckets, "key").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("long"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    tiles = F.when(F.col("member") == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    return rows.select("key", F.explode(tiles).alias("tile"), F.lit(0).alias("side"), "member", "node", F.col("node").alias("comp"))


def open_tiles(members: DataFrame, comps: DataFrame, chunk: int) -> DataFrame:
    """Buckets that hold several components: chunks of the classes outside of the
    largest component against each other, and against those inside."""
    rows = stored(members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), "members")
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size")).where("size > top.c")
    per = per.select("key", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.c")) / chunk).cast("long").alias("u"),
                     F.ceil(F.col("top.c") / chunk).cast("long").alias("h"))
    rows = rows.join(per, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.expr("comp = main"), F.col("h")).otherwise(F.col("u"))))
    inside = "transform(sequence(0L, u - 1), x -> struct(x * (u + h) + u + i AS tile, 1 AS side))"
    outside = ("concat(transform(sequence(0L, h - 1), x -> struct(i * (u + h) + u + x AS tile, if(x = 0, 0, 2) AS side)),"
               " transform(filter(sequence(0L, u - 1), x -> x != i),"
               " x -> struct(least(i, x) * (u + h) + greatest(i, x) AS tile, if(i < x, 2, 1) AS side)))")
    return rows.select("key", "member", "node", "comp", F.explode(F.expr(f"if(comp = main, {inside}, {outside})")).alias("t")).select(
        "key", "t.tile", "t.side", "member", "node", "comp")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs of classes whose sets link, by exact intersection."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node"), "nodes")
    of_set = lambda h: {"n": len(h), "id": parity.node(h) if len(h) else None, "hashes": h}
    texts = docs.join(small(nodes), "doc_id").select("node", "text")  # a doc_id may stand for other texts too
    sets = over_texts(texts, of_set, "n bigint, id bigint, hashes array<bigint>", ["n", "id", "hashes"], width)
    sets = stored(sets.where("id = node").select("node", "n", "hashes").dropDuplicates(["node"]), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def near_copy_sets(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """The columns of ``join_near_copies`` and the row's node."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(sketches(docs, width, num, den), "sketches")
    able = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = stored(able.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")
    # keys of a set, about: two sketches of a word per shingle that may differ, and a few more
    most = able.agg(F.sum(F.col("n") * (2 * (den - num) / den) + 16).alias("keys")).first()["keys"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(most) // KEYS_PER_PART + 1)
    shared = stored(shared_keys(bucket_keys(docs, width, num, den, parts), parts), "buckets")
    members, buckets = bucket_members(shared)
    close = stored(members.select("node").distinct(), "close")
    bits = stored(able.join(small(close), "node").select("node", "n", "own", "below").dropDuplicates(["node"]), "parities")

    tried = stored(proposals(first_tiles(members, buckets, chunk), bits, False, num, den), "pairs")
    links = stored(verify(tried, docs, classes, width, num, den), "links")
    comps = components(links)
    for all_pairs in (False, True):
        tiles = open_tiles(members, comps, chunk)
        pairs = stored(proposals(tiles, bits, all_pairs, num, den).join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            if all_pairs:
                break
            continue
        links = stored(links.unionByName(verify(pairs, docs, classes, width, num, den)), "links")
        tried = stored(tried.unionByName(pairs), "pairs")
        comps = components(links)

    of = classes.join(comps, "node")
    least = stored(of.groupBy("component").agg(F.min("doc_id").alias("least")), "components")
    of = of.join(small(least), "component").select("node", F.col("least").alias("linked"))
    out = rows.select("doc_id", "n", "node").join(classes.withColumnRenamed("doc_id", "first"), "node", "left").join(small(stored(of, "linked")), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "first", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node")


def join_near_copies(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by
    links, itself included) of each row of ``docs`` (doc_id: a whole number)."""
    return near_copy_sets(docs, width, num, den, chunk).drop("node")


def keep_one(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """One document of each component, that with the smallest doc_id; repeated
    rows with that doc_id and rows without doc_id stay. If a doc_id stands for
    several texts, each of them is judged by itself."""
    found = near_copy_sets(docs, width, **how).where("doc_id IS NOT NULL").withColumn("goes", F.col("component_id") < F.col("doc_id"))
    gone = stored(found.groupBy(F.col("doc_id").alias("__kl_gone")).agg(F.every("goes").alias("whole"), F.some("goes").alias("part")).where("part"), "gone")
    kept = docs.join(small(gone.select("__kl_gone")), F.col("doc_id") == F.col("__kl_gone"), "left_anti")
    mixed = gone.where("NOT whole").select("__kl_gone")
    if not mixed.limit(1).count():
        return kept
    sets = found.where("goes").join(small(mixed), F.col("doc_id") == F.col("__kl_gone"))
    sets = stored(sets.select("__kl_gone", F.col("node").alias("__kl_set")).distinct(), "gone-sets")
    rows = aside(docs.join(small(mixed), F.col("doc_id") == F.col("__kl_gone"), "left_semi"), "doc_id", "text")
    rows = set_ids(rows, width, *[c for c in rows.columns if c.startswith("__in_")])
    same = (F.col("doc_id") == F.col("__kl_gone")) & (F.col("node") == F.col("__kl_set"))
    return kept.unionByName(back(rows.join(small(sets), same, "left_anti")))
