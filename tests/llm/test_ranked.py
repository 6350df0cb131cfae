"""Ranked search and hard negatives against brute force; edge rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cases import table_of
from keelson.llm import negatives, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_ranks(docs, items, k=20):
    split = [(d, TERM.findall((t or "").translate(ASCII_LOWER))) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = {}
    for item in {i for i, _ in items}:
        terms = Counter(t for text in {t or "" for i, t in items if i == item} for t in TERM.findall(text.translate(ASCII_LOWER)))
        rows = []
        for d, w in split:
            tf, m = Counter(w), 75 + 25 * len(w) * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t, c in terms.items() if tf[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        for r, (s, none, d) in enumerate(sorted(rows)[:k], 1):
            out[item, r] = (None if none else d, -s)
    return out


def ranks(spark, docs, items, **how):
    rows = search.rank_documents(table_of(spark, docs, "doc_id long, text string"), table_of(spark, items, "item_id long, text string"), **how).collect()
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


DOCS = [(1, "The cat sat, on the CAT mat"), (2, "a dog"), (3, None), (4, ""), (5, "... ?! "), (6, "cat cat cat dog"), (6, "cat cat cat dog"),
        (None, "dog mat"), (7, "Äpfel äpfel naïve"), (8, "mat " * 5000 + "end"), (9, "other words entirely"), (-3, "a dog")]
ITEMS = [(1, "cat dog dog"), (2, "MAT the"), (3, None), (4, "?!"), (5, "Äpfel"), (6, "unknown"), (7, "end"), (7, "end"), (7, "a"), (None, "dog")]


@pytest.mark.parametrize("how", [{}, {"postings": 3, "leaf": 1}, {"block_bytes": 4}, {"k": 2, "leaf": 2}])
def test_ranks_of_edge_rows(spark, how):
    assert ranks(spark, DOCS, ITEMS, **how) == brute_ranks(DOCS, ITEMS, how.get("k", 20))


def test_ranks_of_random_texts(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(700)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(300)]  # ties
    items = [(i, " ".join(word() for _ in range(12))) for i in range(15)] + [(99, "w1 w2")]
    for how in ({}, {"postings": 200, "leaf": 4}):
        assert ranks(spark, docs, items, **how) == brute_ranks(docs, items)


def test_search_prunes():
    """The bounds leave most documents unscored when few can be among the best."""
    rng = np.random.default_rng(1)
    n = 20_000
    tf = rng.integers(1, 3, n)
    tf[rng.integers(0, n, 30)] = 500
    block = search.Block(list(range(n)), np.full(n, 1000), np.array([0]), np.array([n]), np.arange(n), tf, n, n * 1000)
    best = search.Best(20)
    scored = search.search_block(block, np.array([0]), np.array([7]), best, leaf=16)
    assert scored < n / 10
    exact = sorted((-7 * int(x), d) for d, x in enumerate(block.impacts))[:20]
    assert [(s, d) for s, _, d in best.rows] == exact


def test_ranks_of_pieces(spark, monkeypatch):
    text = " ".join(f"t{i % 7}" for i in range(50))
    whole = [t for part in search.pieces(text) for t in part]
    monkeypatch.setattr(search, "PIECE", 10)
    assert [t for part in search.pieces(text) for t in part] == whole == text.encode().split()


def test_ranks_of_empty_tables(spark):
    assert ranks(spark, [], ITEMS) == {} == ranks(spark, DOCS, [])


def test_ranks_ignore_other_columns(spark):
    docs = table_of(spark, [(1, "cat", "x", 5)], "doc_id long, text string, item_id string, score int")
    items = table_of(spark, [(1, "cat", "y")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in search.rank_documents(docs, items).collect()] == [(1, 1, 1, brute_ranks([(1, "cat")], [(1, "cat")])[1, 1][1])]


# ------------------------------------------------------------- hard negatives

def test_hilbert_visits_each_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert(cells, bits)
        order = np.argsort(keys)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (50, 9))
    a = negatives.Anchors([0] * 6, [0] * 6, rng.integers(-200, 200, (6, 9)), [0] * 6)
    low, high = a.bounds(v.min(0), v.max(0))
    s = a.scores(np.arange(6), v)
    assert (s >= low[:, None]).all() and (s <= high[:, None]).all()
    big = negatives.Anchors([0], [0], np.full((1, 3), 1 << 26), [0])
    assert big.scores(np.array([0]), np.full((1, 3), (1 << 26) - 1)).tolist() == [[3 * (1 << 26) * ((1 << 26) - 1)]]


def brute_negatives(rows, every):
    rows = [(i, y, np.array([math.floor(256 * c) for c in v], object)) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(c is not None and abs(c) <= 2 ** 18 for c in v)]
    rows = [*{(i, y, tuple(v)): (i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows}.values()]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    out = []
    for i, y, v in (r for r in rows if r[0] % every == 0):
        scored = sorted((-dot(v, w), j, z) for j, z, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            inside = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(inside, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>"


def mined(spark, rows, every=10, block=8, chunk_bytes=1 << 20):
    whole = negatives.whole_vectors(table_of(spark, rows, SCHEMA))
    whole = whole.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "v")
    return sorted(tuple(r) for r in negatives.mine(whole, every, block, chunk_bytes).collect())


def test_negatives_of_random_vectors(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 0.2, (4, 6))
    rows = [(i, int(y), [float(np.float32(c)) for c in centers[y] + rng.normal(0, 0.15, 6)]) for i, y in enumerate(rng.integers(0, 4, 300))]
    rows += [(1000 + i, int(i % 4), rows[17][2]) for i in range(100)]  # ties
    want = brute_negatives(rows, 10)
    assert want and mined(spark, rows) == want == mined(spark, rows, block=64, chunk_bytes=200)


def test_negatives_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, 1, [1.0, 0.5]), (11, 1, [1.0, 0.25]), (12, 2, [0.5, 0.5]), (12, 2, [0.5, 0.5]), (13, 2, [0.5, None]), (14, 2, [nan, 1.0]), (15, 3, [inf, 1.0]),
            (16, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (17, 2, None), (18, 3, [0.75]), (19, 3, []), (20, 1, [-1.0, -1.0]), (21, 4, [0.5, 0.5, 0.5]),
            (22, 1, [1e30, 1.0]), (30, 8, [1.0, 1.0]), (40, 5, [0.0, 0.0]), (41, 5, [0.0, 0.0]), (10, 1, [1.0, 0.5]), (-10, 1, [0.5, 0.75])]
    padded = [(i, y, None if v is None else [*v, *[0.0] * (3 - len(v))]) for i, y, v in rows]
    want = brute_negatives(padded, 10)
    assert want and mined(spark, rows) == want == mined(spark, rows, block=1)


def test_negatives_of_empty_tables(spark):
    assert mined(spark, []) == [] == mined(spark, [(10, 1, None)])
    assert mined(spark, [(10, 1, [1.0])]) == [] == mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])])


def test_negatives_ignore_other_columns(spark):
    rows = table_of(spark, [(100, 1, [1.0, 1.0], 3, "x"), (1, 1, [1.0, 1.0], 4, "y"), (2, 2, [0.5, 0.5], 5, "z")], SCHEMA + ", block int, anchor string")
    assert [tuple(r) for r in negatives.mine_embeddings(rows).collect()] == [(100, 1, 1, 2, 2 * 256 ** 2, 256 ** 2)]


def test_far_blocks_are_not_read(spark):
    """Two distant clusters: the zone maps leave the other one out."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, [float(c) for c in (1 if i < 200 else -1) + rng.normal(0, 0.01, 4)]) for i in range(400)]
    blocks = negatives.store_blocks(negatives.whole_vectors(table_of(spark, rows, SCHEMA)), 4, 20)
    anchor = negatives.Anchors([0], [0], np.array([[256] * 4]), [0])
    chosen = negatives.choose(blocks, lambda block, low, high, kinds: anchor.bounds(low, high)[1] >= 0)
    assert chosen.count() < 0.7 * blocks.count()
