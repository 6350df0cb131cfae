import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from keelson.llm import near_dups, parity  # noqa: E402
from keelson.llm.components import components  # noqa: E402


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def family(seed=3, size=70, length=120):
    """A group of near copies around the threshold, and unrelated short texts."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(400)}" for _ in range(length)]
    out = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(length)] = f"n{rng.randrange(50)}"
        out.append((1000 - i, " ".join(words)))
    return out + [(2000 + i, " ".join(f"s{rng.randrange(3)}" for _ in range(rng.randrange(0, 9)))) for i in range(40)]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_edge_rows(spark, width, num):
    df = cases.documents(spark)
    want = cases.components([(r[0], r[1]) for r in cases.rows()], width, num, 100)
    assert found(near_dups.join_near_copies(df, width, num, 100)) == want


@pytest.mark.parametrize("width,num,chunk", [(3, 90, 512), (3, 90, 4), (5, 80, 6), (2, 50, 8)])
def test_against_all_pairs(spark, width, num, chunk):
    docs = family()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(near_dups.join_near_copies(df, width, num, 100, chunk)) == cases.components(docs, width, num, 100)


def test_empty_table(spark):
    assert near_dups.join_near_copies(cases.documents(spark, [])).count() == 0


def test_keep_one(spark):
    kept = near_dups.keep_one(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and ids.count(1) == 2 and None in ids and 8 not in ids and {4, 5, 6, 7, 9, 10} <= set(ids)


def test_keep_one_judges_each_text_of_a_doc_id(spark):
    copy, own, other = cases.PLAIN, "own " + " ".join(f"o{i}" for i in range(40)), " ".join(f"p{i}" for i in range(40))
    texts = [(1, copy), (2, copy), (2, own), (2, own), (2, None), (3, own), (4, copy), (5, other)]
    data = [(i, t, "en", "src0", k, 1, "z", 2.5, "k") for k, (i, t) in enumerate(texts)]
    kept = near_dups.keep_one(cases.documents(spark, data))
    assert kept.columns == cases.documents(spark).columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((data[k] for k in (0, 2, 3, 4, 7)), key=str)


def test_sketch_distance_is_a_lower_bound_and_linked_sets_share_a_word():
    rng = np.random.default_rng(5)
    bands = parity.Bands(80, 100)
    for n in [*range(1, 60), 200, 900, 5000]:
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        gone = rng.integers(0, n // 5 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2 ** 63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        k = min(bands.band(len(a)), bands.band(len(b)))
        assert max(bands.band(len(a)), bands.band(len(b))) <= k + 1
        blocks, spare = bands.blocks(k)
        if not blocks:
            assert np.array_equal(a, b)
            continue
        x, y = parity.sketch(a, blocks), parity.sketch(b, blocks)
        assert np.bitwise_count((x ^ y) & parity.PARITY).sum() <= len(a) + len(b) - 2 * both
        assert (x == y).sum() >= 1 + spare


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    whole = parity.shingles(cases.LONG)
    monkeypatch.setattr(parity, "PIECE", 100)
    assert np.array_equal(parity.shingles(cases.LONG), whole)


@pytest.mark.parametrize("task_links", [0, 70, 1000])
def test_components_of_paths_and_stars(spark, task_links):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.Random(4).shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = [(r["node"], r["component"]) for r in components(df, task_links).collect()]
    assert len(got) == 121 and dict(got) == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_keys_of_two_bands_that_collide():
    """Rows of other bands in a bucket are not compared, the others are."""
    import pandas as pd
    rows = pd.DataFrame({"key": 1, "tile": 0, "side": 0, "node": [1, 2, 3, 4], "comp": [1, 2, 3, 4], "n": [40, 40, 9, 40],
                         "words": [b"\0\0\0" * 5, b"\0\0\0" * 5, b"\0\0\0" * 2, b"\xff\xff\xff" * 5]})
    got = pd.concat(near_dups._tiles(iter([rows]), True, 90, 100))
    assert got.values.tolist() == [[2, 1]]


def test_parts_keep_shared_keys_in_bounded_memory():
    """However few entries are held, the members of each shared key come out, and lone keys do not."""
    rng = np.random.default_rng(12)
    key = np.concatenate([rng.integers(0, 3000, 4000), np.full(3000, 7)]).astype(np.int64)
    member = rng.permutation(len(key)).astype(np.int64)
    want = {}
    for k, m in zip(key.tolist(), member.tolist()):
        want.setdefault(k, set()).add(m)
    for most in (50, 1000, 10 ** 6):
        part, got, pairs, peak = near_dups.Part(most), {}, set(), 0
        order = rng.permutation(len(key))
        for at in np.array_split(order, 70):
            e = np.empty(len(at), near_dups._ENTRY)
            e["key"], e["more"], e["member"], e["extra"] = key[at], 0, member[at], member[at] % 5
            out = part.add(e.tobytes())
            peak = max(peak, part.n)
            for k, m in zip(*out) if out is not None else ():
                got.setdefault(int(k), set()).add(int(m))
        (x, y, times, need), (k, m) = part.rest()
        for a, b in zip(k.tolist(), m.tolist()):
            got.setdefault(a, set()).add(b)
        pairs = set(zip(x.tolist(), y.tolist()))
        shared = {k: v for k, v in want.items() if len(v) > 1}
        assert set(got) <= set(shared) and all(got[k] == shared[k] for k in got)
        assert pairs == {tuple(sorted(v)) for k, v in shared.items() if k not in got}
        assert (times == 1).all() and all(n == 1 + min(a % 5, b % 5) for a, b, n in zip(x, y, need))
        assert peak <= 2 * max(most, 3000) + 200


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_links_share_the_words_they_need(num, den):
    """Sets that link share at least as many emitted words, in one band, as the smaller ``extra`` says, and one more."""
    rng, bands = np.random.default_rng(num), parity.Bands(num, den)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.12], rng.integers(0, 2 ** 63, int(rng.integers(0, 1 + n // 20)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or den * both < num * (len(a) + len(b) - both) or parity.node(a) == parity.node(b):
            continue
        found = []
        for x in (0, 1):
            for y in (0, 1):
                (wa, ia, ka, ea), (wb, ib, kb, eb) = parity.key_words(a, bands, x), parity.key_words(b, bands, y)
                if ka == kb and len(wa) and len(wb):
                    found.append(len(set(zip(wa.tolist(), ia.tolist())) & set(zip(wb.tolist(), ib.tolist()))) - 1 - min(ea, eb))
        assert max(found) >= 0
