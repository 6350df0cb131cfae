import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from keelson.llm import decontam  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=13):
    out = []
    windows = {}
    for i, t in items:
        w = WORD.findall(cases.lower(t))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + window]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    for i, t in docs:
        w = WORD.findall(cases.lower(t))
        hit, ids = set(), set()
        for s in range(len(w)):
            for n in sizes:
                if (key := tuple(w[s:s + n])) in windows and len(key) == n:
                    hit |= set(range(s, s + n))
                    ids |= windows[key]
        out.append((i, len(w), len(hit), len(ids), cases.sha256(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(2)
    vocabulary = ["the", "of", "and"] * 5 + [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(40)] + [
        (50, None), (None, "Rare Words, here!"), (51, ""), (52, "the"), (53, "gamma"), (50, "again again again")]
    docs = [(r[0], r[1]) for r in cases.rows()]
    for i in range(80):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        text = items[rng.randrange(40)][1].split(" ")
        cut = rng.randrange(0, len(text) + 1)
        docs.append((100 + i, f"{parts[0]} {' - '.join(text[cut // 2:])} {parts[1]} {' '.join(text[:cut]).upper()}. {parts[2]}"))
    return docs, items


def test_against_brute_force(spark):
    docs, items = tables()
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r)[:6] for r in decontam.judge_documents(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    blocks = decontam.find_contamination(df, bench, carry=["doc_id"], block_bytes=700)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in blocks.collect()), key=str) == [g[:4] for g in got]


def test_clean_documents_keeps_columns_and_clean_rows(spark):
    df = cases.documents(spark)
    bench = spark.createDataFrame([(1, cases.PLAIN[:200])], "item_id bigint, text string")
    clean = decontam.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]


def test_empty_tables(spark):
    df, none = cases.documents(spark), spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontam.judge_documents(df, none).collect()} == {0}
    bench = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert decontam.judge_documents(cases.documents(spark, []), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "blue x green y red"), (2, "red green blue"), (3, "red " + "x " * 60 + "green blue")], "doc_id bigint, text string")
    got = {r["doc_id"]: (len(r["items"]), len(r["near_items"])) for r in decontam.find_contamination(docs, bench).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 0)}
