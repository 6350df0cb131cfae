"""I-Match fingerprints: next documents and edits by brute force, likeness, edge rows."""

import hashlib

import pytest

from cases import table_of
from conftest import SF01
from keelson.llm import fingerprints as fp
from keelson.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def edits(rows):
    """(text, next text, edited text) of each doc_id that comes once."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        out[d] = (t, after, t[:len(t) - half] + after[:half])
    return out


def check(got, rows):
    want = edits(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        text, _, edited = want[r["doc_id"]]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = {}
    for r in got:
        by_text.setdefault(want[r["doc_id"]][0], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = QUERIES["op13_fingerprint"](spark, SF01).collect()
    check(got, rows)
    want, of = edits(rows), {r["doc_id"]: r["fingerprint"] for r in got}
    seen = {}
    for d, (t, after, edited) in want.items():
        seen[t] = of[d]
    for r in got:
        t, after, edited = want[r["doc_id"]]
        both = [(a, b) for a, b in zip(r["fingerprint"].split(" "), seen[after].split(" ")) if (a, b) != ("-", "-")]
        assert r["near_next"] == pytest.approx(sum(a == b for a, b in both) / len(both) if both else 1.0)
        if edited in seen:
            assert r["edited_fingerprint"] == seen[edited]
    # an edit leaves half of the text, the next document is another one
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.7 * len(got)
    assert sum(r["near_next"] > 0.05 for r in got) < 0.02 * len(got)


def lexicon_of(rows, low, high):
    import math
    import re
    split = [set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) for _, t in rows]
    df = {}
    for ws in split:
        for w in ws:
            df[w] = df.get(w, 0) + 1
    return {w for w, n in df.items() if low <= math.log(len(rows) / n) <= high}


def test_lexicon(spark):
    rows = [(i, f"all {'half' if i % 2 else ''} {'tenth' if i % 10 == 0 else ''} only{i} Ünder_score") for i in range(100)] + [(1000, None), (1001, "")]
    docs = table_of(spark, rows, SCHEMA)
    terms = fp.lexicon(docs, 0.5, 3.0)
    want = lexicon_of(rows, 0.5, 3.0)
    assert want == {"half", "tenth"}
    hashes = {r["h"] for r in spark.createDataFrame([(w,) for w in want], "w string").selectExpr("xxhash64(w) AS h").collect()}
    assert {r["term"] for r in terms.collect()} == hashes


def test_terms_outside_the_band_do_not_count(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(i, f"common {' '.join(words)} rare{i}" if i < 20 else f"common z{i}") for i in range(200)]
    docs = table_of(spark, rows, SCHEMA)
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs, fp.lexicon(docs, 1.0, 4.0)).collect()}
    assert len({got[i] for i in range(20)}) == 1  # only the rare slips differ
    assert len({got[i] for i in range(20, 200)}) == 180  # without lexicon terms all terms count


def test_likeness_falls_with_the_edit(spark):
    text = [f"term{i}" for i in range(300)]
    rows = [(0, " ".join(text))] + [(k, " ".join([*text[k:], *[f"new{k}x{j}" for j in range(k)]])) for k in (1, 10, 60, 150, 300)]
    docs = fp.fingerprints(table_of(spark, rows, SCHEMA))
    a, b = docs.where("doc_id = 0").selectExpr("split(fingerprint, ' ') AS a"), docs.selectExpr("doc_id", "split(fingerprint, ' ') AS b")
    near = {r["doc_id"]: sum(x == y != "-" for x, y in zip(r["a"], r["b"])) / sum((x, y) != ("-", "-") for x, y in zip(r["a"], r["b"]))
            for r in b.crossJoin(a).collect()}
    assert near[0] == 1 and near[0] > near[1] > near[10] > near[60] > near[150] > 0 == near[300]


def test_edge_rows(spark):
    long_text = "word" + " filler" * 200_000 + " end"
    rows = [(5, None), (4, ""), (3, "?!."), (2, "a b c"), (1, "ä𝄞b c d e"), (-7, long_text), (100, "one"), (99, "two words")]
    got = fp.compare_documents(table_of(spark, rows, SCHEMA)).collect()
    check(got, rows)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["near_next"] == by[4]["near_next"] == 1  # no term on either side
    assert by[3]["near_next"] == 0 and by[2]["near_next"] < 0.3  # one term of six in common


def test_ties_and_nulls(spark):
    rows = [(None, "null one x y"), (None, "null two"), (3, "three a b"), (3, "three c d"), (3, "three a b"), (1, "one")]
    got = fp.compare_documents(table_of(spark, rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    order = [r["doc_id"] for r in got]
    assert sorted(order, key=lambda d: (d is None, d or 0)) == [1, 3, 3, 3, None, None]
    twins = [r for r in got if r["doc_id"] == 3 and r["n_chars"] == 9]
    assert len(twins) == 3
    # equal rows follow each other: the first of them has itself as next
    assert any(r["near_next"] == 1 for r in got if r["doc_id"] == 3)


def test_one_row_and_none(spark):
    assert fp.compare_documents(table_of(spark, [], SCHEMA)).collect() == []
    (r,) = fp.compare_documents(table_of(spark, [(1, "abcd ef")], SCHEMA)).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"abcdabc").hexdigest()


def test_next_over_many_ranges(spark):
    """One doc_id holds a third of the rows, with texts of its own: it is cut into ranges too."""
    rows = [(7 if i % 3 == 0 else 10 * i, f"text number {i} of many") for i in range(3000)]
    docs = table_of(spark, rows, SCHEMA).repartition(8)
    got = fp.with_next(docs.select("doc_id", "text"), "doc_id", ["text"]).selectExpr("doc_id", "text", "__kl_next.text AS after", "xxhash64(text) AS h").collect()
    ordered = sorted(got, key=lambda r: (-r["doc_id"], r["h"]))
    assert len(got) == 3000
    assert all(r["after"] == ordered[(i + 1) % 3000]["text"] for i, r in enumerate(ordered))


def test_extra_columns(spark):
    docs = table_of(spark, [(1, "a b", "x", 3), (2, "c d", "y", 4)], SCHEMA + ", hashes string, fingerprint int")
    assert fp.compare_documents(docs).count() == 2
    assert fp.fingerprints(docs).columns == ["doc_id", "text", "hashes", "fingerprint"]


def test_native(spark):
    plan = QUERIES["op13_fingerprint"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
