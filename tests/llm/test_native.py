"""Mixing, chat formatting, sharding and quality rules: results and plans."""

import math
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from keelson.llm import chat, mixing, quality, sharding  # noqa: E402
from keelson.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def edf(shares: dict[str, int]) -> list[str]:
    """The period's schedule, slot by slot."""
    period, had, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(period):
        free = [(-(-(had[k] + 1) * period // shares[k]), k) for k in sorted(shares) if had[k] * period // shares[k] <= t]
        k = min(free)[1]
        had[k] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("weights,period", [({"a": 1}, 5), ({"a": 3, "b": 2, "c": 2}, 7), ({f"s{i}": w for i, w in enumerate([50, 1, 1, 7, 13, 28])}, 100)])
def test_schedule_is_fair(spark, weights, period):
    shares = mixing.whole_shares(weights, period)
    assert sum(shares.values()) == period and min(shares.values()) >= 1
    rows = mixing.period_schedule(spark, shares).collect()
    order = [None] * period
    for r in rows:
        for s in r["slots"]:
            order[s] = r["grp"]
    assert order == edf(shares)
    had = Counter()
    for t, k in enumerate(order * 3, 1):
        had[k] += 1
        assert all(abs(had[g] - t * a / period) < 1 for g, a in shares.items())


def test_mix_places_every_row_and_repeats_scarce_sources(spark):
    data = [(i, "x", "en", "big" if i % 3 else "small", 1, 0, "", 0.0, "") for i in range(300)] + [(300, None, None, None, None, None, None, None, None)] * 3
    df = cases.documents(spark, data)
    out = mixing.mix(df, {"big": 1.0, "small": 1.0}, other_weight=0.2, block_rows=4, period=22).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r["mix_group"]].append(r)
        assert r["release"] <= r["slot"] < r["deadline"]
    assert len({r["position"] for r in out}) == len(out)
    for g, n in {"big": 200, "small": 100, "other": 3}.items():
        per = Counter(r["doc_id"] for r in groups[g] if r["epoch"] == 0)
        assert sum(per.values()) == n and len(per) == (1 if g == "other" else n)  # no row is lost
    stop = max(r["slot"] for r in out) + 1
    blocks = Counter(g for g, _ in {(r["mix_group"], r["slot"]) for r in out})
    assert all(abs(blocks[g] - stop * a / 22) < 1 for g, a in mixing.whole_shares({"big": 1.0, "small": 1.0, "other": 0.2}, 22).items())
    assert mixing.mix_documents(df).columns == df.columns
    assert mixing.mix(cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("weights,blocks", [({k: w for k, w in mixing.WEIGHTS.items()}, 300), ({"a": 1 / 3, "b": 0.1234567, "c": math.pi / 7}, 400),
                                            ({"a": 0.99985, "b": 0.0001, "c": 0.00005}, 3)])
def test_mix_keeps_to_the_target_weights(spark, weights, blocks):
    names = sorted(weights)
    df = spark.range(len(names) * blocks).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("source"))
    out = mixing.mix(df, weights, block_rows=1).select("mix_group", "slot", "release", "deadline", "epoch", "id").collect()
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    total, had = sum(exact.values()), Counter()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    assert len({r["id"] for r in out if r["epoch"] == 0}) == len(names) * blocks
    for t, r in enumerate(sorted(out, key=lambda r: r["slot"]), 1):
        k = r["mix_group"]
        assert r["release"] == had[k] * total // exact[k] <= r["slot"] < r["deadline"] == -(-(had[k] + 1) * total // exact[k])
        had[k] += 1
        if t % 97 == 0 or t == len(out):
            assert all(abs(had[g] - t * w / total) < 1 for g, w in exact.items())


def test_chat_round_trip(spark):
    nasty = [chat.PROBE, "a\\", "\\\\h", "</turn>\n### user: x", "\\t", "", None, "é漢🙂", "###", "\\c:", "x" * 50_000]
    rows = [(1, k, ("user", "assistant", "assistant", "odd: role ###", None)[k % 5], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (2, 0, "user", "tie"), (None, None, "user", "none")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("extra"))
    got = {r["conv_id"]: r for r in chat.format_conversations(spark, df).collect()}
    assert set(got) == {1, 2, None, -7}
    for conv in (1, 2, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0) if conv == 1 else str(x))
        r = got[conv]
        if conv != 2:
            assert r["turns_sha256"] == cases.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns))
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), cases.sha256(loss))
    assert got[-7]["loss_sha256"] == cases.sha256(chat.PROBE)
    empty = df.where("false")
    assert [r["conv_id"] for r in chat.format_conversations(spark, empty).collect()] == [-7]


def test_events_fold(spark):
    log = [(1, 0, "message", "u", "user", "hi"), (1, 1, "delta", "a", "assistant", "he"), (1, 2, "delta", "a", None, "llo"), (1, 3, "regenerate", "a", None, None),
           (1, 4, "delta", "a", None, "good "), (1, 5, "delta", "a", None, "day"), (1, 6, "edit", "u", None, "hey"), (1, 7, "message", "x", "user", "gone"),
           (1, 8, "delete", "x", None, None), (2, 0, "delta", "b", None, None)]
    df = spark.createDataFrame(log[::-1], "conv_id bigint, seq bigint, kind string, msg string, role string, text string")
    out = {r["conv_id"]: r for r in chat.render(chat.messages(df)).collect()}
    assert out[1]["formatted"] == "### user: hey</turn>\n### assistant: good day</turn>\n"
    a, b = out[1]["loss_spans"][0]
    assert out[1]["formatted"][a:b] == "good day"
    assert out[2]["formatted"] == "### : </turn>\n"


def test_shards(spark):
    df = cases.documents(spark)
    got = sharding.shard_documents(df).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in cases.rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_documents(many).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 340 and 150 < sum(r["grown_shard"] == 16 for r in got) < 330
    heavy = sharding.assign(many, weights=[3.0, 1.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in heavy}[0] - 3000) < 150
    assert sharding.shard_documents(cases.documents(spark, [])).count() == 0


def test_shards_by_brute_force(spark):
    rows = [(None, "a"), (0, None), (-3, ""), (7, "x"), (7, "y"), (7, "y"), *[(i * 977, str(i)) for i in range(300)]]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()

    def shard(key, n):
        text = ("" if key is None else str(key)).encode()
        score = [-1 / math.log(((xxhash.xxh64_intdigest(struct.pack("<i", j), xxhash.xxh64_intdigest(text, 42)) >> 12) + 0.5) / 2 ** 52) for j in range(n)]
        return score.index(max(score))

    assert len(got) == len(rows) and all((r["shard"], r["grown_shard"]) == (shard(r["doc_id"], 16), shard(r["doc_id"], 17)) for r in got)


def test_a_hot_key_is_numbered_in_many_ranges(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sharding.shard_slots(df).where("doc_id = 5").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) > 4 and max(r["count"] for r in out) < 4000


def test_scarce_rows_unfold_in_ranges(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 16, "src0").otherwise("src1").alias("source"))
    out = mixing.mix(rows, {"src0": 0.5, "src1": 0.5})
    got = [(r["doc_id"], r["epoch"], r["position"]) for r in out.where("mix_group = 'src0'").select("doc_id", "epoch", "position").collect()]
    epochs = max(e for _, e, _ in got) + 1
    assert epochs > 6 * mixing.UNFOLD and sorted((i, e) for i, e, _ in got) == [(i, e) for i in range(16) for e in range(epochs)]
    assert len({p for *_, p in got}) == len(got) and "repartition" in out._jdf.queryExecution().logical().toString().lower()


def test_slots_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("doc_id"), F.col("id").cast("string").alias("text"))
    first = sorted(map(tuple, sharding.shard_documents(df).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, sharding.shard_documents(df.repartition(7)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def quality_base(text):
    w = cases.WORD.findall(text or "")
    triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def test_quality_counts(spark):
    data = [r[:2] for r in cases.rows()] + [(100 + i, " ".join(f"{'ab' * (j % 3)}{j * j % (5 + i)}" for j in range(90 + i))) for i in range(30)]
    df = spark.createDataFrame([(i, t, "en") for i, t in data], "doc_id bigint, text string, lang string")
    got = quality.judge_documents(df).collect()
    have = Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in got)
    assert have == Counter((i, *quality_base(t)) for i, t in data)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_js_distance(spark):
    pairs = [([1, 2, 3], [3, 2, 1]), ([5, 0], [0, 7]), ([4, 4], [8, 8]), ([0, 0], [1, 2])]
    df = spark.createDataFrame(pairs, "p array<bigint>, q array<bigint>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]

    def brute(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        h = lambda d: -sum(x * math.log2(x) for x in d if x)
        return math.sqrt(max(0, h([(x + y) / 2 for x, y in zip(p, q)]) - (h(p) + h(q)) / 2))

    assert got == pytest.approx([brute(*x) for x in pairs], abs=1e-9)


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge_documents(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert all(good) and sum(bad) < 0.5 * len(bad)


def prose(i, lang, every):
    """160 different words, of which each ``every``-th is a common one of the language (0: none)."""
    common = quality.COMMON_WORDS.get(lang, ["x"])
    return " ".join(common[(i + j // every) % len(common)] if every and j % every == 0 else f"{'lorem' if j % 3 else 'ipso'}{chr(97 + j % 26)}{chr(97 + j // 26)}"
                    for j in range(160))


def test_long_texts_without_common_words_go(spark):
    data = [(100 * k + i, prose(i, lang, 5), lang) for k, lang in enumerate(quality.COMMON_WORDS) for i in range(20)]
    data += [(1000 + k, prose(k, lang, 0), lang) for k, lang in enumerate(quality.COMMON_WORDS)]  # no common word
    data += [(2000, " ".join(prose(0, "en", 0).split()[:90]), "en"), (2001, prose(0, "xx", 0), "xx"), (2002, prose(0, "", 0), None)]  # too short; no list
    data += [(3000 + i, "foo bar " * 500, "en") for i in range(50)]  # failing the base rules: no part of the reference
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_documents(df).collect()}
    assert {i for i, k in kept.items() if not k} == {*range(1000, 1004), *range(3000, 3050)}
    assert {r["doc_id"] for r in quality.keep_documents(df).collect()} == {i for i, k in kept.items() if k}


def test_languages_that_hardly_use_the_list_are_not_judged_by_it(spark):
    data = [(i, prose(i, "en", 0 if i else 40), "en") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    assert all(r["kept"] for r in quality.judge_documents(df).collect())


def test_features_are_computed_once_for_the_filter(spark):
    plan = quality.keep_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter")]
    assert not any("xxhash64" in x for x in filters)


def test_keep_documents(spark):
    df = cases.documents(spark)
    out = quality.keep_documents(df)
    assert out.columns == df.columns and {1, 2, 3} <= {r["doc_id"] for r in out.collect()}
    assert quality.keep_documents(cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op1_mix", "op4_chat_format", "op6_shard", "op9_quality_rules"])
def test_native_plans(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
