"""The pipeline's stages on small data, against brute force."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402
from test_decontam import brute as contamination  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from keelson.llm import mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, had = docs.columns, [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"] for r in quality.judge_documents(docs).collect() if r["kept"]}
    comps = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF).cache()
        now = [tuple(r) for r in out.collect()]
        if name == "quality rules":
            assert Counter(now) == Counter(r for r in had if r[0] in kept)
        elif name == "n-gram Jaccard join":
            comps = {i: c for i, _, c in cases.components([(r[0], r[1]) for r in had], 5, 80, 100)}
            assert Counter(now) == Counter(r for r in had if comps[r[0]] == r[0])
        elif name == "benchmark decontamination":
            hit = {i for i, *_, bad in contamination([(r[0], r[1]) for r in had], bench) if bad}
            assert hit and Counter(now) == Counter(r for r in had if r[0] not in hit)
        elif name == "mixing sources":
            assert set(now) == set(had)
            n, total = Counter(r[3] for r in now), len(now)
            weights = {k: mixing.WEIGHTS.get(k, mixing.OTHER_WEIGHT) for k in n}
            share = sum(weights.values())
            assert all(abs(n[k] - total * w / share) < 3 * mixing.BLOCK_ROWS for k, w in weights.items())
        else:
            assert Counter(r[0] for r in now) == Counter(r[0] for r in had)
            break
        assert out.columns == columns
        docs, had = out, now
    assert [n for n, _ in cp.STAGES][-1] == "sharding" and len(cp.STAGES) == 5
    assert cp.run(spark, SF).count() == len(had)


def test_stages_on_edge_rows(spark, tmp_path):
    bench = spark.createDataFrame([(1, "the of and the of and"), (2, None)], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (None, []):
        docs = cases.documents(spark, data)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() >= 0
            if name != "sharding":
                assert out.columns == docs.columns
