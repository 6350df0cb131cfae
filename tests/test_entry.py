import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["customer_id", "health_score", "health_tier"]
    assert df.count() > 0


def test_every_query_builds_a_plan(spark):
    from conftest import SF001
    from keelson.plans.registry import QUERIES
    assert set(QUERIES) <= set(E.queries())
    for k, fn in QUERIES.items():
        df = fn(spark, SF001)
        assert df.columns, k


def test_entry_without_the_llm_folder(tmp_path):
    """The library's own queries are there when the training-data folder is not."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/keelson", tmp_path / "keelson", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
