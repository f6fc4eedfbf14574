"""The driver contract."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['quadrille.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quadrille.llm" not in path.read_text() and "from ..llm" not in path.read_text(), path


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["captures", "header_snippets", "extract_tuition", "link_topk", "aggregate_scalar_fields", "merge_foundation_flags", "compare_scalar_fields"])
def test_queries_agree_with_duckdb(spark, name):
    import duckdb

    from quadrille.plans import registry

    query, sql = registry.REGISTRY[name]
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "part", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df, rel = query(spark, SMALL), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_every_programme_is_scored_against_every_question(spark):
    from quadrille.plans import registry

    got = registry.REGISTRY["resolve_query"][0](spark, SMALL)
    n = registry.S.extracts(spark, SMALL).select("program_code").distinct().count()
    assert got.distinct().count() == 5 * n and got.where("length(program_code) > 3").count() > 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_customers_that_are_too_many_to_broadcast_are_met_by_hash(spark):
    from quadrille.sources import synthetic

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for made in (synthetic.captures, synthetic.extracts, synthetic.gold, synthetic.raw_links):
            plan = made(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            # a sort join holds the orders of a partition in a task's memory
            assert any("ShuffledHashJoin" in line and "o_custkey" in line and "c_custkey" in line for line in plan.splitlines())
    finally:
        spark.conf.set(threshold, before)
