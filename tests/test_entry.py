"""The driver's contract, SQL twins, and life without the subpackage llm."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plantlens.oracles import ORACLE_SQL
from plantlens.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
TWINS = ["rolling_fpy", "pchart_limits", "station_scorecard", "triage_pattern", "dq_by_rule", "asof_bounded", "interval_join", "derived_key_join", "wo_progress", "integrity_report", "coverage_kpis", "cost_sensitivity", "station_condition", "condition_sensitivity", "wear_trend", "report_foldback", "asof_volume", "range_volume", "stream_dedupe", "stream_shift_fpy", "stream_frozen_gauge", "stream_held_in_order", "scan_tolerant"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    result = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in cols]
    show = lambda v: "%.5f" % v if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[i]) for i in at) for r in result.fetchall())
    assert sorted(tuple(map(show, r)) for r in df.select(*cols).collect()) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "out_of_control" in df.columns


def test_without_the_llm_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "plantlens", tmp_path / "plantlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pchart_limits' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
