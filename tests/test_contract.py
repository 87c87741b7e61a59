"""The driver's contract: registered queries agree with their SQL, and the core lives without the text subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.verify import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
CORE = ["p1_found", "p1_merge", "p3_found", "p3_intervals", "p4_found", "p5_found", "p6_found", "p6_late", "implicit_ratio", "blast_radius", "drift_lag", "update_windows", "stream_drift_state", "reference_union", "ref_category", "p5_paths", "ref_risk_by_workflow", "trust_amplification_by_entity", "isolation_by_job", "privilege_by_job", "propagation_by_workflow", "lift_cross_same", "manual_validation", "reusable_calls", "history_changes", "csv_round_trip", "cdg_from_files", "stream_sessions"]


@pytest.mark.parametrize("name", CORE)
def test_equal_to_sql(spark, name):
    import __spark_entry__ as e

    assert f"{name}: equal" in compare(spark, connect(DATA), name, e.queries()[name], e.oracle_sql()[name], DATA)


def test_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 160 and set(o) <= set(q) and all(f"p{n}_found" in q for n in (1, 3, 4, 5, 6))


def test_core_without_texts(tmp_path):
    """A copy without the text subpackage and its tests still imports, registers its queries and collects its tests."""
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.parquet"))
    for folder in ("refweave/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p8_ids' not in q and len(q) > 150; assert len(e.oracle_sql()) > 140"
    env = os.environ | {"PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, timeout=120, text=True)
    assert done.returncode == 0, done.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, timeout=120, text=True)
    assert collected.returncode == 0, collected.stdout
    for p in (root / "refweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "refweave.llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
