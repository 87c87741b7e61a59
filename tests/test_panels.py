"""Panels take all of what they show."""

from pathlib import Path

import pytest

from refweave.plans import panels
from refweave.plans import workflow_metrics as W


def test_stratified_panel_leaves_no_call_out(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no data")
    calls = [(r["repository_full_name"], r["path"], r["sha"], r["is_remote"], r["callee"]) for r in W._calls(spark, folder, every=True).collect()]
    local = {(*r[:3], r[4]) for r in calls if not r[3]}
    assert local >= {(*r[:3], f"{r[0]}/.github/workflows/" + r[4].split("/.github/workflows/")[1].split("@")[0]) for r in calls if r[3]}
    rows = panels.stratified_panel(spark, folder).where("panel = 'inherits_secrets_share'").collect()
    assert {r["label"] for r in rows} == {"local", "remote", "remote_same_org", "remote_cross_org", "remote_third_party"}
