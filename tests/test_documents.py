"""Workflow documents and the signals computed from them."""

import pytest

pytest.importorskip("yaml")

from refweave.operators import documents, jobs  # noqa: E402

TEXT = """
name: Release
on: [push, pull_request_target]
permissions:
  contents: write
jobs:
  build:
    name: Build it
    permissions: {id-token: write}
    env: {TOKEN: "${{ secrets.X }}"}
    outputs: {v: 1}
    steps:
      - uses: actions/checkout@v4
      - uses: other/tool@main
        with: {key: "${{ secrets.K }}"}
      - run: echo A=1 >> $GITHUB_ENV
      - {name: Ship, run: ./deploy.sh}
  last:
    needs: build
    steps:
      - uses: actions/download-artifact@v4
  call:
    needs: [build, last]
    uses: other/repo/.github/workflows/x.yml@v1
    secrets: inherit
  local:
    uses: ./.github/workflows/y.yml
"""


def docs(spark, *texts):
    rows = [("me/repo", f"f{i}.yml", "s", t) for i, t in enumerate(texts)]
    return documents.workflow_documents(spark.createDataFrame(rows, "repository_full_name string, path string, sha string, content string"), "content", jobs.KEY)


def test_struct():
    d = documents.workflow_struct(TEXT)
    assert d["triggers"] == ["push", "pull_request_target"] and d["max_job_depth"] == 2 and [j["job_id"] for j in d["jobs"]] == ["build", "last", "call", "local"]
    assert documents.workflow_struct("on: push\njobs: []")["triggers"] == ["push"] and documents.workflow_struct("on: {a: 1, b: 2}")["triggers"] == ["a", "b"]
    assert [documents.workflow_struct(t) for t in (None, "", "just text", "a: [1", "- 1")] == [None] * 5
    assert documents.workflow_struct("jobs: {a: 1, b: {steps: [x, {uses: 3}]}}")["jobs"][0]["steps"][0]["uses"] is None
    assert documents.longest_chain(["a", "b", "c"], [("a", "b"), ("b", "a"), ("z", "c")]) == 1
    assert documents.action_struct("runs: {using: composite, steps: [{uses: a/b@v1}, {run: x}]}") == {"kind": "composite", "uses": ["a/b@v1"], "scripts": ["x"], "main": None}
    assert [documents.action_struct(t)["kind"] for t in ("runs: {using: docker}", "runs: {using: node20, main: i.js}", "runs: 1", None)] == ["docker", "javascript", "unknown", "unknown"]


def test_signals(spark):
    d = docs(spark, TEXT, None, "a: [", "name: empty")
    j = jobs.jobs(d)
    iso = {r["job_id"]: r for r in jobs.isolation(j).collect()}
    b = iso["build"]
    assert set(iso) == {"build", "last"} and b["mixed_domains"] and b["action_before_sensitive"] and b["untrusted_before_sensitive"] and b["env_signal"] and b["file_signal"]
    assert b["third_party_steps"] == 1 and b["sensitive_steps"] == ["Ship"] and b["signal_score"] == 1.5 + 2.5 + 3 + 1 + 1 + 1
    pr = {r["job_id"]: r for r in jobs.privilege(j, jobs.isolation(j)).collect()}
    assert pr["build"]["id_token_write"] and pr["build"]["contents_write"] and pr["build"]["secrets_in_env"] and pr["build"]["secrets_in_with"] and pr["build"]["mutable_with_privilege"] and pr["build"]["isolation_coupling"]
    assert pr["last"]["contents_write"] and not pr["last"]["id_token_write"] and pr["last"]["movable_actions"] == 0
    depths = spark.createDataFrame([("me/repo", "f0.yml", 3)], "repository_full_name string, path string, max_depth long")
    w = jobs.privilege_by_workflow(jobs.privilege(j, jobs.isolation(j)), depths)
    assert [(r["jobs"], r["max_depth"], r["pull_request_target"]) for r in w.collect()] == [(4, 3, True)]
    p = {r["path"]: r for r in jobs.propagation(d, w).collect()}
    assert set(p) == {"f0.yml", "f3.yml"} and p["f0.yml"]["needs_edges"] == 3 and p["f0.yml"]["artifact_download"] and p["f0.yml"]["job_outputs"] and p["f0.yml"]["mutable_downstream"] and p["f0.yml"]["privilege_coupling"]
    c = {r["job_id"]: r for r in jobs.calls(j).collect()}
    assert c["call"]["ref_type"] == "MAJOR_TAG" and c["call"]["inherits_secrets"] and c["call"]["is_third_party"] and c["local"]["callee"] == "me/repo/.github/workflows/y.yml" and not c["local"]["is_mutable"]
    assert {(r["callee"], r["calls"]) for r in jobs.callees(jobs.calls(j)).collect()} == {("other/repo/.github/workflows/x.yml@v1", 1), ("me/repo/.github/workflows/y.yml", 1)}


def test_workflow_level_write_all_does_not_reach_jobs(spark):
    j = jobs.jobs(docs(spark, "permissions: write-all\njobs: {a: {steps: []}, b: {permissions: write-all, steps: []}}"))
    assert {r["job_id"]: r["write_all"] for r in jobs.privilege(j, jobs.isolation(j)).collect()} == {"a": False, "b": True}


def test_nests_of_aliases_are_not_written_out():
    """Nine levels of nine aliases stand for 387 million values; the file counts as unreadable, a plain alias does not."""
    nest = "a0: &a0 [x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 9)}]\n" for i in range(1, 9))
    assert documents.workflow_struct(nest + "jobs:\n  b:\n    steps:\n    - run: x\n      with: {k: *a8}\n") is None
    loop = "a: &a [*a]\njobs: {}\n"
    assert documents.workflow_struct(loop) is None
    plain = "x: &x {k: 1}\njobs:\n  b:\n    steps:\n    - uses: o/r@v1\n      with: *x\n"
    assert documents.workflow_struct(plain)["jobs"][0]["steps"][0]["with_text"] == "{'k': 1}"
    assert documents.expanded([[1, 2], [3]]) == 6
