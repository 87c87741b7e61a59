"""Workflow and action documents: YAML of any shape becomes one fixed nested struct, parsed once.

The parser is the only Python here; it runs in Arrow batches. Everything computed from the struct is built-in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = "struct<idx:int,name:string,uses:string,run:string,with_text:string,env_text:string>"
JOB = (
    "struct<job_id:string,job_name:string,uses:string,needs:array<string>,has_outputs:boolean,has_steps:boolean,permissions:map<string,string>,"
    f"permissions_text:string,env_text:string,outputs_text:string,secrets_text:string,steps:array<{STEP}>>"
)
DOCUMENT = f"struct<name:string,triggers:array<string>,permissions:map<string,string>,jobs:array<{JOB}>,max_job_depth:int,uses:array<string>>"
ACTION = "struct<kind:string,uses:array<string>,scripts:array<string>,main:string>"


#: Values a document may have with its aliases written out; a nest of aliases has more and counts as unreadable.
MAX_EXPANDED = 1_000_000


def expanded(value, most: int = MAX_EXPANDED) -> int:
    """The number of values of a document with every alias written out, or anything above ``most`` (also for one that holds itself)."""
    sizes: dict[int, int] = {}
    open_: set[int] = set()
    stack = [(value, False)]
    while stack:
        v, done = stack.pop()
        if not isinstance(v, (dict, list)):
            continue
        inside = list(v.values()) if isinstance(v, dict) else v
        if done:
            open_.discard(id(v))
            sizes[id(v)] = 1 + sum(sizes.get(id(x), 1) for x in inside)
            if sizes[id(v)] > most:
                return sizes[id(v)]
        elif id(v) in open_:
            return most + 1
        elif id(v) not in sizes:
            open_.add(id(v))
            stack.append((v, True))
            stack.extend((x, False) for x in inside)
    return sizes.get(id(value), 1)


def _load(text: str):
    import yaml

    try:
        root = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    return root if expanded(root) <= MAX_EXPANDED else None


def _text(value) -> str:
    return "" if value in (None, False, "", {}, []) else str(value)


def _levels(value) -> dict[str, str]:
    """A permissions value as levels: a word stands under its own name, as write."""
    if isinstance(value, str):
        word = value.strip().lower()
        return {word: "write"} if word in ("write-all", "read-all") else {}
    if not isinstance(value, dict):
        return {}
    out = {}
    for k, v in value.items():
        key, level = str(k).strip().lower(), str(v).strip().lower()
        if key in ("write-all", "read-all"):
            out[key] = "write"
        else:
            out[key] = {"write-all": "write", "read-all": "read"}.get(level, level if level in ("write", "read", "none") else "default")
    return out


def longest_chain(jobs: list[str], needs: list[tuple[str, str]]) -> int:
    """Links of the longest chain of needs; jobs on loops, and behind them, count for nothing."""
    after: dict[str, set[str]] = {}
    for first, then in needs:
        after.setdefault(first, set()).add(then)
    waits = {j: 0 for j in [*jobs, *after]}
    for then in (t for ts in after.values() for t in ts):
        waits[then] = waits.get(then, 0) + 1
    depth = {j: 0 for j, n in waits.items() if not n}
    ready = list(depth)
    most = 0
    for job in ready:
        most = max(most, depth[job])
        for then in after.get(job, ()):
            depth[then] = max(depth.get(then, 0), depth[job] + 1)
            waits[then] -= 1
            if not waits[then]:
                ready.append(then)
    return most


def _walk(value, out: set[str]) -> None:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("uses"), str):
                out.add(v["uses"])
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)


def workflow_struct(text: str | None) -> dict | None:
    """The struct of one workflow text; None if it does not parse or is no mapping."""
    root = _load(text) if text else None
    if not isinstance(root, dict):
        return None
    on = root.get("on", root.get(True))  # YAML 1.1 reads the key `on` as true
    triggers = [on] if isinstance(on, str) else [str(x) for x in on] if isinstance(on, (list, dict)) else []
    jobs, chain = [], []
    found = root.get("jobs") if isinstance(root.get("jobs"), dict) else {}
    for job_id, job in found.items():
        if not isinstance(job, dict):
            continue
        needs = job.get("needs")
        needs = [needs] if isinstance(needs, str) else [str(x) for x in needs] if isinstance(needs, list) else []
        chain += [(n, str(job_id)) for n in needs]
        steps = []
        for i, s in enumerate(job["steps"]) if isinstance(job.get("steps"), list) else ():
            if isinstance(s, dict):
                uses = s.get("uses")
                steps.append({
                    "idx": i, "name": _text(s.get("name") or s.get("id")).strip(), "uses": uses if isinstance(uses, str) else None,
                    "run": _text(s.get("run")), "with_text": _text(s.get("with")), "env_text": _text(s.get("env")),
                })
        jobs.append({
            "job_id": str(job_id), "job_name": None if job.get("name") is None else str(job["name"]), "uses": job["uses"] if isinstance(job.get("uses"), str) else None,
            "needs": needs, "has_outputs": "outputs" in job, "has_steps": isinstance(job.get("steps"), list), "permissions": _levels(job.get("permissions")),
            "permissions_text": _text(job.get("permissions")), "env_text": _text(job.get("env")), "outputs_text": _text(job.get("outputs")),
            "secrets_text": _text(job.get("secrets")), "steps": steps,
        })
    uses: set[str] = set()
    _walk(root, uses)
    return {
        "name": None if not root.get("name") else str(root["name"]), "triggers": triggers, "permissions": _levels(root.get("permissions")), "jobs": jobs,
        "max_job_depth": longest_chain([str(j) for j in found], chain), "uses": sorted(uses),
    }


def action_struct(text: str | None) -> dict:
    """kind (composite, docker, javascript, unknown), what a composite uses and runs, and a script's entry."""
    root = _load(text) if text else None
    runs = root.get("runs") if isinstance(root, dict) else None
    runs = runs if isinstance(runs, dict) else {}
    using = runs.get("using")
    kind = {"composite": "composite", "docker": "docker", "node12": "javascript", "node16": "javascript", "node20": "javascript"}.get(using, "unknown")
    steps = [s for s in runs.get("steps") or () if isinstance(s, dict)] if kind == "composite" and isinstance(runs.get("steps"), list) else []
    main = runs.get("main") if kind == "javascript" and isinstance(runs.get("main"), str) else None
    return {"kind": kind, "uses": list(dict.fromkeys(s["uses"] for s in steps if isinstance(s.get("uses"), str))), "scripts": [s["run"] for s in steps if isinstance(s.get("run"), str)], "main": main}


def _parsed(df: DataFrame, content: str, keep: list[str], parse, schema: str, out: str) -> DataFrame:
    picked = df.select(*keep, F.col(content).alias("_content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(c.as_py()) for c in batch.column(batch.num_columns - 1)]
            texts = pa.array([None if m is None else json.dumps(m) for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "_json"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, _json string").withColumn(out, F.from_json("_json", schema)).drop("_json")


def workflow_documents(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``doc``, null where the content is missing, does not parse, expands beyond MAX_EXPANDED or is no mapping."""
    return _parsed(df, content, keep, workflow_struct, DOCUMENT, "doc")


def action_documents(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    return _parsed(df, content, keep, action_struct, ACTION, "action")
