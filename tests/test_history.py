"""Type-two history and snapshot changes against plain Python."""

import random

from refweave.operators.history import build_history, merge_history
from refweave.operators.slices import cut, widths
from refweave.operators.snapshots import snapshot_changes, snapshot_intervals

OBS = "k string, ts long, seq long, v string"


def brute(rows):
    states = {}
    for k, ts, seq, v in rows:
        if k is not None and ts is not None and (states.get((k, ts), (-1,))[0] < seq):
            states[k, ts] = (seq, v)
    out, by = [], {}
    for (k, ts), (_, v) in sorted(states.items()):
        by.setdefault(k, []).append((ts, v))
    for k, runs in by.items():
        starts = [(ts, v) for i, (ts, v) in enumerate(runs) if i == 0 or runs[i - 1][1] != v]
        out += [(k, v, ts, starts[i + 1][0] if i + 1 < len(starts) else None) for i, (ts, v) in enumerate(starts)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in df.collect()), key=repr)


def sample(n, seed, keys="abc", span=400):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(span), i, rng.choice(["x", "y", None])) for i in range(n)]


def test_history_equals_brute_force_across_slices(spark):
    rows = sample(600, 1) + [("hot", i, 1000 + i, "xy"[i // 7 % 2]) for i in range(400)] + [(None, 1, 1, "x"), ("a", None, 2, "x")]
    for most, periods in ((3, 1), (40, 3), (10_000, 5), (25, 1)):
        assert result(build_history(spark.createDataFrame(rows, OBS), "k", "ts", "seq", ["v"], most, periods)) == brute(rows)


def test_slices_hold_no_more_than_asked(spark):
    """A burst: half of a hot key's rows within a hundredth of its time, and rows of one moment."""
    rows = [("hot", i * 1000, i, "x") for i in range(300)] + [("hot", 150_000 + i, i, "x") for i in range(300)] + [("cold", i, i, "x") for i in range(20)]
    df = spark.createDataFrame(rows + [("same", 5, i, "x") for i in range(60)], OBS)
    plan = widths(df, "k", "ts", 50)
    assert {r["k"] for r in plan.collect()} == {"hot", "same"}
    held = {(r["k"], r["_slice"]): r["count"] for r in cut(df, "k", "ts", plan).groupBy("k", "_slice").count().collect()}
    assert max(n for (k, _), n in held.items() if k != "same") <= 50 and widths(df, "k", "ts", 1000) is None


def test_last_seen_of_open_versions(spark):
    rows = [("a", 1, 1, "x"), ("a", 5, 2, "x"), ("b", 1, 1, "x"), ("b", 7, 2, "y")]
    for periods in (1, 3):
        h = build_history(spark.createDataFrame(rows, OBS), "k", "ts", "seq", ["v"], periods=periods)
        assert {(r["k"], r["v"], r["last_seen"]) for r in h.collect()} == {("a", "x", 5), ("b", "x", None), ("b", "y", 7)}


def test_history_edges(spark):
    empty = build_history(spark.createDataFrame([], OBS), "k", "ts", "seq", ["v"])
    assert empty.count() == 0 and empty.columns[:2] == ["k", "v"]
    rows = [("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 5, 2, "y"), ("a", 9, 3, "y"), ("b", -7, 1, "")]
    assert result(build_history(spark.createDataFrame(rows, OBS), "k", "ts", "seq", ["v"])) == [("a", "y", 5, None), ("b", "", -7, None)]
    clash = spark.createDataFrame([("a", 1, 1, "x", 0, "q", 7)], OBS + ", valid_from int, _key string, _slice long")
    assert result(build_history(clash, "k", "ts", "seq", ["v"])) == [("a", "x", 1, None)]
    two = spark.createDataFrame([("a", 1, 1, "x", None), ("a", 2, 2, "x", 1), ("a", 3, 3, "x", 1)], OBS + ", w int")
    assert sorted(r["valid_from"] for r in build_history(two, "k", "ts", "seq", ["v", "w"]).collect()) == [1, 2]


def test_merge_equals_rebuild(spark):
    rows = sample(300, 2) + [("new", 5, 900, "x"), ("late", 50, 1, "x"), ("late", 70, 2, "x"), ("late", 60, 950, "y"), ("on", 1, 3, "x"), ("on", 900, 960, "x"), ("go", 1, 4, "x"), ("go", 900, 961, "y")]
    log, updates = [r for r in rows if r[2] < 200], [r for r in rows if r[2] >= 200]
    a, b = spark.createDataFrame(log, OBS), spark.createDataFrame(updates, OBS)
    merged = merge_history(build_history(a, "k", "ts", "seq", ["v"], 50), a, b, "k", "ts", "seq", ["v"], 50)
    assert result(merged) == brute(rows)
    none = spark.createDataFrame([], OBS)
    assert result(merge_history(build_history(none, "k", "ts", "seq", ["v"]), none, a, "k", "ts", "seq", ["v"])) == brute(log)
    assert result(merge_history(build_history(a, "k", "ts", "seq", ["v"]), a, none, "k", "ts", "seq", ["v"])) == brute(log)


SNAP = "n int, k string, at long, v string"


def test_snapshot_changes(spark):
    rows = [
        (1, "stay", 1, "x"), (2, "stay", 2, "x"), (4, "stay", 3, "x"), (1, "move", 1, "x"), (2, "move", 2, "y"), (4, "move", 2, "y"), (1, "go", 1, "x"),
        (4, "come", 3, "x"), (1, "back", 1, "x"), (4, "back", 3, "x"), (2, "dup", 1, "old"), (2, "dup", 2, "x"), (1, "dup", 1, "x"), (4, "dup", 9, "x"), (4, "dup", 9, "x"),
        (1, "null", 1, None), (2, "null", 2, None), (4, "null", 3, "x"), (None, "no", 1, "x"), (1, None, 1, "x"),
    ]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP), "k", "n", "at", ["v"]).collect()}
    assert got == {(2, "move", "changed"), (2, "go", "removed"), (4, "come", "added"), (2, "back", "removed"), (4, "back", "added"), (4, "null", "changed")}
    runs = snapshot_intervals(spark.createDataFrame(rows, SNAP), "k", "n", "at", ["v"])
    assert {(r["k"], r["first_snapshot"], r["n_snapshots"]) for r in runs.collect() if r["k"] in ("stay", "back")} == {("stay", 1, 3), ("back", 1, 1), ("back", 4, 1)}


def test_snapshot_edges(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP), "k", "n", "at", ["v"]).count() == 0
    assert snapshot_changes(spark.createDataFrame([(3, "a", 1, "x")], SNAP), "k", "n", "at", ["v"]).count() == 0
    clash = spark.createDataFrame([(1, "a", 1, "x", 1, "z"), (2, "a", 1, "y", 1, "z")], SNAP + ", _rank int, row_hash string")
    assert [tuple(r) for r in snapshot_changes(clash, "k", "n", "at", ["v"]).collect()] == [(2, "a", "changed")]
