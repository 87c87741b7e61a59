"""Counts of what reaches a node, in blocks of origins: against plain search, the bitmaps, and by what they write."""

import random
from pathlib import Path

import numpy as np
import pytest

from refweave.operators import graph, sweep
from refweave.session import own_dir

E = "src_node_id string, dst_node_id string, src_kind string, dst_kind string"


def far(links, origin):
    """Fewest links from ``origin`` to every other node."""
    out, front, k = {origin: 0}, {origin}, 0
    while front:
        k += 1
        front = {b for a in front for b in links.get(a, ())} - out.keys()
        out |= dict.fromkeys(front, k)
    return {v: k for v, k in out.items() if k}


def written(spark):
    return sum(p.stat().st_size for p in Path(own_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


@pytest.mark.parametrize("block_bytes", [16, 64, 1 << 20])
def test_blocks_equal_plain_search(monkeypatch, block_bytes):
    monkeypatch.setattr(sweep, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(sweep, "MAX_WORDS", 1)
    monkeypatch.setattr(sweep, "FIRST", 2)
    rng = random.Random(block_bytes)
    for _ in range(60):
        n = rng.randrange(1, 150)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(3 * n))]
        origins = sorted(rng.sample(range(n), rng.randrange(n + 1)))
        worth = [rng.choice([-1, 0, 3, 77]) for _ in origins]
        g = sweep.net(np.arange(n) * 7, *(np.array([x[i] for x in links], np.int64) for i in (0, 1)), np.array(origins, np.int64), np.array(worth, np.int64))
        sums, to, want = sweep._count(g, range(g.blocks)), {}, {}
        for a, b in links:
            to.setdefault(a, set()).add(b)
        for o, w in zip(origins, worth):
            for v, k in far(to, o).items():
                x = want.setdefault(v, [0, 0, 0, 0, 0])
                want[v] = [x[0] + 1, max(x[1], k), x[2] + k, x[3] + (w >= 0), x[4] + max(w, 0)]
        assert {int(g.ids[i]) // 7: sums[:, i].tolist() for i in np.flatnonzero(sums[0])} == want


def dense(spark, n, repositories):
    rng = random.Random(n)
    rows = [(f"a{i}", f"a{(i + 1) % n}", "action", "action") for i in range(n)] + [(f"a{rng.randrange(n)}", f"a{rng.randrange(n)}", "action", "action") for _ in range(n)]
    rows += [(f"workflow::o/r{i}::w.yml", f"a{rng.randrange(n)}", "workflow", "action") for i in range(repositories)]
    return spark.createDataFrame(rows, E), rows


def test_reach_of_a_loop_writes_links_only(spark):
    """On one large loop every node reaches every other: sets or pairs of these are megabytes a round, the links are not."""
    e, rows = dense(spark, 1500, 50)
    to = {}
    for a, b, *_ in rows:
        to.setdefault(a, set()).add(b)
    before = written(spark)
    got = {r["node_id"]: (r["reached"], r["max_hops"], r["sum_hops"]) for r in graph.reach_counts(e).collect()}
    assert written(spark) - before < 1_000_000
    hops = {v: far(to, v).values() for v in to}
    assert got == {v: (len(h), max(h), sum(h)) for v, h in hops.items()}


def test_too_many_links_flow_as_bitmaps(spark, monkeypatch):
    e, _ = dense(spark, 40, 9)
    want = sorted(graph.reach_counts(e).collect())
    monkeypatch.setattr(sweep, "MAX_LINKS", 0)
    assert sorted(graph.reach_counts(e).collect()) == want and len(want) == 49


def test_downstream_of_a_loop_writes_links_only(spark):
    """Repositories, their worth and the union over groups against plain sets, and nothing but links written."""
    e, rows = dense(spark, 1500, 400)
    worth = {f"o/r{i}": 60 + i for i in range(0, 400, 3)}
    w = spark.createDataFrame(list(worth.items()), "repository string, worth long")
    groups = [("g0", "a1"), ("g0", "a2"), ("g1", "a7"), ("none", "unknown")]
    to, sets = {}, {}
    for a, b, *_ in rows:
        to.setdefault(a, set()).add(b)
    for a in [x for x in to if x.startswith("workflow")]:
        for v in far(to, a):
            sets.setdefault(v, set()).add(a.split("::")[1])
    before = written(spark)
    got = {r[0]: tuple(r[1:]) for r in graph.downstream_counts(e, w).collect()}
    unions = {r["group"]: r["n"] for r in graph.downstream_unions(e, spark.createDataFrame(groups, "group string, action_id string")).collect()}
    assert written(spark) - before < 1_000_000
    assert got == {v: (len(x), len(x & worth.keys()), sum(worth.get(r, 0) for r in x)) for v, x in sets.items()}
    assert unions == {"g0": len(sets["a1"] | sets["a2"]), "g1": len(sets["a7"])}


def test_pairs_of_a_loop_are_handed_on(spark, monkeypatch):
    """The listed pairs are right, whatever way they are found, and leave nothing but links on disk."""
    e, rows = dense(spark, 1500, 400)
    to = {}
    for a, b, *_ in rows:
        to.setdefault(a, set()).add(b)
    want = {(v, a.split("::")[1]) for a in to if a.startswith("workflow") for v in far(to, a)}
    monkeypatch.setattr(sweep, "PAIRS", 3000)
    before = written(spark)
    found = graph.downstream_repositories(e).toPandas()
    assert written(spark) - before < 1_000_000 and len(found) == len(want) and set(zip(found["action_id"], found["repository"])) == want
    small, _ = dense(spark, 40, 9)
    few = sorted(graph.downstream_repositories(small).collect())
    monkeypatch.setattr(sweep, "MAX_NAMES", 0)
    assert sorted(graph.downstream_repositories(small).select("action_id", "repository").collect()) == few and len(few) == 360


@pytest.mark.parametrize("block_bytes", [16, 64, 1 << 20])
def test_totals_equal_plain_search(monkeypatch, block_bytes):
    monkeypatch.setattr(sweep, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(sweep, "MAX_WORDS", 1)
    rng = random.Random(block_bytes)
    for _ in range(60):
        n = rng.randrange(1, 150)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(3 * n))]
        origins = sorted(rng.sample(range(n), rng.randrange(n + 1)))
        worth = [rng.choice([-1, 0, 3, 77]) for _ in origins]
        g = sweep.dag(np.arange(n) * 7, *(np.array([x[i] for x in links], np.int64) for i in (0, 1)), np.array(origins, np.int64), np.array(worth, np.int64))
        sums, to, want = sweep._total(g, range(g.blocks)), {}, {}
        for a, b in links:
            to.setdefault(a, set()).add(b)
        for o, w in zip(origins, worth):
            for v in far(to, o):
                x = want.setdefault(v, [0, 0, 0])
                want[v] = [x[0] + 1, x[1] + (w >= 0), x[2] + max(w, 0)]
        assert {int(g.ids[i]) // 7: sums[:, i].tolist() for i in np.flatnonzero(sums[0])} == want


def test_a_link_passes_its_words_once(monkeypatch):
    """On a loop of n nodes with tails, rounds would pass every link n times."""
    n, passed = 400, []
    merge = sweep._merge
    monkeypatch.setattr(sweep, "_merge", lambda rows, send, take, moved: (passed.append(len(send)), merge(rows, send, take, moved)))
    send = np.r_[np.arange(n), np.arange(n), np.arange(n, 2 * n)]
    take = np.r_[(np.arange(n) + 1) % n, np.arange(n, 2 * n), np.arange(2 * n, 3 * n)]
    g = sweep.dag(np.arange(3 * n), send, take, np.arange(n), np.full(n, -1))
    sums = sweep._total(g, range(g.blocks))
    assert sum(passed) <= len(send) * g.blocks and sums[0].tolist() == [n - 1] * n + [n] * 2 * n
