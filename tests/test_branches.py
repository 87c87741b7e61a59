"""Edges of the recursive build counted without listing branches, against the listed ones."""

import random
from collections import Counter

import pytest

from refweave.operators import branches, graph

DIRECT, NESTED = "repository string, path string, action_id string, key string, ref_type string", "parent string, action_id string, key string, ref_type string"


def build(seed):
    """Direct uses and links with loops, and the counts of the branches followed one by one; some actions share a key, some have several."""
    rng = random.Random(seed)
    size = rng.choice([5, 7, 9, 14])
    names = [f"a{i}" for i in range(size)]
    kind = {x: rng.choice(["sha", "tag", None]) for x in names}
    key = {x: x if rng.random() < 0.9 else rng.choice(names) for x in names}
    triple = lambda x: (x, key[x] if rng.random() < 0.95 else "other", kind[x] if rng.random() < 0.95 else "tag")
    direct = sorted({(f"o/r{rng.randrange(3)}", rng.choice(["a.yml", "b.yml", "c.yml"]), *triple(rng.choice(names))) for _ in range(rng.choice([3, 9, 20]))}, key=str)
    links = sorted({(rng.choice(names), *triple(rng.choice(names))) for _ in range(rng.choice([4, 3, 5]) * size)}, key=str)
    under, want = {}, {}
    for p, *x in links:
        under.setdefault(p, []).append(tuple(x))

    def follow(repo, path, x, seen, depth, limit):
        for y in under.get(x[0], []):
            if y[1] not in seen and depth <= limit:
                k = repo, path, x[0], y[0], depth
                want[k] = want.get(k, False) or (x[2] == "sha" and y[2] == "tag")
                follow(repo, path, y, {*seen, y[1]}, depth + 1, limit)

    limit = rng.choice([1, 2, 3, 4, 5, 6, 6, 6, 6])
    for repo, path, *x in direct:
        want[repo, path, path, x[0], 1] = False
        follow(repo, path, tuple(x), {x[1]}, 2, limit)
    edges, downs = Counter(), Counter()
    for (repo, *_, depth), down in want.items():
        edges[repo, depth] += 1
        downs[repo, depth] += down
    return direct, links, limit, {k: (n, downs[k]) for k, n in edges.items()}


@pytest.mark.parametrize("seed", range(12))
def test_counts_equal_single_branches(spark, seed):
    direct, links, limit, want = build(seed)
    rows = graph.expand_counts(spark.createDataFrame(direct, DIRECT), spark.createDataFrame(links, NESTED), limit).collect()
    assert {(r["consumer_repository"], r["depth"]): (r["edges"], r["downgrades"]) for r in rows} == want and len(rows) == len(want)


def test_branches_too_many_to_list(spark):
    """Forty actions that all use each other: 6.9e7 branches of six from each."""
    names = [f"a{i}" for i in range(40)]
    direct = [("o/r", "a.yml", "a0", "a0", "sha"), ("o/r", "b.yml", "a0", "a0", "sha"), ("o/r", "b.yml", "a1", "a1", "tag")]
    links = [(a, b, b, "tag" if b != "a0" else "sha") for a in names for b in names]
    rows = graph.expand_counts(spark.createDataFrame(direct, DIRECT), spark.createDataFrame(links, NESTED)).collect()
    got = {r["depth"]: (r["edges"], r["downgrades"]) for r in rows}
    # a.yml: from depth 3 on all pairs without a0; b.yml: all pairs but a0 and a1 together, and a0 is left for a tag on the ways from a1
    assert got == {1: (3, 0), 2: (39 + 78, 39 + 39), **{d: (39 * 38 + 40 * 39 - 2, 38) for d in range(3, 7)}}


def test_large_sets_and_counting(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**63, (1000, 3), dtype=np.uint64)
    want = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
    assert (branches.column_sums(rows) == want).all()
    direct = [("o/r", "a.yml", f"d{i}", f"d{i}", "tag") for i in range(2100)]  # more than the bits of a row
    links = [(f"d{i}", "x", "x", "tag") for i in range(2100)] + [("x", "y", "y", "tag"), ("x", "d0", "d0", "tag")]
    got = graph.expand_counts(spark.createDataFrame(direct, DIRECT), spark.createDataFrame(links, NESTED)).collect()
    assert {r["depth"]: r["edges"] for r in got} == {1: 2100, 2: 2100, 3: 2}


def test_actions_that_only_use_themselves(spark):
    direct = [("o/r", "a.yml", "s", "s", "tag"), ("o/q", "a.yml", "b", "b", "tag"), ("o/q", "a.yml", "s", "s", "tag")]
    links = [(x, x, x, "tag") for x in "st"] + [("a", "b", "b", "tag"), ("b", "c", "c", "tag"), ("z", "a", "a", "tag")]
    got = graph.expand_counts(spark.createDataFrame(direct, DIRECT), spark.createDataFrame(links, NESTED)).collect()
    assert sorted((r["consumer_repository"], r["depth"], r["edges"]) for r in got) == [("o/q", 1, 2), ("o/q", 2, 1), ("o/r", 1, 1)]
