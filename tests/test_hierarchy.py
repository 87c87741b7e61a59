"""Hierarchies against breadth-first search from every node."""

from hypothesis import given, settings
from hypothesis import strategies as st

from refweave.operators.hierarchy import hierarchies, nested_sets


def reach(links, n, some=None):
    down = {v: set() for v in range(n)}
    for a, b in links:
        down[a].add(b)
    out = {}
    for v in some or range(n):
        dist, todo = {}, [v]
        level = 0
        while todo:
            level += 1
            todo = [c for x in todo for c in down[x] if c not in dist and not dist.setdefault(c, level) is None]
        out[v] = dist
    return out


@given(st.integers(1, 9).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=16))))
@settings(max_examples=400, deadline=None)
def test_any_graph(case):
    n, links = case
    links = sorted(links)
    r, far = nested_sets(links, n), reach(links, n)
    roots = [v for v in range(n) if not any(b == v for _, b in links)]
    for v in range(n):
        assert r["reached"][v] == len(far[v].keys() - {v})
        assert r["loop"][v] == (v in far[v])
        ways = sorted((0 if root == v else far[root][v], root) for root in roots if root == v or v in far[root])
        assert (r["depth"][v], r["root"][v]) == (ways[0] if ways else (-1, -1))


def test_long_chain_and_ranges():
    n = 5000
    r = nested_sets([(i, i + 1) for i in range(n - 1)], n)
    assert r["depth"][n - 1] == n - 1 and r["reached"][0] == n - 1 and (r["start"][0], r["end"][0]) == (0, n)


def test_operator(spark):
    rows = [
        ("r", "p", "w", "a"), ("r", "p", "a", "b"), ("r", "p", "a", "b"), ("r", "p", "b", "a"), ("r", "p", "w", "c"), ("r", "q", "x", "x"), ("r", "q", "y", "z"),
        (None, "p", "w", "a"), ("r", None, "w", "a"), ("r", "p", None, "a"), ("r", "p", "a", None),
    ]
    df = spark.createDataFrame([(*x, 9, "s") for x in rows], "rep string, path string, s string, d string, depth int, scope string")
    got = {(r["path"], r["node_id"]): (r["root_node_id"], r["depth"], r["n_descendants"], r["on_cycle"], r["path_"]) for r in hierarchies(df.withColumnRenamed("path", "pth"), ["rep", "pth"], "s", "d").withColumnRenamed("path", "path_").withColumnRenamed("pth", "path").collect()}
    assert got == {
        ("p", "w"): ("w", 0, 3, 0, ["w"]), ("p", "a"): ("w", 1, 1, 1, ["w", "a"]), ("p", "b"): ("w", 2, 1, 1, ["w", "a", "b"]), ("p", "c"): ("w", 1, 0, 0, ["w", "c"]),
        ("q", "x"): ("", -1, 0, 1, []), ("q", "y"): ("y", 0, 1, 0, ["y"]), ("q", "z"): ("y", 1, 0, 0, ["y", "z"]),
    }
    assert hierarchies(df.limit(0), ["rep"], "s", "d").count() == 0


def test_large_scopes_are_solved_alike(spark):
    """Both ways give the same roots, depths, descendants, loops and paths."""
    import random

    rng = random.Random(4)
    rows = [("s1", "w", "a"), ("s1", "a", "b"), ("s1", "b", "c"), ("s1", "c", "a"), ("s1", "w", "d"), ("s1", "d", "d"), ("s2", "x", "y"), ("s2", "y", "x"), ("s2", "y", "z"), ("s2", "k", "z"), ("s3", "r", "s")]
    rows += [("s4", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)] + [("s5", f"t{(i - 1) // 2}", f"t{i}") for i in range(1, 25)] + [("s5", "t20", "t2")]
    df = spark.createDataFrame(rows, "scope string, s string, d string")
    small, large, mixed = (sorted(map(repr, hierarchies(df, ["scope"], "s", "d", max_scope=most).collect())) for most in (200_000, 0, 6))
    assert small == large == mixed


def test_ranges_do_not_depend_on_the_way(spark):
    """A loose loop smaller than the roots, loops that lead to loops, and random graphs."""
    import random

    rows = [("s", "b", "c"), ("s", "c", "d"), ("s", "a1", "a2"), ("s", "a2", "a1"), ("t", "m", "n"), ("t", "n", "m"), ("t", "m", "o"), ("t", "k", "k"), ("t", "k", "o"), ("t", "z", "o")]
    for seed in range(6):
        rng = random.Random(seed)
        rows += [(f"r{seed}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(5 + seed * 2)]
    df = spark.createDataFrame(rows, "scope string, s string, d string")
    got = [sorted(map(repr, hierarchies(df, ["scope"], "s", "d", max_scope=most).collect())) for most in (0, 200_000)]
    assert got[0] == got[1]
    b = hierarchies(df, ["scope"], "s", "d").where("scope = 's' and node_id = 'b'").first()
    assert (b["range_start"], b["range_end"]) == (0, 3)


def test_many_links_in_one_scope():
    """Layers of nodes with two links each, 50,000 links: seconds, not hours; and exact on samples."""
    import random
    import time

    rng, width, layers = random.Random(1), 250, 100
    links = sorted({(i * width + k, (i + 1) * width + rng.randrange(width)) for i in range(layers) for k in range(width) for _ in range(2)})
    n = (layers + 1) * width
    began = time.time()
    r = nested_sets(links, n)
    assert len(links) > 49_000 and time.time() - began < 10
    far = reach(links, n, range(0, n, 1777))
    for v in far:
        assert r["reached"][v] == len(far[v]) and not r["loop"][v]
    ring = nested_sets(links + [(n - 1, 0)], n)
    assert any(ring["loop"]) and ring["reached"][0] >= r["reached"][0]
