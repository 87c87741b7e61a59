"""As known at event time: persistent trees against scanning all versions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from refweave.operators.knownat import PersistentTree, as_known_at

V = "k string, valid long, known long, seq long, v string"


def answer(versions, known, valid):
    fit = [x for x in versions if x[0] <= known and x[1] <= valid]
    return max(fit, key=lambda x: (x[1], x[2]))[3] if fit else None


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40), st.lists(st.tuples(st.integers(-1, 31), st.integers(-1, 31)), max_size=20))
@settings(max_examples=150, deadline=None)
def test_tree_equals_scan(times, asks):
    versions = sorted((known, valid, i, f"v{i}") for i, (known, valid) in enumerate(times))
    tree = PersistentTree()
    for known, valid, seq, value in versions:
        tree.insert(known, (valid, seq), value)
    for known, valid in asks:
        hit = tree.find(known, valid)
        assert (hit[1] if hit else None) == answer(versions, known, valid)


def test_tree_stays_shallow():
    tree = PersistentTree()
    for i in range(20_000):
        tree.insert(i, (i, i), i)
    assert len(tree.key) < 20_000 * 30
    assert tree.find(10_000, 99_999)[1] == 10_000 and tree.find(19_999, 5)[1] == 5 and tree.find(-1, 5) is None


def check(spark, bitemporal):
    rng = random.Random(5)
    versions, events = [], []
    for i in range(500):
        valid = rng.randrange(300)
        versions.append((rng.choice("abh"), valid, valid + (rng.randrange(90) if bitemporal else 0), i, f"v{i}"))
    versions += [versions[3], ("a", None, 1, 1, "n"), (None, 1, 1, 1, "n")]
    for i in range(300):
        events.append((f"e{i}", rng.choice("abhz"), rng.randrange(-5, 330)))
    events += [("n1", None, 5), ("n2", "a", None)]
    df, ev = spark.createDataFrame(versions, V), spark.createDataFrame(events, "id string, k string, at long")
    for most in (20, 100_000):
        hits = as_known_at(ev, df, "k", "at", "valid", "seq", "v", "id", "known" if bitemporal else None, most)
        got = {r["id"]: r["v"] for r in hits.collect()}
        want = {}
        for e, k, at in events:
            fit = [(n, v, s, x) for kk, v, n, s, x in versions if kk == k and v is not None and at is not None]
            if k and at is not None and (found := answer(fit, at, at)) is not None:
                want[e] = found
        assert got == want


def test_valid_is_known(spark):
    check(spark, False)


def test_known_later(spark):
    check(spark, True)


def test_edges(spark):
    df, ev = spark.createDataFrame([], V), spark.createDataFrame([("e", "a", 1)], "id string, k string, at long")
    assert as_known_at(ev, df, "k", "at", "valid", "seq", "v", "id").count() == 0
    assert as_known_at(ev.limit(0), spark.createDataFrame([("a", 1, 1, 1, "x")], V), "k", "at", "valid", "seq", "v", "id", "known").count() == 0
    some = spark.createDataFrame([("a", 1, 1, 1, None, "q")], V + ", _slice string")
    assert [r["v"] for r in as_known_at(ev, some, "k", "at", "valid", "seq", "v", "id").collect()] == [None]
