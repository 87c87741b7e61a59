"""Cube sampling keeps totals, repeats and determinism."""

import numpy as np

from refweave.llm import mixing


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 3000, 500)
    out = mixing.flight(p, size, np.random.default_rng(2))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    landed = mixing.flight(p, size, np.random.default_rng(2), land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) < 3000


def test_flight_is_unbiased():
    p, size = np.full(12, 0.3), np.arange(1, 13)
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert abs(mean - 0.3).max() < 0.05


def test_edge_flights():
    for p, size in (([], []), ([0.5], [7]), ([0.0, 1.0], [1, 1]), ([0.5] * 5, [3] * 5), ([0.4] * 4, [1, 1, 1, 10**6])):
        out = mixing.flight(np.array(p, float), np.array(size, float), np.random.default_rng(0), land=True)
        assert len(out) == len(p) and set(out) <= {0.0, 1.0}


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3], int(x)) for i, x in enumerate(rng.integers(5, 400, 3000))] + [(9001, "a", 90_000), (9002, None, 50), (9003, "a", 0), (9004, "z", 10)]
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, None), ("none", 0.4, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for block in (200, 20_000):  # several levels, one level
        chosen = mixing.mix(sizes, targets, block=block)
        got = {(r["doc_id"], r["copies"]) for r in chosen.collect()}
        assert got == {(r["doc_id"], r["copies"]) for r in mixing.mix(sizes, targets, block=block).collect()}
        assert not {i for i, _ in got} & {9002, 9003, 9004}
        shares = {r["source"]: r for r in mixing.shares(chosen, targets).collect()}
        for source, share, most in (("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1)):
            assert abs(shares[source]["actual_share"] - share) < 0.01 and shares[source]["most_copies"] <= most
        assert shares["none"]["actual_share"] == 0
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0
    small = mixing.mix(sizes, targets, total_tokens=20_000).selectExpr("sum(copies * n_tokens)").first()[0]
    assert abs(small - 20_000) < 1_500
