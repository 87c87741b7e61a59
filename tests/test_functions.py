"""Column functions and statistics."""

import pytest
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.functions import stats
from refweave.functions.text import clean_sha, filled, stable_id, strip


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_references(spark):
    refs = ["main", "v4", "v4.1.7", "a" * 40, "next", "1234567", "v1.2", "refs/heads/x", "latest", "", None, "${{ x }}"]
    got = values(spark, [(r,) for r in refs], "r string", X.ref_category(F.col("r")), X.classify_ref(F.col("r")))
    assert [g[0] for g in got] == ["BRANCH_MAIN", "MAJOR_TAG", "SEMVER_TAG", "FULL_SHA", "BRANCH_OTHER", "SHORT_SHA", "UNKNOWN_REF", "BRANCH_OTHER", "FLOATING_TAG", "UNKNOWN_REF", "UNKNOWN_REF", "UNKNOWN_REF"]
    assert [g[1] for g in got] == ["branch", "tag", "tag", "sha", "tag", "tag", "tag", "branch", "tag", "tag", "unknown", "unknown"]
    uses = [("a/b@v1",), ("a/b/c/d@x@y",), ("a@v1",), ("a/b",), ("./x",)]
    u = F.col("u")
    assert values(spark, uses, "u string", X.uses_part(u, 1), X.uses_subpath(u), X.uses_ref(u)) == [("b", None, "v1"), ("b", "c/d", "x@y"), (None, None, "v1"), (None, None, None), (None, None, None)]
    assert [r[0] for r in values(spark, uses, "u string", X.trust_domain(u, F.lit("A")))] == ["same_owner", "same_owner", "unknown", "unknown", "unknown"]


def test_texts(spark):
    assert values(spark, [("  AB\t",), ("",), (None,), (" ",)], "s string", strip("s"), clean_sha("s"), filled("s")) == [("AB", "ab", True), ("", None, False), (None, None, False), ("", None, False)]
    assert values(spark, [("Unknown",), ("x",)], "s string", filled("s")) == [(False,), (True,)]
    import hashlib

    assert values(spark, [("a", None)], "a string, b string", stable_id(F.col("a"), F.col("b"))) == [(hashlib.sha1(b"a::").hexdigest(),)]
    html = "<b>Tom &amp;  Jerry</b>&nbsp;<i class='x'>&lt;3</i>"
    assert values(spark, [(html,)], "h string", X.strip_html(F.col("h"))) == [("Tom & Jerry <3",)]
    assert values(spark, [('<a href="/1">x</a><a class=y rel="next" href="/2">n</a>',), ("<p>",)], "h string", X.next_page(F.col("h"))) == [("/2",), (None,)]
    assert values(spark, [("x secrets.GITHUB_TOKEN y",)], "t string", X.token_patterns(F.col("t"))) == [(["GITHUB_TOKEN", "secrets.GITHUB_TOKEN"],)]
    assert values(spark, [("bash ./a/b.sh && python x.py",)], "t string", X.script_paths(F.col("t"))) == [(["./a/b.sh", "x.py"],)]
    assert values(spark, [("abc", "abcd"), ("abc", "abc"), ("", "a")], "a string, b string", X.prefix_confusion(F.col("a"), F.col("b"))) == [(True,), (False,), (False,)]


def test_statistics(spark):
    rows = [(i, float(v)) for i, v in enumerate([5, 1, 0, 3, 3, 8, 0, 2, 9, 4])]
    df = spark.createDataFrame(rows, "i int, v double")
    order = sorted(v for _, v in rows)
    n, total = len(order), sum(order)
    assert stats.gini(df, "v", ["i"]).first()[0] == pytest.approx(2 * sum((k + 1) * v for k, v in enumerate(order)) / (n * total) - (n + 1) / n)
    assert sorted(r["value_share"] for r in stats.lorenz(df, "v", ["i"]).collect())[-1] == pytest.approx(1)
    assert [r["share"] for r in stats.ecdf(df, "v", ["i"]).orderBy("share").collect()] == [(k + 1) / n for k in range(n)]
    assert tuple(stats.top_shares(df, "v", [1, 3], ["i"]).first()) == (9 / total, 22 / total)
    assert stats.gini(df.limit(0), "v", ["i"]).first()[0] == 0 and stats.top_shares(df.limit(0), "v", [1], ["i"]).first()[0] == 0
    labelled = df.withColumn("l", F.lit("x"))
    b = stats.bootstrap(labelled, "l", "v", ["i"], iterations=200, seed=7).first()
    assert b["ci_low"] < b["estimate"] == 3.5 < b["ci_high"] and b["sample_count"] == 10
    assert b == stats.bootstrap(labelled, "l", "v", ["i"], iterations=200, seed=7).first()
    p = stats.bootstrap_means(labelled, "l", "v", iterations=100).first()
    assert 0 < p["ci_low"] < 3.5 < p["ci_high"] < 9
    with pytest.raises(ValueError):
        stats.bootstrap(labelled, "l", "v", ["i"], most=3)


def test_difference_interval_equals_plain_python(spark):
    """Both samples from one seeded generator, the left one first, and the nearest-rank ends of the sorted differences."""
    import random

    rows = [("m", float(i % 7), i < 9, i) for i in range(24)] + [("one", 1.0, True, 0), ("none", None, True, 0)]
    df = spark.createDataFrame(rows, "l string, v double, x boolean, i int")
    got = {r["metric"]: r for r in stats.bootstrap_difference(df, "l", "v", "x", ["i"], iterations=100, seed=3).collect()}
    left, right = [float(i % 7) for i in range(9)], [float(i % 7) for i in range(9, 24)]
    rng, draws = random.Random(3), []
    for _ in range(100):
        a = [left[rng.randrange(9)] for _ in range(9)]
        b = [right[rng.randrange(15)] for _ in range(15)]
        draws.append(sum(a) / 9 - sum(b) / 15)
    draws.sort()
    m = got["m"]
    assert (m["left_count"], m["right_count"]) == (9, 15) and m["difference"] == pytest.approx(sum(left) / 9 - sum(right) / 15, abs=1e-6)
    assert m["ci_low"] == pytest.approx(draws[round(99 * 0.025)], abs=1e-6) and m["ci_high"] == pytest.approx(draws[round(99 * 0.975)], abs=1e-6)
    assert got["one"]["difference"] is None and "none" not in got
    wide = {r["l"]: r for r in stats.bootstrap_differences(df.where("l = 'm'"), "l", "v", "x", iterations=200).collect()}["m"]
    assert wide["ci_low"] < m["difference"] < wide["ci_high"]
    with pytest.raises(ValueError):
        stats.bootstrap_difference(df, "l", "v", "x", ["i"], most=3)


def test_scopes_and_structs(spark):
    p = [({"contents": "Write", "issues": "odd", "packages": "read-all"},), ({"write-all": "x"},), (None,)]
    got = [r[0] for r in values(spark, p, "p map<string,string>", X.scope_levels(F.col("p")))]
    assert (got[0]["contents"], got[0]["issues"], got[0]["packages"], got[0]["actions"], got[0]["write-all"]) == ("write", "default", "read", "default", "none")
    assert got[1]["write-all"] == "write" and set(got[2].values()) == {"default", "none"}
    d = values(spark, [("o/r/sub@${{ x }}",)], "u string", X.dependency(F.col("u")))[0][0]
    assert tuple(d) == ("o/r/sub@${{ x }}", "o", "r", "sub", "${{ x }}", "unknown", True)
