"""Graph operators on small hand-made graphs."""

import random
from itertools import pairwise

from refweave.operators import graph
from refweave.plans import graph_metrics

E = "src_node_id string, dst_node_id string, src_kind string, dst_kind string, consumer_repository string, workflow_path string"


def edges(spark):
    w1, w2 = "workflow::o/r1::a.yml", "workflow::o/r2::b.yml"
    rows = [
        (w1, "A", "workflow", "action", "o/r1", "a.yml"), ("A", "B", "action", "action", "o/r1", "a.yml"), ("A", "C", "action", "action", "o/r1", "a.yml"), ("B", "D", "action", "action", "o/r1", "a.yml"),
        ("D", "B", "action", "action", "o/r1", "a.yml"), (w2, "B", "workflow", "action", "o/r2", "b.yml"), (w2, "B", "workflow", "action", None, "b.yml"), (w2, "B", "workflow", "action", "", "b.yml"),
    ]
    return spark.createDataFrame(rows, E)


def test_closure_and_reach(spark):
    e = edges(spark)
    got = {}
    for r in graph.downstream_repositories(e).collect():
        got.setdefault(r["action_id"], set()).add(r["repository"])
    assert got == {"A": {"o/r1"}, "B": {"o/r1", "o/r2"}, "C": {"o/r1"}, "D": {"o/r1", "o/r2"}}
    reach = {(r["node_id"], r["reached"]): r["hops"] for r in graph.forward_reach(e).collect()}
    assert reach["A", "D"] == 2 and reach["D", "B"] == 1 and ("B", "B") not in reach and len([k for k in reach if k[0] == "A"]) == 3
    assert graph.scoped_edges(e).count() == 6
    est = {r["action_id"]: r["repositories"] for r in graph.downstream_estimate(e).collect()}
    assert est == {"A": 1, "B": 2, "C": 1, "D": 2}
    assert graph.forward_reach(e.limit(0)).count() == 0


def test_expand(spark):
    direct = spark.createDataFrame([("o/r", "a.yml", "A", "o/a@1", "sha"), ("o/r", "a.yml", "B", "o/b@1", "tag")], "repository string, path string, action_id string, key string, ref_type string")
    nested = spark.createDataFrame([("A", "B", "o/b@1", "tag"), ("B", "C", "o/c@1", "tag"), ("C", "A", "o/a@1", "sha"), ("C", "D", "o/d@1", "sha")], "parent string, action_id string, key string, ref_type string")
    got = {(r["src_node_id"].split("::")[0], r["dst_node_id"], r["depth"]): r["binding_downgrade"] for r in graph.expand(direct, nested, 4).collect()}
    # through A: A, B, C, D; directly to B: B, C, then A and D, and A goes on to nothing it has passed
    assert got == {
        ("workflow", "A", 1): False, ("workflow", "B", 1): False, ("A", "B", 2): True, ("B", "C", 2): False, ("B", "C", 3): False, ("C", "A", 3): False,
        ("C", "D", 3): False, ("C", "D", 4): False,
    }
    assert ("C", "A", 4) not in got  # the branch through A does not come back to it


def test_cdg_recursive_goes_to_depth_six(spark, tmp_path):
    names, w = "ABCDEFGH", "workflow::o/r::a.yml"
    links = [(w, "A", "workflow", "direct"), *[(a, b, "action", "transitive") for a, b in pairwise(names)]]
    e = [(str(i), *x[:3], "action", x[3], "o/r", "a.yml", None, i) for i, x in enumerate(links)]
    a = [(x, "o", x, None, "1", "tag", None, i) for i, x in enumerate(names)]
    kinds = "edge_id string, src_node_id string, dst_node_id string, src_kind string, dst_kind string, edge_type string, consumer_repository string, workflow_path string, discovered_at timestamp, ingest_seq long"
    spark.createDataFrame(e, kinds).write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame(a, "action_id string, owner string, repo string, subpath string, ref string, ref_type string, discovered_at timestamp, ingest_seq long").write.parquet(f"{tmp_path}/actions.parquet")
    assert sorted((r["depth"], r["edges"]) for r in graph_metrics.cdg_recursive(spark, str(tmp_path)).collect()) == [(d, 1) for d in range(1, 7)]


def test_expand_equals_single_branches(spark):
    rng = random.Random(6)
    kind = {x: rng.choice(["sha", "tag"]) for x in "ABCDEFG"}
    direct = sorted({(f"o/r{rng.randrange(3)}", rng.choice(["a.yml", "b.yml"]), rng.choice("ABC")) for _ in range(7)})
    links = sorted({(rng.choice("ABCDEFG"), rng.choice("ABCDEFG")) for _ in range(26)})
    want = {}

    def follow(repo, path, seen):
        for _, b in (x for x in links if x[0] == seen[-1] and x[1] not in seen):
            if len(seen) < 6:
                want[repo, path, seen[-1], b, len(seen) + 1] = kind[seen[-1]] == "sha" and kind[b] == "tag"
                follow(repo, path, [*seen, b])

    for repo, path, a in direct:
        want[repo, path, f"workflow::{repo}::{path}", a, 1] = False
        follow(repo, path, [a])
    d = spark.createDataFrame([(*x, x[2], kind[x[2]]) for x in direct], "repository string, path string, action_id string, key string, ref_type string")
    n = spark.createDataFrame([(a, b, b, kind[b]) for a, b in links], "parent string, action_id string, key string, ref_type string")
    rows = graph.expand(d, n).collect()
    got = {(r["consumer_repository"], r["workflow_path"], r["src_node_id"], r["dst_node_id"], r["depth"]): r["binding_downgrade"] for r in rows}
    assert max(k[4] for k in want) == 6 and got == want and len(rows) == len(want)


def test_estimate_follows_deep_chains(spark):
    w, names = "workflow::o/r1::a.yml", [f"n{i}" for i in range(54)]
    rows = [(w, "n0", "workflow", "action", "o/r1", "a.yml"), *[(a, b, "action", "action", "o/r1", "a.yml") for a, b in pairwise(names)]]
    est = {r["action_id"]: r["repositories"] for r in graph.downstream_estimate(spark.createDataFrame(rows, E).coalesce(1)).collect()}
    assert est == dict.fromkeys(names, 1)


def test_union_counts_equal_sets(spark):
    """Bitmaps over numbered values against plain sets, with members of many groups and values beyond one bitmap."""
    rng = random.Random(8)
    pairs = [(f"a{rng.randrange(30)}", f"r{rng.randrange(400)}") for _ in range(2000)] + [("big", f"x{i}") for i in range(40_000)]
    members = [(f"g{rng.randrange(12)}", f"a{rng.randrange(35)}") for _ in range(80)] + [("g0", "big"), ("g1", "big"), ("empty", "nothing")]
    p, m = spark.createDataFrame(pairs + pairs[:50], "action_id string, repository string"), spark.createDataFrame(members + members[:5], "g string, action_id string")
    held = {}
    for a, r in pairs:
        held.setdefault(a, set()).add(r)
    want = {}
    for g, a in members:
        want.setdefault(g, set()).update(held.get(a, ()))
    sets = graph._bitmaps(p.join(graph.numbered(p, "repository"), "repository"), "action_id")
    got = {r["g"]: r["n"] for r in graph.union_counts(m, sets, ["g"]).collect()}
    assert got == {g: len(x) for g, x in want.items() if x}


def test_sets_flow_as_pairs_do(spark):
    """Bitmaps against the listed closure, on random graphs with loops: members, sizes, hops."""
    rng = random.Random(3)
    rows = [(f"workflow::o/r{rng.randrange(12)}::w.yml", f"a{rng.randrange(25)}", "workflow", "action", "o/r", "w.yml") for _ in range(20)]
    rows += [(f"a{rng.randrange(25)}", f"a{rng.randrange(25)}", "action", "action", "o/r", "w.yml") for _ in range(30)] + [("a1", "a1", "action", "action", "o/r", "w.yml"), ("a2", "workflow::o/r3::w.yml", "action", "workflow", "o/r", "w.yml")]
    e = spark.createDataFrame(rows, E)
    want = {}
    for r in graph.downstream_repositories(e).collect():
        want.setdefault(r["action_id"], set()).add(r["repository"])
    sets, numbers = graph.downstream_sets(e)
    keyed = {(r["_bucket"], r["_key"]): set() for r in graph.members(sets, numbers, "repository").collect()}
    for r in graph.members(sets, numbers, "repository").collect():
        keyed[r["_bucket"], r["_key"]].add(r["repository"])
    import hashlib

    assert {r["action_id"]: keyed[r["_bucket"], hashlib.md5(r["_bits"]).hexdigest()] for r in sets.collect()} == want
    assert {r["action_id"]: r["n"] for r in graph.set_sizes(sets, ["action_id"]).collect()} == {a: len(x) for a, x in want.items()}
    far = {}
    for r in graph.forward_reach(e).collect():
        far.setdefault(r["node_id"], []).append(r["hops"])
    got = {r["node_id"]: (r["reached"], r["max_hops"], r["sum_hops"]) for r in graph.reach_counts(e).collect()}
    assert got == {v: (len(h), max(h), sum(h)) for v, h in far.items()}
    flows = {(r["node_id"], r["reached"]) for r in graph.reached_workflows(e).collect()}
    assert flows == {(r["node_id"], r["reached"]) for r in graph.forward_reach(e).collect() if r["reached"].startswith("workflow::")}
    assert graph.reach_counts(e.limit(0)).count() == 0 and graph.downstream_sets(e.limit(0))[0].count() == 0
