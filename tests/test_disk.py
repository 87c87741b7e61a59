"""What queries leave on disk while a session runs."""

from pathlib import Path

from refweave import session
from refweave.operators import graph
from refweave.plans import domain, graph_metrics, temporal_metrics
from tests.test_graph import edges

KINDS = "edge_id string, src_node_id string, dst_node_id string, src_kind string, dst_kind string, edge_type string, consumer_repository string, workflow_path string, job_name string, depth int, discovered_at timestamp, ingest_seq long"


def left(spark) -> set[str]:
    return {p.name for p in Path(session.own_dir(spark).removeprefix("file:")).glob("*") if not p.name.startswith(".")}


def test_links_are_gone_once_swept(spark):
    e, before = edges(spark), left(spark)
    worth = spark.createDataFrame([("o/r1", 5)], "repository string, worth long")
    counts = graph.downstream_counts(e, worth)
    assert len(left(spark) - before) == 1  # the numbered nodes
    unions = graph.downstream_unions(e, spark.createDataFrame([("g", "B"), ("g", "C")], "group string, action_id string"))
    assert len(left(spark) - before) == 2
    reach = graph.reach_counts(e)
    assert len(left(spark) - before) == 3
    assert {(r["action_id"], r["repositories"], r["worth"]) for r in counts.collect()} == {("A", 1, 5), ("B", 2, 5), ("C", 1, 5), ("D", 2, 5)}
    assert [tuple(r) for r in unions.collect()] == [("g", 2)] and {r["node_id"]: r["reached"] for r in reach.collect()}["A"] == 3


def test_links_sent_to_the_workers_are_gone_once_swept(spark):
    """The driver keeps no file of the links that a sweep sent, and the counts can still be read."""
    e, there = edges(spark), lambda: {p.name for p in Path(spark.sparkContext._temp_dir).glob("*")}
    worth, before = spark.createDataFrame([("o/r1", 5)], "repository string, worth long"), there()
    counts, reach = graph.downstream_counts(e, worth), graph.reach_counts(e)
    assert there() <= before
    assert {r["action_id"]: r["repositories"] for r in counts.collect()} == {"A": 1, "B": 2, "C": 1, "D": 2} and {r["node_id"]: r["reached"] for r in reach.collect()}["A"] == 3


def test_intermediates_are_small(spark):
    before, old = left(spark), spark.conf.get(session._CLEANUP, None)
    session.materialize(spark.range(100).selectExpr("id % 7 as k").groupBy("k").count())
    files = [p for d in left(spark) - before for p in Path(session.own_dir(spark).removeprefix("file:"), d).glob("*.parquet")]
    assert files and all(".zstd." in p.name for p in files)
    assert spark.conf.get(session._CLEANUP, None) == old


def tables(spark, path, links):
    rows = [(str(i), a, b, ka, kb, "direct", "o/r", "w.yml", "job", 1, None, i) for i, (a, b, ka, kb) in enumerate(links)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{path}/edges.parquet")
    spark.createDataFrame([("1", "o/r", 60, False, None, 1)], "repo_id string, full_name string, stars long, archived boolean, collected_at timestamp, ingest_seq long").write.parquet(f"{path}/repositories.parquet")


def test_kept_edges_have_what_is_used(spark, tmp_path):
    tables(spark, tmp_path, [("workflow::o/r::w.yml", "A", "workflow", "action")])
    d = str(tmp_path)
    domain.keep_edges(spark, d)
    kept = domain.once(spark, d, "edges", None).columns
    assert not {"edge_id", "job_name", "discovered_at", "ingest_seq"} & set(kept)
    assert domain.edges(spark, d).select("edge_id", "job_name").collect() == [("0", "job")] and domain.edges(spark, d, "job_name").count() == 1


def test_degrees_of_nodes(spark, tmp_path):
    w = "workflow::o/r::w.yml"
    links = [(w, "A", "workflow", "action"), (w, "A", "workflow", "action"), ("A", "B", "action", "action"), ("A", "A", "action", "action"), ("A", "C", "action", "tool"), ("A", w, "action", "workflow"), ("B", None, "action", "action")]
    tables(spark, tmp_path, links)
    got = {(r["node_id"], r["node_kind"]): (r["in_degree"], r["out_degree"]) for r in graph_metrics.amplification_by_node(spark, str(tmp_path)).collect()}
    assert got == {(w, "workflow"): (1, 1), ("A", "action"): (2, 4), ("B", "action"): (1, 1), (None, "action"): (0, 0)}


def test_moves_stay_within_one_reference(spark, tmp_path):
    """Names that are missing in different places are different references."""
    rows = [("a", None, "tag", "1" * 40, 1, 1), ("a", "tag", None, "2" * 40, 2, 2), ("b", "v1", "tag", "3" * 40, 1, 3), ("b", "v1", "tag", "4" * 40, 2, 4)]
    t = spark.createDataFrame(rows, "action_id string, ref_name string, ref_type string, sha string, at long, ingest_seq long")
    t.selectExpr("*", "timestamp_seconds(at) as observed_at").drop("at").write.parquet(f"{tmp_path}/ref_observations.parquet")
    got = temporal_metrics.drift(spark, str(tmp_path)).collect()
    assert [(r["action_id"], r["ref_name"], r["previous_sha"], r["new_sha"]) for r in got] == [("b", "v1", "3" * 40, "4" * 40)]
