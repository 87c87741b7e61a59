"""Dependency graph operators: recursive build, closures and reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.functions.exprs import stable_id_parts, workflow_id
from refweave.functions.stats import ranked
from refweave.operators import branches, sweep
from refweave.session import discard, materialize


def scoped_edges(edges: DataFrame) -> DataFrame:
    """Edges that name a workflow and its repository, with workflow_id; every metric starts here."""
    known = (F.col("consumer_repository") != "") & (F.col("workflow_path") != "")
    return edges.where(known).withColumn("workflow_id", workflow_id(F.col("consumer_repository"), F.col("workflow_path")))


def _spread(start: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(label, node, hops): every node reached from ``start`` along ``links`` with its fewest links.

    One round per link away: only pairs that are new are carried on, joined with the links and held against
    what is known. Ends when a round finds nothing new.
    """
    frontier = materialize(start.select(label, "node").distinct().withColumn("hops", F.lit(0)))
    known, hops = frontier, 0
    while True:
        hops += 1
        step = frontier.join(links, frontier["node"] == links["src"]).select(label, F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(known.select(label, "node"), [label, "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def action_links(edges: DataFrame) -> DataFrame:
    """Distinct action-to-action links, whichever workflow they were found in."""
    return edges.where("src_kind = 'action' and dst_kind = 'action'").select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst")).distinct()


def downstream_repositories(edges: DataFrame) -> DataFrame:
    """(action_id, repository): which repositories' workflows reach an action, directly or through actions.

    The pairs are as many as the answer has. Where repositories x actions is too much to list, use
    downstream_estimate.
    """
    links = materialize(_downstream_links(edges))
    nodes = links.select(F.explode(F.array("send", "take")).alias("node")).distinct()
    got = sweep.pairs(nodes.select("node", F.col("node").startswith("r|").alias("origin"), F.lit(None).cast("long").alias("worth"), F.lit(True).alias("asked")), links, 2)
    discard(links)
    if got is None:
        return _downstream_by_rounds(edges)
    return got.select(F.col("node").alias("action_id"), F.col("origin").alias("repository"))


def _downstream_by_rounds(edges: DataFrame) -> DataFrame:
    """As downstream_repositories, over any number of links."""
    direct = edges.where("src_kind = 'workflow' and dst_kind = 'action'")
    start = direct.select(F.split(F.col("src_node_id"), "::").getItem(1).alias("repository"), F.col("dst_node_id").alias("node"))
    return _spread(start, action_links(edges), "repository").select(F.col("node").alias("action_id"), "repository")


def numbered(values: DataFrame, what: str) -> DataFrame:
    """(what, rank): the distinct values numbered from 1 in their order."""
    return ranked(values.select(what).distinct().withColumn("_one", F.lit(1)), "_one", [], by=[what]).select(what, "rank")


def _bitmaps(pairs: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """(by, _bucket, _bits) of pairs (by, rank): 32,768 numbers a bitmap."""
    return pairs.groupBy(by, F.bitmap_bucket_number(rank).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(rank)).alias("_bits"))


def _flow(start: DataFrame, links: DataFrame) -> Iterator[DataFrame]:
    """Sets flow along links (send, take) until none grows: the bitmaps (node, _bucket, _bits, _n, _was) after each round.

    A round hands on only what grew in the round before. A set of thousands of values is a few kilobytes of a row, so the
    work is links x rounds x bitmaps and not the pairs of the closure.
    """
    now = materialize(start.select("node", "_bucket", "_bits", F.bitmap_count("_bits").alias("_n"), F.lit(0).cast("long").alias("_was")))
    yield now
    links = materialize(links.select("send", "take").distinct())
    while True:
        grown = now.where("_n > _was")
        if grown.isEmpty():
            return
        moved = grown.join(links, grown["node"] == links["send"]).select(F.col("take").alias("node"), "_bucket", "_bits", F.lit(0).cast("long").alias("_n"))
        both = now.select("node", "_bucket", "_bits", "_n").unionByName(moved).groupBy("node", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), F.max("_n").alias("_was"))
        now = materialize(both.select("node", "_bucket", "_bits", F.bitmap_count("_bits").alias("_n"), "_was"))
        yield now


def downstream_sets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which repositories' workflows reach an action, as bitmaps (action_id, _bucket, _bits), and the numbers of the
    repositories (repository, rank)."""
    direct = edges.where("src_kind = 'workflow' and dst_kind = 'action'").select(F.split("src_node_id", "::").getItem(1).alias("repository"), F.col("dst_node_id").alias("node")).distinct()
    numbers = materialize(numbered(direct, "repository"))
    for last in _flow(_bitmaps(direct.join(numbers, "repository"), "node"), action_links(edges).select(F.col("src").alias("send"), F.col("dst").alias("take"))):
        pass
    return last.select(F.col("node").alias("action_id"), "_bucket", "_bits"), numbers


def members(sets: DataFrame, numbers: DataFrame, what: str) -> DataFrame:
    """(_bucket, _key, what): the values of each different bitmap; equal bitmaps, as of actions on one loop, are opened once."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, key, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (bucket - 1) * 32768 + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bucket)), pa.array([key] * len(at), pa.string()), pa.array(at)], names=["_bucket", "_key", "rank"])

    different = sets.select("_bucket", F.md5("_bits").alias("_key"), "_bits").dropDuplicates(["_bucket", "_key"])
    return different.mapInArrow(opened, "_bucket long, _key string, rank long").join(numbers, "rank").select("_bucket", "_key", what)


def set_sizes(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): how many values a set holds, or the sets of one group together."""
    return sets.groupBy(*by, "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_n")).groupBy(*by).agg(F.sum("_n").cast("long").alias("n"))


def union_counts(members_: DataFrame, sets: DataFrame, group: list[str], by: str = "action_id") -> DataFrame:
    """(group, n): how many different values the sets (by, _bucket, _bits) of a group's members hold together.

    A member of many groups is joined as a few rows of bits and not once per value. Groups whose members hold nothing
    are not there.
    """
    return set_sizes(members_.select(*group, by).distinct().join(sets, by).select(*group, "_bucket", "_bits"), group)


def _sweep(links: DataFrame, worth: DataFrame | None, origins: str, asked: str) -> DataFrame | None:
    """sweep.totals of links (send, take) between nodes whose names start with their kind: origins of one kind, counts for another.
    worth: (node, worth). The links are written for this only."""
    links = materialize(links)
    nodes = links.select(F.explode(F.array("send", "take")).alias("node")).distinct()
    nodes = nodes.join(worth, "node", "left") if worth is not None else nodes.withColumn("worth", F.lit(None).cast("long"))
    got = sweep.totals(nodes.select("node", "worth", F.col("node").startswith(origins).alias("origin"), F.col("node").startswith(asked).alias("asked")), links)
    discard(links)
    return got


def _downstream_links(edges: DataFrame) -> DataFrame:
    """Links (send, take) from repositories (r|name) to the actions (a|id) of their workflows and on to what these use."""
    repository = F.when(F.col("src_kind") == "workflow", F.concat(F.lit("r|"), F.split("src_node_id", "::").getItem(1))).otherwise(F.concat(F.lit("a|"), "src_node_id"))
    on = edges.where("src_kind in ('workflow', 'action') and dst_kind = 'action'").select(repository.alias("send"), F.concat(F.lit("a|"), "dst_node_id").alias("take"))
    return on.where("send is not null and take is not null").distinct()


def downstream_counts(edges: DataFrame, worth: DataFrame) -> DataFrame | None:
    """(action_id, repositories, marked, worth): how many repositories' workflows reach an action, how many of these have a
    ``worth`` (repository, worth), and its sum. None if there are more than sweep.MAX_LINKS links."""
    got = _sweep(_downstream_links(edges), worth.select(F.concat(F.lit("r|"), "repository").alias("node"), "worth"), "r|", "a|")
    return got and got.select(F.substr("node", F.lit(3)).alias("action_id"), F.col("n").alias("repositories"), "marked", "worth")


def downstream_unions(edges: DataFrame, members_: DataFrame) -> DataFrame | None:
    """(group, n): how many different repositories reach the actions of a group together; members_: (group, action_id).

    Groups that nothing reaches are not there. None if there are more than sweep.MAX_LINKS links.
    """
    into = members_.select(F.concat(F.lit("a|"), "action_id").alias("send"), F.concat(F.lit("g|"), "group").alias("take")).distinct()
    got = _sweep(_downstream_links(edges).unionByName(into), None, "r|", "g|")
    return got and got.select(F.substr("node", F.lit(3)).alias("group"), "n")


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node_id, reached, max_hops, sum_hops) of every node with a link out: how much it depends on, itself left out, and how far away."""
    links = materialize(edges.where("src_node_id is not null and dst_node_id is not null").select(F.col("src_node_id").alias("take"), F.col("dst_node_id").alias("send")).distinct())
    ends = F.explode(F.array(F.struct(F.col("take").alias("node"), F.lit(True).alias("asked")), F.struct(F.col("send").alias("node"), F.lit(False).alias("asked"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.bool_or("e.asked").alias("asked"), F.bool_or(~F.col("e.asked")).alias("origin")).withColumn("worth", F.lit(None).cast("long"))
    got = sweep.counts(nodes, links)
    if got is None:
        return _reach_by_bitmaps(links.select(F.col("take").alias("src"), F.col("send").alias("dst")))
    discard(links)
    return got.select(F.col("node").alias("node_id"), F.col("n").alias("reached"), "max_hops", "sum_hops")


def _reach_by_bitmaps(links: DataFrame) -> DataFrame:
    """As reach_counts, over any number of links (src, dst).

    After round k a node's set is what lies within k links, so that what a set gains in round k is k links away.
    """
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    own = _bitmaps(nodes.join(numbered(nodes, "node"), "node"), "node")
    gains = None
    for k, now in enumerate(_flow(own, links.select(F.col("dst").alias("send"), F.col("src").alias("take")))):
        if k:
            gain = now.where("_n > _was").groupBy("node").agg(F.sum(F.col("_n") - F.col("_was")).alias("gain")).withColumn("hops", F.lit(k))
            gains = gain if gains is None else gains.unionByName(gain)
    if gains is None:
        gains = own.select("node", F.lit(0).cast("long").alias("gain"), F.lit(0).alias("hops")).limit(0)
    return gains.groupBy(F.col("node").alias("node_id")).agg(F.sum("gain").alias("reached"), F.max("hops").cast("long").alias("max_hops"), F.sum(F.col("gain") * F.col("hops")).alias("sum_hops"))


def reached_workflows(edges: DataFrame) -> DataFrame:
    """(node_id, reached): workflows that a node leads to, itself left out. Only links that end in a workflow start such a way."""
    links = edges.select(F.col("src_node_id").alias("dst"), F.col("dst_node_id").alias("src"), F.col("dst_kind").alias("kind")).distinct()
    ends = links.where("kind = 'workflow'").select(F.col("src").alias("reached"), F.col("src").alias("node"))
    return _spread(ends, links.select("src", "dst"), "reached").where("node <> reached").select(F.col("node").alias("node_id"), "reached")


def forward_reach(edges: DataFrame) -> DataFrame:
    """(node_id, reached, hops) for every action and workflow: what it depends on, itself left out."""
    links = edges.select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst")).distinct()
    start = links.select(F.col("src").alias("node_id"), F.col("src").alias("node")).distinct()
    return _spread(start, links, "node_id").where("hops > 0 and node <> node_id").select("node_id", F.col("node").alias("reached"), "hops")


def downstream_estimate(edges: DataFrame, log2_size: int = 12) -> DataFrame:
    """(action_id, repositories): HyperLogLog estimates of downstream repositories in work proportional to the links.

    Each round merges the sketches of an action's parents into its own, until no estimate grows.
    """
    direct = edges.where("src_kind = 'workflow' and dst_kind = 'action'")
    start = direct.select(F.split(F.col("src_node_id"), "::").getItem(1).alias("r"), F.col("dst_node_id").alias("node"))
    links = materialize(action_links(edges))
    now = materialize(start.groupBy("node").agg(F.hll_sketch_agg("r", F.lit(log2_size)).alias("sketch")))
    size = None
    for _ in range(links.select("src").distinct().count() + 1):  # no shortest path has more links than nodes with one
        moved = now.join(links, now["node"] == links["src"]).select(F.col("dst").alias("node"), "sketch")
        now = materialize(now.unionByName(moved).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch")))
        total = now.agg(F.count("*"), F.sum(F.hll_sketch_estimate("sketch"))).first()
        if total == size:
            break
        size = total
    return now.select(F.col("node").alias("action_id"), F.hll_sketch_estimate("sketch").alias("repositories"))


def expand_counts(direct: DataFrame, nested: DataFrame, max_depth: int = 6) -> DataFrame:
    """(consumer_repository, depth, edges, downgrades): the edges of expand(), counted without listing its branches.

    Branches are listed where it is to go deeper than branches.MAX_DEPTH, or there are more links, or more of them one behind the other, than a task can hold.
    """
    kinds, spark = ["action_id", "key", "ref_type"], direct.sparkSession
    direct = materialize(direct.select("repository", "path", *kinds).distinct())
    nested = materialize(nested.select("parent", *kinds).distinct())
    nodes = materialize(direct.select(*kinds).unionByName(nested.select(*kinds)).distinct().where("key is not null").withColumn("id", F.monotonically_increasing_id()))
    per = lambda c: F.min("id").over(W.partitionBy(c))
    marked = nodes.withColumn("colour", per("key")).withColumn("action", per("action_id"))
    a, b = (marked.select(*[F.col(c).alias(f"{x}_{c}") for c in marked.columns]) for x in "st")
    same = F.col("action_id").eqNullSafe(F.col("t_action_id")) & (F.col("key") == F.col("t_key")) & F.col("ref_type").eqNullSafe(F.col("t_ref_type"))
    down = F.coalesce((F.col("s_ref_type") == "sha") & (F.col("t_ref_type") == "tag"), F.lit(False))
    links = nested.join(b, same).join(a, F.col("parent") == F.col("s_action_id")).select(*[f"{x}_{c}" for x in "st" for c in ("id", "colour", "action")], down.alias("down"))
    links = materialize(links.where("s_colour <> t_colour"))  # no branch takes others, and who has no more is no sender
    g = branches.collected(links, max_depth) if max_depth <= branches.MAX_DEPTH and links.count() <= sweep.MAX_LINKS else None
    if g is None:
        return expand(direct, nested, max_depth).groupBy("consumer_repository", "depth").agg(F.count("*").alias("edges"), F.count_if("binding_downgrade").alias("downgrades"))
    senders = nodes.join(links.select(F.col("s_id").alias("id")).distinct(), "id").select("id", *[F.col(c).alias(f"t_{c}") for c in kinds])
    sets = materialize(direct.join(senders, same).groupBy("repository", "path").agg(F.array_sort(F.collect_set("id")).alias("nodes")))  # the direct actions of one workflow
    sent = spark.sparkContext.broadcast(branches.packed(g))
    del g
    tasks = 2 * spark.sparkContext.defaultParallelism
    found = materialize(sets.select("nodes").distinct().repartition(tasks).mapInArrow(lambda data: branches.batches(sent.value, data), "nodes array<long>, depth int, edges long, downgrades long"))
    sent.destroy()
    first = direct.select("repository", "path", "action_id").distinct().select("repository", F.lit(1).alias("depth"), F.lit(1).cast("long").alias("edges"), F.lit(0).cast("long").alias("downgrades"))
    rows = first.unionByName(sets.join(found, "nodes").select("repository", "depth", "edges", "downgrades"))
    out = materialize(rows.groupBy(F.col("repository").alias("consumer_repository"), "depth").agg(F.sum("edges").alias("edges"), F.sum("downgrades").alias("downgrades")))
    for x in (direct, nested, nodes, links, sets, found):
        discard(x)
    return out


def expand(direct: DataFrame, nested: DataFrame, max_depth: int = 6) -> DataFrame:
    """The recursive build: edges of every workflow down to ``max_depth``, following what actions use.

    direct: repository, path, action_id, key, ref_type. nested: parent (action_id), action_id, key, ref_type.
    A branch never enters a key it has passed; an edge reached again at the same depth is one edge. Result:
    edge_id, src_node_id, dst_node_id, edge_type, consumer_repository, workflow_path, depth, binding_downgrade
    (a sha-bound parent that uses a tag). One round per level; only branches, not graphs, are carried on. What
    lies below an action does not depend on the workflow, so branches are followed once per direct action, in
    any order of what they have passed, and joined to the workflows at the end.
    """
    direct = materialize(direct.select("repository", "path", "action_id", "key", "ref_type").distinct())
    level = direct.select(
        "repository", "path", workflow_id(F.col("repository"), F.col("path")).alias("src"), F.col("action_id").alias("dst"), F.lit("direct").alias("edge_type"),
        F.lit(1).alias("depth"), F.lit(False).alias("down"),
    )
    n = nested.select(F.col("parent").alias("_p"), F.col("action_id").alias("_a"), F.col("key").alias("_k"), F.col("ref_type").alias("_t")).distinct()
    start = ["action_id", "key", "ref_type"]
    front = direct.select(*start, F.col("action_id").alias("dst"), F.array("key").alias("seen"), F.col("ref_type").alias("bound")).distinct()
    levels = [level]
    for depth in range(2, max_depth + 1):
        step = front.join(n, F.col("dst") == F.col("_p")).where(~F.array_contains("seen", F.col("_k"))).select(
            *start, F.col("dst").alias("src"), F.col("_a").alias("dst"), F.lit(depth).alias("depth"), ((F.col("bound") == "sha") & (F.col("_t") == "tag")).alias("down"),
            F.array_sort(F.array_append("seen", F.col("_k"))).alias("seen"), F.col("_t").alias("bound"),
        )
        step = materialize((step if depth < max_depth else step.drop("seen", "bound")).distinct())
        if step.isEmpty():
            break
        found = step.select(*start, "src", "dst", "depth", "down").distinct()
        same = (direct["action_id"] == found["action_id"]) & (direct["key"] == found["key"]) & direct["ref_type"].eqNullSafe(found["ref_type"])
        levels.append(direct.join(found, same).select("repository", "path", "src", "dst", F.lit("transitive").alias("edge_type"), "depth", "down"))
        if depth < max_depth:
            front = step.select(*start, "dst", "seen", "bound").distinct()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    ident = stable_id_parts("src", "dst", "edge_type", "path", "repository", "depth")
    return out.withColumn("edge_id", ident).groupBy("edge_id").agg(
        F.first("src").alias("src_node_id"), F.first("dst").alias("dst_node_id"), F.first("edge_type").alias("edge_type"), F.first("repository").alias("consumer_repository"),
        F.first("path").alias("workflow_path"), F.first("depth").alias("depth"), F.bool_or("down").alias("binding_downgrade"),
    )
