"""Parent-child links to full hierarchies by nested-set ranges.

Links are grouped into scopes (here: one workflow's dependency graph). Per scope: nearest roots by levels,
subtree sizes upward, sibling preorder ranges by prefix sums downward; a node's descendants are then a range.
Peeling leaves upward leaves the nodes that reach a loop unprocessed; loops are then one node each, and where links
lead out of a subtree, ranges are joined along the links, each link once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.stats import ranked
from refweave.session import materialize


def nested_sets(links: list[tuple[int, int]], n: int) -> dict[str, list]:
    """The hierarchy of nodes 0..n-1 (numbered in the order of their ids) under distinct links.

    root (-1: none), depth (-1: none), parent (-1), start and end (the preorder range, which holds the
    tree's descendants), reached (number of other nodes reached), loop (reaches itself).
    """
    down: list[list[int]] = [[] for _ in range(n)]
    up: list[list[int]] = [[] for _ in range(n)]
    for a, b in links:
        down[a].append(b)
        up[b].append(a)
    root, depth, parent = [-1] * n, [-1] * n, [-1] * n
    order: list[int] = []

    def spread(starts: list[int]) -> None:
        level = sorted(starts)
        for v in level:
            root[v] = v
            depth[v] = 0
        far = 0
        while level:
            order.extend(level)
            far += 1
            nxt: dict[int, tuple[int, int]] = {}
            for v in level:  # on equal depth the smallest root, then the smallest parent
                for c in down[v]:
                    if depth[c] < 0 and (c not in nxt or (root[v], v) < nxt[c]):
                        nxt[c] = (root[v], v)
            level = sorted(nxt)
            for c in level:
                root[c], parent[c] = nxt[c]
                depth[c] = far

    spread([v for v in range(n) if not up[v]])
    rooted = len(order)
    # Loops without a root get ranges too, from the nodes that no smaller such node reaches.
    starts, marked = [], [d >= 0 for d in depth]
    for v in range(n):
        if not marked[v]:
            starts.append(v)
            marked[v], todo = True, [v]
            for x in todo:
                for c in down[x]:
                    if not marked[c]:
                        marked[c] = True
                        todo.append(c)
    spread(starts)
    size = [1] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for v in reversed(order):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
            children[parent[v]].append(v)
    start, end, at = [0] * n, [0] * n, 0
    for v in order:
        if parent[v] < 0:
            start[v], at = at, at + size[v]
        end[v] = start[v] + size[v]
        place = start[v] + 1
        for c in sorted(children[v]):
            start[c] = place
            place += size[c]
    # Peel leaves: what stays reaches a loop.
    left = [len(x) for x in down]
    bare = [v for v in range(n) if not left[v]]
    for v in bare:
        for p in up[v]:
            left[p] -= 1
            if not left[p]:
                bare.append(p)
    # Lowest and highest preorder that links lead to from a subtree: where neither lies outside, the range is the answer.
    low, high = start[:], end[:]
    for v, c in links:
        low[v], high[v] = min(low[v], start[c]), max(high[v], end[c])
    for v in reversed(order):
        p = parent[v]
        if p >= 0:
            low[p], high[p] = min(low[p], low[v]), max(high[p], high[v])
    closed = [low[v] >= start[v] and high[v] <= end[v] for v in range(n)]
    parts = [[v] for v in bare] + _components(down, [v for v in range(n) if left[v]])
    part = [0] * n
    for i, members in enumerate(parts):
        for v in members:
            part[v] = i
    reached, loop = [0] * n, [False] * n
    for members, size_of in zip(parts, _reach(parts, part, down, parent, start, end, closed)):
        for v in members:
            reached[v] = size_of - 1
            loop[v] = bool(left[v]) and (len(members) > 1 or v in down[v])
    for v in order[rooted:]:
        root[v] = depth[v] = -1
    return {"root": root, "depth": depth, "parent": parent, "start": start, "end": end, "reached": reached, "loop": loop}


def _components(down: list[list[int]], nodes: list[int]) -> list[list[int]]:
    """The loops among the nodes that peeling left, and the single nodes between them, each after all it leads to."""
    inside = set(nodes)
    number: dict[int, int] = {}
    lowest: dict[int, int] = {}
    done: set[int] = set()
    stack: list[int] = []
    out: list[list[int]] = []
    for first in nodes:
        if first in number:
            continue
        walk = [(first, 0)]
        while walk:
            v, i = walk.pop()
            if i == 0:
                number[v] = lowest[v] = len(number)
                stack.append(v)
            nxt = down[v]
            while i < len(nxt):
                c = nxt[i]
                i += 1
                if c not in inside or c in done:
                    continue
                if c not in number:
                    walk += [(v, i), (c, 0)]
                    break
                lowest[v] = min(lowest[v], number[c])
            else:
                if lowest[v] == number[v]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        done.add(members[-1])
                        if members[-1] == v:
                            break
                    out.append(members)
                if walk:
                    above = walk[-1][0]
                    lowest[above] = min(lowest[above], lowest[v])
    return out


#: Preorder positions handled at once where ranges are joined; bounds the memory at this many bits per node.
BLOCK = 8192


def _reach(parts: list[list[int]], part: list[int], down: list[list[int]], parent: list[int], start: list[int], end: list[int], closed: list[bool]) -> list[int]:
    """How many nodes each part reaches, itself included. ``parts`` come after all they lead to.

    A part with a closed node reaches that node's range. Of the others the ranges of their nodes and what is
    reached along their links are joined, once per link and block of positions, as bits of whole numbers.
    """
    own: list[tuple[int, int] | None] = []
    for members in parts:
        own.append(next(((start[v], end[v]) for v in members if closed[v]), None))
    total = [0 if r is None else r[1] - r[0] for r in own]
    plan = []  # of each open part the ranges it reaches at once and the open parts it leads to
    for i, members in enumerate(parts):
        if own[i] is None:
            ranges, others = [(start[v], end[v]) for v in members], set()
            for v in members:
                for c in down[v]:
                    j = part[c]
                    if j == i:
                        continue
                    if own[j] is None:
                        others.add(j)
                    elif parent[c] != v or own[j] != (start[c], end[c]):
                        ranges.append(own[j])
            plan.append((i, ranges, others))
    if not plan:
        return total
    for at in range(0, len(part), BLOCK):
        bits: dict[int, int] = {}
        for i, ranges, others in plan:
            x = 0
            for a, b in ranges:
                a, b = max(a - at, 0), min(b - at, BLOCK)
                if a < b:
                    x |= ((1 << b - a) - 1) << a
            for j in others:
                x |= bits[j]
            bits[i] = x
            total[i] += x.bit_count()
    return total


SCHEMA = (
    "scope string, node_id string, root_node_id string, depth long, n_descendants long, on_cycle long,"
    " parent_id string, path array<string>, range_start long, range_end long"
)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (scope, src, dst) sorted by scope."""
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    types = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
    scope, links = None, []
    out: list[list] = [[] for _ in names]

    def close() -> None:
        ids = sorted({x for link in links for x in link})
        number = {x: i for i, x in enumerate(ids)}
        r = nested_sets([(number[a], number[b]) for a, b in links], len(ids))
        paths: dict[int, list[str]] = {}
        for v in sorted(range(len(ids)), key=lambda v: r["start"][v]):
            if r["depth"][v] >= 0:
                paths[v] = [*paths.get(r["parent"][v], []), ids[v]]
            p = r["parent"][v] if r["depth"][v] > 0 else -1
            row = (
                scope, ids[v], ids[r["root"][v]] if r["root"][v] >= 0 else "", r["depth"][v], r["reached"][v], int(r["loop"][v]),
                ids[p] if p >= 0 else None, paths.get(v, []), r["start"][v], r["end"][v],
            )
            for c, x in zip(out, row):
                c.append(x)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != scope:
                if links:
                    close()
                scope, links = s, []
            links.append((a, b))
        if len(out[0]) > 5000:
            yield flush()
    if links:
        close()
    if out[0]:
        yield flush()


#: Links of a scope, repeats included, up to which one task solves it. Larger ones are solved level by level in joins.
MAX_SCOPE = 200_000


def hierarchies(links: DataFrame, scope: list[str], src: str, dst: str, max_scope: int = MAX_SCOPE) -> DataFrame:
    """Every node's root, depth, path, number of descendants, loop flag and nested-set range, per scope.

    Result: the scope columns, node_id, root_node_id ('' if none), depth (-1 if none), n_descendants, on_cycle,
    parent_id, path (root first), range_start, range_end. A node reached from several roots belongs to the
    nearest, on equal depth to the smallest id. Links with a null scope column, src or dst are left out;
    repeated links count once; a link to itself is a loop. An empty table gives no rows. Scopes of up to
    ``max_scope`` links are solved in one task each, larger ones by joins over all of them together.
    """
    both = F.col(src).isNotNull() & F.col(dst).isNotNull()
    for s in scope:
        both &= F.col(s).isNotNull()
    packed = F.to_json(F.struct(*scope))
    rows = links.where(both).select(packed.alias("scope"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
    large = materialize(rows.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > max_scope).select("scope"))
    some = not large.isEmpty()
    small = rows.join(large, "scope", "left_anti") if some else rows
    solved = small.repartition("scope").distinct().sortWithinPartitions("scope", "src", "dst").mapInArrow(_solve, SCHEMA)
    if some:
        solved = solved.unionByName(solve_large(materialize(rows.join(large, "scope", "left_semi").distinct())))
    keys = F.from_json("scope", ", ".join(f"`{s}` {dict(links.dtypes)[s]}" for s in scope))
    return solved.withColumn("_s", keys).select(*[F.col(f"_s.`{s}`").alias(s) for s in scope], *[c for c in solved.columns if c != "scope"])


def _levels(starts: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Breadth first from (scope, node): scope, node, root, parent, depth, path; one join a level."""
    front = materialize(starts.select("scope", "node", F.col("node").alias("root"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path")))
    out, seen, depth = front, front.select("scope", "node"), 0
    if known is not None:
        seen = seen.unionByName(known.select("scope", "node"))
    while not front.isEmpty():
        depth += 1
        step = front.select("scope", F.col("node").alias("src"), "root", "path").join(links, ["scope", "src"])
        best = step.groupBy("scope", F.col("dst").alias("node")).agg(F.min(F.struct("root", "src", "path")).alias("b"))
        best = best.join(seen, ["scope", "node"], "left_anti")
        front = materialize(best.select("scope", "node", "b.root", F.col("b.src").alias("parent"), F.lit(depth).cast("long").alias("depth"), F.array_append("b.path", F.col("node")).alias("path")))
        out, seen = out.unionByName(front), seen.unionByName(front.select("scope", "node"))
    return materialize(out)


def solve_large(links: DataFrame) -> DataFrame:
    """The rows of SCHEMA for distinct links (scope, src, dst), in joins whose number grows with the depth.

    No scope and no family is gathered: sibling ranges come from one range-partitioned running sum. Pairs of
    nodes are listed only for nodes from whose subtree a link leads out of it.
    """
    src, dst = links.select("scope", F.col("src").alias("node")), links.select("scope", F.col("dst").alias("node"))
    nodes = materialize(src.union(dst).distinct())
    tree = _levels(nodes.join(dst.distinct(), ["scope", "node"], "left_anti"), links)
    rest = materialize(nodes.join(tree.select("scope", "node"), ["scope", "node"], "left_anti"))
    if not rest.isEmpty():  # loops without a root: start from every node that no smaller one reaches
        inside = materialize(links.join(rest.withColumnRenamed("node", "src"), ["scope", "src"], "left_semi"))
        label = materialize(rest.withColumn("label", F.col("node")))
        while True:
            sent = label.withColumnRenamed("node", "src").join(inside, ["scope", "src"]).select("scope", F.col("dst").alias("node"), "label")
            now = materialize(label.unionByName(sent).groupBy("scope", "node").agg(F.min("label").alias("label")).join(rest, ["scope", "node"], "left_semi"))
            moved = now.join(label.withColumnRenamed("label", "_was"), ["scope", "node"]).where("label <> _was").isEmpty()
            label = now
            if moved:
                break
        loose = _levels(label.where("label = node"), inside, tree)
        tree = materialize(tree.withColumn("real", F.lit(True)).unionByName(loose.withColumn("real", F.lit(False))))
    else:
        tree = materialize(tree.withColumn("real", F.lit(True)))
    deepest = tree.agg(F.max("depth")).first()[0]
    up = tree.select("scope", "node", "parent", "depth")

    def upward(start: DataFrame, values: list[str], merge) -> DataFrame:
        """Combines (scope, node, values) of children into their parents, deepest level first; each level touches its own nodes."""
        levels = materialize(start.join(up, ["scope", "node"]).select("scope", "node", "parent", *values, "depth"), ["depth"])
        done, below = [], None
        for level in range(deepest, -1, -1):
            now = levels.where(F.col("depth") == level).drop("depth")
            if below is not None:
                sent = below.where("parent is not null").select("scope", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), *values)
                now = now.unionByName(sent).groupBy("scope", "node").agg(F.max("parent").alias("parent"), *[merge(v).alias(v) for v in values])
            below = materialize(now)
            done.append(below.drop("parent"))
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return materialize(out)

    size = upward(nodes.withColumn("size", F.lit(1).cast("long")), ["size"], lambda v: F.sum(v))
    sized = tree.join(size, ["scope", "node"]).withColumn("family", F.coalesce("parent", F.lit("")))
    sized = sized.withColumn("loose", ~F.col("real"))  # real roots come before the starts of loops
    order = ranked(sized.select("scope", "family", "loose", "node", "size"), "size", [], by=["scope", "family", "loose", "node"])
    order = materialize(order.select("scope", "family", "node", (F.col("running") - F.col("size")).alias("before")))
    first = order.groupBy("scope", "family").agg(F.min("before").alias("base"))
    offset = materialize(sized.join(order, ["scope", "family", "node"]).join(first, ["scope", "family"]).select("scope", "node", "parent", "depth", "size", (F.col("before") - F.col("base")).alias("offset")))
    placed = materialize(offset.where("parent is null").select("scope", "node", F.col("offset").alias("start"), "size"))
    ranges = placed
    for level in range(1, deepest + 1):
        above = placed.select("scope", F.col("node").alias("parent"), F.col("start").alias("_s"))
        placed = materialize(offset.where(F.col("depth") == level).join(above, ["scope", "parent"]).select("scope", "node", (F.col("_s") + 1 + F.col("offset")).alias("start"), "size"))
        ranges = ranges.unionByName(placed)
    ranges = materialize(ranges.select("scope", "node", "start", (F.col("start") + F.col("size")).alias("end")))
    own = tree.select("scope", F.col("node").alias("dst"), F.col("parent").alias("_p"))
    extra = links.join(own, ["scope", "dst"]).where("_p is null or _p <> src").drop("_p")
    a, b = (ranges.select("scope", F.col("node").alias(n), F.col("start").alias(f"{n}_s"), F.col("end").alias(f"{n}_e")) for n in ("src", "dst"))
    extra = materialize(extra.join(a, ["scope", "src"]).join(b, ["scope", "dst"]))
    reach = ranges.select("scope", "node", F.col("start").alias("low"), F.col("end").alias("high"))
    led = extra.select("scope", F.col("src").alias("node"), F.col("dst_s").alias("low"), F.col("dst_e").alias("high"))
    span = upward(reach.unionByName(led).groupBy("scope", "node").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("high", -F.col("high")), ["low", "high"], lambda v: F.min(v))
    solved = ranges.join(span, ["scope", "node"]).withColumn("leaves", (F.col("low") < F.col("start")) | (-F.col("high") > F.col("end")))
    solved = materialize(solved)
    # A link from inside a node's range back to the node is a loop; where links lead out, list what is reached.
    back = extra.where("src_s >= dst_s and src_s < dst_e").select("scope", F.col("dst").alias("node")).distinct().withColumn("back", F.lit(True))
    front = materialize(solved.where("leaves").select("scope", F.col("node").alias("origin"), "node"))
    pairs = front.limit(0)
    while not front.isEmpty():
        step = front.join(links.withColumnRenamed("src", "node"), ["scope", "node"]).select("scope", "origin", F.col("dst").alias("node")).distinct()
        front = materialize(step.join(pairs, ["scope", "origin", "node"], "left_anti"))
        pairs = pairs.unionByName(front)
    listed = pairs.groupBy("scope", F.col("origin").alias("node")).agg(F.count_if(F.col("node") != F.col("origin")).alias("k"), F.bool_or(F.col("node") == F.col("origin")).alias("self"))
    out = tree.join(solved, ["scope", "node"]).join(back, ["scope", "node"], "left").join(listed, ["scope", "node"], "left")
    real = F.col("real")
    return out.select(
        "scope", F.col("node").alias("node_id"), F.when(real, F.col("root")).otherwise("").alias("root_node_id"), F.when(real, F.col("depth")).otherwise(-1).cast("long").alias("depth"),
        F.when(F.col("leaves"), F.coalesce("k", F.lit(0))).otherwise(F.col("end") - F.col("start") - 1).cast("long").alias("n_descendants"),
        F.when(F.col("leaves"), F.coalesce("self", F.lit(False))).otherwise(F.coalesce("back", F.lit(False))).cast("long").alias("on_cycle"),
        F.when(real, F.col("parent")).alias("parent_id"), F.when(real, F.col("path")).otherwise(F.array().cast("array<string>")).alias("path"), F.col("start").alias("range_start"), F.col("end").alias("range_end"),
    )
