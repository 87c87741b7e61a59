"""What reaches a node along links, counted or listed in blocks of origins: no set is written.

A task takes blocks of origins and holds, for one block at a time, a few words of bits per node and all links as
numbers. Links x origins / 64 words are passed on a round, as for the bitmaps of graph.downstream_sets, but what leaves
a task is one row of sums per node, or the pairs where these are the answer. Where no hops are counted, nodes on a
common loop are one, and every link passes its words once, in the order of the links (Dag).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.session import discard, materialize

#: Links that every task can hold as numbers; more than these flow as bitmaps through shuffles (graph.downstream_sets).
MAX_LINKS = 5_000_000
#: Nodes whose names every task can hold as well.
MAX_NAMES = 1_000_000
#: Bytes of one of a block's arrays (a task holds four), and words of a row at most.
BLOCK_BYTES, MAX_WORDS = 32 << 20, 64
#: The first links of every taker are passed on one by one for all takers, further ones taker by taker.
FIRST = 200
_SUMS = "id long, n long, max_hops long, sum_hops long, marked long, worth long"
_TOTALS = "id long, n long, marked long, worth long"


@dataclass
class Net:
    """Nodes 0 to n - 1, those that take from others first (``takers`` of them), in the order of how many takers they take from.

    send, take: all links. inner: links between takers only; slices: where the senders of the j-th link of each taker stand there, for the FIRST links.
    """

    n: int
    takers: int
    send: np.ndarray
    take: np.ndarray
    inner: np.ndarray
    slices: np.ndarray
    inner_take: np.ndarray
    origins: np.ndarray
    worth: np.ndarray  # per origin; -1: none
    ids: np.ndarray  # of the nodes, in their places
    names: pa.Array | None = None  # of the nodes, in their places

    @property
    def words(self) -> int:
        return max(1, min(MAX_WORDS, BLOCK_BYTES // (8 * max(1, self.n)), -(-len(self.origins) // 64)))

    @property
    def blocks(self) -> int:
        return -(-len(self.origins) // (64 * self.words))


def net(ids: np.ndarray, send: np.ndarray, take: np.ndarray, origins: np.ndarray, worth: np.ndarray) -> Net:
    """The Net of nodes with these ids; links, origins are given by where their nodes stand in ``ids``."""
    n = len(ids)
    both = np.unique(take.astype(np.int64) * n + send) if n else np.zeros(0, np.int64)
    take, send = both // max(n, 1), both % max(n, 1)
    taker = np.zeros(n, bool)
    taker[take] = True
    among = taker[send]
    degree = np.bincount(take[among], minlength=n)
    order = np.lexsort((-degree, ~taker))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    send, take = place[send], place[take]
    t, s = take[among], send[among]
    by = np.argsort(t, kind="stable")
    t, s = t[by], s[by]
    nth = np.arange(len(t)) - np.searchsorted(t, t)
    by = np.lexsort((t, nth))
    slices = np.searchsorted(nth[by], np.arange(min(nth.max() + 1, FIRST) + 1 if len(nth) else 1))
    return Net(n, int(taker.sum()), send, take, s[by], slices, t[by], place[origins], worth, ids[order])


def _some(rows: np.ndarray, send: np.ndarray, take: np.ndarray, moved: np.ndarray) -> None:
    """moved[taker] |= rows[sender] for the links from rows that hold something."""
    at = np.flatnonzero(rows.any(axis=1)[send])
    at = at[np.argsort(take[at], kind="stable")]
    _merge(rows, send[at], take[at], moved)


def _merge(rows: np.ndarray, send: np.ndarray, take: np.ndarray, moved: np.ndarray) -> None:
    """moved[taker] |= rows[sender] for links in the order of their takers."""
    step = max(1, BLOCK_BYTES // (8 * rows.shape[1]))
    for i in range(0, len(send), step):
        to = take[i : i + step]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        moved[to[first]] |= np.bitwise_or.reduceat(rows[send[i : i + step]], first, axis=0)


def rounds(g: Net, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(what each taker gained in this round, what it has without itself) as bits of the block's origins, until none gains.

    The arrays are used again for the next round.
    """
    mine = g.origins[block * 64 * g.words : (block + 1) * 64 * g.words]
    bit = np.arange(len(mine))
    start = np.zeros((g.n, g.words), np.uint64)
    start[mine, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    own = mine < g.takers
    own_bits = mine[own], bit[own] // 64, start[mine[own], bit[own] // 64]
    has, moved = np.zeros((g.takers, g.words), np.uint64), np.zeros((g.takers, g.words), np.uint64)
    _some(start, g.send, g.take, moved)
    del start
    fresh, spare = np.empty_like(has), np.empty_like(has)
    while True:
        moved[own_bits[:2]] &= ~own_bits[2]
        np.invert(has, out=spare)
        moved &= spare
        if not moved.any():
            return
        has |= moved
        yield moved, has
        fresh, moved = moved, fresh
        moved.fill(0)
        if np.count_nonzero(fresh.any(axis=1)) * 5 < g.takers:
            _some(fresh, g.inner, g.inner_take, moved)
        else:
            for i, j in zip(g.slices[:-1], g.slices[1:]):
                moved[: j - i] |= fresh[g.inner[i:j]]
            _some(fresh, g.inner[g.slices[-1] :], g.inner_take[g.slices[-1] :], moved)


def _count(g: Net, blocks: Iterator[int]) -> np.ndarray:
    """n, max_hops, sum_hops, marked and worth of every taker, over some blocks."""
    out = np.zeros((5, g.takers), np.int64)
    for block in blocks:
        last = None
        for k, (gained, last) in enumerate(rounds(g, block), 1):
            n = np.bitwise_count(gained).sum(axis=1, dtype=np.int64)
            out[0] += n
            out[1] = np.where(n > 0, np.maximum(out[1], k), out[1])
            out[2] += n * k
        worth = g.worth[block * 64 * g.words : (block + 1) * 64 * g.words]
        if last is None or not (worth >= 0).any():
            continue
        planes = [(3, 1, worth >= 0), *[(4, 1 << b, (worth >= 0) & (worth >> b & 1 > 0)) for b in range(int(worth.max()).bit_length())]]
        for to, factor, which in planes:
            bits = np.zeros(g.words * 64, np.uint8)
            bits[: len(which)] = which
            out[to] += factor * np.bitwise_count(last & np.packbits(bits, bitorder="little").view(np.uint64)).sum(axis=1, dtype=np.int64)
    return out


@dataclass
class Dag:
    """What sends and takes, with the nodes of a loop as one row; rows only take from rows before them.

    t, s: links between rows, by takers, and ``levels`` where the links into each level start. into_rows: (origin, row) by origins, own ones included.
    Nodes that only take are ends: end_t, end_s: their links from rows; into_ends: (origin, end) of nodes that only send, by blocks, then ends.
    """

    ids: np.ndarray  # of the nodes in rows, then of the ends
    row: np.ndarray  # of the nodes in rows
    rows: int
    t: np.ndarray
    s: np.ndarray
    levels: np.ndarray
    into_rows: tuple[np.ndarray, np.ndarray]
    ends: int
    end_t: np.ndarray
    end_s: np.ndarray
    into_ends: tuple[np.ndarray, np.ndarray]
    worth: np.ndarray  # per origin, the greatest first; -1: none
    own: tuple[np.ndarray, np.ndarray]  # (origin, where it stands among ids) of those in rows, by origins
    words: int

    @property
    def blocks(self) -> int:
        return -(-len(self.worth) // (64 * self.words))


def components(n: int, send: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The strongly connected component of each node (Tarjan); a component only takes from itself and from lower ones."""
    by = np.argsort(take, kind="stable")
    to, at = send[by].tolist(), np.searchsorted(take[by], np.arange(n + 1)).tolist()
    end, seen, low, out = at[1:], [-1] * n, [0] * n, [-1] * n
    held: list[int] = []
    found = done = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        way = [root]
        while way:
            v = way[-1]
            if seen[v] < 0:
                seen[v] = low[v] = found
                found += 1
                held.append(v)
            i = at[v]
            if i < end[v]:
                at[v] = i + 1
                w = to[i]
                if seen[w] < 0:
                    way.append(w)
                elif out[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == seen[v]:
                while out[v] < 0:
                    out[held.pop()] = done
                done += 1
    return np.array(out, np.int64)


def dag(ids: np.ndarray, send: np.ndarray, take: np.ndarray, origins: np.ndarray, worth: np.ndarray) -> Dag:
    """The Dag of what net() takes."""
    n = len(ids)
    both = np.unique((take.astype(np.int64) * n + send)[take != send])
    take, send = both // max(n, 1), both % max(n, 1)
    takes, sends = np.zeros(n, bool), np.zeros(n, bool)
    takes[take], sends[send] = True, True
    core, end = takes & sends, takes & ~sends
    place = np.where(core, np.cumsum(core), np.cumsum(end)) - 1
    inner = core[send] & core[take]
    number = components(int(core.sum()), place[send[inner]], place[take[inner]])
    rows = int(number.max()) + 1 if len(number) else 0
    links = np.unique(number[place[take[inner]]] * rows + number[place[send[inner]]])
    t, s = links // max(rows, 1), links % max(rows, 1)
    t, s = t[t != s], s[t != s]
    level = [0] * rows
    for a, b in zip(t.tolist(), s.tolist()):  # by takers, so that what is taken from has its level
        if level[b] >= level[a]:
            level[a] = level[b] + 1
    deep = np.array(level, np.int64)
    order = np.argsort(deep, kind="stable")
    new = np.empty(rows, np.int64)
    new[order] = np.arange(rows)
    row, t, s = new[number], new[t], new[s]
    by = np.argsort(t, kind="stable")
    t, s = t[by], s[by]
    levels = np.searchsorted(deep[order][t], np.arange(1, (int(deep.max()) if rows else 0) + 2))
    ranked = np.argsort(-worth, kind="stable")
    origins, worth = origins[ranked], worth[ranked]
    nth = np.full(n, -1)
    nth[origins] = np.arange(len(origins))
    alone = ~takes[send] & (nth[send] >= 0)
    start, to = alone & core[take], alone & end[take]
    mine = np.flatnonzero(core[origins])
    o, r = np.r_[nth[send[start]], mine], np.r_[row[place[take[start]]], row[place[origins[mine]]]]
    by = np.argsort(o, kind="stable")
    words = max(1, min(MAX_WORDS, BLOCK_BYTES // (8 * max(1, rows)), -(-len(origins) // 64)))
    eo, ee = nth[send[to]], place[take[to]]
    eby = np.lexsort((ee, eo // (64 * words)))
    last = core[send] & end[take]
    ends = np.unique(place[take[last]] * max(rows, 1) + row[place[send[last]]])
    return Dag(
        np.r_[ids[core], ids[end]], row, rows, t, s, levels, (o[by], r[by]), int(end.sum()), ends // max(rows, 1), ends % max(rows, 1), (eo[eby], ee[eby]), worth, (mine, place[origins[mine]]), words
    )


def _set(rows: np.ndarray, at: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(rows.reshape(-1), at * rows.shape[1] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))


def _total(g: Dag, blocks: Iterator[int]) -> np.ndarray:
    """n, marked and worth of every node of g.ids, over some blocks."""
    per_row, per_end, own = np.zeros((3, g.rows), np.int64), np.zeros((3, g.ends), np.int64), np.zeros((3, len(g.ids)), np.int64)
    step = max(1, BLOCK_BYTES // (8 * g.words))
    for block in blocks:
        lo, hi = block * 64 * g.words, (block + 1) * 64 * g.words
        worth = g.worth[lo:hi]
        planes = [(0, 1, np.full(g.words, ~np.uint64(0)))]
        for to, factor, which in [(1, 1, worth >= 0), *[(2, 1 << b, (worth >= 0) & (worth >> b & 1 > 0)) for b in range(max(0, int(worth.max())).bit_length())]]:
            bits = np.zeros(g.words * 64, np.uint8)
            bits[: len(which)] = which
            if which.any():
                planes.append((to, factor, np.packbits(bits, bitorder="little").view(np.uint64)))

        def add(out: np.ndarray, held: np.ndarray) -> None:
            for to, factor, mask in planes:
                out[to] += factor * np.bitwise_count(held & mask if to else held).sum(axis=1, dtype=np.int64)

        has = np.zeros((g.rows, g.words), np.uint64)
        i, j = np.searchsorted(g.into_rows[0], (lo, hi))
        _set(has, g.into_rows[1][i:j], g.into_rows[0][i:j] - lo)
        for i, j in zip(g.levels[:-1], g.levels[1:]):
            _merge(has, g.s[i:j], g.t[i:j], has)
        for i in range(0, g.rows, step):
            add(per_row[:, i : i + step], has[i : i + step])
        i, j = np.searchsorted(g.own[0], (lo, hi))
        o, at = g.own[0][i:j], g.own[1][i:j]
        own[0, at] += 1
        own[1, at] += g.worth[o] >= 0
        own[2, at] += np.maximum(g.worth[o], 0)
        i, j = np.searchsorted(g.into_ends[0] // (64 * g.words), (block, block + 1))
        eo, ee = g.into_ends[0][i:j] - lo, g.into_ends[1][i:j]
        for x in range(0, g.ends, step):
            held = np.zeros((min(step, g.ends - x), g.words), np.uint64)
            i, j = np.searchsorted(g.end_t, (x, x + step))
            _merge(has, g.end_s[i:j], g.end_t[i:j] - x, held)
            i, j = np.searchsorted(ee, (x, x + step))
            _set(held, ee[i:j] - x, eo[i:j])
            add(per_end[:, x : x + step], held)
    return np.concatenate([per_row[:, g.row], per_end], axis=1) - own


def collected(nodes: DataFrame, links: DataFrame, named: bool = False, make: Callable = net) -> tuple[DataFrame, Net] | None:
    """The numbered nodes (node, id ...) and their Net, or what else is made of them (``named``: with the names of up to MAX_NAMES nodes); None if there
    are more than MAX_LINKS links.

    nodes: node (distinct), origin (boolean), worth (long, not below 0, or null), asked (boolean). links: send, take.
    """
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()))
    name = lambda c, i: nodes.select(F.col("node").alias(c), F.col("id").alias(i))
    pairs = materialize(links.select("send", "take").distinct().join(name("send", "s"), "send").join(name("take", "t"), "take").select("s", "t"))
    if pairs.count() > MAX_LINKS or named and nodes.count() > MAX_NAMES:
        discard(nodes)
        discard(pairs)
        return None
    t, p = nodes.select("id", "origin", F.coalesce("worth", F.lit(-1).cast("long")).alias("worth")).toArrow(), pairs.toArrow()  # bounded by MAX_LINKS
    discard(pairs)
    ids, origin, worth = (t.column(c).to_numpy() for c in ("id", "origin", "worth"))
    by = np.argsort(ids)
    ids, origin, worth = ids[by], np.asarray(origin[by], bool), worth[by]
    g = make(ids, np.searchsorted(ids, p.column("s").to_numpy()), np.searchsorted(ids, p.column("t").to_numpy()), np.flatnonzero(origin), worth[origin])
    if named:
        t = nodes.select("id", "node").toArrow()  # bounded by MAX_NAMES
        g.names = t.column("node").combine_chunks().take(pa.array(np.argsort(t.column("id").to_numpy())[np.searchsorted(ids, g.ids)]))
    return nodes, g


def over_blocks(spark: SparkSession, g: Net | Dag, work: Callable[[Net | Dag, Iterator[int]], Iterator[pa.RecordBatch]], schema: str, per_core: int = 1) -> DataFrame:
    """``work`` over the blocks, each task a stretch of them; every worker is sent the Net once."""
    sent = spark.sparkContext.broadcast(g)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(sent.value, (b for batch in batches for b in batch.column(0).to_pylist()))

    tasks = max(1, min(g.blocks, per_core * spark.sparkContext.defaultParallelism))
    out = spark.range(0, g.blocks, 1, tasks).mapInArrow(task, schema)
    out._sent = sent
    return out


def _named(nodes: DataFrame, found: DataFrame, sums: DataFrame) -> DataFrame:
    """The sums of the nodes asked for, written: the Net, of which the driver and every executor have a file, and the numbers are no longer needed."""
    out = materialize(nodes.where("asked").select("id", "node").join(sums, "id").drop("id"))
    found._sent.destroy()
    discard(nodes)
    return out


def counts(nodes: DataFrame, links: DataFrame) -> DataFrame | None:
    """(node, n, max_hops, sum_hops, marked, worth) of every node asked for that anything else reaches: how many origins do, over how many links
    at most and all together, how many of them have a worth, and these worths' sum. None if there are too many links.

    nodes: node (distinct), origin, worth, asked. links: send, take; what reaches the sender reaches the taker.
    """
    got = collected(nodes, links)
    if got is None:
        return None
    nodes, g = got

    def work(g: Net, blocks: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sums = _count(g, blocks)
        some = np.flatnonzero(sums[0])
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[part]), *[pa.array(x[part]) for x in sums]], names=[c.split()[0] for c in _SUMS.split(", ")])

    found = over_blocks(nodes.sparkSession, g, work, _SUMS)
    sums = found.groupBy("id").agg(F.sum("n").alias("n"), F.max("max_hops").alias("max_hops"), *[F.sum(c).alias(c) for c in ("sum_hops", "marked", "worth")])
    return _named(nodes, found, sums)


def totals(nodes: DataFrame, links: DataFrame) -> DataFrame | None:
    """(node, n, marked, worth) as of counts(), in one pass over the links."""
    got = collected(nodes, links, make=dag)
    if got is None:
        return None
    nodes, g = got

    def work(g: Dag, blocks: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sums = _total(g, blocks)
        some = np.flatnonzero(sums[0])
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[part]), *[pa.array(x[part]) for x in sums]], names=[c.split()[0] for c in _TOTALS.split(", ")])

    found = over_blocks(nodes.sparkSession, g, work, _TOTALS)
    return _named(nodes, found, found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "marked", "worth")]))


#: Pairs in one batch that a task hands on.
PAIRS = 400_000


def pairs(nodes: DataFrame, links: DataFrame, cut: int = 0) -> DataFrame | None:
    """(node, origin): what is reached by which origin, as names without their first ``cut`` characters; None if there are too many links or nodes.

    nodes and links are those of counts(); a pair is handed on as soon as it is found.
    """
    got = collected(nodes, links, named=True)
    if got is None:
        return None
    got[1].names = pc.utf8_slice_codeunits(got[1].names, cut)

    def work(g: Net, blocks: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            last = None
            for _, last in rounds(g, block):
                pass
            if last is None:
                continue
            mine = g.names.take(pa.array(g.origins[block * 64 * g.words : (block + 1) * 64 * g.words]))
            step = max(1, PAIRS // len(mine))
            for i in range(0, g.takers, step):
                row, bit = np.nonzero(np.unpackbits(last[i : i + step].view(np.uint8), axis=1, bitorder="little"))
                if len(row):
                    of, start = np.unique(row, return_index=True)
                    held = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), mine.take(pa.array(bit)))
                    yield pa.RecordBatch.from_arrays([g.names.take(pa.array(of + i)), held], names=["node", "origins"])

    sets = over_blocks(got[0].sparkSession, got[1], work, "node string, origins array<string>", 4)
    return sets.select("node", F.explode("origins").alias("origin"))
