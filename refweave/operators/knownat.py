"""Attributes as known at event time: path-copied persistent search trees per entity.

The versions of a key enter a persistent treap in the order in which they became known; each insertion copies
the path it changes and leaves a new root, so every earlier state of knowledge stays searchable. An event picks
the last root known at its time and searches it for the greatest valid time not after its own.

Keys with many versions are cut into shards in time (slices from counts). A version belongs to the shard in which
it is first both known and valid, an event to that of its time; of all versions of earlier shards only the one of
the greatest valid time can be an answer, so it is carried into the shard as its first insertion. Every answer is
thus one search from one root.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.operators.slices import cut, widths
from refweave.session import materialize

#: Versions of one key that one tree may hold; keys with more are cut.
MAX_SHARD = 50_000


class PersistentTree:
    """A treap over (valid time, sequence) whose insertions copy paths; ``roots[i]`` is the tree after i+1 insertions."""

    def __init__(self) -> None:
        self.key: list = []
        self.value: list = []
        self.priority: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.known: list = []
        self.roots: list[int] = []
        self.inserted = 0

    def _node(self, key, value, priority: int, left: int, right: int) -> int:
        self.key.append(key)
        self.value.append(value)
        self.priority.append(priority)
        self.left.append(left)
        self.right.append(right)
        return len(self.key) - 1

    def _split(self, at: int, key) -> tuple[int, int]:
        """Copies of the nodes below and above ``key``; built along the search path without recursion."""
        path = []
        while at >= 0:
            below = self.key[at] < key
            path.append((at, below))
            at = self.right[at] if below else self.left[at]
        low = high = -1
        for node, below in reversed(path):
            if below:
                low = self._node(self.key[node], self.value[node], self.priority[node], self.left[node], low)
            else:
                high = self._node(self.key[node], self.value[node], self.priority[node], high, self.right[node])
        return low, high

    def insert(self, known, key, value) -> None:
        """One more version. Insertions come in the order of ``known``."""
        self.inserted += 1
        priority = (self.inserted * 0x9E3779B97F4A7C15 ^ self.inserted >> 7) * 0xBF58476D1CE4E5B9 >> 20 & 0xFFFFFFFF
        at, path = (self.roots[-1] if self.roots else -1), []
        while at >= 0 and self.priority[at] >= priority:
            below = self.key[at] < key
            path.append((at, below))
            at = self.right[at] if below else self.left[at]
        low, high = self._split(at, key)
        root = self._node(key, value, priority, low, high)
        for node, below in reversed(path):
            left, right = (self.left[node], root) if below else (root, self.right[node])
            root = self._node(self.key[node], self.value[node], self.priority[node], left, right)
        if self.known and self.known[-1] == known:
            self.roots[-1] = root
        else:
            self.known.append(known)
            self.roots.append(root)

    def find(self, known, valid):
        """The version (key, value) of the greatest key with a valid time <= ``valid`` in the root of ``known``, or None."""
        i = bisect_right(self.known, known) - 1
        at, best = (self.roots[i] if i >= 0 else -1), -1
        while at >= 0:
            if self.key[at][0] <= valid:
                best, at = at, self.right[at]
            else:
                at = self.left[at]
        return None if best < 0 else (self.key[best], self.value[best])


ORDER = ["_key", "_slice", "_kind", "_known", "_valid", "_seq"]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ORDER, versions (kind 0) before events (kind 1); one row per event with an answer."""
    shard, tree, waiting = None, None, []
    for batch in batches:
        keys, slices, kinds = (batch.column(c).to_pylist() for c in ("_key", "_slice", "_kind"))
        knowns, valids, seqs, values, payloads = (batch.column(c).to_pylist() for c in ("_known", "_valid", "_seq", "_value", "_event"))
        events, found, times = [], [], []
        for i, key in enumerate(keys):
            if (key, slices[i]) != shard:
                shard, tree, waiting = (key, slices[i]), None, []
            if kinds[i] == 0:
                waiting.append((knowns[i], (valids[i], seqs[i] if seqs[i] is not None else -1), values[i]))
                continue
            if waiting:  # the tree is grown only where an event asks
                tree = tree or PersistentTree()
                for version in waiting:
                    tree.insert(*version)
                waiting = []
            if tree and (hit := tree.find(knowns[i], valids[i])):
                events.append(payloads[i])
                found.append(hit[1])
                times.append(hit[0][0])
        if events:
            yield pa.RecordBatch.from_arrays([pa.array(events, pa.string()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["_event", "_value", "_valid"])


SCHEMA = "_event string, _value string, _valid long"


def as_known_at(
    events: DataFrame, versions: DataFrame, key: str, event_time: str, valid_time: str, seq: str, value: str, event_id: str,
    known_time: str | None = None, most: int = MAX_SHARD,
) -> DataFrame:
    """For each event the ``value`` (string) valid at its time, as it was known at its time.

    Result: event_id, value, valid_time, for the events that have an answer. Times are long microseconds.
    ``known_time`` (default: the valid time) is when a version became known; an event sees only versions known
    and valid at or before its own time. Of versions with equal valid time the highest ``seq`` known then holds.
    Null keys, times or event ids match nothing; a null value is an answer like any other (filter before, where
    it says nothing). Repeated rows change nothing; empty tables give no rows; further columns are ignored.
    Keys with more than ``most`` versions are cut, which changes no answer.
    """
    known_col = F.col(known_time or valid_time)
    base = versions.where(F.col(key).isNotNull() & F.col(valid_time).isNotNull() & known_col.isNotNull()).select(
        F.col(key).alias("_key"), known_col.cast("long").alias("_known"), F.col(valid_time).cast("long").alias("_valid"), F.col(seq).cast("long").alias("_seq"),
        F.col(value).cast("string").alias("_value"), F.greatest(known_col, F.col(valid_time)).cast("long").alias("_at"),
    )
    asked = events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull() & F.col(event_id).isNotNull()).select(
        F.col(key).alias("_key"), F.col(event_time).cast("long").alias("_known"), F.col(event_time).cast("long").alias("_valid"), F.lit(0).cast("long").alias("_seq"),
        F.lit(None).cast("string").alias("_value"), F.col(event_time).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col(event_id).cast("string").alias("_event"),
    )
    plan = widths(base, "_key", "_at", most)
    if plan is not None:
        asked = materialize(asked)  # read twice below, and costly to make
    rows = cut(base.withColumn("_kind", F.lit(0)).withColumn("_event", F.lit(None).cast("string")).unionByName(asked), "_key", "_at", plan)
    if plan is not None:
        # One row per shard of a cut key: the best version before it. Shards of events alone are there, too.
        best = F.max(F.when(F.col("_kind") == 0, F.struct("_valid", "_seq", "_known", "_value")))
        before = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carried = rows.where("_is_cut").groupBy("_key", "_slice").agg(best.alias("_best")).withColumn("_best", F.max("_best").over(before)).where("_best is not null")
        carried = carried.select("_key", "_slice", "_best.*", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_event"))
        rows = rows.drop("_at", "_is_cut").unionByName(carried)
    rows = rows.select(*ORDER, "_value", "_event").repartition("_key", "_slice").sortWithinPartitions(*ORDER)
    out = rows.mapInArrow(_search, SCHEMA)
    return out.select(F.col("_event").alias(event_id), F.col("_value").alias(value), F.col("_valid").alias(valid_time))
