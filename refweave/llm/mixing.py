"""Mixing sources to target weights by the cube method.

Every document of a source has the same rate: a whole number of copies plus a fraction, its inclusion
probability for one more. The flight phase moves these probabilities through the null space of the balance
constraints (tokens, documents) until all but two per block are 0 or 1. Blocks are bounded; what they leave
undecided is gathered into fewer blocks, level by level, until one small landing problem per source remains.
Long documents fly first, so that what is left to land is short and the totals stay close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import materialize

#: Documents of one flight.
BLOCK = 20_000
#: A document with more than this share of its source's tokens is decided before the others.
OUTSIZED = 0.001
_EPS = 1e-9


def _settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, share: float = 0.01, tries: int = 100) -> np.ndarray:
    """Decides the documents that hold more than ``share`` of a block's size first, each against all the others at once.

    In windows of three such a document would hardly move and be left to land, far from the total.
    """
    p = p.copy()
    for g in np.argsort(-size, kind="stable"):
        if size[g] <= share * size.sum():
            break
        for _ in range(tries):
            free = (p > _EPS) & (p < 1 - _EPS)
            if not free[g]:
                break
            free[g] = False
            free &= size < size[g]
            n, s = free.sum(), size[free]
            var = ((s - s.mean()) ** 2).sum() if n > 2 else 0.0
            if var <= 0:
                break
            u = np.zeros(len(p))
            u[g] = 1.0
            u[free] = -1.0 / n - (size[g] - s.mean()) / var * (s - s.mean())  # keeps the size and the number
            w = np.flatnonzero(u)
            with np.errstate(divide="ignore"):
                up = np.where(u[w] > 0, (1 - p[w]) / u[w], p[w] / -u[w]).min()
                back = np.where(u[w] > 0, p[w] / u[w], (1 - p[w]) / -u[w]).min()
            p[w] += u[w] * (up if rng.random() * (up + back) < back else -back)
            p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    return p


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities moved to 0 or 1, but for two at most, with sum(p x size) and sum(p) kept.

    With ``land`` the last ones are rounded too: of their few combinations the one nearest in size, then in number.
    """
    p, size = _settle(p.astype(float), size.astype(float), rng).tolist(), size.astype(float).tolist()
    scale = max(1.0, max(size, default=1.0))
    undecided = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    draws = iter(rng.random(len(undecided) + 3).tolist())
    window, at = [], 0
    while True:
        while len(window) < 3 and at < len(undecided):
            window.append(undecided[at])
            at += 1
        if len(window) < 3:
            break
        i, j, k = window
        a, b, c = size[i] / scale, size[j] / scale, size[k] / scale
        u = (b - c, c - a, a - b)  # the null vector of rows (a, b, c) and (1, 1, 1)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[w]) / x if x > 0 else p[w] / -x for w, x in zip(window, u) if x)
        back = min(p[w] / x if x > 0 else (1 - p[w]) / -x for w, x in zip(window, u) if x)
        step = up if next(draws) * (up + back) < back else -back
        for w, x in zip(window, u):
            v = p[w] + step * x
            p[w] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        window = [w for w in window if 0.0 < p[w] < 1.0]
    if land and window:
        want_size, want_n = sum(p[w] * size[w] for w in window), sum(p[w] for w in window)
        best = min(
            itertools.product((0.0, 1.0), repeat=len(window)),
            key=lambda x: (abs(sum(v * size[w] for v, w in zip(x, window)) - want_size), abs(sum(x) - want_n)),
        )
        for w, v in zip(window, best):
            p[w] = v
    return np.array(p)


def _fly(seed: int, land: bool):
    schema = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (source, block, order): one flight per (source, block)."""

        def close(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(rows)
            p = flight(t["p"].to_numpy(), t["n_tokens"].to_numpy(), np.random.default_rng([seed & 0xFFFFFFFF, t["block"][0].as_py(), t.num_rows]), land)
            yield from t.select(["source", "doc_id", "n_tokens", "base"]).append_column("p", pa.array(p)).cast(schema).to_batches()

        held, key = [], None
        for batch in batches:
            sources, numbers = batch.column("source").to_pylist(), batch.column("block").to_pylist()
            first = 0
            for i in range(batch.num_rows + 1):
                now = (sources[i], numbers[i]) if i < batch.num_rows else None
                if i == batch.num_rows or now != key:
                    if i > first:
                        held.append(pa.Table.from_batches([batch.slice(first, i - first)]))
                    if i < batch.num_rows:
                        if held:
                            yield from close(held)
                        held, key, first = [], now, i
        if held:
            yield from close(held)

    return run


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source: target_share (among sources that have tokens), max_repeats, available, rate (copies per document).

    The total is the largest at which no source needs more than its repeats, unless a smaller one is given.
    Sources are few: the table is as long as ``targets``.
    """
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    both = wanted.join(have, "source").where("max_repeats > 0")
    whole = both.agg(F.sum("target_share").alias("s"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("most"))
    most = F.col("most") * F.col("s")
    total = most if total_tokens is None else F.least(most, F.lit(float(total_tokens)))
    rate = F.least(total * F.col("target_share") / F.col("s") / F.col("available"), F.col("max_repeats").cast("double"))
    return both.crossJoin(whole).select("source", (F.col("target_share") / F.col("s")).alias("target_share"), "max_repeats", "available", "documents", rate.alias("rate"))


def _with_rate(rows: DataFrame) -> DataFrame:
    """Whole copies (base) and the probability of one more (p) from a rate."""
    base = F.least(F.floor(F.col("rate") + _EPS), F.col("max_repeats")).cast("long")
    return rows.select("source", "doc_id", "n_tokens", base.alias("base"), F.greatest(F.col("rate") - base, F.lit(0.0)).alias("p"))


def _round(rows: DataFrame, blocks: int, seed: int, land: bool) -> DataFrame:
    """One flight per source and block."""
    order = F.xxhash64("doc_id", F.lit(seed))
    return (
        rows.withColumn("block", F.pmod(order, F.lit(blocks)).cast("long")).withColumn("o", order)
        .repartition("source", "block").sortWithinPartitions("source", "block", F.desc("n_tokens"), "o", "doc_id")
        .select("source", "block", "doc_id", "n_tokens", "base", "p")
        .mapInArrow(_fly(seed, land), "source string, doc_id long, n_tokens long, base long, p double")
    )


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """doc_id, source, n_tokens, copies (1 to max_repeats) of the documents chosen.

    ``sizes``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats. Documents without
    tokens, with a null source or of a source without target are never chosen; sources without tokens leave
    their share to the others. A source's repeated target rows count once (the greatest share and repeats),
    null repeats are 1. Repeated document rows are documents of their own. Empty tables give no rows. The
    same input and seed give the same choice.
    """
    per_source = materialize(plan(sizes, targets, total_tokens))
    rows = sizes.where("n_tokens > 0 and source is not null").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    rows = rows.join(F.broadcast(per_source), "source").withColumn("outsized", F.col("n_tokens") > OUTSIZED * F.col("available"))  # one row per target
    # Documents that hold more than their share of a source, fewer than 1 / OUTSIZED of them, are decided first;
    # what they take or leave, the others make up for.
    large = materialize(_round(_with_rate(rows.where("outsized")), 1, seed - 1, True))
    taken = large.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.sum((F.col("base") + F.col("p")) * F.col("n_tokens")).alias("taken"))
    left = per_source.join(taken, "source", "left").select(
        "source", (F.col("rate") * F.col("available") - F.coalesce("taken", F.lit(0))).alias("_want"), (F.col("available") - F.coalesce("held", F.lit(0))).alias("_have")
    )
    rest = F.least(F.greatest(F.col("_want") / F.nullif("_have", F.lit(0)), F.lit(0.0)), F.col("max_repeats").cast("double"))
    rows = _with_rate(rows.where("not outsized").join(F.broadcast(left), "source").withColumn("rate", rest))  # one row per target
    most = per_source.agg(F.max("documents")).first()[0] or 0
    done: list[DataFrame] = [large]
    level, now = 0, rows
    while True:
        blocks = max(1, -(-most // block))
        flown = materialize(_round(now, blocks, seed + level, blocks == 1))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~open_))
        if blocks == 1:
            break
        now, most, level = flown.where(open_), 2 * blocks, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("long")).alias("copies")).where("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, documents, records (with repeats), tokens and the actual_share reached."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = chosen.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("records"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    zero = F.lit(0).cast("long")
    whole = got.agg(F.sum("tokens").alias("all"))
    return wanted.join(got, "source", "left").crossJoin(whole).select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("documents", "records", "tokens", "most_copies")],
        F.coalesce(F.col("tokens") / F.nullif("all", zero), F.lit(0.0)).alias("actual_share"),
    )
