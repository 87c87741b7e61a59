"""Cutting hot keys in time: slices from counts, so that no (key, slice) has more than a set number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import materialize

#: Hash buckets of the first count. A bucket within the bound holds no hot key, whatever its keys are.
BUCKETS = 16_384


def counts_by_bucket(rows: DataFrame, key: str, ts: str) -> list[tuple]:
    """(bucket, rows, least and greatest ``ts``) of at most BUCKETS buckets, in one pass."""
    per = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b")).agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return [tuple(r) for r in per.collect()]  # at most BUCKETS rows


def widths(rows: DataFrame, key: str, ts: str, most: int, buckets: list[tuple] | None = None) -> DataFrame | None:
    """(key, _width) of the keys with more than ``most`` rows: slices of that width in ``ts`` have at most ``most``.

    ``buckets``: as of counts_by_bucket, if it has been asked for before. None if there is no such key. Rows are counted by bucket of the key first, which leaves one row per bucket
    and task; only the keys of heavy buckets are then counted one by one. Widths are narrowed until the rows of
    every slice have been counted within the bound, or the width is one (rows of equal time). There are at
    most rows / ``most`` keys in the result.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    heavy = [b for b, n, *_ in (counts_by_bucket(rows, key, ts) if buckets is None else buckets) if n > most]
    if not heavy:
        return None
    held = rows.select(key, ts)
    held = held.where(bucket.isin(heavy)) if len(heavy) <= 1000 else held  # a filter of many numbers would cost more than it saves
    counts = held.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).cast("double").alias("lo"), F.max(ts).cast("double").alias("hi")).where(F.col("n") > most)
    plan = materialize(counts.select(key, F.greatest(F.lit(1.0), F.ceil((F.col("hi") - F.col("lo") + 1) / F.ceil(2 * F.col("n") / most))).cast("long").alias("_width")))
    if plan.isEmpty():
        return None
    while True:
        full = held.join(plan, key).groupBy(key, F.floor(F.col(ts) / F.col("_width")).alias("_slice")).agg(F.count("*").alias("n"), F.first("_width").alias("_width"))
        full = full.where((F.col("n") > most) & (F.col("_width") > 1)).groupBy(key).agg(F.max("n").alias("n"))
        full = materialize(full.select(key, F.ceil(2 * F.col("n") / most).alias("_parts")))
        if full.isEmpty():
            return plan
        narrower = F.greatest(F.lit(1.0), F.col("_width") / F.coalesce("_parts", F.lit(1))).cast("long")
        plan = materialize(plan.join(full, key, "left").select(key, narrower.alias("_width")))


def cut(rows: DataFrame, key: str, ts: str, plan: DataFrame | None) -> DataFrame:
    """``rows`` with _slice (its order is that of ``ts``; 0 for keys that are not cut) and _is_cut."""
    if plan is None:
        return rows.withColumn("_slice", F.lit(0).cast("long")).withColumn("_is_cut", F.lit(False))
    out = rows.join(plan, key, "left")
    return out.withColumn("_slice", F.coalesce(F.floor(F.col(ts) / F.col("_width")), F.lit(0).cast("long"))).withColumn("_is_cut", F.col("_width").isNotNull()).drop("_width")
