"""Concentration and distribution statistics over a column, without collecting it into one task.

Ranks over a whole table come from range partitioning: rows are sorted in parallel, and a running number or sum is
the partition's own plus what the partitions before it hold, which is one row per partition.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.session import materialize


def ranked(df: DataFrame, value: str, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with rank (1-based, by value then ties), running (sum of the values so far), n and total.

    ``df`` has no columns of these names. Null values have no rank and are left out. ``by``: another order.
    """
    order = by or [value, *ties]
    parts = materialize(df.where(F.col(value).isNotNull()).repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    # Partition numbers are those of the range exchange; a narrow window per partition needs no sort across them.
    w = W.partitionBy("_part").orderBy(*order)
    own = parts.withColumn("_rank", F.row_number().over(w)).withColumn("_sum", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = held.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.sum("_n").over(W.partitionBy()).alias("n"), F.sum("_s").over(W.partitionBy()).alias("total"),
    )
    return own.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_rank") + F.col("_n0")).alias("rank"), (F.col("_sum") + F.col("_s0")).alias("running"), "n", "total")


def gini(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """One row: gini of the values, 0 for none or a zero sum."""
    r = ranked(df, value, ties)
    n, s = F.max("n"), F.max("total")
    g = 2 * F.sum(F.col("rank") * F.col(value)) / (n * s) - (n + 1) / n
    return r.agg(F.coalesce(F.when(s > 0, g), F.lit(0.0)).alias("gini"))


def lorenz(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """population_share and value_share after each row in ascending order; negative values count as 0, a zero sum gives the diagonal."""
    r = ranked(df.withColumn(value, F.greatest(F.col(value), F.lit(0))), value, ties)
    share = F.col("rank") / F.col("n")
    return r.select(*ties, share.alias("population_share"), F.when(F.col("total") > 0, F.col("running") / F.col("total")).otherwise(share).alias("value_share"))


def ecdf(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """value and (i + 1) / n for every row in ascending order; ties keep steps of their own."""
    return ranked(df, value, ties).select(*ties, value, (F.col("rank") / F.col("n")).alias("share"))


def hhi(value: Column) -> Column:
    """Sum of squared shares, as an aggregate; 0 for a zero sum."""
    return F.coalesce(F.sum(value * value) / F.nullif(F.pow(F.sum(value), F.lit(2.0)), F.lit(0.0)), F.lit(0.0))


def top_shares(df: DataFrame, value: str, ks: list[int], ties: list[str]) -> DataFrame:
    """One row: top_k_share for each k, the share of the k greatest values in their sum (or 1)."""
    total = df.agg(F.coalesce(F.nullif(F.sum(value), F.lit(0)), F.lit(1)).alias("_t"))
    top = df.orderBy(F.desc(value), *ties).limit(max(ks)).withColumn("_k", F.row_number().over(W.orderBy(F.desc(value), *ties)))  # max(ks) rows
    sums = top.agg(*[F.coalesce(F.sum(F.when(F.col("_k") <= k, F.col(value))), F.lit(0)).alias(f"_s{k}") for k in ks])
    return sums.crossJoin(total).select(*[(F.col(f"_s{k}") / F.col("_t")).alias(f"top_{k}_share") for k in ks])


BOOTSTRAP = "indicator string, sample_count long, estimate double, ci_low double, ci_high double"


def _position(values: list[float], q: float) -> float:
    return values[min(len(values) - 1, max(0, round((len(values) - 1) * q)))]


def bootstrap(df: DataFrame, label: str, value: str, order: list[str], iterations: int = 500, seed: int = 42, top_k: int | None = None, most: int = 2_000_000) -> DataFrame:
    """Per label the mean (or the share of the top_k values) with its 95 % percentile interval.

    The draws follow one seeded generator over the values in ``order``, so one task holds a label's values: meant
    for the few indicators of a report, and refused beyond ``most`` values. bootstrap_means has no such bound.
    """

    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} values under one label: use bootstrap_means")

    def estimate(values: list[float]) -> float:
        if top_k is None:
            return sum(values) / len(values)
        return sum(sorted(values, reverse=True)[:top_k]) / (sum(values) or 1)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].astype(float).tolist()
        rng, n = random.Random(seed), len(values)
        draws = sorted(estimate([values[rng.randrange(n)] for _ in range(n)]) for _ in range(iterations))
        return pd.DataFrame([[pdf[label].iloc[0], n, round(estimate(values), 6), round(_position(draws, 0.025), 6), round(_position(draws, 0.975), 6)]], columns=["indicator", "sample_count", "estimate", "ci_low", "ci_high"])

    return df.where(F.col(value).isNotNull()).groupBy(label).applyInPandas(draw, BOOTSTRAP)


DIFFERENCE = "metric string, left_count long, right_count long, difference double, ci_low double, ci_high double"


def bootstrap_difference(df: DataFrame, label: str, value: str, is_left: str, order: list[str], iterations: int = 500, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """Per label the difference of the means of two samples (left - right) with its 95 % percentile interval.

    Both samples are drawn from one seeded generator, the left one first. Bounded as bootstrap is;
    bootstrap_differences has no such bound. A label with one empty sample has no difference.
    """
    largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} values under one label: use bootstrap_differences")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)
        left, right = (rows[rows[is_left] == side][value].astype(float).tolist() for side in (True, False))
        out = [pdf[label].iloc[0], len(left), len(right), None, None, None]
        if left and right:
            rng, draws = random.Random(seed), []
            for _ in range(iterations):
                a, b = (sum(x[rng.randrange(len(x))] for _ in x) / len(x) for x in (left, right))
                draws.append(a - b)
            draws.sort()
            point = sum(left) / len(left) - sum(right) / len(right)
            out[3:] = [round(point, 6), round(_position(draws, 0.025), 6), round(_position(draws, 0.975), 6)]
        return pd.DataFrame([out], columns=["metric", "left_count", "right_count", "difference", "ci_low", "ci_high"])

    return df.where(F.col(value).isNotNull()).groupBy(label).applyInPandas(draw, DIFFERENCE)


def _resampled(df: DataFrame, label: str, value: str, sides: list[Column], iterations: int, seed: int) -> DataFrame:
    """Per label and iteration the weighted means of the sides: Poisson(1) weights from a hash of row and iteration."""
    u = (F.pmod(F.xxhash64(*df.columns, "_i", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # the distribution of Poisson(1), inverted
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((u > s).cast("int") for s in steps)
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_w", weight)
    means = [(F.sum(F.when(c, F.col("_w") * F.col(value))) / F.nullif(F.sum(F.when(c, F.col("_w"))), F.lit(0))).alias(f"_m{i}") for i, c in enumerate(sides)]
    return rows.groupBy(label, "_i").agg(*means)


def bootstrap_differences(df: DataFrame, label: str, value: str, is_left: str, iterations: int = 200, seed: int = 42) -> DataFrame:
    """The scalable interval of a difference of means, as bootstrap_means."""
    per = _resampled(df, label, value, [F.col(is_left), ~F.col(is_left)], iterations, seed)
    return per.groupBy(label).agg(*[nearest(F.col("_m0") - F.col("_m1"), q).alias(n) for q, n in ((0.025, "ci_low"), (0.975, "ci_high"))])


def bootstrap_means(df: DataFrame, label: str, value: str, iterations: int = 200, seed: int = 42) -> DataFrame:
    """The scalable interval of the mean: Poisson resampling weights from a hash of row and iteration, all in SQL.

    Rows are aggregated map-side to one partial sum per (label, iteration); nothing is gathered. Rows with equal
    content in all columns share their weights.
    """
    per = _resampled(df, label, value, [F.lit(True)], iterations, seed)
    return per.groupBy(label).agg(nearest("_m0", 0.025).alias("ci_low"), nearest("_m0", 0.975).alias("ci_high"))


def nearest(column: Column | str, q: float) -> Column:
    ordered = F.array_sort(F.collect_list(column))
    return F.get(ordered, F.rint((F.size(ordered) - 1) * F.lit(q)).cast("int"))
