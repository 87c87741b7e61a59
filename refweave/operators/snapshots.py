"""What changed between full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.operators.history import attribute_hash
from refweave.session import materialize


def deliveries(snapshots: DataFrame, key: str, snapshot: str) -> DataFrame:
    """(_snap, _rank): the deliveries in order; one row each, written once."""
    rows = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    return materialize(rows.select(F.col(snapshot).alias("_snap")).distinct().withColumn("_rank", F.row_number().over(W.orderBy("_snap"))))


def snapshot_intervals(snapshots: DataFrame, key: str, snapshot: str, read_at: str, attrs: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """Validity intervals of each key's row: the longest runs of consecutive deliveries with an equal row hash.

    Result: key, row_hash, first_rank, last_rank (positions among the deliveries present), n_snapshots.
    In one delivery a key's latest ``read_at`` holds; on a tie the greater attributes (nulls are least).
    Rows with a null key or snapshot belong to no delivery. Repeats change nothing. The map-side
    pre-aggregation leaves one row per key and delivery, so no group is larger than the number of deliveries.
    """
    rows = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    held = rows.groupBy(F.col(key).alias("_key"), F.col(snapshot).alias("_snap")).agg(
        F.max(F.struct(F.col(read_at).alias("_at"), *[F.col(a).alias(f"_v{i}") for i, a in enumerate(attrs)])).alias("_row")
    )
    held = held.select("_key", "_snap", attribute_hash(*[f"_row._v{i}" for i in range(len(attrs))]).alias("row_hash"))
    ranks = deliveries(snapshots, key, snapshot) if ranks is None else ranks
    w = W.partitionBy("_key").orderBy("_rank")
    marked = (
        held.join(ranks, "_snap")
        .withColumn("_start", F.coalesce((F.lag("_rank").over(w) != F.col("_rank") - 1) | (F.lag("row_hash").over(w) != F.col("row_hash")), F.lit(True)))
        .withColumn("_island", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    return marked.groupBy("_key", "_island").agg(
        F.first("row_hash").alias("row_hash"), F.min("_rank").alias("first_rank"), F.max("_rank").alias("last_rank"),
        F.min_by("_snap", "_rank").alias("first_snapshot"), F.count("*").alias("n_snapshots"),
    ).withColumnRenamed("_key", key)


def snapshot_changes(snapshots: DataFrame, key: str, snapshot: str, read_at: str, attrs: list[str]) -> DataFrame:
    """Change events (snapshot, key, change_kind) between consecutive deliveries, from the intervals' ends.

    An interval that begins right after another one of its key is ``changed``, any other beginning after the
    first delivery is ``added``; an end before the last delivery that no interval adjoins is ``removed``,
    in the delivery that follows. One delivery, or none, gives no events.
    """
    ranks = deliveries(snapshots, key, snapshot)
    runs = snapshot_intervals(snapshots, key, snapshot, read_at, attrs, ranks)
    w = W.partitionBy(key).orderBy("first_rank")
    adjoining = runs.withColumn("_before", F.lag("last_rank").over(w)).withColumn("_after", F.lead("first_rank").over(w))
    events = adjoining.select(
        key,
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("_before") == F.col("first_rank") - 1, F.struct(F.col("first_rank").alias("at"), F.lit("changed").alias("kind")))
                    .when(F.col("first_rank") > 1, F.struct(F.col("first_rank").alias("at"), F.lit("added").alias("kind"))),
                    F.when(F.col("_after").isNull() | (F.col("_after") > F.col("last_rank") + 1), F.struct((F.col("last_rank") + 1).alias("at"), F.lit("removed").alias("kind"))),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("_e"),
    )
    # A removal after the last delivery has no delivery to be seen in: the join drops it.
    return events.join(ranks, F.col("_e.at") == F.col("_rank")).select(F.col("_snap").alias(snapshot), key, F.col("_e.kind").alias("change_kind"))
