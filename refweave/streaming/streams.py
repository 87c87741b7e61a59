"""Structured Streaming: stateful drift, deduplicating accumulation, windows with watermarks.

Every function runs a stream to completion over what is there (availableNow) and returns what it wrote; the
same plans run continuously with another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.text import clean_sha
from refweave.plans.core_problems import _WS
from refweave.session import is_folder, own_dir, table

REF = ["action_id", "ref_name", "ref_type"]
#: How much later than its successors an observation may arrive and still be told from a repeat.
DELAY = "30 days"
DRIFT = "action_id string, ref_name string, ref_type string, previous_sha string, new_sha string, ingest_seq long"


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the Parquet tables as a stream of files."""
    schema = table(spark, d, name).schema
    path = f"{d}/{name}.parquet"
    if is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def run(df: DataFrame) -> DataFrame:
    """The stream run over all that is there in append mode, its result written below the shared folder and read back."""
    spark = df.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


#: How often collection and analysis run.
COLLECT_EVERY, ANALYSE_EVERY = "6 hours", "24 hours"


def start(df: DataFrame, folder: str, every: str = COLLECT_EVERY):
    """The same stream run on and on, a batch each ``every``; the query can be stopped and started again from its state below ``folder``."""
    return df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime=every).start()


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    # Of a batch only positions and codes of its values are kept; a trigger's size bounds the rows of one reference.
    codes, seqs, at = {}, [], []
    for b in batches:
        seqs.append(b["ingest_seq"].to_numpy())
        at.append(np.fromiter((codes.setdefault(s, len(codes)) for s in b["sha"]), np.int32, len(b)))
    seqs, at, names = np.concatenate(seqs), np.concatenate(at), list(codes)
    order = np.argsort(seqs, kind="stable")
    out = []
    for sha, seq in zip((names[c] for c in at[order]), seqs[order].tolist()):
        if last is not None and sha != last:
            out.append((*key, last, sha, seq))
        last = sha
    state.update((last,))
    if out:
        yield pd.DataFrame(out, columns=[*REF, "previous_sha", "new_sha", "ingest_seq"])


def drift_state(spark: SparkSession, d: str) -> DataFrame:
    """Moves of references in order of arrival: each row against the state of its reference, which it replaces."""
    rows = stream(spark, d, "ref_observations").select(*REF, clean_sha("sha").alias("sha"), "ingest_seq").where("sha is not null")
    return run(rows.groupBy(*REF).applyInPandasWithState(_changed, DRIFT, "sha string", "append", "NoTimeout"))


def accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of observations added up, repeats within a watermark dropped."""
    rows = stream(spark, d, "ref_observations").select(*REF, "sha", "observed_at").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return run(rows.withWatermark("observed_at", DELAY).dropDuplicatesWithinWatermark([*REF, "sha", "observed_at"]))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, of the days that are over by the watermark."""
    w = run(_events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
    return w.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of two days, one beginning each day, of those that are over by the watermark."""
    w = run(_events(spark, d).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")))
    return w.select(F.unix_micros("w.start").alias("start_us"), "n")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions: events with gaps below six hours, once the watermark has passed their end."""
    w = run(_events(spark, d).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")))
    return w.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


QUERIES = {"stream_drift_state": drift_state, "stream_accumulate": accumulate, "stream_tumbling": tumbling, "stream_sliding": sliding, "stream_sessions": sessions}

_DAY = 86_400_000_000
_OVER = "(select max(epoch_us(ts)) - 3600000000 from events)"
ORACLE = {
    "stream_drift_state": f"""select action_id, ref_name, ref_type, before as previous_sha, s as new_sha, ingest_seq from (select *, lag(s) over (partition by action_id, ref_name, ref_type order by ingest_seq) as before
      from (select *, nullif(lower(trim(sha, {_WS})), '') as s from ref_observations) where s is not null) where before <> s""",
    "stream_accumulate": "select distinct action_id, ref_name, ref_type, sha, observed_at from ref_observations",
    "stream_tumbling": f"select epoch_us(ts) // {_DAY} * {_DAY} as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having start_us + {_DAY} <= {_OVER}",
    "stream_sliding": f"select (epoch_us(ts) // {_DAY} - k) * {_DAY} as start_us, count(*) as n from events, (values (0), (1)) v(k) group by 1 having start_us + 2 * {_DAY} <= {_OVER}",
    "stream_sessions": f"""select user_id, min(epoch_us(ts)) as start_us, count(*) as n from (select *, sum(g) over (partition by user_id order by ts rows unbounded preceding) as k
      from (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 21600000000 then 0 else 1 end as g from events)) group by user_id, k having max(epoch_us(ts)) + 21600000000 <= {_OVER}""",
}
