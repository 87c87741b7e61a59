"""Session helpers: where intermediate results go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset the session must be a one-machine one (tests); a cluster
    without a shared folder is refused, as a machine-local folder would be lost
    with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="refweave-")
    sc.setCheckpointDir(folder)
    return folder


_owned: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application's driver ends."""
    path = f"{scratch_dir(spark)}/refweave/{spark.sparkContext.applicationId}"
    if path not in _owned:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _owned.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; tables made from it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _owned.clear()


def fingerprint(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of what lies in a folder: another one where a table has been written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """``df`` written once below the shared folder and read back: cuts lineage, survives lost executors.

    ``parts``: columns of few values; reading back by one of them touches its files only.
    What was shuffled for it is no longer needed: Spark deletes it as the write ends, and what other steps have left when
    the driver collects its garbage, so it is made to.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*parts or []).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(df.columns) if parts else out
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` has written for ``df``, once nothing that is still to be computed reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session runs tasks at once.

    For expensive Python steps over few or small files; what has partitions enough is not shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
