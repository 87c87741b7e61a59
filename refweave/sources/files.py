"""Sources and sinks: JSON lines, CSV, Parquet, reports with failure isolation, key/value and reference state."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a path or glob under an explicit schema. Nothing there: an empty table. A bad row fails the read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_jsonl, with _file and _position: files in path order, rows in file order, for rules of the last row."""
    rows = read_jsonl(spark, path, schema)
    if not _exists(spark, path):
        return rows.withColumn("_file", F.lit("")).withColumn("_position", F.lit(0).cast("long"))
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_position", F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33))


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad ones (the error log)."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    from refweave.session import materialize

    rows = materialize(rows)
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: Blanks around values are values; quotes are doubled, as other readers expect them.
CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; replaced as a whole when the write commits."""
    flat(df).write.mode("overwrite").options(**CSV).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV read forgivingly: empty or unreadable numbers are 0, truth is one of true, 1 and yes."""
    raw = spark.read.options(**CSV, multiLine=True).csv(path)
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")
        if isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            c = F.coalesce(F.try_to_number(F.trim(c), F.lit("S9999999999999999D999999")).cast(f.dataType), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.DoubleType):
            c = F.coalesce(F.expr(f"try_cast(`{f.name}` as double)") if f.name in raw.columns else F.lit(None), F.lit(0.0))
        else:
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return raw.select(out)


def read_artifact(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """An exported table again: its CSV if there is one, else its JSON, typed as read_csv_typed types; nothing there is an empty table."""
    if _exists(spark, f"{folder}/{name}.csv"):
        return read_csv_typed(spark, f"{folder}/{name}.csv", schema)
    if not _exists(spark, f"{folder}/{name}.json"):
        return spark.createDataFrame([], schema)
    zero = {T.BooleanType: False, T.LongType: 0, T.IntegerType: 0, T.DoubleType: 0.0}
    return spark.read.schema(schema).json(f"{folder}/{name}.json").select([F.coalesce(f.name, F.lit(zero.get(type(f.dataType), "")).cast(f.dataType)).alias(f.name) for f in schema.fields])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def latex(df: DataFrame, limit: int = 1000) -> str:
    """A small table as a LaTeX tabular."""
    escape = lambda c: "" if c is None else "".join(f"\\{x}" if x in "&%$#_{}" else x for x in str(c))
    body = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *df.limit(limit).collect()]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", *body, r"\end{tabular}"])


def svg_bars(df: DataFrame, label: str, value: str, limit: int = 40, width: int = 640) -> str:
    """A small table as a horizontal bar chart: one bar a row, in the table's order; missing and negative values have no bar."""
    from html import escape

    rows = [(r[label], r[value]) for r in df.select(label, value).limit(limit).collect()]
    most = max([float(v) for _, v in rows if v is not None and v > 0], default=1.0)
    bars = []
    for i, (name, v) in enumerate(rows):
        long = 0 if v is None else max(0.0, float(v)) / most * (width - 300)
        text = escape("" if name is None else str(name))
        bars.append(f'<text x="190" y="{24 * i + 17}" text-anchor="end">{text}</text><rect x="200" y="{24 * i + 4}" width="{long:.1f}" height="16"/><text x="{206 + long:.1f}" y="{24 * i + 17}">{"" if v is None else escape(str(v))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(rows) + 8}" font-family="sans-serif" font-size="12">' + "".join(bars) + "</svg>"


@dataclass
class Report:
    """Named tables to export. A table that fails is noted, the others are written."""

    tables: dict[str, Callable[[], DataFrame]]
    failures: list[tuple[str, str]] = field(default_factory=list)

    def export(self, spark: SparkSession, folder: str, formats: tuple[str, ...] = ("csv", "json")) -> DataFrame:
        """artifact, status and message of every table; failures are also written as export_failures."""
        done: list[tuple[str, str, str]] = []
        for name, make in self.tables.items():
            try:
                df = make()
                if "csv" in formats:
                    write_csv(df, f"{folder}/{name}.csv")
                if "json" in formats:
                    write_json(df, f"{folder}/{name}.json")
                if "parquet" in formats:
                    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
                done.append((name, "written", ""))
            except Exception as e:  # isolation is the point
                self.failures.append((name, str(e)[:500]))
                done.append((name, "failed", str(e)[:500]))
        log = spark.createDataFrame(done, "artifact string, status string, message string")
        write_csv(log.where("status = 'failed'"), f"{folder}/export_failures.csv")
        return log


def missing_inputs(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Of the required inputs those that are not there."""
    return [n for n in names if not _exists(spark, f"{folder}/{n}")]


class KeyValueStore:
    """Checkpoints as an append-only table: the last write of a (namespace, key) holds."""

    SCHEMA = "namespace string, key string, value string, written_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def save(self, df: DataFrame) -> None:
        """Rows namespace, key, value."""
        df.select("namespace", "key", "value", F.current_timestamp().alias("written_at")).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        return self.table().groupBy("namespace", "key").agg(F.max_by("value", "written_at").alias("value"))


def ref_states(observations: DataFrame) -> DataFrame:
    """The latest known sha of each reference, by arrival: the state a tracker would hold."""
    return observations.where("sha is not null").groupBy("action_id", "ref_name", "ref_type").agg(F.max_by("sha", "ingest_seq").alias("sha"), F.max("ingest_seq").alias("ingest_seq"))


def load_ref_state(wanted: DataFrame, states: DataFrame, legacy: DataFrame) -> DataFrame:
    """``wanted`` references (action_id, ref_name, ref_type) with the sha last known: of their own state, for tags without one
    that of the older store by tag (action_id, tag_name, sha); null where neither knows."""
    old = legacy.select("action_id", F.col("tag_name").alias("ref_name"), F.lit("tag").alias("ref_type"), F.col("sha").alias("_old"))
    keys = ["action_id", "ref_name", "ref_type"]
    return wanted.select(*keys).distinct().join(states.select(*keys, "sha"), keys, "left").join(old, keys, "left").select(*keys, F.coalesce("sha", "_old").alias("sha"))


def pending(units: DataFrame, checkpoints: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a resumed collection has left to do: units not completed, and completed ones whose snapshot is gone.

    units: unit; checkpoints: unit, status (running, failed, completed); snapshots: unit.
    """
    state = units.select("unit").distinct().join(checkpoints.groupBy("unit").agg(F.max("status").alias("status")), "unit", "left").join(snapshots.select("unit").distinct().withColumn("_there", F.lit(True)), "unit", "left")
    done = (F.col("status") == "completed") & F.col("_there").isNotNull()
    return state.where(~F.coalesce(done, F.lit(False))).select("unit", F.coalesce("status", F.lit("new")).alias("status"))


@dataclass(frozen=True)
class Settings:
    """Limits of a run, from REFWEAVE_* variables where set."""

    min_stars: int = 50
    repositories: int = 2000
    workflows_per_repository: int = 20
    commits_per_workflow: int = 50
    max_depth: int = 6
    supplemental_identities: int = 1000
    supplemental_actions: int = 4000
    enriched_actions: int = 500
    iterations: int = 500
    seed: int = 42

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        return cls(**{f: int(env[f"REFWEAVE_{f.upper()}"]) for f in cls.__dataclass_fields__ if env.get(f"REFWEAVE_{f.upper()}")})


def preflight(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """check, ok and detail of what a run needs."""
    missing = missing_inputs(spark, folder, names)
    rows = [("inputs", not missing, ",".join(missing))]
    try:
        import yaml

        rows.append(("yaml", True, yaml.__version__))
    except ImportError as e:
        rows.append(("yaml", False, str(e)))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


# ---------------------------------------------------------------- a partitioned search source
class _Range(InputPartition):
    def __init__(self, low: int, high: int, places: list[tuple[int, int, int]]):
        self.low, self.high, self.places = low, high, places  # places: value, offset and length of each hit's line


def bisect_ranges(count: Callable[[int, int], int], low: int, high: int, most: int) -> list[tuple[int, int]]:
    """Inclusive ranges of at most ``most`` hits each; a single value that has more stays one range."""
    out, stack = [], [(low, high)]
    while stack:
        a, b = stack.pop()
        n = count(a, b)
        if n == 0:
            continue
        if n <= most or a == b:
            out.append((a, b))
        else:
            middle = (a + b) // 2
            stack += [(middle + 1, b), (a, middle)]
    return sorted(out)


class RangeSearch(DataSource):
    """``spark.read.format("range_search")``: JSON lines searched by ranges of a number, one partition per range.

    Options: path (a file of JSON lines), column, low, high, most (hits a search can give). Stands for any
    search interface that caps its results: ranges are halved until each fits.
    """

    @classmethod
    def name(cls) -> str:
        return "range_search"

    def schema(self) -> str:
        return "value long, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.column = options["path"], options["column"]
        self.low, self.high, self.most = (int(options.get(k, v)) for k, v in (("low", "0"), ("high", "1000000"), ("most", "1000")))

    def _places(self) -> list[tuple[int, int, int]]:
        """Value, offset and length of every line, by value: the one pass over the whole file."""
        found, at = [], 0
        with open(self.path, "rb") as f:
            for line in f:
                if line.strip():
                    value = json.loads(line).get(self.column)
                    if value is not None:
                        found.append((int(value), at, len(line)))
                at += len(line)
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        from bisect import bisect_left, bisect_right

        places = self._places()
        values = [p[0] for p in places]
        cut = lambda a, b: (bisect_left(values, a), bisect_right(values, b))
        ranges = bisect_ranges(lambda a, b: cut(a, b)[1] - cut(a, b)[0], self.low, self.high, self.most)
        return [_Range(a, b, places[slice(*cut(a, b))]) for a, b in ranges]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Only the lines of the range, each at its place."""
        with open(self.path, "rb") as f:
            for value, at, length in sorted(partition.places, key=lambda p: p[1]):
                f.seek(at)
                yield value, f.read(length).decode("utf-8").strip()
