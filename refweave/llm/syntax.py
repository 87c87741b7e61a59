"""Source files that do not parse: flags per file, rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.languages import EXTENSIONS, failure
from refweave.session import spread


def language_of(path: Column) -> Column:
    """The language of a path by its extension, in any letter case; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, language in EXTENSIONS.items():
        out = F.when(extension == e, F.lit(language)).otherwise(out)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns kept, then language and content; adds the position of the failing token."""
    for batch in batches:
        languages, contents = batch.column("_language").to_pylist(), batch.column("_content")
        at = [failure(language, c.as_py()) for language, c in zip(languages, contents)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at, pa.int64())], names=[*batch.schema.names[:-1], "failing_token"])


def parse_files(files: DataFrame, content: str, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, language and failing_token: -1 where the content is one valid text of its language.

    Rows with null or empty content, and files of other languages, are left out; only syntax counts. A failing
    token equal to the number of tokens means that the text ends too early. Repeated rows repeat their result;
    contents of any length are read whole; an empty table gives no rows.
    """
    rows = files.select(*keep, language_of(F.col(path)).alias("_language"), F.col(content).alias("_content"))
    rows = rows.where("_language is not null and _content is not null and _content <> ''")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return spread(rows).mapInArrow(_parse, f"{schema}, failing_token long").withColumnRenamed("_language", "language")


def failure_rates(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """files, unparsable and rate per ``keys``; each file (row) counts once."""
    bad = F.count_if(F.col("failing_token") >= 0)
    return parsed.groupBy(*keys).agg(F.count("*").alias("files"), bad.alias("unparsable"), (bad / F.count("*")).alias("rate"))
