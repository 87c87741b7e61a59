"""Queries of the text operators: p2, p7, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import encoding, mixing, reading, secrets, syntax
from refweave.session import materialize, table


FILE = ["repository_full_name", "path", "sha"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines on which usable literal secrets begin."""
    return secrets.find_secrets(table(spark, d, "workflows"), "content", "path", FILE).select(*FILE, "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its secrets replaced."""
    return secrets.redact_files(table(spark, d, "workflows").select(*FILE, "content", "ingest_seq"), "content", "path")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_files(table(spark, d, "workflows"), "content", "path", FILE)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that are not valid texts of their language."""
    return _parsed(spark, d).where("failing_token >= 0").select(*FILE).distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of unparsable files per repository and language."""
    files = _parsed(spark, d).groupBy(*FILE, "language").agg(F.max("failing_token").alias("failing_token"))
    return syntax.failure_rates(files, ["repository_full_name", "language"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode(table(spark, d, "documents"), "text", ["doc_id"])


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of every document."""
    return encoding.n_tokens(table(spark, d, "documents"), "text", ["doc_id"])


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(encoding.n_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"]))
    targets = table(spark, d, "mixture_targets")
    return mixing.mix(sizes, targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents chosen, with their copies."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by p9_mix."""
    return mixing.shares(*_mixed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of each document with running prose."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_ratings"))


QUERIES = {
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p7_found": p7_found, "p7_rates": p7_rates, 
    "p8_ids": p8_ids, "p8_lengths": p8_lengths, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
}
ORACLE: dict[str, str] = {}
