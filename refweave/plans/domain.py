"""The domain tables as the analyses take them: deduplicated, the latest collection of each key first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.operators import graph
from refweave.session import fingerprint, materialize, table

_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A shared intermediate (docs, closure ...), written once per session, folder and state of the folder's tables."""
    key = _key(spark, d, name)
    if key not in _kept:
        _kept[key] = materialize(make())
    return _kept[key]


def _key(spark: SparkSession, d: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, d, fingerprint(spark, d), name


def forget() -> None:
    """The next query makes its intermediates anew."""
    _kept.clear()


def latest(df: DataFrame, keys: list[str], at: str, seq: str = "ingest_seq") -> DataFrame:
    """The row of the latest ``at`` of each key, ties to the later arrival; null times are oldest. Pre-aggregates map-side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, seq)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*")


def repositories(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "repositories"), ["repo_id"], "collected_at")


def repository_names(s: SparkSession, d: str) -> DataFrame:
    """One row per full name (stars: the greatest), for joins by name."""
    return repositories(s, d).groupBy("full_name").agg(F.max("stars").alias("stars"), F.bool_or("archived").alias("archived"))


def actions(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "actions")
    return latest(t.select([c for c in t.columns if c != "declared_permissions"]), ["action_id"], "discovered_at")


def workflows(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "workflows"), ["repository_full_name", "path", "sha"], "discovered_at")


#: What keep_edges writes of an edge: the columns of queries that take the edges several times.
KEPT = (
    "src_node_id", "dst_node_id", "src_kind", "dst_kind", "edge_type", "ref_type", "ref_string", "binding_downgrade", "consumer_repository", "workflow_path", "depth",
)


def edges(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest row of each edge; with ``columns`` only these are moved. These are read back where keep_edges has written them."""
    kept = _kept.get(_key(s, d, "edges"))
    if kept is not None and columns and set(columns) <= set(kept.columns):
        return kept.select(*columns)
    t = table(s, d, "edges")
    if not columns:
        return latest(t, ["edge_id"], "discovered_at")
    return latest(t.select("edge_id", *columns, "discovered_at", "ingest_seq"), ["edge_id"], "discovered_at").select(*columns)


def keep_edges(s: SparkSession, d: str) -> None:
    """For queries that take the edges several times: their latest rows are found once, not shuffled for each use."""

    def make() -> DataFrame:
        there = table(s, d, "edges").columns
        return edges(s, d, *[c for c in KEPT if c in there])

    once(s, d, "edges", make)


def scoped(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.scoped_edges(edges(s, d, "consumer_repository", "workflow_path", *columns) if columns else edges(s, d))


CHANGE_KEY = ["repository_full_name", "workflow_path", "commit_sha", "committed_at", "uses_before", "uses_after"]


def changes(s: SparkSession, d: str) -> DataFrame:
    """Workflow changes, the last arrival of each; null lists are empty."""
    t = table(s, d, "workflow_changes")
    empty = F.array().cast("array<string>")
    t = t.select("repository_full_name", "workflow_path", "commit_sha", "committed_at", "ingest_seq", *[F.coalesce(c, empty).alias(c) for c in ("uses_before", "uses_after", "introduced", "removed")])
    return t.groupBy(*CHANGE_KEY).agg(F.max_by(F.struct("introduced", "removed"), "ingest_seq").alias("_r")).select(*CHANGE_KEY, "_r.*")


def observations(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "ref_observations").where("sha is not null")
    return t.select("action_id", "owner", "repo", "ref_name", "ref_type", "sha", "observed_at", "source").dropDuplicates(["action_id", "ref_name", "ref_type", "sha", "observed_at"])


def marketplace(s: SparkSession, d: str) -> DataFrame:
    """Marketplace identities: published actions, one per lower-case owner and repo."""
    a = actions(s, d).where("marketplace_published")
    return a.groupBy(F.lower("owner").alias("m_owner"), F.lower("repo").alias("m_repo")).agg(
        F.max("marketplace_category").alias("category"), F.max("action_name").alias("title"), F.bool_or(F.col("author_verified") == "verified").alias("verified_creator")
    )


def identities(s: SparkSession, d: str) -> DataFrame:
    """Identity observations of repositories: every collected row is one observation of the name its address resolves to."""
    t = table(s, d, "repositories")
    url = F.regexp_extract(F.coalesce("html_url", F.lit("")), r"^https?://[^/]+/([^/]+/[^/]+?)/*$", 1)
    code = F.when(url != "", 200).when(F.col("html_url").isNull(), 404).otherwise(403)
    return t.select(
        F.col("full_name").alias("referenced"), F.nullif(url, F.lit("")).alias("resolved"), "repo_id", "stars", "archived", code.alias("status_code"),
        X.identity_status(code, url, F.col("full_name")).alias("identity_status"), F.col("collected_at").alias("observed_at"), "ingest_seq",
    )


def downstream_sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """As graph.downstream_sets, made once."""
    made: list[DataFrame] = []

    def make() -> list[DataFrame]:
        if not made:
            made.extend(graph.downstream_sets(edges(s, d)))
        return made

    sets = once(s, d, "downstream_sets", lambda: make()[0])
    return sets, once(s, d, "downstream_numbers", lambda: make()[1])
