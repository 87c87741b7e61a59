"""Data sets behind figures and tables: small queries over the metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.functions import stats
from refweave.plans import comparisons as C
from refweave.plans import domain as D
from refweave.plans import graph_metrics as G
from refweave.plans import oracle as O
from refweave.plans import temporal_metrics as M
from refweave.plans import workflow_metrics as W


def binding_by_depth(s: SparkSession, d: str) -> DataFrame:
    """Mean shares of sha, tag, branch and main bindings by the workflow's depth."""
    c = G.cascade_depth(s, d)
    return c.groupBy(X.depth_bucket(F.col("max_depth")).alias("bucket")).agg(F.count("*").alias("workflows"), *[F.round(F.avg(f"{k}_rate"), 6).alias(k) for k in ("sha", "tag", "branch", "main")])


def lag_by_mode(s: SparkSession, d: str) -> DataFrame:
    """Update windows counted by mode and depth with mean and median lag."""
    u = D.once(s, d, "updates", lambda: M.update_windows(s, d)).select("mode", "bucket", "lag_hours")
    return u.groupBy("mode", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("lag_hours"), 4).alias("avg_hours"), F.round(F.median("lag_hours"), 4).alias("median_hours"))


def discovery_top(s: SparkSession, d: str) -> DataFrame:
    return W.discovery_candidates(s, d).where("score > 0").orderBy(F.desc("score"), F.desc("repos"), F.desc("usage"), F.desc("name")).limit(15).select("name", "score", "kind")


def category_counts(s: SparkSession, d: str) -> DataFrame:
    """References per category in fixed order, empty ones too."""
    c = D.once(s, d, "categorized", lambda: G.categorized(s, d)).groupBy("category").agg(F.count("*").alias("n"))
    grid = s.createDataFrame([(i, k) for i, k in enumerate(X.REF_CATEGORIES)], "place int, category string")
    return grid.join(c, "category", "left").select(F.col("place").cast("long").alias("place"), "category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row per flag: how many rows have it, and the share."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(f).alias(f) for f in flags])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags]))
    return row.select("_n", pairs.alias("p")).select("p.flag", "p.n", F.round(X.rate(F.col("p.n"), F.col("_n")), 6).alias("rate"))


def isolation_signals(s: SparkSession, d: str) -> DataFrame:
    return _counts(W.isolation_by_job(s, d), ["mixed_domains", "action_before_sensitive", "untrusted_before_sensitive", "env_signal", "output_signal", "file_signal"])


def isolation_histogram(s: SparkSession, d: str) -> DataFrame:
    return W.isolation_by_job(s, d).groupBy("domains").agg(F.count("*").alias("jobs"))


def privilege_signals(s: SparkSession, d: str) -> DataFrame:
    return _counts(W.privilege_by_job(s, d), ["id_token_write", "contents_write", "actions_write", "packages_write", "deployments_write", "security_events_write", "write_all", "isolation_coupling"])


def id_token_by_depth(s: SparkSession, d: str) -> DataFrame:
    w = W.privilege_by_workflow(s, d)
    return w.groupBy(X.depth_bucket(F.col("max_depth")).alias("bucket")).agg(F.count("*").alias("workflows"), F.round(F.count_if("id_token_write") / F.count("*"), 6).alias("id_token_rate"))


def _bucket(c: Column, last: int) -> Column:
    return F.when(c >= last, F.lit(f"{last}+")).otherwise(c.cast("string"))


def channel_buckets(s: SparkSession, d: str) -> DataFrame:
    """Workflows by number of channels, 0 to 4+, all five in order."""
    per = W.propagation_by_workflow(s, d).groupBy(_bucket(F.col("channel_count"), 4).alias("bucket")).agg(F.count("*").alias("workflows"))
    return s.createDataFrame([(k,) for k in ("0", "1", "2", "3", "4+")], "bucket string").join(per, "bucket", "left").withColumn("workflows", F.coalesce("workflows", F.lit(0).cast("long")))


def channels_by_job_depth(s: SparkSession, d: str) -> DataFrame:
    p = W.propagation_by_workflow(s, d)
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return p.groupBy(_bucket(F.col("max_job_depth"), 2).alias("bucket")).agg(F.count("*").alias("workflows"), share(F.col("artifact_upload") | F.col("artifact_download")).alias("artifact_rate"), share(F.col("cache")).alias("cache_rate"))


def propagation_signals(s: SparkSession, d: str) -> DataFrame:
    return _counts(W.propagation_by_workflow(s, d), ["artifact_upload", "artifact_download", "cache", "job_outputs", "needs_outputs", "reusable_call"])


def reach_histogram(s: SparkSession, d: str) -> DataFrame:
    a = D.once(s, d, "amplification", lambda: G.amplification_by_node(s, d)).where("node_kind = 'action'")
    return a.groupBy("max_depth", (F.floor(F.col("fanout") / 100) * 100).alias("fanout_from")).agg(F.count("*").alias("nodes"))


def top_amplifiers(s: SparkSession, d: str) -> DataFrame:
    a = D.once(s, d, "amplification", lambda: G.amplification_by_node(s, d)).where("node_kind = 'action'")
    order = [F.desc("cascade_radius"), F.desc("fanout"), F.desc("reached_high_star"), F.desc("node_id")]
    return a.orderBy(*order).limit(100).select("node_id", "cascade_radius", "fanout", "betweenness_like")


def top_owners(s: SparkSession, d: str) -> DataFrame:
    return C._entities(s, d).where("kind = 'owner'").orderBy(F.desc("usage"), "entity").limit(15).select("entity", "usage", "repositories")


def callee_histogram(s: SparkSession, d: str) -> DataFrame:
    return W.reusable_callees(s, d).groupBy("repositories").agg(F.count("*").alias("callees"))


def top_privileged(s: SparkSession, d: str) -> DataFrame:
    return C.privileged_blast(s, d).orderBy(F.desc("score"), F.desc("privileged_repos"), "action_id").limit(10).select("action_id", "score", "privileged_workflows", "id_token_workflows")


def owner_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of usage of the top 1, 5 and 10 owners."""
    o = C._entities(s, d).where("kind = 'owner'").select("entity", F.col("usage").cast("double").alias("x"))
    t = stats.top_shares(o, "x", [1, 5, 10], ["entity"])
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


def headline(s: SparkSession, d: str) -> DataFrame:
    """One number for each of five questions."""
    def cell(df: DataFrame, label: str, value: Column) -> DataFrame:
        return df.agg(F.lit(label).alias("question"), F.round(value.cast("double"), 6).alias("value"))

    n = F.count("*")
    parts = [
        cell(G.implicit_ratio(s, d), "RQ1 workflows with implicit dependencies", X.rate(F.count_if(F.col("implicit_count") > 0), n)),
        cell(D.once(s, d, "categorized", lambda: G.categorized(s, d)), "RQ2 mutable bindings", X.rate(F.count_if(X.is_mutable(F.col("category"))), n)),
        cell(W.isolation_by_job(s, d), "RQ3 untrusted before sensitive", X.rate(F.count_if("untrusted_before_sensitive"), n)),
        cell(W.propagation_by_workflow(s, d), "RQ4 workflows with channels", X.rate(F.count_if(F.col("channel_count") > 0), n)),
        cell(D.once(s, d, "blast", lambda: G.blast_radius(s, d)), "RQ5 actions reaching a tenth of repositories", X.rate(F.count_if(F.col("repos") > 0.1 * F.lit(D.repository_names(s, d).count())), n)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def representative_cases(s: SparkSession, d: str) -> DataFrame:
    """The workflow that stands out in each of three questions."""
    def top(df: DataFrame, label: str, keys: list[str], value: str) -> DataFrame:
        best = F.max_by(F.struct(*[F.col(k).alias(n) for k, n in zip(keys, ("repository", "path"))]), F.struct(F.col(value), *keys))
        return df.agg(best.alias("b"), F.max(value).cast("double").alias("value")).select(F.lit(label).alias("question"), "b.*", "value")

    a = top(G.implicit_ratio(s, d), "RQ1", G.WF, "implicit_ratio")
    b = top(W.privilege_by_workflow(s, d), "RQ3", W.WP, "privilege_score")
    c = top(W.propagation_by_workflow(s, d), "RQ4", W.WP, "propagation_score")
    return a.unionByName(b).unionByName(c)


QUERIES = {f.__name__: f for f in (
    binding_by_depth, lag_by_mode, discovery_top, category_counts, isolation_signals, isolation_histogram, privilege_signals, id_token_by_depth, channel_buckets,
    channels_by_job_depth, propagation_signals, reach_histogram, top_amplifiers, top_owners, callee_histogram, top_privileged, owner_coverage, headline, representative_cases,
)}

_CASCADE = O.ORACLE["cascade_depth"]
ORACLE = {
    "binding_by_depth": f"select {O.bucket('max_depth')} as bucket, count(*) as workflows, round(avg(sha_rate), 6) as sha, round(avg(tag_rate), 6) as tag, round(avg(branch_rate), 6) as branch, round(avg(main_rate), 6) as main from ({_CASCADE}) group by 1",
    "lag_by_mode": O.q(O.UPDATES, "select mode, bucket, count(*) as n, round(avg(lag_hours), 4) as avg_hours, round(median(lag_hours), 4) as median_hours from uw group by 1, 2"),
    "category_counts": O.q(O.CAT, f"select i::bigint as place, g.category, count(cw.category) as n from (values {', '.join(f'({i}, {k!r})' for i, k in enumerate(O.REF_CATEGORIES))}) g(i, category) left join cw using (category) group by 1, 2"),
    "reach_histogram": O.q(O.AMP, "select max_depth, cast(floor(fanout / 100) * 100 as bigint) as fanout_from, count(*) as nodes from am where node_kind = 'action' group by 1, 2"),
    "top_amplifiers": O.q(O.AMP, "select node_id, cascade_radius, fanout, betweenness_like from am where node_kind = 'action' order by cascade_radius desc, fanout desc, reached_high_star desc, node_id desc limit 100"),
}
