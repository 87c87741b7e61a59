"""Trust amplification, privileged blast radius, comparisons by type and owner, and evidence: joins of the metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.functions import stats
from refweave.operators import jobs
from refweave.plans import domain as D
from refweave.plans import graph_metrics as G
from refweave.plans import workflow_metrics as W

WF = G.WF
COMPONENT_TYPES = ("javascript", "docker", "composite", "reusable_workflow", "unknown")
#: A workflow is privileged if one of these ten holds.
PRIVILEGED = (
    "id_token_write", "contents_write", "actions_write", "packages_write", "deployments_write", "security_events_write", "write_all", "secrets_in_env", "secrets_in_with", "explicit_token",
)


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names]


def _risk_by_action(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "ref_risk_by_action", lambda: G.ref_risk_by_action(s, d))


def _risk_by_workflow(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "ref_risk_by_workflow", lambda: G.ref_risk_by_workflow(s, d))


def _blast(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "blast", lambda: G.blast_radius(s, d))


def _privilege(s: SparkSession, d: str) -> DataFrame:
    """Privilege of a workflow (all its versions together), keyed as the graph is."""
    w = W.privilege_by_workflow(s, d)
    return w.select(F.col("repository_full_name").alias(WF[0]), F.col("path").alias(WF[1]), *[c for c in w.columns if c not in W.WP])


def _propagation(s: SparkSession, d: str) -> DataFrame:
    """Propagation of a workflow, keyed as the graph is: of several versions that of the greatest sha, which comes last."""
    p = W.propagation_by_workflow(s, d)
    row = F.max_by(F.struct("channel_count", "privilege_coupling"), "sha").alias("r")
    return p.groupBy(F.col("repository_full_name").alias(WF[0]), F.col("path").alias(WF[1])).agg(row).select(*WF, "r.*")


def privileged_blast(s: SparkSession, d: str) -> DataFrame:
    """Per action: privileged, id-token and mutable-with-privilege workflows and repositories it stands in, with its blast radius and score."""
    D.keep_edges(s, d)
    w = _privilege(s, d).select(*WF, "privilege_score", "id_token_write", "mutable_with_privilege")
    e = D.scoped(s, d, "dst_node_id").select(F.col("dst_node_id").alias("action_id"), "workflow_id", *WF).distinct().join(w, WF)
    count = lambda c, x: F.count_distinct(F.when(c, F.col(x)))
    priv, token, mut = F.col("privilege_score") > 0, F.col("id_token_write"), F.col("mutable_with_privilege")
    hit = e.groupBy("action_id").agg(
        count(priv, "workflow_id").alias("privileged_workflows"), count(priv, WF[0]).alias("privileged_repos"), count(token, "workflow_id").alias("id_token_workflows"),
        count(token, WF[0]).alias("id_token_repos"), count(mut, "workflow_id").alias("mutable_privileged_workflows"), count(mut, WF[0]).alias("mutable_privileged_repos"),
    )
    known = D.actions(s, d).select("action_id", X.ref_category(F.col("ref")).alias("category"))
    b = known.join(_blast(s, d), "action_id", "left").join(hit, "action_id", "left")
    b = b.select("action_id", "category", *_zero("repos", "high_star_repos", "high_star_coverage", *[c for c in hit.columns if c != "action_id"]))
    score = 2 * F.col("privileged_repos") + 3 * F.col("id_token_workflows") + 2.5 * F.col("mutable_privileged_workflows") + 1.5 * F.col("high_star_repos") + F.col("high_star_coverage") / 1e6
    return b.withColumn("score", F.round(score, 4))


def privileged_blast_summary(s: SparkSession, d: str) -> DataFrame:
    b = privileged_blast(s, d)
    tops = stats.top_shares(b.select("action_id", F.col("privileged_repos").cast("double").alias("x")), "x", [1, 10, 100], ["action_id"])
    some = [F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in ("privileged_repos", "id_token_repos", "mutable_privileged_workflows")]
    base = b.agg(F.count("*").alias("actions"), *some, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("privileged_repos", "id_token_repos")])
    return base.crossJoin(tops.select(*[F.round(c, 6).alias(c) for c in tops.columns]))  # one row each


def trust_amplification_by_entity(s: SparkSession, d: str) -> DataFrame:
    """What is trusted through one owner or publisher: every action counts for its owner, for the platform's or the third
    parties' owners, and for its marketplace entry and badge where there is one."""
    D.keep_edges(s, d)
    a = D.actions(s, d).select("action_id", "owner", "repo", F.lower("owner").alias("m_owner"), F.lower("repo").alias("m_repo")).join(D.marketplace(s, d), ["m_owner", "m_repo"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat_ws("/", "owner", "repo"))
    named = lambda name, kind: F.struct(name.alias("entity"), F.lit(kind).alias("kind"))
    kinds = F.array_compact(F.array(
        named(F.col("owner"), "owner"), F.when(F.col("m_owner").isin(*X.PLATFORM_OWNERS), named(F.col("owner"), "github_owned")).otherwise(named(F.col("owner"), "third_party_owner")),
        F.when(F.col("verified_creator").isNotNull(), named(title, "marketplace_publisher")), F.when(F.col("verified_creator"), named(title, "verified_creator")),
    ))
    entities = D.once(s, d, "trust_entities_of", lambda: a.select("action_id", F.explode(kinds).alias("e")).select("action_id", "e.*"))
    use = _risk_by_action(s, d).select("action_id", "usage_count", "mutable_ratio").join(_blast(s, d), "action_id", "left")
    use = use.select("action_id", "usage_count", "mutable_ratio", *_zero("repos", "high_star_repos"))
    n, m = F.col("usage_count"), F.col("mutable_ratio")
    sums = entities.join(use, "action_id").groupBy("entity", "kind").agg(
        F.count_distinct("action_id").alias("actions"), F.sum(n).alias("usage"), F.sum("high_star_repos").alias("high_star_repos"), F.sum(F.when(m > 0, n).otherwise(0)).alias("mutable_usage"),
        X.rate(F.sum(m * n), F.sum(n)).alias("ratio"), F.sum("repos").cast("double").alias("blast_sum"), F.max("repos").cast("double").alias("blast_max"),
    )
    w = _privilege(s, d).select(*WF, (F.col("privilege_score") > 0).alias("priv"), F.col("id_token_write").alias("token"))
    seen = D.scoped(s, d, "dst_node_id").select(F.col("dst_node_id").alias("action_id"), "workflow_id", *WF).distinct().join(w, WF, "left").join(entities, "action_id")
    sets = seen.groupBy("entity", "kind").agg(
        F.count_distinct(WF[0]).alias("repositories"), F.count_distinct("workflow_id").alias("workflows"), F.count_distinct(F.when(F.col("priv"), F.col("workflow_id"))).alias("privileged_workflows"),
        F.count_distinct(F.when(F.col("token"), F.col("workflow_id"))).alias("id_token_workflows"),
    )
    out = sums.join(sets, ["entity", "kind"], "left").select(*sums.columns, *_zero(*sets.columns[2:]))
    score = 1.5 * F.col("repositories") + 25.0 * F.col("ratio") + 2.0 * F.col("privileged_workflows") + 3.0 * F.col("id_token_workflows") + F.col("actions") + 0.1 * F.col("blast_sum")
    return out.withColumn("trust_amplification_score", F.round(score, 4)).withColumn("mutable_ratio", F.round("ratio", 4)).drop("ratio")


def _entities(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "trust_amplification", lambda: trust_amplification_by_entity(s, d))


def trust_amplification_summary(s: SparkSession, d: str) -> DataFrame:
    """One row: entities, and how concentrated use is on owners."""
    e = _entities(s, d)
    o = e.where("kind = 'owner'").select("entity", F.col("usage").cast("double").alias("x"))
    tops = stats.top_shares(o, "x", [1, 5, 10], ["entity"])
    gini = stats.gini(o, "x", ["entity"]).select(F.round("gini", 4).alias("gini"))
    base = e.agg(F.count("*").alias("entities"), F.count_if(F.col("kind") == "owner").alias("owners"))
    return base.crossJoin(tops.select(*[F.round(c, 6).alias(c) for c in tops.columns])).crossJoin(gini).crossJoin(o.agg(F.round(stats.hhi(F.col("x")), 4).alias("hhi")))  # one row each


def trust_top_entities(s: SparkSession, d: str) -> DataFrame:
    """The 100 entities of the highest score."""
    order = [F.desc("trust_amplification_score"), F.desc("repositories"), F.desc("usage"), F.desc(F.lower("entity")), "kind"]
    return _entities(s, d).orderBy(*order).limit(100).select("entity", "kind", "trust_amplification_score", "repositories", "usage")


def component_types(s: SparkSession, d: str) -> DataFrame:
    """All five component types, empty ones too: use (mean over used ones), downstream, fan-out, privilege; other types are unknown."""
    kind = F.when(F.col("action_type").isin(*COMPONENT_TYPES), F.col("action_type")).otherwise("unknown")
    a = D.actions(s, d).select("action_id", kind.alias("action_type"))
    r = _risk_by_action(s, d).select("action_id", "usage_count", "mutable_ratio", "downstream_repos")
    m = D.once(s, d, "amplification", lambda: G.amplification_by_node(s, d)).where("node_kind = 'action'").select(F.col("node_id").alias("action_id"), "fanout", "max_depth")
    p = privileged_blast(s, d).select("action_id", "privileged_repos", "id_token_repos", "mutable_privileged_workflows", "score")
    n = F.col("usage_count")
    per = a.join(r, "action_id", "left").join(m, "action_id", "left").join(p, "action_id", "left").groupBy("action_type").agg(
        F.count("*").alias("actions"), F.sum(n).alias("usage"), F.round(F.avg(F.nullif(n, F.lit(0))), 4).alias("avg_usage"), F.round(F.avg("downstream_repos"), 4).alias("avg_downstream"),
        F.round(F.avg(F.coalesce("fanout", F.lit(0))), 4).alias("avg_fanout"), F.round(F.avg(F.coalesce("max_depth", F.lit(0))), 4).alias("avg_max_depth"), F.round(X.rate(F.sum(F.col("mutable_ratio") * n), F.sum(n)), 6).alias("mutable_ratio"),
        *[F.sum(c).alias(c) for c in ("privileged_repos", "id_token_repos", "mutable_privileged_workflows")], F.round(F.avg("score"), 4).alias("avg_score"),
    )
    grid = s.createDataFrame([(k,) for k in COMPONENT_TYPES], "action_type string").join(per, "action_type", "left")
    whole = ("actions", "usage", "privileged_repos", "id_token_repos", "mutable_privileged_workflows")
    return grid.select("action_type", *_zero(*whole), "avg_usage", "avg_downstream", "avg_fanout", "avg_max_depth", F.coalesce("mutable_ratio", F.lit(0.0)).alias("mutable_ratio"), "avg_score")


def ref_type_comparison(s: SparkSession, d: str) -> DataFrame:
    """All eight categories: actions, their use and drift; workflows with any such reference, how many of them are privileged or coupled."""
    a = _risk_by_action(s, d).groupBy("category").agg(
        F.count("*").alias("actions"), F.sum("usage_count").alias("usage"), F.round(F.avg("usage_count"), 4).alias("avg_usage"), F.round(F.avg("downstream_repos"), 4).alias("avg_downstream"),
        F.count_if("observed_drift").alias("drift_actions"), F.round(F.count_if("observed_drift") / F.count("*"), 6).alias("drift_ratio"),
    )
    privileged = F.col(PRIVILEGED[0])
    for c in PRIVILEGED[1:]:
        privileged = privileged | F.col(c)
    p = _privilege(s, d).select(*WF, privileged.alias("privileged"), F.col("mutable_with_privilege").alias("coupled"))
    w = _risk_by_workflow(s, d).join(p, WF, "left").join(_propagation(s, d).select(*WF, "privilege_coupling"), WF, "left")
    has = F.explode(F.array_compact(F.array(*[F.when(F.col(k.lower()) > 0, F.lit(k)) for k in X.REF_CATEGORIES])))
    per = w.select(has.alias("category"), "privileged", "coupled", "privilege_coupling").groupBy("category").agg(
        F.count("*").alias("workflows"), F.count_if("privileged").alias("privileged_workflows"), F.count_if("coupled").alias("privilege_coupled"), F.count_if("privilege_coupling").alias("propagation_coupled")
    )
    grid = s.createDataFrame([(k,) for k in X.REF_CATEGORIES], "category string").join(a, "category", "left").join(per, "category", "left")
    whole = ("actions", "usage", "drift_actions", "workflows", "privileged_workflows", "privilege_coupled", "propagation_coupled")
    return grid.select("category", *_zero(*whole), "avg_usage", "avg_downstream", F.coalesce("drift_ratio", F.lit(0.0)).alias("drift_ratio"))


def workflow_evidence(s: SparkSession, d: str) -> DataFrame:
    """Trust boundaries with reference risk, privilege and propagation of the same workflow: four sides, left-joined."""
    r = _risk_by_workflow(s, d).select(*WF, F.col("mutable_ratio"), "high_risk_ratio", "observed_drift")
    p = _privilege(s, d).select(*WF, "privilege_score", "id_token_write", "mutable_with_privilege")
    t = G.trust_boundaries(s, d).select(*WF, "has_external_owner", "has_multi_owner_cascade", "owners", "max_depth")
    return t.join(r, WF, "left").join(p, WF, "left").join(_propagation(s, d), WF, "left")


def lift_cross_same(s: SparkSession, d: str) -> DataFrame:
    """Workflows that depend on other owners against those that do not, both always there."""
    e = D.once(s, d, "workflow_evidence", lambda: workflow_evidence(s, d))
    flags = {"with_drift": "observed_drift", "with_id_token": "id_token_write", "with_coupled_mutability": "mutable_with_privilege", "with_propagation_coupling": "privilege_coupling", "with_multi_owner_cascade": "has_multi_owner_cascade"}
    means = ("max_depth", "owners", "mutable_ratio", "high_risk_ratio", "channel_count", "privilege_score")
    per = e.groupBy(F.when(F.col("has_external_owner"), "cross").otherwise("same").alias("scope")).agg(
        F.count("*").alias("workflows"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in means]
    )
    grid = s.createDataFrame([("cross",), ("same",)], "scope string").join(per, "scope", "left")
    return grid.select("scope", *_zero("workflows", *flags), *[f"avg_{c}" for c in means])


EFFECTS = ("mutable_ratio", "privilege_score", "channel_count")


def _effects(s: SparkSession, d: str) -> DataFrame:
    e = D.once(s, d, "workflow_evidence", lambda: workflow_evidence(s, d))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in EFFECTS]))
    return e.select("has_external_owner", *WF, cells.alias("m")).select("m.*", "has_external_owner", *WF).where("value is not null")


def cross_owner_effects(s: SparkSession, d: str) -> DataFrame:
    """Means of three measures for workflows with and without direct cross-owner dependencies, and their difference."""
    cross, same = F.when(F.col("has_external_owner"), F.col("value")), F.when(~F.col("has_external_owner"), F.col("value"))
    per = _effects(s, d).groupBy("metric").agg(
        F.count(cross).alias("cross_count"), F.count(same).alias("same_count"), F.round(F.avg(cross), 6).alias("cross_mean"), F.round(F.avg(same), 6).alias("same_mean"), F.round(F.avg(cross) - F.avg(same), 6).alias("difference")
    )
    return s.createDataFrame([(m,) for m in EFFECTS], "metric string").join(per, "metric", "left").select("metric", *_zero("cross_count", "same_count"), "cross_mean", "same_mean", "difference")


def cross_owner_intervals(s: SparkSession, d: str) -> DataFrame:
    """The differences of cross_owner_effects with their 95 % bootstrap intervals, 500 draws from one seed."""
    return stats.bootstrap_difference(_effects(s, d), "metric", "value", "has_external_owner", WF)


def cross_owner_scalable(s: SparkSession, d: str) -> DataFrame:
    """The same intervals by Poisson resampling in SQL, with no group gathered."""
    return stats.bootstrap_differences(_effects(s, d), "metric", "value", "has_external_owner", iterations=50)


def _indicators(s: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)

    def rows(df: DataFrame, name: str, value, ident: list[str]) -> DataFrame:
        return df.select(F.lit(name).alias("indicator"), value.cast("double").alias("value"), F.concat_ws("|", *ident).alias("ident"))

    parts = [
        rows(G.implicit_ratio(s, d), "non_zero_implicit_dependency_ratio", one(F.col("implicit_count") > 0), WF),
        rows(_risk_by_workflow(s, d), "mutable_ref_ratio_per_workflow", F.col("mutable_ratio"), WF),
        rows(W.privilege_by_job(s, d), "isolation_privilege_coupling_ratio_per_job", one(F.col("isolation_coupling")), [*jobs.KEY, "job_id"]),
        rows(W.propagation_by_workflow(s, d), "privilege_propagation_coupling_ratio_per_workflow", one(F.col("privilege_coupling")), jobs.KEY),
        rows(G.trust_boundaries(s, d), "external_owner_dependency_ratio_per_workflow", one(F.col("has_external_owner")), WF),
        rows(_risk_by_action(s, d), "observed_drift_ratio_per_action", one(F.col("observed_drift")), ["action_id"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def indicator_points(s: SparkSession, d: str) -> DataFrame:
    """The point estimates and sample counts of the seven indicators, without their intervals."""
    means = _indicators(s, d).groupBy("indicator").agg(F.count("*").alias("sample_count"), F.round(F.avg("value"), 6).alias("estimate"))
    o = _entities(s, d).where("kind = 'owner'").select("entity", F.col("usage").cast("double").alias("x"))
    top = stats.top_shares(o, "x", [10], ["entity"]).crossJoin(o.agg(F.count("*").alias("n")))  # one row each
    return means.unionByName(top.select(F.lit("top10_owner_usage_share").alias("indicator"), F.col("n").alias("sample_count"), F.round("top_10_share", 6).alias("estimate")))


def bootstrap_indicators(s: SparkSession, d: str) -> DataFrame:
    """Seven indicators with 95 % bootstrap intervals, 500 draws from one seed."""
    means = stats.bootstrap(_indicators(s, d), "indicator", "value", ["ident"])
    owners = _entities(s, d).where("kind = 'owner'").select(F.lit("top10_owner_usage_share").alias("indicator"), F.col("usage").cast("double").alias("value"), F.col("entity").alias("ident"))
    return means.unionByName(stats.bootstrap(owners, "indicator", "value", ["ident"], top_k=10))


def bootstrap_scalable(s: SparkSession, d: str) -> DataFrame:
    """The same means by Poisson resampling in SQL, with no group gathered."""
    return stats.bootstrap_means(_indicators(s, d), "indicator", "value", iterations=50)


def manual_validation(s: SparkSession, d: str) -> DataFrame:
    """Up to 50 workflows to look at for privilege and 50 for propagation, with reasons, signals and the job of the highest score."""
    w = W.privilege_by_workflow(s, d)
    best = F.max(F.struct("privilege_score", "sha", "job_id")).alias("t")
    top_job = W.privilege_by_job(s, d).groupBy(*W.WP).agg(best).select(*W.WP, F.col("t.job_id").alias("top_job"), F.col("t.privilege_score").alias("top_job_score"))
    named = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))
    c = F.col
    why3 = named(
        ("mixed_trust_with_privilege", c("isolation_coupling")), ("mutable_third_party_with_privilege", c("mutable_with_privilege")), ("pull_request_target", c("pull_request_target")),
        ("id_token_write", c("id_token_write")), ("secret_bearing_configuration", c("secrets_in_env") | c("secrets_in_with")),
    )
    a = w.withColumn("r", why3).where("size(r) > 0").orderBy(F.desc("privilege_score"), *W.WP).limit(50).join(top_job, W.WP, "left")
    a = a.select(F.lit("RQ3").alias("label"), *W.WP, F.array_join("r", ",").alias("reasons"), c("privilege_score").alias("score"), "top_job", "top_job_score", c("privileged_jobs").alias("signals"))
    why4 = named(
        ("privilege_propagation_coupling", c("privilege_coupling")), ("mutable_to_downstream_propagation", c("mutable_downstream")), ("artifact_roundtrip", c("artifact_upload") & c("artifact_download")),
        ("workflow_run_trigger", c("on_workflow_run")), ("workflow_level_reuse", c("on_workflow_call") | c("reusable_call")),
    )
    p = W.propagation_by_workflow(s, d).withColumn("r", why4).where("size(r) > 0").orderBy(F.desc("propagation_score"), *W.WP, "sha").limit(50)
    none = lambda t: F.lit(None).cast(t)
    b = p.select(F.lit("RQ4").alias("label"), *W.WP, F.array_join("r", ",").alias("reasons"), c("propagation_score").alias("score"), none("string").alias("top_job"), none("double").alias("top_job_score"), c("channel_count").cast("long").alias("signals"))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (
    privileged_blast, privileged_blast_summary, trust_amplification_by_entity, trust_amplification_summary, trust_top_entities, component_types, ref_type_comparison, workflow_evidence,
    lift_cross_same, cross_owner_effects, cross_owner_intervals, cross_owner_scalable, indicator_points, bootstrap_indicators, bootstrap_scalable, manual_validation,
)}
