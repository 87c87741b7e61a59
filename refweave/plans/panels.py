"""The data of the figures as rows (panel, label, value): counts, rates and top lists over the metric tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.plans import comparisons as C
from refweave.plans import domain as D
from refweave.plans import graph_metrics as G
from refweave.plans import workflow_metrics as W
from refweave.plans.oracle import AMP_NODES, DISCOVERY, IMPLICIT, REACH, RISK, WF, bucket, q
from refweave.plans.oracle_comparisons import PRIV, TRUST
from refweave.plans.oracle_comparisons import ORACLE as _COMPARED
from refweave.plans.oracle_files import CALLS, CHANNELS, FILES
from refweave.plans.oracle_files import ORACLE as _CALLED


def _rows(df: DataFrame, panel: str, label: str, value: str) -> DataFrame:
    return df.select(F.lit(panel).alias("panel"), F.expr(label).cast("string").alias("label"), F.round(F.expr(value).cast("double"), 6).alias("value"))


def _count(df: DataFrame, panel: str, label: str) -> DataFrame:
    return _rows(df.groupBy(F.expr(label).cast("string").alias("_l")).agg(F.count("*").alias("_n")), panel, "_l", "_n")


def _top(df: DataFrame, panel: str, label: str, value: str, k: int, *then: str) -> DataFrame:
    """The k rows of the greatest value, ties by further columns in descending order, then by label."""
    order = [F.desc(F.expr(value)), *[F.desc(F.expr(t)) for t in then], F.expr(label)]
    return _rows(df.orderBy(*order).limit(k), panel, label, value)


def _rates(df: DataFrame, panel: str, flags: list[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("_all"), *[F.count_if(F.expr(f)).alias(f"_{i}") for i, f in enumerate(flags)])
    pairs: list[Column] = [F.struct(F.lit(f).alias("l"), X.rate(F.col(f"_{i}"), F.col("_all")).alias("v")) for i, f in enumerate(flags)]
    return _rows(row.select(F.explode(F.array(*pairs)).alias("p")), panel, "p.l", "p.v")


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_count(table: str, panel: str, label: str, where: str = "true") -> str:
    return f"select '{panel}' as panel, ({label})::varchar as label, count(*)::double as value from {table} where {where} group by 2"


def _sql_rows(table: str, panel: str, label: str, value: str, where: str = "true") -> str:
    return f"select '{panel}' as panel, ({label})::varchar as label, round(({value})::double, 6) as value from {table} where {where}"


def _sql_top(table: str, panel: str, label: str, value: str, k: int, *then: str, where: str = "true") -> str:
    order = ", ".join([f"{value} desc", *[f"{t} desc" for t in then], label])
    return f"select * from (select '{panel}' as panel, ({label})::varchar as label, round(({value})::double, 6) as value from {table} where {where} order by {order} limit {k})"


def _sql_rates(table: str, panel: str, flags: list[str]) -> str:
    return " union all ".join(f"select '{panel}' as panel, '{f}' as label, round(case when count(*) > 0 then count(*) filter (where {f}) / count(*) else 0 end, 6)::double as value from {table}" for f in flags)


_JOB = "concat_ws('/', repository_full_name, path, sha, job_id)"
_FILE, _VERSION = "concat_ws('/', repository_full_name, path)", "concat_ws('/', repository_full_name, path, sha)"
_ISOLATION = ["uses_steps >= 2", "mixed_domains", "untrusted_before_sensitive", "env_signal", "file_signal"]
_PRIVILEGE = ["contents_write", "id_token_write", "secrets_in_with", "mutable_with_privilege", "isolation_coupling"]
_CHANNELS = ["artifact_upload", "artifact_download", "cache", "needs_outputs", "reusable_call", "privilege_coupling"]
_CALLS = ["is_remote", "is_mutable", "is_cross_org", "is_third_party", "inherits_secrets", "id_token_write"]


def discovery_panel(s: SparkSession, d: str) -> DataFrame:
    c = D.once(s, d, "discovery", lambda: W.discovery_candidates(s, d))
    return _all(_top(c.where("score > 0"), "top", "name", "score", 15, "repos", "usage"), _count(c.where("kind <> 'none'"), "kinds", "kind"))


def ref_risk_panel(s: SparkSession, d: str) -> DataFrame:
    r, a = D.once(s, d, "ref_risk_by_depth", lambda: G.ref_risk_by_depth(s, d)), C._risk_by_action(s, d)
    return _all(
        _rows(r, "mutable by depth", "bucket", "mutable_refs"), _rows(r, "high risk by depth", "bucket", "high_risk_ratio"), _count(a.where("observed_drift"), "drifted", "category"),
        _top(a.where("mutable_refs > 0"), "top mutable", "action_id", "risk_score", 15, "downstream_repos", "usage_count"),
    )


def isolation_panel(s: SparkSession, d: str) -> DataFrame:
    i = W.isolation_by_job(s, d)
    return _all(_count(i, "domains", "domains"), _top(i.where("untrusted_before_sensitive"), "top untrusted", _JOB, "signal_score", 15, "third_party_steps"))


def privilege_panel(s: SparkSession, d: str) -> DataFrame:
    j, w = W.privilege_by_job(s, d), W.privilege_by_workflow(s, d)
    return _all(_count(j.where("movable_actions > 0"), "movable", "movable_actions"), _top(w.where("mutable_with_privilege"), "top mutable", _FILE, "privilege_score", 15))


def propagation_panel(s: SparkSession, d: str) -> DataFrame:
    p = W.propagation_by_workflow(s, d)
    return _all(_count(p, "channels", "channel_count"), _count(p, "job depth", "max_job_depth"), _top(p.where("privilege_coupling"), "top coupled", _VERSION, "propagation_score", 15))


def amplification_panel(s: SparkSession, d: str) -> DataFrame:
    a = D.once(s, d, "amplification", lambda: G.amplification_by_node(s, d)).where("node_kind = 'action'")
    return _all(_count(a, "depth and reach", "concat_ws(' ', max_depth, fanout)"), _top(a, "top radius", "node_id", "cascade_radius", 15, "fanout"))


def trust_panel(s: SparkSession, d: str) -> DataFrame:
    o = C._entities(s, d).where("kind = 'owner'")
    return _all(*[_top(o, n, "entity", v, 15) for n, v in (("usage", "usage"), ("blast", "blast_sum"), ("mutable", "mutable_ratio"))], _top(o.where("privileged_workflows > 0"), "coupled", "entity", "trust_amplification_score", 15))


def reusable_panel(s: SparkSession, d: str) -> DataFrame:
    c, e = W._calls(s, d), W.reusable_callees(s, d)
    return _all(_top(e, "top callees", "callee", "repositories", 15, "calls"), _count(c, "reference kinds", "ref_type"), _top(e.where("inherits_secrets > 0"), "top inheriting", "callee", "inherits_secrets", 15))


def privileged_panel(s: SparkSession, d: str) -> DataFrame:
    b = D.once(s, d, "privileged_blast", lambda: C.privileged_blast(s, d))
    return _all(_top(b, "top", "action_id", "score", 10, "privileged_repos"), _count(b, "downstream", "concat_ws(' ', repos, privileged_workflows, id_token_workflows)"))


def component_panel(s: SparkSession, d: str) -> DataFrame:
    c = D.once(s, d, "component_types", lambda: C.component_types(s, d))
    return _all(*[_rows(c, m, "action_type", m) for m in ("avg_usage", "avg_downstream", "avg_score")])


def stratified_panel(s: SparkSession, d: str) -> DataFrame:
    r, x, p = C.ref_type_comparison(s, d), C.lift_cross_same(s, d), W.call_profile(s, W._calls(s, d, every=True))
    return _all(
        _rows(r, "coupled by category", "category", "privilege_coupled"), *[_rows(x, m, "scope", m) for m in ("avg_mutable_ratio", "avg_privilege_score", "avg_channel_count")],
        *[_rows(p, m, "stratum", m) for m in ("is_mutable_share", "inherits_secrets_share", "id_token_write_share")],
    )


_DEPTH = "case when max_depth >= 3 then '3+' else cast(max_depth as string) end"


def dependency_panel(s: SparkSession, d: str) -> DataFrame:
    i, c = G.implicit_ratio(s, d), G.cascade_depth(s, d)
    return _all(_rates(i, "implicit", ["implicit_count > 0"]), _count(c, "depth", _DEPTH), _top(i, "top ratio", f"concat_ws('/', {WF})", "implicit_ratio", 8, "total_count"))


def execution_panel(s: SparkSession, d: str) -> DataFrame:
    w = W.privilege_by_workflow(s, d)
    return _all(_rates(W.isolation_by_job(s, d), "isolation", _ISOLATION), _rates(W.privilege_by_job(s, d), "privilege", _PRIVILEGE), _top(w, "top privilege", _FILE, "privilege_score", 8))


_BUCKET = "case when channel_count >= 4 then '4+' else cast(channel_count as string) end"


def channel_panel(s: SparkSession, d: str) -> DataFrame:
    p = W.propagation_by_workflow(s, d)
    return _all(_rates(p, "channels", _CHANNELS), _rates(W._calls(s, d), "calls", _CALLS), _count(p, "buckets", _BUCKET))


_LIFTS = ("avg_mutable_ratio", "avg_high_risk_ratio", "avg_privilege_score", "avg_channel_count")


def lift_panel(s: SparkSession, d: str) -> DataFrame:
    """Cross-owner over same-owner on four measures (0 where there is nothing to divide by), and the owners' coverage."""
    x = C.lift_cross_same(s, d)
    one = x.agg(*[F.max(F.when(F.col("scope") == k, F.col(m))).alias(f"{m}_{k}") for m in _LIFTS for k in ("cross", "same")])
    cells = F.array(*[F.struct(F.lit(m).alias("l"), X.rate(F.col(f"{m}_cross"), F.col(f"{m}_same")).alias("v")) for m in _LIFTS])
    lifts = _rows(one.select(F.explode(cells).alias("p")), "lift", "p.l", "coalesce(p.v, 0)")
    t = D.once(s, d, "trust_summary", lambda: C.trust_amplification_summary(s, d))
    return _all(lifts, *[_rows(t, "owner coverage", f"'{c}'", c) for c in ("top_1_share", "top_5_share", "top_10_share")])


QUERIES: dict[str, Callable] = {f.__name__: f for f in (
    discovery_panel, ref_risk_panel, isolation_panel, privilege_panel, propagation_panel, amplification_panel, trust_panel, reusable_panel, privileged_panel, component_panel, stratified_panel,
    dependency_panel, execution_panel, channel_panel, lift_panel,
)}


def _u(*parts: str) -> str:
    return " union all ".join(parts)


_COMPONENTS, _TYPES, _LIFT, _PROFILE, _OWNER = (f"({x})" for x in (_COMPARED["component_types"], _COMPARED["ref_type_comparison"], _COMPARED["lift_cross_same"], _CALLED["reusable_profile"], _COMPARED["trust_amplification_summary"]))
_ALL_PROFILE = _PROFILE.replace(" and length(u) % 3 = 0", "")  # every reference is called by its local path as well
ORACLE = {
    "discovery_panel": q(DISCOVERY, _u(_sql_top("dd", "top", "name", "score", 15, "repos", "usage", where="score > 0"), _sql_count("dd", "kinds", "kind", "kind <> 'none'"))),
    "ref_risk_panel": q(RISK + f"""dv as (select g.bucket, coalesce(m, 0) as m, coalesce(h, 0) as h from (values ('level_1'), ('level_2'), ('level_3_plus')) g(bucket) left join (select {bucket("depth")} as bucket, count(*) filter (where category <> 'FULL_SHA') as m,
        count(*) filter (where category in ('BRANCH_MAIN', 'BRANCH_OTHER', 'FLOATING_TAG', 'UNKNOWN_REF')) / count(*) as h from cw group by 1) using (bucket)),""",
      _u(_sql_rows("dv", "mutable by depth", "bucket", "m"), _sql_rows("dv", "high risk by depth", "bucket", "h"), _sql_count("ra", "drifted", "category", "observed_drift"), _sql_top("ra", "top mutable", "action_id", "risk_score", 15, "downstream_repos", "usage_count", where="mutable_refs > 0"))),
    "isolation_panel": q(FILES, _u(_sql_count("io", "domains", "domains"), _sql_top("io", "top untrusted", _JOB, "signal_score", 15, "third_party_steps", where="untrusted_before_sensitive"))),
    "privilege_panel": q(FILES, _u(_sql_count("pj", "movable", "movable_actions", "movable_actions > 0"), _sql_top("pw", "top mutable", _FILE, "privilege_score", 15, where="mutable_with_privilege"))),
    "propagation_panel": q(CHANNELS, _u(_sql_count("pr", "channels", "channel_count"), _sql_count("pr", "job depth", "max_job_depth"), _sql_top("pr", "top coupled", _VERSION, "propagation_score", 15, where="privilege_coupling"))),
    "amplification_panel": q(RISK + REACH + AMP_NODES, _u(_sql_count("am", "depth and reach", "concat_ws(' ', max_depth, fanout)", "node_kind = 'action'"), _sql_top("am", "top radius", "node_id", "cascade_radius", 15, "fanout", where="node_kind = 'action'"))),
    "trust_panel": q(TRUST, _u(*[_sql_top("tz", n, "entity", v, 15, where="kind = 'owner'") for n, v in (("usage", "usage"), ("blast", "blast_sum"), ("mutable", "mutable_ratio"))],
      _sql_top("tz", "coupled", "entity", "trust_amplification_score", 15, where="kind = 'owner' and privileged_workflows > 0"))),
    "reusable_panel": q(CALLS, _u(_sql_top("rl0", "top callees", "callee", "repositories", 15, "calls"), _sql_count("rc", "reference kinds", "ref_type"), _sql_top("rl0", "top inheriting", "callee", "inherits_secrets", 15, where="inherits_secrets > 0"))),
    "privileged_panel": q(PRIV, _u(_sql_top("vb", "top", "action_id", "score", 10, "privileged_repos"), _sql_count("vb", "downstream", "concat_ws(' ', repos, privileged_workflows, id_token_workflows)"))),
    "component_panel": _u(*[_sql_rows(_COMPONENTS, m, "action_type", m) for m in ("avg_usage", "avg_downstream", "avg_score")]),
    "stratified_panel": _u(_sql_rows(_TYPES, "coupled by category", "category", "privilege_coupled"), *[_sql_rows(_LIFT, m, "scope", m) for m in ("avg_mutable_ratio", "avg_privilege_score", "avg_channel_count")],
      *[_sql_rows(_ALL_PROFILE, m, "stratum", m) for m in ("is_mutable_share", "inherits_secrets_share", "id_token_write_share")]),
    "dependency_panel": q(IMPLICIT + f"cx as (select {WF}, max(depth) as max_depth from sc group by 1, 2),", _u(_sql_rates("ir", "implicit", ["implicit_count > 0"]), _sql_count("cx", "depth", _DEPTH.replace("as string", "as varchar")), _sql_top("ir", "top ratio", f"concat_ws('/', {WF})", "implicit_ratio", 8, "total_count"))),
    "execution_panel": q(FILES, _u(_sql_rates("io", "isolation", _ISOLATION), _sql_rates("pj", "privilege", _PRIVILEGE), _sql_top("pw", "top privilege", _FILE, "privilege_score", 8))),
    "channel_panel": q(CHANNELS + CALLS, _u(_sql_rates("pr", "channels", _CHANNELS), _sql_rates("rc", "calls", _CALLS), _sql_count("pr", "buckets", _BUCKET.replace("as string", "as varchar")))),
    "lift_panel": _u(*[f"select 'lift' as panel, '{m}' as label, round(coalesce(case when b > 0 then a / b else 0 end, 0), 6)::double as value from (select max({m}) filter (where scope = 'cross') as a, max({m}) filter (where scope = 'same') as b from {_LIFT})" for m in _LIFTS],
      *[_sql_rows(_OWNER, "owner coverage", f"'{c}'", c) for c in ("top_1_share", "top_5_share", "top_10_share")]),
}
