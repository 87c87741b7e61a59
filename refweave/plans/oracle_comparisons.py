"""DuckDB SQL for trust amplification, privileged blast radius, comparisons, evidence and the figures over them."""

from __future__ import annotations

from refweave.plans.oracle import AMP_NODES, IMPLICIT, OWNERS, REACH, REF_CATEGORIES, RISK, WF, category, q
from refweave.plans.oracle_files import CHANNELS, FILES

_KEYED = "repository_full_name as consumer_repository, path as workflow_path"
PRIV = RISK + FILES + f"""vw as (select {_KEYED}, * exclude (repository_full_name, path) from pw),
se as (select distinct dst_node_id as action_id, workflow_id, {WF} from sc),
vb0 as (select action_id, count(distinct workflow_id) filter (where privilege_score > 0) as privileged_workflows, count(distinct consumer_repository) filter (where privilege_score > 0) as privileged_repos,
    count(distinct workflow_id) filter (where id_token_write) as id_token_workflows, count(distinct consumer_repository) filter (where id_token_write) as id_token_repos,
    count(distinct workflow_id) filter (where mutable_with_privilege) as mutable_privileged_workflows, count(distinct consumer_repository) filter (where mutable_with_privilege) as mutable_privileged_repos
  from se join vw using ({WF}) group by 1),
vb as (select a.action_id, {category("a.ref")} as category, coalesce(repos, 0) as repos, coalesce(high_star_repos, 0) as high_star_repos, coalesce(high_star_coverage, 0) as high_star_coverage,
    {", ".join(f"coalesce({c}, 0) as {c}" for c in ("privileged_workflows", "privileged_repos", "id_token_workflows", "id_token_repos", "mutable_privileged_workflows", "mutable_privileged_repos"))},
    round(2 * coalesce(privileged_repos, 0) + 3 * coalesce(id_token_workflows, 0) + 2.5 * coalesce(mutable_privileged_workflows, 0) + 1.5 * coalesce(high_star_repos, 0) + coalesce(high_star_coverage, 0) / 1e6, 4)::double as score
  from ac a left join bl using (action_id) left join vb0 using (action_id)),
"""
TRUST = PRIV + f"""tm as (select lower(owner) as o, lower(repo) as r, max(action_name) as title, bool_or(author_verified = 'verified') as v from ac where marketplace_published group by 1, 2),
te0 as (select action_id, owner, repo, coalesce(nullif(title, ''), owner || '/' || repo) as title, v from ac left join tm on o = lower(owner) and r = lower(repo)),
te as (select action_id, owner as entity, 'owner' as kind from te0 union all select action_id, owner, case when lower(owner) in ('actions', 'github') then 'github_owned' else 'third_party_owner' end from te0
  union all select action_id, title, 'marketplace_publisher' from te0 where v is not null union all select action_id, title, 'verified_creator' from te0 where v),
t1 as (select entity, kind, count(distinct action_id) as actions, cast(sum(usage_count) as bigint) as usage, cast(sum(coalesce(high_star_repos, 0)) as bigint) as high_star_repos,
    cast(sum(case when mutable_ratio > 0 then usage_count else 0 end) as bigint) as mutable_usage, case when sum(usage_count) > 0 then sum(mutable_ratio * usage_count) / sum(usage_count) else 0 end as ratio,
    sum(downstream_repos)::double as blast_sum, max(downstream_repos)::double as blast_max from te join ra using (action_id) left join bl using (action_id) group by 1, 2),
t2 as (select entity, kind, count(distinct consumer_repository) as repositories, count(distinct workflow_id) as workflows, count(distinct workflow_id) filter (where privilege_score > 0) as privileged_workflows,
    count(distinct workflow_id) filter (where id_token_write) as id_token_workflows from te join se using (action_id) left join vw using ({WF}) group by 1, 2),
tz as (select entity, kind, actions, usage, high_star_repos, mutable_usage, blast_sum, blast_max, coalesce(repositories, 0) as repositories, coalesce(workflows, 0) as workflows, coalesce(privileged_workflows, 0) as privileged_workflows,
    coalesce(id_token_workflows, 0) as id_token_workflows, round(1.5 * coalesce(repositories, 0) + 25 * ratio + 2 * coalesce(privileged_workflows, 0) + 3 * coalesce(id_token_workflows, 0) + actions + 0.1 * blast_sum, 4) as trust_amplification_score,
    round(ratio, 4) as mutable_ratio from t1 left join t2 using (entity, kind)),
to0 as (select entity, usage::double as x, row_number() over (order by usage desc, entity) as i, row_number() over (order by usage, entity) as j, count(*) over () as n from tz where kind = 'owner'),
"""
_PROP = f"""vp as (select {_KEYED}, arg_max(channel_count, sha) as channel_count, arg_max(privilege_coupling, sha) as privilege_coupling from pr group by 1, 2),
"""
# Files and their channels over one set of CTEs: CHANNELS begins with FILES.
EVIDENCE = PRIV + CHANNELS[len(FILES) :] + _PROP + OWNERS + f"""ev as (select t.consumer_repository, t.workflow_path, has_external_owner, has_multi_owner_cascade, owners, t.max_depth, mutable_ratio, high_risk_ratio, observed_drift, privilege_score, id_token_write,
    mutable_with_privilege, channel_count, privilege_coupling from tt t left join rw using ({WF}) left join vw using ({WF}) left join vp using ({WF})),
"""
_TOPS = lambda ks: ", ".join(f"round(sum(x) filter (where i <= {k}) / coalesce(nullif(sum(x), 0), 1), 6) as top_{k}_share" for k in ks)
_PRIVILEGED = "id_token_write or contents_write or actions_write or packages_write or deployments_write or security_events_write or write_all or secrets_in_env or secrets_in_with or explicit_token"
_TYPES = "('javascript', 'docker', 'composite', 'reusable_workflow', 'unknown')"
_INDICATORS = f"""select 'non_zero_implicit_dependency_ratio' as indicator, (implicit_count > 0)::int::double as v from ir union all select 'mutable_ref_ratio_per_workflow', mutable_ratio from rw
  union all select 'isolation_privilege_coupling_ratio_per_job', isolation_coupling::int from pj union all select 'privilege_propagation_coupling_ratio_per_workflow', privilege_coupling::int from pr
  union all select 'external_owner_dependency_ratio_per_workflow', has_external_owner::int from tt union all select 'observed_drift_ratio_per_action', observed_drift::int from ra"""


def _reasons(pairs: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in pairs) + "], lambda x: x is not null), ',')"


_WHY3 = _reasons([("mixed_trust_with_privilege", "isolation_coupling"), ("mutable_third_party_with_privilege", "mutable_with_privilege"), ("pull_request_target", "pull_request_target"), ("id_token_write", "id_token_write"), ("secret_bearing_configuration", "secrets_in_env or secrets_in_with")])
_WHY4 = _reasons([("privilege_propagation_coupling", "privilege_coupling"), ("mutable_to_downstream_propagation", "mutable_downstream"), ("artifact_roundtrip", "artifact_upload and artifact_download"), ("workflow_run_trigger", "on_workflow_run"), ("workflow_level_reuse", "on_workflow_call or reusable_call")])

ORACLE = {
    "privileged_blast": q(PRIV, "select * from vb"),
    "privileged_blast_summary": q(PRIV + "vs as (select privileged_repos as x, row_number() over (order by privileged_repos desc, action_id) as i from vb),", f"""select * from (select count(*) as actions,
      {", ".join(f"count(*) filter (where {c} > 0) as with_{c}" for c in ("privileged_repos", "id_token_repos", "mutable_privileged_workflows"))},
      {", ".join(f"cast(sum({c}) as bigint) as total_{c}" for c in ("privileged_repos", "id_token_repos"))} from vb), (select {_TOPS((1, 10, 100))} from vs)"""),
    "trust_amplification_by_entity": q(TRUST, "select * from tz"),
    "trust_amplification_summary": q(TRUST, f"""select * from (select count(*) as entities, count(*) filter (where kind = 'owner') as owners from tz), (select {_TOPS((1, 5, 10))}, round(2 * sum(j * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 4) as gini,
      round(sum(x * x) / pow(sum(x), 2), 4) as hhi from to0)"""),
    "trust_top_entities": q(TRUST, "select entity, kind, trust_amplification_score, repositories, usage from tz order by trust_amplification_score desc, repositories desc, usage desc, lower(entity) desc, kind limit 100"),
    "top_owners": q(TRUST, "select entity, usage, repositories from tz where kind = 'owner' order by usage desc, entity limit 15"),
    "owner_coverage": q(TRUST, f"select {_TOPS((1, 5, 10))} from to0"),
    "top_privileged": q(PRIV, "select action_id, score, privileged_workflows, id_token_workflows from vb order by score desc, privileged_repos desc, action_id limit 10"),
    "component_types": q(PRIV + REACH + AMP_NODES, f"""select g.action_type, coalesce(actions, 0) as actions, coalesce(usage, 0) as usage, coalesce(privileged_repos, 0) as privileged_repos, coalesce(id_token_repos, 0) as id_token_repos,
      coalesce(mutable_privileged_workflows, 0) as mutable_privileged_workflows, avg_usage, avg_downstream, avg_fanout, avg_max_depth, coalesce(mutable_ratio, 0.0) as mutable_ratio, avg_score
      from (select unnest([{_TYPES[1:-1]}]) as action_type) g left join (select case when action_type in {_TYPES} then action_type else 'unknown' end as action_type, count(*) as actions, cast(sum(usage_count) as bigint) as usage,
        round(avg(nullif(usage_count, 0)), 4) as avg_usage, round(avg(downstream_repos), 4) as avg_downstream, round(avg(coalesce(fanout, 0)), 4) as avg_fanout, round(avg(coalesce(am.max_depth, 0)), 4) as avg_max_depth,
        round(case when sum(usage_count) > 0 then sum(mutable_ratio * usage_count) / sum(usage_count) else 0 end, 6) as mutable_ratio, cast(sum(privileged_repos) as bigint) as privileged_repos, cast(sum(id_token_repos) as bigint) as id_token_repos,
        cast(sum(mutable_privileged_workflows) as bigint) as mutable_privileged_workflows, round(avg(score), 4) as avg_score
        from ac join ra using (action_id) join vb using (action_id) left join (select * from am where node_kind = 'action') am on am.node_id = ac.action_id group by 1) using (action_type)"""),
    "ref_type_comparison": q(EVIDENCE + " union all ".join(f"{'wk as (' if k == REF_CATEGORIES[0] else ''}select '{k}' as category, {WF} from rw where {k.lower()} > 0" for k in REF_CATEGORIES) + f"""),
      wv as (select category, count(*) as workflows, count(*) filter (where {_PRIVILEGED}) as privileged_workflows, count(*) filter (where mutable_with_privilege) as privilege_coupled, count(*) filter (where privilege_coupling) as propagation_coupled
        from wk left join vw using ({WF}) left join vp using ({WF}) group by 1),
      av as (select category, count(*) as actions, cast(sum(usage_count) as bigint) as usage, round(avg(usage_count), 4) as avg_usage, round(avg(downstream_repos), 4) as avg_downstream, count(*) filter (where observed_drift) as drift_actions,
        round(count(*) filter (where observed_drift) / count(*), 6) as drift_ratio from ra group by 1),""", f"""select g.category, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("actions", "usage", "drift_actions", "workflows", "privileged_workflows", "privilege_coupled", "propagation_coupled"))},
      avg_usage, avg_downstream, coalesce(drift_ratio, 0.0) as drift_ratio from (select unnest([{", ".join(f"'{k}'" for k in REF_CATEGORIES)}]) as category) g left join av using (category) left join wv using (category)"""),
    "workflow_evidence": q(EVIDENCE, "select * from ev"),
    "lift_cross_same": q(EVIDENCE, f"""select g.scope, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("workflows", "with_drift", "with_id_token", "with_coupled_mutability", "with_propagation_coupling", "with_multi_owner_cascade"))},
      avg_max_depth, avg_owners, avg_mutable_ratio, avg_high_risk_ratio, avg_channel_count, avg_privilege_score from (values ('cross'), ('same')) g(scope) left join (select case when has_external_owner then 'cross' else 'same' end as scope,
      count(*) as workflows, count(*) filter (where observed_drift) as with_drift, count(*) filter (where id_token_write) as with_id_token, count(*) filter (where mutable_with_privilege) as with_coupled_mutability,
      count(*) filter (where privilege_coupling) as with_propagation_coupling, count(*) filter (where has_multi_owner_cascade) as with_multi_owner_cascade,
      {", ".join(f"round(avg({c}), 4) as avg_{c}" for c in ("max_depth", "owners", "mutable_ratio", "high_risk_ratio", "channel_count", "privilege_score"))} from ev group by 1) using (scope)"""),
    "cross_owner_effects": q(EVIDENCE + " union all ".join(f"{'ef as (' if m == 'mutable_ratio' else ''}select '{m}' as metric, has_external_owner as x, {m}::double as v from ev where {m} is not null" for m in ("mutable_ratio", "privilege_score", "channel_count")) + "),",
      """select metric, count(*) filter (where x) as cross_count, count(*) filter (where not x) as same_count, round(avg(v) filter (where x), 6) as cross_mean, round(avg(v) filter (where not x), 6) as same_mean,
      round(avg(v) filter (where x) - avg(v) filter (where not x), 6) as difference from ef group by 1"""),
    "indicator_points": q(TRUST + CHANNELS[len(FILES) :] + OWNERS + IMPLICIT, f"""select indicator, count(*) as sample_count, round(avg(v), 6) as estimate from ({_INDICATORS}) group by 1
      union all select 'top10_owner_usage_share', count(*), round(sum(x) filter (where i <= 10) / sum(x), 6) from to0"""),
    "manual_validation": q(CHANNELS + f"""m3 as (select repository_full_name, path, {_WHY3} as reasons, privilege_score as score, privileged_jobs from pw where {_WHY3} <> '' order by score desc, repository_full_name, path limit 50),
      mt as (select repository_full_name, path, arg_max(job_id, (privilege_score, sha, job_id)) as top_job, max(privilege_score) as top_job_score from pj group by 1, 2),
      m4 as (select repository_full_name, path, sha, {_WHY4} as reasons, propagation_score as score, channel_count from pr where {_WHY4} <> '' order by score desc, repository_full_name, path, sha limit 50),""",
      """select 'RQ3' as label, repository_full_name, path, reasons, score, top_job, top_job_score, privileged_jobs as signals from m3 left join mt using (repository_full_name, path)
      union all select 'RQ4', repository_full_name, path, reasons, score, null, null, channel_count from m4"""),
    "headline": q(PRIV + CHANNELS[len(FILES) :] + IMPLICIT, """select 'RQ1 workflows with implicit dependencies' as question, round(count(*) filter (where implicit_count > 0) / count(*), 6) as value from ir
      union all select 'RQ2 mutable bindings', round(count(*) filter (where category <> 'FULL_SHA') / count(*), 6) from cw union all select 'RQ3 untrusted before sensitive', round(count(*) filter (where untrusted_before_sensitive) / count(*), 6) from io
      union all select 'RQ4 workflows with channels', round(count(*) filter (where channel_count > 0) / count(*), 6) from pr
      union all select 'RQ5 actions reaching a tenth of repositories', round(count(*) filter (where repos > 0.1 * (select count(*) from rn)) / count(*), 6) from bl"""),
    "representative_cases": q(CHANNELS + IMPLICIT, """select 'RQ1' as question, arg_max(consumer_repository, (implicit_ratio, consumer_repository, workflow_path)) as repository, arg_max(workflow_path, (implicit_ratio, consumer_repository, workflow_path)) as path, max(implicit_ratio) as value from ir
      union all select 'RQ3', arg_max(repository_full_name, (privilege_score, repository_full_name, path)), arg_max(path, (privilege_score, repository_full_name, path)), max(privilege_score) from pw
      union all select 'RQ4', arg_max(repository_full_name, (propagation_score, repository_full_name, path)), arg_max(path, (propagation_score, repository_full_name, path)), max(propagation_score) from pr"""),
}
