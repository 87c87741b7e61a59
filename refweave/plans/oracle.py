"""DuckDB SQL for the rows of the graph and temporal queries."""

from __future__ import annotations

from refweave.plans.core_problems import _WS

# Fixed values, stated again here and not taken from the code under test, so that a wrong one there shows.
REF_CATEGORIES = ("FULL_SHA", "SHORT_SHA", "BRANCH_MAIN", "BRANCH_OTHER", "MAJOR_TAG", "SEMVER_TAG", "FLOATING_TAG", "UNKNOWN_REF")
WEIGHT = """case category when 'FULL_SHA' then 0.0::double when 'SHORT_SHA' then 0.2::double when 'SEMVER_TAG' then 0.45::double when 'MAJOR_TAG' then 0.7::double when 'BRANCH_MAIN' then 0.95::double
  when 'BRANCH_OTHER' then 1.0::double when 'FLOATING_TAG' then 1.0::double when 'UNKNOWN_REF' then 0.85::double end"""
HIGH = "category in ('BRANCH_MAIN', 'BRANCH_OTHER', 'FLOATING_TAG', 'UNKNOWN_REF')"
TOKEN_PATTERNS = (r"\bGITHUB_TOKEN\b", r"secrets\.GITHUB_TOKEN", r"github\.token", r"process\.env\.[A-Z0-9_]+", r"\$GITHUB_TOKEN\b", r"INPUT_[A-Z0-9_]+", r"core\.getInput\(")
CANONICAL = """('actions/checkout', 'actions/setup-node', 'actions/upload-artifact', 'actions/download-artifact', 'actions/cache', 'actions/setup-python', 'docker/login-action', 'github/codeql-action')"""
_OWN = "lower(split_part({0}, '/', 1))"


def category(ref: str) -> str:
    """The reference category of a column."""
    r = f"trim({ref})"
    return f"""case when {ref} is null or {r} = '' then 'UNKNOWN_REF' when regexp_full_match({r}, '[0-9a-fA-F]{{40}}') then 'FULL_SHA'
      when regexp_full_match({r}, '[0-9a-fA-F]{{7,39}}') then 'SHORT_SHA' when lower({r}) in ('main', 'master', 'refs/heads/main', 'refs/heads/master') then 'BRANCH_MAIN'
      when lower({r}) in ('dev', 'develop', 'development', 'next', 'beta', 'nightly', 'canary', 'edge', 'preview', 'alpha') or lower({r}) like 'refs/heads/%' then 'BRANCH_OTHER' when lower({r}) in ('latest', 'stable', 'release') then 'FLOATING_TAG'
      when regexp_full_match({r}, 'v?\\d+\\.\\d+\\.\\d+([-+][A-Za-z0-9_.-]+)?') then 'SEMVER_TAG' when regexp_full_match({r}, 'v?\\d+') then 'MAJOR_TAG' else 'UNKNOWN_REF' end"""


def bucket(depth: str) -> str:
    return f"case when {depth} <= 1 then 'level_1' when {depth} = 2 then 'level_2' else 'level_3_plus' end"


BASE = f"""with recursive
ed as (select * from edges qualify row_number() over (partition by edge_id order by discovered_at desc nulls last, ingest_seq desc) = 1),
sc as (select *, 'workflow::' || consumer_repository || '::' || workflow_path as workflow_id from ed where consumer_repository <> '' and workflow_path <> ''),
ac as (select * from actions qualify row_number() over (partition by action_id order by discovered_at desc nulls last, ingest_seq desc) = 1),
rl as (select * from repositories qualify row_number() over (partition by repo_id order by collected_at desc nulls last, ingest_seq desc) = 1),
rn as (select full_name, max(stars) as stars from rl group by 1),
"""
LINKS = "al as (select distinct src_node_id as src, dst_node_id as dst from ed where src_kind = 'action' and dst_kind = 'action'),\n"
PAIRS = LINKS + """bp(action_id, repository) as (
  select dst_node_id, split_part(src_node_id, '::', 2) from ed where src_kind = 'workflow' and dst_kind = 'action'
  union select l.dst, p.repository from bp p join al l on l.src = p.action_id),
"""
BLAST = PAIRS + """bl as (select i.action_id, count(p.repository) as repos, count(*) filter (where stars > 50) as high_star_repos,
    cast(coalesce(sum(case when stars > 50 then stars end), 0) as bigint) as high_star_coverage
  from (select distinct dst_node_id as action_id from ed where dst_kind = 'action') i left join bp p using (action_id) left join rn on rn.full_name = p.repository group by 1),
"""
REACH = """nl as (select distinct src_node_id as src, dst_node_id as dst from ed),
fr(node_id, reached, hops) as (select src, dst, 1 from nl union select f.node_id, l.dst, f.hops + 1 from fr f join nl l on l.src = f.reached where f.hops < 24),
fb as (select node_id, reached, min(hops) as hops from fr where node_id <> reached group by 1, 2),
re as (select node_id, count(*) as reached, cast(max(hops) as bigint) as max_hops, round(avg(hops), 6) as avg_hops from fb group by 1),
"""
COUNTS = ", ".join(f"count(*) filter (where category = '{k}') as {k.lower()}" for k in REF_CATEGORIES)
WF = "consumer_repository, workflow_path"
DRIFT = f"""ob as (select action_id, ref_name, ref_type, nullif(lower(trim(sha, {_WS})), '') as sha, epoch_us(observed_at) as ts, ingest_seq from ref_observations),
od as (select * from ob where sha is not null qualify row_number() over (partition by action_id, ref_name, ref_type, ts order by ingest_seq desc) = 1),
om as (select *, lag(sha) over (partition by action_id, ref_name, ref_type order by ts) as before from od),
ov as (select *, lag(sha) over w as previous_sha, lag(ts) over w as first_seen_us from om where before is null or before <> sha window w as (partition by action_id, ref_name, ref_type order by ts)),
dr as (select action_id, ref_name, ref_type, previous_sha, sha as new_sha, ts as detected_us, first_seen_us,
  sha1(action_id || '::' || ref_name || '::' || ref_type || '::' || sha || '::' || ts) as drift_id from ov where previous_sha is not null),
"""
_BOUND = "coalesce(nullif(e.ref_string, ''), a.ref)"
CAT = BLAST + DRIFT + f"""dk as (select action_id, lower(ref_name) as bound_ref, count(*) as k from dr group by 1, 2),
ca as (select e.*, a.action_id, a.owner, a.repo, a.author_verified, a.action_type, lower({_BOUND}) as bound_ref, {category(_BOUND)} as category from sc e join ac a on a.action_id = e.dst_node_id),
cw as (select c.*, {WEIGHT} as weight, coalesce(b.repos, 0) as repos, coalesce(dk.k, 0) as k from ca c left join bl b using (action_id) left join dk using (action_id, bound_ref)),
"""
_SUM = " + ".join(k.lower() for k in REF_CATEGORIES)
_DERIVED = f"""{_SUM} as refs, {_SUM} - full_sha as mutable_refs, full_sha as immutable_refs, branch_main + branch_other as branch_refs, major_tag + semver_tag + floating_tag as tag_refs, full_sha + short_sha as sha_refs,
    round(case when {_SUM} > 0 then ({_SUM} - full_sha) / ({_SUM}) else 0 end, 6) as mutable_ratio, round(case when {_SUM} > 0 then (branch_main + branch_other + floating_tag + unknown_ref) / ({_SUM}) else 0 end, 6) as high_risk_ratio"""
RISK = CAT + f"""ua as (select dst_node_id as action_id, count(*) as usage_count, count(distinct workflow_id) as workflow_count from sc group by 1),
r0 as (select a.action_id, owner, repo, ref as ref_name, {category("ref")} as category, coalesce(usage_count, 0) as usage_count, coalesce(workflow_count, 0) as workflow_count, coalesce(b.repos, 0) as n, coalesce(dk.k, 0) as k
  from ac a left join ua using (action_id) left join bl b using (action_id) left join dk on dk.action_id = a.action_id and dk.bound_ref = lower(a.ref)),
ra as (select action_id, owner, repo, ref_name, category, usage_count, workflow_count, n as downstream_repos, case when category <> 'FULL_SHA' then 1 else 0 end as mutable_refs, case when category = 'FULL_SHA' then 1 else 0 end as immutable_refs,
    case when category in ('BRANCH_MAIN', 'BRANCH_OTHER') then 1 else 0 end as branch_refs, case when category in ('MAJOR_TAG', 'SEMVER_TAG', 'FLOATING_TAG') then 1 else 0 end as tag_refs,
    case when category in ('FULL_SHA', 'SHORT_SHA') then 1 else 0 end as sha_refs, case when category <> 'FULL_SHA' then 1.0 else 0.0 end::double as mutable_ratio, case when {HIGH} then 1.0 else 0.0 end::double as high_risk_ratio,
    k > 0 as observed_drift, k as drift_events, case when k > 0 then n else 0 end as affected_repos, round(n * {WEIGHT}, 4) as risk_score, round(case when k > 0 then n * {WEIGHT} * k else 0.0 end, 4) as drift_score from r0),
wn0 as (select consumer_repository, workflow_path from sc union select split_part(src_node_id, '::', 2), array_to_string(split(src_node_id, '::')[3:], '::') from ed where src_kind = 'workflow' and split_part(src_node_id, '::', 2) <> ''),
wx as (select {WF}, {COUNTS}, cast(max(depth) as bigint) as max_depth, round(sum(repos * weight), 4) as risk_score, count(distinct case when k > 0 then (action_id, bound_ref) end) as drift_refs,
    round(sum(case when k > 0 then repos * weight else 0.0 end), 4) as drift_score from cw group by 1, 2),
wu as (select {WF}, count(distinct repository) as downstream_repos from (select distinct {WF}, action_id from ca) join bp using (action_id) group by 1, 2),
w0 as (select {WF}, {", ".join(f"coalesce({k.lower()}, 0) as {k.lower()}" for k in REF_CATEGORIES)}, coalesce(max_depth, 0) as max_depth, coalesce(drift_refs, 0) as drift_refs, coalesce(downstream_repos, 0) as downstream_repos,
    coalesce(risk_score, 0.0) as risk_score, coalesce(drift_score, 0.0) as drift_score from wn0 left join wx using ({WF}) left join wu using ({WF})),
rw as (select *, drift_refs > 0 as observed_drift, case when drift_refs > 0 then downstream_repos else 0 end as affected_repos, {_DERIVED} from w0),
"""
CHANGES = """ch as (select repository_full_name, workflow_path, commit_sha, committed_at, epoch_us(committed_at) as committed_us,
    coalesce(uses_before, []) as uses_before, coalesce(uses_after, []) as uses_after from workflow_changes
  qualify row_number() over (partition by repository_full_name, workflow_path, commit_sha, committed_at, uses_before, uses_after order by ingest_seq) = 1),
"""
_NAME = "split_part(u, '@', 1)"
_REF = "substr(u, instr(u, '@') + 1)"
_OK = "instr(u, '@') > 0 and instr(split_part(u, '@', 1), '/') > 0"
MENTION = CHANGES + f"""me as (select distinct sha1(split_part({_NAME}, '/', 1) || '::' || split_part({_NAME}, '/', 2) || '::' || array_to_string(split({_NAME}, '/')[3:], '/') || '::' || {_REF}) as action_id,
    repository_full_name, workflow_path, committed_us from (select *, unnest(list_distinct(list_concat(uses_before, uses_after))) as u from ch) where {_OK}),
"""
EXPOSURE = DRIFT + MENTION + """ex as (select drift_id, action_id, repository_full_name, workflow_path, min(committed_us) as ended_us, any_value(detected_us) as detected_us
    from dr join me using (action_id) where committed_us > detected_us group by 1, 2, 3, 4),
ew as (select *, round((ended_us - detected_us) / 3.6e9, 4) as hours from ex),
"""


def _refs(column: str, out: str) -> str:
    return f"select repository_full_name, workflow_path, commit_sha, committed_us, lower({_NAME}) as base_key, min({_REF}) as {out} from (select *, unnest({column}) as u from ch) where {_OK} group by all"


TRANS = CHANGES + f"""ta as ({_refs("uses_before", "ref_before")}), tb as ({_refs("uses_after", "ref_after")}),
tr as (select * from ta left join tb using (repository_full_name, workflow_path, commit_sha, committed_us, base_key) where ref_after is null or ref_after <> ref_before),
"""
UPDATES = DRIFT + TRANS + f"""na as (select action_id, lower(owner || '/' || repo || coalesce('/' || subpath, '')) as base_key, ref from ac),
im as (select dst_node_id as action_id, consumer_repository as repository_full_name, workflow_path, min(depth) as depth from sc group by 1, 2, 3),
xp as (select drift_id, action_id, repository_full_name, workflow_path, round((min(committed_us) - any_value(detected_us)) / 3.6e9, 4) as lag_hours
  from dr join na using (action_id) join tr on tr.base_key = na.base_key and tr.ref_before = na.ref where committed_us > detected_us group by 1, 2, 3, 4),
up as (select x.drift_id, x.action_id, x.repository_full_name, x.workflow_path, 'explicit' as mode, lag_hours, coalesce(depth, 1) as depth
    from xp x left join im using (action_id, repository_full_name, workflow_path)
  union all select d.drift_id, d.action_id, i.repository_full_name, i.workflow_path, 'implicit', 0.0, i.depth from (select drift_id, action_id from dr join na using (action_id)) d join im i using (action_id)
    anti join xp x on x.drift_id = d.drift_id and x.action_id = d.action_id and x.repository_full_name = i.repository_full_name and x.workflow_path = i.workflow_path),
uw as (select *, {bucket("depth")} as bucket from up),
"""
OWNERS = f"""tb as (select e.{WF.replace(", ", ", e.")}, e.edge_type, e.depth, lower(a.owner) as dst_owner, a.has_token_access, {_OWN.format("e.consumer_repository")} as home,
    lower(a.owner) <> coalesce(lower(b.owner), {_OWN.format("e.consumer_repository")}) as crosses, e.edge_type = 'direct' as is_direct
  from sc e join ac a on a.action_id = e.dst_node_id left join ac b on b.action_id = e.src_node_id),
td as (select {WF}, count(distinct dst_owner) as owners, count(distinct dst_owner) filter (where dst_owner <> home) as external_owners,
  count(*) filter (where crosses and is_direct) as direct_cross, count(*) filter (where crosses and not is_direct) as transitive_cross, count(*) filter (where not crosses) as same_owner,
  count(*) filter (where crosses and has_token_access) as privileged_cross, cast(max(depth) as bigint) as max_depth from tb group by 1, 2),
tt as (select *, direct_cross > 0 as has_external_owner, owners >= 2 and direct_cross + transitive_cross > 0 as has_multi_owner_cascade from td),
"""
IMPLICIT = f"""pa as (select {WF}, dst_node_id, bool_or(edge_type = 'direct') as direct from sc where dst_kind = 'action' group by 1, 2, 3),
ir as (select {WF}, count(*) filter (where direct) as direct_count, count(*) filter (where not direct) as implicit_count, count(*) as total_count,
  round(count(*) filter (where not direct) / count(*), 6) as implicit_ratio from pa group by 1, 2),
"""
AMP_NODES = """nk as (select src_node_id as node_id, src_kind as node_kind from ed where src_kind in ('action', 'workflow') union select dst_node_id, dst_kind from ed where dst_kind in ('action', 'workflow')),
nw as (select node_id, count(*) as reached_workflows, count(distinct split_part(reached, '::', 2)) as reached_repos, count(distinct split_part(reached, '::', 2)) filter (where stars > 50) as reached_high_star
  from fb left join rn on rn.full_name = split_part(reached, '::', 2) where starts_with(reached, 'workflow::') group by 1),
am as (select node_id, node_kind, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree, coalesce(re.reached, 0) as fanout, coalesce(re.max_hops, 0) as max_depth, coalesce(reached_workflows, 0) as reached_workflows,
    coalesce(reached_repos, 0) as reached_repos, coalesce(reached_high_star, 0) as reached_high_star, coalesce(bl.repos, 0) as blast_repos, coalesce(re.avg_hops, 0.0) as avg_depth, coalesce(i.n, 0) * coalesce(re.reached, 0) as betweenness_like,
    greatest(coalesce(reached_workflows, 0), coalesce(reached_repos, 0), coalesce(bl.repos, 0)) as cascade_radius, round(case when reached_repos > 0 then reached_high_star / reached_repos else 0 end, 6) as concentration
  from nk left join (select dst as node_id, count(*) as n from nl group by 1) i using (node_id) left join (select src as node_id, count(*) as n from nl group by 1) o using (node_id)
  left join re using (node_id) left join nw using (node_id) left join bl on bl.action_id = node_id),
"""
AMP = BLAST + REACH + AMP_NODES
TRANSFER = """iu as (select lower(full_name) as name, full_name, repo_id, collected_at, ingest_seq, html_url,
    nullif(regexp_extract(coalesce(html_url, ''), '^https?://[^/]+/([^/]+/[^/]+?)/*$', 1), '') as resolved from repositories),
ii as (select *, case when resolved is not null then (case when lower(resolved) = name then 'canonical' else 'redirected' end) when html_url is null then 'missing' else 'inaccessible' end as st from iu),
ip as (select name, arg_max(st, _k) as status, list(resolved order by _k desc)[1] as resolved, arg_max(repo_id, _k) as latest_id, count(distinct repo_id) as ids, count(*) as observations, min(epoch_us(collected_at)) as first_us,
    max(epoch_us(collected_at)) as last_us from (select *, (case when collected_at is null then 0 else 1 end, coalesce(epoch_us(collected_at), 0), ingest_seq) as _k from ii) group by 1),
ik as (select *, unnest(list_filter([case when status = 'redirected' then 'redirected' end, case when status = 'missing' then 'missing' end, case when ids > 1 then 'repository_id_changed' end], lambda x: x is not null)) as risk_type from ip),
"""


def q(ctes: str, select: str) -> str:
    return BASE + ctes.rstrip().rstrip(",") + "\n" + select if ctes else BASE.rstrip().rstrip(",") + "\n" + select


def _rank(table: str, value: str, p: float, keys: str) -> str:
    return f"(select {keys}, {value} as v from (select {keys}, {value}, row_number() over (partition by {keys} order by {value}) as rn, count(*) over (partition by {keys}) as n from {table}) where rn = round_even((n - 1) * {p}, 0) + 1)"


ORACLE = {
    "implicit_ratio": q(IMPLICIT, "select * from ir"),
    "blast_radius": q(BLAST, "select * from bl"),
    "blast_top": q(BLAST, "select * from bl order by high_star_repos desc, high_star_coverage desc, action_id limit 12"),
    "downstream_closure": q(PAIRS, "select * from bp"),
    "forward_reach": q(REACH, "select * from re"),
    "min_depths": q("", f"select {WF}, dst_node_id as action_id, edge_type, cast(min(depth) as bigint) as depth from sc group by all"),
    "usage": q("", "select dst_node_id as action_id, count(*) as usage_count from ed where dst_kind = 'action' group by 1"),
    "ref_risk_by_action": q(RISK, "select * from ra"),
    "ref_risk_by_workflow": q(RISK, "select * from rw"),
    "ref_risk_by_depth": q(RISK + f"""de as (select {bucket("depth")} as bucket, {COUNTS} from cw group by 1), dw as (select {bucket("max_depth")} as bucket, count(*) as workflows, cast(sum(drift_refs) as bigint) as drift_refs,
        cast(sum(affected_repos) as bigint) as affected_repos, round(sum(risk_score), 4) as risk_score, round(sum(drift_score), 4) as drift_score from rw group by 1),
      dz as (select g.bucket, {", ".join(f"coalesce({k.lower()}, 0) as {k.lower()}" for k in REF_CATEGORIES)}, coalesce(workflows, 0) as workflows, coalesce(drift_refs, 0) as drift_refs, coalesce(affected_repos, 0) as affected_repos,
        coalesce(risk_score, 0.0) as risk_score, coalesce(drift_score, 0.0) as drift_score from (values ('level_1'), ('level_2'), ('level_3_plus')) g(bucket) left join de using (bucket) left join dw using (bucket)),""", f"select *, {_DERIVED} from dz"),
    "ref_risk_summary": q(RISK, f"""select * from (select count(*) as actions, {COUNTS}, count(*) filter (where observed_drift) as drift_actions, round(sum(risk_score), 4) as risk_score, round(sum(drift_score), 4) as drift_score from ra),
      (select count(*) as workflows, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("refs", "mutable_refs", "immutable_refs", "branch_refs", "tag_refs", "sha_refs", "drift_refs"))},
        round(sum(mutable_refs) / sum(refs), 6) as mutable_ratio, round(sum(branch_main + branch_other + floating_tag + unknown_ref) / sum(refs), 6) as high_risk_ratio from rw),
      (select count(distinct repository) as affected_repos from bp join ac using (action_id))"""),
    "trust_boundaries": q(OWNERS, "select * from tt"),
    "trust_boundary_summary": q(OWNERS, """select count(*) as workflows, count(*) filter (where has_external_owner) as with_external_owner, count(*) filter (where has_multi_owner_cascade) as with_multi_owner_cascade,
      round(avg(external_owners), 6) as avg_external_owners, max(external_owners) as max_external_owners, cast(sum(privileged_cross) as bigint) as privileged_cross from tt"""),
    "cascade_depth": q("", f"""select {WF}, cast(max(depth) as bigint) as max_depth, {", ".join(f"count(distinct dst_node_id) filter (where {bucket('depth')} = '{k}') as {k}" for k in ("level_1", "level_2", "level_3_plus"))},
      {", ".join(f"round(count(*) filter (where ref_type = '{k}') / count(*), 4) as {k}_rate" for k in ("sha", "tag", "branch"))}, round(count(*) filter (where lower(ref_string) in ('main', 'master', 'refs/heads/main', 'refs/heads/master')) / count(*), 4) as main_rate,
      count(*) filter (where binding_downgrade) as downgrades, count(*) filter (where depth >= 3 and ref_type <> 'sha') as high_risk_paths from sc group by 1, 2"""),
    "layer_map": q("", f"select {WF}, string_agg(depth || '=' || n, ',' order by depth) as layers from (select {WF}, depth, count(distinct dst_node_id) as n from sc group by 1, 2, 3) group by 1, 2"),
    "amplification_by_node": q(AMP, "select * from am"),
    "amplification_summary": q(AMP + "aa as (select * from am where node_kind = 'action'),", f"""select count(*) as nodes, median(fanout) as median_fanout, max(fanout) as max_fanout, (select v from {_rank("(select 1 as one, fanout from aa)", "fanout", 0.95, "one")}) as p95_fanout,
      (select round(2 * sum(i * fanout) / (max(n) * sum(fanout)) - (max(n) + 1) / max(n), 6) from (select fanout, row_number() over (order by fanout, node_id) as i, count(*) over () as n from aa)) as gini,
      {", ".join(f"(select round(sum(fanout) filter (where i <= {k}) / sum(fanout), 6) from (select fanout, row_number() over (order by fanout desc, node_id) as i from aa)) as top_{k}_share" for k in (1, 10, 100))} from aa"""),
    "lorenz_blast": q(BLAST, """select action_id, round(row_number() over w / count(*) over (), 6) as population_share, round(sum(repos) over (w rows unbounded preceding) / sum(repos) over (), 6) as value_share
      from bl window w as (order by repos, action_id)"""),
    "ecdf_implicit": q(IMPLICIT, f"select {WF}, implicit_ratio, round(row_number() over (order by implicit_ratio, {WF}) / count(*) over (), 6) as share from ir"),
    "drift_lag": q(DRIFT, "select * from dr"),
    "drift_distribution": q(DRIFT, """select coalesce(action_type, 'unknown') as action_type, coalesce(author_verified, 'unknown') as author_verified, ref_type, count(*) as events, count(distinct action_id) as actions,
      count(distinct (action_id, ref_name, ref_type)) as refs from dr left join (select action_id, action_type, author_verified from ac) using (action_id) group by 1, 2, 3"""),
    "drift_enriched": q(DRIFT, """select drift_id, action_id, coalesce(owner, '') as owner, coalesce(repo, '') as repo, coalesce(action_type, 'unknown') as action_type,
      strftime(make_timestamp(detected_us), '%Y-%m-%dT%H:%M:%S') as detected_at, previous_sha, new_sha from dr left join (select action_id, owner, repo, action_type from ac) using (action_id)"""),
    "drift_coverage": q(DRIFT, """select * from (select count(*) as observations, count(distinct action_id) as actions, count(distinct (action_id, ref_name, ref_type)) as refs, count(distinct ref_name) filter (where ref_type = 'tag') as tag_names,
      count(distinct sha) as shas, round((max(epoch_us(observed_at)) - min(epoch_us(observed_at))) / 3.6e9, 4) as span_hours
      from (select distinct action_id, ref_name, ref_type, sha, observed_at from ref_observations where sha is not null)), (select count(*) as drift_events, count(distinct action_id) as drifted_actions from dr)"""),
    "exposure": q(EXPOSURE, "select * from ew"),
    "exposure_summary": q(EXPOSURE, """select count(*) as windows, count(distinct action_id) as actions, count(distinct repository_full_name) as repositories, round(avg(hours), 4) as avg_hours,
      min(hours) as min_hours, max(hours) as max_hours from ew"""),
    "transitions": q(TRANS, "select * from tr"),
    "update_windows": q(UPDATES, "select * from uw"),
    "update_window_summary": q(UPDATES, f"""select g.bucket, g.mode, coalesce(n, 0) as windows, avg_hours, max_hours, a.v as median_hours, b.v as p95_hours
      from (select * from (values ('level_1'), ('level_2'), ('level_3_plus')) x(bucket), (values ('explicit'), ('implicit')) y(mode)) g
      left join (select bucket, mode, count(*) as n, round(avg(lag_hours), 4) as avg_hours, max(lag_hours) as max_hours from uw group by 1, 2) using (bucket, mode)
      left join {_rank("uw", "lag_hours", 0.5, "bucket, mode")} a using (bucket, mode) left join {_rank("uw", "lag_hours", 0.95, "bucket, mode")} b using (bucket, mode)"""),
    "time_window_amplification": q(UPDATES, """select g.bucket, coalesce(e, 0) as explicit_windows, coalesce(i, 0) as implicit_windows, ea as explicit_avg_hours, ia as implicit_avg_hours
      from (values ('level_1'), ('level_2'), ('level_3_plus')) g(bucket) left join (select bucket, count(*) filter (where mode = 'explicit') as e, count(*) filter (where mode = 'implicit') as i,
      round(avg(lag_hours) filter (where mode = 'explicit'), 4) as ea, round(avg(lag_hours) filter (where mode = 'implicit'), 4) as ia from uw group by 1) using (bucket)"""),
    "uses_diff": q(CHANGES, """select repository_full_name, workflow_path, commit_sha, array_to_string(list_sort(list_distinct(list_filter(uses_after, lambda x: not list_contains(uses_before, x)))), ',') as introduced,
      array_to_string(list_sort(list_distinct(list_filter(uses_before, lambda x: not list_contains(uses_after, x)))), ',') as removed, len(list_distinct(list_concat(uses_before, uses_after))) as all_uses from ch"""),
    "unobserved_repositories": q("", """select name, count(*) as refs from (select lower(a.owner || '/' || a.repo) as name from ed e join ac a on a.action_id = e.dst_node_id) r
      where not exists (select 1 from repositories p where lower(p.full_name) = r.name) group by 1"""),
}

_KEYED = "kn as (select action_id, owner || '/' || repo || coalesce('/' || subpath, '') || '@' || ref as key, ref_type from ac),\n"
ORACLE["cdg_recursive"] = q(LINKS + _KEYED + """ex(c, w, src, dst, depth, down, seen, bound) as (
    select e.consumer_repository, e.workflow_path, 'workflow::' || e.consumer_repository || '::' || e.workflow_path, e.dst_node_id, 1, false, [k.key], k.ref_type
    from (select distinct consumer_repository, workflow_path, dst_node_id from sc where edge_type = 'direct') e join kn k on k.action_id = e.dst_node_id
    union select x.c, x.w, x.dst, l.dst, x.depth + 1, x.bound = 'sha' and k.ref_type = 'tag', list_append(x.seen, k.key), k.ref_type
    from ex x join al l on l.src = x.dst join kn k on k.action_id = l.dst where x.depth < 6 and not list_contains(x.seen, k.key)),
  eu as (select c, w, src, dst, depth, bool_or(down) as down from ex group by all),""",
  "select c as consumer_repository, depth, count(*) as edges, count(*) filter (where down) as downgrades from eu group by 1, 2")

_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def _part(c: str, i: int) -> str:
    return _PLAIN.format(f"split_part({c}, '/', {i})")


_O, _R, _PO, _PR = _part("n.name", 1), _part("n.name", 2), _part("p.name", 1), _part("p.name", 2)
_FULL, _OD, _RD = f"levenshtein({_PLAIN.format('n.name')}, {_PLAIN.format('p.name')})", f"levenshtein({_O}, {_PO})", f"levenshtein({_R}, {_PR})"
_RAW = "split_part({0}.name, '/', {1})"
_CONFUSION = f"""greatest(
  case when {_RAW.format('n', 1)} = {_RAW.format('p', 1)} and {_RD} <= 2 then 0.82 - 0.08 * least({_RD}, 2) else 0 end,
  case when {_RAW.format('n', 2)} = {_RAW.format('p', 2)} and {_OD} <= 2 then 0.78 - 0.08 * least({_OD}, 2) else 0 end,
  case when {_R} = {_PR} and {_O} <> {_PO} and {_OD} <= 1 then 0.88 else 0 end, case when {_O} = {_PO} and {_R} = {_PR} then 0.9 else 0 end,
  case when {_R} <> {_PR} and {_R} <> '' and {_PR} <> '' and (starts_with({_R}, {_PR}) or starts_with({_PR}, {_R}) or ends_with({_R}, {_PR}) or ends_with({_PR}, {_R})) and {_O} = {_PO} then 0.7 else 0 end,
  case when {_FULL} <= 2 then 0.68 - 0.06 * least({_FULL}, 2) else 0 end)::double"""
DISCOVERY = TRANSFER + CHANGES + f"""dn as (select name, count(*) as usage from (
    select lower(a.owner || '/' || a.repo) as name from ed e join ac a on a.action_id = e.dst_node_id
    union all select lower(split_part({_NAME}, '/', 1) || '/' || split_part({_NAME}, '/', 2)) from (select *, unnest(list_distinct(list_concat(uses_before, uses_after))) as u from ch) where {_OK}) group by 1),
df as (select lower(a.owner || '/' || a.repo) as name, count(distinct consumer_repository) as repos from sc e join ac a on a.action_id = e.dst_node_id group by 1),
dm as (select lower(owner || '/' || repo) as name, bool_or(author_verified = 'verified') as v from ac where marketplace_published group by 1),
di as (select lower(full_name) as name, arg_max(archived, (case when collected_at is null then 0 else 1 end, coalesce(epoch_us(collected_at), 0), ingest_seq)) as archived from repositories group by 1),
nm as (select dn.name, usage, coalesce(repos, 0) as repos, v as verified_creator, ip.status, di.archived from dn left join df using (name) left join dm using (name) left join ip using (name) left join di using (name)),
pp as (select name, row_number() over (order by name in {CANONICAL} desc, usage desc, repos desc, coalesce(verified_creator, false) desc, name desc) as place from nm where usage > 1 or repos > 1 or verified_creator or name in {CANONICAL} qualify place <= 20),
pc as (select n.name, p.name as near, {_FULL} as distance, {_CONFUSION} as confusion, place from nm n, pp p where n.name not in (select name from pp)),
pb as (select name, arg_min(near, (distance, -confusion, place)) as near, min(distance) as distance, arg_min(confusion, (distance, -confusion, place)) as confusion from pc group by 1),
dc as (select nm.*, near, distance, coalesce(confusion, 0) as cf from nm left join pb using (name)),
dd as (select name, usage, repos, verified_creator, status, archived, near, distance, round(cf, 4) as confusion,
  round(least(100.0, 60 * cf + case when status = 'redirected' then 35 else 0 end + case when status in ('missing', 'inaccessible') then 45 else 0 end + case when archived then 10 else 0 end
    + case when not verified_creator then 5 else 0 end + 0.5 * least(usage, 20) + 0.5 * least(repos, 20)), 4)::double as score,
  case when status in ('missing', 'inaccessible') then 'unresolved_candidate' when status = 'redirected' then 'redirection_candidate' when distance <= 2 then 'potential_typosquat'
    when cf >= 0.55 then 'potential_brand_confusion' else 'none' end as kind from dc),
"""
ORACLE["discovery_candidates"] = q(DISCOVERY, "select * from dd")
ORACLE["discovery_top"] = q(DISCOVERY, "select name, score, kind from dd where score > 0 order by score desc, repos desc, usage desc, name desc limit 15")

ORACLE["drift_merged"] = q(DRIFT + f"""tq as (select action_id, tag_name as ref_name, nullif(lower(trim(sha, {_WS})), '') as sha, epoch_us(observed_at) as ts, snapshot_no from tag_observations),
  tr0 as (select * from tq where sha is not null qualify row_number() over (partition by action_id, ref_name, ts order by snapshot_no desc) = 1),
  tl as (select *, lag(sha) over (partition by action_id, ref_name order by ts) as before from tr0),
  two as (select action_id, ref_name, sha as new_sha, ts as detected_us, 'stored' as source from tl where before <> sha union all select action_id, ref_name, new_sha, detected_us, 'observed' from dr),""",
  "select action_id, ref_name, new_sha, detected_us, max(source) as source from two group by 1, 2, 3, 4")  # stored comes after observed in the alphabet
ORACLE["discovery_summary"] = q(DISCOVERY, """select * from (select count(*) as names, count(*) filter (where kind = 'unresolved_candidate') as unresolved_candidate, count(*) filter (where kind = 'redirection_candidate') as redirection_candidate,
    count(*) filter (where kind = 'potential_typosquat') as potential_typosquat, count(*) filter (where kind = 'potential_brand_confusion') as potential_brand_confusion from dd),
  (select string_agg(score::varchar || ' ' || name || ' ' || kind, ', ' order by score, name, kind) as top_20 from (select * from dd order by score desc, repos desc, usage desc, name desc limit 20))""")  # fmt: skip
# Sketches of this size are off by about 1.6 %; none may be off by a tenth.
ORACLE["blast_estimate_error"] = q(BLAST, "select count(*) as actions, 0 as off_by_more_than_a_tenth from bl")
