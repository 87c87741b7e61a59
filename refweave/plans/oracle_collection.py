"""DuckDB SQL for the queries of refweave.plans.collection."""

from __future__ import annotations

from refweave.plans.core_problems import _WS
from refweave.plans.oracle import CHANGES, DRIFT, LINKS, RISK, TRANSFER, UPDATES, bucket, q
from refweave.plans.oracle_comparisons import PRIV
from refweave.plans.oracle_files import FILES

_KEYS = "kn as (select action_id, owner || '/' || repo || coalesce('/' || subpath, '') || '@' || ref as key, ref from ac),\n"
_KIND = """case when {0} is null or regexp_matches({0}, '\\$\\{{\\{{\\s*[^}}]+\\s*\\}}\\}}') then 'unknown' when regexp_full_match({0}, '[0-9a-fA-F]{{40}}') then 'sha' when starts_with({0}, 'refs/heads/') then 'branch'
  when regexp_full_match({0}, 'v?\\d+(\\.\\d+)*([\\-+].+)?') then 'tag' when {0} in ('main', 'master', 'develop') or contains({0}, '/') then 'branch' else 'tag' end"""
# What an action's written definition uses: everything its links lead to; only composites have one.
_DEFINED = LINKS + _KEYS + "df0 as (select distinct l.src, k.action_id as dst, k.key, k.ref from al l join kn k on k.action_id = l.dst join ac a on a.action_id = l.src),\n"
_NAME, _REF = "split_part(uses, '@', 1)", "substr(uses, instr(uses, '@') + 1)"
_COLUMNS = "repo_id, full_name, stars, is_fork, default_branch, ingest_seq"
_WHOLE = "owner is not null and owner <> '' and repo is not null and repo <> ''"

ORACLE = {
    "jsonl_round_trip": f"select {_COLUMNS} from repositories",
    "jsonl_last_row": "select repo_id, max(ingest_seq) as ingest_seq from repositories group by 1",
    "csv_round_trip": "select coalesce(repo_id, 0) as repo_id, coalesce(full_name, '') as full_name, coalesce(stars, 0) as stars, coalesce(is_fork, false) as is_fork, coalesce(default_branch, '') as default_branch, ingest_seq from repositories",
    "artifact_reload": q(PRIV, "select action_id, score, privileged_repos, artifact from vb, (values ('both'), ('only')) x(artifact)"),
    "key_value_latest": "select 'repository' as namespace, repo_id::varchar as key, arg_max(full_name, ingest_seq) as value from repositories where repo_id is not null group by repo_id",
    "ref_state": f"""with o as (select action_id, ref_name, ref_type, nullif(lower(trim(sha, {_WS})), '') as sha, ingest_seq from ref_observations where ref_type = 'tag'),
      a as (select action_id, ref_name, arg_max(sha, ingest_seq) as sha from o where sha is not null group by 1, 2), t as (select action_id, tag_name, nullif(lower(trim(sha, {_WS})), '') as sha, snapshot_no, observed_at from tag_observations),
      b as (select action_id, tag_name as ref_name, arg_max(sha, (snapshot_no, observed_at, sha)) as sha from t where sha is not null group by 1, 2)
      select action_id, ref_name, 'tag' as ref_type, coalesce(a.sha, b.sha) as sha from b left join a using (action_id, ref_name)""",
    "resumed": q("ru as (select full_name as unit, max(case when archived then 'failed' when is_fork then 'running' else 'completed' end) as status from rl group by 1),", "select * from ru where status <> 'completed' or unit not in (select repository_full_name from workflows)"),
    "sampled_repositories": q("", "select repo_id, full_name, stars from rl where not is_fork and stars >= 50 order by stars desc, repo_id limit 2000"),
    "workflow_sample": """select * from (select repository_full_name, path, row_number() over (partition by repository_full_name order by path) as place
      from (select distinct repository_full_name, path from workflows where starts_with(path, '.github/workflows/') and (lower(path) like '%.yml' or lower(path) like '%.yaml'))) where place <= 20""",
    "history_changes": q(CHANGES + """hr as (select repository_full_name, workflow_path, commit_sha, committed_us, max(list_sort(list_distinct(uses_after))) as uses from ch where committed_us is not null group by 1, 2, 3, 4),
      hn as (select * from hr qualify row_number() over (partition by repository_full_name, workflow_path order by committed_us desc, commit_sha desc) <= 50),
      hb as (select *, coalesce(lag(uses) over (partition by repository_full_name, workflow_path order by committed_us, commit_sha), []) as before from hn),""",
      """select repository_full_name, workflow_path, commit_sha, committed_us, array_to_string(list_filter(uses, lambda x: not list_contains(before, x)), ',') as introduced,
      array_to_string(list_filter(before, lambda x: not list_contains(uses, x)), ',') as removed from hb where uses <> before"""),
    "trackable_refs": q("", "select action_id, ref, ref_type from ac where ref_type in ('tag', 'branch')"),
    "marketplace_rows": q("", f"""select lower(owner) || '/' || lower(repo) as entry, count(*) as actions, 'owner' as keyed_by from ac where marketplace_published and {_WHOLE} group by 1
      union all select lower(action_name), count(*), 'name' from ac where marketplace_published and not ({_WHOLE}) group by 1"""),
    "scoped_downstream": q("", "select dst_node_id as action_id, count(distinct consumer_repository) as repositories from sc group by 1"),
    "cdg_from_files": q(FILES + _DEFINED + f"""us as (select distinct repository_full_name as c, path as w, uses from st where regexp_full_match(uses, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(/.+)?@.+') and repository_full_name in (select full_name from rl)),
      ui as (select c, w, sha1(split_part({_NAME}, '/', 1) || '::' || split_part({_NAME}, '/', 2) || '::' || array_to_string(split({_NAME}, '/')[3:], '/') || '::' || {_REF}) as action_id, uses as key, {_KIND.format(_REF)} as kind from us),
      xf(c, w, src, dst, depth, down, seen, bound) as (select c, w, 'workflow::' || c || '::' || w, action_id, 1, false, [key], kind from ui
        union select x.c, x.w, x.dst, f.dst, x.depth + 1, x.bound = 'sha' and {_KIND.format("f.ref")} = 'tag', list_append(x.seen, f.key), {_KIND.format("f.ref")} from xf x join df0 f on f.src = x.dst where x.depth < 6 and not list_contains(x.seen, f.key)),
      xg as (select c, w, src, dst, depth, bool_or(down) as down from xf group by all),""", "select c as consumer_repository, depth, count(*) as edges, count(*) filter (where down) as downgrades from xg group by 1, 2"),
    "metadata_supplement": q(_DEFINED + "mu as (select dst_node_id as action_id, count(*) as usage from sc group by 1),", """select action_id, coalesce(usage, 0) as usage, case when action_id in (select src from df0) then 'composite' else 'unknown' end as action_type
      from ac left join mu using (action_id) where action_type = 'unknown' order by usage desc, action_id limit 4000"""),
    "identity_supplement": q(TRANSFER, """select distinct name, st as identity_status from ii union select name, 'missing' from (select name, count(*) as n from (select lower(a.owner || '/' || a.repo) as name from ed e join ac a on a.action_id = e.dst_node_id) r
      where not exists (select 1 from repositories p where lower(p.full_name) = r.name) group by 1 order by n desc, name limit 1000)"""),
    "enriched_types": q(PRIV + _KEYS + "df0 as (select distinct l.src from al l join kn k on k.action_id = l.dst join ac a on a.action_id = l.src),", """select case when action_type = 'unknown' and action_id in (select src from df0) then 'composite' else action_type end as action_type, count(*) as actions, cast(sum(usage_count) as bigint) as usage,
      round(avg(score), 4) as avg_score from (select action_id, usage_count, score from ra join vb using (action_id) order by score desc, usage_count desc, ra.downstream_repos desc, action_id limit 500) join ac using (action_id) group by 1"""),
    "update_windows_ordered": q(UPDATES, "select detected_us, repository_full_name, workflow_path, mode, u.action_id, lag_hours from uw u join dr using (drift_id) order by detected_us, repository_full_name, workflow_path, mode, u.action_id"),
    "binding_panel": q(RISK + UPDATES[len(DRIFT) :], f"""select 'bindings' as panel, case when category in ('FULL_SHA', 'SHORT_SHA') then 'sha' when category = 'SEMVER_TAG' then 'semver' when category = 'MAJOR_TAG' then 'major' when category = 'FLOATING_TAG' then 'floating'
        when category in ('BRANCH_MAIN', 'BRANCH_OTHER') then 'branch' else 'unknown' end as label, count(*)::double as value from cw group by 1, 2
      union all select 'mutable', g.bucket, coalesce(v, 0) from (values ('level_1'), ('level_2'), ('level_3_plus')) g(bucket) left join (select {bucket("depth")} as bucket, round(count(*) filter (where category <> 'FULL_SHA') / count(*), 6) as v from cw group by 1) using (bucket)
      union all select 'drift', g.bucket, coalesce(v, 0) from (values ('level_1'), ('level_2'), ('level_3_plus')) g(bucket) left join (select {bucket("max_depth")} as bucket, sum(drift_refs)::double as v from rw group by 1) using (bucket)
      union all select 'lag', mode || ' ' || bucket, round(avg(lag_hours), 4) from uw group by 1, 2"""),
}
_SCOPES = ("contents", "actions", "checks", "deployments", "id-token", "issues", "packages", "pull-requests", "security-events", "statuses")
_LEVEL = """coalesce(case when lower(trim(declared_permissions['{0}'])) in ('write', 'read', 'none') then lower(trim(declared_permissions['{0}'])) when lower(trim(declared_permissions['{0}'])) = 'write-all' then 'write'
  when lower(trim(declared_permissions['{0}'])) = 'read-all' then 'read' else 'default' end, 'default')"""
ORACLE |= {
    "permission_scopes": "select ingest_seq, " + ", ".join(f"{_LEVEL.format(k)} as {k.replace('-', '_')}" for k in _SCOPES)
    + ", " + ", ".join(f"case when list_contains(map_keys(declared_permissions), '{w}') then 'write' else 'none' end as {w.replace('-', '_')}" for w in ("write-all", "read-all")) + " from actions",
    "dependency_structs": q(CHANGES, f"""select distinct uses as uses_value, split_part({_NAME}, '/', 1) as owner, split_part({_NAME}, '/', 2) as repo, case when len(split({_NAME}, '/')) > 2 then array_to_string(split({_NAME}, '/')[3:], '/') end as subpath,
      {_REF} as ref_string, {_KIND.format(_REF)} as ref_kind, regexp_matches({_REF}, '\\$\\{{\\{{\\s*[^}}]+\\s*\\}}\\}}') as is_dynamic_ref from (select unnest(uses_after) as uses from ch) where regexp_full_match(uses, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(/.+)?@.+')"""),
    "ref_tests": q("", "select edge_id, coalesce(lower(trim(ref_string)) in ('main', 'refs/heads/main'), false) as is_main, coalesce(lower(consumer_repository) = lower(a.owner || '/' || a.repo), false) as is_own from sc left join ac a on a.action_id = sc.dst_node_id"),
    "privileged_workflows": q(FILES, """select repository_full_name, path, jobs, privilege_score from pw where id_token_write or contents_write or actions_write or packages_write or deployments_write or security_events_write or write_all
      or secrets_in_env or secrets_in_with or explicit_token"""),
    "error_log": """select 'good' as kind, count(*) as n, count(distinct ingest_seq) as different from repositories where ingest_seq % 7 <> 0
      union all select 'bad', count(*), count(distinct substr('{"repo_id":' || repo_id || ',"full_name":"' || full_name, 1, 20)) from repositories where ingest_seq % 7 = 0""",
    "input_check": "select 'no_such_table.parquet' as missing",
    "preflight_checks": "select * from (values ('inputs', false), ('yaml', true)) x(\"check\", ok)",
    "markdown_table": q("mt as (select depth::bigint as depth, count(*) as n from sc group by 1),", "select '| depth | edges |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || depth || ' | ' || n || ' |', chr(10) order by depth) as text from mt"),
}
