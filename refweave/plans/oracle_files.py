"""DuckDB SQL for the queries over workflow files: fields are read line by line, on the shapes the files have.

Nothing here comes from the YAML path under test. A file is taken as readable unless a line shows one of the ways in which
files are broken (conflict marks, tabs, wrong indentation, a cut-off end, another language). Block keys stand at 0, 2, 4, 6
and 8 blanks (file, section, job, step, step's keys), texts of blocks at 10 and more.
"""

from __future__ import annotations

from refweave.plans.oracle import CHANGES, TRANSFER, category, q

# Fixed values, stated again here so that a wrong one in the code under test shows.
_SENSITIVE = ["deploy", "release", "publish", "upload", "docker push", "npm publish", "gh release", "kubectl", "terraform apply", "aws", "gcloud", "az "]
_ENV = ["github_env", "github_path"]
_OUTPUT = ["github_output", "steps.", ".outputs"]
_FILES = ["./", "bash ", "sh ", "python ", "npm install", "make", "pytest", "docker build ."]
_SHARING = "('actions/cache', 'actions/upload-artifact', 'actions/download-artifact')"
_SECRET = ["secrets.", "github_token", "api_key", "token", "aws_access_key_id", "aws_secret_access_key", "google_application_credentials", "azure_credentials", "npm_token", "pypi_token", "dockerhub_token", "claude_code_oauth_token"]
_CLOUD = ["aws_access_key_id", "aws_secret_access_key", "google_application_credentials", "azure_credentials", "aws-actions/configure-aws-credentials", "gcloud", "az login"]
_WRITES = [".github/workflows", "gh workflow", "/dispatches", "workflow_dispatch", "repository_dispatch"]

_F = "repository_full_name, path, sha"


def _any(text: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{n}')" for n in needles) + ")"


def _plain(v: str) -> str:
    """A scalar without quotes and without a comment behind it."""
    return f"case when regexp_full_match({v}, '\".*\"|''.*''') then substr({v}, 2, length({v}) - 2) else regexp_replace({v}, '\\s+#.*$', '') end"


_SPLIT = "instr(uses, '@') > 0 and instr(split_part(uses, '@', 1), '/') > 0"
_OWNER = "split_part(uses, '/', 1)"
_DOMAIN = f"""case when not ({_SPLIT}) then 'unknown' when lower({_OWNER}) in ('actions', 'github') then 'github_owned' when lower({_OWNER}) = home then 'same_owner'
    when regexp_full_match({_OWNER}, '[A-Za-z0-9_.-]+') then 'third_party' else 'unknown' end"""
_NAME = f"case when {_SPLIT} then lower(split_part(split_part(uses, '@', 1), '/', 1) || '/' || split_part(split_part(uses, '@', 1), '/', 2)) else lower(uses) end"
_REFCAT = category("case when instr(uses, '@') > 0 then substr(uses, instr(uses, '@') + 1) end")

FILES = f"""wl as (select * from workflows qualify row_number() over (partition by {_F} order by discovered_at desc nulls last, ingest_seq desc) = 1),
wt as (select {_F}, replace(content, chr(13) || chr(10), chr(10)) as t from wl where content is not null and regexp_matches(lower(path), '\\.ya?ml$')),
wg as (select *, lower(split_part(repository_full_name, '/', 1)) as home from wt where regexp_matches(t, '(?m)^name: |^\\{{') and not regexp_matches(t, '(?m)^(<<<<<<<|=======|>>>>>>>)') and not regexp_matches(t, '(?m)^\\t')
  and not regexp_matches(t, '(?m)^( {{5}}| {{7}})[a-z-]') and not regexp_matches(t, '(?m)^ {{0,8}}(- )?[a-z-]+: [`@]') and not regexp_matches(t, '(?m)^ {{0,8}}(- )?[a-z-]+: ("[^"\\n]*|''[^''\\n]*)$')
  and not regexp_matches(t, '(?m)^ {{0,8}}(- )?[a-z-]+: [A-Za-z][^\\n''"]*: ') and not regexp_matches(rtrim(t, chr(10)), '\\n {{0,8}}[a-z-]+$') and not regexp_matches(rtrim(t, chr(10)), '[\\[{{][^\\]}}\\n]*$')),
ln as (select *, length(l) - length(ltrim(l, ' ')) as ind from (select {_F}, home, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as i from wg)),
ls as (select *, last_value(case when ind = 0 then nullif(regexp_extract(l, '^"?([A-Za-z_]+)"?:', 1), '') end ignore nulls) over (partition by {_F} order by i) as top from ln),
wn as (select {_F}, home, coalesce(max(case when ind = 0 and starts_with(l, 'name: ') then {_plain("substr(l, 7)")} when starts_with(l, '  "name": ') then regexp_extract(l, '"name": "([^"]*)"', 1) end), path) as workflow_name,
    list_filter(list_concat(coalesce(string_split(max(case when ind = 0 and starts_with(l, 'on: [') then regexp_extract(l, '\\[(.*)\\]', 1) end), ', '), []),
      coalesce(list(case when top = 'on' and ind = 2 then nullif(regexp_extract(l, '^  ([a-z_]+):', 1), '') end), [])), lambda x: x is not null) as triggers,
    coalesce(bool_or(top = 'permissions' and l = '  contents: write'), false) as contents_write, coalesce(bool_or(top = 'permissions' and l = '  id-token: write'), false) as id_token_write
  from ls group by {_F}, home),
jl as (select *, last_value(case when ind = 2 then nullif(regexp_extract(l, '^  ([A-Za-z0-9_-]+):', 1), '') end ignore nulls) over w as job,
    last_value(case when ind = 4 then nullif(regexp_extract(l, '^    ([A-Za-z0-9_-]+):', 1), '') end ignore nulls) over w as jkey, sum(case when starts_with(l, '      - ') then 1 else 0 end) over w as step
  from ls where top = 'jobs' window w as (partition by {_F} order by i)),
jb as (select {_F}, home, job as job_id, bool_or(jkey = 'steps') as has_steps, max(case when ind = 4 and jkey = 'needs' then string_split(regexp_extract(l, '\\[(.*)\\]', 1), ', ') end) as needs,
    max(case when ind = 4 and jkey = 'name' then {_plain("substr(l, 11)")} end) as job_name
  from jl where job is not null group by {_F}, home, job),
sk as (select *, last_value(nullif(regexp_extract(l, '^(?:      - |        )([a-z-]+):', 1), '') ignore nulls) over (partition by {_F}, step order by i) as skey,
    regexp_extract(l, '^(?:      - |        )([a-z-]+): ?(.*)$', 2) as v, regexp_matches(l, '^(?:      - |        )[a-z-]+:') as is_key from jl where jkey = 'steps' and step > 0 and ind >= 6),
st as (select {_F}, home, job as job_id, step, row_number() over (partition by {_F}, job order by step) - 1 as idx, trim(coalesce(max(case when is_key and skey = 'name' then {_plain("v")} end), '')) as name,
    max(case when is_key and skey = 'uses' then {_plain("v")} end) as uses,
    coalesce(max(case when is_key and skey = 'run' and v not in ('|', '|-', '>', '>-') then v end), string_agg(case when skey = 'run' and not is_key then substr(l, 11) end, chr(10) order by i) || chr(10), '') as run,
    coalesce('{{' || string_agg(case when skey = 'with' and not is_key then '''' || split_part(ltrim(l), ': ', 1) || ''': ''' || {_plain("substr(ltrim(l), instr(ltrim(l), ': ') + 2)")} || '''' end, ', ' order by i) || '}}', '') as with_text
  from sk group by {_F}, home, job, step),
sp as (select *, {_DOMAIN} as domain, case when {_SPLIT} then {_OWNER} end as owner, {_NAME} as action, {_REFCAT} in ('BRANCH_MAIN', 'BRANCH_OTHER', 'FLOATING_TAG', 'UNKNOWN_REF', 'MAJOR_TAG') as movable,
    {_any("concat_ws(' ', name, run)", _SENSITIVE)} as sensitive, concat_ws(' ', name, uses, run, case when uses is not null then with_text end, '') as said from st),
ij as (select {_F}, job_id, count(*) as steps, count(uses) as uses_steps, count(*) filter (where uses is not null and domain = 'third_party') as third_party_steps, count(distinct owner) as owners,
    count(distinct case when uses is not null then domain end) as domains, min(case when uses is not null then idx end) as first_uses, max(case when uses is null and sensitive then idx end) as last_sensitive,
    min(case when uses is not null and domain in ('third_party', 'unknown') then idx end) as first_untrusted, bool_or({_any("said", _FILES)} or coalesce(action in {_SHARING}, false)) as files,
    bool_or({_any("said", _ENV)}) as env_signal, bool_or({_any("said", _OUTPUT)}) as output_signal,
    array_to_string(list(case when sensitive then coalesce(nullif(name, ''), substr(run, 1, 80)) end order by idx) filter (where sensitive), ' | ') as sensitive_steps from sp group by {_F}, job_id),
jz as (select j.{_F.replace(", ", ", j.")}, w.workflow_name, j.job_id, j.job_name, coalesce(steps, 0) as steps, coalesce(uses_steps, 0) as uses_steps, coalesce(third_party_steps, 0) as third_party_steps, coalesce(owners, 0) as owners,
    coalesce(domains, 0) as domains, coalesce(third_party_steps >= 2, false) as multiple_third_party, coalesce(domains >= 2, false) as mixed_domains, coalesce(first_uses < last_sensitive, false) as action_before_sensitive,
    coalesce(first_untrusted < last_sensitive, false) as untrusted_before_sensitive, coalesce(files, false) as shared_workspace, coalesce(env_signal, false) as env_signal, coalesce(output_signal, false) as output_signal,
    coalesce(files, false) as file_signal, coalesce(sensitive_steps, '') as sensitive_steps
  from jb j join wn w using ({_F}) left join ij using ({_F}, job_id) where has_steps),
io as (select *, round(2.0 * multiple_third_party::int + 1.5 * mixed_domains::int + 2.5 * action_before_sensitive::int + 3.0 * untrusted_before_sensitive::int + shared_workspace::int + env_signal::int + output_signal::int + file_signal::int, 4)::double
    as signal_score from jz),
mx as (select repository_full_name, path, job_id, arg_max(mixed_domains, sha) as mixed from io group by 1, 2, 3),
pv as (select {_F}, job_id, bool_or({_any("with_text", _SECRET)}) as secrets_in_with, bool_or({_any("concat_ws(' ', '', with_text, run)", ["github_token"])}) as explicit_token,
    bool_or({_any("concat_ws(' ', '', with_text, run, uses)", _CLOUD)}) as cloud_credentials, count(*) filter (where uses is not null and domain = 'third_party') as third_party_actions,
    count(*) filter (where uses is not null and domain = 'third_party' and movable) as movable_actions from sp group by {_F}, job_id),
pa0 as (select j.{_F.replace(", ", ", j.")}, w.workflow_name, j.job_id, w.id_token_write, w.contents_write, w.id_token_write or w.contents_write as high_privilege, list_contains(list_transform(triggers, lambda x: lower(x)), 'pull_request_target') as pull_request_target,
    coalesce(secrets_in_with, false) as secrets_in_with, coalesce(explicit_token, false) as explicit_token, coalesce(cloud_credentials, false) as cloud_credentials, coalesce(third_party_actions, 0) as third_party_actions,
    coalesce(movable_actions, 0) as movable_actions, coalesce(mixed, false) as mixed
  from jb j join wn w using ({_F}) left join pv using ({_F}, job_id) left join mx on mx.repository_full_name = j.repository_full_name and mx.path = j.path and mx.job_id = j.job_id),
pb as (select *, third_party_actions > 0 and high_privilege as third_party_with_privilege, movable_actions > 0 and high_privilege as mutable_with_privilege,
    mixed and (high_privilege or secrets_in_with or explicit_token or cloud_credentials) as isolation_coupling, high_privilege or pull_request_target or secrets_in_with as any_signal from pa0),
pj as (select {_F}, workflow_name, job_id, id_token_write, contents_write, false as actions_write, false as packages_write, false as deployments_write, false as security_events_write, false as write_all, false as read_all, high_privilege,
    pull_request_target, false as secrets_in_env, secrets_in_with, explicit_token, cloud_credentials, third_party_actions, movable_actions, third_party_with_privilege, mutable_with_privilege, isolation_coupling, any_signal,
    round(6.0 * mutable_with_privilege::int + 4.5 * id_token_write::int + 3.0 * contents_write::int + 2.0 * secrets_in_with::int + 1.5 * explicit_token::int + 1.5 * cloud_credentials::int + 2.0 * pull_request_target::int
      + 1.5 * isolation_coupling::int, 4)::double as privilege_score from pb),
dq as (select consumer_repository as repository_full_name, workflow_path as path, cast(max(depth) as bigint) as max_depth from sc group by 1, 2),
pw as (select p.repository_full_name, p.path, count(*) as jobs, count(*) filter (where any_signal) as privileged_jobs, %FLAGS%, round(sum(privilege_score), 4) as privilege_score, coalesce(max(max_depth), 0) as max_depth
  from pj p left join dq using (repository_full_name, path) group by 1, 2),
"""
FLAGS = (
    "id_token_write", "contents_write", "actions_write", "packages_write", "deployments_write", "security_events_write", "write_all", "read_all", "pull_request_target",
    "secrets_in_env", "secrets_in_with", "explicit_token", "cloud_credentials", "third_party_with_privilege", "mutable_with_privilege", "isolation_coupling",
)
FILES = FILES.replace("%FLAGS%", ", ".join(f"bool_or({f}) as {f}" for f in FLAGS))

CHANNELS = FILES + f"""ne as (select {_F}, job_id, unnest(needs) as need from jb),
nd as (select {_F}, job_id as node, 0 as depth from jb union select {_F}, need, 0 from ne),
dp({_F}, node, depth) as (select * from nd where not exists (select 1 from ne e where e.repository_full_name = nd.repository_full_name and e.path = nd.path and e.sha = nd.sha and e.job_id = nd.node)
  union select e.{_F.replace(", ", ", e.")}, e.job_id, d.depth + 1 from dp d join ne e on e.repository_full_name = d.repository_full_name and e.path = d.path and e.sha = d.sha and e.need = d.node where d.depth < 60),
ch0 as (select {_F}, bool_or(action = 'actions/upload-artifact') as artifact_upload, bool_or(action = 'actions/download-artifact') as artifact_download, bool_or(action = 'actions/cache') as cache,
    bool_or({_any("concat_ws(' ', run, with_text, '', name)", ["needs.", ".outputs"])}) as needs_outputs, bool_or(contains(uses, '/.github/workflows/')) as reusable_call,
    bool_or({_any("concat_ws(' ', run, with_text, '', name)", _WRITES)}) as writes_workflow_files from sp group by {_F}),
mj as (select distinct {_F}, job_id from sp where uses is not null and instr(uses, '@') > 0 and movable),
pg as (select w.{_F.replace(", ", ", w.")}, (select count(*) from jb j where j.repository_full_name = w.repository_full_name and j.path = w.path and j.sha = w.sha) as jobs,
    (select count(*) from ne e where e.repository_full_name = w.repository_full_name and e.path = w.path and e.sha = w.sha) as needs_edges, coalesce((select max(depth) from dp d where d.repository_full_name = w.repository_full_name and d.path = w.path and d.sha = w.sha), 0) as max_job_depth,
    coalesce(artifact_upload, false) as artifact_upload, coalesce(artifact_download, false) as artifact_download, coalesce(cache, false) as cache, false as job_outputs, coalesce(needs_outputs, false) as needs_outputs,
    list_contains(triggers, 'workflow_run') as on_workflow_run, list_contains(triggers, 'repository_dispatch') as on_repository_dispatch, list_contains(triggers, 'workflow_dispatch') as on_workflow_dispatch,
    list_contains(triggers, 'workflow_call') as on_workflow_call, coalesce(reusable_call, false) as reusable_call, coalesce(writes_workflow_files, false) as writes_workflow_files,
    exists (select 1 from ne e join mj m on m.repository_full_name = e.repository_full_name and m.path = e.path and m.sha = e.sha and m.job_id = e.need where e.repository_full_name = w.repository_full_name and e.path = w.path and e.sha = w.sha) as up
  from wn w left join ch0 using ({_F})),
ph as (select *, artifact_upload::int + artifact_download::int + cache::int + needs_outputs::int + on_workflow_run::int + on_repository_dispatch::int + on_workflow_dispatch::int + on_workflow_call::int + reusable_call::int + writes_workflow_files::int as channel_count,
    up and (artifact_download or needs_outputs or cache) as mutable_downstream from pg),
pp as (select h.* exclude (up), coalesce(w.privilege_score > 0 and channel_count > 0, false) as privilege_coupling from ph h left join pw w using (repository_full_name, path)),
pr as (select *, round(channel_count + 0.35 * needs_edges + 0.75 * max_job_depth + 2.5 * privilege_coupling::int + 2.0 * mutable_downstream::int + on_workflow_run::int + on_repository_dispatch::int
    + (on_workflow_call or reusable_call)::int, 4)::double as propagation_score from pp),
"""

_REMOTE, _LOCAL = "'(?i)^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/\\.github/workflows/[^@]+\\.(?:yml|yaml)@.+$'", "'(?i)^\\./\\.github/workflows/[^@]+\\.(?:yml|yaml)$'"
CALLS = CHANGES + f"""cu as (select distinct repository_full_name, workflow_path as path, commit_sha as sha, u as uses, lower(split_part(repository_full_name, '/', 1)) as home
    from (select * exclude (u), unnest(case when regexp_matches(u, {_REMOTE}) and length(u) % 3 = 0 then [u, './' || regexp_extract(u, '(\\.github/workflows/[^@]+)@', 1)] else [u] end) as u
      from (select *, unnest(list_distinct(uses_after)) as u from ch)) where regexp_matches(u, {_REMOTE}) or regexp_matches(u, {_LOCAL})),
cc as (select *, regexp_matches(uses, {_REMOTE}) as is_remote, {_REFCAT} as cat from cu),
rc as (select {_F}, 'call_' || substr(sha1(uses), 1, 8) as job_id, is_remote, case when is_remote then uses else repository_full_name || '/' || substr(uses, 3) end as callee, case when is_remote then cat else 'LOCAL_PATH' end as ref_type,
    is_remote and cat in ('BRANCH_MAIN', 'BRANCH_OTHER', 'FLOATING_TAG', 'UNKNOWN_REF', 'MAJOR_TAG') as is_mutable, is_remote and lower({_OWNER}) <> home as is_cross_org,
    is_remote and lower({_OWNER}) not in (home, 'actions', 'github') as is_third_party, length(uses) % 2 = 0 as inherits_secrets, length(path) % 3 in (0, 1) as has_permissions, length(path) % 3 = 0 as id_token_write from cc),
rl0 as (select callee, bool_or(is_remote) as is_remote, count(*) as calls, count(distinct repository_full_name) as repositories, {", ".join(f"count(*) filter (where {f}) as {f}" for f in ("is_mutable", "inherits_secrets", "has_permissions", "id_token_write", "is_cross_org", "is_third_party"))} from rc group by 1),
"""


def _count(flags, prefix: str = "") -> str:
    return ", ".join(f"count(*) filter (where {f}) as {prefix}{f}" for f in flags)


def _flag_rows(table: str, flags: list[str]) -> str:
    return " union all ".join(f"select '{f}' as flag, count(*) filter (where {f}) as n, round(case when count(*) > 0 then count(*) filter (where {f}) / count(*) else 0 end, 6) as rate from {table}" for f in flags)


_ISO = "repository_full_name, path, sha, workflow_name, job_id, job_name, steps, uses_steps, third_party_steps, owners, domains, multiple_third_party, mixed_domains, action_before_sensitive, untrusted_before_sensitive, shared_workspace, env_signal, output_signal, file_signal"
_P95 = "(select owners from (select owners, row_number() over (order by owners) as rn, count(*) over () as n from io) where rn = round_even((n - 1) * 0.95, 0) + 1)"
_PROP = ("artifact_upload", "artifact_download", "cache", "job_outputs", "needs_outputs", "on_workflow_run", "on_workflow_call", "reusable_call", "privilege_coupling", "mutable_downstream")
ORACLE = {
    "isolation_by_job": q(FILES, f"select {_ISO}, signal_score from io"),
    "isolation_summary": q(FILES, f"""select count(*) as jobs, count(*) filter (where uses_steps >= 2) as with_several_actions, {_count(("mixed_domains", "untrusted_before_sensitive", "env_signal", "output_signal", "file_signal"))},
      median(owners) as median_owners, {_P95} as p95_owners from io"""),
    "isolation_examples": q(FILES, f"""select {_ISO}, sensitive_steps, signal_score from io where untrusted_before_sensitive or action_before_sensitive or mixed_domains
      order by signal_score desc, third_party_steps desc, owners desc, lower(repository_full_name) desc, lower(job_id) desc, path desc, sha desc limit 50"""),
    "isolation_signals": q(FILES, _flag_rows("io", ["mixed_domains", "action_before_sensitive", "untrusted_before_sensitive", "env_signal", "output_signal", "file_signal"])),
    "isolation_histogram": q(FILES, "select domains, count(*) as jobs from io group by 1"),
    "privilege_by_job": q(FILES, "select * from pj"),
    "privilege_by_workflow": q(FILES, "select * from pw"),
    "privilege_summary": q(FILES, f"""select * from (select count(*) as workflows, {_count(("id_token_write", "write_all", "pull_request_target"), "workflows_")} from pw), (select count(*) as jobs, {_count(FLAGS, "jobs_")} from pj)"""),
    "privilege_examples": q(FILES + """pt as (select * from pw where privilege_score > 0 order by privilege_score desc, privileged_jobs desc, lower(repository_full_name) desc, path desc limit 50),
      pk as (select p.repository_full_name, p.path, p.job_id, row_number() over (partition by p.repository_full_name, p.path order by p.privilege_score desc, movable_actions desc, lower(job_id) desc, sha desc) as r
        from pj p join pt using (repository_full_name, path) where p.privilege_score > 0),
      pm as (select repository_full_name, path, string_agg(job_id, ',' order by r) as risky_jobs from pk where r <= 10 group by 1, 2),""", "select pt.*, risky_jobs from pt left join pm using (repository_full_name, path)"),
    "privilege_signals": q(FILES, _flag_rows("pj", ["id_token_write", "contents_write", "actions_write", "packages_write", "deployments_write", "security_events_write", "write_all", "isolation_coupling"])),
    "id_token_by_depth": q(FILES, """select case when max_depth <= 1 then 'level_1' when max_depth = 2 then 'level_2' else 'level_3_plus' end as bucket, count(*) as workflows,
      round(count(*) filter (where id_token_write) / count(*), 6) as id_token_rate from pw group by 1"""),
    "propagation_by_workflow": q(CHANNELS, "select * from pr"),
    "propagation_summary": q(CHANNELS, f"select count(*) as workflows, {_count(_PROP)}, max(max_job_depth) as max_job_depth, round(avg(channel_count), 6) as avg_channels, round(avg(needs_edges), 6) as avg_needs_edges from pr"),
    "propagation_examples": q(CHANNELS, """select * from pr where propagation_score > 0
      order by propagation_score desc, channel_count desc, needs_edges desc, lower(repository_full_name) desc, path desc, sha desc limit 50"""),
    "propagation_signals": q(CHANNELS, _flag_rows("pr", ["artifact_upload", "artifact_download", "cache", "job_outputs", "needs_outputs", "reusable_call"])),
    "channel_buckets": q(CHANNELS, """select g.bucket, count(c.bucket) as workflows from (values ('0'), ('1'), ('2'), ('3'), ('4+')) g(bucket)
      left join (select case when channel_count >= 4 then '4+' else channel_count::varchar end as bucket from pr) c using (bucket) group by 1"""),
    "channels_by_job_depth": q(CHANNELS, """select case when max_job_depth >= 2 then '2+' else max_job_depth::varchar end as bucket, count(*) as workflows, round(count(*) filter (where artifact_upload or artifact_download) / count(*), 6) as artifact_rate,
      round(count(*) filter (where cache) / count(*), 6) as cache_rate from pr group by 1"""),
    "workflow_uses": q(FILES, f"""select w.{_F.replace(", ", ", w.")}, coalesce(u.uses, '') as uses from wn w left join (select {_F}, array_to_string(list_sort(list_distinct(list(uses))), ',') as uses from st
      where regexp_full_match(uses, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(/.+)?@.+') group by all) u using ({_F})"""),
}
# A path may not follow on a word, point, slash or dash; without look-behind the mark before it is matched as well.
ORACLE["script_paths"] = r"""select ingest_seq, len(list_distinct(list_transform(regexp_extract_all(regexp_replace(content, '([^\w./-])', '\1\1', 'g'), '(?:^|[^\w./-])((?:\./)?[\w./-]+\.(?:sh|bash|ps1|cmd|py|js|mjs|cjs|ts))', 1), lambda x: x))) as paths
  from workflows where content is not null"""
ORACLE["action_kinds"] = q("", """select action_type, case when action_type in ('composite', 'docker', 'javascript') then action_type else 'unknown' end as kind, count(*) as actions,
  cast(sum(case when action_type = 'composite' then 1 else 0 end) as bigint) as uses from ac group by 1, 2""")
_STRATA = {"local": "not is_remote", "remote": "is_remote", "remote_same_org": "is_remote and not is_cross_org", "remote_cross_org": "is_remote and is_cross_org", "remote_third_party": "is_remote and is_third_party"}
_CALL_FLAGS = ("is_mutable", "inherits_secrets", "has_permissions", "id_token_write")
ORACLE |= {
    "reusable_calls": q(CALLS, "select rc.*, l.repositories as downstream_repositories from rc join rl0 l using (callee)"),
    "reusable_callees": q(CALLS, "select * from rl0"),
    "callee_histogram": q(CALLS, "select repositories, count(*) as callees from rl0 group by 1"),
    "reusable_summary": q(CALLS, f"select count(*) as calls, {_count(('is_remote', 'is_mutable', 'is_cross_org', 'is_third_party', 'inherits_secrets', 'has_permissions', 'id_token_write'))}, count(distinct callee) as callees, count(distinct callee) filter (where is_remote) as remote_callees from rc"),
    "reusable_profile": q(CALLS, " union all ".join(f"""select '{n}' as stratum, count(*) as calls, {_count(_CALL_FLAGS)}, {", ".join(f"round(case when count(*) > 0 then count(*) filter (where {f}) / count(*) else 0 end, 6) as {f}_share" for f in _CALL_FLAGS)},
      round(avg(repositories), 4) as avg_downstream from (select rc.*, l.repositories from rc join rl0 l using (callee)) where {c}""" for n, c in _STRATA.items())),
}
TRANSFER_RISKS = FILES + TRANSFER + """tw as (select repository_full_name as consumer_repository, path as workflow_path, arg_max(contents_write or id_token_write, sha) as has_write from wn group by 1, 2),
tu as (select lower(a.owner || '/' || a.repo) as name, a.action_id, s.workflow_id, s.consumer_repository, case when has_write then s.workflow_id end as privileged_id from sc s join ac a on a.action_id = s.dst_node_id left join tw using (consumer_repository, workflow_path)),
tv as (select name, count(distinct workflow_id) as workflows, count(distinct consumer_repository) as repositories, count(distinct privileged_id) as privileged_workflows from tu group by 1),
ta1 as (select lower(owner || '/' || repo) as name, count(*) as actions, count(*) filter (where ref_type = 'sha') as sha_references, count(*) filter (where ref_type = 'tag') as tag_references, count(*) filter (where ref_type = 'branch') as branch_references,
  count(*) filter (where ref_type = 'branch' and lower(ref) = 'main') as main_references from ac group by 1),
rk1 as (select k.name, status, resolved, latest_id, ids, observations, first_us, last_us, risk_type, coalesce(actions, 0) as actions, coalesce(sha_references, 0) as sha_references, coalesce(tag_references, 0) as tag_references,
  coalesce(branch_references, 0) as branch_references, coalesce(main_references, 0) as main_references, coalesce(workflows, 0) as workflows, coalesce(repositories, 0) as repositories, coalesce(privileged_workflows, 0) as privileged_workflows
  from ik k left join ta1 using (name) left join tv using (name)),
"""
ORACLE |= {
    "transfer_risks": q(TRANSFER_RISKS, "select * from rk1"),
    "transfer_risks_ordered": q(TRANSFER_RISKS, "select * from rk1 order by risk_type desc, privileged_workflows desc, workflows desc, name desc"),
    "transfer_summary": q(TRANSFER_RISKS, """select * from (select count(*) as risks, count(distinct name) as names, count(*) filter (where risk_type = 'redirected') as redirected, count(*) filter (where risk_type = 'missing') as missing,
      count(*) filter (where risk_type = 'repository_id_changed') as repository_id_changed from rk1), (select count(distinct name) as observed from ii),
      (select count(*) as actions from ac where lower(owner || '/' || repo) in (select name from rk1)),
      (select count(distinct workflow_id) as workflows, count(distinct consumer_repository) as repositories, count(distinct privileged_id) as privileged_workflows from tu where name in (select name from rk1))"""),
}
