"""Job and workflow signals over parsed workflow documents: isolation, privilege, propagation, calls.

All of it is higher-order functions over a job's steps: no row leaves its partition until workflows are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions import exprs as X

# Needles of the signals (substrings in any letter case) and the actions that share files.
SENSITIVE = ("deploy", "release", "publish", "upload", "docker push", "npm publish", "gh release", "kubectl", "terraform apply", "aws", "gcloud", "az ")
ENV_NEEDLES = ("GITHUB_ENV", "GITHUB_PATH")
OUTPUT_NEEDLES = ("GITHUB_OUTPUT", "steps.", ".outputs")
FILE_NEEDLES = ("./", "bash ", "sh ", "python ", "npm install", "make", "pytest", "docker build .")
FILE_ACTIONS = ("actions/cache", "actions/upload-artifact", "actions/download-artifact")
SECRET_NEEDLES = (
    "secrets.", "GITHUB_TOKEN", "API_KEY", "TOKEN", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GOOGLE_APPLICATION_CREDENTIALS",
    "AZURE_CREDENTIALS", "NPM_TOKEN", "PYPI_TOKEN", "DOCKERHUB_TOKEN", "CLAUDE_CODE_OAUTH_TOKEN",
)
CLOUD_NEEDLES = (
    "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GOOGLE_APPLICATION_CREDENTIALS", "AZURE_CREDENTIALS",
    "aws-actions/configure-aws-credentials", "gcloud", "az login",
)
WORKFLOW_FILE_NEEDLES = (".github/workflows", "gh workflow", "/dispatches", "workflow_dispatch", "repository_dispatch")
WRITABLE = ("id-token", "contents", "actions", "packages", "deployments", "security-events")
# Weights of the scores.
ISOLATION_WEIGHTS = {
    "multiple_third_party": 2.0, "mixed_domains": 1.5, "action_before_sensitive": 2.5, "untrusted_before_sensitive": 3.0,
    "shared_workspace": 1.0, "env_signal": 1.0, "output_signal": 1.0, "file_signal": 1.0,
}
PRIVILEGE_WEIGHTS = {
    "mutable_with_privilege": 6.0, "id_token_write": 4.5, "write_all": 4.0, "contents_write": 3.0, "actions_write": 2.5, "packages_write": 2.0,
    "deployments_write": 2.0, "security_events_write": 2.0, "secrets_in_with": 2.0, "secrets_in_env": 1.5, "explicit_token": 1.5,
    "cloud_credentials": 1.5, "pull_request_target": 2.0, "isolation_coupling": 1.5,
}

KEY = ["repository_full_name", "path", "sha"]


def _score(weights: dict[str, float]) -> Column:
    return F.round(sum((F.when(F.col(name), F.lit(w)).otherwise(0.0) for name, w in weights.items()), F.lit(0.0)), 4)


def jobs(docs: DataFrame) -> DataFrame:
    """One row per job: the document's key, name, triggers and permissions, and the job's fields."""
    rows = docs.where("doc is not null").select(*KEY, F.col("doc.name").alias("workflow_name"), "doc.triggers", F.col("doc.permissions").alias("workflow_permissions"), F.explode("doc.jobs").alias("j"))
    return rows.select(*KEY, F.coalesce("workflow_name", "path").alias("workflow_name"), "triggers", "workflow_permissions", "j.*").withColumn("home", F.lower(X.owner_of(F.col("repository_full_name"))))


def _any(steps: Column, test) -> Column:
    return F.coalesce(F.exists(steps, test), F.lit(False))


def isolation(job_rows: DataFrame) -> DataFrame:
    """Per job with steps: who acts in it, what comes before its sensitive commands, which channels it shares."""
    s = F.col("steps")
    home = F.col("home")
    uses = F.filter(s, lambda x: x["uses"].isNotNull())
    domains = F.array_sort(F.array_distinct(F.transform(uses, lambda x: X.trust_domain(x["uses"], home))))
    owners = F.array_sort(F.array_distinct(F.filter(F.transform(uses, lambda x: F.when(X.uses_part(x["uses"], 1).isNotNull(), X.uses_part(x["uses"], 0))), lambda o: o.isNotNull())))
    third = F.size(F.filter(uses, lambda x: X.trust_domain(x["uses"], home) == "third_party"))

    def sensitive(x: Column) -> Column:
        return X.contains_any(F.concat_ws(" ", x["name"], x["run"]), SENSITIVE)

    last = F.array_max(F.transform(F.filter(s, lambda x: x["uses"].isNull() & sensitive(x)), lambda x: x["idx"]))
    first = F.array_min(F.transform(uses, lambda x: x["idx"]))
    untrusted = F.array_min(F.transform(F.filter(uses, lambda x: X.trust_domain(x["uses"], home).isin("third_party", "unknown")), lambda x: x["idx"]))

    def text(x: Column) -> Column:
        with_text = F.when(x["uses"].isNotNull(), x["with_text"])
        return F.concat_ws(" ", x["name"], x["uses"], x["run"], with_text, x["env_text"])

    job_text = F.concat_ws(" ", "env_text", "permissions_text", "outputs_text")
    shares = _any(uses, lambda x: X.action_name(x["uses"]).isin(*FILE_ACTIONS))
    files = _any(s, lambda x: X.contains_any(text(x), FILE_NEEDLES)) | shares
    out = job_rows.where("has_steps").select(
        *KEY, "workflow_name", "job_id", "job_name", F.size(s).alias("steps"), F.size(uses).alias("uses_steps"), third.alias("third_party_steps"),
        F.size(owners).alias("owners"), F.size(domains).alias("domains"), (third >= 2).alias("multiple_third_party"), (F.size(domains) >= 2).alias("mixed_domains"),
        F.coalesce(first < last, F.lit(False)).alias("action_before_sensitive"), F.coalesce(untrusted < last, F.lit(False)).alias("untrusted_before_sensitive"),
        files.alias("shared_workspace"), (_any(s, lambda x: X.contains_any(text(x), ENV_NEEDLES)) | X.contains_any(job_text, ENV_NEEDLES)).alias("env_signal"),
        (_any(s, lambda x: X.contains_any(text(x), OUTPUT_NEEDLES)) | X.contains_any(job_text, OUTPUT_NEEDLES)).alias("output_signal"), files.alias("file_signal"),
        F.transform(F.filter(s, sensitive), lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), F.substring(x["run"], 1, 80))).alias("sensitive_steps"),
    )
    return out.withColumn("signal_score", _score(ISOLATION_WEIGHTS))


def _is_write(p: Column, scope: str) -> Column:
    return F.coalesce(p["write-all"] == "write", F.lit(False)) | F.coalesce(p[scope] == "write", F.lit(False))


def privilege(job_rows: DataFrame, isolated: DataFrame) -> DataFrame:
    """Per job: effective permissions, secrets in reach, movable third-party actions and what they add up to.

    A job's levels replace the workflow's where they are not the default; a workflow's write-all does not reach
    its jobs, as in the semantics to be matched.
    """
    mixed = isolated.groupBy("repository_full_name", "path", "job_id").agg(F.max_by("mixed_domains", "sha").alias("mixed"))
    wp = F.map_filter("workflow_permissions", lambda k, v: ~k.isin("write-all", "read-all"))
    p = F.col("p")
    s = F.col("steps")
    third = F.filter(s, lambda x: X.trust_domain(x["uses"], F.col("home")) == "third_party")
    movable = F.filter(third, lambda x: X.is_movable(X.ref_category(X.uses_ref(x["uses"]))))

    def anywhere(x: Column, *fields: str) -> Column:
        return F.concat_ws(" ", *[x[f] for f in fields])

    rows = job_rows.withColumn("p", X.merge_permissions(wp, F.col("permissions"))).join(mixed, ["repository_full_name", "path", "job_id"], "left")
    writes = {w: _is_write(p, w) for w in WRITABLE}
    high = writes["id-token"]
    for w in WRITABLE[1:]:
        high = high | writes[w]
    out = rows.select(
        *KEY, "workflow_name", "job_id", "triggers", *[c.alias(f"{w.replace('-', '_')}_write") for w, c in writes.items()], F.coalesce(p["write-all"] == "write", F.lit(False)).alias("write_all"),
        F.coalesce(p["read-all"] == "write", F.lit(False)).alias("read_all"), high.alias("high_privilege"), F.exists("triggers", lambda t: F.lower(t) == "pull_request_target").alias("pull_request_target"),
        (X.contains_any(F.col("env_text"), SECRET_NEEDLES) | _any(s, lambda x: X.contains_any(x["env_text"], SECRET_NEEDLES))).alias("secrets_in_env"),
        _any(s, lambda x: X.contains_any(x["with_text"], SECRET_NEEDLES)).alias("secrets_in_with"),
        _any(s, lambda x: X.contains_any(anywhere(x, "env_text", "with_text", "run"), ("GITHUB_TOKEN",))).alias("explicit_token"),
        (X.contains_any(F.col("env_text"), CLOUD_NEEDLES) | _any(s, lambda x: X.contains_any(anywhere(x, "env_text", "with_text", "run", "uses"), CLOUD_NEEDLES))).alias("cloud_credentials"),
        F.size(third).alias("third_party_actions"), F.size(movable).alias("movable_actions"), F.coalesce("mixed", F.lit(False)).alias("mixed"),
    )
    out = out.withColumn("third_party_with_privilege", (F.col("third_party_actions") > 0) & F.col("high_privilege"))
    out = out.withColumn("mutable_with_privilege", (F.col("movable_actions") > 0) & F.col("high_privilege"))
    reach = F.col("high_privilege") | F.col("secrets_in_env") | F.col("secrets_in_with") | F.col("explicit_token") | F.col("cloud_credentials")
    out = out.withColumn("isolation_coupling", F.col("mixed") & reach)
    out = out.withColumn("any_signal", F.col("high_privilege") | F.col("pull_request_target") | F.col("secrets_in_env") | F.col("secrets_in_with"))
    return out.withColumn("privilege_score", _score(PRIVILEGE_WEIGHTS)).drop("mixed")


PRIVILEGE_FLAGS = (
    "id_token_write", "contents_write", "actions_write", "packages_write", "deployments_write", "security_events_write", "write_all", "read_all", "pull_request_target",
    "secrets_in_env", "secrets_in_with", "explicit_token", "cloud_credentials", "third_party_with_privilege", "mutable_with_privilege", "isolation_coupling",
)


def privilege_by_workflow(job_privilege: DataFrame, depths: DataFrame) -> DataFrame:
    """Per workflow, the jobs of all its versions together: any of each flag, summed score, depth (0 if unknown)."""
    out = job_privilege.groupBy("repository_full_name", "path").agg(
        F.count("*").alias("jobs"), F.count_if("any_signal").alias("privileged_jobs"), *[F.bool_or(f).alias(f) for f in PRIVILEGE_FLAGS], F.round(F.sum("privilege_score"), 4).alias("privilege_score")
    )
    return out.join(depths, ["repository_full_name", "path"], "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(0).cast("long")))


def propagation(docs: DataFrame, workflow_privilege: DataFrame) -> DataFrame:
    """Per workflow version: channels by which one job, run or workflow reaches another, and how far."""
    d = F.col("doc")
    steps = F.flatten(F.transform(d["jobs"], lambda j: j["steps"]))

    def named(*names: str) -> Column:
        return _any(steps, lambda x: x["uses"].isNotNull() & X.action_name(x["uses"]).isin(*names))

    def says(needles: tuple[str, ...]) -> Column:
        return _any(steps, lambda x: X.contains_any(F.concat_ws(" ", x["run"], x["with_text"], x["env_text"], x["name"]), needles))

    def trigger(name: str) -> Column:
        return _any(d["triggers"], lambda t: F.lower(t) == name)

    channels = {
        "artifact_upload": named("actions/upload-artifact"), "artifact_download": named("actions/download-artifact"), "cache": named("actions/cache"),
        "job_outputs": _any(d["jobs"], lambda j: j["has_outputs"]), "needs_outputs": says(("needs.", ".outputs")), "on_workflow_run": trigger("workflow_run"),
        "on_repository_dispatch": trigger("repository_dispatch"), "on_workflow_dispatch": trigger("workflow_dispatch"), "on_workflow_call": trigger("workflow_call"),
        "reusable_call": _any(steps, lambda x: x["uses"].contains("/.github/workflows/")), "writes_workflow_files": says(WORKFLOW_FILE_NEEDLES),
    }
    needs = F.flatten(F.transform(d["jobs"], lambda j: j["needs"]))
    movable = F.transform(F.filter(d["jobs"], lambda j: F.exists(j["steps"], lambda x: X.is_movable(X.ref_category(X.uses_ref(x["uses"]))) & x["uses"].isNotNull() & (F.instr(x["uses"], "@") > 0))), lambda j: j["job_id"])
    out = docs.where("doc is not null").select(
        *KEY, F.size(d["jobs"]).alias("jobs"), F.size(needs).alias("needs_edges"), d["max_job_depth"].alias("max_job_depth"), *[c.alias(n) for n, c in channels.items()], F.arrays_overlap(movable, needs).alias("_upstream"),
    )
    out = out.withColumn("channel_count", sum((F.col(n).cast("int") for n in channels), F.lit(0)))
    out = out.withColumn("mutable_downstream", F.coalesce("_upstream", F.lit(False)) & (F.col("artifact_download") | F.col("needs_outputs") | F.col("cache"))).drop("_upstream")
    out = out.join(workflow_privilege.select("repository_full_name", "path", "privilege_score"), ["repository_full_name", "path"], "left")
    out = out.withColumn("privilege_coupling", F.coalesce((F.col("privilege_score") > 0) & (F.col("channel_count") > 0), F.lit(False))).drop("privilege_score")
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    score = (
        F.col("channel_count") + 0.35 * F.col("needs_edges") + 0.75 * F.col("max_job_depth") + one(F.col("privilege_coupling"), 2.5) + one(F.col("mutable_downstream"), 2.0)
        + one(F.col("on_workflow_run"), 1.0) + one(F.col("on_repository_dispatch"), 1.0) + one(F.col("on_workflow_call") | F.col("reusable_call"), 1.0)
    )
    return out.withColumn("propagation_score", F.round(score, 4))


def calls(job_rows: DataFrame) -> DataFrame:
    """Calls of reusable workflows, remote and local, one row per calling job, with the callee's identifier."""
    u = F.col("uses")
    remote = u.rlike(X.REMOTE_CALL)
    single = lambda m: F.map_filter(m, lambda k, v: ~k.isin("write-all", "read-all"))
    p = X.merge_permissions(single("workflow_permissions"), single("permissions"))
    stated = F.exists(F.concat(F.map_values("workflow_permissions"), F.map_values("permissions")), lambda v: v != "default")
    rows = job_rows.where(u.isNotNull() & (remote | u.rlike(X.LOCAL_CALL)))
    owner = F.lower(X.uses_part(u, 0))
    category = X.ref_category(X.uses_ref(u))
    return rows.select(
        *KEY, "job_id", remote.alias("is_remote"), F.when(remote, u).otherwise(F.concat_ws("/", "repository_full_name", F.regexp_replace(u, r"^\./", ""))).alias("callee"),
        F.when(remote, category).otherwise("LOCAL_PATH").alias("ref_type"), F.coalesce(remote & X.is_movable(category), F.lit(False)).alias("is_mutable"),
        F.coalesce(remote & (owner != F.col("home")), F.lit(False)).alias("is_cross_org"), F.coalesce(remote & (owner != F.col("home")) & ~owner.isin(*X.PLATFORM_OWNERS), F.lit(False)).alias("is_third_party"),
        (F.lower(F.trim("secrets_text")) == "inherit").alias("inherits_secrets"), F.coalesce(stated, F.lit(False)).alias("has_permissions"), _is_write(p, "id-token").alias("id_token_write"),
    )


def callees(call_rows: DataFrame) -> DataFrame:
    """Per callee: calls, calling repositories and how they call."""
    return call_rows.groupBy("callee").agg(
        F.bool_or("is_remote").alias("is_remote"), F.count("*").alias("calls"), F.count_distinct("repository_full_name").alias("repositories"),
        *[F.count_if(f).alias(f) for f in ("is_mutable", "inherits_secrets", "has_permissions", "id_token_write", "is_cross_org", "is_third_party")],
    )
