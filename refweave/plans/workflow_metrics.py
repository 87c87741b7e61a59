"""Queries over parsed workflow files, and look-alike names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.operators import documents, jobs
from refweave.plans import domain as D
from refweave.plans import graph_metrics as G
from refweave.session import spread

WP = ["repository_full_name", "path"]


def docs(s: SparkSession, d: str) -> DataFrame:
    yaml_file = F.lower("path").rlike(r"\.ya?ml$")
    files = D.workflows(s, d).where(yaml_file & F.col("content").isNotNull())
    return D.once(s, d, "docs", lambda: documents.workflow_documents(spread(files), "content", jobs.KEY))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return jobs.jobs(docs(s, d))


def write_permissions(s: SparkSession, d: str) -> DataFrame:
    """(consumer_repository, workflow_path, has_write): whether a workflow or one of its jobs asks to write; of several versions the last by sha."""
    grants = lambda m: F.exists(F.map_entries(m), lambda e: (e["key"] != "read-all") & e["value"].contains("write"))
    own = F.coalesce(grants(F.col("doc.permissions")), F.lit(False)) | F.coalesce(F.exists("doc.jobs", lambda j: grants(j["permissions"])), F.lit(False))
    rows = docs(s, d).where("doc is not null").select("repository_full_name", "path", "sha", own.alias("w"))
    return rows.groupBy(F.col("repository_full_name").alias(G.WF[0]), F.col("path").alias(G.WF[1])).agg(F.max_by("w", "sha").alias("has_write"))


def isolation_by_job(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "isolation", lambda: jobs.isolation(_jobs(s, d))).drop("sensitive_steps")


def isolation_summary(s: SparkSession, d: str) -> DataFrame:
    i = isolation_by_job(s, d)
    p95 = G.nearest_rank_rows(i.select("owners", *jobs.KEY, "job_id"), "owners", [*jobs.KEY, "job_id"], 0.95).select(F.col("owners").alias("p95_owners"))
    base = i.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("uses_steps") >= 2).alias("with_several_actions"), *[F.count_if(f).alias(f) for f in ("mixed_domains", "untrusted_before_sensitive", "env_signal", "output_signal", "file_signal")],
        F.median("owners").alias("median_owners"),
    )
    return base.join(p95, F.lit(True), "left")  # one row each


def isolation_examples(s: SparkSession, d: str) -> DataFrame:
    """The 50 jobs of the strongest signals."""
    i = D.once(s, d, "isolation", lambda: jobs.isolation(_jobs(s, d))).where("untrusted_before_sensitive or action_before_sensitive or mixed_domains")
    order = [F.desc("signal_score"), F.desc("third_party_steps"), F.desc("owners"), F.desc(F.lower("repository_full_name")), F.desc(F.lower("job_id")), F.desc("path"), F.desc("sha")]
    return i.orderBy(*order).limit(50).withColumn("sensitive_steps", F.array_join("sensitive_steps", " | "))


def privilege_by_job(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "privilege_job", lambda: jobs.privilege(_jobs(s, d), isolation_by_job(s, d))).drop("triggers")


def _depths(s: SparkSession, d: str) -> DataFrame:
    return D.scoped(s, d, "depth").groupBy(F.col("consumer_repository").alias("repository_full_name"), F.col("workflow_path").alias("path")).agg(F.max("depth").cast("long").alias("max_depth"))


def privilege_by_workflow(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "privilege_workflow", lambda: jobs.privilege_by_workflow(privilege_by_job(s, d), _depths(s, d)))


def privilege_summary(s: SparkSession, d: str) -> DataFrame:
    w = privilege_by_workflow(s, d).agg(F.count("*").alias("workflows"), *[F.count_if(f).alias(f"workflows_{f}") for f in ("id_token_write", "write_all", "pull_request_target")])
    j = privilege_by_job(s, d).agg(F.count("*").alias("jobs"), *[F.count_if(f).alias(f"jobs_{f}") for f in jobs.PRIVILEGE_FLAGS])
    return w.crossJoin(j)  # one row each


def privilege_examples(s: SparkSession, d: str) -> DataFrame:
    """The 50 workflows of the highest score with the first ten of their risky jobs."""
    from pyspark.sql import Window as W

    j = privilege_by_job(s, d).where("privilege_score > 0")
    order = [F.desc("privilege_score"), F.desc("movable_actions"), F.desc(F.lower("job_id")), F.desc("sha")]
    top = privilege_by_workflow(s, d).where("privilege_score > 0").orderBy(F.desc("privilege_score"), F.desc("privileged_jobs"), F.desc(F.lower("repository_full_name")), F.desc("path")).limit(50)
    ten = j.join(top.select(*WP), WP, "left_semi").withColumn("r", F.row_number().over(W.partitionBy(*WP).orderBy(*order))).where("r <= 10")
    names = ten.groupBy(*WP).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "job_id"))), lambda x: x["job_id"]), ",").alias("risky_jobs"))
    return top.join(names, WP, "left")


def propagation_by_workflow(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "propagation", lambda: jobs.propagation(docs(s, d), privilege_by_workflow(s, d)))


def propagation_summary(s: SparkSession, d: str) -> DataFrame:
    flags = ("artifact_upload", "artifact_download", "cache", "job_outputs", "needs_outputs", "on_workflow_run", "on_workflow_call", "reusable_call", "privilege_coupling", "mutable_downstream")
    return propagation_by_workflow(s, d).agg(F.count("*").alias("workflows"), *[F.count_if(f).alias(f) for f in flags], F.max("max_job_depth").alias("max_job_depth"), F.round(F.avg("channel_count"), 6).alias("avg_channels"), F.round(F.avg("needs_edges"), 6).alias("avg_needs_edges"))


def propagation_examples(s: SparkSession, d: str) -> DataFrame:
    p = propagation_by_workflow(s, d).where("propagation_score > 0")
    return p.orderBy(F.desc("propagation_score"), F.desc("channel_count"), F.desc("needs_edges"), F.desc(F.lower("repository_full_name")), F.desc("path"), F.desc("sha")).limit(50)


def _callers(s: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Workflow texts that call what changes name as reusable workflows, one job per reference, and their parsed documents.

    The files of the data call none at the level of jobs, so callers are written from the changes: a job for each
    reference after a change, every second one by the length of its text inheriting secrets; every third reference, or
    ``every`` one, is called by its local path as well.
    """
    u = F.col("u")
    c = D.changes(s, d).select("repository_full_name", F.col("workflow_path").alias("path"), F.col("commit_sha").alias("sha"), F.explode(F.array_distinct("uses_after")).alias("u"))
    local = F.when(u.rlike(X.REMOTE_CALL) & (F.lit(every) | (F.length(u) % 3 == 0)), F.concat(F.lit("./"), F.regexp_extract(u, r"(\.github/workflows/[^@]+)@", 1)))
    c = c.withColumn("u", F.explode(F.array_compact(F.array(u, local))))
    c = c.where(u.rlike(X.REMOTE_CALL) | u.rlike(X.LOCAL_CALL)).distinct()
    job = F.concat(F.lit("  call_"), F.substring(F.sha1(u), 1, 8), F.lit(":\n    uses: '"), u, F.lit("'\n"), F.when(F.length(u) % 2 == 0, "    secrets: inherit\n").otherwise(""))
    kind = F.length("path") % 3
    head = F.when(kind == 0, "permissions:\n  id-token: write\n").when(kind == 1, "permissions: read-all\n").otherwise("")
    texts = c.groupBy(*jobs.KEY).agg(F.array_join(F.array_sort(F.collect_set(job)), "").alias("jobs"))  # the references of one revision
    texts = texts.select(*jobs.KEY, F.concat(F.lit("name: calls\non: [push]\n"), head, F.lit("jobs:\n"), "jobs").alias("content"))
    return D.once(s, d, "all_callers" if every else "callers", lambda: documents.workflow_documents(spread(texts), "content", jobs.KEY))


def _calls(s: SparkSession, d: str, every: bool = False) -> DataFrame:
    return D.once(s, d, "all_calls" if every else "calls", lambda: jobs.calls(jobs.jobs(docs(s, d).unionByName(_callers(s, d, every)))))


def reusable_calls(s: SparkSession, d: str) -> DataFrame:
    c = _calls(s, d)
    return c.join(jobs.callees(c).select("callee", F.col("repositories").alias("downstream_repositories")), "callee")


def reusable_callees(s: SparkSession, d: str) -> DataFrame:
    return jobs.callees(_calls(s, d)).orderBy(F.desc("repositories"), F.desc("calls"), F.desc("is_mutable"), F.desc(F.lower("callee")), F.desc("callee"))


def reusable_summary(s: SparkSession, d: str) -> DataFrame:
    c = _calls(s, d)
    flags = ("is_remote", "is_mutable", "is_cross_org", "is_third_party", "inherits_secrets", "has_permissions", "id_token_write")
    return c.agg(F.count("*").alias("calls"), *[F.count_if(f).alias(f) for f in flags], F.count_distinct("callee").alias("callees"), F.count_distinct(F.when(F.col("is_remote"), F.col("callee"))).alias("remote_callees"))


def reusable_profile(s: SparkSession, d: str) -> DataFrame:
    """Overlapping strata of calls; all five are there, empty ones too."""
    return call_profile(s, _calls(s, d))


def call_profile(s: SparkSession, c: DataFrame) -> DataFrame:
    c = c.join(jobs.callees(c).select("callee", F.col("repositories").alias("downstream")), "callee")
    remote = F.col("is_remote")
    strata = {"local": ~remote, "remote": remote, "remote_same_org": remote & ~F.col("is_cross_org"), "remote_cross_org": remote & F.col("is_cross_org"), "remote_third_party": remote & F.col("is_third_party")}
    label = F.explode(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in strata.items()])))
    flags = ("is_mutable", "inherits_secrets", "has_permissions", "id_token_write")
    per = c.withColumn("stratum", label).groupBy("stratum").agg(F.count("*").alias("calls"), *[F.count_if(f).alias(f) for f in flags], F.round(F.avg("downstream"), 4).alias("avg_downstream"))
    out = s.createDataFrame([(n,) for n in strata], "stratum string").join(per, "stratum", "left")
    zero = F.lit(0).cast("long")
    return out.select("stratum", *[F.coalesce(x, zero).alias(x) for x in ("calls", *flags)], *[F.round(X.rate(F.coalesce(f, zero), F.coalesce("calls", zero)), 6).alias(f"{f}_share") for f in flags], "avg_downstream")


def workflow_uses(s: SparkSession, d: str) -> DataFrame:
    """Every reference a workflow version names anywhere, sorted and distinct."""
    ok = F.filter("doc.uses", lambda u: u.rlike(X.USES))
    return docs(s, d).where("doc is not null").select(*jobs.KEY, F.array_join(ok, ",").alias("uses"))


def action_kinds(s: SparkSession, d: str) -> DataFrame:
    """Definitions written from the actions table, parsed again: kinds by stated type."""
    using = F.when(F.col("action_type") == "javascript", "node20").otherwise(F.col("action_type"))
    text = F.concat(F.lit("name: x\nruns:\n  using: '"), using, F.lit("'\n  main: index.js\n  steps:\n    - uses: "), F.concat_ws("/", "owner", "repo"), F.lit("@v1\n    - run: ./go.sh\n"))
    a = D.actions(s, d).select("action_id", "action_type", "owner", "repo").withColumn("text", text)
    parsed = documents.action_documents(a, "text", ["action_id", "action_type"])
    return parsed.groupBy("action_type", F.col("action.kind").alias("kind")).agg(F.count("*").alias("actions"), F.sum(F.size("action.uses")).alias("uses"))


def discovery_candidates(s: SparkSession, d: str) -> DataFrame:
    """Names that could be taken for a popular one, moved or missing repositories, with score and kind.

    The popular names are at most 20, so each candidate is held against a bounded list. Nearest by edits of
    the whole plain name, then by confusion, then by the list's order.
    """
    from pyspark.sql import Window as W

    from refweave.plans.scalars import reference_union

    a = D.actions(s, d).select(F.lower(F.concat_ws("/", "owner", "repo")).alias("name"), "action_id")
    reach = D.scoped(s, d).join(a, F.col("dst_node_id") == F.col("action_id")).groupBy("name").agg(F.count_distinct("consumer_repository").alias("repos"))
    m = D.marketplace(s, d).select(F.concat_ws("/", "m_owner", "m_repo").alias("name"), "verified_creator")
    known = F.struct(F.col("observed_at").isNotNull(), "observed_at", "ingest_seq")
    i = D.identities(s, d).groupBy(F.lower("referenced").alias("name")).agg(F.max_by("identity_status", known).alias("status"), F.max_by("archived", known).alias("archived"))
    n = reference_union(s, d).select("name", (F.col("edges") + F.col("changes")).alias("usage")).where("usage > 0")
    n = n.join(reach, "name", "left").join(m, "name", "left").join(i, "name", "left").withColumn("repos", F.coalesce("repos", F.lit(0).cast("long")))
    n = D.once(s, d, "discovery_names", lambda: n)
    hint = F.col("name").isin(*X.CANONICAL_NAMES)
    order = [F.desc(hint), F.desc("usage"), F.desc("repos"), F.desc(F.coalesce("verified_creator", F.lit(False))), F.desc("name")]
    popular = n.where((F.col("usage") > 1) | (F.col("repos") > 1) | F.col("verified_creator") | hint).orderBy(*order).limit(20)
    popular = popular.withColumn("place", F.row_number().over(W.orderBy(*order))).select(F.col("name").alias("popular"), "place")
    pairs = n.join(popular, F.col("name") == F.col("popular"), "left_anti").crossJoin(F.broadcast(popular))  # 20 names

    def plain(c: str, i: int):
        return X.normalize_name(F.split_part(F.col(c), F.lit("/"), F.lit(i)))

    o, r, po, pr = plain("name", 1), plain("name", 2), plain("popular", 1), plain("popular", 2)
    raw = lambda c, i: F.split_part(F.col(c), F.lit("/"), F.lit(i))
    full, od, rd = F.levenshtein(X.normalize_name(F.col("name")), X.normalize_name(F.col("popular"))), F.levenshtein(o, po), F.levenshtein(r, pr)
    zero = F.lit(0.0)
    confusion = F.greatest(
        F.when((raw("name", 1) == raw("popular", 1)) & (rd <= 2), 0.82 - 0.08 * F.least(rd, F.lit(2))).otherwise(zero),
        F.when((raw("name", 2) == raw("popular", 2)) & (od <= 2), 0.78 - 0.08 * F.least(od, F.lit(2))).otherwise(zero),
        F.when((r == pr) & (o != po) & (od <= 1), 0.88).otherwise(zero), F.when((o == po) & (r == pr), 0.9).otherwise(zero),
        F.when(X.prefix_confusion(r, pr) & (o == po), 0.7).otherwise(zero), F.when(full <= 2, 0.68 - 0.06 * F.least(full, F.lit(2))).otherwise(zero),
    )
    best = pairs.select("name", "popular", full.alias("distance"), confusion.alias("confusion"), "place").groupBy("name").agg(
        F.min(F.struct("distance", (-F.col("confusion")).alias("minus"), "place", "popular")).alias("b")
    )
    out = n.join(best, "name", "left").select("name", "usage", "repos", "verified_creator", "status", "archived", F.col("b.popular").alias("near"), F.col("b.distance").alias("distance"), F.coalesce(-F.col("b.minus"), zero).alias("confusion"))
    gone, moved = F.coalesce(F.col("status").isin("missing", "inaccessible"), F.lit(False)), F.coalesce(F.col("status") == "redirected", F.lit(False))
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(zero)
    score = 60 * F.col("confusion") + one(moved, 35.0) + one(gone, 45.0) + one(F.coalesce("archived", F.lit(False)), 10.0) + one(F.coalesce(~F.col("verified_creator"), F.lit(False)), 5.0)
    score = score + 0.5 * F.least(F.col("usage"), F.lit(20)) + 0.5 * F.least(F.col("repos"), F.lit(20))
    kind = F.when(gone, "unresolved_candidate").when(moved, "redirection_candidate").when(F.col("distance") <= 2, "potential_typosquat").when(F.col("confusion") >= 0.55, "potential_brand_confusion").otherwise("none")
    return out.withColumn("score", F.round(F.least(score, F.lit(100.0)), 4)).withColumn("kind", kind).withColumn("confusion", F.round("confusion", 4))


def discovery_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts by kind and the 20 highest scores as text."""
    c = discovery_candidates(s, d)
    top = c.orderBy(F.desc("score"), F.desc("repos"), F.desc("usage"), F.desc("name")).limit(20).agg(F.array_sort(F.collect_list(F.struct("score", "name", "kind"))).alias("t"))  # 20 rows
    top = top.select(F.array_join(F.transform("t", lambda x: F.concat_ws(" ", x["score"].cast("string"), x["name"], x["kind"])), ", ").alias("top_20"))
    kinds = ("unresolved_candidate", "redirection_candidate", "potential_typosquat", "potential_brand_confusion")
    return c.agg(F.count("*").alias("names"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]).crossJoin(top)  # one row each


QUERIES = {f.__name__: f for f in (
    isolation_by_job, isolation_summary, isolation_examples, privilege_by_job, privilege_by_workflow, privilege_summary, privilege_examples, propagation_by_workflow,
    propagation_summary, propagation_examples, reusable_calls, reusable_callees, reusable_summary, reusable_profile, workflow_uses, action_kinds, discovery_candidates, discovery_summary,
)}
