"""Collection as queries: sources and sinks read back, sampling, history, supplements, resumption, and the graph built from files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refweave.functions import exprs as X
from refweave.functions.text import clean_sha, micros, stable_id
from refweave.operators import documents, graph
from refweave.plans import comparisons as C
from refweave.plans import domain as D
from refweave.plans import graph_metrics as G
from refweave.plans import temporal_metrics as M
from refweave.plans import workflow_metrics as WM
from refweave.session import own_dir, spread, table
from refweave.sources import files
from refweave.sources.files import Settings

_REPO = T.StructType([T.StructField("repo_id", T.LongType()), T.StructField("full_name", T.StringType()), T.StructField("stars", T.LongType()), T.StructField("is_fork", T.BooleanType()), T.StructField("default_branch", T.StringType()), T.StructField("ingest_seq", T.LongType())])


def _folder(s: SparkSession) -> str:
    return f"{own_dir(s)}/io-{uuid.uuid4().hex}"


def _repositories(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "repositories").select(*[f.name for f in _REPO.fields])


def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """All rows appended to JSON lines in two goes and read back by a glob under their schema."""
    path, r = f"{_folder(s)}/repositories.jsonl", _repositories(s, d)
    for half in (0, 1):
        files.append_jsonl(r.where(F.col("ingest_seq") % 2 == half), path)
    return files.read_jsonl(s, f"{path}/*.json", _REPO)


def jsonl_last_row(s: SparkSession, d: str) -> DataFrame:
    """The last row of each repository by file and position, of files written in the order of arrival."""
    path = f"{_folder(s)}/ordered"
    _repositories(s, d).repartitionByRange(5, "ingest_seq").sortWithinPartitions("ingest_seq").write.json(path)
    rows = files.read_jsonl_ordered(s, f"{path}/*.json", _REPO)
    return rows.groupBy("repo_id").agg(F.max_by("ingest_seq", F.struct("_file", "_position")).alias("ingest_seq"))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read back forgivingly: missing text is empty, missing numbers are 0."""
    path = f"{_folder(s)}/repositories.csv"
    files.write_csv(_repositories(s, d), path)
    return files.read_csv_typed(s, path, _REPO)


def artifact_reload(s: SparkSession, d: str) -> DataFrame:
    """Two artifacts exported, one as JSON only, and both read again: CSV if it is there, else JSON."""
    folder = _folder(s)
    schema = T.StructType([T.StructField("action_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("privileged_repos", T.LongType())])
    rows = D.once(s, d, "privileged_blast", lambda: C.privileged_blast(s, d)).select("action_id", "score", "privileged_repos")
    files.Report({"both": lambda: rows}).export(s, folder)
    files.Report({"only": lambda: rows}).export(s, folder, ("json",))
    parts = [files.read_artifact(s, folder, n, schema).withColumn("artifact", F.lit(n)) for n in ("both", "only", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def key_value_latest(s: SparkSession, d: str) -> DataFrame:
    """A key's value after two saves: repositories' names as of the first half of arrivals, then of all."""
    store, t = files.KeyValueStore(s, f"{_folder(s)}/kv"), table(s, d, "repositories")
    most = t.agg(F.max("ingest_seq")).first()[0] or 0
    for upto in (most // 2, most):
        now = t.where(F.col("ingest_seq") <= upto).groupBy("repo_id").agg(F.max_by("full_name", "ingest_seq").alias("value"))
        store.save(now.select(F.lit("repository").alias("namespace"), F.col("repo_id").cast("string").alias("key"), "value"))
    return store.latest()


def ref_state(s: SparkSession, d: str) -> DataFrame:
    """The sha last known of every tag of a delivery: of the reference's own state, else of the older store by tag."""
    obs = table(s, d, "ref_observations").select("action_id", "ref_name", "ref_type", clean_sha("sha").alias("sha"), "ingest_seq")
    tags = table(s, d, "tag_observations").select("action_id", "tag_name", clean_sha("sha").alias("sha"), "snapshot_no", "observed_at").where("sha is not null")
    legacy = tags.groupBy("action_id", "tag_name").agg(F.max(F.struct("snapshot_no", "observed_at", "sha"))["sha"].alias("sha"))
    wanted = tags.select("action_id", F.col("tag_name").alias("ref_name"), F.lit("tag").alias("ref_type"))
    return files.load_ref_state(wanted, files.ref_states(obs.where("ref_type = 'tag'")), legacy)


def resumed(s: SparkSession, d: str) -> DataFrame:
    """What is left to collect: repositories by status (from their flags) and whether a workflow of theirs is there."""
    r = D.repositories(s, d)
    units = r.select(F.col("full_name").alias("unit"))
    status = F.when(F.col("archived"), "failed").when(F.col("is_fork"), "running").otherwise("completed")
    return files.pending(units, r.select(F.col("full_name").alias("unit"), status.alias("status")), table(s, d, "workflows").select(F.col("repository_full_name").alias("unit")))


def sampled_repositories(s: SparkSession, d: str) -> DataFrame:
    """The repositories an analysis is about: no forks, enough stars, the most starred ones up to the set number."""
    r, k = D.repositories(s, d), Settings()
    return r.where(~F.col("is_fork") & (F.col("stars") >= k.min_stars)).orderBy(F.desc("stars"), "repo_id").limit(k.repositories).select("repo_id", "full_name", "stars")


def workflow_sample(s: SparkSession, d: str) -> DataFrame:
    """Of every repository its workflow files by path, up to the set number each."""
    paths = table(s, d, "workflows").where(F.col("path").startswith(".github/workflows/") & F.lower("path").rlike(r"\.ya?ml$")).select("repository_full_name", "path").distinct()
    w = W.partitionBy("repository_full_name").orderBy("path")
    return paths.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= Settings().workflows_per_repository)


def history_changes(s: SparkSession, d: str) -> DataFrame:
    """Per workflow the newest revisions up to the set number, oldest first, and only those whose references differ from the revision before."""
    key = ["repository_full_name", "workflow_path"]
    r = D.changes(s, d).where("committed_at is not null").select(*key, "commit_sha", micros("committed_at").alias("committed_us"), F.array_sort(F.array_distinct("uses_after")).alias("uses"))
    r = r.groupBy(*key, "commit_sha", "committed_us").agg(F.max("uses").alias("uses"))
    newest = r.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("committed_us"), F.desc("commit_sha")))).where(F.col("_n") <= Settings().commits_per_workflow)
    none = F.array().cast("array<string>")
    before = F.lag("uses", 1).over(W.partitionBy(*key).orderBy("committed_us", "commit_sha"))
    moved = newest.withColumn("before", F.coalesce(before, none)).where("uses <> before")
    return moved.select(*key, "commit_sha", "committed_us", F.array_join(F.array_except("uses", "before"), ",").alias("introduced"), F.array_join(F.array_except("before", "uses"), ",").alias("removed"))


def trackable_refs(s: SparkSession, d: str) -> DataFrame:
    """References that can move and are therefore observed: tags and branches."""
    return D.actions(s, d).where(F.col("ref_type").isin("tag", "branch")).select("action_id", "ref", "ref_type")


def marketplace_rows(s: SparkSession, d: str) -> DataFrame:
    """Marketplace entries keyed by owner and repository, together with those that are known by their page's name alone."""
    a = D.actions(s, d).where("marketplace_published")
    keyed = a.where("owner <> '' and repo <> ''").groupBy(F.concat_ws("/", F.lower("owner"), F.lower("repo")).alias("entry")).agg(F.count("*").alias("actions")).withColumn("keyed_by", F.lit("owner"))
    alone = a.where("owner is null or owner = '' or repo is null or repo = ''").groupBy(F.lower("action_name").alias("entry")).agg(F.count("*").alias("actions")).withColumn("keyed_by", F.lit("name"))
    return keyed.unionByName(alone)


def scoped_downstream(s: SparkSession, d: str) -> DataFrame:
    """Repositories whose own edges lead to an action: what counts where no blast radius is known."""
    return D.scoped(s, d).groupBy(F.col("dst_node_id").alias("action_id")).agg(F.count_distinct("consumer_repository").alias("repositories"))


def _definitions(s: SparkSession, d: str) -> DataFrame:
    """Definitions of actions (owner, repo, subpath, ref, content): composites that use what edges say they use.

    A table of fetched definitions would stand here; the data has none, so the texts are written from the edges.
    """
    a = D.actions(s, d).select("action_id", "owner", "repo", "subpath", "ref")
    uses = F.concat(F.concat_ws("/", "owner", "repo", "subpath"), F.lit("@"), F.col("ref"))
    links = graph.action_links(D.edges(s, d)).join(a.select(F.col("action_id").alias("dst"), uses.alias("u")), "dst")
    step = F.concat(F.lit("    - uses: '"), F.col("u"), F.lit("'\n"))
    steps = links.groupBy(F.col("src").alias("action_id")).agg(F.array_join(F.array_sort(F.collect_set(step)), "").alias("steps"))  # what one definition uses
    return a.join(steps, "action_id").select("action_id", "owner", "repo", "subpath", "ref", F.concat(F.lit("name: x\nruns:\n  using: composite\n  steps:\n"), "steps").alias("content"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return D.once(s, d, "definitions", lambda: documents.action_documents(spread(_definitions(s, d)), "content", ["action_id"]))


def _node(u):
    """action_id, key and ref_type of a reference text."""
    ref = X.uses_ref(u)
    return stable_id(X.uses_part(u, 0), X.uses_part(u, 1), X.uses_subpath(u), ref), F.concat(X.uses_name(u), F.lit("@"), ref), X.classify_ref(ref)


def cdg_from_files(s: SparkSession, d: str) -> DataFrame:
    """The graph from parsed files: references of the workflows of known repositories, and what the definitions of these actions use.

    Edges counted per repository and depth. Workflows of unknown repositories are left out.
    """
    known = D.repositories(s, d).select(F.col("full_name").alias("repository_full_name")).distinct()
    uses = WM.docs(s, d).where("doc is not null").join(known, "repository_full_name", "left_semi").select("repository_full_name", "path", F.explode("doc.uses").alias("u")).where(F.col("u").rlike(X.USES))
    ident, key, kind = _node(F.col("u"))
    direct = uses.select(F.col("repository_full_name").alias("repository"), "path", ident.alias("action_id"), key.alias("key"), kind.alias("ref_type"))
    nested = _resolved(s, d).where("action.kind = 'composite'").select(F.col("action_id").alias("parent"), F.explode("action.uses").alias("u")).where(F.col("u").rlike(X.USES))
    return graph.expand_counts(direct, nested.select("parent", ident.alias("action_id"), key.alias("key"), kind.alias("ref_type")), Settings().max_depth)


def metadata_supplement(s: SparkSession, d: str) -> DataFrame:
    """Actions of unknown type, the most used ones up to the set number, with the type their definition gives."""
    use = D.scoped(s, d).groupBy(F.col("dst_node_id").alias("action_id")).agg(F.count("*").alias("usage"))
    a = D.actions(s, d).where("action_type = 'unknown'").select("action_id").join(use, "action_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0).cast("long")))
    top = a.orderBy(F.desc("usage"), "action_id").limit(Settings().supplemental_actions)
    kinds = _resolved(s, d).select("action_id", F.nullif("action.kind", F.lit("unknown")).alias("kind"))
    return top.join(kinds, "action_id", "left").select("action_id", "usage", F.coalesce("kind", F.lit("unknown")).alias("action_type"))


def identity_supplement(s: SparkSession, d: str) -> DataFrame:
    """Referenced repositories never observed, the most referenced ones up to the set number, added as missing to what was observed."""
    seen = D.identities(s, d).select(F.lower("referenced").alias("name"), "identity_status")
    more = M.unobserved_repositories(s, d).orderBy(F.desc("refs"), "name").limit(Settings().supplemental_identities).select("name", F.lit("missing").alias("identity_status"))
    return seen.unionByName(more).distinct()


def enriched_types(s: SparkSession, d: str) -> DataFrame:
    """The actions of most weight (privileged score, use, downstream) up to the set number, by the type known after asking their definitions."""
    r = D.once(s, d, "ref_risk_by_action", lambda: G.ref_risk_by_action(s, d)).select("action_id", "usage_count", "downstream_repos")
    p = D.once(s, d, "privileged_blast", lambda: C.privileged_blast(s, d)).select("action_id", "score")
    top = r.join(p, "action_id", "left").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc("usage_count"), F.desc("downstream_repos"), "action_id").limit(Settings().enriched_actions)
    kinds = _resolved(s, d).select("action_id", F.nullif("action.kind", F.lit("unknown")).alias("kind"))
    a = top.join(D.actions(s, d).select("action_id", "action_type"), "action_id").join(kinds, "action_id", "left")
    kind = F.when(F.col("action_type") == "unknown", F.coalesce("kind", "action_type")).otherwise(F.col("action_type"))
    return a.groupBy(kind.alias("action_type")).agg(F.count("*").alias("actions"), F.sum("usage_count").alias("usage"), F.round(F.avg("score"), 4).alias("avg_score"))


def update_windows_ordered(s: SparkSession, d: str) -> DataFrame:
    """Update windows in the order of the moves they follow."""
    u = D.once(s, d, "updates", lambda: M.update_windows(s, d)).join(D.once(s, d, "drift", lambda: M.drift(s, d)).select("drift_id", "detected_us"), "drift_id")
    return u.orderBy("detected_us", "repository_full_name", "workflow_path", "mode", "action_id").select("detected_us", "repository_full_name", "workflow_path", "mode", "action_id", "lag_hours")


def transfer_risks_ordered(s: SparkSession, d: str) -> DataFrame:
    return M.transfer_risks(s, d).orderBy(F.desc("risk_type"), F.desc("privileged_workflows"), F.desc("workflows"), F.desc("name"))


def binding_panel(s: SparkSession, d: str) -> DataFrame:
    """Bindings in six groups, mutable share and drift by depth, mean lag by mode and depth, as (panel, label, value)."""
    c = D.once(s, d, "categorized", lambda: G.categorized(s, d))
    group = F.when(F.col("category").isin("FULL_SHA", "SHORT_SHA"), "sha").when(F.col("category") == "SEMVER_TAG", "semver").when(F.col("category") == "MAJOR_TAG", "major").when(F.col("category") == "FLOATING_TAG", "floating")
    group = group.when(F.col("category").startswith("BRANCH"), "branch").otherwise("unknown")
    a = c.groupBy(group.alias("label")).agg(F.count("*").cast("double").alias("value")).select(F.lit("bindings").alias("panel"), "label", "value")
    r = D.once(s, d, "ref_risk_by_depth", lambda: G.ref_risk_by_depth(s, d))
    b = r.select(F.lit("mutable").alias("panel"), F.col("bucket").alias("label"), F.col("mutable_ratio").alias("value"))
    e = r.select(F.lit("drift").alias("panel"), F.col("bucket").alias("label"), F.col("drift_refs").cast("double").alias("value"))
    u = D.once(s, d, "updates", lambda: M.update_windows(s, d)).groupBy("mode", "bucket").agg(F.round(F.avg("lag_hours"), 4).alias("value"))
    return a.unionByName(b).unionByName(e).unionByName(u.select(F.lit("lag").alias("panel"), F.concat_ws(" ", "mode", "bucket").alias("label"), "value"))


def permission_scopes(s: SparkSession, d: str) -> DataFrame:
    """Declared permissions as levels of the ten known scopes and the two words for all."""
    p = X.scope_levels(F.col("declared_permissions"))
    return table(s, d, "actions").select("ingest_seq", *[p[k].alias(k.replace("-", "_")) for k in (*X.SCOPES, "write-all", "read-all")])


def dependency_structs(s: SparkSession, d: str) -> DataFrame:
    """Every reference of the latest changes as a struct."""
    u = D.changes(s, d).select(F.explode("uses_after").alias("u")).where(F.col("u").rlike(X.USES)).distinct()
    return u.select(X.dependency(F.col("u")).alias("x")).select("x.*")


def ref_tests(s: SparkSession, d: str) -> DataFrame:
    """Edges bound to the main branch, and those that lead back into their own repository."""
    a = D.actions(s, d).select(F.col("action_id").alias("dst_node_id"), "owner", "repo")
    e = D.scoped(s, d).join(a, "dst_node_id", "left")
    own = F.coalesce(X.is_same_repository(F.col("consumer_repository"), F.col("owner"), F.col("repo")), F.lit(False))
    return e.select("edge_id", X.is_main_ref(F.col("ref_string")).alias("is_main"), own.alias("is_own"))


def privileged_workflows(s: SparkSession, d: str) -> DataFrame:
    """Workflows for which one of the ten signs of privilege holds."""
    w = WM.privilege_by_workflow(s, d)
    some = F.col(C.PRIVILEGED[0])
    for c in C.PRIVILEGED[1:]:
        some = some | F.col(c)
    return w.where(some).select(*WM.WP, "jobs", "privilege_score")


def error_log(s: SparkSession, d: str) -> DataFrame:
    """JSON lines of which every seventh is cut off: good rows are read, the text of bad ones is kept."""
    path, r = f"{_folder(s)}/errors", _repositories(s, d)
    text = F.to_json(F.struct(*r.columns))
    r.select(F.when(F.col("ingest_seq") % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(path)
    good, bad = files.read_jsonl_lenient(s, path, _REPO)
    return good.select(F.lit("good").alias("kind"), F.col("ingest_seq").cast("string").alias("row")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("line").alias("row"))).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("row").alias("different"))


def input_check(s: SparkSession, d: str) -> DataFrame:
    """Of the inputs a run needs, and one that no run has, those that are not there."""
    gone = files.missing_inputs(s, d, [f"{n}.parquet" for n in ("repositories", "actions", "workflows", "edges", "no_such_table")])
    return s.createDataFrame([(n,) for n in gone], "missing string")


def preflight_checks(s: SparkSession, d: str) -> DataFrame:
    return files.preflight(s, d, ["repositories.parquet", "no_such_table.parquet"]).select("check", "ok")


def markdown_table(s: SparkSession, d: str) -> DataFrame:
    """A small table as Markdown text: edges by depth."""
    rows = D.scoped(s, d).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("edges")).orderBy("depth")
    return s.createDataFrame([(files.markdown(rows),)], "text string")


QUERIES = {f.__name__: f for f in (
    jsonl_round_trip, jsonl_last_row, csv_round_trip, artifact_reload, key_value_latest, ref_state, resumed, sampled_repositories, workflow_sample, history_changes, trackable_refs, marketplace_rows,
    scoped_downstream, cdg_from_files, metadata_supplement, identity_supplement, enriched_types, update_windows_ordered, transfer_risks_ordered, binding_panel,
    permission_scopes, dependency_structs, ref_tests, privileged_workflows, error_log, input_check, preflight_checks, markdown_table,
)}
