"""Metrics over time: drift of references, exposure and update windows, coverage, transfers of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.functions.text import clean_sha, micros, stable_id
from refweave.operators import history
from refweave.plans import domain as D
from refweave.session import table

MODES, BUCKETS = ("explicit", "implicit"), ("level_1", "level_2", "level_3_plus")
REF = ["action_id", "ref_name", "ref_type"]


def drift(s: SparkSession, d: str) -> DataFrame:
    """Observed moves of references: one row per change of sha of (action_id, ref_name, ref_type).

    The history's versions meet end to end, so the version before is found by an equality join on its end,
    not by a window over a possibly hot reference.
    """
    t = table(s, d, "ref_observations")
    obs = t.select(*REF, micros("observed_at").alias("ts"), "ingest_seq", clean_sha("sha").alias("sha")).where("sha is not null")
    h = history.build_history(obs.select(F.struct(*REF).alias("k"), "ts", "ingest_seq", "sha"), "k", "ts", "ingest_seq", ["sha"])  # names are moved once, in the key
    before = h.select(F.col("k").alias("_k"), F.col("valid_to").alias("_end"), F.col("sha").alias("previous_sha"), F.col("valid_from").alias("first_seen_us"))
    moved = h.join(before, (F.col("k") == F.col("_k")) & (F.col("valid_from") == F.col("_end")))
    out = moved.select("k.*", "previous_sha", F.col("sha").alias("new_sha"), F.col("valid_from").alias("detected_us"), "first_seen_us")
    return out.withColumn("drift_id", stable_id(F.col("action_id"), F.col("ref_name"), F.col("ref_type"), F.col("new_sha"), F.col("detected_us")))


def drift_merged(s: SparkSession, d: str) -> DataFrame:
    """Stored events (here: moves between tag deliveries) together with observed ones; of equal ids the stored one stays."""
    observed = D.once(s, d, "drift", lambda: drift(s, d)).select("action_id", "ref_name", "new_sha", "detected_us", F.lit(1).alias("rank"), F.lit("observed").alias("source"))
    t = table(s, d, "tag_observations").select("action_id", F.col("tag_name").alias("ref_name"), micros("observed_at").alias("ts"), "snapshot_no", clean_sha("sha").alias("sha"))
    t = t.where("sha is not null").withColumn("seq", F.col("snapshot_no").cast("long"))
    h = history.build_history(t.withColumn("k", F.concat_ws("\x01", "action_id", "ref_name")), "k", "ts", "seq", ["action_id", "ref_name", "sha"])
    ends = h.select(F.col("k").alias("_k"), F.col("valid_to").alias("_end"))
    stored = h.join(ends, (F.col("k") == F.col("_k")) & (F.col("valid_from") == F.col("_end")), "left_semi").select(
        "action_id", "ref_name", F.col("sha").alias("new_sha"), F.col("valid_from").alias("detected_us"), F.lit(0).alias("rank"), F.lit("stored").alias("source")
    )
    both = stored.unionByName(observed)
    return both.groupBy("action_id", "ref_name", "new_sha", "detected_us").agg(F.min_by("source", "rank").alias("source"))


def drift_distribution(s: SparkSession, d: str) -> DataFrame:
    """Moves by action type, verification and reference type; unknown actions are unknown."""
    e = D.once(s, d, "drift", lambda: drift(s, d)).join(D.actions(s, d).select("action_id", "action_type", "author_verified"), "action_id", "left")
    unknown = F.lit("unknown")
    return e.groupBy(F.coalesce("action_type", unknown).alias("action_type"), F.coalesce("author_verified", unknown).alias("author_verified"), "ref_type").agg(
        F.count("*").alias("events"), F.count_distinct("action_id").alias("actions"), F.count_distinct("action_id", "ref_name", "ref_type").alias("refs")
    )


def drift_enriched(s: SparkSession, d: str) -> DataFrame:
    """Moves with owner, repo and type of their action; '' and unknown where it is not known."""
    a = D.actions(s, d).select("action_id", "owner", "repo", "action_type")
    e = D.once(s, d, "drift", lambda: drift(s, d)).join(a, "action_id", "left")
    return e.select(
        "drift_id", "action_id", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("action_type", F.lit("unknown")).alias("action_type"),
        X.iso(F.timestamp_micros("detected_us")).alias("detected_at"), "previous_sha", "new_sha",
    )


def drift_coverage(s: SparkSession, d: str) -> DataFrame:
    """One row: what was observed, over how many hours, and how much of it moved."""
    o = D.observations(s, d)
    seen = o.agg(
        F.count("*").alias("observations"), F.count_distinct("action_id").alias("actions"), F.count_distinct(*[F.col(c) for c in REF]).alias("refs"),
        F.count_distinct(F.when(F.col("ref_type") == "tag", F.col("ref_name"))).alias("tag_names"), F.count_distinct("sha").alias("shas"),
        F.round(X.hours_between(F.min("observed_at"), F.max("observed_at")), 4).alias("span_hours"),
    )
    moved = D.once(s, d, "drift", lambda: drift(s, d)).agg(F.count("*").alias("drift_events"), F.count_distinct("action_id").alias("drifted_actions"))
    return seen.crossJoin(moved)  # one row each


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """(action_id, repository, path, committed): changes that mention an action before or after."""
    c = D.changes(s, d).select("repository_full_name", "workflow_path", micros("committed_at").alias("committed_us"), F.explode(F.array_union("uses_before", "uses_after")).alias("u"))
    u = F.col("u")
    c = c.where(X.uses_part(u, 1).isNotNull())
    ident = stable_id(X.uses_part(u, 0), X.uses_part(u, 1), X.uses_subpath(u), X.uses_ref(u))
    return c.select(ident.alias("action_id"), "repository_full_name", "workflow_path", "committed_us").distinct()


def _since_last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Events at committed_us with _after, the key's event before (null for the first): each is the first one later than any moment in between."""
    w = W.partitionBy(*keys).orderBy("committed_us")
    return df.select(*keys, "committed_us").distinct().withColumn("_after", F.lag("committed_us").over(w))


def _first_later(moves: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Moves with the first later event of every key: a move meets one span of a key at most, so that nothing is left to aggregate
    and no pair that is no answer leaves the join."""
    m, e = moves.alias("m"), spans.alias("e")
    same = [F.col(f"m.{c}") == F.col(f"e.{c}") for c in on]
    within = (F.col("m.detected_us") < F.col("e.committed_us")) & (F.col("e._after").isNull() | (F.col("m.detected_us") >= F.col("e._after")))
    cond = within
    for c in same:
        cond = cond & c
    return m.join(e, cond).select("m.*", *[f"e.{c}" for c in spans.columns if c not in on and c != "_after"])


def exposure(s: SparkSession, d: str) -> DataFrame:
    """From each move to the first later change of each workflow that mentions the action: a strict as-of join forward."""
    e = D.once(s, d, "drift", lambda: drift(s, d)).select("drift_id", "action_id", "detected_us")
    spans = _since_last(_mentions(s, d), ["action_id", "repository_full_name", "workflow_path"])
    first = _first_later(e, spans, ["action_id"]).withColumnRenamed("committed_us", "ended_us")
    return first.withColumn("hours", F.round((F.col("ended_us") - F.col("detected_us")) / 3.6e9, 4))


def exposure_summary(s: SparkSession, d: str) -> DataFrame:
    x = D.once(s, d, "exposure", lambda: exposure(s, d))
    return x.agg(
        F.count("*").alias("windows"), F.count_distinct("action_id").alias("actions"), F.count_distinct("repository_full_name").alias("repositories"),
        F.round(F.avg("hours"), 4).alias("avg_hours"), F.min("hours").alias("min_hours"), F.max("hours").alias("max_hours"),
    )


def transitions(s: SparkSession, d: str) -> DataFrame:
    """Per change and action name (lower case): the smallest reference before and after, where they differ."""
    c = D.changes(s, d).withColumn("committed_us", micros("committed_at"))

    def refs(column: str, out: str) -> DataFrame:
        u = F.col("u")
        one = c.select("repository_full_name", "workflow_path", "commit_sha", "committed_us", F.explode(column).alias("u")).where(X.uses_part(u, 1).isNotNull())
        return one.groupBy("repository_full_name", "workflow_path", "commit_sha", "committed_us", F.lower(X.uses_name(u)).alias("base_key")).agg(F.min(X.uses_ref(u)).alias(out))

    keys = ["repository_full_name", "workflow_path", "commit_sha", "committed_us", "base_key"]
    both = refs("uses_before", "ref_before").join(refs("uses_after", "ref_after"), keys, "left")
    return both.where("ref_after is null or ref_after <> ref_before")


def _impacted(s: SparkSession, d: str) -> DataFrame:
    return D.scoped(s, d).groupBy(F.col("dst_node_id").alias("action_id"), F.col("consumer_repository").alias("repository_full_name"), "workflow_path").agg(F.min("depth").alias("depth"))


def update_windows(s: SparkSession, d: str) -> DataFrame:
    """Per move and workflow: explicit if a later change leaves the moved reference, with its lag; else implicit, lag 0."""
    name = D.actions(s, d).select("action_id", F.lower(F.concat_ws("/", "owner", "repo", "subpath")).alias("base_key"), "ref")
    e = D.once(s, d, "drift", lambda: drift(s, d)).select("drift_id", "action_id", "detected_us").join(name, "action_id")
    t = transitions(s, d).withColumnRenamed("ref_before", "ref")
    spans = _since_last(t, ["base_key", "ref", "repository_full_name", "workflow_path"])
    key = ["drift_id", "action_id", "repository_full_name", "workflow_path"]
    explicit = _first_later(e, spans, ["base_key", "ref"]).select(*key, F.round((F.col("committed_us") - F.col("detected_us")) / 3.6e9, 4).alias("lag_hours"))
    seen = _impacted(s, d)
    explicit = explicit.join(seen, key[1:], "left").select(*key, F.lit("explicit").alias("mode"), "lag_hours", F.coalesce("depth", F.lit(1)).alias("depth"))
    implicit = e.select("drift_id", "action_id").join(seen, "action_id").join(explicit.select(*key), key, "left_anti")
    implicit = implicit.select(*key, F.lit("implicit").alias("mode"), F.lit(0.0).alias("lag_hours"), "depth")
    return explicit.unionByName(implicit).withColumn("bucket", X.depth_bucket(F.col("depth")))


def _grid(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(b, m) for b in BUCKETS for m in MODES], "bucket string, mode string")


def histogram_rank(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Nearest-rank quantile per key from counts per distinct value: map-side counted, exact, nothing gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys).orderBy(value)
    at = F.rint((F.sum("_c").over(W.partitionBy(*keys)) - 1) * F.lit(q)) + 1
    below = counts.withColumn("_cum", F.sum("_c").over(w)).withColumn("_at", at).where(F.col("_cum") >= F.col("_at"))
    return below.groupBy(*keys).agg(F.min(value).alias(out))


def update_window_summary(s: SparkSession, d: str) -> DataFrame:
    """All six cells of depth and mode, empty ones too: count, mean, median, 95th percentile, greatest lag."""
    u = D.once(s, d, "updates", lambda: update_windows(s, d)).select("bucket", "mode", "lag_hours")
    base = u.groupBy("bucket", "mode").agg(F.count("*").alias("windows"), F.round(F.avg("lag_hours"), 4).alias("avg_hours"), F.max("lag_hours").alias("max_hours"))
    out = _grid(s).join(base, ["bucket", "mode"], "left")
    for q, name in ((0.5, "median_hours"), (0.95, "p95_hours")):
        out = out.join(histogram_rank(u, ["bucket", "mode"], "lag_hours", q, name), ["bucket", "mode"], "left")
    return out.withColumn("windows", F.coalesce("windows", F.lit(0).cast("long")))


def time_window_amplification(s: SparkSession, d: str) -> DataFrame:
    """The same by depth with the modes side by side."""
    u = D.once(s, d, "updates", lambda: update_windows(s, d))

    def of(mode: str, value: Column) -> Column:
        return F.when(F.col("mode") == mode, value)

    per = u.groupBy("bucket").agg(
        *[F.count(of(m, F.lit(1))).alias(f"{m}_windows") for m in MODES], *[F.round(F.avg(of(m, F.col("lag_hours"))), 4).alias(f"{m}_avg_hours") for m in MODES]
    )
    zero = F.lit(0).cast("long")
    return s.createDataFrame([(b,) for b in BUCKETS], "bucket string").join(per, "bucket", "left").select(
        "bucket", *[F.coalesce(f"{m}_windows", zero).alias(f"{m}_windows") for m in MODES], *[f"{m}_avg_hours" for m in MODES]
    )


def _touched(s: SparkSession, d: str) -> DataFrame:
    """Scoped edges to known actions: the action's repository name, the workflow, and whether it may write."""
    from refweave.plans.workflow_metrics import write_permissions

    a = D.actions(s, d).select("action_id", F.lower(F.concat_ws("/", "owner", "repo")).alias("name"))
    w = D.once(s, d, "write_permissions", lambda: write_permissions(s, d))
    e = D.scoped(s, d).join(a, F.col("dst_node_id") == F.col("action_id")).join(w, ["consumer_repository", "workflow_path"], "left")
    return e.select("name", "action_id", "workflow_id", "consumer_repository", F.when(F.col("has_write"), F.col("workflow_id")).alias("privileged_id"))


def _impact(rows: DataFrame) -> list[Column]:
    return [F.count_distinct(c).alias(n) for c, n in (("workflow_id", "workflows"), ("consumer_repository", "repositories"), ("privileged_id", "privileged_workflows"))]


def transfer_risks(s: SparkSession, d: str) -> DataFrame:
    """One row per repository and risk: redirected, missing, or its id changed; what was observed of it, how its actions are
    bound, and what depends on them."""
    i = D.identities(s, d)
    known = F.struct(F.col("observed_at").isNotNull(), "observed_at", "ingest_seq")
    latest = F.max_by(F.struct("identity_status", "resolved", "repo_id"), known).alias("l")
    per = i.groupBy(F.lower("referenced").alias("name")).agg(
        latest, F.count_distinct("repo_id").alias("ids"), F.count("*").alias("observations"), F.min(micros("observed_at")).alias("first_us"), F.max(micros("observed_at")).alias("last_us")
    )
    per = per.select("name", F.col("l.identity_status").alias("status"), F.col("l.resolved").alias("resolved"), F.col("l.repo_id").alias("latest_id"), "ids", "observations", "first_us", "last_us")
    kinds = F.array(
        F.when(F.col("status") == "redirected", "redirected"), F.when(F.col("status") == "missing", "missing"), F.when(F.col("ids") > 1, "repository_id_changed"),
    )
    risks = per.withColumn("risk_type", F.explode(F.array_compact(kinds)))
    bound = lambda k: F.count_if(F.col("ref_type") == k)
    a = D.actions(s, d).groupBy(F.lower(F.concat_ws("/", "owner", "repo")).alias("name")).agg(
        F.count("*").alias("actions"), *[bound(k).alias(f"{k}_references") for k in ("sha", "tag", "branch")], F.count_if((F.col("ref_type") == "branch") & (F.lower("ref") == "main")).alias("main_references")
    )
    t = _touched(s, d)
    hit = t.groupBy("name").agg(*_impact(t))
    zero = F.lit(0).cast("long")
    counted = [*a.columns[1:], *hit.columns[1:]]
    return risks.join(a, "name", "left").join(hit, "name", "left").select(*risks.columns, *[F.coalesce(c, zero).alias(c) for c in counted])


def transfer_summary(s: SparkSession, d: str) -> DataFrame:
    """One row: observed and risky repositories by risk, and what depends on the risky ones, each counted once."""
    r = D.once(s, d, "transfer_risks", lambda: transfer_risks(s, d))
    observed = D.identities(s, d).agg(F.count_distinct(F.lower("referenced")).alias("observed"))
    base = r.agg(F.count("*").alias("risks"), F.count_distinct("name").alias("names"), *[F.count_if(F.col("risk_type") == k).alias(k) for k in ("redirected", "missing", "repository_id_changed")])
    risky = r.select("name").distinct()
    t = _touched(s, d).join(risky, "name", "left_semi")
    actions = D.actions(s, d).select(F.lower(F.concat_ws("/", "owner", "repo")).alias("name")).join(risky, "name", "left_semi").agg(F.count("*").alias("actions"))
    return base.crossJoin(observed).crossJoin(actions).crossJoin(t.agg(*_impact(t)))  # one row each


def uses_diff(s: SparkSession, d: str) -> DataFrame:
    """What each change introduced and removed, from its lists before and after."""
    c = D.changes(s, d)
    return c.select(
        "repository_full_name", "workflow_path", "commit_sha", F.array_join(F.array_sort(F.array_except("uses_after", "uses_before")), ",").alias("introduced"),
        F.array_join(F.array_sort(F.array_except("uses_before", "uses_after")), ",").alias("removed"), F.size(F.array_union("uses_before", "uses_after")).cast("long").alias("all_uses"),
    )


def unobserved_repositories(s: SparkSession, d: str) -> DataFrame:
    """Repositories of referenced actions that were never observed, by number of references."""
    a = D.actions(s, d).select("action_id", F.lower(F.concat_ws("/", "owner", "repo")).alias("name"))
    refs = D.edges(s, d).join(a, F.col("dst_node_id") == F.col("action_id")).groupBy("name").agg(F.count("*").alias("refs"))
    seen = table(s, d, "repositories").select(F.lower("full_name").alias("name"))
    return refs.join(seen, "name", "left_anti")


QUERIES = {f.__name__: f for f in (
    drift_merged, drift_distribution, drift_enriched, drift_coverage, exposure, exposure_summary, transitions, update_windows, update_window_summary,
    time_window_amplification, transfer_risks, transfer_summary, uses_diff, unobserved_repositories,
)} | {"drift_lag": drift}
