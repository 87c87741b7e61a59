"""Queries p1, p3, p4, p5 and p6 over the domain tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.text import WHITE_SPACE, clean_sha, filled, micros, stable_id
from refweave.operators import history, representatives, snapshots
from refweave.operators.hierarchy import hierarchies
from refweave.operators.knownat import as_known_at
from refweave.session import table

#: Times that cannot be right: not before this moment.
CUTOFF = "2025-07-01 00:00:00"


def ref_states(spark: SparkSession, d: str) -> DataFrame:
    """What ref_observations say: action_id, ts (microseconds), ingest_seq, sha. Rows without a sha say nothing."""
    t = table(spark, d, "ref_observations")
    return t.select("action_id", micros("observed_at").alias("ts"), "ingest_seq", clean_sha("sha").alias("sha")).where("sha is not null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods during which each tracked reference pointed to one sha, by merging the observations as periodic updates."""
    h = history.build_history(ref_states(spark, d), "action_id", "ts", "ingest_seq", ["sha"], periods=history.PERIODS)
    return h.select("action_id", F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1)).cast("long").alias("valid_to_us"), "sha")


def p1_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same history, built from what had arrived by an ingest position and then merged with the rest."""
    states = ref_states(spark, d)
    cut = table(spark, d, "ref_observations").agg((F.max("ingest_seq") * 7 / 8).cast("long").alias("cut"))
    marked = states.crossJoin(F.broadcast(cut))  # one row
    log, updates = marked.where("ingest_seq <= cut").drop("cut"), marked.where("ingest_seq > cut").drop("cut")
    old = history.build_history(log, "action_id", "ts", "ingest_seq", ["sha"])
    h = history.merge_history(old, log, updates, "action_id", "ts", "ingest_seq", ["sha"])
    return h.select("action_id", F.col("valid_from").alias("valid_from_us"), F.coalesce("valid_to", F.lit(-1)).cast("long").alias("valid_to_us"), "sha")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag_observations").select("snapshot_no", "action_id", "observed_at", clean_sha("sha").alias("sha"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags added, removed or moved between consecutive deliveries."""
    return snapshots.snapshot_changes(_tags(spark, d), "action_id", "snapshot_no", "observed_at", ["sha"])


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The intervals behind p3_found: runs of deliveries over which a tag stood still."""
    runs = snapshots.snapshot_intervals(_tags(spark, d), "action_id", "snapshot_no", "observed_at", ["sha"])
    return runs.select("action_id", "first_snapshot", F.col("n_snapshots").cast("long").alias("n_snapshots"))


REPOSITORY_FIELDS = ["organization", "default_branch", "html_url"]
ACTION_FIELDS = ["resolved_sha", "marketplace_category", "source_repository_id", "author_verified"]


#: What is known of the classes beforehand, as counts (right, all): the latest row is mostly right, of the others nothing is known.
#: On equal support the class listed first wins, so that the latest row wins by its reliability alone.
RECENCY = {"dated": (1.0, 2.0), "undated": (1.0, 2.0), representatives.LATEST: (9.0, 10.0)}


def _dated(at: str) -> Column:
    return F.col(at).isNotNull() & (F.col(at) < F.lit(CUTOFF).cast("timestamp_ntz"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Which row each surviving field comes from: recency classes are the sources whose reliability is learnt.

    The latest row of a group, its dated and its undated rows name one value each; how far each class is to be
    believed is learnt from how often its values win. Times that cannot be right count as none.
    """
    tables = [("repository", "repositories", "repo_id", "collected_at", REPOSITORY_FIELDS), ("action", "actions", "action_id", "discovered_at", ACTION_FIELDS)]
    votes = [
        representatives.claims(
            table(spark, d, name), F.col(key), {f: F.col(f) for f in fields}, F.when(_dated(at), micros(at)), F.col("ingest_seq"), {"dated": _dated(at), "undated": ~_dated(at)}, family
        )
        for family, name, key, at, fields in tables
    ]
    t = representatives.discover(votes[0].unionByName(votes[1]), RECENCY).truths
    return t.select(F.col("family").alias("entity"), "group_key", F.col("field").alias("field_name"), "from_seq")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving action records where completeness, not recency, makes the classes: dated and undated rows that fill few, some or all fields."""
    t, fields = table(spark, d, "actions"), {f: F.col(f) for f in ACTION_FIELDS}
    n = sum(filled(c).cast("int") for c in fields.values())
    level = F.when(n >= 4, "all").when(n >= 2, "some").otherwise("few")
    classes = {f"{when}_{k}": (_dated("discovered_at") == F.lit(when == "dated")) & (level == k) for k in ("all", "some", "few") for when in ("dated", "undated")}
    votes = representatives.claims(t, F.col("action_id"), fields, F.when(_dated("discovered_at"), micros("discovered_at")), F.col("ingest_seq"), classes)
    truths = representatives.discover(votes, {k: (4.0, 5.0) for k in classes}).truths
    return representatives.survivors(truths, t, F.col("action_id"), fields, F.col("ingest_seq"))


def _hierarchies(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies(table(spark, d, "edges"), ["consumer_repository", "workflow_path"], "src_node_id", "dst_node_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, descendants and loops of every node of every workflow."""
    return _hierarchies(spark, d).select("consumer_repository", "workflow_path", "node_id", "root_node_id", "depth", "n_descendants", "on_cycle")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path from the root and the nested-set range of every rooted node."""
    rows = _hierarchies(spark, d).where("depth >= 0")
    return rows.select("consumer_repository", "workflow_path", "node_id", "parent_id", F.array_join("path", " > ").alias("path"), "range_start", "range_end")


def _uses(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (repository, workflow, commit, uses) that name a row of actions, with action_id and ts."""
    c = table(spark, d, "workflow_changes").where("introduced is not null and committed_at is not null")
    u = F.col("uses")
    at, name = F.instr(u, "@"), F.substring_index(u, "@", 1)
    parts = F.split(name, "/")
    entries = c.select("repository_full_name", "workflow_path", "commit_sha", micros("committed_at").alias("ts"), F.explode(F.array_distinct("introduced")).alias("uses"))
    entries = entries.where(u.isNotNull() & (at > 1) & (F.size(parts) >= 2)).withColumn(
        "action_id", stable_id(parts[0], parts[1], F.array_join(F.slice(parts, 3, 1000), "/"), F.expr("substring(uses, instr(uses, '@') + 1)"))
    )
    entries = entries.groupBy("repository_full_name", "workflow_path", "commit_sha", "uses", "action_id").agg(F.max("ts").alias("ts"))
    return entries.join(table(spark, d, "actions").select("action_id").distinct(), "action_id", "left_semi")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The sha each introduced reference showed when it was committed."""
    ident = ["repository_full_name", "workflow_path", "commit_sha", "uses"]
    events = _uses(spark, d).withColumn("event", F.to_json(F.struct(*ident), {"ignoreNullFields": "false"}))
    hits = as_known_at(events, ref_states(spark, d), "action_id", "ts", "ts", "ingest_seq", "sha", "event")
    return hits.select(F.from_json("event", ", ".join(f"{c} string" for c in ident)).alias("e"), "sha").select("e.*", "sha")


def p6_late(spark: SparkSession, d: str) -> DataFrame:
    """Bitemporal: the same question when an observation is known only a day after it was made."""
    ident = ["repository_full_name", "workflow_path", "commit_sha", "uses"]
    events = _uses(spark, d).withColumn("event", F.to_json(F.struct(*ident), {"ignoreNullFields": "false"}))
    states = ref_states(spark, d).withColumn("known", F.col("ts") + history.DAY_US)
    hits = as_known_at(events, states, "action_id", "ts", "ts", "ingest_seq", "sha", "event", known_time="known")
    return hits.select(F.from_json("event", ", ".join(f"{c} string" for c in ident)).alias("e"), "sha").select("e.*", "sha")


QUERIES = {
    "p1_found": p1_found, "p1_merge": p1_merge, "p3_found": p3_found, "p3_intervals": p3_intervals, "p4_found": p4_found,
    "p4_survivors": p4_survivors, "p5_found": p5_found, "p5_paths": p5_paths, "p6_found": p6_found, "p6_late": p6_late,
}

_WS = "'" + "' || '".join(f"' || chr({ord(c)}) || '" for c in WHITE_SPACE) + "'"
_STATES = f"""states as (select * from (
    select action_id, epoch_us(observed_at) as ts, nullif(lower(trim(sha, {_WS})), '') as sha, ingest_seq,
      row_number() over (partition by action_id, observed_at order by ingest_seq desc) as rn
    from ref_observations where nullif(trim(sha, {_WS}), '') is not null) where rn = 1)"""
_P1 = f"""with {_STATES},
  marks as (select *, lag(sha) over (partition by action_id order by ts) as before from states),
  starts as (select * from marks where before is null or before <> sha)
select action_id, ts as valid_from_us, coalesce(lead(ts) over (partition by action_id order by ts), -1) as valid_to_us, sha from starts"""
_HELD = f"""held as (select snapshot_no, action_id, nullif(lower(trim(arg_max(sha, observed_at), {_WS})), '') as sha,
    dense_rank() over (order by snapshot_no) as r from tag_observations
    where action_id is not null and snapshot_no is not null group by snapshot_no, action_id)"""
_P3 = f"""with {_HELD},
  deliveries as (select distinct snapshot_no, r from held),
  pairs as (select coalesce(a.action_id, b.action_id) as action_id, coalesce(a.r, b.r - 1) + 1 as r, a.action_id is null as is_new, b.action_id is null as is_gone,
    a.sha as sa, b.sha as sb from held a full join held b on a.action_id = b.action_id and b.r = a.r + 1)
select d.snapshot_no, action_id, case when is_new then 'added' when is_gone then 'removed' else 'changed' end as change_kind
from pairs join deliveries d on d.r = pairs.r where d.r > 1 and (is_new or is_gone or sa is distinct from sb)"""
_P3_INTERVALS = f"""with {_HELD},
  m as (select *, lag(r) over w as pr, lag(sha) over w as ps from held window w as (partition by action_id order by r)),
  g as (select *, sum(case when pr = r - 1 and ps is not distinct from sha then 0 else 1 end) over (partition by action_id order by r) as island from m)
select action_id, min(snapshot_no) as first_snapshot, count(*) as n_snapshots from g group by action_id, island"""


def _p4(entity: str, name: str, key: str, at: str, fields: list[str]) -> str:
    rows = " union all ".join(
        f"select cast({key} as varchar) as group_key, '{f}' as field_name, cast({f} as varchar) as value, case when {at} < timestamp '{CUTOFF}' then {at} end as seen, ingest_seq from {name}"
        for f in fields
    )
    return f"""select '{entity}' as entity, group_key, field_name,
      arg_max(ingest_seq, (seen is not null, coalesce(epoch_us(seen), 0), ingest_seq)) filter (where trim(value, {_WS}) <> '' and lower(trim(value, {_WS})) <> 'unknown') as from_seq
      from ({rows}) group by group_key, field_name having count(*) >= 2 and from_seq is not null"""


_P4 = _p4("repository", "repositories", "repo_id", "collected_at", REPOSITORY_FIELDS) + " union all " + _p4("action", "actions", "action_id", "discovered_at", ACTION_FIELDS)
_P5_BASE = """with recursive links as (select distinct consumer_repository as c, workflow_path as w, src_node_id as a, dst_node_id as b from edges
    where consumer_repository is not null and workflow_path is not null and src_node_id is not null and dst_node_id is not null),
  nodes as (select c, w, a as n from links union select c, w, b from links),
  reach(c, w, a, b) as (select c, w, a, b from links union select r.c, r.w, r.a, l.b from reach r join links l on l.c = r.c and l.w = r.w and l.a = r.b),
  most as (select c, w, count(*) as nodes from nodes group by c, w),
  roots as (select n.* from nodes n anti join links l on l.c = n.c and l.w = n.w and l.b = n.n),
  walk(c, w, root, n, depth) as (select c, w, n, n, 0 from roots
    union select k.c, k.w, k.root, l.b, k.depth + 1 from walk k join links l on l.c = k.c and l.w = k.w and l.a = k.n join most m on m.c = k.c and m.w = k.w where k.depth < m.nodes
      and not exists (select 1 from links s where s.c = l.c and s.w = l.w and s.a = l.a and s.b = l.b and s.a = s.b)),
  best as (select c, w, n, arg_min(root, (depth, root)) as root, min(depth) as depth from walk group by c, w, n),
  counts as (select c, w, a as n, count(*) filter (where b <> a) as k, max(case when b = a then 1 else 0 end) as loop from reach group by c, w, a)"""
_P5 = _P5_BASE + """
select n.c as consumer_repository, n.w as workflow_path, n.n as node_id, coalesce(b.root, '') as root_node_id, cast(coalesce(b.depth, -1) as bigint) as depth,
  coalesce(k.k, 0) as n_descendants, cast(coalesce(k.loop, 0) as bigint) as on_cycle
from nodes n left join best b on b.c = n.c and b.w = n.w and b.n = n.n left join counts k on k.c = n.c and k.w = n.w and k.n = n.n"""

_P5_PATHS = _P5_BASE + """,
  up as (select l.c, l.w, l.b as n, arg_min(l.a, (p.root, l.a)) as parent from links l join best p on p.c = l.c and p.w = l.w and p.n = l.a join best b on b.c = l.c and b.w = l.w and b.n = l.b where p.depth = b.depth - 1 group by 1, 2, 3),
  paths(c, w, n, parent, path) as (select c, w, n, null::varchar, [n] from roots union all select u.c, u.w, u.n, u.parent, list_append(p.path, u.n) from paths p join up u on u.c = p.c and u.w = p.w and u.parent = p.n),
  sizes as (select c, w, n, count(*) as size from (select c, w, unnest(path) as n from paths) group by 1, 2, 3),
  placed as (select *, row_number() over (partition by c, w order by path) - 1 as range_start from paths)
select c as consumer_repository, w as workflow_path, n as node_id, parent as parent_id, array_to_string(path, ' > ') as path, range_start, range_start + size as range_end from placed join sizes using (c, w, n)"""


def _p6(delay: int) -> str:
    return f"""with {_STATES},
  entries as (select repository_full_name, workflow_path, commit_sha, uses, max(epoch_us(committed_at)) as ts
    from (select *, unnest(list_distinct(introduced)) as uses from workflow_changes where introduced is not null)
    where uses is not null and committed_at is not null group by all),
  named as (select e.*, a.action_id from entries e join (select distinct action_id,
      owner || '/' || repo || coalesce('/' || nullif(subpath, ''), '') || '@' || ref as uses from actions) a using (uses))
select n.repository_full_name, n.workflow_path, n.commit_sha, n.uses, s.sha
from named n asof join states s on n.action_id = s.action_id and n.ts - {delay} >= s.ts"""


ORACLE = {
    "p1_found": _P1, "p1_merge": _P1, "p3_found": _P3, "p3_intervals": _P3_INTERVALS, "p4_found": _P4, "p5_found": _P5, "p5_paths": _P5_PATHS,
    "p6_found": _p6(0), "p6_late": _p6(history.DAY_US),
}
