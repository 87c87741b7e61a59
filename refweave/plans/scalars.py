"""Scalar functions and simple operators as queries over the whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import exprs as X
from refweave.functions import stats
from refweave.functions.text import stable_id, strip
from refweave.plans import domain as D
from refweave.plans.oracle import CAT, HIGH, TOKEN_PATTERNS, WEIGHT, category, q
from refweave.plans.core_problems import _WS
from refweave.plans.graph_metrics import categorized
from refweave.session import table

_U = "(select distinct unnest(list_concat(coalesce(uses_before, []), coalesce(uses_after, []))) as u from workflow_changes)"
_N, _R = "split_part(u, '@', 1)", "substr(u, instr(u, '@') + 1)"


def _uses(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "workflow_changes")
    empty = F.array().cast("array<string>")
    return t.select(F.explode(F.concat(F.coalesce("uses_before", empty), F.coalesce("uses_after", empty))).alias("u")).where("u is not null").distinct()


def scan_actions(s: SparkSession, d: str) -> DataFrame:
    """Column pruning and a pushed filter: published actions."""
    return table(s, d, "actions").where("marketplace_published").select("action_id", "owner", "repo", "ref")


def scoped_edges(s: SparkSession, d: str) -> DataFrame:
    return D.scoped(s, d).select("edge_id", "workflow_id", "dst_node_id", F.col("depth").cast("long").alias("depth"))


def direct_edges(s: SparkSession, d: str) -> DataFrame:
    return D.edges(s, d).where("src_kind = 'workflow' and dst_kind = 'action'").select("edge_id", "src_node_id", "dst_node_id")


def high_star_repos(s: SparkSession, d: str) -> DataFrame:
    return D.repositories(s, d).where("stars > 50").select("repo_id", "full_name", "stars")


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("owner", "repo", "subpath", "ref")]
    return table(s, d, "actions").select("ingest_seq", "action_id", (stable_id(*c) == F.col("action_id")).alias("is_equal"))


def classify_ref(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "actions").select("ref").distinct().select("ref", X.classify_ref(F.col("ref")).alias("kind"), X.is_dynamic_ref(F.col("ref")).alias("is_dynamic"))


def ref_category(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "actions").select("ref").distinct().withColumn("category", X.ref_category(F.col("ref")))
    return r.withColumn("weight", X.risk_weight(F.col("category"))).withColumn("movable", X.is_movable(F.col("category"))).withColumn("mutable", X.is_mutable(F.col("category")))


def parse_action_ref(s: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    ok = X.uses_part(u, 1).isNotNull()
    return _uses(s, d).select("u", F.when(ok, X.uses_part(u, 0)).alias("owner"), X.uses_part(u, 1).alias("repo"), F.when(ok, X.uses_subpath(u)).alias("subpath"), F.when(ok, X.uses_ref(u)).alias("ref"))


def trust_domain(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "workflow_changes").select("repository_full_name", F.explode("uses_after").alias("u")).where("u is not null").distinct()
    return t.select("repository_full_name", "u", X.trust_domain(F.col("u"), X.owner_of(F.col("repository_full_name"))).alias("domain"), X.action_name(F.col("u")).alias("name"))


def depth_bucket(s: SparkSession, d: str) -> DataFrame:
    return D.scoped(s, d).groupBy(X.depth_bucket(F.col("depth")).alias("bucket")).agg(F.count("*").alias("edges"))


def normalize_name(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "actions").select("action_name").distinct().select("action_name", X.normalize_name(F.col("action_name")).alias("plain"))


def name_lookalikes(s: SparkSession, d: str) -> DataFrame:
    """Pairs of action repositories of different owners whose names lie within two edits, found by deletion keys.

    Each name is keyed by itself and by what is left after up to two deletions (symmetric deletion): names
    within two edits share a key. An equality join then replaces comparing every name with every other one.
    """
    n = table(s, d, "actions").select(F.lower("repo").alias("name")).where("name is not null").distinct()
    at = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.col("name").substr(F.lit(1), i - 1), F.col("name").substr(i + 1, F.length("name"))))
    one = F.when(F.length("name") > 0, at).otherwise(F.array().cast("array<string>"))
    keyed = n.withColumn("one", one)
    two = F.flatten(F.transform("one", lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
    keys = keyed.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), "one", two))).alias("key"))
    a, b = keys.select(F.col("name").alias("a"), "key"), keys.select(F.col("name").alias("b"), "key")
    return a.join(b, "key").where("a < b").select("a", "b").distinct().withColumn("distance", F.levenshtein("a", "b").cast("long")).where("distance <= 2")


def prefix_confusion(s: SparkSession, d: str) -> DataFrame:
    """Names of one owner that begin with another of that owner's names; candidates come from prefixes, not pairs."""
    n = table(s, d, "actions").select("owner", "repo").distinct()
    cut = n.select("owner", F.col("repo").alias("longer"), F.explode(F.sequence(F.lit(1), F.length("repo"))).alias("i")).withColumn("shorter", F.expr("substring(longer, 1, i)"))
    hit = cut.join(n.withColumnRenamed("repo", "shorter"), ["owner", "shorter"]).where(X.prefix_confusion(F.col("longer"), F.col("shorter")))
    return hit.select("owner", "shorter", "longer")


def contains_keywords(s: SparkSession, d: str) -> DataFrame:
    needles = ["secret", "token", "deploy", "aws", "cache"]
    t = table(s, d, "documents")
    return t.select("doc_id", *[X.contains_any(F.col("text"), [n]).alias(f"has_{n}") for n in needles], X.contains_any(F.col("text"), needles).alias("has_any"))


def token_patterns(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "workflows").where("content is not null")
    return t.select("ingest_seq", F.array_join(X.token_patterns(F.col("content")), "|").alias("patterns"))


def script_paths(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "workflows").where("content is not null")
    return t.select("ingest_seq", F.size(X.script_paths(F.col("content"))).cast("long").alias("paths"))


def permission_levels(s: SparkSession, d: str) -> DataFrame:
    """What a permission map grants, and what is left of it under a read-only default."""
    p = F.col("declared_permissions")
    merged = X.merge_permissions(F.create_map(F.lit("contents"), F.lit("read"), F.lit("packages"), F.lit("read")), p)
    return table(s, d, "actions").select("ingest_seq", X.has_write(p).alias("has_write"), merged["contents"].alias("contents"), merged["packages"].alias("packages"))


def callee_identifier(s: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    remote = u.rlike(X.REMOTE_CALL)
    return _uses(s, d).where(remote | u.rlike(X.LOCAL_CALL)).select(
        "u", remote.alias("is_remote"), F.when(remote, F.concat(X.uses_name(u), F.lit("@"), X.uses_ref(u))).otherwise(F.regexp_replace(u, r"^\./", "")).alias("callee")
    )


def html_strip(s: SparkSession, d: str) -> DataFrame:
    """Mark-up made of every action's fields and stripped again."""
    html = F.concat(F.lit("<li><b>"), "action_name", F.lit("</b>&nbsp;&amp;  <i class='x'>"), F.coalesce("marketplace_category", F.lit("")), F.lit("</i></li>"))
    return table(s, d, "actions").select("ingest_seq", X.strip_html(html).alias("text"))


def html_links(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<p><a href=\"/a\">x</a> <a rel=\"next\" href=\"/market?page="), F.col("ingest_seq").cast("string"), F.lit("\">Next</a></p>"))
    return table(s, d, "actions").select("ingest_seq", X.next_page(page).alias("next"))


def marketplace_cards(s: SparkSession, d: str) -> DataFrame:
    """A listing page written for every owner's published actions, and its cards read back."""
    a = D.actions(s, d).where("marketplace_published").select("owner", "action_id", "repo", F.nullif(strip("marketplace_category"), F.lit("")).alias("c"), (F.col("author_verified") == "verified").alias("v"))
    card = F.concat(
        F.lit('<li><a class="x" href="/marketplace/actions/'), "action_id", F.lit('"><h3>'), "repo", F.lit(" &amp; more</h3></a><p>By <b>"), "owner", F.lit('</b></p><a href="https://github.com/'), "owner", F.lit("/"), "repo", F.lit('">code</a>'),
        F.coalesce(F.concat(F.lit('<span data-testid="marketplace-category">'), "c", F.lit("</span>")), F.lit("")), F.when(F.col("v"), "<i>Verified creator</i>").otherwise(""), F.lit("</li>"),
    )
    pages = a.groupBy("owner", F.pmod(F.xxhash64("action_id"), F.lit(16)).alias("page")).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(card), ""), F.lit("</ul>")).alias("html"))
    return pages.select(F.explode(X.marketplace_cards(F.col("html"))).alias("k")).select("k.slug", "k.title", "k.owner", "k.repo", "k.category", "k.description", "k.verified")


def iso_timestamps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "repositories").select("ingest_seq", X.iso(F.col("collected_at")).alias("collected"), X.owner_of(F.col("full_name")).alias("owner_part"))


def identity_status(s: SparkSession, d: str) -> DataFrame:
    return D.identities(s, d).groupBy("identity_status").agg(F.count("*").alias("rows"))


def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return D.repositories(s, d).select("repo_id", "full_name", "ingest_seq")


def edges_actions(s: SparkSession, d: str) -> DataFrame:
    a = D.actions(s, d).select(F.col("action_id").alias("dst_node_id"), "owner", "repo")
    return D.edges(s, d).select("edge_id", "dst_node_id").join(a, "dst_node_id")


def marketplace_left(s: SparkSession, d: str) -> DataFrame:
    """Actions with their marketplace identity by owner and repo in any letter case; null where there is none."""
    m = D.marketplace(s, d)
    a = D.actions(s, d).select("action_id", F.lower("owner").alias("m_owner"), F.lower("repo").alias("m_repo"))
    return a.join(m, ["m_owner", "m_repo"], "left").select("action_id", "category", F.coalesce("verified_creator", F.lit(False)).alias("verified_creator"))


def impact(s: SparkSession, d: str) -> DataFrame:
    """Workflows, repositories and edges touched by actions of unverified authors."""
    bad = D.actions(s, d).where("author_verified = 'unverified'").select(F.col("action_id").alias("dst_node_id"))
    e = D.scoped(s, d).join(bad, "dst_node_id", "left_semi")
    return e.agg(F.count_distinct("workflow_id").alias("workflows"), F.count_distinct("consumer_repository").alias("repositories"), F.count("*").alias("edges"))


def reference_union(s: SparkSession, d: str) -> DataFrame:
    """References by name from four sources with their counts: actions, edges, changes, observations."""
    name = F.lower(F.concat_ws("/", "owner", "repo"))
    a = D.actions(s, d)
    by_id = a.select(F.col("action_id").alias("dst_node_id"), name.alias("name"))
    u = F.col("u")
    parts = [
        a.select(name.alias("name"), F.lit("actions").alias("source")),
        D.edges(s, d).select("dst_node_id").join(by_id, "dst_node_id").select("name", F.lit("edges").alias("source")),
        D.changes(s, d).select(F.explode(F.array_union("uses_before", "uses_after")).alias("u")).where(X.uses_part(u, 1).isNotNull()).select(X.action_name(u).alias("name"), F.lit("changes").alias("source")),
        D.observations(s, d).select(name.alias("name"), F.lit("observations").alias("source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = [F.count_if(F.col("source") == k).alias(k) for k in ("actions", "edges", "changes", "observations")]
    return out.groupBy("name").agg(F.count("*").alias("total"), *n)


def concentration(s: SparkSession, d: str) -> DataFrame:
    """Owners' shares of usage: Herfindahl index, top shares and Gini."""
    a = D.actions(s, d).select(F.col("action_id").alias("dst_node_id"), "owner")
    per = D.edges(s, d).join(a, "dst_node_id").groupBy("owner").agg(F.count("*").cast("double").alias("uses"))
    out = per.agg(F.round(stats.hhi(F.col("uses")), 8).alias("hhi"))
    tops = stats.top_shares(per, "uses", [1, 5, 10], ["owner"])
    g = stats.gini(per, "uses", ["owner"])
    return out.crossJoin(tops.select(*[F.round(c, 8).alias(c) for c in tops.columns])).crossJoin(g.select(F.round("gini", 8).alias("gini")))  # one row each


def percentile_stars(s: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles and the median of stars by fork flag."""
    from refweave.plans.temporal_metrics import histogram_rank

    r = D.repositories(s, d).select("is_fork", "stars")
    out = r.groupBy("is_fork").agg(F.median("stars").alias("median"))
    for p in (0.5, 0.95):
        out = out.join(histogram_rank(r, ["is_fork"], "stars", p, f"p{round(p * 100)}"), "is_fork")
    return out


def reasons(s: SparkSession, d: str) -> DataFrame:
    """Flags of a workflow's references as an ordered list of reasons; workflows without any are left out."""
    c = D.once(s, d, "categorized", lambda: categorized(s, d))
    w = c.groupBy("consumer_repository", "workflow_path").agg(
        F.bool_or(F.col("category").isin(*X.HIGH_RISK)).alias("high"), F.bool_or(F.col("author_verified") == "unverified").alias("unverified"), (F.max("depth") >= 3).alias("deep")
    )
    named = F.array_compact(F.array(F.when(F.col("high"), "high_risk_reference"), F.when(F.col("unverified"), "unverified_author"), F.when(F.col("deep"), "deep_cascade")))
    return w.withColumn("r", named).where("size(r) > 0").select("consumer_repository", "workflow_path", F.array_join("r", ",").alias("reasons"))


def trust_entities(s: SparkSession, d: str) -> DataFrame:
    """Trust by entity: each action counts for its owner, its repository and its category; mean weight by usage."""
    c = D.once(s, d, "categorized", lambda: categorized(s, d))
    cat = D.actions(s, d).select(F.col("action_id").alias("_a"), F.nullif(F.trim("marketplace_category"), F.lit("")).alias("mc"))
    c = c.join(cat, F.col("action_id") == F.col("_a"), "left")
    kinds = F.array_compact(F.array(
        F.struct(F.col("owner").alias("entity"), F.lit("owner").alias("kind")), F.struct(F.concat_ws("/", "owner", "repo").alias("entity"), F.lit("repository").alias("kind")),
        F.when(F.col("mc").isNotNull(), F.struct(F.col("mc").alias("entity"), F.lit("category").alias("kind"))),
    ))
    e = c.withColumn("e", F.explode(kinds)).groupBy("e.entity", "e.kind").agg(
        F.count("*").alias("usage"), F.count_distinct("action_id").alias("actions"), F.count_distinct("consumer_repository").alias("repositories"),
        F.round(F.avg("weight"), 6).alias("mean_weight"), F.round(F.count_if(X.is_mutable(F.col("category"))) / F.count("*"), 6).alias("mutable_ratio"),
    )
    return e


def depth_token_rate(s: SparkSession, d: str) -> DataFrame:
    """Share of token-reading actions by depth (0, 1, 2, 3+), all four in order."""
    a = D.actions(s, d).select(F.col("action_id").alias("dst_node_id"), "has_token_access")
    m = D.edges(s, d).where("dst_kind = 'action'").groupBy("dst_node_id").agg(F.min("depth").alias("m"))
    b = F.when(F.col("m") >= 3, "3+").otherwise(F.coalesce(F.col("m"), F.lit(0)).cast("string"))
    per = a.join(m, "dst_node_id", "left").groupBy(b.alias("bucket")).agg(F.count("*").alias("actions"), F.count_if("has_token_access").alias("with_token"))
    grid = s.createDataFrame([(k,) for k in ("0", "1", "2", "3+")], "bucket string")
    zero = F.lit(0).cast("long")
    out = grid.join(per, "bucket", "left").select("bucket", F.coalesce("actions", zero).alias("actions"), F.coalesce("with_token", zero).alias("with_token"))
    return out.withColumn("token_rate", F.round(X.rate(F.col("with_token"), F.col("actions")), 6))


def top_reuse(s: SparkSession, d: str) -> DataFrame:
    """The 15 most used high-risk references."""
    c = D.once(s, d, "categorized", lambda: categorized(s, d)).where(F.col("category").isin(*X.HIGH_RISK))
    return c.groupBy("action_id", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action_id").limit(15)


def lineitem_pricing(s: SparkSession, d: str) -> DataFrame:
    """Grouped sums over the largest star table."""
    t = table(s, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


def top_orders_per_customer(s: SparkSession, d: str) -> DataFrame:
    """Each customer's three greatest orders, ranked within the group."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (
    scan_actions, scoped_edges, direct_edges, high_star_repos, stable_ids, classify_ref, ref_category, parse_action_ref, trust_domain, depth_bucket, normalize_name,
    marketplace_cards, name_lookalikes, prefix_confusion, contains_keywords, token_patterns, script_paths, permission_levels, callee_identifier, html_strip, html_links, iso_timestamps,
    identity_status, latest_per_key, edges_actions, marketplace_left, impact, reference_union, concentration, percentile_stars, reasons, trust_entities, depth_token_rate, top_reuse, lineitem_pricing, top_orders_per_customer,
)}

_KIND = """case when ref is null or regexp_matches(ref, '\\$\\{\\{\\s*[^}]+\\s*\\}\\}') then 'unknown' when regexp_full_match(ref, '[0-9a-fA-F]{40}') then 'sha' when starts_with(ref, 'refs/heads/') then 'branch'
  when regexp_full_match(ref, 'v?\\d+(\\.\\d+)*([\\-+].+)?') then 'tag' when ref in ('main', 'master', 'develop') or contains(ref, '/') then 'branch' else 'tag' end"""
_PARSES = f"instr(u, '@') > 0 and instr({_N}, '/') > 0"
_DOM = f"""case when not ({_PARSES}) then 'unknown' when lower(split_part(u, '/', 1)) in ('actions', 'github') then 'github_owned'
  when lower(split_part(u, '/', 1)) = lower(split_part(repository_full_name, '/', 1)) then 'same_owner' when regexp_full_match(split_part(u, '/', 1), '[A-Za-z0-9_.-]+') then 'third_party' else 'unknown' end"""
_NAMED = f"case when {_PARSES} then lower(split_part({_N}, '/', 1) || '/' || split_part({_N}, '/', 2)) else lower(u) end"
_TOK = "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(content, '{p}')" for p in TOKEN_PATTERNS) + "])))"

ORACLE = {
    "scan_actions": "select action_id, owner, repo, ref from actions where marketplace_published",
    "scoped_edges": q("", "select edge_id, workflow_id, dst_node_id, cast(depth as bigint) as depth from sc"),
    "direct_edges": q("", "select edge_id, src_node_id, dst_node_id from ed where src_kind = 'workflow' and dst_kind = 'action'"),
    "high_star_repos": q("", "select repo_id, full_name, stars from rl where stars > 50"),
    "stable_ids": "select ingest_seq, action_id, sha1(owner || '::' || repo || '::' || coalesce(subpath, '') || '::' || ref) = action_id as is_equal from actions",
    "classify_ref": f"select ref, {_KIND} as kind, regexp_matches(ref, '\\$\\{{\\{{\\s*[^}}]+\\s*\\}}\\}}') as is_dynamic from (select distinct ref from actions)",
    "ref_category": f"""select *, {WEIGHT} as weight, {HIGH} or category = 'MAJOR_TAG' as movable, category <> 'FULL_SHA' as mutable from (select ref, {category("ref")} as category from (select distinct ref from actions))""",
    "parse_action_ref": f"""select u, case when {_PARSES} then split_part({_N}, '/', 1) end as owner, case when {_PARSES} then split_part({_N}, '/', 2) end as repo,
      case when {_PARSES} and len(split({_N}, '/')) > 2 then array_to_string(split({_N}, '/')[3:], '/') end as subpath, case when {_PARSES} then {_R} end as ref from {_U}""",
    "trust_domain": f"select repository_full_name, u, {_DOM} as domain, {_NAMED} as name from (select distinct repository_full_name, unnest(uses_after) as u from workflow_changes) where u is not null",
    "depth_bucket": q("", "select case when depth <= 1 then 'level_1' when depth = 2 then 'level_2' else 'level_3_plus' end as bucket, count(*) as edges from sc group by 1"),
    "normalize_name": "select distinct action_name, regexp_replace(lower(action_name), '[^a-z0-9]+', '', 'g') as plain from actions",
    "name_lookalikes": "with n as (select distinct lower(repo) as name from actions) select a.name as a, b.name as b, levenshtein(a.name, b.name) as distance from n a join n b on a.name < b.name where levenshtein(a.name, b.name) <= 2",
    "prefix_confusion": """with n as (select distinct owner, repo from actions) select a.owner, a.repo as shorter, b.repo as longer from n a join n b on a.owner = b.owner and a.repo <> b.repo and starts_with(b.repo, a.repo)""",
    "contains_keywords": "select doc_id, " + ", ".join(f"contains(lower(coalesce(text, '')), '{n}') as has_{n}" for n in ("secret", "token", "deploy", "aws", "cache"))
    + ", regexp_matches(lower(coalesce(text, '')), 'secret|token|deploy|aws|cache') as has_any from documents",
    "token_patterns": f"select ingest_seq, array_to_string({_TOK}, '|') as patterns from workflows where content is not null",
    "permission_levels": """select ingest_seq, len(list_filter(map_values(declared_permissions), lambda v: contains(lower(v), 'write'))) > 0 as has_write,
      coalesce(nullif(declared_permissions['contents'], 'default'), 'read') as contents, coalesce(nullif(declared_permissions['packages'], 'default'), 'read') as packages from actions""",
    "callee_identifier": f"""select u, regexp_matches(u, '(?i)^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/\\.github/workflows/[^@]+\\.(?:yml|yaml)@.+$') as is_remote, case when is_remote then {_N} || '@' || {_R} else regexp_replace(u, '^\\./', '') end as callee
      from {_U} where is_remote or regexp_matches(u, '(?i)^\\./\\.github/workflows/[^@]+\\.(?:yml|yaml)$')""",
    "html_strip": "select ingest_seq, trim(regexp_replace(action_name || ' &  ' || coalesce(marketplace_category, ''), '\\s+', ' ', 'g')) as text from actions",
    "marketplace_cards": q("", f"""select action_id as slug, repo || ' & more' as title, owner, repo, nullif(trim(marketplace_category, {_WS}), '') as category, 'By ' || owner as description,
      author_verified = 'verified' as verified from ac where marketplace_published"""),
    "html_links": "select ingest_seq, '/market?page=' || ingest_seq as next from actions",
    "iso_timestamps": "select ingest_seq, coalesce(strftime(collected_at, '%Y-%m-%dT%H:%M:%S'), '') as collected, split_part(full_name, '/', 1) as owner_part from repositories",
    "identity_status": """select case when r is not null and lower(r) = lower(full_name) then 'canonical' when r is not null then 'redirected' when html_url is null then 'missing' else 'inaccessible' end as identity_status, count(*) as rows
      from (select *, nullif(regexp_extract(coalesce(html_url, ''), '^https?://[^/]+/([^/]+/[^/]+?)/*$', 1), '') as r from repositories) group by 1""",
    "latest_per_key": q("", "select repo_id, full_name, ingest_seq from rl"),
    "edges_actions": q("", "select e.edge_id, e.dst_node_id, a.owner, a.repo from ed e join ac a on a.action_id = e.dst_node_id"),
    "marketplace_left": q("mk as (select lower(owner) as o, lower(repo) as r, max(marketplace_category) as category, bool_or(author_verified = 'verified') as v from ac where marketplace_published group by 1, 2),",
      "select action_id, category, coalesce(v, false) as verified_creator from ac left join mk on o = lower(owner) and r = lower(repo)"),
    "impact": q("", """select count(distinct workflow_id) as workflows, count(distinct consumer_repository) as repositories, count(*) as edges from sc
      where dst_node_id in (select action_id from ac where author_verified = 'unverified')"""),
    "reference_union": q("", f"""select name, count(*) as total, count(*) filter (where source = 'actions') as actions, count(*) filter (where source = 'edges') as edges,
      count(*) filter (where source = 'changes') as changes, count(*) filter (where source = 'observations') as observations from (
      select lower(owner || '/' || repo) as name, 'actions' as source from ac union all select lower(a.owner || '/' || a.repo), 'edges' from ed e join ac a on a.action_id = e.dst_node_id
      union all select {_NAMED}, 'changes' from (select *, unnest(list_distinct(list_concat(coalesce(uses_before, []), coalesce(uses_after, [])))) as u from (select distinct on (repository_full_name, workflow_path, commit_sha, committed_at, uses_before, uses_after) * from workflow_changes)) where {_PARSES}
      union all select lower(owner || '/' || repo), 'observations' from (select distinct on (action_id, ref_name, ref_type, sha, observed_at) * from ref_observations where sha is not null)) group by 1"""),
    "concentration": q("pw as (select owner, count(*)::double as n from ed e join ac a on a.action_id = e.dst_node_id group by 1), pr as (select *, row_number() over (order by n, owner) as i, row_number() over (order by n desc, owner) as j, count(*) over () as k from pw),",
      "select round(sum(n * n) / pow(sum(n), 2), 8) as hhi, " + ", ".join(f"round(sum(n) filter (where j <= {k}) / sum(n), 8) as top_{k}_share" for k in (1, 5, 10))
      + ", round(2 * sum(i * n) / (max(k) * sum(n)) - (max(k) + 1) / max(k), 8) as gini from pr"),
    "percentile_stars": q("sr as (select is_fork, stars, row_number() over (partition by is_fork order by stars) as i, count(*) over (partition by is_fork) as n from rl),",
      "select is_fork, median(stars) as median, max(stars) filter (where i = round_even((n - 1) * 0.5, 0) + 1) as p50, max(stars) filter (where i = round_even((n - 1) * 0.95, 0) + 1) as p95 from sr group by 1"),
    "reasons": q(CAT, f"""select consumer_repository, workflow_path, array_to_string(list_filter([case when bool_or({HIGH}) then 'high_risk_reference' end, case when bool_or(author_verified = 'unverified') then 'unverified_author' end,
      case when max(depth) >= 3 then 'deep_cascade' end], lambda x: x is not null), ',') as reasons from cw group by 1, 2 having bool_or({HIGH}) or bool_or(author_verified = 'unverified') or max(depth) >= 3"""),
    "trust_entities": q(CAT + "te as (select c.*, nullif(trim(a.marketplace_category), '') as mc from cw c left join ac a using (action_id)), tx as (select *, owner as entity, 'owner' as kind from te union all select *, owner || '/' || repo, 'repository' from te union all select *, mc, 'category' from te where mc is not null),",
      """select entity, kind, count(*) as usage, count(distinct action_id) as actions, count(distinct consumer_repository) as repositories, round(avg(weight), 6) as mean_weight,
      round(count(*) filter (where category <> 'FULL_SHA') / count(*), 6) as mutable_ratio from tx group by 1, 2"""),
    "depth_token_rate": q("dm as (select dst_node_id as action_id, min(depth) as m from ed where dst_kind = 'action' group by 1), dn as (select case when m >= 3 then '3+' else coalesce(m, 0)::varchar end as bucket, has_token_access from ac left join dm using (action_id)),",
      """select g.bucket, count(has_token_access) as actions, count(*) filter (where has_token_access) as with_token, round(case when count(has_token_access) > 0 then count(*) filter (where has_token_access) / count(has_token_access) else 0 end, 6) as token_rate
      from (values ('0'), ('1'), ('2'), ('3+')) g(bucket) left join dn using (bucket) group by 1"""),
    "top_reuse": q(CAT, f"select action_id, category, count(*) as n from cw where {HIGH} group by 1, 2 order by n desc, action_id limit 15"),
    "lineitem_pricing": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc from lineitem group by 1, 2",
    "top_orders_per_customer": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 3",
}

