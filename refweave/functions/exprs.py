"""Scalar and parsing functions as column expressions: all built-in, none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference categories, their weights, and the names and patterns that decide them.
REF_CATEGORIES = ("FULL_SHA", "SHORT_SHA", "BRANCH_MAIN", "BRANCH_OTHER", "MAJOR_TAG", "SEMVER_TAG", "FLOATING_TAG", "UNKNOWN_REF")
RISK_WEIGHTS = {
    "FULL_SHA": 0.0, "SHORT_SHA": 0.2, "SEMVER_TAG": 0.45, "MAJOR_TAG": 0.7,
    "BRANCH_MAIN": 0.95, "BRANCH_OTHER": 1.0, "FLOATING_TAG": 1.0, "UNKNOWN_REF": 0.85,
}
HIGH_RISK = ("BRANCH_MAIN", "BRANCH_OTHER", "FLOATING_TAG", "UNKNOWN_REF")
MAIN_BRANCHES = ("main", "master", "refs/heads/main", "refs/heads/master")
OTHER_BRANCHES = ("dev", "develop", "development", "next", "beta", "nightly", "canary", "edge", "preview", "alpha")
FLOATING_TAGS = ("latest", "stable", "release")
DYNAMIC_REF = r"\$\{\{\s*[^}]+\s*\}\}"
USES = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:/.+)?@.+$"
SCRIPT_PATH = r"(?<![\w./-])(?:\./)?[\w./-]+\.(?:sh|bash|ps1|cmd|py|js|mjs|cjs|ts)"
TOKEN_PATTERNS = (
    r"\bGITHUB_TOKEN\b", r"secrets\.GITHUB_TOKEN", r"github\.token", r"process\.env\.[A-Z0-9_]+",
    r"\$GITHUB_TOKEN\b", r"INPUT_[A-Z0-9_]+", r"core\.getInput\(",
)
REMOTE_CALL = r"(?i)^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/\.github/workflows/[^@]+\.(?:yml|yaml)@.+$"
LOCAL_CALL = r"(?i)^\./\.github/workflows/[^@]+\.(?:yml|yaml)$"
# Names that are always among the popular ones, where they occur.
CANONICAL_NAMES = (
    "actions/checkout", "actions/setup-node", "actions/upload-artifact", "actions/download-artifact",
    "actions/cache", "actions/setup-python", "docker/login-action", "github/codeql-action",
)
PLATFORM_OWNERS = ("actions", "github")
SCOPES = ("contents", "actions", "checks", "deployments", "id-token", "issues", "packages", "pull-requests", "security-events", "statuses")


def is_dynamic_ref(ref: Column) -> Column:
    return ref.rlike(DYNAMIC_REF)


def classify_ref(ref: Column) -> Column:
    """sha, branch, tag or unknown, by the first rule that holds."""
    return (
        F.when(ref.isNull() | is_dynamic_ref(ref), "unknown").when(ref.rlike(r"^[0-9a-fA-F]{40}$"), "sha").when(ref.startswith("refs/heads/"), "branch")
        .when(ref.rlike(r"^v?\d+(\.\d+)*([\-+].+)?$"), "tag").when(ref.isin("main", "master", "develop") | ref.contains("/"), "branch").otherwise("tag")
    )


def ref_category(ref: Column) -> Column:
    """One of REF_CATEGORIES, by the first rule that holds."""
    r = F.trim(ref)
    low = F.lower(r)
    return (
        F.when(r.isNull() | (r == ""), "UNKNOWN_REF").when(r.rlike(r"^[0-9a-fA-F]{40}$"), "FULL_SHA").when(r.rlike(r"^[0-9a-fA-F]{7,39}$"), "SHORT_SHA")
        .when(low.isin(*MAIN_BRANCHES), "BRANCH_MAIN").when(low.isin(*OTHER_BRANCHES) | low.startswith("refs/heads/"), "BRANCH_OTHER")
        .when(low.isin(*FLOATING_TAGS), "FLOATING_TAG").when(r.rlike(r"^v?\d+\.\d+\.\d+(?:[-+][A-Za-z0-9_.-]+)?$"), "SEMVER_TAG")
        .when(r.rlike(r"^v?\d+$"), "MAJOR_TAG").otherwise("UNKNOWN_REF")
    )


def risk_weight(category: Column) -> Column:
    out = F.lit(0.85)
    for name, weight in RISK_WEIGHTS.items():
        out = F.when(category == name, F.lit(weight)).otherwise(out)
    return out


def is_mutable(category: Column) -> Column:
    """Everything but a full sha."""
    return category != "FULL_SHA"


def is_movable(category: Column) -> Column:
    """The narrower reading: high-risk categories and major tags."""
    return category.isin(*HIGH_RISK, "MAJOR_TAG")


def depth_bucket(depth: Column) -> Column:
    return F.when(depth <= 1, "level_1").when(depth == 2, "level_2").otherwise("level_3_plus")


def uses_ref(uses: Column) -> Column:
    """What follows the first @; null without one."""
    at = F.instr(uses, "@")
    return F.when(at > 0, uses.substr(at + 1, F.length(uses)))


def uses_name(uses: Column) -> Column:
    return F.when(F.instr(uses, "@") > 0, F.substring_index(uses, "@", 1))


def uses_part(uses: Column, i: int) -> Column:
    return F.get(F.split(uses_name(uses), "/"), F.lit(i))


def uses_subpath(uses: Column) -> Column:
    parts = F.split(uses_name(uses), "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, 1_000_000), "/"))


def action_name(uses: Column) -> Column:
    """owner/repo in lower case; a text that does not parse as it is, in lower case."""
    owner, repo = uses_part(uses, 0), uses_part(uses, 1)
    return F.when(repo.isNotNull(), F.lower(F.concat_ws("/", owner, repo))).otherwise(F.lower(uses))


def trust_domain(uses: Column, repository_owner: Column) -> Column:
    """github_owned, same_owner, third_party or unknown; a text without owner/repo@ref is unknown."""
    owner = F.when(uses_part(uses, 1).isNotNull(), uses_part(uses, 0))
    return (
        F.when(owner.isNull(), "unknown").when(F.lower(owner).isin(*PLATFORM_OWNERS), "github_owned")
        .when(F.lower(owner) == F.lower(repository_owner), "same_owner").when(owner.rlike(r"^[A-Za-z0-9_.-]+$"), "third_party").otherwise("unknown")
    )


def contains_any(text: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """Whether a text holds one of the needles, in any letter case; null holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n.lower())
    return out


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def prefix_confusion(a: Column, b: Column) -> Column:
    """One name begins or ends with the other one, and they differ."""
    return (a != b) & (a != "") & (b != "") & (a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a))


def token_patterns(text: Column) -> Column:
    """Sorted distinct matches of the token patterns."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in TOKEN_PATTERNS]))
    return F.array_sort(F.array_distinct(found))


def script_paths(command: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(SCRIPT_PATH), F.lit(0))))


def owner_of(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(1))


def workflow_id(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("workflow::"), repository, F.lit("::"), path)


def has_write(permissions: Column) -> Column:
    """Whether any value of a permission map names write."""
    return F.coalesce(F.exists(F.map_values(permissions), lambda v: F.lower(v).contains("write")), F.lit(False))


def merge_permissions(workflow: Column, job: Column) -> Column:
    """The job's levels over the workflow's, where the job's are not the default."""
    return F.map_zip_with(workflow, job, lambda k, a, b: F.when(b.isNotNull() & (b != "default"), b).otherwise(a))


def scope_levels(permissions: Column) -> Column:
    """The ten known scopes with their level (write, read, none; default where nothing or something else is said), and the two
    words for all of them with write or none."""
    low = F.transform_keys(F.transform_values(F.coalesce(permissions, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(v))), lambda k, v: F.lower(F.trim(k)))
    level = lambda v: F.when(v.isin("write", "read", "none"), v).when(v == "write-all", "write").when(v == "read-all", "read").otherwise("default")
    values = [F.coalesce(level(low[s]), F.lit("default")) for s in SCOPES] + [F.when(F.map_contains_key(low, w), "write").otherwise("none") for w in ("write-all", "read-all")]
    return F.map_from_arrays(F.array(*map(F.lit, SCOPES), F.lit("write-all"), F.lit("read-all")), F.array(*values))


def is_same_repository(repository: Column, owner: Column, repo: Column) -> Column:
    return F.lower(repository) == F.lower(F.concat_ws("/", owner, repo))


def is_main_ref(ref: Column) -> Column:
    return F.coalesce(F.lower(F.trim(ref)).isin("main", "refs/heads/main"), F.lit(False))


def dependency(uses: Column) -> Column:
    """A reference as one struct: its text, owner, repo, subpath, ref, the ref's kind and whether it is computed."""
    ref = uses_ref(uses)
    return F.struct(
        uses.alias("uses_value"), uses_part(uses, 0).alias("owner"), uses_part(uses, 1).alias("repo"), uses_subpath(uses).alias("subpath"), ref.alias("ref_string"),
        classify_ref(ref).alias("ref_kind"), is_dynamic_ref(ref).alias("is_dynamic_ref"),
    )


def strip_html(html: Column) -> Column:
    """Tags become blanks, the five basic entities and no-break blanks are resolved, white space collapses."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def next_page(html: Column) -> Column:
    """The target of the link marked rel=next, null if there is none."""
    out = F.regexp_extract(html, r'(?i)<a\b(?=[^>]*\brel="?next"?)[^>]*\bhref="([^"]+)"', 1)
    return F.nullif(out, F.lit(""))


def identity_status(status_code: Column, resolved: Column, referenced: Column) -> Column:
    return (
        F.when((status_code == 200) & (F.lower(resolved) == F.lower(referenced)), "canonical").when(status_code == 200, "redirected")
        .when(status_code == 404, "missing").otherwise("inaccessible")
    )


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hours_between(start: Column, end: Column) -> Column:
    """From one timestamp to another in hours."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def nearest_rank(values: Column, q: float) -> Column:
    """Of an aggregate's values the one at the rounded (half to even) position (n - 1) q; null if there are none."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.rint((F.size(ordered) - 1) * F.lit(q)).cast("int"))


def stable_id_parts(*columns: str) -> Column:
    """SHA-1 of columns joined by ``::``; nulls count as empty."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def marketplace_cards(html: Column) -> Column:
    """The cards of a listing page: slug, title, owner, repo, category, description, verified, in page order.

    A card begins at a link to an action's page and ends where the next one begins; what it lacks is null.
    """
    pieces = F.split(html, r'(?=<a\b[^>]*href="/marketplace/actions/[^"]+")')

    def first(piece: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(piece, pattern, 1), F.lit(""))

    def card(piece: Column) -> Column:
        repo = r"github\.com/([^/]+)/([^/\"?#<\s]+)"
        return F.struct(
            first(piece, r'href="/marketplace/actions/([^"?#]+)').alias("slug"), strip_html(first(piece, r"(?s)<h3[^>]*>(.*?)</h3>")).alias("title"),
            first(piece, repo).alias("owner"), F.nullif(F.regexp_extract(piece, repo, 2), F.lit("")).alias("repo"), strip_html(first(piece, r'data-testid="marketplace-category">(.*?)<')).alias("category"),
            strip_html(first(piece, r"(?s)<p[^>]*>(.*?)</p>")).alias("description"), F.regexp_like(piece, F.lit(r"(?i)Verified creator|Partner|Creator verified")).alias("verified"),
        )

    return F.transform(F.filter(pieces, lambda p: p.contains('href="/marketplace/actions/')), card)
