"""History of changing entity attributes (type-two dimension): periodic updates are merged one after the other.

An update's versions are compared, by attribute hash, with the version that is current for their key: an equal
one continues it, a different one closes it with an end date and is inserted, as are the versions behind it.
What a merge touches is one open version and one first version per key; closed versions are never read again.

Rows of one key may be a third of the table, so keys with many rows are cut into slices in time (from counts,
``refweave.operators.slices``); each slice is turned into versions on its own, and one summary row per (key,
slice) joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refweave.operators.slices import counts_by_bucket, cut, widths
from refweave.session import materialize

DAY_US = 86_400_000_000
#: Rows of one key that one window may hold; keys with more are cut.
MAX_SLICE = 250_000
#: Periodic updates a table of observations is taken as.
PERIODS = 4

GROUP = ["_key", "_period", "_slice"]


def attribute_hash(*attrs: str) -> Column:
    """128 bits over the attributes; nulls and empty texts differ."""
    packed = F.to_json(F.struct(*attrs), {"ignoreNullFields": "false"}) if len(attrs) > 1 else F.coalesce(F.concat(F.lit("="), F.col(attrs[0]).cast("string")), F.lit("-"))
    return F.unhex(F.substring(F.sha2(packed, 256), 1, 32))


def _versions(obs: DataFrame, key: str, ts: str, seq: str, attrs: list[str], most: int, periods: int) -> DataFrame:
    """The versions of every (key, period) on its own, written once.

    Columns: _key, _attrs, _hash, _from, _to (null: open at the period's end), _head (the key's first one in
    the period), _seen (of open ones: the key's last observation in the period), _period.
    """
    rows = obs.select(F.col(key).alias("_key"), F.col(ts).cast("long").alias("_ts"), F.col(seq).alias("_seq"), F.struct(*[F.col(a) for a in attrs]).alias("_attrs"))
    rows = rows.where("_key is not null and _ts is not null")
    buckets = counts_by_bucket(rows, "_key", "_ts")
    plan = widths(rows, "_key", "_ts", most, buckets)
    if periods > 1:
        lo, hi = float(min((b[2] for b in buckets), default=0)), float(max((b[3] for b in buckets), default=0))
        rows = rows.withColumn("_period", F.least(F.lit(periods - 1), F.floor((F.col("_ts") - F.lit(lo)) / F.lit((hi - lo + 1) / periods))).cast("int"))
    else:
        rows = rows.withColumn("_period", F.lit(0))
    # Hashed after the exchange: the hash needs no shuffling.
    rows = cut(rows, "_key", "_ts", plan).repartition(*GROUP).withColumn("_hash", attribute_hash(*[f"_attrs.`{a}`" for a in attrs]))
    w = W.partitionBy(*GROUP).orderBy("_ts", "_seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # Of rows of equal key and time the highest seq holds.
    states = rows.withColumn("_next", F.lead("_ts").over(w)).where("_next is null or _next <> _ts")
    states = states.withColumn("_before", F.lag("_hash").over(w)).withColumn("_last_hash", F.last("_hash").over(whole)).withColumn("_last_ts", F.last("_ts").over(whole))
    changed = states.where("_before is null or _before <> _hash")
    found = changed.withColumn("_to", F.lead("_ts").over(w)).select(*GROUP, "_is_cut", "_attrs", "_hash", F.col("_ts").alias("_from"), "_to", (F.col("_before").isNull()).alias("_head"), "_last_hash", F.col("_last_ts").alias("_seen"))
    found = materialize(found, ["_period"] if periods > 1 else [])
    out = ["_key", "_attrs", "_hash", "_from", "_to", "_head", F.when(F.col("_to").isNull(), F.col("_seen")).alias("_seen"), "_period"]
    if plan is None:
        return found.select(out)
    # Slices of cut keys: one continues the version the slice before ends with, or closes it; a version still open at the
    # end of its slice is closed by the next slice that begins with, or first changes to, something else.
    k = W.partitionBy("_key", "_period").orderBy("_slice")
    ahead, all_ = k.rowsBetween(1, W.unboundedFollowing), k.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joined = (
        found.where("_is_cut and _head").withColumn("_current", F.lag("_last_hash").over(k))
        .withColumn("_opens", F.col("_current").isNull() | (F.col("_current") != F.col("_hash")))
        .withColumn("_end", F.first(F.when(F.col("_opens"), F.col("_from")).otherwise(F.col("_to")), ignorenulls=True).over(ahead))
        .select(*GROUP, "_opens", F.col("_current").isNull().alias("_first"), "_end", F.last("_seen").over(all_).alias("_key_seen"))
    )
    pieces = found.where("_is_cut").join(joined, GROUP).where("not _head or _opens").withColumn("_to", F.coalesce("_to", "_end")).withColumn("_head", F.col("_head") & F.col("_first")).withColumn("_seen", F.col("_key_seen"))
    return found.where("not _is_cut").select(out).unionByName(pieces.select(out))


STATE = ["_key", "_attrs", "_hash", "_from", "_to", "_seen"]


def _merge(current: DataFrame, heads: DataFrame) -> DataFrame:
    """The type-two step: open versions (one per key at most) met by the first versions of an update.

    A first version with the hash of the current one continues it; a different one closes it and is inserted.
    """
    as_struct = lambda name: F.struct(*STATE[1:]).alias(name)
    met = current.select("_key", as_struct("o")).join(heads.select("_key", as_struct("h")), "_key", "full")
    o, h = F.col("o"), F.col("h")
    same = o["_hash"] == h["_hash"]
    end = F.when(h.isNull(), o["_to"]).when(same, h["_to"]).otherwise(h["_from"])
    seen = F.when(h.isNull(), o["_seen"]).when(same, h["_seen"])
    kept = F.when(o.isNotNull(), F.struct(o["_attrs"].alias("_attrs"), o["_hash"].alias("_hash"), o["_from"].alias("_from"), end.alias("_to"), seen.alias("_seen")))
    new = F.when(h.isNotNull() & (o.isNull() | ~same), h)
    return met.select("_key", F.explode(F.array_compact(F.array(kept, new))).alias("v")).select("_key", "v.*")


def _public(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("_key").alias(key), "_attrs.*", F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"), F.col("_hash").alias("attr_hash"), F.col("_seen").alias("last_seen"))


def build_history(obs: DataFrame, key: str, ts: str, seq: str, attrs: list[str], most: int = MAX_SLICE, periods: int = 1) -> DataFrame:
    """Type-two history of ``attrs`` per ``key`` from irregular observations at ``ts`` (long, microseconds).

    The observations are taken as ``periods`` updates of equal length in time, merged one after the other.
    Result: key, attrs, valid_from, valid_to (null: still open), attr_hash, last_seen (of open versions: the
    key's last observation), one row per longest run of equal attributes, whatever ``most`` and ``periods``.
    Rows with a null key or ts are no observations. Of rows with equal key and ts the highest ``seq`` holds.
    Null attributes are values like any other (filter before, where a null says nothing). Repeated rows
    change nothing; an empty table gives an empty history. Extra columns are ignored.
    """
    versions = _versions(obs, key, ts, seq, attrs, most, periods)
    if periods <= 1:
        return _public(versions, key)
    # Versions closed inside their period, but for the first one of each key, are final; the others take part in merges.
    final = versions.where("not _head and _to is not null").select(STATE)
    edge = versions.where("_head or _to is null")
    first = edge.where("_period = 0").select(STATE)
    done, current = [final, first.where("_to is not null")], first.where("_to is null")
    for p in range(1, periods):
        update = edge.where(F.col("_period") == p)
        merged = materialize(_merge(current, update.where("_head")).unionByName(update.where("not _head").select(STATE)))
        done.append(merged.where("_to is not null"))
        current = merged.where("_to is null")
    out = current
    for part in done:
        out = out.unionByName(part)
    return _public(out, key)


def merge_history(history: DataFrame, log: DataFrame, updates: DataFrame, key: str, ts: str, seq: str, attrs: list[str], most: int = MAX_SLICE) -> DataFrame:
    """``history`` (as of build_history over ``log``) brought up to date with ``updates``.

    Keys whose updates all lie after what was last seen of them take the merge: it reads their open versions
    and the updates. Keys with late or overruling rows are rebuilt from ``log`` and ``updates``, as a late row
    can split a closed version. Keys without updates pass through. Same nulls, ties and repeats as build_history.
    """
    new = updates.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    touched = new.groupBy(F.col(key).alias("_key")).agg(F.min(F.col(ts).cast("long")).alias("_first_new"))
    state = history.select(
        F.col(key).alias("_key"), F.struct(*[F.col(a) for a in attrs]).alias("_attrs"), F.col("attr_hash").alias("_hash"), F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"), F.col("last_seen").alias("_seen"),
    )
    fate = materialize(touched.join(state.where("_to is null").select("_key", "_seen"), "_key", "left").select("_key", F.coalesce(F.col("_seen") >= F.col("_first_new"), F.lit(False)).alias("_late")))
    late = fate.where("_late").select(F.col("_key").alias(key))
    pick = [key, ts, seq, *attrs]
    rebuilt = build_history(log.select(pick).unionByName(new.select(pick)).join(late, key, "left_semi"), key, ts, seq, attrs, most)
    fresh = _versions(new.join(late, key, "left_anti"), key, ts, seq, attrs, most, 1)
    kept = state.join(fate.where("_late"), "_key", "left_anti")
    merged = _merge(kept.where("_to is null").select(STATE), fresh.where("_head"))
    rows = kept.where("_to is not null").select(STATE).unionByName(merged.select(STATE)).unionByName(fresh.where("not _head").select(STATE))
    return _public(rows, key).unionByName(rebuilt)
