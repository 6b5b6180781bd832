"""Maintenance joins: reconcile, sync decisions, pruning, change sets, history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions import keys, paths
from .catalog import NAMESPACE, PK, live


# --- objects against catalog ---------------------------------------------------


def originals(objects: DataFrame) -> DataFrame:
    """Listed objects that are originals, with their primary-key parts."""
    # The channel word is tested apart from the parse, so that a scan can use it.
    listed = objects.where(F.startswith("key", F.lit("tenants/")))
    parsed = listed.withColumn("_k", keys.parse_key(F.col("key")))
    return parsed.where(F.col("_k.channel") == "original").select(
        F.col("_k.tenant_id").alias("tenant_id"),
        F.col("_k.namespace").alias("namespace"),
        F.col("_k.path").alias("path"),
        *objects.columns,
    )


def reconcile_states(
    objects: DataFrame,
    entries: DataFrame,
    now: datetime | Column,
    grace_seconds: int = limits.RECONCILE_GRACE_SECONDS,
) -> DataFrame:
    """Every path known to either side, with its ``state`` and the ``action`` it needs.

    One full outer join on the unique primary key: no key repeats on either side,
    so the shuffle spreads evenly whatever the sizes of the namespaces.
    """
    stored = originals(objects).select(
        *PK,
        F.col("etag").alias("object_etag"),
        F.col("size").alias("object_size"),
        F.col("last_modified").alias("object_modified"),
        F.lit(True).alias("_object"),
    )
    rows = entries.select(
        *PK,
        F.col("etag").alias("entry_etag"),
        F.col("size").alias("entry_size"),
        "updated_at",
        F.col("deleted_at").isNotNull().alias("_dead"),
        F.lit(True).alias("_entry"),
    )
    at = now if isinstance(now, Column) else F.lit(now)
    cutoff = at - F.expr(f"interval {int(grace_seconds)} seconds")
    left, right = paths.norm_etag(F.col("object_etag")), paths.norm_etag(F.col("entry_etag"))
    # A store that lists no tags gives nothing to compare: fall back to size and time.
    untagged = (left == "") | (right == "")
    drifted = F.when(
        untagged,
        (F.col("object_size") != F.col("entry_size")) | (F.col("object_modified") > F.col("updated_at")),
    ).otherwise(left != right)
    present, known, dead = (
        F.coalesce(F.col(c), F.lit(False)) for c in ("_object", "_entry", "_dead")
    )
    state = (
        F.when(present & ~known, "new")
        .when(present & dead, "revived")
        .when(present & F.coalesce(drifted, F.lit(False)), "drifted")
        .when(present, "in_sync")
        .when(dead, "gone")
        .when(F.col("updated_at") > cutoff, "fresh")
        .otherwise("orphaned")
    )
    action = (
        F.when(F.col("state").isin("new", "revived", "drifted"), "enqueue")
        .when(F.col("state") == "orphaned", "tombstone")
        .otherwise("none")
    )
    return (
        stored.join(rows, PK, "full_outer")
        .withColumn("state", state)
        .withColumn("action", action)
        .select(
            *PK,
            "state",
            "action",
            present.alias("has_object"),
            (known & ~dead).alias("has_live_row"),
        )
    )


def reconcile_report(states: DataFrame) -> DataFrame:
    """The counts of one sweep in a single row."""
    spaces = states.groupBy(*NAMESPACE).agg(
        F.count_if("has_object").alias("objects"),
        F.count_if("has_live_row").alias("live_rows"),
        F.count_if(F.col("action") == "enqueue").alias("enqueued"),
        F.count_if(F.col("action") == "tombstone").alias("tombstoned"),
        F.count_if(F.col("state") == "in_sync").alias("in_sync"),
    )
    counts = ("objects", "live_rows", "enqueued", "tombstoned", "in_sync")
    return spaces.agg(
        F.count("*").alias("namespaces"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
    )


# --- source against catalog ----------------------------------------------------


def sync_versions(items: DataFrame, entries: DataFrame) -> DataFrame:
    """First phase: items joined to live rows of the target namespace on path.
    ``decision`` is 'skip_version' when the source says nothing changed, else
    'fetch'. Content is not read here."""
    stored = live(entries).select(
        "path",
        "entry_id",
        "created_at",
        F.col("checksum").alias("stored_checksum"),
        F.col("source.version").alias("stored_version"),
    )
    same = F.col("stored_version") == F.nullif(F.col("version"), F.lit(""))
    return items.join(stored, "path", "left").withColumn(
        "decision", F.when(F.coalesce(same, F.lit(False)), "skip_version").otherwise("fetch")
    )


def sync_plan(items: DataFrame, entries: DataFrame, contents: DataFrame) -> DataFrame:
    """Both phases. ``contents`` is (path, checksum[, error]), one row per fetched
    item; an item whose fetch failed, or is missing, is 'failed' with its error."""
    if "error" not in contents.columns:
        contents = contents.withColumn("error", F.lit(None).cast("string"))
    phase = sync_versions(items, entries)
    fetched = contents.select("path", "checksum", F.col("error").alias("_error"), F.lit(True).alias("_got"))
    error = F.when(
        F.col("decision") == "fetch",
        F.coalesce(F.col("_error"), F.when(F.col("_got").isNull(), F.lit("not fetched"))),
    )
    decision = (
        F.when(F.col("decision") == "skip_version", "skip_version")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("stored_checksum") == F.col("checksum"), "skip_checksum")
        .otherwise("ingest")
    )
    return (
        phase.join(fetched, "path", "left")
        .withColumn("error", error)
        .withColumn("decision", decision)
        .drop("_error", "_got")
    )


def prune(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Live rows of the namespace whose path the source no longer has."""
    return live(entries).join(items.select("path"), "path", "left_anti")


def sync_report(plan: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Counts of one run in a single row; a dry run is this report without a sink."""
    verdict = plan.select(F.col("decision").alias("_d"))
    if deleted is not None:
        verdict = verdict.union(deleted.select(F.lit("deleted")))
    return verdict.agg(
        F.count_if(F.col("_d") == "ingest").alias("ingested"),
        F.count_if(F.startswith("_d", F.lit("skip_"))).alias("skipped"),
        F.count_if(F.col("_d") == "deleted").alias("deleted"),
        F.count_if(F.col("_d") == "failed").alias("failed"),
    )


def sync_errors(plan: DataFrame) -> DataFrame:
    failed = plan.where(F.col("decision") == "failed")
    return failed.select("path", F.concat_ws(": ", "path", "error").alias("message"))


def last_change(changes: DataFrame, by: list[str]) -> DataFrame:
    """The last change of every key of a change set (largest ``seq``)."""
    rest = [c for c in changes.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.col("seq")).alias("_last")
    return changes.groupBy(*by).agg(newest).select(*by, "_last.*")


def apply_changes(current: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """``current`` after a change set with ``op`` 'upsert' or 'delete' and ``seq``."""
    last = last_change(changes, by)
    kept = current.join(last.select(*by), by, "left_anti")
    added = last.where(F.col("op") == "upsert").select(*current.columns)
    return kept.unionByName(added)


def missing_paths(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*by).distinct().join(right.select(*by), by, "left_anti")


# --- versions ------------------------------------------------------------------


def latest_version(history: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The current row of every key of an append-only history.

    ``max_by`` keeps one row per key on the map side, so a key with very many
    versions does not gather in one task.
    """
    rest = [c for c in history.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_now")
    return history.groupBy(*by).agg(newest).select(*by, "_now.*").select(*history.columns)


def tree_version(history: DataFrame) -> DataFrame:
    """Per namespace a token that any later write changes."""
    return history.groupBy(*NAMESPACE).agg(
        F.count("*").alias("writes"), F.max("seq").alias("last_seq")
    )


def expired_versions(
    history: DataFrame, by: list[str], order: list[str], at: str, cutoff: Column
) -> DataFrame:
    """Superseded versions whose successor is older than ``cutoff``; these may go.

    A version may go exactly when a later version of its key is also older than the
    cutoff, so the newest of the old versions is found by aggregation and everything
    old but not that is returned. No window over a key's versions is needed, and
    ``(by, order)`` names single rows, so the join cannot be skewed.
    """
    old = history.where(F.col(at) < cutoff)
    newest = old.groupBy(*by).agg(F.max(F.struct(*order)).alias("_o")).select(*by, "_o.*")
    return old.join(newest, [*by, *order], "left_anti")


def expired_scratch(objects: DataFrame, now: Column, days: int = limits.SCRATCH_TTL_DAYS) -> DataFrame:
    """Scratch objects past their time to live."""
    owner = keys.parse_key(F.col("key"))["channel"]
    cutoff = now - F.expr(f"interval {int(days)} days")
    return objects.where(F.startswith("key", F.lit("scratch/"))).where(
        (owner == "scratch") & (F.col("last_modified") < cutoff)
    )


def superseded_cutoff(key: Column, now: Column) -> Column:
    """The moment before which a successor makes a version of this key expire; the
    area of the key sets the days."""
    out = F.lit(None).cast("timestamp")
    for area, days in limits.SUPERSEDED_DAYS.items():
        out = F.when(
            F.startswith(key, F.lit(area + "/")), now - F.expr(f"interval {days} days")
        ).otherwise(out)
    return out
