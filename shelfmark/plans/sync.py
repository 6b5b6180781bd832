"""One sync run of a source into a namespace, as decisions first and writes after."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.catalog import PK, in_namespace, live
from ..operators.upkeep import last_change, prune, sync_errors, sync_plan, sync_report, sync_versions
from ..session import cut_lineage
from ..sinks.tables import tombstones
from ..sources.normalizers import Gate, Normalizer
from .ingest import ingest_documents


class SyncRun(NamedTuple):
    plan: DataFrame
    report: DataFrame
    errors: DataFrame
    entries: DataFrame  # rows to append: ingested, re-versioned and deleted
    pages: DataFrame


def sync(
    items: DataFrame,
    fetch,
    entries: DataFrame,
    tenant_id: str,
    namespace: str,
    connector_id: str,
    now: datetime,
    prune_missing: bool = False,
    deleted: DataFrame | None = None,
    rungs: list[Normalizer] | None = None,
    gate: Gate | None = None,
) -> SyncRun:
    """``fetch(items)`` gives (path, content[, error]) for the items it is handed; only
    items that the version test does not settle are handed over. Nothing is written:
    a dry run looks at ``report`` and stops there."""
    mine = in_namespace(entries, tenant_id, namespace)
    asked = sync_versions(items, mine).where(F.col("decision") == "fetch").select(items.columns)
    got = fetch(asked)
    if "error" not in got.columns:
        got = got.withColumn("error", F.lit(None).cast("string"))
    got = cut_lineage(got)
    hashes = got.select("path", paths.checksum(F.col("content")).alias("checksum"), "error")
    plan = sync_plan(items, mine, hashes)

    gone = prune(items, mine).select(*PK) if prune_missing else None
    if deleted is not None:
        named = deleted.select(
            F.lit(tenant_id).alias("tenant_id"), F.lit(namespace).alias("namespace"), "path"
        )
        gone = named if gone is None else gone.union(named).distinct()

    source = F.struct(
        F.lit(connector_id).alias("connector_id"),
        F.col("locator").alias("remote_id"),
        F.col("version").alias("version"),
    )
    ingest = plan.where(F.col("decision") == "ingest")
    documents = ingest.join(got.select("path", "content"), "path").select(
        F.lit(tenant_id).alias("tenant_id"),
        F.lit(namespace).alias("namespace"),
        "path",
        "content",
        "content_type",
        source.alias("source"),
    )
    made = ingest_documents(documents, mine, now, rungs, gate)
    # Same content under a new version: remember the version, so the next run need
    # not fetch the item again.
    seen = plan.where(F.col("decision") == "skip_checksum").select("path", source.alias("_source"))
    revised = (
        live(mine)
        .join(seen, "path")
        .withColumn("source", F.col("_source"))
        .select(*mine.columns)
    )
    rows = made.entries.unionByName(revised)
    if gone is not None:
        rows = rows.unionByName(tombstones(mine, gone, now))
    return SyncRun(plan, sync_report(plan, gone), sync_errors(plan), rows, made.pages)


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items to process, paths to delete) of a change feed: last change per path."""
    last = last_change(changes, ["path"])
    upserts = last.where(F.col("op") == "upsert")
    return (
        upserts.select("path", "locator", "size", "content_type", "version"),
        last.where(F.col("op") == "delete").select("path"),
    )
