"""Writes against the catalog, the page store and the dimension tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.catalog import PK, admit, live
from ..operators.text import DOC
from ..schemas import ENTRIES, PAGES
from .history import append_batch

PARTITIONS = ("tenant_id", "namespace")


def write_pages(pages: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Store page text; pages without a number from 0 up are returned, not written. (The
    bound on page numbers is one of key strings; the table holds all pages.) Rows are rebalanced by namespace, so that a small one becomes one file
    and a hot one is split over many tasks, and ordered by document within a file."""
    good, bad = admit(pages, {"bad_page": F.col("page") >= 0})
    shaped = good.select(*(F.col(f.name).cast(f.dataType) for f in PAGES.fields))
    laid_out = shaped.hint("rebalance", *PARTITIONS).sortWithinPartitions(*DOC, "page")
    append_batch(laid_out, path, batch_id, PARTITIONS)
    return bad


def upsert_entries(entries: DataFrame, path: str, batch_id: int) -> None:
    """Put entries by primary key. A put over a tombstone revives the row, because the
    newest row of a key is the current one."""
    shaped = entries.select(*(f.name for f in ENTRIES.fields))
    laid_out = shaped.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PK)
    append_batch(laid_out, path, batch_id, PARTITIONS)


def tombstones(current: DataFrame, requests: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows that soft-delete the requested keys; a missing or dead key gives none."""
    at = now if isinstance(now, Column) else F.lit(now)
    return (
        live(current)
        .join(requests.select(*PK).distinct(), PK, "left_semi")
        .withColumn("deleted_at", at.cast("timestamp"))
        .withColumn("updated_at", at.cast("timestamp"))
    )


def hard_delete(current: DataFrame, requests: DataFrame) -> DataFrame:
    """The table without the requested keys."""
    return current.join(requests.select(*PK), PK, "left_anti")


def delete_prefix(objects: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(objects that stay, one row with the ``deleted`` count)."""
    inside = F.startswith("key", F.lit(prefix))
    return objects.where(~inside), objects.agg(F.count_if(inside).alias("deleted"))


def delete_documents(
    entries: DataFrame, pages: DataFrame, objects: DataFrame, requests: DataFrame, now: datetime | Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove documents: (tombstones to append, pages that stay, objects that stay)."""
    dead = tombstones(entries, requests, now)
    gone = requests.select(keys.originals_key(*(F.col(c) for c in PK)).alias("key"))
    return (
        dead,
        pages.join(dead.select(*DOC), DOC, "left_anti"),
        objects.join(gone, "key", "left_anti"),
    )


def set_extraction(
    entries: DataFrame, states: DataFrame, now: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """(updated rows, requests whose row is missing). ``states`` is the primary key and
    a new ``extraction`` struct."""
    at = now if isinstance(now, Column) else F.lit(now)
    known = live(entries)
    fresh = states.select(*PK, F.col("extraction").alias("_new"))
    updated = (
        known.join(fresh, PK)
        .withColumn("extraction", F.col("_new"))
        .withColumn("updated_at", at.cast("timestamp"))
        .select(*known.columns)
    )
    return updated, states.join(known.select(*PK), PK, "left_anti")


def put_checkpoint(
    cursors: DataFrame, path: str, batch_id: int
) -> None:
    """Store cursors: (tenant_id, connector_id, cursor, updated_at)."""
    append_batch(cursors, path, batch_id)


def get_checkpoint(history: DataFrame) -> DataFrame:
    """The latest cursor per tenant and connector."""
    return history.groupBy("tenant_id", "connector_id").agg(
        F.max_by("cursor", F.struct("updated_at", "cursor")).alias("cursor"),
        F.max("updated_at").alias("updated_at"),
    )


def upsert_dimension(current: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """A dimension (tenants, namespaces, principals) after puts and deletes: ``changes``
    has the dimension's columns, ``op`` ('upsert' or 'delete') and ``seq``."""
    from ..operators.upkeep import apply_changes

    return apply_changes(current, changes, by)
