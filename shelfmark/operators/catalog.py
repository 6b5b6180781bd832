"""Catalog filters, lookups and listings over the ``entries`` table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions import dialect, keys, paths
from ..schemas import EXTRACTION_STATUSES
from .bounds import after, all_of, bounded, page_after, paged

PK = ["tenant_id", "namespace", "path"]
NAMESPACE = ["tenant_id", "namespace"]


def live(entries: DataFrame, include_deleted: bool = False) -> DataFrame:
    return entries if include_deleted else entries.where(F.col("deleted_at").isNull())


def extracted_only(entries: DataFrame) -> DataFrame:
    """Live rows whose text can be read."""
    return live(entries).where(F.col("extraction.status") == "extracted")


def in_namespace(entries: DataFrame, tenant_id: str, namespace: str | None = None) -> DataFrame:
    rows = entries.where(F.col("tenant_id") == tenant_id)
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


def content_type_is(actual: Column, wanted: str) -> Column:
    """Exact media type, or a prefix of it such as ``image/``."""
    return F.startswith(actual, F.lit(wanted))


def list_entries(
    entries: DataFrame,
    tenant_id: str,
    namespace: str,
    prefix: str = "",
    cursor: str | None = None,
    limit: int | None = 100,
    include_deleted: bool = False,
) -> DataFrame:
    """One listing page of a namespace in path order, with ``next_cursor``."""
    rows = in_namespace(live(entries, include_deleted), tenant_id, namespace)
    if prefix:
        rows = rows.where(F.startswith("path", F.lit(prefix)))
    return page_after(rows, "path", limits.size_of(limit), cursor)


def list_first_pages(entries: DataFrame, prefix: str = "", limit: int | None = 100) -> DataFrame:
    """The first listing page of every namespace of every tenant."""
    rows = live(entries)
    if prefix:
        rows = rows.where(F.startswith("path", F.lit(prefix)))
    return bounded(rows, ["path"], limits.size_of(limit), by=NAMESPACE)


def in_pages(answer: DataFrame, size: int = 100) -> DataFrame:
    """A whole answer over (tenant_id, namespace, path), such as ``glob`` or ``find`` without a
    limit, cut into pages per namespace: each row has its ``ordinal``, its ``page_no`` and the
    cursor that opens the next page. That cursor resumes ``glob``, ``find`` or ``list_entries``."""
    return paged(answer, "path", limits.size_of(size), NAMESPACE)


def list_pages(entries: DataFrame, prefix: str = "", size: int = 100) -> DataFrame:
    """Every listing page of every namespace."""
    rows = live(entries)
    return in_pages(rows.where(F.startswith("path", F.lit(prefix))) if prefix else rows, size)


def stat(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Point lookups for a table of (tenant_id, namespace, path); a miss is a row
    with ``error`` set, so no request goes unanswered."""
    known = live(entries).withColumn("_found", F.lit(True))
    error = (
        F.when(~keys.valid_path(F.col("path")), "invalid_path")
        .when(F.col("_found").isNull(), "not_found")
    )
    return requests.join(known, PK, "left").withColumn("error", error).drop("_found")


def _limited(rows: DataFrame, limit: int | None, cursor: str | None, per_namespace: bool) -> DataFrame:
    rest = after(rows, "path", cursor)
    return bounded(rest, ["path"], limits.size_of(limit), NAMESPACE if per_namespace else None)


def glob(
    entries: DataFrame,
    pattern: str,
    limit: int | None = 100,
    per_namespace: bool = False,
    cursor: str | None = None,
) -> DataFrame:
    """Live paths that match a glob: the first ``limit`` in path order after ``cursor``, or all
    for ``None``. Give one namespace's rows, or a whole corpus with ``per_namespace``."""
    rows = live(entries).where(dialect.matches_glob(F.col("path"), pattern)).select(*PK)
    return _limited(rows, limit, cursor, per_namespace)


def find(
    entries: DataFrame,
    pattern: str = "*",
    content_type: str | None = None,
    status: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    modified_after: datetime | None = None,
    limit: int | None = 100,
    per_namespace: bool = False,
    cursor: str | None = None,
) -> DataFrame:
    """Glob and metadata filters; size bounds are inclusive. ``limit`` and ``cursor`` as for ``glob``."""
    tests = [dialect.matches_glob(F.col("path"), pattern)]
    if content_type:
        tests.append(content_type_is(F.col("content_type"), content_type))
    if status:
        tests.append(F.col("extraction.status") == status)
    if min_size is not None:
        tests.append(F.col("size") >= min_size)
    if max_size is not None:
        tests.append(F.col("size") <= max_size)
    if modified_after is not None:
        tests.append(F.col("updated_at") >= F.lit(modified_after))
    rows = live(entries).where(all_of(tests)).select(
        *PK,
        "size",
        "content_type",
        F.col("extraction.status").alias("status"),
        paths.iso8601(F.col("updated_at")).alias("updated_at"),
    )
    return _limited(rows, limit, cursor, per_namespace)


def by_status(
    entries: DataFrame, status: str, limit: int | None = 100, cursor: str | None = None
) -> DataFrame:
    """One page of a tenant-spanning backlog: live rows of one extraction status, in
    primary-key order."""
    if status not in EXTRACTION_STATUSES:
        raise ValueError(f"unknown extraction status: {status}")
    rows = live(entries).where(F.col("extraction.status") == status)
    keyed = rows.withColumn("pk", F.concat_ws("\u0000", *PK))
    return page_after(keyed, "pk", limits.size_of(limit), cursor).drop("pk")


def find_by_checksum(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live rows whose content hash a tenant asks for, across its namespaces;
    ``wanted`` is (tenant_id, checksum)."""
    asked = wanted.select("tenant_id", "checksum").distinct()
    return live(entries).join(asked, ["tenant_id", "checksum"], "left_semi")


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Content hashes that a tenant holds more than once: copies, distinct
    namespaces, first path and bytes that one copy would save.

    Only counters and one smallest key cross the shuffle, so a content that makes
    up a third of a corpus costs one combined row per map task. Copies are first
    counted per namespace, which leaves the number of namespaces a plain count.
    """
    per_namespace = (
        live(entries)
        .groupBy("tenant_id", "checksum", "namespace")
        .agg(
            F.count("*").alias("copies"),
            F.min("path").alias("path"),
            F.max("size").alias("size"),
        )
    )
    return (
        per_namespace.groupBy("tenant_id", "checksum")
        .agg(
            F.sum("copies").alias("copies"),
            F.count("*").alias("namespaces"),
            F.min(F.concat_ws("/", "namespace", "path")).alias("first_copy"),
            F.max("size").alias("size"),
        )
        .where(F.col("copies") > 1)
        .withColumn("saved_bytes", (F.col("copies") - 1) * F.col("size"))
        .drop("size")
    )


def admit(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows by named admission tests into (good, quarantined with ``problem``)."""
    problem = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()))
    judged = rows.withColumn("problem", problem)
    good = judged.where(F.col("problem").isNull()).drop("problem")
    return good, judged.where(F.col("problem").isNotNull())


def admit_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return admit(
        rows,
        {
            "bad_tenant": keys.valid_slug(F.col("tenant_id")),
            "bad_namespace": keys.valid_slug(F.col("namespace")),
            "bad_path": keys.valid_path(F.col("path")),
        },
    )


def namespaces_seen(*tables: DataFrame) -> DataFrame:
    """Distinct (tenant, namespace) pairs of several tables: listing, catalog, registry."""
    pairs = [t.select(*NAMESPACE).distinct() for t in tables]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.union(more)
    return out.distinct()
