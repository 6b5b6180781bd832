"""Ingest and extraction jobs: documents in, catalog rows and page text out."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.catalog import PK, admit_documents, live
from ..operators.extraction import extraction_state
from ..operators.text import DOC, text_checksum_of
from ..operators.upkeep import originals
from ..schemas import ENTRIES, EXTRACTION, PAGES, SOURCE_REF
from ..session import cut_lineage
from ..sinks.history import BATCH, append_batch, current_entries, read_history
from ..sinks.tables import upsert_entries, write_pages
from ..sources.normalizers import NATIVE, Gate, Normalizer, extract


class Ingested(NamedTuple):
    entries: DataFrame
    pages: DataFrame
    quarantined: DataFrame


def _moment(now: datetime | Column) -> Column:
    return (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")


def describe(documents: DataFrame) -> DataFrame:
    """Scalar facts of incoming documents; optional columns are filled in."""
    have = set(documents.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return documents.select(
        *PK,
        "content",
        paths.guess_type(F.col("path"), given("content_type", "string")).alias("content_type"),
        paths.title(F.col("path"), given("title", "string")).alias("title"),
        F.octet_length("content").cast("long").alias("size"),
        (F.coalesce(F.col("etag"), paths.etag(F.col("content"))) if "etag" in have
         else paths.etag(F.col("content"))).alias("etag"),
        paths.checksum(F.col("content")).alias("checksum"),
        (F.col("source") if "source" in have else F.lit(None).cast(SOURCE_REF)).alias("source"),
    )


def reuse_ids(documents: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Keep the id and creation time of a live row; a new path gets a stable id."""
    old = live(entries).select(*PK, F.col("entry_id").alias("_id"), F.col("created_at").alias("_at"))
    return (
        documents.join(old, PK, "left")
        .withColumn("entry_id", F.coalesce("_id", paths.entry_id(*(F.col(c) for c in PK))))
        .withColumn("created_at", F.coalesce(F.col("_at"), now))
        .drop("_id", "_at")
    )


def ingest_documents(
    documents: DataFrame,
    entries: DataFrame,
    now: datetime | Column,
    rungs: list[Normalizer] | None = None,
    gate: Gate | None = None,
    deferred: bool = False,
) -> Ingested:
    """Incoming (tenant_id, namespace, path, content[, content_type, title, source]).

    With ``deferred`` rows are only registered as pending. The text is read once and
    written to the shared folder, because two tables are derived from it.
    """
    at = _moment(now)
    good, bad = admit_documents(documents)
    facts = describe(good)
    if deferred:
        state = F.struct(
            F.lit("pending").alias("status"),
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in EXTRACTION.fields[1:]),
        )
        rows = reuse_ids(facts.drop("content"), entries, at).withColumn("extraction", state)
        no_pages = documents.sparkSession.createDataFrame([], PAGES)
        return Ingested(_as_entries(rows, at), no_pages, bad)
    found = extract(facts, rungs or [NATIVE], gate)
    found = found.withColumn("text_checksum", text_checksum_of(F.col("pages"))).withColumn(
        "page_count", F.size("pages")
    )
    staged = cut_lineage(found)
    rows = reuse_ids(staged.drop("pages"), entries, at).withColumn(
        "extraction", extraction_state("extractor", "page_count", "text_checksum")
    )
    # Page text takes its id from the key itself. Only rows that came with another id
    # are looked up; written down, their true size decides how they are joined.
    derived = paths.entry_id(*(F.col(c) for c in PK))
    foreign = cut_lineage(
        live(entries).where(F.col("entry_id") != derived).select(*PK, F.col("entry_id").alias("_id"))
    )
    pages = (
        staged.where(F.col("extractor").isNotNull())
        .select(*PK, F.explode("pages").alias("_p"))
        .join(foreign, PK, "left")
        .withColumn("entry_id", F.coalesce(F.col("_id"), derived))
        .select(*DOC, "_p.page", "_p.text", "_p.source_locator")
    )
    return Ingested(_as_entries(rows, at), pages, bad)


def _as_entries(rows: DataFrame, at: Column) -> DataFrame:
    return (
        rows.withColumn("metadata", F.create_map().cast(ENTRIES["metadata"].dataType))
        .withColumn("updated_at", at)
        .withColumn("deleted_at", F.lit(None).cast("timestamp"))
        .select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRIES.fields))
    )


def extraction_backlog(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Originals that still need text: without a live row, pending, catalog-only, or
    stored anew since their row was written. Extracted and unchanged ones are left."""
    wanted = originals(objects).select(
        *PK, "key", F.col("etag").alias("object_etag"), "content_type"
    )
    known = live(entries).select(
        *PK, F.col("etag").alias("_etag"), F.col("extraction.status").alias("_status")
    )
    stored, seen = paths.norm_etag(F.col("object_etag")), paths.norm_etag(F.col("_etag"))
    drifted = (stored != "") & (seen != "") & (stored != seen)
    open_ = F.col("_status").isNull() | (F.col("_status") != "extracted") | drifted
    return wanted.join(known, PK, "left").where(open_).drop("_etag", "_status")


def extract_backlog(
    object_keys: DataFrame,
    objects: DataFrame,
    contents: DataFrame,
    entries: DataFrame,
    now: datetime | Column,
    rungs: list[Normalizer] | None = None,
    gate: Gate | None = None,
) -> Ingested:
    """Extract the originals named by ``object_keys`` that are not done yet. Content is
    joined only for those; rows already there keep their id, title and source."""
    asked = objects.join(object_keys.select("key").distinct(), "key", "left_semi")
    todo = extraction_backlog(asked, entries)
    kept = live(entries).select(*PK, "title", "source")
    documents = (
        todo.join(contents, "key")
        .join(kept, PK, "left")
        .withColumn("etag", F.nullif(paths.norm_etag(F.col("object_etag")), F.lit("")))
        .drop("object_etag")
    )
    return ingest_documents(documents, entries, now, rungs, gate)


class Store(NamedTuple):
    """Where a corpus lives: the roots of its history tables."""

    entries: str
    pages: str

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Current rows; with ``before``, as they stood before that batch was written."""
        rows = read_history(spark, self.entries, ENTRIES)
        return current_entries(rows if before is None else rows.where(F.col(BATCH) < before))


def save(result: Ingested, store: Store, batch_id: int, quarantine: str | None = None) -> None:
    """Write one ingest batch; pages first, so a row never names text that is absent. A
    batch that is made again must start from ``store.current(spark, before=batch_id)``:
    then it has the same rows and replaces its first attempt exactly."""
    rows = cut_lineage(result.entries)
    write_pages(result.pages, store.pages, batch_id)
    upsert_entries(rows, store.entries, batch_id)
    if quarantine:
        append_batch(result.quarantined.drop("content"), quarantine, batch_id)


