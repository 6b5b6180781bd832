"""Arbitrary records, folder tables and change feeds as source items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut_lineage

# The folder type, and what native types are exported as.
FOLDER_TYPE = "application/vnd.google-apps.folder"
_OFFICE = "application/vnd.openxmlformats-officedocument"
EXPORTS = {
    "application/vnd.google-apps.document": (f"{_OFFICE}.wordprocessingml.document", ".docx"),
    "application/vnd.google-apps.spreadsheet": (f"{_OFFICE}.spreadsheetml.sheet", ".xlsx"),
    "application/vnd.google-apps.presentation": (f"{_OFFICE}.presentationml.presentation", ".pptx"),
    "application/vnd.google-apps.drawing": ("image/png", ".png"),
}


def _suffixed(path, index):
    """``path`` with ``-index`` before its last extension."""
    dotted = F.regexp_extract(path, r"(?s)\A(.*)\.([^.]*)\z", 2)
    stem = F.regexp_extract(path, r"(?s)\A(.*)\.([^.]*)\z", 1)
    number = index.cast("string")
    return F.when(
        F.contains(path, F.lit(".")), F.concat(stem, F.lit("-"), number, F.lit("."), dotted)
    ).otherwise(F.concat(path, F.lit("-"), number))


def uniquify_paths(records: DataFrame, path: str = "path", index: str = "idx") -> DataFrame:
    """Second and later records of a path get their index in the name.

    The first index per path comes from an aggregation, and is matched on (path,
    index), which names one record: a path that a third of all records share is
    never gathered. A generated name may itself meet a later record's own path;
    such records are suffixed too, round by round, until no round finds one.
    """
    first = records.groupBy(path).agg(F.min(index).alias(index), F.lit(True).alias("_first"))
    marked = records.join(first, [path, index], "left").withColumn(
        "_again", F.col("_first").isNull()
    ).drop("_first")
    named = cut_lineage(
        marked.select(path, index, "_again").withColumn("_name", _suffixed(F.col(path), F.col(index)))
    )
    again = named.where("_again").select(F.col("_name").alias(path), F.col(index).alias("_by"))
    fresh = again
    found = []
    while True:
        clash = (
            named.where(~F.col("_again"))
            .join(fresh.groupBy(path).agg(F.min("_by").alias("_by")), path)
            .where(F.col("_by") < F.col(index))
            .select(path, index)
        )
        for seen in found:
            clash = clash.join(seen, [path, index], "left_anti")
        clash = cut_lineage(clash)
        if clash.isEmpty():
            break
        found.append(clash)
        fresh = clash.select(
            _suffixed(F.col(path), F.col(index)).alias(path), F.col(index).alias("_by")
        )
    out = marked
    for clash in found:
        out = (
            out.join(clash.withColumn("_clash", F.lit(True)), [path, index], "left")
            .withColumn("_again", F.col("_again") | F.coalesce("_clash", F.lit(False)))
            .drop("_clash")
        )
    return out.withColumn(
        path, F.when(F.col("_again"), _suffixed(F.col(path), F.col(index))).otherwise(F.col(path))
    ).drop("_again")


def scan_records(records: DataFrame) -> DataFrame:
    """Records (idx, text, metadata map) as source items with clean, unique paths."""
    named = paths.url_path(paths.first_field(F.col("metadata"), paths.PATH_FIELDS))
    fallback = F.concat(F.lit("doc-"), F.col("idx").cast("string"), F.lit(".md"))
    items = records.select(
        "idx",
        F.coalesce(F.nullif(named, F.lit("")), fallback).alias("path"),
        F.col("idx").cast("string").alias("locator"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit("text/markdown").alias("content_type"),
        paths.record_version(F.col("metadata"), F.col("text")).alias("version"),
    )
    return uniquify_paths(items).drop("idx")


def folder_paths(listing: DataFrame, root: str) -> DataFrame:
    """(folder id, path prefix) of every folder below ``root``, one row per way to reach it.
    The root's prefix is ''.

    Every folder holds a stretch of the way up from it: its names, its ids, and the folder
    that comes next. A round joins each stretch to the one that goes on from its upper end, so
    stretches double, and a tree of depth n takes log2(n) rounds. A way that would pass a
    folder twice is dropped: folders on a loop, and below one only, are not reached. So are
    those whose upper end is not listed. A folder with several parents has a row for each way.
    """
    way = listing.where((F.col("mime_type") == FOLDER_TYPE) & (F.col("id") != root)).select(
        "id",
        F.col("parent_id").alias("_up"),
        F.concat("name", F.lit("/")).alias("prefix"),
        F.array("id").alias("_trail"),
    )
    way = cut_lineage(way.where(F.col("_up").isNotNull()))
    arrived = F.col("_up") == root
    while not way.where(~arrived).isEmpty():
        onward = way.select(
            F.col("id").alias("_up"),
            F.col("_up").alias("_next"),
            F.col("prefix").alias("_above"),
            F.col("_trail").alias("_higher"),
        )
        longer = (
            way.where(~arrived)
            .join(onward, "_up")
            .where(~F.arrays_overlap("_trail", "_higher"))
            .select(
                "id",
                F.col("_next").alias("_up"),
                F.concat("_above", "prefix").alias("prefix"),
                F.concat("_higher", "_trail").alias("_trail"),
            )
        )
        way = cut_lineage(way.where(arrived).unionByName(longer))
    spark = listing.sparkSession
    own = spark.range(1).select(F.lit(root).alias("id"), F.lit("").alias("prefix"))
    return way.select("id", "prefix").union(own)


def scan_folder_table(listing: DataFrame, root: str = "root", export_pdf: bool = False) -> DataFrame:
    """A listing (id, name, parent_id, mime_type, size, version, modified_time) as
    source items with full paths; native types take their export type and extension."""
    mime = F.col("mime_type")
    export, suffix = F.lit(None).cast("string"), F.lit("")
    for native, (target, ext) in EXPORTS.items():
        if export_pdf:
            target, ext = "application/pdf", ".pdf"
        export = F.when(mime == native, F.lit(target)).otherwise(export)
        suffix = F.when(mime == native, F.lit(ext)).otherwise(suffix)
    name = F.when(
        (suffix != "") & ~F.endswith(F.col("name"), suffix), F.concat(F.col("name"), suffix)
    ).otherwise(F.col("name"))
    places = folder_paths(listing, root).select(F.col("id").alias("parent_id"), "prefix")
    stamp = F.coalesce(
        F.nullif(F.col("version"), F.lit("")), F.nullif(F.col("modified_time"), F.lit(""))
    )
    return (
        listing.where(mime != FOLDER_TYPE)
        .join(places, "parent_id")
        .select(
            F.concat("prefix", name).alias("path"),
            F.concat(F.col("id"), F.lit("\t"), F.coalesce(export, F.lit(""))).alias("locator"),
            F.col("size").cast("long").alias("size"),
            F.coalesce(export, mime).alias("content_type"),
            stamp.alias("version"),
        )
    )


def scan_changes(changes: DataFrame, cursor: int | None = None) -> DataFrame:
    """Changes after a cursor; without one, everything."""
    return changes if cursor is None else changes.where(F.col("seq") > cursor)


def next_cursor(changes: DataFrame, cursor: int | None = None) -> DataFrame:
    """How many ``changes`` there are, and the cursor to store after them: their
    largest ``seq``, else the old one."""
    return changes.agg(
        F.count("*").alias("changes"), F.coalesce(F.max("seq"), F.lit(cursor)).alias("cursor")
    )
