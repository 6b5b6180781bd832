"""Listings and reads of files and stored objects."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits
from ..functions import paths
from ..operators.bounds import page_after, paged
from ..session import cut_lineage


_GLOB = re.compile(r"[\\*?\[\]{}]")


def _binary(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root)


def _relative(root: str) -> Column:
    """Path below ``root``; Spark reports file URIs, with or without an authority."""
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    plain = F.regexp_replace("path", r"\A[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "")
    return F.substring(plain, F.instr(plain, F.lit(base)) + len(base), F.lit(2**31 - 1))


def scan_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Source items of a folder tree: visible regular files below ``root``. Only the
    listing is read; file content stays untouched."""
    rel = _relative(root)
    kind = F.nullif(paths.guess_type(F.col("path")), F.lit(paths.DEFAULT_TYPE))
    return (
        _binary(spark, root, pattern)
        .select(rel.alias("path"), F.col("path").alias("locator"), F.col("length").alias("size"), "modificationTime")
        .where(~F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit("."))))
        .select(
            "path",
            "locator",
            "size",
            kind.alias("content_type"),
            paths.file_version(F.col("modificationTime"), F.col("size")).alias("version"),
        )
    )


def fetch_tree(spark: SparkSession, root: str, items: DataFrame) -> DataFrame:
    """(path, content) of chosen items of ``scan_tree``. Only their files are opened: the reader
    is given their names, of which the driver holds one each, as it does for any listing."""
    chosen = cut_lineage(items.select("path", "locator"))
    names = [r[0] for r in chosen.select("locator").distinct().collect()]
    if not names:
        return chosen.select("path", F.lit(None).cast("binary").alias("content"))
    # A name may hold glob characters, which the reader would expand.
    plain = [_GLOB.sub(r"\\\g<0>", unquote(n)) for n in names]
    files = spark.read.format("binaryFile").load(plain).select(F.col("path").alias("locator"), "content")
    return files.join(chosen, "locator").select("path", "content")


def scan_prefix(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Source items of an object listing below a prefix. Folder placeholders go; the
    version is the entity tag, or time and size where the store gives none."""
    rel = F.ltrim(F.substring("key", len(prefix) + 1, 2**31 - 1), F.lit("/"))
    tag = F.nullif(F.regexp_replace(F.coalesce("etag", F.lit("")), r'\A"+|"+\z', ""), F.lit(""))
    stamp = F.concat_ws(":", F.unix_seconds("last_modified").cast("string"), F.col("size").cast("string"))
    listed = objects.where(~F.endswith("key", F.lit("/")))
    if prefix:
        listed = listed.where(F.startswith("key", F.lit(prefix)))
    return (
        listed.select(
            rel.alias("path"),
            F.col("key").alias("locator"),
            "size",
            F.lit(None).cast("string").alias("content_type"),
            F.coalesce(tag, stamp).alias("version"),
        )
        .where(F.col("path") != "")
    )


def list_objects(
    objects: DataFrame, prefix: str = "", cursor: str | None = None, limit: int | None = limits.LIST_RESULTS
) -> DataFrame:
    """One page of keys below a prefix, in key order, with ``next_cursor``."""
    rows = objects.where(F.startswith("key", F.lit(prefix))) if prefix else objects
    return page_after(rows, "key", limits.size_of(limit), cursor)


def object_pages(objects: DataFrame, prefix: str = "", size: int = limits.LIST_RESULTS) -> DataFrame:
    """Every page of keys below a prefix, with the cursor that opens the next."""
    rows = objects.where(F.startswith("key", F.lit(prefix))) if prefix else objects
    return paged(rows, "key", limits.size_of(size))


def stat_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Metadata for a table of keys; an unknown key keeps null metadata."""
    return keys.select("key").distinct().join(objects, "key", "left")


def read_objects(contents: DataFrame, requests: DataFrame) -> DataFrame:
    """Bytes of requested keys (key[, start, end]); the range is inclusive and an open
    end reads to the last byte. Unknown keys have null content.

    The requests are written down first: few of them are broadcast by their true size and no
    bytes are moved but those asked for. With a key index of a stored table
    (``operators.lookup``), ``contents`` can be the rows of the files that may hold a key.
    """
    for name in ("start", "end"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("int"))
    requests = cut_lineage(requests)
    start = F.coalesce(F.col("start"), F.lit(0)).cast("int")
    length = F.coalesce(F.col("end") - start + 1, F.lit(2**31 - 1)).cast("int")
    found = requests.join(contents, "key").withColumn("content", F.substring(F.col("content"), start + 1, length))
    unknown = requests.join(contents.select("key"), "key", "left_anti")
    return found.unionByName(unknown, allowMissingColumns=True)


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """An ``objects`` listing of a store kept in files: key, size, time; no tags."""
    return _binary(spark, root, None).select(
        _relative(root).alias("key"),
        F.col("length").alias("size"),
        F.lit("").alias("etag"),
        F.lit(None).cast(T.StringType()).alias("content_type"),
        F.col("modificationTime").alias("last_modified"),
    )


def stored_contents(spark: SparkSession, root: str) -> DataFrame:
    return _binary(spark, root, None).select(_relative(root).alias("key"), "content")
