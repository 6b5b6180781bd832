"""Queries over stored tables that open only the files their indexes name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import grep, lookup, text
from ..operators.catalog import PK
from ..operators.text import DOC
from ..session import scratch_path
from ..sources import files
from . import corpus as c
from .navigation import LIVE
from .registry import Registry
from .search import hits

queries = Registry()


def stored_pages(spark, d):
    """(path, schema) of all pages, stored by document."""
    pages = c.pages(spark, d)
    path = scratch_path(spark, "pages")
    pages.repartitionByRange(*DOC).sortWithinPartitions(*DOC, "page").write.parquet(path)
    return path, pages.schema


def reviewed(spark, d):
    """Ids of the documents that a review found good."""
    return c.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()


@queries.add(
    "read_indexed",
    c.with_views(c.ENTRIES, c.LINES, c.PAGES) + f""", plan AS (
  SELECT tenant_id, namespace, path, entry_id,
         CASE WHEN deleted THEN 'not_found' WHEN status <> 'extracted' THEN 'catalog_only' END AS error,
         CASE WHEN {LIVE} THEN coalesce(page_count, 0) END AS page_count
  FROM entries WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT p.tenant_id, p.namespace, p.path, t.page, md5(t.text) AS text_md5, p.page_count, p.error
FROM plan p LEFT JOIN doc_pages t ON p.error IS NULL AND t.tenant_id = p.tenant_id AND t.namespace = p.namespace
  AND t.entry_id = p.entry_id AND t.page BETWEEN 1 AND least(4, p.page_count)""",
)
def _read_indexed(spark, d):
    path, schema = stored_pages(spark, d)
    entries = c.entries(spark, d)
    named = c._identity(c.table(spark, d, "documents")).join(reviewed(spark, d), "doc_id", "left_semi")
    index = lookup.key_index(lookup.stored(spark, path, schema), DOC)
    some = lookup.rows_of(spark, path, schema, index, named, DOC)
    asked = named.select(*PK).withColumn("start_page", F.lit(1)).withColumn("end_page", F.lit(4))
    return text.read(entries, some, asked).select(*PK, "page", F.md5("text").alias("text_md5"), "page_count", "error")


@queries.add(
    "objects_indexed",
    """SELECT CAST(d.doc_id AS VARCHAR) AS key, md5(text) AS content_md5 FROM documents d
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'lost/' || CAST(item_id AS VARCHAR), NULL FROM benchmark""",
)
def _objects_indexed(spark, d):
    path = scratch_path(spark, "objects")
    contents = c.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("content")
    )
    contents.repartitionByRange("key").write.parquet(path)
    index = lookup.key_index(lookup.stored(spark, path, contents.schema), ["key"])
    lost = c.table(spark, d, "benchmark").select(F.concat(F.lit("lost/"), F.col("item_id").cast("string")).alias("key"))
    asked = reviewed(spark, d).select(F.col("doc_id").cast("string").alias("key")).unionByName(lost)
    some = lookup.rows_of(spark, path, contents.schema, index, asked, ["key"])
    return files.read_objects(some, asked).select("key", F.md5("content").alias("content_md5"))


INDEXED = "[a-z]+[.][0-9]+@mail[0-9]|api_key|password"


@queries.add(
    "grep_indexed",
    hits(INDEXED) + """
SELECT tenant_id, namespace, path, page, line, line_text AS text FROM hits""",
)
def _grep_indexed(spark, d):
    path, schema = stored_pages(spark, d)
    index = lookup.text_index(lookup.stored(spark, path, schema))
    some = lookup.rows_matching(spark, path, schema, index, INDEXED)
    found = grep.grep(c.entries(spark, d), some, INDEXED, line_chars=None)
    return found.select(*PK, "page", "line", "text")
