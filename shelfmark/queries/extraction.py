"""Routing, rung selection, quality, OCR assembly and ingest queries."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators import extraction as ex
from ..operators import ocr
from ..plans import ingest
from ..schemas import OCR_BLOCKS
from ..session import cut_lineage
from . import corpus as c
from .registry import Registry

queries = Registry()

ROUTES = {
    "application/pdf": ["pdf", "textract"],
    "text/*": ["text_native"],
    "image/*": ["textract", "llm"],
}


@queries.add(
    "route",
    c.with_views(c.ENTRIES) + """
SELECT path, content_type, CASE content_type WHEN 'application/pdf' THEN 'application/pdf' WHEN 'image/png' THEN 'image/*' ELSE 'text/*' END AS route,
       CASE content_type WHEN 'application/pdf' THEN 'pdf,textract' WHEN 'image/png' THEN 'textract,llm' ELSE 'text_native' END AS rungs FROM entries""",
)
def _route(spark, d):
    kind = F.col("content_type")
    return c.entries(spark, d).select(
        "path",
        "content_type",
        ex.route(kind, ROUTES).alias("route"),
        F.array_join(ex.route_ladder(kind, ROUTES), ",").alias("rungs"),
    )


@queries.add(
    "rungs_to_try",
    c.with_views(c.ENTRIES) + """
SELECT path, rung, rung_no FROM (
  SELECT path, content_type, unnest(['text_native', 'pdf', 'docx', 'textract']) AS rung, unnest([1, 2, 3, 4]) AS rung_no FROM entries)
WHERE (rung = 'text_native' AND content_type LIKE 'text/%') OR (rung = 'pdf' AND content_type = 'application/pdf')
   OR (rung = 'textract' AND content_type IN ('application/pdf', 'image/png'))""",
)
def _rungs(spark, d):
    docs = c.entries(spark, d).select("path", "content_type")
    return ex.rungs_to_try(docs, {"*": ex.ladder(preset="ocr")}).select("path", "rung", "rung_no")


ATTEMPTS = """
attempts AS (
  SELECT doc_id, 1 AS rung_no, 'text_native' AS rung, CASE WHEN contains(text, '@') THEN 'parse_failed' END AS error,
         length(string_split(text, chr(10))) AS page_count, n_chars AS min_chars, NULL::DOUBLE AS confidence FROM documents
  UNION ALL
  SELECT d.doc_id, 2, 'textract', NULL, 1, d.n_chars // 2, CASE WHEN l.quality = 1 THEN 0.9 ELSE 0.4 END
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL
  SELECT doc_id, 3, 'llm', NULL, CASE WHEN toxic = 1 THEN 0 ELSE 2 END, 500, 0.8 FROM labels)"""


def attempts(spark, d):
    """Tries per document: the text rung fails on addresses, OCR is as sure as the
    review, the last rung exists for reviewed documents only."""
    docs, labels = c.table(spark, d, "documents"), c.table(spark, d, "labels")
    shape = ["doc_id", "rung_no", "rung", "error", "page_count", "min_chars_per_page", "confidence"]
    none = F.lit(None).cast("string").alias("error")
    native = docs.select(
        "doc_id", F.lit(1).alias("rung_no"), F.lit("text_native").alias("rung"),
        F.when(F.contains("text", F.lit("@")), "parse_failed").alias("error"),
        F.size(tx.split_lines(F.col("text"))).cast("long").alias("page_count"),
        F.col("n_chars").alias("min_chars_per_page"), F.lit(None).cast("double").alias("confidence"),
    )
    scans = docs.select("doc_id", "n_chars").join(labels, "doc_id", "left").select(
        "doc_id", F.lit(2).alias("rung_no"), F.lit("textract").alias("rung"), none,
        F.lit(1).cast("long").alias("page_count"), F.floor(F.col("n_chars") / 2).alias("min_chars_per_page"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("confidence"),
    )
    models = labels.select(
        "doc_id", F.lit(3).alias("rung_no"), F.lit("llm").alias("rung"), none,
        F.when(F.col("toxic") == 1, 0).otherwise(2).cast("long").alias("page_count"),
        F.lit(500).cast("long").alias("min_chars_per_page"), F.lit(0.8).alias("confidence"),
    )
    return native.select(shape).union(scans.select(shape)).union(models.select(shape))


@queries.add(
    "select_rung",
    "WITH " + ATTEMPTS + """, good AS (
  SELECT doc_id, min(rung_no) AS rung_no FROM attempts
  WHERE error IS NULL AND page_count > 0 AND min_chars >= 100 AND (confidence IS NULL OR confidence >= 0.6) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.rung_no IS NULL THEN 'catalog_only' ELSE 'extracted' END AS status,
       CASE WHEN g.rung_no IS NULL THEN 'no_extractor' END AS reason, a.rung AS extractor, a.page_count
FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id LEFT JOIN attempts a ON a.doc_id = g.doc_id AND a.rung_no = g.rung_no""",
)
def _select(spark, d):
    won = ex.select_rung(attempts(spark, d), ["doc_id"], min_chars=100, min_confidence=0.6)
    docs = c.table(spark, d, "documents").select("doc_id").join(won, "doc_id", "left")
    state = ex.extraction_state("extractor", "page_count", "extractor")
    return docs.withColumn("_s", state).select(
        "doc_id", "_s.status", "_s.reason", "_s.extractor", "_s.page_count"
    )


@queries.add(
    "extraction_reasons",
    c.with_views(c.ENTRIES) + """
SELECT status, CASE WHEN status = 'catalog_only' THEN 'no_extractor' ELSE '' END AS reason, count(*) AS documents
FROM entries WHERE NOT deleted GROUP BY ALL""",
)
def _reasons(spark, d):
    return ex.reasons(c.entries(spark, d))


@queries.add(
    "quality_report",
    c.with_views(c.ENTRIES, c.LINES, c.PAGES) + """
SELECT entry_id, count(*) AS page_count, sum(length(text))::BIGINT AS char_count, min(length(text)) AS min_chars_per_page,
       false AS ocr_used FROM doc_pages GROUP BY ALL""",
)
def _quality(spark, d):
    return ex.quality_report(c.pages(spark, d), ["entry_id"]).drop("confidence")


@queries.add(
    "quality_gate",
    c.with_views(c.ENTRIES, c.LINES, c.PAGES) + """
SELECT entry_id, min(length(text)) >= 200 AS passes FROM doc_pages GROUP BY ALL""",
)
def _gate(spark, d):
    measured = ex.quality_report(c.pages(spark, d), ["entry_id"])
    return measured.select(
        "entry_id",
        ex.passes_gate(F.col("min_chars_per_page"), F.col("confidence"), 200, 0.5).alias("passes"),
    )


@queries.add(
    "text_checksum",
    c.with_views(c.ENTRIES) + """
SELECT entry_id, CAST((n_lines + 9) // 10 AS BIGINT) AS page_count, sha256(text) AS text_checksum FROM entries""",
)
def _text_checksum(spark, d):
    return ex.text_checksums(c.pages(spark, d), ["entry_id"])


@queries.add(
    "renumber_pages",
    """WITH parts AS (
  SELECT page_id, unnest(string_split(html, '<p>')) AS text, generate_subscripts(string_split(html, '<p>'), 1) AS page FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY page) AS new_page, 'page=' || page AS source_locator, md5(text) AS text_md5
FROM parts WHERE regexp_matches(text, '[^[:space:]]')""",
)
def _renumber(spark, d):
    html = c.table(spark, d, "pages")
    parts = tx.explode_once(html, ["page_id"], F.split("html", "<p>"), "text", position="_p")
    pages = parts.select("page_id", (F.col("_p") + 1).alias("page"), "text")
    return ex.renumber_pages(pages, ["page_id"]).select("page_id", "new_page", "source_locator", F.md5("text").alias("text_md5"))


# --- OCR blocks built from conversation turns -----------------------------------


def turn_blocks(spark, d):
    """A turn as a page of blocks: its first line is laid out as a two-column table, its
    role and number are a form field, assistants add a figure. The blocks are written
    once, since OCR output is a table that its readers scan more than once."""
    turns = c.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page"), "role", "text"
    )
    lines = tx.explode_once(turns, ["doc", "page"], tx.split_lines(F.col("text")), "line", position="n")
    spoken = lines.withColumn("words", F.filter(F.split("line", " "), lambda w: w != ""))
    words = tx.explode_once(spoken, ["doc", "page", "n"], F.col("words"), "word", position="i")
    first = words.where("n = 0")
    text = lambda *parts: F.concat(*(F.col(p).cast("string") if p in ("n", "i") else F.lit(p) for p in parts))

    def block(rows, kind, ident, seq, **more):
        given = {"id": ident, "block_type": F.lit(kind), "seq": seq, **more}
        return rows.select(
            "doc", "page",
            *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OCR_BLOCKS.fields[2:]),
        )

    ids = lambda prefix: F.transform("words", lambda w, i: F.concat(F.lit(prefix), F.col("n").cast("string"), F.lit("."), i.cast("string")))
    every = [
        block(spoken, "LINE", text("l", "n"), (F.col("n") + 1) * 100000, text=F.col("line"),
              confidence=50 + F.pmod(F.length("line"), F.lit(50)), child_ids=ids("w")),
        block(words, "WORD", text("w", "n", ".", "i"), (F.col("n") + 1) * 100000 + F.col("i") + 1, text=F.col("word")),
        block(first, "CELL", text("c0.", "i"), F.col("i") + 10, row_index=F.floor(F.col("i") / 2) + 1,
              column_index=F.pmod("i", F.lit(2)) + 1, child_ids=F.array(text("w0.", "i"))),
        block(spoken.where("n = 0"), "TABLE", F.lit("t"), F.lit(1), child_ids=ids("c")),
        block(turns, "KEY_VALUE_SET", F.lit("k"), F.lit(2), entity_types=F.array(F.lit("KEY")),
              child_ids=F.array(F.lit("kw")), value_ids=F.array(F.lit("v"))),
        block(turns, "KEY_VALUE_SET", F.lit("v"), F.lit(3), entity_types=F.array(F.lit("VALUE")),
              child_ids=F.array(F.lit("vw"), F.lit("vs"))),
        block(turns, "WORD", F.lit("kw"), F.lit(4), text=F.col("role")),
        block(turns, "WORD", F.lit("vw"), F.lit(5), text=F.col("page").cast("string")),
        block(turns, "SELECTION_ELEMENT", F.lit("vs"), F.lit(6), selection_status=F.lit("SELECTED")),
        block(turns.where("role = 'assistant'"), "LAYOUT_FIGURE", F.lit("f"), F.lit(7)),
    ]
    return cut_lineage(reduce(DataFrame.union, every))


OCR = """
t AS (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INT) AS page, role,
             list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: w <> '') AS w,
             string_split(text, chr(10)) AS lines FROM conversations),
md AS (
  SELECT doc, page, role, lines, list_transform(range(0, (len(w) + 1) // 2), lambda r:
           '| ' || replace(w[2 * r + 1], '|', '\\|') || CASE WHEN len(w) > 1 THEN ' | ' || replace(coalesce(w[2 * r + 2], ''), '|', '\\|') ELSE '' END || ' |') AS rows, len(w) AS n FROM t),
rendered AS (
  SELECT doc, page, array_to_string(list_filter([
     array_to_string(list_filter(lines[2:], lambda l: trim(l) <> ''), chr(10)),
     CASE WHEN n = 0 THEN '' ELSE rows[1] || chr(10) || CASE WHEN n > 1 THEN '| --- | --- |' ELSE '| --- |' END
       || CASE WHEN len(rows) > 1 THEN chr(10) || array_to_string(rows[2:], chr(10)) ELSE '' END END,
     '**' || role || '**: ' || page || ' [x]',
     CASE WHEN role = 'assistant' THEN '[figure 1: see source page]' ELSE '' END], lambda s: s <> ''), chr(10) || chr(10)) AS text,
     list_avg(list_transform(lines, lambda l: CAST(50 + length(l) % 50 AS DOUBLE))) / 100.0 AS confidence
  FROM md)"""


@queries.add("ocr_assemble", "WITH " + OCR + " SELECT doc, page, text, round(confidence, 6) AS confidence FROM rendered")
def _assemble(spark, d):
    pages = ocr.assemble_pages(turn_blocks(spark, d))
    return pages.withColumn("confidence", F.round("confidence", 6))


@queries.add(
    "ocr_pages",
    "WITH " + OCR + """, plain AS (SELECT t.doc, t.page, array_to_string(lines, chr(10)) AS text FROM t)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) AS number, text, 'ocr:page=' || page AS source_locator FROM plain""",
)
def _ocr_pages(spark, d):
    numbered, _ = ocr.finish_pages(ocr.plain_pages(turn_blocks(spark, d)))
    return numbered.drop("confidence")


@queries.add(
    "ocr_quality",
    "WITH " + OCR + """
SELECT r.doc, count(*) AS page_count, sum(length(array_to_string(lines, chr(10))))::BIGINT AS char_count,
       min(length(array_to_string(lines, chr(10)))) AS min_chars_per_page, round(min(confidence), 6) AS confidence, true AS ocr_used
FROM rendered r JOIN t ON t.doc = r.doc AND t.page = r.page GROUP BY ALL""",
)
def _ocr_quality(spark, d):
    _, quality = ocr.finish_pages(ocr.plain_pages(turn_blocks(spark, d)))
    return quality.withColumn("confidence", F.round("confidence", 6))


# --- ingest --------------------------------------------------------------------


def incoming(spark, d):
    """Documents arriving as bytes; benchmark items arrive under a path that no catalog
    may hold."""
    docs = c._identity(c.table(spark, d, "documents")).select(
        "tenant_id", "namespace", "path", F.encode("text", "UTF-8").alias("content")
    )
    bad = c.table(spark, d, "benchmark").select(
        F.lit("acme").alias("tenant_id"), F.lit("en").alias("namespace"),
        F.concat(F.lit("../"), F.col("item_id").cast("string")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return docs.union(bad)


NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


@queries.add(
    "ingest_documents",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, entry_id, size, etag, checksum, content_type,
       CASE WHEN content_type LIKE 'text/%' THEN 'extracted' ELSE 'catalog_only' END AS status,
       CASE WHEN content_type LIKE 'text/%' THEN 1 END AS page_count,
       CASE WHEN content_type LIKE 'text/%' THEN checksum END AS text_checksum,
       CASE WHEN deleted THEN '2024-06-01' ELSE strftime(updated_at, '%Y-%m-%d') END AS created_on
FROM entries""",
)
def _ingest(spark, d):
    made = ingest.ingest_documents(incoming(spark, d), c.entries(spark, d), NOW)
    return made.entries.select(
        "tenant_id", "namespace", "path", "entry_id", "size", "etag", "checksum", "content_type",
        "extraction.status", "extraction.page_count", "extraction.text_checksum",
        F.left(paths.iso8601(F.col("created_at")), F.lit(10)).alias("created_on"),
    )


@queries.add(
    "ingest_pages",
    c.with_views(c.ENTRIES) + """
SELECT entry_id, 1 AS page, 'text:1' AS source_locator, md5(text) AS text_md5 FROM entries WHERE content_type LIKE 'text/%'""",
)
def _ingest_pages(spark, d):
    made = ingest.ingest_documents(incoming(spark, d), c.entries(spark, d), NOW)
    return made.pages.select("entry_id", "page", "source_locator", F.md5("text").alias("text_md5"))


@queries.add(
    "extraction_backlog",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path FROM entries WHERE deleted OR status <> 'extracted'""",
)
def _backlog(spark, d):
    todo = ingest.extraction_backlog(c.stored_objects(spark, d), c.entries(spark, d))
    return todo.select("tenant_id", "namespace", "path")
