"""Choosing the text of a document: routes, ladders, quality gate, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from .text import text_checksum_of

# The named ladders, and what each rung claims by media type (exact or
# prefix) or by lower-cased extension.
LADDERS = {
    "lite": ["text_native", "pdf", "docx"],
    "ocr": ["text_native", "pdf", "docx", "textract"],
    "tables": ["text_native", "pdftables", "docx", "textract_analyze"],
    "multimodal": ["text_native", "pdf", "docx", "llm"],
    "full": ["text_native", "pdftables", "docx", "textract_analyze", "llm"],
}
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
CLAIMS = {
    "text_native": {
        "types": ["application/json", "application/xml", "application/x-ndjson"],
        "prefixes": ["text/"],
        "extensions": [
            ".md", ".markdown", ".txt", ".text", ".csv", ".tsv", ".json",
            ".xml", ".html", ".htm", ".yaml", ".yml", ".log",
        ],
    },
    "pdf": {"types": ["application/pdf"], "prefixes": [], "extensions": [".pdf"]},
    "pdftables": {"types": ["application/pdf"], "prefixes": [], "extensions": [".pdf"]},
    "docx": {"types": [WORD_TYPE], "prefixes": [], "extensions": [".docx"]},
    "textract": {
        "types": ["application/pdf"],
        "prefixes": ["image/"],
        "extensions": [*IMAGE_EXTENSIONS, ".pdf"],
    },
    "textract_analyze": {
        "types": ["application/pdf"],
        "prefixes": ["image/"],
        "extensions": [*IMAGE_EXTENSIONS, ".pdf"],
    },
    "tesseract": {
        "types": ["application/pdf"],
        "prefixes": ["image/"],
        "extensions": [*IMAGE_EXTENSIONS, ".pdf"],
    },
    "rapidocr": {
        "types": ["application/pdf"],
        "prefixes": ["image/"],
        "extensions": [*IMAGE_EXTENSIONS, ".pdf"],
    },
    "llm": {
        "types": ["application/pdf"],
        "prefixes": ["image/"],
        "extensions": [*IMAGE_EXTENSIONS, ".pdf"],
    },
    "docling": {
        "types": [
            "application/pdf",
            WORD_TYPE,
            "application/vnd.openxmlformats-officedocument.presentationml.presentation",
            "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
            "application/msword",
            "application/vnd.ms-powerpoint",
            "application/vnd.ms-excel",
        ],
        "prefixes": ["image/"],
        "extensions": [
            ".pdf", ".docx", ".pptx", ".xlsx", ".doc", ".ppt", ".xls", *IMAGE_EXTENSIONS,
        ],
    },
}


def ladder(
    explicit: list[str] | None = None, preset: str | None = None, known: list[str] | None = None
) -> list[str]:
    """The rungs to walk: an explicit list beats a preset, which must exist."""
    rungs = explicit
    if not rungs:
        name = preset or "lite"
        if name not in LADDERS:
            raise ValueError(f"unknown preset {name!r}; available: {', '.join(sorted(LADDERS))}")
        rungs = LADDERS[name]
    allowed = set(CLAIMS) | set(known or [])
    for rung in rungs:
        if rung not in allowed:
            raise ValueError(f"unknown rung {rung!r}; available: {', '.join(sorted(allowed))}")
    return list(rungs)


def accepts(rung: str, content_type: Column, path: Column) -> Column:
    """Whether a rung claims a document."""
    claim = CLAIMS[rung]
    kind = F.coalesce(content_type, F.lit(""))
    tests = [kind.isin(*claim["types"]), paths.extension(path).isin(*claim["extensions"])]
    tests += [F.startswith(kind, F.lit(p)) for p in claim["prefixes"]]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def route(content_type: Column, routes: dict[str, list[str]]) -> Column:
    """The route a media type takes: exact name, else the first ``type/*`` rule in
    order, else ``*``, else null. Routes are configuration, so they fold into one
    CASE expression instead of a join."""
    kind = F.coalesce(content_type, F.lit(""))
    out = F.when(kind.isin(*routes), kind)
    for rule in routes:
        if rule.endswith("/*"):
            out = out.when(F.startswith(kind, F.lit(rule[:-1])), F.lit(rule))
    return out.otherwise(F.lit("*")) if "*" in routes else out


def route_ladder(content_type: Column, routes: dict[str, list[str]]) -> Column:
    """The rungs of a document's route as an array, null without a route."""
    chosen = route(content_type, routes)
    out = None
    for rule, rungs in routes.items():
        names = F.array(*(F.lit(r) for r in rungs))
        out = F.when(chosen == rule, names) if out is None else out.when(chosen == rule, names)
    return out


def rungs_to_try(documents: DataFrame, routes: dict[str, list[str]]) -> DataFrame:
    """One row per (document, rung) that the document's route names and the rung claims."""
    rungs = sorted({r for names in routes.values() for r in names})
    claimed = F.lit(False)
    for rung in rungs:
        if rung in CLAIMS:
            claimed = claimed | (
                (F.col("rung") == rung) & accepts(rung, F.col("content_type"), F.col("path"))
            )
        else:
            claimed = claimed | (F.col("rung") == rung)
    tried = documents.withColumn("_ladder", route_ladder(F.col("content_type"), routes))
    return (
        tried.select(*documents.columns, F.posexplode("_ladder").alias("rung_no", "rung"))
        .withColumn("rung_no", F.col("rung_no") + 1)
        .where(claimed)
    )


def passes_gate(
    min_chars_per_page: Column, confidence: Column, min_chars: int = 1, min_confidence: float = 0.0
) -> Column:
    """Enough text on the thinnest page and, where reported, enough confidence."""
    sure = confidence.isNull() | (confidence >= min_confidence)
    return (min_chars_per_page >= min_chars) & sure


def native_text_attempts(documents: DataFrame, rung_no: int = 1) -> DataFrame:
    """The text rung as a pure Column job over ``content`` (binary): the whole file is
    page one, and blank text is an ``empty_document`` error."""
    text = tx.decode_text(F.col("content"))
    page = F.struct(F.lit(1).alias("page"), F.col("_text").alias("text"), F.lit("text:1").alias("source_locator"))
    blank = tx.is_blank(F.col("_text"))
    return (
        documents.where(accepts("text_native", F.col("content_type"), F.col("path")))
        .withColumn("_text", text)
        .drop("content")
        .withColumn("rung", F.lit("text_native"))
        .withColumn("rung_no", F.lit(rung_no))
        .withColumn("error", F.when(blank, "empty_document"))
        .withColumn("pages", F.when(~blank, F.array(page)))
        .withColumn("ocr_used", F.lit(False))
        .withColumn("confidence", F.lit(None).cast("double"))
        .drop("_text")
    )


def renumber(pages: Column) -> Column:
    """``array<struct<page,text,source_locator>>`` without its blank pages, numbered
    1..n in order. Done inside the row, so a document needs no shuffle for it."""
    ordered = F.array_sort(
        F.transform(pages, lambda p: F.struct(p["page"], p["text"], p["source_locator"]))
    )
    kept = F.filter(ordered, lambda p: ~tx.is_blank(p["text"]))
    return F.transform(
        kept,
        lambda p, i: F.struct(
            (i + 1).alias("page"), p["text"].alias("text"), p["source_locator"].alias("source_locator")
        ),
    )


def renumber_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """The same over a page table: blank pages go, the rest are numbered 1..n and the
    old number stays in ``source_locator``. A document has at most 9,999 pages."""
    order = Window.partitionBy(*by).orderBy("page")
    return pages.where(~tx.is_blank(F.col("text"))).select(
        *by,
        F.row_number().over(order).alias("new_page"),
        F.concat(F.lit("page="), F.col("page").cast("string")).alias("source_locator"),
        "text",
    )


def quality_of(pages: Column) -> list[Column]:
    """Quality measures of an in-row page array."""
    lengths = F.transform(pages, lambda p: F.length(p["text"]).cast("long"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return [
        F.coalesce(F.size(pages), F.lit(0)).alias("page_count"),
        F.coalesce(total, F.lit(0)).alias("char_count"),
        F.coalesce(F.array_min(lengths), F.lit(0)).alias("min_chars_per_page"),
    ]


def quality_report(pages: DataFrame, by: list[str]) -> DataFrame:
    """Per document: pages, characters, thinnest page, least confidence, OCR use."""
    columns = set(pages.columns)
    confidence = F.col("confidence") if "confidence" in columns else F.lit(None).cast("double")
    ocr = F.col("ocr_used") if "ocr_used" in columns else F.lit(False)
    return pages.groupBy(*by).agg(
        F.count("*").alias("page_count"),
        F.sum(F.length("text")).alias("char_count"),
        F.min(F.length("text")).alias("min_chars_per_page"),
        F.min(confidence).alias("confidence"),
        F.bool_or(ocr).alias("ocr_used"),
    )


def select_rung(
    attempts: DataFrame,
    by: list[str],
    carry: list[str] | None = None,
    min_chars: int = 1,
    min_confidence: float = 0.0,
) -> DataFrame:
    """Per document the first rung that had no error, has pages and passes the gate."""
    good = attempts.where(
        F.col("error").isNull()
        & (F.col("page_count") > 0)
        & passes_gate(F.col("min_chars_per_page"), F.col("confidence"), min_chars, min_confidence)
    )
    kept = ["rung", "page_count", *(carry or [])]
    return (
        good.groupBy(*by)
        .agg(F.min_by(F.struct(*kept), F.col("rung_no")).alias("_w"))
        .select(*by, "_w.*")
        .withColumnRenamed("rung", "extractor")
    )


def extraction_state(winner: str, page_count: str, text_checksum: str) -> Column:
    """The nested state of an entry: extracted by its winner, else catalog-only."""
    won = F.col(winner).isNotNull()
    return F.struct(
        F.when(won, "extracted").otherwise("catalog_only").alias("status"),
        F.when(~won, "no_extractor").alias("reason"),
        F.when(won, F.col(page_count).cast("int")).alias("page_count"),
        F.when(won, F.col(text_checksum)).alias("text_checksum"),
        F.col(winner).alias("extractor"),
    )


def needs_extraction(entries: DataFrame, everything: bool = False) -> DataFrame:
    """Documents a heavier ladder may still move: pending or catalog-only rows."""
    if everything:
        return entries
    return entries.where(F.col("extraction.status").isin("pending", "catalog_only"))


def reasons(entries: DataFrame) -> DataFrame:
    """How many live documents stand at each (status, reason)."""
    return (
        entries.where(F.col("deleted_at").isNull())
        .groupBy(
            F.col("extraction.status").alias("status"),
            F.coalesce("extraction.reason", F.lit("")).alias("reason"),
        )
        .agg(F.count("*").alias("documents"))
    )


def text_checksums(pages: DataFrame, by: list[str]) -> DataFrame:
    """Hash of a document's pages joined by newlines in page order. A document has at
    most 9,999 pages (admission holds that), so its gathered text stays small."""
    gathered = pages.groupBy(*by).agg(F.collect_list(F.struct("page", "text")).alias("_p"))
    return gathered.select(
        *by,
        F.size("_p").cast("long").alias("page_count"),
        text_checksum_of(F.col("_p")).alias("text_checksum"),
    )
