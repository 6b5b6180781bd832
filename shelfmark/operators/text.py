"""Reading page text: lines, ranges, headings, sections.

``pages`` is keyed by (tenant_id, namespace, entry_id, page). Operators over a
whole corpus reduce each page to its few results first, inside the scan stage,
and only then join the catalog: page text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..functions import keys
from ..functions import text as tx
from ..session import cut_lineage, fits_broadcast
from .blocks import with_rank
from .bounds import top_per_group
from .catalog import PK, extracted_only, live

DOC = ["tenant_id", "namespace", "entry_id"]


def lines(pages: DataFrame, ended: bool = True) -> DataFrame:
    """Pages as numbered lines, 1-based within the page. Where a text was cut into pages between
    two lines, no line end closes a page: with ``ended=False`` its last line counts also if empty."""
    found = tx.explode_once(
        pages, [*DOC, "page"], tx.split_lines(F.col("text"), ended), "line_text", position="_at"
    )
    return found.select(*DOC, "page", (F.col("_at") + 1).alias("line"), "line_text")


def readable_documents(entries: DataFrame) -> DataFrame:
    """The catalog columns that text operators need, for extracted live rows."""
    return extracted_only(entries).select(
        *PK,
        "entry_id",
        "content_type",
        F.coalesce(F.col("extraction.page_count"), F.lit(0)).alias("page_count"),
    )


def read_plan(
    entries: DataFrame, requests: DataFrame, max_pages: int | None = limits.READ_PAGES
) -> DataFrame:
    """Fit every request (start_page, end_page) to its document: at most ``max_pages`` pages, or
    all for ``None``, with the range, the truncation flag and an error instead of a failure."""
    known = live(entries).select(
        *PK,
        "entry_id",
        F.col("extraction.status").alias("_status"),
        F.coalesce(F.col("extraction.page_count"), F.lit(0)).alias("page_count"),
    )
    error = (
        F.when(~keys.valid_path(F.col("path")), "invalid_path")
        .when(F.col("_status").isNull(), "not_found")
        .when(F.col("_status") != "extracted", "catalog_only")
    )
    pages = F.col("page_count")
    start = F.greatest(F.lit(1), F.coalesce(F.col("start_page"), F.lit(1)))
    wanted = F.least(F.coalesce(F.col("end_page"), pages), pages)
    most = limits.size_of(max_pages)
    stop = wanted if most is None else F.least(wanted, start + (most - 1))
    return (
        requests.join(known, PK, "left")
        .withColumn("error", error)
        .withColumn("range_start", start)
        .withColumn("_stop", stop)
        .withColumn(
            "truncated",
            F.coalesce(F.col("_stop") < pages, F.lit(False))
            | F.coalesce(F.col("end_page") > pages, F.lit(False)),
        )
        .withColumn("range_end", F.greatest(F.col("_stop"), F.col("range_start")))
        .drop("_status")
    )


def read(
    entries: DataFrame, pages: DataFrame, requests: DataFrame, max_pages: int | None = limits.READ_PAGES
) -> DataFrame:
    """Page ranges of many documents at once, a row per page. A request without pages to show still
    answers with one row whose ``page`` is null."""
    # The plan is written down before it meets the text: if the requests are few, Spark
    # sees their true size and broadcasts them, and no page is moved. Which requests have
    # no page to show is found from the key columns alone.
    plan = cut_lineage(read_plan(entries, requests, max_pages))
    # Own names on the page side: callers may derive requests from the same tables.
    text = pages.select(*(F.col(c).alias(f"_{c}") for c in DOC), F.col("page").alias("page"), F.col("text").alias("text"))
    held = text.drop("text")
    in_range = F.col("error").isNull() & F.col("page").between(F.col("range_start"), F.col("_stop"))
    for c in DOC:
        in_range = in_range & (F.col(c) == F.col(f"_{c}"))
    answer = [*requests.columns, "page", "text", "page_count", "range_start", "range_end", "truncated", "error"]
    shown = plan.join(text, in_range).select(*answer)
    unanswered = plan.join(held, in_range, "left_anti")
    nothing = [F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in ("page", "text")]
    return shown.unionByName(unanswered.select(*(c for c in answer if c not in ("page", "text")), *nothing))


def page_headings(
    pages: DataFrame, per_page: int | None = None, title_chars: int | None = limits.OUTLINE_TITLE_CHARS
) -> DataFrame:
    """Headings of every page (the first ``per_page``, or all), found inside the row; headings in code fences count."""
    numbered = F.transform(
        tx.split_lines(F.col("text")),
        lambda l, i: F.when(tx.is_heading(l), F.struct((i + 1).alias("line"), l.alias("raw"))),
    )
    found = F.filter(numbered, lambda h: h.isNotNull())
    if per_page is not None:
        found = F.slice(found, 1, per_page)
    # A page without a heading mark is dropped before it is cut into lines.
    marked = pages.where(F.contains("text", F.lit("#")))
    return tx.explode_once(marked, [*DOC, "page"], found, "_h").select(
        *DOC,
        "page",
        F.col("_h.line").alias("line"),
        tx.heading_level(F.col("_h.raw")).alias("level"),
        tx.heading_title(F.col("_h.raw"), title_chars).alias("title"),
    )


def outline(
    entries: DataFrame,
    pages: DataFrame,
    max_headings: int | None = limits.OUTLINE_HEADINGS,
    max_pages: int | None = limits.OUTLINE_PAGES,
    title_chars: int | None = limits.OUTLINE_TITLE_CHARS,
) -> DataFrame:
    """Headings of every readable document in reading order: ``max_pages`` pages are looked at
    and ``max_headings`` kept, and ``truncated`` tells when either bit. ``None`` lifts a bound;
    without the bound on headings, places come from range partitions, so that not even one
    document of very many headings passes through one task."""
    most, last_page = limits.size_of(max_headings), limits.size_of(max_pages)
    seen = pages if last_page is None else pages.where(F.col("page") <= last_page)
    heads = page_headings(seen, most, title_chars)
    reading = ["page", "line"]
    if most is None:
        # Written first: a range partitioning looks at its input twice, which would read all text again.
        ranked = with_rank(cut_lineage(heads), DOC, reading, "ordinal").withColumn("_full", F.lit(False))
    else:
        if last_page is None:
            ranked = top_per_group(heads, DOC, reading, most, rank="ordinal")
        else:
            # Each page has at most ``most`` headings here: a document's group is small.
            order = Window.partitionBy(*DOC).orderBy(*reading)
            ranked = heads.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most)
        ranked = ranked.withColumn("_full", F.max("ordinal").over(Window.partitionBy(*DOC)) >= most)
    beyond = F.lit(False) if last_page is None else F.col("page_count") > last_page
    return (
        ranked.join(readable_documents(entries), DOC)
        .select(
            *PK,
            "ordinal",
            "level",
            "title",
            "page",
            "page_count",
            (F.col("_full") | beyond).alias("truncated"),
        )
    )


def all_headings(entries: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Every heading of the requested documents, whatever their number of pages."""
    docs = readable_documents(entries).join(requests.select(*PK).distinct(), PK, "left_semi")
    docs = cut_lineage(docs.select(*PK, "entry_id", "page_count"))
    if fits_broadcast(docs):
        pages = pages.join(docs.select(*DOC), DOC, "left_semi")
    return page_headings(pages).join(docs, DOC)


def section_ranges(
    entries: DataFrame, pages: DataFrame, requests: DataFrame, bounded: bool = False
) -> DataFrame:
    """Requests (tenant_id, namespace, path, section) as page ranges: from the first
    heading whose title holds the words, to the page where the next heading of the
    same or a higher level starts, or the last page. All headings are looked at, or
    if ``bounded`` those of the outline only."""
    if bounded:
        docs = requests.select(*PK).distinct()
        heads = outline(entries, pages).join(docs, PK, "left_semi").withColumn("_order", F.struct("ordinal"))
    else:
        heads = all_headings(entries, pages, requests).withColumn("_order", F.struct("page", "line"))
    heads = cut_lineage(heads.select(*PK, "page", "level", "title", "page_count", "_order"))
    needle = F.lower(tx.strip(F.col("section")))
    target = (
        requests.join(heads, PK)
        .where(F.contains(F.lower("title"), needle))
        .groupBy(*PK, "section")
        .agg(
            F.min_by(F.struct("page", "level", "page_count"), "_order").alias("_t"),
        )
        .select(
            *PK,
            "section",
            F.col("_t.page").alias("start_page"),
            F.col("_t.level").alias("_level"),
            F.col("_t.page_count").alias("_last"),
        )
    )
    later = heads.select(*PK, F.col("page").alias("_next"), F.col("level").alias("_next_level"))
    ends = (
        target.join(later, PK)
        .groupBy(*PK, "section", "start_page", "_last")
        .agg(
            F.min(
                F.when(
                    (F.col("_next") > F.col("start_page")) & (F.col("_next_level") <= F.col("_level")),
                    F.col("_next"),
                )
            ).alias("_end")
        )
        .select(*PK, "section", "start_page", F.coalesce("_end", "_last").alias("end_page"))
    )
    return requests.join(ends, [*PK, "section"], "left")


def read_section(
    entries: DataFrame, pages: DataFrame, requests: DataFrame, max_pages: int | None = limits.READ_PAGES
) -> DataFrame:
    """The pages of named sections, ``max_pages`` of each or all for ``None``; an unknown
    section is a row with ``error``."""
    ranges = section_ranges(entries, pages, requests)
    answer = read(entries, pages, ranges, max_pages).withColumn(
        "_missed", F.col("error").isNull() & F.col("end_page").isNull()
    )
    missed = F.col("_missed")
    return (
        answer.where(~missed | (F.coalesce(F.col("page"), F.lit(1)) == 1))
        .withColumn("error", F.when(missed, "no_section").otherwise(F.col("error")))
        .withColumn("page", F.when(~missed, F.col("page")))
        .withColumn("text", F.when(~missed, F.col("text")))
        .drop("_missed")
    )


def text_checksum_of(pages_array):
    """Column: hash of an ``array<struct<page,text,..>>`` joined by newlines in page order."""
    ordered = F.array_sort(F.transform(pages_array, lambda p: F.struct(p["page"], p["text"])))
    return F.sha2(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), 256)
