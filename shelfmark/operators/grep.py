"""Regex search over page text, one line at a time.

The scan stage turns each page into its few hits (with their context, which is
sliced from the page's own lines); only hits are shuffled afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..functions import dialect
from ..functions import text as tx
from ..session import cut_lineage, fits_broadcast
from .bounds import top_per_group
from .catalog import NAMESPACE, PK, content_type_is, in_namespace
from .text import DOC, readable_documents


def page_hits(
    pages: DataFrame,
    pattern: str,
    ignore_case: bool = True,
    context_lines: int = 0,
    per_page: int | None = None,
    line_chars: int | None = limits.GREP_LINE_CHARS,
) -> DataFrame:
    """Pages with ``hits``: an array of (line, text, before, after), all or the first ``per_page``."""
    regex = dialect.python_regex(pattern, ignore_case)
    around = max(0, context_lines)
    at = F.filter(
        F.transform(F.col("_lines"), lambda l, i: F.when(l.rlike(regex), i)),
        lambda i: i.isNotNull(),
    )

    def shown(line):
        return line if line_chars is None else tx.truncate(line, line_chars)

    def context(start, length):
        part = F.slice(F.col("_lines"), start, length)
        return part if line_chars is None else F.transform(part, shown)

    def hit(i):
        fields = [
            (i + 1).alias("line"),
            shown(F.get(F.col("_lines"), i)).alias("text"),
        ]
        if around:
            fields.append(
                context(F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around))).alias("before")
            )
            fields.append(context(i + 2, F.lit(around)).alias("after"))
        else:
            none = F.array().cast("array<string>")
            fields += [none.alias("before"), none.alias("after")]
        return F.struct(*fields)

    return (
        pages.withColumn("_lines", tx.split_lines(F.col("text")))
        .withColumn("_at", at if per_page is None else F.slice(at, 1, per_page))
        .withColumn("hits", F.transform("_at", hit))
        .drop("_lines", "_at")
    )


def _candidates(entries: DataFrame, path_glob: str, content_type: str | None) -> DataFrame:
    docs = readable_documents(entries).where(dialect.matches_glob(F.col("path"), path_glob))
    if content_type:
        docs = docs.where(content_type_is(F.col("content_type"), content_type))
    return docs.select(*PK, "entry_id")


def _narrowed(
    entries: DataFrame, pages: DataFrame, path_glob: str, content_type: str | None
) -> tuple[DataFrame, DataFrame]:
    """(candidates, pages to scan). A search for some of the documents writes down which
    ones first: if they are few enough to broadcast, other pages are dropped before any
    text is searched; if not, all pages are searched where they lie and only hits move."""
    wanted = _candidates(entries, path_glob, content_type)
    if path_glob == "*" and not content_type:
        return wanted, pages
    wanted = cut_lineage(wanted)
    if fits_broadcast(wanted):
        pages = pages.join(wanted.select(*DOC), DOC, "left_semi")
    return wanted, pages


def grep(
    entries: DataFrame,
    pages: DataFrame,
    pattern: str,
    path_glob: str = "*",
    ignore_case: bool = True,
    context_lines: int = 0,
    max_matches_per_file: int | None = None,
    content_type: str | None = None,
    line_chars: int | None = limits.GREP_LINE_CHARS,
) -> DataFrame:
    """All hits of a corpus with as many lines around them as asked for. Only a caller's
    ``max_matches_per_file`` keeps the first of each document in reading order. Lines show
    their first ``line_chars`` characters, or if that is None all. Nothing is bounded
    across documents; see ``grep_bounded`` for that."""
    most = None if max_matches_per_file is None else max(1, int(max_matches_per_file))
    regex = dialect.python_regex(pattern, ignore_case)
    wanted, pages = _narrowed(entries, pages, path_glob, content_type)
    if dialect.is_literal(pattern):
        # Plain words never span a line end, so one test of the page decides whether
        # it is cut into lines at all.
        pages = pages.where(F.col("text").rlike(regex))
    searched = page_hits(pages, pattern, ignore_case, context_lines, most, line_chars)
    found = tx.explode_once(searched, [*DOC, "page"], F.col("hits"), "_h").select(*DOC, "page", "_h.*")
    if most is not None:
        # Each page brings ``most`` hits at most; the rank limit is also applied before
        # the shuffle, which then serves the join as well.
        order = Window.partitionBy(*DOC).orderBy("page", "line")
        found = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    return found.join(wanted, DOC).select(
        *PK, "page", "line", "text", "before", "after"
    )


def grep_files(
    entries: DataFrame,
    pages: DataFrame,
    pattern: str,
    path_glob: str = "*",
    ignore_case: bool = True,
    content_type: str | None = None,
) -> DataFrame:
    """Paths of documents with at least one hit."""
    regex = dialect.python_regex(pattern, ignore_case)
    if dialect.is_literal(pattern):
        hit = F.col("text").rlike(regex)
    else:
        hit = F.exists(tx.split_lines(F.col("text")), lambda l: l.rlike(regex))
    wanted, pages = _narrowed(entries, pages, path_glob, content_type)
    docs = pages.where(hit).select(*DOC).distinct()
    return wanted.join(docs, DOC, "left_semi").select(*PK)


def grep_bounded(
    entries: DataFrame,
    pages: DataFrame,
    pattern: str,
    path_glob: str = "*",
    ignore_case: bool = True,
    context_lines: int = 0,
    max_files: int = limits.GREP_FILES,
    max_matches: int = limits.GREP_MATCHES,
    max_matches_per_file: int = limits.GREP_MATCHES_PER_FILE,
    content_type: str | None = None,
    files_with_matches: bool = False,
    byte_budget: int = limits.GREP_BYTES,
    within: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The budgeted search of each namespace: (matches, summary).

    Files are taken in path order up to ``max_files``. The search of a namespace
    stops at ``max_matches`` or once ``byte_budget`` bytes of text were read; a
    file stops at its own match bound. The summary has one row per namespace with
    candidates: ``files_searched``, ``truncated`` and ``file_cap_hit``. The budgets
    are running sums over at most ``max_files`` documents of a namespace. ``within``
    names one (tenant, namespace); only its first files' pages are then searched.
    """
    if within:
        entries, pages = in_namespace(entries, *within), in_namespace(pages, *within)
    around = min(context_lines, limits.GREP_CONTEXT_LINES)
    most_files, most = max(1, max_files), max(1, max_matches)
    per_file = 1 if files_with_matches else max(1, max_matches_per_file)
    everyone = _candidates(entries, path_glob, content_type)
    picked = top_per_group(everyone, NAMESPACE, ["path"], most_files + 1, rank="_file")
    files = picked.where(F.col("_file") <= most_files)

    if within:
        # Written first, so that Spark knows the size of the chosen files and broadcasts few.
        pages = pages.join(cut_lineage(files.select(*DOC)), DOC, "left_semi")
    read_rows = (
        page_hits(pages, pattern, ignore_case, around, per_file)
        .select(*DOC, "page", F.octet_length("text").cast("long").alias("_bytes"), "hits")
        .join(files.select(*DOC, "path"), DOC)
    )
    no_hits = F.array().cast(read_rows.schema["hits"].dataType)
    heads = files.select(
        *DOC,
        F.lit(0).alias("page"),
        F.lit(0).cast("long").alias("_bytes"),
        no_hits.alias("hits"),
        "path",
    )
    rows = heads.unionByName(read_rows)

    in_file = Window.partitionBy(*DOC).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    in_space = (
        Window.partitionBy(*NAMESPACE).orderBy("path", "page")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(F.size("hits")).over(in_file), F.lit(0))
    zero = F.lit(0).cast("long")
    walked = (
        rows.withColumn("_left", F.lit(per_file) - before)
        .withColumn("_open", (F.col("page") > 0) & (F.col("_left") > 0))
        .withColumn("_emit", F.when(F.col("_open"), F.least(F.size("hits"), F.col("_left"))).otherwise(0))
        .withColumn("_read", F.when(F.col("_open"), F.col("_bytes")).otherwise(zero))
        .withColumn("_bprior", F.coalesce(F.sum("_read").over(in_space), zero))
        .withColumn("_mprior", F.coalesce(F.sum("_emit").over(in_space), zero))
    )
    spent = F.col("_bprior") >= byte_budget
    full = F.lit(False) if files_with_matches else F.col("_mprior") >= most
    head = F.col("page") == 0
    summary = walked.groupBy(*NAMESPACE).agg(
        F.count_if(head & ~spent & ~full).alias("files_searched"),
        F.max((head & (spent | full)) | (F.col("_open") & spent & ~full)).alias("truncated"),
    )
    capped = picked.groupBy(*NAMESPACE).agg((F.max("_file") > most_files).alias("file_cap_hit"))
    summary = summary.join(capped, NAMESPACE)

    shown = walked.where(~head & ~spent & (F.col("_emit") > 0))
    if files_with_matches:
        return shown.select(*PK), summary
    matches = (
        shown.select(*PK, "page", "_emit", "_mprior", F.posexplode("hits").alias("_i", "_h"))
        .where((F.col("_i") < F.col("_emit")) & (F.col("_mprior") + F.col("_i") < most))
        .select(*PK, "page", "_h.*")
    )
    return matches, summary


