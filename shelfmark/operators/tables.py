"""Pipe tables parsed out of page text.

A table is a row line that starts with a pipe, followed by a separator line; its
body runs to the first line that does not start with a pipe. The walk over a
page's candidate starts happens inside the row, so nothing is shuffled to find
tables, and a page without a pipe is not even cut into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..functions import text as tx
from ..session import cut_lineage
from .blocks import with_rank
from .bounds import top_per_group
from .catalog import PK
from .text import DOC, readable_documents


def _spans(lines: Column) -> Column:
    """(first, stop) line offsets of the tables of one page, in order."""
    last = F.size(lines)
    starts = F.filter(
        F.transform(
            lines,
            lambda l, i: F.when(
                (i + 1 < last)
                & tx.starts_with_pipe(l)
                & tx.is_table_separator(F.coalesce(F.get(lines, i + 1), F.lit("x"))),
                i,
            ),
        ),
        lambda i: i.isNotNull(),
    )
    other = F.filter(
        F.transform(lines, lambda l, i: F.when(~tx.starts_with_pipe(l), i)),
        lambda i: i.isNotNull(),
    )
    no_spans = F.array().cast("array<struct<first:int,stop:int>>")

    def step(state: Column, start: Column) -> Column:
        stop = F.coalesce(F.array_min(F.filter(other, lambda o: o >= start + 2)), last)
        taken = F.struct(
            stop.cast("int").alias("free"),
            F.concat(
                state["spans"],
                F.array(F.struct(start.cast("int").alias("first"), stop.cast("int").alias("stop"))),
            ).alias("spans"),
        )
        # A start inside the table before it is one of that table's rows.
        return F.when(start >= state["free"], taken).otherwise(state)

    begin = F.struct(F.lit(0).alias("free"), no_spans.alias("spans"))
    return F.aggregate(starts, begin, step, lambda state: state["spans"])


def page_tables(
    pages: DataFrame, max_tables: int | None = limits.TABLES, max_rows: int | None = limits.TABLE_ROWS
) -> DataFrame:
    """One row per table: page, first line, header cells, body cells and row count. ``None``
    keeps all tables of a page, or all body rows."""
    body = F.greatest(F.col("_s.stop") - F.col("_s.first") - 2, F.lit(0))
    kept = body if max_rows is None else F.least(body, F.lit(max_rows))
    shown = F.slice("_lines", F.col("_s.first") + 3, kept)
    cut = pages.where(F.contains("text", F.lit("|"))).select(
        *DOC, "page", tx.split_lines(F.col("text")).alias("_lines")
    )
    spans = _spans(F.col("_lines"))
    if max_tables is not None:
        spans = F.slice(spans, 1, max_tables)
    return tx.explode_once(cut, [*DOC, "page", "_lines"], spans, "_s").select(
        *DOC,
        "page",
        (F.col("_s.first") + 1).alias("line"),
        tx.table_cells(F.get("_lines", F.col("_s.first"))).alias("header"),
        F.transform(shown, tx.table_cells).alias("rows"),
        body.alias("row_count"),
    )


def tables(
    entries: DataFrame,
    pages: DataFrame,
    max_pages: int | None = limits.TABLE_PAGES,
    max_tables: int | None = limits.TABLES,
    max_rows: int | None = limits.TABLE_ROWS,
) -> DataFrame:
    """Tables of every readable document: those of the first ``max_pages`` pages, the first
    ``max_tables`` of them, ``max_rows`` body rows each; ``truncated`` is per document.
    ``None`` lifts a bound; without one on tables, their numbers come from range partitions."""
    last_page, most, most_rows = (limits.size_of(n) for n in (max_pages, max_tables, max_rows))
    seen = pages if last_page is None else pages.where(F.col("page") <= last_page)
    found = page_tables(seen, most, most_rows)
    reading, group, cut = ["page", "line"], Window.partitionBy(*DOC), F.lit(False)
    if most is None:
        # Tables are parsed and written once; only their places are numbered and meet the catalog.
        found = cut_lineage(found.withColumn("_id", F.monotonically_increasing_id()))
        kept = with_rank(found.select("_id", *DOC, *reading, "row_count"), DOC, reading, "table_no")
    else:
        if last_page is None:
            kept = top_per_group(found, DOC, reading, most, rank="table_no")
        else:
            # Each page has at most ``most`` tables here: a document's group is small.
            order = group.orderBy(*reading)
            kept = found.withColumn("table_no", F.row_number().over(order)).where(F.col("table_no") <= most)
        cut = F.max("table_no").over(group) >= most
    if most_rows is not None:
        cut = cut | (F.max("row_count").over(group) > most_rows)
    beyond = F.lit(False) if last_page is None else F.col("page_count") > last_page
    shown = kept.withColumn("_cut", cut).join(readable_documents(entries), DOC)
    if most is None:
        shown = shown.join(found.select("_id", "header", "rows"), "_id")
    return shown.select(
        *PK,
        "table_no",
        "page",
        "line",
        "header",
        "rows",
        (F.col("_cut") | beyond).alias("truncated"),
    )


def table_values(found: DataFrame, keys: list[str]) -> DataFrame:
    """Tables as one row per cell; row 0 is the header, columns count from 1."""
    grid = F.concat(F.array("header"), F.col("rows"))
    rows = tx.explode_once(found, keys, grid, "_cells", position="row")
    return tx.explode_once(rows, [*keys, "row"], F.col("_cells"), "value", position="_c").select(
        *keys, "row", (F.col("_c") + 1).alias("col"), "value"
    )
