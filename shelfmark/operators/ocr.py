"""OCR block tables turned into page markdown.

``blocks`` holds one row per recognised block (see ``schemas.OCR_BLOCKS``); ``seq``
is its place on the page. Words meet their parents in one equi-join on (doc, page,
block id); what is left of a page, its lines, cells and fields, is then small enough
to be laid out inside one row. Every group is one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .extraction import quality_report

PAGE = ["doc", "page"]
LEAVES = ("WORD", "SELECTION_ELEMENT")


def _kind(*names: str) -> Column:
    return F.col("block_type").isin(*names)


def _edges(blocks: DataFrame) -> DataFrame:
    """Child references of every block that may hold words, with their place."""
    parents = blocks.where(~_kind("TABLE", *LEAVES))
    return parents.select(*PAGE, F.col("id").alias("parent"), F.posexplode("child_ids").alias("place", "child"))


def _words(blocks: DataFrame) -> DataFrame:
    """Leaf blocks as text: words, and ``[x]`` for a ticked box; empty ones are left out."""
    ticked = _kind("SELECTION_ELEMENT") & (F.col("selection_status") == "SELECTED")
    word = F.when(_kind("WORD"), F.col("text")).when(ticked, F.lit("[x]"))
    return (
        blocks.where(_kind(*LEAVES))
        .select(*PAGE, F.col("id").alias("child"), F.nullif(word, F.lit("")).alias("word"))
        .where(F.col("word").isNotNull())
    )


def _table_words(blocks: DataFrame) -> DataFrame:
    """Distinct ids that the cells of some table refer to."""
    owned = blocks.where(_kind("TABLE")).select(*PAGE, F.explode("child_ids").alias("id")).distinct()
    return (
        blocks.where(_kind("CELL"))
        .join(owned, [*PAGE, "id"], "left_semi")
        .select(*PAGE, F.explode("child_ids").alias("child"))
        .distinct()
        .withColumn("_tabled", F.lit(True))
    )


def _ordered(value: Column, *order: str) -> Column:
    """Aggregate: values in the order of columns, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.transform(rows, lambda r: r["_v"])


def child_text(blocks: DataFrame) -> DataFrame:
    """Per block with children: their words in reference order (``child_text``), and
    ``covered``, true when table cells refer to every one of the children."""
    words = F.array_join(
        F.transform(
            F.filter(
                F.array_sort(F.collect_list(F.struct("place", "word"))), lambda r: r["word"].isNotNull()
            ),
            lambda r: r["word"],
        ),
        " ",
    )
    return (
        _edges(blocks)
        .join(_words(blocks), [*PAGE, "child"], "left")
        .join(_table_words(blocks), [*PAGE, "child"], "left")
        .groupBy(*PAGE, F.col("parent").alias("id"))
        .agg(
            words.alias("child_text"),
            F.bool_and(F.coalesce("_tabled", F.lit(False))).alias("covered"),
        )
    )


def line_confidence(blocks: DataFrame) -> DataFrame:
    """Per page the mean confidence of its lines as a fraction, null without scores."""
    score = F.when(_kind("LINE"), F.col("confidence"))
    return blocks.groupBy(*PAGE).agg((F.avg(score) / 100.0).alias("confidence"))


# --- layout of one page, over its array of blocks ``b`` --------------------------


def _body(b: Column) -> Column:
    lines = F.filter(b, lambda x: (x["block_type"] == "LINE") & ~x["covered"])
    said = F.transform(lines, lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["child_text"]))
    return F.array_join(F.filter(said, lambda s: ~tx.is_blank(s)), "\n")


def _grid(cells: Column) -> Column:
    """Cells as rows of texts; a place no cell names stays empty."""
    width = F.array_max(F.transform(cells, lambda x: x["column_index"]))
    height = F.array_max(F.transform(cells, lambda x: x["row_index"]))

    def at(row: Column, column: Column) -> Column:
        here = F.filter(row, lambda x: x["column_index"] == column)
        return F.coalesce(F.try_element_at(here, F.lit(-1))["child_text"], F.lit(""))

    def one_row(number: Column) -> Column:
        return tx.let(
            F.filter(cells, lambda x: x["row_index"] == number),
            lambda row: F.transform(F.sequence(F.lit(1), width), lambda c: at(row, c)),
        )

    return F.transform(F.sequence(F.lit(1), height), one_row)


def _tables(b: Column) -> Column:
    def render(table: Column) -> Column:
        own = F.filter(
            b, lambda x: (x["block_type"] == "CELL") & F.array_contains(table["child_ids"], x["id"])
        )
        return tx.let(
            own,
            lambda cells: F.when(F.size(cells) > 0, tx.grid_to_markdown(_grid(cells))).otherwise(""),
        )

    return F.transform(F.filter(b, lambda x: x["block_type"] == "TABLE"), render)


def _forms(b: Column) -> Column:
    fields = F.filter(b, lambda x: x["block_type"] == "KEY_VALUE_SET")

    def line(key: Column) -> Column:
        named = F.transform(
            key["value_ids"],
            lambda v: F.get(F.filter(fields, lambda x: x["id"] == v), F.lit(0))["child_text"],
        )
        # The last referenced value that has text wins.
        value = F.try_element_at(F.filter(named, lambda t: F.coalesce(t != "", F.lit(False))), F.lit(-1))
        full = F.concat(F.lit("**"), key["child_text"], F.lit("**: "), F.coalesce(value, F.lit("")))
        return F.regexp_replace(full, rf"(?U){tx.SPACE}+\z", "")

    keys = F.filter(fields, lambda x: x["is_key"] & (x["child_text"] != ""))
    return F.array_join(F.transform(keys, line), "\n")


def _figures(b: Column) -> Column:
    found = F.filter(b, lambda x: x["block_type"] == "LAYOUT_FIGURE")
    return F.transform(
        found, lambda x, i: F.concat(F.lit("[figure "), (i + 1).cast("string"), F.lit(": see source page]"))
    )


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """Markdown of every page: body lines that no table shows, tables, form fields and
    figure notes; with the page's confidence."""
    upper = blocks.where(~_kind(*LEAVES)).join(child_text(blocks), [*PAGE, "id"], "left")
    shape = F.struct(
        "seq",
        "id",
        "block_type",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("child_text", F.lit("")).alias("child_text"),
        F.coalesce("covered", F.lit(False)).alias("covered"),
        "row_index",
        "column_index",
        F.coalesce(F.array_contains("entity_types", "KEY"), F.lit(False)).alias("is_key"),
        F.when(_kind("TABLE"), F.col("child_ids")).alias("child_ids"),
        F.coalesce("value_ids", F.array().cast("array<string>")).alias("value_ids"),
    )
    score = F.when(_kind("LINE"), F.col("confidence"))
    whole = upper.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(shape)).alias("_b"), (F.avg(score) / 100.0).alias("confidence")
    )
    b = F.col("_b")
    sections = F.concat(F.array(_body(b)), _tables(b), F.array(_forms(b)), _figures(b))
    return whole.select(
        *PAGE,
        F.array_join(F.filter(sections, lambda s: ~tx.is_blank(s)), "\n\n").alias("text"),
        "confidence",
    )


def plain_pages(blocks: DataFrame) -> DataFrame:
    """Plain OCR: the lines of each page, joined by newlines, with confidence."""
    lines = blocks.where(_kind("LINE"))
    return lines.groupBy(*PAGE).agg(
        F.array_join(_ordered(F.coalesce("text", F.lit("")), "seq"), "\n").alias("text"),
        (F.avg("confidence") / 100.0).alias("confidence"),
    )


def finish_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept pages renumbered 1..n, per-document quality). Blank pages go. A document
    has at most 9,999 pages, so its group is small."""
    kept = pages.where(~tx.is_blank(F.col("text")))
    order = Window.partitionBy("doc").orderBy("page")
    numbered = kept.select(
        "doc",
        F.row_number().over(order).alias("number"),
        "text",
        "confidence",
        F.concat(F.lit("ocr:page="), F.col("page").cast("string")).alias("source_locator"),
    )
    return numbered, quality_report(kept.withColumn("ocr_used", F.lit(True)), ["doc"])
