"""Column functions over text: lines, headings, pipe-table cells, blank tests.

Everything stays in the JVM. White space and line ends follow Python's string
rules, which are wider than Spark's ``trim`` (space only) and Java's ``\\s``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits

# The text patterns of the data model.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
RARE_LINE_ENDS = ("\r", "\u000b", "\u000c", "\u001c", "\u001d", "\u001e", "\u0085", "\u2028", "\u2029")
SPACE = r"[\s\u001c-\u001f]"
NON_SPACE = r"[^\s\u001c-\u001f]"
HEADING = rf"(?U)\A(#{{1,6}}){SPACE}+({NON_SPACE}.*?){SPACE}*#*{SPACE}*\z"
SEPARATOR_CELL = r"\A:?-+:?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(
    df: DataFrame, keep: list, values: Column, value: str, position: str | None = None
) -> DataFrame:
    """``keep`` columns and one row per element of an array that is costly to compute.

    A plain explode makes the optimizer test the array's size first, and push that test
    below the projection with a second copy of the whole computation. The outer form is
    left alone; the empty row it adds is dropped by a test on the element itself.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(values).alias(value))
    else:
        out = df.select(*keep, F.posexplode_outer(values).alias(position, value))
    return out.where(F.col(value).isNotNull())


def split_lines(text: Column, ended: bool = True) -> Column:
    """Lines as an array. A final line end does not open an empty last line, unless lines
    are not ``ended``: then line ends part them, and an empty text is one empty line."""
    # Plain newlines take the single-character split, which needs no regex; byte
    # searches for the rare ends cost far less than a character class would.
    rare = reduce(or_, (F.contains(text, F.lit(end)) for end in RARE_LINE_ENDS))
    raw = F.when(rare, F.split(text, LINE_END)).otherwise(F.split(text, "\n"))
    if not ended:
        return raw
    return let(
        raw,
        lambda a: F.when(
            F.get(a, F.size(a) - 1) == "", F.slice(a, F.lit(1), F.size(a) - 1)
        ).otherwise(a),
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U){NON_SPACE}")


def truncate(text: Column, chars: int = limits.GREP_LINE_CHARS) -> Column:
    """The first ``chars`` characters (not bytes)."""
    return F.substring(text, 1, chars)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column, chars: int | None = limits.OUTLINE_TITLE_CHARS) -> Column:
    """The words of a heading line, cut at ``chars`` characters unless that is ``None``."""
    title = F.regexp_extract(line, HEADING, 2)
    return title if chars is None else truncate(title, chars)


def starts_with_pipe(line: Column) -> Column:
    return line.rlike(rf"(?U)\A{SPACE}*\|")


def table_cells(line: Column) -> Column:
    """Cells of a pipe row: outer space and outer pipes go, every cell is stripped."""
    inner = F.regexp_replace(strip(line), r"\A\|+|\|+\z", "")
    return F.transform(F.split(inner, r"\|"), strip)


def is_table_separator(line: Column) -> Column:
    """True when every non-empty cell is dashes with optional colons at its ends."""
    return F.forall(table_cells(line), lambda c: (c == "") | c.rlike(SEPARATOR_CELL))


def row_to_markdown(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_to_markdown(rows: Column) -> Column:
    """Header row, rule row, body rows, from ``array<array<string>>``; '' without rows."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    return let(clean, _render_rows)


def grid_to_markdown(rows: Column) -> Column:
    """As ``table_to_markdown``, but pipes are escaped, newlines become spaces and
    short rows are padded to the widest."""

    def tidy(cell: Column) -> Column:
        flat = F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" "))
        return strip(F.replace(flat, F.lit("|"), F.lit("\\|")))

    def pad(all_rows: Column) -> Column:
        width = F.array_max(F.transform(all_rows, F.size))
        return F.transform(
            all_rows,
            lambda r: F.concat(
                F.transform(r, tidy), F.array_repeat(F.lit(""), width - F.size(r))
            ),
        )

    return let(
        rows,
        lambda a: F.when(
            (F.size(a) == 0) | (F.size(F.get(a, F.lit(0))) == 0), F.lit("")
        ).otherwise(let(pad(a), _render_rows)),
    )


def _render_rows(rows: Column) -> Column:
    header = F.get(rows, F.lit(0))
    rule = row_to_markdown(F.array_repeat(F.lit("---"), F.size(header)))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), row_to_markdown)
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(
        F.array_join(F.concat(F.array(row_to_markdown(header), rule), body), "\n")
    )


def join_row_text(paragraphs: Column, rows: Column) -> Column:
    """Non-blank paragraphs, then table rows as ``a | b``; blocks part by a blank line."""
    kept = F.filter(paragraphs, lambda p: ~is_blank(p))
    stripped = F.transform(rows, lambda r: F.transform(r, strip))
    lines = F.transform(
        F.filter(stripped, lambda r: F.exists(r, lambda c: c != "")),
        lambda r: F.array_join(r, " | "),
    )
    return F.array_join(F.concat(kept, lines), "\n\n")


def decode_text(content: Column) -> Column:
    """UTF-8 text of a binary column, invalid bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))
