"""Ordered answers: the first rows, one page after a cursor, or every row with its place."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_rank

SALTS = 32


def top_per_group(
    df: DataFrame, by: list[str], order: list[str], k: int, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, ranked from 1.

    A group of any size is spread over ``salts`` tasks first; only each part's own
    first ``k`` rows reach the task that ranks the group, so that task sees at most
    ``salts * k`` rows however hot the group is. No row of the answer is lost.
    """
    parted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    local = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        parted.withColumn("_local", F.row_number().over(local))
        .where(F.col("_local") <= k)
        .drop("_salt", "_local")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= k)
    )


def bounded(df: DataFrame, order: list[str], k: int | None, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows in ``order`` (all for ``None``) with a ``truncated`` flag that says
    whether more rows matched: over all rows, or per group when ``by`` is given."""
    if k is None:
        return df.withColumn("truncated", F.lit(False))
    if by:
        ranked = top_per_group(df, by, order, k + 1, rank="_rank")
        group = Window.partitionBy(*by)
    else:
        first = df.orderBy(*order).limit(k + 1)
        group = Window.partitionBy(F.lit(0))
        ranked = first.withColumn("_rank", F.row_number().over(group.orderBy(*order)))
    return (
        ranked.withColumn("truncated", F.max("_rank").over(group) > k)
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def encode_cursor(key: str) -> str:
    return base64.urlsafe_b64encode(key.encode("utf-8")).decode("ascii")


def decode_cursor(cursor: str) -> str:
    return base64.urlsafe_b64decode(cursor.encode("ascii")).decode("utf-8")


def cursor_of(key: Column) -> Column:
    """Column form of ``encode_cursor``."""
    return F.translate(F.base64(key.cast("binary")), "+/", "-_")


def after(df: DataFrame, key: str, cursor: str | None) -> DataFrame:
    """Rows strictly after ``cursor`` in key order; a test that reaches the scan."""
    return df if cursor is None else df.where(F.col(key) > F.lit(decode_cursor(cursor)))


def page_after(df: DataFrame, key: str, limit: int | None, cursor: str | None = None) -> DataFrame:
    """One keyset page: rows strictly after ``cursor`` in key order, plus a
    ``next_cursor`` column that is null once nothing remains."""
    rest = after(df, key, cursor)
    if limit is None:
        return rest.withColumn("next_cursor", F.lit(None).cast("string"))
    page = bounded(rest, [key], limit)
    last = F.max(key).over(Window.partitionBy(F.lit(0)))
    return page.withColumn("next_cursor", F.when(F.col("truncated"), cursor_of(last))).drop("truncated")


def paged(df: DataFrame, key: str, size: int, by: list[str] | None = None) -> DataFrame:
    """Every page of a whole answer at once: ``ordinal`` (from 1) in key order, ``page_no``
    and the ``next_cursor`` of that page, null on the last one.

    ``key`` is unique in its group. Places come from range partitions and a count per
    partition, so no group passes through one task, whatever its share of the rows. The
    cursors are the keys of the rows that end a page, where another row opens the next:
    two tables of a ``size``-th of the rows, met by page.
    """
    groups = by or []
    placed = with_rank(df, groups, [key], "ordinal").withColumn(
        "page_no", F.floor((F.col("ordinal") - 1) / size).cast("long") + 1
    )
    opens = placed.where(F.pmod(F.col("ordinal") - 1, F.lit(size)) == 0)
    ends = placed.where(F.pmod(F.col("ordinal"), F.lit(size)) == 0).select(
        *groups, "page_no", cursor_of(F.col(key)).alias("next_cursor")
    )
    followed = opens.select(*groups, (F.col("page_no") - 1).alias("page_no"))
    cursors = ends.join(followed, [*groups, "page_no"], "left_semi")
    return placed.join(cursors, [*groups, "page_no"], "left")


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out
