"""Ordered scans within groups that may hold any share of the rows.

Rows are range-partitioned by (group, order): a group larger than one partition
is cut into consecutive blocks, so every block has bounded size. A scan then runs
per block, and only one summary row per block travels to carry values across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin_partitions

BLOCK = "_block"


def with_blocks(
    df: DataFrame, by: list[str], order: list[str], blocks: int | None = None, sort: bool = False
) -> DataFrame:
    """``df`` with a ``_block`` number that rises with (by, order).

    The numbering is written once: a later plan that reads it twice, or a task
    that is run again after an executor is lost, must see the same numbers.
    """
    parts = [blocks] if blocks else []
    spread = df.repartitionByRange(*parts, *by, *order)
    if sort:
        spread = spread.sortWithinPartitions(*by, *order)
    return pin_partitions(spread.withColumn(BLOCK, F.spark_partition_id()))


def _carry(blocked: DataFrame, by: list[str], total: str) -> DataFrame:
    """Per (group, block): the sum of ``total`` over the group's earlier blocks."""
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.withColumn("_carry", F.coalesce(F.sum(total).over(earlier), F.lit(0))).drop(total)


def with_running_sum(
    df: DataFrame, by: list[str], order: list[str], value: str, out: str, blocked: bool = False
) -> DataFrame:
    """The inclusive running sum of ``value`` within each group."""
    rows = df if blocked else with_blocks(df, by, order)
    keys = [*by, BLOCK]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_total"))
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_here", F.sum(value).over(here))
        .join(_carry(totals, by, "_total"), keys)
        .withColumn(out, F.col("_here") + F.col("_carry"))
        .drop("_here", "_carry", *([] if blocked else [BLOCK]))
    )


def with_rank(df: DataFrame, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """The 1-based position of every row in its group."""
    return with_running_sum(df.withColumn("_one", F.lit(1)), by, order, "_one", rank).drop("_one")
