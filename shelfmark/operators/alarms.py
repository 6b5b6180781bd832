"""Threshold alarms over fixed periods, and their state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import limits

PERIOD = limits.ALARM_PERIOD_SECONDS


def alarm_windows(
    metrics: DataFrame, metric: str, ts: str, value: Column, statistic: str = "sum", period: int = PERIOD
) -> DataFrame:
    """One row per (metric, period) that has data: its statistic and sample count."""
    folds = {"sum": F.sum, "max": F.max}
    if statistic not in folds:
        raise ValueError(f"unknown statistic: {statistic}")
    return (
        metrics.groupBy(metric, F.window(ts, f"{int(period)} seconds").alias("_w"))
        .agg(folds[statistic](value).alias("stat"), F.count("*").alias("samples"))
        .select(metric, F.col("_w.start").alias("period_start"), "stat", "samples")
    )


def alarm_changes(
    windows: DataFrame, metric: str, breach: Column, periods: int = 1, period: int = PERIOD
) -> DataFrame:
    """When each alarm fires and clears: it fires with the ``periods``-th breaching
    period in a row and clears with the next period that does not breach. A period
    without data does not breach, so only breaching periods are looked at, as runs of
    consecutive period numbers; no calendar of empty periods is built.
    """
    number = (F.unix_seconds(F.col("period_start").cast("timestamp")) / period).cast("long")
    numbered = windows.withColumn("_n", number)
    order = Window.partitionBy(metric).orderBy("_n")
    runs = (
        numbered.where(breach)
        .withColumn("_run", F.col("_n") - F.row_number().over(order))
        .groupBy(metric, "_run")
        .agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
        .where(F.col("_last") - F.col("_first") + 1 >= periods)
        .withColumn("_end", numbered.agg(F.max("_n")).scalar())
    )
    fired = F.struct((F.col("_first") + (periods - 1)).alias("n"), F.lit("ALARM").alias("state"))
    cleared = F.struct((F.col("_last") + 1).alias("n"), F.lit("OK").alias("state"))
    both = F.when(F.col("_last") < F.col("_end"), F.array(fired, cleared)).otherwise(F.array(fired))
    return runs.select(metric, F.explode(both).alias("_c")).select(
        metric,
        F.timestamp_seconds(F.col("_c.n") * period).alias("period_start"),
        F.col("_c.state").alias("state"),
    )
