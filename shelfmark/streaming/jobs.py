"""Continuous forms of ingest, sync, quota and alarms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import limits
from ..functions import keys
from ..operators.alarms import PERIOD
from ..plans.ingest import Store, extract_backlog, save
from ..schemas import CHANGES, MESSAGES
from ..sinks.history import append_batch
from ..sources.messages import malformed_messages, parse_object_events
from ..sources.normalizers import Gate, Normalizer

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """Object-created messages arriving as JSON files of (message_id, body, attempt)."""
    return spark.readStream.schema(MESSAGES).json(path)


def ingest_stream(
    messages: DataFrame,
    objects: Callable[[], DataFrame],
    contents: Callable[[], DataFrame],
    store: Store,
    checkpoint: str,
    quarantine: str,
    now: Callable[[], datetime],
    rungs: list[Normalizer] | None = None,
    gate: Gate | None = None,
    max_deliveries: int = limits.MAX_DELIVERIES,
):
    """Extract what messages name, batch by batch.

    Delivery is at least once: a batch that runs again writes the same batch number
    over itself, and a key already extracted is not extracted again. Malformed
    messages, keys that are no originals' and messages delivered too often go to the
    quarantine table with a reason.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spent = F.coalesce(F.col("attempt"), F.lit(1)) > max_deliveries
        bad = malformed_messages(batch.where(~spent)).unionByName(
            batch.where(spent).withColumn("error", F.lit("too_many_deliveries"))
        )
        named = parse_object_events(batch.where(~spent).select("message_id", "body"))
        original = keys.is_indexable(F.col("key"))
        stray = named.where(~original).select(
            "message_id",
            F.col("key").alias("body"),
            F.lit(None).cast("int").alias("attempt"),
            F.lit("not_an_original").alias("error"),
        )
        append_batch(bad.unionByName(stray), quarantine, batch_id)
        # A batch that runs again must not see its own first attempt.
        entries = store.current(spark, before=batch_id + 1)
        result = extract_backlog(
            named.where(original), objects(), contents(), entries, now(), rungs, gate
        )
        save(result, store, batch_id + 1)

    return (
        messages.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """A source's change feed as Parquet files; the stream's checkpoint is its cursor."""
    return spark.readStream.schema(CHANGES).parquet(path)


def delta_sync(
    changes: DataFrame, apply: Callable[[DataFrame, int], int], checkpoint: str
):
    """Feed each batch of changes to ``apply(batch, batch_id)``, which returns how many
    items failed. A batch with failures raises, so the cursor does not move past it."""

    def process(batch: DataFrame, batch_id: int) -> None:
        failed = apply(batch, batch_id)
        if failed:
            raise RuntimeError(f"batch {batch_id}: {failed} items failed; cursor stays")

    return (
        changes.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def alarm_stream(
    metrics: DataFrame, metric: str, ts: str, value: Column, period: int = PERIOD, late: str = "10 minutes"
) -> DataFrame:
    """Sums per (metric, period) of a stream; the watermark bounds the open periods."""
    return (
        metrics.withWatermark(ts, late)
        .groupBy(metric, F.window(ts, f"{int(period)} seconds").alias("_w"))
        .agg(F.sum(value).alias("stat"), F.count("*").alias("samples"))
        .select(metric, F.col("_w.start").alias("period_start"), "stat", "samples")
    )


QUOTA_OUTPUT = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("principal_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("delta_bytes", T.LongType()),
        T.StructField("admitted", T.BooleanType()),
        T.StructField("usage_after", T.LongType()),
    ]
)


class QuotaProcessor(StatefulProcessor):
    """Keeps each principal's usage and admits its deltas in ``seq`` order per batch."""

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.usage = handle.getValueState("usage", T.StructType([T.StructField("used", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from ..operators.ledger import admit_run

        used = self.usage.get()[0] if self.usage.exists() else 0
        batch = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        admitted, after = admit_run(batch["delta_bytes"].to_numpy(dtype="int64"), int(used), self.quota)
        self.usage.update((int(after[-1]),))
        yield pd.DataFrame(
            {
                "tenant_id": key[0],
                "principal_id": key[1],
                "seq": batch["seq"],
                "delta_bytes": batch["delta_bytes"],
                "admitted": admitted,
                "usage_after": after,
            }
        )

    def close(self) -> None:
        pass


def quota_stream(ledger: DataFrame, quota: int) -> DataFrame:
    """Admission with one counter per principal. Needs the RocksDB state store. A
    trigger takes a bounded number of rows (set the source's rate), which bounds what a
    principal brings to one call."""
    spark = ledger.sparkSession
    spark.conf.set(STATE_STORE, ROCKS_DB)
    return (
        ledger.select("tenant_id", "principal_id", "seq", "delta_bytes")
        .groupBy("tenant_id", "principal_id")
        .transformWithStateInPandas(
            statefulProcessor=QuotaProcessor(quota),
            outputStructType=QUOTA_OUTPUT,
            outputMode="Append",
            timeMode="None",
        )
    )
