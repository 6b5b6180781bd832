"""Append-only tables on plain Parquet: batches in, current rows out.

Every attempt at a batch is written to a folder of its own, which nobody reads. An empty file
whose name holds batch, commit number and attempt then makes it the batch: it is created in one
step or not at all. Readers take the newest commit of each batch, so an attempt that dies leaves
the batch as it was, one that is made again takes the place of the last, and a reader that has
begun goes on with the files it has. Rows are never changed in place: the current row of a key
is the one of its highest batch.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import PK
from ..operators.text import DOC
from ..operators.upkeep import latest_version

BATCH = "batch_id"
DATA, COMMITS = "data", "commits"


def _folder(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    target, files = _folder(spark, path)
    return list(files.listStatus(target)) if files.exists(target) else []


def write_attempt(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> str:
    """Write rows where no reader looks yet; returns the name of the attempt."""
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/{DATA}/{BATCH}={int(batch_id)}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch_id: int, attempt: str) -> None:
    """Make an attempt the batch. Of two that commit at once, one has the later number or name."""
    number = 1 + max((n for b, n, _ in commits(spark, path) if b == int(batch_id)), default=0)
    target, files = _folder(spark, f"{path}/{COMMITS}/{int(batch_id):020d}.{number:06d}.{attempt}")
    files.createNewFile(target)


def commits(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(batch, number, attempt) of all commits in order; the driver holds a name each."""
    names = (s.getPath().getName().split(".") for s in _listed(spark, f"{path}/{COMMITS}"))
    return sorted((int(b), int(n), attempt) for b, n, attempt in (x for x in names if len(x) == 3))


def snapshot(spark: SparkSession, path: str) -> dict[int, str]:
    """The attempt that each batch is made of now."""
    return {batch: attempt for batch, _, attempt in commits(spark, path)}


def append_batch(
    df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()
) -> None:
    """Write a batch in place of any earlier attempt at it, of which nothing stays: also
    not those partitions that the new attempt has no rows for."""
    commit(df.sparkSession, path, batch_id, write_attempt(df, path, batch_id, partition_by))


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A history with a declared schema, as its commits stand now; an absent table reads as empty."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    # The attempt is named in the schema too, or Spark would guess a type from its letters.
    held = T.StructType([*full.fields, T.StructField("attempt", T.StringType())])
    root = f"{path}/{DATA}"
    folders = [f"{root}/{BATCH}={b}/attempt={a}" for b, a in snapshot(spark, path).items()]
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(held).option("basePath", root).parquet(*folders).select(*full.fieldNames())


def vacuum(spark: SparkSession, path: str, older_than_seconds: float) -> int:
    """Delete attempts that no batch is made of any more, or ever was, once they are old enough
    that no reader or writer is still at them; returns how many."""
    live, before, gone = set(snapshot(spark, path).items()), time.time() - older_than_seconds, 0
    for batch in _listed(spark, f"{path}/{DATA}"):
        name = batch.getPath().getName()
        if not name.startswith(f"{BATCH}="):
            continue
        for attempt in _listed(spark, batch.getPath().toString()):
            key = int(name.split("=")[1]), attempt.getPath().getName().split("=")[-1]
            if key not in live and attempt.getModificationTime() / 1000 < before:
                _, files = _folder(spark, attempt.getPath().toString())
                gone += bool(files.delete(attempt.getPath(), True))
    return gone


def current(history: DataFrame, by: list[str]) -> DataFrame:
    return latest_version(history, by, [BATCH]).drop(BATCH)


def current_entries(history: DataFrame) -> DataFrame:
    """Latest row per primary key, tombstones included."""
    return current(history, PK)


def current_pages(history: DataFrame) -> DataFrame:
    """Pages of each document's latest batch only, so a document that shrank shows no
    old page. Which (document, batch) pairs are superseded is found from the key
    columns; page text is only filtered."""
    batches = history.select(*DOC, BATCH).distinct()
    newest = batches.groupBy(*DOC).agg(F.max(BATCH).alias("_newest"))
    superseded = (
        batches.join(newest, DOC).where(F.col(BATCH) < F.col("_newest")).select(*DOC, BATCH)
    )
    return history.join(superseded, [*DOC, BATCH], "left_anti").drop(BATCH)


def compact(rows: DataFrame, out_path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write current rows as batch 0 of a new table; readers switch to it afterwards.
    The table being read is never the one written."""
    append_batch(rows, out_path, 0, partition_by)
