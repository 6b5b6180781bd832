"""Folder views of the catalog: roll-ups of every folder and indented listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions import text as tx
from .blocks import with_rank
from .bounds import bounded
from .catalog import NAMESPACE, live


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def tree_rollup(entries: DataFrame, prefix: str = "") -> DataFrame:
    """Files and bytes below every folder; the root of a namespace is ''.

    Each entry names its ancestors; folders with many files are combined before
    the shuffle, so the root costs one row per map task.
    """
    rows = live(entries)
    if prefix:
        rows = rows.where(F.startswith("path", F.lit(prefix)))
    parts = _parts(F.col("path"))
    folders = tx.let(
        parts,
        lambda p: F.transform(
            F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)),
            lambda i: F.struct(
                F.array_join(F.slice(p, F.lit(1), i), "/").alias("folder"),
                i.alias("depth"),
                (i == F.size(p) - 1).alias("direct"),
            ),
        ),
    )
    return (
        tx.explode_once(rows, [*NAMESPACE, "size"], folders, "_f")
        .groupBy(*NAMESPACE, F.col("_f.folder").alias("folder"), F.col("_f.depth").alias("depth"))
        .agg(
            F.count("*").alias("files"),
            F.count_if("_f.direct").alias("direct_files"),
            F.sum("size").alias("bytes"),
        )
    )


def tree_rows(
    entries: DataFrame, prefix: str = "", max_entries: int | None = limits.TREE_ENTRIES
) -> DataFrame:
    """Lines of the indented listing of every namespace (of its first ``max_entries`` paths, or
    of all for ``None``): folders before files at each level, both sorted; ``sort_key`` puts a
    namespace's lines in order."""
    rows = live(entries)
    if prefix:
        rows = rows.where(F.startswith("path", F.lit(prefix)))
    listed = bounded(rows.select(*NAMESPACE, "path"), ["path"], limits.size_of(max_entries), by=NAMESPACE)
    parts = F.col("_parts")
    depth = F.size(parts) - 1

    def folder_key(upto: Column) -> Column:
        marked = F.transform(
            F.slice(parts, F.lit(1), upto), lambda p: F.concat(F.lit("0"), p, F.lit("\u0000"))
        )
        return F.array_join(marked, "")

    file_line = F.struct(
        F.concat(folder_key(depth), F.lit("1"), F.get(parts, depth)).alias("sort_key"),
        depth.alias("depth"),
        F.get(parts, depth).alias("name"),
        F.lit(False).alias("is_dir"),
    )
    folder_lines = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            folder_key(i).alias("sort_key"),
            (i - 1).alias("depth"),
            F.get(parts, i - 1).alias("name"),
            F.lit(True).alias("is_dir"),
        ),
    )
    split = listed.withColumn("_parts", _parts(F.substring("path", len(prefix) + 1, 2**31 - 1)))
    lines = F.when(F.size(parts) > 0, F.concat(folder_lines, F.array(file_line)))
    return (
        tx.explode_once(split, [*NAMESPACE, "truncated"], lines, "_l")
        .select(*NAMESPACE, "_l.*", "truncated")
        .distinct()
    )


def tree_lines(entries: DataFrame, prefix: str = "") -> DataFrame:
    """The whole indented listing of every namespace, a numbered row per line. Lines get their
    numbers from range partitions, so a namespace is never gathered; a range of ``line_no``
    is one piece of the listing."""
    rows = tree_rows(entries, prefix, max_entries=None).drop("truncated")
    return with_rank(rows, NAMESPACE, ["sort_key"], "line_no")


def tree(entries: DataFrame, prefix: str = "", max_entries: int = limits.TREE_ENTRIES) -> DataFrame:
    """One rendered listing per namespace with folder and file counts. The text is
    built from at most ``max_entries`` paths, so its group is small; ``tree_lines`` has all."""
    rows = tree_rows(entries, prefix, max_entries)
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")),
        F.col("name"),
        F.when(F.col("is_dir"), "/").otherwise(""),
    )
    ordered = F.array_sort(F.collect_list(F.struct("sort_key", line.alias("line"))))
    return rows.groupBy(*NAMESPACE).agg(
        F.array_join(F.transform(ordered, lambda l: l["line"]), "\n").alias("tree"),
        F.count_if("is_dir").alias("dirs"),
        F.count_if(~F.col("is_dir")).alias("files"),
        F.bool_or("truncated").alias("truncated"),
    )
