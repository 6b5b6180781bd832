"""Differences between pairs of documents, for a table of pairs.

Requests are (tenant_id, namespace, path_a, path_b). A unified diff gathers the first
twenty pages of the requested documents; twenty pages is a fixed bound, so a document's
text is one small row. Compared as multisets of lines, documents are never gathered
and all their pages count.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions import text as tx
from ..session import cut_lineage
from .catalog import NAMESPACE, live
from .text import DOC

PAIR = [*NAMESPACE, "path_a", "path_b"]


def _texts(entries: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested documents as (tenant, namespace, path, text, status, page_count)."""
    paths = (
        requests.select(*NAMESPACE, F.col("path_a").alias("path"))
        .union(requests.select(*NAMESPACE, F.col("path_b").alias("path")))
        .distinct()
    )
    docs = live(entries).join(paths, [*NAMESPACE, "path"], "left_semi").select(
        *DOC,
        "path",
        F.col("extraction.status").alias("status"),
        F.coalesce(F.col("extraction.page_count"), F.lit(0)).alias("page_count"),
    )
    # Written down, so that a small request moves no other document's text.
    docs = cut_lineage(docs)
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = (
        pages.where(F.col("page").between(1, limits.DIFF_PAGES))
        .join(docs.select(*DOC), DOC, "left_semi")
        .groupBy(*DOC)
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
    )
    return docs.join(text, DOC, "left").withColumn("text", F.coalesce("text", F.lit("")))


def paired(entries: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with both texts, an ``error`` per unreadable side, and whether pages
    beyond the bound were left out of the comparison."""
    docs = _texts(entries, pages, requests)

    def side(name: str) -> DataFrame:
        return docs.select(
            *NAMESPACE,
            F.col("path").alias(f"path_{name}"),
            F.col("text").alias(f"text_{name}"),
            F.col("status").alias(f"status_{name}"),
            (F.col("page_count") > limits.DIFF_PAGES).alias(f"cut_{name}"),
        )

    def trouble(name: str):
        status = F.col(f"status_{name}")
        return F.when(status.isNull(), "not_found").when(status != "extracted", "catalog_only")

    return (
        requests.select(*PAIR)
        .join(side("a"), [*NAMESPACE, "path_a"], "left")
        .join(side("b"), [*NAMESPACE, "path_b"], "left")
        .withColumn("error", F.coalesce(trouble("a"), trouble("b")))
        .withColumn("pages_truncated", F.coalesce(F.col("cut_a") | F.col("cut_b"), F.lit(False)))
    )


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, cuts = [], []
        for row in batch.itertuples(index=False):
            lines = list(
                difflib.unified_diff(
                    row.text_a.splitlines(),
                    row.text_b.splitlines(),
                    fromfile=row.path_a,
                    tofile=row.path_b,
                    lineterm="",
                )
            )
            texts.append("\n".join(lines[: limits.DIFF_LINES]))
            cuts.append(len(lines) > limits.DIFF_LINES)
        out = batch[[*PAIR, "error", "pages_truncated"]].copy()
        yield out.assign(diff=texts, truncated=cuts)


def diff(entries: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Unified diffs with three context lines, at most five hundred lines each. Equal
    texts and unreadable pairs are answered without leaving the JVM."""
    pairs = paired(entries, pages, requests)
    changed = F.col("error").isNull() & (F.col("text_a") != F.col("text_b"))
    schema = (
        "tenant_id string, namespace string, path_a string, path_b string, error string, "
        "pages_truncated boolean, diff string, truncated boolean"
    )
    worked = (
        pairs.where(changed)
        .select(*PAIR, "error", "pages_truncated", "text_a", "text_b")
        .mapInPandas(_unified, schema)
    )
    plain = pairs.where(~changed).select(
        *PAIR,
        "error",
        "pages_truncated",
        F.when(F.col("error").isNull(), F.lit("")).alias("diff"),
        F.lit(False).alias("truncated"),
    )
    return worked.unionByName(plain)


def unreadable_pairs(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Pairs that no comparison can answer, each with its ``error``: that of the first side, or
    else of the second. Only catalog columns are read; ``diff_lines`` answers all other pairs,
    and has no row for a pair without differences."""
    states = live(entries).select(*NAMESPACE, "path", F.col("extraction.status").alias("_status"))

    def side(name: str) -> DataFrame:
        return states.withColumnsRenamed({"path": f"path_{name}", "_status": f"_{name}"})

    def trouble(status: str) -> Column:
        return F.when(F.col(status).isNull(), "not_found").when(F.col(status) != "extracted", "catalog_only")

    return (
        requests.select(*PAIR)
        .distinct()
        .join(side("a"), [*NAMESPACE, "path_a"], "left")
        .join(side("b"), [*NAMESPACE, "path_b"], "left")
        .select(*PAIR, F.coalesce(trouble("_a"), trouble("_b")).alias("error"))
        .where(F.col("error").isNotNull())
    )


def _sides(entries: DataFrame, text: DataFrame, requests: DataFrame) -> DataFrame:
    """Both documents of every pair that can be read: (pair, document, _sign, _last page)."""
    asked = requests.select(*PAIR).where(F.col("path_a") != F.col("path_b")).distinct()
    sides = F.array(
        F.struct(F.col("path_a").alias("path"), F.lit(-1).alias("_sign")),
        F.struct(F.col("path_b").alias("path"), F.lit(1).alias("_sign")),
    )
    asked = asked.select(*PAIR, F.explode(sides).alias("_s")).select(*PAIR, "_s.*")
    docs = live(entries).where(F.col("extraction.status") == "extracted").select(*NAMESPACE, "path", "entry_id")
    found = cut_lineage(asked.join(docs, [*NAMESPACE, "path"]))
    both = found.groupBy(*PAIR).agg(F.count_distinct("_sign").alias("_n")).where(F.col("_n") == 2).select(*PAIR)
    wanted = found.select(*DOC).distinct()
    last = text.join(wanted, DOC, "left_semi").groupBy(*DOC).agg(F.max("page").alias("_last"))
    return found.join(both, PAIR, "left_semi").join(last, DOC).select(*PAIR, "entry_id", "_sign", "_last")


def diff_lines(entries: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines that a pair does not share, as multisets: ``removed`` and ``added`` counts
    per distinct line, over all pages. Fully native, with partial sums before the shuffle."""
    text = pages.where((F.col("page") >= 1) & F.col("text").isNotNull()).select(*DOC, "page", "text")
    sides = cut_lineage(_sides(entries, text, requests))
    # Pages are joined by newlines: one that ends a line opens an empty one, unless it is the last.
    whole = F.when(F.col("page") < F.col("_last"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return (
        tx.explode_once(text.join(sides, DOC), [*PAIR, "_sign"], tx.split_lines(whole), "line")
        .groupBy(*PAIR, "line")
        .agg(F.sum("_sign").alias("_net"))
        .where(F.col("_net") != 0)
        .select(
            *PAIR,
            "line",
            F.greatest(-F.col("_net"), F.lit(0)).alias("removed"),
            F.greatest(F.col("_net"), F.lit(0)).alias("added"),
        )
    )
