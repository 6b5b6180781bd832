"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order; a document's virtual finish time is
the source's words up to and including it, divided by the source's target. All documents,
those of a second pass over their source after those of the first, are range-sorted by that
time and cut off at the total budget. What a source gives is then a prefix of its own order,
so the whole mix is one pair of cut-off keys a source, and texts are never moved.

Cases: a null or empty text has size 0 and is taken with nothing; a null source is a source
of its own, last in order; rows whose keys tie (a repeated id) are taken or left together;
an empty table gives an empty mix; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_ROWS = 5_000
SEED = "mix:1:"


def order_key(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """A document's place in the shuffled order: 60 bits of a digest of its id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key): all that mixing needs to know of a document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        words(text_col).alias("size"),
        order_key(id_col, seed).alias("key"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): shares of the budget by weight, none above ``most`` times its source.

    Sources fill up in the order of (what they can give / weight). The level at which the
    budget is used up follows from running sums in that order.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight)
    t = t.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    later = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    filled = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    t = t.withColumn("level", (F.col("budget") - filled) / F.sum("weight").over(later))
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    # Later places leave out ever more of the budget, so the first level that fits is the highest.
    t = t.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("weight") * F.col("level"), (F.lit(most) * F.col("source_size")).cast("double"))
    return t.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _finish_times(sizes: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """(source, key, pass, size, finish): one row for each document and pass over its source."""
    # A source, which may hold a third of all rows, is cut into blocks of its shuffled order.
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK_ROWS), F.lit(1))
    block = F.floor(F.col("key") / F.lit(float(2**60)) * blocks)
    rows = sizes.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("block", block)
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"),
        F.col("block").alias("_b"),
        F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("start"),
    )
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    # Ties of a key share one sum (the frame is a range), so a cut never falls between them.
    within = F.sum("size").over(Window.partitionBy("source", "block").orderBy("key"))
    rows = rows.withColumn("upto", F.col("start") + within)
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    rows = rows.select("source", "key", "size", "source_size", "target", "upto", passes)
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    return rows.filter("target > 0").select("source", "key", "pass", "size", finish.alias("finish"))


def cutoffs(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, last): in ``last``, a pass's highest taken key, for each pass with any.

    ``sizes`` is read several times; hand over a written table. The result has a row a source.
    """
    aims = cut_lineage(targets(sizes, weights, share, most))
    timed = cut_lineage(_finish_times(sizes, aims, most))
    # The budget runs out in one of many slices of time; rows of that slice alone are ranked.
    budget = aims.agg(F.sum("target")).first()[0] or 0.0
    slices = max(1, -(-timed.count() // BLOCK_ROWS))
    # finish / (1 + finish) keeps the order and lies below 1.
    squeezed = F.col("finish") / (F.col("finish") + 1)
    placed = timed.withColumn("slice", F.floor(squeezed * F.lit(slices)))
    sums = placed.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    sums = cut_lineage(sums.filter(F.col("start") <= budget).select("slice", "start", "slice_size"))
    placed = placed.join(sums, "slice")
    whole = placed.filter(F.col("start") + F.col("slice_size") <= budget)
    split = placed.filter(F.col("start") + F.col("slice_size") > budget)
    reach = F.col("start") + F.sum("size").over(Window.partitionBy("slice").orderBy("finish"))
    split = split.withColumn("reach", reach).filter(F.col("reach") <= budget).drop("reach")
    taken = whole.unionByName(split).groupBy("source", "pass").agg(F.max("key").alias("key"))
    last = taken.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pass", "key"))).alias("last"))
    last = last.withColumnRenamed("source", "_s")
    full = aims.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "n_docs")
    return cut_lineage(full.withColumn("last", F.transform("last", lambda p: p["key"])))


def copies(key: Column, last: Column) -> Column:
    """How often the mix takes a document: the passes whose cut-off its key does not exceed."""
    return F.coalesce(F.aggregate(last, F.lit(0), lambda n, k: n + (key <= k).cast("int")), F.lit(0))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, **columns) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document."""
    sizes = cut_lineage(sized(docs, **columns))
    cuts = cutoffs(sizes, weights, share, most).withColumnRenamed("source", "_s")
    met = sizes.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    return met.select("doc_id", "source", "size", "source_size", "target", copies(F.col("key"), F.col("last")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts stay where they are read."""
    cuts = cutoffs(cut_lineage(sized(docs, seed=seed)), weights, share, most)
    cuts = cuts.select(F.col("source").alias("_mix_source"), F.col("last").alias("_mix_last"))
    met = docs.join(cuts, F.col("source").eqNullSafe(F.col("_mix_source")))
    met = met.withColumn("_mix_n", copies(order_key(seed=seed), F.col("_mix_last"))).filter("_mix_n > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("_mix_copy")
    return met.select(*docs.columns, copy).drop("_mix_copy")
