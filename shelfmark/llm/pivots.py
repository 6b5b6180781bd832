"""Embedding near-duplicates through an index of pivot permutations.

A vector is described by its ``NEAREST`` nearest reference points out of ``PIVOTS``. Vectors
that share ``SHARED`` of them are candidates: every choice of that many names an inverted list,
so two vectors meet in a list exactly if they share so many. Candidates are verified by their
cosine in double precision. A pair that meets in several lists counts in the first alone.

Equal vectors stand behind one representative. A long list is cut into blocks and pairs of
blocks are compared, each in a task of its own; what leaves a task is a row a vector (how many
links, which local component), never the pairs.

The reference points come from a sample of ``SAMPLE`` vectors, those of least digest, of which
no two kept ones are alike, filled up with fixed random directions. That is the only part
fitted on a sample; all vectors are indexed. Pairs of cosine 0.95 meet with a chance of about
0.98, closer ones more surely (tests measure it against brute force).

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of other lengths than the usual one are compared within their own length;
rows repeated under one id are copies of each other; a null id is kept and is never a
component's name but its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import in_parts
from .common import batches
from .graph import components
from .minhash import local_roots

PIVOTS, NEAREST, SHARED = 128, 6, 3
SAMPLE, APART = 4096, 0.6
BLOCK = 512
COSINE = 0.95


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def choose(sample: np.ndarray, pivots: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """Reference points: sampled vectors no two of which are alike, then random directions."""
    kept = np.zeros((0, sample.shape[1]))
    for x in unit(sample) if len(sample) else sample:
        if len(kept) == pivots:
            break
        if not len(kept) or (kept @ x).max() < APART:
            kept = np.vstack([kept, x])
    more = np.random.default_rng(seed).normal(size=(pivots - len(kept), sample.shape[1]))
    return np.vstack([kept, unit(more)]) if len(more) else kept


def nearest(vectors: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """The pivots nearest to each vector, as sorted sets."""
    alike = vectors @ pivots.T
    top = np.argpartition(-alike, count - 1, axis=1)[:, :count]
    return np.sort(top, axis=1)


def _classes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, class, vector): a digest of the vector, null where it cannot link."""
    x = F.col(vector_col).cast("array<double>")
    plain = F.transform(x, lambda v: v + F.lit(0.0))  # -0.0 becomes 0.0
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fine = fine & F.exists(x, lambda v: v != 0)
    digest = F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(plain))
    second = F.when(digest.isNotNull(), F.hash(plain))
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"), digest.alias("class"), second.alias("class2"),
        F.when(digest.isNotNull(), plain).alias("vector"),
    )


def _lists(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(list, rep) for every list a representative stands in."""
    schema = pa.schema([("list", pa.int64()), ("rep", pa.int64())])
    places = np.array(list(combinations(range(NEAREST), SHARED)))

    def run(it):
        for ids, vectors in batches(it, "rep", "vector"):
            lengths = np.array([len(v) for v in vectors])
            ids = np.array(ids, np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = unit(np.array([vectors[i] for i in at]))
                sets = nearest(x, pivots[int(length)]).astype(np.int64)
                keys = np.full((len(at), len(places)), int(length), np.int64)
                for place in range(SHARED):
                    keys = keys * PIVOTS + sets[:, places[:, place]]
                out = {"list": keys.ravel(), "rep": np.repeat(ids[at], len(places))}
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return reps.select("rep", "vector").mapInArrow(run, "list long, rep long")


def compare(name: int, a, b, pivots: np.ndarray, cosine: float = COSINE) -> Iterator[tuple[int, int, int]]:
    """(rep, links, root) within one block, or between two, of the list ``name``.

    A block is (reps, sizes, unit vectors). Only pairs whose first shared list this is count as links.
    """
    ids, sizes, x = (np.concatenate(p) for p in zip(a, b)) if b is not None else a
    alike = x @ x.T
    linked = alike >= cosine
    np.fill_diagonal(linked, False)
    if b is not None:
        n = len(a[0])
        linked[:n, :n] = linked[n:, n:] = False
    if not linked.any():
        return
    chosen = []
    for _ in range(SHARED):
        name, pivot = divmod(name, PIVOTS)
        chosen.append(pivot)
    near = np.flatnonzero(linked.any(1))
    holds = np.zeros((len(ids), PIVOTS), np.float32)
    sets = nearest(x[near], pivots)
    holds[near[:, None], sets] = 1
    holds[:, max(chosen) :] = 0
    holds[:, chosen] = 0
    first = linked & ((holds @ holds.T) == 0)
    links = first @ sizes
    roots = local_roots(linked)
    for i in near:
        yield int(ids[i]), int(links[i]), int(ids[roots[i]])


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``rows``."""
    spark = rows.sparkSession
    classed = _classes(rows, id_col, vector_col)
    members = cut_lineage(classed.select("vec_id", "class", "class2"))
    grouped = classed.filter("class is not null").groupBy("class", "class2")
    reps = grouped.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    # Two different vectors never share an id here: ids that repeat are told apart by their class.
    reps = cut_lineage(reps.select("class", "class2", F.col("rep").alias("first_id"), F.xxhash64("class", "class2").alias("rep"), "size", "vector"))
    lengths = [r[0] for r in reps.select(F.size("vector")).distinct().collect()]
    pivots = {}
    for length in lengths:
        of_length = reps.filter(F.size("vector") == length)
        sampled = of_length.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").collect()
        pivots[length] = choose(np.array([r[0] for r in sampled], np.float64).reshape(-1, length))
    shared = spark.sparkContext.broadcast(pivots)
    lists = cut_lineage(_lists(reps, pivots))
    counts = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "list"), F.col("blocks")).cast("int")
    placed = lists.join(counts.withColumn("blocks", blocks), "list").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("list", "rep", "own", other)
    pairs = placed.select(
        "list", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    full = pairs.join(reps.select("rep", "size", "vector"), "rep")
    ordered = full.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "own")
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def groups(it):
        now, held = None, []
        for columns in batches(it, "list", "i", "j", "own", "rep", "size", "vector"):
            for name, i, j, mine, rep, size, vector in zip(*columns):
                if (name, i, j) != now:
                    if now is not None:
                        yield now, held
                    now, held = (name, i, j), []
                held.append((mine, rep, size, vector))
        if now is not None:
            yield now, held

    def found(it):
        for (name, i, j), held in groups(it):
            sides = []
            for side in (i,) if i == j else (i, j):
                part = [h for h in held if h[0] == side]
                if part:
                    ids = np.array([h[1] for h in part], np.int64)
                    sizes = np.array([h[2] for h in part], np.int64)
                    sides.append((ids, sizes, unit(np.array([h[3] for h in part]))))
            if len(sides) == (1 if i == j else 2):
                length = sides[0][2].shape[1]
                yield from compare(name, sides[0], sides[1] if i != j else None, shared.value[length], cosine)

    out = cut_lineage(ordered.mapInArrow(lambda it: in_parts(found(it), schema), "rep long, links long, root long"))
    links = out.groupBy("rep").agg(F.sum("links").alias("links"))
    # Components are named by vector ids, so nodes are the first ids of the classes.
    firsts = reps.select(F.col("rep").alias("_rep"), "first_id")
    edges = out.filter("rep <> root").select("rep", "root").distinct()
    edges = edges.join(firsts, F.col("rep") == F.col("_rep")).select(F.col("first_id").alias("u"), "root")
    edges = edges.join(firsts, F.col("root") == F.col("_rep")).select("u", F.col("first_id").alias("v"))
    named = components(edges)
    stats = (
        reps.select("class", "class2", "rep", "size", "first_id")
        .join(links, "rep", "left")
        .join(named.withColumnRenamed("id", "first_id"), "first_id", "left")
        .select(
            F.col("class").alias("_c"), F.col("class2").alias("_d"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "first_id").alias("component_id"),
        )
    )
    met = members.join(stats, (F.col("class") == F.col("_c")) & (F.col("class2") == F.col("_d")), "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
