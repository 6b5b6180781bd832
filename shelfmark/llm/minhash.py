"""Near-duplicate documents by SetSketch registers.

A document's sketch holds ``REGISTERS`` minima over its word shingles, one a hash function,
seen as exponential variates and truncated to exponentially spaced levels of base ``BASE``.
The sketch of a union is the registerwise maximum. Registers of similar sets are equal often,
so bands of them name buckets; pairs that meet in a bucket are judged by the joint likelihood
of how many registers are equal, greater and smaller, given both set sizes; groups of likely
pairs are verified on the full shingle sets.

Documents of equal sets stand behind one representative. A large bucket or group is cut into
blocks, and pairs of blocks are compared in tasks of their own. A task reports a spanning
forest of the links it found, never the pairs, so a group of n documents costs n rows. No
pair that meets in a bucket is left out.

``STRIPES`` bands of ``STRIPE`` registers bring a pair of similarity 0.85 together with a
probability of 1 - 6e-7, one of 0.8 with 1 - 5e-5; the likelihood test keeps pairs whose
estimate lies less than five standard deviations below the threshold.

Cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; texts repeated under one id are versions of one document
and share its component; a null id is kept and names no component; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import in_parts
from .common import WordHashes, ascii_lower, batches, rolling, whole_text
from .graph import components

REGISTERS, STRIPE, STRIPES = 128, 5, 25
BASE, RATE, TOP = 1.02, 20.0, 1200
BLOCK = 256
#: Shingles of one block of documents, at most about so many.
BLOCK_SHINGLES = 1 << 20

_RNG = np.random.default_rng(20240501)
_MULTIPLIERS = (_RNG.integers(0, 2**31, REGISTERS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.int64).astype(np.uint32)


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = ascii_lower(text).split()
    if not found:
        return np.zeros(0, np.uint64)
    x = hashes.of(found)
    if len(x) < words:
        return rolling(x, len(x), 1000 + len(x))
    return np.unique(rolling(x, words, words))


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers of a set: level of the least variate under each hash function, 0 for the empty set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    if not len(items):
        return np.zeros(REGISTERS, np.uint16)
    narrow = (items >> np.uint64(32)).astype(np.uint32)
    low = items.astype(np.uint32)
    for start in range(0, len(items), 512):
        x, y = narrow[start : start + 512, None], low[start : start + 512, None]
        h = (x * _MULTIPLIERS + _SHIFTS) ^ (y * _MULTIPLIERS[::-1])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    level = np.floor(1 - np.log(variate) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _slope(j, more, less, same, u, v):
    """Derivative by the similarity ``j`` of the log-likelihood of register comparisons.

    ``u`` and ``v`` are the shares of the two set sizes in their sum.
    """
    c = (BASE - 1) / BASE
    xu, xv = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    pu, pv = _chance(xu), _chance(xv)
    du = -v * c / (1 - xu * c) / np.log(BASE)
    dv = -u * c / (1 - xv * c) / np.log(BASE)
    rest = np.maximum(1 - pu - pv, 1e-12)
    return more * du / pu + less * dv / pv - same * (du + dv) / rest


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """The similarity of greatest likelihood, given both sketches and set sizes."""
    if not size_a or not size_b:
        return 0.0
    more, less = int((a > b).sum()), int((a < b).sum())
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    low, high = 0.0, min(u / v, v / u)
    for _ in range(40):
        middle = (low + high) / 2
        if _slope(middle, more, less, REGISTERS - more - less, u, v) > 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def likely(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may belong to sets of the wanted similarity.

    The likelihood has one peak, so an estimate lies above a bound where the slope there is positive.
    The test of sizes is the one of the verification, in whole numbers, so a share of exactly ``percent`` passes.
    """
    same = np.empty((len(a), len(b)), np.float64)
    more = np.empty_like(same)
    for i in range(len(a)):
        same[i] = (b == a[i]).sum(1)
        more[i] = (b < a[i]).sum(1)
    less = REGISTERS - same - more
    t = percent / 100
    bound = max(0.0, t - 5 * np.sqrt(t * (1 - t) / REGISTERS))
    total = sizes_a[:, None] + sizes_b[None, :]
    u, v = sizes_a[:, None] / total, sizes_b[None, :] / total
    small, large = np.minimum(sizes_a[:, None], sizes_b[None, :]), np.maximum(sizes_a[:, None], sizes_b[None, :])
    return (_slope(bound, more, less, same, u, v) >= 0) & (100 * small >= percent * large)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(linked)).min(1)
        new = np.minimum(root, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _forest(nodes: list, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    roots = local_roots(linked | linked.T)
    for i, r in enumerate(roots):
        if nodes[i] != nodes[r]:
            yield nodes[i], nodes[r]


def _groups(it, *names: str):
    """Runs of equal (key, i, j) in sorted rows, as ((key, i, j), rows of the other columns)."""
    now, held = None, []
    for columns in batches(it, "key", "i", "j", *names):
        for key, i, j, *rest in zip(*columns):
            if (key, i, j) != now:
                if now is not None:
                    yield now, held
                now, held = (key, i, j), []
            held.append(rest)
    if now is not None:
        yield now, held


def _between(own: list[int], i: int, j: int) -> np.ndarray | None:
    """Pairs to be compared: all of one block, or those across two; None if there are none."""
    side = np.array(own)
    if i == j:
        return None if len(side) < 2 else ~np.eye(len(side), dtype=bool)
    across = side[:, None] != side[None, :]
    return across if across.any() else None


def _likely_forest(rows, percent: int) -> Iterator[tuple[int, int]]:
    for (_, i, j), held in _groups(rows, "own", "node", "size", "registers"):
        allowed = _between([h[0] for h in held], i, j)
        if allowed is None:
            continue
        x = np.array([np.frombuffer(h[3], "<u2") for h in held])
        sizes = np.array([h[2] for h in held], np.float64)
        yield from _forest([h[1] for h in held], likely(x, sizes, x, sizes, percent) & allowed)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets have in common: a product of indicator matrices, in column blocks."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], np.int64)
    items, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    useful = counts > 1
    place = np.cumsum(useful) - 1
    keep = useful[codes]
    owner, column = owner[keep], place[codes[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((n, n), np.float64), 4096
    edges = np.searchsorted(column, np.arange(0, int(useful.sum()) + width, width))
    for k in range(len(edges) - 1):
        at = slice(edges[k], edges[k + 1])
        block = np.zeros((n, width), np.float32)
        block[owner[at], column[at] - k * width] = 1
        total += block @ block.T  # exact: at most 4096 ones a product
    return total.astype(np.int64)


def _verified_forest(rows, percent: int) -> Iterator[tuple[int, int]]:
    for (_, i, j), held in _groups(rows, "own", "node", "items"):
        allowed = _between([h[0] for h in held], i, j)
        if allowed is None:
            continue
        sets = [np.frombuffer(h[2], "<u8") for h in held]
        common = shared_counts(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        yield from _forest([h[1] for h in held], (100 * common >= percent * union) & allowed)


def _in_blocks(rows: DataFrame, counts: DataFrame, blocks) -> DataFrame:
    """``rows`` (key, node) once for each pair of blocks of its key that they take part in."""
    placed = rows.join(counts.select("key", blocks.cast("int").alias("blocks")), "key")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    placed = placed.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return placed.select("key", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _edges(rows: DataFrame, forest, percent: int) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    ordered = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")
    return ordered.mapInArrow(lambda it: in_parts(forest(it, percent), schema), "u long, v long")


def marked(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, class2, registers) of every row; a null class has no shingles."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("class2", pa.int64()), ("registers", pa.binary())]
    )

    def rows(it):
        import xxhash

        hashes = WordHashes()
        for ids, texts in batches(it, "doc_id", "text"):
            for doc, text in zip(ids, texts):
                items = shingles(text, words, hashes)
                if not len(items):
                    yield doc, 0, None, None, None
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), "<i8")
                yield doc, len(items), int(digest[0]), int(digest[1]), sketch(items).tobytes()

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return held.mapInArrow(
        lambda it: in_parts(rows(it), schema),
        "doc_id long, n_shingles long, class long, class2 long, registers binary",
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the wanted documents only."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def rows(it):
        hashes = WordHashes()
        for ids, texts in batches(it, "node", "text"):
            for node, text in zip(ids, texts):
                items = shingles(text, words, hashes)
                if len(items):
                    yield node, items.tobytes()

    held = docs.select(F.col(id_col).cast("long").alias("node"), whole_text(text_col).alias("text"))
    return held.join(wanted, "node", "left_semi").mapInArrow(lambda it: in_parts(rows(it), schema), "node long, items binary")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by shared shingles of at least ``percent`` of all."""
    marks = cut_lineage(marked(docs, words, id_col, text_col))
    members = marks.select("doc_id", "n_shingles", "class", "class2")
    grouped = marks.filter("class is not null").groupBy("class", "class2")
    classes = cut_lineage(
        grouped.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers"))
    )
    nodes = classes.filter("node is not null").select("node", "size", "registers")
    bands = F.array(
        *(
            F.xxhash64(F.lit(n), F.substring(F.col("registers"), n * STRIPE * 2 + 1, STRIPE * 2))
            for n in range(STRIPES)
        )
    )
    buckets = nodes.select("node", F.explode(bands).alias("key"))
    counts = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = _in_blocks(buckets, counts, F.ceil(F.col("n") / BLOCK))
    met = placed.join(nodes, "node")
    candidates = cut_lineage(_edges(met, _likely_forest, percent).distinct())
    groups = cut_lineage(components(candidates).select(F.col("component").alias("key"), F.col("id").alias("node")))
    sets = cut_lineage(_full_sets(docs, groups.select("node"), words, id_col, text_col))
    sizes = nodes.select("node", "size")
    counts = groups.join(sizes, "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    links = cut_lineage(_edges(_in_blocks(groups, counts, blocks).join(sets, "node"), _verified_forest, percent).distinct())
    named = components(links).select(F.col("id").alias("node"), "component")
    of_class = classes.select(F.col("class").alias("_c"), F.col("class2").alias("_d"), "node").join(named, "node", "left")
    of_class = of_class.select("_c", "_d", F.coalesce("component", "node").alias("component_id"))
    met = members.join(of_class, (F.col("class") == F.col("_c")) & (F.col("class2") == F.col("_d")), "left")
    component = F.coalesce("component_id", "doc_id")
    return met.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
