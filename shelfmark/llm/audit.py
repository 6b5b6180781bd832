"""How five document filters interact, over all orders in which they may be applied.

Four filters look at one text. The fifth, exact repeats, needs all texts: they are inserted whole
into compressed (radix) tries whose terminals hold the smallest id. Each input task first builds
tries of its own share, so of a group of copies one row a share leaves the task. What is left is
range-partitioned by adaptive prefixes: the first 16 characters of a text, or 64, 256 and so on
where more texts share them than a partition should hold. Each range then builds one trie and
walks it. What a row fails is a mask of five bits; masks are counted, and only those counts meet
the orders of the filters.

Cases: a null text counts as empty, and all empty texts are identical; rows repeated under one id
are not repeats of each other, but all of them count; a null id is neither smaller nor greater than
another, so its rows fail no repeat test and cause none; a null ``lang`` is the part of the empty
string; several label rows of one id count as 1 where any of them is 1, rows without labels as 0;
other columns of the input are ignored; an empty table gives an empty result. A very long text is
cut into words a few megabytes at a time; its distinct words and the text itself are held by a task.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import in_parts
from .common import batches, whole_text

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]

#: Bytes of text that an input task holds in a trie before it starts another.
SHARE_BYTES = 24 << 20
#: Bytes of text that a range should hold.
RANGE_BYTES = 16 << 20
FIRST_PREFIX = 16
STRETCH = 4 << 20

_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_SYMBOL = re.compile(rb"[#$%&*|]")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

_HELD = "doc_id long, part string, mask int, n long, text binary"
_HELD_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())]
)


class Node:
    """A run of bytes, the nodes below by their first byte, and what ends here: the least id and its rows."""

    __slots__ = ("label", "below", "least", "rows", "mask")

    def __init__(self, label: bytes):
        self.label, self.below = label, {}
        self.least, self.rows, self.mask = None, None, 0


class RadixTrie:
    """Whole texts as bytes, with the smallest id of each at its terminal."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                return child
            label = child.label
            if not text.startswith(label, at):
                shared = common_length(label, text, at)
                upper = Node(label[:shared])
                child.label = label[shared:]
                upper.below[child.label[0]] = child
                node.below[text[at]] = child = upper
            node, at = child, at + len(child.label)
        return node

    def insert(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> list[tuple]:
        """Add rows of one text; returns the (doc_id, part, mask, n) that are now known to be repeats."""
        end = self.terminal(text)
        if end.rows is None:
            end.least, end.rows, end.mask = doc_id, Counter(), mask
        elif doc_id > end.least:
            return [(doc_id, part, mask | REPEAT, n)]
        out = []
        if doc_id < end.least:
            out = [(end.least, p, end.mask | REPEAT, m) for p, m in end.rows.items()]
            end.least, end.rows = doc_id, Counter()
        end.rows[part] += n
        return out

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """(text, node) of all terminals, in the order of their bytes within each run."""
        waiting = [(b"", self.root)]
        while waiting:
            above, node = waiting.pop()
            text = above + node.label
            if node.rows is not None:
                yield text, node
            waiting += [(text, node.below[k]) for k in sorted(node.below, reverse=True)]


def common_length(label: bytes, text: bytes, at: int) -> int:
    """How many leading bytes ``label`` shares with ``text`` from ``at``; not all of them."""
    low, high = 0, len(label) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text, cut a stretch at a time."""
    if len(text) <= STRETCH:
        words = text.split()
        return len(words), len(set(words))
    n, distinct, at = 0, set(), 0
    while at < len(text):
        blank = _BLANK.search(text, at + STRETCH)
        end = blank.start() if blank else len(text)
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end + 1
    return n, len(distinct)


def own_mask(text: bytes, n_chars: int) -> int:
    """The filters that a text fails by itself: too short, too repetitive, too loud, odd symbols."""
    words, distinct = word_counts(text)
    upper = len(text.translate(None, _NOT_UPPER))
    fails = (words < 200, 100 * distinct < 50 * words, 100 * upper > 3 * n_chars, _SYMBOL.search(text) is not None)
    return sum(1 << n for n, failed in enumerate(fails) if failed)


def _shares(it) -> Iterator[tuple]:
    """Rows of one input task: settled ones without a text, the first of each text with it."""
    trie, held, without_id = RadixTrie(), 0, Counter()

    def left():
        for text, end in trie.terminals():
            yield from ((end.least, part, end.mask, n, text) for part, n in end.rows.items())

    for ids, parts, sizes, texts in batches(it, "doc_id", "part", "n_chars", "text"):
        for doc_id, part, n_chars, text in zip(ids, parts, sizes, texts):
            mask = own_mask(text, n_chars)
            if doc_id is None:
                without_id[part, mask] += 1
                continue
            for row in trie.insert(text, doc_id, part, mask, 1):
                yield (*row, None)
            held += len(text)
            if held >= SHARE_BYTES:
                yield from left()
                trie, held = RadixTrie(), 0
    yield from left()
    yield from ((None, part, mask, n, None) for (part, mask), n in without_id.items())


def _ranges(it) -> Iterator[tuple]:
    """Rows of one range of texts, all of them settled."""
    trie = RadixTrie()
    for ids, parts, masks, counts, texts in batches(it, "doc_id", "part", "mask", "n", "text"):
        for doc_id, part, mask, n, text in zip(ids, parts, masks, counts, texts):
            for row in trie.insert(text, doc_id, part, mask, n):
                yield (*row, None)
    for _, end in trie.terminals():
        yield from ((end.least, part, end.mask, n, None) for part, n in end.rows.items())


def by_adaptive_prefix(held: DataFrame, range_bytes: int) -> DataFrame:
    """Rows range-partitioned by ``prefix``: short, but longer where many bytes share it.

    Identical texts always have the same prefix, so they meet in one range.
    """
    size = F.octet_length("text")
    total, longest = held.agg(F.sum(size), F.max(F.length(F.col("text").cast("string")))).first()
    chars = F.col("text").cast("string")
    out, length = held.withColumn("prefix", F.substring(chars, 1, FIRST_PREFIX)), FIRST_PREFIX
    while length < (longest or 0):
        shared = out.groupBy("prefix").agg(F.sum(size).alias("_bytes")).filter(F.col("_bytes") > range_bytes)
        shared = cut_lineage(shared.select("prefix", F.lit(True).alias("_shared")))
        if shared.isEmpty():
            break
        length *= 4
        longer = F.when(F.col("_shared"), F.substring(chars, 1, length)).otherwise(F.col("prefix"))
        out = out.join(shared, "prefix", "left").withColumn("prefix", longer).drop("_shared")
    return out.repartitionByRange(max(1, -(-(total or 0) // range_bytes)), "prefix")


def failures(
    docs: DataFrame, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id fail which filters; bit 0 is A, bit 4 is E."""
    text = whole_text(text_col)
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.length(text).cast("long").alias("n_chars"),
        text.cast("binary").alias("text"),
    )
    # Written once: the ranges are drawn from it, and the texts are not judged a second time.
    shares = cut_lineage(read.mapInArrow(lambda it: in_parts(_shares(it), _HELD_ARROW), _HELD))
    spread = by_adaptive_prefix(shares.filter("text IS NOT NULL"), range_bytes)
    ranged = spread.drop("prefix").mapInArrow(lambda it: in_parts(_ranges(it), _HELD_ARROW), _HELD)
    return shares.filter("text IS NULL").unionByName(ranged).drop("text")


def _bits(holds) -> Column:
    """The mask of the filters of which ``holds(letter)`` is true."""
    one = [F.when(holds(letter), F.lit(1 << n)).otherwise(F.lit(0)) for n, letter in enumerate(FILTERS)]
    return sum(one[1:], one[0])


def interactions(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a part, order of the filters and step, from the masks of ``failures``."""
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = failed.join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    orders = F.split(F.lit(",".join(ORDERS)), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    mask, n = F.col("mask"), F.col("n")
    here = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bit, earlier = _bits(lambda x: here == x), _bits(lambda x: F.instr("filter_order", x) < F.col("step"))
    fails, fresh = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) == 0
    count = lambda test, times=n: F.sum(F.when(test, times).otherwise(F.lit(0))).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        count(fresh & ~fails).alias("kept"),
        count(fresh & fails).alias("removed"),
        count(~fresh & fails).alias("redundant"),
        count(mask == bit).alias("unique_fails"),
        count(fresh & fails & F.col("good")).alias("good_lost"),
        count(fresh & fails & F.col("toxic")).alias("toxic_lost"),
        # A filter comes first among the k that a row fails in one order of k.
        count(fails, n * F.floor(F.lit(len(ORDERS)) / F.bit_count(mask))).alias("shapley"),
    )
