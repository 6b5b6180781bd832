"""A trie of conversation prefixes, kept as tables of slots under a minimal perfect hash.

A conversation is followed turn by turn as a stream and every prefix gets a digest chained from
that of the prefix before; the texts stay where they are, only digests and sizes travel. Distinct
digests are counted before they are shuffled. The trie is then cut below its *wide* nodes, those
with more prefixes beneath than a shard should hold (the root always), so that one common first
turn is spread over many shards and each shard is bounded. In a shard all digests get slots of a
minimal perfect hash, each slot is checked against the digest it was given to, values are
scattered into flat arrays, and sums run from the deepest level up through an array of parent
slots. Wide nodes get the totals of the shards below them and form a shard of their own; only if
they are too many for one (some ``depth * rows / SHARD``) they are summed a level at a time.

Digests have 128 bits. The hash of the ids that end at a node is SHA-256 over one string, which
cannot be split; the string is prepared in chunks by many tasks and only the hashing itself, a
few bytes an id, runs through one task a node, as a stream.

Cases: turns are ordered by turn, null first, and rows of one turn by the digest of role and text;
null role or text is empty; rows without a conversation id belong to no conversation and are left
out; ``c % 5`` keeps the sign of c, as in SQL; rows repeated are turns of their own; other columns
of the input are ignored; an empty table gives an empty result. A conversation of any length is
streamed through the task that follows it, since each of its prefixes needs the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import in_parts
from .common import batches, mix64

#: Prefixes beneath a node above which it counts as wide, and about the rows of a table of slots.
SHARD = 200_000
#: Conversation ids of one prepared chunk of a hash.
CHUNK = 4096
#: Conversations share the first turns of the one whose id starts their group of this many.
GROUP = 5
SHARED_TURNS = 9

_STEPS = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, size long, length long"
_STEPS_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in _STEPS.split(", ")])
_SUMS = "hi long, lo long, n_children long, n_leaves long, saved long, up_conv long"
_SUMS_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in _SUMS.split(", ")])
#: The columns of a node in a shard; the last three are totals of nodes below that are not in it.
_NODES = ("top_hi", "top_lo", "hi", "lo", "up_hi", "up_lo", "depth", "conv_id", "n", "size", "children", "leaves", "saved")
_ROOT = (0, 0)


class Slots:
    """A minimal perfect hash over distinct 128-bit digests, level by level.

    On each level the digests left over pick a place; those alone at theirs keep it, the others go
    on. The slot is the rank of the place among all places taken.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = self._mixed(hi, lo)
        base = 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("digests of a shard are not distinct")
            n = len(left) * 2 + 1
            place = self._place(left, len(self.levels), n)
            alone = np.bincount(place, minlength=n) == 1
            # Rank of each taken place, and -1 where nothing stands.
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            base += int(alone.sum())
            left = left[~alone[place]]
        self.size = base
        self.hi, self.lo = np.zeros(base, np.int64), np.zeros(base, np.int64)
        slots = self._find(hi, lo)
        if len(np.unique(slots)) != len(hi) or base != len(hi):
            raise ValueError("digests of a shard do not fill its slots one to one")
        self.hi[slots], self.lo[slots] = hi, lo

    @staticmethod
    def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return mix64(mix64(hi.view(np.uint64)) + lo.view(np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1))
        return (mix64(keys ^ seed) % np.uint64(n)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        keys = self._mixed(hi, lo)
        slots = np.full(len(keys), -1, np.int64)
        for level, rank in enumerate(self.levels):
            open_ = np.flatnonzero(slots < 0)
            slots[open_] = rank[self._place(keys[open_], level, len(rank))]
        return slots

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the slot belongs to another or to none."""
        slots = self._find(hi, lo)
        if not self.size:
            return slots
        own = (slots >= 0) & (self.hi[slots] == hi) & (self.lo[slots] == lo)
        return np.where(own, slots, -1)


def summed(hi, lo, up_hi, up_lo, depth, conv_id, n, size, children, leaves, saved) -> tuple[np.ndarray, ...]:
    """(n_children, n_leaves, saved, parent's conv or -1) of the nodes of whole subtrees.

    The last three are totals of what lies below and is not given here.
    """
    slots = Slots(hi, lo)
    at, up = slots.of(hi, lo), slots.of(up_hi, up_lo)
    parent, least = np.empty(slots.size, np.int64), np.empty(slots.size, np.int64)
    below, ends_here, spared = (np.empty(slots.size, np.int64) for _ in range(3))
    parent[at], least[at], below[at], ends_here[at], spared[at] = up, conv_id, children, leaves, saved + (n - 1) * size
    below += np.bincount(parent[parent >= 0], minlength=slots.size)
    ends_here[below == 0] = 1
    order = np.argsort(-depth, kind="stable")
    # Deepest level first: all sums below a node are complete before its own moves up.
    for level in np.split(at[order], np.flatnonzero(np.diff(-depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(ends_here, parent[level], ends_here[level])
        np.add.at(spared, parent[level], spared[level])
    return below[at], ends_here[at], spared[at], np.where(up >= 0, least[up], -1)


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns as digests, those of a group of conversations together and its first conversation first."""
    said = lambda name: F.coalesce(F.col(name), F.lit(""))
    text, role = said("text"), said("role")
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    conv = F.col("conv_id").cast("long")
    rows = conversations.filter(conv.isNotNull()).select(
        (conv - conv % GROUP).alias("family"),
        conv.alias("conv_id"),
        F.col("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        (F.crc32(conv.cast("string")) % SHARED_TURNS).alias("head"),
    )
    counted = rows.repartition("family").withColumn("n", F.count("*").over(Window.partitionBy("family", "conv_id")))
    later = (F.col("conv_id") != F.col("family")).alias("later")
    return counted.sortWithinPartitions("family", later, "conv_id", F.asc_nulls_first("turn"), "digest")


def _followed(it) -> Iterator[tuple]:
    """Every prefix of every rebuilt conversation, with the digest of the prefix before."""

    def rows():
        for columns in batches(it, "family", "conv_id", "digest", "size", "head", "n"):
            yield from zip(*columns)

    family, first = None, []
    for (of, conv), turns in groupby(rows(), key=lambda r: r[:2]):
        if of != family:
            family, first = of, []
        leads = of == conv
        hi, lo, depth, length = *_ROOT, 0, None

        def step(digest, size):
            nonlocal hi, lo, depth
            made = hashlib.blake2b(hi.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big", signed=True) + digest, digest_size=16)
            up = hi, lo
            hi, lo = (int.from_bytes(made.digest()[i : i + 8], "big", signed=True) for i in (0, 8))
            depth += 1
            return conv, depth, hi, lo, *up, size, length

        for place, (_, _, digest, size, head, n) in enumerate(turns):
            if leads and place < SHARED_TURNS:
                first.append((digest, size))
            if length is None:
                given = [] if leads else first[:head]
                length = n if leads else len(given) + max(0, n - head)
                yield conv, 0, *_ROOT, None, None, 0, length
                yield from (step(*turn) for turn in given)
            if leads or place >= head:
                yield step(digest, size)


def _digest_ends(rows) -> Iterator[tuple]:
    """(hi, lo, hash) of chunks sorted by node and first id."""
    for (hi, lo), chunks in groupby(rows, key=lambda r: r[:2]):
        digest = hashlib.sha256()
        for number, (_, _, text) in enumerate(chunks):
            digest.update((b"," if number else b"") + text.encode())
        yield hi, lo, digest.hexdigest()


def ends(steps: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which conversations end."""
    key = ["hi", "lo"]
    rows = steps.filter(F.col("depth") == F.col("length")).select(*key, "conv_id")
    sorted_rows = rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunk_schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
    end_schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])

    def chunks(it):
        held, node = [], None
        for columns in batches(it, "hi", "lo", "conv_id"):
            for hi, lo, conv in zip(*columns):
                if held and (node != (hi, lo) or len(held) >= CHUNK):
                    yield *node, held[0], ",".join(map(str, held))
                    held = []
                node = hi, lo
                held.append(conv)
        if held:
            yield *node, held[0], ",".join(map(str, held))

    prepared = sorted_rows.mapInArrow(lambda it: in_parts(chunks(it), chunk_schema), "hi long, lo long, first long, text string")
    together = prepared.repartition(*key).sortWithinPartitions(*key, "first")

    def hashed(it):
        return in_parts(_digest_ends(r for c in batches(it, "hi", "lo", "text") for r in zip(*c)), end_schema)

    return together.mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def _shards(it, size: int) -> Iterator[pa.RecordBatch]:
    """Sums of the nodes of one task, whole shards at a time and about ``size`` rows together."""
    waiting: list[np.ndarray] = []

    def flush(held: np.ndarray):
        own = dict(zip(_NODES, held))
        made = summed(**{k: own[k] for k in _NODES[2:]})
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (own["hi"], own["lo"], *made)], schema=_SUMS_ARROW)

    for batch in it:
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in _NODES]
        waiting.append(np.array(columns, np.int64))
        if sum(c.shape[1] for c in waiting) >= size:
            held = np.concatenate(waiting, axis=1)
            # The last shard may go on in the next batch.
            last = int(np.argmax((held[:2] == held[:2, -1:]).all(axis=0)))
            if last:
                yield flush(held[:, :last])
            waiting = [held[:, last:]]
    if waiting and sum(c.shape[1] for c in waiting):
        yield flush(np.concatenate(waiting, axis=1))


def nodes(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations."""
    key, up_key = ["hi", "lo"], ["up_hi", "up_lo"]
    steps = cut_lineage(_turns(conversations).mapInArrow(lambda it: in_parts(_followed(it), _STEPS_ARROW), _STEPS))
    # Of equal conversations one counts for what lies beneath a node; copies make no trie wide.
    firsts = steps.filter(F.col("depth") == F.col("length")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    marked = steps.join(firsts.select("conv_id", F.lit(True).alias("first")), "conv_id", "left")
    beneath = F.sum(F.when(F.col("first"), F.col("length") - F.col("depth") + 1))
    distinct = marked.groupBy(*key).agg(
        F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("size").alias("size"),
        ((beneath > shard) | (F.max("depth") == 0)).alias("wide"),
    )
    distinct = cut_lineage(distinct)
    wide, narrow = distinct.filter("wide"), distinct.filter("not wide")
    n_wide, deepest = wide.agg(F.count("*"), F.max("depth")).first()

    # The highest node that is not wide names the shard; the least conversation of any node below passes it.
    above = wide.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("wide_conv"))
    tops = narrow.join(above, up_key).select(*key, F.col("hi").alias("top_hi"), F.col("lo").alias("top_lo"), "wide_conv")
    near = steps.filter(F.col("depth").between(1, (deepest or 0) + 1)).select("conv_id", *key)
    path = near.join(tops, key).select("conv_id", "top_hi", "top_lo")
    none = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    placed = narrow.join(path, "conv_id").select(*_NODES[:-3], *none)
    placed = placed.repartition("top_hi", "top_lo").sortWithinPartitions("top_hi", "top_lo")
    below = placed.mapInArrow(lambda it: _shards(it, shard), _SUMS)
    done = narrow.join(below, key).join(tops.select(*key, "wide_conv"), key, "left")
    # The parent of a shard's top is in no shard.
    parent, top = F.coalesce("wide_conv", "up_conv").alias("parent"), F.col("wide_conv").isNotNull().alias("top")
    done = cut_lineage(done.select(*key, *up_key, "depth", "conv_id", "n", parent, "n_children", "n_leaves", "saved", top))
    # Wide nodes take what the shards below them sum up to, then hand it upwards among themselves.
    totals = [F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved")]
    sums = cut_lineage(done.filter("top").groupBy(*up_key).agg(*totals))
    levels = [wide] if n_wide <= shard else [wide.filter(F.col("depth") == d) for d in range(deepest, -1, -1)]
    finished = done.drop(*up_key, "top")
    for number, level in enumerate(levels):
        got = sums if not number else sums.unionByName(level_done.groupBy(*up_key).agg(*totals))  # noqa: F821
        got = got.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
            *(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))
        )
        rows = level.join(got, key, "left").fillna(0, ["children", "leaves", "saved"]).fillna(-1, up_key)
        one = rows.select(*(F.lit(0).cast("long").alias(c) for c in ("top_hi", "top_lo")), *_NODES[2:])
        # All wide nodes are one shard where they fit one; nodes of one level need nothing from each other.
        one = one.repartition(1) if len(levels) == 1 else one
        made = one.mapInArrow(lambda it: _shards(it, shard + 1), _SUMS)
        parents = above.select(F.col("up_hi"), F.col("up_lo"), F.col("wide_conv").alias("parent"))
        level_done = cut_lineage(
            level.join(made, key).join(parents, up_key, "left")
            .select(*key, *up_key, "depth", "conv_id", "n", "parent", "n_children", "n_leaves", "saved")
        )
        finished = finished.unionByName(level_done.drop(*up_key))
    return finished.join(ends(steps), key, "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
