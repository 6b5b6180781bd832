"""Exact-substring deduplication with fixed-block anchors.

Every document is cut into blocks of ``BLOCK`` words that do not overlap; these are the
reference index. A passage of ``WINDOW`` >= 2 * ``BLOCK`` - 1 words holds a whole block of each
document it stands in, so probing the index with every rolling window of ``BLOCK`` words meets
every shared passage. Where a probe hits a block of another document, the passages of
``WINDOW`` words around the hit are compared by their own hashes; runs of repeated passages are
the maximal exact repeats. A word goes if a passage over it also starts in a document of
smaller id.

Nothing is paired: hits and passages are summed up by hash, so a passage that all documents
share costs one entry a batch of texts. Texts are read in batches of the table's own order;
what a batch asks of the index are packed arrays of distinct hashes, a row for each bucket of
the hash space, and the answers are bits in the same order. Buckets grow in number with the
corpus, so each fits in a task's memory. ``docs`` is read twice and must come in the same order
both times, as a table of files does; a batch whose answers do not fit its questions raises.

Hashes of probes may collide (a false hit only costs a comparison); passages are told apart by
64 bits and their bucket.

Cases: null and empty texts have no words; a null id counts as larger than all others; rows
of one id do not count against each other; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import in_parts
from .common import WordHashes, batches, mix64, rolling, whole_text

BLOCK, WINDOW = 25, 50
#: Bytes of text handled together by a task.
BATCH_BYTES = 4 << 20
#: Characters of text whose hashes share a bucket, and the least number of buckets.
BUCKET_CHARS, LEAST_BUCKETS = 16_000_000, 512
CODE_BITS = 30
NO_ID = np.iinfo(np.int64).max


@dataclass
class Batch:
    name: int
    ids: np.ndarray
    words: list[list[bytes]]
    hashes: np.ndarray
    starts: np.ndarray  # of each document among all words, and their end

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


def _named(ids: np.ndarray, texts: list[bytes]) -> int:
    """A batch's name: a digest of its ids and texts."""
    import xxhash

    digest = xxhash.xxh3_64(ids.tobytes())
    for t in texts:
        digest.update(len(t).to_bytes(8, "little"))
        digest.update(t)
    return digest.intdigest() - (1 << 63)


def make_batch(ids: np.ndarray, texts: list[bytes], kept: WordHashes, name: int | None = None) -> Batch:
    words = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    hashes = kept.of([w for doc in words for w in doc])
    return Batch(_named(ids, texts) if name is None else name, ids, words, hashes, starts)


def _cut(it) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids, texts, size = [], [], 0
    for docs, found in batches(it, "doc_id", "text"):
        for doc, text in zip(docs, found):
            raw = text.encode("utf-8", "surrogatepass")
            ids.append(NO_ID if doc is None else doc)
            texts.append(raw)
            size += len(raw)
            if size >= BATCH_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _windows(batch: Batch, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all windows that lie within one document."""
    h = rolling(batch.hashes, width, seed)
    owner = batch.owner
    places = np.flatnonzero(owner[: len(h)] == owner[width - 1 : width - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    return places, h[places]


def _buckets(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


@dataclass
class Probes:
    places: np.ndarray
    #: For each place its entry among the batch's distinct hashes, which are ordered by bucket and code.
    entry: np.ndarray
    buckets: np.ndarray
    codes: np.ndarray
    flags: np.ndarray


def probes(batch: Batch, count: int, block: int) -> Probes:
    """All rolling windows of a batch; flag 1: a block of the index, flag 2: in several documents here."""
    places, hashes = _windows(batch, block, block)
    owner = batch.owner
    docs = owner[places]
    anchor = (places - batch.starts[docs]) % block == 0
    key = (_buckets(hashes, count) << np.uint64(CODE_BITS)) | (hashes & np.uint64((1 << CODE_BITS) - 1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    entry = np.empty(len(key), np.int64)
    entry[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(key)]])))
    flags = np.zeros(len(first), np.uint32)
    if len(first):
        ids = batch.ids[docs][order]
        flags = np.logical_or.reduceat(anchor[order], first).astype(np.uint32)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        flags |= several.astype(np.uint32) << np.uint32(1)
    return Probes(
        places, entry, (ordered[first] >> np.uint64(CODE_BITS)).astype(np.int64),
        (ordered[first] & np.uint64((1 << CODE_BITS) - 1)).astype(np.uint32), flags,
    )


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(buckets[a]), slice(int(a), int(b))


def _live(payloads: list[bytes]) -> list[np.ndarray]:
    """Which entries of each batch's packed probes are of a block that stands in several documents."""
    parts = [np.frombuffer(p, "<u4") for p in payloads]
    packed = np.concatenate(parts)
    codes = packed >> np.uint32(2)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(ordered)]]))
    flags = np.bitwise_or.reduceat(packed[order] & np.uint32(3), first)
    live = ((flags & 1) > 0) & (((flags & 2) > 0) | (sizes > 1))
    out = np.empty(len(packed), bool)
    out[order] = np.repeat(live, sizes)
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def _runs(it, key: str, *names: str):
    now, held = None, []
    for columns in batches(it, key, *names):
        for k, *rest in zip(*columns):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(rest)
    if held:
        yield now, held


@dataclass
class Passages:
    """Distinct candidate passages of a batch, ordered by bucket and hash."""

    places: np.ndarray
    entry: np.ndarray
    buckets: np.ndarray
    hashes: np.ndarray
    least: np.ndarray  # the smallest id of the batch that has it


def candidates(batch: Batch, p: Probes, live: np.ndarray, block: int, window: int) -> np.ndarray:
    """A mask over words: where a passage starts that holds a hit."""
    hit = np.zeros(len(batch.hashes) + 1, np.int64)
    hit[p.places[live[p.entry]] + 1] = 1
    sums = np.cumsum(hit)
    mask = np.zeros(len(batch.hashes), bool)
    for start, end in zip(batch.starts[:-1], batch.starts[1:]):
        n = end - start - window + 1
        if n > 0:
            reach = window - block + 1
            mask[start : start + n] = sums[start + reach : start + reach + n] > sums[start : start + n]
    return mask


def passages(batch: Batch, mask: np.ndarray, count: int, window: int) -> Passages:
    places = np.flatnonzero(mask)
    if not len(places):
        none = np.zeros(0, np.int64)
        return Passages(places, none, none, none.astype(np.uint64), none)
    hashes = rolling(batch.hashes, window, window)[places]
    buckets = _buckets(mix64(hashes), count)
    order = np.lexsort((hashes, buckets))
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(h)]]))
    entry = np.empty(len(h), np.int64)
    entry[order] = np.repeat(np.arange(len(first)), sizes)
    ids = batch.ids[batch.owner[places]][order]
    return Passages(places, entry, buckets[order][first].astype(np.int64), h[first], np.minimum.reduceat(ids, first))


def _pack_passages(p: Passages, at: slice) -> bytes:
    """Hashes, then for each the place of its id in a table of distinct ids, which ends the array."""
    ids, place = np.unique(p.least[at], return_inverse=True)
    n = np.array([at.stop - at.start], "<u4")
    return n.tobytes() + p.hashes[at].astype("<u8").tobytes() + place.astype("<u2" if len(ids) < 65536 else "<u4").tobytes() + ids.astype("<i8").tobytes()


def _unpack_passages(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    hashes = np.frombuffer(raw, "<u8", n, 4)
    rest = len(raw) - 4 - 8 * n
    # Two bytes a place or four: what is left must be whole ids, and no more than 65,535 of them for two.
    wide = (rest - 2 * n) % 8 != 0 or (rest - 2 * n) // 8 >= 65536
    size = 4 if wide else 2
    places = np.frombuffer(raw, "<u4" if wide else "<u2", n, 4 + 8 * n)
    return hashes, np.frombuffer(raw, "<i8", -1, 4 + (8 + size) * n)[places]


def _earlier(payloads: list[bytes]) -> list[np.ndarray]:
    """Which passages of each batch also start in a smaller document of another batch."""
    parts = [_unpack_passages(p) for p in payloads]
    hashes = np.concatenate([h for h, _ in parts])
    ids = np.concatenate([i for _, i in parts])
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    least = np.minimum.reduceat(ids[order], first)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(least, np.diff(np.concatenate([first, [len(h)]]))) < ids[order]
    return np.split(out, np.cumsum([len(h) for h, _ in parts])[:-1])


def _answers(replies: dict[int, tuple[int, bytes]], buckets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buckets), bool)
    for bucket, at in _by_bucket(buckets):
        n, bits = replies.get(bucket, (-1, b""))
        if n != at.stop - at.start:
            raise RuntimeError("a batch of texts was not read twice in the same order")
        out[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


SHARED = "bucket int, batch long, kind int, data binary, ids binary, sizes binary, doc_id long, n_words long, digest string"
RESULT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def repeats(
    docs: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, spans, kept_sha256) of every row.

    ``spans`` are the runs of words that repeat a smaller document, in places of words;
    ``kept_sha256`` is the digest of the other words joined by spaces. ``removed`` cuts texts by them.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must be sure to hold a whole block")
    import zstandard

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    count = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    ask = _schema("bucket int, batch long, data binary")
    answer = _schema("bucket int, batch long, n long, data binary")
    shared = _schema(SHARED)

    def questions(it):
        kept = WordHashes()
        for ids, texts in _cut(it):
            batch = make_batch(ids, texts, kept)
            p = probes(batch, count, block)
            packed = ((p.codes << np.uint32(2)) | p.flags).astype("<u4")
            for bucket, at in _by_bucket(p.buckets):
                yield bucket, batch.name, packed[at].tobytes()

    def hits(it):
        for bucket, rows in _runs(it, "bucket", "batch", "data"):
            for (name, raw), live in zip(rows, _live([r[1] for r in rows])):
                yield bucket, name, len(live), np.packbits(live).tobytes()

    asked = held.mapInArrow(lambda it: in_parts(questions(it), ask), "bucket int, batch long, data binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    replies = cut_lineage(
        asked.mapInArrow(lambda it: in_parts(hits(it), answer), "bucket int, batch long, n long, data binary")
    )

    def bundles(it):
        packer = zstandard.ZstdCompressor(level=1)
        for ids, texts in _cut(it):
            sizes = np.array([len(t) for t in texts], np.int64)
            name = _named(ids, texts)
            yield 0, name, 1, packer.compress(b"".join(texts)), ids.tobytes(), sizes.tobytes(), None, None, None

    def opened(name: int, data: bytes, ids: bytes, sizes: bytes, kept: WordHashes) -> Batch:
        raw = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        texts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return make_batch(np.frombuffer(ids, np.int64), texts, kept, name)

    def met(it, kept: WordHashes):
        """(batch, answers, mask) with the batch's bundle after its answers."""
        for name, rows in _runs(it, "batch", "kind", "bucket", "n_words", "data", "ids", "sizes", "digest"):
            found = {bucket: (n, data) for kind, bucket, n, data, *_ in rows if kind == 0}
            for kind, _, _, data, ids, sizes, digest in rows:
                if kind == 1:
                    yield opened(name, data, ids, sizes, kept), found, digest

    def compared(it):
        kept, packer = WordHashes(), zstandard.ZstdCompressor(level=1)
        for batch, found, _ in met(it, kept):
            p = probes(batch, count, block)
            mask = candidates(batch, p, _answers(found, p.buckets), block, window)
            far = passages(batch, mask, count, window)
            for bucket, at in _by_bucket(far.buckets):
                yield bucket, batch.name, 0, _pack_passages(far, at), None, None, None, None, None
            inside = np.unique(batch.owner[far.places])
            rest = np.setdiff1d(np.arange(len(batch.ids)), inside, assume_unique=True)
            for d in rest.tolist():
                words, doc = batch.words[d], int(batch.ids[d])
                yield d % count, batch.name, 2, None, None, None, None if doc == NO_ID else doc, len(words), _digest(words)
            if len(inside):
                texts = [b" ".join(batch.words[d]) for d in inside]
                own = np.concatenate([mask[batch.starts[d] : batch.starts[d + 1]] for d in inside])
                sizes = np.array([len(t) for t in texts], np.int64)
                yield (
                    abs(batch.name) % count, batch.name, 1, packer.compress(b"".join(texts)), batch.ids[inside].tobytes(),
                    sizes.tobytes(), None, len(own), np.packbits(own).tobytes().hex(),
                )

    def judged(it):
        def one(bucket, rows):
            asking = [r for r in rows if r[1] == 0]
            for (name, _, raw, *_), earlier in zip(asking, _earlier([r[2] for r in asking]) if asking else []):
                yield bucket, name, 0, np.packbits(earlier).tobytes(), None, None, None, len(earlier), None
            for name, kind, data, ids, sizes, doc, n, digest in rows:
                if kind:
                    yield bucket, name, kind, data, ids, sizes, doc, n, digest

        for bucket, rows in _runs(it, "bucket", "batch", "kind", "data", "ids", "sizes", "doc_id", "n_words", "digest"):
            yield from one(bucket, rows)

    def finished(it):
        kept = WordHashes()
        for batch, found, bits in met(it, kept):
            mask = np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=len(batch.hashes)).astype(bool)
            far = passages(batch, mask, count, window)
            here = batch.ids[batch.owner[far.places]]
            gone = _answers(found, far.buckets)[far.entry] | (far.least[far.entry] < here)
            steps = np.zeros(len(batch.hashes) + 1, np.int64)
            np.add.at(steps, far.places[gone], 1)
            np.add.at(steps, far.places[gone] + window, -1)
            covered = np.cumsum(steps)[:-1] > 0
            for d, (doc, words) in enumerate(zip(batch.ids.tolist(), batch.words)):
                own = covered[batch.starts[d] : batch.starts[d + 1]]
                left = [w for w, c in zip(words, own) if not c]
                yield None if doc == NO_ID else doc, len(words), _spans(own), _digest(left)

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", spans), ("kept_sha256", pa.string())])

    as_shared = F.lit(None)
    bundled = held.mapInArrow(lambda it: in_parts(bundles(it), shared), SHARED)
    answered = replies.select(
        "bucket", "batch", F.lit(0).alias("kind"), "data", as_shared.cast("binary").alias("ids"),
        as_shared.cast("binary").alias("sizes"), as_shared.cast("long").alias("doc_id"), F.col("n").alias("n_words"),
        as_shared.cast("string").alias("digest"),
    )
    first = answered.unionByName(bundled).repartition("batch").sortWithinPartitions("batch", "kind")
    second = first.mapInArrow(lambda it: in_parts(compared(it), shared), SHARED)
    second = second.repartition("bucket").sortWithinPartitions("bucket", "kind")
    staged = cut_lineage(second.mapInArrow(lambda it: in_parts(judged(it), shared), SHARED))
    third = staged.filter("kind < 2").repartition("batch").sortWithinPartitions("batch", "kind")
    touched = third.mapInArrow(lambda it: in_parts(finished(it), result), RESULT)
    untouched = staged.filter("kind = 2").select(
        "doc_id", "n_words", F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("digest").alias("kept_sha256")
    )
    return untouched.unionByName(touched)


def removed(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of ``found`` spans cut out; texts without any stay as they are."""
    hit = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), "spans")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    stays = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    met = docs.join(hit, F.col(id_col) == F.col("_id"), "left")
    text = F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(F.array_join(stays, " "))
    return met.withColumn(text_col, text).select(*docs.columns)
