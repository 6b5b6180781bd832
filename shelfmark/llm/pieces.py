"""Pieces of text by a SentencePiece model, each with the original bytes it stands for.

Normalizing is done here: at every place the longest rule of the model's compiled character map
is applied, and for each normalized byte the place of its source is recorded. Between a character
that is no word mark and a following word mark no piece of the vocabulary reaches across, so
stretches between such places are encoded apart (and kept, for they repeat); the merges inside a
stretch are the library's, with its own normalizer switched off. The lengths of the pieces, laid
end to end over the normalized bytes, then project every piece to a span of the source.

Of a character written as byte pieces the last one spans the whole character and those before it
are empty, as in the library. The model file is read by the driver and broadcast; its size is that
of one vocabulary, whatever the corpus. Models without byte pieces, with pieces that hold a word
mark inside or with symbols kept whole are refused.

Cases: a null text counts as empty and has the end id only (without ``end`` none); rows repeated
stay repeated and a null id stays null; other columns of the input are ignored; an empty table
gives an empty result. A text of many megabytes is normalized and encoded a stretch at a time
where the map has no rules; with rules it is normalized whole. Its ids are held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, in_stretches, tokenizer_path
from .common import batches, whole_text

MARK = "▁"
KEPT_WORDS = 150_000
STRETCH = 1 << 20

# Field numbers and piece kinds of the public model format.
PIECES, NORMALIZER = 1, 3
MAP, DUMMY_PREFIX, FEWER_BLANKS, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, KEPT_WHOLE, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def number(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie of byte strings, each with its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.known: dict[bytes, bytes] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes covered, replacement) of the longest rule that starts at a place; 0 if none does."""
        units, best, value = self.units, 0, 0
        place = units[0] >> 10 << ((units[0] & 512) >> 6)
        for n in range(at, len(data)):
            place ^= data[n]
            unit = units[place] if place < len(units) else 0
            if unit & 0x800000FF != data[n]:
                break
            place ^= unit >> 10 << ((unit & 512) >> 6)
            if unit & 256:
                best, value = n + 1 - at, units[place] & 0x7FFFFFFF
        if not best:
            return 0, b""
        return best, self.replacements[value : self.replacements.index(b"\0", value)]


class Normalizer:
    """Text to the model's normal form, with the source place of every byte of it."""

    def __init__(self, spec: bytes):
        held = {MAP: b"", DUMMY_PREFIX: 1, FEWER_BLANKS: 1, ESCAPE: 1} | dict(fields(spec))
        self.map = CharMap(held[MAP]) if held[MAP] else None
        self.dummy, self.fewer = bool(held[DUMMY_PREFIX]), bool(held[FEWER_BLANKS])
        self.blank = MARK.encode() if held[ESCAPE] else b" "

    def __call__(self, text: str, first: bool = True) -> tuple[bytes, np.ndarray]:
        """(normal form, places): one source place a byte, and the end of the source last.

        With ``first`` false the text is a later stretch, which gets no mark in front.
        """
        data = text.encode("utf-8", "replace")
        if not self.map and not self.fewer:
            return self._plain(data, first)
        out: list[bytes] = []
        places: list[int] = []
        sizes: list[int] = []
        at, after_blank = 0, self.fewer
        while at < len(data):
            covered, new = self.map.longest(data, at) if self.map else (0, b"")
            if not covered:
                covered = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + covered]
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                if self.dummy and not out:
                    out.append(self.blank)
                    places.append(at)
                    sizes.append(len(self.blank))
                # Each blank is a run of its own, so that trailing ones can be taken off.
                for run in re.findall(b" |[^ ]+", new):
                    run = self.blank if run == b" " else run
                    out.append(run)
                    places.append(at)
                    sizes.append(len(run))
                after_blank = self.fewer and new.endswith(b" ")
            at += covered
        end = len(data)
        while self.fewer and out and out[-1] == self.blank:
            end = places.pop()
            out.pop()
            sizes.pop()
        if not out:
            return b"", np.zeros(1, np.int64)
        return b"".join(out), np.append(np.repeat(np.array(places, np.int64), sizes), end)

    def _plain(self, data: bytes, first: bool) -> tuple[bytes, np.ndarray]:
        """Where there are no rules: blanks become marks, all else stays."""
        raw = np.frombuffer(data, np.uint8)
        # All bytes of a character have the place of its first one.
        starts = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else raw.astype(np.int64)
        places = np.repeat(starts, np.where(raw == 32, len(self.blank), 1))
        head = self.blank if first and self.dummy and data else b""
        return head + data.replace(b" ", self.blank), np.concatenate([np.zeros(len(head), np.int64), places, [len(raw)]])


class Model:
    """A model file's normalizer here, its merges in the library."""

    def __init__(self, blob: bytes):
        import sentencepiece

        pieces, spec = [], b""
        for number, value in fields(blob):
            if number == PIECES:
                held = dict(fields(value))
                pieces.append((held[1].decode(), held.get(3, NORMAL)))
            elif number == NORMALIZER:
                spec += value
        kinds = {kind for _, kind in pieces}
        plain = [p for p, kind in pieces if kind == NORMAL]
        if BYTE not in kinds or kinds & {KEPT_WHOLE, UNUSED} or any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("the model needs byte pieces, word marks in front only, and no symbols kept whole")
        self.normalize = Normalizer(spec)
        #: Normalized bytes a piece stands for.
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) * (kind == NORMAL) for p, kind in pieces], np.int64)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        # A message laid behind another overrides its fields: no map, no mark in front, blanks as they are.
        off = b"\x12\x00" + b"".join(bytes([field << 3, 0]) for field in (DUMMY_PREFIX, FEWER_BLANKS, ESCAPE))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=blob + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        self.end_id = self.library.eos_id()
        self.kept: dict[str, bytes] = {}
        # A line end that stands in no piece with another character is a run of its own.
        alone = "" if any("\n" in p for p in plain) else "\n"
        self.runs = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|\n").findall

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of a text that can be encoded one after the other; each but the first starts with a blank."""
        at = 0
        if self.normalize.map is None and not self.normalize.fewer:
            cut = re.compile(f"(?<=[^ {MARK}]) ")
            while len(text) - at > STRETCH and (found := cut.search(text, at + STRETCH)):
                yield text[at : found.start()]
                at = found.start()
        yield text[at:]

    def _coded(self, normal: list[list[str]]) -> None:
        fresh = set().union(*normal).difference(self.kept)
        if self.kept and len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
            fresh = set().union(*normal)
        listed = list(fresh)
        for start in range(0, len(listed), 20_000):
            some = listed[start : start + 20_000]
            made = self.merges.encode(some, num_threads=1)
            self.kept.update((s, np.array(ids, "<i4").tobytes()) for s, ids in zip(some, made))

    def encode(self, texts: list[str], end: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text; spans are of its UTF-8 bytes, that of the end id is empty."""
        plans = []
        for number, text in enumerate(texts):
            before = 0
            for stretch in self.stretches(text):
                normal, places = self.normalize(stretch, first=not before)
                plans.append((number, self.runs(normal.decode()), places + before))
                before += int(places[-1]) if len(texts[number]) > len(stretch) else 0
        self._coded([runs for _, runs, _ in plans])
        parts: list[list] = [[] for _ in texts]
        for number, runs, places in plans:
            ids = np.frombuffer(b"".join(map(self.kept.__getitem__, runs)), "<i4")
            bounds = np.concatenate([[0], np.cumsum(self.sizes[ids])])
            # Any piece, byte pieces too, ends where the next one begins.
            parts[number].append((ids, places[bounds[:-1]], places[bounds[1:]]))
        out = []
        for some in parts:
            ids, begins, ends = (np.concatenate(c) for c in zip(*some)) if len(some) > 1 else some[0]
            if end:
                last = ends[-1:] if len(ends) else np.zeros(1, np.int64)
                ids, begins, ends = np.append(ids, np.int32(self.end_id)), np.append(begins, last), np.append(ends, last)
            out.append((ids, begins, ends))
        return out


def load(spark: SparkSession, path: str | None = None):
    """The model file as a broadcast variable."""
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_CODED = "doc_id long, ids array<int>, begins array<long>, ends array<long>"


def _arrow(held: list[tuple]) -> pa.RecordBatch:
    sizes = np.cumsum([0] + [len(ids) for _, ids, _, _ in held])
    # A list column needs 32-bit offsets; a batch ends long before that.
    lists = [
        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([row[n] for row in held]), kind))
        for n, kind in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))
    ]
    return pa.RecordBatch.from_arrays([pa.array([row[0] for row in held], pa.int64()), *lists], ["doc_id", "ids", "begins", "ends"])


def encode(docs: DataFrame, model, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends): the ids of every text and the UTF-8 bytes each one stands for."""

    def run(it):
        coder, held, size = Model(model.value), [], 0
        for docs_, texts in in_stretches(it, ("doc_id", "text"), 1 << 20):
            for doc, coded in zip(docs_, coder.encode(texts, end)):
                held.append((doc, *coded))
                size += 20 * len(coded[0]) + 64
                if size >= BATCH_BYTES:
                    yield _arrow(held)
                    held, size = [], 0
        if held:
            yield _arrow(held)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return read.mapInArrow(run, _CODED)


def decode(encoded: DataFrame, model) -> DataFrame:
    """The rows with ``text``: what the library makes of their ids."""
    names = [f.name for f in encoded.schema.fields if f.name != "text"]

    def run(it):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in it:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                lists = part.column(part.schema.get_field_index("ids"))
                ids, bounds = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                texts = [library.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(bounds, bounds[1:])]
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "text")
    return encoded.select(*names).mapInArrow(run, f"{schema}, text string")
