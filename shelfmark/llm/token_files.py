"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids in order. Each document is one frame (one that
is very long is several), so a reader decompresses only what it asks for. After the frames
come a table of documents in a skippable frame and the seek table of the public seekable
format: compressed size, decompressed size and a checksum (the low half of XXH64) a frame.

Texts are moved once, by a range partitioning on the id; encoding and writing happen in the
same task. An attempt writes under a name of its own and the manifest names the files of
attempts that were committed, so a lost or repeated task leaves no trace in what is read.

Cases: a null text is the empty one and has the end id only; rows of one id are ordered by
text; a null id comes first; other columns of the input are ignored; an empty table gives an
empty manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .bpe import in_parts, in_stretches, kept_by_worker
from .common import batches, whole_text

# Fixed values of the seekable format.
SEEK_FRAME, SEEK_FOOTER, DOC_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80
#: A document of more bytes than this takes several frames.
FRAME_BYTES = 4 << 20
LEVEL = 1

_DOC = "<?qIIQ"  # id is set, id, first frame, frames, ids
_FRAME = "<III"  # packed bytes, bytes, checksum
_HEAD = "<II"
_FOOT = "<IBI"


class Writer:
    def __init__(self, out):
        import zstandard

        self.out, self.at = out, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)
        self.frames: list[bytes] = []
        self.docs: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        first = len(self.frames)
        for start in range(0, max(len(ids), 1), FRAME_BYTES):
            part = ids[start : start + FRAME_BYTES]
            packed = self.packer.compress(part)
            self.out.write(packed)
            self.frames.append(struct.pack(_FRAME, len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append(struct.pack(_DOC, doc_id is not None, doc_id or 0, first, len(self.frames) - first, len(ids) // 4))

    def close(self) -> None:
        table = b"".join(self.docs)
        self.out.write(struct.pack(_HEAD, DOC_FRAME, len(table)) + table)
        seek = b"".join(self.frames) + struct.pack(_FOOT, len(self.frames), CHECKSUMS, SEEK_FOOTER)
        self.out.write(struct.pack(_HEAD, SEEK_FRAME, len(seek)) + seek)
        self.out.close()


class Reader:
    """Random access to the documents of one file; ``source`` can seek and read."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        frames, flags, magic = struct.unpack(_FOOT, self._read(end - struct.calcsize(_FOOT), struct.calcsize(_FOOT)))
        if magic != SEEK_FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_at = end - struct.calcsize(_FOOT) - frames * struct.calcsize(_FRAME)
        self.frames = np.frombuffer(self._read(seek_at, frames * struct.calcsize(_FRAME)), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        table_at = int(self.starts[-1])
        kind, size = struct.unpack(_HEAD, self._read(table_at, struct.calcsize(_HEAD)))
        if kind != DOC_FRAME or table_at + 2 * struct.calcsize(_HEAD) + size != seek_at:
            raise ValueError("the table of documents is damaged")
        self.docs = list(struct.iter_unpack(_DOC, self._read(table_at + struct.calcsize(_HEAD), size)))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, number: int) -> bytes:
        """Ids of the document at that place of the file; only its frames are read."""
        import xxhash
        import zstandard

        _, _, first, count, _ = self.docs[number]
        out = []
        for frame in range(first, first + count):
            packed, size, check = self.frames[frame]
            part = zstandard.ZstdDecompressor().decompress(
                self._read(int(self.starts[frame]), int(packed)), max_output_size=int(size)
            )
            if len(part) != size or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {frame} does not match its checksum")
            out.append(part)
        return b"".join(out)


def open_files(folder: str):
    """(file system, path) for a folder named by URI or path, as pyarrow reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(
    docs: DataFrame, tokenizer, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and write; returns the manifest (part, file, n_docs, n_ids, start), one row a file.

    ``start`` counts the ids of all files before. The folder must be reachable by all executors.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    tail = struct.pack("<I", end_id)
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept = kept_by_worker(tokenizer.value)
        out, n_docs, n_ids = None, 0, 0
        for ids, texts in in_stretches(it, ("doc_id", "text")):
            if out is None:
                files, base = open_files(folder)
                files.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                out = Writer(files.open_output_stream(f"{base}/{name}", compression=None))
            for doc, coded in zip(ids, kept.texts(texts)):
                coded += tail
                out.add(doc, coded)
                n_docs += 1
                n_ids += len(coded) // 4
        kept.rest()
        if out is not None:
            out.close()
            yield from in_parts([(part, name, n_docs, n_ids)], schema)

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ordered = held.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = cut_lineage(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long"))
    # One small row a file, so its running sum is not spread.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return made.withColumn("start", start).withColumn("folder", F.lit(folder))


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents of the files, checksums tested."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def rows(it) -> Iterator[tuple]:
        for folders, names, starts in batches(it, "folder", "file", "start"):
            for folder, name, at in zip(folders, names, starts):
                files, base = open_files(folder)
                with files.open_input_file(f"{base}/{name}") as source:
                    reader = Reader(source)
                    for number, (known, doc, _, _, n) in enumerate(reader.docs):
                        yield doc if known else None, at, reader.ids(number)
                        at += n

    files = manifest.select("folder", "file", "start", "part")
    # A task a file: a number of parts that is given is not merged, however small the manifest.
    spread = files.repartitionByRange(max(1, files.count()), "part")
    return spread.mapInArrow(lambda it: in_parts(rows(it), schema), "doc_id long, start long, ids binary")
