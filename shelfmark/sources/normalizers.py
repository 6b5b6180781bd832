"""User parsers over binary documents: the Python seam of extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..operators.extraction import CLAIMS, accepts
from ..schemas import PAGE_TEXT


class Declined(Exception):
    """A parser declines a document for a stated reason; the next rung is tried."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(detail or reason)
        self.reason = reason


@dataclass
class Normalized:
    """Pages as (text, source locator) in order, with what the parser knows of them."""

    pages: list[tuple[str, str]]
    ocr_used: bool = False
    confidence: float | None = None


@dataclass
class Normalizer:
    """One rung: which documents it claims (a Column over content_type and path), and a
    function from (content, content_type, path) to ``Normalized``."""

    name: str
    normalize: Callable[[bytes, str, str], Normalized]
    claims: Callable[[Column, Column], Column] | None = None

    def accepts(self, content_type: Column, path: Column) -> Column:
        if self.claims is not None:
            return self.claims(content_type, path)
        if self.name in CLAIMS:
            return accepts(self.name, content_type, path)
        return F.lit(True)


@dataclass
class Gate:
    min_chars: int = 1
    min_confidence: float = 0.0

    def passes(self, found: Normalized) -> bool:
        shortest = min((len(text) for text, _ in found.pages), default=-1)
        sure = found.confidence is None or found.confidence >= self.min_confidence
        return bool(found.pages) and shortest >= self.min_chars and sure


def _native(content: bytes, content_type: str, path: str) -> Normalized:
    text = str(content, "utf-8", "replace")
    if not text or text.isspace():
        raise Declined("empty_document")
    return Normalized([(text, "text:1")])


NATIVE = Normalizer("text_native", _native)

#: A task answers with about this much text at a time; a document or page counts as this much besides its text.
ANSWER_BYTES, ROW_BYTES = 4 << 20, 256
#: What a document's content and claiming rungs are called on their way to Python.
BODY, CLAIMED = "_body", "_claimed"

RESULT = [
    T.StructField("extractor", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("pages", T.ArrayType(PAGE_TEXT)),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("ocr_used", T.BooleanType()),
]


@dataclass
class _Walk:
    """Tries the claimed rungs of each document in order; the first result that passes
    the gate wins. A parser that raises costs its document an error, not the task."""

    rungs: list[Normalizer]
    gate: Gate
    keep: list[str] = field(default_factory=list)

    def one(self, content: bytes, content_type: str, path: str, claimed: list[str]):
        errors: list[str] = []
        for rung in self.rungs:
            if rung.name not in claimed:
                continue
            try:
                found = rung.normalize(bytes(content), content_type, path)
            except Exception as err:  # noqa: BLE001 - a user parser may raise anything
                reason = getattr(err, "reason", None) or f"parse_failed:{type(err).__name__}"
                errors.append(f"{rung.name}:{reason}")
                continue
            if self.gate.passes(found):
                pages = [
                    {"page": n, "text": text, "source_locator": locator}
                    for n, (text, locator) in enumerate(found.pages, 1)
                ]
                return rung.name, None, pages, found.confidence, found.ocr_used
            errors.append(f"{rung.name}:below_gate")
        return None, ";".join(errors) or None, None, None, None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents are taken out of a batch one by one, and answered a few megabytes at a time."""
        kinds = [to_arrow_type(f.dataType) for f in RESULT]
        names = [*self.keep, *(f.name for f in RESULT)]
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            asked = [column[n] for n in (BODY, "content_type", "path", CLAIMED)]
            found, start, size = [], 0, 0
            for n in range(batch.num_rows):
                found.append(self.one(*(c[n].as_py() for c in asked)))
                size += ROW_BYTES + sum(ROW_BYTES + len(p["text"] or "") for p in found[-1][2] or ())
                if size >= ANSWER_BYTES or n + 1 == batch.num_rows:
                    held = [column[k].slice(start, len(found)) for k in self.keep]
                    made = [pa.array([f[at] for f in found], kind) for at, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*held, *made], names=names)
                    found, start, size = [], n + 1, 0


def extract(
    documents: DataFrame, rungs: list[Normalizer], gate: Gate | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Text of documents (``content`` binary, ``content_type``, ``path``, ...): kept
    columns plus extractor, error, pages, confidence, ocr_used.

    Plain text is decoded in the JVM when its rung comes first; only the documents it
    does not settle go to Python, one pass each, without any shuffle.
    """
    gate = gate or Gate()
    keep = keep or [c for c in documents.columns if c != "content"]
    schema = T.StructType([*(documents.schema[c] for c in keep), *RESULT])
    kind, path = F.col("content_type"), F.col("path")
    rest, settled = documents, None  # settled: answered without Python
    if rungs and rungs[0].name == "text_native":
        documents = documents.withColumn("_text", tx.decode_text(F.col("content")))
        text = F.col("_text")
        ours = NATIVE.accepts(kind, path)
        ready = F.coalesce(ours & ~tx.is_blank(text) & (F.length(text) >= gate.min_chars), F.lit(False))
        page = F.struct(
            F.lit(1).alias("page"), text.alias("text"), F.lit("text:1").alias("source_locator")
        )
        decoded = [
            *keep,
            F.when(ready, "text_native").alias("extractor"),
            F.when(ours & ~ready, "text_native:empty_document").alias("error"),
            F.when(ready, F.array(page)).alias("pages"),
            F.lit(None).cast("double").alias("confidence"),
            F.when(ready, F.lit(False)).alias("ocr_used"),
        ]
        if len(rungs) == 1:
            return documents.select(*decoded)
        settled = documents.where(ready).select(*decoded)
        rest = documents.where(~ready).drop("_text")
    claimed = F.filter(
        F.array(
            *(F.when(r.accepts(kind, path), F.lit(r.name)) for r in rungs)
        ).cast("array<string>"),
        lambda n: n.isNotNull(),
    )
    # What no rung claims is answered without its content.
    sent = rest.withColumn(CLAIMED, claimed).withColumn(BODY, F.when(F.size(CLAIMED) > 0, F.col("content")))
    asked = dict.fromkeys([*keep, "content_type", "path", CLAIMED, BODY])
    walked = sent.select(*asked).mapInArrow(_Walk(rungs, gate, keep), schema)
    return walked if settled is None else settled.unionByName(walked)
