"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the least hash among its s-mers stands at its first or
last place. Whether it is depends on the k-mer alone, so the same passage has the same anchors
wherever it stands. A fingerprint keeps every anchor whose hash lies below a fixed share of all
hashes, hence a number that grows with the text and does not depend on what else it holds; short
texts, with few of those, keep their anchors of least hash up to a fixed number. Each has the
place of its first occurrence. Two fingerprints are alike by the share of common anchors, among
the hashes below which both are complete, that also agree on how far the passage has moved.

Cases: null and empty texts have the empty fingerprint, like only to itself; a text without
anchors is anchored by all of it; ties of a hash keep the first place; rows of one id are
ordered by text; a null id comes first; other columns are ignored; an empty table gives an
empty result; the only document is its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bpe import in_parts
from .common import batches, mix64, rolling, whole_text

K, S = 12, 5
#: A text keeps at least so many anchors (all, if it has fewer), and all whose 32-bit hash is below ``BELOW``.
ANCHORS = 64
BELOW = 2**32 // 32
#: Places are kept in steps of this many code points.
STEP = 8
#: Texts of a range of ids, in bytes; ranges are one document or more.
RANGE_BYTES = 64 << 20
_SEED = 0x51ED270B


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values."""
    n, have, out = len(x) - width + 1, 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers of a text, in order of place."""
    points = code_points(text)
    if len(points) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = rolling(points.astype(np.uint64), s, _SEED)
    width = k - s + 1
    least = least_of(inner, width)
    n = len(least)
    places = np.flatnonzero((inner[:n] == least) | (inner[width - 1 :] == least))
    # Inner substrings that cover the k-mer between them name it.
    whole = np.zeros(len(places), np.uint64)
    for at in [*range(0, k - s, s), k - s]:
        whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + inner[places + at])
    return whole, places


def fingerprint(text: str, k: int = K, s: int = S, anchors: int = ANCHORS, below: int = BELOW) -> str:
    """Sixteen hex digits an anchor, in order of hash: its hash, then its place in steps."""
    if not text:
        return ""
    hashes, places = syncmers(text, k, s)
    if not len(hashes):
        import xxhash

        hashes = np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)
        places = np.zeros(1, np.int64)
    short = hashes >> np.uint64(32)
    kept, first = np.unique(short, return_index=True)  # the first place of each, ordered by hash
    n = max(anchors, int(np.searchsorted(kept, np.uint64(below))))
    steps = (places[first[:n]] // STEP).astype(np.uint64)
    return ((kept[:n] << np.uint64(32)) | steps).astype(">u8").tobytes().hex()


def anchors_of(printed: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(printed), ">u4").astype(np.int64)
    return raw[::2], raw[1::2]


def complete_to(hashes: np.ndarray, anchors: int = ANCHORS, below: int = BELOW) -> int:
    """The hash up to which a fingerprint has all anchors of its text."""
    return 2**32 if len(hashes) < anchors else max(below - 1, int(hashes[-1]))


def likeness(a: str, b: str, anchors: int = ANCHORS, below: int = BELOW) -> float:
    """0 to 1: common anchors that moved alike, among those of both together as far as both are complete."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (ha, pa_), (hb, pb) = anchors_of(a), anchors_of(b)
    reach = min(complete_to(ha, anchors, below), complete_to(hb, anchors, below))
    na, nb = np.searchsorted(ha, reach, "right"), np.searchsorted(hb, reach, "right")
    common, ia, ib = np.intersect1d(ha[:na], hb[:nb], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    # The commonest displacement, give or take a step of rounding.
    moved = np.sort(pa_[ia] - pb[ib])
    near = np.searchsorted(moved, moved + 1, "right") - np.searchsorted(moved, moved - 1, "left")
    return int(near.max()) / int(na + nb - len(common))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def _bounds(docs: DataFrame, parts: int) -> tuple[list[int], dict[int, int]]:
    """Ids that split the table into ``parts`` ranges, and the first id of each range with rows."""
    steps = [i / parts for i in range(1, parts)] or [0.5]
    cuts = docs.select(F.percentile_approx("_key", steps, max(10_000, 10 * parts))).first()[0]
    bounds = sorted(set(cuts or []))
    firsts = docs.groupBy(_range_of(F.col("_key"), bounds).alias("part")).agg(F.min("_key").alias("first"))
    # One small row a range, not a row a document.
    return bounds, {r["part"]: r["first"] for r in firsts.collect()}


def _range_of(key: Column, bounds: list[int]) -> Column:
    edges = np.array(bounds, np.int64)

    @F.pandas_udf(LongType())
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="left"))

    return place(key)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, next_fingerprint), one row a document.

    Texts are moved once, to ranges of ids; the first document of a range goes along to the
    range before it, whose last document it follows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), key.alias("_key"))
    size = held.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds, firsts = _bounds(held.select("_key"), parts)
    used = sorted(firsts)
    before = {part: used[i - 1] for i, part in enumerate(used)}  # the last range precedes the first
    follows = {firsts[part]: (before[part], 0 if i else 1) for i, part in enumerate(used)}
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("array<struct<part:long,turn:int>>")
    def where(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(edges, keys.to_numpy(np.int64), side="left")
        out = []
        for k, p in zip(keys, own):
            places = [{"part": int(p), "turn": 0}]
            if k in follows:  # turn 1: after the range's own; the wrap-around comes last
                places.append({"part": follows[k][0], "turn": 1})
            out.append(places)
        return pd.Series(out)

    spread = held.select("doc_id", "text", "_key", F.explode(where("_key")).alias("at"))
    spread = spread.select("doc_id", "text", "_key", F.col("at.part").alias("part"), F.col("at.turn").alias("turn"))
    ordered = spread.repartition(parts, "part").sortWithinPartitions("part", "turn", "_key", "text")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text", pa.string()), ("edited", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()),
        ]
    )

    def rows(it) -> Iterator[tuple]:
        held, printed = None, ""
        for parts_, turns, ids, texts in batches(it, "part", "turn", "doc_id", "text"):
            for part, turn, doc, text in zip(parts_, turns, ids, texts):
                if held is not None and (held[0] != part or (held[1] and turn)):
                    held = None  # a follower's own row is made in its range
                now = fingerprint(text)
                if held is not None:
                    changed = edited(held[3], text)
                    yield held[2], len(held[3]), held[3], changed, printed, fingerprint(changed), now
                held, printed = (part, turn, doc, text), now

    def run(it):
        return in_parts(rows(it), schema)

    made = ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, text string, edited string, fingerprint string, edited_fingerprint string, "
        "next_fingerprint string",
    )
    return made
