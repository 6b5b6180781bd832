"""What the operators of this package share: texts, words, hashes and staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: str) -> bytes:
    """UTF-8 of ``text`` with A-Z lowered; ``bytes.split()`` then cuts words as ``WORD`` does."""
    return text.encode("utf-8", "surrogatepass").lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen; emptied when it has grown large."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each window of ``width`` consecutive values; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mix64(hashes ^ np.uint64(seed))
    base = np.uint64(0x9E3779B97F4A7C15)
    # Horner's rule over the window, one vector step per place.
    out = x[:n].copy()
    for place in range(1, width):
        out *= base
        out += x[place : place + n]
    return mix64(out)


def batches(rows, *names: str) -> Iterator[list[list]]:
    """Columns of Arrow batches as Python lists, at most a thousand rows at a time."""
    for batch in rows:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
