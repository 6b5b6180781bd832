"""Indexes of stored tables, so that a request opens the files it needs and no others.

Two indexes, both plain tables with rows per stored Parquet file:

* a *key index* has, for each file and leading part of the key, the range of the last key column
  and a split-block Bloom filter: eight words a block, one bit of each set by a key. A request is
  joined with the filters' blocks on equal block numbers and leading keys, and what passes names
  the files that may hold it. All of it is built-in functions; bits are gathered by ``bit_or``.
* a *text index* has, for each run of rows of a file, a bitmap of the trigrams of their folded
  text. A pattern's needed trigrams (``functions.patterns``) become bit tests over the bitmaps.

Both can say too much, never too little: what they name is read and tested as before. Building
one moves no text, and ``refresh`` indexes only those files that have no rows in it yet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import patterns
from ..session import cut_lineage

WORDS = 8
WORD_BITS = 64
#: Keys for each block of 512 bits; one in some hundreds of absent keys then passes a filter.
KEYS_PER_BLOCK = 40

ROWS_PER_RUN = 32
GRAM_BITS = 1 << 15

FILE = "_file"


def stored(spark: SparkSession, path: str, schema: StructType, files: list[str] | None = None) -> DataFrame:
    """A stored table, or the rows of some of its files."""
    reader = spark.read.schema(schema)
    if files is None:
        return reader.parquet(path)
    if not files:
        return spark.createDataFrame([], schema)
    return reader.option("basePath", path).parquet(*files)


def _file() -> Column:
    """The file of a row. Local files are named with one slash or with three; here with one."""
    return F.regexp_replace("_metadata.file_path", r"\Afile:/+", "file:/")


def _files(rows: DataFrame) -> list[str]:
    return [re.sub(r"\Afile:/+", "file:/", f) for f in rows.inputFiles()]


# --- keys -----------------------------------------------------------------------


def _block_and_bits(by: list[str], blocks: Column) -> tuple[Column, list[Column]]:
    """The block of a key, and the bit it sets in each word of that block."""
    spread = F.xxhash64(*by)
    bits = F.xxhash64(F.lit(1), *by)
    # Six bits of a second hash pick the place in each of the eight words.
    places = [F.shiftrightunsigned(bits, 6 * n).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for n in range(WORDS)]
    return F.pmod(spread, blocks).cast("int"), places


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def key_index(rows: DataFrame, by: list[str], blocks: int | None = None) -> DataFrame:
    """The key index of stored rows: (leading key columns, _file, block, blocks, low, high, w0..w7).

    ``by`` is the key, from coarse to fine; files are ranged by its last column. ``blocks`` is how
    many blocks a filter has; by default as the fullest file needs it.
    """
    *lead, last = by
    keys = rows.select(*by, _file().alias(FILE))
    if blocks is None:
        fullest = keys.groupBy(FILE).agg(F.approx_count_distinct(F.struct(*by)).alias("n")).agg(F.max("n")).first()[0]
        blocks = max(1, -(-(fullest or 0) // KEYS_PER_BLOCK))
    block, places = _block_and_bits(by, F.lit(blocks))
    filled = (
        keys.select(*lead, FILE, F.col(last).alias("_last"), block.alias("block"), *(p.alias(f"_p{n}") for n, p in enumerate(places)))
        .groupBy(*lead, FILE, "block")
        .agg(
            F.min("_last").alias("low"), F.max("_last").alias("high"),
            *(F.bit_or(_bit(F.col(f"_p{n}"))).alias(f"w{n}") for n in range(WORDS)),
        )
    )
    return filled.withColumn("blocks", F.lit(blocks))


def files_with(index: DataFrame, requests: DataFrame, by: list[str]) -> DataFrame:
    """(_file) of all files that may hold a requested key. A null in a key is never found."""
    *lead, last = by
    asked = requests.select(*by).dropna().distinct()
    sizes = [r[0] for r in index.select("blocks").distinct().collect()]  # one value a run of ``refresh``
    found = None
    for blocks in sizes:
        block, places = _block_and_bits(by, F.lit(blocks))
        wanted = asked.select(
            *lead, F.col(last).alias("_last"), block.alias("block"), *(p.alias(f"_p{n}") for n, p in enumerate(places))
        )
        held = F.col("_last").between(F.col("low"), F.col("high"))
        for n in range(WORDS):
            held &= F.call_function("getbit", F.col(f"w{n}"), F.col(f"_p{n}")) == 1
        some = index.where(F.col("blocks") == blocks).join(wanted, [*lead, "block"]).where(held).select(FILE)
        found = some if found is None else found.unionByName(some)
    return (index.select(FILE).limit(0) if found is None else found).distinct()


def named(files: DataFrame) -> list[str]:
    """Paths of index rows as a reader takes them. The driver holds one a file, as Spark's own
    listing of the table does."""
    return sorted(unquote(r[0]) for r in files.collect())


def rows_of(
    spark: SparkSession, path: str, schema: StructType, index: DataFrame, requests: DataFrame, by: list[str]
) -> DataFrame:
    """The rows of a stored table that lie in files which may hold a requested key."""
    return stored(spark, path, schema, named(files_with(index, requests, by)))


# --- text -----------------------------------------------------------------------


def folded(text: Column) -> Column:
    """Text in lower case, with the letters that only match when case is ignored as plain ones."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), *patterns.FOLDED))


def gram_bit(codes):
    """The bit of trigrams given as 24-bit numbers (one, or an array of them)."""
    return ((codes * 0x9E3779B1) & 0xFFFFFFFF) >> 17


def _runs(it) -> Iterator:
    import numpy as np
    import pyarrow as pa

    run, bits, made = None, np.zeros(GRAM_BITS, bool), []

    def close():
        return (*run, np.packbits(bits, bitorder="little").tobytes())

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], [FILE, "run", "grams"])

    for rows in it:
        columns = (rows.column(rows.schema.get_field_index(n)) for n in (FILE, "run", "text"))
        for file, number, text in zip(*(c.to_pylist() for c in columns)):
            if (file, number) != run:
                if run is not None:
                    made.append(close())
                run, bits = (file, number), np.zeros(GRAM_BITS, bool)
            # A long text goes through in stretches that share two bytes.
            for start in range(0, len(text) - 2, 1 << 20):
                raw = np.frombuffer(text[start : start + (1 << 20) + 2], np.uint8).astype(np.uint64)
                bits[gram_bit(raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]).astype(np.int64)] = True
            if len(made) >= 500:
                yield batch()
                made = []
    if run is not None:
        made.append(close())
    if made:
        yield batch()


def text_index(rows: DataFrame, text: str = "text", rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """The text index of stored rows: (_file, run, rows_per_run, grams), in one pass without a shuffle.

    A run that is cut by a file split has a row for each part. Each row of text is in one of
    them, so a run is searched if any of its rows passes.
    """
    number = F.floor(F.col("_metadata.row_index") / rows_per_run).cast("long").alias("run")
    read = rows.select(_file().alias(FILE), number, folded(F.col(text)).cast("binary").alias("text"))
    made = read.mapInArrow(_runs, f"{FILE} string, run long, grams binary")
    return made.withColumn("rows_per_run", F.lit(rows_per_run))


def holds(grams: Column, need) -> Column:
    """Whether a bitmap can hold what ``needed_trigrams`` says."""
    if need is None:
        return F.lit(True)
    if isinstance(need, str):
        bit = int(gram_bit(int.from_bytes(need.encode("ascii"), "big")))
        byte = F.conv(F.hex(F.substring(grams, bit // 8 + 1, 1)), 16, 10).cast("int")
        return F.call_function("getbit", byte, F.lit(bit % 8)) == 1
    kind, parts = need
    tests = [holds(grams, p) for p in parts]
    out = tests[0]
    for test in tests[1:]:
        out = out & test if kind == "all" else out | test
    return out


def runs_with(index: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """(_file, run, rows_per_run) of all runs that may hold a match of a Python pattern."""
    need = patterns.needed_trigrams(pattern, ignore_case)
    return index.where(holds(F.col("grams"), need)).select(FILE, "run", "rows_per_run").distinct()


def rows_matching(
    spark: SparkSession, path: str, schema: StructType, index: DataFrame, pattern: str, ignore_case: bool = True
) -> DataFrame:
    """The rows of a stored table in runs that may hold a match; other files are not opened.

    The runs are written down, so that Spark sees how few they are when it joins them.
    """
    runs = cut_lineage(runs_with(index, pattern, ignore_case))
    sizes = [r[0] for r in runs.select("rows_per_run").distinct().collect()]
    out = stored(spark, path, schema, named(runs.select(FILE).distinct()))
    if not sizes:
        return out
    numbered = out.withColumn(FILE, _file()).withColumn("_at", F.col("_metadata.row_index"))
    found = None
    for size in sizes:
        here = runs.where(F.col("rows_per_run") == size).select(FILE, "run")
        some = numbered.withColumn("run", F.floor(F.col("_at") / size).cast("long")).join(here, [FILE, "run"], "left_semi")
        found = some if found is None else found.unionByName(some)
    return found.select(*schema.fieldNames())


# --- upkeep ---------------------------------------------------------------------


def refresh(
    spark: SparkSession, path: str, schema: StructType, index_path: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Index the files of a table that the index at ``index_path`` does not know yet; returns the index.

    Rows of files that are gone stay behind and name nothing that is read: ``current`` drops them.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index_path)
    known: set[str] = set()
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        known = {r[0] for r in spark.read.parquet(index_path).select(FILE).distinct().collect()}
    fresh = sorted(unquote(f) for f in _files(stored(spark, path, schema)) if f not in known)
    if fresh or not known:
        build(stored(spark, path, schema, fresh)).write.mode("append").parquet(index_path)
    return current(spark.read.parquet(index_path), stored(spark, path, schema))


def current(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Index rows of files that the table still has."""
    files = _files(rows)
    if not files:
        return index.limit(0)
    spark = index.sparkSession
    return index.join(spark.createDataFrame([(f,) for f in files], f"{FILE} string"), FILE, "left_semi")
