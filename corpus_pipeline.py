"""The corpus pipeline: documents in, token ids out, each stage written and read again.

Every stage but the last returns the columns of ``documents``; what it decides takes effect:
toxic documents go, one document of each group of near-duplicates stays, secrets are blotted
out, and sources are mixed to their target weights (documents of favoured sources twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, minhash, mixing, secrets, toxicity
from shelfmark.session import cut_lineage

#: A document of at least this score is rejected; higher than the operator's flag, to keep clean ones.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic; it learns from the labels of this corpus."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score_col="_toxicity_score")
    return scored.filter(F.col("_toxicity_score") < REJECT).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of smallest id.

    Rows without an id, or without a word, are not near any other and stay; rows repeated under
    one id are one document and stay or go together.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = found.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row."""
    coded = bpe.encode(docs, bpe.load(spark))
    ids = F.col("ids")
    return coded.select("doc_id", ids, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("secrets", blot_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained network decides in the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
