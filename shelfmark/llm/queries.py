"""The operators of this package as registered queries over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audit, bpe, fingerprints, langid, minhash, mixing, pieces, pivots, prefix_trie, secrets, substring, token_files, toxicity,
)
from .common import read
from .sql import AUDIT_SQL, MIXING_SQL, SECRETS_SQL, TRIE_SQL


def op1_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: shingles of three words, 85 percent shared."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    made = fingerprints.neighbours(read(spark, sf_dir, "documents"))

    @F.pandas_udf("near_edited double, near_next double")
    def near(own: pd.Series, changed: pd.Series, following: pd.Series) -> pd.DataFrame:
        like = fingerprints.likeness
        return pd.DataFrame(
            {"near_edited": [*map(like, own, changed)], "near_next": [*map(like, own, following)]}, dtype=float
        )

    digested = made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near("fingerprint", "edited_fingerprint", "next_fingerprint").alias("near"),
    )
    return digested.select("*", "near.*").drop("near")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of the corpus: base rules first, then the further rules over the same ledger."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger, findings, _ = secrets.scan(docs, secrets.BASE_RULES)
    _, _, by_path = secrets.scan(docs, secrets.RULES, ledger, findings)
    base = secrets.of_kinds(F.col("spans"), *(r.kind for r in secrets.BASE_RULES))
    count = lambda kind: F.size(secrets.of_kinds(F.col("spans"), kind)).cast("long")
    return by_path.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that start in an earlier one."""
    found = substring.repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select("doc_id", "n_words", gone.alias("n_removed"), "kept_sha256")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written for the whole corpus, and what their frames hold when read back."""
    docs = read(spark, sf_dir, "documents")
    held = token_files.read_back(token_files.write(docs, bpe.load(spark)))
    return held.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_bpe_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    tokenizer = bpe.load(spark)
    coded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every text is, by a network that never saw the held-out rows."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    flag = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", flag)


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    p = mixing.plan(read(spark, sf_dir, "documents"))
    return p.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def op10_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by machines that never saw the held-out rows."""
    docs = read(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as pieces with their source bytes, and decoded again."""
    model = pieces.load(spark)
    coded = pieces.decode(pieces.encode(read(spark, sf_dir, "documents"), model), model)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        covered.alias("n_bytes_covered"),
    )


def op12_prefix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that share first turns."""
    return prefix_trie.nodes(read(spark, sf_dir, "conversations"))


def op13_radix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, keeps and costs in all orders, for each language."""
    failed = audit.failures(read(spark, sf_dir, "documents"))
    return audit.interactions(failed, read(spark, sf_dir, "labels"))


_OPS = {
    "op1_setsketch_dedup": (op1_setsketch_dedup, None),
    "op2_syncmer_fingerprints": (op2_syncmer_fingerprints, None),
    "op3_secret_ledger": (op3_secret_ledger, SECRETS_SQL),
    "op4_block_anchors": (op4_block_anchors, None),
    "op5_token_files": (op5_token_files, None),
    "op6_bpe_boundaries": (op6_bpe_boundaries, None),
    "op7_pivot_permutations": (op7_pivot_permutations, None),
    "op8_toxicity_network": (op8_toxicity_network, None),
    "op9_weighted_mix": (op9_weighted_mix, MIXING_SQL),
    "op10_language_families": (op10_language_families, None),
    "op11_piece_spans": (op11_piece_spans, None),
    "op12_prefix_slots": (op12_prefix_slots, TRIE_SQL),
    "op13_radix_audit": (op13_radix_audit, AUDIT_SQL),
}


def queries():
    return {name: build for name, (build, _) in _OPS.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _OPS.items() if sql is not None}
