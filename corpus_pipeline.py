"""A training-data pipeline over ``documents``: filter, deduplicate three ways, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. ``run`` writes each stage's rows to the shared folder and
reads them back, so a lost executor costs one stage's tasks at most. Nulls,
empty texts and repeated rows are treated as the operators document; an empty
table passes through all stages and gives no rows. Extra columns of ``docs`` are
kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunking, exact, packing, simhash, toxicity
from tidemark.llm.queries import reachable, vocabulary
from tidemark.llm.rows import free_name, text_digest, without
from tidemark.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 with the classifier learned from all labels."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.score_column(docs, toxicity.fit(docs, labels)) < 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; of rows that repeat it, one."""
    found = exact.exact_duplicates(docs, carry={"text_digest": text_digest("text")})
    return without(docs, found.where(~F.col("kept")).select("doc_id", F.col("text_digest").alias("digest")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, by way of others too, the one with the smallest id."""
    reachable(spark)
    found = simhash.similar_documents(docs, similarity=0.8, width=5)
    return without(docs, found.where(~F.col("kept")).select("doc_id", "digest"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated passages that occur before; ``n_chars`` follows the text, nulls stay null."""
    reachable(spark)
    name = free_name(docs, "_cut")
    cut = chunking.remove_repeats(docs, out=name)
    kept = F.col(f"{name}.kept")
    changed = {"text": F.when(F.col("text").isNotNull(), kept)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(f"{name}.spans") > 0, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    reachable(spark)
    return packing.best_fit(packing.cut_documents(docs, vocabulary(), capacity=2048, end_id=0), capacity=packing.Capacity(tokens=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# Fingerprints, rolling hashes, a trained model and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
