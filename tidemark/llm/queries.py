"""One registered query per corpus operator, over its whole table, and the SQL that must return the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, chunking, codec, embeddings, exact, html, packing, pieces, quality, runs, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary; every machine of the cluster has it in its own Python."""
    return public_tokenizers.path(name)


#: Rows that go to a Python worker at once: whole documents, some very long, so far fewer than Spark's 10,000.
ROWS_AT_ONCE = 1_000


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and read documents in small batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}" if known else home
    return spark


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(reachable(spark), folder)
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens; documents and attention as far as the tokens allow."""
    pieces = packing.cut_documents(_table(spark, folder, "documents"), vocabulary(), capacity=2048, end_id=0)
    return packing.best_fit(pieces, capacity=packing.Capacity(tokens=2048))


@query
def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return codec.round_trip(_table(spark, folder, "documents"), vocabulary())


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, folder, "documents"), carry={"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _held_out(parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = _table(spark, folder, "labels").where(~_held_out(5, 0))
    return _judged(quality.classify(_table(spark, folder, "documents"), labels, "quality"), _held_out(5, 0))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = toxicity.fit(documents, _table(spark, folder, "labels").where(~_held_out(4, 2)), "toxic")
    return _judged(documents.select("doc_id", toxicity.score_column(documents, model).alias("score")), _held_out(4, 2))


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


@query
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"), threshold=0.93)


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.remove_repeats(_table(spark, folder, "documents"), least=200)
    kept_bytes = F.length("kept").cast("long")
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept_bytes).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the bytes in repeated runs of chunks, what of them goes (all but first occurrences), and the rest's digest."""
    cut = chunking.remove_repeats(_table(spark, folder, "documents"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), F.col("_cut.repeated").alias("n_repeated"), (n_bytes - F.octet_length("_cut.kept")).alias("n_removed"),
        F.size("_cut.spans").cast("long").alias("n_spans"), F.sha2("_cut.kept", 256).alias("kept_sha256"),
    )


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(_table(spark, folder, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order in which the query takes a document's words: every tenth id repeats a stretch up to the end."""
    chosen, times = divmod(zlib.crc32(str(doc_id).encode()), 10)[::-1] if doc_id is not None else (1, 0)
    if chosen or not n:
        return None
    begin = times % n
    period = 1 + (n - begin) // (3 + times % 8)
    order = np.arange(n)
    order[begin:] = begin + np.arange(n - begin) % period
    return order


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its runs' number and digest, the longest one, and the digest of the collapsed words."""
    found = runs.periodic_runs(_table(spark, folder, "documents"), order=planted_order)
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", ranked)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
