"""Exact duplicates by progressive refinement, in DataFrame operations only.

1. Rows are counted by length and, within it, by the hash of a short prefix.
2. Groups with two or more rows survive. A Bloom-style table of ``FILTER_BITS``
   bits marks them; its size is fixed, so it is broadcast, and no text is ever
   shuffled to learn whether it survives.
3. Only the content of rows whose mark is set is hashed whole and grouped. A
   mark set by chance costs a hash, never a wrong result, because the last
   grouping is by length, prefix hash and full hash.

Null texts count as empty. Rows without an id take part: the largest id that
is not null stays for a group, and a group without ids has a null ``keep_id``
and keeps its rows. Rows that repeat an id with an equal text all count; all
carry ``kept`` if that id stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 256
FILTER_BITS = 1 << 22  # 65,536 words of 64 bits: at most about 1 MB on each executor


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, n_bytes, prefix_hash, digest, keep_id, group_size, kept`` per row.

    ``digest`` is null where length and prefix already prove the text unique.
    ``carry``: further columns, computed from ``docs`` in the scan.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix_hash"),
        *[c.alias(f"_carried_{name}") for name, c in carry.items()],
    )
    mark = F.pmod(F.xxhash64("n_bytes", "prefix_hash"), F.lit(FILTER_BITS))
    survivors = rows.groupBy("n_bytes", "prefix_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(mark.alias("_mark"))
    words = survivors.groupBy(F.expr("_mark div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_mark % 64 AS INT))")).alias("_bits"))
    marked = rows.withColumn("_mark", mark).withColumn("_word", F.expr("_mark div 64")).join(F.broadcast(words), "_word", "left")
    refined = marked.select(
        "doc_id", "n_bytes", "prefix_hash",
        F.when(F.expr("shiftright(_bits, CAST(_mark % 64 AS INT)) & 1L") == 1, F.unhex(F.sha2("_text", 256))).alias("digest"),
        *[f"_carried_{name}" for name in carry],
    )
    groups = (
        refined.where("digest IS NOT NULL").groupBy("n_bytes", "prefix_hash", "digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )
    # Joined by a key of its own, so that both sides are dealt out anew and a hot group of copies can be split.
    facts = groups.select(F.substring("digest", 1, 32).alias("_key"), "keep_id", "group_size")
    joined = refined.withColumn("_key", F.coalesce("digest", F.unhex(F.hex("prefix_hash")))).join(facts, "_key", "left")
    grouped = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id", "n_bytes", "prefix_hash", "digest",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *[F.col(f"_carried_{name}").alias(name) for name in carry],
    )
