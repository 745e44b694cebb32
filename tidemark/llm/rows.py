"""Identity of document rows, and removing rows without shuffling more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a missing id: after all others.
NO_ID = 2**63 - 1


def text_digest(text_col: str) -> Column:
    """MD5 of a text's UTF-8 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows of ``dropped`` (``doc_id, digest``), and one of those that repeat an id with an equal text.

    Among repeated rows, the one whose other columns come first as JSON text
    stays. The anti join and the choice use one partitioning, by id and digest.
    """
    own_id, digest = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_digest(text_col).alias("digest")
    keyed = docs.select(whole_row(docs).alias("row"), own_id, digest)
    gone = dropped.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest").distinct()
    left = keyed.join(gone, ["id", "digest"], "left_anti")
    others = [F.col("row").getField(c) for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(others)])) if others else F.lit("")
    first = F.row_number().over(Window.partitionBy("id", "digest").orderBy(order))
    return left.withColumn("place", first).where("place = 1").select("row.*")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one value, so that no name of theirs meets another."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name
