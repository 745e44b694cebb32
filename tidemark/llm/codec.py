"""Encoding and decoding of whole documents with a public BPE vocabulary.

The cutting into fragments is in ``bpe``. Null texts count as empty; every row
gives a row, repeated ones too; an empty table gives none. Columns other than
the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import codec, id_batches, sha256

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, ids in id_batches(batch, "text", tokenizer):
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                bounds = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.ListArray.from_arrays(bounds, flat)], names=ENCODED.names)

    return _named(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of encoded documents; null ids give an empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = [own.decode(np.asarray(x.as_py() or [], "<u4").tobytes()).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of its ids and digests of the ids and of the text decoded from them.

    Encodes and decodes in one pass, so that the ids of a corpus are never
    shuffled or written to be counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for first, texts, ids in id_batches(batch, "text", tokenizer):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x) for x in ids]), pa.array([sha256(own.decode(x)) for x in ids]),
                    ],
                    names=DIGESTS.names,
                )

    return _named(docs, id_col, text_col).mapInArrow(run, DIGESTS)
