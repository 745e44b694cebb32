"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash of the last
16 bytes is small, so an insertion moves only the chunks it touches. Chunks
are told apart by 128-bit digests. A chunk is repeated if its digest occurs again
anywhere. Runs of neighbouring repeated chunks of ``min_run`` bytes or more go,
but for the first occurrence of each chunk by id and place; shorter runs, such as a
licence line, stay.

A first scan counts 64-bit keys, summed before the shuffle; a Bloom-style table
of fixed size then lets the second scan emit possibly repeated chunks only. What
the table lets through by chance is settled by the full digests. Chunks are
joined to facts about their digest, so a digest that very many documents share is
split like any hot key.

Cuts fall between characters, so what is kept is valid text. Null texts count as
empty. Rows without an id come last in the order of occurrences; rows with equal
id and text are one document and get one result. An empty table gives no rows;
columns other than the two named are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks
from tidemark.llm.filters import bit_table, in_table
from tidemark.llm.rows import NO_ID, text_digest, whole_row
from tidemark.staging import stage

_GEAR = np.random.default_rng(32_077).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_WINDOW_ROUNDS = 4  # doublings: the hash covers 2 ** 4 bytes


def chunk_ends(data: np.ndarray, offsets: np.ndarray, average: int = 32, least: int = 12, most: int = 256) -> list[np.ndarray]:
    """Ends of the chunks of each text ``data[offsets[i]:offsets[i + 1]]``, as positions in ``data``."""
    n = len(data)
    rolled = _GEAR[data]
    for r in range(_WINDOW_ROUNDS):
        step = 1 << r
        later = rolled.copy()
        later[step:] += rolled[:-step] << np.uint32(step)
        rolled = later
    small = (rolled * np.uint32(0x9E3779B1)) < np.uint32((1 << 32) // average)
    begins_char = np.ones(n + 1, bool)
    begins_char[:n] = (data & 0xC0) != 0x80
    # A window that began in the text before tells nothing about this one: such places are never cuts.
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)) >= (1 << _WINDOW_ROUNDS) - 1
    places = np.flatnonzero(small & inside & begins_char[1:]) + 1
    bounds = np.searchsorted(places, offsets)
    out = []
    for i in range(len(offsets) - 1):
        last, end = int(offsets[i]), int(offsets[i + 1])
        ends = []
        for place in [*places[bounds[i] : bounds[i + 1]].tolist(), end]:
            if place - last < least and place != end:
                continue
            while place - last > most:
                last += most
                while not begins_char[last]:
                    last += 1
                ends.append(last)
            if place > last:
                ends.append(place)
                last = place
        out.append(np.array(ends, np.int64))
    return out


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), text_digest(text_col).alias("_digest")]


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = 32, least: int = 12, most: int = 256) -> DataFrame:
    """``_id, _digest, chunks`` of the documents with repeated chunks; ``chunks``: array of ``start, end, first``."""
    context = docs.sparkSession.sparkContext

    def portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[bytes]]]:
        for row, texts in text_chunks(batch.column("text"), 1 << 20):
            joined = b"".join(texts)
            offsets = np.cumsum([0, *map(len, texts)])
            ends = chunk_ends(np.frombuffer(joined, np.uint8), offsets, average, least, most)
            flat = np.concatenate([np.zeros(0, np.int64), *ends])
            begins = np.concatenate([[0], flat[:-1]]) if len(flat) else flat
            digests = [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(begins.tolist(), flat.tolist(), strict=True)]
            yield row, ends, offsets, digests

    def head(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)[:, 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, digests in portions(batch):
                keys, n = np.unique(head(digests), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    text = _text(text_col).alias("text")
    twice = docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    table = context.broadcast(bit_table(twice, "key"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ends, offsets, digests in portions(batch):
                flat = np.concatenate([np.zeros(0, np.int64), *ends])
                keep = np.flatnonzero(in_table(table.value, head(digests)))
                if not len(keep):
                    continue
                doc = np.repeat(np.arange(len(ends)), [len(x) for x in ends])[keep]
                begins = np.concatenate([[0], flat[:-1]])[keep]
                at = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(at), batch.column("_digest").take(at), pa.array(begins - offsets[doc]), pa.array(flat[keep] - offsets[doc]),
                        pa.array([digests[k] for k in keep.tolist()], pa.binary()),
                    ],
                    names=["_id", "_digest", "start", "end", "chunk"],
                )

    rows = docs.select(*_identity(docs, id_col, text_col), text).mapInArrow(emit, "_id long, _digest binary, start long, end long, chunk binary")
    rows = stage(rows, "chunks")
    place = F.struct("_id", "_digest", "start")
    facts = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).where("n > 1").select("chunk", "origin")
    # A key of its own: both sides are dealt out anew, and a chunk that very many documents share can be split.
    facts = facts.withColumn("chunk", F.substring("chunk", 1, 16))
    repeated = rows.join(facts, "chunk").select("_id", "_digest", "start", "end", (place == F.col("origin")).alias("first"))
    return repeated.groupBy("_id", "_digest").agg(F.collect_set(F.struct("start", "end", "first")).alias("chunks"))


def runs(chunks: list[tuple[int, int, bool]], min_run: int) -> tuple[int, list[tuple[int, int]]]:
    """Bytes in runs of repeated chunks of ``min_run`` or more, and the spans of them that go."""
    total, spans, run = 0, [], []
    for chunk in [*sorted(chunks), None]:
        if chunk is not None and (not run or run[-1][1] == chunk[0]):
            run.append(chunk)
            continue
        size = run[-1][1] - run[0][0] if run else 0
        if size >= min_run:
            total += size
            for start, end, first in run:
                if not first:
                    if spans and spans[-1][1] == start:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
        run = [chunk] if chunk is not None else []
    return total, spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 80, average: int = 32, least: int = 12, most: int = 256, out: str = "_cut"
) -> DataFrame:
    """``docs`` with a column ``out``: ``repeated`` (bytes in long runs), ``spans`` (byte spans that go) and ``kept`` (the text that stays).

    ``out`` must not be a column of ``docs`` (see ``rows.free_name``); all other names are free.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is a column already")
    found = repeated_chunks(docs, id_col, text_col, average, least, most)

    @F.pandas_udf("repeated long, spans array<struct<start: long, end: long>>, kept string")
    def cut(texts: pd.Series, chunks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, chunks, strict=True):
            total, spans = (0, []) if own is None else runs([(c["start"], c["end"], c["first"]) for c in own], min_run)
            if spans:
                data = text.encode()
                bounds = [0, *(x for span in spans for x in span), len(data)]
                text = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)).decode()
            rows.append((total, [{"start": a, "end": b} for a, b in spans], text))
        return pd.DataFrame(rows, columns=["repeated", "spans", "kept"])

    keyed = docs.select(whole_row(docs).alias("row"), *_identity(docs, id_col, text_col))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    joined = keyed.join(found, ["_id", "_digest"], "left").select("row", cut(text, "chunks").alias("cut"))
    return joined.select("row.*", F.col("cut").alias(out))
