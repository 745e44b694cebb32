"""Packing of documents into sequences by vector best fit.

A piece of a document uses three resources of a sequence: tokens, one place
among its documents, and attention cost (the square of its length). All three
follow from its length, so pieces of one length are alike: the plan is made
over the histogram of lengths, at most ``capacity`` entries however many
documents there are, and the pieces then take the planned places by their
number among the pieces of their length. Counting, numbering and placing run
on Spark; only the histogram reaches the driver.

Bins with the same content are planned together as one class. A step moves a
whole class or exhausts a length, so there are at most two classes per length
more than there were (``2 * capacity`` in all), whatever the counts.

Null texts count as empty; rows without an id are packed like any other, and
repeated rows are separate documents. An empty table gives no rows. Columns
other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import id_batches
from tidemark.staging import stage


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; ``None`` stands for the most that the tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids: only those longer than ``capacity`` are cut, the first piece may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            names = batch.column("doc_id")
            for first, _, ids in id_batches(batch, "text", tokenizer):
                row, piece, start, length, crc = [], [], [], [], []
                for i, own in enumerate(ids, first):
                    own += end
                    n = len(own) // 4
                    at = 0
                    size = n if n <= capacity else n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[4 * at : 4 * (at + size)]))
                        at, size = at + size, capacity
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=PIECE.names,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECE)


@dataclass
class _Class:
    bins: int
    room: np.ndarray
    lengths: tuple[int, ...]


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), score: str = "norm") -> list[tuple[int, tuple[int, ...]]]:
    """``(bins, lengths of the pieces in each)``: best fit, longest pieces first.

    Among the classes of bins in which a piece keeps within every capacity, the
    piece goes where the weighted norm of the room left is least (``norm``), or
    where its demand and the room agree best (``dot``).
    """
    full = capacity.vector()
    weight = np.asarray(weights)
    room = np.zeros((0, 3))
    bins = np.zeros(0, np.int64)
    contents: list[tuple[int, ...]] = []
    closed: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, float(length) ** 2])
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left = counts[length]
        while left > 0:
            fits = np.flatnonzero((room >= need).all(axis=1))
            if len(fits):
                after = (room[fits] - need) / full
                worth = -(weight * after**2).sum(axis=1) if score == "norm" else (weight * (need / full) * (room[fits] / full)).sum(axis=1)
                k = fits[worth.argmax()]
                n = min(left, int(bins[k]))
                left -= n
                new_room, new = room[k] - need, (*contents[k], length)
                if n == bins[k]:
                    room[k], contents[k] = new_room, new
                else:
                    bins[k] -= n
                    room, bins = np.vstack([room, new_room]), np.append(bins, n)
                    contents.append(new)
                continue
            each = int((full // need).min())
            for n, of in ((left // each, each), (1, left % each)):
                if n and of:
                    room, bins = np.vstack([room, full - of * need]), np.append(bins, n)
                    contents.append((length,) * of)
            left = 0
        shut = (room[:, 0] < 1) | (room[:, 1] < 1) | (room[:, 2] < 1)
        if shut.any():
            closed += [(int(bins[k]), contents[k]) for k in np.flatnonzero(shut)]
            contents = [contents[k] for k in np.flatnonzero(~shut)]
            room, bins = room[~shut], bins[~shut]
    return closed + [(int(n), c) for n, c in zip(bins, contents, strict=True)]


def _places(planned: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first numbers of the runs of places, the sequence of each run's first place, and the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for bins, lengths in planned:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + bins
            offset += length
        base += bins
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def best_fit(pieces: DataFrame, length_col: str = "length", capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), score: str = "norm") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Every task numbers its pieces of each length as it writes them; sums over
    the tasks' counts turn those into numbers over all pieces.
    """
    fields = pieces.schema.fields
    numbered_schema = T.StructType([*fields, T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity.tokens + 1, np.int64)
        for batch in batches:
            sizes = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            of = sizes[order]
            first = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
            run = np.diff(np.append(first, len(of)))
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(first, run) + seen[of]
            seen[of[first]] += run
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), task), pa.int32()), pa.array(nth)], names=numbered_schema.names)

    numbered = stage(pieces.mapInArrow(number, numbered_schema), "pieces")
    counts = numbered.groupBy(F.col(length_col).alias("_length"), "_task").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity, weights, score)))
    earlier = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_length").alias("_l"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = numbered.join(before, (F.col(length_col) == F.col("_l")) & (F.col("_task") == F.col("_t")))
    ranked = ranked.select(*[F.col(f"`{f.name}`") for f in fields], (F.col("_nth") + F.col("_before")).alias("_rank"))
    placed = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(length_col).to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                first, base, at = places.value[int(size)]
                run = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = base[run] + ranks[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=placed.names)

    return ranked.mapInArrow(place, placed)
