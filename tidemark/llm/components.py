"""Connected components over a table of links, for the operators on pairs.

Star operations: every node passes its smallest neighbour on to its larger
ones, then its smaller ones to the smallest. A round takes equi-joins and
minima only, so a node with very many links is split like any hot key; the
number of rounds grows with the logarithm of the longest chain. Before the first
round every task replaces the links it holds by a spanning forest of them.

States are written tables in the shared folder; only a count and a checksum
reach the driver. The state before the last is deleted after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import delete_staged, staged_path


LINKS_HELD = 500_000  # links a task reads before it replaces them by a forest


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def spanning(links: np.ndarray) -> np.ndarray:
    """A forest that joins the same nodes as ``links`` (two rows: ends), by the smallest node of each tree."""
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(links.shape)
    label = roots(len(nodes), at[0], at[1])
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[linked], nodes[label[linked]]])


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches in portions that never part rows with equal first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    join = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        same = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        before = np.flatnonzero(~same)
        at = int(before[-1]) + 1 if len(before) else 0
        if at:
            held.append([c[:at] for c in columns])
        elif held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], columns[:keys], strict=True)):
            yield join()
            held = []
        if at:
            yield join()
            held = []
        held.append([c[at:] for c in columns])
    if held:
        yield join()


def dealt_anew(key: str) -> Column:
    """A long key as a value of its own, for the grouped side of a join with the rows it was grouped from.

    Spark then deals both sides out anew, and so can split a key with very many
    rows, which it cannot where it reuses the partitions of the grouping.
    """
    return F.col(key).bitwiseXOR(F.lit(0))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = np.zeros((2, 0), np.int64)
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
        if sum(x.shape[1] for x in held) > LINKS_HELD:
            links, held = spanning(np.concatenate([links, *held], axis=1)), []
    links = spanning(np.concatenate([links, *held], axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that stands in a link; ``component`` is its smallest node.

    ``links``: two long columns without nulls, in any direction, repeated or not.
    """
    spark = links.sparkSession
    a, b = links.columns
    schema = "a long, b long"
    state = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b").mapInArrow(_forest, schema)
    path, mark = staged_path(spark, "links"), None
    state.distinct().write.parquet(path)
    while True:
        now = spark.read.schema(schema).parquet(path)
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size[0] == 0 or tuple(size) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = tuple(size)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = dealt_anew("a").alias("a")
        least = both.groupBy("a").agg(F.min("b").alias("_low")).select(own, F.least("a", "_low").alias("_low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        kept = now.where("a > b").unionByName(large.where("a > b")).distinct()
        # Every larger node now points at smaller ones; they all move to the smallest.
        lowest = kept.groupBy("a").agg(F.min("b").alias("_low"))
        small = kept.join(lowest.select(own, "_low"), "a").where("b != _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        ends = lowest.select("a", F.col("_low").alias("b"))
        after = staged_path(spark, "links")
        ends.unionByName(small).distinct().write.parquet(after)
        delete_staged(spark, path)
        path = after
