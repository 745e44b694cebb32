"""Connected components by per-task forests and star contraction.

Nodes get numbers in the order of their names, so the smallest number of a
component is its smallest name. Every task first replaces the links it holds by
a spanning forest of them, at most one link per node and task. Star rounds then
move links towards smaller nodes: every node passes its smallest neighbour on to
its larger ones, then its smaller ones to the smallest. A round is two joins and
two minima, so a node with very many links is an ordinary hot key, and the number
of rounds grows with the logarithm of the longest chain that is left.

The state is a written table; the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import stage, unstage

LINKS_HELD = 500_000


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of ``n`` positions that each can reach along the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], least)
        np.minimum.at(fresh, label[b], least)
        while (fresh[fresh] != fresh).any():
            fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = lowest(len(nodes), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def forest(links: DataFrame) -> DataFrame:
    """``a, b`` with ``a > b``: per task a spanning forest of the links ``a, b`` it holds, ``LINKS_HELD`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > LINKS_HELD:
                a, b = _spanned(a, b)
                if len(a) > LINKS_HELD // 2:  # a tree this large would be spanned over and over: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = _spanned(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """``a, b`` for every number ``a`` that stands in a link, but for the roots; ``b`` is the smallest it reaches. A staged table."""
    state = stage(forest(links).distinct(), "links")
    mark = None
    while True:
        size = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if size[0] == 0 or size == mark:
            return state
        mark = size
        least = state.groupBy("a").agg(F.min("b").alias("low"))
        # a key of its own, so that adaptive execution can split a node with very many links
        near = state.join(least.withColumn("a", F.col("a").bitwiseXOR(F.lit(0))), "a")
        # links point down: a node's neighbours below it meet at the smallest of them
        small = near.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = least.select("a", F.col("low").alias("b")).unionByName(small)
        # and jump to where the smallest one points itself
        jump = stage(stars.distinct(), "links")
        unstage(state)
        below = jump.groupBy("a").agg(F.min("b").alias("low"))
        onward = below.select(F.col("a").alias("b"), F.col("low").alias("next"))
        moved = jump.join(onward, "b", "left").select("a", F.coalesce("next", "b").alias("b"))
        # the smallest neighbour keeps every step that is skipped connected
        kept = moved.unionByName(below.select("a", F.col("low").alias("b"))).where("a <> b")
        state = stage(forest(kept.distinct()).distinct(), "links")
        unstage(jump)


def islands(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``repo, node, component`` of every node of ``nodes(repo, node)`` over ``links(repo, a, b)``: its component's smallest node."""
    ordered = nodes.select("repo", "node").distinct().repartitionByRange("repo", "node").sortWithinPartitions("repo", "node")
    numbered = stage(ordered.withColumn("id", F.monotonically_increasing_id()), "numbers")
    end = lambda c: numbered.select("repo", F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    pairs = links.where("a <> b").join(end("a"), ["repo", "a"]).join(end("b"), ["repo", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    roots = contracted(pairs)
    rooted = roots.select(F.col("a").alias("id"), F.col("b").alias("root"))
    named = numbered.join(rooted, "id", "left").select("repo", "node", F.coalesce("root", "id").alias("root"))
    first = numbered.select(F.col("id").alias("root"), F.col("node").alias("component"))
    out = stage(named.join(first, "root").select("repo", "node", "component"), "islands")
    unstage(numbered, roots)
    return out
