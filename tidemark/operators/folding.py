"""Hash chains folded in order, without ever holding a run of entries.

Rows of one run are dealt to one task and sorted there; the task reads them batch
by batch and carries a hash from each to the next. A run may be longer than
memory: what is held is one batch and the hash. A chain has to be followed in
order by nature, so one run is one task's work; other runs are others'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv

FIRST, ENTRY, ADDED = 0, 1, 2


def _linked(previous: str | None, text: str | None) -> str | None:
    if previous is None or text is None:
        return None
    return hashlib.sha256((previous + text).encode()).hexdigest()[: fv.CHAIN_LENGTH]


def _batch(done: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) if done else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "n" else pa.string()) for c, n in zip(columns, names, strict=True)], names=names)


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one partition, sorted.

    Dealt by a hash of their own: parts of a union that are already partitioned by
    the keys would else be put together as they are, and adaptive execution may
    have coalesced them differently.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "kind", "n")


def chained(rows: DataFrame) -> DataFrame:
    """``repo, log, n, stored, expected`` of the last entry of every run.

    ``rows(repo, log, segment, kind, n, text, stored)``: entries of kind ``ENTRY``,
    and for runs that do not begin a log one row of kind ``FIRST`` whose text is the
    hash they rest on. Each entry's hash is taken over the one before and its text.
    """
    names = ["repo", "log", "n", "stored", "expected"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, acc = None, None, fv.CHAIN_GENESIS
        for batch in batches:
            done = []
            for repo, log, segment, kind, n, text, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (repo, log, segment) != key:
                    if held:
                        done.append((*held, acc))
                    key, held, acc = (repo, log, segment), None, fv.CHAIN_GENESIS
                if kind == FIRST:
                    acc = text
                else:
                    acc, held = _linked(acc, text), (repo, log, n, stored)
            yield _batch(done, names)
        if held:
            yield _batch([(*held, acc)], names)

    plain = rows.select("repo", F.col("log").cast("string").alias("log"), "segment", "kind", F.col("n").cast("long").alias("n"), "text", "stored")
    out = _in_order(plain, ["repo", "log", "segment"]).mapInArrow(run, "repo string, log string, n long, stored string, expected string")
    return out.select("repo", F.col("log").cast(kinds["log"]).alias("log"), F.col("n").cast(kinds["n"]).alias("n"), "stored", "expected")


def stamped(rows: DataFrame) -> DataFrame:
    """``repo, log, n, text, stored`` of the rows of kind ``ADDED``; the hash is taken over all texts of the log up to it.

    ``rows(repo, log, kind, n, text)``: of kind ``FIRST`` the hash that the log's end
    rests on, of kind ``ENTRY`` the entries behind it, in one piece with the addition.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, upto = None, hashlib.sha256()
        for batch in batches:
            done = []
            for repo, log, kind, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (repo, log) != key:
                    key, upto = (repo, log), hashlib.sha256(b"" if kind == FIRST else fv.CHAIN_GENESIS.encode())
                if kind != ADDED:
                    upto.update((text or "").encode())
                else:
                    own = upto.copy()
                    own.update((text or "").encode())
                    done.append((repo, log, n, text, None if text is None else own.hexdigest()[: fv.CHAIN_LENGTH]))
            yield _batch(done, ["repo", "log", "n", "text", "stored"])

    plain = rows.select("repo", F.col("log").cast("string").alias("log"), "kind", F.col("n").cast("long").alias("n"), "text")
    out = _in_order(plain, ["repo", "log"]).mapInArrow(run, "repo string, log string, n long, text string, stored string")
    return out.select("repo", F.col("log").cast(kinds["log"]).alias("log"), F.col("n").cast(kinds["n"]).alias("n"), "text", "stored")
