"""Incremental churn and first-flagged state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import staged_path

CHURN_KEYS = ["repo", "path"]


def churn_windows(touches: DataFrame, window: str = "30 days", lateness: str = "7 days") -> DataFrame:
    """Commits per file and time window, repeated deliveries dropped (2.12.1).

    ``touches(ts TIMESTAMP, repo, sha, path)`` as a stream.
    """
    once = touches.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["repo", "sha", "path"])
    return once.groupBy(F.window("ts", window), *CHURN_KEYS).agg(F.count(F.lit(1)).alias("commits"))


def first_flagged(snapshots: DataFrame) -> DataFrame:
    """First and last run that lists a path, and the number of runs (2.12.2).

    ``snapshots(repo, path, run BIGINT)`` as a stream; the state per file is three
    numbers of a built-in aggregate, whatever the number of runs.
    """
    return snapshots.groupBy(*CHURN_KEYS).agg(
        F.min("run").alias("first_flagged"), F.max("run").alias("last_run"), F.count(F.lit(1)).alias("runs")
    )


def _batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch_no={epoch}")

    return write


def _run(stream: DataFrame, mode: str, progress: str, path: str) -> int:
    """Everything available goes through the stream; the rows that came too late for its state are counted."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(_batch_writer(path)).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for batch in query.recentProgress for op in batch["stateOperators"])


def _result(spark: SparkSession, schema: str, path: str, keys: list[str] | None) -> DataFrame:
    written = spark.read.schema(f"{schema}, epoch_no long").parquet(path)
    if keys:
        fields = [c for c in written.columns if c != "epoch_no"]
        latest = written.groupBy(*keys).agg(F.max_by(F.struct(*fields), "epoch_no").alias("r"))
        return latest.select("r.*")
    return written.drop("epoch_no")


def _schema(stream: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Each batch overwrites a folder of its own, so one that is tried again is not
    written twice. In update mode a later batch replaces the rows of the same keys.
    """
    path = staged_path(spark, name)
    _run(stream, mode, staged_path(spark, f"{name}-progress"), path)
    return _result(spark, _schema(stream), path, keys)


def drain_landings(
    landings: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, mode: str, keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """What a stream wrote over rows that land bit by bit, and ``run, late_rows``.

    Each landing is written by as many tasks as its rows come in, then a run of the
    stream takes all of it and goes on from the state and watermark of the run
    before. Rows behind the watermark are dropped by the state operators; their
    number per run is the second result, so that nothing is lost unseen.
    """
    spark = landings[0].sparkSession
    landed, path, progress = (staged_path(spark, f"{name}{x}") for x in ("-landed", "", "-progress"))
    late, schema = [], ""
    for i, landing in enumerate(landings):
        landing.write.mode("append").parquet(landed)
        stream = build(spark.readStream.schema(landing.schema).parquet(landed))
        schema = _schema(stream)
        late.append((i, _run(stream, mode, progress, path)))
    return _result(spark, schema, path, keys), spark.createDataFrame(late, "run int, late_rows long")
