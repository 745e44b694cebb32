"""Written results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import folding
from tidemark.operators.snapshots import log_chain_verify

SCHEMA_VERSION = "1.0.0"


def write_run(findings: DataFrame, run_id: str, path: str, fmt: str = "parquet") -> None:
    """Findings of a run, partitioned by repository and run (2.1.16).

    A run that is written again replaces itself and nothing else. Rows are spread by a hash inside a repository, so that a repository with a
    third of all rows is written by many tasks.
    """
    stamped = findings.withColumn("run_id", F.lit(run_id)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "run_id").format(fmt).save(path)


def new_log_rows(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """Next row of each log with its chain hash (2.1.17).

    ``entries(repo, log, n, text, stored)``, ``additions(repo, log, text)``.
    Unstamped rows after the last stamp go into the hash together with the new
    text, one after the other; an earlier break is disclosed once in the new row.
    """
    keys = ["repo", "log"]
    last = entries.where(F.col("stored").isNotNull()).groupBy(*keys).agg(
        F.max_by("stored", "n").alias("previous"), F.max("n").alias("stamped_n")
    )
    size = entries.groupBy(*keys).agg(F.max("n").alias("last_n"))
    loose = entries.join(last.select(*keys, "stamped_n"), keys, "left").where(F.col("n") > F.coalesce("stamped_n", F.lit(0)))
    note = F.concat(F.lit("> **Warning:** History integrity broken at entry "), F.col("broken_at").cast("string"), F.lit(".\n\n"))
    rows = additions.join(size, keys, "left").join(last, keys, "left").join(log_chain_verify(entries), keys, "left")
    text = F.concat(F.coalesce(F.when(~F.col("valid"), note), F.lit("")), F.col("text"))
    added = rows.select(*keys, (F.coalesce("last_n", F.lit(0)) + 1).alias("n"), text.alias("text"), "previous")
    of_kind = lambda df, kind, n, text: df.select(*keys, F.lit(kind).alias("kind"), F.col(n).cast("long").alias("n"), F.col(text).alias("text"))
    wanted = loose.join(additions.select(*keys).distinct(), keys, "left_semi")
    parts = of_kind(added, folding.ADDED, "n", "text").unionByName(of_kind(wanted, folding.ENTRY, "n", "text"))
    parts = parts.unionByName(of_kind(added.where(F.col("previous").isNotNull()).dropDuplicates(keys), folding.FIRST, "n", "previous"))
    return folding.stamped(parts)


def append_log(entries: DataFrame, additions: DataFrame, path: str) -> None:
    new_log_rows(entries, additions).write.mode("append").partitionBy("repo").parquet(path)


def badge_rows(summary: DataFrame, stale: DataFrame) -> DataFrame:
    """Message and colour per repository (2.1.18).

    ``summary(repo, concern_kinds)``, ``stale(repo, total_stale)``.
    """
    rows = summary.select("repo", "concern_kinds").join(stale.select("repo", "total_stale"), "repo", "left").na.fill(0)
    return rows.select(
        "repo",
        F.format_string("%d findings · %d stale markers", F.col("concern_kinds"), F.col("total_stale")).alias("message"),
        scores.badge_color(F.col("concern_kinds"), F.col("total_stale")).alias("color"),
    )


def write_badges(badges: DataFrame, path: str) -> None:
    badges.write.mode("overwrite").json(path)


def write_actions(actions: DataFrame, path: str) -> None:
    """The durable action table, one partition per repository (2.1.19); other repositories keep theirs."""
    actions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)
