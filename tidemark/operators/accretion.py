"""Files that only ever grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import scores
from tidemark.scale import running_sum, top_k
from tidemark.staging import stage


def running_net_delta(numstat: DataFrame) -> DataFrame:
    """Net lines after each commit, in author time and sha order (2.5.1).

    Days are the chunks: a file with a third of all commits is scanned day by
    day, and only its daily totals are ordered as a whole.
    """
    rows = numstat.select(
        "repo",
        "path",
        "sha",
        "author_ts",
        (F.col("added") - F.col("deleted")).alias("delta"),
        F.floor(F.col("author_ts") / 86400).alias("_day"),
    )
    rows = stage(rows, "deltas")
    net = running_sum(rows, ["repo", "path"], "_day", ["author_ts", "sha"], "delta", "net", "prev_net")
    return net.select("repo", "path", "sha", "net", "prev_net")


def accretion(numstat: DataFrame, deletion_fraction: float = fv.ACCRETION_DELETION_FRACTION) -> DataFrame:
    """Files whose running net never falls (2.4.14).

    The running net is monotonic exactly when no commit after the first removes
    more than it adds, so plain aggregates decide it.
    """
    order = F.struct("author_ts", "sha")
    delta = F.col("added") - F.col("deleted")
    agg = numstat.groupBy("repo", "path").agg(
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.count(F.lit(1)).alias("commit_count"),
        F.min("author_ts").alias("first_ts"),
        F.max("author_ts").alias("last_ts"),
        F.count_if(delta < 0).alias("falls"),
        F.min_by(delta, order).alias("first_delta"),
    )
    fraction = F.col("deleted") / (F.col("added") + F.col("deleted"))
    falls_later = F.col("falls") - F.when(F.col("first_delta") < 0, 1).otherwise(0)
    return (
        agg.where(F.col("commit_count") >= fv.ACCRETION_MIN_COMMITS)
        .where(F.col("added") + F.col("deleted") > 0)
        .where(fraction < deletion_fraction)
        .where(F.col("added") > F.col("deleted"))
        .where(falls_later == 0)
        .select(
            "repo",
            "path",
            (F.col("added") - F.col("deleted")).alias("net_additions"),
            "commit_count",
            fraction.alias("deletion_fraction"),
            scores.span_months(F.col("first_ts"), F.col("last_ts")).alias("time_span_months"),
        )
    )


def accretion_in_band(accreting: DataFrame, band: DataFrame, k: int = fv.MAX_ACCRETION_FILES) -> DataFrame:
    """Accreting files among the ranked lists, largest first, with their number (2.4.15)."""
    inside = accreting.join(band.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    ranked = top_k(inside, ["repo"], [F.desc("net_additions"), F.asc("path")], k)
    totals = inside.groupBy("repo").agg(F.count(F.lit(1)).alias("total_in_band"))
    return ranked.join(totals, "repo")
