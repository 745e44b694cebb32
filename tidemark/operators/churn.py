"""Commit counts per file and what they say about the history.

``commit_files(repo, sha, ts, path)`` has one row per touched file and commit,
so counts need no distinct and combine before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import identity, paths, scores
from tidemark.scale import first_of, salted_lookup, value_counts


def months_before(as_of: int, months: int) -> int:
    """Epoch seconds of the same day ``months`` calendar months earlier."""
    day = dt.datetime.fromtimestamp(as_of, dt.UTC)
    total = day.year * 12 + day.month - 1 - months
    year, month = divmod(total, 12)
    for last in (day.day, 30, 29, 28):
        try:
            return int(day.replace(year=year, month=month + 1, day=last).timestamp())
        except ValueError:
            continue
    raise ValueError(as_of)


def since(df: DataFrame, start: int, column: str = "ts") -> DataFrame:
    """History window (2.2.9)."""
    return df.where(F.col(column) >= start)


def scope(commit_files: DataFrame, folder: str) -> DataFrame:
    """Commits restricted to a subtree; emptied commits drop out (2.2.7)."""
    return commit_files.where(paths.under(F.col("path"), folder))


def churn_per_file(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"))


def churn_windows(commit_files: DataFrame, as_of: int) -> DataFrame:
    """Counts for all four windows from one scan."""
    counts = [
        F.count_if(F.lit(True) if months is None else F.col("ts") >= months_before(as_of, months)).alias(f"w{i}")
        for i, (_, months) in enumerate(fv.CHURN_WINDOWS)
    ]
    return commit_files.groupBy("repo", "path").agg(*counts)


def pick_churn_window(commit_files: DataFrame, files: DataFrame, as_of: int) -> DataFrame:
    """Per repository the first window with enough activity, else the widest (2.4.2)."""
    windows = churn_windows(commit_files, as_of)
    scored = files.select("repo", "path").join(windows, ["repo", "path"], "left")
    n = len(fv.CHURN_WINDOWS)
    per_repo = scored.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(f"w{i}") > 0).alias(f"hit{i}") for i in range(n)],
        *[F.coalesce(F.max(f"w{i}"), F.lit(0)).alias(f"peak{i}") for i in range(n)],
    )
    choice: Column | None = None
    for i in range(n):
        qualifies = (F.col(f"peak{i}") >= fv.WINDOW_MIN_MAX) & (
            F.lit(100.0) * F.col(f"hit{i}") / F.col("total") >= fv.WINDOW_MIN_COVERAGE_PCT
        )
        choice = F.when(qualifies, i) if choice is None else choice.when(qualifies, i)
    widest = F.when(F.col(f"hit{n - 1}") > 0, n - 1)
    picked = per_repo.select("repo", choice.otherwise(widest).alias("window"))
    commits = F.coalesce(*[F.when(F.col("window") == i, F.col(f"w{i}")) for i in range(n)], F.lit(0))
    labels = F.array(*[F.lit(f"commits ({label})") for label, _ in fv.CHURN_WINDOWS])
    return (
        salted_lookup(scored, picked, ["repo"])
        .where(F.col("window").isNotNull())
        .select("repo", "path", F.element_at(labels, F.col("window") + 1).alias("window_label"), commits.alias("commits"))
    )


def nearest_rank(counts: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Nearest-rank percentile from a histogram ``(keys, value, n)``.

    Only distinct values are ordered per key, never the rows behind them.
    """
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_cum", F.sum("n").over(by_value)).withColumn("_all", F.sum("n").over(whole))
    return (
        ranked.where(F.col("_cum") >= F.ceil(F.lit(q) * F.col("_all")))
        .groupBy(*keys)
        .agg(F.min(value).alias("pct"), F.max("_all").alias("n"))
    )


def churn_degenerate(churn: DataFrame) -> DataFrame:
    """History too flat to rank by: p95 of active files is one commit (2.4.3)."""
    active = value_counts(churn.where(F.col("commits") > 0), ["repo"], "commits")
    return nearest_rank(active, ["repo"], "commits", 0.95).select(
        "repo",
        ((F.col("n") >= fv.DEGENERATE_MIN_FILES) & (F.col("pct") <= fv.DEGENERATE_P95)).alias("degenerate"),
    )


def last_commit_days(commit_files: DataFrame, as_of: int, column: str = "author_ts") -> DataFrame:
    last = commit_files.groupBy("repo", "path").agg(F.max(column).alias("last_ts"))
    return last.select("repo", "path", scores.days_since(F.col("last_ts"), F.lit(as_of)).alias("last_commit_days"))


def last_human_commit_days(authored: DataFrame, as_of: int) -> DataFrame:
    """Days since a human-authored commit by committer time; null without one (2.5.4)."""
    human = identity.is_human(F.col("ae"), F.col("an"))
    last = authored.groupBy("repo", "path").agg(F.max(F.when(human, F.col("ts"))).alias("last_ts"))
    return last.select("repo", "path", scores.days_since(F.col("last_ts"), F.lit(as_of)).alias("last_human_days"))


def commit_count_decile(churn: DataFrame) -> DataFrame:
    """Share of files with strictly fewer commits, times ten (2.5.5).

    Ranked over the distinct counts of a repository, then looked up.
    """
    counts = value_counts(churn, ["repo"], "commits")
    below = Window.partitionBy("repo").orderBy("commits").rowsBetween(Window.unboundedPreceding, -1)
    deciles = counts.select(
        "repo",
        "commits",
        (
            F.coalesce(F.sum("n").over(below), F.lit(0))
            / F.sum("n").over(Window.partitionBy("repo"))
            * F.lit(10.0)
        ).alias("decile"),
    )
    return salted_lookup(churn.select("repo", "path", "commits"), deciles, ["repo", "commits"], "inner")


def hotspot_risk_band(ranked: DataFrame, position: str = "rank") -> DataFrame:
    """Positions 1-3 high, 4-7 medium, 8-10 low, the rest leave the list (2.5.6)."""
    pos = F.col(position)
    band = F.when(pos <= 3, "high").when(pos <= 7, "medium").when(pos <= 10, "low")
    return ranked.withColumn("risk_band", band).where(F.col("risk_band").isNotNull())


def candidate_dirs(commit_files: DataFrame, k: int | None = fv.MAX_CONTAINMENT_DIRS) -> DataFrame:
    """Busiest directories with at least five commits: the first ``k``, or all with None; ``eligible`` counts all (2.4.6)."""
    touched = (
        commit_files.select("repo", "sha", paths.parent(F.col("path")).alias("dir"))
        .distinct()
        .select("repo", "sha", F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("dir"))
        .where(F.col("dir") != "")
        .distinct()
    )
    counted = touched.groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n_commits"))
    eligible = counted.where(F.col("n_commits") >= fv.MIN_DIR_COMMITS)
    return first_of(eligible, ["repo"], [F.desc("n_commits"), F.asc("dir")], k, "eligible")
