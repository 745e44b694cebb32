"""Per-file complexity, statistics and ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, scores
from tidemark.scale import first_of, top_k, value_counts


def file_complexity(functions: DataFrame, files: DataFrame, source: str = "functions") -> DataFrame:
    """Sum (at least 1) and maximum of the function complexities of a file (2.4.10)."""
    per_file = functions.groupBy("repo", "path").agg(
        F.greatest(F.sum("ccn").cast("double"), F.lit(1.0)).alias("ccn"), F.max("ccn").cast("double").alias("max_fn_ccn")
    )
    return (
        files.select("repo", "path", "loc", "est_tokens")
        .where(F.col("loc") > 0)
        .join(per_file, ["repo", "path"])
        .withColumn("source", F.lit(source))
    )


def scorer_union(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of the fallback scorer only for files the first did not score (2.7.3)."""
    extra = fallback.join(primary.select("repo", "path"), ["repo", "path"], "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True).where(F.col("loc") > 0)


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p95, maximum and total with linear interpolation.

    Works on the histogram of values, so a group costs its distinct values and
    not its rows.
    """
    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    v, n = F.col(value).cast("double"), F.col("n")
    return counts.groupBy(*keys).agg(
        F.percentile(v, [0.5, 0.95], n).alias("_p"),
        F.max(v).alias("max"),
        F.sum(v * n).alias("total"),
        F.sum("n").alias("count"),
    ).select(*keys, F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), "max", "total", "count")


def complexity_percentiles(files: DataFrame, functions: DataFrame, churn: DataFrame) -> DataFrame:
    """One row per repository and metric (2.4.9)."""
    scored = files.join(churn, ["repo", "path"], "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    # one pass over the files: every metric becomes a labelled value
    metrics = scored.select(
        "repo",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in ("loc", "est_tokens", "ccn", "commits")
                ]
            )
        ).alias("m"),
    ).select("repo", "m.*")
    fn = functions.select("repo", F.lit("fn_ccn").alias("metric"), F.col("ccn").cast("double").alias("value"))
    return percentiles(metrics.unionByName(fn), ["repo", "metric"], "value")


def score_files(files: DataFrame, churn: DataFrame) -> DataFrame:
    """Files with commits and the hotspot score."""
    return (
        files.join(churn.select("repo", "path", "commits"), ["repo", "path"], "left")
        .withColumn("commits", F.coalesce("commits", F.lit(0)))
        .withColumn(
            "score",
            scores.hotspot_score(F.col("ccn"), F.col("max_fn_ccn"), F.col("commits"), F.col("est_tokens")),
        )
    )


def top_hotspots(scored: DataFrame, k: int = fv.TOP_LIST) -> DataFrame:
    """Rounded before ranking, so that equal scores tie on every platform."""
    return top_k(scored, ["repo"], [F.round("score", 6).desc(), F.asc("path")], k)


def top_complex(scored: DataFrame, k: int = fv.TOP_LIST) -> DataFrame:
    return top_k(scored, ["repo"], [F.desc("ccn"), F.asc("path")], k)


def top_large(scored: DataFrame, k: int = fv.TOP_LIST) -> DataFrame:
    return top_k(scored, ["repo"], [F.desc("loc"), F.asc("path")], k)


def band_union(*lists: DataFrame) -> DataFrame:
    """Distinct paths of the ranked lists (2.7.1)."""
    return reduce(DataFrame.unionByName, [df.select("repo", "path") for df in lists]).distinct()


def max_ccn_union(*lists: DataFrame) -> DataFrame:
    """Highest complexity per path over several lists (2.7.2)."""
    union = reduce(DataFrame.unionByName, [df.select("repo", "path", "ccn") for df in lists])
    return union.where(F.col("ccn").isNotNull()).groupBy("repo", "path").agg(F.max("ccn").alias("ccn"))


def budget_subtrees(files: DataFrame, budget: int = fv.CONTEXT_BUDGET_TOKENS, k: int | None = fv.TOP_LIST) -> DataFrame:
    """Top-level subtrees over the token budget: the ``k`` largest, or all with None; ``over_budget`` counts all (2.4.11)."""
    top = F.element_at(F.split("path", "/"), 1)
    per_tree = files.groupBy("repo", top.alias("subtree")).agg(F.sum("est_tokens").alias("est_tokens"))
    over = per_tree.where(F.col("est_tokens") > budget)
    return first_of(over, ["repo"], [F.desc("est_tokens"), F.asc("subtree")], k, "over_budget")


def budget_rollup(files: DataFrame, budget: int = fv.CONTEXT_BUDGET_TOKENS) -> DataFrame:
    top = F.element_at(F.split("path", "/"), 1)
    per_tree = files.groupBy("repo", top.alias("subtree")).agg(
        F.sum("est_tokens").alias("tokens"), F.count_if(F.col("est_tokens") > budget).alias("over")
    )
    return per_tree.groupBy("repo").agg(
        F.sum("tokens").alias("total"),
        F.sum("over").alias("files_over_budget"),
        F.count_if(F.col("tokens") > budget).alias("subtrees_over_budget"),
    )


def dominant_file(files: DataFrame, share: float = fv.DOMINANCE_SHARE) -> DataFrame:
    """The largest file and its share of all lines, where it dominates (2.4.12)."""
    agg = files.groupBy("repo").agg(
        F.max(F.struct("loc", "path")).alias("biggest"), F.sum("loc").alias("total"), F.count(F.lit(1)).alias("n")
    )
    ratio = F.try_divide(F.col("biggest.loc"), F.col("total"))
    return agg.where((F.col("n") >= 2) & (ratio >= share)).select(
        "repo", F.col("biggest.path").alias("path"), ratio.alias("share")
    )


def directory_rollup(files: DataFrame, size: str = "loc") -> DataFrame:
    """Size of every directory as the sum over its subtree (2.4.13).

    Files collapse to their directory before the ancestors are exploded.
    """
    per_dir = files.groupBy("repo", paths.parent(F.col("path")).alias("dir")).agg(
        F.sum(size).alias("size"), F.count(F.lit(1)).alias("files")
    )
    return (
        per_dir.select("repo", "size", "files", F.explode(paths.self_and_ancestors(F.col("dir"))).alias("dir"))
        .groupBy("repo", "dir")
        .agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
        .withColumn("depth", paths.depth(F.col("dir")))
    )
