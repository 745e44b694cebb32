"""Cross-signal findings, attention and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, scores
from tidemark.operators import documents
from tidemark.scale import salted_lookup, top_k


def finding_names(spark: SparkSession) -> DataFrame:
    """The eleven names in their fixed order."""
    rows = [(name, action, i) for i, (name, action, _) in enumerate(fv.FINDINGS)]
    return spark.createDataFrame(rows, "name string, action string, ordinal int")


def static_history(containment: DataFrame, modularity: DataFrame, python_dirs: DataFrame) -> DataFrame:
    """Containment next to the static metrics of directories that have any (2.3.16).

    ``modularity(repo, modularity_q, front_door_ratio)``.
    """
    marked = containment.join(
        python_dirs.select("repo", "dir").distinct().withColumn("has_static", F.lit(True)), ["repo", "dir"], "left"
    )
    joined = salted_lookup(marked, modularity, ["repo"])
    # without a static result for the repository there is no evidence either
    evidence = F.coalesce("has_static", F.lit(False)) & (F.col("modularity_q").isNotNull() | F.col("front_door_ratio").isNotNull())
    return joined.withColumn("has_static", evidence)


def coupling_findings(static: DataFrame) -> DataFrame:
    """Low containment: hidden when the static view looks modular, bleeding without one (2.11.1)."""
    modular = (F.col("modularity_q") >= fv.HIGH_MODULARITY) | (F.col("front_door_ratio") >= fv.HIGH_FRONT_DOOR)
    finding = F.when(
        F.col("has_static"), F.when(F.coalesce(modular, F.lit(False)), "hidden_coupling")
    ).otherwise("bleeding_module")
    return static.where(F.col("containment") < fv.LOW_CONTAINMENT).select(
        "repo", F.col("dir").alias("path"), "containment", finding.alias("finding")
    )


def refactor_boundaries(containment: DataFrame) -> DataFrame:
    """Directories commits rarely leave (2.11.2)."""
    return containment.where(F.col("containment") > fv.HIGH_CONTAINMENT).select("repo", F.col("dir").alias("path"), "containment")


def doc_complexity(file_ccn: DataFrame, stale: DataFrame, threshold: DataFrame, degenerate: DataFrame) -> DataFrame:
    """Documents by the complexity they cover times their freshness (2.11.3).

    ``file_ccn(repo, path, ccn)``, ``stale`` from ``documents.staleness``,
    ``threshold(repo, threshold)``, ``degenerate(repo, degenerate)``.
    """
    dirs = documents.deepest_doc_pick(stale.select("repo", F.col("doc").alias("path")))
    assigned = documents.nearest_ancestor(file_ccn, dirs)
    covered = assigned.groupBy("repo", "doc").agg(F.max("ccn").alias("complexity"), F.count(F.lit(1)).alias("subject_count"))
    rows = stale.select("repo", "doc", "ratio", "confidence", "source_newer").join(covered, ["repo", "doc"], "left")
    rows = salted_lookup(salted_lookup(rows, threshold, ["repo"]), degenerate, ["repo"])
    complexity = F.coalesce("complexity", F.lit(0.0))
    freshness = F.round(scores.signed_freshness(F.col("ratio"), F.col("source_newer")), 3)
    known = F.col("source_newer").isNotNull()
    confidence = F.when(known, "high").when(F.coalesce("degenerate", F.lit(False)), "low").otherwise(F.col("confidence"))
    high = complexity >= F.col("threshold")
    finding = F.when(high & (freshness < 0) & (confidence != "low"), "lying_map").when(high & (freshness > 0), "good_contract")
    return rows.select(
        "repo", F.col("doc").alias("path"), F.round(complexity, 2).alias("complexity"), freshness.alias("freshness"),
        F.round(F.round(complexity, 2) * freshness, 3).alias("doc_value"), finding.alias("finding"), confidence.alias("confidence"),
        F.coalesce("subject_count", F.lit(0)).alias("subject_count"),
    )


def unexplained_complexity(file_ccn: DataFrame, docs: DataFrame, threshold: DataFrame) -> DataFrame:
    """Complex files under no document at all (2.11.3)."""
    dirs = documents.deepest_doc_pick(docs)
    covered = documents.nearest_ancestor(file_ccn, dirs).select("repo", "path")
    open_files = file_ccn.join(covered, ["repo", "path"], "left_anti")
    return salted_lookup(open_files, threshold, ["repo"], "inner").where(
        F.round("ccn", 2) >= F.col("threshold")
    ).select("repo", "path", F.round("ccn", 2).alias("complexity"))


def high_complexity(file_ccn: DataFrame, threshold: DataFrame) -> DataFrame:
    return salted_lookup(file_ccn, threshold, ["repo"], "inner").where(F.col("ccn") >= F.col("threshold")).select("repo", "path", "ccn")


def intent_source(code: DataFrame, docs: DataFrame) -> DataFrame:
    """Files with any document in a directory above them."""
    return documents.nearest_ancestor(code, documents.deepest_doc_pick(docs)).select("repo", "path")


def orphaned_understanding(high: DataFrame, authorship: DataFrame, docs: DataFrame) -> DataFrame:
    """Complex, no human anchor, no document above (2.11.4)."""
    lonely = high.join(authorship.where(~F.col("human_anchor")).select("repo", "path"), ["repo", "path"], "left_semi")
    return lonely.join(intent_source(lonely, docs), ["repo", "path"], "left_anti").select("repo", "path")


def assemble(parts: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``(repo, name, path)`` over all findings (2.7.12)."""
    tagged = [df.select("repo", F.lit(name).alias("name"), "path") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged).distinct()


def drop_unreliable(found: DataFrame, degenerate: DataFrame) -> DataFrame:
    """A flat history takes back the findings that rest on churn."""
    flat = degenerate.where("degenerate").select("repo", F.lit(True).alias("flat"))
    rows = salted_lookup(found, flat, ["repo"])
    return rows.where(~(F.coalesce("flat", F.lit(False)) & F.col("name").isin(fv.CHURN_DERIVED_FINDINGS))).drop("flat")


def all_names(found: DataFrame, repos: DataFrame) -> DataFrame:
    """Paths per repository and finding, always all eleven names."""
    counted = found.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("action"), F.lit(i).alias("ordinal")) for i, (n, a, _) in enumerate(fv.FINDINGS)])
    grid = repos.select("repo").distinct().select("repo", F.explode(names).alias("n")).select("repo", "n.*")
    return grid.join(counted, ["repo", "name"], "left").na.fill(0, ["count"])


def split_excluded(found: DataFrame, dirs: list[str], globs: list[str]) -> DataFrame:
    """Mark findings on paths the configuration excludes (2.2.16)."""
    return found.withColumn("excluded", paths.is_user_excluded(F.col("path"), dirs, globs))


def attention(found: DataFrame) -> DataFrame:
    """Distinct negative findings per path; at most ten fit the list (2.4.30)."""
    negative = found.where(F.col("name") != fv.POSITIVE_FINDING)
    return negative.groupBy("repo", "path").agg(
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("findings"), F.count_distinct("name").alias("score")
    )


def top_attention(units: DataFrame, k: int = fv.MAX_ATTENTION) -> DataFrame:
    return top_k(units, ["repo"], [F.desc("score"), F.asc("path")], k)


def prescribed_actions(units: DataFrame, k: int = fv.MAX_PRESCRIBED) -> DataFrame:
    """Worst finding of the first units gives the action (2.5.12)."""
    first = top_attention(units, k)
    names = F.split("findings", ",")
    order = F.array(*[F.lit(n) for n, _, _ in fv.FINDINGS if n != fv.POSITIVE_FINDING])
    worst = F.element_at(F.filter(order, lambda n: F.array_contains(names, n)), 1)
    return first.select(
        "repo", "path", "rank", worst.alias("finding"), scores.finding_action(worst).alias("action"),
        scores.mode_for_finding(worst).alias("mode"),
    )


def _plural(n, word: str):
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def keyhole_summary(named: DataFrame) -> DataFrame:
    """Concerns, safe zones and the one-line text (2.4.31). Eleven rows per repository."""
    negative = (F.col("name") != fv.POSITIVE_FINDING) & (F.col("count") > 0)
    item = F.struct("ordinal", F.concat(F.col("count").cast("string"), F.lit(" "), scores.display_name(F.col("name"))).alias("t"))
    agg = named.groupBy("repo").agg(
        F.sum(F.when(negative, F.col("count")).otherwise(0)).alias("total_concerns"),
        F.sum(F.when(F.col("name") == fv.POSITIVE_FINDING, F.col("count")).otherwise(0)).alias("safe_zones"),
        F.count_if(negative).alias("concern_kinds"),
        F.sort_array(F.collect_list(F.when(negative, item))).alias("items"),
    )
    detail = F.array_join(F.transform("items", lambda x: x["t"]), ", ")
    zones = _plural(F.col("safe_zones"), "safe zone")
    line = F.when(F.col("total_concerns") == 0, F.concat(F.lit("No structural concerns, "), zones, F.lit("."))).otherwise(
        F.concat(_plural(F.col("total_concerns"), "structural concern"), F.lit(" ("), detail, F.lit("), "), zones, F.lit("."))
    )
    return agg.select("repo", "total_concerns", "safe_zones", "concern_kinds", line.alias("summary_text"))


def gate_containment(summary: DataFrame) -> DataFrame:
    """Safe zones over safe zones and concerns; null for none (2.4.33)."""
    return summary.select(
        "repo", F.try_divide(F.col("safe_zones"), F.col("safe_zones") + F.col("total_concerns")).alias("containment")
    )


def quality_gate(
    named: DataFrame,
    summary: DataFrame,
    ccn: DataFrame,
    regressed: DataFrame,
    fail_on: list[str],
    warn_on: list[str] | None = None,
    ccn_p95_max: float | None = None,
    containment_min: float | None = None,
    fail_on_regression: bool = False,
    enabled: bool = True,
) -> DataFrame:
    """Breaches per repository; a disabled gate still reports (2.11.15).

    ``ccn(repo, p95)``, ``regressed(repo, reliable, n)``.
    """
    concerns = [n for n, _, _ in fv.FINDINGS if n != fv.POSITIVE_FINDING]
    warn = [n for n in (concerns if warn_on is None else warn_on) if n not in fail_on]
    fired = named.where(F.col("count") > 0)
    rows = fired.where(F.col("name").isin(fail_on)).select("repo", F.lit("fail").alias("kind"), "name", F.col("count").cast("double").alias("value"))
    rows = rows.unionByName(
        fired.where(F.col("name").isin(warn)).select("repo", F.lit("warn").alias("kind"), "name", F.col("count").cast("double").alias("value"))
    )
    if ccn_p95_max is not None:
        over = ccn.where(F.col("p95") > ccn_p95_max)
        rows = rows.unionByName(over.select("repo", F.lit("threshold").alias("kind"), F.lit("ccn_p95").alias("name"), F.col("p95").alias("value")))
    if containment_min is not None:
        low = gate_containment(summary).where(F.col("containment") < containment_min)
        rows = rows.unionByName(low.select("repo", F.lit("threshold").alias("kind"), F.lit("containment").alias("name"), F.round("containment", 3).alias("value")))
    if fail_on_regression:
        worse = regressed.where(F.col("reliable") & (F.col("n") > 0))
        rows = rows.unionByName(worse.select("repo", F.lit("threshold").alias("kind"), F.lit("regressed_hotspots").alias("name"), F.col("n").cast("double").alias("value")))
    verdict = rows.groupBy("repo").agg(
        F.count_if(F.col("kind") == "fail").alias("failures"),
        F.count_if(F.col("kind") == "warn").alias("warnings"),
        F.count_if(F.col("kind") == "threshold").alias("threshold_breaches"),
    )
    every = named.select("repo").distinct().join(verdict, "repo", "left").na.fill(0)
    return every.withColumn("failed", F.lit(enabled) & ((F.col("failures") > 0) | (F.col("threshold_breaches") > 0)))


def python_dirs(commit_files: DataFrame) -> DataFrame:
    """Directories above any Python file of the history."""
    dirs = commit_files.where(F.col("path").endswith(".py")).select("repo", paths.parent(F.col("path")).alias("dir")).distinct()
    return dirs.select("repo", F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("dir")).where("dir <> ''").distinct()


