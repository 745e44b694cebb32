"""What kind of repository it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, scores


def archetype(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Software or knowledge base, by marker or by signals (2.4.29).

    ``files(repo, path)``, ``overrides(repo, override, source)``.
    """
    p = F.col("path")
    kept = ~F.arrays_overlap(paths.parts(p), F.array(*[F.lit(d) for d in fv.EXCLUDED_DIRS]))
    root = ~F.contains(p, F.lit("/"))
    runtime = root & p.rlike(paths.globs_regex(fv.RUNTIME_MANIFESTS))
    kind = paths.file_kind(p)
    signals = files.groupBy("repo").agg(
        F.count_if(kept & (kind == "code")).alias("code"),
        F.count_if(kept & (kind == "doc")).alias("doc"),
        F.count_if(kept & ~kind.isin("code", "doc")).alias("other"),
        F.bool_or(runtime).alias("runtime"),
    )
    ratio = F.coalesce(F.try_divide(F.col("code"), F.col("code") + F.col("doc")), F.lit(0.0))
    looks_kb = (F.col("doc") >= fv.KB_MIN_DOCS) & (ratio <= fv.KB_MAX_CODE_RATIO) & ~F.col("runtime")
    guess = F.when(looks_kb, "knowledge-base").otherwise("software")
    rows = signals.join(overrides, "repo", "left")
    final = F.coalesce("override", guess)
    return rows.select(
        "repo", "code", "doc", "other", "runtime", ratio.alias("code_ratio"), final.alias("archetype"),
        F.when(F.col("override").isNotNull(), "override").otherwise("heuristic").alias("detected_via"),
        F.coalesce(F.col("override") != guess, F.lit(False)).alias("contradicts"), "source",
        F.when(final == "knowledge-base", fv.KB_DENOMINATOR).otherwise(fv.SOFTWARE_DENOMINATOR).alias("denominator"),
    )


def contradictions(classified: DataFrame) -> DataFrame:
    """Marker files that force what the signals deny (2.11.9)."""
    return classified.where("contradicts").select("repo", F.coalesce("source", F.lit("<archetype marker>")).alias("path"))


def agent_ops_summary(settings: DataFrame, dir_files: DataFrame) -> DataFrame:
    """Three flags over tracked evidence only (2.4.35).

    ``settings`` from ``sources.repository.agent_settings``,
    ``dir_files(repo, path, tracked)`` for hook and routine folders.
    """
    s = settings.where("tracked").groupBy("repo").agg(
        F.bool_or(F.col("allow_count") + F.col("deny_count") + F.col("ask_count") > 0).alias("permissions"),
        F.bool_or(F.col("hook_events") > 0).alias("hooks_in_settings"),
    )
    visible = dir_files.where(F.col("tracked") & ~F.startswith(paths.basename(F.col("path")), F.lit(".")))
    d = visible.groupBy("repo").agg(
        F.bool_or(F.startswith("path", F.lit(".claude/hooks/"))).alias("hook_files"),
        F.bool_or(F.col("path").rlike(r"^\.claude/(workflows|routines)/")).alias("routines"),
    )
    every = settings.select("repo").unionByName(dir_files.select("repo")).distinct()
    rows = every.join(s, "repo", "left").join(d, "repo", "left").na.fill(False)
    return rows.select(
        "repo", F.col("permissions").alias("permissions_encoded"),
        (F.col("hooks_in_settings") | F.col("hook_files")).alias("hooks_present"), F.col("routines").alias("routines_present"),
    )


def jvm_capabilities(files: DataFrame, plugins: DataFrame, analyzed: DataFrame) -> DataFrame:
    """State of each capability of JVM repositories (2.4.37).

    ``files(repo, path)``, ``plugins(repo, capability, label)``,
    ``analyzed(repo)``: repositories with a dependency analysis.
    """
    name = paths.basename(F.col("path"))
    system = files.groupBy("repo").agg(
        F.bool_or(name == "pom.xml").alias("maven"), F.bool_or(name.isin("build.gradle", "build.gradle.kts")).alias("gradle")
    ).where(F.col("maven") | F.col("gradle"))
    grid = system.select("repo", "maven", F.explode(F.array(*[F.lit(c) for c in fv.JVM_CAPABILITIES])).alias("capability"))
    credits = plugins.groupBy("repo", "capability").agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("served_by"))
    ran = analyzed.select("repo").distinct().withColumn("ran", F.lit(True))
    rows = grid.join(credits, ["repo", "capability"], "left").join(ran, "repo", "left")
    live = F.when(~F.col("maven"), "honest_degrade").when(F.col("ran"), "served").otherwise("offer")
    other = F.when(F.col("maven") & F.col("served_by").isNotNull(), "credited").otherwise("honest_degrade")
    state = F.when(F.col("capability") == "liveness", live).otherwise(other)
    return rows.select(
        "repo", "capability", state.alias("state"),
        F.when(state == "credited", F.col("served_by")).otherwise("").alias("served_by"),
    )


def decline_reoffer(declines: DataFrame, current_version: str) -> DataFrame:
    """Declines made under an older major version (2.11.18)."""
    old, new = scores.major_version(F.col("version")), scores.major_version(F.lit(current_version))
    reoffer = F.coalesce(old < new, F.lit(False))
    return declines.withColumn("reoffer", reoffer).withColumn(
        "mutation", reoffer & F.col("tool").isin(fv.MUTATION_TOOLS_DECLINED)
    )
