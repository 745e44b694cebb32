"""Landed files, settings, markers and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.sources.history import only_tracked

RANKED = "array<struct<path: string, loc: bigint, ccn: double, max_fn_ccn: double, commits: bigint, churn: bigint, est_tokens: bigint>>"
SPREAD = "struct<p50: double, p95: double, max: double, total: double>"
STATS_SCHEMA = (
    f"repo string, run_id string, schema_version int, files_scored bigint, loc {SPREAD}, ccn {SPREAD}, fn_ccn {SPREAD}, "
    f"est_tokens {SPREAD}, churn {SPREAD}, top_hotspots {RANKED}, top_complex {RANKED}, top_large {RANKED}"
)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files landed below ``repo=<name>/`` as ``(repo, path, text)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = r"/repo=([^/]+)/(.+)$"
    return raw.select(
        F.regexp_extract("path", place, 1).alias("repo"),
        F.regexp_extract("path", place, 2).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def scan_files(
    files: DataFrame,
    extensions: list[str],
    tracked: DataFrame | None = None,
    exclude_dirs: list[str] | None = None,
    exclude_globs: list[str] | None = None,
    scope: str = "",
) -> DataFrame:
    """Files of the given kinds, excludes applied, tracked ones only (2.1.4)."""
    p = F.col("path")
    kept = files.where(
        paths.extension(p).isin(extensions)
        & paths.under(p, scope)
        & ~paths.is_excluded_path(p)
        & ~paths.is_user_excluded(p, exclude_dirs or [], exclude_globs or [])
    )
    return kept if tracked is None else only_tracked(kept, tracked)


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics documents, one row per run (2.1.6)."""
    return spark.read.schema(STATS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(root)


def parse_stats(json: DataFrame) -> DataFrame:
    """The same from documents held in a column ``json``."""
    return json.select(F.from_json("json", STATS_SCHEMA).alias("s")).select("s.*")


def ranked_rows(stats: DataFrame, name: str) -> DataFrame:
    """One ranked list in long form; an old field name for commits still counts."""
    rows = stats.select("repo", "run_id", F.posexplode(name).alias("pos", "r"))
    return rows.select(
        "repo", "run_id", (F.col("pos") + 1).alias("rank"), "r.path", "r.loc", "r.ccn", F.coalesce("r.commits", "r.churn", F.lit(0)).alias("commits")
    )


def codeowners(lines: DataFrame) -> DataFrame:
    """Rules of the first ownership file that exists (2.1.12).

    ``lines(repo, path, text)``.
    """
    places = F.array(*[F.lit(p) for p in fv.CODEOWNERS_LOCATIONS])
    owned = lines.withColumn("o", F.array_position(places, F.col("path"))).where(F.col("o") > 0)
    first = owned.groupBy("repo").agg(F.min("o").alias("o"))
    line = F.trim("text")
    rules = owned.join(first, ["repo", "o"]).where((line != "") & ~F.startswith(line, F.lit("#")))
    return rules.select("repo", F.split(line, r"\s+")[0].alias("pattern"), F.col("path").alias("declared_in")).distinct()


STATE_SCHEMA = (
    "repo string, unreachable boolean, default_branch string, open_prs int, draft_prs int, ci string, failing_workflows string, "
    "dependabot string, code_scanning string, secret_scanning string, protection string"
)


def read_repo_state(spark: SparkSession, root: str) -> DataFrame:
    """State fragments, one object per repository (2.1.13); alerts stay text."""
    return spark.read.schema(STATE_SCHEMA).option("multiLine", True).json(root)


def parse_repo_state(json: DataFrame) -> DataFrame:
    return json.select(F.from_json("json", STATE_SCHEMA).alias("s")).select("s.*")


def agent_settings(files: DataFrame) -> DataFrame:
    """Permission and hook counts; unreadable settings keep a row (2.1.14).

    ``files(repo, path, text, tracked)``.
    """
    v = F.col("v")
    parsed = files.select("repo", "path", "tracked", F.try_parse_json("text").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))

    def entries(path: str) -> Column:
        return F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0))

    hooks = F.coalesce(F.size(F.try_variant_get(v, "$.hooks", "map<string, variant>")), F.lit(0))
    sandbox = F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", "map<string, variant>"), "sandbox"), F.lit(False))
    return parsed.select(
        "repo", "path", "tracked", is_object.alias("parse_ok"),
        entries("$.permissions.allow").alias("allow_count"), entries("$.permissions.deny").alias("deny_count"),
        entries("$.permissions.ask").alias("ask_count"), hooks.alias("hook_events"), sandbox.alias("sandbox_configured"),
    )


def decline_markers(files: DataFrame) -> DataFrame:
    """``.no-<tool>`` markers; old empty ones have no provenance (2.1.15)."""
    tool = F.regexp_extract(paths.basename(F.col("path")), r"^\.no-(.+)$", 1)
    data = F.from_json("text", "declined_by string, declined_at string, plugin_version string, reason string")
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = files.select("repo", "path", tool.alias("tool"), data.alias("d")).where(F.col("tool") != "")
    return rows.select(
        "repo", "tool", known("d.declined_by").alias("declined_by"), known("d.declined_at").alias("declined_at"),
        known("d.plugin_version").alias("version"), known("d.reason").alias("reason"),
    )
