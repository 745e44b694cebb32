"""Exported history logs.

Logs are landed as ``<root>/repo=<name>/...`` so that the repository is a
partition column. A record is everything up to the next record separator; the
same commit may come in several records (chunked exports), so results are
distinct. Commit attributes travel on every file row: no later join by commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, UNIT, GROUP = "\x1e", "\x1f", "\x1d"


def read_records(spark: SparkSession, root: str, separator: str = RECORD) -> DataFrame:
    """Raw records ``(repo, value)`` of a landed log."""
    return spark.read.option("lineSep", separator).text(root).select(F.col("repo").cast("string").alias("repo"), "value")


def _records(raw: DataFrame) -> DataFrame:
    text = F.replace("value", F.lit("\r\n"), F.lit("\n"))
    # a header alone needs no list of lines
    return raw.where(F.trim("value") != "").select(
        "repo", F.trim(F.substring_index(text, "\n", 1)).alias("header"), F.slice(F.split(text, "\n"), 2, 2**31 - 1).alias("rows")
    )


def commit_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sha [epoch]`` headers and touched paths; empty commits are kept (2.1.1)."""
    parts = F.split("header", " ")
    parsed = _records(raw).select(
        "repo", parts[0].alias("sha"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("ts"), "rows"
    )
    commits = parsed.select("repo", "sha", "ts").distinct()
    files = (
        parsed.select("repo", "sha", "ts", F.explode("rows").alias("path"))
        .select("repo", "sha", "ts", F.trim("path").alias("path"))
        .where(F.col("path") != "")
        .distinct()
    )
    return commits, files


def _numstat_rows(df: DataFrame) -> DataFrame:
    """``added<TAB>deleted<TAB>path`` rows; binary files carry no numbers."""
    keep = [c for c in df.columns if c != "rows"]
    lines = df.select(*keep, F.explode("rows").alias("r"))
    upto = lambda i: F.substring_index("r", "\t", i)
    cell = lambda i: F.substring_index(upto(i), "\t", -1)
    path = F.when(upto(2) != F.col("r"), cell(3))  # there is a third cell
    rows = lines.select(*keep, cell(1).try_cast("long").alias("added"), cell(2).try_cast("long").alias("deleted"), path.alias("path"))
    return rows.where((F.col("added") >= 0) & (F.col("deleted") >= 0) & F.col("path").isNotNull())


def numstat_log(raw: DataFrame) -> DataFrame:
    """``epoch sha`` headers with numstat rows; malformed headers are skipped (2.1.2)."""
    epoch = F.regexp_extract("header", r"^(\d+) (.+)$", 1).try_cast("long")
    parsed = _records(raw).select("repo", epoch.alias("author_ts"), F.regexp_extract("header", r"^(\d+) (.+)$", 2).alias("sha"), "rows")
    return _numstat_rows(parsed.where(F.col("author_ts").isNotNull())).select(
        "repo", "sha", "author_ts", "path", "added", "deleted"
    )


def authored_log(raw: DataFrame) -> DataFrame:
    """Headers with author, committer and co-authors; short headers are padded (2.1.3)."""
    cells = F.split("header", UNIT)
    field = lambda i: F.coalesce(F.try_element_at(cells, F.lit(i)), F.lit(""))
    trailers = F.filter(F.split(field(6), GROUP), lambda c: F.trim(c) != "")
    parsed = _records(raw).select(
        "repo", field(1).alias("sha"), field(2).alias("an"), field(3).alias("ae"), field(4).alias("cn"), field(5).alias("ce"),
        trailers.alias("coauthors"), "rows",
    )
    return _numstat_rows(parsed)


def tracked_files(raw: DataFrame) -> DataFrame:
    """NUL-separated path listing (2.1.5)."""
    return raw.select("repo", F.explode(F.split("value", "\x00")).alias("path")).where(F.col("path") != "").distinct()


def only_tracked(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files under version control; a repository without a listing keeps all."""
    listed = tracked.select("repo").distinct()
    kept = files.join(tracked.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    unlisted = files.join(listed, "repo", "left_anti")
    return kept.unionByName(unlisted)
