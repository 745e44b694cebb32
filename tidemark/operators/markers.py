"""Promises left in code: detection, ageing, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import identity, paths, scores, text
from tidemark.operators import churn
from tidemark.scale import has_hot, running_sum, salted_lookup, top_k
from tidemark.staging import stage

PROSE_FREE = ["suppression", "disabled_test"]
COMMENT_BOUND = ["todo", "deprecation"]


def is_scanned(path) -> object:
    """Generated and vendored files are not scanned."""
    return ~(
        F.arrays_overlap(paths.parts(path), F.array(*[F.lit(d) for d in fv.MARKER_EXCLUDED_DIRS]))
        | path.rlike(r"(^|/)tests/fixtures/")
        | paths.basename(path).rlike(paths.globs_regex(fv.MARKER_EXCLUDED_GLOBS))
    )


def scan(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line and marker family found on it (2.10.1); ``keep`` names columns that go along."""
    prose = paths.extension(F.col("path")).isin(fv.PROSE_EXTENSIONS)
    hits = []
    for family, pattern in fv.MARKER_FAMILIES.items():
        literal = reduce(or_, [F.contains(F.col("text"), F.lit(x)) for x in fv.MARKER_LITERALS[family]])
        hit = literal & F.col("text").rlike(text.UNICODE + pattern)
        hit = hit & (~prose if family in PROSE_FREE else text.in_comment(F.col("text"), text.UNICODE + pattern, prose))
        # a path is looked at only where its line has a hit
        hits.append(F.when(hit & is_scanned(F.col("path")), F.lit(family)))
    found = lines.select(
        "repo", "path", "line_no", "text", *keep, F.explode(F.array_compact(F.array(*hits))).alias("family")
    )
    return found.select(
        "repo", "path", "line_no", "family", F.trim("text").alias("text"),
        text.is_linked(F.col("text"), F.col("family")).alias("linked"), *keep,
    )


def survived_touches(intros: DataFrame, commit_times: DataFrame) -> DataFrame:
    """Commits to the file strictly after each introduction (2.3.14).

    ``intros(repo, path, intro_ts)``, ``commit_times(repo, path, ts)``. Both are
    laid on one time line per file and counted with a running sum, day by day
    where a file is hot, so markers are never paired with commits.
    """
    counts = commit_times.groupBy("repo", "path", "ts").agg(F.count(F.lit(1)).alias("n"))
    line = counts.select("repo", "path", "ts", F.lit(0).alias("kind"), "n").unionByName(
        intros.select("repo", "path", F.col("intro_ts").alias("ts"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n")).distinct()
    )
    line = stage(line.withColumn("_day", F.floor(F.col("ts") / 86400)), "timeline")
    if has_hot(line, ["repo", "path"]):
        summed = running_sum(line, ["repo", "path"], "_day", ["ts", "kind"], "n", "upto")
        totals = line.groupBy("repo", "path").agg(F.sum("n").alias("all_commits"))
        marks = summed.where(F.col("kind") == 1).join(totals, ["repo", "path"])
    else:
        whole = Window.partitionBy("repo", "path")
        upto = whole.orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
        known = line.where(F.col("repo").isNotNull() & F.col("path").isNotNull())
        summed = known.withColumns({"upto": F.sum("n").over(upto), "all_commits": F.sum("n").over(whole)})
        marks = summed.where((F.col("kind") == 1) & F.col("ts").isNotNull())
    return marks.select("repo", "path", F.col("ts").alias("intro_ts"), (F.col("all_commits") - F.col("upto")).alias("survived"))


def marker_author(markers: DataFrame, authored: DataFrame) -> DataFrame:
    """Whether an agent wrote the introducing commit; null when unknown (2.3.15)."""
    commits = authored.select("repo", "sha", "an", "ae", "coauthor_text").dropDuplicates(["repo", "sha"])
    agent = identity.is_agent(F.col("ae"), F.col("an")) | identity.any_coauthor_agent(F.split("coauthor_text", "\x1d"))
    return markers.join(commits.select("repo", "sha", agent.alias("agent_introduced")), ["repo", "sha"], "left")


def times_counted(commit_times: DataFrame) -> DataFrame:
    """Commits to a file by their time; rows that are counted already stay as they are."""
    if "n" in commit_times.columns:
        return commit_times.select("repo", "path", "ts", "n")
    return commit_times.groupBy("repo", "path", "ts").agg(F.count(F.lit(1)).alias("n"))


def with_survived(marks: DataFrame, commit_times: DataFrame) -> DataFrame:
    """``marks(repo, path, intro_ts, ...)`` with ``survived``: commits to the file after each introduction.

    Marks and commits lie on one time line per file, latest first, and every mark
    reads off how many commits came before it on the line: nothing is joined back.
    Marks without a time have no count.
    """
    own = [c for c in marks.columns if c not in ("repo", "path")]
    zero = F.lit(0).cast("long")
    counts = times_counted(commit_times)
    at_marks = marks.select("repo", "path", F.coalesce("intro_ts", zero).alias("ts"), zero.alias("n"), F.struct(*own).alias("mark"))
    line = at_marks.unionByName(counts, allowMissingColumns=True)
    line = stage(line.withColumns({"_back": -F.col("ts"), "_day": -F.floor(F.col("ts") / 86400), "_later": F.col("mark").isNull()}), "timeline")
    if has_hot(line, ["repo", "path"]):
        summed = running_sum(line, ["repo", "path"], "_day", ["_back", "_later"], "n", "upto")
    else:
        upto = Window.partitionBy("repo", "path").orderBy("_back", "_later").rowsBetween(Window.unboundedPreceding, 0)
        summed = line.dropna(subset=["repo", "path"]).withColumn("upto", F.sum("n").over(upto))
    summed = summed.where(F.col("mark").isNotNull())
    return summed.select("repo", "path", "mark.*", F.when(F.col("mark.intro_ts").isNotNull(), F.col("upto")).alias("survived"))


def age(markers: DataFrame, commit_times: DataFrame, people: DataFrame) -> DataFrame:
    """Survived touches, author kind and severity of markers that carry their blame (2.10.2).

    ``markers`` as ``scan`` gives them, with ``sha`` and ``intro_ts`` of the line kept;
    ``commit_times(repo, path, ts)``; ``people(repo, sha, an, ae, coauthor_text)``.
    """
    counts = stage(times_counted(commit_times), "touches")
    survived = with_survived(markers, counts)
    commits = stage(counts.groupBy("repo", "path").agg(F.sum("n").alias("commits")), "churn")
    deciles = churn.commit_count_decile(commits).select("repo", "path", "decile")
    aged = marker_author(survived, people).join(deciles, ["repo", "path"], "left").withColumn("decile", F.coalesce("decile", F.lit(0.0)))
    return aged.withColumn(
        "severity", scores.marker_severity(F.col("family"), F.col("survived"), F.col("decile"))
    ).withColumn("stale", F.coalesce(F.col("survived") >= fv.STALE_TOUCHES, F.lit(False)))


def family_summary(aged: DataFrame) -> DataFrame:
    """Counts per family (2.4.16)."""
    return aged.groupBy("repo", "family").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("stale").alias("stale"),
        F.count_if("linked").alias("linked"),
        F.count_if(F.coalesce("agent_introduced", F.lit(False))).alias("agent_introduced"),
    )


def totals(aged: DataFrame) -> DataFrame:
    """Bare and linked todos, stale markers and those agents left."""
    todo = F.col("family") == "todo"
    return aged.groupBy("repo").agg(
        F.count_if(todo & ~F.col("linked")).alias("todo_bare"),
        F.count_if(todo & F.col("linked")).alias("todo_linked"),
        F.count(F.lit(1)).alias("total_markers"),
        F.count_if("stale").alias("total_stale"),
        F.count_if(F.col("stale") & F.coalesce("agent_introduced", F.lit(False))).alias("stale_agent_introduced"),
    )


def stale_by_file(aged: DataFrame) -> DataFrame:
    """Stale markers of each file; at most four families fit the list (2.4.17)."""
    return aged.where("stale").groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
        F.max("survived").alias("max_survived"),
    )


def top_offenders(aged: DataFrame, k: int = fv.TOP_LIST) -> DataFrame:
    """Stale markers by severity, then path and line (2.6.5)."""
    order = [F.round("severity", 6).desc(), F.asc("path"), F.asc("line_no"), F.asc("family")]
    return top_k(aged.where("stale"), ["repo"], order, k)


def unactioned_intent(aged: DataFrame, degenerate: DataFrame) -> DataFrame:
    """Files with stale markers where the history can be trusted (2.11.7)."""
    files = stale_by_file(aged).select("repo", "path")
    return salted_lookup(files, degenerate.where("degenerate").select("repo"), ["repo"], "left_anti")
