"""Co-change, containment and authorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import identity, paths
from tidemark.scale import LOOKUP_COPIES, has_hot, salted_lookup, skewed_join, top_k
from tidemark.staging import stage

PAIR = ["repo", "file_a", "file_b"]
#: Rows of pairs that are made, or counted, by one task.
PAIRS_A_PART = 1_000_000
#: Numbers that files are hashed to where only the most touched matter.
FILE_NUMBERS = 1 << 20


def _without_bulk(commit_files: DataFrame, max_files: int, min_files: int = 1) -> DataFrame:
    """Rows of commits with ``min_files`` to ``max_files`` files.

    Bulk commits can be enormous. One row more than allowed is kept of each, by a
    limit that holds before any shuffle, and shows that the commit is to go: its
    rows are never gathered, and the history is neither read twice nor joined.
    """
    first = top_k(commit_files, ["repo", "sha"], [F.asc("path")], max_files + 1, "_place")
    n = F.count(F.lit(1)).over(Window.partitionBy("repo", "sha"))
    return first.withColumn("_n", n).where(F.col("_n").between(min_files, max_files)).drop("_place", "_n")


def bulk_commit_filter(commit_files: DataFrame, max_files: int = fv.MAX_COMMIT_FILES) -> DataFrame:
    """Files of commits that touch 2 to ``max_files`` files (2.2.8)."""
    return _without_bulk(commit_files, max_files, 2)


def change_sets(commit_files: DataFrame, max_files: int = fv.MAX_COMMIT_FILES) -> DataFrame:
    """``repo, sha, files``: the sorted files of commits that touch 2 to ``max_files``."""
    return (
        _without_bulk(commit_files, max_files)
        .groupBy("repo", "sha")
        .agg(F.sort_array(F.collect_set("path")).alias("files"))
        .where(F.size("files") >= 2)
    )


def _pairs_of(sets: DataFrame) -> DataFrame:
    pairs = F.flatten(
        F.transform(
            "files",
            lambda a, i: F.transform(
                F.slice("files", i + 2, F.size("files")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b"))
            ),
        )
    )
    return sets.select("repo", "sha", F.explode(pairs).alias("p")).select("repo", "sha", "p.*")


def co_change_pairs(commit_files: DataFrame, max_files: int = fv.MAX_COMMIT_FILES) -> DataFrame:
    """Unordered file pairs per commit; a commit yields at most 1,225 (2.3.1).

    Without bulk commits a commit's files fit one short array, so pairs come
    from the row itself and the history is not joined with itself.
    """
    return _pairs_of(change_sets(commit_files, max_files))


def pair_counts(sets: DataFrame) -> DataFrame:
    """``repo, file_a, file_b, co_change_count`` of ``change_sets``, which are read several times: hand in a written table.

    Most pairs are rare, so what a task counts would grow with the history wherever a
    session's shuffle partitions stay as many. How many pairs there are is known from the
    sets; they are made and counted in parts of ``PAIRS_A_PART``. A pair can fill a part
    alone only if its files have as many commits: where some file has, pairs are counted
    by slices of the commits first. Files that share a number may call for that too.
    """
    n = F.size("files").cast("long")
    total = sets.agg(F.sum(F.shiftright(n * (n - 1), 1))).first()[0] or 0
    parts, own = -(-total // PAIRS_A_PART), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(max(parts, own), "repo", "sha") if parts > 1 else sets
    pairs, count = _pairs_of(dealt), F.count(F.lit(1)).alias("co_change_count")
    if parts <= own:
        return pairs.groupBy(*PAIR).agg(count)
    numbered = sets.select("repo", F.explode("files").alias("path")).select(F.pmod(F.xxhash64("repo", "path"), F.lit(FILE_NUMBERS)).alias("file"))
    if not has_hot(numbered, ["file"], PAIRS_A_PART):
        return pairs.select(*PAIR).repartition(parts, *PAIR).groupBy(*PAIR).agg(count)
    sliced = pairs.withColumn("_slice", F.pmod(F.xxhash64("sha"), F.lit(LOOKUP_COPIES))).drop("sha")
    sliced = sliced.repartition(parts, *PAIR, "_slice").groupBy(*PAIR, "_slice").agg(count)
    return sliced.repartition(parts, *PAIR).groupBy(*PAIR).agg(F.sum("co_change_count").alias("co_change_count"))


def coupling_pairs(
    commit_files: DataFrame, commits: DataFrame, min_support: int = fv.MIN_PAIR_SUPPORT
) -> DataFrame:
    """Pairs that keep changing together, with support over all commits (2.4.4)."""
    tally = pair_counts(stage(change_sets(commit_files), "change_sets")).where(F.col("co_change_count") >= min_support)
    totals = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    return salted_lookup(tally, totals, ["repo"], "inner").select(
        "repo",
        "file_a",
        "file_b",
        "co_change_count",
        (F.lit(100.0) * F.col("co_change_count") / F.col("total")).alias("support_pct"),
    )


def top_coupling_pairs(pairs: DataFrame, k: int = 100) -> DataFrame:
    return top_k(pairs, ["repo"], [F.desc("co_change_count"), F.asc("file_a"), F.asc("file_b")], k)


def containment_ratio(commit_files: DataFrame) -> DataFrame:
    """Commits that stay inside a directory over commits that touch it (2.4.5).

    A commit stays inside every directory that is above both its smallest and
    its largest path, so the inner count needs two aggregates per commit and no
    join against the commit's size.
    """
    dirs = commit_files.select("repo", "sha", paths.parent(F.col("path")).alias("dir")).distinct()
    touching = (
        dirs.select(
            "repo",
            "sha",
            F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("dir"),
        )
        .where(F.col("dir") != "")
        .distinct()
        .groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("touching"))
    )
    inside = (
        commit_files.groupBy("repo", "sha")
        .agg(F.min("path").alias("first"), F.max("path").alias("last"))
        .select("repo", F.explode(paths.common_directories(F.col("first"), F.col("last"))).alias("dir"))
        .groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("inside"))
    )
    return touching.join(inside, ["repo", "dir"], "left").select(
        "repo",
        "dir",
        "touching",
        (F.coalesce(F.col("inside"), F.lit(0)) / F.col("touching")).alias("containment"),
    )


def co_commit_pairs(test_map: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Keep (test, source) pairs that share a commit (2.3.13).

    Both sides shrink to commits of mapped files first.
    """
    tests = skewed_join(
        commit_files.select("repo", "sha", F.col("path").alias("test_file")),
        test_map.select("repo", "test_file", "source_file"),
        ["repo", "test_file"],
    )
    sources = commit_files.select("repo", "sha", F.col("path").alias("source_file"))
    return (
        tests.join(sources, ["repo", "sha", "source_file"], "left_semi")
        .select("repo", "test_file", "source_file")
        .distinct()
    )


def _flags(authored: DataFrame) -> DataFrame:
    author_agent = identity.is_agent(F.col("ae"), F.col("an"))
    author_human = identity.is_human(F.col("ae"), F.col("an"))
    involved = (
        author_agent
        | identity.is_agent(F.col("ce"), F.col("cn"))
        | identity.any_coauthor_agent(F.split(F.col("coauthor_text"), "\x1d"))
    )
    return authored.select(
        "repo",
        "path",
        "sha",
        "an",
        "ae",
        "added",
        "deleted",
        author_agent.alias("author_agent"),
        author_human.alias("author_human"),
        identity.is_human(F.col("ce"), F.col("cn")).alias("committer_human"),
        involved.alias("agent_involved"),
    )


def contributors(authored: DataFrame) -> DataFrame:
    """Commits and lines per author of a file (2.4.7)."""
    label = F.when(F.col("author_agent"), "agent").when(F.col("author_human"), "human").otherwise("unknown")
    return (
        _flags(authored)
        .withColumn("classification", label)
        .groupBy("repo", "path", F.col("an").alias("name"), F.col("ae").alias("email"), "classification")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.sum("added").alias("lines_added"),
            F.sum("deleted").alias("lines_removed"),
        )
    )


def authorship_class(authored: DataFrame) -> DataFrame:
    """Human anchor, intent source and class; agent only when nothing is unclear (2.4.8)."""
    agg = (
        _flags(authored)
        .groupBy("repo", "path")
        .agg(
            F.bool_or("agent_involved").alias("any_agent"),
            F.bool_or("author_human").alias("any_human"),
            F.bool_or(F.col("author_human") | F.col("committer_human")).alias("intent_source"),
            F.count_if(~F.col("author_human") & ~F.col("agent_involved")).alias("n_unknown"),
        )
    )
    agent, human = F.col("any_agent"), F.col("any_human")
    label = (
        F.when(agent & human, "mixed")
        .when(agent & (F.col("n_unknown") == 0), "agent")
        .when(agent, "unknown")
        .when(human, "human")
        .otherwise("unknown")
    )
    return agg.select("repo", "path", human.alias("human_anchor"), "intent_source", label.alias("authorship_class"))
