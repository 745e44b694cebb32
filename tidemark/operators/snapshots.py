"""Runs compared with earlier runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import scores
from tidemark.operators import folding
from tidemark.scale import running_sum

MEASURES = ["ccn", "commits", "loc"]


def hotspot_transitions(prior: DataFrame, current: DataFrame) -> DataFrame:
    """New, graduated, persistent or regressed hotspots (2.11.12).

    Both sides: ``(repo, path, ccn, commits, loc)``.
    """
    p = prior.select("repo", "path", F.lit(True).alias("was"), *[F.coalesce(m, F.lit(0)).alias(f"p_{m}") for m in MEASURES])
    c = current.select("repo", "path", F.lit(True).alias("now"), *[F.coalesce(m, F.lit(0)).alias(f"c_{m}") for m in MEASURES])
    both = p.join(c, ["repo", "path"], "full_outer")
    kept = F.col("was").isNotNull() & F.col("now").isNotNull()
    delta = {m: F.when(kept, F.col(f"c_{m}") - F.col(f"p_{m}")).otherwise(0) for m in MEASURES}
    status = (
        F.when(F.col("now").isNull(), "graduated")
        .when(F.col("was").isNull(), "new")
        .when((delta["ccn"] > 0) | ((delta["loc"] > 50) & (delta["commits"] > 2)), "regressed")
        .otherwise("persistent")
    )
    return both.select("repo", "path", status.alias("status"), *[delta[m].alias(f"{m}_delta") for m in MEASURES])


def transition_sets(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Graduated and new paths by two anti joins (2.7.9)."""
    keys = ["repo", "path"]
    gone = prior.select(*keys).join(current.select(*keys), keys, "left_anti").withColumn("status", F.lit("graduated"))
    new = current.select(*keys).join(prior.select(*keys), keys, "left_anti").withColumn("status", F.lit("new"))
    return gone.unionByName(new)


def diff_reliability(runs: DataFrame) -> DataFrame:
    """Whether two snapshots can be compared (2.11.13).

    ``runs(repo, prior_exists, prior_version, version, prior_schema, schema,
    prior_lizard, lizard, prior_scc, scc)``.
    """
    prior, current = scores.semver(F.col("prior_version")), scores.semver(F.col("version"))

    def tool(name: str) -> Column:
        a, b = F.col(f"prior_{name}"), F.col(name)
        return F.when(
            a.isNotNull() & b.isNotNull() & (a != b), F.concat(F.lit(f"{name} version changed "), a, F.lit("->"), b)
        )

    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    note = (
        F.when(~F.col("prior_exists"), F.lit(None).cast("string"))
        .when(F.coalesce("prior_version", F.lit("")) == "", "version not stamped in prior snapshot")
        .when(prior.isNull() | current.isNull(), F.concat(F.lit("unparseable version "), show(F.col("prior_version")), F.lit(", "), show(F.col("version"))))
        .when(
            ~F.col("prior_schema").eqNullSafe(F.col("schema")),
            F.concat(F.lit("schema version changed "), show(F.col("prior_schema")), F.lit("->"), show(F.col("schema"))),
        )
        .when(
            prior["major"] != current["major"],
            F.concat(F.lit("major version changed "), F.col("prior_version"), F.lit("->"), F.col("version")),
        )
        .otherwise(F.coalesce(tool("lizard"), tool("scc")))
    )
    return runs.select(
        "repo", note.isNull().alias("reliable"), note.alias("note"),
        F.coalesce(F.startswith(note, F.lit("major version changed")), F.lit(False)).alias("trend_reset"),
    )


def run_anomalies(runs: DataFrame, graded: DataFrame) -> DataFrame:
    """Suspicious runs, one row per code (2.11.14).

    ``runs(repo, files_scored, ccn_p95, ccn_max, hotspots, new, persistent,
    prior_exists)``; ``graded(repo, path, grade, lines)``.
    """
    def code(hit: Column, name: str, detail: Column) -> Column:
        return F.when(hit, F.struct(F.lit(name).alias("code"), detail.alias("detail")))

    files, hot = F.col("files_scored"), F.col("hotspots")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: c.cast("string")
    found = F.array_compact(
        F.array(
            code(files == 0, "ZERO_FILES_SCORED", F.lit("files_scored=0")),
            code(
                (files > 5) & (F.col("ccn_p95") == 0) & (F.col("ccn_max") == 0), "ZERO_COMPLEXITY",
                text("files_scored=", s(files), ", ccn_p95=0, ccn_max=0"),
            ),
            code((files > 200) & (hot == 0), "EMPTY_HOTSPOTS", text("files_scored=", s(files), ", hotspots_count=0")),
            code(
                F.col("prior_exists") & (hot > 5) & (F.col("new") == hot) & (F.col("persistent") == 0), "ALL_NEW_HOTSPOTS",
                text("hotspot_count=", s(hot), ", new_count=", s(F.col("new")), ", persistent_count=0"),
            ),
        )
    )
    of_runs = runs.select("repo", F.explode(found).alias("a")).select("repo", "a.*")
    name = F.substring_index("path", "/", -1)
    of_files = graded.where((F.col("grade") == "F") & (F.col("lines") > 200)).select(
        "repo", F.lit("INSTRUCTION_FILE_GRADE_MISMATCH").alias("code"), text("file=", name, ", line_count=", s(F.col("lines")), ", grade=F").alias("detail")
    )
    return of_runs.unionByName(of_files)


def first_flagged(history: DataFrame, records_from: int) -> DataFrame:
    """Earliest run that flagged a path; unknown when older than the records (2.5.11)."""
    first = history.groupBy("repo", "path").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    return first.select(
        "repo", "path", F.when(F.col("first_run") < records_from, "unknown").otherwise(F.col("first_run").cast("string")).alias("first_flagged"),
        "last_run",
    )


def hotspot_index(current: DataFrame, transitions: DataFrame, ranked: list[DataFrame], flagged: DataFrame) -> DataFrame:
    """Current hotspots and graduated ones with whatever metrics are known (2.11.20).

    ``ranked`` are the three lists in order; the first non-null value counts.
    """
    tagged = [df.select("repo", "path", "loc", "ccn", F.lit(i).alias("o")) for i, df in enumerate(ranked)]
    known = reduce(DataFrame.unionByName, tagged).groupBy("repo", "path").agg(
        F.min_by("loc", F.when(F.col("loc").isNotNull(), F.col("o"))).alias("loc"),
        F.min_by("ccn", F.when(F.col("ccn").isNotNull(), F.col("o"))).alias("ccn"),
    )
    live = current.select("repo", "path").join(transitions.select("repo", "path", "status"), ["repo", "path"], "left")
    live = live.withColumn("status", F.coalesce("status", F.lit("active")))
    gone = transitions.where(F.col("status") == "graduated").select("repo", "path", "status")
    rows = live.unionByName(gone).join(known, ["repo", "path"], "left").join(
        flagged.select("repo", "path", "first_flagged"), ["repo", "path"], "left"
    )
    return rows.select("repo", "path", "status", F.coalesce("first_flagged", F.lit("unknown")).alias("first_flagged"), "ccn", "loc")


def orphan_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Hotspot pages whose file left the tree and that are not retired yet (2.11.19)."""
    open_pages = pages.where(F.col("status") != fv.RETIRED_STATUS)
    return open_pages.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_anti").select("repo", "path")


def log_chain(entries: DataFrame, chunk: int = 1024) -> DataFrame:
    """Expected hash of every stamped entry, and of the last one of each log (2.5.10).

    ``entries(repo, log, n, text, stored)``. A stamped entry rests on the
    previous *stored* hash, so the log falls into segments that end with a
    stamped entry; a segment is folded in order, carrying only the hash (see
    ``folding``).
    """
    keys = ["repo", "log"]
    marked = entries.withColumn("_chunk", F.floor(F.col("n") / chunk)).withColumn("_s", F.col("stored").isNotNull().cast("int"))
    numbered = running_sum(marked, keys, "_chunk", ["n"], "_s", "_upto")
    entries_of = numbered.select(*keys, (F.col("_upto") - F.col("_s")).alias("segment"), F.lit(folding.ENTRY).alias("kind"), "n", "text", "stored")
    before = entries_of.where(F.col("stored").isNotNull()).select(
        *keys, (F.col("segment") + 1).alias("segment"), F.lit(folding.FIRST).alias("kind"), "n", F.col("stored").alias("text"), F.lit(None).cast("string").alias("stored")
    )
    return folding.chained(entries_of.unionByName(before))


def log_chain_verify(entries: DataFrame) -> DataFrame:
    """Whether each log is intact, and its first break."""
    bad = F.col("stored").isNotNull() & (F.col("stored") != F.col("expected"))
    return log_chain(entries).groupBy("repo", "log").agg((~F.bool_or(bad)).alias("valid"), F.min(F.when(bad, F.col("n"))).alias("broken_at"))
