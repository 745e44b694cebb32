"""What tests pin down: mutants, coverage, siblings, focus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, text
from tidemark.scale import first_of, salted_lookup, skewed_join, top_k


def survivor_density(mutation: DataFrame) -> DataFrame:
    """Survivors over all mutants; null without totals (2.4.21)."""
    return mutation.groupBy("repo").agg(
        F.sum(F.coalesce("survived", F.lit(0))).alias("total_survived"),
        F.sum("total").alias("total_mutants"),
        F.try_divide(F.sum(F.coalesce("survived", F.lit(0))), F.sum("total")).alias("overall"),
    )


def survivor_clusters(mutation: DataFrame, k: int = 50) -> DataFrame:
    """Files with three or more survivors, fifty most."""
    many = mutation.where(F.col("survived") >= fv.CLUSTER_MIN_SURVIVORS).select("repo", "file", "survived")
    return top_k(many, ["repo"], [F.desc("survived"), F.asc("file")], k)


def coverage_overall(lines: DataFrame) -> DataFrame:
    """Hit lines over found lines (2.4.22)."""
    return lines.groupBy("repo").agg(F.try_divide(F.sum("lh"), F.sum("lf")).alias("rate"))


def untrusted_hotspots(hotspots: DataFrame, mutation: DataFrame, density: float = fv.SURVIVOR_DENSITY) -> DataFrame:
    """Hotspots whose mutants survive too often (2.3.20)."""
    dense = mutation.where(F.col("total") > 0).where(F.coalesce("survived", F.lit(0)) / F.col("total") >= density)
    return hotspots.select("repo", "path").distinct().join(
        dense.select("repo", F.col("file").alias("path")), ["repo", "path"], "left_semi"
    )


def dead_weight(high: DataFrame, dead_code: DataFrame, intent: DataFrame) -> DataFrame:
    """Complex files a tool calls dead and nothing explains (2.3.19)."""
    flagged = high.select("repo", "path").distinct().join(dead_code.select("repo", "path"), ["repo", "path"], "left_semi")
    return flagged.join(intent.select("repo", "path"), ["repo", "path"], "left_anti")


def test_names(path: Column) -> Column:
    """Sibling test names from the literal templates (2.13.2)."""
    base, ext = paths.stem(path), F.regexp_extract(paths.basename(path), r"^.+(\.[^.]+)$", 1)
    templates = F.array(*[F.lit(n) for n in fv.TEST_NAME_TEMPLATES])
    return F.transform(templates, lambda n: F.replace(F.replace(n, F.lit("{stem}"), base), F.lit("{ext}"), ext))


def colocated_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """First sibling test of each source, by place and name order (2.3.12).

    Looked up from the tests' side: a file whose name fits a template gives the
    stem, extension and directory of the source it would test, so only such
    files are shuffled, once, and not every name a source might have a test under.
    """
    p = F.col("source_file")
    ext = F.regexp_extract(paths.basename(p), r"^.+(\.[^.]+)$", 1)
    src = sources.select("repo", F.col("path").alias("source_file")).where(~paths.is_test_stem(F.col("path"))).distinct()
    src = src.select("repo", "source_file", paths.parent(p).alias("folder"), paths.stem(p).alias("stem"), ext.alias("ext"))
    name, folder = paths.basename(F.col("path")), paths.parent(F.col("path"))
    forms = []
    for i, template in enumerate(fv.TEST_NAME_TEMPLATES):
        pattern = "^" + re.escape(template).replace(r"\{stem\}", "(.+?)").replace(r"\{ext\}", r"((?:\.[^.]+)?)") + "$"
        forms.append(F.when(name.rlike(pattern), F.struct(F.lit(i).alias("form"), F.regexp_extract(name, pattern, 1).alias("stem"), F.regexp_extract(name, pattern, 2).alias("ext"))))
    n = len(forms)
    same = F.struct(F.lit(n).alias("form"), paths.stem(F.col("path")).alias("stem"), F.regexp_extract(name, r"^.+(\.[^.]+)$", 1).alias("ext"))
    above = F.when(F.contains(folder, F.lit("/")), paths.parent(folder)).otherwise(F.lit(""))
    places = F.array(
        F.struct(folder.alias("folder"), F.lit(0).alias("first")),
        *[F.when(paths.basename(folder) == d, F.struct(above.alias("folder"), F.lit(n + j * (n + 1)).alias("first"))) for j, d in enumerate(fv.ADJACENT_TEST_DIRS)],
    )
    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    tests = (
        files.select("repo", "path").distinct()
        .select("repo", "path", F.explode(known(F.array(*forms, same))).alias("_form"), places.alias("places"))
        .select("repo", "path", "_form.*", F.explode(known(F.col("places"))).alias("_place"))
        .select("repo", F.col("path").alias("test_file"), "stem", "ext", "_place.folder", (F.col("_place.first") + F.col("form")).alias("rank"), ((F.col("_place.first") == 0) & (F.col("form") == n)).alias("itself"))
        .where(~F.col("itself")).drop("itself")
    )
    found = skewed_join(src, tests, ["repo", "folder", "stem", "ext"])
    return found.groupBy("repo", "source_file").agg(F.min_by("test_file", F.struct("rank", "test_file")).alias("test_file"))


def has_sibling_test(sources: DataFrame, files: DataFrame) -> DataFrame:
    """True, false, or null for a path that is no file."""
    known = files.select("repo", "path").distinct().withColumn("exists", F.lit(True))
    tested = colocated_tests(sources, files).select("repo", F.col("source_file").alias("path"), F.lit(True).alias("tested"))
    rows = sources.select("repo", "path").distinct().join(known, ["repo", "path"], "left").join(tested, ["repo", "path"], "left")
    verdict = F.when(F.col("exists"), F.coalesce("tested", F.lit(False)) | paths.is_test_stem(F.col("path")))
    return rows.select("repo", "path", verdict.alias("has_tests"))


def test_focus(ranked: DataFrame, coverage: DataFrame, heuristics: DataFrame, k: int | None = fv.TOP_LIST) -> DataFrame:
    """Hotspot band, coverage and hollow kinds to a focus list (2.3.21, 2.6.8).

    Without any coverage rows a repository is unknown, never clean.
    ``ranked`` has ``rank`` and ``risk_band``; ``heuristics(repo, path, kind)``.
    """
    covered = coverage.groupBy("repo", "path").agg(F.max("line_rate").alias("line_rate"))
    present = coverage.groupBy("repo").agg(F.lit(True).alias("present"))
    order = F.array(*[F.lit(k) for k in fv.HEURISTIC_KINDS])
    kinds = heuristics.where(F.col("kind").isin(fv.HEURISTIC_KINDS)).groupBy("repo", "path").agg(
        F.collect_set("kind").alias("found")
    )
    rows = salted_lookup(ranked, present, ["repo"]).join(covered, ["repo", "path"], "left").join(kinds, ["repo", "path"], "left")
    is_covered = F.coalesce(F.col("line_rate") > 0, F.lit(False))
    signal = (
        F.when(F.col("present").isNull(), "unknown_no_coverage")
        .when(~is_covered, "no_covering_test")
        .when(F.col("found").isNotNull(), "covered_but_hollow")
        .otherwise("covered_clean")
    )
    hollow = F.when(is_covered, F.array_join(F.filter(order, lambda k: F.array_contains("found", k)), ","))
    action = (
        F.when(F.col("test_signal").isin("no_covering_test", "unknown_no_coverage"), "add_tests")
        .when(F.col("test_signal") == "covered_but_hollow", "strengthen_assertions")
        .otherwise("none")
    )
    severity = (
        F.when(F.col("test_signal") == "no_covering_test", 3).when(F.col("test_signal") == "covered_but_hollow", 2).otherwise(1)
    )
    band = F.when(F.col("risk_band") == "high", 3).when(F.col("risk_band") == "medium", 2).otherwise(1)
    focus = rows.withColumn("test_signal", signal).withColumn("hollow_kinds", F.coalesce(hollow, F.lit("")))
    focus = focus.where(F.col("test_signal") != "covered_clean").withColumn("suggested_action", action)
    focus = focus.withColumn("band_order", band).withColumn("severity", severity)
    return first_of(focus, ["repo"], [F.desc("band_order"), F.desc("severity"), F.asc("rank")], k, "listed", rank="position")


def internal_assertions(lines: DataFrame) -> DataFrame:
    """Private fields asserted on in TypeScript and Go tests (2.10.14)."""
    ext = paths.extension(F.col("path"))
    fields = F.when(
        ext.isin(".ts", ".tsx", ".js", ".jsx"), text.all_matches(F.col("text"), text.UNICODE + fv.TS_INTERNAL_ASSERTION, 1)
    ).when(ext == ".go", text.all_matches(F.col("text"), text.UNICODE + fv.GO_INTERNAL_ASSERTION, 1))
    return (
        lines.where(fields.isNotNull())
        .select("repo", F.col("path").alias("test_file"), F.explode(fields).alias("internal_field"))
        .distinct()
    )


def assertion_on_internal(assertions: DataFrame) -> DataFrame:
    """Tests that read private fields and nothing public (2.10.14).

    ``assertions(repo, test_file, test_fn, field, is_private, is_call)``.
    """
    private = F.col("is_private") & ~F.col("is_call")
    verdict = assertions.groupBy("repo", "test_file", "test_fn").agg(
        F.bool_or(private).alias("reads_private"), F.bool_or(~F.col("is_private")).alias("reads_public")
    )
    bad = verdict.where(F.col("reads_private") & ~F.col("reads_public")).select("repo", "test_file", "test_fn")
    rows = assertions.where(private).select("repo", "test_file", "test_fn", F.col("field").alias("internal_field")).distinct()
    return rows.join(bad, ["repo", "test_file", "test_fn"], "left_semi")


def untested_boundaries(lines: DataFrame, covered_lines: DataFrame) -> DataFrame:
    """Comparisons on covered lines (2.3.25)."""
    op = F.regexp_replace(F.regexp_extract("text", fv.BOUNDARY_COMPARISON, 1), r"\s+", "")
    hits = lines.where(~paths.is_test_file(F.col("path"))).select("repo", "path", "line_no", op.alias("operator"))
    hits = hits.where(F.col("operator") != "")
    return hits.join(covered_lines.select("repo", "path", "line_no").distinct(), ["repo", "path", "line_no"], "left_semi")


def duplicate_truth(assignments: DataFrame) -> DataFrame:
    """Fields whose every assignment derives from one other field (2.10.15).

    ``assignments(repo, file, field, is_derived, source)``.
    """
    agg = assignments.groupBy("repo", "file", "field").agg(
        F.every("is_derived").alias("all_derived"), F.min("source").alias("low"), F.max("source").alias("high")
    )
    one = F.col("all_derived") & (F.col("low") == F.col("high")) & (F.col("low") != F.col("field"))
    return agg.where(one).select("repo", "file", "field", F.col("low").alias("derives_from"))


def assignments(lines: DataFrame) -> DataFrame:
    """``this.x = ...`` assignments of TypeScript sources as facts."""
    t = F.col("text")
    field = F.regexp_extract(t, text.UNICODE + fv.TS_ANY_ASSIGNMENT, 1)
    source = F.regexp_extract(t, text.UNICODE + fv.TS_DERIVED_ASSIGNMENT, 2)
    rows = lines.where(paths.extension(F.col("path")).isin(".ts", ".tsx", ".js", ".jsx") & ~paths.is_test_file(F.col("path")))
    return rows.where(field != "").select(
        "repo", F.col("path").alias("file"), field.alias("field"), (source != "").alias("is_derived"),
        F.when(source != "", source).alias("source"),
    )
