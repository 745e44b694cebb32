"""Coverage, mutation, dead-code and dependency reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.scale import carry_forward


def read_cobertura(spark: SparkSession, root: str) -> DataFrame:
    """``<class>`` rows of landed Cobertura reports (2.1.7)."""
    rows = spark.read.format("xml").option("rowTag", "class").schema("_filename string, `_line-rate` string, repo string").load(root)
    return cobertura_classes(rows.select("repo", F.col("_filename").alias("filename"), F.col("`_line-rate`").alias("rate")))


def read_cobertura_overall(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "coverage").schema("`_line-rate` string, repo string").load(root)
    return rows.select("repo", F.col("`_line-rate`").try_cast("double").alias("rate"))


def cobertura_fragments(xml: DataFrame) -> DataFrame:
    """The same from XML fragments held in a column ``xml``."""
    schema = "_filename string, `_line-rate` string"
    parsed = xml.select("repo", F.from_xml("xml", schema).alias("c"))
    return cobertura_classes(parsed.select("repo", F.col("c._filename").alias("filename"), F.col("c.`_line-rate`").alias("rate")))


def cobertura_classes(rows: DataFrame) -> DataFrame:
    """Line rate per file; classes without a usable number are skipped."""
    rated = rows.select("repo", F.col("filename").alias("path"), F.col("rate").try_cast("double").alias("line_rate"))
    return rated.where(F.col("path").isNotNull() & F.col("line_rate").isNotNull()).groupBy("repo", "path").agg(
        F.max("line_rate").alias("line_rate")
    )


def read_lcov(spark: SparkSession, root: str) -> DataFrame:
    """Records of landed lcov files; one row per record, no ordering needed."""
    raw = spark.read.option("lineSep", "end_of_record").text(root)
    return lcov_lines(raw.select(F.col("repo").cast("string").alias("repo"), "value"))


def lcov_lines(raw: DataFrame) -> DataFrame:
    """Found and hit lines per file (2.1.8).

    A record ends at its terminator, which separates the rows, or where the
    next ``SF:`` begins.
    """
    pieces = F.filter(F.split("value", r"(?m)^\s*(?=SF:)"), lambda p: F.startswith(F.trim(p), F.lit("SF:")))
    rows = raw.select("repo", F.explode(pieces).alias("p"))

    def last_number(tag: str) -> Column:
        found = F.regexp_extract_all("p", F.lit(rf"(?m)^\s*{tag}:\s*(\d+)\s*$"), F.lit(1))
        return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("long"), F.lit(0).cast("long"))

    parsed = rows.select(
        "repo", F.trim(F.regexp_extract("p", r"SF:([^\n]*)", 1)).alias("path"), last_number("LF").alias("lf"), last_number("LH").alias("lh")
    )
    return parsed.where(F.col("lf") > 0)


def lcov_rates(lines: DataFrame) -> DataFrame:
    return lines.groupBy("repo", "path").agg((F.sum("lh") / F.sum("lf")).alias("line_rate"))


def first_coverage_location(listing: DataFrame) -> DataFrame:
    """The report a repository is read from: first of six places (2.1.7)."""
    places = F.array(*[F.lit(p) for p, _ in fv.COVERAGE_LOCATIONS])
    kinds = F.create_map(*[F.lit(x) for item in fv.COVERAGE_LOCATIONS for x in item])
    found = listing.withColumn("o", F.array_position(places, F.col("path"))).where(F.col("o") > 0)
    return found.groupBy("repo").agg(F.min_by("path", "o").alias("source")).withColumn("format", kinds[F.col("source")])


def _by_status(rows: DataFrame, killed: list[str], survived: list[str]) -> DataFrame:
    low = F.lower("status")
    agg = rows.groupBy("repo", "tool", "file").agg(
        F.count_if(low.isin(killed)).alias("killed"), F.count_if(low.isin(survived)).alias("survived")
    )
    return agg.withColumn("total", F.col("killed") + F.col("survived"))


def mutation_stryker(json: DataFrame) -> DataFrame:
    """Stryker JSON held in a column ``json``."""
    schema = "files map<string, struct<mutants: array<struct<status: string>>>>"
    files = json.select("repo", F.explode(F.from_json("json", schema)["files"]).alias("file", "info"))
    rows = files.select("repo", F.lit("stryker").alias("tool"), "file", F.explode("info.mutants").alias("m")).select("repo", "tool", "file", "m.status")
    return _by_status(rows, ["killed", "timeout"], ["survived", "nocoverage", "no coverage"]).where(F.col("total") > 0)


def mutation_lines(lines: DataFrame, tool: str) -> DataFrame:
    """Text output of gremlins or cargo-mutants, one line per mutant."""
    pattern, killed, survived = {
        "gremlins": (fv.GREMLINS_LINE, ["killed"], ["lived", "not covered"]),
        "cargo-mutants": (fv.CARGO_MUTANTS_LINE, ["caught"], ["missed"]),
    }[tool]
    line = F.trim("text")
    rows = lines.where(line.rlike(pattern)).select(
        "repo", F.lit(tool).alias("tool"), F.regexp_extract(line, pattern, 2).alias("file"), F.regexp_extract(line, pattern, 1).alias("status")
    )
    return _by_status(rows, killed, survived).where(F.col("total") > 0)


def mutation_mutmut(lines: DataFrame) -> DataFrame:
    """Survivor lines of mutmut; totals stay unknown."""
    line = F.trim("text")
    rows = lines.where(line.rlike(fv.MUTMUT_LINE)).select("repo", F.regexp_extract(line, fv.MUTMUT_LINE, 1).alias("file"))
    unknown = F.lit(None).cast("long")
    return rows.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("survived")).select(
        "repo", F.lit("mutmut").alias("tool"), "file", unknown.alias("killed"), "survived", unknown.alias("total")
    )


def mutation_junit(cases: DataFrame) -> DataFrame:
    """mutmut JUnit test cases ``(repo, file, classname, failed)``."""
    dotted = F.regexp_extract("classname", r"^mutmut\.(.+)$", 1)
    name = F.coalesce(
        F.when(F.coalesce("file", F.lit("")) != "", F.col("file")),
        F.when(dotted != "", F.concat(F.replace(dotted, F.lit("."), F.lit("/")), F.lit(".py"))),
    )
    rows = cases.select("repo", F.lit("mutmut").alias("tool"), name.alias("file"), F.when(F.col("failed"), "survived").otherwise("killed").alias("status"))
    return _by_status(rows.where(F.col("file").isNotNull()), ["killed"], ["survived"])


def read_mutation_junit(spark: SparkSession, root: str) -> DataFrame:
    schema = "_file string, _classname string, failure string, repo string"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\x00").schema(schema).load(root)
    return mutation_junit(
        rows.select("repo", F.col("_file").alias("file"), F.col("_classname").alias("classname"), F.col("failure").isNotNull().alias("failed"))
    )


def mutation_reports(*parts: DataFrame) -> DataFrame:
    """One table of the report shapes (2.1.9)."""
    return reduce(DataFrame.unionByName, [p.select("repo", "tool", "file", "killed", "survived", "total") for p in parts])


def dead_code_lines(lines: DataFrame) -> DataFrame:
    """Tool output lines ``(repo, tool, text)`` by the rule table (2.1.10, 2.13.1)."""
    line = F.trim("text")

    def pick(groups: tuple, pattern: str, i: int) -> Column:
        return F.lit(groups[i]) if isinstance(groups[i], str) else F.regexp_extract(line, pattern, groups[i])

    parsed = []
    for tool, pattern, groups, dropped in fv.DEAD_CODE_TOOLS:
        hit = (F.col("tool") == tool) & line.rlike(pattern)
        if dropped:
            hit = hit & ~F.contains(F.regexp_extract(line, pattern, 4), F.lit(dropped))
        parsed.append(
            F.when(
                hit,
                F.struct(
                    pick(groups, pattern, 0).alias("path"), pick(groups, pattern, 1).try_cast("int").alias("line"),
                    pick(groups, pattern, 2).alias("kind"), pick(groups, pattern, 3).alias("symbol"),
                ),
            )
        )
    rows = lines.select("repo", "tool", F.coalesce(*parsed).alias("d")).where(F.col("d").isNotNull()).select("repo", "tool", "d.*")
    return rows.where(~paths.is_excluded_path(F.col("path")))


def dead_code_knip(json: DataFrame) -> DataFrame:
    """knip JSON: unused files and exports."""
    schema = "files array<string>, issues array<struct<file: string, exports: array<struct<name: string>>>>"
    doc = json.select("repo", F.from_json("json", schema).alias("j"))
    base = [F.lit("knip").alias("tool")]
    files = doc.select("repo", *base, F.explode("j.files").alias("path")).select(
        "repo", "tool", "path", F.lit(0).alias("line"), F.lit("unused file").alias("kind"), F.lit("(file)").alias("symbol")
    )
    exports = doc.select("repo", *base, F.explode("j.issues").alias("i")).select(
        "repo", "tool", F.col("i.file").alias("path"), F.lit(0).alias("line"), F.lit("unused export").alias("kind"), F.explode("i.exports.name").alias("symbol")
    )
    return files.unionByName(exports).where(~paths.is_excluded_path(F.col("path")))


def dead_code_union(*parts: DataFrame) -> DataFrame:
    """Symbols and unused dependencies in one table (2.7.11)."""
    cols = ["repo", "tool", "path", "line", "kind", "symbol"]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def dependency_sections(lines: DataFrame, chunk_lines: int = 10_000) -> DataFrame:
    """Dependency lines of build logs with the section they stand in (2.1.11).

    ``lines(repo, log, line_no, text)``. A header opens a section and any other
    line that is no coordinate closes it; the state is carried chunk by chunk.
    """
    low = F.lower("text")
    bare = F.trim(F.regexp_replace("text", fv.LOG_PREFIX, ""))
    is_dep = bare.rlike(fv.COORDINATE)
    event = (
        F.when(F.contains(low, F.lit(fv.UNUSED_DECLARED)), "unused")
        .when(F.contains(low, F.lit(fv.USED_UNDECLARED)), "undeclared")
        .when(~is_dep & (bare != ""), "closed")
    )
    rows = lines.withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines)).withColumn("_event", event)
    carried = carry_forward(rows, ["repo", "log"], "_chunk", ["line_no"], "_event", "section")
    symbol = F.concat_ws(":", F.regexp_extract(bare, fv.COORDINATE, 1), F.regexp_extract(bare, fv.COORDINATE, 2))
    return carried.where(is_dep & F.col("_event").isNull()).select("repo", "log", "line_no", "section", symbol.alias("symbol"))


def unused_dependencies(sections: DataFrame) -> DataFrame:
    return sections.where(F.col("section") == "unused").select(
        "repo", F.lit("dependency-analyze").alias("tool"), F.col("log").alias("path"), F.lit(0).alias("line"),
        F.lit("unused declared dependency").alias("kind"), "symbol",
    )


def used_undeclared_count(sections: DataFrame) -> DataFrame:
    return sections.groupBy("repo").agg(F.count_if(F.col("section") == "undeclared").alias("used_undeclared"))
