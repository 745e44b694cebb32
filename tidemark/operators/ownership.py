"""Ownership rules and architecture references against the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, text
from tidemark.operators import globbing
from tidemark.scale import carry_forward, running_sum, salted_lookup, skewed_join
from tidemark.staging import stage

WILDCARD = r"[*?\[]"


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Each rule's regex and the literal part that can serve as a join key."""
    bare = F.regexp_replace(F.trim("pattern"), "^/+", "")
    glob = F.regexp_replace(F.when(bare.endswith("/"), F.concat(bare, F.lit("*"))).otherwise(bare), r"\*\*", "*")
    anchored = F.startswith(F.trim("pattern"), F.lit("/")) | F.contains(F.regexp_replace(glob, r"\*+$", ""), F.lit("/"))
    df = rules.select("repo", "pattern", glob.alias("glob"), anchored.alias("anchored")).select(
        "*",
        F.regexp_extract("glob", r"^([^*?\[]*)/", 1).alias("dir"),
        paths.basename(F.col("glob")).alias("last"),
        F.regexp_extract("glob", r"(\.[^.*?\[\]/]+)$", 1).alias("ext"),
    )
    df = df.withColumn(
        "kind",
        F.when(F.col("anchored") & ~F.col("glob").rlike(WILDCARD), "path")
        .when(F.col("anchored") & (F.col("dir") != ""), "dir")
        .when(~F.col("last").rlike(WILDCARD), "name")
        .when(F.col("ext") != "", "ext")
        .otherwise("scan"),
    )
    kind = F.col("kind")
    key = (
        F.when(kind == "path", F.col("glob"))
        .when(kind == "dir", F.col("dir"))
        .when(kind == "name", F.col("last"))
        .when(kind == "ext", F.col("ext"))
        .otherwise("")
    )
    prefix = F.when(F.col("anchored"), "").otherwise("(?:.*/)?")
    body = F.regexp_replace(paths.glob_column_regex(F.col("glob")), r"^\(\?s\)\^", "")
    # an equal key says it all where nothing else is left of the pattern
    exact = (
        (kind == "path") | ((kind == "name") & ~F.col("anchored") & (F.col("glob") == F.col("last")))
        | ((kind == "dir") & (F.col("glob") == F.concat("dir", F.lit("/*"))))
    )
    return df.select("repo", "pattern", "glob", "anchored", F.concat(F.lit("(?s)^"), prefix, body).alias("regex"), "kind", key.alias("key"), exact.alias("exact"))


def match_rules(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Every (rule, file) match without a nested-loop join (2.3.5).

    A rule is looked up by its literal path, directory prefix, name or
    extension; the regex is checked on those candidates only, and not where the
    key is the whole rule. Brackets that do not close are literal. Rules with no
    literal part at all become one automaton per repository, which reads each path
    once, however many they are (see ``globbing``).
    """
    keyed = stage(_rule_keys(rules.select("repo", "pattern").distinct()), "rules")

    def probe(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    p = F.col("path")
    probes = F.concat(
        F.array(probe("path", p), probe("name", paths.basename(p)), probe("ext", F.regexp_extract(p, r"(\.[^./]+)$", 1))),
        F.transform(paths.ancestors(p), lambda d: probe("dir", d)),
    )
    candidates = files.select("repo", "path", F.explode(probes).alias("k")).select("repo", "path", "k.*")
    hits = skewed_join(candidates, keyed.where(F.col("kind") != "scan"), ["repo", "kind", "key"]).where(
        F.col("exact") | F.rlike("path", F.col("regex"))
    )
    scanned = globbing.matched(keyed.where(F.col("kind") == "scan").select("repo", "pattern", "glob", "anchored"), files)
    return hits.select("repo", "pattern", "path").unionByName(scanned).distinct()


def rule_counts(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Files per rule; a rule without files stays with zero."""
    counted = matches.groupBy("repo", "pattern").agg(F.count(F.lit(1)).alias("n_files"))
    return (
        rules.select("repo", "pattern").distinct().join(counted, ["repo", "pattern"], "left").na.fill(0, ["n_files"])
    )


def outside_fences(lines: DataFrame, chunk_lines: int = 10_000) -> DataFrame:
    """Drop fenced blocks from documents held line by line; a fence that never closes is text."""
    rows = lines.withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines)).withColumn(
        "_fence", F.col("text").rlike(r"^\s*```").cast("int")
    )
    counted = running_sum(rows, ["repo", "doc"], "_chunk", ["line_no"], "_fence", "_fences")
    totals = counted.groupBy("repo", "doc").agg(F.sum("_fence").alias("_total"))
    unpaired = (F.col("_total") % 2 == 1) & (F.col("_fences") == F.col("_total"))
    outside = (F.col("_fences") % 2 == 0) & (F.col("_fence") == 0)
    return skewed_join(counted, totals, ["repo", "doc"]).where(outside | unpaired).drop("_chunk", "_fence", "_fences", "_total")


def section_carry_forward(lines: DataFrame, chunk_lines: int = 10_000) -> DataFrame:
    """Attribute each line to the header above it (2.5.8).

    Before the first header a document's own name is the section. Long
    documents are carried chunk by chunk.
    """
    title = F.trim(F.regexp_extract("text", fv.HEADER_PATTERN, 2))
    rows = lines.withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines)).withColumn(
        "_header", F.when(F.col("text").rlike(fv.HEADER_PATTERN), title)
    )
    carried = carry_forward(rows, ["repo", "doc"], "_chunk", ["line_no"], "_header", "_section")
    section = F.concat(F.col("doc"), F.lit("::"), F.coalesce("_section", paths.basename(F.col("doc"))))
    return carried.where(F.col("_header").isNull()).select("repo", "doc", "line_no", "text", section.alias("section"))


def section_refs(lines: DataFrame) -> DataFrame:
    """Paths each section of an architecture document names."""
    return (
        section_carry_forward(outside_fences(lines))
        .select("repo", "doc", "section", F.explode(text.path_refs(F.col("text"))).alias("ref"))
        .distinct()
    )


def resolve_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Level on which a reference resolves: file, directory, bare name, or none (2.3.6).

    Only existence is looked up here; :func:`expand_refs` lists the files.
    """
    norm = F.regexp_replace("ref", "^/+|/+$", "")
    wanted = refs.withColumn("norm", norm)
    dirs = files.select("repo", paths.parent(F.col("path")).alias("dir")).distinct()
    known = (
        files.select("repo", F.col("path").alias("norm"), F.lit(1).alias("level"))
        .unionByName(
            dirs.select("repo", F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("norm"), F.lit(2).alias("level"))
        )
        .unionByName(files.select("repo", paths.basename(F.col("path")).alias("norm"), F.lit(3).alias("level")))
        .where(F.col("norm") != "")
        .groupBy("repo", "norm")
        .agg(F.min("level").alias("level"))
    )
    return skewed_join(wanted, known, ["repo", "norm"], "left")


def expand_refs(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Files behind each resolved reference."""
    refs = resolved.where(F.col("level").isNotNull()).select("repo", "section", "ref", "norm", "level").distinct()
    p = F.col("path")
    offered = files.select(
        "repo",
        "path",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit(1).alias("level"), p.alias("norm")),
                    F.struct(F.lit(3).alias("level"), paths.basename(p).alias("norm")),
                ),
                F.transform(paths.ancestors(p), lambda d: F.struct(F.lit(2).alias("level"), d.alias("norm"))),
            )
        ).alias("k"),
    ).select("repo", "path", "k.*")
    return skewed_join(offered, refs, ["repo", "level", "norm"]).select("repo", "section", "ref", "path").distinct()


def empty_patterns(rules: DataFrame, matches: DataFrame, resolved_refs: DataFrame) -> DataFrame:
    """Declared globs and references that match no tracked file (2.11.10)."""
    globs = rules.select("repo", "pattern", "declared_in").join(
        matches.select("repo", "pattern").distinct(), ["repo", "pattern"], "left_anti"
    )
    refs = resolved_refs.where(F.col("level").isNull()).select(
        "repo", F.col("ref").alias("pattern"), F.col("section").alias("declared_in")
    )
    return globs.unionByName(refs).distinct()


def coverage(rules: DataFrame, matches: DataFrame, resolved_refs: DataFrame) -> DataFrame:
    """Declared and matched patterns per repository (2.4.27)."""
    globs = rule_counts(rules, matches).select("repo", (F.col("n_files") > 0).alias("matched"))
    refs = resolved_refs.select("repo", F.col("level").isNotNull().alias("matched"))
    both = globs.unionByName(refs)
    return both.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("matched").alias("matched"),
        (F.count_if("matched") / F.count(F.lit(1))).alias("ratio"),
    )


def ownership_map(matches: DataFrame, expanded_refs: DataFrame) -> DataFrame:
    """Boundaries and their files in long form."""
    globs = matches.select("repo", F.concat(F.lit("CODEOWNERS::"), "pattern").alias("boundary"), "path")
    refs = expanded_refs.select("repo", F.col("section").alias("boundary"), "path")
    return globs.unionByName(refs).distinct()
