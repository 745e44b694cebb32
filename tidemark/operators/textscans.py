"""One-pass scans over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, scores, text


def sensitive_content(docs: DataFrame) -> DataFrame:
    """Distinct (category, redacted evidence) per document (2.10.3)."""
    t = F.col("text")

    def rows(category: str, evidence: Column) -> Column:
        return F.transform(evidence, lambda e: F.struct(F.lit(category).alias("category"), e.alias("evidence")))

    once = lambda hit, value: F.when(hit, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))
    creds = F.filter(
        F.transform(
            text.all_matches(t, "(?i)" + text.UNICODE + fv.CREDENTIAL_ASSIGNMENT),
            lambda m: F.struct(
                F.lower(F.regexp_extract(m, "(?i)" + text.UNICODE + fv.CREDENTIAL_ASSIGNMENT, 1)).alias("key"),
                F.regexp_extract(m, "(?i)" + text.UNICODE + fv.CREDENTIAL_ASSIGNMENT, 2).alias("value"),
            ),
        ),
        lambda c: text.is_concrete_credential(c["value"]),
    )
    ips = F.filter(text.all_matches(t, text.UNICODE + fv.IPV4_PATTERN, 1), text.is_routable_ipv4)
    homes = F.filter(
        text.all_matches(t, fv.UNIX_HOME_PATTERN, 1),
        lambda h: ~F.lower(F.regexp_extract(h, "([^/]+)/$", 1)).isin(fv.UNIX_HOME_GENERIC),
    )
    windows = F.filter(
        text.all_matches(t, fv.WINDOWS_HOME_PATTERN, 1),
        lambda h: ~F.lower(F.regexp_extract(h, r"([^\\]+)\\$", 1)).isin(fv.WINDOWS_HOME_GENERIC),
    )
    found = F.concat(
        rows("private_key", once(t.rlike(fv.PRIVATE_KEY_PATTERN), "-----BEGIN PRIVATE KEY-----")),
        rows("cloud_key", F.transform(text.all_matches(t, text.UNICODE + fv.CLOUD_KEY_PATTERN, 1), lambda k: text.redact(k, 4))),
        rows("credential", F.transform(creds, lambda c: F.concat(c["key"], F.lit("=***")))),
        rows("ssh_or_host", once(t.rlike(text.UNICODE + fv.ROOT_HOST_PATTERN), "root@***")),
        rows("ssh_or_host", once(t.rlike(text.UNICODE + fv.SSH_HOST_PATTERN), "ssh ***@***")),
        rows("ip_address", F.transform(ips, lambda ip: F.concat(F.split(ip, r"\.")[0].cast("int").cast("string"), F.lit(".x.x.x")))),
        rows("home_path", F.transform(homes, lambda h: F.when(F.startswith(h, F.lit("/Users/")), "/Users/***/").otherwise("/home/***/"))),
        rows("home_path", F.transform(windows, lambda h: F.lit("C:\\Users\\***\\"))),
    )
    return docs.select("repo", "path", F.explode(F.array_distinct(found)).alias("f")).select("repo", "path", "f.*")


def instruction_features(docs: DataFrame) -> DataFrame:
    """Directives, trade-offs, path references, checks, size and delegation (2.10.4)."""
    t, low = F.col("text"), F.col("_folded")
    slashed = F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\"))
    return docs.withColumn("_folded", text.folded(t)).select(
        *docs.columns,
        text.count_matches(t, low, fv.DIRECTIVE_PATTERNS).alias("directives"),
        text.count_matches(t, low, fv.TRADEOFF_PATTERNS).alias("tradeoffs"),
        F.when(slashed, F.regexp_count(t, F.lit(text.UNICODE + fv.PATH_REFERENCE_PATTERN))).otherwise(0).alias("path_refs"),
        text.count_matches(t, low, fv.VERIFIABLE_PATTERNS).alias("verifiable"),
        text.line_count(t).alias("lines"),
        text.word_count(t).alias("words"),
        text.count_matches(t, low, fv.DELEGATION_PATTERNS).alias("delegations"),
    )


def _penalty(value: Column, steps: list[tuple[int, int]]) -> Column:
    out = F.when(value > steps[0][0], steps[0][1])
    for floor, points in steps[1:]:
        out = out.when(value > floor, points)
    return out.otherwise(0)


def instruction_score(features: DataFrame) -> DataFrame:
    """0-100 score and letter (2.4.34).

    Expects ``freshness_days`` and ``skills_present`` next to the features.
    """
    bloat = F.when(
        F.col("skills_present") | (F.col("delegations") > 0), 0
    ).otherwise(F.greatest(_penalty(F.col("lines"), fv.LINE_PENALTIES), _penalty(F.col("words"), fv.WORD_PENALTIES)))
    stale = F.when(F.col("freshness_days") > 365, 10).when(F.col("freshness_days") > 180, 5).otherwise(0)
    points = (
        F.lit(10)
        + F.least(F.col("directives") * 3, F.lit(30))
        + F.least(F.col("tradeoffs") * 5, F.lit(25))
        + F.least(F.col("path_refs") * 3, F.lit(20))
        + F.least(F.col("verifiable") * 10, F.lit(15))
        - stale
        - bloat
    )
    empty = F.trim("text") == ""
    score = F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.least(points, F.lit(100))))
    graded = features.withColumn("bloat_penalty", bloat).withColumn("score", score.cast("int"))
    return graded.withColumn("grade", F.when(empty, "F").otherwise(scores.letter_grade(F.col("score"))))


def grade_rank(grade: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for item in fv.GRADE_RANK.items() for x in item])[grade], F.lit(0))


def best_grade(graded: DataFrame) -> DataFrame:
    return graded.groupBy("repo").agg(F.max_by("grade", grade_rank(F.col("grade"))).alias("best_grade"))


def detect_alias(docs: DataFrame) -> DataFrame:
    """Short files that only point at a canonical instruction file (2.10.5)."""
    t = F.col("text")
    nonblank = F.size(F.filter(F.split(t, "\n"), lambda l: F.trim(l) != ""))
    target = F.coalesce(
        *[F.when(t.rlike(rf"{text.UNICODE}\b{name.replace('.', chr(92) + '.')}\b"), name) for name in fv.CANONICAL_INSTRUCTIONS]
    )
    short = (nonblank > 0) & (nonblank <= fv.ALIAS_MAX_LINES) & (text.word_count(t) <= fv.ALIAS_MAX_WORDS)
    return docs.withColumn("alias_target", F.when(short, target))


def alias_grade(graded: DataFrame) -> DataFrame:
    """Alias files inherit the grade of their target (2.3.22).

    ``graded(repo, path, grade, score, alias_target)``.
    """
    by_name = graded.groupBy("repo", F.lower(paths.basename(F.col("path"))).alias("_name")).agg(
        F.max_by(F.struct(F.col("path").alias("p"), "grade", "score"), "path").alias("t")
    )
    own = F.lower(paths.basename(F.col("path")))
    rows = graded.withColumn("_name", F.when(F.lower("alias_target") != own, F.lower("alias_target")))
    joined = rows.join(by_name, ["repo", "_name"], "left")
    inherits = F.col("t").isNotNull() & (F.col("t.p") != F.col("path"))
    return joined.select(
        "repo", "path", F.col("_name").isNotNull().alias("is_alias"),
        F.when(inherits, F.col("t.grade")).otherwise(F.col("grade")).alias("grade"),
        F.when(inherits, F.col("t.score")).otherwise(F.col("score")).alias("score"),
    )


def kb_facets(docs: DataFrame) -> DataFrame:
    """Knowledge-base upkeep facets a text documents (2.10.6)."""
    low = F.lower("text")
    facets = F.array_compact(
        F.array(*[F.when(low.rlike(text.UNICODE + "|".join(ps)), F.lit(f)) for f, ps in fv.KB_FACETS.items()])
    )
    cited = low.rlike(text.UNICODE + fv.KB_CITATION)
    return docs.select(
        "repo", "path", F.array_join(facets, ",").alias("facets"), cited.alias("cited"),
        (cited | (F.size(facets) >= 2)).alias("documented"),
    )


def archetype_override(docs: DataFrame) -> DataFrame:
    """First instruction file with a known archetype marker (2.10.7)."""
    names = F.array(*[F.lit(n) for n in fv.ARCHETYPE_INSTRUCTION_FILES])
    alias = F.create_map(*[F.lit(x) for item in fv.ARCHETYPE_ALIASES.items() for x in item])
    marked = docs.select(
        "repo",
        "path",
        F.array_position(names, F.col("path")).alias("ordinal"),
        alias[F.lower(F.regexp_extract("text", fv.ARCHETYPE_MARKER, 1))].alias("override"),
    ).where((F.col("ordinal") > 0) & F.col("override").isNotNull())
    return marked.groupBy("repo").agg(
        F.min_by("override", "ordinal").alias("override"), F.min_by("path", "ordinal").alias("source")
    )


def prose_tells(docs: DataFrame) -> DataFrame:
    """Hits per writing tell, only tells with hits (2.10.16)."""
    hits = F.array(
        *[
            F.struct(F.lit(tell).alias("tell"), F.regexp_count("text", F.lit(pattern)).alias("hits"))
            for tell, pattern in fv.PROSE_TELLS.items()
        ]
    )
    return docs.select("repo", "path", F.explode(F.filter(hits, lambda h: h["hits"] > 0)).alias("h")).select("repo", "path", "h.*")


def prose_verdict(docs: DataFrame) -> DataFrame:
    """Clean, light or heavy by clusters of tells, not single hits."""
    counts = [F.regexp_count("text", F.lit(p)) for p in fv.PROSE_TELLS.values()]
    total = reduce(lambda a, b: a + b, counts)
    kinds = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts])
    scored = docs.select("repo", "path", total.alias("hits"), kinds.alias("tells"))
    verdict = (
        F.when((F.col("hits") >= fv.HEAVY_HITS) & (F.col("tells") >= fv.HEAVY_TELLS), "heavy")
        .when((F.col("hits") >= fv.LIGHT_HITS) & (F.col("tells") >= fv.LIGHT_TELLS), "light")
        .otherwise("clean")
    )
    return scored.withColumn("verdict", verdict)


def directive_clarity(docs: DataFrame) -> DataFrame:
    """Latent-action instructions per line, and whether a failure marker on the
    line or next to it says to keep them as they are (2.10.17).

    A document is split in place, so neighbours are array elements and no
    window over lines is needed.
    """
    lines = docs.select("repo", "path", F.split("text", "\n").alias("lines"))
    rows = lines.select(
        "repo",
        "path",
        F.explode(
            F.transform(
                "lines",
                lambda l, i: F.struct(
                    (i + 1).alias("line_no"),
                    l.alias("line"),
                    F.concat_ws("\n", F.slice("lines", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))).alias("near"),
                ),
            )
        ).alias("l"),
    ).select("repo", "path", "l.*")
    patterns = F.array_compact(
        F.array(*[F.when(F.col("line").rlike(text.UNICODE + p), F.lit(n)) for n, p in fv.DIRECTIVE_PATTERNS_LATENT.items()])
    )
    return rows.select("repo", "path", "line_no", "near", F.explode(patterns).alias("pattern")).select(
        "repo", "path", "line_no", "pattern", F.col("near").rlike(text.UNICODE + fv.FAILURE_MARKERS).alias("preserve")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """Normalised sentences of three words or more."""
    parts = F.split("text", r"[.!?\n]+")
    clean = F.transform(parts, lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))
    return docs.select("repo", "path", F.explode(F.filter(clean, lambda s: s.rlike(r"\S+ \S+ \S+"))).alias("sentence"))


def duplicate_statements(docs: DataFrame) -> DataFrame:
    """Sentences stated more than once, with the place to keep (2.10.18).

    Grouped on a hash with counts and minima only: a sentence repeated by a
    third of all rows still leaves one row per map task.
    """
    said = sentences(docs).select(F.sha2("sentence", 256).alias("sentence_hash"), "path")
    return (
        said.groupBy("sentence_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("keep"))
        .where(F.col("n") > 1)
    )


def instrumentation(files: DataFrame) -> DataFrame:
    """Telemetry libraries in manifests and telemetry configuration files (2.10.8)."""
    name, low = paths.basename(F.col("path")), F.lower("text")
    manifest = name.isin(fv.INSTRUMENTED_MANIFESTS) | name.endswith(".csproj")
    labels = F.array_compact(
        F.array(
            *[F.when(manifest & F.contains(low, F.lit(token)), F.lit(label)) for token, label in fv.INSTRUMENTED_TOKENS.items()],
            F.when(F.lower(name).isin(fv.TELEMETRY_CONFIG_FILES), F.lit("telemetry config present")),
        )
    )
    return files.select("repo", F.explode(labels).alias("signal")).distinct()


def _runbook_name(path: Column) -> Column:
    return paths.stem(path).rlike(fv.RUNBOOK_NAME) | F.exists(F.split(paths.parent(path), "/"), lambda d: d.rlike(fv.RUNBOOK_NAME))


def runbooks(docs: DataFrame) -> DataFrame:
    """Documents named as runbooks, or with two distinct telemetry words (2.10.9)."""
    words = F.array_distinct(
        F.transform(text.all_matches(F.col("text"), text.UNICODE + fv.RUNBOOK_CONTENT, 1), F.lower)
    )
    is_doc = paths.extension(F.col("path")).isin(fv.DOC_EXTENSIONS)
    by_name = _runbook_name(F.col("path"))
    return docs.where(is_doc).withColumn("by_name", by_name).withColumn("words", words).where(
        F.col("by_name") | (F.size("words") >= 2)
    )


def reachability(files: DataFrame) -> DataFrame:
    """Telemetry an agent can reach: servers, skills, runnable queries (2.10.10)."""
    p, t = F.col("path"), F.col("text")
    name = paths.basename(p)
    low_parts = F.transform(paths.parts(p), F.lower)
    skipped = F.arrays_overlap(low_parts, F.array(*[F.lit(d) for d in fv.SKILL_SKIPPED_DIRS]))
    kind = (
        F.when((name == ".mcp.json") & t.rlike(text.UNICODE + fv.TELEMETRY_TOOL), "mcp_server")
        .when(
            (name == "SKILL.md") & ~skipped & F.array_contains(low_parts, "skills")
            & paths.basename(paths.parent(p)).rlike(text.UNICODE + fv.TELEMETRY_TOOL),
            "repo_skill",
        )
    )
    tools = files.select("repo", "path", kind.alias("kind")).where(F.col("kind").isNotNull())
    fenced = F.array_join(text.all_matches(t, fv.FENCED_BODY, 1), "\n")
    runnable = runbooks(files).where(fenced.rlike(text.UNICODE + fv.RUNNABLE_QUERY)).select(
        "repo", "path", F.lit("runbook_query").alias("kind")
    )
    return tools.unionByName(runnable).distinct()


def observability_rung(repos: DataFrame, instrumented: DataFrame, found_runbooks: DataFrame, reachable: DataFrame) -> DataFrame:
    """Ladder 0-3; tools reachable by an agent decide alone (2.4.36)."""
    facts = (
        instrumented.select("repo", F.lit("i").alias("k"))
        .unionByName(found_runbooks.select("repo", F.lit("d").alias("k")))
        .unionByName(reachable.select("repo", F.when(F.col("kind") == "runbook_query", "q").otherwise("t").alias("k")))
    )
    has = facts.groupBy("repo").agg(*[F.bool_or(F.col("k") == k).alias(k) for k in "idqt"])
    rows = repos.select("repo").distinct().join(has, "repo", "left").na.fill(False)
    rung = (
        F.when(F.col("t"), 3)
        .when(F.col("i") & F.col("q"), 3)
        .when(F.col("i") & F.col("d"), 2)
        .when(F.col("i"), 1)
        .otherwise(0)
    )
    return rows.select("repo", rung.alias("rung"))


def mutation_config(files: DataFrame) -> DataFrame:
    """Mutation tools configured, and whether CI runs them (2.10.11)."""
    p, low = F.col("path"), F.lower("text")
    name = paths.basename(p)
    configured = [F.create_map(*[F.lit(x) for item in fv.MUTATION_CONFIG_FILES.items() for x in item])[name]]
    configured += [
        F.when((name == manifest) & F.contains(low, F.lit(token)), F.lit(tool))
        for manifest, token, tool in fv.MUTATION_MANIFEST_TOKENS
    ]
    ci = p.rlike(r"^\.github/workflows/.*\.(?i:ya?ml)$") | p.isin(fv.CI_FILE_NAMES)
    in_ci = [F.when(ci & F.contains(low, F.lit(token)), F.lit(tool)) for token, tool in fv.MUTATION_CI_TOKENS.items()]
    tag = lambda cols, flag: F.transform(F.array_compact(F.array(*cols)), lambda x: F.struct(x.alias("tool"), F.lit(flag).alias("ci")))
    rows = files.select("repo", F.explode(F.concat(tag(configured, False), tag(in_ci, True))).alias("x")).select("repo", "x.*")
    return rows.groupBy("repo").agg(
        F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"), F.bool_or("ci").alias("ci_integrated")
    )


def configured_plugins(files: DataFrame) -> DataFrame:
    """Build plugins that already serve a capability, comments ignored (2.10.12)."""
    low = F.lower(F.regexp_replace("text", r"(?s)<!--.*?-->", " "))
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains(low, F.lit(needle)), F.struct(F.lit(cap).alias("capability"), F.lit(label).alias("label")))
                for needle, cap, label in fv.PLUGIN_CREDITS
            ]
        )
    )
    poms = files.where(paths.basename(F.col("path")) == "pom.xml")
    return poms.select("repo", F.explode(hits).alias("h")).select("repo", "h.*").distinct()


def layer_evidence(files: DataFrame) -> DataFrame:
    """Which files speak for which layer (2.10.13)."""
    rules = []
    for layer, signal, on_path, on_text in fv.LAYER_RULES:
        hit = F.col("path").rlike(on_path)
        if on_text:
            hit = hit & F.col("text").rlike(on_text)
        rules.append(F.when(hit, F.struct(F.lit(layer).alias("layer"), F.lit(signal).alias("signal"))))
    return (
        files.select("repo", F.explode(F.array_compact(F.array(*rules))).alias("r"))
        .groupBy("repo", "r.layer", "r.signal")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def test_inventory(files: DataFrame) -> DataFrame:
    """Test files per language, integration apart (2.4.46)."""
    p = F.col("path")
    language = F.coalesce(*[F.when(paths.basename(p).rlike(rx), lang) for lang, rx in fv.TEST_LANGUAGES])
    tests = files.withColumn("language", language).where(F.col("language").isNotNull())
    return tests.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(p.rlike(fv.INTEGRATION_PATH)).alias("integration")
    )


