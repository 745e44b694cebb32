"""Queries over landed logs, reports, settings and written results.

The landed texts are rendered from the tables row by row and then read by the
same parsers that read files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import scores
from tidemark.operators import archetype, findings, links, markers, records, snapshots, testing, textscans
from tidemark.plans.catalog import query
from tidemark.plans.docs import SHAPES, shapes
from tidemark.plans.history import r6
from tidemark.plans.signals import AGED, SUMMARY, aged_of, named_of
from tidemark.plans.tables import Tables
from tidemark.sources import history, reports, repository, sinks
from tidemark.staging import stage, staged_path

# --- logs ------------------------------------------------------------------


def commit_records(t: Tables):
    head = F.concat_ws(" ", "sha", "ts")
    touched = t.commit_files.select("repo", F.concat(head, F.lit("\n"), "path", F.lit("\n\n")).alias("value"))
    return touched.unionByName(t.commits.select("repo", head.alias("value")))


@query("scan_commit_log", "SELECT repo, CAST(sha AS VARCHAR) AS sha, ts, path FROM commit_files")
def scan_commit_log(t: Tables):
    return history.commit_log(commit_records(t))[1]


@query("scan_commit_log_commits", "SELECT repo, CAST(sha AS VARCHAR) AS sha, ts FROM commits")
def scan_commit_log_commits(t: Tables):
    return history.commit_log(commit_records(t))[0]


@query("scan_numstat_log", "SELECT repo, CAST(sha AS VARCHAR) AS sha, author_ts, path, added, deleted FROM numstat")
def scan_numstat_log(t: Tables):
    rows = F.concat(F.concat_ws("\t", "added", "deleted", "path"), F.lit("\n-\t-\tlogo.png\nnoise"))
    good = F.concat(F.concat_ws(" ", "author_ts", "sha"), F.lit("\n"), rows)
    bad = F.concat(F.lit("malformed\n"), rows)
    return history.numstat_log(t.numstat.select("repo", F.explode(F.array(good, bad)).alias("value")))


@query(
    "scan_authored_log",
    "SELECT repo, CAST(sha AS VARCHAR) AS sha, an, ae, cn, ce, CASE WHEN coauthor_text = '' THEN 0 ELSE len(string_split(coauthor_text, chr(29))) END AS coauthors, path, added, deleted FROM authored",
)
def scan_authored_log(t: Tables):
    head = F.concat_ws(history.UNIT, "sha", "an", "ae", "cn", "ce", F.when(F.col("coauthor_text") != "", F.col("coauthor_text")))
    raw = t.authored.select("repo", F.concat(head, F.lit("\n"), F.concat_ws("\t", "added", "deleted", "path")).alias("value"))
    parsed = history.authored_log(raw)
    return parsed.withColumn("coauthors", F.size("coauthors"))


@query("scan_tracked_files", "SELECT repo, path FROM tracked")
def scan_tracked_files(t: Tables):
    raw = t.commit_files.select("repo", F.concat("path", F.lit("\x00"), "path", F.lit("\x00")).alias("value"))
    return history.tracked_files(raw)


@query(
    "scan_file_snapshot",
    f"""WITH {SHAPES} SELECT DISTINCT repo, path FROM shapes WHERE starts_with(path, 'src/') AND regexp_matches(path, '\\.(py|ts|go|java|rb|js)$') AND NOT contains(path, '/brand2/') AND NOT regexp_matches(path, '/p1[^/]*$')
        AND (repo = 'repo1' OR NOT ends_with(path, '.min.js'))""",
)
def scan_file_snapshot(t: Tables):
    files = shapes(t).select("repo", "path").distinct()
    listed = files.where("path LIKE 'src/%' AND path NOT LIKE '%.min.js' AND repo <> 'repo1'")
    return repository.scan_files(files, fv.CODE_EXTENSIONS, listed, ["brand2"], ["p1*"], "src")


def stats_documents(t: Tables):
    # ten rows per repository by construction
    row = F.struct("path", F.col("commits").alias("churn"), F.lit(1.5).alias("ccn"))
    per_repo = t.hot_s.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rank", row.alias("r")))).alias("rows"))
    doc = F.struct("repo", F.lit("run-1").alias("run_id"), F.lit(7).alias("files_scored"), F.transform("rows", lambda x: x["r"]).alias("top_hotspots"))
    return per_repo.select(F.to_json(doc).alias("json"))


@query("scan_stats_snapshot", "SELECT repo, 'run-1' AS run_id, rank, path, CAST(NULL AS BIGINT) AS loc, 1.5::DOUBLE AS ccn, commits FROM hot_s")
def scan_stats_snapshot(t: Tables):
    return repository.ranked_rows(repository.parse_stats(stats_documents(t)), "top_hotspots")


# --- reports ---------------------------------------------------------------


@query("scan_coverage_cobertura", "SELECT repo, path, line_rate FROM coverage WHERE line_rate >= 0.05")
def scan_coverage_cobertura(t: Tables):
    rate = F.when(F.col("line_rate") < 0.05, "n/a").otherwise(F.col("line_rate").cast("string"))
    xml = t.coverage.select(
        "repo", F.concat(F.lit('<class name="x" filename="'), "path", F.lit('" line-rate="'), rate, F.lit('"><lines/></class>')).alias("xml")
    )
    return reports.cobertura_fragments(xml)


def lcov_records(t: Tables):
    body = F.concat(F.lit("TN:\nSF:"), "file", F.lit("\nDA:1,1\nLF:"), "total", F.lit("\nLH:"), "killed", F.lit("\nSF:zero.py\nLF:0\nLH:0\n"))
    return t.mutation.select("repo", body.alias("value"))


@query("scan_coverage_lcov", "SELECT repo, file AS path, round(CAST(killed AS DOUBLE) / total, 6) AS line_rate FROM mutation")
def scan_coverage_lcov(t: Tables):
    return reports.lcov_rates(reports.lcov_lines(lcov_records(t))).select("repo", "path", r6("line_rate"))


@query("lcov_overall", "SELECT repo, round(CAST(sum(killed) AS DOUBLE) / sum(total), 6) AS rate FROM mutation GROUP BY repo")
def lcov_overall(t: Tables):
    return testing.coverage_overall(reports.lcov_lines(lcov_records(t))).select("repo", r6("rate"))


@query(
    "coverage_location",
    "SELECT c_name AS repo, CASE WHEN c_nationkey % 2 = 0 THEN 'coverage/coverage.xml' ELSE 'lcov.info' END AS source, CASE WHEN c_nationkey % 2 = 0 THEN 'cobertura' ELSE 'lcov' END AS format FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey % 3 <> 0",
)
def coverage_location(t: Tables):
    found = F.array_compact(
        F.array(
            F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'coverage/coverage.xml' END"),
            F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 'lcov.info' END"), F.lit("other.txt"),
        )
    )
    return reports.first_coverage_location(t.customer.select(F.col("c_name").alias("repo"), F.explode(found).alias("path")))


@query(
    "scan_mutation_reports",
    """SELECT repo, 'stryker' AS tool, file, killed, survived, total FROM mutation UNION ALL SELECT repo, 'gremlins', replace(file, '.py', '.go'), killed, survived, total FROM mutation
       UNION ALL SELECT repo, 'cargo-mutants', replace(file, '.py', '.rs'), killed, survived, total FROM mutation UNION ALL SELECT repo, 'mutmut', file, NULL, survived, NULL FROM mutation WHERE survived > 0
       UNION ALL SELECT repo, 'mutmut', file, killed, survived, total FROM mutation""",
)
def scan_mutation_reports(t: Tables):
    dead = F.col("status") == "killed"
    stryker = t.mutants.select(
        "repo",
        F.concat(F.lit('{"files":{"'), "file", F.lit('":{"mutants":[{"status":"'), F.when(dead, "Timeout").otherwise("NoCoverage"), F.lit('"},{"status":"Ignored"}]}}}')).alias("json"),
    )
    line = lambda killed, lived, ext: t.mutants.select(
        "repo", F.concat(F.when(dead, killed).otherwise(lived), F.lit("  replaced at "), F.replace("file", F.lit(".py"), F.lit(ext)), F.lit(":12:3 in f")).alias("text")
    )
    mutmut = t.mutants.select("repo", F.when(~dead, F.concat("file", F.lit(":7: survived"))).otherwise("done").alias("text"))
    dotted = F.replace(F.regexp_replace("file", r"\.py$", ""), F.lit("/"), F.lit("."))
    cases = t.mutants.select("repo", F.lit("").alias("file"), F.concat(F.lit("mutmut."), dotted).alias("classname"), (~dead).alias("failed"))
    return reports.mutation_reports(
        reports.mutation_stryker(stryker),
        reports.mutation_lines(line("KILLED", "LIVED", ".go"), "gremlins"),
        reports.mutation_lines(line("CAUGHT", "MISSED", ".rs"), "cargo-mutants"),
        reports.mutation_mutmut(mutmut),
        reports.mutation_junit(cases),
    )


def tool_lines(t: Tables):
    n = F.col("file_id").cast("string")
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    rows = F.array(
        F.struct(F.lit("vulture").alias("tool"), c("lib/s", n, ".py:", n, ": unused function 'f", n, "' (60% confidence)").alias("text")),
        F.struct(F.lit("vulture").alias("tool"), c("node_modules/s", n, ".py:3: unused import 'x'").alias("text")),
        F.struct(F.lit("ts-prune").alias("tool"), c("src/s", n, ".ts:4 - helper", n).alias("text")),
        F.struct(F.lit("ts-prune").alias("tool"), c("src/s", n, ".ts:5 - inner (used in module)").alias("text")),
        F.struct(F.lit("staticcheck").alias("tool"), c("s", n, ".go:6:1: func g", n, " is unused (U1000)").alias("text")),
        F.struct(F.lit("deadcode").alias("tool"), c("s", n, ".go:7:1: unreachable func: h", n).alias("text")),
        F.struct(F.lit("deadcode").alias("tool"), F.lit("no findings here").alias("text")),
    )
    return t.pages_of_repo.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


DEAD = """SELECT repo, 'vulture' AS tool, concat('lib/s', file_id, '.py') AS path, CAST(file_id AS INT) AS line, 'unused function' AS kind, concat('f', file_id) AS symbol FROM pages_of_repo
    UNION ALL SELECT repo, 'ts-prune', concat('src/s', file_id, '.ts'), 4, 'unused export', concat('helper', file_id) FROM pages_of_repo
    UNION ALL SELECT repo, 'staticcheck', concat('s', file_id, '.go'), 6, 'unused', concat('func g', file_id, ' is unused (U1000)') FROM pages_of_repo
    UNION ALL SELECT repo, 'deadcode', concat('s', file_id, '.go'), 7, 'unreachable', concat('unreachable func: h', file_id) FROM pages_of_repo"""


@query("scan_dead_code_reports", DEAD)
def scan_dead_code_reports(t: Tables):
    return reports.dead_code_lines(tool_lines(t))


@query("tool_parser_registry", f"SELECT tool, kind, count(*) AS n FROM ({DEAD}) GROUP BY tool, kind")
def tool_parser_registry(t: Tables):
    return reports.dead_code_lines(tool_lines(t)).groupBy("tool", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_dead_code_knip",
    """SELECT repo, 'knip' AS tool, concat('web/u', file_id, '.ts') AS path, 0 AS line, 'unused file' AS kind, '(file)' AS symbol FROM pages_of_repo
       UNION ALL SELECT repo, 'knip', concat('web/s', file_id, '.ts'), 0, 'unused export', x FROM pages_of_repo, (SELECT unnest(['a', 'b']) AS x)""",
)
def scan_dead_code_knip(t: Tables):
    n = F.col("file_id").cast("string")
    doc = F.concat(
        F.lit('{"files":["web/u'), n, F.lit('.ts","dist/z.js"],"issues":[{"file":"web/s'), n, F.lit('.ts","exports":[{"name":"a"},{"name":"b"}]}]}')
    )
    return reports.dead_code_knip(t.pages_of_repo.select("repo", doc.alias("json")))


DEPS = """ev AS (SELECT *, CASE WHEN line_no = 1 THEN 'undeclared' WHEN line_no = 3 THEN 'unused' WHEN line_no = 6 AND q % 2 = 0 THEN 'closed' END AS event, line_no IN (2, 4) OR line_no > 6 OR line_no = 6 AND q % 2 = 1 AS dep FROM build_lines),
    sec AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY repo, log ORDER BY line_no) AS section FROM ev)"""


@query(
    "scan_dependency_analyze",
    f"WITH {DEPS} SELECT repo, log, line_no, section, CASE WHEN line_no = 2 THEN concat('org.a:lib', q) WHEN line_no = 4 THEN concat('org.b:tool-', q) WHEN line_no = 6 THEN concat('org.c:x', q) ELSE concat('org.d:y', q) END AS symbol FROM sec WHERE dep",
)
def scan_dependency_analyze(t: Tables):
    return reports.dependency_sections(t.build_lines, chunk_lines=3)


@query(
    "dead_code_union",
    f"WITH {DEPS} {DEAD} UNION ALL SELECT repo, 'dependency-analyze', CAST(log AS VARCHAR), 0, 'unused declared dependency', CASE WHEN line_no = 4 THEN concat('org.b:tool-', q) WHEN line_no = 6 THEN concat('org.c:x', q) ELSE concat('org.d:y', q) END FROM sec WHERE dep AND section = 'unused'",
)
def dead_code_union(t: Tables):
    unused = reports.unused_dependencies(reports.dependency_sections(t.build_lines))
    return reports.dead_code_union(reports.dead_code_lines(tool_lines(t)), unused.withColumn("path", F.col("path").cast("string")))


@query("used_undeclared_count", f"WITH {DEPS} SELECT repo, count(*) FILTER (section = 'undeclared') AS used_undeclared FROM sec WHERE dep GROUP BY repo")
def used_undeclared_count(t: Tables):
    return reports.used_undeclared_count(reports.dependency_sections(t.build_lines))


# --- files and settings ----------------------------------------------------


@query(
    "scan_codeowners",
    "SELECT DISTINCT repo, pattern, CASE WHEN repo IN ('repo0', 'repo1') THEN '.github/CODEOWNERS' ELSE 'CODEOWNERS' END AS declared_in FROM ownership_rules",
)
def scan_codeowners(t: Tables):
    place = F.when(F.col("repo").isin("repo0", "repo1"), ".github/CODEOWNERS").otherwise("CODEOWNERS")
    rules = t.ownership_rules.select("repo", place.alias("path"), F.concat(F.lit("  "), "pattern", F.lit("   @team @other")).alias("text"))
    noise = t.ownership_rules.select("repo", place.alias("path"), F.lit("# comment").alias("text"))
    other = t.ownership_rules.select("repo", F.lit("docs/CODEOWNERS").alias("path"), F.lit("late @x").alias("text"))
    return repository.codeowners(rules.unionByName(noise).unionByName(other))


@query("scan_repo_state_fragments", "SELECT * FROM repo_state")
def scan_repo_state_fragments(t: Tables):
    return repository.parse_repo_state(t.repo_state.select(F.to_json(F.struct("*")).alias("json")))


def settings_files(t: Tables):
    body = F.expr(
        """CASE WHEN c_custkey % 10 = 0 THEN '{oops' WHEN c_custkey % 10 = 1 THEN '[1, 2]'
           ELSE concat('{"permissions": {"allow": [', CASE WHEN c_nationkey % 3 = 0 THEN '"a", "b"' ELSE '' END, '], "deny": ["x"], "ask": 5}',
                CASE WHEN c_nationkey % 2 = 0 THEN ', "hooks": {"Pre": [], "Post": []}' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN ', "sandbox": null' ELSE '' END, '}') END"""
    )
    return t.customer.select(
        F.col("c_name").alias("repo"), F.lit(".claude/settings.json").alias("path"), body.alias("text"), (F.col("c_acctbal") > 0).alias("tracked"), "c_custkey", "c_nationkey"
    )


SETTINGS = """settings AS (SELECT c_name AS repo, '.claude/settings.json' AS path, c_acctbal > 0 AS tracked, c_custkey % 10 > 1 AS parse_ok, CASE WHEN c_custkey % 10 > 1 AND c_nationkey % 3 = 0 THEN 2 ELSE 0 END AS allow_count,
        CASE WHEN c_custkey % 10 > 1 THEN 1 ELSE 0 END AS deny_count, 0 AS ask_count, CASE WHEN c_custkey % 10 > 1 AND c_nationkey % 2 = 0 THEN 2 ELSE 0 END AS hook_events, c_custkey % 10 > 1 AND c_custkey % 4 = 0 AS sandbox_configured FROM customer)"""


@query("scan_agent_settings", f"WITH {SETTINGS} SELECT * FROM settings")
def scan_agent_settings(t: Tables):
    return repository.agent_settings(settings_files(t).select("repo", "path", "text", "tracked"))


@query(
    "agent_ops_summary",
    f"""WITH {SETTINGS}, f AS (SELECT c_name AS repo, c_mktsegment AS seg, c_custkey % 3 <> 0 AS tracked FROM customer)
    SELECT s.repo, tracked_s AND allow_count + deny_count > 0 AS permissions_encoded, tracked_s AND hook_events > 0 OR f.tracked AND seg = 'BUILDING' AS hooks_present, f.tracked AND seg IN ('MACHINERY', 'FURNITURE') AS routines_present
    FROM (SELECT *, tracked AS tracked_s FROM settings) s JOIN f USING (repo)""",
)
def agent_ops_summary(t: Tables):
    place = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN '.claude/hooks/pre.sh' WHEN 'MACHINERY' THEN '.claude/workflows/a.md' WHEN 'FURNITURE' THEN '.claude/routines/b.md' ELSE '.claude/hooks/.hidden' END"
    )
    files = t.customer.select(F.col("c_name").alias("repo"), place.alias("path"), (F.col("c_custkey") % 3 != 0).alias("tracked"))
    return archetype.agent_ops_summary(scan_agent_settings(t), files)


DECLINES = """dec AS (SELECT s_name AS repo, CASE s_suppkey % 3 WHEN 0 THEN 'mutmut' WHEN 1 THEN 'scc' ELSE 'vulture' END AS tool, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS declined_by, CASE WHEN s_suppkey % 4 <> 0 THEN concat('v', s_nationkey % 4, '.2.0') END AS version FROM supplier)"""


def decline_files(t: Tables):
    body = F.expr(
        "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('{\"declined_by\": \"', s_name, '\", \"declined_at\": \"\", \"plugin_version\": \"v', s_nationkey % 4, '.2.0\"}') END"
    )
    place = F.expr("concat('.no-', CASE s_suppkey % 3 WHEN 0 THEN 'mutmut' WHEN 1 THEN 'scc' ELSE 'vulture' END)")
    return t.supplier.select(F.col("s_name").alias("repo"), place.alias("path"), body.alias("text"))


@query("scan_decline_markers", f"WITH {DECLINES} SELECT repo, tool, declined_by, version FROM dec")
def scan_decline_markers(t: Tables):
    return repository.decline_markers(decline_files(t)).select("repo", "tool", "declined_by", "version")


@query(
    "decline_reoffer",
    f"WITH {DECLINES} SELECT repo, tool, version, coalesce(CAST(version[2] AS INT) < 2, false) AS reoffer, coalesce(CAST(version[2] AS INT) < 2, false) AND tool = 'mutmut' AS mutation FROM dec",
)
def decline_reoffer(t: Tables):
    out = archetype.decline_reoffer(repository.decline_markers(decline_files(t)), "2.0.1")
    return out.select("repo", "tool", "version", "reoffer", "mutation")


VERSIONS = "ver AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('v', c_nationkey, '.', c_custkey % 7, '.3-rc1') WHEN 1 THEN concat(' ', c_nationkey, '.1.2') WHEN 2 THEN concat(c_nationkey, '.5') ELSE 'unknown' END AS version FROM customer)"


@query(
    "parse_semver",
    f"""WITH {VERSIONS} SELECT c_custkey, version, CASE WHEN c_custkey % 4 < 2 THEN CAST(regexp_extract(version, '(\\d+)\\.(\\d+)\\.(\\d+)', 1) AS INT) END AS major, CASE WHEN c_custkey % 4 < 2 THEN CAST(regexp_extract(version, '(\\d+)\\.(\\d+)\\.(\\d+)', 2) AS INT) END AS minor,
        CASE WHEN c_custkey % 4 < 3 THEN CAST(regexp_extract(version, '(\\d+)', 1) AS INT) END AS loose_major FROM ver""",
)
def parse_semver(t: Tables):
    version = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN concat('v', c_nationkey, '.', c_custkey % 7, '.3-rc1') WHEN 1 THEN concat(' ', c_nationkey, '.1.2') WHEN 2 THEN concat(c_nationkey, '.5') ELSE 'unknown' END"
    )
    rows = t.customer.select("c_custkey", version.alias("version"))
    parsed = scores.semver(F.col("version"))
    return rows.select(
        "c_custkey", "version", parsed["major"].alias("major"), parsed["minor"].alias("minor"), scores.major_version(F.col("version")).alias("loose_major")
    )


@query("metric_format", "SELECT s_suppkey, CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END AS shown FROM supplier")
def metric_format(t: Tables):
    return t.supplier.select("s_suppkey", scores.metric_format(F.col("s_acctbal")).alias("shown"))


@query(
    "test_name_builders",
    """SELECT repo, path, array_to_string([s || '_test' || x, s || '.test' || x, s || '.spec' || x, s || '_spec' || x, 'test_' || s || x, s || 'Test' || x, s || 'Tests' || x], ' ') AS names
       FROM (SELECT repo, path, 'p' || file_id AS s, regexp_extract(path, '\\.[^.]+$') AS x FROM files_p)""",
)
def test_name_builders(t: Tables):
    return t.files_p.select("repo", "path", F.array_join(testing.test_names(F.col("path")), " ").alias("names"))


@query(
    "pluggable_frontmatter",
    """SELECT repo, path, unnest(['title', 'status', 'source', 'generated_by']) AS key, unnest([concat('Note ', doc_id), lang, CASE n_chars % 3 WHEN 0 THEN concat('r0/x', doc_id, '.py # gen') WHEN 1 THEN '[a.py, "b.py"]' END, concat('tool-', lang)]) AS value
       FROM (SELECT source AS repo, concat('notes/', source, '/d', doc_id, '.md') AS path, * FROM documents)""",
)
def pluggable_frontmatter(t: Tables):
    table = links.frontmatter_table(t.frontmatter_docs)
    lists = t.frontmatter_docs.where(F.col("text").contains("source:\n")).select("repo", "path", F.lit("source").alias("key"), F.lit(None).cast("string").alias("value"))
    return table.unionByName(lists)


@query(
    "archetype_signals",
    """WITH f AS (SELECT repo, count(*) FILTER (path = 'src/x.py') AS code, count(*) FILTER (ends_with(path, '.md')) AS doc, count(*) FILTER (NOT ends_with(path, '.md') AND path NOT IN ('src/x.py', 'node_modules/x.js')) AS other, bool_or(path = 'app.csproj') AS runtime FROM kb_files GROUP BY repo),
    o AS (SELECT repo, CASE c_custkey % 5 WHEN 0 THEN 'knowledge-base' ELSE 'software' END AS override, path AS source FROM manual_docs WHERE c_custkey % 5 < 2 AND path <> 'notes.md'),
    g AS (SELECT f.*, o.override, o.source, CASE WHEN doc >= 3 AND code / (code + doc) <= 0.1 AND NOT runtime THEN 'knowledge-base' ELSE 'software' END AS guess FROM f LEFT JOIN o USING (repo))
    SELECT repo, code, doc, other, runtime, round(code / (code + doc), 6) AS code_ratio, coalesce(override, guess) AS archetype, CASE WHEN override IS NULL THEN 'heuristic' ELSE 'override' END AS detected_via, coalesce(override <> guess, false) AS contradicts, source,
        CASE coalesce(override, guess) WHEN 'knowledge-base' THEN 3 ELSE 8 END AS denominator FROM g""",
)
def archetype_signals(t: Tables):
    out = archetype.archetype(t.kb_files, textscans.archetype_override(t.manual_docs))
    return out.withColumn("code_ratio", F.round("code_ratio", 6))


@query(
    "override_contradicts_signals",
    """WITH f AS (SELECT repo, count(*) FILTER (path = 'src/x.py') AS code, count(*) FILTER (ends_with(path, '.md')) AS doc, bool_or(path = 'app.csproj') AS runtime FROM kb_files GROUP BY repo)
    SELECT repo, path FROM manual_docs JOIN f USING (repo) WHERE c_custkey % 5 < 2 AND path <> 'notes.md' AND (c_custkey % 5 = 0) <> (doc >= 3 AND code / (code + doc) <= 0.1 AND NOT runtime)""",
)
def override_contradicts_signals(t: Tables):
    return archetype.contradictions(archetype.archetype(t.kb_files, textscans.archetype_override(t.manual_docs)))


@query(
    "jvm_capability_state",
    """WITH j AS (SELECT *, unnest(['liveness', 'module_graph', 'linting', 'modernization']) AS capability FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT c_name AS repo, capability, CASE WHEN capability = 'liveness' THEN CASE WHEN c_acctbal > 5000 THEN 'served' ELSE 'offer' END WHEN capability = 'linting' AND c_nationkey % 3 = 0 OR capability = 'modernization' AND c_nationkey % 3 = 1 THEN 'credited' ELSE 'honest_degrade' END AS state,
        CASE WHEN capability = 'linting' AND c_nationkey % 3 = 0 THEN 'Checkstyle' WHEN capability = 'modernization' AND c_nationkey % 3 = 1 THEN 'OpenRewrite' ELSE '' END AS served_by FROM j""",
)
def jvm_capability_state(t: Tables):
    analyzed = t.customer.where("c_acctbal > 5000").select(F.col("c_name").alias("repo"))
    return archetype.jvm_capabilities(t.repo_files, textscans.configured_plugins(t.repo_files), analyzed)


# --- written results -------------------------------------------------------


@query("sink_run_context", "SELECT DISTINCT repo, '20010806-r1' AS run_id, name, path, '1.0.0' AS schema_version FROM findings_t")
def sink_run_context(t: Tables):
    path = staged_path(t.spark, "runs")
    sinks.write_run(t.findings_t.distinct(), "20010806-r1", path)
    return t.spark.read.parquet(path).select("repo", "run_id", "name", "path", "schema_version")


LOG = """st AS (SELECT repo, log, max(n) AS last_n, max(n) FILTER (stored IS NOT NULL) AS stamped_n, arg_max(stored, n) FILTER (stored IS NOT NULL) AS previous, min(n) FILTER (stored = 'deadbeefdeadbeef') AS broken_at FROM log_entries GROUP BY repo, log),
    tail AS (SELECT e.repo, e.log, string_agg(text, '' ORDER BY n) AS tail FROM log_entries e JOIN st ON st.repo = e.repo AND st.log = e.log WHERE e.n > coalesce(st.stamped_n, 0) GROUP BY e.repo, e.log),
    nw AS (SELECT st.*, coalesce(tail, '') AS tail, CASE WHEN broken_at IS NULL THEN '' ELSE concat('> **Warning:** History integrity broken at entry ', broken_at, '.', chr(10), chr(10)) END || 'run done' AS text FROM st LEFT JOIN tail ON tail.repo = st.repo AND tail.log = st.log)"""


def shared_log(t: Tables):
    return stage(t.log_entries, "log")


@query("sink_run_log", f"WITH {LOG} SELECT repo, log, last_n + 1 AS n, text, left(sha256(coalesce(previous, 'genesis') || tail || text), 16) AS stored FROM nw")
def sink_run_log(t: Tables):
    path = staged_path(t.spark, "run-log")
    entries = shared_log(t)
    sinks.append_log(entries, entries.select("repo", "log", F.lit("run done").alias("text")).distinct(), path)
    return t.spark.read.parquet(path).select("repo", "log", "n", "text", "stored")


@query("log_chain_verify", f"WITH {LOG} SELECT repo, log, broken_at IS NULL AS valid, broken_at FROM st")
def log_chain_verify(t: Tables):
    return snapshots.log_chain_verify(shared_log(t))


@query(
    "sink_badge_rows",
    f"""WITH {SUMMARY}, {AGED}, x AS (SELECT repo, count(*) FILTER (stale) AS s FROM aged GROUP BY repo) SELECT summ.repo, concern_kinds || ' findings · ' || s || ' stale markers' AS message,
        CASE WHEN concern_kinds = 0 AND s = 0 THEN 'green' WHEN concern_kinds <= 2 THEN 'yellow' ELSE 'orange' END AS color FROM summ JOIN x USING (repo)""",
)
def sink_badge_rows(t: Tables):
    path = staged_path(t.spark, "badges")
    sinks.write_badges(sinks.badge_rows(findings.keyhole_summary(named_of(t)), markers.totals(aged_of(t))), path)
    return t.spark.read.schema("repo string, message string, color string").json(path)


def action_rows(t: Tables):
    return t.hot_s.select(
        "repo", "rank", F.concat(F.lit("fix "), "path").alias("action"), F.when(F.col("rank") < 10, "tests pass").alias("done_when"),
        F.lit("src").alias("scope_fence"), F.expr("CASE WHEN rank % 2 = 0 THEN 'lying_map' END").alias("finding"),
    )


def prior_actions(t: Tables):
    status = F.expr("CASE rank % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'claimed' ELSE 'weird' END")
    old = t.hot_s.where("rank < 8").select(
        "repo", F.concat(F.lit("fix "), "path").alias("action"), F.lit(2).alias("run"), status.alias("status"),
        F.concat(F.lit("u"), "rank").alias("claimed_by"), F.lit(None).cast("string").alias("completed_sha"),
    )
    return old.unionByName(old.withColumn("run", F.lit(1)).withColumn("status", F.lit("reopened")))


ACTIONS = """act AS (SELECT repo, rank, concat('fix ', path) AS action, 'tests pass' AS done_when, 'src' AS scope_fence, CASE WHEN rank < 8 THEN CASE rank % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'claimed' ELSE 'pending' END ELSE 'pending' END AS status,
        CASE WHEN rank < 8 THEN concat('u', rank) END AS claimed_by, CASE WHEN rank % 2 = 0 THEN 'verify_then_retire' ELSE 'characterize_first' END AS mode FROM hot_s WHERE rank < 10)"""


@query("action_status_join", f"WITH {ACTIONS} SELECT * FROM act")
def action_status_join(t: Tables):
    return records.carry_status(action_rows(t), prior_actions(t)).drop("completed_sha")


@query("sink_actions_contract", f"WITH {ACTIONS} SELECT repo, rank, action, status, claimed_by, mode FROM act")
def sink_actions_contract(t: Tables):
    path = staged_path(t.spark, "actions")
    sinks.write_actions(records.carry_status(action_rows(t), prior_actions(t)), path)
    return t.spark.read.parquet(path).select("repo", "rank", "action", "status", "claimed_by", "mode")


@query("actions_by_rank", f"WITH {ACTIONS} SELECT repo, rank, action, row_number() OVER (PARTITION BY repo ORDER BY rank, action) AS position FROM act QUALIFY position <= 3")
def actions_by_rank(t: Tables):
    return records.actions_by_rank(records.carry_status(action_rows(t), prior_actions(t))).select("repo", "rank", "action", "position")


@query("major", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_nationkey END AS major FROM customer")
def major(t: Tables):
    version = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('V', c_nationkey, '.1') WHEN 1 THEN concat(' ', c_nationkey) ELSE 'none.1' END")
    return t.customer.select("c_custkey", scores.major_version(version).alias("major"))
