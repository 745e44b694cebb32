import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import archetype, snapshots
from tidemark.plans import reports as plan_reports, tables
from tidemark.sources import history, reports, repository, sinks


@pytest.fixture
def landed(tmp_path):
    def write(name, body, repo="one"):
        path = tmp_path / f"repo={repo}" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8", newline="")
        return str(tmp_path)

    return write


def test_commit_log_keeps_empty_commits(spark, rows, landed):
    root = landed("log.txt", "\x1eaaa 10\nx.py\n\ny.py\n\x1ebbb 20\n\x1eccc 30\nx.py\n")
    commits, files = history.commit_log(history.read_records(spark, root))
    assert rows(commits, "repo", "sha", "ts") == [("one", "aaa", 10), ("one", "bbb", 20), ("one", "ccc", 30)]
    assert rows(files, "sha", "path") == [("aaa", "x.py"), ("aaa", "y.py"), ("ccc", "x.py")]


def test_numstat_log_skips_binaries_and_bad_headers(spark, rows, landed):
    root = landed("n.txt", "\x1e10 aaa\n3\t1\tx.py\n-\t-\timg.png\nnoise\n\x1enonsense\n1\t1\tz.py\n")
    out = history.numstat_log(history.read_records(spark, root))
    assert rows(out, "sha", "author_ts", "path", "added", "deleted") == [("aaa", 10, "x.py", 3, 1)]


def test_authored_log_pads_short_headers(spark, rows, landed):
    root = landed("a.txt", "\x1es\x1fAnn\x1fann@x\x1fC\x1fc@x\x1fA <a@x>\x1dB <b@x>\n1\t2\tf\n\x1et\x1fBob\n1\t0\tg")
    out = history.authored_log(history.read_records(spark, root))
    assert rows(out, "sha", "an", "ce", "coauthors", "path") == [("s", "Ann", "c@x", ["A <a@x>", "B <b@x>"], "f"), ("t", "Bob", "", [], "g")]


def test_tracked_listing_restricts_files(spark, rows, landed):
    root = landed("ls", "a.py\x00b c.py\x00")
    tracked = history.tracked_files(history.read_records(spark, root, "\x01"))
    assert rows(tracked, "path") == [("a.py",), ("b c.py",)]
    files = spark.createDataFrame([("one", "a.py"), ("one", "new.py"), ("two", "z.py")], "repo string, path string")
    assert rows(history.only_tracked(files, tracked), "repo", "path") == [("one", "a.py"), ("two", "z.py")]


def test_cobertura(spark, rows, landed):
    xml = '<coverage line-rate="0.75"><packages><package><classes><class filename="a.py" line-rate="0.8"/><class filename="b.py" line-rate="0.5"/><class filename="c.py" line-rate="x"/></classes></package></packages></coverage>'
    root = landed("coverage.xml", xml)
    assert rows(reports.read_cobertura(spark, root), "path", "line_rate") == [("a.py", 0.8), ("b.py", 0.5)]
    assert rows(reports.read_cobertura_overall(spark, root), "repo", "rate") == [("one", 0.75)]


def test_lcov(spark, rows, landed):
    body = "SF:a.py\nLF:10\nLH:8\nend_of_record\nSF:b.py\nLF:10\nLH:2\nSF:z.py\nLF:0\nLH:0\nend_of_record\nSF:tail.py\nLF:4\nLH:1"
    lines = reports.read_lcov(spark, landed("lcov.info", body))
    assert rows(reports.lcov_rates(lines), "path", "line_rate") == [("a.py", 0.8), ("b.py", 0.2), ("tail.py", 0.25)]


def test_mutation_junit(spark, rows, landed):
    xml = """<testsuite><testcase file="calc.py"/><testcase file="calc.py"><failure/></testcase><testcase file="calc.py"><failure message="m">x</failure></testcase>
    <testcase classname="mutmut.pkg.util"/><testcase classname="mutmut.pkg.util"/><testcase classname="other"/></testsuite>"""
    out = reports.read_mutation_junit(spark, landed("junit.xml", xml))
    assert rows(out, "file", "killed", "survived", "total") == [("calc.py", 1, 2, 3), ("pkg/util.py", 2, 0, 2)]


def test_build_log_sections(spark, rows):
    lines = ["[WARNING] Used undeclared dependencies found:", "[WARNING]    g:u:jar:1:compile", "[WARNING] Unused declared dependencies found:", "[WARNING]    g:a:jar:1:compile", "",
             "[WARNING]    g:b:jar:1", "[INFO] done", "g:late:jar:1"]
    df = spark.createDataFrame([("r", "pom.xml", i, t) for i, t in enumerate(lines)], "repo string, log string, line_no long, text string")
    sections = reports.dependency_sections(df, chunk_lines=2)
    assert rows(reports.unused_dependencies(sections), "symbol") == [("g:a",), ("g:b",)]
    assert rows(reports.used_undeclared_count(sections), "used_undeclared") == [(1,)]


def test_files_and_snapshots(spark, rows, landed):
    root = landed("docs/a b.md", "# hi\n")
    assert rows(repository.read_files(spark, root), "repo", "path", "text") == [("one", "docs/a b.md", "# hi\n")]


def test_statistics_documents(spark, rows, tmp_path):
    def stats(hot):
        return {"files_scored": 3, "ccn": {"p50": 1, "p95": 2, "max": 3}, "top_hotspots": hot}

    for run, doc in {
        "1": stats([{"path": "parser", "loc": 10, "ccn": 5, "churn": 3}, {"path": "handler", "loc": 10, "ccn": 5, "commits": 2}, {"path": "helpers", "loc": 9, "ccn": 2, "commits": 1}]),
        "2": stats([{"path": "feature", "loc": 8, "ccn": 7, "commits": 4}, {"path": "handler", "loc": 11, "ccn": 9, "commits": 3}, {"path": "helpers", "loc": 9, "ccn": 2, "commits": 9}]),
    }.items():
        folder = tmp_path / "repo=r" / f"run_id={run}"
        folder.mkdir(parents=True)
        (folder / "stats.json").write_text(json.dumps(doc))
    all_runs = repository.ranked_rows(repository.read_stats(spark, str(tmp_path)), "top_hotspots")
    prior, current = all_runs.where("run_id = '1'"), all_runs.where("run_id = '2'")
    assert rows(prior, "path", "commits")[-1] == ("parser", 3)
    assert rows(snapshots.hotspot_transitions(prior, current), "path", "status", "ccn_delta") == [
        ("feature", "new", 0.0), ("handler", "regressed", 4.0), ("helpers", "persistent", 0.0), ("parser", "graduated", 0.0),
    ]


def test_settings_survive_bad_json(spark, rows):
    data = [("a", '{"permissions": {"allow": ["x", "y"], "deny": "no"}, "hooks": {"Pre": []}, "sandbox": null}'), ("b", "{oops"), ("c", "[1]")]
    df = spark.createDataFrame([(r, ".claude/settings.json", t, r == "a") for r, t in data], "repo string, path string, text string, tracked boolean")
    out = repository.agent_settings(df)
    assert rows(out, "repo", "parse_ok", "allow_count", "deny_count", "hook_events", "sandbox_configured") == [
        ("a", True, 2, 0, 1, True), ("b", False, 0, 0, 0, False), ("c", False, 0, 0, 0, False),
    ]


def test_declines(spark, rows):
    df = spark.createDataFrame(
        [("a", ".assess/.no-mutmut", '{"declined_by": "x", "plugin_version": "1.9"}'), ("b", ".no-scc", ""), ("c", "notes", "")], "repo string, path string, text string"
    )
    out = archetype.decline_reoffer(repository.decline_markers(df), "v2.0.0")
    assert rows(out, "tool", "declined_by", "reoffer", "mutation") == [("mutmut", "x", True, True), ("scc", None, False, False)]


def test_log_rows_chain_and_disclose(spark, rows):
    empty = spark.createDataFrame([], "repo string, log string, n long, text string, stored string")
    add = lambda t: spark.createDataFrame([("r", "l", t)], "repo string, log string, text string")
    first = sinks.new_log_rows(empty, add("one")).collect()
    second = sinks.new_log_rows(spark.createDataFrame(first), add("two")).collect()
    log = spark.createDataFrame(first + second)
    assert rows(snapshots.log_chain_verify(log), "valid", "broken_at") == [(True, None)]
    forged = spark.createDataFrame([first[0], second[0].__class__(**{**second[0].asDict(), "text": "edited"})])
    assert rows(snapshots.log_chain_verify(forged), "valid", "broken_at") == [(False, 2)]
    third = sinks.new_log_rows(forged, add("three")).collect()[0]
    assert third["n"] == 3 and third["text"].startswith("> **Warning:** History integrity broken at entry 2.")


def test_a_later_run_keeps_other_repositories(spark, rows, tmp_path):
    from tidemark.sources import sinks

    path = str(tmp_path / "actions")
    first = spark.createDataFrame([("a", "x"), ("b", "y")], "repo string, action string")
    sinks.write_actions(first, path)
    sinks.write_actions(spark.createDataFrame([("b", "z")], "repo string, action string"), path)
    assert rows(spark.read.parquet(path), "repo", "action") == [("a", "x"), ("b", "z")]
    runs = str(tmp_path / "runs")
    for _ in range(2):
        sinks.write_run(first, "one", runs)
    sinks.write_run(first, "two", runs)
    assert spark.read.parquet(runs).count() == 4


def test_numstat_log_is_rendered_from_one_pass(spark, rows, tmp_path):
    lines = [(1, 1, 1, 5.0, 0.02, None), (1, 1, 2, 4.0, 0.01, None), (2, 2, 1, 3.0, 0.0, None)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp")
    lines.withColumn("l_shipdate", F.timestamp_seconds("l_orderkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(1, "Brand#1", "SMALL", 1), (2, "Brand#2", "PROMO", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    log = plan_reports.scan_numstat_log(tables.Tables(spark, str(tmp_path)))
    assert rows(log, "sha", "author_ts", "path", "added", "deleted") == [("1", 1, "src/brand1/p1.ts", 9, 3), ("2", 2, "src/brand2/p2.rb", 3, 0)]
    assert log._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 2


def test_numstat_cells(spark, rows):
    cells = ["1\t2\ta b\textra", "1\t2", "7", "", "-\t2\tx", "3\t-4\tx", " 5\t6\t", "\t1\tx", "8\t9\tc"]
    raw = spark.createDataFrame([("r", "10 s\r\n" + "\n".join(cells) + "\r\n"), ("r", "no head\n1\t2\tx"), ("r", None), ("r", "  ")], "repo string, value string")
    assert rows(history.numstat_log(raw), "sha", "author_ts", "path", "added", "deleted") == [("s", 10, "", 5, 6), ("s", 10, "a b", 1, 2), ("s", 10, "c", 8, 9)]
