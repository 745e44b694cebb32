"""Steps that are made once, whatever reads them."""

import re

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import documents, graph, markers
from tidemark.plans import tables


def counted(spark, df, column):
    """``df`` whose rows count when they are made."""
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(passed, df.schema[column].dataType)(column)), seen


def test_rounds_of_communities_read_written_picks(spark, monkeypatch):
    joins, stage = [], graph.stage

    def seen(df, name):
        joins.append(len(re.findall(r"Join ", df._jdf.queryExecution().optimizedPlan().toString())))
        return stage(df, name)

    monkeypatch.setattr(graph, "stage", seen)
    links = [(a, b) for a in "abcd" for b in "abcd" if a < b] + [(a, b) for a in "wxyz" for b in "wxyz" if a < b] + [("d", "w")]
    nodes = spark.createDataFrame([(r, n) for r in ("r", "s") for n in "abcdwxyz"] + [("r", "lone"), (None, "a"), ("r", "a")], "repo string, node string")
    edges = spark.createDataFrame([(r, a, b) for r in ("r", "s") for a, b in links] + [(None, "a", "b"), ("r", None, "b"), ("r", "a", "a")], "repo string, src string, dst string")
    part = graph.communities(nodes, edges).collect()
    assert len(part) == 19
    found = {(r.repo, r.node): r.community for r in part}
    assert found[None, "a"] == "a" and found["r", "lone"] == "lone"
    for repo in ("r", "s"):
        assert len({found[repo, n] for n in "abcd"}) == len({found[repo, n] for n in "wxyz"}) == 1 and found[repo, "a"] != found[repo, "w"]
    assert max(joins) <= 3


def test_ranks_of_names_outside_and_missing(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", None), ("q", "x")], "repo string, node string")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "b", None), ("r", "a", "out"), ("r", None, "a")], "repo string, src string, dst string")
    got = {(r.repo, r.node): r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert set(got) == {("r", "a"), ("r", "b"), ("r", None), ("r", "out"), ("q", "x")}
    assert got["q", "x"] == 1.0 and got["r", "out"] is None and abs(got["r", "a"] - got["r", "b"]) < 1e-3


def test_staleness_counts_churn_once(spark):
    code = spark.createDataFrame([("r", f"d/f{i}") for i in range(9)], "repo string, path string")
    churn, seen = counted(spark, code.withColumn("commits", F.lit(3).cast("long")).localCheckpoint(), "commits")
    docs = spark.createDataFrame([("r", "d/README.md"), ("r", "x.md"), ("r", "docs/d.md")], "repo string, path string")
    edges = spark.createDataFrame([("r", "x.md", "d/f1")], "repo string, doc string, code string")
    out = {r.doc: (r.method, r.code_churn) for r in documents.staleness(docs, code, churn, edges).collect()}
    assert out == {"d/README.md": ("nearest-ancestor", 27), "x.md": ("explicit-links", 3), "docs/d.md": ("parallel-docs-tree", 27)}
    assert seen.value == 9


TOUCHES = [("r", "f", 10), ("r", "f", 20), ("r", "f", 20), ("r", "f", 90_000), ("r", "g", 5), ("r", "f", None)]


def test_survived_touches_counts_commits_once(spark, rows, monkeypatch):
    times, seen = counted(spark, spark.createDataFrame(TOUCHES, "repo string, path string, ts long").localCheckpoint(), "ts")
    intros = spark.createDataFrame([("r", "f", 20), ("r", "f", 20), ("r", "f", 1), ("r", "g", 5), ("r", "h", 7), ("r", "f", None), (None, "f", 1)], "repo string, path string, intro_ts long")
    want = [("f", 1, 4), ("f", 20, 1), ("g", 5, 0), ("h", 7, 0)]
    assert rows(markers.survived_touches(intros, times), "path", "intro_ts", "survived") == want
    assert seen.value == len(TOUCHES)
    monkeypatch.setattr(markers, "has_hot", lambda *_: True)
    assert rows(markers.survived_touches(intros, times), "path", "intro_ts", "survived") == want


def test_age_counts_commits_once(spark, rows, monkeypatch):
    times, seen = counted(spark, spark.createDataFrame(TOUCHES, "repo string, path string, ts long").localCheckpoint(), "ts")
    marks = [("r", "f", 1, "todo", "t", False, 7, 10), ("r", "f", 2, "todo", "t", False, 7, None), ("r", "g", 1, "todo", "t", True, 8, 4)]
    marks = spark.createDataFrame(marks, "repo string, path string, line_no long, family string, text string, linked boolean, sha long, intro_ts long")
    people = spark.createDataFrame([("r", 7, "A", "a@example.com", "")], "repo string, sha long, an string, ae string, coauthor_text string")
    want = [("f", 1, 4), ("f", 2, None), ("g", 1, 1)]
    assert rows(markers.age(marks, times, people), "path", "line_no", "survived") == want
    assert seen.value == len(TOUCHES)
    monkeypatch.setattr(markers, "has_hot", lambda *_: True)
    assert rows(markers.age(marks, times, people), "path", "line_no", "survived") == want


def test_every_marker_holds_a_literal(spark, rows):
    texts = [
        "# TODO", "# FIXME x", "# HACK", "# XXX", "# TBD", "# remove after x", "# temporary fix", "@Deprecated", "// @deprecated", "// DEPRECATED", "# noqa", "# type: ignore",
        "// eslint-disable", "// nolint", "@SuppressWarnings", "# nosec", "# rubocop:disable", "# pylint: disable", "// @ts-ignore", "// @ts-nocheck", "// NOSONAR", "// ignore:", "// ignore_for_file:",
        "@pytest.mark.skip", "@unittest.skip", "xfail", "it.skip(", "xdescribe.skip(", "t.Skip(", "@Disabled", "@Ignore", "skip: true", "skip:'",
    ]
    families = {x: [f for f, p in fv.MARKER_FAMILIES.items() if re.search(p, x)] for x in texts}
    assert all(families.values())
    assert all(any(lit in x for lit in fv.MARKER_LITERALS[f]) for x, fs in families.items() for f in fs)
    lines = spark.createDataFrame([("r", "a.md" if x.startswith("# ") and "noqa" not in x else "a.py", i, x) for i, x in enumerate(texts)] + [("r", "vendor/a.py", 99, "# TODO")], "repo string, path string, line_no long, text string")
    assert "# TODO" in {t for (t,) in rows(markers.scan(lines), "text")} and 99 not in {n for (n,) in rows(markers.scan(lines), "line_no")}


def test_tracked_files_are_written_once(spark, rows, tmp_path):
    given = {
        "nation": ([(1, 0), (2, 1)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(1, 1), (2, 2), (None, 1), (3, None)], "s_suppkey long, s_nationkey int"),
        "orders": ([(3, 0), (4, 1), (4, 1), (None, 2)], "o_orderkey long, days int"),
        "lineitem": ([(3, 1), (3, 1), (3, 2), (4, 2), (None, 1), (4, None), (9, 1), (4, 3)], "l_orderkey long, l_suppkey long"),
    }
    for name, (of, schema) in given.items():
        table = spark.createDataFrame(of, schema)
        if name == "orders":
            table = table.select("o_orderkey", F.timestamp_seconds(F.col("days") * 86400).alias("o_orderdate"))
        if name == "lineitem":
            table = table.withColumn("l_shipdate", F.timestamp_seconds(F.lit(0)))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    t = tables.Tables(spark, str(tmp_path))
    assert rows(t.tracked, "repo", "path") == [("repo0", "r0/n1/s1.py"), ("repo0", "r1/n2/s2.py"), ("repo4", "r1/n2/s2.py")]
    read = [f for df in (t.tracked, t.file_triple_edges) for f in df.inputFiles()]
    assert read and not any("lineitem" in f or "orders" in f for f in read)
