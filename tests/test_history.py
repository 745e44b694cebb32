from pyspark.sql import functions as F

from tidemark.operators import accretion, churn, complexity, coupling
from tidemark.plans import tables


def touches(spark, commits):
    data = [("r", sha, i, path) for i, (sha, files) in enumerate(commits) for path in files]
    return spark.createDataFrame(data, "repo string, sha string, ts long, path string")


def commit_table(spark, commits):
    return spark.createDataFrame([("r", sha, i) for i, (sha, _) in enumerate(commits)], "repo string, sha string, ts long")


def test_pairs_of_a_trio_and_the_denominator(spark, rows):
    commits = [(f"c{i}", ["a", "b", "c"]) for i in range(4)]
    pairs = coupling.coupling_pairs(touches(spark, commits), commit_table(spark, commits))
    assert rows(pairs, "file_a", "file_b", "co_change_count", "support_pct") == [
        ("a", "b", 4, 100.0), ("a", "c", 4, 100.0), ("b", "c", 4, 100.0),
    ]
    with_empty = commit_table(spark, commits + [("empty", [])] * 1 + [("bulk", [])])
    assert rows(coupling.coupling_pairs(touches(spark, commits), with_empty), "support_pct")[0][0] == 100.0 * 4 / 6


def test_bulk_commits_make_no_pairs(spark):
    commits = [("bulk", [f"f{i}" for i in range(51)]), ("edge", [f"f{i}" for i in range(50)]), ("one", ["x"])]
    kept = coupling.bulk_commit_filter(touches(spark, commits))
    assert {r[0] for r in kept.select("sha").distinct().collect()} == {"edge"}
    assert coupling.co_change_pairs(touches(spark, commits)).count() == 50 * 49 // 2


def test_bulk_filter_reads_the_history_once(spark, tmp_path):
    touches(spark, [("one", ["x"]), ("two", ["x", "y"])]).write.parquet(str(tmp_path / "log"))
    plan = coupling.co_change_pairs(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation ") == 1


def test_commit_files_are_dealt_by_commit(spark, tmp_path, rows, monkeypatch):
    for name, columns, data in (
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp", [(k, 1, s, 1, None) for k in (1, 2) for s in (7, 7, 8, 9)]),
        ("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 1, None), (2, 1, None), (2, 1, None), (3, 1, None)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(7, 1), (7, 1), (8, 2), (9, None)]),
        ("nation", "n_nationkey int, n_regionkey int", [(1, 0), (2, 0)]),
    ):
        spark.createDataFrame(data, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(tables, "PART_BYTES", 100)
    t = tables.Tables(spark, str(tmp_path))
    assert t.order_lines.rdd.getNumPartitions() > 4
    assert rows(t.commit_files, "sha", "path") == [(1, "r0/n1/s7.py"), (1, "r0/n2/s8.py"), (2, "r0/n1/s7.py"), (2, "r0/n2/s8.py")]


def test_containment(spark, rows):
    commits = [("1", ["src/a/x", "src/a/y"]), ("2", ["src/a/x", "src/b/z"]), ("3", ["src/a/x", "root"]), ("4", ["src/ab/q"])]
    out = coupling.containment_ratio(touches(spark, commits))
    assert rows(out, "dir", "touching", "containment") == [
        ("src", 4, 0.75), ("src/a", 3, 1 / 3), ("src/ab", 1, 1.0), ("src/b", 1, 0.0),
    ]


def test_accretion_sequences(spark, rows):
    seq = {
        "grows": [(10, 0), (5, 1), (7, 0)],
        "late_cut": [(50, 0), (30, 0), (1, 5)],
        "two_commits": [(5, 0), (5, 0)],
        "first_falls": [(0, 1), (20, 0), (20, 0)],
        "heavy_deletion": [(10, 4), (10, 4), (10, 4)],
        "no_lines": [(0, 0), (0, 0), (0, 0)],
    }
    data = [("r", f"s{i}", i * 86400 * 30, name, a, d) for name, steps in seq.items() for i, (a, d) in enumerate(steps)]
    numstat = spark.createDataFrame(data, "repo string, sha string, author_ts long, path string, added long, deleted long")
    out = accretion.accretion(numstat)
    assert rows(out, "path", "net_additions", "commit_count") == [("first_falls", 39, 3), ("grows", 21, 3)]
    net = accretion.running_net_delta(numstat.where("path = 'late_cut'"))
    assert rows(net, "sha", "net", "prev_net") == [("s0", 50, None), ("s1", 80, 50), ("s2", 76, 80)]


def test_order_is_author_time_then_sha(spark, rows):
    data = [("r", "b", 5, "p", 1, 0), ("r", "a", 5, "p", 0, 1), ("r", "c", 1, "p", 10, 0)]
    numstat = spark.createDataFrame(data, "repo string, sha string, author_ts long, path string, added long, deleted long")
    assert rows(accretion.running_net_delta(numstat), "sha", "net", "prev_net") == [("a", 9, 10), ("b", 10, 9), ("c", 10, None)]


def test_degenerate_history(spark, rows):
    def verdict(counts):
        df = spark.createDataFrame([("r", f"f{i}", c) for i, c in enumerate(counts)], "repo string, path string, commits long")
        return rows(churn.churn_degenerate(df), "degenerate")[0][0]

    assert verdict([1] * 6)
    assert not verdict([1] * 4)
    assert not verdict([1, 1, 1, 1, 9])
    assert verdict([1] * 20 + [9])


def test_churn_window_widens(spark, rows):
    as_of = 1_000_000_000
    day = 86400
    data = [("r", f"c{i}", as_of - 500 * day, "a") for i in range(3)] + [("r", "new", as_of - day, "a")]
    df = spark.createDataFrame(data, "repo string, sha string, ts long, path string")
    files = spark.createDataFrame([("r", "a"), ("r", "b"), ("quiet", "z")], "repo string, path string")
    assert rows(churn.pick_churn_window(df, files, as_of), "repo", "path", "window_label", "commits") == [
        ("r", "a", "commits (last 24mo)", 4), ("r", "b", "commits (last 24mo)", 0),
    ]


def test_months_are_calendar_months():
    march_31 = 1_080_691_200  # 2004-03-31
    assert churn.months_before(march_31, 1) == 1_078_012_800  # 2004-02-29
    assert churn.months_before(march_31, 12) == 1_049_068_800  # 2003-03-31


def test_deciles_match_a_plain_rank(spark, rows):
    counts = [1, 1, 2, 3, 3, 3, 8, 9, 9, 20]
    df = spark.createDataFrame([("r", f"f{i}", c) for i, c in enumerate(counts)], "repo string, path string, commits long")
    got = {p: d for p, d in rows(churn.commit_count_decile(df), "path", "decile")}
    for i, c in enumerate(counts):
        assert abs(got[f"f{i}"] - sum(x < c for x in counts)) < 1e-9


def test_people_and_bots(spark, rows):
    data = [
        ("human", "1", "Claude", "claude@personal.org", "Claude", "claude@personal.org", ""),
        ("bot", "1", "x[bot]", "x@y", "x[bot]", "x@y", ""),
        ("pair", "1", "Ann", "ann@y", "Ann", "ann@y", "Helper <copilot@github.com>"),
        ("blank", "1", "Bob", "", "Bob", "", ""),
        ("agent_unclear", "1", "x[bot]", "x@y", "x", "x@y", ""),
        ("agent_unclear", "2", "Bob", "", "Bob", "", ""),
    ]
    schema = "path string, sha string, an string, ae string, cn string, ce string, coauthor_text string"
    df = spark.createDataFrame(data, schema).select(F.lit("r").alias("repo"), "*", F.lit(1).alias("added"), F.lit(0).alias("deleted"))
    out = coupling.authorship_class(df)
    assert rows(out, "path", "human_anchor", "authorship_class") == [
        ("agent_unclear", False, "unknown"), ("blank", False, "unknown"), ("bot", False, "agent"), ("human", True, "human"), ("pair", True, "mixed"),
    ]


def test_percentiles_are_linear(spark, rows):
    df = spark.createDataFrame([("r", v) for v in (1, 2, 3, 4, 100)], "repo string, v long")
    ((p50, p95, peak, n),) = rows(complexity.percentiles(df, ["repo"], "v"), "p50", "p95", "max", "count")
    assert (p50, peak, n) == (3.0, 100.0, 5)
    assert abs(p95 - 80.8) < 1e-9


def test_repositories_do_not_mix(spark, rows):
    data = [(r, sha, 0, p) for r in ("one", "two") for sha, p in [("1", "a"), ("1", "b"), ("2", "a")]]
    df = spark.createDataFrame(data, "repo string, sha string, ts long, path string")
    assert rows(churn.churn_per_file(df), "repo", "path", "commits") == [
        ("one", "a", 2), ("one", "b", 1), ("two", "a", 2), ("two", "b", 1),
    ]
