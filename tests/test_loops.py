"""Graph loops, overlapping boundaries, long hash chains and landed streams against plain Python."""

import datetime as dt
import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import contraction, drift, graph, snapshots
from tidemark.sources import sinks
from tidemark.streaming import jobs


def reach(start, out):
    seen, stack = {start}, [start]
    while stack:
        for b in out.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


@pytest.mark.parametrize("held", [3, 500_000])
def test_islands_equal_search(spark, monkeypatch, held):
    monkeypatch.setattr(contraction, "LINKS_HELD", held)
    rng = random.Random(held)
    names = [f"n{i:03d}" for i in range(150)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(60)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40, 80)] + [("n100", x) for x in names[101:140]] + [("n001", "gone")]
    nodes = spark.createDataFrame([(r, n) for r in ("r", "s") for n in names] + [("r", "n000")], "repo string, node string")
    edges = spark.createDataFrame([("r", a, b) for a, b in links], "repo string, a string, b string").repartition(5)
    got = {(r.repo, r.node): r.component for r in contraction.islands(nodes, edges).collect()}
    known = [(a, b) for a, b in links if b != "gone"]
    out = neighbours(known + [(b, a) for a, b in known])
    assert got == {("r", n): min(reach(n, out)) for n in names} | {("s", n): n for n in names}
    assert contraction.islands(nodes.limit(0), edges).count() == 0


def test_strong_components_equal_search(spark):
    rng = random.Random(4)
    names = [f"m{i:02d}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(95)] + [(f"m{i:02d}", f"m{i + 1:02d}") for i in range(20, 45)] + [("m45", "m20")]
    out = neighbours(edges)
    far = {n: reach(n, out) for n in names}
    members = {n: [x for x in names if x in far[n] and n in far[x]] for n in names}
    want = {(n, min(m), len(m)) for n, m in members.items() if len(m) > 1}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string")
    for steps in (1, 6):
        assert {(r.node, r.component, r.size) for r in graph.strong_components(df, steps).collect()} == want
    assert graph.strong_components(df.limit(0)).count() == 0


def test_a_hub_takes_its_leaves_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": rounds.append(name) or plain(df, name))
    edges = [("hub", f"l{i:03d}") for i in range(200)] + [("other", f"k{i:03d}") for i in range(200)] + [("hub", "other")]
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string")
    nodes = spark.createDataFrame([("r", n) for n in sorted({x for e in edges for x in e} | {"alone"})], "repo string, node string")
    part = {r.node: r.community for r in graph.communities(nodes, df).collect()}
    assert len({part[n] for n in part if n[0] in "hl"}) == 1 == len({part[n] for n in part if n[0] in "ok"})
    assert part["alone"] == "alone" and part["hub"] != part["other"] and rounds.count("moves") <= 5


def test_early_end_of_pagerank_changes_nothing(spark, monkeypatch):
    nodes = spark.createDataFrame([("r", x) for x in "abcdef"] + [("loop", x) for x in "xy"], "repo string, node string")
    edges = [("r", a, b) for a, b in ("ab", "ac", "bd", "de")] + [("loop", "x", "y"), ("loop", "y", "x")]
    df = spark.createDataFrame(edges, "repo string, src string, dst string")
    only = df.where("repo = 'r'")
    full = {(r.repo, r.node): r.pagerank for r in graph.pagerank(nodes, df, iterations=60).collect()}
    short = {(r.repo, r.node): r.pagerank for r in graph.pagerank(nodes.where("repo = 'r'"), only, iterations=60).collect()}
    monkeypatch.setattr(graph, "RANK_LEFT", 0.0)
    whole = {(r.repo, r.node): r.pagerank for r in graph.pagerank(nodes.where("repo = 'r'"), only, iterations=60).collect()}
    assert all(abs(short[k] - whole[k]) < 1e-10 and abs(full[k] - whole[k]) < 1e-10 for k in whole) and abs(sum(short.values()) - 1) < 1e-9


def pairs_by_hand(boundaries, sides=lambda a, b: True):
    return {p for files in boundaries.values() for p in combinations(sorted(files), 2) if sides(*p)}


@pytest.mark.parametrize("tile", [3, 2048])
def test_overlapping_boundaries_are_counted_once(spark, monkeypatch, tile):
    monkeypatch.setattr(drift, "TILE", tile)
    rng = random.Random(tile)
    files = [f"{'lo' if i % 3 == 0 else 'hi' if i % 3 == 1 else 'mid'}/f{i:02d}" for i in range(70)]
    boundaries = {f"b{k:02d}": {f for f in files if rng.random() < 0.25} | {files[0], files[1]} for k in range(40)} | {"all": set(files[:30]), "inner": set(files[5:9])}
    owned = spark.createDataFrame([("r", b, f) for b, own in boundaries.items() for f in own] + [("s", "x", files[0])], "repo string, boundary string, path string")
    got = {r.repo: r.pairs for r in drift.human_pair_counts(owned).collect()}
    assert got == {"r": len(pairs_by_hand(boundaries)), "s": 0}
    seams = [("lo", "hi")]
    apart = lambda a, b: {a[:2], b[:2]} != {"lo", "hi"}
    assert {r.repo: r.pairs for r in drift.human_pair_counts(owned, seams).collect()}["r"] == len(pairs_by_hand(boundaries, apart))
    parts = {f: str(i % 4) for i, f in enumerate(files)}
    communities = spark.createDataFrame([("r", f, c) for f, c in parts.items()], "repo string, path string, community string")
    close = [(files[i], files[i + 1]) for i in range(0, 40, 3)]
    together = spark.createDataFrame([("r", *sorted(p)) for p in close], "repo string, file_a string, file_b string")
    h = pairs_by_hand(boundaries, apart)
    s = {p for p in combinations(sorted(files), 2) if parts[p[0]] == parts[p[1]] and apart(*p)}
    c = {tuple(sorted(p)) for p in close if apart(*p)}
    row = {r.repo: r for r in drift.grouping_disagreement(owned, communities, together, seams).collect()}["r"]
    assert tuple(row)[1:7] == (len(h - s), len(s - h), len(h - c), len(c - h), len(h & s), len(h & c))


def linked(start, texts):
    acc = start
    for x in texts:
        acc = hashlib.sha256((acc + x).encode()).hexdigest()[: fv.CHAIN_LENGTH]
    return acc


def test_long_runs_of_unstamped_entries(spark):
    n = 100_000
    plain = spark.range(1, n + 1).select(F.lit("r").alias("repo"), F.lit("long").alias("log"), F.col("id").alias("n"), F.concat(F.lit("entry "), "id").alias("text"), F.lit(None).cast("string").alias("stored"))
    texts = [f"entry {i}" for i in range(1, n + 1)]
    end = spark.createDataFrame([("r", "long", n + 1, "end", linked(fv.CHAIN_GENESIS, [*texts, "end"])), ("r", "long", n + 2, "bad", "00"), ("r", "short", 1, "x", None)], plain.schema)
    log = plain.unionByName(end).repartition(6)
    got = {(r.log, r.n): (r.stored, r.expected) for r in snapshots.log_chain(log).collect()}
    good = linked(fv.CHAIN_GENESIS, [*texts, "end"])
    assert got == {("long", n + 1): (good, good), ("long", n + 2): ("00", linked(good, ["bad"])), ("short", 1): (None, linked(fv.CHAIN_GENESIS, ["x"]))}
    assert {(r.log, r.valid, r.broken_at) for r in snapshots.log_chain_verify(log).collect()} == {("long", False, n + 2), ("short", True, None)}
    added = spark.createDataFrame([("r", "long", "next"), ("r", "fresh", "one"), ("r", "short", "two")], "repo string, log string, text string")
    rows = {r.log: r for r in sinks.new_log_rows(plain.unionByName(end.where("log = 'short'")), added).collect()}
    assert rows["long"].stored == linked(fv.CHAIN_GENESIS, ["".join(texts) + "next"]) and rows["long"].n == n + 1
    assert rows["fresh"].stored == linked(fv.CHAIN_GENESIS, ["one"]) and rows["short"].stored == linked(fv.CHAIN_GENESIS, ["xtwo"])


def test_late_rows_of_a_stream_are_counted(spark, rows):
    day = lambda d: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=d)
    schema = "ts timestamp, repo string, sha string, path string"
    runs = [[(day(0), "r", "a", "f"), (day(40), "r", "b", "f")], [(day(39), "r", "c", "f"), (day(1), "r", "d", "f"), (day(90), "r", "e", "f")], [(day(80), "r", "g", "f"), (day(89), "r", "h", "f")]]
    flat = lambda s: jobs.churn_windows(s, "30 days", "2 days").select("repo", "path", F.col("window.start").alias("start"), "commits")
    counted, late = jobs.drain_landings([spark.createDataFrame(r, schema) for r in runs], flat, "w", "update", ["repo", "path", "start"])
    assert counted.agg(F.sum("commits")).first()[0] == 5
    assert rows(late, "run", "late_rows") == [(0, 0), (1, 1), (2, 1)]


def levels_by_hand(deps):
    blockers = {}
    for item, by in deps:
        blockers.setdefault(item, set())
        if by is not None:
            blockers[item].add(by)
            blockers.setdefault(by, set())
    level = {}
    while True:
        ready = [i for i, b in blockers.items() if i not in level and all(x in level for x in b)]
        if not ready:
            return {i: level.get(i) for i in blockers}
        for i in ready:
            level[i] = max((level[x] + 1 for x in blockers[i]), default=0)


def test_levels_of_chains_diamonds_and_cycles(spark):
    rng = random.Random(9)
    chain = [("c000", None)] + [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 90)]
    diamonds = [(f"d{i}{x}", f"d{i - 1}z") for i in range(1, 12) for x in "lr"] + [(f"d{i}z", f"d{i}{x}") for i in range(1, 12) for x in "lr"] + [("d5z", "c040"), ("d3l", "c010")]
    ring = [("x1", "x3"), ("x2", "x1"), ("x3", "x2"), ("y", "x2"), ("y", "c003"), ("w", "y"), ("two", "one"), ("one", "two"), ("one", "c001"), ("two", "c002"), ("tail", "two"), ("s", "s")]
    loose = [(f"g{i:02d}", f"g{rng.randrange(i):02d}") for i in range(1, 60) for _ in range(rng.randrange(1, 4))]
    deps = [*chain, *diamonds, *ring, *loose]
    df = spark.createDataFrame([("r", i, b) for i, b in deps] + [("s", "a", None)], "repo string, item string, blocked_by string")
    for jumps in (1, 3):
        got = {(r.repo, r.item): r.level for r in graph.dependency_levels(df, jumps).collect()}
        assert got == {("r", i): v for i, v in levels_by_hand(deps).items()} | {("s", "a"): 0}
    assert graph.dependency_levels(df.limit(0)).count() == 0


def test_an_automaton_matches_as_regexes_do(spark):
    import re

    from tidemark.functions import paths
    from tidemark.operators import globbing, ownership

    rng = random.Random(3)
    tokens = ["*", "?", "a", "b", "/", "1", "[ab]", "[!a]", "[b-a]", "[1-3]", "[", "[]a]", "[!]", ".", "é", "**", "-", "]"]
    rules = sorted({"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 7))) for _ in range(400)} | {"*", "?", "a", "/a*", "[x"})
    names = sorted({"".join(rng.choice(["a", "b", "/", "1", "2", ".", "é", "[", "]", "-", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([("r", r) for r in rules], "repo string, pattern string")
    files = spark.createDataFrame([("r", n) for n in names] + [("s", n) for n in names[:5]], "repo string, path string")
    keyed = ownership._rule_keys(df).collect()
    want = {(k.pattern, n) for k in keyed for n in names if re.search(k.regex, n)}
    own = globbing.GlobSet([(k.glob, k.anchored) for k in keyed])
    assert {(keyed[i].pattern, n) for n in names for i in own.matches(n)} == want
    assert {(r.pattern, r.path) for r in ownership.match_rules(df, files).collect() if r.repo == "r"} == want
    sliced = globbing.matched(ownership._rule_keys(df).select("repo", "pattern", "glob", "anchored"), files, 40)
    assert {(r.pattern, r.path) for r in sliced.collect()} == want
    assert paths.glob_regex("*").endswith(")$")


def test_thousands_of_rules_cost_a_path_its_length():
    import time

    from tidemark.operators import globbing

    own = globbing.GlobSet([(f"*{i:04d}?*[{i % 9}-9]*", False) for i in range(5_000)])
    start = time.process_time()
    found = [own.matches(f"src/dir{i % 40}/file{i:04d}x9.py") for i in range(1_000)]
    assert all(i in f for i, f in enumerate(found)) and time.process_time() - start < 20
