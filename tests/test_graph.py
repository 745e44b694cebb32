import pytest

from tidemark import staging
from tidemark.operators import graph, structure


def net(spark, nodes, edges, repo="r"):
    n = spark.createDataFrame([(repo, x) for x in nodes], "repo string, node string")
    e = spark.createDataFrame([(repo, a, b) for a, b in edges], "repo string, src string, dst string")
    return n, e


def power_iteration(nodes, edges, rounds):
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    pr = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        loose = sum(pr[n] for n in nodes if not out[n])
        fresh = {n: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for n in nodes}
        for n in nodes:
            for b in out[n]:
                fresh[b] += 0.85 * pr[n] / len(out[n])
        pr = fresh
    return pr


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_pagerank_with_dangling_pages_and_sliced_hubs(spark, hot_rows):
    nodes = list("abcdef")
    edges = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("c", "a"), ("e", "a")]
    n, e = net(spark, nodes, edges)
    lone = spark.createDataFrame([("quiet", "x"), ("quiet", "y")], "repo string, node string")
    got = {(r, k): v for r, k, v in graph.pagerank(n.unionByName(lone), e, iterations=4, hot_rows=hot_rows).collect()}
    for k, v in power_iteration(nodes, edges, 4).items():
        assert abs(got["r", k] - v) < 1e-12
    assert got["quiet", "x"] == 0.5


def test_cycles(spark, rows):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("s", "s")]
    _, e = net(spark, [], [])
    _, e = net(spark, ["a"], edges)
    assert rows(graph.strong_components(e), "component", "node", "size") == [
        ("a", "a", 3), ("a", "b", 3), ("a", "c", 3), ("x", "x", 2), ("x", "y", 2),
    ]


CLIQUES = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]


def test_two_cliques_make_two_clusters(spark, rows):
    n, e = net(spark, list("abcdwxyz"), CLIQUES)
    part = graph.communities(n, e)
    groups = {}
    for node, c in rows(part, "node", "community"):
        groups.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]
    q = rows(graph.modularity_q(e, part), "modularity_q")[0][0]
    assert abs(q - (12 / 13 - 2 * (13 / 26) ** 2)) < 1e-12
    alone = n.withColumn("community", n["node"])
    assert rows(graph.modularity_q(e, alone), "modularity_q")[0][0] < q


def test_breakup_needs_clear_clusters(spark, rows):
    modules = spark.createDataFrame([("r", f"pkg.{x}") for x in "abcdwxyz"] + [("r", "tiny.a")], "repo string, module string")
    edges = spark.createDataFrame([("r", f"pkg.{a}", f"pkg.{b}") for a, b in CLIQUES], "repo string, src string, dst string")
    found, clusters = structure.breakup_candidates(modules, edges)
    assert rows(found, "repo", "package", "clusters") == [("r", "pkg", 2)]
    assert clusters.count() == 8


def test_imports_of_every_form(spark, rows):
    files = ["src/pkg/__init__.py", "src/pkg/a.py", "src/pkg/b.py", "src/pkg/sub/__init__.py", "src/pkg/sub/m.py", "lone.py", "src/tool.py", "top/__init__.py", "src/pkg/loose/x.py"]
    f = spark.createDataFrame([("r", p) for p in files], "repo string, path string")
    modules = structure.python_modules(f)
    assert rows(modules, "module", "is_package") == [("pkg", True), ("pkg.a", False), ("pkg.b", False), ("pkg.sub", True), ("pkg.sub.m", False), ("top", True)]
    forms = {
        "lone.py": ["import pkg.a"],
        "src/pkg/__init__.py": ["from . import a"],
        "src/pkg/a.py": ["import pkg.b as q; import pkg.sub.m", "from pkg import (  # several", "    sub,", "    nothing)", "sub = 1"],
        "src/pkg/b.py": ["import pkg.a, \\", "    pkg.sub", "import os, \\", "  pkg.missing"],
        "src/pkg/sub/m.py": ["from .. import a, b as c", "from . import nothing", "from ..b import thing", "from pkg.sub import *"],
        "top/__init__.py": ["from pkg import a, b", "x = 'from pkg import sub'"],
    }
    lines = spark.createDataFrame([("r", p, i, x) for p, own in forms.items() for i, x in enumerate(own)], "repo string, path string, line_no long, text string")
    assert rows(structure.import_edges(lines, modules), "src", "dst") == [
        ("pkg", "pkg.a"), ("pkg.a", "pkg"), ("pkg.a", "pkg.b"), ("pkg.a", "pkg.sub"), ("pkg.a", "pkg.sub.m"), ("pkg.b", "pkg.a"), ("pkg.b", "pkg.sub"),
        ("pkg.sub.m", "pkg.a"), ("pkg.sub.m", "pkg.b"), ("pkg.sub.m", "pkg.sub"), ("top", "pkg.a"), ("top", "pkg.b"),
    ]


def test_loops_leave_a_fixed_number_of_tables(spark, tmp_path, monkeypatch):
    n, e = net(spark, [f"n{i:03d}" for i in range(40)], [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(39)])
    runs = [
        (lambda: graph.weak_components(n, e), 2), (lambda: graph.distances(n, e, n.limit(1)), 10),
        (lambda: graph.strong_components(e), 1), (lambda: graph.pagerank(n, e), 11),
    ]
    for k, (run, most) in enumerate(runs):
        folder = tmp_path / str(k)
        monkeypatch.setattr(staging, "staging_root", lambda _, folder=folder: str(folder))
        run().collect()
        assert len(list(folder.iterdir())) <= most


def test_reach_of_a_ring_tree(spark, rows):
    n, e = net(spark, ["README.md", "a", "b", "c", "d", "e"], [("README.md", "a"), ("a", "b"), ("d", "e"), ("e", "d")])
    roots = graph.entry_points(n, n.withColumn("pagerank", n["node"].isNotNull().cast("double")))
    assert rows(roots, "node") == [("README.md",)]
    dist = graph.distances(n, e, roots)
    assert [x for x in rows(dist, "node", "dist") if x[1] is not None] == [("README.md", 0), ("a", 1), ("b", 2)]
    kinds = dict(rows(graph.classify(n, graph.degree(n, e), dist, roots), "node", "kind"))
    assert kinds == {"README.md": "entry", "a": "reachable", "b": "reachable", "c": "orphan", "d": "island", "e": "island"}
    assert len(set(dict(rows(graph.weak_components(n, e), "node", "component")).values())) == 3


def test_rings_grow(spark):
    far = spark.createDataFrame([("r", f"n{i:03d}", None) for i in range(120)], "repo string, node string, dist int")
    sizes = {}
    for r in graph.hop_shells(far).collect():
        sizes[r["shell"]] = sizes.get(r["shell"], 0) + 1
    assert [sizes[k] for k in sorted(sizes)] == [24, 36, 48, 12]


def test_levels_stop_at_a_cycle(spark, rows):
    data = [("r", "a", None), ("r", "b", "a"), ("r", "c", "b"), ("r", "c", "a"), ("r", "x", "y"), ("r", "y", "x"), ("r", "z", "y")]
    deps = spark.createDataFrame(data, "repo string, item string, blocked_by string")
    assert rows(graph.dependency_levels(deps), "item", "level") == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None), ("z", None)]
