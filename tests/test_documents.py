import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import documents, drift, links, ownership


def table(spark, schema, *data):
    return spark.createDataFrame([("r", *d) for d in data], "repo string, " + schema)


@pytest.mark.parametrize(
    "src, target, expected",
    [
        ("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c.md", "c.md"), ("a/b.md", "../../c.md", None), ("a/b.md", "/x/./y.md", "x/y.md"),
        ("b.md", "./d//e.md", "d/e.md"), ("a/b.md", "..", ""), ("a/b.md", "../..", None),
    ],
)
def test_normalised_links(spark, src, target, expected):
    df = spark.createDataFrame([(src, target)], "s string, t string")
    assert df.select(paths.normalize_link(F.col("s"), F.col("t"))).first()[0] == expected


def test_climbs_stay_visible_in_broken_targets(spark):
    df = spark.createDataFrame([("a/b.md", "../../../x/../y.md")], "s string, t string")
    assert df.select(paths.normalize_keep(F.col("s"), F.col("t"))).first()[0] == "../../y.md"


def test_links_of_a_page(spark, rows):
    page = "See [[Note|n]] and [t](x.md#a) ![i](p.png) [w](https://e.org) `[[no]]`\n```md\n[f](f.md)\n```\n[#](#top)"
    found = links.extract_links(table(spark, "path string, text string", ("d.md", page)))
    assert rows(found, "kind", "target") == [("mdlink", ""), ("mdlink", "https://e.org"), ("mdlink", "x.md"), ("wikilink", "Note")]
    files = table(spark, "path string", ("d.md",), ("sub/x.md",))
    md = links.resolve_mdlinks(found, files)
    assert rows(md, "target", "status") == [("x.md", "broken")]
    assert rows(links.machine_links(found), "src", "machine_links") == [("d.md", 1)]


def test_wikilink_collisions_prefer_the_same_directory(spark, rows):
    docs = table(spark, "path string", ("a/n.md",), ("b/n.md",), ("c/other.md",), ("b/deep/Sub.md",))
    found = table(
        spark, "src string, kind string, target string",
        ("b/x.md", "wikilink", "n"), ("c/other.md", "wikilink", "n"), ("a/n.md", "wikilink", "b/N"), ("a/n.md", "wikilink", "SUB"), ("a/n.md", "wikilink", "gone"),
    )
    out = links.resolve_wikilinks(found, docs)
    assert rows(out, "src", "target", "dst", "ambiguous") == [
        ("a/n.md", "SUB", "b/deep/Sub.md", False), ("a/n.md", "b/N", "b/n.md", False), ("a/n.md", "gone", None, False),
        ("b/x.md", "n", "b/n.md", True), ("c/other.md", "n", "a/n.md", True),
    ]


def test_names_in_prose(spark, rows):
    docs = table(spark, "path string", ("guide.md",), ("x/setup.md",), ("README.md",))
    body = "read setup.md, not my.setup.md nor README.md\n```sh\ncat guide.md\n```"
    texts = table(spark, "path string, text string", ("guide.md", body))
    none = table(spark, "src string, dst string", ("q", "q"))
    assert rows(links.missing_xrefs(texts, docs, none), "src", "dst") == [("guide.md", "x/setup.md")]


def test_nearest_document(spark, rows):
    docs = table(spark, "path string", ("README.md",), ("a/README.md",), ("a/index.md",), ("a/b/b.md",), ("a/b/LICENSE.md",), ("z/notes.md",))
    code = table(spark, "path string", ("m.py",), ("a/x.py",), ("a/b/c/y.py",), ("z/q.py",))
    out = documents.nearest_ancestor(code, documents.base_doc_pick(docs))
    assert rows(out, "path", "doc") == [("a/b/c/y.py", "a/b/b.md"), ("a/x.py", "a/README.md"), ("m.py", "README.md"), ("z/q.py", "README.md")]


def test_staleness_methods(spark, rows):
    docs = table(spark, "path string", ("a/README.md",), ("docs/core.md",), ("guide.md",), ("loose.md",))
    code = table(spark, "path string", ("a/x.py",), ("lib/core/y.py",), ("lib/core/z.py",))
    churn = table(spark, "path string, commits long", ("a/x.py", 4), ("lib/core/y.py", 2), ("lib/core/z.py", 3), ("guide.md", 2))
    edges = table(spark, "doc string, code string", ("guide.md", "lib/core/z.py"), ("docs/core.md", "a/x.py"))
    newer = table(spark, "doc string, source_newer boolean", ("a/README.md", False))
    out = documents.staleness(docs, code, churn, edges, newer)
    assert rows(out, "doc", "method", "subject_count", "code_churn", "ratio", "confidence") == [
        ("a/README.md", "nearest-ancestor", 1, 4, 0.0, "high"), ("docs/core.md", "parallel-docs-tree", 2, 5, 5.0, "high"),
        ("guide.md", "explicit-links", 1, 3, 1.5, "high"), ("loose.md", "repo-baseline", 3, 9, 9.0, "low"),
    ]


def test_raw_trees(spark, rows):
    def signals(isolated, machine, n=10):
        return table(
            spark, "path string, in_degree long, out_degree long, machine_links long, is_entry boolean",
            *[(f"raw/x/d{i}.md", 0 if i < isolated else 1, 0, 1 if i < machine else 0, False) for i in range(n)],
        )

    assert rows(documents.raw_tree_density(signals(10, 5)), "dir") == [("raw",), ("raw/x",)]
    assert rows(documents.outermost(documents.raw_tree_density(signals(9, 5))), "dir") == [("raw",)]
    assert rows(documents.raw_tree_density(signals(10, 4)), "dir") == []
    assert rows(documents.raw_tree_density(signals(9, 9, n=9)), "dir") == []


def test_ownership_patterns(spark, rows):
    rules = table(
        spark, "pattern string, declared_in string",
        *[(p, "CODEOWNERS") for p in ("src/**", "docs/", "legacy/**", "Makefile", "/top.txt", "*.py", "s?c/[ab].go", "*x*")],
    )
    files = table(spark, "path string", *[(p,) for p in ("src/a.go", "src/d/b.py", "docs/x.md", "Makefile", "tools/Makefile", "top.txt", "q/top.txt")])
    found = ownership.match_rules(rules, files)
    assert rows(ownership.rule_counts(rules, found), "pattern", "n_files") == [
        ("*.py", 1), ("*x*", 3), ("/top.txt", 1), ("Makefile", 2), ("docs/", 1), ("legacy/**", 0), ("s?c/[ab].go", 1), ("src/**", 2),
    ]


def test_sections_and_references(spark, rows):
    body = ["intro src/a.py", "# One #", "`src/b.py` and lib/, x", "```", "# not a header src/q.py", "```", "## Two", "[[gone.md]]"]
    lines = table(spark, "doc string, line_no long, text string", *[("D.md", i, t) for i, t in enumerate(body)])
    files = table(spark, "path string", ("src/a.py",), ("lib/z/c.py",), ("deep/b.py",))
    out = ownership.resolve_refs(ownership.section_refs(lines), files)
    assert rows(out, "section", "ref", "level") == [("D.md::D.md", "src/a.py", 1), ("D.md::One", "src/b.py", None), ("D.md::Two", "gone.md", None)]


def brute(own, comm, co, seams):
    def pairs(groups):
        return {(a, b) for g in groups.values() for a in g for b in g if a < b}

    def side(p, q):
        under = lambda x, d: x == d or x.startswith(d + "/")
        return any((under(p, lo) and under(q, hi)) or (under(p, hi) and under(q, lo)) for lo, hi in seams)

    h, s, c = ({x for x in rel if not side(*x)} for rel in (pairs(own), pairs(comm), co))
    return (len(h - s), len(s - h), len(h - c), len(c - h), len(h & s), len(h & c))


@pytest.mark.parametrize("seed", [1, 2])
def test_grouping_counts_equal_enumerated_pairs(spark, rows, seed):
    import random

    rng = random.Random(seed)
    files = [f"d{i % 4}/f{i}" for i in range(30)]
    own = {f"b{j}": set(rng.sample(files, 9)) for j in range(5)}
    comm = {}
    for f in files:
        comm.setdefault(rng.randrange(4), set()).add(f)
    co = {tuple(sorted(rng.sample(files, 2))) for _ in range(40)}
    seams = [("d0", "d1"), ("d2/f2", "d2")]
    ownership_df = table(spark, "boundary string, path string", *[(b, f) for b, g in own.items() for f in g])
    relabel = {k: f"c{k}" if seed == 1 else f"z{9 - k}" for k in comm}
    comm_df = table(spark, "path string, community string", *[(f, relabel[k]) for k, g in comm.items() for f in g])
    co_df = table(spark, "file_a string, file_b string", *co)
    columns = [
        "human_grouped_static_splits", "human_split_static_fuses", "human_grouped_never_cochange", "human_split_but_cochange",
        "human_static_agree", "human_cochange_agree",
    ]
    for allowed in ([], seams):
        got = rows(drift.grouping_disagreement(ownership_df, comm_df, co_df, allowed), *columns)
        assert got == [brute(own, comm, co, allowed)]


def test_frontmatter_forms(spark):
    body = "---\nTitle: 'A'\ntags:\n  - \"X\"\n\n  - y\nempty:\nSource: [one.py, \"two.py\"] # c\n---\nrest"
    row = spark.createDataFrame([(body,)], "t string").select(
        text.frontmatter_fields(F.col("t")).alias("f"), text.frontmatter_tags(F.col("t")).alias("tags"), text.provenance_sources(F.col("t")).alias("s")
    ).first()
    assert row["f"]["title"] == "A" and "empty" not in row["f"]
    assert sorted(row["tags"]) == ["x", "y"]
    # a comment after the bracket makes it a scalar, not a list
    assert row["s"] == ['[one.py, "two.py"]']


def test_globs_that_no_engine_would_compile(spark, rows):
    from tidemark.operators import ownership

    files = ["docs/[draft", "docs/draft", "a/b.py", "a/&b", "a/-x", "a/^x", "deep/Makefile", "x[1].txt", "z.q"]
    patterns = ["docs/[draft", "/a/[z-a]*", "a/[&&]b", "a/[!&^-]*.py", "Makefile", "x[[]1].txt", "[]z].q", "[", "[]", "a/[a-b-]*", "*.{py}", "/a/**"]
    f = spark.createDataFrame([("r", p) for p in files], "repo string, path string")
    r = spark.createDataFrame([("r", p) for p in patterns], "repo string, pattern string")
    assert rows(ownership.match_rules(r, f), "pattern", "path") == sorted([
        ("docs/[draft", "docs/[draft"), ("a/[&&]b", "a/&b"), ("a/[!&^-]*.py", "a/b.py"), ("Makefile", "deep/Makefile"), ("x[[]1].txt", "x[1].txt"), ("[]z].q", "z.q"),
        ("a/[a-b-]*", "a/b.py"), ("a/[a-b-]*", "a/-x"), ("/a/**", "a/b.py"), ("/a/**", "a/&b"), ("/a/**", "a/-x"), ("/a/**", "a/^x"),
    ], key=repr)


def test_a_fence_that_never_closes_is_text(spark, rows):
    from tidemark.operators import ownership

    text = ["one", "```", "inside", "```", "two", "```", "three"]
    lines = spark.createDataFrame([("r", "d", i, x) for i, x in enumerate(text)], "repo string, doc string, line_no long, text string")
    assert [x for _, x in rows(ownership.outside_fences(lines), "line_no", "text")] == ["one", "two", "```", "three"]


def test_pairs_are_counted_without_class_pairs(spark, rows):
    import itertools

    from tidemark.operators import drift

    owned = [("r", "all", f"d/f{i}") for i in range(300)] + [("r", f"own{i}", f"d/f{i}") for i in range(300)]
    owned += [("r", f"b{k}", f"e/f{i}") for k in range(4) for i in range(40) if i % (k + 2) == 0]
    table = spark.createDataFrame(owned, "repo string, boundary string, path string")
    compared = drift._tiles(drift._by_boundary(drift.file_classes(table, []), []), ["repo", "boundary"])
    assert compared.count() < 40
    seams = [("d", "e"), ("e/f1", "e")]
    for s in ([], seams):
        held = {}
        for _, b, p in owned:
            held.setdefault(b, set()).add(p)
        pairs = {(x, y) for own in held.values() for x, y in itertools.combinations(sorted(own), 2)}
        under = lambda p, d: p == d or p.startswith(d + "/")
        pairs = {(x, y) for x, y in pairs if not any((under(x, lo) and under(y, hi)) or (under(y, lo) and under(x, hi)) for lo, hi in s)}
        assert rows(drift.human_pair_counts(table, s), "pairs") == [(len(pairs),)]
    communities = spark.createDataFrame([("r", "d/f1", "c"), ("quiet", "a", "c"), ("quiet", "b", "c")], "repo string, path string, community string")
    cochange = spark.createDataFrame([], "repo string, file_a string, file_b string")
    out = dict(rows(drift.grouping_disagreement(table, communities, cochange), "repo", "reason"))
    assert out == {"r": None, "quiet": "no ownership map"}
