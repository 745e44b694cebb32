"""Queries over document graphs, import graphs and work items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.operators import documents, graph, structure
from tidemark.plans.catalog import query
from tidemark.plans.docs import STALE, staleness_of
from tidemark.plans.history import r6
from tidemark.plans.tables import Tables
from tidemark.staging import stage


def nodes(t: Tables):
    return t.doc_nodes.select("repo", F.col("doc").alias("node"))


def staged_graph(t: Tables):
    return stage(nodes(t), "nodes"), stage(t.doc_graph_edges, "edges")


DEGREE = """deg AS (SELECT n.repo, n.doc AS node, (SELECT count(*) FROM doc_graph_edges e WHERE e.repo = n.repo AND e.dst = n.doc) AS in_degree,
        (SELECT count(*) FROM doc_graph_edges e WHERE e.repo = n.repo AND e.src = n.doc) AS out_degree FROM doc_nodes n)"""


@query("degree", f"WITH {DEGREE} SELECT repo, node, in_degree, out_degree FROM deg")
def degree(t: Tables):
    return graph.degree(nodes(t), t.doc_graph_edges)


# dangling pages become even links to every page, so one sum is one iteration
def rank_sql(rounds: int) -> str:
    return f"""{DEGREE}, sized AS (SELECT repo, count(*) AS n FROM doc_nodes GROUP BY repo),
    w AS (SELECT e.repo, e.src, e.dst, 0.85 / d.out_degree AS w FROM doc_graph_edges e JOIN deg d ON d.repo = e.repo AND d.node = e.src
        UNION ALL SELECT d.repo, d.node, x.doc, 0.85 / s.n FROM deg d JOIN sized s USING (repo) JOIN doc_nodes x ON x.repo = d.repo WHERE d.out_degree = 0
        UNION ALL SELECT repo, node, node, 0.0 FROM deg),
    pr AS (SELECT 0 AS i, d.repo, d.node, 1.0::DOUBLE / s.n AS pr FROM deg d JOIN sized s USING (repo)
        UNION ALL SELECT p.i + 1, w.repo, w.dst, (any_value(0.15 / s.n) + sum(p.pr * w.w))::DOUBLE FROM pr p JOIN w ON w.repo = p.repo AND w.src = p.node JOIN sized s ON s.repo = p.repo WHERE p.i < {rounds} GROUP BY p.i, w.repo, w.dst),
    rank AS (SELECT repo, node, pr AS pagerank FROM pr WHERE i = {rounds})"""


RANK = rank_sql(100)


@query("pagerank", f"WITH RECURSIVE {RANK} SELECT repo, node, round(pagerank, 7) AS pagerank FROM rank")
def pagerank(t: Tables):
    return graph.pagerank(*staged_graph(t)).select("repo", "node", F.round("pagerank", 7).alias("pagerank"))


@query(
    "top_hubs",
    f"""WITH RECURSIVE {RANK} SELECT repo, node, pagerank, out_degree, in_degree, position FROM (SELECT repo, node, round(pagerank, 4) AS pagerank, out_degree, in_degree,
        row_number() OVER (PARTITION BY repo ORDER BY round(pagerank, 4) DESC, out_degree DESC, node) AS position FROM rank JOIN deg USING (repo, node)) WHERE position <= 10""",
)
def top_hubs(t: Tables):
    n, e = staged_graph(t)
    return graph.top_hubs(graph.pagerank(n, e), graph.degree(n, e)).withColumnRenamed("rank", "position")


# entry pages: the root README and the index page with the highest rank
ENTRY = """entry AS (SELECT DISTINCT repo, 'README.md' AS node FROM doc_nodes UNION SELECT repo, arg_max(node, (round(pagerank, 12), node)) FROM rank WHERE ends_with(node, '/index.md') GROUP BY repo)"""


def entries_of(n, e):
    ranks = graph.pagerank(n, e).withColumn("pagerank", F.round("pagerank", 12))
    return stage(graph.entry_points(n, ranks), "entries")


@query("entry_points", f"WITH RECURSIVE {RANK}, {ENTRY} SELECT repo, node FROM entry")
def entry_points(t: Tables):
    return entries_of(*staged_graph(t))


@query("orphans", f"WITH RECURSIVE {RANK}, {ENTRY} SELECT repo, node FROM deg ANTI JOIN entry USING (repo, node) WHERE in_degree = 0")
def orphans(t: Tables):
    n, e = staged_graph(t)
    return graph.orphans(graph.degree(n, e), entries_of(n, e))


@query(
    "moc_validation",
    f"WITH {DEGREE} SELECT repo, node, out_degree, out_degree >= 3 AS is_structural_hub FROM deg WHERE ends_with(node, '/index.md')",
)
def moc_validation(t: Tables):
    return graph.moc_validation(graph.degree(nodes(t), t.doc_graph_edges))


ROOTS = "roots AS (SELECT DISTINCT repo, 'README.md' AS node FROM doc_nodes)"
REACH = f"""{ROOTS}, bfs AS (SELECT repo, node, 0 AS dist FROM roots UNION SELECT b.repo, e.dst, b.dist + 1 FROM bfs b JOIN doc_graph_edges e ON e.repo = b.repo AND e.src = b.node WHERE b.dist < 60),
    reach AS (SELECT repo, node, min(dist) AS dist FROM bfs GROUP BY repo, node)"""


def roots(t: Tables):
    return nodes(t).where(paths.is_entry_doc(F.col("node")))


def dist_of(t: Tables):
    n, e = staged_graph(t)
    return graph.distances(n, e, roots(t))


@query(
    "reachability",
    f"WITH RECURSIVE {REACH} SELECT n.repo, n.doc AS node, r.node IS NOT NULL AS reachable FROM doc_nodes n LEFT JOIN reach r ON r.repo = n.repo AND r.node = n.doc",
)
def reachability(t: Tables):
    return dist_of(t).select("repo", "node", F.col("dist").isNotNull().alias("reachable"))


@query(
    "hop_shells",
    f"""WITH RECURSIVE {REACH}, far AS (SELECT n.repo, n.doc AS node, row_number() OVER (PARTITION BY n.repo ORDER BY n.doc) AS pos FROM doc_nodes n ANTI JOIN reach r ON r.repo = n.repo AND r.node = n.doc),
    last AS (SELECT repo, max(dist) AS m FROM reach GROUP BY repo)
    SELECT repo, node, CAST(dist AS BIGINT) AS shell FROM reach UNION ALL
    SELECT f.repo, f.node, CAST(m + CASE WHEN pos <= 24 THEN 1 WHEN pos <= 60 THEN 2 WHEN pos <= 108 THEN 3 WHEN pos <= 168 THEN 4 WHEN pos <= 240 THEN 5 ELSE 6 END AS BIGINT) FROM far f JOIN last USING (repo)""",
)
def hop_shells(t: Tables):
    return graph.hop_shells(dist_of(t))


@query(
    "classify_node",
    f"""WITH RECURSIVE {DEGREE}, {REACH} SELECT d.repo, d.node, in_degree, out_degree, CASE WHEN d.node = 'README.md' THEN 'entry' WHEN r.node IS NOT NULL THEN 'reachable' WHEN in_degree = 0 THEN 'orphan' ELSE 'island' END AS kind
    FROM deg d LEFT JOIN reach r USING (repo, node)""",
)
def classify_node(t: Tables):
    n, e = staged_graph(t)
    return graph.classify(n, graph.degree(n, e), graph.distances(n, e, roots(t)), roots(t))


@query(
    "doc_graph_summary",
    f"""WITH RECURSIVE {DEGREE}, {REACH} SELECT d.repo, count(*) AS docs, count(*) FILTER (in_degree = 0 AND d.node <> 'README.md') AS orphans, round(count(*) FILTER (in_degree = 0 AND d.node <> 'README.md') / count(*), 6) AS orphan_rate,
        round(count(r.node) / count(*), 6) AS reachability FROM deg d LEFT JOIN reach r USING (repo, node) GROUP BY d.repo""",
)
def doc_graph_summary(t: Tables):
    n, e = staged_graph(t)
    kinds = graph.classify(n, graph.degree(n, e), graph.distances(n, e, roots(t)), roots(t))
    orphan = (F.col("in_degree") == 0) & (F.col("kind") != "entry")
    return kinds.groupBy("repo").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(orphan).alias("orphans"),
        F.round(F.avg(orphan.cast("double")), 6).alias("orphan_rate"),
        F.round(F.avg(F.col("kind").isin("entry", "reachable").cast("double")), 6).alias("reachability"),
    )


CURATED = """rawdirs AS (SELECT repo, concat('r', rk) AS dir FROM (SELECT repo, rk, avg(s_acctbal) AS b FROM pages_of_repo GROUP BY repo, rk) z WHERE b < 4500),
    inraw AS (SELECT n.repo, n.doc AS node FROM doc_nodes n JOIN rawdirs r ON r.repo = n.repo AND starts_with(n.doc, r.dir || '/'))"""


def raw_dirs(t: Tables):
    return (
        t.pages_of_repo.groupBy("repo", F.concat(F.lit("r"), "rk").alias("dir"))
        .agg(F.avg("s_acctbal").alias("b"))
        .where("b < 4500")
        .select("repo", "dir")
    )


@query(
    "curated_subgraph",
    f"WITH {CURATED} SELECT repo, src, dst FROM doc_graph_edges e WHERE (repo, src) NOT IN (SELECT (repo, node) FROM inraw) AND (repo, dst) NOT IN (SELECT (repo, node) FROM inraw)",
)
def curated_subgraph(t: Tables):
    return graph.curated_subgraph(nodes(t), t.doc_graph_edges, raw_dirs(t))[1]


@query(
    "weak_components",
    """WITH RECURSIVE und AS (SELECT repo, src AS a, dst AS b FROM doc_graph_edges UNION SELECT repo, dst, src FROM doc_graph_edges),
    lab AS (SELECT repo, doc AS node, doc AS label FROM doc_nodes UNION SELECT l.repo, u.b, l.label FROM lab l JOIN und u ON u.repo = l.repo AND u.a = l.node AND l.label < u.b)
    SELECT repo, node, min(label) AS component FROM (SELECT * FROM lab UNION ALL SELECT repo, node, node FROM lab) GROUP BY repo, node""",
)
def weak_components(t: Tables):
    return graph.weak_components(nodes(t), t.doc_graph_edges)


@query(
    "hub_staleness_join",
    f"""WITH RECURSIVE {RANK}, {STALE} SELECT r.repo, r.node AS doc, round(pagerank, 4) AS pagerank, round(code_churn * 1.0, 6)::DOUBLE AS ratio, CASE method WHEN 'repo-baseline' THEN 'low' ELSE 'high' END AS confidence,
        round(round(pagerank, 4) * code_churn, 4) AS priority FROM rank r JOIN stale s ON s.repo = r.repo AND s.doc = r.node""",
)
def hub_staleness_join(t: Tables):
    n, e = staged_graph(t)
    hubs = graph.pagerank(n, e).select("repo", F.col("node").alias("doc"), F.round("pagerank", 4).alias("pagerank"))
    out = documents.hub_staleness(hubs, staleness_of(t))
    return out.select("repo", "doc", "pagerank", r6("ratio"), "confidence", F.round("priority", 4).alias("priority"))


# --- modules ---------------------------------------------------------------


@query(
    "module_surface",
    """SELECT repo, path, count(*) FILTER (trim(text) <> '') AS size, count(*) FILTER (starts_with(text, 'def p') OR starts_with(text, 'async def f')) AS surface FROM file_lines GROUP BY repo, path""",
)
def module_surface(t: Tables):
    return structure.module_surface(t.file_lines)


PY = """py AS (SELECT DISTINCT repo, brand || '.p' || file_id AS module FROM line_facts WHERE ends_with(path, '.py') UNION SELECT DISTINCT repo, brand FROM line_facts WHERE ends_with(path, '.py')),
    imp AS (SELECT repo, brand || '.p' || file_id AS src, brand || '.p' || n AS full, pkg FROM (
        SELECT repo, brand, file_id, sk AS n, brand AS pkg FROM py_forms WHERE form IN (0, 2, 4, 6) UNION ALL SELECT repo, brand, file_id, q, brand FROM py_forms WHERE form IN (0, 4, 6)
        UNION ALL SELECT repo, brand, file_id, sk, NULL FROM py_forms WHERE form IN (1, 3) UNION ALL SELECT repo, brand, file_id, q, NULL FROM py_forms WHERE form IN (1, 3))
        UNION ALL SELECT repo, brand, brand || '.p' || min(file_id), NULL FROM line_facts WHERE ends_with(path, '.py') GROUP BY repo, brand)"""


@query(
    "import_edge_build",
    f"""WITH {PY} SELECT DISTINCT i.repo, i.src, coalesce(p.module, q.module) AS dst FROM imp i LEFT JOIN py p ON p.repo = i.repo AND p.module = i.full LEFT JOIN py q ON q.repo = i.repo AND q.module = i.pkg
        WHERE coalesce(p.module, q.module) IS NOT NULL AND coalesce(p.module, q.module) <> i.src""",
)
def import_edge_build(t: Tables):
    return structure.import_edges(t.py_lines, structure.python_modules(t.py_files))


@query("python_modules", f"WITH {PY} SELECT repo, module, NOT contains(module, '.') AS is_package FROM py")
def python_modules(t: Tables):
    return structure.python_modules(t.py_files).select("repo", "module", "is_package")


FOOT = """foot AS (SELECT m.repo, m.module, m.size, CAST(coalesce((SELECT sum(d.surface) FROM import_edges e JOIN modules d ON d.repo = e.repo AND d.module = e.dst WHERE e.repo = m.repo AND e.src = m.module), 0) AS BIGINT) AS dep_surface,
        m.surface AS exposed_surface FROM modules m)"""


@query(
    "comprehension_footprint",
    f"WITH {FOOT} SELECT *, size + dep_surface + exposed_surface AS total, size + dep_surface + exposed_surface > 900 AS over_budget FROM foot",
)
def comprehension_footprint(t: Tables):
    return structure.footprint(t.modules, t.import_edges, budget=900)


@query(
    "top_footprints",
    f"""WITH {FOOT} SELECT repo, module, total, rank FROM (SELECT repo, module, size + dep_surface + exposed_surface AS total, row_number() OVER (PARTITION BY repo ORDER BY size + dep_surface + exposed_surface DESC, module) AS rank FROM foot) WHERE rank <= 200""",
)
def top_footprints(t: Tables):
    return structure.top_footprints(structure.footprint(t.modules, t.import_edges)).select("repo", "module", "total", "rank")


CROSS = """cross_e AS (SELECT repo, src, dst, NOT contains(dst, '.') AS door FROM import_edges WHERE split_part(src, '.', 1) <> split_part(dst, '.', 1))"""


@query("front_door_ratio", f"WITH {CROSS} SELECT repo, round(count(*) FILTER (door) / count(*), 6) AS front_door_ratio FROM cross_e GROUP BY repo")
def front_door_ratio(t: Tables):
    return structure.front_door_ratio(t.import_edges, t.modules).select("repo", r6("front_door_ratio"))


@query(
    "burrow_edges",
    f"WITH {CROSS} SELECT repo, src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY src, dst) AS rank FROM cross_e WHERE NOT door) WHERE rank <= 100",
)
def burrow_edges(t: Tables):
    return structure.burrow_edges(t.import_edges, t.modules)


@query(
    "modularity_q",
    """WITH u AS (SELECT DISTINCT repo, least(src, dst) AS a, greatest(src, dst) AS b FROM import_edges WHERE src <> dst), m AS (SELECT repo, count(*) AS m FROM u GROUP BY repo),
    e AS (SELECT repo, split_part(a, '.', 1) AS ca, split_part(b, '.', 1) AS cb FROM u), d AS (SELECT repo, c, count(*) AS d FROM (SELECT repo, ca AS c FROM e UNION ALL SELECT repo, cb FROM e) GROUP BY repo, c),
    l AS (SELECT repo, ca AS c, count(*) AS l FROM e WHERE ca = cb GROUP BY repo, ca)
    SELECT d.repo, round(sum(coalesce(l.l, 0) / m.m - power(d.d / (2.0 * m.m), 2)), 6) AS modularity_q FROM d JOIN m USING (repo) LEFT JOIN l USING (repo, c) GROUP BY d.repo""",
)
def modularity_q(t: Tables):
    part = t.modules.select("repo", F.col("module").alias("node"), F.col("package").alias("community"))
    return graph.modularity_q(t.import_edges, part).select("repo", r6("modularity_q"))


@query(
    "strong_components",
    """WITH RECURSIVE closure AS (SELECT repo, src AS a, dst AS b FROM import_edges UNION SELECT c.repo, c.a, e.dst FROM closure c JOIN import_edges e ON e.repo = c.repo AND e.src = c.b),
    mutual AS (SELECT x.repo, x.a AS node, x.b AS other FROM closure x JOIN closure y ON y.repo = x.repo AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
    lab AS (SELECT repo, node, least(node, min(other)) AS component FROM mutual GROUP BY repo, node)
    SELECT repo, node, component, count(*) OVER (PARTITION BY repo, component) AS size FROM lab""",
)
def strong_components(t: Tables):
    return graph.strong_components(t.import_edges)


@query("communities")
def communities(t: Tables):
    n = t.modules.select("repo", F.col("module").alias("node"))
    return graph.communities(n, t.import_edges)


def canonical(part):
    """Communities named by their smallest member."""
    first = part.groupBy("repo", "community").agg(F.min("node").alias("first"))
    return part.join(first, ["repo", "community"]).select("repo", "node", F.col("first").alias("community"))


@query("communities_of_groups", "SELECT repo, module AS node, min(module) OVER (PARTITION BY repo, brand, grp) AS community FROM triples")
def communities_of_groups(t: Tables):
    return canonical(graph.communities(t.triples.select("repo", F.col("module").alias("node")), t.triple_edges))


@query(
    "communities_check",
    "SELECT repo, count(*) AS nodes, count(*) AS labelled, 0 AS gaining_merges FROM modules GROUP BY repo",
)
def communities_check(t: Tables):
    """Each module has one label, and no two communities are better merged."""
    n = t.modules.select("repo", F.col("module").alias("node"))
    edges = stage(t.import_edges, "edges")
    part = stage(graph.communities(n, edges), "communities")
    links = graph.undirected(edges)
    m = links.groupBy("repo").agg(F.count(F.lit(1)).alias("m"))
    side = lambda c: part.select("repo", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    ends = links.join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b"])
    degree = ends.select("repo", F.explode(F.array("ca", "cb")).alias("c")).groupBy("repo", "c").agg(F.count(F.lit(1)).alias("d"))
    between = ends.where("ca <> cb").groupBy("repo", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.count(F.lit(1)).alias("w"))
    of = lambda c: degree.select("repo", F.col("c").alias(f"c{c}"), F.col("d").alias(f"d{c}"))
    gain = F.round(F.col("w") / F.col("m") - F.col("da") * F.col("db") / (2.0 * F.col("m") * F.col("m")), 12)
    gaining = between.join(of("a"), ["repo", "ca"]).join(of("b"), ["repo", "cb"]).join(m, "repo").where(gain > 0)
    merges = gaining.groupBy("repo").agg(F.count(F.lit(1)).alias("gaining"))
    counted = n.join(part, ["repo", "node"], "left").groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.count("community").alias("labelled"))
    return counted.join(merges, "repo", "left").select("repo", "nodes", "labelled", F.coalesce("gaining", F.lit(0)).cast("int").alias("gaining_merges"))


@query(
    "breakup_of_groups",
    f"""WITH e AS (SELECT repo, brand, grp, count(*) AS e FROM triple_edges GROUP BY ALL), q AS (SELECT repo, brand, 1 - sum(power(e / m, 2)) AS q FROM (SELECT *, sum(e) OVER (PARTITION BY repo, brand) AS m FROM e) GROUP BY ALL),
    s AS (SELECT repo, brand, count(*) AS modules, count(DISTINCT grp) AS clusters FROM triples GROUP BY ALL)
    SELECT s.repo, s.brand AS package, modules, clusters, round(q, 6) AS modularity_q FROM s JOIN q USING (repo, brand) WHERE modules >= {fv.BREAKUP_MIN_MODULES} AND clusters >= 2 AND q >= {fv.BREAKUP_MIN_Q}""",
)
def breakup_of_groups(t: Tables):
    found = structure.breakup_candidates(t.triples.select("repo", "module"), t.triple_edges)[0]
    return found.select("repo", "package", "modules", "clusters", r6("modularity_q"))


@query("breakup_candidates")
def breakup_candidates(t: Tables):
    return structure.breakup_candidates(t.modules, t.import_edges)[0]


# --- work items ------------------------------------------------------------


@query(
    "dependency_levels",
    "SELECT repo, item, CAST(CASE WHEN NOT looped THEN rn - 1 END AS INT) AS level FROM work_chain",
)
def dependency_levels(t: Tables):
    return graph.dependency_levels(t.work_deps)


@query(
    "critical_path",
    """WITH l AS (SELECT repo, CASE WHEN NOT looped THEN rn - 1 END AS level FROM work_chain)
       SELECT repo, CAST(max(level) + 1 AS INT) AS critical_path, count(*) FILTER (level = 0) AS first_wave FROM l GROUP BY repo""",
)
def critical_path(t: Tables):
    return graph.dependency_levels(t.work_deps).groupBy("repo").agg(
        (F.max("level") + 1).alias("critical_path"), F.count_if(F.col("level") == 0).alias("first_wave")
    )


@query(
    "hot_files",
    "SELECT repo, path, count(DISTINCT item) AS n_items, count(DISTINCT item) >= 5 AS contended FROM item_files GROUP BY repo, path HAVING count(DISTINCT item) >= 2",
)
def hot_files(t: Tables):
    return graph.hot_files(t.item_files)


@query(
    "hot_file_groups",
    """WITH RECURSIVE bip AS (SELECT repo, item, path FROM item_files),
    lab AS (SELECT repo, item, item AS label FROM (SELECT DISTINCT repo, item FROM bip) UNION SELECT l.repo, b.item, l.label FROM lab l JOIN bip a ON a.repo = l.repo AND a.item = l.item JOIN bip b ON b.repo = a.repo AND b.path = a.path AND l.label < b.item)
    SELECT repo, item, min(label) AS "group" FROM lab GROUP BY repo, item""",
)
def hot_file_groups(t: Tables):
    return graph.hot_file_groups(t.item_files)

