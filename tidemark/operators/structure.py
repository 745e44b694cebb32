"""Module structure: imports, footprints, front doors, break-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.operators import graph
from tidemark.scale import carry_forward, running_sum, skewed_join, top_k


def module_surface(lines: DataFrame) -> DataFrame:
    """Non-blank lines and public top-level definitions per file (2.4.25).

    A pattern on column zero stands in for a syntax tree.
    """
    public = F.col("text").rlike(r"^(async )?(def|class)\s+[A-Za-z]")
    return lines.groupBy("repo", "path").agg(
        F.count_if(F.trim("text") != "").alias("size"), F.count_if(public).alias("surface")
    )


def python_modules(files: DataFrame) -> DataFrame:
    """``repo, path, module, is_package`` of the Python files inside packages, wherever those lie.

    A directory with an ``__init__.py`` is a package; a name starts at the
    outermost package of an unbroken chain, so ``src/pkg/m.py`` is ``pkg.m``
    when ``src`` is none. Files outside packages have no module.
    """
    python = files.where(F.endswith("path", F.lit(".py"))).select("repo", "path").distinct()
    where = python.withColumn("dir", paths.parent(F.col("path")))
    packages = where.where(paths.basename(F.col("path")) == "__init__.py").select("repo", "dir", F.lit(True).alias("is_pkg"))
    dirs = where.where("dir <> ''").select("repo", "dir").distinct()
    chain = dirs.select("repo", F.col("dir").alias("leaf"), F.posexplode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("depth", "dir"))
    broken = (
        skewed_join(chain.where("dir <> ''"), packages, ["repo", "dir"], "left")
        .groupBy("repo", F.col("leaf").alias("dir"))
        .agg(F.max(F.when(F.col("is_pkg").isNull(), F.size(F.split("dir", "/")))).alias("outside"), F.bool_or((F.col("dir") == F.col("leaf")) & F.col("is_pkg")).alias("inside"))
    )
    named = skewed_join(where, broken.where("inside"), ["repo", "dir"])
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    module = F.array_join(F.slice(parts, F.coalesce("outside", F.lit(0)) + 1, F.size(parts)), ".")
    return named.select("repo", "path", module.alias("module"), (paths.basename(F.col("path")) == "__init__.py").alias("is_package"))


OPENS = r"^\s*from\s+\S+\s+import\s*\([^)]*$"


def _joined_lines(code: DataFrame, chunk_lines: int) -> DataFrame:
    """Lines that end with a backslash together with those that go on with them, under the first one's number.

    Only files with such a line are regrouped, chunk by chunk; others pass as they are.
    """
    going_on = F.col("text").rlike(r"\\\s*$")
    files = code.where(going_on).select("repo", "path").distinct()
    rows = code.join(files, ["repo", "path"], "left_semi").withColumns({"_chunk": F.floor(F.col("line_no") / chunk_lines), "_end": (~going_on).cast("int")})
    counted = running_sum(rows, ["repo", "path"], "_chunk", ["line_no"], "_end", "_upto")
    pieces = F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("text", r"\\\s*$", " ").alias("text"))))
    whole = counted.groupBy("repo", "path", (F.col("_upto") - F.col("_end")).alias("_line")).agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))
    return code.join(files, ["repo", "path"], "left_anti").unionByName(whole.select("repo", "path", "line_no", "text"))


def import_statements(lines: DataFrame, chunk_lines: int = 10_000) -> DataFrame:
    """``repo, path, line_no, statement``: one import statement per row.

    Comments go, lines that a backslash joins are one, ``;`` parts statements, and each line inside parentheses that an
    import opened becomes a statement with that import's head. Long files are
    carried chunk by chunk.
    """
    code = _joined_lines(lines.select("repo", "path", "line_no", F.regexp_replace("text", r"\s*#.*$", "").alias("text")), chunk_lines)
    plain = code.where(F.col("text").rlike(r"(^|;)\s*(import|from)\s"))
    single = plain.where(~F.col("text").rlike(OPENS)).select(
        "repo", "path", "line_no", F.explode(F.split(F.translate("text", "()", ""), ";")).alias("statement")
    )
    opened = skewed_join(code, code.where(F.col("text").rlike(OPENS)).select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    head = F.regexp_extract("text", r"^\s*(from\s+\S+\s+import)\s*\(", 1)
    # an event before a line opens a list, one after it closes the list
    events = opened.select(
        "*", F.explode(F.array(
            F.struct((F.col("line_no") * 2).alias("at"), F.when(F.col("text").rlike(OPENS), head).alias("mark"), F.lit(True).alias("is_line")),
            F.struct((F.col("line_no") * 2 + 1).alias("at"), F.when(F.contains("text", F.lit(")")), F.lit("")).alias("mark"), F.lit(False).alias("is_line")),
        )).alias("e")
    ).select("repo", "path", "line_no", "text", "e.*")
    carried = carry_forward(events.withColumn("chunk", F.floor(F.col("at") / (2 * chunk_lines))), ["repo", "path"], "chunk", ["at"], "mark", "head")
    names = F.translate(F.regexp_replace("text", r"^\s*from\s+\S+\s+import\s*\(", ""), "()", "")
    inside = carried.where("is_line AND head <> ''").select("repo", "path", "line_no", F.concat_ws(" ", "head", names).alias("statement"))
    return single.unionByName(inside).where(F.col("statement").rlike(r"^\s*(import|from)\s"))


def import_edges(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports between known modules (2.9.2).

    ``lines(repo, path, line_no, text)``; ``modules`` as ``python_modules`` makes
    them. Every name of a statement counts, by its real name. ``from a import b``
    is an import of ``a.b`` when that is a module, else of ``a``. Relative
    imports start at the importer's package, which is the importer itself if it is one.
    """
    importers = modules.select("repo", "path", F.col("module").alias("src"), "is_package")
    rows = skewed_join(import_statements(lines), importers, ["repo", "path"])
    statement = F.trim("statement")
    source = F.regexp_extract(statement, r"^from\s+(\.*[\w.]*)\s+import\b", 1)
    listed = F.regexp_replace(statement, r"^(from\s+\.*[\w.]*\s+import|import)\b", "")
    names = F.filter(
        F.transform(F.split(listed, ","), lambda x: F.regexp_extract(x, r"^\s*([\w.*]+)", 1)), lambda x: x != ""
    )
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    tail = F.regexp_replace(source, r"^\.+", "")
    parts = F.split("src", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + F.when(F.col("is_package"), 1).otherwise(0), F.lit(0))), ".")
    absolute = F.when(dots == 0, tail).otherwise(F.array_join(F.filter(F.array(base, tail), lambda x: x != ""), "."))
    each = rows.select(
        "repo", "src", "path", "line_no", F.startswith(statement, F.lit("from")).alias("is_from"), absolute.alias("absolute"), statement.alias("statement"),
        F.explode(F.array_distinct(names)).alias("name"),
    )
    joined = F.array_join(F.filter(F.array("absolute", F.when(F.col("name") != "*", F.col("name"))), lambda x: x.isNotNull() & (x != "")), ".")
    wanted = F.when(F.col("is_from"), F.array(joined, "absolute")).otherwise(F.array("name"))
    tries = each.select("*", F.posexplode(wanted).alias("rank", "dst")).where("dst <> ''")
    known = modules.select("repo", F.col("module").alias("dst")).distinct()
    hit = skewed_join(tries, known, ["repo", "dst"])
    # both readings of a name are tried; the more precise one wins
    best = hit.groupBy("repo", "src", "path", "line_no", "statement", "name").agg(F.min_by("dst", "rank").alias("dst"))
    return best.where(F.col("src") != F.col("dst")).select("repo", "src", "dst").distinct()


def footprint(modules: DataFrame, edges: DataFrame, budget: int = fv.FOOTPRINT_BUDGET) -> DataFrame:
    """Own size, surface of direct imports and own surface (2.4.24)."""
    surfaces = modules.select("repo", F.col("module").alias("dst"), "surface")
    deps = (
        skewed_join(edges.select("repo", "src", "dst").distinct(), surfaces, ["repo", "dst"])
        .groupBy("repo", F.col("src").alias("module"))
        .agg(F.sum("surface").alias("dep_surface"))
    )
    rows = modules.join(deps, ["repo", "module"], "left").withColumn("dep_surface", F.coalesce("dep_surface", F.lit(0)))
    total = F.col("size") + F.col("dep_surface") + F.col("surface")
    return rows.select(
        "repo", "module", "size", "dep_surface", F.col("surface").alias("exposed_surface"), total.alias("total"),
        (total > budget).alias("over_budget"),
    )


def top_footprints(footprints: DataFrame, k: int = fv.MAX_FOOTPRINTS) -> DataFrame:
    return top_k(footprints, ["repo"], [F.desc("total"), F.asc("module")], k)


def _cross(edges: DataFrame, modules: DataFrame) -> DataFrame:
    top = lambda c: F.element_at(F.split(c, r"\."), 1)
    crossing = edges.where(top("src") != top("dst"))
    doors = modules.where("is_package").select("repo", F.col("module").alias("dst"), F.lit(True).alias("door"))
    return skewed_join(crossing, doors, ["repo", "dst"], "left").withColumn("door", F.coalesce("door", F.lit(False)))


def front_door_ratio(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Share of cross-package imports that land on a package; none counts as 1 (2.4.23)."""
    ratio = _cross(edges, modules).groupBy("repo").agg(F.avg(F.col("door").cast("double")).alias("ratio"))
    every = modules.select("repo").distinct()
    return every.join(ratio, "repo", "left").select("repo", F.coalesce("ratio", F.lit(1.0)).alias("front_door_ratio"))


def burrow_edges(edges: DataFrame, modules: DataFrame, k: int = fv.MAX_BURROW_EDGES) -> DataFrame:
    """Cross-package imports that bypass the package."""
    inside = _cross(edges, modules).where(~F.col("door")).select("repo", "src", "dst")
    return top_k(inside, ["repo"], [F.asc("src"), F.asc("dst")], k)


def breakup_candidates(modules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages that fall into clear clusters, and those clusters (2.9.15).

    All packages are clustered in one run: the package is part of the key.
    """
    top = lambda c: F.element_at(F.split(c, r"\."), 1)
    group = lambda c: F.concat_ws("\x1f", F.col("repo"), top(c))
    nodes = modules.select(group("module").alias("repo"), F.col("module").alias("node")).distinct()
    inner = edges.where(top("src") == top("dst")).select(group("src").alias("repo"), "src", "dst")
    # one statement: clusters of all packages at once
    part = graph.communities(nodes, inner)
    q = graph.modularity_q(inner, part)
    size = part.groupBy("repo").agg(F.count(F.lit(1)).alias("modules"), F.count_distinct("community").alias("clusters"))
    good = q.join(size, "repo").where(
        (F.col("modules") >= fv.BREAKUP_MIN_MODULES)
        & (F.col("clusters") >= 2)
        & (F.col("modularity_q") >= fv.BREAKUP_MIN_Q)
    )
    keys = lambda c: (F.split(c, "\x1f")[0].alias("repo"), F.split(c, "\x1f")[1].alias("package"))
    members = part.join(good.select("repo"), "repo", "left_semi")
    return (
        good.select(*keys("repo"), "modules", "clusters", "modularity_q"),
        members.select(*keys("repo"), F.col("node").alias("module"), F.col("community").alias("cluster")),
    )


def directory_partition(files: DataFrame) -> DataFrame:
    """The partition a directory tree already declares."""
    return files.select("repo", F.col("path").alias("node"), paths.parent(F.col("path")).alias("community"))
