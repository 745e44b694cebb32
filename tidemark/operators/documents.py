"""Which document explains which code, and how stale it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, text
from tidemark.scale import salted_lookup, skewed_join
from tidemark.staging import stage


def base_doc_pick(docs: DataFrame) -> DataFrame:
    """One base document per directory by precedence, then path (2.5.7)."""
    order = F.array(*[F.lit(n) for n in fv.BASE_DOC_PRECEDENCE])
    name = F.lower(paths.basename(F.col("path")))
    rank = F.when(name.isin(fv.BASE_DOC_PRECEDENCE), F.array_position(order, name)).otherwise(F.lit(99))
    base = docs.where(paths.is_base_doc(F.col("path")))
    return base.groupBy("repo", paths.parent(F.col("path")).alias("dir")).agg(
        F.min_by("path", F.struct(rank, F.col("path"))).alias("doc")
    )


def deepest_doc_pick(docs: DataFrame) -> DataFrame:
    """Any document covers its directory; the larger path wins a tie."""
    return docs.groupBy("repo", paths.parent(F.col("path")).alias("dir")).agg(F.max("path").alias("doc"))


def nearest_ancestor(code: DataFrame, dir_docs: DataFrame) -> DataFrame:
    """Code files with the document of the nearest directory above (2.3.2).

    Ancestors are exploded once per directory, not per file, and the deepest
    match is a maximum, so neither a big directory nor a deep tree piles up.
    """
    dirs = code.select("repo", paths.parent(F.col("path")).alias("code_dir")).distinct()
    candidates = dirs.select("repo", "code_dir", F.explode(paths.self_and_ancestors(F.col("code_dir"))).alias("dir"))
    owners = (
        skewed_join(candidates, dir_docs.select("repo", "dir", "doc"), ["repo", "dir"])
        .groupBy("repo", "code_dir")
        .agg(F.max_by("doc", paths.depth(F.col("dir"))).alias("doc"))
    )
    keyed = code.withColumn("code_dir", paths.parent(F.col("path")))
    return skewed_join(keyed, owners, ["repo", "code_dir"]).drop("code_dir")


def parallel_docs(docs: DataFrame, code: DataFrame) -> DataFrame:
    """``docs/<name>.md`` or ``docs/<name>/x.md`` to the shallowest code directory of that name (2.3.3)."""
    dirs = code.select("repo", paths.parent(F.col("path")).alias("dir")).distinct()
    by_name = dirs.groupBy("repo", F.lower(paths.basename(F.col("dir"))).alias("name")).agg(
        F.min(F.struct(paths.depth(F.col("dir")).alias("depth"), F.col("dir"))).alias("best")
    )
    in_docs = docs.where(F.array_contains(F.transform(paths.parts(F.col("path")), F.lower), "docs"))
    names = in_docs.select(
        "repo",
        F.col("path").alias("doc"),
        F.explode(
            F.array_distinct(
                F.array(
                    F.lower(paths.stem(F.col("path"))), F.lower(paths.basename(paths.parent(F.col("path"))))
                )
            )
        ).alias("name"),
    )
    return (
        skewed_join(names, by_name, ["repo", "name"])
        .groupBy("repo", "doc")
        .agg(F.min("best").alias("best"))
        .select("repo", "doc", F.col("best.dir").alias("dir"))
    )


def staleness(
    docs: DataFrame,
    code: DataFrame,
    churn: DataFrame,
    doc_code_edges: DataFrame,
    provenance: DataFrame | None = None,
) -> DataFrame:
    """Churn of the code a document is about over its own churn (2.4.18).

    The subject is the code the document owns, else its parallel directory,
    else its explicit links, else the whole repository at low confidence.
    ``provenance(repo, doc, source_newer)`` overrides the ratio of documents
    generated from sources that have not changed since.
    """
    churn = stage(churn.select("repo", "path", "commits"), "churn")
    counted = code.select("repo", "path").join(churn, ["repo", "path"], "left")
    counted = stage(counted.withColumn("commits", F.coalesce("commits", F.lit(0))), "code")
    docs = stage(docs.select("repo", "path"), "docs")

    def subject(df: DataFrame, method: str, rank: int) -> DataFrame:
        return df.select(
            "repo",
            "doc",
            F.struct(
                F.lit(rank).alias("rank"), F.lit(method).alias("method"), F.col("n").alias("n"), F.col("churn").alias("churn")
            ).alias("s"),
        )

    totals = [F.count(F.lit(1)).alias("n"), F.sum("commits").alias("churn")]
    owned = nearest_ancestor(counted, base_doc_pick(docs)).groupBy("repo", "doc").agg(*totals)
    per_dir = (
        counted.groupBy("repo", paths.parent(F.col("path")).alias("dir"))
        .agg(*totals)
        .select("repo", "n", "churn", F.explode(paths.self_and_ancestors(F.col("dir"))).alias("dir"))
        .groupBy("repo", "dir")
        .agg(F.sum("n").alias("n"), F.sum("churn").alias("churn"))
    )
    parallel = skewed_join(parallel_docs(docs, counted), per_dir, ["repo", "dir"])
    links = doc_code_edges.select("repo", "doc", F.col("code").alias("path")).distinct()
    explicit = (
        skewed_join(links, churn, ["repo", "path"], "left")
        .withColumn("commits", F.coalesce("commits", F.lit(0)))
        .groupBy("repo", "doc")
        .agg(*totals)
    )
    best = (
        subject(owned, "nearest-ancestor", 1)
        .unionByName(subject(parallel, "parallel-docs-tree", 2))
        .unionByName(subject(explicit, "explicit-links", 3))
        .groupBy("repo", "doc")
        .agg(F.min("s").alias("s"))
    )
    whole = counted.groupBy("repo").agg(F.count(F.lit(1)).alias("all_n"), F.sum("commits").alias("all_churn"))
    rows = docs.select("repo", F.col("path").alias("doc")).distinct()
    rows = rows.join(best, ["repo", "doc"], "left")
    rows = rows.join(
        churn.select("repo", F.col("path").alias("doc"), F.col("commits").alias("own")), ["repo", "doc"], "left"
    )
    rows = salted_lookup(rows, whole, ["repo"])
    if provenance is not None:
        rows = rows.join(provenance.select("repo", "doc", "source_newer"), ["repo", "doc"], "left")
    else:
        rows = rows.withColumn("source_newer", F.lit(None).cast("boolean"))
    zero = F.lit(0).cast("long")
    code_churn = F.coalesce(F.col("s.churn"), F.col("all_churn"), zero)
    doc_churn = F.coalesce("own", zero)
    method = F.coalesce(F.col("s.method"), F.lit("repo-baseline"))
    return rows.select(
        "repo",
        "doc",
        method.alias("method"),
        F.coalesce(F.col("s.n"), F.col("all_n"), zero).alias("subject_count"),
        code_churn.alias("code_churn"),
        doc_churn.alias("doc_churn"),
        F.when(~F.col("source_newer"), F.lit(0.0))
        .otherwise(code_churn / F.greatest(doc_churn, F.lit(1)))
        .alias("ratio"),
        F.when(method == "repo-baseline", "low").otherwise("high").alias("confidence"),
        "source_newer",
    )


def association_summary(docs: DataFrame, code: DataFrame, stale: DataFrame) -> DataFrame:
    """How much code sits under a base document, and how many documents map to code (2.4.19)."""
    base = base_doc_pick(docs)
    under = nearest_ancestor(code.select("repo", "path"), base).groupBy("repo").agg(
        F.count(F.lit(1)).alias("code_under_base")
    )
    files = code.groupBy("repo").agg(F.count(F.lit(1)).alias("code_files"))
    code_dirs = (
        code.select("repo", paths.parent(F.col("path")).alias("dir")).distinct().groupBy("repo").agg(
            F.count(F.lit(1)).alias("code_dirs")
        )
    )
    base_dirs = base.groupBy("repo").agg(F.count(F.lit(1)).alias("base_dirs"))
    methods = stale.groupBy("repo").agg(
        F.count(F.lit(1)).alias("docs"),
        *[
            F.count_if(F.col("method") == m).alias(m.replace("-", "_"))
            for m in ("nearest-ancestor", "parallel-docs-tree", "explicit-links", "repo-baseline")
        ],
    )
    out = methods.join(files, "repo", "left").join(under, "repo", "left").join(code_dirs, "repo", "left")
    out = out.join(base_dirs, "repo", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(
        "repo",
        "docs",
        "code_files",
        "nearest_ancestor",
        "parallel_docs_tree",
        "explicit_links",
        "repo_baseline",
        ratio("code_under_base", "code_files").alias("pct_code_under_base"),
        F.coalesce(F.try_divide(F.col("docs") - F.col("repo_baseline"), F.col("docs")), F.lit(0.0)).alias("pct_docs_mapping"),
        ratio("base_dirs", "code_dirs").alias("base_doc_dir_ratio"),
        (F.col("code_files") >= fv.LARGE_REPO_CODE_FILES).alias("large_repo"),
    )


def _resolve_sources(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Sources as written, tried from the root and then from the document."""
    tries = wanted.withColumn("raw", F.regexp_replace(F.trim("raw"), "^/+", "")).where(F.col("raw") != "")
    tries = tries.withColumn(
        "t",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("rank"), paths.normalize_link(F.lit(""), F.col("raw")).alias("path")),
                F.struct(F.lit(2).alias("rank"), paths.normalize_link(F.col("doc"), F.col("raw")).alias("path")),
            )
        ),
    ).select("*", F.col("t.rank").alias("rank"), F.col("t.path").alias("path"))
    keep = [c for c in wanted.columns if c != "raw"]
    return (
        skewed_join(tries, files.select("repo", "path"), ["repo", "path"])
        .groupBy(*keep, "raw")
        .agg(F.min_by("path", "rank").alias("source"))
    )


def provenance(texts: DataFrame, files: DataFrame, config: DataFrame) -> DataFrame:
    """Declared sources of generated documents (2.3.24).

    Frontmatter first; else the first configured prefix, in declaration order,
    with a source that exists. ``config(repo, ordinal, prefix, source)``.
    """
    stated = texts.select(
        "repo", F.col("path").alias("doc"), F.explode(text.provenance_sources(F.col("text"))).alias("raw")
    )
    front = _resolve_sources(stated, files).select("repo", "doc", "source", F.lit("frontmatter").alias("method"))
    front = stage(front, "stated")
    above = texts.select(
        "repo",
        F.col("path").alias("doc"),
        F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("prefix"),
    ).distinct()
    rules = stage(config, "config").select("repo", "ordinal", F.regexp_replace("prefix", "^/+|/+$", "").alias("prefix"), F.col("source").alias("raw"))
    ruled = skewed_join(above, rules, ["repo", "prefix"]).select("repo", "doc", "ordinal", "raw")
    resolved = stage(_resolve_sources(ruled, files), "resolved")
    first = resolved.groupBy("repo", "doc").agg(F.min("ordinal").alias("ordinal"))
    configured = resolved.join(first, ["repo", "doc", "ordinal"]).select(
        "repo", "doc", "source", F.lit("config").alias("method")
    )
    rest = configured.join(front.select("repo", "doc").distinct(), ["repo", "doc"], "left_anti")
    return front.unionByName(rest).distinct()


def source_newer(sources: DataFrame, last_change: DataFrame) -> DataFrame:
    """Whether any source changed after its document (2.11.11).

    ``sources(repo, doc, source)``, ``last_change(repo, path, ts)``.
    """
    dated = skewed_join(
        sources.select("repo", "doc", F.col("source").alias("path")), last_change, ["repo", "path"], "left"
    )
    newest = dated.groupBy("repo", "doc").agg(F.max("ts").alias("source_ts"))
    own = last_change.select("repo", F.col("path").alias("doc"), F.col("ts").alias("doc_ts"))
    return newest.join(own, ["repo", "doc"], "left").select(
        "repo", "doc", (F.col("source_ts") > F.col("doc_ts")).alias("source_newer")
    )


def raw_tree_density(doc_signals: DataFrame) -> DataFrame:
    """Directories of unlinked machine-made documents (2.4.20).

    ``doc_signals(repo, path, in_degree, out_degree, machine_links, is_entry)``.
    """
    isolated = ~F.col("is_entry") & (F.col("in_degree") == 0) & (F.col("out_degree") == 0)
    per_dir = doc_signals.groupBy("repo", paths.parent(F.col("path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(isolated).alias("isolated"),
        F.count_if(F.col("machine_links") > 0).alias("machine"),
    )
    trees = (
        per_dir.select("*", F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("tree"))
        .where(F.col("tree") != "")
        .groupBy("repo", F.col("tree").alias("dir"))
        .agg(F.sum("n").alias("file_count"), F.sum("isolated").alias("isolated"), F.sum("machine").alias("machine"))
    )
    return trees.where(
        (F.col("file_count") >= fv.RAW_TREE_MIN_FILES)
        & (F.col("isolated") / F.col("file_count") >= fv.RAW_TREE_ISOLATION)
        & (F.col("machine") / F.col("file_count") >= fv.RAW_TREE_MACHINE)
    ).select("repo", "dir", "file_count")


def outermost(dirs: DataFrame) -> DataFrame:
    """Directories without a qualifying directory above them (2.5.9)."""
    above = dirs.select("repo", "dir", F.explode(paths.ancestors(F.col("dir"))).alias("above"))
    nested = skewed_join(
        above, dirs.select("repo", F.col("dir").alias("above")), ["repo", "above"], "left_semi"
    ).select("repo", "dir")
    return dirs.join(nested, ["repo", "dir"], "left_anti")


def hub_staleness(hubs: DataFrame, stale: DataFrame) -> DataFrame:
    """Central documents by rank times staleness; low confidence counts half (2.3.17)."""
    joined = hubs.join(stale, ["repo", "doc"])
    priority = F.col("pagerank") * F.col("ratio")
    weight = F.when(F.col("confidence") == "low", 0.5).otherwise(1.0)
    return joined.select("repo", "doc", "pagerank", "ratio", "confidence", priority.alias("priority"), (priority * weight).alias("sort_key"))
