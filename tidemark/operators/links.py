"""Links between documents: extraction, resolution, edges.

Texts are ``(repo, path, text)``; a document may come in several rows as long
as no fenced block is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths, text
from tidemark.scale import skewed_join
from tidemark.staging import stage


def extract_links(texts: DataFrame) -> DataFrame:
    """Distinct links of every document outside code, both forms."""
    body = text.strip_code_spans(F.col("text"))
    tagged = F.concat(
        F.transform(text.wikilinks(body), lambda r: F.struct(F.lit("wikilink").alias("kind"), r.alias("raw"))),
        F.transform(text.mdlinks(body), lambda r: F.struct(F.lit("mdlink").alias("kind"), r.alias("raw"))),
    )
    return (
        texts.select("repo", F.col("path").alias("src"), F.explode(tagged).alias("l"))
        .select("repo", "src", "l.kind", "l.raw")
        .distinct()
        .withColumn("target", paths.strip_anchor_alias(F.col("raw")))
    )


def machine_links(links: DataFrame) -> DataFrame:
    """Links with a URI scheme, per document (2.2.11)."""
    external = links.where(paths.is_external(F.col("target")))
    return external.groupBy("repo", "src").agg(F.count(F.lit(1)).alias("machine_links"))


def resolve_mdlinks(links: DataFrame, files: DataFrame) -> DataFrame:
    """Relative and root-absolute targets matched to files (2.3.8).

    ``status`` is ``file``, ``directory`` (exists, but is no edge) or ``broken``.
    """
    md = links.where(
        (F.col("kind") == "mdlink")
        & ~F.startswith(F.trim("raw"), F.lit("#"))
        & (F.col("target") != "")
        & ~paths.is_external(F.col("target"))
    ).withColumn("dst", paths.normalize_link(F.col("src"), F.col("target")))
    file_rows = files.select("repo", F.col("path").alias("dst"), F.lit("file").alias("status"))
    dirs = files.select("repo", paths.parent(F.col("path")).alias("dir")).distinct()
    dir_rows = dirs.select(
        "repo", F.explode(paths.self_and_ancestors(F.col("dir"))).alias("dst"), F.lit("directory").alias("status")
    ).distinct()
    known = file_rows.unionByName(dir_rows)
    return skewed_join(md, known, ["repo", "dst"], "left").withColumn("status", F.coalesce("status", F.lit("broken")))


def _name_index(docs: DataFrame) -> DataFrame:
    """Every key a wikilink may use for a document."""
    rel, name, stem = F.lower("path"), F.lower(paths.basename(F.col("path"))), F.lower(paths.stem(F.col("path")))
    bare = F.regexp_replace(rel, r"^(.*[^/])\.[^./]+$", "$1")

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("index"), value.alias("key"))

    return docs.select(
        "repo", "path", F.explode(F.array(key("rel", rel), key("rel", bare), key("name", name), key("stem", stem))).alias("k")
    ).select("repo", "path", "k.*")


def resolve_wikilinks(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Wikilink targets by path, name, name plus ``.md``, stem (2.3.7).

    Candidates of a key are summarised (how many, the first, the one in each
    directory) before any link meets them, so a name shared by many documents
    never multiplies the links that use it.
    """
    wiki = links.where(
        (F.col("kind") == "wikilink") & (F.col("target") != "") & ~paths.is_external(F.col("target"))
    ).select("repo", "src", "target").distinct()
    wiki = stage(wiki, "wikilinks")
    key = F.lower("target")
    slashed = F.contains("target", F.lit("/")) | F.contains("target", F.lit("\\"))

    def probe(level: int, index: str, value: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(index).alias("index"), value.alias("key"))

    probes = wiki.select(
        "repo",
        "src",
        "target",
        paths.parent(F.col("src")).alias("dir"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(slashed, probe(0, "rel", F.replace(key, F.lit("\\"), F.lit("/")))),
                    probe(1, "name", key),
                    probe(2, "name", F.concat(key, F.lit(".md"))),
                    probe(3, "stem", key),
                )
            )
        ).alias("p"),
    ).select("repo", "src", "target", "dir", "p.*")
    index = stage(_name_index(docs), "names")
    whole = index.groupBy("repo", "index", "key").agg(
        F.when(F.first("index") == "rel", 1).otherwise(F.count(F.lit(1))).alias("n"),
        F.when(F.first("index") == "rel", F.max("path")).otherwise(F.min("path")).alias("first"),
    )
    local = (
        index.where(F.col("index") != "rel")
        .groupBy("repo", "index", "key", paths.parent(F.col("path")).alias("dir"))
        .agg(F.count(F.lit(1)).alias("n_here"), F.min("path").alias("here"))
        .where(F.col("n_here") == 1)
        .select("repo", "index", "key", "dir", "here")
    )
    found = skewed_join(probes, whole, ["repo", "index", "key"]).join(local, ["repo", "index", "key", "dir"], "left")
    best = found.groupBy("repo", "src", "target").agg(
        F.min(F.struct("level", "n", "first", "here")).alias("b")
    )
    dst = F.when(F.col("b.n") == 1, F.col("b.first")).otherwise(F.coalesce("b.here", "b.first"))
    return wiki.join(best, ["repo", "src", "target"], "left").select(
        "repo", "src", "target", F.when(F.col("b").isNotNull(), dst).alias("dst"),
        F.coalesce(F.col("b.n") > 1, F.lit(False)).alias("ambiguous"),
    )


def doc_edges(resolved_md: DataFrame, resolved_wiki: DataFrame) -> DataFrame:
    """Distinct document edges without self-loops (2.9.1)."""
    md = resolved_md.where((F.col("status") == "file") & (paths.file_kind(F.col("dst")) == "doc"))
    wiki = resolved_wiki.where(F.col("dst").isNotNull())
    both = md.select("repo", "src", "dst").unionByName(wiki.select("repo", "src", "dst"))
    return both.where(F.col("src") != F.col("dst")).distinct()


def doc_code_edges(resolved_md: DataFrame) -> DataFrame:
    """Resolved links to source files (2.3.9)."""
    code = resolved_md.where((F.col("status") == "file") & (paths.file_kind(F.col("dst")) == "code"))
    return code.select("repo", F.col("src").alias("doc"), F.col("dst").alias("code")).distinct()


def broken_links(resolved_md: DataFrame, resolved_wiki: DataFrame) -> DataFrame:
    md = resolved_md.where(F.col("status") == "broken").select("repo", "src", "target", F.lit("mdlink").alias("kind"))
    wiki = resolved_wiki.where(F.col("dst").isNull()).select("repo", "src", "target", F.lit("wikilink").alias("kind"))
    return md.unionByName(wiki).groupBy("repo", "src", "target").agg(F.max("kind").alias("kind"))


def group_broken_links(broken: DataFrame) -> DataFrame:
    """A row per missing canonical target and source, with the number of sources (2.4.28).

    Sources stay rows: a target missed by a third of all pages would not fit one array.
    """
    key = F.when(F.col("kind") == "wikilink", F.col("target")).otherwise(
        paths.normalize_keep(F.col("src"), F.col("target"))
    )
    keyed = broken.select("repo", key.alias("missing"), "src").distinct()
    counted = keyed.groupBy("repo", "missing").agg(F.count(F.lit(1)).alias("n_sources"))
    return skewed_join(keyed, counted, ["repo", "missing"]).select("repo", "missing", "n_sources", "src")


def missing_xrefs(texts: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents named in prose without a link to them (2.3.10)."""
    body = F.regexp_replace("text", fv.FENCE_PATTERN, "")
    token = text.UNICODE + r"(?i)(?<![\w./-])([^\s/\\()\[\]<>\"'`|,;:!?]+\.(?:md|mdx|markdown))\b"
    mentions = (
        texts.select("repo", F.col("path").alias("src"), F.explode(text.all_matches(body, token, 1)).alias("name"))
        .select("repo", "src", F.lower("name").alias("name"))
        .where(~F.col("name").isin(fv.CROSS_REFERENCE_SKIP))
        .distinct()
    )
    by_name = docs.groupBy("repo", F.lower(paths.basename(F.col("path"))).alias("name")).agg(F.max("path").alias("dst"))
    found = skewed_join(mentions, by_name, ["repo", "name"]).where(F.col("src") != F.col("dst"))
    return found.select("repo", "src", "dst").distinct().join(edges, ["repo", "src", "dst"], "left_anti")


def broken_instruction_refs(broken: DataFrame) -> DataFrame:
    """Broken links that point at an instruction file (2.3.23)."""
    name = F.lower(paths.basename(F.col("target")))
    return broken.where(name.isin(fv.INSTRUCTION_BASENAMES)).select("repo", "src", "target")


def vault_edges(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes selected by a hub query: folders, tags or fields, united (2.3.11).

    ``queries(repo, hub, text)``, ``notes(repo, path, text)``; each predicate
    becomes one key, so the selection is a single equi-join.
    """

    def keyed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("by"), v.alias("key")))

    def clean(folder: Column) -> Column:
        return F.regexp_replace(F.replace(F.trim(folder), F.lit("\\"), F.lit("/")), "^/+|/+$", "")

    q = F.col("text")
    wanted = queries.select(
        "repo",
        "hub",
        F.explode(
            F.concat(
                keyed("folder", F.transform(text.query_folders(q), clean)),
                keyed("tag", text.query_tags(q)),
                keyed("field", F.transform(text.query_fields(q), lambda f: F.concat_ws("=", f["key"], F.lower(f["value"])))),
            )
        ).alias("k"),
    ).select("repo", "hub", "k.*").distinct()
    fields = F.transform(
        F.map_entries(text.frontmatter_fields(q)), lambda e: F.concat_ws("=", e["key"], F.lower(e["value"]))
    )
    offered = notes.select(
        "repo",
        "path",
        F.explode(
            F.concat(
                keyed("folder", F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")), F.array("path"))),
                keyed("tag", text.frontmatter_tags(q)),
                keyed("field", fields),
            )
        ).alias("k"),
    ).select("repo", "path", "k.*")
    return (
        skewed_join(offered, wanted, ["repo", "by", "key"])
        .where(F.col("hub") != F.col("path"))
        .select("repo", "hub", F.col("path").alias("note"))
        .distinct()
    )


def frontmatter_table(notes: DataFrame) -> DataFrame:
    """Frontmatter as rows, so that any table of the same shape can stand in (2.13.3)."""
    return notes.select("repo", "path", F.explode(text.frontmatter_fields(F.col("text"))).alias("key", "value"))
