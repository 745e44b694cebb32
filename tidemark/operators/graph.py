"""Graph measures as DataFrame loops.

``nodes(repo, node)`` and ``edges(repo, src, dst)``. Every loop keeps its state
in a written table (see ``staging``), asks the driver only for one number per
round, and runs all repositories together. Edges leaving a hub are joined in
slices (see ``scale.skewed_join``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.operators.contraction import islands
from tidemark.scale import HOT_ROWS, positions, salted_lookup, top_k
from tidemark.staging import stage, unstage


def _sliced(edges: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges with a slice number, and the slices of every source.

    Only sources with more than ``hot_rows`` edges have more than one slice.
    """
    out = edges.groupBy("repo", "src").agg(F.count(F.lit(1)).alias("out_degree"))
    out = out.withColumn("slices", F.ceil(F.col("out_degree") / F.lit(hot_rows)).cast("long"))
    hot = out.where(F.col("slices") > 1).select("repo", "src", "slices")
    sliced = (
        salted_lookup(edges, hot, ["repo", "src"])
        .withColumn("slice", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("slices")), F.lit(0).cast("long")))
        .drop("slices")
    )
    return sliced, out.select("repo", F.col("src").alias("node"), "out_degree", "slices")


def _slices(column: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(column, F.lit(1).cast("long")) - 1))


def _total(df: DataFrame, column: Column) -> float:
    """One number for the driver."""
    return df.agg(column).first()[0] or 0


def _numbered(names: DataFrame) -> DataFrame:
    """Distinct ``repo, node, ...`` with an ``id`` in the order of their repository and name. A staged table."""
    dealt = names.repartitionByRange("repo", "node").sortWithinPartitions("repo", "node")
    return stage(dealt.withColumn("id", F.monotonically_increasing_id()), "numbers")


def _by_number(df: DataFrame, numbers: DataFrame, name: str, out: str) -> DataFrame:
    """Rows with the number of the node that column ``name`` names, also of the one without a name."""
    of = numbers.select(F.col("repo").alias("_repo"), F.col("node").alias("_node"), F.col("id").alias(out))
    return df.join(of, (F.col("repo") == F.col("_repo")) & F.col(name).eqNullSafe(F.col("_node"))).drop("_repo", "_node")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree, zeros kept (2.9.3): one aggregate, no join."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = (
        nodes.select("repo", "node", zero.alias("i"), zero.alias("o"))
        .unionByName(edges.select("repo", F.col("dst").alias("node"), one.alias("i"), zero.alias("o")))
        .unionByName(edges.select("repo", F.col("src").alias("node"), zero.alias("i"), one.alias("o")))
    )
    return rows.groupBy("repo", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


#: What later iterations of ``pagerank`` may add to a repository's ranks, all together, before they are left out.
RANK_LEFT = 1e-11


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = fv.PAGERANK_ALPHA,
    iterations: int = fv.PAGERANK_ITERATIONS,
    hot_rows: int = HOT_ROWS,
    rounds_per_stage: int = 10,
) -> DataFrame:
    """Power iteration with dangling mass spread evenly (2.9.4).

    Let z(0) be even and z(j + 1) be ``alpha`` times what links pass on of z(j).
    Jumps and dangling nodes give every node of a repository the same, so a rank
    after k iterations is the sum of u(k - j) z(j) with numbers u that follow
    from the sums of z alone: u(0) = 1, u(k + 1) = 1 - sum of u(k - j) |z(j + 1)|.
    The loop therefore needs no number per repository between iterations. A node
    sends its own record along a self row, so one join and one aggregate make an
    iteration, and ``rounds_per_stage`` of them are planned between two writes.
    Unless a source is hot, ranks are joined by the key they were aggregated by, so
    an iteration shuffles them once, and the links once per write. Nodes go by
    numbers in the loop: keys of eight bytes are hashed and sorted, not names.

    What is left of z after an iteration bounds all that later ones can add, and
    every one of them keeps at most ``alpha`` of it. Once a write shows that no
    repository has more than ``RANK_LEFT`` of it, the rest counts as zero.
    """
    sliced, sources = _sliced(edges, hot_rows)
    sizes = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    linked = edges.select("repo").distinct()
    zero = F.lit(0).cast("long")
    plain = salted_lookup(nodes.select("repo", "node"), sizes, ["repo"], "inner")
    # repositories without links keep even ranks
    even = salted_lookup(plain, linked, ["repo"], "left_anti").select(
        "repo", "node", (F.lit(1.0) / F.col("n")).alias("pagerank")
    )
    each = F.lit(1.0) / F.col("n")
    names = nodes.select("repo", "node").unionByName(edges.select("repo", F.explode(F.array("src", "dst")).alias("node")))
    numbers = _numbered(names.where(F.col("repo").isNotNull()).distinct())
    state = salted_lookup(plain, linked, ["repo"], "left_semi").join(sources, ["repo", "node"], "left")
    state = stage(
        _by_number(
            state.select(
                "repo", "node", F.coalesce("out_degree", zero).alias("deg"), F.coalesce("slices", zero + 1).alias("slices"),
                each.alias("z"), F.array(each).alias("past"),
            ),
            numbers, "node", "id",
        ),
        "ranks",
    )
    own = state.where(F.col("node").isNotNull()).select(F.col("id").alias("src"), F.col("id").alias("dst"), zero.alias("slice"), F.lit(True).alias("own"))
    sent = sliced.join(numbers.select("repo", F.col("node").alias("src"), F.col("id").alias("from")), ["repo", "src"])
    sent = _by_number(sent, numbers, "dst", "to").select(F.col("from").alias("src"), F.col("to").alias("dst"), "slice", F.lit(False).alias("own"))
    links = stage(sent.unionByName(own), "links")
    hot = not sources.where("slices > 1").isEmpty()

    def step(df: DataFrame, i: int) -> DataFrame:
        if hot:
            sent = df.withColumn("slice", _slices(F.col("slices"))).withColumnRenamed("id", "src").join(links, ["src", "slice"])
        else:  # ranks come out of the aggregate dealt by the key that they are joined by
            sent = df.withColumnRenamed("id", "src").join(links.drop("slice"), ["src"])
        share = F.when(F.col("own"), 0.0).otherwise(F.lit(alpha) * F.col("z") / F.col("deg"))
        # what a node keeps lies in columns of its own, not in an array, so that the aggregate hashes and never sorts
        mine = [F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("deg", "slices", *[f"z{j}" for j in range(i)])]
        return sent.groupBy(F.col("dst").alias("id")).agg(F.sum(share).alias("z"), *mine).withColumn(f"z{i}", F.col("z"))

    written, done = [(0, state)], 0
    while done < iterations:
        rounds = min(rounds_per_stage, iterations - done)
        after = reduce(step, range(rounds), state.select("id", "deg", "slices", "z"))
        past = F.when(F.col("deg").isNotNull(), F.array(*[f"z{j}" for j in range(rounds)]))
        state = stage(after.join(numbers, "id").select("repo", "node", "id", "deg", "slices", "z", past.alias("past")), "ranks")
        written.append((done + 1, state))
        done += rounds
        left = state.groupBy("repo").agg(F.sum("z").alias("left"))
        if _total(left, F.max("left")) * alpha / (1 - alpha) < RANK_LEFT:
            break
    unstage(links, numbers)
    parts = reduce(DataFrame.unionByName, [df.select("repo", "node", F.lit(at).alias("at"), "past") for at, df in written])
    sums = parts.select("repo", "at", F.posexplode("past").alias("k", "z")).groupBy("repo", (F.col("at") + F.col("k")).alias("j")).agg(F.sum("z").alias("s"))
    later = sums.where("j > 0").groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]).alias("s"))
    next_u = lambda u, s: F.array_append(
        u, 1.0 - F.aggregate(F.zip_with(F.reverse(u), F.slice(s, 1, F.size(u)), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    )
    u = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.array(F.lit(1.0)), lambda u, _: next_u(u, F.col("s")))
    weights = (later.select("repo", u.alias("u")) if iterations else linked.select("repo", F.array(F.lit(1.0)).alias("u")))
    mixed = salted_lookup(parts, weights, ["repo"], "inner")
    own_u = F.slice(F.reverse("u"), F.col("at") + 1, F.size("past"))
    part = F.aggregate(F.zip_with("past", own_u, lambda z, w: z * w), F.lit(0.0), lambda a, x: a + x)
    return mixed.groupBy("repo", "node").agg(F.sum(part).alias("pagerank")).unionByName(even)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of each island, by forests and star contraction (2.9.5)."""
    return islands(nodes, edges.select("repo", F.col("src").alias("a"), F.col("dst").alias("b")))


def distances(nodes: DataFrame, edges: DataFrame, entries: DataFrame, gather: int = 8) -> DataFrame:
    """Hops from the entry set; null for nodes out of reach (2.9.6, 2.9.7).

    A step joins the links with the last frontier only. Frontiers are gathered
    into one table of visited nodes every ``gather`` steps, so a step reads that
    table and a few frontiers, however deep the graph is.
    """
    edges = stage(edges.select("repo", "src", "dst"), "edges")
    frontier = stage(
        entries.select("repo", "node").join(nodes, ["repo", "node"], "left_semi").distinct().withColumn("dist", F.lit(0)),
        "frontier",
    )
    seen = [frontier]
    step = 0
    while True:
        step += 1
        reached = edges.join(frontier.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_semi")
        visited = reduce(DataFrame.unionByName, seen).select("repo", "node")
        frontier = stage(
            reached.select("repo", F.col("dst").alias("node"))
            .distinct()
            .join(visited, ["repo", "node"], "left_anti")
            .withColumn("dist", F.lit(step)),
            "frontier",
        )
        if frontier.isEmpty():
            unstage(frontier, edges)
            break
        seen.append(frontier)
        if len(seen) > gather:
            # the last frontier stays a table of its own: the next step starts from it
            gathered = stage(reduce(DataFrame.unionByName, seen[:-1]), "visited")
            unstage(*seen[:-1])
            seen = [gathered, frontier]
    return nodes.select("repo", "node").join(reduce(DataFrame.unionByName, seen), ["repo", "node"], "left")


def hop_shells(dist: DataFrame) -> DataFrame:
    """Shell per node: its distance, or a growing ring after the last shell (2.9.7)."""
    last = dist.groupBy("repo").agg(F.coalesce(F.max("dist"), F.lit(0)).alias("last"))
    inside = dist.where(F.col("dist").isNotNull()).select("repo", "node", F.col("dist").cast("long").alias("shell"))
    ranked = positions(dist.where(F.col("dist").isNull()).select("repo", "node"), "repo", "node", "pos")
    # rings hold 24, 36, 48, ... nodes, so k rings hold 6k^2 + 18k
    position = F.col("pos") - 1
    linear = F.lit(2 * fv.RING_FIRST - fv.RING_STEP)
    ring = F.floor(
        (F.sqrt(linear * linear + F.lit(8 * fv.RING_STEP) * position) - linear) / F.lit(2 * fv.RING_STEP)
    )
    rings = salted_lookup(ranked, last, ["repo"]).select("repo", "node", (F.col("last") + 1 + ring).cast("long").alias("shell"))
    return inside.unionByName(rings)


def entry_points(docs: DataFrame, ranks: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Root entry files, the top map-of-content, query hubs; else the top node (2.9.8)."""
    roots = docs.where(paths.is_entry_doc(F.col("node"))).select("repo", "node")
    order = F.struct(F.col("pagerank"), F.col("node"))
    mocs = (
        docs.where(paths.is_declared_moc(F.col("node")))
        .join(ranks, ["repo", "node"])
        .groupBy("repo")
        .agg(F.max_by("node", order).alias("node"))
    )
    found = roots.unionByName(mocs)
    if hubs is not None:
        found = found.unionByName(hubs.select("repo", "node"))
    found = found.distinct()
    top = ranks.groupBy("repo").agg(F.max_by("node", order).alias("node"))
    return found.unionByName(top.join(found.select("repo").distinct(), "repo", "left_anti"))


def classify(nodes: DataFrame, degrees: DataFrame, dist: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry, reachable, orphan or island for every node (2.8.28)."""
    from tidemark.functions import scores

    marked = entries.select("repo", "node", F.lit(True).alias("is_entry"))
    rows = nodes.select("repo", "node").join(degrees, ["repo", "node"]).join(dist, ["repo", "node"], "left")
    rows = rows.join(marked, ["repo", "node"], "left")
    return rows.select(
        "repo", "node", "in_degree", "out_degree",
        scores.classify_node(
            F.coalesce("is_entry", F.lit(False)), F.col("dist").isNotNull(), F.col("in_degree")
        ).alias("kind"),
    )


def orphans(degrees: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes nothing links to, entries aside (2.9.9)."""
    return degrees.where(F.col("in_degree") == 0).join(entries, ["repo", "node"], "left_anti").select("repo", "node")


def moc_validation(degrees: DataFrame) -> DataFrame:
    """Declared maps and whether they are wired (2.9.10)."""
    declared = degrees.where(paths.is_declared_moc(F.col("node")))
    return declared.select(
        "repo", "node", "out_degree", (F.col("out_degree") >= fv.HUB_MIN_OUT_DEGREE).alias("is_structural_hub")
    )


def top_hubs(ranks: DataFrame, degrees: DataFrame, k: int = fv.TOP_LIST) -> DataFrame:
    """By rounded rank, out degree, path (2.6.4)."""
    rows = ranks.join(degrees, ["repo", "node"]).withColumn("pagerank", F.round("pagerank", 4))
    return top_k(rows, ["repo"], [F.desc("pagerank"), F.desc("out_degree"), F.asc("node")], k)


def curated_subgraph(nodes: DataFrame, edges: DataFrame, raw_dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the documents of raw trees (2.9.11)."""
    above = nodes.select("repo", "node", F.explode(paths.ancestors(F.col("node"))).alias("dir"))
    raw = above.join(raw_dirs.select("repo", "dir"), ["repo", "dir"], "left_semi").select("repo", "node").distinct()
    kept = nodes.join(raw, ["repo", "node"], "left_anti")
    inner = edges.join(raw.withColumnRenamed("node", "src"), ["repo", "src"], "left_anti").join(
        raw.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_anti"
    )
    return kept, inner.select("repo", "src", "dst")


def _trimmed(edges: DataFrame, rounds_per_stage: int = 4) -> DataFrame:
    """Edges between nodes that have edges on both sides; chains that lead in or out of cycles go end by end."""
    live = stage(edges, "edges")
    size = live.count()
    while True:
        left = live
        for _ in range(rounds_per_stage):
            left = left.join(left.select("repo", F.col("dst").alias("src")).distinct(), ["repo", "src"], "left_semi")
            left = left.join(left.select("repo", F.col("src").alias("dst")).distinct(), ["repo", "dst"], "left_semi")
        after = stage(left.select("repo", "src", "dst"), "edges")
        unstage(live)
        live, before, size = after, size, after.count()
        if size == before:
            return live


def _colours(live: DataFrame, steps_per_stage: int) -> DataFrame:
    """``repo, node, fwd, bwd``: the smallest node that reaches each node, and the smallest it reaches. A staged table.

    A node sends its own record along a row of its own, its forward label along
    its edges and its backward label against them, so one join and one aggregate
    make a step for both directions and a written table holds several steps. Labels
    then jump to the labels of the nodes they name.
    """
    row = lambda a, b, kind: live.select("repo", F.col(a).alias("node"), F.col(b).alias("to"), F.lit(kind).alias("kind"))
    nodes = live.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = nodes.select("repo", "node", F.col("node").alias("to"), F.lit("own").alias("kind"))
    sends = stage(row("src", "dst", "fwd").unionByName(row("dst", "src", "bwd")).unionByName(own), "sends")
    labels, mark = nodes.select("repo", "node", F.col("node").alias("fwd"), F.col("node").alias("bwd")), None

    def step(df: DataFrame) -> DataFrame:
        carried = lambda c: F.min(F.when(F.col("kind").isin("own", c), F.col(c))).alias(c)
        return df.join(sends, ["repo", "node"]).groupBy("repo", F.col("to").alias("node")).agg(carried("fwd"), carried("bwd"))

    written = None
    while True:
        fresh = stage(reduce(lambda df, _: step(df), range(steps_per_stage), labels), "labels")
        now = tuple(fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("repo", "node", "fwd", "bwd").cast("decimal(38,0)"))).first())
        if written is not None:
            unstage(written)
        written = fresh
        if now == mark:
            unstage(sends)
            return fresh
        mark = now
        jump = lambda c: fresh.select("repo", F.col("node").alias(c), F.col(c).alias(f"next_{c}"))  # noqa: E731, B023
        jumped = fresh.join(jump("fwd"), ["repo", "fwd"], "left").join(jump("bwd"), ["repo", "bwd"], "left")
        labels = jumped.select("repo", "node", F.least("fwd", "next_fwd").alias("fwd"), F.least("bwd", "next_bwd").alias("bwd"))


def strong_components(edges: DataFrame, steps_per_stage: int = 6) -> DataFrame:
    """Members of every cycle, labelled by the smallest member (2.9.12).

    Forward and backward colouring with every local minimum as a pivot: each round
    finds the smallest node that reaches a node and the smallest it reaches. Equal
    labels put a node into that component; edges between nodes with different
    labels cannot lie on a cycle and are cut, and what then has no edges on one
    side is trimmed before the next round.
    """
    live = _trimmed(edges.where(F.col("src") != F.col("dst")).select("repo", "src", "dst").distinct())
    found: list[DataFrame] = []
    while not live.isEmpty():
        labels = _colours(live, steps_per_stage)
        same = labels.where(F.col("fwd") == F.col("bwd"))
        found.append(stage(same.select("repo", "node", F.col("fwd").alias("component")), "components"))
        rest = labels.where(F.col("fwd") != F.col("bwd"))
        a = rest.select("repo", F.col("node").alias("src"), F.struct("fwd", "bwd").alias("sa"))
        b = rest.select("repo", F.col("node").alias("dst"), F.struct("fwd", "bwd").alias("sb"))
        inner = live.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).where(F.col("sa") == F.col("sb")).select("repo", "src", "dst")
        cut = _trimmed(inner)
        unstage(live, labels)
        live = cut
    unstage(live)
    if not found:
        return edges.select("repo", F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    members = reduce(DataFrame.unionByName, found)
    sizes = members.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return members.join(sizes, ["repo", "component"])


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges ``a < b``."""
    return edges.where(F.col("src") != F.col("dst")).select(
        "repo", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()


def modularity_q(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Newman's Q of a partition ``(repo, node, community)`` (2.9.13)."""
    links = undirected(edges)
    ca = partition.select("repo", F.col("node").alias("a"), F.col("community").alias("ca"))
    cb = partition.select("repo", F.col("node").alias("b"), F.col("community").alias("cb"))
    both = links.join(ca, ["repo", "a"]).join(cb, ["repo", "b"])
    # every edge gives one degree to each side and one inner edge where both sides agree
    ends = both.select(
        "repo", F.explode(F.array(
            F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0).alias("inner")),
            F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inner")),
        )).alias("e")
    )
    per_c = ends.groupBy("repo", "e.c").agg(F.sum("e.inner").alias("inner"), F.count(F.lit(1)).cast("double").alias("deg"))
    per_repo = per_c.groupBy("repo").agg(
        (F.sum("deg") / 2).alias("m"), F.sum("inner").alias("inner"), F.sum(F.col("deg") * F.col("deg")).alias("sq")
    )
    q = F.col("inner") / F.col("m") - F.col("sq") / (F.lit(4.0) * F.col("m") * F.col("m"))
    linked = per_repo.select("repo", F.greatest(F.lit(-0.5), F.least(F.lit(1.0), q)).alias("q"))
    every = partition.select("repo").distinct()
    return every.join(linked, "repo", "left").select("repo", F.coalesce("q", F.lit(0.0)).alias("modularity_q"))


def _picks(between: DataFrame) -> DataFrame:
    """The neighbour each community gains most with: ``x, low, high, w, dlow, dhigh, m``; none where no merge gains.

    Gains are in one total order of pairs, so picks never go round in a circle of three or more.
    """
    gain = F.round(F.col("w") / F.col("m") - F.col("dlow") * F.col("dhigh") / (2 * F.col("m") * F.col("m")), 12)
    gaining = between.withColumn("gain", gain).where("gain > 0")
    sides = gaining.select(F.explode(F.array("low", "high")).alias("x"), F.struct("gain", *BETWEEN).alias("pick"))
    return sides.groupBy("x").agg(F.max("pick").alias("pick")).select("x", *[f"pick.{c}" for c in BETWEEN])


def _moves(picks: DataFrame) -> DataFrame:
    """``x, target, d`` for every community that takes part in a merge; ``d`` is the degree of what it becomes. A staged table.

    Two that pick each other merge. Others that picked one of the two follow at
    once if they gain even when all followers come: each is charged half of what
    the rest of them cost it, so a round never loses modularity and a hub takes
    its neighbourhood together.
    """
    both = picks.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.max("dlow").alias("dlow"), F.max("dhigh").alias("dhigh")).where("n = 2")
    sides = F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("dlow").alias("dx")), F.struct(F.col("high").alias("x"), F.col("dhigh").alias("dx"))))
    pairs = stage(both.select("low", (F.col("dlow") + F.col("dhigh")).alias("d_pair"), sides.alias("s")).select("s.x", F.col("low").alias("target"), "s.dx", "d_pair"), "pairs")
    is_low = F.col("x") == F.col("low")
    others = picks.join(pairs.select("x"), ["x"], "left_anti").select(
        "x", F.when(is_low, F.col("high")).otherwise(F.col("low")).alias("y"), F.when(is_low, F.col("dlow")).otherwise(F.col("dhigh")).alias("dx"), "w", "m"
    )
    followers = stage(others.join(pairs.select(F.col("x").alias("y"), "target", "d_pair"), ["y"]).drop("y"), "followers")
    load = followers.groupBy("target").agg(F.sum("dx").alias("load"))
    cost = F.col("dx") * (F.col("d_pair") + (F.col("load") - F.col("dx")) / 2) / (2 * F.col("m") * F.col("m"))
    follow = followers.join(load, ["target"]).where(F.round(F.col("w") / F.col("m") - cost, 12) > 0)
    members = stage(pairs.select("x", "target", "dx").unionByName(follow.select("x", "target", "dx")), "members")
    moves = stage(members.join(members.groupBy("target").agg(F.sum("dx").alias("d")), ["target"]).select("x", "target", "d"), "moves")
    unstage(pairs, followers, members)
    return moves


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modularity clusters by merging whole neighbourhoods, level by level (2.9.13).

    A round merges communities (see ``_moves``) and contracts the links between
    them, so the next one works on a smaller graph. Rounds end when no merge
    gains; they do end, because the pair with the largest gain picks each other.
    Nodes go by numbers that keep the order of their names, a link is one row, and
    degrees travel with it, so a round takes one aggregate to pick, joins on the
    written picks, and one aggregate to contract. The partition is one local
    optimum; its Q is the contract, not the labels.
    """
    links = stage(undirected(edges).where(F.col("repo").isNotNull()), "links")
    ends = links.select("repo", F.explode(F.array("a", "b")).alias("node"))
    numbers = _numbered(ends.groupBy("repo", "node").agg(F.count(F.lit(1)).cast("double").alias("d")))
    totals = numbers.groupBy("repo").agg((F.sum("d") / 2).alias("m"))
    of = lambda c, name: numbers.select("repo", F.col("node").alias(c), F.col("id").alias(name), F.col("d").alias(f"d{name}"))
    weighed = links.join(of("a", "low"), ["repo", "a"]).join(of("b", "high"), ["repo", "b"]).withColumn("w", F.lit(1.0))
    between = stage(salted_lookup(weighed, totals, ["repo"], "inner").select(*BETWEEN), "between")
    unstage(links)
    levels = []
    while True:
        picks = stage(_picks(between), "picks")
        moves = _moves(picks)
        unstage(picks)
        if moves.isEmpty():
            unstage(moves, between)
            break
        levels.append(moves)
        to = lambda c: moves.select(F.col("x").alias(c), F.col("target").alias(f"t{c}"), F.col("d").alias(f"n{c}"))  # noqa: E731, B023
        joined = between.join(to("low"), ["low"], "left").join(to("high"), ["high"], "left").select(
            F.struct(F.coalesce("tlow", "low").alias("c"), F.coalesce("nlow", "dlow").alias("d")).alias("p"),
            F.struct(F.coalesce("thigh", "high").alias("c"), F.coalesce("nhigh", "dhigh").alias("d")).alias("q"), "w", "m",
        )
        ordered = joined.where("p.c <> q.c").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "w", "m")
        contracted = ordered.groupBy(F.col("p.c").alias("low"), F.col("q.c").alias("high")).agg(
            F.sum("w").alias("w"), F.max("p.d").alias("dlow"), F.max("q.d").alias("dhigh"), F.max("m").alias("m")
        )
        contracted = stage(contracted.select(*BETWEEN), "between")
        unstage(between)
        between = contracted
    part = numbers.select("repo", "node", F.col("id").alias("community"))
    for moves in levels:
        step = moves.where("x <> target").select(F.col("x").alias("community"), "target")
        part = part.join(step, ["community"], "left").select("repo", "node", F.coalesce("target", "community").alias("community"))
    named = part.join(numbers.select(F.col("id").alias("community"), F.col("node").alias("name")), ["community"]).select("repo", "node", "name")
    return nodes.select("repo", "node").join(named, ["repo", "node"], "left").select("repo", "node", F.coalesce("name", "node").alias("community"))


BETWEEN = ["low", "high", "w", "dlow", "dhigh", "m"]


def _one_blocker(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items that wait for one other item: ``repo, item, to, w, base``; their level is ``max(base, level(to) + w)``."""
    single = edges.groupBy("repo", "item").agg(F.count(F.lit(1)).alias("n"), F.first("to").alias("to"), F.first("w").alias("w")).where("n = 1")
    return single.join(nodes.select("repo", "item", "base"), ["repo", "item"]).select("repo", "item", "to", "w", "base")


def _jumped(single: DataFrame) -> DataFrame:
    """Each item past the item it waits for, where that one waits for one other itself."""
    past = single.select("repo", F.col("item").alias("to"), F.col("to").alias("next"), F.col("w").alias("w2"), F.col("base").alias("base2"))
    both = single.join(past, ["repo", "to"], "left")
    none = F.lit(0).cast("long")
    return both.select(
        "repo", "item", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("w2", none)).alias("w"),
        F.greatest("base", F.when(F.col("next").isNotNull(), F.col("w") + F.col("base2"))).alias("base"),
    )


def dependency_levels(deps: DataFrame, jumps_per_stage: int = 2) -> DataFrame:
    """Wave of each work item; null on or behind a cycle (2.9.16).

    ``deps(repo, item, blocked_by)`` with one row per blocker, or a null blocker. An
    item's level is ``max(base, level(to) + w)`` over the items it still waits for.
    Each round settles items that wait for nothing any more and takes them out;
    items that wait for one other jump past it, twice as far with every jump, so a
    chain takes the logarithm of its length; items that wait for several wait for
    where those jumped to, and count as one blocker what met there, so diamonds
    close. Who jumps further than there are items is behind a cycle, and so is
    whatever is left when nothing settles or jumps.
    """
    given = deps.where(F.col("blocked_by").isNotNull()).select("repo", "item", F.col("blocked_by").alias("to")).distinct()
    items = stage(deps.select("repo", "item").unionByName(given.select("repo", F.col("to").alias("item"))).distinct(), "items")
    size = items.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    nodes = items.withColumn("base", zero)
    edges = stage(given.withColumn("w", one), "edges")
    done: list[DataFrame] = []
    mark = None
    while True:
        # what waits for nothing is settled; once that is nothing and no edge moves, what is left waits for itself
        free = nodes.join(edges.select("repo", "item").distinct(), ["repo", "item"], "left_anti")
        settled = stage(free.select("repo", "item", F.col("base").alias("level")), "settled")
        done.append(settled)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("repo", "item", "to", "w").cast("decimal(38,0)"))).first())
        if now[0] == 0 or (now == mark and settled.isEmpty()):
            unstage(nodes, edges)
            break
        mark = now
        single = _one_blocker(edges, nodes)
        for _ in range(jumps_per_stage):
            single = _jumped(single)
        # a jump beyond all items goes round a cycle: it never settles
        single = stage(salted_lookup(single, size, ["repo"]).withColumn("lost", F.col("w") > F.col("size")).drop("size"), "single")
        lost = single.where("lost").select("repo", "item")
        of = single.select("repo", F.col("item").alias("to"), F.col("to").alias("next"), F.col("w").alias("w2"), F.col("base").alias("base2"))
        several = edges.join(single.select("repo", "item"), ["repo", "item"], "left_anti").join(of, ["repo", "to"], "left")
        moved = several.select(
            "repo", "item", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("w2", zero)).alias("w"),
            F.when(F.col("next").isNotNull(), F.col("w") + F.col("base2")).alias("least"),
        ).unionByName(single.where("NOT lost").select("repo", "item", "to", "w", F.col("base").alias("least")))
        merged = moved.groupBy("repo", "item", "to").agg(F.max("w").alias("w"), F.max("least").alias("least"))
        known = settled.select("repo", F.col("item").alias("to"), "level")
        reached = stage(merged.join(known, ["repo", "to"], "left"), "reached")
        more = reached.groupBy("repo", "item").agg(F.max(F.greatest("least", F.col("level") + F.col("w"))).alias("more"))
        left = nodes.join(settled, ["repo", "item"], "left_anti").join(lost, ["repo", "item"], "left_anti")
        fresh = stage(left.join(more, ["repo", "item"], "left").select("repo", "item", F.greatest("base", "more").alias("base")), "nodes")
        unstage(nodes, edges, single)
        nodes, edges = fresh, reached.where("level IS NULL").select("repo", "item", "to", "w")
    levels = reduce(DataFrame.unionByName, done)
    return items.join(levels, ["repo", "item"], "left").select("repo", "item", F.col("level").cast("int").alias("level"))


def hot_files(item_files: DataFrame) -> DataFrame:
    """Files several open items touch; five or more is contention (2.9.17)."""
    counted = item_files.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n_items"))
    return counted.where(F.col("n_items") >= 2).withColumn("contended", F.col("n_items") >= 5)


def hot_file_groups(item_files: DataFrame) -> DataFrame:
    """Items that share files directly or through others.

    Every item of a file is tied to the file's first item, so a file with many
    items adds one tie per item and no pairs; the ties are contracted.
    """
    first = item_files.groupBy("repo", "path").agg(F.min("item").alias("b"), F.count(F.lit(1)).alias("n"))
    ties = item_files.join(first.where(F.col("n") >= 2), ["repo", "path"]).select("repo", F.col("item").alias("a"), "b")
    nodes = item_files.select("repo", F.col("item").alias("node"))
    return islands(nodes, ties).select("repo", F.col("node").alias("item"), F.col("component").alias("group"))
