"""Declared, imported and co-changed groupings compared.

"Same boundary" and "same community" relate every pair of files of a group, so
a boundary over a third of the tree would mean billions of pairs. They are kept
as groups: files with the same boundaries form a class, and a pair is counted
once, at the widest boundary that holds both files, from the classes' sizes. Only
the co-change relation, which is sparse, is held as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths
from tidemark.scale import positions, skewed_join
from tidemark.staging import stage

Seams = list[tuple[str, str]]


def _sides(path: Column, seams: Seams) -> Column:
    """Per seam: 0 neither side, 1 low, 2 high, 3 both."""
    codes = [
        F.when(paths.under(path, lo), 1).otherwise(0) + F.when(paths.under(path, hi), 2).otherwise(0) for lo, hi in seams
    ]
    return F.array(*codes).cast("array<int>") if codes else F.array().cast("array<int>")


def _on_seam(a: Column, b: Column) -> Column:
    crossed = F.zip_with(
        a, b, lambda x, y: (x.isin(1, 3) & y.isin(2, 3)) | (x.isin(2, 3) & y.isin(1, 3))
    )
    return F.exists(crossed, lambda c: c)


def seam_filter(pairs: DataFrame, seams: Seams) -> DataFrame:
    """Drop pairs that straddle an allowed seam, in either order (2.2.17)."""
    return pairs.where(~_on_seam(_sides(F.col("file_a"), seams), _sides(F.col("file_b"), seams)))


def cochange_grouping(pairs: DataFrame, threshold_pct: float = fv.COCHANGE_SUPPORT_PCT) -> DataFrame:
    """Coupled pairs with enough support; no closure (2.7.8)."""
    kept = pairs.where(F.col("support_pct") >= threshold_pct)
    return kept.select(
        "repo", F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b")
    ).distinct()


def file_classes(ownership: DataFrame, seams: Seams) -> DataFrame:
    """The boundaries of each file as one sorted list, plus its seam sides."""
    sig = F.sort_array(F.collect_set("boundary"))
    return ownership.groupBy("repo", "path").agg(sig.alias("sig")).withColumn("sides", _sides(F.col("path"), seams))


#: Classes of one boundary that are compared at once; more are cut into tiles.
TILE = 2048


def _by_boundary(classes: DataFrame, extra: list[str]) -> DataFrame:
    """``repo, boundary, extra, before, sides, n``: the files of every boundary by the wider boundaries they lie in.

    Boundaries are numbered from the widest on, and ``before`` lists the numbers
    below a boundary's own. Two files count as a pair where the first boundary that
    holds both is: where they share none before. Rows grow with files times rules,
    and files that agree on ``before`` are one row; a wide boundary has few such.
    """
    sized = stage(classes.groupBy("repo", "sig", "sides", *extra).agg(F.count(F.lit(1)).alias("n")).withColumn("_row", F.monotonically_increasing_id()), "classes")
    held = sized.select("repo", "_row", "n", F.explode("sig").alias("boundary"))
    width = held.groupBy("repo", "boundary").agg(F.sum("n").alias("width"))
    widest = width.withColumn("_order", F.struct((-F.col("width")).alias("width"), "boundary"))
    numbers = positions(widest, "repo", "_order", "number").select("repo", "boundary", "number")
    numbered = skewed_join(held.select("repo", "_row", "boundary"), numbers, ["repo", "boundary"]).groupBy("_row").agg(F.sort_array(F.collect_list("number")).alias("all"))
    placed = sized.drop("sig").join(numbered, "_row").select("repo", "sides", *extra, "n", "all", F.posexplode("all").alias("at", "boundary"))
    return placed.groupBy("repo", "boundary", *extra, F.slice("all", F.lit(1), F.col("at")).alias("before"), "sides").agg(F.sum("n").alias("n"))


def _tiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the tile they are compared in: a group of many rows is cut into blocks, and every two blocks meet.

    A group whose files all lie in the same wider boundaries has no first pairs and goes.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("before")).alias("least"))
    blocks = sizes.where("rows > 1 OR least = 0").select(*keys, F.ceil(F.col("rows") / F.lit(TILE)).cast("int").alias("blocks"))
    cut = skewed_join(rows, blocks, keys).withColumn("own", F.pmod(F.xxhash64("before", "sides"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cut.withColumn("other", other).select(
        *keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("is_high"), "before", "sides", "n"
    )


def _first_shared(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``repo, pairs``: file pairs of each group that share nothing in ``before`` and cross no seam.

    A tile is one comparison of bit rows; it gives one number, never its pairs.
    """
    names = [*keys, "low", "high"]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[names] == frame[names].iloc[-1]).all(axis=1).to_numpy()
            at = int(np.flatnonzero(last)[0])
            rest = frame.iloc[at:]
            if at:
                yield _tile_pairs(frame.iloc[:at], names)
        if rest is not None and len(rest):
            yield _tile_pairs(rest, names)

    dealt = _tiles(groups, keys).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInPandas(counted, "repo string, pairs long").groupBy("repo").agg(F.sum("pairs").alias("pairs"))


def _tile_pairs(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    out: dict[str, int] = {}
    for key, tile in rows.groupby(names, sort=False):
        repo, low, high = key[0], key[-2], key[-1]
        out[repo] = out.get(repo, 0) + _pairs_of(tile, low == high)
    return pd.DataFrame({"repo": list(out), "pairs": list(out.values())}).astype({"repo": "object", "pairs": "int64"})


def _pairs_of(tile: pd.DataFrame, same: bool) -> int:
    """Pairs between the two blocks of a tile, or within its one."""
    n = tile["n"].to_numpy(np.int64)
    if len(n) == 1 and not len(tile["before"].iloc[0]) and not len(tile["sides"].iloc[0]):
        return int(n[0]) * (int(n[0]) - 1) // 2 if same else 0
    numbers = {x: i for i, x in enumerate(sorted({x for b in tile["before"] for x in b}))}
    wide = np.zeros((len(tile), max(len(numbers), 1)), np.float32)
    for i, before in enumerate(tile["before"]):
        wide[i, [numbers[x] for x in before]] = 1
    sides = np.stack(tile["sides"].to_numpy()).astype(np.int64).reshape(len(tile), -1)
    low, high = (sides & 1).astype(np.float32), (sides >> 1 & 1).astype(np.float32)
    one, two = (slice(None), slice(None)) if same else (np.flatnonzero(~tile["is_high"].to_numpy()), np.flatnonzero(tile["is_high"].to_numpy()))
    apart = (wide[one] @ wide[two].T == 0) & (low[one] @ high[two].T == 0) & (high[one] @ low[two].T == 0)
    total = int((apart.astype(np.int64) @ n[two] * n[one]).sum())
    if not same:
        return total
    return (total - int((np.diagonal(apart) * n).sum())) // 2


def human_pair_counts(ownership: DataFrame, seams: Seams | None = None) -> DataFrame:
    """Distinct same-boundary pairs per repository (2.7.6)."""
    return _human_total(file_classes(ownership, seams or []))


def _human_total(classes: DataFrame) -> DataFrame:
    return _first_shared(_by_boundary(classes, []), ["repo", "boundary"])


def boundary_pairs(ownership: DataFrame) -> DataFrame:
    """Files and pairs of every boundary."""
    n = F.count(F.lit(1))
    return ownership.groupBy("repo", "boundary").agg(n.alias("files"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def static_pair_counts(communities: DataFrame) -> DataFrame:
    """Files and pairs of every community (2.7.7)."""
    n = F.count(F.lit(1))
    return communities.groupBy("repo", "community").agg(n.alias("files"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def _static_total(communities: DataFrame, seams: Seams) -> DataFrame:
    none = F.array().cast("array<bigint>").alias("before")
    sized = communities.withColumn("sides", _sides(F.col("path"), seams)).groupBy("repo", "community", "sides").agg(F.count(F.lit(1)).alias("n"))
    return _first_shared(sized.select("repo", "community", none, "sides", "n"), ["repo", "community"]).withColumnRenamed("pairs", "s")


def _agreed_total(classes: DataFrame, communities: DataFrame) -> DataFrame:
    """Pairs that share a boundary and a community."""
    placed = skewed_join(classes, communities.select("repo", "path", "community"), ["repo", "path"])
    return _first_shared(_by_boundary(placed, ["community"]), ["repo", "boundary", "community"]).withColumnRenamed("pairs", "hs")


def cochange_against_ownership(cochange: DataFrame, ownership: DataFrame, seams: Seams | None = None) -> DataFrame:
    """Each co-change pair and whether a boundary holds both files."""
    pairs = seam_filter(cochange, seams) if seams else cochange
    return _held_pairs(pairs, stage(file_classes(ownership, []), "classes"))


def _held_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select("repo", F.col("path").alias("file_a"), F.col("sig").alias("sig_a"))
    b = classes.select("repo", F.col("path").alias("file_b"), F.col("sig").alias("sig_b"))
    joined = skewed_join(skewed_join(pairs, a, ["repo", "file_a"], "left"), b, ["repo", "file_b"], "left")
    held = F.coalesce(F.arrays_overlap("sig_a", "sig_b"), F.lit(False))
    return joined.select("repo", "file_a", "file_b", held.alias("same_boundary"))


def grouping_disagreement(
    ownership: DataFrame, communities: DataFrame, cochange: DataFrame, seams: Seams | None = None, mapped: DataFrame | None = None
) -> DataFrame:
    """Sizes of the six difference and intersection sets (2.7.5).

    ``ownership(repo, boundary, path)``, ``communities(repo, path, community)``,
    ``cochange(repo, file_a, file_b)``; ``mapped(repo)`` names the repositories with an
    ownership map, by default those in ``ownership``. Others have nothing to
    disagree with: their counts are null and ``reason`` says so.
    """
    seams = seams or []
    classes = stage(file_classes(ownership, seams), "classes")
    communities = stage(communities.select("repo", "path", "community"), "communities")
    h = _human_total(classes).withColumnRenamed("pairs", "h")
    s = _static_total(communities, seams)
    hs = _agreed_total(classes, communities)
    c = _held_pairs(seam_filter(cochange, seams) if seams else cochange, classes).groupBy("repo").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("same_boundary").alias("hc")
    )
    out = h
    for other in (s, hs, c):
        out = out.join(other, "repo", "full_outer")
    known = (ownership if mapped is None else mapped).select("repo", F.lit(True).alias("has_map")).distinct()
    out = out.join(known, "repo", "full_outer").na.fill(0)
    count = lambda value, name: F.when(F.col("has_map"), value).alias(name)
    return out.select(
        "repo",
        count(F.col("h") - F.col("hs"), "human_grouped_static_splits"),
        count(F.col("s") - F.col("hs"), "human_split_static_fuses"),
        count(F.col("h") - F.col("hc"), "human_grouped_never_cochange"),
        count(F.col("c") - F.col("hc"), "human_split_but_cochange"),
        count(F.col("hs"), "human_static_agree"),
        count(F.col("hc"), "human_cochange_agree"),
        F.when(F.col("has_map").isNull(), "no ownership map").alias("reason"),
    )


def drift_dir_pairs(against: DataFrame, min_pairs: int = fv.MIN_DRIFT_PAIRS) -> DataFrame:
    """Directories straddled by several undeclared co-change pairs (2.4.26)."""
    a, b = paths.parent(F.col("file_a")), paths.parent(F.col("file_b"))
    hidden = against.where(~F.col("same_boundary")).select("repo", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    straddled = (
        hidden.where((F.col("a") != F.col("b")) & (F.col("a") != ""))
        .groupBy("repo", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pairs)
    )
    return straddled.select("repo", F.explode(F.array("a", "b")).alias("dir")).distinct()
