"""Helpers that keep a hot key from landing in one task.

The rules used throughout the package:

* counts, sums, minima and maxima go through ``groupBy``: the map-side combine
  turns a hot key into one row per map task before anything is shuffled;
* facts per repository are joined with :func:`salted_lookup`;
* joins whose big side may hold a hot key use :func:`skewed_join`: adaptive
  execution splits the hot partitions, or the hot keys are cut into slices;
* ordered work over long sequences is split into chunks
  (:func:`running_sum`, :func:`carry_forward`), so that no window sorts more
  than one chunk of a group;
* no data-derived side is hinted for broadcast: Spark compares the measured
  size with its own threshold and falls back to a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import stage

LOOKUP_COPIES = 16
HOT_ROWS = 1_000_000


def _row_salt(df: DataFrame, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), buckets)


def salted_lookup(
    df: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "left", copies: int = LOOKUP_COPIES
) -> DataFrame:
    """Join a small table with one row per key onto rows of any size.

    Each fact is repeated ``copies`` times and the rows of a key are spread
    over the copies, so a repository with a third of all rows is joined by
    ``copies`` tasks instead of one when the facts are too big to broadcast.
    """
    left = df.withColumn("_copy", _row_salt(df, F.lit(copies)))
    right = facts.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    return left.join(right, [*on, "_copy"], how).drop("_copy")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the slices each is cut into.

    At most ``rows / hot_rows`` keys qualify, whatever the data looks like.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("long").alias("_slices"))
    )


def has_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> bool:
    """Whether any key has more than ``hot_rows`` rows: one aggregate, one answer for the driver."""
    return not hot_keys(df, keys, HOT_ROWS if hot_rows is None else hot_rows).isEmpty()


def _adaptive_skew(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    return all(
        str(conf.get(key, "true")).lower() == "true"
        for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    )


def skewed_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """Equi-join whose big side may hold a hot key.

    With adaptive execution Spark measures the shuffled partitions and splits
    the hot ones itself, at no cost when there are none; without it, or when
    ``hot_rows`` asks for it, the hot keys are found and sliced here. Results
    are then regrouped on other keys, so the split is never undone.
    """
    if hot_rows is None and _adaptive_skew(big):
        return big.join(small, list(on), how)
    return sliced_join(big, small, on, how, hot_rows or HOT_ROWS)


def sliced_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Equi-join in which the hot keys of ``big`` are cut into slices.

    ``small`` rows of a hot key are repeated once per slice; all other rows
    are joined as usual. Exact for inner, left, left_semi and left_anti.
    """
    hot = hot_keys(big, on, hot_rows)
    sliced = salted_lookup(big, hot, on)
    sliced = sliced.withColumn(
        "_slice", F.when(F.col("_slices").isNotNull(), _row_salt(big, F.col("_slices"))).otherwise(F.lit(0).cast("long"))
    ).drop("_slices")
    repeated = small.join(hot, list(on), "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_slices") - 1, F.lit(0).cast("long"))))
    )
    return sliced.join(repeated.drop("_slices"), [*on, "_slice"], how).drop("_slice")


def running_sum(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str, previous: str | None = None
) -> DataFrame:
    """Running total of ``value`` per key, computed chunk by chunk.

    ``chunk`` must follow ``order`` (a day of a timestamp, a block of line
    numbers). Totals per chunk are small; only they are scanned per key.
    ``previous`` names a column for the total before the row, null at the first.
    ``df`` is read twice: hand in a written table when it is costly to make.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, chunk, F.sum("_total").over(before).alias("_before"))
    order_inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    inside = order_inside.rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.col("_before"), F.lit(0))
    summed = df.join(offsets, [*keys, chunk]).withColumn(out, base + F.sum(value).over(inside))
    if previous:
        summed = summed.withColumn(previous, F.coalesce(F.lag(out).over(order_inside), F.col("_before")))
    return summed.drop("_before")


def carry_forward(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row, computed chunk by chunk."""
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    tails = df.groupBy(*keys, chunk).agg(F.max_by(value, position).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, chunk, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(carried, [*keys, chunk])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_carried")
    )


def positions(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Position of each row of a key in the order of a column, from 1.

    Rows are dealt out by ranges of key and order, so the rows of a hot key
    lie in many partitions whatever their values look like; a partition counts its
    own, and sums over the partitions before it complete the positions.
    """
    dealt = stage(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    return dealt.withColumn("_row", inside).join(offsets, [key, "_part"]).withColumn(out, F.col("_row") + F.col("_before")).drop("_row", "_before", "_part")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histogram ``(keys, value, n)``: the pre-aggregate for ranks and percentiles."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, total: str, rank: str = "rank") -> DataFrame:
    """``top_k``, or all rows ranked with None; ``total`` names a column with the number of rows before the cut."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    if k is None:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = top_k(df, keys, order, k, rank)
    return salted_lookup(ranked, counts, keys)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key under a total order.

    ``row_number() <= k`` plans as a group limit on both sides of the shuffle,
    so a hot key ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
