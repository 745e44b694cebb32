"""Near duplicates among embeddings by sorted projection passes.

Equal vectors of a label are one class from the start. In every pass the classes
are ordered lexicographically by label and by 64 concatenated random hashes (the
sides of random hyperplanes through the label's mean), and every class is
compared with the ``window`` classes before it. Pairs are verified by their
cosine in double precision and united over the passes.

Places in the order are counted over all ranges of rows, so a window never ends
at the edge of a task: the order is cut into blocks, and each block brings the
``window`` places before it along. A pair meets in a pass if its places differ by
at most ``window``. Rows carry their places in all passes, so a link is counted in
the first pass it meets in, and what leaves a task is one count per class and a
spanning forest of its links, never a row per pair.

How many passes there are follows from the data, at every size alike. The first
ones are as many as a pair at the threshold needs to meet with probability
``recall`` if the classes of the largest label are spread evenly: it keeps company
on the first ``log2(rows / window)`` hyperplanes. Vectors that lie densely need
more. So batches of passes follow until the last pass found so few new links
that, by the share of all links that it met, ``recall`` of them are known.

Rows whose label is null, or whose vector is null, empty, zero or holds a null
or non-finite component, link with nothing; neither do rows without an id.
Vectors of different lengths are not compared. Repeated rows are copies like
any other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components, dealt_anew, spanning
from tidemark.staging import stage, unstage

SEED = 8_191
WINDOW = 2_048
BLOCK = 4  # a block holds so many windows of places
ROUNDING = 1e-9  # products of matrices are searched this far below the threshold, then taken pair by pair


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[begins[at][:, None] + np.arange(d)]


def passes_for(rows: int, threshold: float, recall: float, window: int) -> int:
    """Passes in which a pair at ``threshold`` comes within ``window`` places with probability ``recall``, among evenly spread rows.

    A hyperplane parts it with probability arccos(threshold) / pi, each on its own.
    """
    together = (1 - math.acos(threshold) / math.pi) ** max(0, math.ceil(math.log2(max(rows, 1) / window)))
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def keys(unit: np.ndarray, number: int) -> np.ndarray:
    """Keys of a pass: the sides of its 64 hyperplanes as longs that sort as the concatenated hashes do."""
    d = unit.shape[1]
    directions = np.random.default_rng([SEED, number, d]).standard_normal((64, d)).T
    key = np.packbits(unit @ directions > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _with_means(classes: DataFrame) -> DataFrame:
    """Classes with the mean of their label's unit vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_pylist()
            for at, matrix in _matrices(batch.column("vector")):
                unit = _unit(matrix)
                names, of = np.unique([repr(label[i]) for i in at], return_inverse=True)
                first = [label[at[int(np.argmax(of == k))]] for k in range(len(names))]
                for k, name in enumerate(first):
                    own = unit[of == k]
                    d = own.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * d, batch.schema.field("label").type), pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(own.sum(axis=0)), pa.array(np.full(d, len(own)))],
                        names=["label", "size", "at", "total", "n"],
                    )

    schema = T.StructType([classes.schema["label"], *(T.StructField(c, T.IntegerType()) for c in ("size", "at")), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = classes.select("label", "vector").mapInArrow(sums, schema).groupBy("label", "size", "at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("mean")
    return classes.withColumn("size", F.size("vector")).join(parts.groupBy("label", "size").agg(mean), ["label", "size"])


def _places(centred: DataFrame, numbers: range) -> DataFrame:
    """``node, places``: the place of every class in the order of each pass, over all labels."""
    schema = T.StructType([centred.schema["node"], centred.schema["label"], centred.schema["size"], T.StructField("number", T.IntegerType()), T.StructField("key", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2_000):
                batch = whole.slice(begin, 2_000)
                means = [x for _, x in sorted(((i, m) for at, rows in _matrices(batch.column("mean")) for i, m in zip(at, rows, strict=True)), key=lambda x: x[0])]
                for at, matrix in _matrices(batch.column("vector")):
                    unit = _unit(matrix) - np.stack([means[i] for i in at])
                    part = batch.take(pa.array(at))
                    for number in numbers:
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "label", "size")), pa.array(np.full(len(at), number, np.int32)), pa.array(keys(unit, number))], names=schema.names)

    order = ["number", "label", "size", "key", "node"]
    keyed = centred.select("node", "label", "size", "vector", "mean").mapInArrow(spread, schema)
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("number", "node", F.monotonically_increasing_id().alias("row"))
    dealt = stage(dealt, "order")
    part = F.shiftrightunsigned("row", 33)
    sizes = dealt.groupBy("number", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("number", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = dealt.withColumn("part", part).join(offsets, ["number", "part"]).select("node", F.struct("number", (F.col("row") + F.col("shift")).alias("place")).alias("p"))
    out = stage(placed.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["place"]).alias("places")), "places")
    unstage(dealt)
    return out


def _band_pairs(place: np.ndarray, group: np.ndarray, unit: np.ndarray, owned: np.ndarray, threshold: float, window: int, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``i < j`` of a block in the order of ``place``: ``j`` owned, at most ``window`` places apart, of one group, cosine at or over ``threshold``."""
    start = int(np.argmax(owned)) if owned.any() else len(place)
    for begin in range(start, len(place), rows):
        end = min(begin + rows, len(place))
        low = int(np.searchsorted(place, place[begin] - window))
        i, j = np.nonzero(unit[low:end] @ unit[begin:end].T >= threshold - ROUNDING)
        i, j = i + low, j + begin
        near = (i < j) & (place[j] - place[i] <= window) & (group[i] == group[j])
        i, j = i[near], j[near]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            yield a[hit], b[hit]


def _compared(rows: DataFrame, number: int, threshold: float, window: int) -> DataFrame:
    """``a, b, links, met`` of pass ``number``: forest links ``a, b``; per class ``a`` the rows it newly links with; and how many pairs met.

    ``rows(node, label, size, vector, copies, places)``.
    """
    own = F.col("places")[number]
    first = F.floor(own / (BLOCK * window))
    last = F.floor((own + window) / (BLOCK * window))
    dealt = rows.withColumn("block", F.explode(F.sequence(first, last))).select("block", own.alias("place"), (F.col("block") == first).alias("owned"), "node", "label", "size", "vector", "copies", "places")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "place")

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        place, owned, node, copies = (table.column(c).to_numpy() for c in ("place", "owned", "node", "copies"))
        places = table.column("places").chunk(0).flatten().to_numpy().reshape(len(node), -1)[:, :number]
        label = table.column("label").to_numpy(zero_copy_only=False)
        group = np.cumsum(np.concatenate([[0], label[1:] != label[:-1]]))
        links, met, counts = np.zeros((2, 0), np.int64), [0, 0], np.zeros(len(node), np.int64)
        for at, matrix in _matrices(table.column("vector").chunk(0)):
            unit = _unit(matrix)
            for i, j in _band_pairs(place[at], group[at], unit, owned[at], threshold, window):
                i, j = at[i], at[j]
                fresh = ~(np.abs(places[i] - places[j]) <= window).any(axis=1)
                met[0] += len(i)
                met[1] += int(fresh.sum())
                i, j = i[fresh], j[fresh]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                links = spanning(np.concatenate([links, np.stack([node[i], node[j]])], axis=1)) if len(i) else links
        some = np.flatnonzero(counts)
        n = links.shape[1] + len(some) + 1
        a = np.concatenate([links[0], node[some], [0]])
        b, c = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        b[: links.shape[1]] = links[1]
        c[links.shape[1] : n - 1] = counts[some]
        pairs, new = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs[-1], new[-1] = met
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, c, pairs, new)], names=["a", "b", "links", "met", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            edge = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)] if len(block) else []
            for x, y in zip(edge, edge[1:], strict=False):
                if held and block[x] != now:
                    yield from found(held)
                    held = []
                now = block[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from found(held)

    return dealt.mapInArrow(run, "a long, b long, links long, met long, fresh long")


def window_links(classes: DataFrame, threshold: float, recall: float, window: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that join the classes ``node, label, vector, copies`` as all links found do, and ``node, others``: rows each links with."""
    centred = stage(_with_means(classes), "centred")
    largest = centred.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    batch = passes_for(largest, threshold, recall, window)
    outputs, places, done, known = [], None, 0, 0
    while largest > 1:
        more = _places(centred, range(done, done + batch))
        places = more if places is None else stage(places.join(more.withColumnRenamed("places", "more"), "node").select("node", F.concat("places", "more").alias("places")), "places")
        rows = centred.drop("mean").join(places, "node")
        for number in range(done, done + batch):
            outputs.append(stage(_compared(rows, number, threshold, window), "pass"))
        done += batch
        met, fresh = [], []
        for out in outputs[-batch:]:
            x, y = out.agg(F.sum("met"), F.sum("fresh")).first()
            met.append(x or 0)
            fresh.append(y or 0)
        known += sum(fresh)
        # the last pass met this share of all links, so this many times its new ones were unknown before it
        if largest <= window or known == 0 or fresh[-1] <= (1 - recall) * met[-1]:
            break
    if not outputs:
        none = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        return none, none.select(F.col("a").alias("node"), F.col("b").alias("others"))
    every = outputs[0]
    for out in outputs[1:]:
        every = every.unionByName(out)
    others = every.where("links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    return every.where("b >= 0").select("a", "b"), others


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, window: int = WINDOW,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    vector = F.col("_vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_vector"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    hashes = [F.when(usable, F.xxhash64(vector)).alias("_h1"), F.when(usable, F.xxhash64(F.reverse(vector), F.size(vector))).alias("_h2")]
    found = rows.where(usable).select("*", *hashes).groupBy("label", "_h1", "_h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("_vector").alias("vector"))
    classes = stage(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs, linked = window_links(classes.select("node", "label", "vector", "copies"), threshold, recall, window)
    small = classes.select("node", "least", "copies")
    member = small.join(connected_components(pairs), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = (
        member.join(least.withColumn("component", dealt_anew("component")), "component").join(linked, "node", "left").join(classes.select("node", "label", "_h1", "_h2"), "node")
        .select("label", "_h1", "_h2", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    narrow = rows.select("vec_id", "label", *hashes)
    joined = narrow.join(facts, ["label", "_h1", "_h2"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
