"""Near duplicates by SimHash over pigeonhole blocks.

A fingerprint of 64 bits is cut into ``distance + 3`` blocks; two fingerprints
that differ in at most ``distance`` bits agree in at least three of them, so they meet
in the group of one choice of three blocks. With ``distance`` 2 that is ten
choices of 38 to 39 bits: at 10^11 documents a chance meeting is still rare,
which a key of one block (21 bits) would not give.

Equal fingerprints are one node before anything meets. In a group the links
come from comparing all where it is small, else from looking up every
fingerprint's neighbours over the bits outside the key (351 at most), so work
grows linearly with the group. A group gives a spanning forest of its links,
never all pairs.

Null texts count as empty. A text without words has fingerprint zero and is
linked like any other. Rows without an id get a component like others; it is
null only where no member has an id. Repeated rows give a row each. An empty
table gives none. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import text_chunks
from tidemark.llm.components import connected_components, dealt_anew, grouped, roots, spanning
from tidemark.llm.rows import NO_ID, text_digest
from tidemark.staging import stage

SEED = 42
SKETCH = 256  # bits that verify pairs of wide fingerprints
SMALL_GROUP = 32
TILE = 512  # rows of a doubtful cluster that are compared with as many others at once
COMPARE_ALL = 512  # groups up to this size are compared row by row; the result is the same


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of all shingles' XXH64; a bit that exactly half have is 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
        n = 1
    else:
        n = len(words) - width + 1
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))])
    bits = np.zeros(64, np.int64)
    each = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 200):  # sums of up to 200 bits fit a byte
        bits += np.unpackbits(each[at : at + 200], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, digest, bits`` of every row: MD5 of the text, and its 64 bits as a signed long."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
                own = (batch.column(c).slice(first, len(texts)) for c in ("doc_id", "digest"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def block_masks(distance: int) -> list[int]:
    """The masks of every choice of three blocks out of ``distance + 3``."""
    blocks = distance + 3
    ends = list(accumulate([64 // blocks + (i < 64 % blocks) for i in range(blocks)], initial=0))
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    return [x | y | z for x, y, z in combinations(masks, 3)]


def _group_links(bits: np.ndarray, mask: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that agree under ``mask``."""
    n = len(bits)
    if n <= COMPARE_ALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance, 1))
    else:
        bits = np.sort(bits)
        free = [np.uint64(1 << i) for i in range(64) if not mask >> i & 1]
        flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, distance + 1) for c in combinations(free, k)]
        left, right = [], []
        for flip in flips:
            other = bits ^ flip
            at = np.minimum(np.searchsorted(bits, other), n - 1)
            hit = np.flatnonzero((bits[at] == other) & (bits < other))
            left.append(hit)
            right.append(at[hit])
        a, b = np.concatenate(left), np.concatenate(right)
    label = roots(n, a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return bits[linked], bits[label[linked]]


def fingerprint_links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``a, b`` that join every two of the distinct ``bits`` within ``distance`` into one component."""
    masks = block_masks(distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    met = nodes.select("bits", F.explode(keys).alias("k")).select("k.choice", "k.key", "bits")
    met = met.repartition("choice", "key").sortWithinPartitions("choice", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, key, bits in grouped(batches, 2):
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for x, y in zip(begin[end - begin > 1], end[end - begin > 1], strict=True):
                a, b = _group_links(bits[x:y].view(np.uint64), masks[choice[x]], distance)
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, digest, bits, component_id, kept`` per row.

    ``component_id`` is the smallest id that links of ``distance`` bits or fewer
    reach; its document (of several with that id, the one with the smallest
    digest) is ``kept``, and so are rows that repeat it.
    """
    rows = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest")
    nodes = rows.groupBy("bits").agg(F.min(order).alias("_least"))
    linked = connected_components(fingerprint_links(nodes, distance))
    member = nodes.join(linked, F.col("bits") == F.col("node"), "left").select("bits", "_least", F.coalesce("component", "bits").alias("_component"))
    least = member.groupBy("_component").agg(F.min("_least").alias("_first"))
    of_bits = member.join(least.withColumn("_component", dealt_anew("_component")), "_component").select("bits", "_first")
    return rows.join(of_bits, "bits").select(
        "doc_id", "digest", "bits", F.nullif(F.col("_first.id"), F.lit(NO_ID)).alias("component_id"), (order == F.col("_first")).alias("kept")
    )


@dataclass(frozen=True)
class Blocks:
    """How wide fingerprints are split: ``count`` blocks of ``bits``, and ``SKETCH`` more bits to verify with."""

    bits: int
    count: int
    distance: int
    loose: int

    @property
    def total(self) -> int:
        return 1 << max(11, (self.bits * self.count + SKETCH - 1).bit_length())


def split_for(rows: int, similarity: float, recall: float) -> Blocks:
    """Blocks long enough that chance meetings stay in proportion to the rows, and so many that close pairs share one.

    Two sets of Jaccard similarity s have a cosine of 2s / (1 + s) and differ in a
    bit with probability arccos(cosine) / pi. ``distance`` allows what pairs at the
    similarity asked for differ by, and 1.3 standard deviations more; ``loose`` three.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    limit = lambda deviations: round(SKETCH * differ + deviations * math.sqrt(SKETCH * differ * (1 - differ)))
    return Blocks(bits, count, limit(1.3), limit(3))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of a text's different shingles."""
    words = text.lower().split()
    digest = xxhash.xxh64_digest
    shingles = {b" ".join(words)} if 0 < len(words) <= width else set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64)


def shingle_vector(text: bytes, width: int, size: int) -> np.ndarray:
    """The set of a text's shingles, each added with its sign at one of ``size`` places."""
    hashes = shingle_hashes(text, width)
    return np.bincount((hashes & np.uint64(size - 1)).astype(np.intp), np.where(hashes >> np.uint64(63), 1.0, -1.0), size)


def mixed(rows: np.ndarray) -> np.ndarray:
    """Rows turned by two rounds of random signs and a Walsh-Hadamard transform: as many random projections as columns."""
    n, size = rows.shape
    rows = rows.astype(np.float32)
    signs = np.random.default_rng([SEED, size]).integers(0, 2, (2, size)).astype(np.float32) * 2 - 1
    for sign in signs:
        rows = rows * sign
        half = 1
        while half < size:
            pair = rows.reshape(n, -1, 2, half)
            rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
    return rows


def close_links(group: np.ndarray, sketch: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows of a group within ``distance`` bits of each other; ``group`` is sorted.

    Small groups are compared row by row. In a large one a search spreads from row
    to row and compares each only with rows not yet reached, so a group of many
    near copies costs little more than its size, and gives one link per row.
    """
    near = lambda a, b: np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=-1, dtype=np.int64) <= distance
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, len(group)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(size <= SMALL_GROUP, size)
    for off in range(1, SMALL_GROUP):
        i = np.flatnonzero(small[:-off] & (group[:-off] == group[off:])) if off < len(group) else []
        if not len(i):
            break
        hit = i[near(i, i + off)]
        left.append(hit)
        right.append(hit + off)
    for b, n in zip(begin[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        unseen = np.arange(b, b + n)
        while len(unseen):
            reached, unseen = [int(unseen[0])], unseen[1:]
            for row in reached:
                if not len(unseen):
                    break
                hit = near(unseen, row)
                left.append(np.full(int(hit.sum()), row))
                right.append(unseen[hit])
                reached.extend(unseen[hit].tolist())
                unseen = unseen[~hit]
    return np.concatenate(left), np.concatenate(right)


def shared_counts(sets: list[np.ndarray], often: int = 32) -> np.ndarray:
    """How many values each two of the sets share: those of many sets by products of bit columns, the others by pairs."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(value)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    shared = np.zeros((n, n), np.int64)
    many = df[value] > often
    hot, hot_value = row[many], np.unique(value[many], return_inverse=True)[1]
    for low in range(0, int(hot_value.max(initial=-1)) + 1, 4096):
        here = (hot_value >= low) & (hot_value < low + 4096)
        bits = np.zeros((n, 4096), np.float32)
        bits[hot[here], hot_value[here] - low] = 1
        shared += (bits @ bits.T).astype(np.int64)
    row, value = row[~many], value[~many]
    for off in range(1, often):
        at = np.flatnonzero(value[off:] == value[:-off]) if off < len(value) else []
        if not len(at):
            break
        shared += np.bincount(row[at] * n + row[at + off], minlength=n * n).reshape(n, n)
    return np.maximum(shared, shared.T)


def joining_links(label: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of different labels whose sets are similar: a forest that joins all labels such links join."""
    size = np.array([len(x) for x in sets])
    shared = shared_counts(sets)
    near = shared >= (size[:, None] + size[None, :] - shared) * similarity - 1e-9
    a, b = np.nonzero(np.triu(near & (label[:, None] != label[None, :]), 1))
    labels, of = np.unique(label, return_inverse=True)
    own = np.arange(len(labels))
    while len(a):  # a link is kept where it joins two trees; rounds of one link per tree
        x, y = own[of[a]], own[of[b]]
        a, b, x, y = a[x != y], b[x != y], x[x != y], y[x != y]
        if not len(a):
            break
        first = np.unique(np.maximum(x, y), return_index=True)[1]
        yield a[first], b[first]
        own = roots(len(labels), np.concatenate([np.arange(len(labels)), x[first]]), np.concatenate([own, y[first]]))


def _pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray]], held_pairs: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes as ``a < b``, without repeats among those held at once."""
    held, n = [np.zeros((2, 0), np.int64)], 0

    def batch() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for a, b in found:
        held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        n += len(a)
        if n > held_pairs:
            yield batch()
            held, n = held[:1], 0
    yield batch()


def _in_tiles(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """``cluster, low, high, node, label, shingles``: rows of doubtful clusters, once for each tile they are compared in.

    The label that most rows of a cluster have is settled among itself: its blocks
    meet the blocks of all other rows, and those meet each other.
    """
    counts = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / F.lit(TILE)).cast("long")
    sized = major.where("n > n_major").select("cluster", "major", blocks(F.col("n") - F.col("n_major")).alias("minor_blocks"), blocks(F.col("n_major")).alias("major_blocks"))
    placed = labelled.join(sized.withColumn("cluster", dealt_anew("cluster")), "cluster").withColumn("is_major", F.col("label") == F.col("major"))
    turn = F.xxhash64("node")
    own = F.when(F.col("is_major"), F.col("minor_blocks") + F.pmod(turn, F.col("major_blocks"))).otherwise(F.pmod(turn, F.col("minor_blocks")))
    others = F.when(F.col("is_major"), F.col("minor_blocks")).otherwise(F.col("minor_blocks") + F.col("major_blocks"))
    met = placed.withColumn("own", own).select("cluster", "node", "label", "own", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
    tiled = met.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label")
    full = tiled.join(sets, "node").select("cluster", "low", "high", "node", "label", "shingles")
    return full.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each tile, gathered from sorted batches: ``cluster, low, high, node, label, shingles``."""
    key, held = None, []

    def whole() -> tuple:
        table = pa.Table.from_batches(held)
        shingles = table.column("shingles").combine_chunks()
        ends = shingles.offsets.to_numpy()
        values = shingles.values.to_numpy()
        return (*key, table.column("node").to_numpy(), table.column("label").to_numpy(), [values[x:y] for x, y in zip(ends, ends[1:], strict=False)])

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("cluster", "low", "high")]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
        bounds = [0, *edge, batch.num_rows] if batch.num_rows else []
        for x, y in zip(bounds, bounds[1:], strict=False):
            now = tuple(int(c[x]) for c in columns)
            if now != key:
                if held:
                    yield whole()
                key, held = now, []
            held.append(batch.slice(x, y - x))
    if held:
        yield whole()


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, component_id, kept`` per row, for documents that share ``similarity`` of their shingles of ``width`` words.

    64 bits cannot tell such pairs apart by shared blocks: at 0.8 they differ in
    ten bits. So fingerprints are as wide as blocks of about log2(rows) bits must
    be many for pairs at the threshold to share one with probability ``recall``;
    closer pairs share one more surely. Rows grow as documents ** 1.24, chance
    meetings with them.

    The sketch only proposes: a link counts if the shingles' Jaccard similarity,
    taken exactly over their hashes, is ``similarity`` or more. Proposed first are
    links that span all rows of a group within the loose limit, so near copies are
    confirmed in proportion to their number. Where one of them is refuted, the rows
    around it are compared whole, in tiles: a row's shingles go to the tiles of its
    cluster, a task compares the rows of a tile that are not joined yet and gives
    only links that join more of them. So no row ever stands for a pair of
    look-alikes, but their comparison costs the square of those that are left over
    when most of a cluster is one component already. ``kept`` is as in ``near_duplicates``.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    blocks = split_for(docs.count(), similarity, recall)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                for at in range(0, len(texts), 256):
                    part = texts[at : at + 256]
                    bits = np.packbits(mixed(np.stack([shingle_vector(t, width, blocks.total) for t in part])) > 0, axis=1)
                    own = (batch.column(c).slice(first + at, len(part)) for c in ("doc_id", "digest"))
                    yield pa.RecordBatch.from_arrays([*own, pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "digest", "bits"])

    rows = stage(named.mapInArrow(wide, "doc_id long, digest binary, bits binary"), "fingerprints")
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest")
    nodes = stage(rows.groupBy("bits").agg(F.min(order).alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(blocks.bits, dtype=np.uint64)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1_000):
                batch = whole.slice(begin, 1_000)
                n = batch.num_rows
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(n, -1), axis=1)
                sketch = np.packbits(bits[:, :SKETCH], axis=1).view(np.int64)
                keys = bits[:, SKETCH : SKETCH + blocks.bits * blocks.count].reshape(n, blocks.count, blocks.bits) @ weight
                keys = (np.arange(blocks.count, dtype=np.uint64) << np.uint64(40) | keys.astype(np.uint64)).view(np.int64)
                again = lambda x: pa.array(np.repeat(x, blocks.count))
                own = batch.schema.names[1:]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(again(batch.column(c).to_numpy()) for c in own), *(again(sketch[:, k]) for k in range(SKETCH // 64))], names=["key", *own, *(f"s{k}" for k in range(SKETCH // 64))])

    sketches = "".join(f", s{k} long" for k in range(SKETCH // 64))

    def met(found: DataFrame) -> DataFrame:
        own = "".join(f", {c} long" for c in found.columns[1:])
        return found.mapInArrow(spread, f"key long{own}{sketches}").repartition("key").sortWithinPartitions("key")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for key, node, *sketch in grouped(batches):
                for limit in (blocks.distance, blocks.loose):
                    a, b = close_links(key, np.stack(sketch, axis=1).view(np.uint64), limit)
                    yield node[a], node[b]

        yield from _pair_batches(found())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                sets = [shingle_hashes(t, width).view(np.int64) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, _, _, node, label, shingles in _tiles_of(batches):
                for a, b in joining_links(label, shingles, similarity):
                    yield node[a], node[b]

        yield from _pair_batches(found())

    proposed = stage(met(nodes.select("bits", "node")).mapInArrow(propose, "a long, b long").distinct(), "proposed")
    ends = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("first.digest").alias("digest"))
    sets = stage(named.select("digest", "text").join(wanted, "digest").select("node", "text").mapInArrow(cut, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")

    def judged(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
        return both.select("a", "b", (F.col("shared") >= (F.size("x") + F.size("y") - F.col("shared")) * similarity - 1e-9).alias("near"))

    first = stage(judged(proposed), "judged")
    links = first.where("near").select("a", "b")
    linked = connected_components(links)
    refuted = first.where(~F.col("near")).select(F.col("a").alias("node"))
    if refuted.head(1):
        around = stage(connected_components(proposed).withColumnRenamed("component", "cluster"), "clusters")
        doubtful = around.join(refuted.join(around, "node").select("cluster").distinct(), "cluster", "left_semi")
        labelled = stage(doubtful.join(linked, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("label")), "doubtful")
        found = _in_tiles(labelled, sets).mapInArrow(decide, "a long, b long")
        linked = connected_components(links.unionByName(found))
    member = nodes.join(linked, "node", "left").select("bits", "first", F.coalesce("component", "node").alias("_component"))
    least = member.groupBy("_component").agg(F.min("first").alias("_first"))
    of_bits = member.join(least.withColumn("_component", dealt_anew("_component")), "_component").select("bits", "_first")
    return rows.join(of_bits, "bits").select("doc_id", "digest", F.nullif(F.col("_first.id"), F.lit(NO_ID)).alias("component_id"), (order == F.col("_first")).alias("kept"))
