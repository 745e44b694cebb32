"""Repeated substrings by deep-shallow suffix sorting.

A byte goes if it lies in a string of ``least`` bytes that also starts anywhere
else. All strings of that length that could repeat are found through anchors:

* Every window of ``least`` bytes picks the position in it whose following bytes
  have the smallest hash. Equal windows pick the same relative position, so
  they meet at equal anchors. Windows with one anchor form a segment.
* Anchors whose following ``shallow`` bytes occur once in the corpus cannot
  stand in a repeat. A Bloom-style table of fixed size tells most of them in a
  second scan, before anything but a hash is shuffled.
* Segments that occur twice as a whole repeat in all their windows. What is
  left, different segments around equal anchors, is compared by sorting the
  suffixes that start at the anchors: a multikey quicksort over eight-byte
  digits to the shallow depth, then a blind trie for each group that agrees so
  far. A second blind trie orders what stands before the anchors, backwards.
  A node of the first trie at depth ``f`` and neighbours in the second that
  agree in ``b`` bytes make the windows from ``least - f`` to ``b`` bytes before
  the anchor repeats, if there are any.

A group of more than ``group_rows`` different segments is not sorted in one task:
its windows become rows, counted with map-side sums. The result is the same.

Texts are UTF-8 bytes, matches never cross documents, and spans are judged on
the input. Null texts count as empty. Rows with equal texts share one result
and repeat each other; ids may be null or repeated. An empty table gives no rows.
Texts of any length are read whole; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks
from tidemark.llm.filters import bit_table, in_table
from tidemark.llm.rows import text_digest
from tidemark.staging import stage

GROUP_ROWS = 50_000
ROWS_PER_TASK = 20_000
_GEAR = np.random.default_rng(20_041).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


class Anchors:
    """Anchors of the windows of ``least`` bytes; ``shallow``: bytes of an anchor that its windows always hold."""

    def __init__(self, least: int):
        self.least = least
        self.shallow = max(1, least * 8 // 25)
        self.choice = least - self.shallow + 1
        self.rounds = self.shallow.bit_length() - 1

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``anchor, first, last``: positions of anchors and of the first and last window start of each segment."""
        n = len(data)
        none = np.zeros(0, np.int64)
        if n < self.least:
            return none, none, none
        order = _GEAR[data]
        for r in range(self.rounds):
            step = 1 << r
            order[:-step] = (order[:-step] << np.uint32(step)) + order[step:]
        order *= np.uint32(0x9E3779B1)
        order ^= order >> np.uint32(15)
        w = self.choice
        blocks = -(-n // w) + 1
        ranked = np.full(blocks * w, np.iinfo(np.uint64).max)
        ranked[:n] = order.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        square = ranked.reshape(blocks, w)
        before = np.minimum.accumulate(square, axis=1).ravel()
        after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.least + 1
        chosen = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))[:starts]
        whole = np.flatnonzero(np.arange(starts) + self.least <= ends)
        chosen = chosen[whole]
        if not len(whole):
            return none, none, none
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1] + 1)]))
        return chosen[new], whole[new], whole[np.append(new[1:], len(whole)) - 1]

    def keys(self, joined: bytes, anchor: np.ndarray) -> np.ndarray:
        """Hash of the shallow bytes at each anchor."""
        k = self.shallow
        return np.fromiter((xxhash.xxh64_intdigest(joined[a : a + k]) for a in anchor.tolist()), np.uint64, len(anchor))


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _anchor_rows(texts: DataFrame, least: int, schema: str, emit: Callable) -> DataFrame:
    """Rows that ``emit`` makes of ``(joined, offsets, digests, anchor, first, last, keys)`` portion by portion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Anchors(least)
        for batch in batches:
            for row, held in text_chunks(batch.column("text"), 1 << 20):
                joined = b"".join(held)
                offsets = np.cumsum([0, *map(len, held)])
                found = own.find(np.frombuffer(joined, np.uint8), offsets)
                if len(found[0]):
                    digests = batch.column("digest").slice(row, len(held)) if "digest" in batch.schema.names else None
                    out = emit(joined, offsets, digests, *found, own.keys(joined, found[0]))
                    if out is not None:
                        yield out

    return texts.mapInArrow(run, schema)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Sorts strings that share long prefixes: branches on single bytes, compares each new string with one leaf only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [None, {}, [0]]  # depth (None: leaf), children by byte (-1: end), members of a leaf
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        new, node = self.strings[i], self.root
        while node[0] is not None:
            key = new[node[0]] if node[0] < len(new) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        same = _common(new, other)
        if same == len(new) == len(other):
            node[2].append(i)
            return
        parent, key, node = None, 0, self.root
        while node[0] is not None and node[0] < same:
            parent, key = node, new[node[0]] if node[0] < len(new) else -1
            node = node[1][key]
        mine = new[same] if same < len(new) else -1
        leaf = [None, {}, [i]]
        if node[0] == same:
            node[1][mine] = leaf
            return
        split = [same, {other[same] if same < len(other) else -1: node, mine: leaf}, None]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def walk(self) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        """Order of the strings, common prefix of each with the next, and ``(depth, begin, end)`` of every inner node or shared leaf."""
        order: list[int] = []
        common: list[int] = []
        nodes: list[tuple[int, int, int]] = []
        todo: list[tuple[list, int, int]] = [(self.root, -1, 0)]
        while todo:
            node, begin, shared = todo.pop()
            if begin >= 0:
                nodes.append((node[0], begin, len(order)))
                continue
            if node[0] is None:
                members = node[2]
                if order:
                    common.append(shared)
                if len(members) > 1:
                    size = len(self.strings[members[0]])
                    nodes.append((size, len(order), len(order) + len(members)))
                    common.extend([size] * (len(members) - 1))
                order.extend(members)
                continue
            todo.append((node, len(order), 0))
            kids = sorted(node[1].items(), key=lambda x: x[0])
            for k in range(len(kids) - 1, -1, -1):
                todo.append((kids[k][1], -1, node[0] if k else shared))
        return order, common, nodes


def group_repeats(least: int, heads: list[bytes], tails: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each segment, ranges ``(from, to)`` of how many bytes before the anchor a repeated window may start.

    ``tails``: bytes from the anchor on; ``heads``: bytes before it, backwards.
    """
    n = len(tails)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        f, b = _common(tails[0], tails[1]), _common(heads[0], heads[1])
        if f + b >= least:
            found[0].append((max(0, least - f), b))
            found[1].append((max(0, least - f), b))
        return found
    order, _, nodes = BlindTrie(tails).walk()
    back, agree, _ = BlindTrie(heads).walk()
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)
    by_tail = rank[order]
    lows = np.array([*agree, 0], np.int64)
    for depth, begin, end in nodes:
        need = max(0, least - depth)
        at = np.sort(by_tail[begin:end])
        near = np.minimum.reduceat(lows, at)[:-1]
        best = np.maximum(np.append(near, 0), np.append(0, near))
        for r, b in zip(at[best >= need].tolist(), best[best >= need].tolist(), strict=True):
            found[back[r]].append((need, b))
    return found


def shallow_groups(tails: np.ndarray) -> Iterator[np.ndarray]:
    """Rows that agree in all columns of an eight-byte digit matrix: multikey quicksort, digit by digit."""
    rows, group = np.arange(len(tails)), np.zeros(len(tails), np.int64)
    for digit in range(tails.shape[1]):
        value = tails[rows, digit]
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(rows) else np.zeros(0, bool)
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        rows, group = rows[several], group[several]
    if len(rows):
        yield from np.split(rows, np.flatnonzero(np.diff(group)) + 1)


def repeated_windows(docs: DataFrame, least: int = 200, text_col: str = "text", group_rows: int = GROUP_ROWS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``digest, spans`` of the texts (MD5 of their bytes) with repeats; ``spans``: array of ``start, end`` covered, unmerged."""
    context = docs.sparkSession.sparkContext
    text = _texts(docs, text_col)
    plain = docs.select(text.alias("text"))
    named = docs.select(text.alias("text"), text_digest(text_col).alias("digest"))
    signed = lambda x: pa.array(x.view(np.int64))
    batch = lambda names, *columns: pa.RecordBatch.from_arrays(list(columns), names=names.split())

    def count(joined, offsets, digests, anchor, first, last, keys):  # noqa: ANN001, ANN202
        one, n = np.unique(keys, return_counts=True)
        return batch("key n", signed(one), pa.array(n))

    twice = _anchor_rows(plain, least, "key long, n long", count).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    marks = context.broadcast(bit_table(twice.select("key"), "key"))

    def hashes(joined: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(first.tolist(), (last + least).tolist(), strict=True)), np.uint64, len(first))

    def meet(joined, offsets, digests, anchor, first, last, keys):  # noqa: ANN001, ANN202
        keep = np.flatnonzero(in_table(marks.value, keys))
        if not len(keep):
            return None
        anchor, first, last, keys = anchor[keep], first[keep], last[keep], keys[keep]
        doc = np.searchsorted(offsets, first, side="right") - 1
        base = offsets[doc]
        places = (pa.array((x - base).astype(np.int64)) for x in (anchor, first, last))
        return batch("digest key segment anchor first last", digests.take(pa.array(doc)), signed(keys), signed(hashes(joined, first, last)), *places)

    rows = stage(_anchor_rows(named, least, "digest binary, key long, segment long, anchor long, first long, last long", meet), "anchors")
    classes = stage(rows.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n")), "segments")
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least_n")).where("kinds > 1 AND least_n = 1")
    open_keys = stage(mixed.select("key", "kinds"), "mixed")
    open_marks = context.broadcast(bit_table(open_keys.select("key"), "key"))

    def contents(joined, offsets, digests, anchor, first, last, keys):  # noqa: ANN001, ANN202
        keep = np.flatnonzero(in_table(open_marks.value, keys))
        if not len(keep):
            return None
        anchor, first, last, keys = anchor[keep], first[keep], last[keep], keys[keep]
        segment = hashes(joined, first, last)
        _, one = np.unique(segment, return_index=True)
        cut = [joined[a:b] for a, b in zip(first[one].tolist(), (last[one] + least).tolist(), strict=True)]
        return batch("key segment before content", signed(keys[one]), signed(segment[one]), pa.array(anchor[one] - first[one]), pa.array(cut, pa.binary()))

    segments = _anchor_rows(plain, least, "key long, segment long, before long, content binary", contents).dropDuplicates(["key", "segment"])
    compared = stage(segments.join(open_keys, "key"), "compared")
    sorted_here, split_up = compared.where(F.col("kinds") <= group_rows), compared.where(F.col("kinds") > group_rows)
    tasks = max(1, -(-sorted_here.count() // rows_per_task))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, segment, before = (table.column(c).to_numpy() for c in ("key", "segment", "before"))
        content = table.column("content").to_pylist()
        tails = [c[b:] for c, b in zip(content, before.tolist(), strict=True)]
        heads = [c[:b][::-1] for c, b in zip(content, before.tolist(), strict=True)]
        depth = Anchors(least).shallow
        digits = np.frombuffer(b"".join([t[:depth].ljust(-(-depth // 8) * 8, b"\0") for t in tails]), ">u8").astype(np.uint64).reshape(len(tails), -1)
        row, start, end = [], [], []
        for group in shallow_groups(digits):
            at = group.tolist()
            for i, ranges in zip(at, group_repeats(least, [heads[i] for i in at], [tails[i] for i in at]), strict=True):
                for a, b in set(ranges):
                    row.append(i)
                    start.append(a)
                    end.append(b)
        yield batch("key segment near far", pa.array(key[row]), pa.array(segment[row]), pa.array(start, pa.int64()), pa.array(end, pa.int64()))

    found = sorted_here.select("key", "segment", "before", "content").repartition(tasks, "key").mapInArrow(compare, "key long, segment long, near long, far long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for key, segment, before, content in zip(*(part.column(c).to_pylist() for c in ("key", "segment", "before", "content")), strict=True):
                n = len(content) - least + 1
                digests = [xxhash.xxh3_128_digest(content[i : i + least]) for i in range(n)]
                yield batch("key segment near window", pa.array([key] * n), pa.array([segment] * n), pa.array([before - i for i in range(n)]), pa.array(digests, pa.binary()))

    rows_of = split_up.mapInArrow(windows, "key long, segment long, near long, window binary")
    shared = rows_of.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "window")
    counted = rows_of.join(shared, ["key", "window"]).select("key", "segment", "near", F.col("near").alias("far"))
    whole = classes.where("n > 1").select("key", "segment", F.lit(None).cast("long").alias("near"), F.lit(None).cast("long").alias("far"))
    repeats = found.unionByName(counted).unionByName(whole)
    spans = rows.join(repeats, ["key", "segment"]).select(
        "digest", F.coalesce(F.col("anchor") - F.col("far"), F.col("first")).alias("start"),
        (F.coalesce(F.col("anchor") - F.col("near"), F.col("last")) + least).alias("end"),
    )
    return spans.distinct().groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover; runs that touch are one."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row: the removed runs and the remaining bytes."""
    text = _texts(docs, text_col)
    spans = repeated_windows(docs, least, text_col, group_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_digest(text_col).alias("digest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                size, runs, kept = [], [], []
                for data, found in zip(part.column("text"), part.column("spans"), strict=True):
                    data = data.as_py()
                    removed = merge_spans([(s["start"], s["end"]) for s in found.as_py() or ()])
                    bounds = [0, *(x for run in removed for x in run), len(data)]
                    size.append(len(data))
                    runs.append([{"start": a, "end": b} for a, b in removed])
                    kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, "digest", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
