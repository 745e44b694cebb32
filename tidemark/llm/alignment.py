"""Alignment of two tokenizers by an inverted index of id pairs with compressed document bitmaps.

Each text is cut into groups at the byte offsets where a token of both
tokenizers ends; every token of the one links with every token of the other in
its group. Both must end a token before the blanks of a word, so each different
word that a task remembers is aligned once. The links become an inverted index: documents are numbered, 65,536
numbers are a part, and for each id pair and part a bitmap says which documents
hold the pair. What a document holds more than once is written in multiplicity
planes: plane ``k`` (from 1) marks the documents whose number of links less one
has bit ``k - 1``.

* ``pair_index`` encodes the texts and emits bitmaps, combined in the task over
  about ``LINKS_HELD`` links, together with a row per document.
* ``merged`` brings the bitmaps of a pair and part together and ORs them.
* ``pair_counts`` adds up their population counts: documents from plane 0, links
  from all planes; and says which pairs are their first id's most frequent.
* ``returned_scores`` gives each bitmap its pair's counts and hands them back
  along the postings: a task holds two numbers for each document of a part.

No row exists per link. A pair that stands in every document costs a bit per
document; its bitmaps lie in as many rows as there are parts, and adaptive
execution may split them. A part is bounded, so no task holds a whole corpus.

A bitmap (``bits``) is a sorted list of 16-bit numbers, or, where that is
shorter, one bit per document of the part with a trailing byte that tells the
two apart (lists have an even length, bitmaps an odd one).

Null and empty texts, and texts whose tokens' joined bytes are not the blank and
the text (such as those with the marker character U+2581), have no tokens: zeros
and an empty string. Rows that repeat an id are documents of their own. An empty
table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec, sha256, text_chunks
from tidemark.llm.pieces import marked_words, piece_codec
from tidemark.staging import stage

PART_BITS = 16
LINKS_HELD = 2_000_000
#: Text bytes aligned at once, a longer document alone; and most different units remembered.
ALIGNED_BYTES, UNITS_HELD = 4 << 20, 300_000
#: Groups with more links than this are reduced to their different ids before they are paired.
WIDE_GROUP = 1 << 16

_ROW = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "pair long, part long, plane int, bits binary"


@dataclass
class Aligned:
    """A portion of texts aligned: ids in order, flags of the tokens that end a group, and what each text has."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @functools.cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group of each token of either side, and how many tokens of either side a group has."""
        of_a = np.cumsum(self.ends_a) - self.ends_a
        of_b = np.cumsum(self.ends_b) - self.ends_b
        n = int(self.ends_a.sum())
        return of_a, of_b, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)

    def per_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups and links of each text, and the text of each group."""
        _, _, in_a, in_b = self.groups
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.ends_a]
        n_groups = np.bincount(text, minlength=len(self.n_a))
        n_links = np.zeros(len(self.n_a), np.int64)
        np.add.at(n_links, text, in_a * in_b)
        return n_groups, n_links, text

    def shown(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of each group."""
        of_a, of_b, in_a, in_b = self.groups
        size = len(self.a) + len(self.b)
        ids, mark = np.zeros(size, np.int64), np.zeros(size, np.uint8)
        at_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[of_a]
        at_b = np.arange(len(self.b)) + np.cumsum(in_a)[of_b]
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a], mark[at_b] = np.where(self.ends_a, ord("|"), ord(",")), np.where(self.ends_b, ord(";"), ord(","))
        digits, width = _decimal(1 << int(ids.max(initial=1)).bit_length())
        cells = np.zeros((size, digits.shape[1] + 1), np.uint8)
        cells[:, :-1] = digits[ids]
        cells[np.arange(size), width[ids]] = mark
        length = np.concatenate([[0], np.cumsum(width[ids] + 1)])
        flat = cells[cells != 0].tobytes()
        bounds = length[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [flat[x : y - 1] for x, y in zip(bounds, bounds[1:], strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links as ``(text, pair, how many)``: ``pair`` is the one id times 65,536 plus the other; pairs may repeat."""
        of_a, of_b, in_a, in_b = self.groups
        _, _, text = self.per_text()
        wide = in_a * in_b > WIDE_GROUP
        first_b = np.cumsum(in_b) - in_b
        plain = np.flatnonzero(~wide[of_a]) if wide.any() else np.arange(len(of_a))
        times = in_b[of_a[plain]]
        left = np.repeat(plain, times)
        right = np.arange(len(left)) + np.repeat(first_b[of_a[plain]] - (np.cumsum(times) - times), times)
        parts = [(text[of_a[left]], self.a[left].astype(np.int64) << 16 | self.b[right], np.ones(len(left), np.int64))]
        first_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(wide):
            x, n_x = np.unique(self.a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, n_y = np.unique(self.b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pairs = (x.astype(np.int64)[:, None] << 16 | y[None, :]).ravel()
            parts.append((np.full(len(pairs), text[g]), pairs, (n_x[:, None] * n_y[None, :]).ravel()))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@functools.cache
def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, as ASCII from the left, and how many each has."""
    shown = np.array([b"%d" % i for i in range(size)])
    digits = shown.view(np.uint8).reshape(size, -1)
    return digits, (digits != 0).sum(axis=1)


@functools.cache
def _sizes(byte_bpe: str, pieces: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(t) for t in codec(byte_bpe).tokens]), np.array([len(t) for t in piece_codec(pieces).bytes])


def units(text: bytes) -> list[bytes]:
    """A text with a blank in front, cut where both tokenizers must end a token: before the blanks of a marked word.

    The byte-level pattern begins a token at the last blank before a word. Only
    white space right before several blanks, or before the blanks that end a text,
    may be one token with some of them; there nothing is cut.
    """
    words = marked_words(text)
    if b"  " in text or text[-1:] == b" ":
        out: list[bytes] = []
        for word in words:
            if out and (not word or word[:1] == b" ") and (out[-1][-1:].isspace() or out[-1][-1:] > b"\x7f"):
                out[-1] += b" " + word
            else:
                out.append(word)
        return out
    return words


def _align_units(distinct: list[bytes], byte_bpe: str, pieces: str) -> tuple[Aligned, np.ndarray]:
    """The units aligned, each with a blank in front, and flags of those whose tokens do not spell them."""
    one, other = codec(byte_bpe), piece_codec(pieces)
    marked = [b" " + u for u in distinct]
    data = b"".join(marked)
    ids_a = one.encode_bytes(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, marked)])) if marked else []
    ids_b = other.encode_marked(distinct)
    joined = [b"".join(ids_a), b"".join(ids_b)]
    bad = np.zeros(len(marked), bool)
    for own, ids, whole in ((one.tokens, ids_a, joined[0]), (other.bytes, ids_b, joined[1])):
        if b"".join(map(own.__getitem__, np.frombuffer(whole, "<u4").tolist())) != data:
            bad |= np.fromiter((b"".join(map(own.__getitem__, np.frombuffer(x, "<u4").tolist())) != t for x, t in zip(ids, marked, strict=True)), bool, len(marked))
    for k in np.flatnonzero(bad):
        ids_a[k] = ids_b[k] = b""
    a, b = (np.frombuffer(b"".join(ids), "<u4").astype(np.int64) for ids in (ids_a, ids_b))
    size_a, size_b = _sizes(byte_bpe, pieces)
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    length = int(end_a[-1]) + 1 if len(a) else 1
    in_a, in_b = np.zeros(length, bool), np.zeros(length, bool)
    in_a[end_a], in_b[end_b] = True, True
    counts = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
    return Aligned(a, b, in_b[end_a], in_a[end_b], *counts), bad


@dataclass
class Texts:
    """What texts have: ids, groups and links each, the groups themselves, and the links as ``(text, pair, how many)``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list[bytes]
    links: tuple[np.ndarray, np.ndarray, np.ndarray]


class UnitTable:
    """What each different unit has, for a pair of tokenizers: filled per Python worker, anew once it holds ``UNITS_HELD``."""

    def __init__(self, byte_bpe: str, pieces: str):
        if max(len(codec(byte_bpe).tokens), len(piece_codec(pieces).bytes)) > 1 << 16:
            raise ValueError("ids of both vocabularies have to fit into 16 bits")
        self.names = byte_bpe, pieces
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.shown: list[bytes] = []
        self.bad = np.zeros(0, bool)
        self.figures = np.zeros((4, 0), np.int64)  # ids of either side, groups, links
        self.first = np.zeros(1, np.int64)  # where a unit's links begin among all
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, flat: list[bytes]) -> np.ndarray:
        """The row of each unit; those not in the table are aligned together."""
        new = dict.fromkeys(filterfalse(self.row.__contains__, flat))
        if new and len(self.row) + len(new) > UNITS_HELD:
            self.clear()
            new = dict.fromkeys(flat)
        if new:
            self._add(list(new))
        return np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))

    def _add(self, new: list[bytes]) -> None:
        found, bad = _align_units(new, *self.names)
        n_groups, n_links, _ = found.per_text()
        unit, pair, times = found.links()
        order = np.argsort(unit, kind="stable")
        ends = np.searchsorted(unit[order], np.arange(1, len(new) + 1)) + len(self.pair)
        self.row.update(zip(new, range(len(self.shown), len(self.shown) + len(new)), strict=True))
        self.shown += found.shown()
        self.bad = np.concatenate([self.bad, bad])
        self.figures = np.concatenate([self.figures, np.stack([found.n_a, found.n_b, n_groups, n_links])], axis=1)
        self.first = np.concatenate([self.first, ends])
        self.pair, self.times = np.concatenate([self.pair, pair[order]]), np.concatenate([self.times, times[order]])

    def links(self, text: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of texts as ``(text, pair, how many)`` from the units that stand in them."""
        n = len(self.shown)
        key, often = np.unique(text * n + row, return_counts=True)
        text, row = key // n, key % n
        size = self.first[row + 1] - self.first[row]
        at = np.arange(int(size.sum())) + np.repeat(self.first[row] - (np.cumsum(size) - size), size)
        return np.repeat(text, size), self.pair[at], self.times[at] * np.repeat(often, size)


@functools.cache
def unit_table(byte_bpe: str, pieces: str) -> UnitTable:
    return UnitTable(byte_bpe, pieces)


def align(texts: list[bytes], byte_bpe: str, pieces: str) -> Texts:
    """Texts aligned: the groups and links of each different unit are taken over to wherever it stands."""
    table = unit_table(byte_bpe, pieces)
    each = [units(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), list(map(len, each)))
    row = table.rows(list(chain.from_iterable(each)))
    if table.bad[row].any():  # such a text has no tokens at all
        without = np.zeros(len(texts), bool)
        without[text[table.bad[row]]] = True
        row, text = row[~without[text]], text[~without[text]]
    figures = [np.bincount(text, x[row], len(texts)).astype(np.int64) for x in table.figures]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    shown = list(map(table.shown.__getitem__, row.tolist()))
    groups = [b";".join(shown[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
    return Texts(*figures, groups, table.links(text, row) if len(row) else (text, row, row))


def _bitmaps(group: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """First positions of the groups, and a bitmap for each; sorted by group and number, without repeats."""
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    last = low[begin + size - 1] if len(begin) else low[:0]
    dense = np.flatnonzero(2 * size > (last >> 3) + 2)
    held = 2 * size
    held[dense] = (last[dense] >> 3) + 1 + ((last[dense] >> 3) + 1 + 1) % 2  # an odd number of bytes
    offset = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros(int(offset[-1]), np.uint8)
    if len(dense):
        is_dense = np.zeros(len(begin), bool)
        is_dense[dense] = True
        of = np.repeat(np.arange(len(begin)), size)
        bit = is_dense[of]
        place = offset[of[bit]] + (low[bit] >> 3)
        np.bitwise_or.at(out, place, (1 << (low[bit] & 7)).astype(np.uint8))
        rest, nth = ~bit, np.arange(len(low)) - begin[of]
        at = offset[of[rest]] + 2 * nth[rest]
        out[at], out[at + 1] = low[rest] & 255, low[rest] >> 8
    else:
        out = low.astype("<u2").view(np.uint8)
    return begin, pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())


def numbers(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, number)`` of every document in a column of bitmaps, in order."""
    column = bits.cast(pa.large_binary())
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and offset[-1] else np.zeros(0, np.uint8)
    size = np.diff(offset)
    dense = size % 2 == 1
    of_byte = np.repeat(np.arange(len(size)), size)
    body = data[offset[0] : offset[-1]]
    listed = ~dense[of_byte]
    rows = [np.repeat(np.flatnonzero(~dense), size[~dense] // 2)]
    lows = [body[listed].view("<u2").astype(np.int64)]
    if dense.any():
        at = np.flatnonzero(~listed)
        byte, bit = np.nonzero(np.unpackbits(body[at, None], axis=1, bitorder="little"))
        rows.append(of_byte[at[byte]])
        lows.append((at[byte] - (offset - offset[0])[of_byte[at[byte]]]) * 8 + bit)
    row, low = np.concatenate(rows), np.concatenate(lows)
    if dense.any():
        order = np.lexsort((low, row))
        row, low = row[order], low[order]
    return row, low


def _postings(pair: np.ndarray, low: np.ndarray, times: np.ndarray, part: int) -> pa.RecordBatch:
    """Rows of the index for links of one part: its document bitmaps, then multiplicity planes."""
    key, inverse = np.unique(pair << PART_BITS | low, return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, inverse, times)
    found = [(key, 0)]
    above = count - 1
    for plane in range(1, int(above.max(initial=0)).bit_length() + 1):
        found.append((key[above >> (plane - 1) & 1 == 1], plane))
    pairs, planes, bits = [], [], []
    for held, plane in found:
        begin, maps = _bitmaps(held >> PART_BITS, held & ((1 << PART_BITS) - 1))
        pairs.append(held[begin] >> PART_BITS)
        planes.append(np.full(len(begin), plane, np.int32))
        bits.append(maps)
    flat = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.full(len(flat), part, np.int64)), pa.array(np.concatenate(planes)), pa.concat_arrays(bits)], names=["pair", "part", "plane", "bits"])


def pair_index(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of the documents (``number`` and their own figures), and the index in pieces: ``pair, part, plane, bits``.

    Both are read from one written table, so that they agree on the numbers.
    """
    names = [c.split()[0] for c in f"{_ROW}, {_POSTING}".split(", ")]
    schema = pa.schema([pa.field(n, pa.string() if n == "groups_sha256" else pa.binary() if n == "bits" else pa.int32() if n == "plane" else pa.int64()) for n in names])

    def whole(part: pa.RecordBatch) -> pa.RecordBatch:
        own = dict(zip(part.schema.names, part.columns, strict=True))
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(part.num_rows, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        part = number >> PART_BITS

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pair, low, times = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                index = _postings(pair, low, times, part)
                for at in range(0, index.num_rows, 50_000):
                    yield whole(index.slice(at, 50_000))

        for batch in batches:
            for first, texts in text_chunks(batch.column("text"), ALIGNED_BYTES):
                found = align(texts, byte_bpe, pieces)
                mine = number + np.arange(len(texts))
                shown = pa.array([sha256(x) if x else "" for x in found.shown], pa.string())
                rows = [pa.array(mine), batch.column("doc_id").slice(first, len(texts)), *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links)), shown]
                yield whole(pa.RecordBatch.from_arrays(rows, names=names[:7]))
                text, pair, times = found.links
                own = mine[text]
                for now in range(int(mine[0]) >> PART_BITS, (int(mine[-1]) >> PART_BITS) + 1):
                    if now != part or sum(len(x[0]) for x in held) > LINKS_HELD:
                        yield from flush()
                        part = now
                    here = own >> PART_BITS == now
                    if here.any():
                        held.append((pair[here], own[here] & ((1 << PART_BITS) - 1), times[here]))
                number += len(texts)
        yield from flush()

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = stage(named.mapInArrow(run, f"{_ROW}, {_POSTING}"), "aligned")
    return both.where("number IS NOT NULL").select(*names[:7]), both.where("pair IS NOT NULL").select(*names[7:])


def merged(index: DataFrame) -> DataFrame:
    """``pair, part, plane, bits, n``: the bitmaps of each pair, part and plane ORed into one, and its population count.

    Rows of one pair meet in one task, sorted; a task holds a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def united(rows: pa.Table) -> pa.RecordBatch:
            pair, part, plane = (rows.column(c).to_numpy() for c in ("pair", "part", "plane"))
            edge = np.concatenate([[True], (pair[1:] != pair[:-1]) | (part[1:] != part[:-1]) | (plane[1:] != plane[:-1])])
            of = np.cumsum(edge) - 1
            row, low = numbers(rows.column("bits").combine_chunks())
            key = np.unique(of[row] << PART_BITS | low)
            begin, bits = _bitmaps(key >> PART_BITS, key & ((1 << PART_BITS) - 1))
            first = np.flatnonzero(edge)
            n = np.diff(np.append(begin, len(key)))
            return pa.RecordBatch.from_arrays([pa.array(pair[first]), pa.array(part[first]), pa.array(plane[first]), bits, pa.array(n)], names=["pair", "part", "plane", "bits", "n"])

        last = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("pair", "part", "plane"))
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and last(held[-1], held[-1].num_rows - 1) != last(batch, 0) and sum(b.num_rows for b in held) >= 5_000:
                yield united(pa.Table.from_batches(held))
                held = []
            held.append(batch)
        if held:
            yield united(pa.Table.from_batches(held))

    by = ["pair", "part", "plane"]
    return index.repartition("pair").sortWithinPartitions(*by).mapInArrow(run, f"{_POSTING}, n long")


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, pair, documents, links, best`` of every id pair of a merged index.

    ``best``: no pair of the same ``a`` stands in more documents. The ids of ``b``
    bound how many rows share an ``a``.
    """
    weight = F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    counted = index.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("documents"), F.sum(F.col("n") * weight).alias("links"))
    a, b = F.shiftright("pair", 16), F.col("pair").bitwiseAND(F.lit(65535))
    most = F.max("documents").over(Window.partitionBy("a"))
    return counted.select(a.alias("a"), b.alias("b"), "pair", "documents", "links").withColumn("best", F.col("documents") == most)


def returned_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """``number, n_best, count_sum`` of every document in a merged index, from the counts of the pairs it holds."""
    weighed = index.join(counts.select("pair", "documents", "best"), "pair").select("part", "plane", "bits", "documents", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << PART_BITS
        now, links, best, total = None, np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            there = np.flatnonzero(links)
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array((now << PART_BITS) + there), pa.array(best[there]), pa.array(total[there])], names=["number", "n_best", "count_sum"])
            for x in (links, best, total):
                x[:] = 0

        for batch in batches:
            part = batch.column("part").to_numpy()
            plane, documents = batch.column("plane").to_numpy().astype(np.int64), batch.column("documents").to_numpy()
            is_best = batch.column("best").to_numpy(zero_copy_only=False)
            weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
            row, low = numbers(batch.column("bits"))
            for p in np.unique(part).tolist():
                if now is not None and p != now:
                    yield from given()
                now = p
                here = part[row] == p
                r, at = row[here], low[here]
                np.add.at(links, at, weight[r])
                np.add.at(best, at, weight[r] * is_best[r])
                np.add.at(total, at, weight[r] * documents[r])
        yield from given()

    return weighed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "number long, n_best long, count_sum long")


def align_documents(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``byte_bpe`` encodes a blank and the text, ``pieces`` the text, to which it
    adds the blank itself; special tokens' names are plain text to both. The count
    of a link is the number of documents that hold its id pair; ``n_best`` links
    have the highest count of their first id.
    """
    rows, index = pair_index(docs, byte_bpe, pieces, id_col, text_col)
    index = stage(merged(index), "pairs")
    scores = returned_scores(index, pair_counts(index))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(scores, "number", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def aligned_groups(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, groups`` of every row: the ids of each group as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column("text"), ALIGNED_BYTES):
                shown = [x.decode() for x in align(texts, byte_bpe, pieces).shown]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(shown, pa.string())], names=["doc_id", "groups"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, groups string")
