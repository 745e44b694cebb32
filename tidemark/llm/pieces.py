"""SentencePiece BPE by a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker behind another character,
so no merge reaches from one marked word (a run of markers and what follows it
up to the next marker) into the next. Each text is therefore cut at its markers,
every distinct marked word is segmented once, and the ids are joined back by
position. The table is kept per Python worker, about ``REMEMBERED`` words at most;
what it forgets is segmented again, which changes nothing. A table of the whole
corpus would have to be joined by word with every place where it stands: several
times the corpus through a shuffle, to save a merge of a few letters.

A vocabulary with a piece that does cross a marker is refused.

Nulls and empty texts have no pieces. A literal marker character (U+2581) in a
text is a blank to the model, as in the public library. Characters without a
piece become one piece per byte.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import sha256, text_chunks

MARKER = "▁"
MARKER_BYTES = MARKER.encode()
REPLACEMENT = "�".encode()
#: Most distinct marked words remembered per Python worker, and the longest that is remembered, in bytes.
REMEMBERED, LONGEST = 200_000, 64
_WIDTHS = (4, 8, 12, 16, 24, 48)  # marked words up to each length are merged side by side; longer ones singly
_NEVER = np.int32(2**31 - 1)


class PieceCodec:
    """A SentencePiece BPE model with byte pieces, whose normaliser only marks blanks and adds one in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        crossing = next((names[i] for i in plain if MARKER in names[i].lstrip(MARKER)), None)
        if crossing is not None:
            raise ValueError(f"pieces of this model cross whitespace markers: {crossing!r}")
        self.end_id = model.eos_id()
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        self.is_plain = np.isin(np.arange(n), plain)
        byte = {int(names[i][3:5], 16): i for i in np.flatnonzero(self.is_byte)}
        self.byte_ids = [byte[b] for b in range(256)]
        #: The bytes each id stands for in a text.
        self.bytes = [names[i].replace(MARKER, " ").encode() for i in range(n)]
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        for i in np.flatnonzero(self.is_control):
            self.bytes[i] = b""
        for i in range(n):
            if model.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()  # what the library shows for its unknown piece
        ids = {names[i]: i for i in plain}
        # Characters that stand in pieces without being one get numbers behind the vocabulary.
        symbol = ids | {c: n + i for i, c in enumerate(sorted({c for p in ids for c in p if c not in ids}))}
        self._by_point = np.full(0x110000, -1, np.int32)
        self._by_point[:128] = self.byte_ids[:128]  # a byte piece merges with nothing, so it may stand from the start
        for c, i in symbol.items():
            if len(c) == 1:
                self._by_point[ord(c)] = i
        self._by_point[ord(" ")] = symbol[MARKER]
        _, rank = np.unique(-np.array([model.get_score(i) for i in range(n)]), return_inverse=True)
        pairs = [
            (symbol[p[:k]], symbol[p[k:]], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left << 32 | right
        order = np.argsort(key)
        self._keys, self._made = key[order], made[order].astype(np.int32)
        self._ranks = rank[self._made].astype(np.int32)
        self.recent: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.n = n

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each two neighbours; pairs that make no piece rank last."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        known = self._keys[at] == key
        return np.where(known, self._ranks[at], _NEVER), self._made[at]

    def _ids(self, symbols: Iterator[int] | list[int], letters: str) -> bytes:
        """Ids of merged symbols; those without a piece, in order ``letters``, become their bytes."""
        rest, out = iter(letters), []
        for s in symbols:
            if 0 <= s < self.n:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in next(rest).encode()]
        return np.array(out, "<u4").tobytes()

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, four bytes each) of marked words in UTF-8, given without their first marker."""
        joined = b" " + b" ".join(words)
        data = np.frombuffer(joined, np.uint8)
        begin = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
        place = np.cumsum((data & 0xC0) != 0x80)[begin] - 1
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        symbols = self._by_point[points]
        size = np.diff(np.append(place, len(points)))
        out: list[bytes] = [b""] * len(words)
        for low, width in zip((0, *_WIDTHS), _WIDTHS, strict=False):
            rows = np.flatnonzero((size > low) & (size <= width))
            if not len(rows):
                continue
            here = np.arange(width) < size[rows, None]
            ids = np.full(here.shape, -1, np.int32)
            ids[here] = symbols[(place[rows, None] + np.arange(width))[here]]
            left = size[rows]
            done = self._merged(ids, left)
            flat = done.astype("<u4").tobytes()
            for j, (i, k) in enumerate(zip(rows.tolist(), left.tolist(), strict=True)):
                out[i] = flat[4 * width * j : 4 * width * j + 4 * k]
            odd = ((done < 0) | (done >= self.n)) & (np.arange(width) < left[:, None])
            for j in np.flatnonzero(odd.any(axis=1)).tolist():
                i = int(rows[j])
                out[i] = self._ids(done[j, : left[j]].tolist(), self._without_piece(points[place[i] : place[i] + size[i]]))
        for i in np.flatnonzero(size > _WIDTHS[-1]).tolist():
            out[i] = self._one(points[place[i] : place[i] + size[i]])
        return out

    def _without_piece(self, points: np.ndarray) -> str:
        """The characters that have no piece, in order."""
        symbols = self._by_point[points]
        return "".join(map(chr, points[(symbols < 0) | (symbols >= self.n)].tolist()))

    def _merged(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All rows merged side by side, the best pair of each per step, leftmost on ties; ``size`` shrinks along."""
        n, width = ids.shape
        last = np.arange(width - 1)
        done = ids.copy()
        live = np.arange(n)
        rank, made = self._pair(ids[:, :-1], ids[:, 1:])
        rank[last + 1 >= size[:, None]] = _NEVER
        while len(live):
            k = rank.argmin(axis=1)
            here = np.arange(len(live))
            go = rank[here, k] != _NEVER
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, rank, made, k = live[go], ids[go], rank[go], made[go], k[go]
                here = here[: len(live)]
                if not len(live):
                    break
            ids[here, k] = made[here, k]
            later = last > k[:, None]
            ids[:, 1:-1] = np.where(later[:, 1:], ids[:, 2:], ids[:, 1:-1])
            rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            made[:, :-1] = np.where(later[:, :-1], made[:, 1:], made[:, :-1])
            rank[:, -1] = _NEVER
            size[live] -= 1
            for at in (k - 1, k):
                ok = np.flatnonzero((at >= 0) & (at + 1 < size[live]))
                rank[ok, at[ok]], made[ok, at[ok]] = self._pair(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            ended = np.flatnonzero(k + 1 >= size[live])
            rank[ended, k[ended]] = _NEVER
        return done

    @functools.cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self._keys.tolist(), zip(self._ranks.tolist(), self._made.tolist(), strict=True), strict=True))

    def _one(self, points: np.ndarray) -> bytes:
        """The same for the code points of one word of any length, with a heap and linked neighbours."""
        ids = self._by_point[points].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and ids[i] >= 0 and ids[j] >= 0 and (found := self._pairs.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return self._ids((s for s, x in zip(ids, gone, strict=True) if not x), self._without_piece(points))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian, four bytes each) of whole texts in UTF-8, without an end id."""
        plain = [t.replace(MARKER_BYTES, b" ") if MARKER_BYTES in t else t for t in texts]
        return self._joined([marked_words(t) for t in plain])

    def encode_marked(self, units: list[bytes]) -> list[bytes]:
        """Ids of stretches of a text that begin with a marker, each given without it: an empty one is the marker alone."""
        plain = [u.replace(MARKER_BYTES, b" ") if MARKER_BYTES in u else u for u in units]
        return self._joined([marked_words(u) if b" " in u else [u] for u in plain])

    def _joined(self, each: list[list[bytes]]) -> list[bytes]:
        """Ids of lists of marked words, joined by position."""
        found = self._looked_up([w for words in each for w in words])
        out, at = [], 0
        for words in each:
            out.append(b"".join(found[at : at + len(words)]) if len(words) != 1 else found[at])
            at += len(words)
        return out

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of marked words from the table; those not in it are segmented together, each once.

        The table has two halves: when the recent one is full it replaces the one
        before, so words that keep coming back stay.
        """
        found = list(map(self.recent.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            rest = dict.fromkeys([words[i] for i in missing])
            new = [w for w in rest if w not in self.before]
            made = dict(zip(new, self.segment(new), strict=True)) if new else {}
            for w in rest:
                rest[w] = made.get(w) or self.before[w]
            for i in missing:
                found[i] = rest[words[i]]
            if len(self.recent) + len(rest) > REMEMBERED // 2:
                self.before, self.recent = self.recent, {}
            self.recent.update((w, x) for w, x in rest.items() if len(w) <= LONGEST)
        return found

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: without the first blank, control pieces left out, broken bytes each replaced."""
        seq = np.frombuffer(ids, "<u4")
        raw = self.is_byte[seq]
        text = b"".join(self._runs(seq, raw) if raw.any() else map(self.bytes.__getitem__, seq.tolist()))
        said = np.flatnonzero(~self.is_control[seq])
        return text[1:] if len(said) and self.is_plain[seq[said[0]]] and text[:1] == b" " else text

    def _runs(self, seq: np.ndarray, raw: np.ndarray) -> Iterator[bytes]:
        """Texts of runs of byte pieces and of other pieces, in turn."""
        edge = np.flatnonzero(raw[1:] != raw[:-1]) + 1
        for part in np.split(seq, edge):
            run = b"".join(map(self.bytes.__getitem__, part.tolist()))
            yield _mended(run) if self.is_byte[part[0]] else run


def _mended(run: bytes) -> bytes:
    """A run of bytes as UTF-8; every byte that belongs to no whole character is replaced."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in range(4, 0, -1):
                try:
                    if len(run[at : at + n].decode()) == 1:
                        out.append(run[at : at + n])
                        at += n
                        break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(REPLACEMENT)
                at += 1
        return b"".join(out)


def marked_words(text: bytes) -> list[bytes]:
    """Marked words of a text with a blank in front, each without its first blank: blanks in a row belong to the word behind them."""
    parts = text.split(b" ") if text else []
    if b"" not in parts:
        return parts
    # An empty part is a blank with another behind it; the last one ends the text.
    out, blanks = [], 0
    for part in parts[:-1]:
        if part:
            out.append(b" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    out.append(b" " * blanks + parts[-1])
    return out


@functools.cache
def piece_codec(path: str) -> PieceCodec:
    """The model at ``path``, loaded once per Python worker."""
    return PieceCodec(path)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row; ``end`` adds the end id.

    Null texts count as empty. Repeated rows give a row each, an empty table
    none. Columns other than the two named are not read.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        tail = np.array([own.end_id] * end, "<u4").tobytes()
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                ids = [x + tail for x in own.encode(texts)]
                bounds = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.ListArray.from_arrays(bounds, flat)], names=schema.names)

    return _named(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of encoded rows; null ids give an empty text, repeated rows a row each."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        for batch in batches:
            texts = [own.decode(np.asarray(x.as_py() or [], "<u4").tobytes()).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: its ids, and the text decoded from them.

    ``ids_sha256`` is taken over the decimal ids joined by one blank. Encodes and
    decodes in one pass, so that a corpus of ids is neither shuffled nor written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(model)
        decimal = [b"%d" % i for i in range(own.n)]
        tail = np.array([own.end_id] * end, "<u4").tobytes()
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                ids = [x + tail for x in own.encode(texts)]
                shown = (b" ".join(map(decimal.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x) for x in shown]), pa.array([sha256(own.decode(x)) for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _named(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
