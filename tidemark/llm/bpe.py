"""Byte-level BPE by forced boundaries.

Two kinds of cut are certain before any merge is tried:

* the ends of the words that the vocabulary's splitting pattern makes;
* every place between two bytes that never stand side by side inside any token
  of the vocabulary: no merge can reach across it.

The fragments between cuts are encoded on their own, each distinct one once per
batch of work, and the ids are concatenated. All texts of an Arrow batch are
cut together with vector operations on their UTF-8 bytes; documents are cuts
too, so nothing crosses them.

Nulls count as empty texts. The literal text of a special token becomes its id,
as the public library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Most distinct fragments remembered per Python worker; beyond it the memory starts anew.
REMEMBERED = 120_000
# Text bytes handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20
_NO_BYTE = 0xFF  # never occurs in UTF-8
_NEVER = np.int32(2**31 - 1)
_WIDTHS = (6, 9, 12, 16, 24, 48)  # fragments up to each length are merged together; longer ones singly


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 as it is, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


class Codec:
    """A byte-level BPE vocabulary in the public JSON layout."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.ids = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[bytes(letters[c] for c in left), bytes(letters[c] for c in right)] = rank
        self.cut_between = np.ones(65536, bool)
        for token in self.ids:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.intp)
                self.cut_between[(b[:-1] << 8) | b[1:]] = False
        self.memory: dict[bytes, bytes] = {}
        self._arrays()

    def _arrays(self) -> None:
        """The merges as arrays: rank of byte pairs by position, of other pairs by search, and the id each merge makes."""
        pairs = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.ranks], np.int64).reshape(-1, 3)
        ranks = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        self._keys, self._key_ranks = key[order], ranks[order]
        self._made = np.zeros(len(ranks) + 1, np.int32)
        self._made[ranks] = pairs[:, 2]
        self._byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._key_ranks[at], _NEVER)

    def merge_many(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of many fragments: those of like length are merged side by side, one merge each per step."""
        out: list[bytes] = [b""] * len(fragments)
        by_length: dict[int, list[int]] = {}
        for i, fragment in enumerate(fragments):
            length = next((x for x in _WIDTHS if x >= len(fragment)), 0)
            by_length.setdefault(length, []).append(i)
        for length, rows in by_length.items():
            if not length:
                for i in rows:
                    out[i] = self.merge(fragments[i])
                continue
            data = np.frombuffer(b"".join([fragments[i].ljust(length, b"\0") for i in rows]), np.uint8).reshape(-1, length)
            ids = self._byte_ids[data]
            size = np.fromiter((len(fragments[i]) for i in rows), np.int64, len(rows))
            columns = np.arange(length)
            rank = np.full((len(rows), length), _NEVER, np.int32)
            rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
            rank[columns[None, :] + 1 >= size[:, None]] = _NEVER
            live = np.arange(len(rows))
            part, part_rank = ids, rank
            done = np.empty_like(ids)
            while len(live):
                k = part_rank.argmin(axis=1)
                here = np.arange(len(live))
                best = part_rank[here, k]
                ended = best == _NEVER
                if ended.any():
                    done[live[ended]] = part[ended]
                    go = ~ended
                    live, part, part_rank, k, best = live[go], part[go], part_rank[go], k[go], best[go]
                    here = np.arange(len(live))
                    if not len(live):
                        break
                after = columns[None, :] > k[:, None]
                moved = np.minimum(columns + 1, length - 1)
                part = np.where(after, part[:, moved], part)
                part_rank = np.where(after, part_rank[:, moved], part_rank)
                part_rank[:, -1] = _NEVER
                part[here, k] = self._made[best]
                size[live] -= 1
                has_next = k + 1 < size[live]
                part_rank[here, k] = np.where(has_next, self._rank(part[here, k], part[here, np.minimum(k + 1, length - 1)]), _NEVER)
                back = np.flatnonzero(k > 0)
                part_rank[back, k[back] - 1] = self._rank(part[back, k[back] - 1], part[back, k[back]])
            flat = done.astype("<u4").tobytes()
            for j, (i, n) in enumerate(zip(rows, size.tolist(), strict=True)):
                out[i] = flat[4 * length * j : 4 * length * j + 4 * n]
        return out

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each fragment; what was not seen before is merged all at once."""
        found = list(map(self.memory.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = list({pieces[i] for i in missing})
            made = dict(zip(new, self.merge_many(new), strict=True))
            for i in missing:
                found[i] = made[pieces[i]]
            if len(self.memory) + len(new) > REMEMBERED:
                self.memory.clear()
            self.memory.update((k, v) for k, v in made.items() if len(k) <= 64)
        return found

    def merge(self, fragment: bytes) -> bytes:
        """Ids of one fragment, merging the pair of lowest rank first, leftmost on ties."""
        whole = self.ids.get(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        if len(parts) > 256:
            return self._merge_long(parts)
        rank_of, none = self.ranks.get, 1 << 60
        pairs = [rank_of(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank_of((parts[k - 1], parts[k]), none)
            if k < len(pairs):
                pairs[k] = rank_of((parts[k], parts[k + 1]), none)
        if whole is not None and len(parts) == 1:
            return whole.to_bytes(4, "little")
        return b"".join(self.ids[p].to_bytes(4, "little") for p in parts)

    def _merge_long(self, parts: list[bytes]) -> bytes:
        """The same with a heap and linked neighbours: n log n for fragments of any length."""
        import heapq

        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return b"".join(self.ids[p].to_bytes(4, "little") for p, x in zip(parts, alive, strict=True) if x)

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Flags of the bytes at which a fragment begins; ``begins``: first bytes of the texts."""
        flags = np.zeros(len(data) + 1, bool)
        if not len(data):
            return flags[:0]
        begins = begins[begins < len(data)]
        flags[begins] = True
        flags[1:-1] |= self.cut_between[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        first = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[first]
        kind = _classes()[:128][np.minimum(lead, 127)]
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            at, head = first[wide], lead[wide].astype(np.int32)
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            b1, b2, b3 = ((padded[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
            point = np.where(head < 0xE0, (head & 0x1F) << 6 | b1, np.where(head < 0xF0, (head & 0x0F) << 12 | b1 << 6 | b2, (head & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
            kind[wide] = _classes()[np.minimum(point, 0x10FFFF)]
        n = len(first)
        start = np.zeros(n + 4, bool)
        new_text = np.zeros(n + 4, bool)
        new_text[np.searchsorted(first, begins)] = True
        new_text[n] = True
        start[:n] = new_text[:n]
        differs = kind[1:] != kind[:-1]
        start[1:n] |= differs
        # A run of white space gives its last character to what follows; a blank is joined to it.
        gap = np.flatnonzero(differs & (kind[:-1] == SPACE) & ~new_text[1:n])
        start[gap] = True
        start[gap[lead[gap] == 32] + 1] = False
        quote = np.flatnonzero((lead == 39) & start[:n])
        if len(quote):
            padded = np.concatenate([lead, np.zeros(3, np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            inside = ~new_text[quote + 1]
            short = quote[inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))]
            pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            long = quote[inside & pair & ~new_text[quote + 2]]
            start[short + 1], start[short + 2] = False, True
            start[long + 1], start[long + 2], start[long + 3] = False, False, True
        flags[first[np.flatnonzero(start[:n])]] = True
        return flags[:-1]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids (little-endian, four bytes each) of each text ``data[offsets[i]:offsets[i + 1]]``."""
        cut = self.cuts(data, offsets[:-1])
        places = np.flatnonzero(cut)
        spread = np.full(len(data) + max(len(places) - 1, 0), _NO_BYTE, np.uint8)
        spread[np.arange(len(data)) + np.cumsum(cut) - 1] = data
        pieces = spread.tobytes().split(bytes([_NO_BYTE])) if len(data) else []
        found = self.lookup(pieces)
        bounds = np.searchsorted(places, offsets).tolist()
        return [b"".join(found[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts in UTF-8, special tokens' texts included."""
        rows: list[list[tuple[bool, bytes]]] = []
        plain: list[bytes] = []
        for text in texts:
            parts = [(False, text)]
            for token in self.special:
                if token in text:
                    parts = [x for is_id, p in parts for x in ([(True, p)] if is_id else _around(p, token))]
            rows.append(parts)
            plain += [p for is_id, p in parts if not is_id]
        offsets = np.cumsum([0, *map(len, plain)])
        ids = iter(self.encode_bytes(np.frombuffer(b"".join(plain), np.uint8), offsets))
        return [b"".join(self.special[p] if is_id else next(ids) for is_id, p in parts) for parts in rows]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; broken sequences become the replacement character."""
        joined = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


def _around(text: bytes, token: bytes) -> list[tuple[bool, bytes]]:
    parts = [(False, text)]
    while token in parts[-1][1]:
        head, _, tail = parts.pop()[1].partition(token)
        parts += [(False, head), (True, token), (False, tail)]
    return parts


@functools.cache
def codec(path: str) -> Codec:
    """The vocabulary at ``path``, loaded once per Python worker."""
    return Codec(path)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """``(first row, UTF-8 texts)`` of a string column in portions of about ``limit`` bytes; nulls are empty."""
    values = column.cast(pa.large_binary())
    start, held, size = 0, [], 0
    for i, value in enumerate(values):
        text = value.as_py() or b""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held
    pa.default_memory_pool().release_unused()


def id_batches(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """``(first row, texts, ids)`` of a text column, portion by portion."""
    own = codec(path)
    for start, texts in text_chunks(batch.column(column)):
        yield start, texts, own.encode(texts)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
