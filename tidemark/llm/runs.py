"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q (words q apart are equal) that
no neighbour extends and that is at least ``max(12, 2 q)`` long. Words q apart
are then equal along ``max(12 - q, q)`` places or more.

Scales are dyadic: with blocks of ``b = 3, 6, 12, ...`` words, periods from 2 b to
4 b - 1 are looked for (from 1 at the first scale), so such a stretch of equal
places holds a whole block at a multiple of ``b``. A block is convolved with the
window of words those distances behind it: the sums of squared differences of
word numbers come from an exact integer number-theoretic transform, modulo so
many primes that a sum below their product is zero only if it is zero modulo each.
A zero is a place where the block recurs without a mismatch; its distance seeds a
run, which is extended to both sides by comparing words.

Two exact tests spare transforms: a block can recur only if its first and its
last three words do at one of the distances; and where a block's window lies in a
run with a period of at most ``b``, all zeros are multiples of that period. Seeds
inside a known run at a multiple of its period are that run again; any other
distance that is not the smallest period of its stretch is recognised by comparing.

Texts are handled side by side in portions; a text is never cut, and equal words
of different texts never meet. Work grows as n log^2 n for a text of n words.

Null texts have no words. Texts without runs keep their words; repeated rows
give a row each, an empty table none. Columns other than the two named are not
read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import text_chunks

LEAST = 12
FIRST_BLOCK = 3
# Primes of the form k * 2^n + 1 below 2^31 with a generator of their multiplicative group.
PRIMES = ((2013265921, 31), (469762049, 3), (1811939329, 13))
#: Numbers of a transform held at once.
HELD = 1 << 19

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@functools.lru_cache(maxsize=128)
def _turns(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each pass of a transform of ``size`` numbers, widest first."""
    root = pow(generator, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    powers = np.ones(max(size // 2, 1), np.uint64)
    have = 1
    while have < len(powers):  # doubling: the second half is the first times a power
        more = min(have, len(powers) - have)
        powers[have : have + more] = powers[:more] * np.uint64(pow(root, have, prime)) % np.uint64(prime)
        have += more
    return [powers[:: 1 << k].copy() for k in range(size.bit_length() - 1)]


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    n, size = rows.shape
    p = np.uint64(prime)
    for turn in _turns(size, prime, generator, False):
        half = len(turn)
        pair = rows.reshape(n, -1, 2, half)
        low, high = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack([(low + high) % p, (low + (p - high)) * turn % p], axis=2).reshape(n, size)
    return rows


def restored(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``transform``, times the length of a row."""
    n, size = rows.shape
    p = np.uint64(prime)
    for turn in reversed(_turns(size, prime, generator, True)):
        half = len(turn)
        pair = rows.reshape(n, -1, 2, half)
        low, high = pair[:, :, 0], pair[:, :, 1] * turn % p
        rows = np.stack([(low + high) % p, (low + (p - high)) % p], axis=2).reshape(n, size)
    return rows


def mismatches_zero(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block stands in its window without a mismatch: flags by row and offset.

    ``sum((block[t] - window[o + t]) ** 2)`` over t, for every offset o, taken
    modulo as many primes as its largest possible value needs.
    """
    n, b = blocks.shape
    width = windows.shape[1]
    offsets = width - b + 1
    size = 1 << (width - 1).bit_length()
    most = int(max(blocks.max(initial=0), windows.max(initial=0))) ** 2 * b
    own = (blocks.astype(np.int64) ** 2).sum(axis=1)
    squares = np.zeros((n, width + 1), np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=1, out=squares[:, 1:])
    rest = own[:, None] + squares[:, b:] - squares[:, : offsets]
    zero, product = np.ones((n, offsets), bool), 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        padded = np.zeros((2, n, size), np.uint64)
        padded[0, :, :b] = blocks[:, ::-1]  # reversed: the convolution becomes a correlation
        padded[1, :, :width] = windows
        product_of = transform(padded[0], prime, generator) * transform(padded[1], prime, generator) % p
        cross = restored(product_of, prime, generator)[:, b - 1 : b - 1 + offsets]
        # 2 * cross / size has to equal the squares; both sides are compared times the size.
        zero &= cross * np.uint64(2) % p == (rest % prime).astype(np.uint64) * np.uint64(size) % p
        product *= prime
        if product > most:
            return zero
    raise ValueError("word numbers too large for the primes")


class _Found:
    """Runs found so far, and for each place the one that reaches furthest."""

    def __init__(self, n: int):
        self.runs: list[np.ndarray] = []
        self.reach, self.period = np.zeros(n, np.int64), np.ones(n, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        self.runs.append(np.stack([start, end - start, period], axis=1))
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
            further = self.reach[s:e] < e
            self.reach[s:e][further] = e
            self.period[s:e][further] = q


def _first_mismatch(x: np.ndarray, one: np.ndarray, other: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``one`` and ``other`` on, in direction ``step``, are equal; ``limit`` at most."""
    equal = np.zeros(len(one), np.int64)
    live, width = np.flatnonzero(limit > 0), 8
    while len(live):
        near = np.arange(width)
        at = equal[live, None] + near
        inside = at < limit[live, None]
        at = np.where(inside, at, 0)
        same = (x[one[live, None] + step * at] == x[other[live, None] + step * at]) & inside
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        equal[live] += n
        live = live[n == width]
        width = min(width * 2, 1024)
    return equal


def _factors(n: int) -> list[int]:
    found, f = [], 2
    while f * f <= n:
        if n % f == 0:
            found.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*found, n] if n > 1 else found


def _is_power(x: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of period ``period`` has a smaller one that divides it."""
    word = x[start : start + period]
    return any(np.array_equal(word[: period - period // f], word[period // f :]) for f in _factors(period))


def _extended(x: np.ndarray, seed: np.ndarray, distance: np.ndarray, block: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch with period ``distance`` around each seed, inside its text."""
    back = _first_mismatch(x, seed - 1, seed - 1 + distance, seed - begin, -1)
    ahead = _first_mismatch(x, seed + block, seed + block + distance, end - distance - block - seed, 1)
    return seed - back, seed + block + ahead + distance


def find_runs(x: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start and period.

    ``x``: numbers of the words of all texts, equal for equal words of a text;
    ``bounds``: where each text begins, and the end of the last. ``least`` is 9 or
    more: shorter stretches need not hold a whole block.
    """
    if least < 9:
        raise ValueError("runs of fewer than 9 words need not hold a block")
    n = len(x)
    known = _Found(n)
    if n < least:
        return np.zeros((0, 3), np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin, end = bounds[:-1][text], bounds[1:][text]
    # Numbers of the three words from each place on: equal for equal ones of a text. Hashed, so only ever too often equal.
    mix = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(3):
        mix = (mix ^ np.append(x[k:], np.zeros(k, x.dtype)).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mix ^= mix >> np.uint64(32)
    order = np.argsort(mix, kind="stable")
    new = np.concatenate([[True], mix[order][1:] != mix[order][:-1]])
    rank = np.cumsum(new) - 1
    keys = rank * n + order  # ascending: by three words, then by place
    number = np.empty(n, np.int64)
    number[order] = rank

    def recurs(place: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the three words from each place on come again ``low`` to ``high`` places behind."""
        key = number[place] * n + place
        at = np.minimum(np.searchsorted(keys, key + low), n - 1)
        return (keys[at] >= key + low) & (keys[at] <= key + high) & (number[order[at]] == number[place])

    alone = np.zeros(n, bool)  # three words that come once in their text
    alone[order] = new & np.append(new[1:], True)
    b, longest = FIRST_BLOCK, int(np.diff(bounds).max())
    while True:
        low = 1 if b == FIRST_BLOCK else 2 * b
        high = 4 * b - 1
        if max(2 * low, least) > longest:
            break
        place = np.arange(0, n - b + 1, b)
        place = place[(end[place] - place >= b + low) & ~alone[place] & ~alone[place + b - 3]]
        place = place[recurs(place, low, high)]
        place = place[recurs(place + b - 3, low, high)]
        inside = (known.period[place] <= b) & (known.reach[place] >= np.minimum(place + high + b, end[place]))
        place = place[~inside]
        if len(place):
            _scale(x, place, b, low, high, begin, end, known, least)
        b *= 2
    if not known.runs:
        return np.zeros((0, 3), np.int64)
    found = np.unique(np.concatenate(known.runs), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _scale(x: np.ndarray, place: np.ndarray, b: int, low: int, high: int, begin: np.ndarray, end: np.ndarray, known: _Found, least: int) -> None:
    """The runs with periods from ``low`` to ``high`` seeded by the blocks of ``b`` words at ``place``."""
    width = high - low + b
    rows = max(1, HELD // (1 << (width - 1).bit_length()))
    seeds, distances = [], []
    for at in range(0, len(place), rows):
        own = place[at : at + rows]
        span = own[:, None] + low + np.arange(width)
        windows = x[np.minimum(span, len(x) - 1)]
        zero = mismatches_zero(x[own[:, None] + np.arange(b)], windows)
        row, offset = np.nonzero(zero)
        here, distance = own[row], offset + low
        whole = here + distance + b <= end[here]
        here, distance = here[whole], distance[whole]
        again = (known.reach[here] >= here + distance + b) & (distance % known.period[here] == 0)
        seeds.append(here[~again])
        distances.append(distance[~again])
    seed, distance = np.concatenate(seeds), np.concatenate(distances)
    order = np.lexsort((seed, distance))
    seed, distance = seed[order], distance[order]
    if len(seed):  # neighbouring blocks at one distance lie in one stretch
        first = np.concatenate([[True], (seed[1:] != seed[:-1] + b) | (distance[1:] != distance[:-1])])
        seed, distance = seed[first], distance[first]
    for at in range(0, len(seed), 20_000):
        s, d = seed[at : at + 20_000], distance[at : at + 20_000]
        again = (known.reach[s] >= s + d + b) & (d % known.period[s] == 0)
        s, d = s[~again], d[~again]
        start, stop = _extended(x, s, d, b, begin[s], end[s])
        long = stop - start >= np.maximum(least, 2 * d)
        found = np.unique(np.stack([start[long], stop[long], d[long]], axis=1), axis=0)
        found = found[np.lexsort((found[:, 0], found[:, 2]))]
        found = found[[not _is_power(x, s, q) for s, _, q in found.tolist()]] if len(found) else found
        known.add(found[:, 0], found[:, 1], found[:, 2])


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the places that a run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(
    docs: DataFrame, least: int = LEAST, order: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row: all runs by start and period, and the words that are left.

    Words are separated by ASCII white space. ``collapsed`` is the text without the
    words that a run holds behind its first period, joined by one blank. ``order``,
    given a row's id and number of words, may say in which order (with repeats) its
    words are taken, before anything is looked for; None leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch.column("text")):
                words = [t.split() for t in texts]
                codes, every = [], []
                for i, own in enumerate(words):
                    number = dict(zip(dict.fromkeys(own), count()))
                    x = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                    taken = order(ids[first + i], len(own)) if order else None
                    if taken is not None:
                        x, words[i] = x[taken], list(map(own.__getitem__, taken.tolist()))
                    codes.append(x)
                    every.append(len(x))
                bounds = np.concatenate([[0], np.cumsum(every)]).astype(np.int64)
                found = find_runs(np.concatenate(codes), bounds, least)
                of = np.searchsorted(found[:, 0], bounds)
                gone = dropped(found, int(bounds[-1]))
                left = []
                for i, own in enumerate(words):
                    cut = gone[bounds[i] : bounds[i + 1]]
                    left.append(b" ".join([own[k] for k in np.flatnonzero(~cut).tolist()] if cut.any() else own))
                start = found[:, 0] - np.repeat(bounds[:-1], np.diff(of))
                fields = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)), pa.array(every, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(of, pa.int32()), fields), pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
