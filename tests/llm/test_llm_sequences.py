"""Pieces, periodic runs and alignment against the public libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, pieces, queries, runs

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, number string, pair int, part string, runs long, ids string, best long"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [w + c for w in "alpha beta gamma delta epsilon zeta eta theta".split() for c in ("", "s", "ed", ",", ".")]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    mixed = "".join(rng.choice(["a", "b", " ", "  ", "▁", "\n", "é", "漢", "<0x41>", "<s>", "</s>", "<unk>", "\x00", "😀", "the", "=", "-", "\t", "ß", "⁇"]) for _ in range(900))
    texts = [
        None, "", " ", "   ", "▁", "one ▁ two", "One", "one", " \t\n", "<|endoftext|> a<|endoftext|></s>", "Naïve café — 東京 \U0001f600 it's  two\n\n three", "a" * 900, "=" * 1200,
        "漢字仮名" * 200, "\U0001f600" * 300, mixed, mixed.replace("▁", ""), prose(1500), prose(30), "x y " * 500, " ".join(["spam"] * 40), " ".join("abcab" * 30),
        "w1 w2 w3 w4 w5 w6 " * 2, "w1 w2 w3 w4 w5 w6 " * 2 + "w1", prose(5) + " q r s" * 9 + " " + prose(7) + " q r s" * 9,
    ]
    data = [(i, t) for i, t in enumerate(texts)] + [(100 + i, prose(rng.randrange(1, 200))) for i in range(60)]
    return [*data, (7, "one"), (7, "another"), (None, prose(60)), (None, "one"), (300, data[17][1])]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "n", 1, "p", 2, "i", 3) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_equal_the_library(spark, docs, rows, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [model.encode(t or "", add_eos=True) for _, t in rows]
    want = Counter((d, len(i), sha(" ".join(map(str, i)).encode()), sha(model.decode(i).encode())) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(map(tuple, pieces.round_trip(docs, MODEL).collect())) == want
    encoded = pieces.encode(docs, MODEL, end=False)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((d, tuple(i[:-1])) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(r.text for r in pieces.decode(encoded, MODEL).collect()) == Counter(model.decode(i) for i in ids)
    assert pieces.round_trip(empty, MODEL).count() == pieces.encode(empty, MODEL).count() == pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0


def test_any_ids_decode_as_the_library_does():
    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.piece_codec(MODEL), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 29871, 259, 1, 2]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == model.decode([i for i in ids])


def test_forgotten_words_are_segmented_again(monkeypatch, rows):
    own = pieces.PieceCodec(MODEL)
    texts = [(t or "").encode() for _, t in rows]
    want = own.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    assert all(own.encode([t]) == [w] for t, w in zip(texts, want, strict=True))


def runs_of(x, least=12):
    """All runs by trying every period."""
    found = []
    for q in range(1, len(x) // 2 + 1):
        at = 0
        while at + q < len(x):
            end = at
            while end + q < len(x) and x[end] == x[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, 2 * q) and not any(s <= at and s + n >= end + q and q % p == 0 for s, n, p in found):
                found.append((at, end - at + q, q))
            at = max(end, at) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    total = 0
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 4)):
            x = rng.integers(0, rng.choice([1, 2, 3, 5, 50]), rng.integers(0, 130))
            if len(x) > 20 and rng.random() < 0.7:
                begin = int(rng.integers(0, len(x)))
                x[begin:] = x[begin + np.arange(len(x) - begin) % int(rng.integers(1, max(2, (len(x) - begin) // 2 + 1)))]
                x[int(rng.integers(0, len(x)))] = int(rng.integers(0, 3))
            texts.append(x)
        bounds = np.cumsum([0, *map(len, texts)])
        want = [(s + int(b), n, q) for b, t in zip(bounds, texts, strict=False) for s, n, q in runs_of(t.tolist())]
        assert list(map(tuple, runs.find_runs(np.concatenate(texts).astype(np.int64), bounds).tolist())) == want
        total += len(want)
    assert total > 100
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(30, np.int64), np.array([0, 30]), 8)


def test_transforms_find_the_places_that_comparing_finds():
    rng = np.random.default_rng(4)
    for top in (2, 40, 1 << 20):  # one, one and two primes
        blocks, windows = rng.integers(0, 2, (6, 24)) * (top - 1), rng.integers(0, 2, (6, 71)) * (top - 1)
        for i, at in enumerate((0, 5, 20, 47)):
            windows[i, at : at + 24] = blocks[i]
        want = np.array([[(w[o : o + 24] == b).all() for o in range(48)] for b, w in zip(blocks, windows, strict=True)])
        assert (runs.mismatches_zero(blocks, windows) == want).all() and want.sum() >= 4


def test_long_texts_of_one_word_and_of_long_periods():
    for x, q in ((np.zeros(60_000, np.int64), 1), (np.arange(60_000) % 19_999, 19_999)):
        assert runs.find_runs(x, np.array([0, len(x)])).tolist() == [[0, 60_000, q]]


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_runs_query(spark, docs, rows, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in rows:
        words = planted(d, (t or "").encode().split())
        found = runs_of(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if found else None
        shown = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        want[(d, len(found), *best, milli, sha(shown), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))] += 1
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want and sum(k[1] for k in want) > 10
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, t in rows if t)
    assert runs.periodic_runs(empty).count() == 0


def aligned(rows):
    """Every link of every row, one by one."""
    one, other = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    one.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}
    out, count = [], Counter()
    for d, t in rows:
        text = " " + (t or "")
        a = one.encode(text, add_special_tokens=False).ids if t else []
        b = other.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [other.id_to_piece(i)]]
        if b"".join(bytes_a) != text.encode() or b"".join(bytes_b) != text.encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[next(k for k, c in enumerate(cuts) if e <= c) if len(cuts) < 50 else int(np.searchsorted(cuts, e))][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        out.append((d, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    result = Counter()
    for d, a, b, groups, links in out:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        result[(d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(shown.encode()) if a else "")] += 1
    return result, count, out


def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@pytest.mark.parametrize(("held", "wide"), [(2_000_000, 1 << 16), (500, 3)])
def test_alignment_equals_brute_force(spark, docs, rows, empty, tmp_path, monkeypatch, held, wide):
    monkeypatch.setattr(alignment, "LINKS_HELD", held)
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    want, count, out = aligned(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_cross_tokenizer_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    own = alignment.merged(alignment.pair_index(docs, BPE, MODEL)[1])
    links = Counter(p for *_, each in out for p in each)
    found = {(r.a, r.b): (r.documents, r.links) for r in alignment.pair_counts(own).collect()}
    assert found == {p: (n, links[p]) for p, n in count.items()}
    assert own.groupBy("pair", "part", "plane").count().where("count > 1").isEmpty()
    assert alignment.align_documents(empty, BPE, MODEL).count() == 0
    shown = Counter((r.doc_id, sha(r.groups.encode()) if r.groups else "") for r in alignment.aligned_groups(docs, BPE, MODEL).collect())
    assert shown == Counter((k[0], k[-1]) for k in want.elements())


def test_bitmaps_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, top, n)) for n, top in ((1, 65536), (5, 9), (4000, 65536), (30000, 65536), (65536, 65536), (2, 3), (300, 320))] + [np.array([65535]), np.arange(65536)]
    group, low = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    begin, bits = alignment._bitmaps(group, low)
    assert len(begin) == len(sets) and max(map(len, bits.to_pylist())) <= 8193
    for column, there in ((bits, np.arange(len(sets))), (bits.slice(2, 5), np.arange(2, 7))):
        row, number = alignment.numbers(column)
        assert [number[row == i].tolist() for i in range(len(there))] == [sets[k].tolist() for k in there]


def test_queries_read_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op11_cross_tokenizer_alignment", "op12_periodic_runs", "op13_sentencepiece_round_trip"):
        got = queries.QUERIES[name](spark, folder)
        assert got.count() == n and got.where(F.col("doc_id").isNull()).isEmpty()
