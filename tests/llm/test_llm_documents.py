"""The document operators against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chunking, codec, exact, packing, simhash, suffixes

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length long, bits string, spans int, digest string, n long, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = prose(rng, 70)
    texts = [
        None, "", " \t\n", "One", "one", "Naïve café — 東京 \U0001f600 it's we'll  two\n\n three x", "<|endoftext|> a<|endoftext|>", "aaaa" * 300,
        passage, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30), "start " + passage + " end", prose(rng, 6000), prose(rng, 120), "x" * 700 + prose(rng, 20),
        "don't 'start' y'all'll\t'quoted  '  \r\n  tail   ", "123 4567,89.10 ١٢ a1b2",
    ]
    data = [(i, t) for i, t in enumerate(texts)]
    data += [(40, passage), (41, passage), (41, passage), (None, passage), (None, "One"), (50, ""), (12, texts[12]), (12, prose(rng, 60))]
    return data


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "b", 2, "g", 3, "k") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows], tokenizer


def test_codec_equals_the_library(spark, docs, rows, empty):
    ids, tokenizer = library_ids(rows)
    pack = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    want = Counter((d, len(i), pack(i), hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest()) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(map(tuple, codec.round_trip(docs, PATH).collect())) == want
    encoded = codec.encode(docs, PATH)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((d, tuple(i)) for (d, _), i in zip(rows, ids, strict=True))
    assert Counter(map(tuple, codec.decode(encoded, PATH).collect())) == Counter((d, t or "") for d, t in rows)
    assert codec.round_trip(empty, PATH).count() == codec.decode(codec.encode(empty, PATH), PATH).count() == 0


def test_cuts_are_certain_and_long_fragments_merge_alike():
    own, tokenizer = bpe.codec(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(8)
    odd = ["a" * 999, "é" * 400, "".join(chr(rng.choice([9, 10, 32, 39, 48, 97, 115, 116, 0xA0, 0x2028, 0x3B1, 0x661, 0x4E2D, 0x1F600])) for _ in range(3000)), "=" * 500 + "ab" * 300]
    odd += ["".join(rng.choice("ab' st\n.,1é") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, got in zip(odd, own.encode([t.encode() for t in odd]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert any(len(f) > 256 for f in [b"a" * 999]) and own.merge(b"a" * 999) == own._merge_long([b"a"] * 999)


def test_packing_places_every_piece_once(spark, docs, rows, empty):
    ids, _ = library_ids(rows)
    pieces = packing.cut_documents(docs, PATH, capacity=256, end_id=0)
    got = packing.best_fit(pieces, capacity=packing.Capacity(tokens=256, documents=4)).collect()
    want = Counter()
    for (d, _), i in zip(rows, ids, strict=True):
        i = i + [0]
        at, size = 0, len(i) if len(i) <= 256 else len(i) % 256 or 256
        for k in range(-(-len(i) // 256)):
            want[d, k, at, size, zlib.crc32(np.array(i[at : at + size], "<u4").tobytes())] += 1
            at, size = at + size, 256
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        assert len(inside) <= 4
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.best_fit(packing.cut_documents(empty, PATH)).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    rng = random.Random(1)
    counts = {rng.randrange(1, 100): rng.randrange(1, 900) for _ in range(60)}
    limits = packing.Capacity(tokens=128, documents=6, attention=5_000)
    counts = {k: v for k, v in counts.items() if k * k <= 5_000}
    planned = packing.plan(counts, limits, (1.0, 0.2, 0.2), score)
    used = Counter()
    for n, lengths in planned:
        assert sum(lengths) <= 128 and len(lengths) <= 6 and sum(x * x for x in lengths) <= 5_000
        for x in lengths:
            used[x] += n
    assert used == Counter(counts) and len(planned) <= 4 * 128
    with pytest.raises(ValueError):
        packing.plan({200: 1}, limits)
    assert sum(n for n, _ in packing.plan({60: 10, 40: 20, 28: 10}, packing.Capacity(tokens=128))) == 15


def test_exact_groups(spark, docs, rows, empty):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = Counter()
    for t, own in groups.items():
        keep = max((d for d in own if d is not None), default=None)
        for d in own:
            want[d, keep, len(own), d == keep] += 1
    got = exact.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept")
    assert Counter(map(tuple, got.collect())) == want
    assert exact.exact_duplicates(empty).count() == 0


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs, rows, empty):
    prints = {(d, t): brute_fingerprint(t, 3) for d, t in rows}
    part = components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), f in prints.items():
        if d is not None:
            least[part[f]] = min(d, least.get(part[f], d))
    want = Counter((d, f"{prints[d, t]:016x}", least.get(part[prints[d, t]])) for d, t in rows)
    found = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0"), "component_id")
    assert Counter(map(tuple, found.collect())) == want
    assert simhash.near_duplicates(empty).count() == simhash.similar_documents(empty).count() == 0


def test_fingerprint_links_in_groups_of_any_size(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(120)})
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "bits long")
    for limit in (512, 1):
        monkeypatch.setattr(simhash, "COMPARE_ALL", limit)
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.fingerprint_links(table).collect()]
        assert all((a ^ b).bit_count() >= 0 for a, b in links)
        pairs = set(links) | {(b, a) for a, b in links}
        assert components(prints, lambda a, b: (a, b) in pairs) == want


def test_wide_fingerprints_find_edited_copies(spark, docs):
    rng = random.Random(6)
    data = []
    for k in range(60):
        words = prose(rng, 150).split()
        data.append((2 * k, " ".join(words)))
        words[rng.randrange(150)] = "edited"
        words[rng.randrange(150)] = "again"
        data.append((2 * k + 1, " ".join(words)))
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in simhash.similar_documents(table).collect()}
    right = sum(got[2 * k + 1] == (2 * k, False) and got[2 * k] == (2 * k, True) for k in range(60))
    assert right >= 58 and all(c // 2 == d // 2 for d, (c, _) in got.items())
    assert simhash.similar_documents(docs).count() == docs.count()


def test_resembling_documents_are_not_near_copies(spark):
    rng = random.Random(16)
    template = prose(rng, 400).split()

    def filled(share):
        words, at = template[:], rng.randrange(400)
        for i in range(round(400 * share)):  # one run of own words: shingles shared with the others are known closely
            words[(at + i) % 400] = f"own{rng.randrange(10**9)}"
        return words

    data = [(k, " ".join(filled(0.15))) for k in range(300)]
    for k in range(0, 40, 2):
        words = data[k][1].split()
        words[200:210] = [f"new{rng.randrange(10**9)}" for _ in range(10)]
        data.append((1000 + k, " ".join(words)))
    sets = {d: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for d, t in data}
    linked = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert all(linked[d] == linked[c] for d, c in got.items())  # no link below the similarity
    alone = {d for d in sets if sum(x == linked[d] for x in linked.values()) == 1}
    assert len(alone) >= 30 and all(got[d] == d for d in alone)
    assert sum(got[d] == c for d, c in linked.items()) >= 0.95 * len(linked)


def test_large_groups_are_searched_whole():
    rng = np.random.default_rng(4)
    sketch = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 90, axis=0)
    sketch[np.arange(60), 0] ^= np.uint64(1) << np.arange(60, dtype=np.uint64)
    sketch[60:] = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    a, b = simhash.close_links(np.zeros(90, np.int64), sketch, 2)
    joined = components(range(90), lambda x, y: (x, y) in set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)))
    assert len({joined[x] for x in range(60)}) == 1 and len(set(joined.values())) == 31 and len(a) == 59


@pytest.mark.parametrize("group_rows", [2, 50_000])
def test_suffixes_against_every_window(spark, docs, rows, empty, group_rows):
    count = Counter()
    for _, t in rows:
        data = (t or "").encode()
        count.update(data[i : i + 40] for i in range(len(data) - 39))
    want = Counter()
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 39):
            if count[data[i : i + 40]] > 1:
                gone[i : i + 40] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(data), runs, bytes(np.frombuffer(data, np.uint8)[~gone])] += 1
    got = suffixes.remove_repeats(docs, least=40, group_rows=group_rows).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == want
    assert suffixes.remove_repeats(empty, least=40).count() == 0


def test_blind_tries_sort_and_compare():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 30)
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(n)]
        order, common, _ = suffixes.BlindTrie(strings).walk()
        assert [strings[i] for i in order] == sorted(strings)
        assert common == [suffixes._common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
        heads = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(n)]
        for i, ranges in enumerate(suffixes.group_repeats(7, heads, [b"xx" + s for s in strings])):
            want = set()
            for j in range(n):
                if j != i:
                    want |= set(range(max(0, 5 - suffixes._common(strings[i], strings[j])), suffixes._common(heads[i], heads[j]) + 1))
            assert set().union(*(range(a, b + 1) for a, b in ranges)) == want


def test_chunks_against_a_plain_pass(spark, docs, rows, empty):
    pieces, count = {}, Counter()
    for d, t in rows:
        data = (t or "").encode()
        ends = chunking.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
        assert "".join(data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)) == (t or "")
        pieces[d, t] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        count.update(c for _, _, c in pieces[d, t])
    seen, want = {}, {}
    for d, t in sorted(pieces, key=lambda x: (x[0] if x[0] is not None else chunking.NO_ID, hashlib.md5((x[1] or "").encode()).digest())):
        flagged = []
        for a, b, c in pieces[d, t]:
            seen.setdefault(c, (d, t, a))
            if count[c] > 1:
                flagged.append((a, b, seen[c] == (d, t, a)))
        want[d, t] = chunking.runs(flagged, 80)
    got = chunking.remove_repeats(docs).select("doc_id", "text", "_cut").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r._cut.repeated, [tuple(s) for s in r._cut.spans]) == want[r.doc_id, r.text]
    assert sum(len(s) > 0 for _, s in want.values()) >= 3
    assert chunking.remove_repeats(empty).count() == 0


def test_an_insertion_moves_few_chunks():
    rng = random.Random(9)
    text = prose(rng, 800).encode()
    cut = lambda t: {t[a:b] for e in [chunking.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()] for a, b in zip([0, *e], e, strict=False)}
    whole, moved = cut(text), cut(text[:2000] + b"inserted words" + text[2000:])
    assert len(whole & moved) >= len(whole) - 6
