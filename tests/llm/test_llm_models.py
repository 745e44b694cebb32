"""Classifiers, embeddings, pages and the pipeline on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, embeddings, html, mincut, quality, simhash, toxicity


def rough(rng, n):
    return " | ".join(str(rng.randrange(10**6)) + "###" for _ in range(n))


def smooth(rng, n):
    return " ".join(rng.choice("the of and in a to is was for with that on".split()) + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = rough(rng, 40) if bad else smooth(rng, 80)
        if toxic:
            text += f" you stupid {rng.choice(['idiot', 'clown'])}."
        docs.append((i, text, 1.5, 0, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, None, None, None, None), (900, "", 0.0, 1, None), (901, None, 0.0, 1, None), (901, None, 0.0, 1, None), (902, "the woman is here. the man is here.", 0.0, 1, "x")]
    labels += [(None, 1, 1), (903, 1, 0), (5, None, None), (6, 1, 0)]
    return docs, labels


DOCS = "doc_id long, text string, score double, _label int, stats string"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_separates_and_scores_everything(spark, labelled):
    docs, labels = spark.createDataFrame(labelled[0], DOCS), spark.createDataFrame(labelled[1], LABELS)
    got = quality.classify(docs, labels.where("doc_id % 5 != 0 OR doc_id IS NULL")).collect()
    assert len(got) == len(labelled[0]) and all(0 <= r.score <= 1 for r in got)
    known = {i: q for i, q, _ in labelled[1] if q is not None and i is not None}
    held = [(r.score >= 0.5) == (known[r.doc_id] == 1) for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 5 == 0]
    assert sum(held) >= len(held) - 1
    one = labels.where("quality = 1")
    assert {r.score for r in quality.classify(docs, one).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_discriminant_equals_the_gaussian_densities():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 2]])
    cov = np.cov(x.T)
    factor = np.linalg.cholesky(cov)
    means = [x.mean(axis=0), x.mean(axis=0) + 1]
    model = quality.Discriminant(0.5, means, [np.linalg.inv(factor)] * 2, [-np.log(np.diag(factor)).sum()] * 2)
    density = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)) for m in means]
    assert np.allclose(model.scores(x), density[1] / (density[0] + density[1]))


def test_toxicity_learns_words_not_groups(spark, labelled):
    docs, labels = spark.createDataFrame(labelled[0], DOCS), spark.createDataFrame(labelled[1], LABELS)
    model = toxicity.fit(docs, labels.where("doc_id % 4 != 2 OR doc_id IS NULL"))
    got = docs.select("doc_id", toxicity.score_column(docs, model).alias("score")).collect()
    assert len(got) == len(labelled[0])
    toxic = {i: t for i, _, t in labelled[1] if t is not None and i is not None and i < 240}
    assert all((r.score >= 0.3) == (toxic[r.doc_id] == 1) for r in got if r.doc_id in toxic and r.doc_id != 6)
    assert toxicity.fit(docs, labels.where("toxic = 1")).score("hello") > 0.99
    assert toxicity.fit(docs, labels.limit(0)).score("idiot") < 0.01
    assert docs.limit(0).select(toxicity.score_column(docs, model)).count() == 0


def test_swapped_terms_are_scored_alike():
    assert list(toxicity.swaps("No terms here.")) == []
    gained, lost = next(iter(toxicity.swaps("A man ran. All ran.")))
    assert "=woman" in gained and "=man" in lost
    rng = np.random.default_rng(2)
    rows, y = [], []
    for i in range(200):  # feature 0 is the insult, 1 and 2 are terms; term 1 stands in most toxic rows
        bad = i % 2
        own = ([0] if bad else []) + ([1] if rng.random() < (0.9 if bad else 0.2) else [2])
        rows.append(np.array(own))
        y.append(float(bad))
    change = [(100, np.array([2]), np.array([1]))]
    _, free = toxicity.solve(rows, np.array(y), 3, [], 1e-3, 0.0, 300)
    _, tied = toxicity.solve(rows, np.array(y), 3, change, 1e-3, 5.0, 300)
    assert abs(free[1] - free[2]) > 0.5 > 0.1 > abs(tied[1] - tied[2]) and tied[0] > 1


def brute_links(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if rows[k][0] is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    return {(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.normal(size=16)
        for j in range(k % 4 + 1):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.08).astype(np.float32).tolist(), k % 3))
    dense = rng.normal(size=16)
    rows += [(1000 + j, (dense + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for j in range(80)]
    rows += [(2000 + j, rows[0][1], rows[0][2]) for j in range(5)] + [(2000, rows[0][1], rows[0][2])]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, rows[0][1], None), (None, rows[0][1], 0), (3005, [], 1), (3006, [1.0] * 8, 1)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, node int, key string")
    links = brute_links(rows, 0.93)
    want_n = Counter(a for a, _ in links)
    root = list(range(len(rows)))
    for a, b in sorted(links):
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    want = Counter((r[0], want_n[k], least.get(root[k]), r[0] == least.get(root[k])) for k, r in enumerate(rows))
    got = Counter(map(tuple, embeddings.near_duplicates(table).collect()))
    assert got == want  # windows as wide as a label find every link
    narrow = Counter(map(tuple, embeddings.near_duplicates(table, window=24, recall=0.98).collect()))
    assert sum((want & narrow).values()) >= len(rows) - 6  # passes are random; all but stray pairs are found
    assert Counter(x[0] for x in narrow.elements()) == Counter(x[0] for x in want.elements())
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_links_inside_a_dense_topic(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    x = centre / np.linalg.norm(centre) + rng.normal(size=(1_500, 64)) * 0.045  # cosines around 0.88, few links among many near ones
    x[1_400:] = x[:100] + rng.normal(size=(100, 64)) * 0.032  # about the threshold
    x = x.astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.triu(unit @ unit.T >= 0.93, 1)
    want = (links | links.T).sum(axis=1)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicates(table).collect()} == dict(enumerate(want.tolist()))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, window=300, recall=0.99).collect()}
    assert all(got[k] <= n for k, n in enumerate(want.tolist())) and sum(got.values()) >= 0.98 * want.sum() > 150


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**8])
def test_passes_follow_the_rows_of_a_label(rows):
    passes = embeddings.passes_for(rows, 0.93, 0.999, 2_048)
    together = (1 - np.arccos(0.93) / np.pi) ** np.ceil(np.log2(rows / 2_048))
    assert 1 - (1 - together) ** passes >= 0.999 and embeddings.passes_for(2_000, 0.93, 0.999, 2_048) == 1


def test_a_link_is_counted_once_and_leaves_a_forest(spark, tmp_path, monkeypatch):
    from tidemark import staging

    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path))
    rng = np.random.default_rng(6)
    x = (np.eye(8)[0] + rng.normal(size=(200, 8)) * 0.01).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(table, window=30, recall=0.98).collect()
    assert max(r.n_links for r in got) <= 199 and {r.component_id for r in got} == {0} and sum(r.n_links for r in got) >= 0.96 * 200 * 199
    sizes = [spark.read.parquet(str(p)).where("b >= 0").count() for p in tmp_path.iterdir() if p.name.startswith("pass-")]
    assert sizes and max(sizes) < 2 * 200 * 2  # links that leave a pass, not its pairs


def test_bands_end_at_the_window():
    unit = np.tile(np.eye(4)[:1], (60, 1))
    place = np.arange(100, 160)
    found = [x for x in embeddings._band_pairs(place, np.repeat([0, 1], 30), unit, np.ones(60, bool), 0.9, 7, rows=11)]
    pairs = {(int(a), int(b)) for i, j in found for a, b in zip(i, j, strict=True)}
    assert pairs == {(i, j) for g in (0, 30) for i in range(g, g + 30) for j in range(i + 1, min(i + 8, g + 30))}


@pytest.mark.parametrize("sizes", [(60, 120, 240)])
def test_look_alikes_are_decided_without_a_row_per_pair(spark, monkeypatch, tmp_path, sizes):
    """Documents of one template: links as all pairs give them, and what is emitted grows with the documents."""
    from tidemark import staging

    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    template = [rng.choice(words) for _ in range(120)]
    emitted = []
    for n in sizes:
        texts = []
        for _ in range(n):
            own = list(template if not texts or rng.random() < 0.4 else rng.choice(texts).split())
            for _ in range(rng.randrange(1, 7)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
        root = list(range(n))
        for i in range(n):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        folder = tmp_path / str(n)
        monkeypatch.setattr(staging, "staging_root", lambda _, folder=folder: str(folder))
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
        assert all(root[got[i]] == root[i] for i in got)  # no two are joined that links do not join
        assert len(set(got.values())) <= len(set(root)) + max(2, n // 40)
        emitted.append(sum(spark.read.parquet(str(p)).count() for p in folder.iterdir() if p.name.startswith(("proposed", "judged", "doubtful"))))
    # blocks grow in number too, so a little over proportion; pairs would grow sixteenfold
    assert emitted[-1] <= emitted[0] * (sizes[-1] / sizes[0]) ** 1.5


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 80, rng.integers(0, 60))) for _ in range(50)] + [np.arange(1000, 1003)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for often in (2, 8, 64):
        got = simhash.shared_counts(sets, often)
        np.fill_diagonal(got, 0)
        assert (got == np.array(want) - np.diag(np.diag(want))).all()


def test_components_over_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(70)] + [(500, 500 + i) for i in range(1, 90)] + [(9, 9), (900, 901), (901, 900)]
    rng.shuffle(links)
    table = spark.createDataFrame(links, "x long, y long")
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    assert got == {i: 0 for i in range(71)} | {500 + i: 500 for i in range(90)} | {900: 900, 901: 900}
    assert components.connected_components(table.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this site work better for you.</p></div>
<main><article><header><h1>The  title &amp; more</h1></header><p>First   paragraph of the text, <b>bold</b> and<br>broken.<p>Second one &lt;here&gt;.<!-- <p>hidden</p> -->
<div class="ad-slot">Buy the best shoes, now half price, only today.</div><ul><li>A point of the list.</li></ul><p>End.</p>
<form><label>Mail</label><button>Send</button></form></article><section id="comments"><p>I read this text and I liked it a lot, thank you all.</p></section></main>
<aside><p>Related stories that you may like to read next week.</p></aside><footer><p>&copy; 2020 Somebody, all rights reserved.</p></footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "v", "<p>Just a long enough line of plain text, without any structure.</p>"), (1, "u", PAGE), (4, "w", "<div><p>Cut off in a tag, but the text stays &am"), (5, "z", "no markup at all, only a sentence.")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(table).collect())
    text = "The title & more\nFirst paragraph of the text, bold and broken.\nSecond one <here>.\nA point of the list.\nEnd."
    texts = {1: text, 2: "", 3: "", None: "Just a long enough line of plain text, without any structure.", 4: "Cut off in a tag, but the text stays &am", 5: "no markup at all, only a sentence."}
    assert got == Counter((p, u, texts[p], len(texts[p])) for p, u, _ in rows)
    assert html.extract(table.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<p>" + "word " * 50_000 + "</p>"
    assert len(html.main_text(deep)[0]) == 249_999


LONG = "A long paragraph that says quite a lot about things that matter to many."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<main><article><section id="related-work"><h2>Related work</h2><p>Earlier studies did this.</p></section></article></main>', "Related work\nEarlier studies did this."),
        (f'<article><p>{LONG}</p><div class="widget-text"><p>Second paragraph here.</p></div></article>', f"{LONG}\nSecond paragraph here."),
        ('<article><h2 id="search">Search trees</h2><p>They are trees.</p><h2 id="privacy">Privacy</h2><p>It matters.</p></article>', "Search trees\nThey are trees.\nPrivacy\nIt matters."),
        (f"<article><p>{LONG}</p></article><div><p>Buy our new shoes now, fifty percent off today.</p></div>", LONG),
        (f'<article><p>{LONG}</p><div class="ad"><p>Buy our new shoes now, and never again, really.</p></div><p>{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f'<article><p>{LONG}</p><section id="comments"><p>I liked what you say there.</p></section></article>', LONG),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer><p>All rights reserved, and so on.</p></footer></article>", f"Title\n{LONG}"),
    ],
)
def test_names_are_costs_and_structure_decides(page, text):
    assert html.main_text(page)[0] == text


def test_the_cut_changes_what_a_block_says_of_itself():
    page = html.read_blocks(f"<div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>")
    assert [x > 0 for x in html.block_scores(page)] == [True, False, True]
    assert html.main_text(f"<div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>")[0] == f"{LONG}\nYes\n{LONG}"


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) + rng.random() / 8 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        cost = lambda lab: sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, lab, strict=True)) + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(mincut.label(scores, edges)) - best) < 1e-9


@pytest.fixture(scope="module")
def folder(spark, labelled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    unique = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(120)) for _ in range(60)]
    passage = " ".join(f"p{rng.randrange(10**5)}" for _ in range(60))
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(unique)]
    docs += [(100 + i, unique[i], "en", "s", 1) for i in range(10)]  # exact copies with larger ids
    docs += [(200 + i, unique[i + 20].replace(" ", " edited ", 1), "en", "s", 1) for i in range(10)]  # near copies
    docs += [(300 + i, f"{unique[i][:300]} {i * 7919} {passage} {rng.random()}", "en", "s", 1) for i in range(2)]
    docs += [(400 + i, f"{smooth(rng, 60)} what a stupid idiot {i}", "en", "s", 1) for i in range(8)]
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "no id here at all", "en", None, None), (600, unique[50], "en", "a", 1), (600, unique[50], "en", "a", 1)]
    docs += [(1000 + i, t, "en", "s", len(t)) for i, (_, t, *_) in enumerate(labelled[0][:240]) if i % 3 == 0 or i % 4]
    labels = [(400 + i, 1, 1) for i in range(4)] + [(i, 1, 0) for i in range(60)] + [(1000 + i, q, x) for i, (_, q, x) in enumerate(labelled[1][:240])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept, frames = {}, {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        if name != "best_fit_packing":
            assert docs.columns == columns
        docs = corpus_pipeline.stage(docs, name)
        frames[name] = docs
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert not [d for d in kept["toxicity"] if d is not None and 400 <= d < 408] and {500, 501, None, 300, 301} <= set(kept["toxicity"]) and all(kept["toxicity"][i] for i in range(60))
    exact = kept["exact_dedup"]
    assert all(exact[100 + i] == 1 and exact[i] == 0 for i in range(10)) and exact[50] == 0 and exact[600] == 1 and exact[500] + exact[501] == 1
    near = kept["simhash_near_dedup"]
    assert all(near[i + 20] == 1 for i in range(10)) and sum(near[200 + i] for i in range(10)) == 0 and all(near[i] == 1 for i in range(10, 50))
    texts = {r.doc_id: r for r in frames["substring_dedup"].collect()}
    assert set(texts) == set(near) and len(texts[301].text) < len(texts[300].text) and texts[301].n_chars == len(texts[301].text)
    packed = frames["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == set(texts) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_pipeline_passes_empty_and_extra_columns_on(spark, folder):
    internal = ("_keep_id", "_cut", "__cut", "_digest", "_first", "row", "place", "cut", "chunks", "_text", "node", "label", "cluster", "shingles", "repeated", "spans", "kept")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(f"given {c}") for c in internal}).withColumns({c: F.lit(1) for c in ("_id", "digest", "bits", "component", "length", "score", "chunk")})
    for table in (docs.limit(0), docs):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, table, folder)
            assert out.columns == docs.columns
            assert (out.count() == 0) == table.isEmpty()
            assert out.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> 'given {c}'" for c in internal)).isEmpty()
