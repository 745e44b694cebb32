"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct lower-case words, their first four and
five letters, and the five letters that begin two or more of them. A logistic regression over them is fitted with two penalties: the
size of the weights, and the change of a sentence's score when its identity
terms are swapped for others of the same group. So a term that merely stands
in toxic sentences earns no weight of its own, and a neutral mention of a
group scores like the same sentence about any other.

The fit uses at most ``sample`` labelled rows (those with the smallest hash of
their id) and at most ``size`` features, both parameters; the rows chosen reach
the texts through a broadcast of at most ``sample`` ids. Features are counted
on Spark; the driver sees ``size`` features, each sampled row's feature numbers
and one row per pair of terms swapped. All documents are scored, whole.

Null texts count as empty and are scored. Rows without an id are scored and
not learned from, like labels without an id or a value. An id labelled twice counts
for its larger label; repeated rows are scored each. With labels of one class
only, the score is that class; without any, 0. An empty table gives no rows;
extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import stage

# Groups of identity terms; a term is swapped for the others of its group.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"), ("father", "mother"), ("he", "she"),
    ("black", "white", "asian", "latino", "indigenous"), ("african", "american", "european", "chinese", "mexican", "arab", "indian"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"), ("young", "old"), ("immigrant", "citizen"),
    ("immigrants", "citizens"), ("disabled", "blind", "deaf", "autistic"), ("rich", "poor"),
)
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
_COUNTERPARTS = {t: [o for o in group if o != t] for group in IDENTITY_TERMS for t in group}


def features(words: Iterable[str]) -> set[str]:
    """Distinct words (marked ``=``), their first four and five letters, and five letters that begin several (marked ``+``)."""
    distinct = set(words)
    found = {"=" + w for w in distinct}
    found.update([w[:4] for w in distinct])
    begins = Counter([w[:5] for w in distinct])
    found.update(begins)
    found.update(["+" + h for h, n in begins.items() if n > 1])
    return found


def swaps(text: str, counterparts: dict[str, list[str]] = _COUNTERPARTS) -> Iterator[tuple[frozenset[str], frozenset[str]]]:
    """Per sentence with identity terms and counterpart: the features gained and lost by the swap."""
    low = text.lower()
    for sentence in SENTENCE.split(low):
        words = WORDS.findall(sentence)
        for term in counterparts.keys() & set(words):
            before = features(words)
            for other in counterparts[term]:
                after = features([other if w == term else w for w in words])
                yield frozenset(after - before), frozenset(before - after)


@dataclass
class Model:
    bias: float = -30.0
    words: dict[str, float] = field(default_factory=dict)
    heads: dict[str, float] = field(default_factory=dict)
    shared: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        words = set(WORDS.findall(text.lower()))
        begins = Counter([w[:5] for w in words])
        heads = {w[:4] for w in words}.union(begins)
        total = self.bias + sum(map(self.words.__getitem__, self.words.keys() & words)) + sum(map(self.heads.__getitem__, self.heads.keys() & heads))
        total += sum(self.shared[h] for h in self.shared.keys() & begins.keys() if begins[h] > 1)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def solve(rows: list[np.ndarray], y: np.ndarray, n_features: int, changes: list[tuple[int, np.ndarray, np.ndarray]], l2: float, counterfactual: float, rounds: int) -> tuple[float, np.ndarray]:
    """Bias and weights: logistic loss + ``l2`` |w|^2 + ``counterfactual`` times the mean squared score change of the swaps."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    weight, bias = np.zeros(n_features), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    swapped = sum(n for n, _, _ in changes)
    for k in range(1, rounds + 1):
        z = np.bincount(of, weight[at], len(rows)) + bias
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(at, miss[of], n_features) / len(y) + 2 * l2 * weight, miss.mean())
        for n, gained, lost in changes:
            change = weight[gained].sum() - weight[lost].sum()
            step = 2 * counterfactual * n / swapped * change
            grad[gained] += step
            grad[lost] -= step
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weight -= move[:-1]
        bias -= float(move[-1])
    return bias, weight


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, size: int = 300, l2: float = 1e-4, counterfactual: float = 1.0, rounds: int = 300) -> Model:
    """The classifier learned from ``labels`` of ``docs``."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_label")
    rows = stage(texts, "labelled")
    totals = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(bias=30.0 if totals.get(1) else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])

        for batch in batches:
            for t, y in zip(batch.column("_text"), batch.column("_label"), strict=True):
                seen[y.as_py()].update(features(WORDS.findall(t.as_py().lower())))
                if len(seen[0]) + len(seen[1]) > 150_000:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    counts = rows.select("_text", "_label").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share, clean_share = F.col("toxic") / totals[1], F.col("clean") / totals[0]
    lean = F.abs(share - clean_share) / F.sqrt(share + clean_share)
    terms = {x for t in _COUNTERPARTS for x in features([t])}
    best = counts.where(F.col("toxic") + F.col("clean") >= 3).orderBy(lean.desc(), "feature").limit(size)
    vocabulary = sorted({r[0] for r in best.select("feature").collect()} | terms)
    number = {x: i for i, x in enumerate(vocabulary)}
    held = docs.sparkSession.sparkContext.broadcast(number)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [sorted(own[x] for x in own.keys() & features(WORDS.findall(t.as_py().lower()))) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(found, pa.list_(pa.int32()))], names=["y", "at"])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = held.value, Counter()
        for batch in batches:
            for t in batch.column("_text"):
                for gained, lost in swaps(t.as_py()):
                    seen[tuple(sorted(own[x] for x in gained if x in own)), tuple(sorted(own[x] for x in lost if x in own))] += 1
        pairs = [(g, o, n) for (g, o), n in seen.items() if g or o]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.int32())), pa.array([p[2] for p in pairs], pa.int64())], names=["gained", "lost", "n"])

    matrix = rows.select("_label", "_text").mapInArrow(design, "y int, at array<int>").toPandas()
    moves = rows.select("_text").mapInArrow(changed, "gained array<int>, lost array<int>, n long").groupBy("gained", "lost").agg(F.sum("n").alias("n")).toPandas()
    as_ints = lambda x: np.asarray(x, np.int64)
    changes = [(int(n), as_ints(g), as_ints(o)) for g, o, n in moves[["gained", "lost", "n"]].itertuples(index=False)]
    bias, weight = solve([as_ints(x) for x in matrix["at"]], matrix["y"].to_numpy(np.float64), len(vocabulary), changes, l2, counterfactual, rounds)
    used = {x: float(weight[i]) for x, i in number.items() if abs(weight[i]) > 1e-4}
    marked = lambda mark: {x[1:]: w for x, w in used.items() if x[0] == mark}
    return Model(bias, marked("="), {x: w for x, w in used.items() if x[0] not in "=+"}, marked("+"))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score (0 to 1) of the text in ``text_col``, for use in a projection of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([held.value.score(t) for t in part.fillna("")], dtype="float64")

    return score(F.col(text_col))
