"""Quality by regularised quadratic discriminant over statistics of whole texts.

Each class has a Gaussian over the transformed statistics. A class covariance
is shrunk towards the pooled one and towards its own mean variance, so it can
always be factored; the Cholesky factors are computed once and the score is the
logistic of the difference of the Mahalanobis log densities and log priors.

Counts, sums and cross products of all labelled rows are one aggregation with
map-side sums; two rows reach the driver. Nothing is sampled.

Null texts count as empty, and empty texts get a score. Rows without an id are
scored and never learned from, like labels without an id or a value. An id
labelled twice counts for each distinct label, a repeated document row each
time. With fewer than two classes every score is the share of class 1 among
the labelled rows, 0 without any. An empty table gives no rows; columns
other than the two named are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import text_chunks
from tidemark.staging import stage

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "pipes", "symbols", "digits", "upper", "ends", "commas", "marks", "lines",
    "beyond_ascii", "distinct_words", "repeated_word", "top_word", "short_words", "distinct_lines", "plain_words", "distinct_pairs",
)
_GROUPS = {
    "pipes": b"|", "symbols": b"#$%&*@^~<>{}[]+=_/\\", "digits": b"0123456789", "upper": bytes(range(65, 91)), "ends": b".!?", "commas": b",;:",
    "marks": b"!?", "lines": b"\n", "beyond_ascii": bytes(range(128, 256)),
}
_MEMBERS = np.zeros((256, len(_GROUPS)))
for _k, _group in enumerate(_GROUPS.values()):
    _MEMBERS[list(_group), _k] = 1


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text: logarithms of sizes, square roots of shares."""
    words = text.split()
    n, m = max(len(text), 1), max(len(words), 1)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBERS / n).tolist()
    counts = Counter(words)
    lines = text.split(b"\n")
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(n / m), math.log1p(max(map(len, words), default=0)),
        *(math.sqrt(x) for x in shares), math.sqrt(len(counts) / m), math.sqrt(sum(map(eq, words, words[1:])) / m),
        math.sqrt(max(counts.values(), default=0) / m), math.sqrt(sum(len(w) <= 3 for w in words) / m),
        math.sqrt(len(set(lines)) / len(lines)), math.sqrt(sum(map(bytes.isalpha, words)) / m),
        math.sqrt(len(set(zip(words, words[1:], strict=False))) / m),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes; ``share`` alone where one is missing."""

    share: float
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = [c - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, label: str, to_pooled: float = 0.1, to_sphere: float = 0.02) -> Discriminant:
    """The discriminant of ``stats`` for ``label`` (0 or 1) over all rows of ``labelled``."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("stats")[i]) for i in range(d)] + [F.sum(F.col("stats")[i] * F.col("stats")[j]) for i, j in pairs]
    found = {r[0]: (r[1], np.array(r[2 : 2 + d]), np.array(r[2 + d :])) for r in labelled.groupBy(label).agg(F.count(F.lit(1)), *sums).collect()}
    total = sum(x[0] for x in found.values())
    share = found[1][0] / total if 1 in found else 0.0
    if set(found) != {0, 1} or min(x[0] for x in found.values()) < 2:
        return Discriminant(share, [], [], [])
    scatter = {}
    for c, (n, total_c, products) in found.items():
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, products, strict=True):
            square[i, j] = square[j, i] = v
        scatter[c] = square - np.outer(total_c, total_c) / n
    pooled = sum(scatter.values()) / max(total - 2, 1)
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    means, inverses, constants = [], [], []
    for c in (0, 1):
        n, total_c, _ = found[c]
        own = scatter[c] / max(n - 1, 1)
        weight = to_pooled + (1 - to_pooled) * d / (n + d)  # a small class leans on the pooled covariance
        shrunk = (1 - weight) * own + weight * pooled
        scaled = shrunk / np.outer(spread, spread)
        scaled = (1 - to_sphere) * scaled + to_sphere * max(np.trace(scaled) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(scaled) * spread[:, None]
        means.append(total_c / n)
        inverses.append(np.linalg.inv(factor))
        constants.append(math.log(n / total) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(share, means, inverses, constants)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` of every row of ``stats``."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(x), pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row of ``docs``; learns from the rows of ``labels`` given."""
    stats = stage(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where("doc_id IS NOT NULL AND _label IN (0, 1)").distinct()
    return score(stats, fit(stats.join(known, "doc_id"), "_label"))
