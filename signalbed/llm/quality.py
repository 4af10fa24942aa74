"""Document quality by regularised quadratic discriminant analysis (operator 3).

A text becomes a short vector of transformed statistics. Each class keeps a
mean and a covariance that is shrunk towards the pooled covariance and towards
a multiple of the identity; its Cholesky factor is kept. The score follows the
difference of the two log densities, brought to a probability by a logistic
curve fitted on the same rows.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.llm.rows import id_remainder, per_document, to_bytes

#: Most labelled rows (about) that the fit looks at, chosen by a hash of the id.
SAMPLE_ROWS = 40_000
TO_POOLED, TO_IDENTITY = 0.15, 0.02
THRESHOLD = 0.3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, log_density_difference double"

_KINDS = np.zeros((256, 7))
for _byte in range(256):
    _char = chr(_byte)
    _kind = (0 if "a" <= _char <= "z" else 1 if "A" <= _char <= "Z" else 2 if "0" <= _char <= "9"
             else 3 if _char.isspace() and _byte < 128 else 4 if _char in ".,;:'\"()-?" else 5 if _byte < 128 else 6)
    _KINDS[_byte, _kind] = 1
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digits", "spaces", "points", "symbols", "high_bytes",
    "bang", "distinct_words", "distinct_lines", "top_word", "line_words",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; a null counts as empty."""
    data = to_bytes(text)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    n, total = max(len(words), 1), max(len(data), 1)
    lower, upper, digits, spaces, points, symbols, high = (counts @ _KINDS / total).tolist()
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    share = lambda x: math.log((x + 0.01) / (1.01 - x))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / n), share(lower),
        share(upper), share(digits), share(spaces), share(points), share(symbols), share(high),
        share(int(counts[33]) / total), share(len(tally) / n), share(len(set(lines)) / len(lines)),
        share(max(tally.values(), default=0) / n), math.log1p(len(words) / len(lines)),
    ]


@dataclasses.dataclass(frozen=True)
class Discriminant:
    """Both classes in standard units: mean, Cholesky factor and log determinant; then the logistic curve."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    slope: float
    offset: float

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        out = []
        for mean, factor in zip(self.means, self.factors):
            part = np.linalg.solve(factor, (z - mean).T)
            out.append(-0.5 * (part * part).sum(0) - np.log(np.diag(factor)).sum())
        return out[1] - out[0]

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(difference, -100, 100) + self.offset, -30, 30)))


def fit_discriminant(x: np.ndarray, y: np.ndarray, pooled: float = TO_POOLED, identity: float = TO_IDENTITY) -> Discriminant:
    """From rows ``x`` and classes ``y`` (0 or 1).

    With fewer than two rows in a class both classes share what is known, and
    the score is the (smoothed) share of class 1 everywhere.
    """
    width = x.shape[1]
    share = (float((y == 1).sum()) + 1) / (len(y) + 2)
    prior = math.log(share / (1 - share))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        eye, zero = np.eye(width), np.zeros(width)
        return Discriminant(zero, np.ones(width), (zero, zero), (eye, eye), 0.0, prior)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - center) / scale
    groups = [z[y == k] for k in (0, 1)]
    means = tuple(g.mean(0) for g in groups)
    own = [np.cov(g.T, bias=True) for g in groups]
    common = sum(len(g) * s for g, s in zip(groups, own)) / len(z)
    factors = tuple(
        np.linalg.cholesky((1 - pooled - identity) * s + pooled * common
                           + identity * max(np.trace(s) / width, 0.05) * np.eye(width)) for s in own
    )
    first = Discriminant(center, scale, means, factors, 1.0, prior)
    d = np.clip(first.log_density_difference(x), -100, 100)
    slope, offset = 0.1, prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * d + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((y - p) * d).sum() - 1e-3 * slope, (y - p).sum()])
        hessian = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return dataclasses.replace(first, slope=float(slope), offset=float(offset))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    """From ``docs`` (``doc_id text``) and ``labels`` (``doc_id quality``); rows without a label are left out.

    Labels are counted first; about ``sample_rows`` of them, by a hash of the
    id, are joined to their texts (their ids are what a broadcast holds) and
    turned into statistics by the executors. The driver gets only those vectors,
    each once however often its row is repeated.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int"))
    n = max(known.count(), 1)
    place = (F.xxhash64("doc_id", F.lit("quality")) % 1_000_000 + 1_000_000) % 1_000_000
    sample = known.where(place < min(1.0, sample_rows / n) * 1_000_000).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            return {"x": [statistics(t) for t in batch["text"].to_pylist()], "y": batch["quality"]}

        return work

    rows = per_document(texts, ["text", "quality"], start, "x array<double>, y int").distinct().toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_discriminant(x, rows["y"].to_numpy(dtype=int))


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (likelier good when higher) and ``predicted`` for every row of ``docs`` (``doc_id text``).

    Null and empty texts have the statistics of an empty text and a score like
    any other. Repeated rows are answered one by one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            x = np.array([statistics(t) for t in batch["text"].to_pylist()])
            difference = known.log_density_difference(x)
            scores = known.score(difference)
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores,
                    "predicted": (scores >= threshold).astype(np.int32), "log_density_difference": difference}

        return work

    columns = [F.col("doc_id").cast("bigint"), "text", (id_remainder("doc_id", 5) == 0).alias("held_out")]
    return per_document(docs, columns, start, SCHEMA)


def op3_quality(spark, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return score(docs, fit(docs, labels.where(id_remainder("doc_id", 5) != 0)))
