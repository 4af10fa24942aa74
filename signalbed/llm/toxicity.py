"""Severity of toxicity by cumulative-link ordinal regression (operator 5).

Grades 0, 1, ... K-1 are ordered. One weight per word is shared by all
thresholds: P(grade > k) = sigmoid(weights . x - threshold_k), thresholds in
increasing order. Features are the words of a text, present or absent. A first-
order method with soft thresholding leaves most weights at exactly zero, so
ordinary words of a long text do not add up to anything.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed.llm.rows import per_document
from signalbed.session import cut_lineage

#: Most labelled rows (about) that the fit looks at, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
#: A feature takes part where its likelihood ratio against the label has less than one chance in a hundred (chi squared,
#: one degree of freedom). How many features those are, and how often they occur, is not bounded.
TELLING = 6.63
PENALTY = 0.5
STEPS = 300
STEMS = (4, 5, 6, 8)
#: A text counts as toxic from this probability of a grade above 0.
TOXIC_FROM = 0.4
SCHEMA = "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean"

_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """Whole words (marked by a full stop) and their stems of some lengths."""
    return {w[:k] for k in STEMS for w in words if len(w) >= k} | {w + "." for w in words}


@dataclasses.dataclass(frozen=True)
class Severity:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def chances(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold k, from the whole text."""
        known = self.weights
        words = words_of(text) if known else ()
        found = {w[:k] for k in STEMS for w in words if w[:k] in known and len(w) >= k}
        total = math.fsum([known[f] for f in found] + [known[w + "."] for w in words if w + "." in known])
        return [1 / (1 + math.exp(min(max(t - total, -700), 700))) for t in self.thresholds]


def table_of(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(feature names, row of each entry, feature of each entry) of texts given as word sets."""
    place: dict[str, int] = {}
    columns = [np.fromiter((place.setdefault(f, len(place)) for f in sorted(features_of(w))), np.int32) for w in texts]
    row_of = np.repeat(np.arange(len(columns), dtype=np.int32), [len(c) for c in columns])
    return list(place), row_of, np.concatenate([*columns, np.zeros(0, np.int32)])


def fit_ordinal(
    names: list[str], row_of: np.ndarray, column_of: np.ndarray, grades: np.ndarray, levels: int,
    penalty: float = PENALTY, steps: int = STEPS,
) -> Severity:
    """Weights and thresholds of ``levels`` grades by proximal gradient steps with momentum.

    The thresholds are kept in order by learning the logarithms of their gaps.
    Without rows, every grade above 0 is held to be very unlikely.
    """
    if not len(grades):
        return Severity({}, tuple(8.0 + k for k in range(levels - 1)))
    n, above = len(grades), [(grades > k).astype(float) for k in range(levels - 1)]
    rates = [(a.sum() + 0.5) / (n + 1) for a in above]
    first = -math.log(rates[0] / (1 - rates[0]))
    gaps = np.array([math.log(max(0.05, -math.log(b / (1 - b)) + math.log(a / (1 - a)))) for a, b in zip(rates, rates[1:])])
    theta = np.concatenate([[first], gaps])
    # A step per word from the curvature bound of its column, so rare words move as fast as common ones.
    seen = np.bincount(column_of, minlength=len(names)).astype(float)
    width = np.maximum(np.bincount(row_of, minlength=n), 1).astype(float)
    bound = np.bincount(column_of, weights=np.sqrt(width)[row_of], minlength=len(names)) * 0.25 * (levels - 1) + 1e-9
    rate_w = 1 / np.maximum(bound, seen)
    w = np.zeros(len(names))
    old, momentum = w, 1.0
    ahead = w
    for _ in range(steps):
        total = np.bincount(row_of, weights=ahead[column_of], minlength=n)
        cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
        # The likelihood of the grade is a difference of two neighbouring curves.
        curve = [1 / (1 + np.exp(-np.clip(total - c, -30, 30))) for c in cuts]
        upper = np.column_stack([np.ones(n), *curve])
        lower = np.column_stack([*curve, np.zeros(n)])
        at = np.arange(n)
        p = np.maximum(upper[at, grades] - lower[at, grades], 1e-12)
        slope = lambda c: c * (1 - c)
        up, low = slope(upper[at, grades]), slope(lower[at, grades])
        by_total = (up - low) / p
        by_cut = np.array([-(up[grades == k + 1] / p[grades == k + 1]).sum() + (low[grades == k] / p[grades == k]).sum()
                           for k in range(levels - 1)])
        by_theta = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * math.exp(theta[k]) for k in range(1, levels - 1)]])
        theta = theta + np.clip(by_theta / (0.25 * n), -0.5, 0.5)
        moved = ahead + rate_w * np.bincount(column_of, weights=by_total[row_of], minlength=len(names))
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate_w * penalty, 0)
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = w + (momentum - 1) / following * (w - old)
        old, momentum = w, following
    cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    return Severity({name: float(x) for name, x in zip(names, w) if x}, tuple(float(c) for c in cuts))


def graded(names: list[str], row_of: np.ndarray, column_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 (clean), 1 and 2 from a yes/no label.

    The features that are most telling of the label among these rows count as
    strong; a toxic text with more of them than the median toxic text is
    graded 2, every other toxic text 1.
    """
    n_on, n_off = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    on = np.bincount(column_of, weights=toxic[row_of], minlength=len(names))
    off = np.bincount(column_of, minlength=len(names)) - on
    strong = on / n_on > 8 * (off + 1) / (n_off + 1)
    hits = np.bincount(row_of, weights=strong[column_of], minlength=len(toxic))
    middle = float(np.median(hits[toxic == 1])) if toxic.any() else 0.0
    return np.where(toxic == 0, 0, np.where(hits > middle, 2, 1)).astype(int)


def _telling(counts: DataFrame, n_on: int, n_off: int) -> Column:
    """Whether ``seen_on`` of ``n_on`` toxic and ``seen_off`` of ``n_off`` other texts differ by more than chance."""
    seen = F.col("seen_on") + F.col("seen_off")

    def part(found: Column, rows: int, of: Column) -> Column:
        expected = of * F.lit(float(rows)) / F.lit(float(max(n_on + n_off, 1)))
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    unseen = F.lit(n_on + n_off) - seen
    ratio = (part(F.col("seen_on"), n_on, seen) + part(F.col("seen_off"), n_off, seen)
             + part(F.lit(n_on) - F.col("seen_on"), n_on, unseen) + part(F.lit(n_off) - F.col("seen_off"), n_off, unseen))
    return 2 * ratio > TELLING


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **settings) -> Severity:
    """From ``docs`` (``doc_id text``) and ``labels`` (``doc_id toxic``); rows without a label are left out.

    About ``sample_rows`` labelled rows, by a hash of the id, are joined to
    their texts (their ids are what a broadcast holds); rows that repeat id,
    label and words count once. Their features are counted by a grouping, and
    the driver gets (row, feature) as numbers for the telling features alone.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int"))
    n = max(known.count(), 1)
    place = (F.xxhash64("doc_id", F.lit("toxic")) % 1_000_000 + 1_000_000) % 1_000_000
    sample = known.where(place < min(1.0, sample_rows / n) * 1_000_000).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch["doc_id"], "toxic": batch["toxic"],
                    "features": [sorted(features_of(words_of(t))) for t in batch["text"].to_pylist()]}

        return work

    found = per_document(texts, ["doc_id", "text", "toxic"], start, "doc_id bigint, toxic int, features array<string>")
    rows = cut_lineage(found.withColumn("words", F.xxhash64("features")).dropDuplicates(["doc_id", "toxic", "words"]))
    graded_rows = rows.select("doc_id", "toxic", "words").orderBy("doc_id", "toxic", "words").toPandas()
    toxic = graded_rows["toxic"].to_numpy(dtype=int)
    entries = rows.select("doc_id", "toxic", "words", F.explode("features").alias("feature"))
    on = F.sum("toxic")
    counts = entries.groupBy("feature").agg(on.alias("seen_on"), (F.count("*") - on).alias("seen_off"))
    chosen = cut_lineage(counts.where(_telling(counts, int(toxic.sum()), int((1 - toxic).sum()))).select("feature"))
    names = [r["feature"] for r in chosen.orderBy("feature").collect()]
    number = pd.Series(np.arange(len(names), dtype=np.int32), index=pd.Index(names, dtype=object))
    row_number = {key: i for i, key in enumerate(zip(graded_rows["doc_id"], graded_rows["toxic"], graded_rows["words"]))}
    held = entries.join(chosen, "feature").groupBy("doc_id", "toxic", "words").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    row_of, column_of = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for row in held.collect():
        column_of.append(number[row["features"]].to_numpy())
        row_of.append(np.full(len(row["features"]), row_number[row["doc_id"], row["toxic"], row["words"]], np.int32))
    table = names, np.concatenate(row_of), np.concatenate(column_of)
    return fit_ordinal(*table, graded(*table, toxic), 3, **settings)


def severity_udf(spark, model: Severity, toxic_from: float = TOXIC_FROM):
    """A column function text -> struct(severity, grade, p_toxic, toxic)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, p_toxic double, toxic boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        above = [known.chances(t) for t in texts]
        return pd.DataFrame({
            "severity": [sum(c) for c in above], "grade": [sum(x >= 0.5 for x in c) for c in above],
            "p_toxic": [c[0] for c in above], "toxic": [c[0] >= toxic_from for c in above],
        })

    return judge


def severity(docs: DataFrame, model: Severity, text: str | Column = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``doc_id`` and the expected severity, grade, chance of any toxicity and verdict of every row of ``docs``.

    A null or empty text has no words and gets the severity of the thresholds
    alone, which is low. Repeated rows are answered one by one; other columns
    are ignored.
    """
    judge = severity_udf(docs.sparkSession, model, toxic_from)
    return docs.select(F.col("doc_id").cast("bigint"), judge(text).alias("found")).select("doc_id", "found.*")


def op5_toxicity(spark, folder: str) -> DataFrame:
    """Severity of every document, learned from the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return severity(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
