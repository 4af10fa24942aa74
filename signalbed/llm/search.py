"""Ranked lexical search by NRA, "no random access" (operator 12).

The documents are read in shards of bounded size, as Spark deals them out. In a
shard every query term has one list, sorted by impact. For an item the lists
are read sequentially from the largest impact down; a document's score lies
between the sum of what was read of it and that sum plus the next unread impact
of each list where it was not met. Reading goes on until no document outside
can come in, ties included, and until the scores of all that remain are exact.
What a shard answers is its exact best; the best of all shards are merged.

Nothing of a document is shuffled but its score where it is among the best of
its shard. The items are the stated query set: they are taken in blocks of at
most ``BLOCK_TERMS`` terms (or one item, if it is longer), which is what a
broadcast holds.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from signalbed.llm.rows import per_document, per_partition, plain_words
from signalbed.session import cut_lineage

BEST = 10
#: Percent of the length in a document's norm.
LENGTH_SHARE = 75
#: Most terms of the items of one block; a single longer item is a block.
BLOCK_TERMS = 500_000
#: A shard is full with so many documents, or so many entries in its lists.
SHARD_ROWS, SHARD_ENTRIES = 8_192, 2_000_000
#: Documents tokenized at once.
ROWS_AT_ONCE = 500
#: Entries read of an item's lists before its bounds are looked at for the first time; doubled every time.
FIRST_READ = 2_048


@dataclasses.dataclass(frozen=True)
class Block:
    """Some items: the number of every term, and of each item its terms and how often it holds them."""

    terms: dict[bytes, int]
    items: list[tuple[np.ndarray, np.ndarray]]


@dataclasses.dataclass(frozen=True)
class Corpus:
    """Documents with a term, their terms, and the weight of each term of a block."""

    documents: int
    length: int
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def norm(n: int, documents: int, length: int, share: int = LENGTH_SHARE) -> int:
    return 100 - share + (share * n * documents) // length if length else 100


def entries_of(texts: list[str | None], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of every term of the block in ``texts``, and the number of terms of each text."""
    words = [plain_words(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found = np.fromiter(map(terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
    key = np.repeat(np.arange(len(words)), sizes) * max(len(terms), 1) + found
    key, times = np.unique(key[found >= 0], return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), times, sizes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def corpus_of(docs: DataFrame, block: Block, shared) -> Corpus:
    """Counts over all documents; tasks add up before the shuffle, the driver gets one number per term of the block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        terms = shared.value.terms
        holding, totals = np.zeros(len(terms), np.int64), np.zeros(2, np.int64)
        for piece in _pieces(batches):
            _, term, _, sizes = entries_of(piece["text"].to_pylist(), terms)
            holding += np.bincount(term, minlength=len(terms))
            totals += (sizes > 0).sum(), sizes.sum()
        known = np.flatnonzero(holding)
        yield {"term": [-1, -2, *known], "n": [*totals, *holding[known]]}

    counts = per_partition(docs, ["text"], work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in counts.collect()}
    documents = n.get(-1, 0)
    return Corpus(documents, n.get(-2, 0), np.array([weight(documents, n.get(k, 0)) for k in range(len(block.terms))], np.int64))


class Shard:
    """The impact-sorted lists of some documents."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((document, -impact, term))
        self.document, self.impact = document[order], impact[order]
        self.cuts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def lists(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (document, list, impact) of all lists of an item, merged in the order they are read."""
        spans = [(k, self.cuts[t], self.cuts[t + 1], n) for k, (t, n) in enumerate(zip(terms, times)) if self.cuts[t] < self.cuts[t + 1]]
        if not spans:
            return (np.zeros(0, np.int64),) * 3
        document = np.concatenate([self.document[a:b] for _, a, b, _ in spans])
        impact = np.concatenate([self.impact[a:b] * n for _, a, b, n in spans])
        which = np.repeat([k for k, *_ in spans], [b - a for _, a, b, _ in spans])
        order = np.argsort(-impact, kind="stable")
        order = order[: np.searchsorted(-impact[order], 0)]  # an impact of nothing adds nothing
        return document[order], which[order], impact[order]


def best_of(shard: Shard, terms: np.ndarray, times: np.ndarray, n_documents: int, ids: np.ndarray, best: int,
            first_read: int = FIRST_READ) -> tuple[list[int], list[int]]:
    """(documents, exact scores) of the ``best`` of a shard, scores above 0, equal scores by ``ids``; see the module.

    Once no unread document can come in, entries of documents that are out are
    passed over without being added.
    """
    document, which, impact = shard.lists(terms, times)
    lower = np.zeros(n_documents, np.int64)
    met_at, met_list = document[:0], which[:0]
    read, step = 0, first_read
    inside = None  # the documents that can still be among the best, once no unread one can
    while True:
        now = slice(read, read + step)
        fresh = (document[now], which[now], impact[now])
        if inside is not None:
            stay = inside[fresh[0]]
            fresh = tuple(x[stay] for x in fresh)
        np.add.at(lower, fresh[0], fresh[2])
        met_at, met_list = np.concatenate([met_at, fresh[0]]), np.concatenate([met_list, fresh[1]])
        read, step = min(read + step, len(document)), step * 2
        # Next unread impact of every list.
        ahead_list, first = np.unique(which[read:], return_index=True)
        frontier = np.zeros(len(terms), np.int64)
        frontier[ahead_list] = impact[read:][first]
        unmet = np.full(n_documents, frontier.sum())
        np.subtract.at(unmet, met_at, frontier[met_list])
        upper = lower + unmet
        bar = np.partition(lower, n_documents - best)[n_documents - best] if n_documents >= best else 0
        alive = (upper >= max(bar, 1)) if inside is None else inside & (upper >= max(bar, 1))
        if read == len(document) or not (unmet[alive] > 0).any():
            break
        if frontier.sum() < bar:
            inside = alive
            stay = inside[met_at]
            met_at, met_list = met_at[stay], met_list[stay]
    found = np.flatnonzero(alive & (lower > 0))
    found = found[np.lexsort((ids[found], -lower[found]))[:best]]
    return found.tolist(), lower[found].tolist()


def shard_answers(block: Block, corpus: Corpus, best: int, share: int, limits: tuple[int, int] = (SHARD_ROWS, SHARD_ENTRIES)):
    """The work of one partition: (item, doc_id, score) of the best of each of its shards."""

    def answer(parts: list, ids: list) -> dict:
        places = np.cumsum([0] + [len(sizes) for *_, sizes in parts])
        document = np.concatenate([d + at for (d, *_), at in zip(parts, places)])
        term, times, sizes = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        norms = np.array([norm(n, corpus.documents, corpus.length, share) for n in sizes.tolist()], np.int64)
        impact = corpus.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * norms[document]))
        shard = Shard(document, term, impact, len(block.terms))
        order = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
        out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
        for item, (terms, held) in enumerate(block.items):
            documents, scores = best_of(shard, terms, held, len(ids), order, best)
            out["item"] += [item] * len(documents)
            out["doc_id"] += [ids[d] for d in documents]
            out["score"] += scores
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts, ids, entries = [], [], 0
        for piece in _pieces(batches):
            parts.append(entries_of(piece["text"].to_pylist(), block.terms))
            ids += piece["doc_id"].to_pylist()
            entries += len(parts[-1][0])
            if len(ids) >= limits[0] or entries >= limits[1]:
                yield answer(parts, ids)
                parts, ids, entries = [], [], 0
        if ids:
            yield answer(parts, ids)

    return work


def blocks_of(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[tuple[list, Block]]:
    """The distinct rows of ``items`` (``item_id text``) that hold a term, in blocks."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            held = [Counter(plain_words(t)) for t in batch["text"].to_pylist()]
            return {"item_id": batch["item_id"], "terms": [list(h) for h in held], "times": [list(h.values()) for h in held]}

        return work

    kind = items.schema["item_id"].dataType.simpleString()
    rows = per_document(items.select("item_id", "text").distinct(), ["item_id", "text"], start,
                        f"item_id {kind}, terms array<binary>, times array<bigint>").where("size(terms) > 0")
    ids, terms, held = [], {}, []
    total = 0
    for row in rows.toLocalIterator():
        if ids and total + len(row["terms"]) > most:
            yield ids, Block(terms, held)
            ids, terms, held, total = [], {}, [], 0
        ids.append(row["item_id"])
        held.append((np.array([terms.setdefault(bytes(t), len(terms)) for t in row["terms"]]), np.array(row["times"])))
        total += len(row["terms"])
    if ids:
        yield ids, Block(terms, held)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, share: int = LENGTH_SHARE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id rank doc_id score`` of the ``best`` rows of ``docs`` (``doc_id text``) for each of ``items`` (``item_id text``).

    Every row of ``docs`` is a document, rows that repeat an id or a text
    included; a row without an id comes after those with one at equal scores. A
    null or empty text has no terms and is never found; items without terms get
    no rows, items that repeat id and text are one. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    id_type = StructType([StructField("item_id", items.schema["item_id"].dataType)])
    out = None
    for ids, block in blocks_of(items, block_terms):
        shared = spark.sparkContext.broadcast(block)
        corpus = corpus_of(docs, block, shared)
        counted = spark.sparkContext.broadcast(corpus)

        def work(batches: Iterator[pa.RecordBatch], shared=shared, counted=counted) -> Iterator[dict]:
            return shard_answers(shared.value, counted.value, best, share)(batches)

        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), *id_type]))
        found = per_partition(docs, ["doc_id", "text"], work, "item int, doc_id bigint, score bigint")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else cut_lineage(out).unionByName(cut_lineage(found))
    if out is None:
        return spark.createDataFrame([], id_type).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    return out


def op12_search(spark, folder: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP12_SQL = rf"""
WITH held AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS size FROM rows_ WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS total, CAST(sum(size) AS BIGINT) AS length FROM docs),
entries AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM rows_) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM entries SEMI JOIN held USING (term) GROUP BY term), corpus),
scores AS (
  SELECT item_id, doc_id, row_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * size * total) // length)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN entries USING (term) JOIN docs USING (row_id), corpus
  GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= {BEST}
"""
