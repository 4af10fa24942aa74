"""Benchmark decontamination with DataFrame functions only (operator 10).

A window is ten consecutive words of a benchmark item; an item of fewer words
is one window. Testing every word of every document is not needed: any ten
words in a row hold five that begin at a word number 1, 6, 11, ..., so only
those fives are looked up among the fives of the items. Around a five that is
known, the full windows are looked up and compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SEED = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows that a broadcast may hold (about 200 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all else unchanged; the short way where a text is all ASCII."""
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text in order; none in a null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, window, key) of every window of every item (``item_id text``)."""
    return (
        items.select("item_id", words(F.col("text")).alias("words"))
        .selectExpr("item_id", "words", f"least(size(words), {window}) AS size")
        .selectExpr("item_id", "words", "size", "explode_outer(IF(size > 0, sequence(1, size(words) - size + 1), NULL)) AS at")
        .where("at IS NOT NULL")
        .selectExpr("item_id", "size", "slice(words, at, size) AS window")
        .withColumn("key", F.xxhash64("window"))
        .distinct()
    )


def hits(docs: DataFrame, items: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """(keys, at, size, item_id) of every window of an item in the ``text`` of ``docs``; ``at`` counts words from 1.

    ``docs`` may have other columns; only the keys and the text are read.
    """
    table = benchmark_windows(items, window).persist()
    sizes = {r["size"]: r["n"] for r in table.groupBy("size").agg(F.count("*").alias("n")).collect()}
    hint = F.broadcast if sum(sizes.values()) <= BROADCAST_WINDOWS else (lambda df: df)
    split = docs.select(*keys, words(F.col("text")).alias("words"))
    found = None
    for size in sorted(sizes):
        own = table.where(F.col("size") == size)
        seed, stride = (SEED, SEED) if size >= 2 * SEED - 1 else (size, 1)
        seeds = own.selectExpr(f"explode(transform(sequence(1, {size - seed + 1}), i -> xxhash64(slice(window, i, {seed})))) AS seed")
        near = (
            split.selectExpr(
                *keys, "words",
                f"explode_outer(IF(size(words) >= {size}, sequence(1, size(words) - {seed - 1}, {stride}), NULL)) AS place")
            .where("place IS NOT NULL")
            .withColumn("seed", F.expr(f"xxhash64(slice(words, place, {seed}))"))
            .join(hint(seeds.distinct()), "seed", "left_semi")
        )
        full = (
            near.selectExpr(
                *keys, "words",
                f"explode_outer(sequence(greatest(1, place - {size - seed}), least(place, size(words) - {size - 1}))) AS at")
            .selectExpr(*keys, "at", f"slice(words, at, {size}) AS found")
            .withColumn("key", F.xxhash64("found"))
            .join(hint(own.select("key", "window", "size", "item_id")), "key")
            .where("found = window")
            .select(*keys, "at", "size", "item_id")
        )
        found = full if found is None else found.unionByName(full)
    if found is None:
        return split.selectExpr(*keys, "1 AS at", "1 AS size", "CAST(NULL AS BIGINT) AS item_id").where("false")
    return found


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text that tells apart rows sharing an id, and the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def hits_by_document(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, hit_words, items) of the documents with a hit; both arrays sorted, words from 1."""
    keys = ["doc_id", "text_key"]
    return hits(docs, items, keys, window).groupBy(*keys).agg(
        F.collect_set(F.struct("at", "size")).alias("places"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    ).selectExpr(
        *keys, "array_sort(array_distinct(flatten(transform(places, p -> sequence(p.at, p.at + p.size - 1))))) AS hit_words",
        "array_sort(items) AS items",
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (``doc_id text``) against ``items`` (``item_id text``).

    ``n_words``, ``n_hit`` (words inside any window of an item), ``n_items``,
    ``items_sha256`` (of the sorted ids, comma-joined) and ``contaminated``.
    Null and empty texts have no words and no hits; items without words, or an
    empty benchmark, hit nothing; an item without an id hits but isn't listed.
    Repeated rows get the same answer each; rows that share an id are told
    apart by their text. Other columns are ignored.
    """
    rows = keyed(docs)
    found = hits_by_document(rows, items, window).select(
        F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("ids"),
    )
    counts = rows.select("doc_id", "text_key", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return counts.join(
        found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left"
    ).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with an item."""
    found = hits(keyed(docs), items, ["doc_id", "text_key"], window).select(
        F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key")).distinct()
    return docs.join(
        found, docs["doc_id"].eqNullSafe(found["hit_doc"]) & (F.xxhash64(docs["text"]) == found["hit_key"]), "left_anti"
    )


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (``doc_id text``) where hit words are cut out of the text, each with what follows up to the next word."""
    rows = keyed(docs)
    found = hits_by_document(rows, items, window).selectExpr("doc_id AS hit_doc", "text_key AS hit_key", "hit_words")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left")
    one = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    cut = F.concat(
        F.regexp_extract("text", r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0),
        F.array_join(F.filter(
            F.regexp_extract_all("text", F.lit(one), F.lit(0)), lambda w, i: ~F.array_contains("hit_words", i + 1)), ""),
    )
    return joined.select("doc_id", F.when(F.col("hit_words").isNull(), F.col("text")).otherwise(cut).alias("text"))


def op10_decontaminate(spark, folder: str) -> DataFrame:
    """Every document against the whole benchmark."""
    return contamination(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
m AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
