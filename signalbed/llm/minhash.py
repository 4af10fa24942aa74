"""Near-duplicate documents by DartMinHash signatures and bands (operator 7).

A document is a weighted set of word shingles. Every element owns a strip of
the plane as wide as its weight; darts are thrown at the plane by hashing, one
per unit of area on average, so that all documents see the same darts. A
document catches those inside its strips up to a height that yields about
``k (ln k + 2)`` darts. Each dart belongs to one of ``k`` coordinates, and the
lowest dart of a coordinate is its signature: equal in two documents with the
probability of their weighted Jaccard similarity.

Coordinates are joined in bands. Documents that share a band are compared with
one of them, all similarities are verified exactly, and only where a band still
holds several components are the pairs between them compared as well. So no
pair of a band goes unanswered, and a large group of copies costs one
comparison per member.

What a document has for itself, the shingles no other candidate holds, serves
twice. The member with the fewest of them stands in the middle of its band and
is the one the others are compared with. And they bound every similarity: of
two sets of n and m shingles with u and v own ones, at most
``min(n - u, m - v)`` are shared. The comparison with the middle member p gives
a second bound: both sets lack some shingles of p, hashed to 256 bits, and what
they share inside p is at most the size of p less the bits of both together.
With at most ``s`` shared, the similarity is at most ``s / (n + m - s)``; pairs
that can't reach the threshold are never made. The bounds are exact: nothing
that could link is left out.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.llm.components import components
from signalbed.llm.rows import GOLDEN, mix, per_document, plain_words
from signalbed.llm.substrings import hashes_of, rolled
from signalbed.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Units of area handled at once.
AREA = 300_000
_FACTOR = np.uint64(0x9FB21C651E98DF25)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(24)])


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = hashes_of(words)
    return np.unique(mix(rolled(hashes, min(size, len(hashes)), _FACTOR) + np.uint64(min(size, len(hashes)))))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray | None]], k: int) -> np.ndarray:
    """One row of ``k`` values per set of (element hashes, weights above 0 or None for 1 each); an empty set has zeros."""
    count = len(sets)
    best = np.full(count * k, np.inf)
    value = np.zeros(count * k, np.uint64)
    totals = np.array([len(e) if w is None else w.sum() for e, w in sets], dtype=float)
    darts = k * (math.log(k) + 2)
    height = np.array([darts / t if t > 0 else 0.0 for t in totals])
    open_sets = [i for i in range(count) if totals[i] > 0]
    while open_sets:
        group: list[tuple[int, np.ndarray, np.ndarray]] = []
        area = 0.0
        for i in open_sets:
            elements, weights = sets[i]
            weights = np.ones(len(elements)) if weights is None else weights
            step = max(1, int(AREA / max(1.0, math.ceil(height[i]))))
            for at in range(0, len(elements), step):
                group.append((i, elements[at:at + step], weights[at:at + step]))
                area += float(np.ceil(group[-1][2]).sum()) * math.ceil(height[i])
                if area >= AREA:
                    _throw(group, height, k, best, value)
                    group, area = [], 0.0
        if group:
            _throw(group, height, k, best, value)
        # A coordinate without a dart: look further up, which finds the same lower darts again.
        open_sets = [i for i in open_sets if np.isinf(best[i * k:(i + 1) * k]).any()]
        height[open_sets] *= 2
    return value.reshape(count, k)


def _throw(group, height, k: int, best: np.ndarray, value: np.ndarray) -> None:
    owner = np.repeat([i for i, _, _ in group], [len(e) for _, e, _ in group])
    elements = np.concatenate([e for _, e, _ in group])
    weights = np.concatenate([w for _, _, w in group])
    with np.errstate(over="ignore"):
        # Unit columns of each strip, then unit rows up to the height of the set.
        columns = np.ceil(weights).astype(int)
        at = np.repeat(np.arange(len(elements)), columns)
        column = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
        cell = mix(elements[at] + column.astype(np.uint64) * GOLDEN)
        part = np.minimum(weights[at] - column, 1.0)
        rows = np.ceil(height[owner[at]]).astype(int)
        of = np.repeat(np.arange(len(at)), rows)
        row = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
        region = mix(cell[of] ^ (row.astype(np.uint64) * _FACTOR))
        hits = np.searchsorted(_POISSON, _uniform(region))
        dart_of = np.repeat(np.arange(len(of)), hits)
        number = np.arange(len(dart_of)) - np.repeat(np.cumsum(hits) - hits, hits)
        dart = mix(region[dart_of] + (number.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        rank = row[dart_of] + _uniform(mix(dart + np.uint64(1)))
        source = of[dart_of]
        caught = rank <= height[owner[at[source]]]
        narrow = part[source] < 1
        if narrow.any():
            caught &= ~narrow | (_uniform(mix(dart + np.uint64(2))) < part[source])
        dart, rank, source = dart[caught], rank[caught], source[caught]
        coordinate = (mix(dart + np.uint64(3)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
    key = owner[at[source]] * k + coordinate.astype(np.int64)
    np.minimum.at(best, key, rank)
    lowest = rank == best[key]
    value[key[lowest]] = dart[lowest]


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per set and band; keys of different bands never meet but by chance."""
    parts = signature.reshape(len(signature), bands, rows)
    out = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(signature), 0)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out * _FACTOR + parts[:, :, r])
    return out


def signed(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """(doc_id, c1, c2, n, bands): hashes of the words, the number of shingles, the band keys."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            digest, sets = b"", []
            for text in batch["text"].to_pylist():
                words = plain_words(text)
                digest += xxhash.xxh3_128_digest(b" ".join(words))
                sets.append(shingles(words, shingle))
            digests = np.frombuffer(digest, "<i8").reshape(-1, 2)
            keys = bands_of(signatures([(s, None) for s in sets], bands * rows), bands, rows).view(np.int64)
            return {"doc_id": batch["doc_id"], "c1": digests[:, 0], "c2": digests[:, 1], "n": [len(s) for s in sets],
                    "bands": [k if len(s) else None for k, s in zip(keys, sets)]}

        return work

    schema = "doc_id bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>"
    return per_document(docs, [F.col("doc_id").cast("bigint"), "text"], start, schema)


def compressed(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, n, words): the number of shingles and the words, compressed."""

    def start():
        packer = zstandard.ZstdCompressor(level=3)

        def work(batch: pa.RecordBatch) -> dict:
            words, counts = [], []
            for text in batch["text"].to_pylist():
                found = plain_words(text)
                words.append(packer.compress(b" ".join(found)))
                counts.append(len(shingles(found, shingle)))
            return {"node": batch["doc_id"], "n": counts, "words": words}

        return work

    columns = [F.col("doc_id").cast("bigint"), "text"]
    return per_document(docs.where("doc_id IS NOT NULL"), columns, start, "node bigint, n bigint, words binary")


def own_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, u) of ``texts`` (``node words``): the number of shingles, and of those that no other node has."""

    def start():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles(unpack.decompress(w).split(), shingle) for w in batch["words"].to_pylist()]
            nodes = batch["node"].to_numpy()
            return {"h": np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), "node": np.repeat(nodes, [len(s) for s in sets])}

        return work

    rows = per_document(texts, ["node", "words"], start, "h bigint, node bigint")
    once = rows.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    own = once.groupBy("node").agg(F.count("*").alias("u"))
    return texts.select("node", "n").join(own, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))


_SIMILAR = "a bigint, b bigint, similarity double, shared bigint, lost array<bigint>"


def similarities(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, similarity, shared, lost) of ``pairs`` (``a b``), exact, from ``texts`` (``node words``).

    ``lost`` is a bit mask: the shingles of b that a has not, hashed to 256 bits.
    """
    both = pairs.join(texts.selectExpr("node AS a", "words AS left_words"), "a").join(
        texts.selectExpr("node AS b", "words AS right_words"), "b")

    def start():
        unpack = zstandard.ZstdDecompressor()

        @functools.lru_cache(maxsize=64)
        def set_of(data: bytes) -> np.ndarray:
            return shingles(unpack.decompress(data).split(), shingle)

        def work(batch: pa.RecordBatch) -> dict:
            found, common, masks = [], [], []
            for left, right in zip(batch["left_words"].to_pylist(), batch["right_words"].to_pylist()):
                x, y = set_of(left), set_of(right)
                has = np.isin(y, x, assume_unique=True)
                shared = int(has.sum())
                bits = np.zeros(256, np.uint8)
                bits[(y[~has] % np.uint64(256)).astype(int)] = 1
                found.append(shared / max(len(x) + len(y) - shared, 1))
                common.append(shared)
                masks.append(np.packbits(bits).view(np.int64))
            return {"a": batch["a"], "b": batch["b"], "similarity": found, "shared": common, "lost": masks}

        return work

    return per_document(both, ["a", "b", "left_words", "right_words"], start, _SIMILAR)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id text``): ``doc_id``, ``class_id``, ``component_id``, ``kept``.

    ``class_id`` is the smallest id with the same words (A-Z lowered), and
    ``component_id`` the smallest id reachable over links, that is pairs whose
    sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``threshold``; ``kept`` where it is the row's own id. Two documents at 0.8
    miss each other in all bands with probability below 0.0001. A text of fewer
    words is one shingle. Null texts and texts without words link with nothing,
    not even each other. Rows that share an id count as one document. A row
    without an id takes no part: null class and component, kept. Other columns
    are ignored.
    """
    marked = cut_lineage(signed(docs, bands, rows, shingle))
    real = marked.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(real.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id")))
    nodes = real.join(classes.withColumnRenamed("class_id", "doc_id"), ["c1", "c2", "doc_id"]).select(
        F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = cut_lineage(
        nodes.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band")
    )
    members = cut_lineage(nodes.join(shared, "band", "left_semi").distinct())
    ids = members.select("node").distinct()
    texts = cut_lineage(compressed(docs, shingle).join(ids, "node", "left_semi").dropDuplicates(["node"]))
    facts = cut_lineage(own_shingles(texts, shingle))
    placed = members.join(facts, "node")
    middle = F.col("u") * (1 << 31) + F.pmod(F.xxhash64("node"), F.lit(1 << 31))
    pivots = cut_lineage(placed.groupBy("band").agg(F.min_by("node", middle).alias("pivot")))
    placed = cut_lineage(placed.join(pivots, "band"))
    stars = cut_lineage(placed.where("node <> pivot").selectExpr("node AS a", "pivot AS b").distinct())
    tested = cut_lineage(similarities(stars, texts, shingle))
    enough = F.col("similarity") >= threshold - 1e-12
    links = tested.where(enough).select("a", "b")
    found = components(links)
    # Bands that hold more than one component: the pairs between components that can reach the threshold.
    apart = cut_lineage(placed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = cut_lineage(
        apart.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    )
    rest = (
        apart.join(mixed, "band", "left_semi").where(F.col("n") - F.col("u") >= threshold * F.col("n") - 1e-9)
        .join(tested.selectExpr("a AS node", "b AS pivot", "shared", "lost"), ["node", "pivot"])
        .join(facts.selectExpr("node AS pivot", "n AS np"), "pivot")
    )
    # s: shingles that are not its own; e: those of them outside the pivot; np: the pivot's.
    left = rest.selectExpr("band", "node AS x", "component AS cx", "n AS nx", "n - u AS sx", "n - u - shared AS ex", "lost AS lx", "np")
    right = rest.selectExpr("band", "node AS y", "component AS cy", "n AS ny", "n - u AS sy", "n - u - shared AS ey", "lost AS ly")
    lacking = sum((F.bit_count(F.col("lx")[i].bitwiseOR(F.col("ly")[i])) for i in range(4)), F.lit(0))
    most = F.least(F.col("sx"), F.col("sy"), F.col("np") - lacking + F.least("ex", "ey"))
    crossing = left.join(
        right, (left["band"] == right["band"]) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy"))
        & (most >= threshold * (F.col("nx") + F.col("ny") - most) - 1e-9)
    ).selectExpr("x AS a", "y AS b").distinct()
    more = cut_lineage(similarities(crossing, texts, shingle).where(enough).select("a", "b"))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    answer = cut_lineage(
        classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("c1", "c2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return marked.drop("bands").join(answer, ["c1", "c2"], "left").select(
        "doc_id", F.when(takes_part, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(takes_part, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(takes_part, F.col("component_id") == F.col("doc_id")).otherwise(True).alias("kept"),
    )


def op7_minhash(spark, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


#: All pairs that share a shingle, for small tables with one row per id.
OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8 - 1e-12),
reach(a, b) AS (SELECT DISTINCT a, a FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) ELSE doc_id END AS class_id,
  coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN c ON c.a = doc_id
"""
