"""Near-duplicate vectors by sorted projection passes (operator 2).

In every pass the vectors of a label are put in the order of a key of
concatenated random hashes (signs of random projections), and each is compared
with a bounded window of neighbours in that order. Sketches of more such bits
travel with the keys and rule out nearly all pairs; what is left is verified by
the cosine of the vectors themselves in double precision. Pairs of all passes
are joined into components.

A window ends early where many vectors have nearly the same key. So the vectors
whose keys begin alike are afterwards compared in full, block by block, except
inside a component already found; only what joins components is written down.

The links of each vector are counted over its whole component, block by block,
so that a large group of near copies is counted exactly and no pair is written
down.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signalbed.llm.components import components
from signalbed.llm.rows import per_document
from signalbed.session import cut_lineage

THRESHOLD = 0.98
PASSES = 16
NEIGHBOURS = 24
#: Bits of the sketch that two vectors at the threshold may differ in: 256 * angle / pi is 16 at 0.98, with a spread of 4.
SKETCH_WORDS, MOST_BITS = 4, 44
BLOCK = 128
#: Keys begin alike in so many bits that about CROWD evenly spread vectors of a label share them, but in MOST_PREFIX at most.
CROWD, MOST_PREFIX, CROWD_BLOCK = 128, 12, 512


@functools.lru_cache(maxsize=8)
def _planes(width: int, passes: int) -> np.ndarray:
    """Random hyperplanes by width: 64 for each pass, then those of the sketch."""
    return np.random.default_rng(1_000_003 + width).standard_normal((width, 64 * (passes + SKETCH_WORDS)))


def signed_bits(vectors: np.ndarray, passes: int) -> np.ndarray:
    """64-bit words of signs per vector: a key for each pass, then the sketch; the first projection is the highest bit."""
    bits = vectors @ _planes(vectors.shape[1], passes) > 0
    packed = np.packbits(bits, axis=1).reshape(len(vectors), -1, 8)
    return packed.view(">u8").reshape(len(vectors), -1).astype(np.uint64)


def usable(vector: list | None) -> bool:
    if not vector or any(x is None for x in vector):
        return False
    v = np.asarray(vector, float)
    return bool(np.isfinite(v).all() and v.any())


def marked(vectors: DataFrame, passes: int) -> DataFrame:
    """(vec_id, label, width, c1, c2, keys, sketch) of every row; keys are null where a row can't link."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            rows = batch["embedding"].to_pylist()
            labels, ids = batch["label"].to_pylist(), batch["vec_id"].to_pylist()
            n = len(rows)
            good = [i for i in range(n) if labels[i] is not None and ids[i] is not None and usable(rows[i])]
            keys: list = [None] * n
            sketch: list = [None] * n
            digest = np.zeros((n, 2), np.int64)
            by_width: dict[int, list[int]] = {}
            for i in good:
                by_width.setdefault(len(rows[i]), []).append(i)
            for width, places in by_width.items():
                x = np.array([rows[i] for i in places], float) + 0.0  # -0.0 becomes 0.0
                words = signed_bits(x / np.abs(x).max(1, keepdims=True), passes)
                ordered = (words[:, :passes] ^ np.uint64(1 << 63)).view(np.int64)
                for j, i in enumerate(places):
                    keys[i], sketch[i] = ordered[j], words[j, passes:].view(np.int64)
                    digest[i] = np.frombuffer(xxhash.xxh3_128_digest(x[j].tobytes()), "<i8")
            return {"vec_id": batch["vec_id"], "label": batch["label"], "width": [len(r or ()) for r in rows],
                    "c1": digest[:, 0], "c2": digest[:, 1], "keys": keys, "sketch": sketch}

        return work

    columns = [F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")]
    schema = "vec_id bigint, label string, width int, c1 bigint, c2 bigint, keys array<bigint>, sketch array<bigint>"
    return per_document(vectors, columns, start, schema)


_ORDER = ("pass", "label", "width", "key", "node")
_PAIRS = "a bigint, b bigint, edge int, side int, place int, grp bigint, node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def _near(group: np.ndarray, node: np.ndarray, sketch: np.ndarray, neighbours: int, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``neighbours`` apart, of one group, alike by sketch; the later one at ``fresh`` or beyond."""
    left, right = [], []
    for lag in range(1, min(neighbours, len(node) - 1) + 1):
        later = np.arange(max(fresh, lag), len(node))
        earlier = later - lag
        same = group[later] == group[earlier]
        later, earlier = later[same], earlier[same]
        bits = np.bitwise_count(sketch[later] ^ sketch[earlier]).sum(1)
        close = (bits <= MOST_BITS) & (node[later] != node[earlier])
        left.append(node[earlier[close]])
        right.append(node[later[close]])
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def window_pairs(keys: DataFrame, neighbours: int, partitions: int) -> DataFrame:
    """Candidate pairs (a, b) of ``keys`` (``pass label width key node sketch``) over all passes.

    The rows are dealt out by range, each task walks its part in order. The
    first and last rows of every part are kept and compared once more with
    those of the neighbouring part, so that no window ends at a border. (A
    part of fewer rows than a window only meets its direct neighbours.)
    """
    ordered = keys.repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
    arrow = to_arrow_schema(StructType.fromDDL(_PAIRS))

    def table(a, b, edges) -> pa.RecordBatch:
        n, m = len(a), len(edges[0]) if edges else 0
        columns = {"a": [*a, *[None] * m], "b": [*b, *[None] * m]}
        for i, name in enumerate(("edge", "side", "place", "grp", "node", "s0", "s1", "s2", "s3")):
            columns[name] = [*[None] * n, *(edges[i] if edges else [])]
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        group, node, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH_WORDS), np.uint64)
        head = None

        def edge(number: int, side: int, rows: slice) -> list:
            n = len(node[rows])
            return [[number] * n, [side] * n, list(range(n)), group[rows].tolist(), node[rows].tolist(),
                    *(sketch[rows, i].view(np.int64).tolist() for i in range(SKETCH_WORDS))]

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = len(node)
            names = zip(batch["pass"].to_pylist(), batch["label"].to_pylist(), batch["width"].to_pylist())
            group = np.concatenate([group, [xxhash.xxh3_64_intdigest(f"{p} {w} {v}") >> 1 for p, v, w in names]]).astype(np.int64)
            node = np.concatenate([node, batch["node"].to_numpy()])
            sketch = np.concatenate([sketch, np.array(batch["sketch"].to_pylist(), np.int64).view(np.uint64)])
            seen += batch.num_rows
            if head is None and (seen >= neighbours):
                head = edge(part, 1, slice(0, neighbours))
            yield table(*_near(group, node, sketch, neighbours, fresh), None)
            if head is not None:
                keep = slice(max(0, len(node) - neighbours), None)
                group, node, sketch = group[keep], node[keep], sketch[keep]
        if seen:
            head = head or edge(part, 1, slice(0, neighbours))
            tail = edge(part + 1, 0, slice(max(0, len(node) - neighbours), None))
            yield table([], [], [x + y for x, y in zip(head, tail)])

    found = cut_lineage(ordered.mapInArrow(run, _PAIRS))

    def border(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "place"])
        sketch = rows[["s0", "s1", "s2", "s3"]].to_numpy(np.int64).view(np.uint64)
        a, b = _near(rows["grp"].to_numpy(), rows["node"].to_numpy(), sketch, neighbours, int((rows["side"] == 0).sum()))
        return pd.DataFrame({"a": a, "b": b})

    inner = found.where("a IS NOT NULL").select("a", "b")
    borders = found.where("edge IS NOT NULL").groupBy("edge").applyInPandas(border, "a bigint, b bigint")
    return inner.unionByName(borders).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of ``pairs`` in double precision, from ``vectors`` (``node embedding``)."""
    both = pairs.join(vectors.selectExpr("node AS a", "embedding AS x"), "a").join(vectors.selectExpr("node AS b", "embedding AS y"), "b")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                u, v = unit(np.array([x], float)), unit(np.array([y], float))
                found.append(float((u * v).sum()) if u.shape == v.shape else -2.0)
            return {"a": batch["a"], "b": batch["b"], "cosine": found}

        return work

    return per_document(both, ["a", "b", "x", "y"], start, "a bigint, b bigint, cosine double")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so nothing overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) of ``members`` (``component node n embedding``): the rows linked directly, over each whole component.

    A component is cut into blocks of about ``BLOCK`` vectors by a hash of the
    id; every pair of blocks is one small group, and a group gives a number per
    vector.
    """
    sizes = cut_lineage(members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.select(
        "component", "node", "n", "embedding", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "component", "node", "n", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        sides = [rows[rows["block"] == k] for k in ((i, j) if i != j else (i,))]
        units = [unit(np.array(s["embedding"].tolist(), float)) if len(s) else np.zeros((0, 1)) for s in sides]
        if any(not len(s) for s in sides):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        close = units[0] @ units[-1].T >= threshold
        if i == j:
            np.fill_diagonal(close, False)
            return pd.DataFrame({"node": sides[0]["node"], "links": close @ sides[0]["n"].to_numpy()})
        return pd.DataFrame({
            "node": np.concatenate([sides[0]["node"], sides[1]["node"]]),
            "links": np.concatenate([close @ sides[1]["n"].to_numpy(), sides[0]["n"].to_numpy() @ close]),
        })

    parts = dealt.groupBy("component", "i", "j").applyInPandas(count, "node bigint, links bigint")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def joined(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of components that join what ``close`` links (rows in ``left``, columns in ``right``), fewer than there are components."""
    rows, columns = np.nonzero(close)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, places = np.unique(np.concatenate([left[rows], right[columns]]), return_inverse=True)
    a, b = places[:len(rows)], places[len(rows):]
    top = np.arange(len(names))
    while True:
        least = np.minimum(top[a], top[b])
        before = top.copy()
        np.minimum.at(top, a, least)
        np.minimum.at(top, b, least)
        top = top[top]
        if (top == before).all():
            lower = top < np.arange(len(names))
            return names[top[lower]], names[lower]


def crowded_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of components to join, from ``rows`` (``node component label width keys embedding``), one per vector.

    All vectors of a label and width whose keys of one pass begin with the same
    bits are compared, unless they are of one component. A component with more
    than ``CROWD_BLOCK`` vectors there has blocks of its own, which never meet
    each other. A label with no more than ``CROWD`` vectors is compared whole.
    """
    bits = F.greatest(F.lit(0), F.least(F.lit(MOST_PREFIX), F.ceil(F.log2(F.col("size") / CROWD)))).cast("int")
    sizes = cut_lineage(rows.groupBy("label", "width").agg(F.count("*").alias("size")).select("label", "width", bits.alias("bits")))
    place = ["label", "width", "pass", "start"]
    dealt = rows.join(sizes, ["label", "width"]).select(
        "label", "width", "node", "component", "embedding", "bits", F.posexplode("keys").alias("pass", "key")
    ).where("bits > 0 OR pass = 0").withColumn("start", F.expr("IF(bits = 0, 0L, shiftright(key, 64 - bits))"))
    counts = cut_lineage(dealt.groupBy(*place, "component").agg(F.count("*").alias("m")))
    large = counts.where(F.col("m") > CROWD_BLOCK).select(*place, "component", F.lit(True).alias("own"))
    own = F.col("m") > CROWD_BLOCK
    parts = counts.groupBy(*place, own.alias("own"), F.when(own, F.col("component")).otherwise(0).alias("part")).agg(
        F.ceil(F.sum("m") / CROWD_BLOCK).cast("int").alias("blocks"), F.count("*").alias("kinds"))
    whole = Window.partitionBy(*place)
    parts = cut_lineage(
        parts.withColumn("first", (F.sum("blocks").over(whole.orderBy("own", "part")) - F.col("blocks")).cast("int"))
        .withColumn("all", F.sum("blocks").over(whole).cast("int")).withColumn("kinds", F.sum("kinds").over(whole)).where("kinds > 1")
    )
    placed = dealt.join(large, [*place, "component"], "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn(
        "part", F.when(F.col("own"), F.col("component")).otherwise(0)
    ).join(parts, [*place, "own", "part"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.expr("filter(sequence(0, all - 1), x -> NOT own OR x < first OR x >= first + blocks)")
    met = placed.withColumn("other", F.explode(others)).select(
        *place, "component", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        sides = [rows[rows["block"] == k] for k in (i, j)]
        a = b = np.zeros(0, np.int64)
        if all(len(s) for s in sides):
            left, right = (s["component"].to_numpy(np.int64) for s in sides)
            u, v = (unit(np.array(s["embedding"].tolist(), float)) for s in sides)
            a, b = joined((u @ v.T >= threshold) & (left[:, None] != right[None, :]), left, right)
        return pd.DataFrame({"a": a, "b": b})

    return met.groupBy(*place, "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id embedding label``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link if their labels are equal and not null, their lengths are
    equal, and their cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, itself included. Rows that
    share an id count as one node of the graph. A row without an id links with
    nothing, has a null component and is kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(marked(vectors, passes))
    real = rows.where("keys IS NOT NULL")
    same = ["label", "width", "c1", "c2"]
    classes = cut_lineage(real.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    nodes = cut_lineage(
        real.withColumnRenamed("vec_id", "node").join(classes, [*same, "node"]).dropDuplicates([*same, "node"])
        .select("node", "n", "label", "width", "keys", "sketch")
    )
    texts = cut_lineage(
        vectors.selectExpr("CAST(vec_id AS BIGINT) AS node", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
        .join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])
    )
    keys = nodes.select("label", "width", "node", "sketch", F.posexplode("keys").alias("pass", "key"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = window_pairs(keys, neighbours, partitions)
    links = cut_lineage(cosines(pairs, texts).where(F.col("cosine") >= threshold))
    found = components(links)
    start = cut_lineage(
        nodes.join(found, "node", "left").join(texts, "node")
        .select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"), "label", "width", "keys", "embedding")
    )
    joins = components(cut_lineage(crowded_links(start, threshold)))
    found = cut_lineage(
        start.select("node", "component", "linked").join(joins.selectExpr("node AS component", "component AS next"), "component", "left")
        .where("linked OR next IS NOT NULL").select("node", F.coalesce("next", "component").alias("component"))
    )
    members = found.join(nodes.select("node", "n"), "node").join(texts, "node")
    direct = links_inside(members, threshold)
    answer = cut_lineage(
        classes.join(found, "node", "left").join(direct, "node", "left")
        .select(*same, F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    linked = F.col("keys").isNotNull()
    return rows.join(answer, same, "left").select(
        "vec_id", F.when(linked, F.col("links")).otherwise(0).cast("bigint").alias("n_links"),
        F.when(linked, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(linked, F.col("component") == F.col("vec_id")).otherwise(True).alias("kept"),
    )


def op2_embedding_dedup(spark, folder: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))




#: All pairs, for small tables with one row per id.
OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT DISTINCT a, a FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
