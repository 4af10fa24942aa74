"""Passages that stood earlier in the corpus, by level-wise doubling (operator 4).

Level one looks at windows of half the wanted length. Not at all of them: of
the half windows inside any wanted window one with the smallest hash is
selected, so equal windows select equal halves. Only where a half window is
repeated is it extended to twice its length; the windows of full length are
then judged the same way, and so on while longer windows are asked for.

No position is ever joined with the positions of its copies. Tasks reduce
hashes to the smallest and largest document before the shuffle; what comes back
to a document is what is *its own*: half windows nobody else has, and full
windows it is the first to hold. A passage that a third of all documents share
is one row here. Texts that repeat an earlier document word for word are found
by one hash per document and take no part in the levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.llm.rows import mix, per_document, to_bytes

WINDOW = 20
LAST_ID = (1 << 63) - 1
_NONE = np.zeros(0, np.uint64)
_FACTORS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; none in a null."""
    return to_bytes(text).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(values: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """A hash of every window of ``length`` values, not yet mixed, so that two neighbours can be joined to twice the length."""
    out = np.zeros(max(len(values) - length + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length if len(out) else 0):
            out = out * factor + values[k:k + len(out)]
    return out


def doubled(half: np.ndarray, length: int, factor: np.uint64, starts: np.ndarray) -> np.ndarray:
    """Hashes of the windows of twice ``length`` at ``starts`` from those of ``length``."""
    with np.errstate(over="ignore"):
        return half[starts] * np.power(factor, length, dtype=np.uint64) + half[starts + length]


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """The smallest or largest of every ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = choose(values[:-span], values[span:])
        span *= 2
    return choose(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def selected(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are smallest among some ``width`` in a row; all ties are selected."""
    if len(values) < width:
        return np.zeros(len(values), bool)
    lowest = _sliding(values, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return _sliding(np.concatenate([edge, lowest, edge]), width, np.maximum) == values


class Levels:
    """The levels of one document: its number of words, and the hashes of its half windows (see :func:`levels_of`)."""

    def __init__(self, n: int, window: int, halves: list[np.ndarray], values: np.ndarray) -> None:
        self.n, self.window, self.half, self.halves, self.values = n, window, window // 2, halves, values
        self.places = np.flatnonzero(selected(values, window - self.half + 1))

    def seeds(self) -> np.ndarray:
        return np.unique(self.values[self.places])

    def extended(self, own_seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hash, second hash) of the full windows around half windows that are repeated anywhere."""
        values = self.values[self.places]
        repeated = ~np.isin(values, own_seeds)
        if len(values) > 1:
            _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
            repeated |= counts[which] > 1
        if not repeated.any():
            return np.zeros(0, np.int64), _NONE, _NONE
        places = self.places[repeated]
        edges = np.zeros(self.n + 2, np.int64)
        np.add.at(edges, np.maximum(places - (self.window - self.half), 0), 1)
        np.add.at(edges, np.minimum(places, self.n - self.window) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges)[:max(self.n - self.window + 1, 0)] > 0)
        first, second = (mix(doubled(h, self.half, f, starts)) for h, f in zip(self.halves, _FACTORS))
        return starts, first, second


def levels_of(documents: list[list[bytes]], window: int) -> list[Levels]:
    """The levels of several documents; their words are hashed in one go."""
    half = window // 2
    sizes = [len(words) for words in documents]
    hashes = hashes_of([w for words in documents for w in words])
    halves = [rolled(hashes, half, f) for f in _FACTORS]
    values = mix(halves[0])
    out, at = [], 0
    for n in sizes:
        own = slice(at, at + max(n - half + 1, 0))
        out.append(Levels(n, window, [h[own] for h in halves], values[own]))
        at += n
    return out


def _joint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first ^ (second * _FACTORS[1]))


def _ids(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _hash_lists(array: pa.ListArray) -> list[np.ndarray | None]:
    """The lists of a column as views of its values; None for a null."""
    values, cuts = array.values.to_numpy(zero_copy_only=False).view(np.uint64), array.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], array.is_valid().to_pylist())]


def packed(docs: DataFrame) -> DataFrame:
    """(id, doc_id, c1, c2, n, words): two hashes of a document's words, their number, and the words compressed."""

    def start():
        packer = zstandard.ZstdCompressor(level=6)

        def work(batch: pa.RecordBatch) -> dict:
            digest, counts, packed_words = b"", [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                joined = b" ".join(words)
                digest += xxhash.xxh3_128_digest(joined)
                counts.append(len(words))
                packed_words.append(packer.compress(joined))
            digests = np.frombuffer(digest, "<i8").reshape(-1, 2)
            return {"id": batch["id"], "doc_id": batch["doc_id"], "c1": digests[:, 0], "c2": digests[:, 1],
                    "n": counts, "words": packed_words}

        return work

    return per_document(docs, _columns(), start, "id bigint, doc_id bigint, c1 bigint, c2 bigint, n bigint, words binary")


def _columns() -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col("doc_id").cast("bigint"), "text"]


def originals(docs: DataFrame, window: int) -> DataFrame:
    """(id, originals): the documents that are the first with their words, as hashes."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            joined = [words_of(t) for t in batch["text"].to_pylist()]
            long = [i for i, w in enumerate(joined) if len(w) >= window]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(joined[i])) for i in long), "<i8").reshape(-1, 2)
            return {"id": _ids(batch["id"])[long], "c1": digests[:, 0], "c2": digests[:, 1]}

        return work

    rows = per_document(docs, _columns(), start, "id bigint, c1 bigint, c2 bigint")
    firsts = rows.groupBy("c1", "c2").agg(F.min("id").alias("id"))
    return firsts.groupBy("id").agg(F.collect_list("c1").alias("originals"))


def own_halves(docs: DataFrame, window: int) -> DataFrame:
    """(id, own): the selected half windows that stand in no other document."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            seeds = [d.seeds() for d in levels_of([words_of(t) for t in batch["text"].to_pylist()], window)]
            found = np.concatenate([*seeds, _NONE])
            return {"h": found.view(np.int64), "id": np.repeat(_ids(batch["id"]), [len(s) for s in seeds])}

        return work

    rows = per_document(docs, _columns(), start, "h bigint, id bigint")
    once = rows.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return once.groupBy("id").agg(F.collect_list("h").alias("own"))


def own_windows(marked: DataFrame, window: int) -> DataFrame:
    """(id, firsts): the full windows, among those that may be repeated, that no smaller id holds.

    Documents are compared by 96 bits; the list for one document needs 64.
    """

    def start():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict:
            first, second, ids, sizes = [], [], [], []
            columns = [batch["id"].to_pylist(), _ids(batch["c1"]).view(np.uint64), batch["words"].to_pylist(),
                       _hash_lists(batch["originals"]), _hash_lists(batch["own"])]
            chosen = [row for row in zip(*columns) if row[3] is not None and row[1] in row[3]]
            levels = levels_of([unpack.decompress(row[2]).split() for row in chosen], window)
            for (i, _, _, _, own), document in zip(chosen, levels):
                _, a, b = document.extended(_NONE if own is None else own)
                joint, keep = np.unique(_joint(a, b), return_index=True)
                first.append(joint)
                second.append((b[keep] >> np.uint64(32)).astype(np.uint32))
                ids.append(i)
                sizes.append(len(keep))
            return {"h": np.concatenate([*first, _NONE]).view(np.int64), "h2": np.concatenate([*second, np.zeros(0, np.uint32)]).view(np.int32),
                    "id": np.repeat(np.array(ids, np.int64), np.array(sizes, np.int64))}

        return work

    rows = per_document(marked, ["id", "c1", "words", "originals", "own"], start, "h bigint, h2 int, id bigint")
    firsts = rows.groupBy("h", "h2").agg(F.min("id").alias("id"))
    return firsts.groupBy("id").agg(F.collect_list("h").alias("firsts"))


def removed_words(document: Levels, original: bool, own: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which words are covered by a window that also starts earlier."""
    if document.n < document.window:
        return np.zeros(document.n, bool)
    if not original:
        return np.ones(document.n, bool)
    starts, a, b = document.extended(own)
    joint = _joint(a, b)
    first_here = np.zeros(len(starts), bool)
    first_here[np.unique(joint, return_index=True)[1]] = True
    gone = starts[~(first_here & np.isin(joint, firsts))]
    edges = np.zeros(document.n + 1, np.int64)
    edges[gone] += 1
    np.add.at(edges, gone + document.window, -1)
    return np.cumsum(edges)[:-1] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (``doc_id text``): ``doc_id``, ``n_words``, ``kept`` (the words left, by one space), ``n_removed``.

    A word goes if a window of ``window`` words (an even number) that covers it
    also starts earlier: in a document of a smaller id, or earlier in the same
    one. Null and empty texts, and texts shorter than a window, lose nothing.
    Rows that share an id count as one document, so none of them comes before
    the other; a null id counts as the largest. Other columns are ignored.
    """
    return _judged(docs, window, digest=False)


def _judged(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    if window % 2 or window < 2:
        raise ValueError("the window is an even number of words")
    marked = packed(docs).join(originals(docs, window), "id", "left").join(own_halves(docs, window), "id", "left")
    joined = marked.join(own_windows(marked, window), "id", "left")

    def start():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict:
            counts, removed, kept = [], [], []
            columns = [_ids(batch["c1"]).view(np.uint64), batch["words"].to_pylist(),
                       *(_hash_lists(batch[c]) for c in ("originals", "own", "firsts"))]
            texts = [unpack.decompress(data) for data in columns[1]]
            split = [text.split() for text in texts]
            rows = zip(texts, split, levels_of(split, window), columns[0], *columns[2:])
            for text, words, document, c1, originals_, own, firsts in rows:
                gone = removed_words(document, originals_ is not None and c1 in originals_, _NONE if own is None else own,
                                     _NONE if firsts is None else firsts)
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else text
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
            return {"doc_id": batch["doc_id"], "n_words": counts, "n_removed": removed,
                    "kept_sha256" if digest else "kept": kept}

        return work

    columns = ["doc_id", "c1", "words", "originals", "own", "firsts"]
    return per_document(joined, columns, start, SCHEMA if digest else SCHEMA.replace("kept_sha256", "kept"))


def op4_substrings(spark, folder: str) -> DataFrame:
    """Every document without the passages of twenty words that stood earlier, as a digest."""
    return _judged(spark.read.parquet(f"{folder}/documents.parquet"), WINDOW, digest=True)


OP4_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, r, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, r, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS p FROM later),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
one AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM one ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
