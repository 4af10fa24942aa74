"""Phrases whose words stand together more often than by chance (operator 11).

Every n-gram has a Rabin-Karp fingerprint: a polynomial over the bytes gives the
words their hashes, a polynomial over the hashes gives the n-grams theirs; both
are differences of prefix sums that numpy takes for a whole chunk of documents
at once. Tasks add up fingerprints and send each with a mark: 32 bits of a check
from a second polynomial, and 32 bits that point to one occurrence. The shuffle
adds up the numbers and keeps the smallest and largest mark. What reaches the
wanted frequency is a bit in a filter of fixed size; longer n-grams are only
sent where all the shorter ones in them have their bit.

A bit can be set in error, but never be missing. In the last pass a frequent
fingerprint's phrase is cut out of the text once, at its pointer. Where the
checks of a fingerprint differ, different words have met: those phrases, and
none else, are counted by their text in all documents.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbed.llm.rows import mix, per_partition, to_bytes
from signalbed.session import cut_lineage

LEAST, MOST_WORDS, BEST = 100, 5, 2_000
#: A phrase goes where a longer one around it has at least this percent of its occurrences.
COVERED_PERCENT = 100
#: Bits of a filter (8 MB); three per group of lengths are broadcast, whatever the corpus.
FILTER_BITS = 26
#: Bytes of the documents taken at once (one longer document is taken alone), and fingerprints of a length added up before they are sent.
CHUNK_BYTES, FINGERPRINTS_AT_ONCE = 1 << 20, 1_000_000
#: Parts that a language's candidates are ranked in before the parts' best are ranked together.
RANK_PARTS = 256
NO_LANGUAGE = "und"

#: Bases of the fingerprint and of the check, and what each byte counts in them.
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BYTES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(odd)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_LOW = np.uint64(0xFFFFFFFF)
_SPACES, _CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([1 if b in _SPACES else 2 if b in _CUTS else 0 for b in range(256)], np.uint8)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_SPACE = bytes(32 if _KIND[b] else b for b in range(256))


class Powers:
    """Powers of both bases and of their inverses, as many as the longest chunk so far needed."""

    def __init__(self) -> None:
        self.of_base = [(np.ones(1, np.uint64),) * 2] * 2

    def of(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of_base[which][0]) < n:
            size, base = max(n, CHUNK_BYTES), _BASES[which]
            self.of_base[which] = tuple(
                np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up, down = self.of_base[which]
        return up[:n], down[:n]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Chunk:
    """The words of some documents, and fingerprints of all that follow each other inside a piece."""

    def __init__(self, texts: list[bytes], langs: list[str], marks: list[int], powers: Powers, seeds: dict[str, int]) -> None:
        self.text = b"\n".join(texts).translate(_LOWER)  # a line end is a cut, so no n-gram spans two documents
        raw = np.frombuffer(self.text, np.uint8)
        kind = _KIND[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(starts)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.langs = langs
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.document = np.searchsorted(first, starts, side="right") - 1
        self.seed = np.array([seeds.setdefault(name, xxhash.xxh3_64_intdigest(name)) for name in langs], np.uint64)
        self.mark = np.array(marks, np.int64).view(np.uint64)
        self.sums, self.downs = [], []
        for which in (0, 1):
            up, down = powers.of(which, max(len(raw), self.n) + 1)
            at = _prefix(_BYTES[which][raw] * up[:len(raw)])
            hashes = mix((at[ends] - at[starts]) * down[starts])
            self.sums.append(_prefix(hashes * up[:self.n]))
            self.downs.append(down)

    def fingerprints(self, k: int, which: int = 0) -> np.ndarray:
        """Of the k words from each word on, as if there were no pieces."""
        m = max(self.n - k + 1, 0)
        value = (self.sums[which][k:k + m] - self.sums[which][:m]) * self.downs[which][:m]
        return mix(value + self.seed[self.document[:m]] + np.uint64(k * _BASES[which] % (1 << 64)))

    def whole(self, k: int) -> np.ndarray:
        """Where the k words from a word on stand in one piece."""
        m = max(self.n - k + 1, 0)
        return self.piece[k - 1:k - 1 + m] == self.piece[:m]

    def pointers(self, places: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """32 bits for the document of each place, other ones for each fingerprint."""
        return mix(self.mark[self.document[places]] + fingerprints) & _LOW


@dataclasses.dataclass(frozen=True)
class Filter:
    """Keys that may be held; each has the bit of its first and of its second half."""

    bits: int
    #: None where no key is held.
    table: np.ndarray | None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.table is not None)
        if self.table is None:
            return out
        for place in (keys >> np.uint64(64 - self.bits), (keys >> np.uint64(32 - self.bits)) & np.uint64((1 << self.bits) - 1)):
            out &= (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


@dataclasses.dataclass(frozen=True)
class Known:
    """What the counting passes found: frequent fingerprints by length, the occurrences they point to, and those with several texts."""

    frequent: dict[int, Filter]
    pointed: dict[int, Filter]
    mixed: dict[int, Filter]


def frequent(chunk: Chunk, k: int, filters: dict[int, Filter], mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the n-grams of k words inside which no n-gram is known to be rare."""
    stays = chunk.whole(k)
    below = max((j for j in filters if j < k), default=0)
    if below:
        ok = filters[below].holds(chunk.fingerprints(below) & mask) & chunk.whole(below)
        for shift in range(k - below + 1):
            stays = stays & ok[shift:shift + len(stays)]
    values = chunk.fingerprints(k) & mask
    if k in filters:
        stays = stays & filters[k].holds(values)
    places = np.flatnonzero(stays)
    return places, values[places]


def chunks_of(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    powers, seeds = Powers(), {}
    texts, langs, marks, size = [], [], [], 0
    for batch in batches:
        for text, lang, mark in zip(batch["text"], batch["lang"], batch["mark"]):
            raw = to_bytes(text.as_py())
            if texts and size + len(raw) > chunk_bytes:
                yield Chunk(texts, langs, marks, powers, seeds)
                texts, langs, marks, size = [], [], [], 0
            texts.append(raw)
            langs.append(lang.as_py())
            marks.append(mark.as_py())
            size += len(raw) + 1
    if texts:
        yield Chunk(texts, langs, marks, powers, seeds)


def added(values: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, number, mark): a row per fingerprint, and one of number 0 for each other check that occurs with it."""
    order = np.argsort(values, kind="stable")
    values, marks = values[order], marks[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    n = np.diff(np.append(first, len(values)))
    other = np.flatnonzero((marks >> np.uint64(32)) != np.repeat(marks[first] >> np.uint64(32), n))
    return (np.concatenate([values[first], values[other]]), np.concatenate([n, np.zeros(len(other), np.int64)]),
            np.concatenate([marks[first], marks[other]]))


def count_fingerprints(k_range: tuple[int, ...], known, mask: np.uint64, chunk_bytes: int):
    """The work of a partition in a counting pass: (k, fingerprint, number, mark), added up in parts."""

    def sent(k: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
        values, n, marks = added(*(np.concatenate(p) for p in zip(*parts)))
        for at in range(0, len(values), 500_000):
            now = slice(at, at + 500_000)
            yield {"k": np.full(len(values[now]), k, np.int32), "fp": values[now].view(np.int64), "n": n[now], "mark": marks[now].view(np.int64)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = {k: [] for k in k_range}
        filters = known().frequent
        for chunk in chunks_of(batches, chunk_bytes):
            for k in k_range:
                places, values = frequent(chunk, k, filters, mask)
                if len(places):
                    checks = chunk.fingerprints(k, 1)[places] << np.uint64(32)
                    parts[k].append((values, checks | chunk.pointers(places, values)))
                if sum(len(v) for v, _ in parts[k]) >= FINGERPRINTS_AT_ONCE:
                    yield from sent(k, parts[k])
                    parts[k] = []
        for k in k_range:
            if parts[k]:
                yield from sent(k, parts[k])

    return work


def _distinct(chunk: Chunk, k: int, places: np.ndarray, ids: np.ndarray) -> dict[tuple[int, ...], list[int]]:
    """Places of equal words of equal language, by those words."""
    found: dict[tuple[int, ...], list[int]] = {}
    for at in places.tolist():
        found.setdefault((int(chunk.seed[chunk.document[at]]), *ids[at:at + k].tolist()), []).append(at)
    return found


def cut_phrases(most_words: int, known, mask: np.uint64, chunk_bytes: int):
    """The work of a partition in the last pass: (lang, k, fingerprint, phrase, number).

    The phrase of a fingerprint where it points to, without a number; phrases
    of a fingerprint with several texts, with their number here and without
    the fingerprint; and the words of a language as the phrase of none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = known()
        for chunk in chunks_of(batches, chunk_bytes):
            words = chunk.text.translate(_TO_SPACE).split()
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            rows: list[tuple[str, int, int | None, bytes, int | None]] = []
            totals: dict[str, int] = {}
            for lang, n in zip(chunk.langs, np.bincount(chunk.document, minlength=len(chunk.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            rows += [(lang, 0, None, b"", n) for lang, n in totals.items()]
            for k in range(1, most_words + 1):
                places, values = frequent(chunk, k, found.frequent, mask)
                several = found.mixed[k].holds(values)
                for same in _distinct(chunk, k, places[several], ids).values():
                    rows.append((chunk.langs[chunk.document[same[0]]], k, None, b" ".join(words[same[0]:same[0] + k]), len(same)))
                pointers = chunk.pointers(places, values)
                pointed = ~several & found.pointed[k].holds(values ^ (pointers | pointers << np.uint64(32)))
                shown, first = np.unique(values[pointed], return_index=True)
                for value, at in zip(shown.view(np.int64).tolist(), places[pointed][first].tolist()):
                    rows.append((chunk.langs[chunk.document[at]], k, value, b" ".join(words[at:at + k]), None))
            yield dict(zip(("lang", "k", "fp", "phrase", "n"), map(list, zip(*rows))))

    return work


def _filter_of(keys: DataFrame, bits: int) -> Filter:
    """The filter of the column ``key``: built by a grouping, at most 2^bits bits come to the driver."""
    part = min(bits, 15)
    halves = F.explode(F.array(F.expr(f"shiftrightunsigned(key, {64 - bits})"), F.expr(f"shiftrightunsigned(key, {32 - bits}) & {(1 << bits) - 1}L")))
    found = (keys.select(halves.alias("place")).groupBy(F.shiftright("place", part).alias("part"))
             .agg(F.expr(f"bitmap_construct_agg(place & {(1 << part) - 1})").alias("map")))
    rows = found.collect()
    if not rows:
        return Filter(bits, None)
    table = np.zeros(max(1 << bits >> 3, 1), np.uint8)
    size = max(1 << part >> 3, 1)
    for row in rows:
        table[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["map"], np.uint8)[:size]
    return Filter(bits, table)


def _groups(most_words: int) -> list[tuple[int, ...]]:
    """Lengths that are counted in one pass: (1, 2), (3,), then two at a time."""
    return [g for g in [(1, 2)[:most_words], (3,) if most_words > 2 else (), *(
        tuple(range(k, min(k + 2, most_words + 1))) for k in range(4, most_words + 1, 2))] if g]


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, filter_bits: int = FILTER_BITS,
                  fingerprint_bits: int = 64, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, k, phrase, n): phrases of 1 to ``most_words`` words that occur at least ``least`` times in the texts of
    a language, and for k = 0 the number of all its words. Filters of any size give the same. Two texts would be counted as
    one only where they agree in the fingerprint and in 32 bits of the check."""
    context = docs.sparkSession.sparkContext
    id_ = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("bigint")
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.xxhash64(id_, "text").alias("mark"))
    mask = np.uint64(((1 << fingerprint_bits) - 1) << (64 - fingerprint_bits))
    columns = ["text", "lang", "mark"]
    filters: dict[str, dict[int, object]] = {"frequent": {}, "pointed": {}, "mixed": {}}

    def reader() -> Callable[[], Known]:
        held = {name: dict(of) for name, of in filters.items()}
        return lambda: Known(**{name: {k: b.value for k, b in of.items()} for name, of in held.items()})

    tables = []
    for lengths in _groups(most_words):
        sent = per_partition(docs, columns, count_fingerprints(lengths, reader(), mask, chunk_bytes), "k int, fp bigint, n bigint, mark bigint")
        counts = sent.groupBy("k", "fp").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"), F.max("mark").alias("last")).where(F.col("n") >= least)
        alike = F.shiftright("mark", 32) == F.shiftright("last", 32)
        counts = cut_lineage(counts.select("k", "fp", "n", F.col("mark").bitwiseAND(0xFFFFFFFF).alias("pointer"), alike.alias("alike")))
        tables.append(counts)
        pointed = F.col("fp").bitwiseXOR(F.col("pointer").bitwiseOR(F.shiftleft("pointer", 32)))
        for name, keys in (("frequent", counts.select(F.col("fp").alias("key"))), ("mixed", counts.where("NOT alike").select(F.col("fp").alias("key"))),
                           ("pointed", counts.where("alike").select(pointed.alias("key")))):
            filters[name] |= dict.fromkeys(lengths, context.broadcast(_filter_of(keys, filter_bits)))
    rows = cut_lineage(per_partition(docs, columns, cut_phrases(most_words, reader(), mask, chunk_bytes),
                                     "lang string, k int, fp bigint, phrase string, n bigint"))
    known = functools.reduce(DataFrame.unionByName, tables).where("alike").select("k", "fp", F.col("n").alias("number"))
    shown = rows.where("fp IS NOT NULL").select("lang", "k", "fp", "phrase").distinct().join(known, ["k", "fp"]).select(
        "lang", "k", "phrase", F.col("number").alias("n"))
    counted = rows.where("fp IS NULL").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= least))
    return cut_lineage(shown.unionByName(counted))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, best: int = BEST,
                 covered_percent: int = COVERED_PERCENT, **settings) -> DataFrame:
    """``lang rank phrase a l r n score`` of the ``best`` phrases of each language of ``docs`` (``text lang``).

    A null or empty text has no words; rows without a language are one of their
    own; repeated rows count as often as they stand there. Equal scores are
    ranked by frequency, then by the bytes of the phrase. Other columns are
    ignored, and a table without words gives no rows.
    """
    counts = phrase_counts(docs, least, most_words, **settings)
    words = F.split("phrase", " ")
    candidates = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"))
    parts = counts.where("k >= 1").select("lang", "phrase", "n")
    totals = counts.where("k = 0").select("lang", F.col("n").alias("n"))

    def joined(first, length) -> F.Column:
        return F.array_join(F.slice("words", first, length), " ")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    # Products may pass 64 bits: 38 digits.
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(17, 0)))"
                   " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    span = F.explode(F.sequence(F.lit(2), F.col("k") - 1))
    around = candidates.where("k >= 3").withColumn("size", span).withColumn(
        "from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    around = around.select("lang", joined(F.col("from"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered_percent)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(in_part))
    kept = kept.where(F.col("rank") <= best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return kept.where(F.col("rank") <= best).select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, folder: str) -> DataFrame:
    """The phrases of each language of the documents."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


_NEXT = ", ".join(f"lead(word, {j}) OVER places AS w{j}" for j in range(1, MOST_WORDS))
_GRAMS = "\n  UNION ALL ".join(
    "SELECT lang, {} AS k, {} AS phrase FROM followed{}".format(
        k, " || ' ' || ".join(["word", *(f"w{j}" for j in range(1, k))]), f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "")
    for k in range(1, MOST_WORDS + 1))
OP11_SQL = rf"""
WITH lowered AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '{NO_LANGUAGE}') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents WHERE text IS NOT NULL),
pieces AS (
  SELECT lang, row_id, generate_subscripts(p, 1) AS piece, unnest(p) AS text
  FROM (SELECT lang, row_id, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM lowered)),
words AS (
  SELECT lang, row_id, piece, generate_subscripts(w, 1) AS place, unnest(w) AS word
  FROM (SELECT lang, row_id, piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces)),
followed AS (SELECT lang, word, {_NEXT} FROM words WINDOW places AS (PARTITION BY row_id, piece ORDER BY place)),
grams AS ({_GRAMS}),
counted AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first_, array_to_string(w[cut + 1:], ' ') AS rest_
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, f.n AS l, r.n AS r, t.n,
    CAST((1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(f.n AS HUGEINT) * r.n) AS BIGINT) AS score, cut
  FROM cuts c JOIN counted f ON f.lang = c.lang AND f.phrase = c.first_ JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest_
    JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (
  SELECT lang, array_to_string(w[at_:at_ + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS at_ FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM candidates))
  GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
  FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND around.phrase = lowest.phrase
  WHERE coalesce(100 * longer, 0) < {COVERED_PERCENT} * a)
WHERE rank <= {BEST}
"""
