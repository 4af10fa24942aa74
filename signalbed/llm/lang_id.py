"""Language identification by compression (operator 1).

Every language has a dictionary of raw text. A text is compressed with each of
them, and the language whose dictionary makes it smallest is chosen. Where the
runner-up comes close, the choice is marked as not reliable.

Texts are folded first: lower case, ASCII punctuation and digits to spaces.
They are compressed in pieces, so that a long text stays measured against the
dictionary and not against its own beginning; all pieces of a text count.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbed.llm.rows import id_remainder, per_document, to_bytes

DICTIONARY_BYTES = 65_536
SAMPLE_ROWS = 400
PIECE_CHARS = 512
PIECE_BYTES = 4_096
LEVEL = 5
MARGIN = 0.02
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, reliable boolean"

_FOLD = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def fold(text: str) -> bytes:
    return b" ".join(to_bytes(text.lower()).translate(_FOLD).split())


def fit(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES
) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of ``docs`` (``doc_id text lang``).

    The rows are counted per language over all of ``docs``; about
    ``sample_rows`` of each language, chosen by a hash of the row, are cut into
    pieces of ``PIECE_CHARS`` from beginning to end. A dictionary takes pieces
    of all these texts, in the order of a hash of text and place, until it has
    ``dictionary_bytes``: that is what the driver gets per language, and the
    bound of the sample. Rows that repeat a text give their pieces once.
    Languages are ordered by their rows.
    """
    known = docs.where("lang IS NOT NULL")
    counts = known.groupBy("lang").count()
    few = counts.limit(MOST_LANGUAGES + 1).collect()
    if len(few) <= MOST_LANGUAGES:  # then a broadcast holds them; beyond, the join shuffles
        counts = F.broadcast(docs.sparkSession.createDataFrame(few, counts.schema))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1_000_000))
    picked = known.join(counts, "lang").where(
        F.col("text").isNotNull() & (place < F.lit(sample_rows * 1_000_000.0) / F.col("count")))

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            pieces = [[fold(t[i:i + PIECE_CHARS]) for i in range(0, len(t), PIECE_CHARS)] for t in batch["text"].to_pylist()]
            return {"lang": batch["lang"], "count": batch["count"], "at": batch["at"], "pieces": pieces}

        return work

    columns = ["lang", "count", F.xxhash64("text").alias("at"), "text"]
    cut = per_document(picked, columns, start, "lang string, count bigint, at bigint, pieces array<binary>")
    cut = cut.select("lang", "count", "at", F.posexplode("pieces").alias("place", "piece")).dropDuplicates(["lang", "at", "place"])
    cut = cut.where(F.length("piece") > 0).withColumn("turn", F.xxhash64("at", "place"))
    before = Window.partitionBy("lang").orderBy("turn", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).where(F.col("before") < dictionary_bytes)
    texts: dict[tuple[int, str], list[tuple[int, bytes]]] = {}
    for row in cut.select("lang", "count", "turn", "piece").collect():
        texts.setdefault((-row["count"], row["lang"]), []).append((row["turn"], bytes(row["piece"])))
    return {lang: b" ".join(t for _, t in sorted(rows))[:dictionary_bytes] for (_, lang), rows in sorted(texts.items())}


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, text in model:
        words = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False,
                                                   write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, reliable) of one whole text."""
    if not model or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    data = fold(text)
    pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)] or [b""]
    sizes = sorted(
        (sum(len(packer.compress(p)) for p in pieces), i, lang) for i, (lang, packer) in enumerate(_compressors(model))
    )
    best, _, lang = sizes[0]
    score = 1 / sum(math.exp(max(best - size, -700)) for size, *_ in sizes)
    gap = (sizes[1][0] - best) / max(best, 1) if len(sizes) > 1 else 1.0
    return lang, score, gap >= margin


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``reliable`` for every row of ``docs`` (``doc_id text``).

    ``und`` with score 0 for a null text, a text without a letter, or an empty
    model. ``score`` is the share of the chosen language when every byte saved
    counts e-fold; equal sizes go to the language that comes first in
    ``model`` (most rows) and score at most 1/2. ``reliable`` is false where the runner-up is less than
    ``margin`` larger: a caller that wants rejection reads ``und`` there.
    Repeated rows are answered one by one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model.items()))

    def start():
        languages = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            found = [classify(t, languages, margin) for t in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found], "reliable": [f[2] for f in found],
            }

        return work

    columns = [F.col("doc_id").cast("bigint"), "text", (id_remainder("doc_id", 3) == 1).alias("held_out")]
    return per_document(docs, columns, start, SCHEMA)


def op1_language_id(spark, folder: str) -> DataFrame:
    """The language of every document, learned from the two thirds that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return identify(docs, fit(docs.where(id_remainder("doc_id", 3) != 1)))
