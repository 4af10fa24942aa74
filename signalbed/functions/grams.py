"""Grams of texts as numbers, and a filter of bounded size that tells which grams of a text may be asked for.

A gram is some consecutive bytes of a text in UTF-8; its number is a hash of 64
bits. What holds a needle holds all its grams, so equal numbers find all that
may hold it, and whoever asks compares the texts afterwards. The hashes of a
column are made in one sweep over the bytes of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a gram; each is twice the one before. A needle is known by grams of the longest that it holds.
SIZES = (3, 6, 12)
#: Bytes that are hashed at a time, whatever the length of the texts.
SWEEP = 1 << 17
#: Bits of a filter for each gram, and most words of 64 bits (32 MB).
FILTER_BITS, MOST_WORDS = 24, 1 << 22

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _hashes(data: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, the hash of each run of so many bytes) for each of ``sizes``."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, power = np.uint64(_BASE), pow(_BASE, 3, 1 << 64)
    h = (h[:-2] * base + h[1:-1]) * base + h[2:]
    for size in SIZES:
        if size in sizes:
            x = h + np.uint64(size * _BASE & _MASK)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield size, x ^ (x >> np.uint64(31))
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power & _MASK


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _lists(row: np.ndarray, found: np.ndarray, n: int) -> pa.Array:
    """The distinct numbers of each of ``n`` rows."""
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(found.view(np.int64)))


def _sweep(texts: pa.Array, sizes: Sequence[int], wanted) -> pa.Array:
    """For each text the numbers of its grams for which ``wanted(size, hashes)`` is true."""
    data, ends = _bytes(texts)
    rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(0, len(data), SWEEP):
        part = data[start:start + SWEEP + max(SIZES) - 1]
        for size, hashes in _hashes(part, sizes):
            hashes = hashes[:SWEEP]
            at = np.flatnonzero(wanted(size, hashes))
            row = np.searchsorted(ends, start + at, side="right") - 1
            inside = start + at + size <= ends[row + 1]
            rows.append(row[inside])
            numbers.append(hashes[at[inside]])
    return _lists(np.concatenate(rows), np.concatenate(numbers), len(texts))


def size_of(needle: Column) -> Column:
    """Bytes of the grams that a needle is known by; null where it is shorter than the shortest."""
    return F.coalesce(*[F.when(F.octet_length(needle) >= size, size) for size in reversed(SIZES)])


@F.arrow_udf(T.ArrayType(T.LongType()))
def needle_grams(needles: pa.Array) -> pa.Array:
    """The distinct grams of each needle, of the longest size it holds; none where it is too short or null."""
    lists = [_sweep(needles, [size], lambda _, hashes: np.ones(len(hashes), bool)) for size in SIZES]
    ends = np.diff(_bytes(needles)[1])
    which = np.searchsorted(SIZES, ends, side="right") - 1
    return pa.array([lists[k][i].as_py() if k >= 0 else [] for i, k in enumerate(which)], pa.list_(pa.int64()))


def _word_bits(words: int) -> int:
    return 64 - (words.bit_length() - 1)


def gram_filter(grams: DataFrame, n: int) -> Broadcast:
    """A filter over ``grams`` (one column of numbers, ``n`` rows), made in tasks: each gram sets two bits of a word."""
    column = F.col(grams.columns[0])
    words = 1 << max(10, min(MOST_WORDS.bit_length() - 1, (n * FILTER_BITS // 64).bit_length()))
    one = F.lit(1).cast("long")

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int"))

    bits = bit(column).bitwiseOR(bit(F.shiftrightunsigned(column, 6)))
    set_ = grams.groupBy(F.shiftrightunsigned(column, _word_bits(words)).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    filled = np.zeros(words, np.uint64)
    filled[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(filled)


def asked_grams(text: Column, wanted: Broadcast, sizes: Sequence[int]) -> Column:
    """The distinct grams of a text that the filter knows, and hardly any others."""
    sizes = tuple(sizes)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def asked(texts: pa.Array) -> pa.Array:
        words = wanted.value
        shift = np.uint64(_word_bits(len(words)))

        def known(_: int, hashes: np.ndarray) -> np.ndarray:
            word = words[hashes >> shift]
            return (word >> (hashes & np.uint64(63)) & (word >> (hashes >> np.uint64(6) & np.uint64(63))) & np.uint64(1)).astype(bool)

        return _sweep(texts, sizes, known)

    return asked(text)
