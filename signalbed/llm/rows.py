"""Work on one document at a time: Arrow batches in, Arrow batches out, nothing shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII letters to lower case, every other ASCII character but letters and digits to a space; other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Documents that a batch function gets at once, so that the words of a whole Arrow batch never lie in memory together.
ROWS_AT_ONCE = 1_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none in a null."""
    return to_bytes(text).translate(WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def per_document(
    docs: DataFrame, columns: list[str | Column], start: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Run ``start()`` once per partition, then what it returns on ``rows_at_once`` rows of ``columns`` at a time.

    The batch function returns one list or array per column of ``schema``.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                work = work or start()
                made = work(batch.slice(at, rows_at_once))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)


def per_partition(
    docs: DataFrame, columns: list[str | Column], work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str,
) -> DataFrame:
    """Run ``work`` on the batches of each partition; it yields parts of the result, one list or array per column.

    For work that gathers some rows before it answers; ``work`` itself has to
    bound what it holds.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)
