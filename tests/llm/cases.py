"""Documents that operators must survive: nulls, empty and long texts, repeats, and columns named like results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 7919} the" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen " * 3

ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (7, SAME.upper()),
    (None, "a row without an id"), (None, None), (8, "12345 67.89 !!! ???"), (9, "x"), (10, "Ünïcödé ÄÖ ß 漢字 😀"),
    (11, "\x00\x01 nul \x7f"), (12, "mail me at jane.roe@example.org or +1 (212) 555-0199 now"),
]
SCHEMA = "doc_id bigint, text string"
#: Columns of the operators' results and of their inner tables.
CLASHING = (
    "score", "held_out", "lang_pred", "kept", "n_words", "words", "id", "c1", "n", "node", "severity", "ids", "spans",
    "component_id", "class_id", "hit_doc", "text_key", "toxic", "own", "size", "band",
)


def odd_documents(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).where("false")
