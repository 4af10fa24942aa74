"""Every operator over documents with nulls, empty and long texts, repeats and clashing columns, and over none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbed.llm import bpe, decontaminate, lang_id, licenses, minhash, pii, quality, substrings, toxicity
from tests.llm.cases import LONG, ROWS, SAME, no_documents, odd_documents

MODEL = {"en": b"the and of with this that from", "fr": b"le la les une dans avec pour"}
TOXIC = toxicity.Severity({"scum.": 9.0}, (4.0, 8.0))
ITEMS = "item_id bigint, text string, score string"


def _quality_model():
    x = np.random.default_rng(1).normal(size=(60, len(quality.FEATURES)))
    return quality.fit_discriminant(x, np.arange(60) % 2)


def _items(spark):
    return spark.createDataFrame(
        [(1, SAME, "c"), (2, "x", "c"), (2, "x", "c"), (3, None, "c"), (4, "", "c"), (None, "row WITHOUT an", "c")], ITEMS)


OPERATORS = {
    "language": lambda docs: lang_id.identify(docs, MODEL),
    "no_languages": lambda docs: lang_id.identify(docs, {}),
    "quality": lambda docs: quality.score(docs, _quality_model()),
    "substrings": substrings.without_repeats,
    "toxicity": lambda docs: toxicity.severity(docs, TOXIC),
    "licenses": licenses.find_licenses,
    "minhash": minhash.near_duplicates,
    "bpe": bpe.encode,
    "bpe_digests": bpe.digests,
    "pii": lambda docs: pii.find(docs, np.zeros((len(pii.FEATURES), len(pii.KINDS)))),
    "decontaminate": lambda docs: decontaminate.contamination(docs, _items(docs.sparkSession)),
}


@pytest.fixture(scope="module")
def results(spark):
    docs = odd_documents(spark).cache()
    return {name: run(docs).collect() for name, run in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(results, name):
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in results[name])
    assert ids == sorted((i is None, i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_agree(results, name):
    assert len({str(r) for r in results[name] if r["doc_id"] == 5}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](no_documents(spark)).collect() == []


def _by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language_of_nothing(results):
    found = _by_id(results["language"])
    assert {found[i]["lang_pred"] for i in (1, 2, 3, 8)} == {"und"}
    assert found[10]["lang_pred"] in MODEL
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in results["no_languages"])


def test_substrings_of_copies(results):
    found = _by_id(results["substrings"])
    assert found[1]["n_words"] == found[2]["n_words"] == found[3]["n_words"] == 0
    assert found[1]["kept"] == ""
    # 39 words, the windows from word 13 on repeat earlier ones of the document itself
    assert found[5]["n_removed"] == 26 and found[6]["n_removed"] == 39 and found[7]["n_removed"] == 26


def test_minhash_of_nothing_and_copies(results):
    found = _by_id(results["minhash"])
    assert all(found[i]["component_id"] == i and found[i]["kept"] for i in (1, 2, 3, 4, 8, 9, 10))
    assert {found[i]["component_id"] for i in (5, 6, 7)} == {5}
    assert [found[i]["kept"] for i in (5, 6, 7)] == [True, False, False]
    assert all(r["kept"] and r["component_id"] is None for r in results["minhash"] if r["doc_id"] is None)


def test_decontaminate_short_items(results):
    found = _by_id(results["decontaminate"])
    assert found[9]["n_hit"] == 1 and found[9]["n_items"] == 1
    assert found[5]["n_hit"] == found[5]["n_words"] == 39
    assert not found[1]["contaminated"] and found[4]["n_words"] == len(LONG.split())
    without_id = [r for r in results["decontaminate"] if r["doc_id"] is None]
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in without_id) == [(0, 0, 0), (5, 3, 0)]


def test_no_items(spark):
    docs = odd_documents(spark)
    found = decontaminate.contamination(docs, _items(spark).where("false")).collect()
    assert len(found) == len(ROWS) and not any(r["contaminated"] for r in found)
    assert decontaminate.without_contaminated(docs, _items(spark).where("false")).count() == len(ROWS)


def test_pii_of_nothing(results):
    found = _by_id(results["pii"])
    assert found[1]["spans"] == found[2]["spans"] == ""
    assert (found[12]["n_email"], found[12]["n_phone"]) == (1, 1)


def test_fits_without_labels(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels)).select(F.round("score", 9).alias("score")).collect()} == {0.5}
    assert not any(r["toxic"] for r in toxicity.severity(docs, toxicity.fit(docs, labels)).collect())
    assert lang_id.fit(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")) == {}
    some = spark.createDataFrame([(5, None, None), (None, 1, 1), (6, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, some)).count() == len(ROWS)
    assert toxicity.severity(docs, toxicity.fit(docs, some)).count() == len(ROWS)
    assert pii.fit(docs.where("false")).shape == (len(pii.FEATURES), len(pii.KINDS))
