"""The pipeline's stages on planted documents, and its result against the stages' own rules."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalbed.llm import bpe, decontaminate, minhash, pii
from tests.llm.cases import odd_documents

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.cut_lineage(stage(spark, out[-1], FOLDER)))
    return out


def test_columns_and_order(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0.6 * counts[0]


def test_toxic_rows_go_and_clean_stay(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before = stages[0].join(labels, "doc_id").groupBy("toxic").count().collect()
    after = {r["toxic"]: r["count"] for r in stages[1].join(labels, "doc_id").groupBy("toxic").count().collect()}
    before = {r["toxic"]: r["count"] for r in before}
    assert after.get(1, 0) < 0.2 * before[1] and after[0] > 0.95 * before[0]


def test_one_of_each_group(stages):
    left = minhash.near_duplicates(stages[2])
    assert left.where("NOT kept").count() == 0
    gone = stages[1].join(stages[2].select("doc_id"), "doc_id", "left_anti")
    groups = minhash.near_duplicates(stages[1]).where("NOT kept").select("doc_id")
    assert {r[0] for r in gone.select("doc_id").collect()} == {r[0] for r in groups.collect()}


def test_no_benchmark_window_left(spark, stages):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.contamination(stages[3], items).where("contaminated").count() == 0
    assert decontaminate.contamination(stages[2], items).where("NOT contaminated").count() == stages[3].count()


def test_no_base_span_left(stages):
    for row in stages[4].collect():
        assert pii.base_spans(row["text"]) == []
        assert row["n_chars"] == len(row["text"])


def test_ids_decode_to_the_masked_text(stages):
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary()), None)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for row in stages[5].collect():
        assert b"".join(i.to_bytes(4, "little") for i in row["ids"]) == encoder.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(row["ids"])


def test_every_row_is_decoded(stages):
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary()), None)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for row in stages[5].select("doc_id", "decoded").collect():
        assert row["decoded"] == encoder.decode(encoder.encode(texts[row["doc_id"]])).decode()


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    key = F.sha2(F.concat_ws(",", "ids"), 256)
    assert sorted(got.select("doc_id", key).collect()) == sorted(stages[5].select("doc_id", key).collect())


def test_planted_cases(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 8)))
    plain = [[word() for _ in range(160)] for _ in range(6)]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [(i, " ".join(w)) for i, w in enumerate(plain)]
    near = plain[0][:]
    near[80] = "other"
    rows += [(10, " ".join(near)), (11, " ".join(plain[1])), (12, " ".join(plain[2][:80]) + " " + item), (3, rows[3][1]), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, FOLDER)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect()) == sorted(
        (i is None, i) for i in [0, 1, 2, 3, 4, 5, None, None])


def test_odd_rows_and_none(spark):
    docs = odd_documents(spark)
    for table, most in ((docs, docs.count()), (docs.where("false"), 0)):
        rows = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.cut_lineage(stage(spark, rows, FOLDER))
            assert rows.columns == docs.columns
        assert rows.count() <= most and (rows.count() > 0) == (most > 0)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).count() == rows.count()
