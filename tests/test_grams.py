"""The numbers of grams against a plain search for them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalbed.functions import grams
from signalbed.operators import traps


@pytest.mark.parametrize("sweep", [7, 1 << 17])
def test_texts_hold_the_grams_of_their_needles(monkeypatch, sweep):
    monkeypatch.setattr(grams, "SWEEP", sweep)
    draw = random.Random(7)
    texts = ["".join(draw.choices("abü😀 ", k=draw.randrange(40))) for _ in range(60)] + [None, "", "ab"]
    array = pa.array([None, "not this one", *texts]).slice(2)
    every = {size: grams._sweep(array, [size], lambda _, hashes: np.ones(len(hashes), bool)).to_pylist() for size in grams.SIZES}
    for size, found in every.items():
        runs = [{t[i:i + size] for i in range(len(t) - size + 1)} for t in ((text or "").encode() for text in texts)]
        assert [len(numbers) for numbers in found] == [len(r) for r in runs]
        assert len({n for numbers in found for n in numbers}) == len(set().union(*runs))  # equal bytes, equal numbers
    assert {n for numbers in every[3] for n in numbers}.isdisjoint(n for numbers in every[6] for n in numbers)


def test_long_texts_ask_for_filed_grams_only(spark):
    long = " ".join(f"{n:x}" for n in range(50_000))
    words = spark.createDataFrame([(0, f"the License, {long}"), (1, long), (2, None), (3, ""), (4, "LICENSE " * 9)], "id long, text string")
    rule = [{"trap_id": "x", "team_id": 0, "trap_type": "PATTERN", "is_active": True, "conditions": [
        {"condition_type": "KEYWORD", "field": "message", "pattern": "LicenSe"}]}]
    index = traps.rule_index(traps._prepared(traps._active(spark, rule, "PATTERN")))
    wanted = grams.gram_filter(index.select("_gram"), 1)
    asked = words.select("id", F.size(grams.asked_grams(F.lower("text"), wanted, [6])).alias("n"))
    # One gram is filed; of some hundred thousand others the filter lets hardly any through.
    assert {r.id: r.n for r in asked.collect() if r.id != 1 and r.id != 0} == {2: 0, 3: 0, 4: 1}
    assert max(r.n for r in asked.collect()) < 40
    rows = words.select("id", F.lit(0).alias("team_id"), F.col("text").alias("message"))
    assert sorted(r.id for r in traps.pattern_hits(rows, rule).collect()) == [0, 4]
