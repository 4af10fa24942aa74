"""Collocations, ranked search and mixing against brute force, and over odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbed.llm import collocations, mixing, search
from signalbed.llm.rows import plain_words
from tests.llm.cases import LONG, ROWS, no_documents, odd_documents

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _phrases(rows, least, most_words):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().translate(LOWER)):
            words = [w.decode() for w in re.findall(rb"[^\x20\x09]+", piece)]
            counts[lang or "und"][""] += len(words)
            for k in range(1, most_words + 1):
                counts[lang or "und"].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts


def _collocations(rows, least, most_words, best):
    out = []
    for lang, c in _phrases(rows, least, most_words).items():
        n = c.pop("")
        found = {p: a for p, a in c.items() if a >= least and " " in p}
        covered = set()
        for p, a in found.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner = " ".join(w[i:i + size])
                    if 100 * a >= 100 * c[inner]:
                        covered.add(inner)
        ranked = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1000 * a * n // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if p not in covered:
                ranked.append((-score, -a, p.encode(), p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n, score))
        out += [(lang, i + 1, *r[3:]) for i, r in enumerate(sorted(ranked)[:best])]
    return sorted(out, key=str)


def _random_texts(rng, n):
    words = ["a", "b", "c", "the", "Über", "x1"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(40))),
             rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 9, 3])
def test_collocations_by_brute_force(spark, bits):
    """With 9 bits some fingerprints collide, with 3 nearly all: the result stays the same."""
    rows = _random_texts(random.Random(5), 300) + [(None, "en"), ("", None), ("the the the the the the", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least, most_words, best in ((20, 5, 2000), (8, 3, 7), (3, 7, 50)):
        got = collocations.collocations(docs, least, most_words, best, filter_bits=min(bits, 12), fingerprint_bits=bits, chunk_bytes=500)
        got = [tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert sorted(got, key=str) == _collocations(rows, least, most_words, best)


def test_fingerprints_depend_on_words_alone():
    powers, seeds = collocations.Powers(), {}
    rng = random.Random(3)
    words = [rng.choice(["one", "two", "three", "four"]).encode() for _ in range(5000)]
    chunk = collocations.Chunk([b" ".join(words[:2000]), b"  ".join(words[2000:])], ["en", "en"], [1, 2], powers, seeds)
    for k, which in ((1, 0), (2, 0), (4, 0), (1, 1), (3, 1)):
        of = {}
        for i, value in enumerate(chunk.fingerprints(k, which).tolist()):
            assert of.setdefault(tuple(words[i:i + k]), value) == value
        assert len(set(of.values())) == len(of)


def test_collocations_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("lang", F.when(F.col("doc_id") > 6, "en"))
    got = collocations.collocations(docs, least=3).collect()
    assert got and {r["lang"] for r in got} <= {"und", "en"}
    assert collocations.collocations(no_documents(spark).withColumn("lang", F.lit("en"))).collect() == []


def _ranked(docs, items, best):
    terms = [plain_words(t) for _, t in docs]
    sizes = [len(t) for t in terms]
    total, length = sum(1 for s in sizes if s), sum(sizes)
    held = collections.Counter(w for t in terms for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), t, size in zip(docs, terms, sizes):
            tf = collections.Counter(t)
            m = 25 + 75 * size * total // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
                        for w in plain_words(text) if tf[w])
            if score:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [(8192, 10**6), (7, 10**6), (100, 30)])
def test_search_by_brute_force(spark, monkeypatch, shard):
    rng = random.Random(sum(shard))
    words = [f"w{i}" for i in range(30)]
    docs = [(rng.randrange(150), " ".join(rng.choice(words[: rng.randrange(1, 30)]) for _ in range(rng.randrange(25)))) for _ in range(200)]
    docs += [docs[0], docs[1], (None, "w3 w4 W5"), (None, "w3 w4 w5"), (900, None), (901, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "...")]
    shared = search.shard_answers
    monkeypatch.setattr(search, "shard_answers", lambda block, corpus, best, share: shared(block, corpus, best, share, shard))
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items_df = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    for best, block in ((10, 10**6), (3, 9)):
        got = [tuple(r) for r in search.search(docs_df, items_df, best=best, block_terms=block).collect()]
        assert sorted(got, key=str) == _ranked(docs, items, best)


def test_bounds_of_a_shard():
    """Any number of entries read before the first look gives the same best, whole scores and ties included."""
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 400 * 12, 2500))
    impact = rng.integers(0, 6, len(key)) * 100
    shard = search.Shard(key // 12, key % 12, impact, 12)
    times = rng.integers(1, 3, 12)
    scores = np.bincount(key // 12, weights=impact * times[key % 12], minlength=400).astype(int)
    ids = rng.permutation(400)
    order = [d for d in np.lexsort((ids, -scores)) if scores[d] > 0][:10]
    for first_read in (1, 5, 64, 10**6):
        assert search.best_of(shard, np.arange(12), times, 400, ids, 10, first_read) == (order, scores[order].tolist())


def test_search_of_odd_rows(spark):
    items = spark.createDataFrame([("x", "word1 the"), ("x", "row WITHOUT an id"), (None, "twelve")], "item_id string, text string")
    got = search.search(odd_documents(spark), items).collect()
    assert [r["rank"] for r in got if r["item_id"] is None] == [1, 2, 3, 4]
    assert {r["doc_id"] for r in got if r["item_id"] == "x"} == {4, None}
    assert search.search(no_documents(spark), items).collect() == []
    assert search.search(odd_documents(spark), items.where("false")).collect() == []


SIZE = re.compile(rb"[^\x20\x09-\x0d]+")


def _targets(sizes, weights, percent, passes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, want = set(), sum(sizes.values()) * percent
    while True:
        rest = want - 100 * passes * sum(sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * rest > 100 * passes * sizes[s] * left}
        if not above:
            return {s: float(passes * sizes[s]) if s in full else weight[s] * rest / (100 * left) for s in names}
        full |= above


def _mix_rows(rng, n):
    sources = [f"s{i}" for i in range(9)] + ["Ä", None]
    rows = [(rng.choice([i, i, None, 7]), " ".join(["w"] * rng.choice([0, 1, 3, 30, 200])), "hot" if rng.random() < 0.4 else rng.choice(sources)) for i in range(n)]
    return rows + [(1, None, "empty"), (2, " \t ", "empty"), (3, "one", "tiny")]


@pytest.mark.parametrize("block", [4, 512])
def test_mix_by_brute_force(spark, block):
    rows = _mix_rows(random.Random(block), 400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("taken", F.lit("clash")).repartition(5)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(SIZE.findall((text or "").encode()))
    target = _targets(sizes, (3, 1, 2), 150, 2)
    got = mixing.mix(docs, block_words=block).collect()
    want = sorted(((d, len(SIZE.findall((t or "").encode())), sizes[s], target[s]) for d, t, s in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got), key=str) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["source_size"], r["target"]] += r["taken"]
    for (size, t), n in taken.items():
        alike = sum(1 for s in sizes if (sizes[s], target[s]) == (size, t))
        assert n == alike * math.floor(t + 0.5)
    again = mixing.mix(docs.repartition(2), block_words=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_schedule_is_the_van_der_corput_sequence(spark):
    """Slots belong to the source their point falls into; a stretch of the schedule holds each source in proportion."""
    rows = [(i, "w " * 97, f"s{i % 7 // 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    pieces = mixing.schedule(docs, block_words=64).collect()
    sizes = collections.Counter({f"s{k}": 0 for k in range(3)})
    for _, _, s in rows:
        sizes[s] += 97
    target = _targets(sizes, (3, 1, 2), 150, 2)
    total = sum(target.values())
    slots = 1 << (int(total / 64).bit_length() - 1)
    owner = {p["slot"]: p["source"] for p in pieces}
    assert sorted(owner) == list(range(slots))
    for slot, source in owner.items():
        point = (int(format(slot, f"0{slots.bit_length() - 1}b")[::-1], 2) + 0.5) / slots
        edge = 0.0
        for s in sorted(target):
            edge += target[s] / total
            if point < edge:
                break
        assert s == source
    words = collections.Counter()
    for p in pieces:
        words[p["slot"]] += p["end_word"] - p["first_word"]
    assert max(words.values()) - min(words.values()) <= 2
    for n in range(10, slots + 1, 37):
        for s in target:
            assert abs(sum(owner[i] == s for i in range(n)) - n * target[s] / total) <= math.log2(n) + 1
    lines = collections.defaultdict(list)
    for p in pieces:
        lines[p["source"]].append((p["at"], p["end_word"] - p["first_word"]))
    for spans in lines.values():  # no gap and no overlap on a source's line
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even"))
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, _ in ROWS)
    assert max(r["size"] for r in got) == len(LONG.split())
    assert mixing.mix(no_documents(spark).withColumn("source", F.lit("a"))).collect() == []
    empty = mixing.mix(docs.where("doc_id IN (1, 2, 3)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 3


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_AT_ONCE", 10)
    docs = spark.createDataFrame([(None, "a b c", "s")] * 95 + [(1, "x " * 50, "t")], "doc_id bigint, text string, source string")
    got = mixing.mix(docs, block_words=8).collect()
    targets = {r["size"]: r["target"] for r in got}
    assert len(got) == 96 and targets[50] == 100
    assert sum(r["taken"] for r in got if r["size"] == 3) == math.floor(targets[3] + 0.5)
    assert {r["taken"] for r in got if r["size"] == 50} == {100}
