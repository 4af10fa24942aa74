"""The methods against brute force, exact round trips and held-out rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalbed.llm import bpe, components, decontaminate, lang_id, licenses, minhash, pii, quality, substrings, toxicity, vectors
from signalbed.llm.rows import plain_words

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_language_held_out(spark, docs):
    rows = lang_id.op1_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.96
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(spark, labels):
    rows = quality.op3_quality(spark, FOLDER).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_discriminant_is_the_log_density_ratio():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (400, 3))])
    y = np.repeat([0, 1], 400)
    model = quality.fit_discriminant(x, y, pooled=0.0, identity=0.0)
    z = (x - model.center) / model.scale
    want = 0.0
    for k, sign in ((0, -1), (1, 1)):
        g = z[y == k]
        s, d = np.cov(g.T, bias=True), z - g.mean(0)
        want = want + sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.log_density_difference(x), want)


def test_toxicity(docs, labels):
    known = labels.where("doc_id % 4 <> 0")
    model = toxicity.fit(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.severity(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    clean = [r["p_toxic"] for r in rows if r["toxic"] is not None]
    assert len(clean) == len(rows)
    strong = max(model.weights, key=model.weights.get).rstrip(".")
    assert sum(model.chances(f"{strong} {strong} x")) > sum(model.chances("x"))


def test_toxicity_of_rows_not_learned(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    known = labels.where("doc_id % 4 = 0 AND toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    rows = toxicity.severity(docs.where("doc_id % 4 = 0"), model).join(known, "doc_id").collect()
    found = {label: [r["toxic"] for r in rows if r["label"] == label] for label in (0, 1)}
    assert np.mean(found[1]) > 0.85 and np.mean(found[0]) < 0.01
    assert np.mean([r["severity"] for r in rows if r["label"]]) > 1 > 0.05 > np.mean([r["severity"] for r in rows if not r["label"]])


def test_ordinal_regression_recovers_order():
    rng = random.Random(2)
    sets, grades = [], []
    for _ in range(600):
        grade = rng.choice([0, 0, 1, 2])
        marks = rng.sample(["badword", "worseword", "vileword"], {0: 0, 1: 1, 2: 3}[grade])
        sets.append({*marks, *(f"plain{rng.randrange(80)}" for _ in range(12))})
        grades.append(grade)
    table = toxicity.table_of(sets)
    model = toxicity.fit_ordinal(*table, np.array(grades), 3)
    expected = [np.mean([sum(model.chances(" ".join(s))) for s, g in zip(sets, grades) if g == k]) for k in range(3)]
    assert expected[0] < 0.15 and 0.7 < expected[1] < 1.4 and expected[2] > 1.6


def test_license_base_by_brute_force(spark, texts):
    phrases = [(p.encode().split(), label) for p, label in licenses.PHRASES]
    for row in licenses.op6_license_scan(spark, FOLDER).collect():
        words = plain_words(texts[row["doc_id"]])
        places = [(i, label) for p, label in phrases for i in range(len(words)) if words[i:i + len(p)] == p]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert row["first_word"] == min((i for i, _ in places), default=None)
        assert row["last_word"] == max((i for i, _ in places), default=None)
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))


def _edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("abcxyz") + text[i:], text[:i] + "q" + text[i + 1:]])
    return text


def test_fuzzy_notices_found_with_their_edits():
    rng = random.Random(4)
    for notice, label in licenses.NOTICES:
        for edits in range(licenses.edits_allowed(notice) + 1):
            text = f"Some words. {_edited(rng, notice, edits).upper()}, and more words"
            found = [s for s in licenses.scan(text)[2] if s[0] == label]
            assert found and min(s[3] for s in found) <= edits
    assert licenses.scan("a plain text about the license of a poet")[2] == []


@pytest.mark.parametrize("pair", [(0, "licensed under the apache license version"), (2, "released under the mit license")])
def test_pieces_make_up_the_notice(pair):
    edits, notice = pair
    parts = licenses.pieces(notice, edits)
    assert "".join(p for _, p in parts) == notice and len(parts) == edits + 1


def test_bpe_equals_the_library(docs, texts):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for row in bpe.encode(docs).collect():
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_odd_texts():
    library = Tokenizer.from_file(bpe.default_vocabulary())
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary()), None)
    rng = random.Random(1)
    odd = ["<|startoftext|>hello <|endoftext|>x", "<|startoftext|", "İI ΣΑΣ ΟΔΟΣ", "don't I'LL", "\x1c\x1d a\x0b", "a　b\x85c\xa0d", "ﬁ ẞ Ω"]
    odd += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x300, 0x530), rng.randrange(0x2000, 0xD7FF),
                                    rng.randrange(0xE000, 0x110000)])) for _ in range(12)) for _ in range(1500)]
    for text in odd:
        want = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert encoder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_lexicon_holds_its_words_and_shares_suffixes():
    rng = random.Random(3)
    words = {a + b: [rng.randrange(1 << 20) for _ in range(rng.randint(1, 4))] for a in ("play", "walk", "é", "") for b in ("ing", "ed", "er", "s", "x")}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    for word, ids in words.items():
        assert np.frombuffer(lexicon.look_up(word), "<u4").tolist() == ids
    assert all(lexicon.look_up(w) is None for w in ("", "pla", "playin", "playings", "zed", "éé"))
    trie = {w[:i] for w in (x.encode() for x in words) for i in range(len(w) + 1)}
    assert len(lexicon.final) < len(trie) / 2
    empty = bpe.Lexicon(bpe.compile_lexicon({}))
    assert empty.look_up("a") is None


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def test_pii_base_by_plain_search(texts):
    for text in texts.values():
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                 if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"[^0-9]", "", m.group())
            want += [("card", *m.span())] if 16 <= len(digits) <= 19 and _luhn(digits) else []
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                 if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
        assert pii.base_spans(text) == want


@pytest.fixture(scope="module")
def pii_weights(docs):
    return pii.fit(docs)


def test_pii_adds_spans_the_patterns_miss(pii_weights):
    for text, kind, span in (
        ("call (212) 555-0199 now", "phone", "(212) 555-0199"), ("paid 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"),
        ('x token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" y', "secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"),
    ):
        base, spans = pii.all_spans(text, pii_weights)
        assert base == [] and (kind, text.index(span), text.index(span) + len(span)) in spans
    for text in ("on 2024-05-17 at 12:30", "version 2.0 and 3.", "room 101, 45%"):
        assert pii.all_spans(text, pii_weights) == ([], [])
    base, spans = pii.all_spans("jane@example.org and 10.0.0.1", pii_weights)
    assert set(base) <= set(spans)
    assert pii.redact("jane@example.org and 10.0.0.1", spans) == "[EMAIL] and [IP]"


def test_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(0)
    z = pii.lattice("a1 b2 c3", 0, 8)
    weights = rng.normal(size=(len(pii.FEATURES), len(pii.KINDS)))
    scores = (z.x @ weights).max(1)
    spans = list(zip(z.first.tolist(), z.last.tolist(), scores.tolist()))

    def best(at):
        if at >= len(z.places):
            return 0.0
        return max([best(at + 1), *(s + best(b) for a, b, s in spans if a == at)])

    chosen = pii.best_spans(z, weights)
    value = sum(max(s for a, b, s in spans if (a, b) == (i, j)) for i, j, _ in chosen)
    assert np.isclose(value, best(0))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    z = pii.lattice("a1.b2", 0, 5)
    gold = np.full(len(z.first), -1)
    gold[0] = 2
    weights = rng.normal(size=(len(pii.FEATURES), len(pii.KINDS))) * 0.1

    def log_likelihood(w):
        scores = z.x @ w
        total = [0.0]
        for j in range(1, len(z.places) + 1):
            terms = [total[j - 1]] + [total[z.first[s]] + np.log(np.exp(scores[s]).sum()) for s in z.ends[j]]
            total.append(np.logaddexp.reduce(terms))
        return scores[0, 2] - total[-1]

    step = pii._gradient(z, gold, weights)
    for f, k in ((0, 2), (1, 0), (15, 1)):
        moved = weights.copy()
        moved[f, k] += 1e-5
        assert np.isclose((log_likelihood(moved) - log_likelihood(weights)) / 1e-5, step[f, k], atol=1e-3)


def test_decontaminate_spans_cut(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = f"-- Before it. {item.title()}! After, it"
    docs = spark.createDataFrame([(1, text), (2, "Nothing here"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, items).collect()}
    assert cut == {1: "-- Before it. After, it", 2: "Nothing here", 3: None}
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, items).collect()} == {2, 3}


def test_decontaminate_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcde")
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 8, 9, 10, 12, 14])))) for i in range(12)]
    items += [(100 + i, " ".join(docs[i][1].split()[3:3 + n])) for i, n in enumerate((9, 10, 11, 13, 4))]
    want = {}
    for i, text in docs:
        words, hit, ids = text.split(), set(), set()
        for j, item in items:
            w = item.split()
            size = min(len(w), 10)
            for a in range(len(w) - size + 1 if size else 0):
                for at in range(len(words) - size + 1):
                    if words[at:at + size] == w[a:a + size]:
                        hit |= set(range(at, at + size))
                        ids.add(j)
        want[i] = (len(words), len(hit), len(ids))
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()} == want


def test_substrings_by_brute_force(spark):
    rng = random.Random(6)
    pool = [[rng.choice("abcdefgh") for _ in range(50)] for _ in range(6)]
    docs = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, 20)
            words += p[a:a + rng.randint(3, 30)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 3))]
        docs.append((i, " ".join(words)))
    docs += [(200, docs[3][1]), (201, "loop " * 70)]
    seen, want = set(), {}
    for i, text in docs:
        words, gone = text.split(), set()
        for at in range(len(words) - 19):
            window = tuple(words[at:at + 20])
            if window in seen:
                gone |= set(range(at, at + 20))
            seen.add(window)
        want[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    rows = substrings.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == want


def test_selection_agrees_on_equal_windows():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 40).astype(np.uint64)
    left, right = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), common, rng.integers(0, 2**63, 9).astype(np.uint64)]) for n in (5, 17))
    for width in (1, 2, 3, 8, 11, 16):
        a, b = substrings.selected(left, width), substrings.selected(right, width)
        inner = slice(width, 40 - width)
        assert (a[5:45][inner] == b[17:57][inner]).all()
        for values, mask in ((left, a), (right, b)):
            want = {i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)}
            assert set(np.flatnonzero(mask)) == want


def test_minhash_by_brute_force(spark, docs, texts):
    sets = {i: set(minhash.shingles(plain_words(t)).tolist()) for i, t in texts.items()}
    own = {i: i for i in sets}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    for i in ids:
        near = {}
        for s in sets[i]:
            for j in by[s]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, shared in near.items():
            if shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8:
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.op7_minhash(spark, FOLDER).collect()}
    assert got == {i: top(i) for i in ids}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(60):
        elements = rng.integers(0, 2**63, 60).astype(np.uint64)
        left = rng.random(60) * 5 + 0.01
        right = np.where(rng.random(60) < 0.5, left, rng.random(60) * 5 + 0.01)
        made = minhash.signatures([(elements, left), (elements, right)], 256)
        gaps.append((made[0] == made[1]).mean() - np.minimum(left, right).sum() / np.maximum(left, right).sum())
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.06


def test_crossing_pairs_of_a_band(spark):
    """Two groups in the same bands, the pivot in neither: the links between the others are still found."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]

    def changed(words, places):
        return [f"z{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]

    far = changed(base, set(range(0, 120, 9)))
    docs = [(1, " ".join(base))] + [(10 + i, " ".join(changed(far, {60}))) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), bands=60, rows=2).collect()}
    assert got[1] == 1 and {got[10 + i] for i in range(12)} == {10}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links = [(a, b) for a, b in links if a != b] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    own = {}

    def top(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        own[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: top(x) for x in own}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _vector_rows():
    rng = np.random.default_rng(9)
    rows, centers = [], rng.normal(size=(20, 32))
    for i in range(400):
        v = centers[i % 20] + rng.normal(size=32) * (0.02 if i % 3 else 1.0)
        rows.append((i, (v * (1 + i % 5)).tolist(), i % 2))
    rows += [(400 + i, (centers[0] + rng.normal(size=32) * 0.05).tolist(), 0) for i in range(300)]
    rows += [(900 + i, rows[1][1], 1) for i in range(40)]
    return rows


ODD_VECTORS = [
    (2000, None, 0), (2001, [], 0), (2002, [0.0] * 32, 0), (2003, [float("nan")] + [1.0] * 31, 0), (2004, [None] + [1.0] * 31, 0),
    (2005, [float("inf")] + [1.0] * 31, 0), (2006, [1.0] * 32, None), (None, [1.0] * 32, 0), (2007, [1.0] * 8, 0), (2008, [1.0] * 32, 0),
    (2009, [1e-300] * 32, 0), (2010, [1e300] * 32, 0), (2011, [1.0] * 32, 5), (2012, [-0.0] * 31 + [1.0], 7), (2013, [0.0] * 31 + [1.0], 7),
]


def test_vectors_by_brute_force(spark):
    rows = _vector_rows() + ODD_VECTORS
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("n", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table.repartition(5)).collect()}
    valid = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and k is not None and vectors.usable(v)]
    own = {i: i for i, _, _ in valid}
    links = {i: 0 for i in own}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, (i, u, k) in enumerate(valid):
        for j, v, m in valid[:a]:
            if k == m and len(u) == len(v) and (vectors.unit(u[None]) * vectors.unit(v[None])).sum() >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                own[max(x, y)] = min(x, y)
    want = {i: (links.get(i, 0), top(i) if i in own else i, i is None or i not in own or top(i) == i) for i, _, _ in rows}
    assert got == want


def test_dense_group_of_vectors(spark):
    """Most pairs fall just short of the threshold, many vectors have few links: every row right, not most pairs found."""
    rng = np.random.default_rng(5)
    n, x = 2000, rng.normal(size=64)
    x = x / np.linalg.norm(x) + rng.normal(size=(n, 64)) * 0.19 / 8
    unit = vectors.unit(x)
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    top = np.arange(n)
    while (lower := np.minimum(top, np.where(close, top, n).min(1))).tolist() != top.tolist():
        top = lower
    assert ((close.sum(1) > 0) & (close.sum(1) < 6)).sum() > 500
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table.repartition(5)).collect()}
    assert got == {i: (k, t, t == i) for i, (k, t) in enumerate(zip(close.sum(1).tolist(), top.tolist()))}


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_long_words_by_the_library():
    """Random letters, one letter, and letters that merge in rows: words of up to 200 000 letters."""
    rng = random.Random(8)
    path = bpe.default_vocabulary()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.load_vocabulary(path), None)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (150, 201, 202, 5_000, 200_000)]
    texts += ["a" * 30_001, "the" * 20_000, "ab" * 900 + "é" * 700, "x" * 400 + " " + "straße" * 300]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [k for k in [*encoder.known, *encoder.chunks] if isinstance(k, str)]), default=0) <= bpe.REMEMBERED_CHARS


def test_many_phrases_in_one_text():
    words = ("mit license word " * 60_000).split()
    n, base, spans, _ = licenses.scan(" ".join(words))
    assert n == len(words) and [place for place, _ in base] == list(range(0, n, 3))
    text = "filler " * 50 + "Permission is hereby granted, free of charge, " * 3
    _, _, spans, _ = licenses.scan(text)
    assert all(first >= 49 for _, first, _, _ in spans)


def test_zone_in_blocks_equals_the_lattice():
    rng = random.Random(12)
    weights = np.random.default_rng(3).normal(size=(len(pii.FEATURES), len(pii.KINDS)))
    weights[0] -= 1.5
    for _ in range(40):
        text = "".join(rng.choice(["12", "7.", "a@b.de", " ", "+1 ", "(", ")", "-", "x9", "key=", "2024"]) for _ in range(rng.randrange(1, 70)))
        z = pii.lattice(text, 0, len(text))
        want = [(z.places[i][0], z.places[j - 1][1], kind) for i, j, kind in pii.best_spans(z, weights)]
        for block in (1, 5, 256):
            assert sorted(pii.spans_of_zone(text, 0, len(text), weights, block)) == sorted(want)


def test_long_zone_of_numbers():
    weights = pii.fit_weights(pii.variants(random.Random(3)), epochs=1)
    base, spans = pii.all_spans("12 345.6 " * 2_000 + "mail jane@example.org", weights)
    assert ("email", 18_005, 18_021) in base and set(base) <= set(spans)
