"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 9).

Zones of a text are its runs of chunks that hold a digit or an at sign. Within
a zone every span of up to ``MAX_TOKENS`` tokens is a candidate for every kind;
features look at the whole span and its surroundings. Segmentations of a zone
are scored by the sum over their spans; a dynamic program picks the best one,
so that boundaries and kinds are chosen together. Outside of zones a text has
no candidates. The weights are fitted by likelihood on zones of the documents
themselves, marked by the patterns, and on written variants of them.
"""

from __future__ import annotations

import array
import bisect
import dataclasses
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.llm.rows import per_document

# Patterns of the base search.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A keyed secret; marks training zones only.
SECRET = re.compile(r"(?i)\b(?:token|api[_-]?key|secret|password)\s*[=:]\s*[\"']?([0-9A-Za-z_-]{20,})")

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 16
#: Tokens whose candidates are scored at once.
BLOCK_TOKENS = 256
#: Documents (about) whose zones the fit looks at, and zones it uses.
SAMPLE_DOCS, SAMPLE_ZONES = 20_000, 2_500
TRAIN_TOKENS = 60
EPOCHS = 8
SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_spans bigint"
)

_HIT = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
_CONTEXT = 24

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """The matches of the four patterns, each kind leftmost and without overlaps; failing matches are dropped."""
    if not text or _HIT.search(text) is None:
        return []
    out: list[Span] = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def zones(text: str | None) -> list[tuple[int, int]]:
    """Maximal runs of chunks with a digit or an at sign, as places in the text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    end = -1
    for m in _HIT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        found = _SPACE.search(text, m.end())
        end = found.start() if found else len(text)
        if out and start - out[-1][1] <= 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


FEATURES = (
    "bias", "email_shape", "at_signs_1", "at_signs_more", "ip_shape", "octets", "four_numbers", "luhn_16_19",
    "luhn_13_15", "digits_13_19", "digits_16_19_no_luhn", "phone_plus", "phone_digits", "phone_groups", "brackets",
    "single_token", "hex_long", "mixed_long", "key_before", "after_equals", "quoted", "only_digits", "digits_1_4",
    "digits_5_7", "digits_20_up", "has_letters", "dots_1", "dots_3", "dots_more", "dashes", "spaces", "cut_left",
    "cut_right", "left_joins", "right_joins", "starts_mark", "ends_mark", "word_before_contact", "tokens_1_3",
    "tokens_8_up", "date_shape", "plus_inside",
)
_EMAIL_ALL = re.compile(r"[^\s@]+@[^\s@]+\.[^\W\d_]{2,}")
_IP_ALL = re.compile(r"[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}")
_DATE_ALL = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
_KEY_WORD = re.compile(r"(?i)(?:token|key|secret|password)\W*$")
_CONTACT = re.compile(r"(?i)(?:phone|tel|call|mobile|fax)\W*$")


def _features(text: str, start: int, end: int, n_tokens: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - _CONTEXT):start], text[end:end + 1]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    marks = set(span)
    numbers = span.split(".") if marks <= set("0123456789.") else []
    ok = luhn(digits) if 13 <= n <= 19 else False
    pure = not letters and "@" not in marks
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    return [
        1, bool(_EMAIL_ALL.fullmatch(span)), span.count("@") == 1, span.count("@") > 1, bool(_IP_ALL.fullmatch(span)),
        len(numbers) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in numbers), len(groups) == 4 and pure,
        pure and ok and n > 15, pure and ok and n < 16, pure and 13 <= n <= 19, pure and 16 <= n <= 19 and not ok,
        span[0] == "+", pure and 8 <= n <= 15 and not marks & set(":/,"), pure and 3 <= len(groups) <= 5
        and all(len(g) <= 5 for g in groups) and len(groups[-1]) >= 3, "(" in marks and ")" in marks,
        n_tokens == 1, n_tokens == 1 and len(span) >= 24 and all(c in "0123456789abcdefABCDEF" for c in span),
        len(span) >= 20 and n > 3 and letters > 3, bool(_KEY_WORD.search(before)), before.rstrip("\"' ")[-1:] in ("=", ":"),
        bool(before) and before[-1] in "\"'" and after == before[-1], n == len(span), 1 <= n <= 4, 5 <= n <= 7, n >= 20,
        letters > 0, span.count(".") == 1, span.count(".") == 3, span.count(".") > 3, "-" in marks,
        any(c.isspace() for c in marks), bool(before) and before[-1].isalnum(), after.isalnum(),
        bool(before) and before[-1] in ".-@+_%", after in tuple("-@_") , not span[0].isalnum() and span[0] not in "+(",
        not span[-1].isalnum(), bool(_CONTACT.search(before)), n_tokens <= 3, n_tokens >= 8,
        bool(_DATE_ALL.fullmatch(span)), "+" in span[1:],
    ]


@dataclasses.dataclass
class Lattice:
    """A zone's tokens and candidate spans; ``ends[j]`` lists the candidates that end before token j."""

    places: list[tuple[int, int]]
    first: np.ndarray
    last: np.ndarray
    x: np.ndarray
    ends: list[list[int]]


def lattice(text: str, start: int, end: int) -> Lattice:
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    blank = [text[a].isspace() for a, _ in places]
    hit = [_HIT.search(text, a, b) is not None for a, b in places]
    first, last, rows = [], [], []
    ends: list[list[int]] = [[] for _ in range(len(places) + 1)]
    for i in range(len(places)):
        if blank[i]:
            continue
        holds = False
        for j in range(i, min(i + MAX_TOKENS, len(places))):
            holds = holds or hit[j]
            if holds and not blank[j]:
                ends[j + 1].append(len(first))
                first.append(i)
                last.append(j + 1)
                rows.append(_features(text, places[i][0], places[j][1], j + 1 - i))
    x = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
    return Lattice(places, np.array(first, dtype=int), np.array(last, dtype=int), x, ends)


def best_spans(z: Lattice, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the best segmentation; every token outside scores 0."""
    if not len(z.first):
        return []
    scores = z.x @ weights
    kind = scores.argmax(1)
    top = scores.max(1).tolist()
    starts = z.first.tolist()
    best, back = [0.0], [-1]
    for j in range(1, len(z.places) + 1):
        value, by = best[j - 1], -1
        for s in z.ends[j]:
            other = best[starts[s]] + top[s]
            if other > value:
                value, by = other, s
        best.append(value)
        back.append(by)
    out, j = [], len(z.places)
    while j > 0:
        s = back[j]
        if s < 0:
            j -= 1
        else:
            out.append((starts[s], j, int(kind[s])))
            j = starts[s]
    return out[::-1]


def spans_of_zone(text: str, start: int, end: int, weights: np.ndarray, block: int = BLOCK_TOKENS) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of :func:`best_spans`, places in ``text``; the candidates are scored and dropped block by block.

    A candidate has at most ``MAX_TOKENS`` tokens, so what a long zone keeps is
    a score and a step back for each token.
    """
    begins, stops = array.array("q"), array.array("q")
    for m in _TOKEN.finditer(text, start, end):
        begins.append(m.start())
        stops.append(m.end())
    n = len(begins)
    best, back, kinds = array.array("d", [0.0]) * (n + 1), array.array("q", [-1]) * (n + 1), bytearray(n + 1)
    waiting: dict[int, list[tuple[int, float, int]]] = {}
    for low in range(0, n, block):
        high = min(low + block, n)
        near = range(low, min(high + MAX_TOKENS, n))
        blank = {j: text[begins[j]].isspace() for j in near}
        hit = {j: _HIT.search(text, begins[j], stops[j]) is not None for j in near}
        found, rows = [], []
        for i in range(low, high):
            holds = False
            for j in range(i, min(i + MAX_TOKENS, n)) if not blank[i] else ():
                holds = holds or hit[j]
                if holds and not blank[j]:
                    found.append((i, j + 1))
                    rows.append(_features(text, begins[i], stops[j], j + 1 - i))
        if rows:
            scores = np.array(rows, dtype=float) @ weights
            for (i, j), top, kind in zip(found, scores.max(1).tolist(), scores.argmax(1).tolist()):
                waiting.setdefault(j, []).append((i, top, kind))
        for j in range(low + 1, high + 1):
            best[j] = best[j - 1]
            for i, top, kind in waiting.pop(j, ()):
                if best[i] + top > best[j]:
                    best[j], back[j], kinds[j] = best[i] + top, i, kind
    j = n
    while j > 0:
        i = back[j]
        if i >= 0:
            yield begins[i], stops[j - 1], kinds[j]
        j = i if i >= 0 else j - 1


def _log_sum(values: np.ndarray) -> float:
    top = values.max()
    return float(top + np.log(np.exp(values - top).sum()))


def _gradient(z: Lattice, gold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Observed minus expected features; ``gold`` has the kind of each candidate, -1 for none."""
    scores = z.x @ weights
    top = scores.max(1)
    share = np.exp(scores - top[:, None])
    mass = share.sum(1)
    span = (top + np.log(mass)).tolist()
    n, starts, stops = len(z.places), z.first.tolist(), z.last.tolist()
    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        if z.ends[j]:
            ahead[j] = _log_sum(np.array([ahead[j - 1], *(ahead[starts[s]] + span[s] for s in z.ends[j])]))
        else:
            ahead[j] = ahead[j - 1]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for s, i in enumerate(starts):
        by_start[i].append(s)
    behind = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if by_start[i]:
            behind[i] = _log_sum(np.array([behind[i + 1], *(span[s] + behind[stops[s]] for s in by_start[i])]))
        else:
            behind[i] = behind[i + 1]
    a, b, s = np.array(ahead), np.array(behind), np.array(span)
    expected = np.exp(a[z.first] + s + b[z.last] - ahead[n])[:, None] * share / mass[:, None]
    observed = np.zeros_like(expected)
    marked = np.flatnonzero(gold >= 0)
    observed[marked, gold[marked]] = 1
    return z.x.T @ (observed - expected)


def marked_zones(text: str | None) -> list[tuple[str, int, int, list[Span]]]:
    """(surroundings, start, end, spans) of each zone, by the patterns; places are in the surroundings."""
    found = base_spans(text) + [("secret", *m.span(1)) for m in SECRET.finditer(text or "")]
    out = []
    for a, b in zones(text):
        left = max(0, a - _CONTEXT)
        inside = sorted((k, s - left, e - left) for k, s, e in found if a <= s and e <= b)
        out.append((text[left:b + 2], a - left, b - left, inside))
    return out


def variants(rng: random.Random) -> list[tuple[str, int, int, list[Span]]]:
    """Written zones: spellings the patterns don't know, and numbers that are no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = []

    def zone(before: str, span: str, after: str, kind: str | None) -> None:
        made.append((before + span + after, len(before), len(before) + len(span),
                     [(kind, len(before), len(before) + len(span))] if kind else []))

    for _ in range(60):
        a, b, c = "2" + number(2), number(3), number(4)
        for text in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"{a} {b} {c}"):
            zone("call ", text, " ", "phone")
        card = "4" + number(14)
        card += next(d for d in "0123456789" if luhn(card + d))
        for glue in (".", " ", "/"):
            zone("paid ", glue.join(card[i:i + 4] for i in range(0, 16, 4)), " ", "card")
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        for text in (wrong, number(rng.randint(1, 7)), f"20{number(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
                     f"{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"{rng.randint(1, 9)}.{number(1)}.{number(2)}",
                     f"{rng.randint(1, 23)}:{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"x{number(3)}",
                     f"{rng.randint(300, 999)}.{number(3)}.{number(2)}.{number(3)}", number(rng.randint(20, 30)), f"{number(2)}%"):
            zone("in ", text, " ", None)
    return made


def fit_weights(examples: list[tuple[str, int, int, list[Span]]], epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights by stochastic likelihood steps; the same examples give the same weights."""
    data = []
    for text, a, b, spans in examples:
        z = lattice(text, a, b)
        if not len(z.first) or len(z.places) > TRAIN_TOKENS:
            continue
        wanted = {(s, e): KINDS.index(k) for k, s, e in spans}
        places = [(z.places[i][0], z.places[j - 1][1]) for i, j in zip(z.first, z.last)]
        data.append((z, np.array([wanted.get(p, -1) for p in places])))
    weights, seen = np.zeros((len(FEATURES), len(KINDS))), np.full((len(FEATURES), len(KINDS)), 1e-3)
    weights[0] = -2.0
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for z, gold in data:
            step = _gradient(z, gold, weights) - 1e-4 * weights
            seen += step * step
            weights += 0.3 * step / np.sqrt(seen)
    return weights


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_zones: int = SAMPLE_ZONES) -> np.ndarray:
    """The weights for ``docs`` (``doc_id text``).

    About ``sample_docs`` documents, by a hash of the id, give their zones; at
    most ``sample_zones`` of them, by a hash of the zone, are used.
    """
    place = (F.xxhash64("doc_id", F.lit("zones")) % 1_000_000 + 1_000_000) % 1_000_000
    share = min(1.0, sample_docs / max(docs.select("doc_id").count(), 1))
    sample = docs.where(place < share * 1_000_000)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            found = [z for t in batch["text"].to_pylist() for z in marked_zones(t) if z[2] - z[1] < 400]
            return {
                "text": [z[0] for z in found], "first": [z[1] for z in found], "last": [z[2] for z in found],
                "spans": [[{"kind": k, "s": s, "e": e} for k, s, e in z[3]] for z in found],
            }

        return work

    schema = "text string, first int, last int, spans array<struct<kind:string,s:int,e:int>>"
    rows = (
        per_document(sample, ["text"], start, schema).distinct()
        .orderBy(F.xxhash64("text", "first", "last"), "text", "first").limit(sample_zones).collect()
    )
    examples = [(r["text"], r["first"], r["last"], [tuple(s) for s in r["spans"]]) for r in rows]
    return fit_weights(examples + variants(random.Random(3)))


def all_spans(text: str | None, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text; a span of the model stands only where no base span does."""
    base = base_spans(text)
    out = list(base)
    # Base spans by their start, with the largest end up to each: whether one reaches into a span is one look-up.
    edges = sorted((x, y) for _, x, y in base)
    reach = list(itertools.accumulate((y for _, y in edges), max))
    for a, b in zones(text):
        for s, e, kind in spans_of_zone(text, a, b, weights):
            before = bisect.bisect_left(edges, (e,))
            if not before or reach[before - 1] <= s:
                out.append((KINDS[kind], s, e))
    order = lambda span: (KINDS.index(span[0]), span[1], span[2])
    return sorted(base, key=order), sorted(out, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per row of ``docs`` (``doc_id text``), in the columns of ``SCHEMA``.

    Places are code points, ends exclusive. A null text counts as empty and has
    no spans. Base spans of different kinds may overlap, as each kind is
    searched on its own; spans of the model overlap nothing. Repeated rows are
    answered one by one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        known = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("base_sha256", "spans", "n_spans", *(f"n_{k}" for k in BASE_KINDS))}
            for text in batch["text"].to_pylist():
                base, spans = all_spans(text, known)
                kinds = [k for k, _, _ in base]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(spans))
                out["n_spans"].append(len(spans))
            return out | {"doc_id": batch["doc_id"]}

        return work

    return per_document(docs, [F.col("doc_id").cast("bigint"), "text"], start, SCHEMA)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first and longest stays."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        elif e > at:
            out.append(f"[{kind.upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redactor(spark, weights: np.ndarray):
    """A column function text -> text without personal data."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([redact(t, all_spans(t, known)[1]) if isinstance(t, str) else None for t in texts], dtype=object)

    return clean


def op9_pii(spark, folder: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return find(docs, fit(docs))
