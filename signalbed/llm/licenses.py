"""License notices, exact and fuzzy (operator 6).

Base: the places where the words of a known phrase stand consecutively.
Fuzzy: a notice that may differ in ``k`` letters is cut into ``k + 1`` pieces.
If the notice occurs with at most ``k`` edits, one piece occurs unchanged, so
an automaton over all pieces finds every candidate; bounded-error matching then
verifies the edits in a window around it.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.llm.rows import per_document, plain_words

# Phrases of the base search and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices of the fuzzy search, in plain words, with their labels.
NOTICES = (
    ("licensed under the gnu general public license version", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this", "all-rights-reserved"),
)
#: Letters of a notice per allowed edit.
LETTERS_PER_EDIT = 12
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
)


def edits_allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length that make up the notice, each with its place."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def _machine(notices: tuple[tuple[str, str], ...]):
    """The automaton of all pieces and the bounded-error pattern of each notice."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, label) in enumerate(notices):
        edits = edits_allowed(notice)
        for at, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((i, at))
        # Word edges outside the fuzzy group: a match never begins or ends inside a word.
        patterns.append((regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice)}){{e<={edits}}}(?= )"), edits, notice, label))
    machine = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine, patterns


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES, phrases=PHRASES) -> tuple:
    """(words, base places [(word, label)], fuzzy spans [(label, first, last, edits)], score) of one whole text."""
    words = plain_words(text)
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in phrases:
        key = b" " + phrase.encode() + b" "
        at, counted, word = line.find(key), 0, 0
        while at >= 0:
            word, counted = word + line.count(b" ", counted, at), at
            base.append((word, label))
            at = line.find(key, at + 1)
    machine, patterns = _machine(notices)
    plain = line.decode("utf-8", "replace")
    windows: dict[int, list[list[int]]] = {}
    for end, (length, uses) in machine.iter(plain):
        for i, at in uses:
            _, edits, notice, _ = patterns[i]
            first = max(0, end + 1 - length - at - edits - 1)
            last = min(len(plain), end + 1 - length - at + len(notice) + edits + 1)
            seen = windows.setdefault(i, [])
            if seen and first <= seen[-1][1]:
                seen[-1][1] = max(seen[-1][1], last)
            else:
                seen.append([first, last])
    spans, score = [], 1.0 if base else 0.0
    for i, seen in sorted(windows.items()):
        pattern, _, notice, label = patterns[i]
        counted = blanks = 0
        for first, last in _joined(seen):
            for m in pattern.finditer(plain, first, last):
                edits = sum(m.fuzzy_counts)
                blanks, counted = blanks + plain.count(" ", counted, m.start()), m.start()
                a = blanks - 1
                spans.append((label, a, a + m.group().count(" "), edits))
                score = max(score, 1 - edits / len(notice))
    return len(words), base, sorted(set(spans)), score


def _joined(windows: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def find_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id text``), in the columns of ``SCHEMA``.

    ``n_base`` counts all base places, ``first_word`` and ``last_word`` are
    their smallest and largest start (null without any). ``labels`` joins base
    labels and those of the fuzzy matches, ``spans`` are the fuzzy matches by
    words (first and last included) with their edits, ``score`` is 1 for a base
    place, else the best 1 - edits / letters, else 0. A null text counts as
    empty: no words, no labels. Repeated rows are answered one by one; other
    columns are ignored.
    """
    notices, phrases = tuple(notices), tuple(phrases)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in (
                "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch["text"].to_pylist():
                n, base, spans, score = scan(text, notices, phrases)
                places, labels = [w for w, _ in base], {label for _, label in base}
                out["n_words"].append(n)
                out["n_base"].append(len(base))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {s[0] for s in spans})))
                out["score"].append(score)
                out["spans"].append([dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in spans])
            return out | {"doc_id": batch["doc_id"]}

        return work

    return per_document(docs, [F.col("doc_id").cast("bigint"), "text"], start, SCHEMA)


def op6_license_scan(spark, folder: str) -> DataFrame:
    """License notices of every document."""
    return find_licenses(spark.read.parquet(f"{folder}/documents.parquet"))
