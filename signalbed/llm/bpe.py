"""BPE encoding and decoding with a minimal acyclic transducer of frequent words (operator 8).

The frequent words of the corpus are counted, merged once, and compiled into a
minimal acyclic automaton with shared suffixes. Its edges carry numbers that
add up to the rank of the word, and the rank finds the ids. The automaton is
one file that every executor gets from Spark and maps into memory. A word the
automaton doesn't hold is merged in full by the ranks of the vocabulary, so the
ids never depend on which words were counted as frequent.
"""

from __future__ import annotations

import array
import dataclasses
import functools
import hashlib
import heapq
import json
import mmap
import struct
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalbed.llm.rows import per_document
from signalbed.session import cut_lineage

#: Frequent words of the lexicon; a speed setting, the ids do not depend on it.
LEXICON_WORDS = 60_000
#: Words a Python worker remembers beside the lexicon.
REMEMBERED = 500_000
#: Characters of the longest word that is remembered, and letters from which a word is merged by a heap.
REMEMBERED_CHARS, LONG_WORD = 64, 200
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_MAGIC = b"LEX1"
NEVER = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others get the letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """What the tokenizer file says, in the form that encoding and decoding need."""

    ids: dict[str, int]
    ranks: dict[int, int]
    tokens: tuple[str, ...]
    special: dict[str, int]
    split: regex.Pattern
    rules: Tokenizer
    special_split: regex.Pattern | None
    ending: str

    def words(self, text: str | None) -> list[str | int]:
        """The pieces of a whole text: words in byte letters, and the ids of special tokens."""
        if not text:
            return []
        parts = self.special_split.split(text) if self.special_split else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out.extend(self.split.findall(part.lower()))
            elif part and _RARE.search(part) is None:
                out.extend(self.split.findall(unicodedata.normalize("NFC", part).lower()))
            elif part:
                out.extend(self.rare_words(part))
        return out

    def chunks(self, text: str | None) -> list[str] | None:
        """A text cut at white space, normalized; None where white space isn't enough and ``words`` has to cut.

        The pieces of a chunk are ``split.findall(chunk)``: no piece goes over white space.
        """
        if not text:
            return []
        if _RARE.search(text) is not None or any(t in text for t in self.special):
            return None
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()

    def rare_words(self, text: str) -> list[str]:
        """The words of a text with letters whose class depends on the Unicode version: split by the file's own rules."""
        found = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [bytes(map(_BYTES.__getitem__, word)).decode() for word, _ in found]

    def letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(_LETTERS.__getitem__, word.encode()))

    def merge(self, word: str) -> list[int]:
        """The ids of one word by the merges, lowest rank first and leftmost of equals."""
        letters, ids, ranks = self.letters(word), self.ids, self.ranks
        parts = [ids[c] for c in letters[:-1]]
        parts.append(ids[letters[-1] + self.ending])
        # Each neighbour pair's rank and result in one integer; NEVER sorts behind all of them.
        pairs = [ranks.get(a << 16 | b, NEVER) for a, b in zip(parts, parts[1:])]
        if len(pairs) > LONG_WORD:
            return self._merge_long(parts, pairs)
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            made = parts[i] = best & 0xFFFF
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] << 16 | made, NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(made << 16 | parts[i + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[int | None], pairs: list[int]) -> list[int]:
        """The same merges over a linked list, the next one from a heap: n log n for a word of n letters."""
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [*pairs, NEVER]
        heap = [(pair, i) for i, pair in enumerate(pairs) if pair != NEVER]
        heapq.heapify(heap)
        while heap:
            pair, i = heapq.heappop(heap)
            if pairs[i] != pair:  # has changed since
                continue
            gone = after[i]
            parts[i], parts[gone], pairs[gone] = pair & 0xFFFF, None, NEVER
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left < 0:
                    continue
                pairs[left] = ranks.get(parts[left] << 16 | parts[right], NEVER) if right < n else NEVER
                if pairs[left] != NEVER:
                    heapq.heappush(heap, (pairs[left], left))
        return [part for part in parts if part is not None]


_LETTERS = byte_letters()
_BYTES = {letter: byte for byte, letter in _LETTERS.items()}
#: Beyond the Latin blocks (and some common marks) classes and case rules differ between Unicode versions; so does
#: white space among the separators before the space.
_RARE = regex.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")


@functools.lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids: dict[str, int] = model["vocab"]
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault(ids[left] << 16 | ids[right], rank << 16 | ids[left + right])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = token
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    either = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
    return Vocabulary(
        ids, ranks, tuple(tokens), special, regex.compile(pattern), Tokenizer.from_file(path),
        regex.compile(f"({either})") if special else None, model["end_of_word_suffix"] or "",
    )


# The lexicon -------------------------------------------------------------------------------------------------------


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def key(self) -> tuple:
        return self.final, tuple((label, id(target)) for label, target in self.edges.items())


def _minimal(words: list[bytes]) -> _State:
    """The minimal acyclic automaton of words in byte order, built word by word."""
    root, known = _State(), {}
    path: list[tuple[_State, int, _State]] = []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            parent.edges[label] = known.setdefault(child.key(), child)

    before = b""
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else root
        for label in word[common:]:
            child = _State()
            state.edges[label] = child
            path.append((state, label, child))
            state = child
        state.final = True
        before = word
    settle(0)
    return root


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer of word -> ids as the bytes of its file.

    Words of one rank order are numbered; every edge carries how many words
    come before those behind it, so that a walk adds up to the rank.
    """
    by_bytes = {w.encode(): ids for w, ids in entries.items()}
    words = sorted(by_bytes)
    root = _minimal(words)
    states: list[_State] = []
    stack: list[tuple[_State, bool]] = [(root, False)]
    while stack:  # targets before sources, for the counts
        state, done = stack.pop()
        if done:
            state.words = state.final + sum(t.words for t in state.edges.values())
            if state.number < 0:
                state.number = len(states)
                states.append(state)
        elif state.number < 0:
            stack.append((state, True))
            stack.extend((t, False) for t in state.edges.values() if t.number < 0)
    first, labels, targets, adds = [0], [], [], []
    for state in states:
        before = int(state.final)
        for label, target in sorted(state.edges.items()):
            labels.append(label)
            targets.append(target.number)
            adds.append(before)
            before += target.words
        first.append(len(labels))
    places = np.cumsum([0, *(len(by_bytes[w]) for w in words)]).astype("<u4")
    parts = [
        np.array(first, "<u4"), np.array(targets, "<u4"), np.array(adds, "<u4"), places,
        np.array([i for w in words for i in by_bytes[w]], "<u4"),
        np.array([s.final for s in states], "u1"), np.array(labels, "u1"),
    ]
    head = struct.pack("<4sI8I", _MAGIC, root.number, *(len(p) for p in parts), 0)
    return head + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The file, mapped; nothing of it is copied until it is read."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        magic, self.root, *lengths = struct.unpack_from("<4sI8I", view)
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        at, out = struct.calcsize("<4sI8I"), []
        for i, n in enumerate(lengths[:7]):
            size = n * (4 if i < 5 else 1)
            out.append(view[at:at + size].cast("I" if i < 5 else "B"))
            at += size
        self.first, self.targets, self.adds, self.places, self.ids, self.final, self.labels = out

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, word: str) -> bytes | None:
        """The ids of ``word`` as little-endian 32-bit integers, None if it isn't held."""
        state, rank = self.root, 0
        first, labels = self.first, self.labels
        for byte in word.encode("utf-8", "surrogatepass"):
            low, high = first[state], first[state + 1]
            while low < high:  # the labels of a state are in order
                middle = (low + high) // 2
                if labels[middle] < byte:
                    low = middle + 1
                else:
                    high = middle
            if low == first[state + 1] or labels[low] != byte:
                return None
            rank += self.adds[low]
            state = self.targets[low]
        return bytes(self.ids[self.places[rank]:self.places[rank + 1]]) if self.final[state] else None


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str | int, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # Decoding joins tokens by a space (the file names no decoder).
        self.decoded = [t.encode() for t in vocabulary.tokens]

    def _word(self, word: str | int) -> bytes:
        if isinstance(word, int):
            found = struct.pack("<I", word)
        else:
            found = self.lexicon.look_up(word) if self.lexicon else None
            if found is None:
                found = array.array("I", self.vocabulary.merge(word)).tobytes()
        return self._keep(self.known, word, found)

    def _chunk(self, chunk: str) -> bytes:
        words = self.vocabulary.split.findall(chunk)
        if len(words) == 1:
            return self._keep(self.chunks, chunk, self.known.get(words[0]) or self._word(words[0]))
        return self._keep(self.chunks, chunk, b"".join([self.known.get(w) or self._word(w) for w in words]))

    @staticmethod
    def _keep(known: dict, key: str | int, found: bytes) -> bytes:
        if isinstance(key, int) or len(key) <= REMEMBERED_CHARS:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, little-endian."""
        chunks = self.vocabulary.chunks(text)
        if chunks is None:
            get, make, pieces = self.known.get, self._word, self.vocabulary.words(text)
        else:
            get, make, pieces = self.chunks.get, self._chunk, chunks
        return b"".join([get(p) or make(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, special tokens included."""
        return b" ".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


# On Spark ----------------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, vocabulary_path: str, keep: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all of ``docs``, at most ``keep``.

    Tasks add up their words before the shuffle. The words are counted by steps
    of frequency, and all words of the steps that fit are taken.
    """

    def start():
        vocabulary = load_vocabulary(vocabulary_path)

        def work(batch: pa.RecordBatch) -> dict:
            chunks: Counter = Counter()
            tally: Counter = Counter()
            for text in batch["text"].to_pylist():
                found = vocabulary.chunks(text)
                if found is None:
                    tally.update(w for w in vocabulary.words(text) if isinstance(w, str))
                else:
                    chunks.update(found)
            for chunk, n in chunks.items():
                for word in vocabulary.split.findall(chunk):
                    tally[word] = tally.get(word, 0) + n
            return {"word": list(tally), "n": list(tally.values())}

        return work

    counts = cut_lineage(
        per_document(docs, ["text"], start, "word string, n bigint", rows_at_once=20_000).groupBy("word").agg(F.sum("n").alias("n"))
        .withColumn("size", F.floor(F.log2("n") * 16))
    )
    sizes = counts.groupBy("size").count().orderBy(F.desc("size")).collect()
    least, total = None, 0
    for row in sizes:  # a few hundred steps of frequency, largest first
        total += row["count"]
        if total > keep:
            break
        least = row["size"]
    return [r["word"] for r in counts.where(F.col("size") >= least).select("word").collect()] if least is not None else []


def publish(spark: SparkSession, data: bytes) -> str:
    """Put a file before every executor: written to the shared folder, sent out by Spark; returns its name."""
    context = spark.sparkContext
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm = context._jvm
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        cut_lineage(spark.range(1))  # sets a folder on a local master, or says what is missing
        folder = context.getCheckpointDir()
    path = jvm.org.apache.hadoop.fs.Path(folder, name)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(path):
        out = system.create(path, True)
        out.write(bytearray(data))
        out.close()
    context.addFile(system.makeQualified(path).toString())
    return name


def encoder_factory(spark: SparkSession, docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS):
    """A function that makes the encoder in a worker; the lexicon is compiled from the words of ``docs``."""
    vocabulary = load_vocabulary(vocabulary_path)
    entries = {w: vocabulary.merge(w) for w in frequent_words(docs, vocabulary_path, words)}
    name = publish(spark, compile_lexicon(entries))

    def make() -> Encoder:
        return Encoder(load_vocabulary(vocabulary_path), Lexicon.open(SparkFiles.get(name)))

    return make


def encode(
    docs: DataFrame, vocabulary_path: str | None = None, words: int = LEXICON_WORDS, decoded: bool = True
) -> DataFrame:
    """``doc_id``, ``ids`` (array) and, if wanted, ``decoded`` of every row of ``docs`` (``doc_id text``).

    A null or empty text has no ids and decodes to an empty text. Repeated rows
    are answered one by one; other columns are ignored.
    """
    make = encoder_factory(docs.sparkSession, docs, vocabulary_path or default_vocabulary(), words)

    def start():
        encoder = make()

        def work(batch: pa.RecordBatch) -> dict:
            ids = [encoder.encode(t) for t in batch["text"].to_pylist()]
            out = {"doc_id": batch["doc_id"], "ids": [np.frombuffer(i, "<i4") for i in ids]}
            return out | {"decoded": [encoder.decode(i).decode() for i in ids]} if decoded else out

        return work

    columns = [F.col("doc_id").cast("bigint"), "text"]
    return per_document(docs, columns, start, "doc_id bigint, ids array<int>" + ", decoded string" * decoded)


def digests(docs: DataFrame, vocabulary_path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """``encode`` where only the number of ids and the digests of ids and decoded text are wanted."""
    make = encoder_factory(docs.sparkSession, docs, vocabulary_path or default_vocabulary(), words)

    def start():
        encoder = make()

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"].to_pylist():
                ids = encoder.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            return out | {"doc_id": batch["doc_id"]}

        return work

    return per_document(docs, [F.col("doc_id").cast("bigint"), "text"], start, SCHEMA)


def op8_bpe(spark, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(spark.read.parquet(f"{folder}/documents.parquet"))
