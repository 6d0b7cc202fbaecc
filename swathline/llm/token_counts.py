r"""Token counts by a map-side look-up in two tiers.

The first tier is a compact hash table of frequent pre-tokens with their numbers
of tokens: open addressing over 64-bit digests, in a few integer arrays, with the
pre-tokens' bytes to confirm a hit. It is broadcast; its size is bounded by the
number of pre-tokens (``most``) times their length (``LONGEST``). A task splits its
texts into pre-tokens and probes the distinct ones of a portion all at once. What
misses goes to the second tier, a cache that a Python worker keeps from task to
task, and what that misses is encoded. Counting itself has no shuffle.

The frequent pre-tokens come from the whole corpus by mergeable summaries: a task
counts what stands between spaces and, whenever it holds more than four times
``most`` of them, takes the (most + 1)-th largest count off all and drops what is
left without one. It gives out one such summary, in one row, and Spark adds up a
bounded number of summaries at a time, in rounds, until one is left. Whatever has
more than 1 / (most + 1) of all pre-tokens is in it. Only the speed depends on the
table: counts are exact with any.

Counts are those of the tokenizers library with its defaults: the text of a
special token is one token.

Edge cases: a null or empty text has no tokens; long texts are split in stretches
that end at a border of pre-tokens; a pre-token of any length is counted whole,
those over ``LONGEST`` bytes are neither in the table nor kept; a null ``doc_id``
is carried through; equal rows give equal rows; an empty table gives an empty
one; other columns play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPECIAL, Splitter, Vocabulary
from .common import held, portions, stretches, texts_of, written

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SUMMARY = "part bigint, words binary"
#: Bytes of a pre-token in the table or in a worker's cache.
LONGEST = 64
#: Pre-tokens that a worker's cache holds.
CACHED = 250_000
#: Summaries that one task adds up.
FAN = 32


# ---- the table of frequent pre-tokens --------------------------------------------------------------------------


class FrequentLengths:
    """A hash table from bytes to a small number, as arrays: slots of (digest, entry), and entries of (start, end, number)."""

    def __init__(self, words: list[bytes], numbers: Iterable[int]):
        size = 1 << max(3, (2 * len(words)).bit_length())  # at most half full
        self.start = np.cumsum([0, *map(len, words)])
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.number = np.array(list(numbers), np.int32)
        self.digest = np.zeros(size, np.uint64)
        self.entry = np.full(size, -1, np.int32)
        digests = digests_of(words)
        left, step = np.arange(len(words)), 0
        while len(left):  # all that still look for a slot, one step further on each time; the first in a slot has it
            slot = self._slot(digests[left], step)
            free = self.entry[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            got = np.flatnonzero(free)[first]
            self.entry[slot[got]], self.digest[slot[got]] = left[got], digests[left[got]]
            left, step = np.delete(left, got), step + 1

    def _slot(self, digests: np.ndarray, step: int) -> np.ndarray:
        return ((digests + np.uint64(step)) & np.uint64(len(self.entry) - 1)).astype(np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't held."""
        out = np.full(len(words), -1, np.int64)
        digests = digests_of(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lens) - lens
        left, step = np.arange(len(words)), 0
        while len(left):
            slot = self._slot(digests[left], step)
            entry = self.entry[slot]
            hit = (entry >= 0) & (self.digest[slot] == digests[left])
            who, what = left[hit], entry[hit]
            same = self.start[what + 1] - self.start[what] == lens[who]
            who, what, hit = who[same], what[same], np.flatnonzero(hit)[same]
            # Bytes of candidates beside those of the entries.
            n = lens[who]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = flat[np.repeat(first[who], n) + inside] == self.blob[np.repeat(self.start[what], n) + inside]
            wrong = np.bincount(np.repeat(np.arange(len(who)), n)[~equal], minlength=len(who))
            out[who[wrong == 0]] = self.number[what[wrong == 0]]
            go = entry >= 0  # an empty slot ends the search
            go[hit[wrong == 0]] = False
            left, step = left[go], step + 1
        return out


def digests_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


# ---- frequent pre-tokens of a corpus ---------------------------------------------------------------------------


def reduced(counts: Counter, most: int) -> Counter:
    """At most ``most`` of the counted, each by the (most + 1)-th largest count less."""
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return Counter({w: n - off for w, n in counts.items() if n > off})


def _packed(counts: Counter) -> bytes:
    return zlib.compress("\n".join(f"{n} {w}" for w, n in counts.items()).encode("utf-8", "replace"), 1)


def _unpacked(packed: bytes) -> Counter:
    """Words have no line feed, as pre-tokens with one are left out."""
    return Counter({w: int(n) for n, _, w in (line.partition(" ") for line in zlib.decompress(packed).decode().split("\n") if line)})


def frequent(docs: DataFrame, vocabulary: Vocabulary, most: int = 50_000) -> list[bytes]:
    """The frequent pre-tokens of all texts, at most ``most``, sorted."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        splitter = Splitter(vocabulary)
        runs: Counter = Counter()
        for pdf in batches:
            for text in texts_of(pdf["text"]):
                for stretch in stretches(text):
                    runs.update(r for r in stretch.split(" ") if len(r) <= 4 * LONGEST)
                    if len(runs) > 4 * most:
                        runs = reduced(runs, most)
        words: Counter = Counter()
        for run, n in runs.items():
            for w in splitter.words(" " + run):
                if len(w) <= LONGEST and "\n" not in w:
                    words[w] += n
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "words": [_packed(reduced(words, most))]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for words in pdf["words"]:  # at most FAN summaries
            total.update(_unpacked(words))
        return pd.DataFrame({"part": [key[0]], "words": [_packed(reduced(total, most))]})

    summaries = written(docs.select("text").mapInPandas(summarise, _SUMMARY))
    parts = summaries.agg(F.max("part")).first()[0]
    while parts:
        summaries = written(summaries.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(add, _SUMMARY))
        parts //= FAN
    last = summaries.first()  # one row of at most ``most`` pre-tokens
    found = _unpacked(last.words) if last else {}
    return sorted(b for w in found if len(b := w.encode()) <= LONGEST)


# ---- counting --------------------------------------------------------------------------------------------------


class Lengths:
    """Numbers of tokens of pre-tokens, in one worker. ``asked``: distinct pre-tokens of portions, those the table had, and those encoded."""

    def __init__(self, vocabulary: Vocabulary, table: FrequentLengths):
        self.vocabulary, self.table, self.splitter = vocabulary, table, Splitter(vocabulary)
        self.kept: dict[bytes, int] = {}
        self.asked = np.zeros(3, np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each of the distinct ``words`` has."""
        out = self.table.of(words)
        missed = np.flatnonzero(out < 0)
        out[missed] = [self.kept.get(words[i], -1) for i in missed.tolist()]
        new = missed[out[missed] < 0].tolist()
        out[new] = [len(ids) // 4 for ids in self.vocabulary.merge([words[i] for i in new])]
        for i in new:
            if len(words[i]) <= LONGEST and len(self.kept) < CACHED:
                self.kept[words[i]] = int(out[i])
        self.asked += (len(words), len(words) - len(missed), len(new))
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        pieces = [(i, s) for i, t in enumerate(texts) for s in stretches(t)]
        for a, b in portions([s for _, s in pieces]):
            number: dict[str, int] = {}
            codes, owner = [], []
            for i, stretch in pieces[a:b]:
                words = self.splitter.parts(stretch)
                codes += [number.setdefault(w, len(number)) for w in words]
                owner.append((i, len(words)))
            special = np.array([w.startswith(SPECIAL) for w in number], bool)
            length = np.ones(len(number), np.int64)
            length[~special] = self.of([w.encode("utf-8", "replace") for w, s in zip(number, special, strict=True) if not s])
            who, lens = np.array(owner).T if owner else np.zeros((2, 0), np.int64)
            np.add.at(total, np.repeat(who, lens), length[np.array(codes, np.int64)])
        return total


def count_tokens(docs: DataFrame, limit: int = 512, vocabulary: Vocabulary | None = None, words: list[bytes] | None = None, most: int = 50_000) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text). ``words``: frequent pre-tokens, if they are known."""
    vocabulary = vocabulary or Vocabulary()
    words = frequent(docs, vocabulary, most) if words is None else sorted(set(words))
    table = FrequentLengths(words, (len(ids) // 4 for ids in vocabulary.merge(words)))
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, table))  # at most ``most`` pre-tokens of LONGEST bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = held(token, lambda: Lengths(*shared.value))
        for pdf in batches:
            n = lengths.count(texts_of(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).mapInPandas(run, SCHEMA)
