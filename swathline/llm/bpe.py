r"""Byte-level BPE by a minimal acyclic transducer.

The corpus's words (the vocabulary's own split) are counted by Spark; the most
frequent ones, with their token ids, are compiled into a minimal automaton:
words enter in sorted order, states that have the same future are shared, and
every arc carries the number of words below it, so that the sum along a path is
the word's rank and the rank finds its ids. The automaton is a few integer
arrays, memory-mapped by every task from a file of its own. All words of a
batch walk it at once, a byte at a time. Words that it does not hold are merged
exactly, pair by pair in rank order, all together, and kept for the rest of the
task up to a bound. Decoding joins the bytes of the ids.

The result is that of the tokenizers library with its defaults: the text of a
special token gives its id.

Edge cases: a null or empty text has no ids, and decodes to the empty string;
very long words are merged like others; a null ``doc_id`` is carried through;
equal rows give equal rows; an empty table gives an empty one; other columns
play no part.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, texts_of, written

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Characters on whose classes all regular expression engines agree.
EVERYDAY = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞]*\Z")
SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


# ---- the vocabulary --------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a public byte-level BPE file."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        a, b, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.wide = len(self.bytes_of)
        keys = a * self.wide + b
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.pair_ids = keys[order], order.astype(np.int64), made[order]
        specials = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({specials})") if specials else None

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers: the pair of least rank, leftmost first, is merged until none is left. All words take a step at a time."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > 256:
                out[i] = self._merge_long(w)
            elif w:
                by_width.setdefault((len(w) + 7) // 8, []).append(i)
        for width, ids in by_width.items():
            at_once = max(1, 400_000 // (8 * width))
            for s in range(0, len(ids), at_once):
                part = ids[s : s + at_once]
                for i, got in zip(part, self._merge_matrix([words[i] for i in part]), strict=True):
                    out[i] = got
        return out

    def _merge_matrix(self, words: list[bytes]) -> list[bytes]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lens.max())
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = np.where(np.arange(width) < lens[:, None], self.byte_ids[flat], -1)
        live, result = np.arange(len(words)), np.full((len(words), width), -1)
        none = np.iinfo(np.int64).max
        rank, made = self._pairs(ids[:, :-1], ids[:, 1:])
        while len(live):
            least = rank.min(1, initial=none)
            done = least == none
            if done.any():
                result[live[done], : ids.shape[1]] = ids[done]
                go = ~done
                live, ids, lens, rank, made, least = live[go], ids[go], lens[go], rank[go], made[go], least[go]
                if not len(live):
                    break
            at = rank.argmin(1)  # the leftmost of that rank
            rows = np.arange(len(live))
            ids[rows, at] = made[rows, at]
            columns = np.arange(ids.shape[1] - 1)
            moved = np.where(columns > at[:, None], ids[:, 1:], ids[:, :-1])  # closes the gap behind the merged pair
            ids = moved
            columns = np.arange(ids.shape[1] - 1)
            rank = np.where(columns > at[:, None], rank[:, 1:], rank[:, :-1])
            made = np.where(columns > at[:, None], made[:, 1:], made[:, :-1])
            for k in (at - 1, at):  # only the pairs beside the merged one are new
                ok = (k >= 0) & (k < ids.shape[1] - 1)
                r, m = self._pairs(ids[rows[ok], k[ok]], ids[rows[ok], k[ok] + 1])
                rank[rows[ok], k[ok]], made[rows[ok], k[ok]] = r, m
        ends = [0, *(4 * np.cumsum((result >= 0).sum(1))).tolist()]
        flat = result[result >= 0].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair's merge; the largest integer where there is none."""
        keys = np.where((a >= 0) & (b >= 0), a * self.wide + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], np.iinfo(np.int64).max), self.pair_ids[at]

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long word, with a heap and linked neighbours."""
        import heapq

        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        none = np.iinfo(np.int64).max
        rank, made = self._pairs(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    if (ids[x], ids[y]) not in known:
                        r, k = self._pairs(np.array([ids[x]]), np.array([ids[y]]))
                        known[ids[x], ids[y]] = int(r[0]), int(k[0])
                    r, k = known[ids[x], ids[y]]
                    if r != none:
                        heapq.heappush(heap, (r, x, ids[x], ids[y], k))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Splitter:
    """Cuts text at special tokens and into the vocabulary's words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.exact = vocabulary, None

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if EVERYDAY.match(text):
            return SPLIT.findall(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.vocabulary.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str]:
        """Words and, at odd places, special tokens: as [words, special, words, ...] flattened with specials marked by a leading NUL pair."""
        cut = self.vocabulary.cut
        if cut is None or not cut.search(text):
            return self.words(text)
        out: list[str] = []
        for k, x in enumerate(cut.split(text)):
            if k % 2:
                out.append(SPECIAL + x)
            elif x:
                out += self.words(x)
        return out


#: Stands before a special token among words; no word of a split starts so, as NUL and a letter are never one word.
SPECIAL = "\0a\0"


# ---- the transducer --------------------------------------------------------------------------------------------


def compile_lexicon(words: Iterable[bytes], ids: Iterable[bytes]) -> bytes:
    """A minimal automaton of ``words`` (sorted, distinct), with their ids, as bytes to be memory-mapped.

    States whose outgoing arcs and finality are equal are one. Arcs are sorted by
    (state, byte); each has the number of words that pass before it, so the sum
    on a path is the word's place, and the place its ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # of the last word: final, arcs; the last arc's target is still open
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    for w in words:
        common = len(os.path.commonprefix([w, last]))
        close(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root is the last one
    count = np.zeros(len(states), np.int64)  # words from a state on; targets come before their sources
    keys, target, skip = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for b, t in arcs:
            keys.append(s * 256 + b)
            target.append(t)
            skip.append(n)
            n += count[t]
        count[s] = n
    ids = list(ids)
    lens = np.array([0, *map(len, ids)], np.int64)
    arrays = [
        np.array(keys, np.int64),
        np.array(target, np.int64),
        np.array(skip, np.int64),
        np.array([f for f, _ in states], np.int64),
        np.cumsum(lens),
    ]
    head = np.array([len(a) for a in arrays], np.int64)
    return b"".join([*(a.tobytes() for a in (head, *arrays)), *ids])


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed file."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing stays behind
            f.write(compiled)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(mapped, np.int64, 5)
        arrays, at = [], head.nbytes
        for n in head:
            arrays.append(np.frombuffer(mapped, np.int64, int(n), at))
            at += int(n) * 8
        self.keys, self.target, self.skip, self.final, self.first = arrays
        self.mapped, self.at = mapped, at

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't held. All words take a byte at a time."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(lens) - lens
        live = np.flatnonzero(lens > 0)
        state, place = np.full(len(live), len(self.final) - 1), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at, place = live[hit], at[hit], place[hit]
            state, place = self.target[at], place + self.skip[at]
            step += 1
            over = lens[live] == step
            ended = over & (self.final[state] == 1)
            out[live[ended]] = place[ended]
            live, state, place = live[~over], state[~over], place[~over]
        return out

    def ids_at(self, places: np.ndarray) -> list[bytes]:
        a, b = self.at + self.first[places], self.at + self.first[places + 1]
        return [self.mapped[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, vocabulary: Vocabulary, compiled: bytes, most: int = 250_000):
        self.vocabulary, self.lexicon, self.splitter, self.most = vocabulary, Lexicon(compiled), Splitter(vocabulary), most
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        size, waiting = 0, []
        for t in texts:
            waiting.append(self.splitter.parts(t))
            size += len(t)
            if size > 4_000_000:
                yield from self._encode(waiting)
                size, waiting = 0, []
        yield from self._encode(waiting)

    def _encode(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        new = list({w for words in split for w in words if w not in self.seen})
        special = [w for w in new if w.startswith(SPECIAL)]
        if special:
            new = [w for w in new if not w.startswith(SPECIAL)] + special
            self.seen.update((w, np.array([self.vocabulary.special[w.removeprefix(SPECIAL)]], "<u4").tobytes()) for w in special)
        own = new[: len(new) - len(special)]
        raw = [w.encode("utf-8", "replace") for w in own]
        places = self.lexicon.places(raw)
        found, unseen = np.flatnonzero(places >= 0), np.flatnonzero(places < 0).tolist()
        self.seen.update(zip([own[i] for i in found.tolist()], self.lexicon.ids_at(places[found]), strict=True))
        self.seen.update(zip([own[i] for i in unseen], self.vocabulary.merge([raw[i] for i in unseen]), strict=True))
        for words in split:
            yield np.frombuffer(b"".join(map(self.seen.__getitem__, words)), "<u4")
        over = len(self.seen) - self.most
        for w in new[max(0, len(new) - over) :] if over > 0 else ():  # the first words stay, as frequent ones are among them
            del self.seen[w]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


# ---- on Spark --------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int = 50_000) -> list[bytes]:
    """The most frequent words of up to 64 characters of all texts, ``most`` at most, sorted.

    Words of like counts, within one part in 23, go in together or not at all. A task counts what stands between spaces and cuts each distinct run into
    words once; Spark adds the tasks' counts up.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(vocabulary)

        def words(runs: Counter) -> pd.DataFrame:
            c: Counter = Counter()
            for run, n in runs.items():
                for w in splitter.words(" " + run):
                    if len(w) <= 64:
                        c[w] += n
            return pd.DataFrame({"word": [w.encode("utf-8", "replace") for w in c], "n": list(c.values())})

        runs: Counter = Counter()
        for pdf in batches:
            for t in texts_of(pdf["text"]):
                runs.update(t.split(" "))
                if len(runs) > 600_000:
                    yield words(runs)
                    runs = Counter()
        yield words(runs)

    counted = docs.select("text").mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1"))  # a word that occurs once is not frequent
    # The count from which on there are at most ``most`` words: from how many words have each count, summed up by powers of 2^(1/16).
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # a thousand rows at most
    total, least = 0, None
    for r in levels:
        total += r.words
        if total > most:
            break
        least = r.level
    return sorted(bytes(r.word) for r in counted.where(level >= least).select("word").collect()) if least is not None else []


def encode_decode(docs: DataFrame, vocabulary: Vocabulary | None = None, words: list[bytes] | None = None, most: int = 50_000) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text): digests of the ids and of the text decoded from them."""
    vocabulary = vocabulary or Vocabulary()
    words = frequent_words(docs, vocabulary, most) if words is None else sorted(set(words))
    token = uuid.uuid4().hex
    compiled = docs.sparkSession.sparkContext.broadcast((vocabulary, compile_lexicon(words, vocabulary.merge(words))))  # at most ``most`` words of 64 characters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held(token, lambda: Encoder(*compiled.value))
        vocabulary = encoder.vocabulary
        decimal = [b"%d" % i for i in range(len(vocabulary.bytes_of))]
        for pdf in batches:
            out = []
            for ids in encoder.encode(texts_of(pdf["text"])):
                listed = b",".join(map(decimal.__getitem__, ids.tolist()))
                out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(ids, vocabulary).encode()).hexdigest()))
            got = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield got

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
