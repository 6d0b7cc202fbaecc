r"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary
(the pieces of ``piece_bpe_32k.model``; they are given, never trained). The
probability of a word is the sum over all its segmentations into pieces, found
by a forward algorithm over the whole word, however long; a text's log probability
sums those of its words. Its score is the best language's share of the
probabilities, after log probabilities of a text of over ``SCORED_WORDS`` words
are brought down to that many words' worth, so that long texts don't all score 1.

Training: expectation maximisation over word counts. The words come from a
bounded sample of the labelled rows: about ``sample_docs`` texts of each
language, chosen by a hash of ``doc_id`` at a rate set from exact counts, so the
sample is the same on every run. Words are counted by Spark; each iteration is a
job whose tasks run forward-backward over their share of the distinct words, and
what returns to the driver is one row per piece and language, bounded by the
vocabulary.

Edge cases: a null text or one without a letter gets ``und`` with score 0; a
null ``lang`` is not learned from; with nothing to learn from, every text gets
``und``; a null ``doc_id`` is never trained on and counts as held out; equal
rows get equal answers; ties go to the language that sorts first; an empty table
gives an empty one; other columns play no part.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, portions, texts_of

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_letter_words bigint"
UND = "und"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words of up to so many characters go through matrices, many at a time (no product of FLOORs underflows); longer ones one by one, place by place.
SHORT = 40
SCORED_WORDS = 50
#: Probability of a character that no piece holds, and the least one that a piece can get.
FLOOR = 1e-7
_MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-cased pieces of a sentencepiece model, sorted."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))
    return sorted({x.lower() for x in found if x})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of code points, a row per word padded with zeros, and the lengths."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lens.max(initial=1))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), width).astype(np.uint64), lens


def _extend(h: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The keys of strings that are longer by the characters in ``column``."""
    h = (h ^ column) * _MULT
    return h ^ (h >> np.uint64(31))


class Pieces:
    """Looks up all substrings of many words at once, by 64-bit keys in tables without collisions."""

    def __init__(self, pieces: list[str]):
        self.size, self.tables = len(pieces), []
        keys = np.zeros(len(pieces), np.uint64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.longest = int(lens.max(initial=0))
        if pieces:
            codes, _ = _codes(pieces)
            for k in range(codes.shape[1]):
                keys = np.where(lens > k, _extend(keys, codes[:, k]), keys)
        left, bits = np.arange(len(pieces)), 20
        while len(left):  # what a table has no place for goes to the next one
            slots = (keys[left] >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            held, ids = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            held[slots[first]], ids[slots[first]] = keys[left[first]], left[first]
            self.tables.append((np.uint64(64 - bits), held, ids))
            left = np.delete(left, first)
            bits = 17 - len(self.tables)
            keys = keys * np.uint64(0xD6E8FEB86659FD93) if len(left) and len(self.tables) > 3 else keys

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold a piece, and its id."""
        rows, found = [], []
        for shift, held, ids in self.tables:
            at = (keys >> shift).astype(np.int64)
            hit = np.flatnonzero(held[at] == keys)
            rows.append(hit)
            found.append(ids[at[hit]])
        return (rows[0], found[0]) if len(rows) == 1 else (np.concatenate(rows), np.concatenate(found))

    def spans(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Lengths, and for each end position the pieces that end there: (piece length, rows, piece ids)."""
        codes, lens = _codes(words)
        width = codes.shape[1]
        columns = [np.ascontiguousarray(codes[:, k]) for k in range(width)]
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for start in range(width if self.tables else 0):
            keys = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                keys = _extend(keys, columns[end - 1])  # the zeros behind a word's end match no piece
                rows, ids = self.find(keys)
                if len(rows):
                    ends[end].append((end - start, rows, ids))
        return lens, ends


def forward(p: np.ndarray, n_words: int, lens: np.ndarray, ends: list) -> np.ndarray:
    """P(word | language), summed over all segmentations: (words, languages).

    ``p`` is (pieces, languages). A position that no piece reaches is reached by
    one unknown character of probability FLOOR.
    """
    width, k = len(ends) - 1, p.shape[1]
    alpha = np.zeros((n_words, width + 1, k))
    alpha[:, 0] = 1
    for end in range(1, width + 1):
        a = alpha[:, end - 1] * FLOOR
        for n, rows, ids in ends[end]:
            a[rows] += alpha[rows, end - n] * p[ids]
        alpha[:, end] = a
    return alpha[np.arange(n_words), lens]


def placed(word: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in one word: first character, length and id of each, sorted by where they end."""
    codes, _ = _codes([word])
    keys, found = np.zeros(codes.shape[1], np.uint64), []
    for n in range(1, min(pieces.longest, len(word)) + 1):
        keys = _extend(keys[: len(word) - n + 1], codes[0, n - 1 :])
        rows, ids = pieces.find(keys)
        found.append((rows, np.full(len(rows), n), ids))
    start, n, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(start + n, kind="stable")
    return start[order], n[order], ids[order]


def long_word_log(word: str, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """log P(word | language) of one word: the forward pass in a ring of the last places, scaled up as it shrinks."""
    start, n, ids = placed(word, pieces)
    first = np.searchsorted(start + n, np.arange(len(word) + 2))
    size = pieces.longest + 1
    ring, scale = np.zeros((size, p.shape[1])), np.zeros(p.shape[1])
    ring[0] = 1
    for end in range(1, len(word) + 1):
        a = ring[(end - 1) % size] * FLOOR
        own = slice(first[end], first[end + 1])
        if own.stop > own.start:
            a = a + (ring[(end - n[own]) % size] * p[ids[own]]).sum(0)
        ring[end % size] = a
        small = a < 1e-150
        if small.any():
            ring[:, small] *= 1e150
            scale[small] -= 150 * np.log(10)
    return np.log(np.maximum(ring[len(word) % size], 1e-300)) + scale


def word_logs(words: list[str], p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """log P(word | language), (words, languages)."""
    out = np.zeros((len(words), p.shape[1]))
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > SHORT:
            out[i] = long_word_log(START + w, p, pieces)
        else:
            by_width.setdefault((len(w) + 3) // 4, []).append(i)  # words of like length share a matrix
    for ids in by_width.values():
        for s in range(0, len(ids), 20_000):
            part = ids[s : s + 20_000]
            lens, ends = pieces.spans([START + words[i] for i in part])
            out[part] = np.log(np.maximum(forward(p, len(part), lens, ends), 1e-300))
    return out


def _long_counts(word: str, p: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids and their expected counts in one word, by forward-backward in logarithms; ``p`` is one language's."""
    start, n, ids = placed(word, pieces)
    end, logs, unknown = start + n, np.log(p[ids]), np.log(FLOOR)
    alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
    alpha[0] = beta[-1] = 0
    first = np.searchsorted(end, np.arange(len(word) + 2))
    for k in range(1, len(word) + 1):
        own = slice(first[k], first[k + 1])
        alpha[k] = np.logaddexp.reduce(np.r_[alpha[k - 1] + unknown, alpha[start[own]] + logs[own]])
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], np.arange(len(word) + 1))
    for k in range(len(word) - 1, -1, -1):
        own = order[first[k] : first[k + 1]]
        beta[k] = np.logaddexp.reduce(np.r_[beta[k + 1] + unknown, beta[end[own]] + logs[own]])
    return ids, np.exp(alpha[start] + logs + beta[end] - alpha[-1])


def expected_counts(words: list[str], weights: np.ndarray, langs: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected piece counts (pieces, languages) by forward-backward; word i counts for language ``langs[i]`` only."""
    out = np.zeros(p.shape)
    for i in (i for i, x in enumerate(words) if len(x) > SHORT):
        ids, c = _long_counts(START + words[i], p[:, langs[i]], pieces)
        np.add.at(out[:, langs[i]], ids, weights[i] * c)
    short = np.array([i for i, x in enumerate(words) if len(x) <= SHORT], np.int64)
    for s in range(0, len(short), 5_000):
        part = short[s : s + 5_000]
        own, w, lang = [START + words[i] for i in part], weights[part], langs[part]
        lens, ends = pieces.spans(own)
        pl = [[(n, rows, ids, p[ids, lang[rows]]) for n, rows, ids in e] for e in ends]
        width, m = len(ends) - 1, len(own)
        alpha, beta = np.zeros((m, width + 1)), np.zeros((m, width + 1))
        alpha[:, 0] = 1
        for end in range(1, width + 1):
            a = alpha[:, end - 1] * FLOOR
            for n, rows, _, q in pl[end]:
                a[rows] += alpha[rows, end - n] * q
            alpha[:, end] = a
        beta[np.arange(m), lens] = 1
        for end in range(width, 0, -1):
            beta[:, end - 1] += beta[:, end] * FLOOR
            for n, rows, _, q in pl[end]:  # a row has one piece of each length here at most
                beta[rows, end - n] += beta[rows, end] * q
        total = np.maximum(alpha[np.arange(m), lens], 1e-300)
        found = [(ids * p.shape[1] + lang[rows], w[rows] * alpha[rows, end - n] * q * beta[rows, end] / total[rows]) for end in range(1, width + 1) for n, rows, ids, q in pl[end]]
        if found:
            at, c = (np.concatenate(x) for x in zip(*found, strict=True))
            out += np.bincount(at, c, out.size).reshape(out.shape)
    return out


@dataclass
class LanguageModel:
    """Languages, sorted; pieces; p[piece, language]. A few MB at most: the vocabulary bounds it."""

    langs: list[str]
    pieces: list[str]
    p: np.ndarray


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def train(docs: DataFrame, pieces: list[str] | None = None, sample_docs: int = 300, iterations: int = 2) -> LanguageModel:
    """Fit on rows of ``docs`` (doc_id, text, lang) with a text, a lang and a doc_id.

    About ``sample_docs`` rows of each language are read as text (the bound of
    the sample); which rows is a matter of a hash of ``doc_id`` alone.
    """
    pieces = vocabulary() if pieces is None else pieces
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rates = spark.createDataFrame([(x, min(1.0, sample_docs / sizes[x])) for x in langs], "lang string, rate double")
    sample = docs.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                c: Counter = Counter()
                for t in own["text"]:
                    c.update(words_of(t))
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    counted = sample.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    index = {x: i for i, x in enumerate(langs)}
    p = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    for _ in range(iterations):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            found = Pieces(pieces)
            for pdf in batches:
                c = expected_counts(list(pdf["word"]), pdf["n"].to_numpy(float), pdf["lang"].map(index).to_numpy(), now.value, found)
                i, k = np.nonzero(c)
                yield pd.DataFrame({"piece": i, "lang": k, "c": c[i, k]})

        parts = counted.mapInPandas(expect, "piece int, lang int, c double").groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas()
        c = np.zeros(p.shape)
        c[parts["piece"], parts["lang"]] = parts["c"]
        p = np.maximum((c + 0.01) / (c.sum(0) + 0.01 * len(pieces)), FLOOR)
    counted.unpersist()
    return LanguageModel(langs, pieces, p)


class Scorer:
    """Scores texts in one task; the scores of words seen before are kept, up to ``most`` words."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.pieces, self.most = model, Pieces(model.pieces), most
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))

    def texts(self, texts: list[str]) -> list[tuple[str, float, int]]:
        out = []
        for a, b in portions(texts):
            words = [words_of(t) for t in texts[a:b]]
            new = list({w for own in words for w in own if w not in self.index})
            kept = len(self.index)
            self.index.update(zip(new, range(kept, kept + len(new)), strict=True))
            logs = np.concatenate([self.logs, word_logs(new, self.model.p, self.pieces)])
            for own in words:
                n = len(own)
                if not self.model.langs or not any(c.isalpha() for w in own for c in w):  # the first one decides, but for numerals like ½
                    out.append((UND, 0.0, n))
                    continue
                total = logs[np.fromiter(map(self.index.__getitem__, own), np.int64, n)].sum(0)
                total *= min(n, SCORED_WORDS) / n
                best = int(total.argmax())
                out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum()), n))
            room = max(0, self.most - kept)  # the first words seen stay, as frequent ones are among them
            for w in new[room:]:
                del self.index[w]
            self.logs = logs[: kept + room]
        return out


def predict(docs: DataFrame, model: LanguageModel, held_out: str = "false") -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs``; ``held_out`` is an SQL expression over them."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = held(token, lambda: Scorer(shared.value))
        for pdf in batches:
            got = scorer.texts(texts_of(pdf["text"]))
            lang, score, n = zip(*got, strict=True) if got else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": list(lang), "score": list(score), "n_letter_words": list(n)})

    return docs.select("doc_id", "text", F.expr(held_out).alias("held_out")).mapInPandas(run, SCHEMA)


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more, with all their columns."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(token, lambda: Scorer(shared.value))
        for batch in batches:
            got = scorer.texts([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([lang != UND and score >= least for lang, score, _ in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
