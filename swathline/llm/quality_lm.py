r"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order 4. Its symbols are the most frequent
characters of the counted text, up to ``ALPHABET``, and 256 bytes; any other
character is spelt in its UTF-8 bytes, so no text loses anything. Counts of four
symbols are summed up by Spark; the lower orders count in how many different ways
they continue, three discounts per order come from the counts of counts, and every
n-gram gets its discounted probability and, as a context, the weight of the next
lower order. The model stays a table, sharded by n-gram.

Scoring is a sharded join: documents travel in blocks of about ``block_chars``
characters, compressed; a block asks once for each distinct n-gram that it holds,
the answers come back packed by block, and the block's documents are scored with
them. What is gathered so grows with the corpus, and no n-gram is a hot key, as
it has one request per block at most.

One in ten of the trusted documents, by a hash of the id, is kept out of the
counts and sets the thresholds: a document is kept if its perplexity per
character is at most ``margin`` times the ``quantile`` (to a ten-thousandth of the
ranks) of those of its language; of all languages, if its own has none; of the
counted documents, if none was kept out.

Edge cases: a null or empty text has no perplexity and is not kept; a null
``lang`` is a language of its own; without trusted text nothing has a perplexity
or is kept; a label with a null id or quality is not trusted; repeated rows are
counted and scored each; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of, written

SCHEMA = "doc_id bigint, lang string, n_scored bigint, perplexity double, role string"
ORDER, BITS = 4, 12
#: Symbols: 0 stands before a text, from 2 on characters, after them 256 bytes.
BYTES = 256
ALPHABET = (1 << BITS) - 2 - BYTES
#: Which trusted documents set the thresholds instead of being counted: this share, by a hash of the id.
HELD_OUT = 10
#: Ids of trusted documents are broadcast up to this number (8 bytes each); above it they are joined by a shuffle.
FEW = 2_000_000
#: Characters that one NumPy pass takes at once.
AT_ONCE = 2_000_000
_PACKED = "block bigint, n int, keys binary, a binary, gamma binary"
_BLOCK = "block bigint, doc_ids binary, nulls binary, langs array<string>, roles array<string>, texts binary, ends binary"


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, text, lang, role): ``counted`` or ``calibrating`` for trusted documents with a text, else null."""
    few = trusted.limit(FEW + 1).count() <= FEW
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("_id"), "left")
    role = F.when(F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)) == 0, "calibrating").otherwise("counted")
    return found.select("doc_id", "text", "lang", F.when(F.col("_id").isNotNull() & (F.col("text") != ""), role).alias("role"))


# ---- counting --------------------------------------------------------------------------------------------------


class Symbols:
    """Turns texts into symbols by the alphabet, a sorted array of code points."""

    def __init__(self, alphabet: np.ndarray):
        self.table = np.ones(0x110000, np.int16)
        self.table[alphabet] = np.arange(2, len(alphabet) + 2)
        self.first_byte = len(alphabet) + 2

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each with three zeros before it, and where each text ends."""
        pad = "\0" * (ORDER - 1)
        raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), "<u4") if texts else np.zeros(0, np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens + ORDER - 1)
        out = self.table[raw]
        starts = ends - lens
        for k in range(1, ORDER):
            out[starts - k] = 0
        rare = np.flatnonzero(out == 1)
        if not len(rare):
            return out, ends
        codes, which = np.unique(raw[rare], return_inverse=True)
        spelt = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in codes]
        widths = np.fromiter(map(len, spelt), np.int64, len(spelt))[which]
        each = np.ones(len(out), np.int64)
        each[rare] = widths
        after = np.cumsum(each)
        out = np.repeat(out, each)
        at = np.repeat(after[rare] - widths, widths) + np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
        out[at] = self.first_byte + np.concatenate([spelt[k] for k in which]).astype(np.int16)
        return out, after[ends - 1]


def grams(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of order 4, the number of each, and for each symbol but the padding its place among them.

    Two gathers through dense tables: symbols to distinct pairs, pairs of pairs
    to distinct n-grams. No sorting of positions.
    """
    used = np.flatnonzero(np.bincount(symbols, minlength=1))
    local = np.zeros(1 << BITS, np.int32)
    local[used] = np.arange(len(used))
    local = local[symbols]
    pair = local[:-1] * np.int32(len(used)) + local[1:]
    flags = np.zeros(len(used) ** 2, bool)
    flags[pair] = True
    pairs = np.flatnonzero(flags)
    number = np.zeros(len(flags), np.int32)
    number[pairs] = np.arange(len(pairs))
    pair = number[pair]
    # A position counts if it is no padding; its n-gram starts three symbols before.
    real = np.ones(len(symbols), bool)
    starts = np.r_[0, ends[:-1]]
    for k in range(ORDER - 1):
        real[starts + k] = False
    real = real[ORDER - 1 :]
    first, second = pair[:-2][real], pair[2:][real]
    if len(pairs) ** 2 <= 16_000_000:
        quad = first * np.int32(len(pairs)) + second
        counts = np.bincount(quad, minlength=1)
        found = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int32)
        place[found] = np.arange(len(found))
        counts, place = counts[found], place[quad]
    else:
        found, place, counts = np.unique(first.astype(np.int64) * len(pairs) + second, return_inverse=True, return_counts=True)
    a, b = pairs[found // len(pairs)] if len(found) else found, pairs[found % len(pairs)] if len(found) else found
    key = np.zeros(len(found), np.int64)
    for s in (a // len(used), a % len(used), b // len(used), b % len(used)):
        key = (key << BITS) | used[s]
    return key, counts, place


def tagged(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of n-grams with the order in front, so that all orders share a table."""
    return (key & ((1 << BITS * order) - 1)) | (order << BITS * ORDER)


def alphabet(trusted: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for pdf in batches:
            texts = texts_of(pdf["text"])
            for a, b in portions(texts):
                codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "replace"), "<u4")
                c = np.bincount(codes)
                total[: len(c)] += c
        own = np.flatnonzero(total)
        yield pd.DataFrame({"code": own, "n": total[own]})

    counted = trusted.select("text").mapInPandas(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return np.array(sorted(r.code for r in counted.orderBy(F.desc("n"), "code").limit(ALPHABET).collect()), np.int64)


def count_grams(trusted: DataFrame, letters: np.ndarray) -> DataFrame:
    """(key, n): counts of n-grams of order 4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(letters)
        for pdf in batches:
            texts = [t for t in texts_of(pdf["text"]) if t]
            parts = [grams(*symbols.of(texts[a:b]))[:2] for a, b in portions(texts, AT_ONCE)]
            if parts:
                key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                yield pd.DataFrame({"key": key, "n": np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)})

    return trusted.select("text").mapInPandas(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


# ---- the model -------------------------------------------------------------------------------------------------


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams have the counts 1, 2, 3 and 4."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else float(k) for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), out, strict=True)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(key, a, gamma): of a tagged n-gram, its discounted probability, and the lower order's weight after it as a context."""
    tag = lambda k: F.lit(k << BITS * ORDER)
    rows = []
    level = counts
    for order in range(ORDER, 0, -1):
        level = written(level)
        of = level.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        d = _discounts([of.n1, of.n2, of.n3, of.n4])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("key", BITS)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
        gamma = totals.select((F.col("context") + tag(order - 1)).alias("key"), F.lit(None).cast("double").alias("a"), (F.col("cut") / F.col("total")).alias("gamma"))
        a = level.withColumn("context", context).join(totals.select("context", "total"), "context")
        rows += [gamma, a.select((F.col("key") + tag(order)).alias("key"), (F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total")).alias("a"), F.lit(None).cast("double").alias("gamma"))]
        level = level.select(F.col("key").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return written(out.groupBy("key").agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("a"), F.coalesce(F.max("gamma"), F.lit(1.0)).alias("gamma")))


def log_probabilities(key: np.ndarray, answers: tuple[np.ndarray, np.ndarray, np.ndarray], n_letters: int) -> np.ndarray:
    """log p of the last symbol of each order-4 n-gram after the three before it; ``answers`` (keys, a, gamma) are sorted by key."""
    keys, a, gamma = answers

    def find(wanted: np.ndarray, column: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, column[at], missing)

    p = np.full(len(key), 1.0 / (n_letters + BYTES))
    for order in range(1, ORDER + 1):
        context = tagged(key >> BITS, order - 1)
        p = find(tagged(key, order), a, 0.0) + find(context, gamma, 1.0) * p
    return np.log(p)


# ---- scoring ---------------------------------------------------------------------------------------------------


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """Documents in compressed blocks; a block's number tells its task and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=9)
        k, held, size = 0, [], 0

        def out() -> pd.DataFrame:
            raw = [r[3].encode("utf-8", "replace") for r in held]
            ids = np.array([0 if r[0] is None else r[0] for r in held], np.int64)
            nulls = np.array([r[0] is None for r in held])
            row = ((TaskContext.get().partitionId() << 32) + k, ids.tobytes(), nulls.tobytes(), [r[1] for r in held], [r[2] for r in held], squeeze.compress(b"".join(raw)), np.cumsum(list(map(len, raw)), dtype=np.int64).tobytes())
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for pdf in batches:
            ids = [None if x is pd.NA else int(x) for x in pdf["doc_id"].astype("Int64").array]
            for row in zip(ids, pdf["lang"].where(pdf["lang"].notna(), None), pdf["role"].where(pdf["role"].notna(), None), texts_of(pdf["text"]), strict=True):
                held.append(row)
                size += len(row[3]) + 64
                if size >= block_chars:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    return docs.mapInPandas(run, _BLOCK)


def _texts(row) -> list[str]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=int(np.frombuffer(row.ends, np.int64)[-1]) + 1)
    ends = [0, *np.frombuffer(row.ends, np.int64).tolist()]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _pack(batches: Iterator[pd.DataFrame], at_once: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Answers (block, key, a, gamma) as ``_PACKED``: one row for each block in some million of them."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)

    def out(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held).sort_values(["block", "key"])
        block = pdf["block"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            keys = np.diff(pdf["key"].to_numpy()[a:b], prepend=0)
            rows.append((block[a], b - a, squeeze.compress(keys.tobytes()), *(squeeze.compress(pdf[c].to_numpy(np.float64)[a:b].tobytes()) for c in ("a", "gamma"))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PACKED.split(", ")])

    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= at_once:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _unpack(packed: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    parts = [tuple(np.frombuffer(open_.decompress(x, max_output_size=8 * r.n + 8), t) for x, t in ((r.keys, np.int64), (r.a, np.float64), (r.gamma, np.float64))) for r in packed.itertuples()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    keys = np.concatenate([np.cumsum(k) for k, _, _ in parts])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a for _, a, _ in parts])[order], np.concatenate([g for _, _, g in parts])[order]


def score(docs: DataFrame, letters: np.ndarray, model: DataFrame, block_chars: int = 12_000_000) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text, lang, role)."""
    blocks = written(_blocks(docs, block_chars))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(letters)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(shared.value)
        for pdf in batches:
            for row in pdf.itertuples():
                texts = [t for t in _texts(row) if t]
                parts = [grams(*symbols.of(texts[a:b]))[0] for a, b in portions(texts, AT_ONCE)]
                key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                asked = [tagged(key, ORDER)]
                for order in range(ORDER - 1, -1, -1):  # lower orders, and contexts, which may be of padding
                    asked.append(np.unique(np.r_[tagged(key, order), tagged(key >> BITS, order)]))
                yield pd.DataFrame({"key": np.concatenate(asked), "block": row.block})

    asked = blocks.select("block", "texts", "ends").mapInPandas(ask, "key bigint, block bigint")
    answers = asked.join(model, "key").select("block", "key", "a", "gamma").mapInPandas(_pack, _PACKED)

    def judge(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        symbols, out = Symbols(shared.value), []
        found = _unpack(answers)
        for row in block.itertuples():
            texts = _texts(row)
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            total = np.zeros(len(texts))
            full = np.flatnonzero(lens)
            if len(full) and len(shared.value):
                for a, b in portions([texts[i] for i in full], AT_ONCE):
                    own = full[a:b]
                    spelt, ends = symbols.of([texts[i] for i in own])
                    key, _, place = grams(spelt, ends)
                    logs = log_probabilities(key, found, len(shared.value))[place]
                    total[own] = np.add.reduceat(logs, np.r_[0, ends[:-1]] - np.arange(len(own)) * (ORDER - 1))
            ppl = np.exp(-total / np.maximum(lens, 1))
            ids = pd.array(np.frombuffer(row.doc_ids, np.int64), "Int64")
            ids[np.frombuffer(row.nulls, bool)] = pd.NA
            scored = (lens > 0) & bool(len(shared.value))
            out.append(pd.DataFrame({"doc_id": ids, "lang": list(row.langs), "n_scored": np.where(scored, lens, 0), "perplexity": pd.array(np.where(scored, ppl, np.nan)).astype("Float64"), "role": list(row.roles)}))
        got = pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
        got["perplexity"] = got["perplexity"].astype("Float64").where(got["n_scored"] > 0, pd.NA)
        return got

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.25, block_chars: int = 12_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_scored, perplexity, threshold, kept."""
    docs = flagged(docs, trusted_ids(labels))
    counted = docs.where("role = 'counted'")
    letters = alphabet(counted)
    model = kneser_ney(count_grams(counted, letters))
    scored = written(score(docs, letters, model, block_chars))
    cut: Column = F.percentile_approx("perplexity", quantile, 10_000) * margin
    by_lang = scored.where("role = 'calibrating' and perplexity is not null").groupBy("lang").agg(cut.alias("own"))
    every = {r.role: r.every for r in scored.where("role is not null and perplexity is not null").groupBy("role").agg(cut.alias("every")).collect()}  # two numbers at most
    found = scored.alias("s").join(by_lang.alias("t"), F.expr("s.lang <=> t.lang"), "left")
    threshold = F.coalesce(F.col("own"), F.lit(every.get("calibrating", every.get("counted"))).cast("double"))
    return found.select("doc_id", "s.lang", "n_scored", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
