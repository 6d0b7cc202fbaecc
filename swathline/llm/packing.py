r"""Best-fit packing by the configuration linear program.

Documents become token ids plus an end id; only those longer than ``capacity``
are cut, into pieces of ``capacity`` tokens of which the first may be shorter.
The pieces' length histogram has at most ``capacity`` entries whatever the
corpus, so the plan is made from it alone:

* the linear program over configurations (which lengths share a sequence) is
  solved by multiplicative weights: in each round every length may be covered a
  step further, configurations are priced by a knapsack dynamic program, those
  near the best are taken in whole numbers, as often as the step has room for
  them, and the weight of lengths that fall behind grows. So the solution covers
  no length too often and is rounded down as it is made;
* what no configuration near the best holds goes into its open and new sequences
  by best fit, longest first, on counts of equal sequences;
* weights over the best price are a dual solution, whose value no plan is below.
  One round of whole demand comes first; more rounds, of smaller steps, follow
  while the plan is over ``GAP`` from the bound. Best fit alone is the plan only
  where it needs fewer sequences than all of them.

The plan says, for each length, which ranks go to which sequences. Pieces are
ranked within their length by Spark: a length of many pieces is dealt out over
as many salts as leave about ``per_salt`` pieces in each, counts per (length,
salt) give each salt's first rank, and a window numbers the pieces inside a salt,
so a length that holds a third of all rows is numbered by many tasks. These
counts are what grows on the driver: one number for every ``per_salt`` pieces.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` is
carried through; rows with equal ids or texts are packed each on its own; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, texts_of, written

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
END = 2
#: Characters on whose classes all regular expression engines agree; other texts go to the tokenizers library.
_EVERYDAY = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞]*\Z")


class Encoder:
    """Token ids of a public byte-level vocabulary, the same as the tokenizers library gives."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        if _EVERYDAY.match(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, capacity: int = 1024, end: int = END) -> DataFrame:
    """One row of ``PIECES`` per piece: a narrow pass that reads each text once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        encoder = Encoder()
        for pdf in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, text in zip(pdf["doc_id"].astype("Int64").array, texts_of(pdf["text"]), strict=True):
                raw = np.append(encoder.ids(text), np.uint32(end)).astype("<u4").tobytes()
                n, start, k = len(raw) // 4, 0, 0
                while start < n:
                    stop = start + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    for name, v in zip(out, (doc_id, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])), strict=True):
                        out[name].append(v)
                    start, k = stop, k + 1
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


# ---- the plan, from the histogram ------------------------------------------------------------------------------


def knapsack(values: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to ``capacity`` the value of the most valuable configuration in it. values[l] is length l's."""
    lengths = np.flatnonzero(values > 0)
    best = np.zeros(capacity + 1)
    if not len(lengths):
        return best
    worth = values[lengths]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fits[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + worth[:k]).max())
    return best


class Program:
    """The covering program of one histogram while multiplicative weights solve it.

    ``used`` counts what the configurations of ``taken`` hold of each length, never
    more than there is, so that they are whole sequences of a plan at any time.
    ``bound`` is the best dual solution so far: weights over the most valuable
    configuration's value.
    """

    def __init__(self, hist: np.ndarray, capacity: int):
        self.n, self.capacity = hist.astype(np.int64), capacity
        self.lengths = np.flatnonzero(hist)
        self.used = np.zeros(capacity + 1, np.int64)
        self.log = np.zeros(capacity + 1)
        self.log[self.lengths] = np.log(self.lengths / capacity)
        self.taken: dict[tuple, int] = {}
        self.bound = 0.0

    def price(self) -> None:
        """Weights as they are now, and what each room is worth."""
        self.weight = np.zeros(self.capacity + 1)
        self.weight[self.lengths] = np.exp(self.log[self.lengths] - self.log[self.lengths].max())
        self.best = knapsack(self.weight, self.capacity)
        self.bound = max(self.bound, float(self.weight @ self.n / self.best[-1]))

    def near_best(self, k: int, left: np.ndarray, loss: float) -> dict[int, int] | None:
        """A configuration with length ``k`` of what is ``left`` whose value is within ``loss`` of the best, the longest lengths first; nothing if there is none."""
        room = self.capacity - k
        spare = loss * self.best[-1] - (self.best[-1] - self.weight[k] - self.best[room]) + 1e-12
        if spare < 0:
            return None
        config = {k: 1}
        while room:
            fit = self.lengths[: np.searchsorted(self.lengths, room, side="right")]
            lost = self.best[room] - self.weight[fit] - self.best[room - fit]
            free = left[fit]
            for j, a in config.items():
                if j <= room:
                    free[np.searchsorted(fit, j)] -= a
            good = np.flatnonzero((free > 0) & (lost <= spare))
            if not len(good):
                return config if self.best[room] <= spare else None
            j = int(fit[good[-1]])
            spare -= lost[good[-1]]
            config[j] = config.get(j, 0) + 1
            room -= j
        return config

    def take(self, target: np.ndarray, loss: float) -> None:
        """Configurations within ``loss`` of the best as often as ``target`` has room for them."""
        left = target - self.used
        for k in self.lengths[::-1].tolist():
            while left[k] > 0 and (config := self.near_best(k, left, loss)):
                times = min(int(left[j]) // a for j, a in config.items())
                for j, a in config.items():
                    left[j] -= a * times
                    self.used[j] += a * times
                key = tuple(sorted(config.items()))
                self.taken[key] = self.taken.get(key, 0) + times

    def run(self, rounds: int, rate: float = 0.1, losses: tuple = (0.0, 0.001, 0.004, 0.01), late: tuple = (0.02, 0.05)) -> list[tuple[dict[int, int], int]]:
        """In each round a ``rounds``-th more of every length may be covered; the weight of those that fall behind grows."""
        for t in range(1, rounds + 1):
            self.price()
            target = -(-self.n * t // rounds)
            for loss in losses:
                self.take(target, loss)
            behind = (target - self.used)[self.lengths] / self.n[self.lengths] * rounds  # in rounds
            self.log[self.lengths] += rate * np.minimum(behind, 10)
        self.price()
        for loss in (*losses, *late):
            self.take(self.n, loss)
        return [(dict(k), x) for k, x in self.taken.items()]


def best_fit(hist: np.ndarray, capacity: int, opened: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on groups of equal sequences, into those ``opened`` first."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(config: dict[int, int], times: int, free: int) -> None:
        room.setdefault(free, []).append((config, times))
        rooms[free] = True

    for config, times in opened:
        put(config, times, capacity - sum(k * a for k, a in config.items()))
    for length in np.flatnonzero(hist)[::-1]:
        length, left = int(length), int(hist[length])
        while left:
            found = np.flatnonzero(rooms[length:])
            if not len(found):
                each = capacity // length
                if left >= each:
                    put({length: each}, left // each, capacity - each * length)
                if left % each:
                    put({length: left % each}, 1, capacity - left % each * length)
                break
            free = length + int(found[0])
            config, times = room[free].pop()
            rooms[free] = bool(room[free])
            each = min(free // length, left)
            used = min(times, left // each)
            left -= used * each
            put(config | {length: config.get(length, 0) + each}, used, free - each * length)
            if times > used:
                put(config, times - used, free)
    return [x for group in room.values() for x in group]


#: How far from the bound a plan is good enough, and in how many rounds the program is solved, one after the other, until it is.
GAP, ROUNDS = 0.002, (1, 16, 64)


def planned(hist: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(configuration, number of sequences) that use every length exactly as often as ``hist[length]`` says, and a lower bound on their number."""
    left = hist.astype(np.int64).copy()
    full = int(left[capacity])
    left[capacity] = 0
    if not left.any():
        return ([({capacity: 1}, full)] if full else []), full
    best, bound = None, 0
    for rounds in ROUNDS:
        program = Program(left, capacity)
        solved = program.run(rounds)
        made = best_fit(left - program.used, capacity, solved)
        used = sum(times for _, times in made)
        if best is None or used < best[0]:
            best = used, made
        bound = max(bound, int(np.ceil(program.bound - 1e-6)))
        if best[0] <= max(bound, (1 + GAP) * bound):
            break
    alone = best_fit(left, capacity)  # of lengths that fit nowhere near, it may need fewer
    used = sum(times for _, times in alone)
    made = alone if used < best[0] else best[1]
    return ([({capacity: 1}, full)] if full else []) + made, bound + full


def plan(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    return planned(hist, capacity)[0]


def slots(planned: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks: from ``first`` on, ``each`` per sequence, in sequences from ``sequence``, at ``offset``."""
    rows, at, sequence = [], {}, 0
    for config, times in planned:
        offset = 0
        for length, each in sorted(config.items(), reverse=True):
            rows.append((length, at.get(length, 0), each, sequence, offset))
            at[length] = at.get(length, 0) + each * times
            offset += length * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = 1024, end: int = END, per_salt: int = 200_000) -> DataFrame:
    """One row of ``SCHEMA`` per piece of ``docs`` (doc_id, text)."""
    cut = written(pieces(docs, capacity, end))
    hist = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most capacity rows, whatever the corpus
        hist[r.length] = r["count"]
    where = slots(plan(hist, capacity))
    salts = np.maximum(1, -(-hist // per_salt))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.get(F.array(*map(F.lit, salts.tolist())), F.col("length").cast("int")))
    group = F.get(F.array(*map(F.lit, (np.cumsum(salts) - salts).tolist())), F.col("length").cast("int")) + dealt
    cut = cut.withColumn("group", group)
    sizes = np.zeros(int(salts.sum()), np.int64)
    if salts.max() > 1:
        counts = cut.groupBy("group").count().toPandas()
        sizes[counts["group"]] = counts["count"]
    else:
        sizes = hist
    # The first rank of each group: the pieces of its length in the groups before it.
    base = np.cumsum(sizes) - sizes
    base -= np.repeat(base[np.cumsum(salts) - salts], salts)
    # One key for (length, rank), so that one binary search finds a piece's range.
    step = np.int64(1) << 40
    shared = docs.sparkSession.sparkContext.broadcast((base, *(where[c].to_numpy(np.int64) for c in where)))
    number = F.row_number().over(Window.partitionBy("group").orderBy("doc_id", "piece", "start", "ids_crc32"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, length, first, each, sequence, offset = shared.value
        keys = length * step + first
        for pdf in batches:
            own = pdf["length"].to_numpy(np.int64)
            rank = base[pdf["group"].to_numpy()] + pdf["number"].to_numpy() - 1
            i = np.searchsorted(keys, own * step + rank, side="right") - 1
            inside = rank - first[i]
            pdf["sequence_id"] = sequence[i] + inside // each[i]
            pdf["offset"] = offset[i] + inside % each[i] * own
            yield pdf[[c.split()[0] for c in SCHEMA.split(", ")]].astype({"doc_id": "Int64"})

    return cut.withColumn("number", number).mapInPandas(place, SCHEMA)
