r"""Alignment of two tokenizers over the bytes of the same texts.

Texts are encoded by a byte-level vocabulary (A) and by a piece vocabulary (B), and
everything between is columns of Arrow arrays, some texts at a time:

* the lists of ids are flattened, with the text of each token as its parent index;
  the bytes of all tokens are one take from the vocabulary, so its offsets are the
  running sum of token lengths, and less the offset where the text starts the sum
  inside of each text; the same bytes are compared with the text itself;
* ends that both have come from an Acero hash join on (text, end): there a group
  ends. Between two neighbouring ends of either side lies one link, so a token of
  A links with the token of B that holds its last byte, and a token of B whose end
  A lacks with that of A;
* links are counted by (text, pair) and by pair in Arrow's group_by. A task gathers
  texts in blocks of about ``block_chars`` characters and gives out, for each
  block, its distinct pairs with their counts, and one compressed record batch
  with the block's rows.

Spark adds up the pairs' counts of all blocks, finds each B id's highest by a
window (a B id has at most as many pairs as A has ids), sends each block the
counts of its pairs, one row per block and pair however often the pair occurs
there, and rows and answers of a block meet in one cogroup.

Texts are cut in stretches before encoding, where both vocabularies have a border
in any case; of pieces this holds as none has a space after another letter, which
is checked.

Edge cases: a text that is null, empty or not given back byte for byte by both
(control characters, say) has no tokens: zeros and an empty digest; special tokens'
strings are plain text; a null ``doc_id`` is carried through; equal rows count each
on their own; long texts are whole; an empty table gives an empty one; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import EVERYDAY, byte_letters
from .common import portions, stretches, texts_of, written

SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
#: Either a block's rows or one of its pairs.
_PARTS = "block bigint, rows binary, pair bigint, n bigint"
#: Characters that are aligned at once, in a block, and texts in a block.
AT_ONCE, BLOCK_CHARS, BLOCK_TEXTS = 1_500_000, 16_000_000, 100_000


class Tokenizers:
    """Both vocabularies: ids of texts, the bytes of each id, and the decimal ids with what may follow them."""

    def __init__(self, a_path: str | None = None, a_ranks: str | None = None, b_path: str | None = None):
        import base64

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.exact.encode_special_tokens = True  # their strings are plain text
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(a_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        letters = byte_letters()
        special = self.exact.get_added_tokens_decoder()
        a = [b""] * self.exact.get_vocab_size()
        for token, i in self.exact.get_vocab().items():
            a[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece goes on beyond a space, so texts cannot be cut there")
        b = [bytes([int(x[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        self.bytes_a, self.bytes_b = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.wide = len(b)
        #: By 2 * id and 3 * id: an id and a comma, or what ends its side of the group.
        self.text_a = pa.array([f"{i}{c}" for i in range(len(a)) for c in (",", "|")], pa.binary())
        self.text_b = pa.array([f"{i}{c}" for i in range(len(b)) for c in (",", ";", "")], pa.binary())

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of space and text."""
        out = []
        for part in stretches(f" {text}"):
            if EVERYDAY.match(part):
                out.append(self.fast.encode_to_numpy(part, allowed_special=set(), disallowed_special=()))
            else:
                out.append(np.array(self.exact.encode(part, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out).astype(np.int32)

    def ids_b(self, text: str) -> np.ndarray:
        """Ids of the text, before which the library puts a space; later stretches have one of their own."""
        parts = [part[k > 0 :] for k, part in enumerate(stretches(text))]
        return np.concatenate([np.array(x, np.int32) for x in self.pieces.encode(parts, num_threads=1)])


class Side:
    """The tokens of some texts by one vocabulary, flattened: ids, the text of each, its end inside the text, and over all texts."""

    def __init__(self, ids: list[np.ndarray], lexicon: pa.Array):
        offsets = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        self.counts = np.diff(offsets)
        self.flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        self.ids, self.text = self.flat.to_numpy(), parent.to_numpy()
        taken = lexicon.take(self.flat)
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        self.bytes = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: ends[-1]]
        self.starts = ends[offsets]  # of each text, and the end of the last
        self.end = ends[1:] - self.starts[:-1][self.text]
        self.at = ends[1:]

    def keys(self, name: str) -> pa.Table:
        return pa.table({"text": self.text, "end": self.end, name: np.arange(len(self.ids))})


def _equal(side: Side, texts: list[bytes]) -> np.ndarray:
    """Which texts the tokens' bytes are equal to."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    same = np.diff(side.starts) == lens
    if same.all() and np.array_equal(side.bytes, np.frombuffer(b"".join(texts), np.uint8)):
        return same
    for i in np.flatnonzero(same).tolist():
        same[i] = side.bytes[side.starts[i] : side.starts[i + 1]].tobytes() == texts[i]
    return same


def align(texts: list[str], known: Tokenizers) -> pa.Table:
    """(place, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): of each text that both give back, the distinct pairs of its links and how often each occurs."""
    ids_a, ids_b = [known.ids_a(t) for t in texts], [known.ids_b(t) for t in texts]
    place = np.arange(len(texts))
    raw = [f" {t}".encode() for t in texts]
    a, b = Side(ids_a, known.bytes_a), Side(ids_b, known.bytes_b)
    both = _equal(a, raw) & _equal(b, raw)
    if not both.all():
        place = np.flatnonzero(both)
        a, b = Side([ids_a[i] for i in place], known.bytes_a), Side([ids_b[i] for i in place], known.bytes_b)
    shared = a.keys("a").join(b.keys("b"), ["text", "end"], join_type="inner", use_threads=False)
    border_a, border_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    border_a[shared["a"].to_numpy()] = True
    border_b[shared["b"].to_numpy()] = True
    n = len(place)
    groups = np.bincount(a.text[border_a], minlength=n)

    # Links: where a token of A ends, and where one of B does but none of A.
    inner = np.flatnonzero(~border_b)
    text = np.r_[a.text, b.text[inner]]
    pair = np.r_[a.ids, a.ids[np.searchsorted(a.at, b.at[inner])]] * np.int64(known.wide) + np.r_[b.ids[np.searchsorted(b.at, a.at)], b.ids[inner]]
    links = pa.table({"text": text, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
    order = np.lexsort((links["pair"].to_numpy(), links["text"].to_numpy()))
    sizes = np.bincount(links["text"].to_numpy(), minlength=n)
    offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(links[c].to_numpy()[order])) for c in ("pair", "count_all")]

    # The groups as text: each token's place behind the tokens of both sides before it.
    before_a = np.cumsum(border_a) - border_a  # groups before the token's own, over all texts
    before_b = np.cumsum(border_b) - border_b
    per_a, per_b = np.bincount(before_a, minlength=groups.sum()), np.bincount(before_b, minlength=groups.sum())
    put_a = np.arange(len(a.ids)) + np.r_[0, np.cumsum(per_b)][before_a]
    put_b = np.arange(len(b.ids)) + np.cumsum(per_a)[before_b]
    last = np.zeros(len(b.ids), np.int64)
    last[np.cumsum(b.counts)[b.counts > 0] - 1] = 1
    word = np.empty(len(a.ids) + len(b.ids), np.int64)
    word[put_a] = 2 * a.ids + border_a
    word[put_b] = len(known.text_a) + 3 * b.ids + border_b + last
    written_out = pa.concat_arrays([known.text_a, known.text_b]).take(pa.array(word))
    ends = np.frombuffer(written_out.buffers()[1], np.int32, len(written_out) + 1)[np.cumsum([0, *(a.counts + b.counts)])]
    characters = memoryview(written_out.buffers()[2] or b"")
    digest = [hashlib.sha256(characters[x:y]).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist())]
    return pa.table(
        {
            "place": place,
            "n_a": a.counts,
            "n_b": b.counts,
            "n_groups": groups,
            "n_links": a.counts + b.counts - groups,
            "groups_sha256": pa.array(digest, pa.string()),
            "pairs": lists[0],
            "times": lists[1],
        }
    )


# ---- blocks ----------------------------------------------------------------------------------------------------


def _sealed(ids: pa.Array, rows: pa.Table, pairs: np.ndarray) -> bytes:
    """A block's rows as one compressed stream: pairs as places among the block's, each less the one before it."""
    codes = np.searchsorted(pairs, rows["pairs"].combine_chunks().flatten().to_numpy())
    offsets = np.cumsum([0, *rows["pairs"].combine_chunks().value_lengths().to_numpy()])
    steps = np.diff(codes, prepend=0)
    heads = offsets[:-1][np.diff(offsets) > 0]
    steps[heads] = codes[heads]
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(steps.astype(np.int32)), rows["times"].combine_chunks().flatten().cast(pa.int32()))]
    out = rows.drop_columns(["pairs", "times"]).append_column("steps", lists[0]).append_column("times", lists[1])
    at = {name: out[name].combine_chunks() for name in out.column_names}
    at["doc_id"] = ids
    table = pa.table(at)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _answered(sealed: bytes, total: np.ndarray, best: np.ndarray) -> pa.Table:
    """A block's rows with sums over their links, given counts of the block's pairs in the order of their numbers."""
    rows = pa.ipc.open_stream(sealed).read_all()
    steps, times = rows["steps"].combine_chunks(), rows["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    lens = steps.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(lens)), lens)
    run = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
    first = np.cumsum(lens) - lens
    base = np.r_[0, run][first]  # the running sum before each row's first
    code = run - np.repeat(base, lens)
    ends = np.r_[0, np.cumsum(total[code] * times if len(code) else np.zeros(0, np.int64))]
    count_sum = ends[first + lens] - ends[first]
    n_best = np.bincount(owner[best[code]], times[best[code]], len(lens)).astype(np.int64) if len(code) else np.zeros(len(lens), np.int64)
    return pa.table({"doc_id": rows["doc_id"], **{c: rows[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": rows["groups_sha256"]})


class Block:
    """Rows of one block while it is gathered."""

    def __init__(self):
        self.chars, self.ids, self.rows = 0, [], []

    def add(self, ids: pa.Array, rows: pa.Table, chars: int) -> None:
        self.ids.append(ids)
        self.rows.append(rows)
        self.chars += chars

    @property
    def full(self) -> bool:
        return sum(map(len, self.ids)) >= BLOCK_TEXTS

    def parts(self, number: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``_PARTS``."""
        rows = pa.concat_tables(self.rows).combine_chunks()
        flat = pa.table({"pair": rows["pairs"].combine_chunks().flatten(), "n": rows["times"].combine_chunks().flatten()})
        sums = flat.group_by("pair", use_threads=False).aggregate([("n", "sum")])
        order = np.argsort(sums["pair"].to_numpy())
        pairs, n = sums["pair"].to_numpy()[order], sums["n_sum"].to_numpy()[order]
        sealed = _sealed(pa.concat_arrays(self.ids), rows, pairs)
        yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "rows": pa.array([sealed], pa.binary()), "pair": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64())})
        for s in range(0, len(pairs), 100_000):
            own = pairs[s : s + 100_000]
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(own), number)), "rows": pa.nulls(len(own), pa.binary()), "pair": pa.array(own), "n": pa.array(n[s : s + 100_000])})


def _filled(aligned: pa.Table, count: int) -> pa.Table:
    """A row for each of ``count`` texts, zeros for those that are not in ``aligned``, in their order."""
    at = np.full(count, -1)
    at[aligned["place"].to_numpy()] = np.arange(len(aligned))
    take = pa.array(np.where(at < 0, 0, at), mask=at < 0)
    rows = aligned.drop_columns(["place"]).take(take)
    out = {}
    for name in rows.column_names:
        column = rows[name].combine_chunks()
        if pa.types.is_list(column.type):
            lens = column.value_lengths().fill_null(0).to_numpy()
            out[name] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lens]), pa.int32()), column.flatten())
        else:
            out[name] = column.fill_null("" if pa.types.is_string(column.type) else 0)
    return pa.table(out)


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``_PARTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = Tokenizers()
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            texts = texts_of(batch.column("text").to_pylist())
            ids = batch.column("doc_id").cast(pa.int64())
            for a, b in portions(texts, AT_ONCE):
                own = texts[a:b]
                there = [i for i, t in enumerate(own) if t]
                rows = align([own[i] for i in there], known)
                rows = rows.set_column(0, "place", pa.array(np.array(there, np.int64)[rows["place"].to_numpy()]))
                block.add(ids.slice(a, b - a), _filled(rows, b - a), sum(map(len, own)))
                if block.chars >= block_chars or block.full:
                    yield from block.parts(number)
                    number, block = number + 1, Block()
        if block.rows:
            yield from block.parts(number)

    return docs.select("doc_id", "text").mapInArrow(run, _PARTS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair in the corpus, and whether no other pair of its B id has more."""
    wide = Tokenizers().wide
    totals = parts.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(F.col("pair") % wide)))


def aligned(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text)."""
    parts = written(blocks(docs, block_chars))
    asked = parts.where("pair is not null").select(F.col("block").alias("asked_by"), "pair")
    answers = asked.join(pair_counts(parts), "pair").select("asked_by", "pair", "total", "best")
    rows = parts.where("rows is not null").select("block", "rows")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order]
        return pa.concat_tables([_answered(x.as_py(), total, best) for x in left["rows"]])

    return rows.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(meet, SCHEMA)
