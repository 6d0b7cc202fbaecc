r"""SimHash near-duplicates by a Gray-order hierarchical index.

A text is lower-cased in A-Z, cut into words ``[^\x20\x09-\x0D]+`` and shingles
of three words; a fingerprint bit is set where over half the shingles' XXH64
values have it. Fingerprints that differ in at most ``most`` bits are linked,
and a group is what links reach.

How links are found: two fingerprints within three bits agree on one of four
16-bit blocks, so each distinct fingerprint goes to four buckets, one per block
and value (with many fingerprints, to sixteen buckets of 28 bits, by the same
argument on the rest). A task holds many buckets. In each bucket the
fingerprints are sorted by Gray rank, so that neighbours share long bit
patterns; nodes over 8, 64, ... neighbours hold the bits that all of them share.
A search goes down from the root, adds up the differences in the bits that a
node is the first to fix, and leaves a whole group once they exceed the limit,
or once the group is known to belong to the searcher's own component. What a
task returns is a forest over its fingerprints, never all pairs. A bucket of
over ``chunk`` fingerprints is dealt out as pairs of chunks, so no task has to
hold it and no link is lost. Components then form by alternating
large-star and small-star steps over tables in the shared folder.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; a text of one or two words has one shingle, the whole sequence; equal
texts share a fingerprint; a null ``doc_id`` is the largest, and a group
of null ids only has a null ``component_id``; an empty table gives an empty one;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, texts_of, written

SCHEMA = "doc_id bigint, fingerprint string, component_id bigint"
SHINGLE, SEED, FAN = 3, 42, 8
#: Up to so many distinct fingerprints the buckets are of 16 bits, above it of 28 bits.
FEW = 4_000_000


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    sums, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for a in range(0, n, 50_000):
        part = words[a : a + 50_000 + SHINGLE - 1]
        h = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])), ">u8", len(part) - SHINGLE + 1)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer, and ``content`` if that column of strings is given."""
    schema = "doc_id bigint, fp bigint" + ", content string" * len(others)
    more = bool(others)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            fp = np.fromiter((fingerprint(t) for t in texts_of(pdf["text"])), np.uint64, len(pdf))
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "fp": fp.view(np.int64)})
            yield out.assign(content=pdf["content"].array) if more else out

    return docs.select("doc_id", "text", *others).mapInPandas(run, schema)


def content_of(docs: DataFrame) -> Column:
    """The digest of a text; empty for null."""
    return F.coalesce(F.sha2(docs["text"], 256), F.lit(""))


# ---- the index -------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A hierarchy over fingerprints sorted by (bucket, Gray rank); every bucket has a root of its own."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        _, bucket = np.unique(bucket, return_inverse=True)
        order = np.lexsort((gray_rank(fp), bucket))
        self.fp, bucket = fp[order], bucket[order]
        self.order = order
        n = len(fp)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
        place = np.arange(n) - starts[bucket] if n else np.zeros(0, np.int64)
        self.root = bucket
        #: Of each level: first leaf, first child, number of children, bits fixed here first, their pattern.
        self.levels: list[tuple] = []
        child_first, low, high = np.arange(n), self.fp, self.fp
        width = FAN
        while n:
            top = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (place[1:] // width != place[:-1] // width)])
            kids = np.searchsorted(child_first, top)
            low, high = np.bitwise_and.reduceat(low, kids), np.bitwise_or.reduceat(high, kids)
            self.levels.append([top, kids, np.diff(np.r_[kids, len(child_first)]), ~(low ^ high), low])
            child_first = top
            if len(top) == len(starts):
                break
            width *= FAN
        self.levels.reverse()  # roots first
        for up, down in zip(self.levels, self.levels[1:]):
            parent = np.repeat(np.arange(len(up[0])), up[2])
            down.append(down[3] & ~up[3][parent])
        if self.levels:
            self.levels[0].append(self.levels[0][3])
        self.leaf_parent = np.repeat(np.arange(len(self.levels[-1][0])), self.levels[-1][2]) if n else np.zeros(0, np.int64)

    def links(self, most: int, label: np.ndarray | None = None) -> np.ndarray:
        """The component of each leaf, as the place of one of its members: what links of up to ``most`` bits reach."""
        n = len(self.fp)
        label = np.arange(n)
        step = 16
        a = 0
        while a < n:
            q = np.arange(a, min(n, a + step))
            spans = [(np.minimum.reduceat(label, t[0]), np.maximum.reduceat(label, t[0])) for t in self.levels]
            node, acc = self.root[q], np.zeros(len(q), np.int64)
            for k, level in enumerate(self.levels):
                acc = acc + np.bitwise_count((self.fp[q] ^ level[4][node]) & level[5][node])
                low, high = spans[k]
                go = (acc <= most) & ~((low[node] == high[node]) & (low[node] == label[q]))
                q, node, acc = q[go], node[go], acc[go]
                count = level[2][node]
                at = np.repeat(level[1][node] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                q, acc, node = np.repeat(q, count), np.repeat(acc, count), at
            fixed = self.levels[-1][3][self.leaf_parent[node]]
            acc = acc + np.bitwise_count((self.fp[q] ^ self.fp[node]) & ~fixed)
            near = (acc <= most) & (q != node)
            label = _joined(label, q[near], node[near])
            a += step
            step = min(4096, step * 2)
        return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after joining the components of a[i] and b[i]; a label is the smallest place of its component."""
    if not len(a):
        return label
    x, y = label[a], label[b]
    other = x != y
    x, y = x[other], y[other]
    parent = np.arange(len(label))
    while len(x):
        high, low = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        other = x != y
        x, y = x[other], y[other]
    return parent[label]


def _forest(batches: Iterator[pd.DataFrame], most: int, at_once: int = 400_000) -> Iterator[pd.DataFrame]:
    """Rows (bucket, fp) sorted by bucket: for each fingerprint that is linked in its bucket, a link towards its component."""

    def of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts)
        index = GrayIndex(pdf["bucket"].to_numpy(), pdf["fp"].to_numpy(np.int64).view(np.uint64))
        label = index.links(most)
        linked = label != np.arange(len(label))
        fp = index.fp.view(np.int64)
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n >= at_once:
            pdf = pd.concat(held)
            cut = int(np.searchsorted(pdf["bucket"].to_numpy(), pdf["bucket"].iat[-1]))  # the last bucket may go on
            if cut:
                yield of([pdf.iloc[:cut]])
            held, n = [pdf.iloc[cut:]], len(pdf) - cut
    if n:
        yield of(held)


def linked_fingerprints(fps: DataFrame, most: int = 3, chunk: int = 4096, few: int = FEW) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that leave the same components as all links of ``most`` bits."""
    if most != 3:
        raise ValueError("the buckets are made for differences of up to 3 bits")
    n = fps.count()
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
    if n <= few:
        keys = F.array(*[block(i) + F.lit(i) * 65536 for i in range(4)])
    else:  # the other 48 bits hold the differences: one of their four parts of 12 bits agrees too
        parts = []
        for i in range(4):
            rest = F.shiftleft(F.shiftrightunsigned("fp", 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("bigint")
            rest = rest.bitwiseOR(F.col("fp").bitwiseAND((1 << 16 * i) - 1)).bitwiseAND((1 << 48) - 1)
            parts += [(F.lit(i * 4 + j).cast("bigint") * (1 << 28)) + block(i) * 4096 + F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF) for j in range(4)]
        keys = F.array(*parts)
    dealt = fps.select("fp", F.explode(keys).alias("bucket"))
    sizes = written(dealt.groupBy("bucket").count().where(F.col("count") > chunk))
    if sizes.isEmpty():
        dealt = dealt.select(F.xxhash64("bucket").alias("bucket"), "fp")
    else:
        # chunk c of r meets every chunk, itself included: r rows, as pairs (least, greatest)
        r = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), F.col("r"))
        dealt = dealt.join(sizes, "bucket", "left").select("bucket", "fp", r.alias("r")).select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("other"))
        dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(lambda it: _forest(it, most), "a bigint, b bigint").distinct()


# ---- components ------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of ``edges`` (a, b) with the smallest vertex that links reach.

    Alternating large-star and small-star steps; each one's links are a table in
    the shared folder, so a lost executor repeats one step at most.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large-star: every larger neighbour is linked to the smallest one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        # small-star: every smaller neighbour, and the vertex, is linked to the smallest one
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        links = written(small)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return links.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = now


def _roots(marked: DataFrame, most: int, chunk: int) -> DataFrame:
    """(fp, root, first): each fingerprint of ``marked`` (doc_id, fp) with its component's root and its own smallest id."""
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked_fingerprints(firsts.select("fp"), most, chunk))
    return written(roots.withColumnRenamed("v", "fp").join(firsts, "fp", "right").select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def near_duplicates(docs: DataFrame, most: int = 3, chunk: int = 4096) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs`` (doc_id, text)."""
    marked = written(fingerprints(docs))
    named = _roots(marked, most, chunk)
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(named.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, most: int = 3, chunk: int = 4096) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns: the smallest ``doc_id``, nulls last, then the smallest digest of the text."""
    marked = written(fingerprints(docs, content_of(docs).alias("content")))
    rooted = marked.join(_roots(marked, most, chunk).select("fp", "root"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "content")).alias("m"))
    first = written(first.select(F.col("m.doc_id").alias("_first"), F.col("m.content").alias("_first_content")))
    own = docs.withColumn("_content", content_of(docs))
    kept = own.join(first, own["doc_id"].eqNullSafe(first["_first"]) & (own["_content"] == first["_first_content"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_content"]).drop("_content")  # equal texts are of one group
