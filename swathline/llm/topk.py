r"""Exact top-k by inner product over norm-sorted vectors.

Vectors are integers, floor(scale * x) of each component. Spark sorts them by
descending length into blocks of bounded size, in the narrowest integers that
hold them; the block of the longest ones gives every query a first threshold, its
k-th best score there. A query block then goes only to those blocks whose longest
vector, by Cauchy-Schwarz, could still reach the threshold of one of its queries;
block and query block meet in a join on the block, so a task holds one of each.
Inside, candidates come in short runs of falling length. Vectors are rotated by
the singular vectors of the whole table, so that the first components carry most
of a product. Products are summed up over growing parts of the components
(``STAGES``); after a part, a candidate is dropped if its sum plus the product of
the residual lengths stays below the running k-th score. Stages that drop little
are passed over in the next run. What is left when few are, or at the end, gets
its exact integer score. Spark ranks the survivors.

The rotation comes from the d x d matrix of inner products of components, which
tasks sum up; only that matrix reaches the driver.

Edge cases: vectors that are null or hold a null, NaN or infinity take no part,
nor do rows without an id; shorter vectors count as padded with zeros; zero
vectors score 0; components and scores beyond 64 bits saturate; ties go to the smaller id;
rows that share the query's id are its own, and of a repeated query the smallest
vector (component by component) asks, while repeated candidates stay; with fewer than k candidates all are returned;
an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCHEMA = "query_id bigint, rank int, vec_id bigint, score bigint"
RUN = 512
#: After which shares of the components bounds are tested; beyond ``FEW`` of the pairs the next part is summed up for all.
STAGES, FEW = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8), 0.05
_BLOCK = "block bigint, n int, width int, longest double, ids binary, data binary"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v, norm): integer vectors and their lengths, of valid rows."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def gram(rows: DataFrame, dim: int) -> np.ndarray:
    """The dim x dim matrix of component products over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = _matrix(pdf["v"], dim).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dim * dim), "x": total.ravel()})

    sums = rows.select("v").mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(dim * dim)
    out[sums["i"]] = sums["x"]
    return out.reshape(dim, dim)


def _packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows of ``_BLOCK``: up to ``size`` vectors of a partition each, in their order, as integers of ``width`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []

        def out(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
            m = _matrix(pdf["v"], dim)
            width = next(w for w in (2, 4, 8) if w == 8 or np.abs(m, dtype=float).max(initial=0) < 1 << 8 * w - 1)
            return pd.DataFrame([(k, len(pdf), width, float(pdf["norm"].max()), pdf["vec_id"].to_numpy(np.int64).tobytes(), m.astype(f"i{width}").tobytes())], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= size:
                pdf = pd.concat(held)
                yield out(pdf.iloc[:size], k)
                held, k = [pdf.iloc[size:]], k + 1
        if sum(map(len, held)):
            yield out(pd.concat(held), k)

    return rows.mapInPandas(run, _BLOCK)


def _unpacked(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, f"i{width}").reshape(len(ids), -1).astype(np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~score))[:k]  # ~ turns the order round without overflow


class Search:
    """A block of candidates, sorted by falling length, that query blocks are searched in. ``pruned`` counts pairs: all, left by length, left by sums."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray):
        self.ids, self.c, self.rotation = ids, c, rotation
        self.f = c.astype(float)
        self.norm = np.linalg.norm(self.f, axis=1)
        self.turned = self.f @ rotation
        dim = c.shape[1]
        self.cuts = sorted({max(1, round(dim * s)) for s in STAGES} - {dim})
        self.rest = self._rests(self.turned)
        self.stage = 0
        self.pruned = np.zeros(3, np.int64)

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        """Lengths of what is left of the vectors after each part."""
        return [np.linalg.norm(turned[:, n:], axis=1) for n in self.cuts]

    def _exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, plain: bool) -> np.ndarray:
        """Integer scores of pairs."""
        if plain:  # sums below 2**52 are exact in float64
            out = np.zeros(len(i), np.int64)
            for s in range(0, len(i), 1 << 16):
                out[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[i[s : s + (1 << 16)]].astype(float), self.f[j[s : s + (1 << 16)]]).astype(np.int64)
            return out
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        return np.array([min(max(sum(map(int.__mul__, q[a].tolist(), self.c[b].tolist())), low), high) for a, b in zip(i, j, strict=True)], np.int64)

    def of(self, q_ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each query place: ids and scores of its up to k best candidates that reach ``limit``."""
        qf = q.astype(float)
        qn = np.linalg.norm(qf, axis=1)
        plain = float(qn.max(initial=0)) * float(self.norm.max(initial=0)) < 2.0**52
        turned = qf @ self.rotation
        rest = self._rests(turned)
        limit = limit.copy()
        found: list[list] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in q_ids]
        self.pruned[0] += len(q_ids) * len(self.ids)
        for a in range(0, len(self.ids), RUN):
            b = min(len(self.ids), a + RUN)
            slack = 1 + 1e-9 * qn * self.norm[a]
            live = np.flatnonzero(qn * self.norm[a] + slack >= limit)
            if not len(live):
                break  # all that follow are shorter
            self.pruned[1] += len(live) * (b - a)
            need = (limit[live] - slack[live])[:, None]
            total, done, stage = 0.0, 0, min(self.stage, len(self.cuts))
            while True:
                upto = self.cuts[stage] if stage < len(self.cuts) else q.shape[1]
                total = total + turned[live, done:upto] @ self.turned[a:b, done:upto].T
                done = upto
                keep = total + (rest[stage][live, None] * self.rest[stage][None, a:b] if stage < len(self.cuts) else 0.0) >= need
                share = keep.mean()
                if share <= FEW or stage >= len(self.cuts):
                    break
                stage += 1
            self.stage = max(0, stage - 1) if share < FEW / 5 else stage
            i, j = np.nonzero(keep)
            self.pruned[2] += len(i)
            if plain and share > 4 * FEW:
                score = (qf[live] @ self.f[a:b].T)[i, j].astype(np.int64)
            else:
                score = self._exact(q, live[i], a + j, plain)
            good = (score >= limit[live[i]]) & (q_ids[live[i]] != self.ids[a + j])
            i, j, score = live[i[good]], a + j[good], score[good]
            edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(0, np.int64)
            for s, e in zip(edges, edges[1:]):
                at = i[s]
                ids, scores = np.concatenate([found[at][0], self.ids[j[s:e]]]), np.concatenate([found[at][1], score[s:e]])
                top = _best(ids, scores, k)
                found[at] = [ids[top], scores[top]]
                if len(top) == k:
                    limit[at] = max(limit[at], float(scores[top[-1]]))
        return [(i, ids, scores) for i, (ids, scores) in enumerate(found) if len(ids)]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """Rows of ``SCHEMA``: for every row of ``vectors`` (vec_id, embedding) where ``queries`` holds, its k best others.

    ``block`` and ``query_block``: vectors in one; by default of up to 16 MB and 2 MB as 64-bit numbers.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count_if(queries).alias("asked")).first()
    if not size.n:
        return spark.createDataFrame([], SCHEMA)
    dim = max(1, size.dim)
    share = -(-size.n // (2 * spark.sparkContext.defaultParallelism))  # small tables are dealt to all cores too
    block = block or max(RUN, min((2 << 20) // dim, share))
    query_block = query_block or max(64, min((256 << 10) // dim, 4096))
    _, rotation = np.linalg.eigh(gram(rows, dim))
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(rotation[:, ::-1]))
    # Equal lengths, of copies say, are told apart by the id, so that no range grows with them.
    order = rows.withColumn("down", -F.col("norm"))
    blocks = written(_packed(order.repartitionByRange(-(-size.n // block), "down", "vec_id").sortWithinPartitions("down", "vec_id"), dim, block))
    # The number first, of narrow rows; then the one block, which is of bounded size.
    longest = blocks.groupBy().agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("block")).first().block
    longest = blocks.where(F.col("block") == longest).select("ids", "data", "width").first()
    first = spark.sparkContext.broadcast((bytes(longest.ids), bytes(longest.data), longest.width))

    asked = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("r")).select("vec_id", "r.v", "r.norm", (-F.col("r.norm")).alias("down"))
    asked = asked.repartitionByRange(max(1, -(-size.asked // query_block)), "down", "vec_id").sortWithinPartitions("down", "vec_id")

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = Search(*_unpacked(*first.value), shared.value)
        for pdf in batches:
            out, reach = [], []
            for row in pdf.itertuples():
                ids, q = _unpacked(row.ids, row.data, row.width)
                limit = np.full(len(ids), -np.inf)
                for i, _, scores in head.of(ids, q, limit, k):
                    if len(scores) == k:
                        limit[i] = float(scores[-1])
                norm = np.linalg.norm(q.astype(float), axis=1)
                need = np.where(limit > 0, limit / np.maximum(norm, 1e-300), 0.0)  # of a candidate's length
                out.append(limit.tobytes())
                reach.append(float(need.min()) * (1 - 1e-9) - 1)
            yield pdf.assign(limits=out, reach=reach)

    asked = written(_packed(asked, dim, query_block).mapInPandas(limits, _BLOCK + ", limits binary, reach double"))
    # Descriptors meet by the length's level, a few hundred at most; payloads by the block.
    level = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1.0))) * 8).cast("int")
    levels = F.array(*[F.lit(r.level) for r in blocks.select(level(F.col("longest")).alias("level")).distinct().collect()])
    marks = blocks.select(F.col("block").alias("c_block"), level(F.col("longest")).alias("level"), "longest")
    wanted = asked.select("block", "reach", F.explode(F.filter(levels, lambda x: x >= level(F.col("reach")))).alias("level"))
    pairs = wanted.join(marks, "level").where("longest >= reach").select("block", "c_block")
    sent = asked.select("block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"), "limits").join(pairs, "block")
    held = blocks.select(F.col("block").alias("c_block"), "ids", "data", "width")
    both = sent.join(held, "c_block").select("c_block", "q_ids", "q_data", "q_width", "limits", "ids", "data", "width")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, search = None, None
        for pdf in batches:
            for row in pdf.itertuples():
                if row.c_block != now:  # rows of a block come together
                    now, search = row.c_block, Search(*_unpacked(row.ids, row.data, row.width), shared.value)
                q_ids, q = _unpacked(row.q_ids, row.q_data, row.q_width)
                got = search.of(q_ids, q, np.frombuffer(row.limits), k)
                if got:
                    i, ids, scores = zip(*got, strict=True)
                    yield pd.DataFrame({"query_id": np.repeat(q_ids[list(i)], list(map(len, ids))), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    found = both.mapInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
