"""Whitening, token counts and tokenizer alignment against brute force."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathline.llm import alignment, queries, token_counts, whitening
from swathline.llm.bpe import Vocabulary, byte_letters
from swathline.llm.common import stretches

ODD = [
    (1, "a b " * 3000),
    (2, None),
    (3, ""),
    (4, "x" * 3000),
    (None, "Émile 日本語 ½ <|endoftext|> 🙂\n\n  tab\there's it's"),
    (None, "日本語" * 500),
    (5, "\0 a\0b <|endoftext|>"),
    (5, "\n\n\n"),
    (6, " " * 50 + "x"),
    (7, "word " * 10),
    (8, "ﬁ ligature <s> </s> <0x41> ▁x"),
    (8, "ﬁ ligature <s> </s> <0x41> ▁x"),
    (9, "a   b c\r\nd"),
    (10, " "),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("pair", F.lit("clash"))


def library(plain: bool) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = plain
    return t


# ---- 11 ----


def plain_whitening(vectors, components=8):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(dim)]
    a = np.array([[n * v[j] - sums[j] for j in range(dim)] for v in x], object)
    cov = np.array([[float(Fraction(int((a[:, i] * a[:, j]).sum()), n**3)) for j in range(dim)] for i in range(dim)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return np.array([min(d, 2**63 - 1) for d in (a * a).sum(1)], np.int64), (a / n).astype(float) @ w / np.sqrt(e), e / np.trace(cov)


def test_whitening_matches_exact_covariance(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, given = queries.op11_whitening(spark, sf_dir).toPandas(), df.toPandas()
    deviation, whitened, explained = plain_whitening(given["embedding"])
    assert len(got) == 8 * len(given) and got["identity_error"].max() < 1e-12
    for k in range(8):
        own = got[got.component == k + 1].set_index("vec_id").loc[given["vec_id"]]
        assert (own.n == len(given)).all() and (own.deviation == deviation).all()
        assert np.allclose(own.explained, explained[k], rtol=1e-10)
        sign = np.sign(whitened[:, k] @ own.whitened)
        assert np.allclose(own.whitened, sign * whitened[:, k], atol=1e-9)


def test_whitening_without_full_rank_or_scale(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(400, 6))
    m[:, 3], m[:, 4] = m[:, 0], 7  # a copy, and no variance but that of one shorter vector
    m = np.c_[m, m[:, :1] * 1e5 + (rng.random((400, 1)) < 0.01)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(m)] + [(600, None), (500, [1.0, None]), (501, [float("nan")]), (502, [float("inf")]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    got = whitening.whiten(df.repartition(3), 20).toPandas()
    deviation, _, explained = plain_whitening(np.r_[m, [[1.0, 2.0, 0, 0, 0, 0, 0]]], 20)
    assert got.component.max() == 6 and len(got) == 6 * 401 and got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first()[:5], explained[:5], rtol=1e-6)
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert set(got[got.vec_id.isna()].component) == set(range(1, 7))


def test_whitening_of_equal_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).count() == 0  # no variance
    got = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (2, [0.0, 0.0])], schema)).toPandas()
    assert got.deviation.max() == 2**63 - 1 and got.n.eq(3).all()


def test_factors_come_from_repeated_passes():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(500, 12)) * np.logspace(0, -7, 12)  # products of columns are beyond one Cholesky factor's reach
    passes = []

    def gram(factors):
        passes.append(len(factors))
        q = whitening.solved(m, factors)
        return q.T @ q

    r = whitening.orthogonalised(gram, 12)
    assert len(passes) >= 3 and np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(m, compute_uv=False), rtol=1e-9)


# ---- 12 ----


@pytest.mark.parametrize("kind", ["corpus's own", "few", "none"])
def test_token_counts_match_the_library(spark, odd, kind):
    words = {"corpus's own": None, "few": [b" a", b"zz", b" word"], "none": []}[kind]
    got = token_counts.count_tokens(odd.repartition(3), limit=100, words=words).collect()
    known = library(plain=False)
    want = [(i, len((t or "").encode()), n := len(known.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_token_counts_of_the_given_documents(spark, sf_dir):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf_dir).collect()}
    known = library(plain=False)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(known.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 512)


def test_hash_table_confirms_bytes(monkeypatch):
    words = [b"w%d" % i for i in range(500)] + [b"", b"\0", b"\0\0"]
    monkeypatch.setattr(token_counts, "digests_of", lambda w: np.array([len(x) % 3 for x in w], np.uint64))  # all collide
    table = token_counts.FrequentLengths(words, range(len(words)))
    assert table.of(words + [b"w1000", b"x"]).tolist() == [*range(len(words)), -1, -1]
    assert token_counts.FrequentLengths([], []).of([b"a"]).tolist() == [-1]


def test_summaries_keep_what_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([*(["often"] * 40), *(f"w{x}" for x in rng.integers(0, 10**6, 200))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert b" often" in token_counts.frequent(docs, Vocabulary(), most=8)
    counts = Counter({f"x{i}": i for i in range(100)})
    assert token_counts.reduced(counts, 10) == Counter({f"x{i}": i - 89 for i in range(90, 100)})
    assert token_counts.reduced(Counter(a=1, b=1, c=1), 2) == Counter()  # ties go together


def test_worker_cache_serves_what_the_table_lacks():
    v = Vocabulary()
    lengths = token_counts.Lengths(v, token_counts.FrequentLengths([b" the"], [1]))
    lengths.count(["the the zzyzx zzyzx", "the the zzyzx"])
    lengths.count([" zzyzx"])
    asked, table, encoded = lengths.asked
    assert (asked, table, encoded) == (4, 1, 2)  # "the", " the", " zzyzx", and " zzyzx" again, from the cache


def test_stretches_join_to_the_text():
    for text in ("", "abc", "ab cd ef gh", "  a  b c", "x" * 50, "日本 語 x"):
        for most in (1, 2, 5, 100):
            assert "".join(stretches(text, most)) == text
    assert list(stretches("ab cd ef", 1)) == ["ab", " cd", " ef"]


# ---- 13 ----


def plain_alignment(rows):
    """By definition: all pairs of tokens of each group whose ranges overlap."""
    a_lib, b_lib = library(plain=True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    counts, found = Counter(), []
    for doc_id, text in rows:
        links, a, b, groups = [], [], [], []
        if text:
            a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
            if not (b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()):
                a, b = [], []
            a, b = spans(a), spans(b)
            start = 0
            for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
                own = [[t for t in side if start < t[2] <= cut] for side in (a, b)]
                groups.append("|".join(",".join(str(t[0]) for t in side) for side in own))
                links += [(x[0], y[0]) for x in own[0] for y in own[1] if x[1] < y[2] and y[1] < x[2]]
                start = cut
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), d) for i, na, nb, ng, ls, d in found]


@pytest.mark.parametrize("block_chars", [100, 16_000_000])
def test_alignment_of_odd_texts(odd, block_chars):
    rows = [(i, t if t is None or len(t) < 2000 else t[:300]) for i, t in ODD]  # the plain version is quadratic in a text
    df = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash"))
    got = alignment.aligned(df.repartition(3), block_chars).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_alignment(rows), key=str)
    assert alignment.aligned(odd.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in alignment.aligned(odd.where("doc_id = 2")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_the_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.aligned(df, block_chars=50_000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_alignment(rows), key=str)


def test_stretches_have_a_border_in_both(monkeypatch):
    known = alignment.Tokenizers()
    text = "some words, x 12 and más: ünïts in a row\n\n  and on"
    whole = [known.ids_a(text).tolist(), known.ids_b(text).tolist()]
    monkeypatch.setattr(alignment, "stretches", lambda t: stretches(t, 3))
    assert [known.ids_a(text).tolist(), known.ids_b(text).tolist()] == whole
