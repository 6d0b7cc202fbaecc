"""Each training-data operator on edge cases and against brute force."""

import hashlib
import html as html_lib
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.llm import bpe, html_extract, langid, license_scan, packing, quality_lm, quality_rules, simhash, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"  # an extra column with a clashing name
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "one two three " * 10, "en", "s", 1, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, "x"),
    (4, LONG, "en", "s", 1, "x"),
    (5, "Tie one. Tie two.\nTie one. Tie two.\n", "de", "s", 1, "x"),
    (5, "Tie one. Tie two.\nTie one. Tie two.\n", "de", "s", 1, "x"),
    (None, "no id here", "fr", "s", 1, "x"),
    (7, "Émile 日本語 ½ <|endoftext|> 🙂", "fr", "s", 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- 1 ----


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 12)) * rng.lognormal(size=(300, 1))
    v[100:160] = v[100]  # many copies, so ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (401, [1.0, float("nan")] + [0.0] * 10), (402, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=32, query_block=4).toPandas()
    q = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    for i in range(0, 300, 20):
        score = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:7]
        own = got[got.query_id == i].sort_values("rank")
        assert list(own.vec_id) == best and list(own.score) == [score[j] for j in best]
    assert set(got.query_id) == set(range(0, 300, 20))


def test_top_k_of_repeated_ids_and_great_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (0, [1.0, 5.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [1e18, 1.0]), (3, [-1e18, 0.0]), (4, [3e9, 3e9])]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.lit(True), k=3, block=2, query_block=2).collect()
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    q = [(i, [clip(int(np.floor(64 * x))) for x in v]) for i, v in rows]
    for i in range(5):
        own = min(v for j, v in q if j == i)
        best = sorted(((-clip(sum(a * b for a, b in zip(own, v, strict=True))), j) for j, v in q if j != i))[:3]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == best


def test_top_k_bounds_prune():
    rng = np.random.default_rng(8)
    v = (64 * rng.normal(size=(4000, 64))).astype(int)
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    _, rotation = np.linalg.eigh((v.T @ v).astype(float))
    search = topk.Search(np.arange(4000), v, rotation[:, ::-1])
    got = search.of(np.arange(10_000, 10_040), v[::100], np.full(40, -np.inf), 5)
    scores = v[::100] @ v.T
    assert all(list(s) == sorted(scores[i], reverse=True)[:5] for i, _, s in got) and len(got) == 40
    assert search.pruned[2] < 0.2 * search.pruned[1]  # even where all directions weigh alike


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0, 0.5])], schema), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in two) == [(0, 1, 64 * 128), (1, 0, 64 * 128)]


# ---- 2 ----


def kn(texts, letters):
    """Plain interpolated modified Kneser-Ney of order 4 over characters; others than ``letters`` are spelt in bytes."""
    sym = {c: i + 2 for i, c in enumerate(letters)}
    spell = lambda t: [0, 0, 0, *(x for c in t for x in ([sym[c]] if c in sym else [-b for b in c.encode()]))]
    seq = [spell(t) for t in texts]
    counts = {4: Counter(tuple(s[i - 3 : i + 1]) for s in seq for i in range(3, len(s)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    model = {}
    for k, c in counts.items():
        d = quality_lm._discounts([sum(v == n for v in c.values()) for n in (1, 2, 3, 4)])
        cut = lambda n, d=d: d[min(n, 3) - 1]
        total, gone = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            gone[g[:-1]] += cut(n)
        model[k] = ({g: max(n - cut(n), 0) / total[g[:-1]] for g, n in c.items()}, {h: gone[h] / total[h] for h in total})

    def ppl(text):
        s = spell(text)
        logs = 0.0
        for i in range(3, len(s)):
            p = 1 / (len(letters) + 256)
            for k in (1, 2, 3, 4):
                a, g = model[k]
                p = a.get(tuple(s[i - k + 1 : i + 1]), 0.0) + g.get(tuple(s[i - k + 1 : i]), 1.0) * p
            logs += np.log(p)
        return np.exp(-logs / len(text))

    return ppl


def test_classifier_matches_a_plain_model(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality_lm, "ALPHABET", 40)  # the rarer letters of the counted text are spelt in bytes too
    rows = [(r.doc_id, r.text, r.lang) for r in real(spark, sf_dir).limit(80).collect()] + [(1000, "日本語の text, Ω½", None), (1001, None, "en"), (1002, "", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("clash"))
    labels = d.select("doc_id", F.lit(1).alias("quality")).where("doc_id % 3 <> 0 or doc_id = 1001")
    got = quality_lm.classify(d, labels, block_chars=20_000).toPandas().set_index("doc_id")
    held = {r.doc_id for r in d.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).collect()}
    trusted = {i for i, t, _ in rows if (i % 3 or i == 1001) and t}
    counted = [t for i, t, _ in rows if i in trusted - held]
    often = Counter("".join(counted))
    ppl = kn(counted, sorted(sorted(often, key=lambda c: (-often[c], c))[:40]))
    want = {i: ppl(t) if t else None for i, t, _ in rows}
    calm = [(lang, want[i]) for i, t, lang in rows if i in trusted & held]
    assert len(calm) > 3 and len({x for x, _ in calm}) > 1
    for i, _, lang in rows:
        own = [x for k, x in calm if k == lang] or [x for _, x in calm]
        limit = 1.25 * max(own)  # the 0.99 quantile of so few
        if want[i] is None:
            assert pd.isna(got.perplexity[i]) and not got.kept[i]
        else:
            assert got.perplexity[i] == pytest.approx(want[i], rel=1e-9)
            assert got.threshold[i] == pytest.approx(limit) and got.kept[i] == (want[i] <= got.threshold[i])
    assert got.kept.any() and not got.kept.all()


def test_classifier_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_lm.classify(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (2, 3))
    assert quality_lm.classify(none, labels).count() == 0
    untrusted = quality_lm.classify(docs, labels.where("false")).collect()
    assert len(untrusted) == len(ROWS) and not any(r.kept for r in untrusted)


# ---- 3 ----


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    often = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if often[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_lines(texts):
    """Lines that stand between different neighbours in 1 % of the texts, 20 times or more."""
    seen = {}
    for text in texts:
        own = [x for x in (re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x) for x in text.split("\n")) if x]
        for i, x in enumerate(own):
            if len(x) <= 300:
                seen.setdefault(x, set()).add((*own[max(0, i - 1) : i], "|", *own[i + 1 : i + 2]))
    return {x for x, c in seen.items() if len(c) >= max(20, 0.01 * len(texts))}


def brute_verdict(text, common):
    """Characters of failing, common and other lines, and the text without the first two, by the rules as they are written."""
    lost, shared, kept, clean = 0, 0, 0, []
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            clean.append(line)
            continue
        marks = set(".,;:!?'\"()«»–—‘’‚‛“”„‟…،؟-") | set(map(chr, [*range(0x300, 0x370), *range(0x900, 0xE00), *range(0x3000, 0x3040), *range(0xFF00, 0xFF10)]))
        odd = sum(not (c.isalnum() or c == "_" or c.isspace() or c in marks) for c in line)
        ends = any(c in ".!?…:;。！？،؟।" for c in line)
        bars = sum(c in "|>»›•·" for c in line)
        phrase = len(words) <= 25 and any(p in line.lower() for p in quality_rules.NOTICES)
        if odd > 0.35 * len("".join(words)) or (len(words) < 3 and not ends) or (odd and 3 * bars >= max(len(words), 3)) or phrase:
            lost += len(line)
        elif re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line) in common:
            shared += len(line)
        else:
            kept += len(line)
            clean.append(line)
    every = max(lost + shared + kept, 1)
    return lost / every, (lost + shared) / every, kept, "\n".join(clean)


def test_quality_rules_match_brute_force(spark, docs, sf_dir):
    pool = [f"A line that many texts have, number {i}." for i in range(3)]
    many = [(i, "\n".join([pool[i % 3], f"Own line {i} of the text with some more words in it.", f"And line {i * i} too."])) for i in range(90)] + [(100 + i, "Copied line one here.\nCopied line two here.") for i in range(50)]
    for df in (docs, real(spark, sf_dir), spark.createDataFrame(many, "doc_id long, text string")):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        rows = df.where("text is not null").count()
        common = brute_lines([r.text for r in df.where("text is not null").collect()])
        assert rows > 20 or not common
        report = {r.doc_id: r for r in quality_rules.quality_report(df).collect()}
        for i, r in report.items():
            if i != 4 or rows > 20:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (base := brute_quality(texts[i]))
            else:
                base = (30_000, len(LONG) - 29_999, 0, 0, 0)
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            failed, lost, kept_chars, _ = brute_verdict(texts[i], common)
            assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
            assert (r.failed_share, r.lost_share, r.kept_chars) == (pytest.approx(failed), pytest.approx(lost), kept_chars)
            assert r.kept == (not r.base_failed and failed <= 0.5 and lost <= 0.8)
        good = {r.doc_id: r.text for r in quality_rules.keep_good(df).collect()}
        assert good == {i: brute_verdict(texts[i], common)[3] for i, r in report.items() if r.kept}
        assert all(t.strip() for t in good.values())
    assert common == set(pool)  # not the copied lines


def test_quality_lines():
    rules = quality_rules.QualityRules()
    fails = lambda line: quality_rules.line_fails(line, len(line.split()), rules)
    assert fails("Home | News | Sport | Contact") and fails("Menu") and fails("Please accept cookies to go on.") and fails("a### b$$$ c%%% d&&&")
    assert not fails("This is a sentence.") and not fails("今日は良い天気です。")
    assert quality_rules.judge("Menu\nA good line of words.\n", rules)[-1] == "A good line of words.\n"


def test_no_document_is_kept_without_text(spark):
    pool = [" ".join(f"word{i}of{k}" for k in range(12)) + "." for i in range(6)]
    rows = [(i, "\n".join(x for k in range(4) for x in (pool[(i + k) % 6], f"Only this short line {k} of {i} is its own."))) for i in range(200)]
    rows += [(1000 + i, "\n".join(pool[(i * k + i) % 6] for k in (1, 2, 3, 5))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    report = {r.doc_id: r for r in quality_rules.quality_report(df).collect()}
    emptied = [i for i, r in report.items() if r.kept_chars == 0 and not r.base_failed]
    assert emptied and not any(report[i].kept for i in emptied)
    assert not {r.doc_id for r in quality_rules.keep_good(df).collect()} & set(emptied)


def test_quality_keeps_columns_and_takes_no_rows(docs, none):
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema and all(r.n_chars == len(r.text) for r in kept.collect())
    assert quality_rules.quality_report(none).count() == 0 and quality_rules.keep_good(none).count() == 0


# ---- 4 ----


def test_html_blocks():
    page = "<html><head><title>T</title></head><body><header>H</header><div class='ad'>AD<div>in</div></div><article><h1>Ti&amp;le</h1><p>one\n  two<p>three<b>x</b> y</p><form>f</form><div class=comments><p>c</p></div></article><script>if(a<b)</script><footer>F"
    assert [t for t, p in html_extract.blocks(page) if p == "main"] == ["Ti&le", "one two", "threex y"]
    assert html_extract.blocks("") == [] and html_extract.blocks("<article>cut <b")[0] == ("cut", "main")


def test_html_of_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    got = html_extract.extract(spark.createDataFrame(pages)).toPandas().set_index("page_id")
    for r in pages.itertuples():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        parts = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert got.text[r.page_id] == want and got.n_chars[r.page_id] == len(want)


def test_html_tags_follow_the_tokenizer():
    text = lambda page: [t for t, _ in html_extract.blocks(page)]
    assert text("<article><p class=it's>one</p><p>two</p></article>") == ["one", "two"]
    assert text("<article><!-->two<!--->three<!-- x --!>four</article>") == ["twothreefour"]
    assert text("<p a='>'b=c d>x</ y>z</><input value='>'>w<a href=/u/>v</a>") == ["xzwv"]
    assert text("<div/>a<p>b<svg/>c<select><option>n</select>d<canvas>e") == ["a", "bcde"]
    assert text("a < b <3 c</") == ["a < b <3 c</"]
    places = lambda page: [p for _, p in html_extract.blocks(page)]
    assert places("<div class=content-sidebar-wrap>x<article>y<ul class=comments><li><article>c</article></ul></article></div>") == ["soft", "main", "side"]
    assert places("<form id=all><main>m</main></form>") == ["main"] and places("<nav><article>n</article></nav>") == ["side"]


def brute_extract(rows, least=8):
    """The rules of the module, with plain dictionaries: {page_id: text}."""
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault(url_filter.parts(url)[0], set()).add(page or "")
    of = {}
    for host, pages in hosts.items():
        pages.discard("")
        where, tokens = {}, {}
        for page in pages:
            tokens[page] = [(w, p) for t, p in html_extract.blocks(page) for w in t.split()]
            for i in range(len(tokens[page]) - least + 1):
                where.setdefault(tuple(w for w, _ in tokens[page][i : i + least]), set()).add(page)
        for page in pages:
            hit = {"main": set(), "other": set()}
            for i in range(len(tokens[page]) - least + 1):
                n = len(where[tuple(w for w, _ in tokens[page][i : i + least])])
                main = tokens[page][i][1] == "main"
                if n >= max(4, len(pages) / 2) if main else n > 1:
                    hit["main" if main else "other"] |= set(range(i, i + least))
            mains = {i for i, (_, p) in enumerate(tokens[page]) if p == "main"}
            got = (hit["main"] if 2 * len(hit["main"] & mains) <= len(mains) else set()) | hit["other"]
            at, blocks = 0, []
            for t, p in html_extract.blocks(page):
                n = len(t.split())
                blocks.append((t, p, len(got & set(range(at, at + n))) / n))
                at += n
            for place, most in (("main", 0.8), ("open", 0.5), ("soft", 0.5)):
                every = [b for b in blocks if b[1] == place]
                if every:
                    of[host, page] = "\n\n".join(b[0] for b in [b for b in every if b[2] < most] or every)
                    break
    return {i: of.get((url_filter.parts(url)[0], page or ""), "") for i, url, page in rows}


@pytest.mark.parametrize("shard_chars", [1 << 18, 3000])
def test_html_matches_brute_force(spark, shard_chars):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 3000, n))
    notice, quote = [words(12) for _ in range(3)], words(60)
    rows = []
    for i in range(90):
        h = i % 3
        if i < 45:  # without an article
            rows.append((i, f"http://h{h}.x/", f"<div>{notice[h]}</div><div>{words(30)}</div><form>{words(4)}</form>"))
        else:  # a notice in every article of a host, a quotation in some
            rows.append((i, f"http://n{h}.x/", f"<nav>{words(9)}</nav><article><p>{words(25)}</p>" + (f"<p>{quote}</p>" if i % 5 == 0 else "") + f"<p>{words(20)}</p><p>{notice[h]}</p></article>"))
    copy = f"<article><p>{words(40)}</p></article>"
    rows += [(100 + i, "http://copies.x/a", copy) for i in range(6)]
    rows += [(110 + i, "http://near.x/a", f"<article><p>{quote}</p><p>{notice[0]}</p><p>{i}</p></article>") for i in range(6)]
    rows += [(None, None, None), (99, "http://h0.x/", ""), (98, None, "<p>bare</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, shard_chars=shard_chars).collect()
    assert {r.page_id: r.text for r in got} == brute_extract(rows) and len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert all(notice[i % 3] not in texts[i] for i in range(90)) and quote in texts[45] and quote in texts[111] and texts[100] == texts[105] != ""
    assert html_extract.extract(df.where("false")).count() == 0


def test_window_pages_by_hand():
    tokens = "a b a b \0 a b c \0".replace("\0", "|").split()
    page, stop = np.array([0] * 5 + [1] * 4), np.array([t == "|" for t in tokens])
    _, pages, whole = html_extract.window_pages([f"{t}{p}" if t == "|" else t for t, p in zip(tokens, page, strict=True)], page, stop, 2)
    assert list(pages[whole]) == [2, 1, 2, 2, 1]


# ---- 5 ----

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}


def test_url_rules(spark):
    cases = [
        ("http://a.example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("x.net/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://?a", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(list(RULES.items()), "rule string, verdict string")
    for got in (url_filter.judge(df, RULES), url_filter.judge_by_join(df, rules)):
        assert [(r.host, r.path, r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [c[1:] for c in cases]
    assert url_filter.judge(df.where("false"), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(df, {}, "block").collect()} == {"block"}


def test_digest_array_confirms_texts(monkeypatch):
    monkeypatch.setattr(url_filter, "_digests", lambda texts: np.array([len(t) for t in texts], np.uint64))  # all of one length collide
    array = url_filter.DigestArray(url_filter.compile_list(["aa", "bb", "cc", "d"]))
    assert list(array.holds([b"aa", b"bb", b"cc", b"xx", b"d", b"e", b"long one"])) == [True, True, True, False, True, False, False]


# ---- 6 ----


def test_packing_places_every_token(spark, docs, none, sf_dir):
    for df, per_salt in ((docs, 200_000), (real(spark, sf_dir), 200_000), (real(spark, sf_dir), 3)):
        got = packing.pack(df, per_salt=per_salt).toPandas()
        own = got.sort_values(["sequence_id", "offset"])
        assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
        assert own.groupby("sequence_id").length.sum().max() <= 1024
        assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 1024) * 1.01 + 1
        encoder = packing.Encoder()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*encoder.exact.encode(r.text or "", add_special_tokens=False).ids, 2]
            start, k = 0, 0
            while start < len(ids):
                n = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
                want[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
                start, k = start + n, k + 1
        assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert packing.pack(none).count() == 0


def test_plan_uses_each_length_exactly():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500):
        hist = np.bincount(rng.integers(1, 65, n), minlength=65) * 3
        used = np.zeros(65, int)
        for config, times in packing.plan(hist, 64):
            assert sum(k * a for k, a in config.items()) <= 64
            for k, a in config.items():
                used[k] += a * times
        assert (used == hist).all()


@pytest.mark.parametrize(("lengths", "most"), [((400, 330, 290), 90_000), ((505, 260, 252), 60_000)])
def test_plan_solves_the_program_without_perfect_fills(lengths, most):
    hist = np.zeros(1025, int)
    hist[list(lengths)] = most
    made, bound = packing.planned(hist, 1024)
    assert sum(times for _, times in made) <= 1.01 * bound
    assert sum(times for _, times in made) <= 1.001 * most
    program = packing.Program(hist, 1024)
    assert sum(times for _, times in program.run(1)) >= 0.99 * most  # by itself, not by best fit


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_plan_of_given_documents_is_near_the_bound(spark, sf):
    hist = np.zeros(1025, int)
    for r in packing.pieces(real(spark, f"/root/testdata/{sf}")).groupBy("length").count().collect():
        hist[r.length] = r["count"]
    made, bound = packing.planned(hist, 1024)
    used = sum(times for _, times in made)
    assert used <= 1.01 * bound and used <= sum(times for _, times in packing.best_fit(hist, 1024))
    program = packing.Program(np.r_[hist[:1024], 0], 1024)
    taken = sum(times for _, times in program.run(1))
    assert taken + hist[1024] >= 0.9 * used  # best fit closes the rest only
    assert (program.used <= hist).all() and program.bound <= used


def test_weights_find_the_bound_of_lengths_that_leave_room():
    hist = np.zeros(1025, int)
    hist[[600, 100]] = 1000  # every 600 needs a sequence of its own, whatever the weights of length say
    assert packing.planned(hist, 1024)[1] >= 990


# ---- 7 ----


def groups(fp):
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


@pytest.mark.parametrize(("chunk", "few"), [(4096, 10**6), (8, 10**6), (4096, 0), (8, 0)])
def test_links_reach_what_brute_force_reaches(spark, chunk, few):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(8)]
    fp = np.unique(np.array(near, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    roots = {r.v: r.root for r in simhash.components(simhash.linked_fingerprints(df, 3, chunk, few)).collect()}
    signed = fp.view(np.int64)
    got, want = [roots.get(int(x), int(x)) for x in signed], groups(fp)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    text = "A b\tC d a B c Ärger"
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want and simhash.fingerprint("") == 0 and simhash.fingerprint("One two") == xxh64_intdigest("one two", 42)


def test_near_duplicates_edge_cases(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    words = lambda k: " ".join(f"{k}x{i}" for i in range(40))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (3, words("c")), (7, words("d")), (7, words("e")), (9, words("e")), (None, None), (None, "")]
    kept = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter((i, t or "") for i, t in kept) == Counter([(None, words("a")), (None, words("b")), (3, words("c")), (7, words("d")), (7, words("e")), (None, "")])


# ---- 8 ----


def test_bpe_matches_the_library(spark, docs, none, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.Vocabulary().path)
    for df in (docs, real(spark, sf_dir)):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = Counter()
        for i, text in texts:
            ids = t.encode(text, add_special_tokens=False).ids
            back = t.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.encode_decode(df).collect()) == want
    assert bpe.encode_decode(none).count() == 0


def test_lexicon_shares_states_and_finds_places():
    words = sorted({w.encode() for w in "walking talking walked talked walk talk balk".split()})
    ids = [np.array([i, i + 1], "<u4").tobytes() for i in range(len(words))]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, ids))
    places = lexicon.places([*words, b"wal", b"walks", b""])
    assert list(places) == [*range(len(words)), -1, -1, -1]
    assert lexicon.ids_at(places[: len(words)]) == ids
    assert len(lexicon.final) < 16  # w, t and b share what follows
    assert list(bpe.Lexicon(bpe.compile_lexicon([], [])).places([b"a"])) == [-1]


# ---- 9 ----


def test_licences(spark, none):
    mit = license_scan.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Person\n" + mit.upper().replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (6, "# Released under the MIT Licence"), (None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    got = {r.doc_id: r.license_id for r in license_scan.scan(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT-line", None: "MIT"}
    assert license_scan.scan(none).count() == 0


def test_licences_in_other_wrappings(spark):
    texts = {k: t for k, t in (license_scan.TEXTS | license_scan.long_texts()).items() if "SPDX" not in k}
    rows = []
    for k, t in texts.items():
        words = t.split()
        rows += [(k.strip(), f"{w}", "\n".join(textwrap.wrap(" ".join(words), w, break_long_words=False, break_on_hyphens=False))) for w in (1, 30, 50, 66, 72, 79, 100, 10**6)]
    notice = "Copyright (c) 2020, 2021 A. Person <a@b.org>"
    for k, title in {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "Simplified BSD License", "Zlib": "The zlib License"}.items():
        for head in (title, notice, f"{title}\n\n{notice}\nAll rights reserved.", f"{notice}\n\nThe {title}", "Copyright A. Person"):
            rows += [(k, head, f"{head}\n\n{texts[k]}"), (k, head, " ".join(f"{head} {texts[k]}".split()))]
    rows.append(("BSD-3-Clause", "holder", texts["BSD-3-Clause"].replace("the copyright holder nor", "Some Company, Inc. nor")))
    rows += [(None, "prose", x) for x in ("MIT License", notice, "Copyright holders agree.\n" + texts["MIT"], "MIT License is nice.\n" + texts["MIT"])]
    df = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(df).collect()}
    assert [(*r[:2], got[i]) for i, r in enumerate(rows) if got[i] != r[0]] == []
    assert "authors or copyright holders be liable" in df.sparkSession.createDataFrame([(texts["MIT"],)], "t string").select(license_scan.canonical(F.col("t"))).first()[0]


@pytest.mark.parametrize("words", [10, 60, 400, 1000])
def test_licences_under_notices_of_any_length(spark, words):
    mit, bsd = license_scan.TEXTS["MIT"], license_scan.long_texts().get("BSD-3-Clause", license_scan.TEXTS.get("BSD-3-Clause"))
    people = " ".join(f"Person{i}," for i in range(words - 4))
    notice = f"Copyright (c) 2020 {people} Inc."
    rows = [f"{notice}\n\n{mit}", " ".join(f"{notice} {mit}".split()), "\n".join(textwrap.wrap(f"{notice} {mit}", 70, break_long_words=False, break_on_hyphens=False)), f"MIT License\n\n{notice}\nAll rights reserved.\n\n{mit}"]
    rows += [f"{mit}\n{notice}\n", f"{notice}\n\nSome prose of a page that is no notice.\n\n{mit}", bsd.replace("the copyright holder nor", f"{people} nor")]
    got = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "BSD-3-Clause"}


def test_licences_of_very_long_texts(spark):
    rows = [(1, "copyright 2020 x " + "word " * 300_000), (2, "neither the name of " * 2000), (3, "mit license " * 50_000), (4, "\n\n" * 100_000 + license_scan.TEXTS["MIT"])]
    got = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "MIT"}


# ---- 10 ----


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.07]])
    memo = {x: p[i, 0] for i, x in enumerate(pieces)}

    def total(s):
        if not s:
            return 1.0
        whole = sum(memo[s[:n]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in memo)
        return whole + langid.FLOOR * total(s[1:])

    got = np.exp(langid.word_logs(["ab", "bab", "abc"], p, langid.Pieces(pieces)))[:, 0]
    assert got == pytest.approx([total("▁ab"), total("▁bab"), total("▁abc")], rel=1e-4)


def test_long_words_are_summed_whole():
    rng = np.random.default_rng(2)
    pieces = sorted({"".join(rng.choice(list("abc"), n)) for n in (1, 2, 3, 5, 9, 16) for _ in range(12)} | {"▁"})
    p = rng.dirichlet(np.ones(len(pieces)), 3).T + 1e-9
    found = langid.Pieces(pieces)
    words = ["".join(rng.choice(list("abcx"), n, p=[0.4, 0.3, 0.28, 0.02])) for n in (1, 5, 17, 39, 40)]
    assert np.array([langid.long_word_log("▁" + w, p, found) for w in words]) == pytest.approx(langid.word_logs(words, p, found))
    long = "".join(rng.choice(list("abcx"), 700))
    logs, at = np.full((702, 3), -np.inf), {x: np.log(p[i]) for i, x in enumerate(pieces)}
    logs[0] = 0
    text = "▁" + long
    for end in range(1, 702):
        ways = [logs[end - 1] + np.log(langid.FLOOR)] + [logs[end - n] + at[text[end - n : end]] for n in range(1, min(16, end) + 1) if text[end - n : end] in at]
        logs[end] = np.logaddexp.reduce(ways)
    assert langid.word_logs([long], p, found)[0] == pytest.approx(logs[701])


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.05], [0.05, 0.2], [0.15, 0.15], [0.07, 0.2], [0.13, 0.1]])
    found = langid.Pieces(pieces)

    def ways(s):
        if not s:
            yield []
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                yield from ([pieces.index(s[:n]), *rest] for rest in ways(s[n:]))
        if s:
            yield from ([-1, *rest] for rest in ways(s[1:]))

    for words in (["ab", "abab", "baab", "abx"],):
        weights, langs = np.array([2.0, 1.0, 3.0, 1.0]), np.array([0, 1, 1, 0])
        want = np.zeros(p.shape)
        for w, n, k in zip(words, weights, langs, strict=True):
            every = [(x, np.prod([langid.FLOOR if i < 0 else p[i, k] for i in x])) for x in ways("▁" + w)]
            for x, q in every:
                for i in x:
                    if i >= 0:
                        want[i, k] += n * q / sum(q for _, q in every)
        assert langid.expected_counts(words, weights, langs, p, found) == pytest.approx(want)
        for w, k in zip(words, langs, strict=True):
            ids, c = langid._long_counts("▁" + w, p[:, k], found)
            one = langid.expected_counts([w], np.ones(1), np.array([k]), p, found)[:, k]
            assert np.bincount(ids, c, len(pieces)) == pytest.approx(one)


def test_the_vocabulary_is_whole():
    import sentencepiece

    import public_tokenizers

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = {m.id_to_piece(i).lower() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    assert set(langid.vocabulary()) == own and max(map(len, own)) > 8


def test_language_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = d.where("doc_id % 4 <> 2"), d.where("doc_id % 4 = 2")
    got = langid.predict(test, langid.train(train, sample_docs=60)).join(test.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edge_cases(docs, none):
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == len(ROWS) and all((r.lang_pred == "und") == (r.doc_id in (2, 3)) for r in got)
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}
    assert langid.keep_known(docs, langid.train(docs), 0.0).schema == docs.schema


def test_numerals_are_no_letters():
    model = langid.LanguageModel(["a", "b"], ["x"], np.array([[0.5, 0.1]]))
    assert [g[0] for g in langid.Scorer(model).texts(["½ Ⅷ 12", "", "x", "½x"])] == ["und", "und", "a", "a"]


# ---- pipeline ----


def brute_pipeline(spark, d):
    """Rows that reach the last stage, as (doc_id, cleaned text), by the brute-force parts above."""
    rows = [(r.doc_id, r.text) for r in d.collect()]
    common = brute_lines([t for _, t in rows if t is not None])
    good = []
    for i, t in rows:
        lost, _, clean = brute_verdict(t or "", common)
        base = brute_quality(t or "")
        if base[0] >= 20 and 100 * base[4] <= 30 * base[0] and lost <= 0.5:
            good.append((i, clean))
    langs = {(r.doc_id, r.text): r.lang for r in d.collect()}
    again = spark.createDataFrame([(i, c, langs.get((i, t))) for (i, t), c in ((x, brute_verdict(x[1] or "", common)[2]) for x in rows) if (i, c) in set(good)], "doc_id long, text string, lang string")
    model = langid.train(again)
    scorer = langid.Scorer(model)
    known = [(i, t) for i, t in good if (got := scorer.texts([t])[0])[0] != "und" and got[1] >= 0.5]
    fp = np.array([simhash.fingerprint(t) for _, t in known], np.uint64)
    first = {}
    for x, g in zip(known, groups(fp), strict=True):
        key = (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest())
        first[g] = min(first.get(g, (key, x)), (key, x), key=lambda y: y[0])
    return [x for _, x in first.values()]


def checked_pipeline(out, want):
    """The pieces of the pipeline's last stage are those of the wanted texts, placed without gaps or overlaps."""
    encoder = packing.Encoder()
    pieces = Counter()
    for i, text in want:
        ids = [*encoder.exact.encode(text, add_special_tokens=False).ids, 2]
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if k == 0 else 1024
            pieces[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, k = start + n, k + 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == pieces
    own = out.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all() and own.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_matches_brute_force(spark, sf_dir):
    import corpus_pipeline

    checked_pipeline(corpus_pipeline.run(spark, sf_dir).toPandas(), brute_pipeline(spark, real(spark, sf_dir)))


def test_pipeline_edge_cases(spark, sf_dir, tmp_path):
    import corpus_pipeline

    rows = [tuple(r)[:5] for r in real(spark, sf_dir).limit(60).collect()]
    good = next(r for r in rows if r[1] and len(r[1].split()) > 60 and r[1].count("\n") < 9)
    rows += [(None, good[1] + " And a word more.", None, None, None), (None, None, None, None, None), (rows[0][0], "Another text under a known id, " + " ".join(f"word{i}" for i in range(40)) + ".", "en", None, 1)]
    rows += [good, good, (9000, "", "en", "s", 0), (9001, " ".join(f"long{i}" for i in range(20_000)) + ".", "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1.5))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    checked_pipeline(out, brute_pipeline(spark, d))
    assert 9001 in set(out.doc_id) and 9000 not in set(out.doc_id)
    d.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema == d.schema, name
