r"""Quality rules by line-first cleaning.

Every line is judged on its own by three rules; lines that fail are removed; a
document that loses too much of its text, or that fails the base rules, is
rejected.

* punctuation: over ``max_odd`` of the line's visible characters are neither
  letters, digits, marks nor ordinary sentence punctuation;
* navigation: under ``min_line_words`` words with no sentence punctuation, or a
  separator (``|``, ``>``, a bullet) for every two words beside it;
* boilerplate: a known notice phrase in a line of at most ``notice_words`` words,
  or a line of the corpus's own boilerplate.

The corpus's boilerplate is learned from all documents: lines of at most
``notice_chars`` characters that stand between different neighbours in at least
``common_share`` of the documents, and ``common_least`` times or more. A line of
copied documents has the same neighbours each time and counts once. As a share
of the documents, such lines are few whatever the corpus: at most the mean number
of lines of a document divided by ``common_share``.

All that is removed is lost text. A document is rejected if over ``max_failed`` of
its text is in lines that fail a rule of their own, or over ``max_lost`` of it is
lost by any rule, so none is kept without text. ``max_lost`` is the wider one, as
boilerplate is well-formed and says nothing about what stands around it: of 3,302
trusted documents of the test tables, none loses so much, and of 301 known as bad
that pass the base rules, nine in ten do by either share.

Words are runs of ``[^\x20\x09-\x0D]``. The base rules need ``min_words`` words
and at most ``max_repeat_pct`` per cent of the words in 8-word windows that the
text holds twice or more.

Edge cases: a null or empty text has no words and is rejected by the base
rules; a null ``doc_id`` is carried through; equal rows give equal rows; an
empty table gives an empty one; columns besides ``doc_id`` and ``text`` play no
part (``keep_good`` sets ``n_chars``, if there is one, to the cleaned text's). A
line of only white space is neither kept nor lost.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, n_lines bigint, n_failed_lines bigint, n_common_lines bigint, kept_chars bigint, failed_share double, lost_share double, kept boolean"
)
WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Fixed phrases of page notices in four languages, lower case.
NOTICES = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "aceptar cookies",
    "haga clic aquí",
    "política de cookies",
    "política de privacidad",
    "suscríbase a nuestro boletín",
    "todos los derechos reservados",
    "accepter les cookies",
    "cliquez ici",
    "conditions d'utilisation",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_pct: int = 30
    max_odd: float = 0.35
    min_line_words: int = 3
    notice_words: int = 25
    max_failed: float = 0.5
    max_lost: float = 0.8
    notice_chars: int = 300
    common_share: float = 0.01
    common_least: int = 20


_SENTENCE = re.compile(r"[.!?…:;。！？،؟।]")
_SEPARATOR = re.compile(r"[|>»›•·]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()«»–—‘-‟…̀-ͯऀ-෿　-〿＀-／،؟-]")
_NOTICE = re.compile("|".join(NOTICES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 8 words that occur twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Only windows with equal hashes are looked at as words, so a hash collision can't count.
    found = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = {int(i): tuple(words[i : i + WINDOW]) for i in found}
    often = Counter(windows.values())
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in windows.items():
        if often[w] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_fails(line: str, n_words: int, rules: QualityRules) -> bool:
    """Whether the line breaks one of the three line rules; ``line`` has ``n_words`` > 0 words."""
    odd = len(_ODD.findall(line))
    if odd and odd > rules.max_odd * (len(line) - sum(map(line.count, " \t\r\x0b\x0c"))):
        return True
    if n_words < rules.min_line_words and not _SENTENCE.search(line):
        return True
    if odd and 3 * len(_SEPARATOR.findall(line)) >= max(n_words, 3):
        return True
    return n_words <= rules.notice_words and _NOTICE.search(line.lower()) is not None


_BLANK = " \t\n\x0b\x0c\r"


def common_lines(docs: DataFrame, rules: QualityRules = QualityRules()) -> frozenset[bytes]:
    """Digests (MD5) of the corpus's own boilerplate lines; a bounded set, see above. Two counts, summed up in part before each shuffle."""
    least = max(rules.common_least, rules.common_share * docs.where("text is not null").count())
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "")
    # Each line with the lines before and after it, in one pass over the array.
    beside = lambda i: F.coalesce(F.get("l", i), F.lit(""))
    placed = F.transform("l", lambda x, i: F.struct(x.alias("x"), F.xxhash64(beside(i - 1), beside(i + 1)).alias("context")))
    rows = docs.select(lines.alias("l")).select(F.explode(F.filter(placed, lambda p: F.length(p["x"]) <= rules.notice_chars)).alias("p"))
    rows = rows.select(F.unhex(F.md5("p.x")).alias("line"), "p.context").distinct()
    return frozenset(bytes(r.line) for r in rows.groupBy("line").count().where(F.col("count") >= least).select("line").collect())


def _is_common(line: str, rules: QualityRules, common: frozenset[bytes]) -> bool:
    if not common:
        return False
    line = line.strip(_BLANK)
    return len(line) <= rules.notice_chars and hashlib.md5(line.encode("utf-8", "replace"), usedforsecurity=False).digest() in common


def judge(text: str, rules: QualityRules, common: frozenset[bytes] = frozenset()) -> tuple:
    """All columns of ``SCHEMA`` but ``doc_id``, and the cleaned text."""
    raw = text.encode("utf-8", "replace")
    word_chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    words: list[bytes] = []
    clean: list[str] = []
    dups = lines = failed = shared = kept_chars = all_chars = failed_chars = 0
    for line, line_raw in zip(text.split("\n"), raw.split(b"\n"), strict=True):
        own = line_raw.split()  # of bytes: splits at ASCII white space only, which is what a word excludes
        if not own:
            clean.append(line)
            continue
        words += own
        lines += 1
        dups += line in seen
        seen.add(line)
        all_chars += len(line)
        if line_fails(line, len(own), rules):
            failed += 1
            failed_chars += len(line)
        elif _is_common(line, rules, common):
            shared += 1
        else:
            kept_chars += len(line)
            clean.append(line)
    n_words, repeat = len(words), repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * repeat > rules.max_repeat_pct * n_words
    bad, lost = (failed_chars / all_chars, 1 - kept_chars / all_chars) if all_chars else (0.0, 0.0)
    kept = not base_failed and bad <= rules.max_failed and lost <= rules.max_lost
    return n_words, word_chars, n_symbols, dups, repeat, base_failed, lines, failed, shared, kept_chars, bad, lost, kept, "\n".join(clean)


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules(), common: frozenset[bytes] | None = None) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs``; after the count of lines, a narrow pass without a shuffle."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs, rules) if common is None else common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [judge(t, rules, shared.value)[:-1] for t in texts_of(pdf["text"])]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), common: frozenset[bytes] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; texts without the lines that failed or are the corpus's boilerplate."""
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs, rules) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t or "", rules, shared.value)[-2:] for t in batch.column("text").to_pylist()]
            for name, values in (("text", [clean for _, clean in found]), ("n_chars", [len(clean) for _, clean in found])):
                at = batch.schema.get_field_index(name)
                if at >= 0:
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch.filter(pa.array([kept for kept, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
