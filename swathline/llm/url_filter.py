"""URL filters by a sorted array of digests.

A rule is a host and a path prefix, written together (``example.com/en/``); it
fits its host and all subdomains if the url's path starts with the rule's, and
of several that fit the longest text wins, of equally long ones that of the
longer host. The rules' 64-bit xxHash digests are sorted in an array that every
task memory-maps, with the full texts behind it. A url's candidates (host
suffixes at label borders, path prefixes of the lengths that rules have) are
hashed, looked up by binary search all together, and confirmed by the stored
text, so a digest collision never decides.

The array goes to the tasks as one broadcast, of at most ``LIMIT`` bytes; a
longer list is joined by Spark on the same candidates (``judge_by_join``).

Edge cases: a null url or one without ``://`` has an empty host and path and
fits no rule; a host stands as written but for A-Z (ports, dots and user names
are not understood); equal rows give equal rows; an empty table gives an empty
one; with no rules every url gets the default verdict; other columns play no part.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
LIMIT = 64 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    m = _URL.search(url) if isinstance(url, str) else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _digests(texts: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, texts), np.uint64, len(texts))


def compile_list(entries: list[str]) -> bytes:
    """Digests, ends and texts of distinct entries, sorted by digest, as bytes to be memory-mapped."""
    raw = [e.encode() for e in dict.fromkeys(entries)]
    keys = _digests(raw)
    order = np.argsort(keys, kind="stable")
    raw = [raw[i] for i in order]
    ends = np.cumsum([0, *map(len, raw)])
    return b"".join([np.array([len(raw)], np.int64).tobytes(), keys[order].tobytes(), ends.astype(np.int64).tobytes(), *raw])


class DigestArray:
    """A compiled list, memory-mapped from an unnamed file."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing stays behind
            f.write(compiled)
            f.flush()
            self.mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.mapped, np.int64, 1)[0])
        self.keys = np.frombuffer(self.mapped, np.uint64, n, 8)
        self.ends = np.frombuffer(self.mapped, np.int64, n + 1, 8 + 8 * n)
        self.text_at = 16 + 16 * n

    def holds(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text is in the list."""
        keys = _digests(texts)
        at = np.searchsorted(self.keys, keys)
        out = np.zeros(len(texts), bool)
        live = np.flatnonzero(at < len(self.keys))
        while len(live):  # one step, but for digests that two entries share
            live = live[self.keys[at[live]] == keys[live]]
            a, b = self.ends[at[live]], self.ends[at[live] + 1]
            same = np.fromiter((self.mapped[self.text_at + x : self.text_at + y] == texts[i] for i, x, y in zip(live, a, b, strict=True)), bool, len(live))
            out[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[at[live] < len(self.keys)]
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """The rules that would fit, longest text first, then longest host. ``lengths``: of rules' paths."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


def judge(pages: DataFrame, rules: dict[str, str], default: str = "allow") -> DataFrame:
    """One row of ``SCHEMA`` per row of ``pages`` (page_id, url); ``rules`` has the verdict of each rule."""
    rules = {"".join(split_rule(r)): v for r, v in rules.items()}
    compiled = compile_list(list(rules))
    spark = pages.sparkSession
    if len(compiled) > LIMIT:
        return judge_by_join(pages, spark.createDataFrame(list(rules.items()), "rule string, verdict string"), default)
    lengths = sorted({len(split_rule(r)[1]) for r in rules}, reverse=True)
    shared = spark.sparkContext.broadcast((compiled, rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, verdicts = shared.value
        array = DigestArray(compiled)
        for pdf in batches:
            split = [parts(u) for u in pdf["url"]]
            own = {x: candidates(*x, lengths) for x in dict.fromkeys(split)}
            probes = list(dict.fromkeys(c for cs in own.values() for c in cs))
            held = {p for p, ok in zip(probes, array.holds([p.encode() for p in probes]), strict=True) if ok}
            best = {x: next((c for c in cs if c in held), None) for x, cs in own.items()}
            rule = [best[x] for x in split]
            yield pd.DataFrame(
                {"page_id": pdf["page_id"].astype("Int64").array, "host": [h for h, _ in split], "path": [p for _, p in split], "rule": rule, "verdict": [default if r is None else verdicts[r] for r in rule]}
            )

    return pages.select("page_id", "url").mapInPandas(run, SCHEMA)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for a list of any length, ``rules`` (rule, verdict): candidates meet rules by a join on distinct urls' parts."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = pages.select(
        F.col("page_id"),
        F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), upper, lower).alias("host"),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    lengths = rules.select(F.length("rule") - F.length(F.substring_index("rule", "/", 1))).distinct().toDF("n")
    hosts = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    probes = split.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(hosts).alias("h"))
    probes = probes.join(F.broadcast(lengths), F.col("n") <= F.length("path"))  # as many rows as rules have path lengths
    probes = probes.select("host", "path", F.length("h").alias("hl"), F.concat("h", F.expr("substring(path, 1, n)")).alias("rule"))
    best = probes.join(rules, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "hl")).alias("b"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
