r"""Main text of web pages by host suffix arrays.

A page is cut into blocks, each with a place: ``main`` (inside an article or
main element), ``side`` (inside a menu, header, footer, sidebar, notice, advert,
form or comment list, by element, role or class), ``soft`` (side by a form or a
compound class name only, which may as well be the wrapper of a whole page; an
article inside is ``main``) or ``open`` (neither). An article inside what is side
by one plain word of a class or id is ``main`` if the page has no other. Inside an
article, a paragraph is side by the names of adverts, notices and comments only, a
heading by none; a link, button or span never ends a block, and its words are
dropped only if the block has no others. Scripts, styles, comments and hidden
parts are not text. Tags are read by the states of the HTML tokenizer; heads,
cells, rows and items end where the next begins.

The token streams of a host's pages are concatenated; a suffix array over them,
sorted to the depth of ``least`` tokens, shows runs of that length or longer
that occur on distinct pages. What such runs cover goes:

* of ``open`` blocks, those covered by half or more by runs that another page
  has too;
* of ``main`` blocks, those covered by four fifths or more by runs that at least
  half of the host's pages have, four pages or more: an article may quote a
  passage that other articles have, but what most of a host's articles hold is a
  notice. A page of which runs cover over half of the main text is a copy of
  other pages, and stays whole.

The text is the ``main`` blocks; of a page without any the ``open`` ones, or
else the ``soft`` ones; if runs leave nothing of them, a copied page, they stay.

A large host is dealt out by content digest in shards of about ``shard_chars``
characters of HTML, each with its own suffix array. Windows outside ``main`` that
are new to a shard are then counted over the host's shards by a grouping on
128-bit digests, so a run that repeats in different shards only is found as well.
For ``main`` windows a shard reports those that half of its own pages have; the
host's count sums the reports, so a run is never taken for more common than it
is, and one that is common everywhere is found.

Character references are decoded, white space inside a block is one space,
blocks are trimmed and joined by two line feeds.

Edge cases: a null or empty page has an empty text; a page that ends anywhere,
inside a tag, comment or reference, gives the text so far; a null url is the
host of the empty name; pages of equal content are one page to the suffix array and give equal texts;
an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_side_tokens bigint, n_repeated_tokens bigint"
_STREAM = "uid binary, host string, shard bigint, shards bigint, blocks array<string>, places array<string>"
_FOUND = "uid binary, start int, digest binary, n int, kind string, host string, shard bigint"
_SHARED = "host string, uid binary, start int, digest binary, n int, size int, inside array<int>"
#: A main run is boilerplate on half of the host's pages, and on so many at least.
LEAST_PAGES = 4
#: Distinct pages that a task remembers, so that it sends copies once.
REMEMBERED = 200_000

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements without text of the page; they nest, and end at their own end tag.
SKIPPED = frozenset("noscript template object svg math canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a head holds; anything else ends it.
HEAD_CONTENT = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that end, without an end tag, where one like them begins: those that end, and those beyond which none does.
ENDS = {
    **dict.fromkeys(("li",), (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    **dict.fromkeys(("tr",), (frozenset(("tr",)), frozenset(("table",)))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot", "caption")), frozenset(("table",)))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option",)), frozenset(("optgroup",)))),
}
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
SIDE = frozenset("nav footer aside menu dialog button".split())
MAIN = frozenset(("article", "main"))
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Fixed words of class and id names that mark what is not the article, and those that mark the article.
_SIDE_NAME = re.compile(
    r"(?:.*[-_])?(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promo|banner|cookies?|consent|gdpr|notices?|popup|modal|"
    r"newsletter|subscribe|subscription|share|sharing|social|sidebar|menu|nav|navbar|navigation|breadcrumbs?|pagination|footer|"
    r"comments?|replies|related|recommended|widget|toolbar|login|signup|search)(?:[-_].*)?"
)
_COMMENT_NAME = re.compile(r"(?:.*[-_])?(?:comments?|replies|reply|respond|related|recommended|ads?|adverts?|advertisement|advertising|sponsored|cookies?|consent)(?:[-_].*)?")
#: Of these, the ones that a paragraph of an article may have that is none of it.
_NOTICE_NAME = re.compile(
    r"(?:.*[-_])?(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promo|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|comments?|replies|reply)(?:[-_].*)?"
)
_HEAD_NAME = re.compile(r"(?:site|page|top|global|main)?[-_]?(?:header|masthead|topbar)")
_MAIN_NAME = re.compile(r"(?:article|post|entry|story)[-_]?(?:body|content|text)|articlebody|main-?content")
_NOT_NAME = re.compile(r"(?:has|with|no|is|without|hide)[-_]")
# The tokenizer's states: a quote opens a value after '=' only; '<!-->' is a whole comment.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?+")


def _attributes(text: str) -> dict[str, str]:
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text) if text and not text.isspace() else ():
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return given


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))


def place(name: str, given: dict[str, str], outer: str) -> str:
    """Where the text of an element is, given its attributes and the place of what holds it.

    main, side, soft, open or none as in the module's text; named: side by one
    plain word only; inner: an article inside of that.
    """
    if outer == "none" or _hidden(given):
        return "none"
    if outer == "side":
        return "side"
    names = [x for x in f"{given.get('class', '')} {given.get('id', '')}".lower().split() if not _NOT_NAME.match(x)]
    role = given.get("role", "").lower()
    is_main = name in MAIN or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody" or any(map(_MAIN_NAME.fullmatch, names))
    inside = outer in ("main", "inner")
    if name not in ("html", "body", "main"):
        side = [x for x in names if _SIDE_NAME.fullmatch(x)]
        if inside and name in HEADINGS:
            side = []
        elif inside and name == "p":
            side = [x for x in names if _NOTICE_NAME.fullmatch(x)]
        if name in SIDE or role in SIDE_ROLES or any(map(_COMMENT_NAME.fullmatch, side)):
            return "side"
        if inside and side and not is_main:
            return "side"
        if not inside and (name == "header" or any(map(_HEAD_NAME.fullmatch, names))):
            return "side"
        if any("-" not in x and "_" not in x for x in side):
            return "named"
        if (side or name == "form") and not is_main:
            return "side" if inside else "soft" if outer != "named" else "named"
    if is_main and outer in ("named", "inner"):
        return "main" if name == "main" or role == "main" else "inner"
    return "main" if is_main else outer


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, place) of each block with text, in page order; places are main, side, soft and open."""
    out: list[tuple[str, str]] = []
    open_: list[tuple[str, str, bool]] = []  # name, place, and whether its words alone are no block of the article
    here, at = "open", 0
    held: list[tuple[str, bool]] = []
    muted = 0

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                own = here if muted == 0 and not any(m for _, m in held) or any(not m and t.strip() for t, m in held) else "side"
                out.append((text, own))
            held.clear()

    def close(k: int) -> None:
        nonlocal here, muted
        muted -= sum(m for *_, m in open_[k:])
        del open_[k:]
        here = open_[-1][1] if open_ else "open"

    def innermost(names: frozenset[str], beyond: frozenset[str]) -> int:
        """The place of the innermost open element of ``names``, -1 if there is none this side of ``beyond``."""
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in names:
                return k
            if open_[k][0] in beyond:
                return -1
        return -1

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if open_ and open_[-1][0] == "head" and text and not text.isspace():
            close(len(open_) - 1)  # words end a head that has no end tag
        if here != "none":
            held.append((text, muted > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCK:
            end()
        elif name == "br":
            held.append((" ", muted > 0))
        if m[1]:
            beyond = frozenset() if name == "table" else frozenset(("table",)) if name in TABLE_PARTS else frozenset(("td", "th", "caption"))
            k = innermost(frozenset((name,)), beyond)
            if k >= 0:
                outer = open_[k - 1][1] if k else "open"
                if outer != here and "none" not in (outer, here):
                    end()
                close(k)
            continue
        if open_ and open_[-1][0] == "head" and name not in HEAD_CONTENT:
            close(len(open_) - 1)
        if name in RAW or name in SKIPPED:
            empty = m[3].endswith("/") and name in ("svg", "math")
            stop = None if empty else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in RAW:
                at = n
            continue
        if name in VOID:
            continue
        if name in ENDS and (k := innermost(*ENDS[name])) >= 0:
            close(k)
        if name in BLOCK:  # an open paragraph ends where a block begins
            k = innermost(frozenset(("p",)), BLOCK)
            if k >= 0:
                close(k)
        given = _attributes(m[3])
        now = "none" if name == "head" else place(name, given, here)
        mute = False
        if name not in BLOCK and now not in (here, "none", "main", "inner"):
            now, mute = here, True  # words inside a line belong to it, if it has others
        if now != here and "none" not in (now, here):
            end()
        open_.append((name, now, mute))
        muted += mute
        here = now
    end()
    whole = any(p == "main" for _, p in out)
    names = {"named": "side", "inner": "side" if whole else "main"}
    return [(t, names.get(p, p)) for t, p in out]


def _named(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, uid): ``uid`` is a 128-bit digest of the page's content."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"), F.unhex(F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 32)).alias("uid"))


def streams(named: DataFrame, shard_chars: int) -> DataFrame:
    """Rows of ``_STREAM``: the blocks of each page, copies of a host left out as far as one task sees them."""
    size = named.groupBy("host").agg(F.sum(F.length("html")).alias("t")).select("host", F.ceil(F.col("t") / shard_chars).alias("shards")).where("shards > 1")
    dealt = named.where("html <> ''").join(written(size), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.select("uid", "host", F.pmod(F.xxhash64("uid"), "shards").alias("shard"), "shards", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, bytes]] = set()
        for pdf in batches:
            out = []
            for uid, host, shard, shards, page in pdf.itertuples(index=False):
                if (host, uid) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add((host, uid))
                found = blocks(page)
                out.append((uid, host, shard, shards, [t for t, _ in found], [p for _, p in found]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STREAM.split(", ")])

    return dealt.mapInPandas(run, _STREAM)


def truncated_suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """For each position a number that orders suffixes by their first ``depth`` tokens (a power of two): equal for equal windows.

    Ranks of 1, 2, 4, ... tokens, each from two ranks of half the length.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    n, size = len(tokens), 1
    while size < depth:
        later = np.zeros(n, np.int64)
        later[: n - size] = rank[size:] + 1 if size < n else 0
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        size *= 2
    return rank


def _tokens(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all pages, each page's followed by a separator of its own; the page of each token; whether it is a separator; whether it is main text."""
    tokens: list[str] = []
    page, stop, main = [], [], []
    for k, (own, places) in enumerate(zip(pdf["blocks"], pdf["places"], strict=True)):
        words = [b.split() for b in own]
        n = sum(map(len, words))
        for w, p in zip(words, places, strict=True):
            tokens += w
            main += [p == "main"] * len(w)
        tokens.append(f"\0{k}")
        page += [k] * (n + 1)
        stop += [False] * n + [True]
        main.append(False)
    return tokens, np.array(page, np.int64), np.array(stop, bool), np.array(main, bool)


def window_pages(tokens: list[str], page: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window at each token: its rank in the suffix array, on how many pages it occurs, and whether it ends before its page does."""
    ids = pd.factorize(np.array(tokens, object))[0] if tokens else np.zeros(0, np.int64)
    rank = truncated_suffix_array(ids, least)
    order = np.lexsort((page, rank))  # the suffix array, pages in order inside equal windows
    new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])] if len(order) else np.zeros(0, bool)
    pages = np.bincount(rank[order][new], minlength=1)
    ends = np.cumsum(stop)
    whole = np.zeros(len(tokens), bool)
    if len(tokens) >= least:
        whole[: len(tokens) - least + 1] = ends[least - 1 :] == ends[: len(tokens) - least + 1] - stop[: len(tokens) - least + 1]
    return rank, pages[rank], whole


def covered(n: int, starts: np.ndarray, least: int) -> np.ndarray:
    """Which of ``n`` tokens windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + least, n), -1)
    return np.cumsum(edge)[:-1] > 0


def boilerplate(rows: DataFrame, least: int = 8, of_hosts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(host, uid, starts): where windows of ``least`` tokens start in a page that are boilerplate there. ``rows``: ``_STREAM``.

    A window of main text that half of a host's pages have is on half of the pages
    of at least one of its shards. Those of each shard are counted again in all
    shards, so the result is the same however a host is dealt; ``of_hosts`` gives
    the rows of some hosts (host), whole, for that.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from xxhash import xxh3_128_digest

        shards = int(pdf["shards"].iat[0])
        pdf = pdf.drop_duplicates("uid").sort_values("uid", ignore_index=True)
        tokens, page, stop, main = _tokens(pdf)
        rank, pages, whole = window_pages(tokens, page, stop, least)
        first = np.searchsorted(page, np.arange(len(pdf)))
        uid, out = pdf["uid"].to_numpy(), []
        # Only a page without main text needs the places of what repeats outside of it.
        bare = np.array(["main" not in p for p in pdf["places"]], bool)[page]

        def add(kind: str, at: np.ndarray, placed: np.ndarray | bool, digests: bool) -> None:
            d = [xxh3_128_digest("\0".join(tokens[i : i + least])) for i in at] if digests else None
            out.append(pd.DataFrame({"uid": uid[page[at]], "start": np.where(placed, at - first[page[at]], -1), "digest": d, "n": pages[at], "kind": kind}))

        outside = whole & ~main
        add("open", np.flatnonzero(outside & (pages > 1) & bare), True, False)
        if shards > 1:
            fresh = np.flatnonzero(outside & (pages == 1))
            once = np.flatnonzero(outside & (pages > 1))
            once = once[np.unique(rank[once], return_index=True)[1]]  # of the windows found here, one each, as news for other shards
            add("fresh", fresh, bare[fresh], True)
            add("fresh", once, False, True)
        common = whole & main & (2 * pages >= len(pdf))
        if shards > 1:
            once = np.flatnonzero(common)
            add("likely", once[np.unique(rank[once], return_index=True)[1]], False, True)
        common &= (shards == 1) & (pages >= LEAST_PAGES)
        for k in np.unique(page[common]):
            own = np.flatnonzero(common & (page == k))
            here = slice(first[k], first[k] + int((page == k).sum()))
            if 2 * (covered(here.stop - here.start, own - here.start, least) & main[here]).sum() <= main[here].sum():
                add("main", own, True, False)
        out.append(pd.DataFrame({"uid": [b""], "start": [-1], "digest": [None], "n": [len(pdf)], "kind": ["pages"]}))
        return pd.concat(out, ignore_index=True).assign(host=key[0], shard=key[1])

    found = written(rows.groupBy("host", "shard").applyInPandas(run, _FOUND))
    fresh = found.where("kind = 'fresh'")
    across = fresh.groupBy("host", "digest").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a < b").select("host", "digest")
    starts = found.where("kind IN ('open', 'main')").select("host", "uid", "start")
    starts = starts.union(fresh.where("start >= 0").join(written(across), ["host", "digest"], "left_semi").select("host", "uid", "start"))
    likely = written(found.where("kind = 'likely'").select("host", "digest").distinct())
    if not likely.isEmpty():
        hosts = likely.select("host").distinct()
        again = of_hosts(hosts) if of_hosts else rows.join(hosts, "host", "left_semi")
        starts = starts.union(_shared(again, likely, found.where("kind = 'pages'").select("host", "shard", "n"), least))
    return starts.groupBy("host", "uid").agg(F.collect_list("start").alias("starts"))


def _shared(rows: DataFrame, likely: DataFrame, shards: DataFrame, least: int) -> DataFrame:
    """(host, uid, start): windows of main text that half of a host's pages have, where they are at most half of a page's. ``rows``: ``_STREAM``; ``likely``: host, digest; ``shards``: host, shard, n pages."""

    def run(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        from xxhash import xxh3_128_digest

        pdf = pdf.drop_duplicates("uid").sort_values("uid", ignore_index=True)
        tokens, page, stop, main = _tokens(pdf)
        rank, pages, whole = window_pages(tokens, page, stop, least)
        first, size = np.searchsorted(page, np.arange(len(pdf))), np.bincount(page[main], minlength=len(pdf))
        wanted, at = set(asked["digest"]), np.flatnonzero(whole & main)
        once = at[np.unique(rank[at], return_index=True)[1]]
        digest = {rank[i]: d for i in once if (d := xxh3_128_digest("\0".join(tokens[i : i + least]))) in wanted}
        uid, columns = pdf["uid"].to_numpy(), [c.split()[0] for c in _SHARED.split(", ")]
        out = [(key[0], uid[page[i]], i - first[page[i]], digest[rank[i]], pages[i], size[page[i]], [k - first[page[i]] for k in range(i, i + least) if main[k]]) for i in at.tolist() if rank[i] in digest]
        seen = [(key[0], None, -1, digest[rank[i]], pages[i], 0, []) for i in once.tolist() if rank[i] in digest]
        return pd.DataFrame(out + seen, columns=columns)

    asked = likely.join(shards.select("host", "shard"), "host")
    found = written(rows.groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInPandas(run, _SHARED))
    every = shards.groupBy("host").agg(F.sum("n").alias("pages"))
    common = found.where("uid IS NULL").groupBy("host", "digest").agg(F.sum("n").alias("n")).join(every, "host").where(f"2 * n >= pages AND n >= {LEAST_PAGES}").select("host", "digest")
    own = written(found.where("uid IS NOT NULL").join(common, ["host", "digest"], "left_semi"))
    covers = own.groupBy("host", "uid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("inside")))).alias("covered"), F.max("size").alias("size"))
    return own.join(covers.where("2 * covered <= size").select("host", "uid"), ["host", "uid"], "left_semi").select("host", "uid", "start")


def chosen(found: list[tuple[str, str]], starts: np.ndarray | None, least: int) -> tuple[list[str], int, int]:
    """Blocks of the article, the number of tokens outside main, and of tokens that runs cover."""
    sizes = [len(t.split()) for t, _ in found]
    cover = covered(sum(sizes), np.array([] if starts is None else starts, np.int64), least)
    at = np.cumsum([0, *sizes])
    share = [cover[a:b].sum() / max(b - a, 1) for a, b in zip(at, at[1:])]
    outside = sum(n for n, (_, p) in zip(sizes, found, strict=True) if p != "main")
    for where, most in (("main", 0.8), ("open", 0.5), ("soft", 0.5)):
        every = [k for k, (_, p) in enumerate(found) if p == where]
        if every:
            kept = [k for k in every if share[k] < most]
            return [found[k][0] for k in kept or every], outside, int(cover.sum())
    return [], outside, int(cover.sum())


def extract(pages: DataFrame, least: int = 8, shard_chars: int = 1 << 18) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``pages`` (page_id, url, html). ``least`` is a power of two.

    Pages are read twice: for their streams, and, when the boilerplate is known,
    for their text. Marks are joined on the content's digest; as most pages have
    none, they are few, and Spark broadcasts them if they are below its limit.
    """
    named = _named(pages)
    marks = written(boilerplate(streams(named, shard_chars), least, lambda hosts: streams(named.join(hosts, "host", "left_semi"), shard_chars)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, page, starts in zip(pdf["page_id"].astype("Int64").array, pdf["url"], texts_of(pdf["html"]), pdf["starts"], strict=True):
                kept, outside, repeated = chosen(blocks(page), starts, least)
                text = "\n\n".join(kept)
                out.append((page_id, url, text, len(text), outside, repeated))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"page_id": "Int64"})

    return named.join(marks, ["host", "uid"], "left").select("page_id", "url", "html", "starts").mapInPandas(run, SCHEMA)
