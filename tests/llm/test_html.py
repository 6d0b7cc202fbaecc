"""What of a page is its article, by hand-made pages with their full text."""

import pytest

from swathline.llm import html_extract

PAGES = {
    "head without an end tag": ("<html><head><title>t</title><body><article><p>one</p></article>", "one"),
    "head without end tag and body": ("<head><meta charset=x><article><p>one</article>", "one"),
    "words end a head": ("<head><title>t</title>words<p>two", "words\n\ntwo"),
    "scripts do not": ("<head><script>a</script><link rel=x>\n<title>t</title><main>m</main>", "m"),
    "wrapper of a plain word": ("<div class='search'><article><p>a</p></article></div>", "a"),
    "wrapper by id": ("<div id='sidebar'><article><p>a</article></div>", "a"),
    "main in a wrapper": ("<div class=share><main>a</main></div>", "a"),
    "cells without end tags": ("<table><td class=menu>nav<td><article>a</article></table>", "a"),
    "an article of a sidebar beside the page's own": ("<div class=sidebar><article>teaser</article></div><article>real</article>", "real"),
    "articles in an aside": ("<aside><article>t</article></aside><p>open", "open"),
    "link inside a line": ("<article><p>x <a class='related' href=#>linked</a> y</p></article>", "x linked y"),
    "button inside a line": ("<article><p>press <button>ok</button> now</p></article>", "press ok now"),
    "button on its own": ("<article><p>press</p><button>Share</button><p>x</p></article>", "press\n\nx"),
    "link on its own": ("<article><p>a<a class=related>only</a></p><p><a class=related>only</a></p></article>", "aonly"),
    "hidden inside a word": ("<article><p>a<span hidden>b</span>c</p></article>", "ac"),
    "names of paragraphs and headings": ("<article><p class='menu'>m</p><h2 class='cookies'>c</h2><p class=ad>buy</p><div class=ad><h2>x</h2>y</div>z</article>", "m\n\nc\n\nz"),
    "items without end tags": ("<article><ul><li class=share>s<li>t</ul><dl><dt class=nav>n<dd>d</dl></article>", "t\n\nd"),
    "rows without end tags": ("<article><table><tr><td class=ad>ad<td>cell<tr><td>next</table>after</article>", "cell\n\nnext\n\nafter"),
    "nested lists": ("<article><ul><li>a<ul><li>b<li>c</ul>d<li>e</ul></article>", "a\n\nb\n\nc\n\nd\n\ne"),
    "comments": ("<article>a<div class=comments><article>c</article></div></article>", "a"),
    "end tags do not leave a cell": ("<div><table><tr><td>x</div>y</table></div>z", "x\n\ny\n\nz"),
    "form in an article": ("<article>a<form><p>f<input></form>b</article>", "a\n\nb"),
    "page in a form": ("<form><article>a</article></form>", "a"),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_of(name):
    page, text = PAGES[name]
    assert "\n\n".join(html_extract.chosen(html_extract.blocks(page), None, 8)[0]) == text


def test_text_of_in_spark(spark):
    df = spark.createDataFrame([(i, f"http://h{i}/", page) for i, (page, _) in enumerate(PAGES.values())], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got == {i: (text, len(text)) for i, (_, text) in enumerate(PAGES.values())}


def test_runs_decide_where_no_element_does(spark):
    """Pages without an article element: what other pages of the host have goes, in whatever element it stands."""
    notice = "This shop ships its goods to all places on every second day"
    rows = [(i, "http://host.net/a", f"<div><div>{notice}</div><p>Page {i} says {' '.join(f'word{i}x{k}' for k in range(12))}</p></div>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_runs = {r.text for r in html_extract.extract(df).collect()}
    assert not any(notice in t for t in with_runs) and len(with_runs) == 5
    assert all(notice in "\n".join(html_extract.chosen(html_extract.blocks(page), None, 8)[0]) for *_, page in rows)


def test_shared_runs_of_articles_do_not_depend_on_shards(spark):
    """A notice inside the articles of just half of a host's pages, and one of fewer, whatever part of the host a task sees."""
    notice, other = "Every order of this shop is sent by the post on the next working day", "Only some of our writers add this long line under what they have written"
    words = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, "http://host.net/a", f"<article><p>Page {i} says {words(i)}</p>" + f"<p>{notice}</p>" * (i % 2 == 0) + f"<p>{other}</p>" * (i % 3 == 0) + "</article>") for i in range(12)]
    rows.append((12, "http://host.net/b", f"<article><p>{notice}</p><p>Short</p></article>"))  # nothing but the notice: it stays
    rows.append((13, "http://host.net/c", f"<article><p>Page 13 says {words(13)}</p><p>{notice}</p></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {n: {r.page_id: r.text for r in html_extract.extract(df, shard_chars=n).collect()} for n in (1 << 18, 1500, 200)}
    one = got[1 << 18]
    assert got[1500] == one and got[200] == one
    assert [i for i, t in one.items() if notice in t] == [12] and sum(other in t for t in one.values()) == 4
