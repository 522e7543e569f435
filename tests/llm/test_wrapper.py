"""Wrapper induction: what decides when names are gone, nested articles, deep and unclosed pages."""

from __future__ import annotations

import re
import time

from gleaner.llm.wrapper import Page, aligned, content, main_text

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_without_names(spark):
    """The text is found by the pages' evidence: stripped of element and class names it is the same."""
    rows = [(r.page_id, "http://one.example/" + str(r.page_id), r.html or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    bare = [(i, u, re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h).replace(' class="ad"', "")) for i, u, h in rows]
    want = {}
    for i, _, h in rows:
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = re.split(r"</?(?:p|h1)[^>]*>", inner)
        want[i] = "\n\n".join(x for x in (" ".join(plain(y).split()) for y in parts) if x)
    assert extracted(spark, rows) == want
    assert extracted(spark, bare) == want


def plain(piece):
    import html

    return html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", re.sub(r"<!--.*?-->", "", piece))))


def test_evidence(spark):
    def page(i):
        return f"""<html><body><header><h1>Site</h1></header><main><h2 class="section-header">Head {i}</h2>
        <div class="left-side"><p>{'Long text of its own. ' * 20}{i}</p><p>Same line on every page</p><svg><text>label</text></svg><button>b{i}</button></div>
        <div class="tip">Same notice on every page</div>
        <section class="comments"><p>{i} says hello</p></section><article><p>Teaser {i}</p></article></main><aside>x</aside><form><p>f</p></form></body></html>"""

    got = extracted(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(5)] + [(9, "http://alone.example/", page(9))])
    for i in range(5):
        assert got[i] == f"Head {i}\n\n" + ("Long text of its own. " * 20 + str(i)) + f"\n\nSame line on every page\n\nlabelb{i}"
    assert got[9].endswith("Same notice on every page") and "Teaser" not in got[9] and "hello" not in got[9]
    copies = extracted(spark, [(i, "http://c.example/", page(1)) for i in range(4)])
    assert len(set(copies.values())) == 1 and "Long text" in copies[0]


def test_deep_and_unclosed():
    began = time.time()
    deep = "<html><body>" + "<div>" * 5000 + "<p>deep text"
    a, b = Page(deep).tree(), Page(deep.replace("<p>", "<p class=x>")).tree()
    assert aligned(a, b)[:-1] == list(range(5003)) and aligned(a, b)[-1] == -1
    for html in ("<div>" * 200_000 + "x", "x<a " * 250_000, '<a "' * 250_000 + ">", "<div>" * 90_000 + "</p>" * 90_000, "<article>" + "<div>" * 60_000 + "</section>" * 60_000):
        content(Page(html), None, None)
    assert time.time() - began < 60
    assert content(Page("a < b &lt; c <p>d</p"), None, None) == "a < b < c\n\nd"


def test_article_beside_longer_text():
    """Reader posts longer than the article, in a section of no telling name."""
    html = "<body><article><h1>Title</h1><p>" + "The article. " * 20 + "</p></article><div class='user-posts'><p>" + "A post. " * 60 + "</p></div></body>"
    assert content(Page(html), None, None) == "Title\n\n" + ("The article. " * 20).strip()


def host(body, n=5):
    return [(i, f"http://h.example/{i}", "<body><nav><a href='/'>Home</a></nav>" + body(i) + "<footer>Foot</footer></body>") for i in range(n)]


def test_what_an_article_holds_is_its_own(spark):
    """Short articles beside much other text, many reader comments, own text under names of furniture, headings that every
    page has: on a page alone and on a host of five."""
    body = "The article of page {0}. " * 12

    def short(i):
        return f"<article><h1>Title {i}</h1><p>{body.format(i)}</p><p>Closing line</p></article><div><p>" + f"A post of page {i}. " * 120 + "</p></div>"

    def commented(i):
        return f"<article><h1>Title {i}</h1><p>{body.format(i)}</p><div class='comments'><p>" + f"A comment of page {i}. " * 40 + "</p></div></article>"

    def named(i):
        return (
            f"<main><h1>Title {i}</h1><p>{body.format(i)}</p><h2>Ingredients</h2><div class='related'><p>Own paragraph {i}</p></div><div class='notice'>Own notice {i}</div>"
            f"<ul class='menu'><li>soup {i}</li></ul><div class='notice box'>Everywhere</div><div class='related'><a href='/x'>Link {i}</a></div><div class='ad'>Buy {i}</div></main>"
        )

    own = body.strip()
    want = {
        short: "Title {0}\n\n" + own + "\n\nClosing line",
        commented: "Title {0}\n\n" + own,
        named: "Title {0}\n\n" + own + "\n\nIngredients\n\nOwn paragraph {0}\n\nOwn notice {0}\n\nsoup {0}",
    }
    for page, text in want.items():
        got = extracted(spark, host(page))
        assert got == {i: text.format(i) for i in range(5)}, page
    for page in (short, commented):
        assert content(Page(host(page)[1][2]), None, None) == want[page].format(1)
