"""Main text of pages: the given pages against a plain reading, templates of made sites, odd markup."""

import html
import re
from collections import defaultdict

import pytest

from waymark.llm import ordered, pagetext
from waymark.llm.pagetext import Page, main_text

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "page_id long, url string, html string"


def one(source):
    page = Page(source)
    return page.main([False] * len(page.tag))


def test_given_pages(spark):
    """Every given page's article, cut out by its tags and freed of them."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.sub(r"</?(?:h1|p|br)\b[^>]*>", "\n", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        expected = " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, expected, len(expected))


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<article><p>a<b>b</b> c\n\t d<p>e</article>", "ab c d e"),
        ("<body><nav>menu</nav><main><header><h1>Title</h1><p>by me</p></header><p>x &amp; y &lt;z&gt; &#233;&nbsp;&eacute</p><aside>side</aside></main><footer>foot</footer>", "Title x & y <z> é é"),
        ("<article>one<br>two<script>var a = '</p><article>no';</script><style>p{}</style><!-- <p>not</p> --> three</article>", "one two three"),
        ("<form><article><p>inside a form</p><form>ask</form></article></form>", "inside a form"),
        ("<article><p>text</p><div class='share-buttons'>share</div><section id='comments'><article>me too</article></section><div class=\"ad\">buy</div><p class=promo>promo</p></article>", "text"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl></article>", "a b c d e f g"),
        ("<article><p>a <a href='x>y'>link > here</a> b</p></article><p>after", "a link > here b"),
        ("<article></article><p>no article text", ""),
        ("<div id=content><p>the content</p></div><div>other</div>", "the content"),
        ("<div class='cookie-notice'>we use</div><div><p>plain body text of a page.</p></div><ul><li><a>x</a><li><a>y</a></ul>", "plain body text of a page."),
        ("<body class='has-sidebar no-comments'><div class='with-ads'>kept</div>", "kept"),
        ("<article><p>unclosed <b>bold<i>both</p><p>next</article>out", "unclosed boldboth next"),
        ("<ARTICLE><H1>Up</H1><P>per</ARTICLE>", "Up per"),
        ("<article>a < b and c > d</article>", "a < b and c > d"),
        ("<article>cut <b class='", "cut"),
        ("<article>a<!-- open <p>b", "a"),
        ("no markup  at\nall &copy; ", "no markup at all ©"),
        ("<p hidden>h</p><p style='display: none'>n</p><p>shown", "shown"),
        ("<article><div class='entry-header'><h1>H</h1><span>meta</span></div><p>t</article>", "H t"),
        ("", ""),
        ("<![CDATA[raw <b>]]>", "raw <b>"),
    ],
)
def test_markup(source, expected):
    assert one(source) == expected


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + "<p>in" * 3 + "</div>" * 20_000
    assert one(f"<article>{deep}</article>") == "in in in"
    assert one("<article>" + "<a " * 50_000 + ">x</article>") == "x"
    assert one("<article>" + "<p>word and more" * 50_000).count("word") == 50_000


def site(spark, repeated=1):
    """Three hosts of div pages whose templates carry no names, with articles that share passages and have copies."""
    rows, expected, n = [], {}, 0
    for h, size in enumerate((30, 6, 2)):
        for i in range(size):
            body = f"<p>Story {i if i % 10 else 0} of host {h} tells {i * 7} things.</p>" + ("<p>A passage that several stories share.</p>" if i % 4 == 0 else "")
            menu = f"<div><div>Home of {h}</div><div>Latest</div><div>{'Here' if i % 2 else 'There'}</div></div>"
            foot = f"<div>All rights of host {h} kept</div>"
            expected[n] = " ".join(re.sub("<[^>]*>", " ", body).split())
            rows += [(n, f"https://h{h}.net/{i}", f"<html><body>{menu}<div>{body}</div>{foot}</body></html>")] * repeated
            n += 1
    return spark.createDataFrame(rows, COLUMNS), expected


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_templates_without_names(spark, monkeypatch, broadcast_rows):
    if not broadcast_rows:
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    pages, expected = site(spark, 2)
    got = defaultdict(set)
    for r in main_text(pages, broadcast_rows).collect():
        got[r.page_id].add(r.text)
    for n, text in expected.items():
        assert len(got[n]) == 1
        if n < 36:  # the last host has too few pages to tell a template
            assert got[n] == {text}, n
        else:
            assert text in next(iter(got[n]))


def test_templates_against_a_plain_count(spark):
    pages, _ = site(spark)
    where, sites = defaultdict(set), defaultdict(set)
    for r in pages.collect():
        page, host = Page(r.html), r.url.split("/")[2]
        sites[host].add(r.html)
        for tag, digest in zip(page.tag, page.digest):
            if digest:
                where[host, digest].add(r.html)
    expected = sum(len(v) >= 3 and len(v) >= 0.4 * len(sites[h]) for (h, _), v in where.items())
    assert pagetext.templates(pages.withColumn("host", pagetext.host_of(pages.url))).count() == expected > 3


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://x.org/a", f"<nav>n{i}</nav><article><p>the same article</p><p>tail {i % 2}</p></article><div class=ad>{i}</div>") for i in range(50)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, COLUMNS)).collect()} == {"the same article tail 0", "the same article tail 1"}


def test_template_inside_articles_goes(spark):
    rows = [(i, "http://x.org/a", f"<article><p>story {i}</p><div>Read our terms</div></article>") for i in range(20)]
    assert {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, COLUMNS)).collect()} == {i: f"story {i}" for i in range(20)}


def test_odd_rows(spark):
    rows = [(1, None, "<p>no url"), (None, "http://a.b/", None), (2, "odd", ""), (3, "http://a.b", "<p>x"), (3, "http://a.b", "<p>x"), (None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    df = df.withColumns({c: df.url for c in ("host", "text", "key", "page", "site", "templates", "n_chars")})
    got = sorted((r.page_id or -1, r.text, r.n_chars) for r in main_text(df).collect())
    assert got == [(-1, "", 0), (-1, "", 0), (1, "no url", 6), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert main_text(df.limit(0)).count() == 0
