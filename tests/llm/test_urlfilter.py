import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from tests.compare import difference
from waymark.llm import urlfilter

FOLDER = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert difference(urlfilter.judged(pages), urlfilter.ORACLE, FOLDER) == ""


def test_blocks_reach_aliases_and_allows_win(spark):
    link = lambda u: f'<link href="{u}" rel="canonical">'
    rows = [
        (1, "http://A.example.net/x", link("http://b.com/de/1")), (2, "http://b.com/de/1", None), (3, "https://c.net/y/", f'<META http-equiv=refresh content="0; url=http://A.example.net/x">'),
        (4, "http://d.net/z", link("http://e.com/de/2")), (5, "http://d.net/z?q=1#f", link("//sub.f.org/k")), (6, "http://g.net/", link("/h")), (7, None, None), (8, "no scheme", "<link"), (9, "http://b.com/de/1", None),
        (10, "http://i.net", link("http://e.com/de/2") + link("http://f.org/ok")), (None, "http://x.com/fr/a/../b", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as node", "page_id as component", "url as host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages).collect()}
    assert got[1] == ("a.example.net", "/x", None, "block") and got[3] == ("c.net", "/y/", None, "block")
    assert got[2] == got[9] == ("b.com", "/de/1", "com/de/", "block")
    assert got[4][3] == got[10][3] == "allow"  # an explicit allow in the component takes precedence
    assert got[7] == got[8] == ("", "", None, "allow") and got[None] == ("x.com", "/fr/a/../b", "com/fr/", "allow")
    assert urlfilter.judged(pages.limit(0)).count() == 0


def linked_pages(n=700, seed=11):
    """Pages with hundreds of redirects and canonical links: chains, cycles, relative targets, blocked and allowed ends."""
    rng = random.Random(seed)
    hosts = ["a.net", "b.com", "c.com", "news.d.org", "e.net", "example.org", "F.Net"]
    place = lambda: rng.choice(["/", "", "/de", "/de/", f"/de/{rng.randint(1, 9)}", "/fr/x", f"/p/{rng.randint(1, 150)}", f"/p/q/{rng.randint(1, 150)}/", f"/s?id={rng.randint(1, 60)}", "/en/1"])
    rows = []
    for k in range(n):
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(hosts[:5] if rng.random() < 0.8 else hosts)}{place()}"
        if k % 5 == 0:
            url = f"http://chain.net/d/{k // 5}"
        target = rng.choice([f"http://{rng.choice(hosts)}{place()}", f"//{rng.choice(hosts)}{place()}", place() or "/", f"{rng.randint(1, 150)}", f"../{rng.randint(1, 150)}", "./..", f"?id={rng.randint(1, 60)}", "#top", "mailto:x@b.com", "/p/./q/../7?x=..&amp;y=1"])
        if k % 5 == 0:
            target = f"{k // 5 + 1}" if k % 35 else "http://b.com/de/3"
        tag = rng.choice([f'<link rel="canonical" href="{target}">', f"<META http-equiv=refresh content='0; url={target}'>", f'<link href="{target}" rel=stylesheet>'])
        html = None if rng.random() < 0.1 else f"<html><head>{tag if rng.random() < 0.6 or k % 5 == 0 else ''}</head>{'text ' * rng.randint(0, 3)}"
        rows.append((k, rng.choice([None, "no scheme"]) if rng.random() < 0.02 else url, html))
    return rows


def test_linked_pages_equal_sql(spark, tmp_path):
    pages = spark.createDataFrame(linked_pages(), "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    assert difference(urlfilter.judged(pages), urlfilter.ORACLE, str(tmp_path)) == ""
    got = urlfilter.judged(pages).collect()
    assert sum(r.component is not None for r in got) > 300 and sum(r.rule is None and r.verdict == "block" for r in got) > 20
    # a table of many rules gives what trying each in turn gives
    rules = [*urlfilter.RULES, *(("block" if k % 2 else "allow", "a.net", f"/p/{k}") for k in range(150))]
    one = urlfilter.rule_of(F.col("host"), F.col("path"), rules)
    rows = urlfilter.with_address(pages, "url")
    want = {(r[0], r[1], r[2]) for r in rows.select("page_id", *one).collect()}
    assert {(r.page_id, r.rule, r.action) for r in urlfilter.ruled(rows, rules).collect()} == want and any(a == "allow" for _, _, a in want)


def test_rules_see_real_paths(spark):
    rows = [(1, "http://b.com/de", None), (2, "http://x.net/1", '<link rel="canonical" href="http://b.com/de">'), (3, "http://x.net/2", '<link rel="canonical" href="http://c.com/de/">')]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: (None, "block")}  # /de is not under /de/


def test_long_html(spark):
    html = "<p>words and words</p>" * 60_000 + '<link rel="canonical" href="http://b.com/de/1">'
    rows = [(1, "http://x.net/1", html)]
    assert urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).first().verdict == "block"


def test_longest_rule(spark):
    rows = [(1, "http://example.org/en/12"), (2, "http://www.example.org/es/"), (3, "http://example.org/en/2"), (4, "http://notexample.org/es/"), (5, "http://com/de/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "cast(null as string) as html")).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: ("org/", "allow"), 5: ("com/de/", "block")}


def test_relative_targets_carry_blocks(spark):
    moved = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        ("http://a.net/dir/p", moved("next.html")), ("http://a.net/dir/next.html", '<link rel="canonical" href="../x/./y?q=http://no.net">'), ("http://a.net/x/y?q=http://no.net", moved("?p=1")),
        ("http://a.net/x/y?p=1", moved("../../../up/")), ("http://a.net/up", moved("/k/../de")), ("http://a.net/de", moved("http://b.com/de/1")), ("http://root.net", moved("in")), ("http://root.net/in", moved("http://b.com/de/1")),
        ("http://free.net/a", moved("mailto:x@b.com")), ("http://free.net/b?q=1", moved("#part")),
        *[(f"http://chain.net/d/{i}", moved(f"./{i + 1}")) for i in range(60)], ("http://chain.net/d/60", moved("//b.com/de/2")),
    ]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 8 and got[8] == got[9] == "allow" and [got[i] for i in range(10, 71)] == ["block"] * 61
    assert urlfilter.alias_edges(pages.where("page_id in (8, 9)")).collect() == []


class _Edges(HTMLParser):
    """An independent reading of a page: (base, targets) by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.base, self.targets = None, []

    def handle_starttag(self, tag, attrs):
        got = {}
        for k, v in attrs:
            got.setdefault(k, v or "")
        if tag == "base" and "href" in got and self.base is None:
            self.base = got["href"].strip()
        if tag == "link" and "canonical" in got.get("rel", "").lower().split():
            self.targets.append(got.get("href", "").strip())
        if tag == "meta" and got.get("http-equiv", "").strip().lower() == "refresh":
            m = re.match(r"\s*[\d.]+\s*[;,]?\s*(?:url\s*=\s*)?(.*)", got.get("content", ""), re.I | re.S)
            if m:
                t = m[1].strip()
                self.targets.append(t[1:].split(t[0])[0].strip() if t[:1] in ("'", '"') else t)


def _plain_edges(url, html):
    page = _Edges()
    page.feed(html)
    page.close()
    at = urljoin(url, page.base) if page.base else url
    out = set()
    for t in page.targets:
        full = urlsplit(urljoin(at, t))
        if t and not t.startswith("#") and full.netloc:
            out.add(full.netloc.lower() + full.path.removesuffix("/") + (f"?{full.query}" if full.query else ""))
    own = urlsplit(url)
    return out - {own.netloc.lower() + own.path.removesuffix("/") + (f"?{own.query}" if own.query else "")}


def markup(n=400, seed=3):
    """Pages with links in comments, scripts and attribute values, several rel words, decoys, bases and character references."""
    rng = random.Random(seed)
    hosts = ["b.com", "c.net", "news.d.org"]
    href = lambda: rng.choice([f"http://{rng.choice(hosts)}/de/{rng.randint(1, 99)}", f"//{rng.choice(hosts)}/x", f"/p/{rng.randint(1, 99)}", f"q/{rng.randint(1, 99)}", f"http&#58;//d.net/{rng.randint(1, 9)}", f"http:&#x2F;&#x2f;e.net/a&amp;b", "/k?x=1&amp;y=&#233;", " /sp "])
    rows = []
    for k in range(n):
        q = rng.choice(["'", '"'])
        link = lambda: rng.choice(["<link ", "<LINK\n", "<link data-href='http://no.net/' ", "<link title='a > b' "]) + rng.choice([f"rel={q}{r}{q}" for r in ("canonical", "shortlink Canonical", "stylesheet", "notcanonical", "canonical-x")] + ["rel=canonical", "data-rel=canonical"]) + f" href={q}{href()}{q}" + rng.choice([">", "/>", " />"])  # noqa: E731, B023
        meta = lambda: f"<meta HTTP-EQUIV={rng.choice(['refresh', q + 'Refresh' + q])} content={q}{rng.choice(['0; url=', '5;URL=', '1, ', '0;'])}{href().strip()}{q}>"  # noqa: E731, B023
        some = lambda: rng.choice([link, meta])()  # noqa: E731, B023
        parts = [some(), f"<!-- {some()} -->", f"<script>var a = '{link().replace(chr(39), '')}';</script>", f"<style>/* {link()} */</style>", f'<a title="{link().replace(chr(34), "")}">x</a>', rng.choice(["", "<base target=x>", f"<base href={q}{rng.choice(['/sub/dir/', 'http://base.net/r/s', '//base.org/', 'up/'])}{q}>"]), some(), "<p>text & more < 3</p>"]
        rng.shuffle(parts)
        rows.append((k, f"http://h{k}.net/dir/page{k}", "".join(parts[: rng.randint(1, len(parts))])))
    return rows


def test_markup_by_an_independent_parser(spark, tmp_path):
    rows = markup()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in urlfilter.alias_edges(pages).collect():
        got.setdefault(r.src.split(".")[0], set()).add(r.dst)
    want = {f"h{k}": _plain_edges(url, html) for k, url, html in rows}
    assert {k: got.get(k, set()) for k in want} == want and sum(map(len, want.values())) > 200
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert difference(urlfilter.judged(spark.read.parquet(str(tmp_path / "pages.parquet"))), urlfilter.ORACLE, str(tmp_path)) == ""


def test_links_that_are_none_and_links_that_were_lost(spark):
    to = 'href="http://b.com/de/1"'
    rows = [f"<!-- <link rel=canonical {to}> -->", f"<script>x = '<link rel=canonical {to}>'</script>", f"<link rel=canonical {to.replace('href', 'data-href')}>", f"<link rel=stylesheet {to}>", f"<!-- open <link rel=canonical {to}>",
            f'<link rel="shortlink canonical" {to}>', '<link rel=canonical href="http&#58;//b.com/de/1">', '<base href="http://b.com/de/"><link rel=canonical href=1>', f'<link data-href="http://no.net" title="a > b" rel=canonical {to}>', '<link rel=canonical href="http&#x3a;&sol;/b.com/de/1" href=x>', f"<link rel=canonical {to} " + "a=1 " * 20_000 + ">"]
    pages = spark.createDataFrame([(k, f"http://x{k}.net/", h) for k, h in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages).collect()}
    assert [got[k] for k in range(11)] == ["allow"] * 5 + ["block"] * 6
