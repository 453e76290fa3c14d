"""Main text of web pages by removal of site templates.

Every element's subtree is hashed by its tags and text. Spark counts on how many different pages of
a host each subtree stands, and the subtrees that recur on a large share of them are deleted; what
a page marks as menu, header, footer, sidebar, notice, advert, form or reader comments goes as well.
Outside the article a subtree is a template from ``OUTSIDE`` of the host's different pages on,
inside it only from ``INSIDE`` of the different articles on, so that copies of an article and
passages that articles share stay. Pages that are equal count once.

Defined cases: a null html is empty and gives an empty text; a null or odd url belongs to the host
of no name; an article without text gives an empty text; a page without an article element is read
by its content block, else by its body; unclosed and misnested tags are closed as browsers do;
pages of any length are read whole; repeated rows and rows without page_id stay; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_ROWS, released, steps, stored
from waymark.llm.ordered import looked_up

#: Share of a host's different pages, or articles, on which a template stands, and the least number of them.
OUTSIDE, INSIDE = 0.4, 0.8
LEAST = 3

# Names of HTML, and words by which pages name their parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GONE = frozenset("head nav footer aside menu dialog form button input select option textarea label svg canvas object audio video map template script style noscript iframe".split())
_SCOPE = frozenset("html table td th caption template object marquee".split())
#: An element of the first kind ends open ones of the second, up to one of the third.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split()) | {"html"}) for k, (a, b) in _ENDS.items()}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted adsense nav navbar navigation menu menubar breadcrumb breadcrumbs masthead header footer sidebar aside"
    " cookie cookies consent gdpr notice notices disclaimer alert banner popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations trending teaser"
    " comment comments commentlist respond reply replies disqus pagination pager toolbar widget widgets search form copyright skip".split()
)
_HEADER_NAMES = frozenset(("header", "masthead"))
_NOT_AN_ARTICLE = frozenset("ad ads advert advertisement sponsored promo related recommended teaser comment comments reply".split())
_CONTENT = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main|page|news|blog)[-_]?(?:body|content|text|main)|(?:body|content|main)[-_]?(?:article|content|text)|content|main|article|post|entry|story)(?:$|\s)", re.I)

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?=>)|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _RAW}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_ALIVE, _DEAD, _HEADER = 0, 1, 2


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of class and id; what stands behind has, with, no and the like names something else."""
    found = set()
    for name in html.unescape(f"{attributes.get('class', '')} {attributes.get('id', '')}").split():
        words = [w.lower() for w in _WORDS.findall(name)]
        cut = next((i for i, w in enumerate(words) if w in ("has", "with", "no", "without", "is", "hide")), len(words))
        found |= set(words[:cut])
    return found


class Page:
    """A page as a flat list of elements with subtree hashes, and its text in order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.gone, self.header, self.article, self.content, self.digest = [], [], [], [], [], [], []
        self.links: list[list[int]] = []  # of each element: characters, characters in links, links
        self.flow: list[tuple[int, str | None]] = []  # element and text, or None between blocks
        self._stack: list[int] = []
        self._parts: list[list[bytes]] = []
        self._open: dict[str, int] = {}
        self._begin("html", "")
        self._read(source)
        while self._stack:
            self._end()

    def _begin(self, tag: str, text: str) -> None:
        attributes = _attributes(text) if text.strip(" /\n\t") else {}
        names = _names(attributes) if attributes else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))
        inside = tag == "article" or tag == "main" or attributes.get("role") == "main" or "articleBody" in attributes.get("itemprop", "")
        part = names & (_NOT_AN_ARTICLE if inside else _PARTS) if tag not in ("html", "body") else set()
        self.header.append(tag not in _HEADINGS and (tag == "header" or bool(part)) and part <= _HEADER_NAMES)
        if part <= _HEADER_NAMES:
            part = set()
        self.gone.append(tag in _GONE or hidden or bool(part) or attributes.get("role", "") in _ROLES)
        self.article.append(inside and not part)
        self.content.append(bool(attributes) and any(_CONTENT.search(attributes.get(a, "")) for a in ("class", "id")) and not part)
        self.tag.append(tag)
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.digest.append(0)
        self.links.append([0, 0, 0])
        self._stack.append(len(self.tag) - 1)
        self._parts.append([tag.encode()])
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in _BLOCK:
            self.flow.append((self._stack[-1], None))

    def _end(self) -> None:
        at, parts = self._stack.pop(), self._parts.pop()
        tag = self.tag[at]
        self._open[tag] -= 1
        if tag in _BLOCK:
            self.flow.append((at, None))
        if len(parts) > 1:
            self.digest[at] = xxhash.xxh3_64_intdigest(b"\x00".join(parts))
            if self._parts:
                self._parts[-1].append(b"%x" % self.digest[at])
        size, linked, links = self.links[at]
        if tag == "a":
            linked, links = size, links + 1
        if self._stack:
            up = self.links[self._stack[-1]]
            up[0] += size
            up[1] += linked
            up[2] += links

    def _until(self, tags: frozenset | set, stop: frozenset) -> None:
        """Close up to the outermost of ``tags`` that is open before one of ``stop``."""
        if not any(self._open.get(t) for t in tags):
            return
        depth = None
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in tags:
                depth = k
            elif tag in stop:
                break
        while depth is not None and len(self._stack) > depth:
            self._end()

    def _text(self, text: str) -> None:
        words = text.split()
        if not words:
            if text and self.flow and self.flow[-1][1] is not None:
                self.flow.append((self._stack[-1], " "))
            return
        if "&" in text:
            text = html.unescape(text)
            words = text.split()
        at = self._stack[-1]
        self.flow.append((at, text))
        joined = " ".join(words)
        self._parts[-1].append(b"=" + joined.encode("utf-8", "replace"))
        self.links[at][0] += len(joined)

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while match := _TAG.search(source, at, last):
            if match.start() > at:
                self._text(source[at : match.start()])
            at = match.end()
            if not (tag := match[2]):
                if match[0].startswith("<![CDATA["):
                    self._text(html.escape(match[0][9:].removesuffix("]]>")))
                elif match[0].startswith("<!--") and not match[0].endswith(("<!-->", "-->", "--!>")):
                    return
                continue
            tag = tag.lower()
            if match[1]:
                self._close(tag)
                continue
            if tag in ("html", "body") and self._open.get(tag):
                continue
            if tag in _CLOSES_P:
                self._until({"p"}, _SCOPE)
            if tag in _HEADINGS and self.tag[self._stack[-1]] in _HEADINGS:
                self._end()
            if tag in _ENDS:
                self._until(*_ENDS[tag])
            if tag == "body" and self._open.get("head"):
                self._until({"head"}, frozenset())
            self._begin(tag, match[3])
            if tag in _VOID:
                self._end()
            elif tag in _RAW:
                found = _RAW_END[tag].search(source, at)
                at = found.end() if found else len(source)
                self._end()
        cut = re.compile("<[/!?a-zA-Z]").search(source, max(at, last))  # a tag that the page's end cuts off is none
        self._text(source[at : cut.start() if cut else len(source)])

    def _close(self, tag: str) -> None:
        if not self._open.get(tag) or tag in ("html", "body"):
            return
        block = tag in _BLOCK
        for k in range(len(self._stack) - 1, 0, -1):
            other = self.tag[self._stack[k]]
            if other == tag:
                while len(self._stack) > k:
                    self._end()
                return
            if (other in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th")) or (not block and other in _BLOCK):
                return

    def _states(self, dropped: list[bool], spare: set[int]) -> list[int]:
        state: list[int] = []
        for i, up in enumerate(self.parent):
            above = state[up] if up >= 0 else _ALIVE
            if above == _HEADER and self.tag[i] in _HEADINGS and not dropped[i]:
                state.append(_ALIVE)
            elif above:
                state.append(above)
            elif i not in spare and self.header[i] and not dropped[i]:
                state.append(_HEADER if self.within[i] else _DEAD)
            else:
                state.append(_DEAD if i not in spare and dropped[i] else _ALIVE)
        return state

    @cached_property
    def within(self) -> list[bool]:
        """Whether an element stands below an article."""
        out: list[bool] = []
        for up in self.parent:
            out.append(up >= 0 and (out[up] or self.article[up]))
        return out

    def _above(self, those: list[int]) -> set[int]:
        found: set[int] = set()
        for i in those:
            while i >= 0 and i not in found:
                found.add(i)
                i = self.parent[i]
        return found

    def main(self, templates: list[bool]) -> str:
        """The text of the article, without the elements that are marked as templates."""
        dropped = [(g or t) for g, t in zip(self.gone, templates)]
        state = self._states(dropped, set())
        articles = [i for i, a in enumerate(self.article) if a]
        kept = [i for i in articles if not state[i]]
        if articles and not kept:  # a form or sidebar around the whole article
            state = self._states(dropped, self._above(articles))
            kept = [i for i in articles if not state[i]]
        if not articles:
            blocks = [i for i, c in enumerate(self.content) if c]
            kept = [i for i in blocks if not state[i] and self.links[i][0]]
            linked = [d or (n > 1 and 2 * inside > size and self.tag[i] in _BLOCK) for i, (d, (size, inside, n)) in enumerate(zip(dropped, self.links))]
            state = self._states(linked, self._above(kept) | {0})
            kept = [i for i in kept if not state[i]]
        inner = [not kept] * len(self.tag)
        chosen = set(kept)
        for i, up in enumerate(self.parent):
            inner[i] = inner[i] or i in chosen or (up >= 0 and inner[up])
        blocks, now = [], []
        for at, text in self.flow:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inner[at] and not state[at]:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(" ".join(b.split()) for b in blocks if b and not b.isspace())


def _key(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def _keys(page: Page, host: str) -> np.ndarray:
    """A key for each element: host, place inside or outside an article, and subtree; 0 without text."""
    return np.array([_key(host, inside, digest) if digest else 0 for digest, inside in zip(page.digest, page.within)], np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in steps(batches, "html"):
        rows: list[tuple[int, int, int, bool]] = []
        for host, source in zip(step.column("host").to_pylist(), step.column("html").to_pylist()):
            page = Page(source or "")
            whole = page.digest[0]
            article = _key("article", *(page.digest[i] for i, a in enumerate(page.article) if a and not page.within[i]))
            mine = {(int(k), article if inside else whole - (1 << 63), inside) for k, inside in zip(_keys(page, host), page.within) if k}
            hosts = {inside: _key(host, "all", inside) for inside in (False, True)}
            rows += [(k, by, hosts[inside], inside) for k, by, inside in mine]
            rows += [(hosts[inside], by, hosts[inside], inside) for inside, by in ((False, whole - (1 << 63)), (True, article))]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "page", "site", "inside"])


def templates(pages: DataFrame, outside: float = OUTSIDE, inside: float = INSIDE, least: int = LEAST) -> DataFrame:
    """Keys of the subtrees that recur on a large share of a host's different pages: key, pages."""
    seen = pages.mapInArrow(_fingerprints, "key long, page long, site long, inside boolean").groupBy("key", "page").agg(F.first("site").alias("site"), F.first("inside").alias("inside"))
    counts = stored(seen.groupBy("key").agg(F.count("*").alias("pages"), F.first("site").alias("site"), F.first("inside").alias("inside")).where(F.col("pages") >= least), "subtrees")
    often = counts.where("key <> site")
    sites = often.groupBy("site").agg(F.count("*").alias("subtrees"))
    all_ = stored(counts.where("key = site").select("site", F.col("pages").alias("of")).join(sites, "site"), "sites")
    share = F.when(F.col("inside"), F.lit(inside)).otherwise(F.lit(outside))
    found = stored(looked_up(often, all_, ["site"], "subtrees").where(F.col("pages") >= share * F.col("of")).select("key", "pages"), "templates")
    released(counts, all_)
    return found


def host_of(url: Column) -> Column:
    """Host of a url: between ``://`` and the next ``/``, ``?`` or ``#``, in lower case; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[^:]*://([^/?#]*)", 1)), F.lit(""))


def _extracted(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value if known is not None else None
        for step in steps(batches, "html"):
            out = []
            lists = [None] * step.num_rows if known is not None else step.column("templates").to_pylist()
            for host, source, own in zip(step.column("host").to_pylist(), step.column("html").to_pylist(), lists):
                page = Page(source or "")
                keys, among = _keys(page, host), common if common is not None else np.sort(np.array(own or [], np.int64))
                at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
                hit = (among[at] == keys) & (keys != 0) if len(among) else np.zeros(len(keys), bool)
                out.append(page.main(hit.tolist()))
            yield pa.record_batch([step.column("page_id"), step.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Templates are broadcast as 8-byte keys while they are counted few. Beyond, each page's own templates are found
    by joins and given to it as a list.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    known = templates(source)
    schema = "page_id long, url string, text string, n_chars long"
    if known.count() <= broadcast_rows:
        keys = np.sort(np.array([r.key for r in known.select("key").toLocalIterator()], np.int64))
        return source.mapInArrow(_extracted(spark.sparkContext.broadcast(keys)), schema)
    source = source.withColumn("page_key", F.xxhash64("host", "html"))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            rows = [(p, int(k)) for p, host, text in zip(*(step.column(c).to_pylist() for c in ("page_key", "host", "html"))) for k in set(_keys(Page(text or ""), host).tolist()) if k]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), ()))], ["page_key", "key"])

    elements = stored(source.select("page_key", "host", "html").mapInArrow(keys_of, "page_key long, key long").distinct(), "elements")
    often = stored(elements.join(known.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("rows"), F.lit(True).alias("hit")), "often")
    own = looked_up(elements, often, ["key"], "rows").where("hit").groupBy("page_key").agg(F.collect_list("key").alias("templates"))
    lists = stored(own.join(source.groupBy("page_key").agg(F.count("*").alias("rows")), "page_key"), "lists")
    released(elements, often)
    return looked_up(source, lists, ["page_key"], "rows").mapInArrow(_extracted(None), schema)
