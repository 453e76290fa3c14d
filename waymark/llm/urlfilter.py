"""Operator 6: URL rules with redirect equivalence, DataFrame functions only.

Pages are nodes by address; redirects and canonical links are edges. A page under a rule has
the rule's verdict. A page without one is blocked when an address of its component is blocked
by a rule and none is allowed by one: an explicit allow takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored
from waymark.llm.components import components

#: (action, host, path); the longest fitting rule wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Up to so many rules are tried one by one in each row; more are a table joined by host, with the same result.
IN_ROW = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_address(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with host, path and node of a url column.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then
    up to ``?``, ``#`` or the end. Both are empty without ``://``. Node: host, path without a
    closing slash, and query; null without a host. The columns build on each other step by step,
    so that each expression is evaluated once.
    """
    at = F.instr(url, "://")
    rows = rows.withColumn("rest", F.when(at > 0, F.col(url).substr(at + 3, F.length(url))))
    rows = rows.withColumn("host", F.coalesce(F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOWER), F.lit("")))
    rows = rows.withColumn("path", F.coalesce(F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1), F.lit("")))
    query = F.regexp_extract("rest", "^[^?#]*([?][^#]*)", 1)
    node = F.when(F.col("host") != "", F.concat("host", F.regexp_replace("path", "/$", ""), query))
    return rows.withColumn("node", node).drop("rest")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the host or a parent and whose path begins the path."""
    rule = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        action = F.when(fits, act).otherwise(action)
    return rule, action


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` (with host and path) with rule and action."""
    if len(rules) <= IN_ROW:
        rule, action = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumn("rule", rule).withColumn("action", action)
    table = rows.sparkSession.createDataFrame([(place, *r) for place, r in enumerate(rules)], "place int, action string, rule_host string, rule_path string")
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = rows.select("host", "path").distinct().withColumn("rule_host", F.explode(parents)).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), "place", rule.alias("rule"), "action")).alias("b"))
    return rows.join(best.select("host", "path", "b.rule", "b.action"), ["host", "path"], "left")


def _resolved(target: Column, path: Column) -> Column:
    """Path and query of a relative target on a page with this path."""
    own, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^.*/", 0)).otherwise("/")
    full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(full, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)  # a folder
    plain = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    return F.concat(F.when(own == "", path).otherwise(plain), rest)


_W = r"[ \t\n\f\r]"
_NAME = r"[^ \t\n\f\r/>=\"']+"


def _grammar(own: str) -> tuple[str, str]:
    """(attribute, token): patterns of an attribute and of what markup consists of: comments, raw text, tags.

    ``own`` is ``+`` where repeats may be possessive, which keeps long tags off the stack, else empty; the matches are the same.
    """
    value = rf"(?:\"[^\"]*{own}\"|'[^']*{own}'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*{own})"
    attribute = rf"{_NAME}{own}(?:{_W}*{own}={_W}*{own}{value})?{own}"
    raw = "|".join(rf"<{n}[ \t\n\f\r/>].*?(?:</{n}|\z)" for n in ("script", "style", "textarea", "title", "iframe", "xmp"))
    tag = rf"<[a-z][^ \t\n\f\r/>]*{own}(?:[ \t\n\f\r/](?:[ \t\n\f\r/=]+{own}|{attribute})*{own})?{own}>"
    return attribute, rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|{raw}|{tag}"


_ATTRIBUTE, _TOKEN = _grammar("+")
_READ = rf"(?i)^<(?:link|meta|base)[ \t\n\f\r/]"
_REFERENCE = "&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-z]+;|[^&]+|&"
_REFRESH = rf"(?is)^{_W}*[0-9.]+{_W}*[;,]?{_W}*(?:url{_W}*={_W}*)?"
#: Named character references that occur in addresses, fixed values.
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "colon": ":", "sol": "/", "period": ".", "quest": "?", "equals": "=", "num": "#", "lowbar": "_", "percnt": "%", "plus": "+", "comma": ",", "semi": ";"}


def decoded(text: Column) -> Column:
    """``text`` with its numeric and the NAMED character references decoded once."""

    def one(part: Column) -> Column:
        number = F.when(part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "^&#[xX](.*);$", 1), 16, 10)).when(part.rlike("^&#"), F.regexp_extract(part, "^&#(.*);$", 1)).cast("int")
        char = F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.unhex(F.lpad(F.hex(number), 8, "0"))), "UTF-32")
        got = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), char)
        for name, said in NAMED.items():
            got = got.when(part == f"&{name};", said)
        return got.otherwise(part)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute of that name, null without one, white space around it removed."""
    each = F.regexp_extract_all(F.regexp_replace(tag, "^<[A-Za-z]+", ""), F.lit(_ATTRIBUTE), F.lit(0))
    own = F.filter(each, lambda a: F.lower(F.regexp_extract(a, f"^{_NAME}", 0)) == name)
    raw = F.regexp_replace(F.get(own, F.lit(0)), f"(?s)^[^=]*=?{_W}*", "")
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return _trimmed(decoded(bare))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_W}+|{_W}+$", "")


def _absolute(target: Column, host: Column, path: Column) -> Column:
    """A target with ``//`` or a scheme as it stands, a relative one on host and path; null for a mere fragment."""
    full = F.when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target)).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
    return full.when(~F.startswith(target, F.lit("#")), F.concat(F.lit("http://"), host, _resolved(target, path)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst, host, path: addresses that each page's canonical links and meta redirects lead to, with host and path of dst.

    Markup is read as comments, raw text (scripts, styles and the like) and tags with attributes, so links inside the
    first two don't count. A link counts if ``canonical`` is one of the words of its ``rel``. Of equal attributes the first
    counts, character references are decoded. Relative targets are resolved on the first ``base`` of the page (itself on the page's
    address), else on the page's own host and path. A tag with a quote outside a value is not read.
    """
    tags = F.filter(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike(_READ))
    rows = with_address(pages.select("url", "html"), "url").select("host", "path", "node", tags.alias("tags")).where("node is not null and size(tags) > 0")
    bases = F.filter("tags", lambda t: t.rlike("(?i)^<base") & attribute(t, "href").isNotNull())
    rows = rows.withColumn("base", attribute(F.get(bases, F.lit(0)), "href"))
    rows = rows.withColumn("base", F.when(F.col("base") != "", _absolute(F.col("base"), F.col("host"), F.col("path"))))
    rows = with_address(rows.select(F.col("node").alias("src"), F.col("host").alias("own_host"), F.col("path").alias("own_path"), "tags", "base"), "base")
    based = F.col("host") != ""
    rows = rows.select("src", F.when(based, F.col("host")).otherwise(F.col("own_host")).alias("host"), F.when(based, F.col("path")).otherwise(F.col("own_path")).alias("path"), F.explode("tags").alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), f"{_W}+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    content = attribute(tag, "content")
    moved = F.when(content.rlike(_REFRESH), F.regexp_replace(content, _REFRESH, ""))
    moved = _trimmed(F.when(moved.rlike("^[\"']"), F.regexp_extract(moved, "(?s)^(?:\"([^\"]*)|'[^']*)", 0).substr(F.lit(2), F.length(moved))).otherwise(moved))
    rows = rows.withColumn("t", F.when(canonical, attribute(tag, "href")).when(refresh, moved)).where("t <> ''").select("src", "host", "path", "t").distinct()
    edges = with_address(rows.select("src", _absolute(F.col("t"), F.col("host"), F.col("path")).alias("target")), "target").select("src", F.col("node").alias("dst"), "host", "path")
    # stored before the filter, which would otherwise be expanded through every step above
    return stored(edges.distinct(), "aliases").where("src is not null and dst is not null and src <> dst")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (null without aliases).

    A null url or one without ``://`` has an empty host and path, no rule and the verdict allow;
    null html has no links, html of any length is searched whole. Repeated rows give repeated rows
    and other columns are not read. Rules see the paths that pages and links spell.
    """
    rows = ruled(with_address(pages.select("page_id", "url"), "url"), rules)
    edges = alias_edges(pages.select("url", "html"))
    groups = components(edges.select("src", "dst"))
    targets = ruled(edges.select(F.col("dst").alias("node"), "host", "path").distinct(), rules)
    said = rows.select("node", "action").unionByName(targets.select("node", "action")).where("action is not null").distinct()
    said = said.join(groups, "node").groupBy("component")
    said = said.agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    found = groups.join(said, "component", "left").select("node", "component", (F.col("blocked") & ~F.col("allowed")).alias("shut"))
    out = rows.join(found, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("shut"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


#: DuckDB twin of judged() with RULES on the table ``pages``.
ORACLE = r"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, html,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
page AS (
  SELECT row_id, page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*([?][^#]*)', 1), '') AS query FROM parts),
keyed AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') || query END AS node FROM page),
tokens AS (SELECT row_id, host, path, node, list_filter(regexp_extract_all(html, '@TOKEN@'), lambda t: regexp_matches(t, '@READ@')) AS tags FROM keyed WHERE node IS NOT NULL),
tagged AS (SELECT row_id, host, path, node, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM tokens),
attributes AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(tag, '^<[A-Za-z]+', ''), '@ATTRIBUTE@'),
  lambda a: {'name': lower(regexp_extract(a, '^@NAME@')), 'raw': regexp_replace(a, '(?s)^[^=]*=?@W@*', '')}) AS attrs FROM tagged),
chosen AS (SELECT row_id, host, path, node, lower(tag[2:5]) AS kind, place, list_transform(['rel', 'href', 'http-equiv', 'content'], lambda n: list_filter(attrs, lambda a: a.name = n)[1].raw) AS raws FROM attributes),
bare AS (SELECT *, list_transform(raws, lambda r: CASE WHEN regexp_matches(r, '^["'']') THEN substr(r, 2, length(r) - 2) ELSE r END) AS texts FROM chosen),
plain_texts AS (SELECT *, list_transform(texts, lambda t: CASE WHEN t IS NOT NULL THEN regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '@REFERENCE@'), lambda p: CASE
    WHEN regexp_matches(p, '^&#[xX]') AND (CAST('0x' || regexp_extract(p, '^&#[xX](.*);$', 1) AS BIGINT) BETWEEN 1 AND 55295 OR CAST('0x' || regexp_extract(p, '^&#[xX](.*);$', 1) AS BIGINT) BETWEEN 57344 AND 1114111) THEN chr(CAST('0x' || regexp_extract(p, '^&#[xX](.*);$', 1) AS INTEGER))
    WHEN regexp_matches(p, '^&#[0-9]') AND (CAST(regexp_extract(p, '^&#(.*);$', 1) AS BIGINT) BETWEEN 1 AND 55295 OR CAST(regexp_extract(p, '^&#(.*);$', 1) AS BIGINT) BETWEEN 57344 AND 1114111) THEN chr(CAST(regexp_extract(p, '^&#(.*);$', 1) AS INTEGER))
    @NAMED@ ELSE p END), ''), '^@W@+|@W@+$', '', 'g') END) AS v FROM bare),
said AS (SELECT row_id, host, path, node, kind, place, v[1] AS rel, v[2] AS href, v[3] AS equiv, v[4] AS content FROM plain_texts),
moved AS (SELECT *, CASE WHEN regexp_matches(content, '@REFRESH@') THEN regexp_replace(content, '@REFRESH@', '') END AS m FROM said),
wanted AS (
  SELECT row_id, host, path, node, 1 AS step, arg_min(href, place) AS t FROM said WHERE kind = 'base' AND href IS NOT NULL GROUP BY ALL
  UNION ALL SELECT row_id, host, path, node, 2, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '@W@+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN regexp_replace(CASE WHEN regexp_matches(m, '^["'']') THEN substr(regexp_extract(m, '(?s)^(?:"[^"]*|''[^'']*)'), 2) ELSE m END, '^@W@+|@W@+$', '', 'g') END FROM moved),
base_pieces AS (SELECT *, @PIECES@ FROM wanted WHERE step = 1 AND t <> ''),
base_split AS (SELECT *, @PARTS@ AS parts FROM base_pieces),
base_walked AS (SELECT *, @WALKED@ AS plain FROM base_split),
base_rest AS (SELECT row_id, @REST@ AS rest FROM base_walked),
bases AS (SELECT row_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS base_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS base_path FROM base_rest WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
raw_targets AS (SELECT coalesce(b.base_host, w.host) AS host, coalesce(b.base_path, w.path) AS path, w.node, w.t FROM wanted w LEFT JOIN bases b USING (row_id) WHERE w.step = 2 AND w.t <> ''),
pieces AS (SELECT *, @PIECES@ FROM raw_targets),
split_up AS (SELECT *, @PARTS@ AS parts FROM pieces),
walked AS (SELECT *, @WALKED@ AS plain FROM split_up),
targets AS (SELECT node, @REST@ AS rest FROM walked),
links AS (
  SELECT DISTINCT node AS src, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    coalesce(regexp_extract(rest, '^[^?#]*([?][^#]*)', 1), '') AS query FROM targets WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
edges AS (SELECT src, host || regexp_replace(path, '/$', '') || query AS dst, host, path FROM links),
both_ways AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(node, other) AS (SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
alias AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
addresses AS (SELECT node, host, path FROM keyed WHERE node IS NOT NULL UNION SELECT dst, host, path FROM edges),
node_said AS (
  SELECT a.component, arg_max(r.action, length(r.rule_host || r.rule_path)) AS said FROM alias a JOIN addresses x USING (node) JOIN rules r
    ON (x.host = r.rule_host OR ends_with(x.host, '.' || r.rule_host)) AND starts_with(x.path, r.rule_path) GROUP BY a.component, x.node, x.host, x.path),
shut AS (SELECT component, bool_or(said = 'block') AND NOT bool_or(said = 'allow') AS shut FROM node_said GROUP BY component),
ruled AS (
  SELECT k.row_id, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, arg_max(r.action, length(r.rule_host || r.rule_path)) AS action
  FROM keyed k JOIN rules r ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path) GROUP BY k.row_id)
SELECT k.page_id, k.host, k.path, d.rule, coalesce(d.action, CASE WHEN s.shut THEN 'block' ELSE 'allow' END) AS verdict, a.component
FROM keyed k LEFT JOIN ruled d ON k.row_id = d.row_id LEFT JOIN alias a ON k.node = a.node LEFT JOIN shut s ON a.component = s.component
"""
_PARTS = {
    "PIECES": r"regexp_extract(t, '^[^?#]*') AS own, regexp_extract(t, '^[^?#]*(.*)$', 1) AS more, CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^.*/') ELSE '/' END AS folder",
    "PARTS": "string_split(CASE WHEN own LIKE '/%' THEN own ELSE folder || own END, '/')",
    "WALKED": "list_reduce(list_concat([''], parts[2:], CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE [] END), lambda a, b: CASE b WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || b END)",
    "REST": """CASE WHEN t LIKE '//%' THEN substr(t, 3) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN position('://' IN t) > 0 THEN substr(t, position('://' IN t) + 3) END
    WHEN t NOT LIKE '#%' THEN host || CASE WHEN own = '' THEN path ELSE plain END || more END""",
    "NAMED": " ".join("WHEN p = '&{}' THEN '{}'".format(n + ";", c.replace("'", "''")) for n, c in NAMED.items()),
} | {k: v.replace("'", "''") for k, v in {"TOKEN": _grammar("")[1], "ATTRIBUTE": _grammar("")[0], "READ": _READ, "NAME": _NAME, "REFERENCE": _REFERENCE, "REFRESH": _REFRESH, "W": _W}.items()}
for _name, _part in _PARTS.items():
    ORACLE = ORACLE.replace(f"@{_name}@", _part)
