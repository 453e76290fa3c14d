"""Operator 10: personal data by weak supervision, DataFrame functions only.

Four kinds have fixed rules. Further candidates (values of 4 characters or more of named keys, keys as issuers write
them, runs of 12 characters or more with digits, account numbers, names after a title or a known given name) are voted on by
regex, gazetteer, context and format labelers. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; its posteriors train a logistic span classifier
whose weights become an expression. Only the bounded table of patterns reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored

#: Base kinds in order. The patterns match what the plain ones do; possessive repeats and
#: look-behinds only keep the search linear on long runs. Cards of fewer than 13 digits can't pass.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": "+"}
#: Gazetteers, fixed values: names of keys whose value is secret, how issued keys begin, titles, given names.
KEYS = ("token", "password", "passwd", "pwd", "secret", "api[_-]?key", "access[_-]?key", "private[_-]?key", "passwort", "kennwort", "contraseña", "clave")
ISSUED = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_", "pk_", "rk_", "eyJ", "npm_", "SG.")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Don", "Doña")
GIVEN = ("Anna", "Anne", "Carlos", "Charles", "Claire", "David", "Elena", "Elisabeth", "Emma", "Hans", "Isabel", "James", "Jean", "Johann", "John", "José", "Juan", "Julia", "Karl", "Laura", "Luis", "Maria", "María", "Marie", "Martin", "Mary", "Michael", "Paul", "Pedro", "Peter", "Pierre", "Robert", "Sophie", "Thomas", "William")
_ASSIGNS = r"[\"']?\x20?[=:]\x20?[\"']?"
_KEY = r"[\p{L}0-9_.-]"
#: A key of any length: as a search begins at the first character of a run of key characters only, it stays linear.
NAMED = rf"(?={_KEY}{{3,}}+[\"']?\x20?[=:])(?i:{_KEY}*(?:{'|'.join(KEYS)})){_ASSIGNS}"
TITLED = rf"(?:{'|'.join(TITLES)})\.?\x20"
_NAME = r"\p{Lu}\p{Ll}+"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_RUN = r"A-Za-z0-9_+/=-"
#: What precedes the value of a candidate inside its match.
LEAD = f"^(?:{NAMED}|{TITLED})"
_NAMES = rf"(?=[A-ZÑ])(?<!\p{{L}})(?:{TITLED}{_NAME}(?:\x20{_NAME})?|(?:{'|'.join(GIVEN)})\x20{_NAME}"
_NUMBERED = rf"(?<![.{_RUN}])(?:{SSN}(?![0-9-])|(?=[A-Za-z_+/=-]*+[0-9])[{_RUN}]{{12,}}+)"
#: Candidates of texts with an assignment, of others with a digit, and of all others.
CANDIDATES = (
    ("[=:]", rf"(?<!{_KEY}){NAMED}[^\s\"'<>,;]{{4,}}+|{_NAMES}|{IBAN}(?![A-Za-z0-9]))|{_NUMBERED}"),
    ("[0-9]", rf"{_NAMES}|{IBAN}(?![A-Za-z0-9]))|{_NUMBERED}"),
    ("", f"{_NAMES})"),
)
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
_FOLD = 64  # items that a list grows by at once


def folded(items: Column, zero: Column, none: Column, step) -> Column:
    """The list that ``step`` makes of ``items``: (state, item) -> (state, element) as struct at, one.

    Items are taken in blocks and their elements appended a block at a time, so a list of many
    thousands isn't copied for each of them.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _FOLD)), lambda i: F.slice(items, (i * _FOLD + 1).cast("int"), F.lit(_FOLD)))

    def one(acc: Column, item: Column) -> Column:
        got = step(acc["at"], item)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["one"])).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], got["out"]).alias("out"))

    whole = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), block, lambda a: a["out"])
    return F.when(F.size(items) > 0, whole).otherwise(none)


def spans_of(gaps: Column, found: Column) -> Column:
    """Leftmost non-overlapping matches with code-point offsets (end exclusive) from the matches and the text split at them.

    Offsets are running lengths of gaps and matches.
    """
    pairs = F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    none = F.from_json(F.lit("[]"), _SPAN)

    def step(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.cast("long").alias("at"), F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), pair["value"].alias("value")).alias("one"))

    return F.when(F.size(found) > 0, folded(pairs, F.lit(0).cast("long"), none, step)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    spread = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(spread, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str):
    return lambda span: _passes(kind, span["value"])


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _possible(kind: str) -> Column:
    need = NEEDS[kind]
    return F.contains("text", F.lit(need)) if len(need) == 1 else F.col("digits") & F.col("text").rlike(need)


def found(docs: DataFrame, text: str = "text", kinds: bool = True) -> DataFrame:
    """``docs`` as the struct column ``row``, with ``text``, valid spans per base kind, and ``candidate``.

    Columns of ``docs`` stay inside ``row``, so none of their names can clash.
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("text", F.coalesce(F.col("row")[text], F.lit("")))
    out = out.withColumn("digits", F.col("text").rlike("[0-9]")).withColumn("assigns", F.col("text").rlike(CANDIDATES[0][0]))
    tried = {k: [(_possible(k), p)] for k, p in PATTERNS.items()} if kinds else {}
    tried["candidate"] = [(g, p) for g, (_, p) in zip((F.col("assigns"), F.col("digits"), F.lit(True)), CANDIDATES)]

    def first(ways, otherwise: Column) -> Column:
        for guard, way in reversed(ways):
            otherwise = F.when(guard, way).otherwise(otherwise)
        return otherwise

    for kind, ways in tried.items():
        matches = [(g, F.regexp_extract_all("text", F.lit(p), F.lit(0))) for g, p in ways]
        out = out.withColumn(kind, first(matches, F.array().cast("array<string>")))
    # most texts have no match of a kind and need no offsets of it
    for kind, ways in tried.items():
        gaps = first([(g, F.split("text", p, -1)) for g, p in ways], F.array().cast("array<string>"))
        spans = spans_of(gaps, F.col(kind))
        out = out.withColumn(kind, spans if kind == "candidate" else F.filter(spans, _valid(kind)))

    def parted(s: Column) -> Column:
        lead = F.regexp_extract(s["value"], LEAD, 0)
        return F.struct((s["start"] + F.length(lead)).alias("start"), s["end"].alias("end"), F.substring(s["value"], F.length(lead) + 1, F.length(s["value"])).alias("value"), lead.alias("lead"))

    return out.withColumn("candidate", F.transform("candidate", parted))


def iban(value: Column) -> Column:
    """Whether an account number passes the check modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (F.when(c.rlike("^[0-9]$"), a * 10).otherwise(a * 100) + number(c)) % 97) == 1


def kind_of(value: Column, lead: Column) -> Column:
    """secret, account or name."""
    account = (lead == "") & value.rlike(f"^(?:{IBAN}|{SSN})$")
    name = value.rlike(rf"^{_NAME}(?:\x20{_NAME})?$") & ~lead.rlike("[=:]")
    return F.when(name, "name").when(account, "account").otherwise("secret")


def traits(value: Column, lead: Column) -> dict[str, Column]:
    """Yes-or-no features of a candidate."""
    letters, digits = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(_digits(value))
    kind = kind_of(value, lead)
    secret, number = kind == "secret", letters == 0
    return {
        "hexadecimal": secret & value.rlike("^[0-9a-f]{16,}$") & ~number,
        "capitals": secret & value.rlike("^[A-Z0-9]{16,}$") & ~number,
        "long": secret & (F.length(value) >= 16),
        "named": lead.rlike("[=:]"),
        "issued": secret & value.rlike(f"^(?:{'|'.join(ISSUED).replace('.', '[.]')})") & ~number,
        "mixed": secret & (letters >= 3) & (digits >= 2),
        "number": secret & number,
        "slug": secret & value.rlike("(?:^|[-/_=+])[a-z]{3,}(?:[-/_=+]|$)"),
        "secret": secret,
        "known": (kind == "name") & (lead != ""),
        "format": (kind == "account") & (F.when(value.rlike(f"^{IBAN}$"), iban(value)).otherwise(~value.rlike("^(?:000|666|9)|-00-|-0000$"))),
    }


def votes(t: dict[str, Column]) -> dict[str, Column]:
    """Each labeler says 1 (personal or secret), -1 (neither) or 0 (no opinion)."""
    when = F.when
    return {
        "shape": when(t["hexadecimal"] | t["capitals"], 1).when(t["number"] | (t["slug"] & ~t["issued"] & ~t["named"]), -1).otherwise(0),
        "gazetteer": when(t["issued"] | t["known"], 1).when(~t["secret"] & ~t["format"], 0).otherwise(0),
        "context": when(t["named"], 1).otherwise(0),
        "format": when(t["format"], 1).when(~t["secret"] & ~t["known"], 0).otherwise(0),
        "mixture": when(t["mixed"], 1).when(t["secret"] & ~t["named"], -1).otherwise(0),
        "length": when(t["long"], 1).when(t["secret"] & ~t["named"], -1).otherwise(0),
    }


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation (Dawid-Skene, two classes)."""
    belief = 1 / (1 + np.exp(-patterns.sum(1)))
    for _ in range(rounds):
        prior = (counts @ belief + 1) / (counts.sum() + 2)
        score = np.full(len(patterns), np.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                here = patterns[:, j] == v
                yes = (counts[here] @ belief[here] + 1) / (counts @ belief + 3)
                no = (counts[here] @ (1 - belief[here]) + 1) / (counts @ (1 - belief) + 3)
                score[here] += np.log(yes / no)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - belief).max() < 1e-9:
            return new
        belief = new
    return belief


def train_classifier(spans: DataFrame) -> dict[str, float] | None:
    """Weights of the span classifier from all candidates; None without any."""
    each = spans.select(F.explode("candidate").alias("c")).select("c.value", "c.lead")
    t = traits(F.col("value"), F.col("lead"))
    each = each.select(*[c.cast("int").alias(k) for k, c in t.items()])
    table = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    said = votes({k: F.col(k) == 1 for k in t})
    table = table.select("*", *[c.alias(f"vote_{k}") for k, c in said.items()]).collect()  # at most 2 ** 11 patterns
    if not table:
        return None
    names = list(t)
    x = np.array([[1, *[r[k] for k in names]] for r in table], float)
    patterns = np.array([[r[f"vote_{k}"] for k in said] for r in table])
    n = np.array([r.n for r in table], float)
    belief = reliabilities(patterns, n)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # ridge logistic regression on the posteriors, by Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (n * (belief - p)) - 0.1 * w)
    return dict(zip(["", *names], w.tolist()))


BASE = tuple(PATTERNS)
FURTHER = ("secret", "account", "name")
KINDS = (*BASE, *FURTHER)


def classified(spans: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """``spans`` with one array column for each of FURTHER instead of ``candidate``."""

    def accepted(kind: str):
        def test(s: Column) -> Column:
            if weights is None:
                return F.lit(False)
            t = traits(s["value"], s["lead"])
            return (kind_of(s["value"], s["lead"]) == kind) & (sum((c.cast("int") * weights[k] for k, c in t.items()), F.lit(weights[""])) >= 0)

        return test

    for kind in FURTHER:
        spans = spans.withColumn(kind, F.filter("candidate", accepted(kind)))
    return spans.drop("candidate")


def _label(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _listed(kinds) -> Column:
    return F.array_join(F.concat(*[F.transform(k, _label(k)) for k in kinds]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_account, n_name.

    Null and empty texts have no spans; a text of any length is searched whole. Repeated rows
    give repeated rows, a null doc_id stays null and other columns are not read. Kinds may
    overlap; within a kind spans don't. The texts are searched once: spans are stored.
    """
    once = found(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), *BASE, "candidate")
    once = stored(once, "spans")
    spans = classified(once, train_classifier(once.select("candidate").where(F.size("candidate") > 0)))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts[:4], F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), *counts[4:])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kind, as in ``[EMAIL]``.

    Spans that overlap are replaced together, by the kind of the one that begins first, the longer
    if two begin together. Null texts stay null, texts of any length are searched whole, repeated
    rows stay repeated; all other columns keep their names, types and values, whatever they are called.
    """
    seen = stored(found(docs, kinds=False).where(F.size("candidate") > 0).select("candidate"), "candidates")
    spans = classified(found(docs), train_classifier(seen))

    def marked(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("mark"))

    every = F.array_sort(F.concat(*[F.transform(k, marked(k)) for k in KINDS]))
    spans = spans.withColumn("every", every)
    none = F.from_json(F.lit("[]"), "array<struct<after:bigint,start:bigint,mark:string>>")

    def step(at: Column, s: Column) -> Column:  # a span that begins inside earlier ones only moves their end
        mark = F.when(s["start"] >= at, s["mark"])
        return F.struct(F.greatest(at, -s["back"]).alias("at"), F.struct(at.alias("after"), s["start"].alias("start"), mark.alias("mark")).alias("one"))

    spans = spans.withColumn("cuts", F.filter(folded(F.col("every"), F.lit(0).cast("long"), none, step), lambda c: c["mark"].isNotNull()))
    # four bytes for each code point, so that a piece is found without a walk through the text
    spans = spans.withColumn("wide", F.when(F.size("cuts") > 0, F.encode("text", "UTF-32")))
    piece = lambda start, length: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring("wide", (start * 4 + 1).cast("int"), (length * 4).cast("int"))), "UTF-32")
    marked_up = F.array_join(F.transform("cuts", lambda c: F.concat(piece(c["after"], c["start"] - c["after"]), c["mark"])), "")
    last = F.array_max(F.transform("every", lambda s: -s["back"]))
    text = F.when(F.size("cuts") > 0, F.concat(marked_up, piece(last, F.length("text") - last))).otherwise(F.col("row.text"))
    return spans.withColumn("clean", text).select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
