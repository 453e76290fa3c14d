"""Text expressions: normal forms of names and plates, token scores, ordered rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Accented Latin letters and their plain forms, and the confusable plate characters.
ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝáàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNYaaaaaaeeeeiiiiooooouuuucnyy"
OCR_PAIRS = {"0": "O", "O": "0", "1": "I", "I": "1", "8": "B", "B": "8", "5": "S", "S": "5"}
PLATE_DIGITS, PLATE_LETTERS = "0123456789", "ABCDEFGHIJ"

PLATE = r"^[A-Z]{3}[0-9][A-Z0-9][0-9]{2}$"


def plain(s: Column) -> Column:
    """Without accents."""
    return F.translate(s, ACCENTED, PLAIN)


def name_key(s: Column) -> Column:
    """Trimmed, single spaces, upper case, no accents."""
    return F.upper(plain(F.trim(F.regexp_replace(s, r"\s+", " "))))


def score_key(s: Column) -> Column:
    """Lower case, no accents, every other character than a letter or digit a space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain(s)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def group_key(s: Column) -> Column:
    """Key under which spellings that differ in case, accents or spaces are one."""
    return F.lower(name_key(s))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column, unequal: int = 99) -> Column:
    """Number of differing characters; ``unequal`` when lengths differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(unequal)).when(F.length(a) == 0, F.lit(0)).otherwise(F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def plate_key(s: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def plate_valid(s: Column) -> Column:
    """Old (LLLNNNN) or new (LLLNLNN) plate form."""
    return F.coalesce(plate_key(s).rlike(PLATE), F.lit(False))


def ocr_variants(plate: Column) -> Column:
    """The plate and all plates that differ in one commonly misread character (7 characters only)."""
    pairs = F.create_map(*[F.lit(x) for kv in OCR_PAIRS.items() for x in kv])

    def swapped(i: Column) -> Column:
        other = F.try_element_at(pairs, F.substring(plate, i, F.lit(1)))
        return F.concat(F.substring(plate, F.lit(1), i - 1), other, F.substring(plate, i + 1, F.lit(7)))

    every = F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), swapped), lambda x: x.isNotNull())
    return F.when(F.length(plate) != 7, F.array(plate)).otherwise(F.array_distinct(F.concat(F.array(plate), every)))


def series_variants(plate: Column) -> Column:
    """The plate and its other form: the fifth character is a digit in the old series, a letter in the new."""
    fifth = F.substring(plate, 5, 1)
    other = F.translate(fifth, PLATE_DIGITS + PLATE_LETTERS, PLATE_LETTERS + PLATE_DIGITS)
    moved = F.concat(F.substring(plate, 1, 4), other, F.substring(plate, 6, 2))
    return F.when((F.length(plate) == 7) & (other != fifth), F.array(plate, moved)).otherwise(F.array(plate))


def visual_key(plate: Column) -> Column:
    """Characters that look alike made equal: letters in the first three places, digits in the fourth, sixth and seventh."""
    head = F.translate(F.substring(plate, 1, 3), "01", "OI")
    one = lambda k: F.translate(F.substring(plate, k, 1), "OI", "01")
    return F.when(F.length(plate) == 7, F.concat(head, one(4), F.translate(F.substring(plate, 5, 1), "OI", "01"), one(6), one(7))).otherwise(plate)


def core_tokens(s: Column, stopwords: Iterable[str] = ()) -> Column:
    """Distinct upper-case tokens of the part before the first comma, without single letters and stopwords."""
    first = F.element_at(F.split(name_key(s), ","), 1)
    tokens = F.array_distinct(F.filter(F.split(first, "[^A-Z0-9]+"), lambda t: (t != "") & ~t.rlike("^[A-Z]$")))
    return F.coalesce(F.array_except(tokens, F.array(*map(F.lit, stopwords)).cast("array<string>")), F.array().cast("array<string>"))


def token_score(a: Column, b: Column) -> Column:
    """Distance of two token sets, lower is nearer; null for no match.

    max(|A|, |B|) - |A and B|. If both hold short numbers and share none, another shared word is
    needed and 3 is added. Without a shared token the longest words may differ by two edits.
    """
    number, word = (lambda t: t.rlike("^[0-9]{1,3}$")), (lambda t: ~t.rlike("^[0-9]+$"))
    both = F.size(F.array_intersect(a, b))
    larger = F.greatest(F.size(a), F.size(b))
    na, nb, wa, wb = F.filter(a, number), F.filter(b, number), F.filter(a, word), F.filter(b, word)
    clash = (F.size(na) > 0) & (F.size(nb) > 0) & (F.size(F.array_intersect(na, nb)) == 0)
    words = F.size(F.array_intersect(wa, wb))
    longest = lambda w: F.aggregate(w, F.lit(""), lambda m, t: F.when(F.length(t) > F.length(m), t).otherwise(m))
    la, lb = longest(wa), longest(wb)
    edits = F.levenshtein(la, lb)
    fuzzy = F.when((F.length(la) >= 5) & (F.length(lb) >= 5) & (edits <= 2), larger + edits)
    clashed = F.when(words > 0, F.greatest(F.size(wa), F.size(wb)) - words + 3)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), None).when(clash, clashed).when(both > 0, larger - both).otherwise(fuzzy)


def trigrams(s: Column) -> Column:
    """Distinct letter triples of each word, with two spaces before it and one after."""
    words = F.filter(F.split(score_key(s), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.coalesce(F.array_distinct(F.flatten(each)), F.array().cast("array<string>"))


def first_match(rules: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule whose condition holds: one ordered CASE."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def keyword_class(s: Column, rules: Mapping[str, str], otherwise: str | None = None) -> Column:
    """The name of the first pattern that the normalised text matches."""
    key = name_key(s)
    return first_match([(key.rlike(pattern), F.lit(name)) for name, pattern in rules.items()], otherwise)


def code_and_name(s: Column) -> tuple[Column, Column]:
    """(code, name) of ``CODE - NAME``, ``CODE NAME`` or ``NAME (CODE)``; a null code otherwise."""
    text = F.trim(s)
    lead, tail = F.regexp_extract(text, r"^([0-9]{3,})\s*(?:-\s*)?(.+)$", 1), F.regexp_extract(text, r"\(([0-9]{3,})\)\s*$", 1)
    code = F.when(lead != "", lead).when(tail != "", tail)
    name = F.when(lead != "", F.regexp_extract(text, r"^([0-9]{3,})\s*(?:-\s*)?(.+)$", 2)).when(tail != "", F.trim(F.regexp_replace(text, r"\([0-9]{3,}\)\s*$", ""))).otherwise(text)
    return code, name


# Street types and their abbreviations.
STREET_TYPES = {"AVENIDA": r"AV|AVE|AVEN", "RUA": r"R", "ESTRADA": r"EST|ESTR", "RODOVIA": r"ROD", "TRAVESSA": r"TV|TRAV", "PRACA": r"PC|PCA|PRC"}


def address_key(s: Column) -> Column:
    """Address without postal code and marks, with full street types."""
    out = F.regexp_replace(name_key(s), r"\b[0-9]{5}-?[0-9]{3}\b", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^A-Z0-9, ]", " "), r"\s+", " "))
    for full, short in STREET_TYPES.items():
        out = F.regexp_replace(out, rf"^({short})[ .]+", f"{full} ")
    return F.trim(F.regexp_replace(out, r"\s*,\s*", ","))


def street_number_key(s: Column) -> Column:
    """``STREET,NUMBER`` of an address; null without a number."""
    key = address_key(s)
    street, number = F.regexp_extract(key, r"^([^,0-9]+?)[, ]+([0-9]+)\b", 1), F.regexp_extract(key, r"^([^,0-9]+?)[, ]+([0-9]+)\b", 2)
    return F.when(number != "", F.concat_ws(",", F.trim(street), number))


def repaired_plate(raw: Column, known: Column) -> Column:
    """``raw`` if it is in the array ``known``, else the only known plate among its misreadings, else ``raw``."""
    hits = F.array_intersect(F.array_distinct(F.concat(ocr_variants(raw), series_variants(raw))), known)
    return F.when(F.array_contains(known, raw), raw).when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise(raw)


#: Fixed value: a common beginning only counts from this similarity on.
BOOST_FROM = 0.7


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro < BOOST_FROM:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity (Spark has none built in); null if a side is null, 0 if one is empty.

    Each distinct pair of a batch is compared once.
    """
    pairs = list(zip(a, b))
    known = {p: None if p[0] is None or p[1] is None else _jaro_winkler(*p) if p[0] and p[1] else 0.0 for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype=np.float64)


def hybrid_score(a: Column, b: Column) -> Column:
    """0.6 Jaro-Winkler + 0.4 edit similarity; 0 if a side is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(0.6 * jaro_winkler(a, b) + 0.4 * similarity(a, b))
