"""Phrases against SQL on a whole table and against a plain count on odd rows."""

import re
from collections import Counter

import pytest

from tests.compare import difference
from tests.llm.common import odd_documents
from waymark.llm import phrases

FOLDER = "/root/testdata/sf0.001"


def plain(rows, least, absorbed=80, first=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            count.update((lang, *words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    good = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *p), a in good.items():
        if any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= absorbed * a and any(list(q[i : i + len(p)]) == p for i in range(1, len(q))) for q, b in good.items()):
            continue
        score, _, left, right = min((2000000 * a // (count[(lang, *p[:k])] + count[(lang, *p[k:])]), k, count[(lang, *p[:k])], count[(lang, *p[k:])]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:first]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_sql_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for how in ({}, {"prefix_rows": 100}, {"broadcast_rows": 0}, {"prefix_rows": 40, "broadcast_rows": 0}):
        assert difference(phrases.collocations(docs, **how), phrases.ORACLE, FOLDER) == "", how


@pytest.mark.parametrize("how", [{}, {"prefix_rows": 5}, {"prefix_rows": 2, "broadcast_rows": 0}])
def test_odd_rows_ties_and_repeats(spark, how):
    more = spark.createDataFrame([(9, "a b a b a b. A\tB? a b, Ä b Ä b ä b", None), (10, "a b c d; a b c d e a b c d", "und"), (11, "a b c d\va b c\x0cd a b", "")], "doc_id long, text string, lang string")
    docs = odd_documents(spark).unionByName(more, allowMissingColumns=True)
    got = rows_of(phrases.collocations(docs, 2, **how))
    assert got == plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 2)
    assert any(r[0] == "en" and r[2].startswith("word and") for r in got)


def test_first_rows_only_and_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, f"w{i} v{i} w{i} v{i}", "en") for i in range(9)] * 2, "doc_id long, text string, lang string")
    assert rows_of(phrases.collocations(docs, 2, first=3)) == plain([(r.lang, r.text) for r in docs.collect()], 2, first=3)
    assert phrases.collocations(docs, 100).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_report_products_pass_64_bits(spark):
    """Counts as of a corpus of 1e17 words: the score's product needs more than 64 bits."""
    a = 10**17
    assert spark.sql(f"SELECT (cast({a} as decimal(31,0)) * 2000000) div (cast({3 * a} as decimal(37,0)) + {a}L) AS x").first().x == 500000
