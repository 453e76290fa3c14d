import re

from tests.llm.common import odd_documents
from waymark.llm import quality
from waymark.llm.quality import cleaned, line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def plain_verdict(text):
    """(kept, characters lost, failing lines) by the rules, line by line and character by character."""
    text = text or ""
    n_words, chars, _, _, _, base_failed = plain(text)
    seen, lost, failing = set(), 0, 0
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    for line in lines:
        words = WORD.findall(line)
        size = sum(map(len, words))
        symbols = sum(c in "#*$%&|<>" for c in line)
        capitals = sum("A" <= c <= "Z" or "\xc0" <= c <= "\xde" for c in line)
        smalls = sum("a" <= c <= "z" or "\xe0" <= c <= "\xff" for c in line)
        bad = bool(words) and line in seen
        bad |= symbols >= 3 and symbols >= quality.SYMBOL_SHARE * max(size, 1)
        bad |= line.count("|") >= 2 and line.count("|") >= quality.BAR_SHARE * max(len(words), 1)
        bad |= len(words) >= 4 and capitals >= 10 and capitals >= quality.CAPITAL_SHARE * (capitals + smalls)
        bad |= len(words) >= quality.UNBROKEN_WORDS and not any(c in ".,;:?!" for c in line)
        bad |= len(words) >= quality.REPEAT_WORDS and len(set(words)) < quality.DISTINCT_SHARE * len(words)
        bad |= 0 < len(words) <= quality.BOILERPLATE_WORDS and bool(re.search(quality.BOILERPLATE, line))
        if words:
            seen.add(line)
        lost += size * bad
        failing += bad
    return not base_failed and lost <= quality.MAX_LOSS * chars, lost, failing


def test_verdict_equals_the_rules_line_by_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = line_quality(docs).collect()
    wrong = [(r.doc_id, (r.kept, r.lost_chars, r.n_failed_lines), plain_verdict(texts[r.doc_id])) for r in got if (r.kept, r.lost_chars, r.n_failed_lines) != plain_verdict(texts[r.doc_id])]
    assert not wrong, wrong[:3]
    assert sum(r.n_failed_lines > 0 for r in got) > 50


def test_boilerplate_of_four_languages(spark):
    lines = ["Tous droits réservés", "Alle Rechte vorbehalten.", "Todos los derechos reservados", "All Rights Reserved", "Bitte hier klicken", "Política de privacidad"]
    good = "\n".join(f"Sentence {w} of this text names {w}, and then it tells us why {w} matters." for w in "rain snow wind hail sleet fog heat frost".split())
    docs = spark.createDataFrame([(i, f"{x}\n{good}") for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.text for r in cleaned(docs).collect()} == {good}


def test_equals_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = line_quality(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = line_quality(docs).collect()
    assert sorted(tuple(r)[1:7] for r in got) == sorted(plain(r.text) for r in docs.collect())
    assert line_quality(docs.limit(0)).count() == 0 and cleaned(docs.limit(0)).count() == 0


def test_lines_that_fail_go(spark):
    good = "\n".join(f"Sentence {w} of this text names {w}, and then it tells us why {w} matters." for w in "rain snow wind hail sleet fog heat frost".split())
    bad = "Home | News | Sport | Login\nall rights reserved\n" + good + "\nBUY NOW BUY NOW CHEAP GOODS HERE\n"
    junk = "\n".join(["Subscribe to read more about this topic today"] + [f"click here {i} times to share this on pages" for i in range(12)])
    docs = spark.createDataFrame([(1, good, 7), (2, bad, 7), (3, junk, 7)], "doc_id long, text string, n_failed_lines long")
    out = {r.doc_id: r for r in cleaned(docs).collect()}
    assert out[1].text == good and out[2].text == good and set(out) == {1, 2}
    assert out[1].n_failed_lines == 7  # a column of the input, not the figure
