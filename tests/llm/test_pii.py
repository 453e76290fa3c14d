import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import odd_documents
from waymark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15))
    for kind, pattern, good in rules:
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text or "") if good(m[0])]
    return out


HARD = [
    "a@b.c@d.e f@g", "x@y..z a.b@c-d.e.f! @a.b", "1.2.3.4.5 01.002.3.255 256.1.1.1 1.2.3 9.9.9.9.9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111", "+1 (555) 123-4567 +55..11 +5(5)) +12345678901234567", "++1234567890+123456789",
    "é 4111111111111111 😀 me@x.org 日本 10.0.0.1", "12345678901234567890123 4111111111111111-", "1 2 3 4 5 6 7 8 9 0 1 2 8", "a" * 500 + "@" + "b.c" * 100, "1." * 300, "+" * 50 + "1" * 30, "0.0.0.0000000000000 1.1.1.0256", None, "",
]


def check(docs, got):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")], (r.doc_id, texts[r.doc_id][:200], base)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(HARD)
    check(docs, got)


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, pii.personal_data(docs).collect())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(docs.limit(0)).count() == 0
    assert pii.redacted(docs).count() == docs.count() and pii.redacted(docs).columns == docs.columns


def test_clashing_columns_keep_types_and_values(spark):
    names = ["email", "ip", "card", "phone", "secret", "account", "name", "candidate", "row", "_text", "_spans", "every", "cuts", "wide", "clean", "marks"]
    docs = spark.createDataFrame([(1, "me@x.org", "kept"), (2, None, None)], "doc_id long, text string, other string")
    docs = docs.select("doc_id", *[F.array(F.lit(n), "other").alias(n) for n in names], "text")
    got = pii.redacted(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "[EMAIL]" and rows[2].text is None
    assert all(rows[1][n] == [n, "kept"] and rows[2][n] == [n, None] for n in names)
    assert pii.personal_data(docs).count() == 2


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "\ufeffé write me@x.org or +1 555 123 4567, 10.0.0.1."), (2, "nothing"), (3, None), (4, "😀 +4111111111111111.5 end")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    # the last card begins inside a phone number that is too long for one, so only the card is replaced
    assert got == {1: "\ufeffé write [EMAIL] or [PHONE], [IP].", 2: "nothing", 3: None, 4: "😀 +[CARD].5 end"}


def test_redaction_replaces_overlapping_spans_together(spark):
    docs = spark.createDataFrame([(1, "call +4111 1111 (02) 10.0.0.1@x.org now")], "doc_id long, text string")
    spans = pii.personal_data(docs).first().spans
    got = pii.redacted(docs).first().text
    assert got == "call [PHONE] now", (got, spans)


def test_many_spans_in_one_long_text(spark):
    n = 6_000
    text = " ".join(f"u{i}@x.org" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.personal_data(docs).first()
    at = text.index(f"u{n - 1}@")
    assert got.n_email == n and got.spans.split(",")[n - 1] == f"email:{at}:{len(text)}"
    assert pii.redacted(docs).first().text == " ".join(["[EMAIL]"] * n)


def planted(seed=4, n=400):
    """Texts with marked further spans (kind, value) and with decoys that are none."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(k))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    makers = [
        lambda: ("secret", f'token = "{(v := hexes(40))}"', v),
        lambda: ("secret", f"password: {(v := mixed(9))}", v),
        lambda: ("secret", f"db_password='{(v := 'Sommer-' + mixed(5) + '!')}'", v),
        lambda: ("secret", f"use {(v := 'ghp_' + mixed(36))} here", v),
        lambda: ("secret", f"use {(v := 'xoxb-' + mixed(12) + '-' + mixed(24))} here", v),
        lambda: ("account", f"account {(v := iban())}", v),
        lambda: ("account", f"number {(v := f'{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}')}", v),
        lambda: ("name", f"with Frau {(v := 'Erika Mustermann')}", v),
        lambda: ("name", f"saw {(v := 'Maria ' + rng.choice(['Silva', 'Weber', 'Durand']))} there", v),
    ]
    decoys = [lambda: "the-2nd-edition-of-the-book", lambda: "order 1234567890123456789012", lambda: "2024-01-02T10:11:12", lambda: "/var/log/app-2/current", lambda: "in 12 cases: none", lambda: "The New York office", lambda: "Total=all", lambda: "state_of_the_art_2020_report"]
    words = "the cat sat on a mat and then went home again with some more words".split()
    rows, want = [], {}
    for i in range(n):
        parts, spans = [], []
        for _ in range(rng.randint(1, 5)):
            parts.append(" ".join(rng.choices(words, k=rng.randint(2, 8))))
            if rng.random() < 0.5:
                kind, text, value = rng.choice(makers)()
                spans.append((kind, sum(map(len, parts)) + len(parts) + text.index(value), len(value)))
                parts.append(text)
            else:
                parts.append(rng.choice(decoys)())
        rows.append((i, " ".join(parts)))
        want[i] = {(k, a, a + size) for k, a, size in spans}
    return rows, want


def test_precision_and_recall_of_further_spans(spark):
    rows, want = planted()
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in pii.FURTHER} for r in got}
    right = sum(len(want[i] & found[i]) for i in want)
    missed = {(k, rows[i][1][a:b]) for i in want for k, a, b in want[i] - found[i]}
    wrong = {(k, rows[i][1][a:b]) for i in want for k, a, b in found[i] - want[i]}
    assert right / sum(map(len, want.values())) >= 0.95, missed
    assert right / sum(map(len, found.values())) >= 0.95, wrong


def test_reliabilities_find_the_good_labelers():
    rng = np.random.RandomState(0)
    truth = rng.rand(4000) < 0.3
    say = lambda right: np.where(rng.rand(4000) < right, truth, ~truth) * 2 - 1
    votes = np.stack([say(0.95), say(0.9), say(0.55)], 1)
    table, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief = pii.reliabilities(table, n.astype(float))[at.ravel()]
    assert ((belief > 0.5) == truth).mean() > 0.93


def test_named_keys_of_any_length(spark):
    """A long key name is one like any other, and long runs of key characters, also of other alphabets, don't slow the search."""
    long = "x" * 70 + "_password=hunter2hunter"
    rows = [(1, long), (2, "é" * 300 + "_token: abcd1234efgh"), (3, "字" * 200_000 + "=x " + "a_" * 100_000), *[(k, f"api_key = Zq9{k}Lm2Kp7Rt{k}") for k in range(10, 40)]]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"secret:80:{len(long)}" and got[2].startswith("secret:308:") and got[3] == ""
