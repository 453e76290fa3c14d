"""The conversation trie against SQL on whole tables and against a plain walk on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tests.compare import difference
from waymark.llm import ordered, trie

FOLDER = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*NAMES).collect())


def odd(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "hello there" if t == 0 else f"turn {t} {c % 3}") for c in range(45) for t in range(c % 6)]
    rows += [(100, t, "user", f"long {t // 2} words here\n") for t in range(300)] + [(101, t, "user", f"long {t // 2} words here\n") for t in range(290)] + [(120, 5, None, None), (120, None, "user", "no turn"), (121, 1, None, "")]
    rows += [(140, 1, "user", "tie"), (140, 1, "user", "a tie"), (140, 1, "user", "tie"), (-7, 1, "user", "minus"), (-7, 2, "user", "minus two"), (None, 1, "user", "lost"), (160, 1, "x:y", "z"), (161, 1, "x", ":yz"), (163, 0, "ü", "😀 é")]
    rows += [(c, 0, "user", "one for all of these") for c in range(200, 320)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_equals_sql_on_the_whole_table(spark):
    assert difference(trie.prefix_trie(spark.read.parquet(f"{FOLDER}/conversations.parquet")), trie.ORACLE, FOLDER) == ""


@pytest.mark.parametrize("block", [16, 3])
def test_odd_rows_equal_a_plain_walk(spark, monkeypatch, block):
    """Long conversations of several blocks, nulls, ties, repeats, negative ids; extra columns with names of its own."""
    monkeypatch.setattr(trie, "BLOCK", block)
    if block == 3:  # the way of lookups beyond a broadcast
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ordered, "HOT_ROWS", 20)
    df = odd(spark)
    expected = plain(df.collect())
    found = trie.prefix_trie(df.withColumns({c: df.turn for c in ("node", "place", "number", "key", "at", "up")}))
    assert rows_of(found) == expected


def test_intervals_hold_subtrees(spark):
    rows = {r.preorder: r for r in trie.prefix_trie(odd(spark)).collect()}
    assert sorted(rows) == list(range(len(rows)))
    for r in rows.values():
        inside = [x for x in range(r.preorder + 1, r.subtree_end + 1)]
        assert all(rows[x].depth > r.depth for x in inside) and (r.subtree_end + 1 not in rows or rows[r.subtree_end + 1].depth <= r.depth)
        assert r.n_leaves == sum(rows[x].n_children == 0 for x in [r.preorder, *inside])


def test_empty_and_without_turns(spark):
    df = odd(spark)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    one = spark.createDataFrame([(turnless, 1, "user", "only")], df.schema)
    assert rows_of(trie.prefix_trie(one)) == plain([(turnless, 1, "user", "only")]) and trie.prefix_trie(one).count() == 1


def test_running_sums_cross_tasks(spark):
    df = spark.range(5000).selectExpr("id % 2 * (id % 7) as k", "id", "id % 5 as v")
    got = ordered.running(df, "k", ["id"], {"total": df.v}).collect()
    sums = {}
    for r in sorted(got, key=lambda r: (r.k, r.id)):
        sums[r.k] = sums.get(r.k, 0) + r.id % 5
        assert r.total == sums[r.k]
