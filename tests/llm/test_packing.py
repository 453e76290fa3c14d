import random
import zlib

import numpy as np
import public_tokenizers as P

from tests.llm.common import odd_documents
from waymark.llm import packing

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def counts(seed, capacity=64):
    rng = random.Random(seed)
    return {n: rng.randint(1, 60) for n in rng.sample(range(1, capacity + 1), rng.randint(1, 30))}


def used(plan):
    out = {}
    for pattern, copies in plan:
        for n, k in pattern:
            out[n] = out.get(n, 0) + k * copies
    return out


def test_plans_hold_every_piece_and_fit():
    for seed in range(60):
        have = counts(seed)
        for pack in (packing.min_bin_slack, packing.best_fit_decreasing):
            plan = pack(have, 64)
            assert used(plan) == have and all(sum(n * k for n, k in p) <= 64 for p, _ in plan)


def test_best_fit_equals_the_plain_algorithm():
    for seed in range(40):
        have = counts(seed)
        rooms = []
        for n in sorted((n for n, c in have.items() for _ in range(c)), reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(64 - n)
        assert sum(c for _, c in packing.best_fit_decreasing(have, 64)) == len(rooms)


def test_each_window_has_least_slack_of_all_choices():
    """Each window of the plan is as full as the best of all multisets that hold its longest piece."""
    for seed in range(40):
        rng = random.Random(seed)
        have = {n: rng.randint(1, 3) for n in rng.sample(range(3, 41), 7)}
        left = dict(have)
        for pattern, copies in packing.min_bin_slack(have, 40):
            for _ in range(copies):
                longest = max(n for n, c in left.items() if c)
                sums = {0}
                for n, c in left.items():
                    c -= n == longest
                    sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 40 - longest}
                assert pattern[0][0] == longest and sum(n * k for n, k in pattern) == longest + max(sums), (seed, pattern)
                for n, k in pattern:
                    left[n] -= k
                    assert left[n] >= 0
        assert not any(left.values())


def test_special_tokens_that_texts_spell_out(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> a", "no <|startoftext|> <|endoftext|><|endoftext|>", "<|other|>"]
    lib = Tokenizer.from_file(WORDS)
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect()
    want = [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(np.array(x, "<u4"))) for i, x in enumerate(want)}


def test_first_window_has_least_slack():
    have = {30: 1, 21: 1, 13: 3, 8: 1}
    pattern, _ = packing.min_bin_slack(have, 64)[0]
    assert sum(n * k for n, k in pattern) == 64  # 30 + 21 + 13


def test_pieces_cover_the_documents(spark):
    from tokenizers import Tokenizer

    docs = odd_documents(spark)
    got = packing.packed(docs, WORDS).collect()
    lib = Tokenizer.from_file(WORDS)
    ids = {t: [*lib.encode(t, add_special_tokens=False).ids, 1] for t in {r.text or "" for r in docs.collect()}}
    texts = sorted(len(ids[r.text or ""]) for r in docs.collect())
    assert sorted(r.doc_tokens for r in got if r.start == 0) == texts and sum(r.length for r in got) == sum(texts)
    crc = {(a, len(x[a : a + n]), zlib.crc32(np.array(x[a : a + n], "<u4"))) for x in ids.values() for a in range(0, len(x), 2048) for n in [2048]}
    assert all((r.start, r.length, r.ids_crc32) in crc for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs.limit(0), WORDS).count() == 0


def test_matrix_rows_give_the_ids_back(spark):
    from waymark.llm.tokens import decode_bytes

    docs = odd_documents(spark).where("doc_id is not null and doc_id <> 4")
    rows = packing.matrix(docs, BYTES, capacity=256).collect()
    back = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        assert r.position_resets == [*r.cu_seqlens[:-1], *([r.n_tokens] if r.n_tokens < 256 else [])]
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            back.setdefault(d, []).append((s, ids[a:b]))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for d, parts in back.items():
        ids = np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])
        assert ids[-1] == 50256 and decode_bytes(ids[:-1], BYTES).decode() == texts[d]
    assert set(back) == set(texts)


def test_written_matrices_are_read_as_arrays(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.matrix(docs, BYTES)
    packing.write_matrix(rows, str(tmp_path / "rows"))
    want = {bytes(r.ids): r.cu_seqlens for r in rows.collect()}
    n = 0
    for ids, cuts, resets in packing.id_matrices([str(f) for f in (tmp_path / "rows").glob("*.parquet")]):
        assert ids.shape[1] == 2048 and ids.dtype == np.dtype("<u2") and len(cuts) == len(resets) == len(ids)
        assert all(want[row.tobytes()] == cut for row, cut in zip(ids, cuts))
        n += len(ids)
    assert n == rows.count()
