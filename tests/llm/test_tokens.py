import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from tests.llm.common import odd_documents
from waymark.llm import tokens

PATH = P.path("byte_bpe_50k.json")


def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    parts = ["hello", " World", "'s", "'LL", "don't", "  ", "\n", "\n\n", "\t", "123", "4567.89", "é", "ß", "ÿ", "ñandú", " naïve", "…", "“q”", "日本", "😀", "<|endoftext|>", "a" * 70, "--", "...", "ª", "²", "İ", "ŉ", " ", "×", "_", "0x1F", " ' s", "'", "x'", "\r\n", "é"]
    return ["", " ", "\n", *parts] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]


def test_ids_equal_the_plain_library():
    all_texts = texts()
    ids, offs = tokens.encoder(PATH).ids(pa.array(all_texts))
    lib = library()
    for t, a, b in zip(all_texts, offs[:-1], offs[1:]):
        assert ids[a:b].tolist() == lib.encode_ordinary(t), repr(t)
        assert tokens.decode_bytes(ids[a:b], PATH) == t.encode()


def test_word_ids_equal_the_plain_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    all_texts = [*texts(), "<|endoftext|> a", "a<|startoftext|>b <|ENDOFTEXT|>", "<| endoftext |>", "x" * 50 + "<|endoftext|>" * 3]
    assert lib.encode("<|endoftext|> a", add_special_tokens=False).ids[0] == 49407
    ids, offs = tokens.encoder(path, True).ids(pa.array(all_texts))
    for t, a, b in zip(all_texts, offs[:-1], offs[1:]):
        assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_split_characters():
    text = "a😀é日"
    ids, _ = tokens.encoder(PATH).ids(pa.array([text]))
    pieces = tokens.decode_pieces(ids, PATH)
    assert "".join(pieces) == text and len(pieces) == len(ids)
    ends = tokens.character_ends(ids, np.frombuffer(text.encode(), np.uint8), PATH)
    assert ends[-1] == len(text) and (np.diff(ends) >= 0).all()


def test_round_trips(spark):
    docs = odd_documents(spark)
    lib = library()
    got = tokens.round_trips(docs, PATH).collect()
    want = {r.text or "": lib.encode_ordinary(r.text or "") for r in docs.collect()}
    chars = {t: [len(lib.decode_bytes(ids[: i + 1]).decode("utf-8", "ignore")) + (lib.decode_bytes(ids[: i + 1]).decode("utf-8", "replace")[-1:] == "\ufffd") for i in range(len(ids))] for t, ids in want.items() if len(ids) < 1000}
    ends = {hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest() for x in chars.values()}
    assert ends <= {r.ends_sha256 for r in got}
    rows = sorted((n, hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t, ids in want.items() for n in [len(ids)])
    assert sorted({(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}) == rows
    assert len(got) == docs.count() and tokens.round_trips(docs.limit(0), PATH).count() == 0


def test_encode_and_decode_give_the_texts_back(spark):
    docs = odd_documents(spark).where("doc_id < 3 or doc_id > 4")
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
