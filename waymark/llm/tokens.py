"""Operator 2: byte-level BPE encoding and decoding, and the token ids that the packers use.

Each match of the splitting pattern is encoded apart, so the tokenizers library encodes each
distinct match of a block of texts once and the ids of the texts are gathered from those.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from waymark.llm.common import HELD, over_arrow, text_buffer
from waymark.llm.textkernel import gather

#: Encoded pieces that a Python worker remembers between blocks.
PIECES = 500_000
#: Text bytes whose ids are found at once: their pieces and ids take some 70 bytes of memory a byte meanwhile.
ENCODED_BYTES = 1 << 20
#: Pieces longer than this are never remembered.
LONGEST = 64


def _library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    import tokenizers

    return tokenizers


@lru_cache(maxsize=4)
def _tokenizer(path: str, special: bool = False):
    """The library's tokenizer; ``special`` lets a special token that a text spells out count as one."""
    tokenizer = _library().Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


#: The character that stands for each byte in the vocabulary: printable bytes stand for
#: themselves, the others, in order, for the characters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _packed(ids) -> bytes:
    return ids if isinstance(ids, bytes) else np.array(ids, np.uint32).tobytes()


class _Memory:
    """Encoded ids (as bytes) by unit; ``encode`` maps a list of new units to lists of ids.

    It holds at most ``room`` units between blocks; when full it is started afresh.
    """

    def __init__(self, encode: Callable[[list[str]], list], room: int) -> None:
        self.encode, self.known, self.room = encode, {}, room

    def look_up(self, units: list[str]) -> list[bytes]:
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            got = {u: _packed(ids) for u, ids in zip(new, self.encode(new))}
            if len(known) + len(got) > self.room:
                known.clear()
            out = [got[u] if u in got else known.get(u) for u in units]
            lost = [i for i, x in enumerate(out) if x is None]
            if lost:  # forgotten just now
                again = self.encode([units[i] for i in lost])
                for i, ids in zip(lost, again):
                    out[i] = _packed(ids)
            known.update((u, x) for u, x in got.items() if len(u) <= LONGEST)
            return out
        return [known[u] for u in units]


#: Classes of the bytes of common Latin texts (ASCII, U+00A1 to U+017F): letters, digits, other
#: marks, space, line feed, further bytes of a character. A text with any other byte is odd.
_LETTER, _DIGIT, _MARK, _BLANK, _FEED, _MORE, _ODD = range(7)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[0xC2], _CLASS[32], _CLASS[10] = _MARK, _BLANK, _FEED
_CLASS[0x80:0xC0] = _MORE
#: Two-byte characters of those that are no mark or letter as their first byte says, or that
#: change their length in lower case or NFC: no-break space, the letters and numbers among the
#: signs, the two operators among the letters, dotted capital I, n with apostrophe.
_ODD_PAIRS = {0xC2: [*range(0x80, 0xA1), 0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE], 0xC3: [0x97, 0xB7], 0xC4: [0xB0], 0xC5: [0x89]}


class ByteLevel:
    """Ids of a byte-level BPE (a tokenizers JSON file) for columns of texts.

    Texts of common Latin characters with single separators are cut where the splitting pattern
    would cut them, on the bytes of the whole block; each distinct piece, with its bytes mapped
    to the vocabulary's characters, goes through the library's model once and the ids are
    gathered by piece. All other texts go through the whole tokenizer.
    """

    SPECIAL = False

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path, self.SPECIAL)
        spelt = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if self.SPECIAL else []
        self.special = "|".join(map(re.escape, spelt))
        self.pieces = _Memory(self._encode_pieces, PIECES)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(BYTE_CHARACTERS))] if p else [] for p in pieces]

    def _odd(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Which bytes make their text odd. White space must be single and inside the text."""
        blank = (kind == _BLANK) | (kind == _FEED)
        beside = edge[:-1] | edge[1:]
        beside[1:] |= blank[:-1]
        return (kind == _ODD) | (blank & beside)

    def _cuts(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where pieces begin. A space belongs to the piece after it, a line feed stands alone."""
        cut = edge[:-1].copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
        return cut

    def _contractions(self, raw: np.ndarray, kind: np.ndarray, cut: np.ndarray, edge: np.ndarray, lower: bool) -> None:
        """Move the cuts around 's, 't, 'm, 'd, 're, 've and 'll where a piece begins with one."""
        at = np.flatnonzero((raw[:-2] == 39) & cut[:-2] & (kind[1:-1] == _LETTER) & ~edge[1:-2]) if len(raw) > 2 else np.zeros(0, np.int64)
        if not len(at):
            return
        one, two = raw[at + 1].astype(np.int64), raw[at + 2].astype(np.int64)
        two[edge[at + 2]] = 0
        if lower:
            one |= 32 * (one < 128)
            two |= 32 * ((two < 128) & (two > 64))
        long = np.isin(one * 256 + two, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
        short = np.isin(one, [ord(x) for x in "stmd"])
        at, size = np.r_[at[short], at[long]], np.r_[np.ones(short.sum(), np.int64), np.full(long.sum(), 2)]
        cut[at + 1] = edge[at + 1]
        after = at + 1 + size
        cut[after[after < len(raw)]] = True

    LOWER = False

    def _plain_ids(self, raw: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        cut = self._cuts(raw, kind, edge)
        # one padded byte lets a contraction end the block
        padded, kinds = np.r_[raw, np.zeros(2, np.uint8)], np.r_[kind, np.full(2, _BLANK, np.uint8)]
        longer = np.r_[cut, np.zeros(2, bool)]
        self._contractions(padded, kinds, longer, np.r_[edge, np.ones(2, bool)], self.LOWER)
        begin = np.flatnonzero(longer[:-2])
        spans = pa.py_buffer(np.r_[begin, len(raw)].astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(begin), spans, pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        code = coded.indices.to_numpy()
        got = self.pieces.look_up(self._trim(coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        length = size[code]
        ends = np.r_[0, np.cumsum(length)][np.searchsorted(begin, offs)]
        return gather(flat, (np.cumsum(size) - size)[code], length), ends

    def _trim(self, pieces: list[str]) -> list[str]:
        return pieces

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts end to end, and the n + 1 offsets; nulls count as empty."""
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        raw, offs = text_buffer(column)
        kind = _CLASS[raw]
        for _ in range(2):  # further bytes are of the kind of the first one
            more = np.flatnonzero(kind == _MORE)
            kind[more] = kind[more - 1]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        bad = self._odd(raw, kind, edge)
        for first, seconds in _ODD_PAIRS.items():
            at = np.flatnonzero(raw[:-1] == first)
            bad[at[np.isin(raw[at + 1], seconds)]] = True
        plain = np.ones(n, bool)
        if self.special:
            plain = ~pc.match_substring_regex(column, self.special, ignore_case=True).to_numpy(zero_copy_only=False)
        plain[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = False
        if plain.all():
            return self._plain_ids(raw, kind, offs)
        keep = np.repeat(plain, np.diff(offs))
        ids, ends = self._plain_ids(raw[keep], kind[keep], np.r_[0, np.cumsum(np.diff(offs)[plain])])
        rest = np.flatnonzero(~plain)
        # one by one: what the library makes of a text is many times its ids
        whole = {i: np.array(self.tokenizer.encode_batch_fast([column[i].as_py()], add_special_tokens=False)[0].ids, np.uint32) for i in rest.tolist()}
        spans = iter(zip(ends[:-1], ends[1:]))
        parts = [whole[i] if i in whole else ids[slice(*next(spans))] for i in range(n)]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)


class WordLevel(ByteLevel):
    """Ids of the lower-casing word BPE, which drops white space and takes digits singly.

    As in the library's own encoding, a special token that a text spells out is one id.
    """

    LOWER, SPECIAL = True, True

    def _odd(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return kind == _ODD

    def _cuts(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
        cut = edge[:-1] | (kind == _DIGIT)
        cut[1:] |= kind[1:] != kind[:-1]
        return cut

    def _trim(self, pieces: list[str]) -> list[str]:
        return [p.strip().lower() for p in pieces]


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[bytes, ...]:
    """The bytes of each id: the vocabulary's characters mapped back to bytes."""
    back = {c: b for b, c in BYTE_CHARACTERS.items()}
    tokenizer = _tokenizer(path)
    size = tokenizer.get_vocab_size(with_added_tokens=False)
    return tuple(bytes(back[c] for c in tokenizer.id_to_token(i)) for i in range(size))


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(byte_table(path).__getitem__, ids.tolist()))


def decode_pieces(ids: np.ndarray, path: str) -> list[str]:
    """The text of each id; a character split over several ids goes to the id that completes it."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    table = byte_table(path)
    pieces = [decoder.decode(table[i]) for i in ids.tolist()]
    if pieces:
        pieces[-1] += decoder.decode(b"", final=True)
    return pieces


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in byte_table(path)], np.int64)


def character_ends(ids: np.ndarray, raw: np.ndarray, path: str) -> np.ndarray:
    """For each id the number of characters of the text begun when it ends.

    An id that ends inside a character counts that character, so spans of ids that share a
    split character overlap in it.
    """
    ends = np.cumsum(byte_lengths(path)[ids])
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][ends] if len(ids) else ends


def encoder(path: str, word: bool = False) -> ByteLevel:
    """The encoder that this Python worker holds for work of kind ``ids``, with the pieces it remembers."""
    held = HELD.setdefault("ids", {})
    if (path, word) not in held:
        held[path, word] = (WordLevel if word else ByteLevel)(path)
    return held[path, word]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, ends array<int> (character_ends) of every whole text.

    Null and empty texts have empty arrays; repeated rows give repeated rows; other columns of
    ``docs`` are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offs = encoder(path).ids(batch.column("text"))
        raw, at = text_buffer(batch.column("text"))
        ends = [character_ends(ids[a:b], raw[c:d], path) for a, b, c, d in zip(offs[:-1], offs[1:], at[:-1], at[1:])]
        lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
        end_lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, end_lists], ["doc_id", "ids", "ends"])

    return over_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, ends array<int>", kind="ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids; bytes that are no UTF-8 become replacement characters."""

    def run(batches):
        for batch in batches:
            texts = [decode_bytes(np.array(x or [], np.uint32), path).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ends_sha256: encodes each whole text and decodes its ids.

    ``ends_sha256`` is the digest of character_ends() as little-endian unsigned 32-bit integers.
    Null and empty texts have no tokens and the digests of no bytes; a text of any length is one
    row; repeated rows give repeated rows; other columns of ``docs`` are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offs = encoder(path).ids(batch.column("text"))
        raw, at = text_buffer(batch.column("text"))
        ids = ids.astype("<u4")
        digests: list[list[str]] = [[], [], []]
        for a, b, c, d in zip(offs[:-1], offs[1:], at[:-1], at[1:]):
            ends = character_ends(ids[a:b], raw[c:d], path).astype("<u4")
            for held, data in zip(digests, (ids[a:b], decode_bytes(ids[a:b], path), ends)):
                held.append(hashlib.sha256(data).hexdigest())
        names = ["ids_sha256", "decoded_sha256", "ends_sha256"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), *[pa.array(x, pa.string()) for x in digests]], ["doc_id", "n_tokens", *names])

    return over_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string", kind="ids")
