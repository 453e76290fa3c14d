"""Vectorised word and shingle hashing of a block of texts (numpy over Arrow's UTF-8 buffers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from waymark.llm.common import text_buffer

_BASE = 0x9E3779B97F4A7C15 | 1
_SALTS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
_powers: dict[str, np.ndarray] = {}


def _ladder(name: str, base: int, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64."""
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if n <= 1 << 25:
            _powers[name] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], end to end."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(total)]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts: byte spans, per-text offsets and hashes."""

    def __init__(self, column: pa.Array, lower: bool) -> None:
        raw, self.texts = text_buffer(column)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        self.raw = raw
        n = len(raw)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[self.texts] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.begin = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: word number at which each text begins; one more than there are texts
        self.first = np.searchsorted(self.begin, self.texts)
        self.inside = inside
        self._sums: np.ndarray | None = None

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span."""
        n = len(self.raw)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * _ladder("up", _BASE, max(n, 1))[:n], out=self._sums[1:])
        down = _ladder("down", pow(_BASE, -1, 1 << 64), n + 1)
        return mix((self._sums[end] - self._sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.begin, self.end)


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, and the number of its first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total += words[i : i + count] * np.uint64(_SALTS[i])
    whole = np.ones(count, bool)
    for cut in first[1:-1]:  # a run must not cross into the next text
        whole[max(0, cut - size + 1) : min(cut, count)] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and the n + 1 offsets.

    A text of fewer than ``size`` words has one shingle, the whole sequence; a text without
    words has none. A-Z are lower-cased first.
    """
    words = Words(column, lower=True)
    hashes = words.hashes()
    runs, at = windows(hashes, words.first, size)
    counts = np.diff(words.first)
    bounds = np.searchsorted(at, words.first)
    sets, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts):
        if n >= size:
            got = runs[bounds[i] : bounds[i + 1]]
            got = np.sort(got)
            got = got[np.r_[True, got[1:] != got[:-1]]]
        elif n:
            one = int(n)
            for word in hashes[words.first[i] : words.first[i + 1]].tolist():
                one = (one * _SALTS[7] + word) % (1 << 64)
            got = mix(np.array([one], np.uint64))
        else:
            continue
        sets.append(got)
        sizes[i + 1] = len(got)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)
