"""Vectorised text kernels shared by the Arrow-batched operators.

Everything here works on UTF-8 bytes: both word definitions used by the
operators only separate on ASCII bytes, and every byte of a multi-byte UTF-8
character is >= 0x80, so byte classes and character classes agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


class WordRule:
    """Which bytes belong to words; A-Z count and hash as a-z."""

    def __init__(self, is_word: Iterable[int]):
        self.mask = np.zeros(256, dtype=bool)
        self.mask[list(is_word)] = True
        folded = np.arange(256)
        folded[65:91] += 32
        self.value = np.where(self.mask, _BYTE[folded], _U(0))


#: Words are runs of anything but ASCII white space.
SPACED = WordRule(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = WordRule(b for b in range(256) if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128)

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for slot, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers[slot] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


#: Bytes that are hashed at once, as each takes tens of bytes meanwhile.
SEGMENT = 2_000_000


def _segments(data: bytes, rule: WordRule) -> Iterator[np.ndarray]:
    """Parts of ``data`` of about SEGMENT bytes, none ending within a word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        while end < len(raw) and rule.mask[raw[end - 1]]:
            gap = np.flatnonzero(~rule.mask[raw[end : end + 65536]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + 65536, len(raw))
        yield raw[at:end]
        at = end


def _hashed(joined: np.ndarray, rule: WordRule, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of their beginnings, row by row; and where words start."""
    inside = rule.mask[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.append(edge, len(inside))
    start, stop = edge[0::2], edge[1::2]
    power, inverse = _power(len(joined) + 1)
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(rule.value[joined] * power[: len(joined)], out=total[1:])
    raw = (total[stop] - total[start]) * inverse[start]
    rows = [mix64(raw + (stop - start).astype(np.uint64) * _U(0xA0761D6478BD642F))]
    # The first bytes of each word, hashed apart from whole words.
    for p in prefixes:
        cut = np.minimum(start + p, stop)
        rows.append(mix64((total[cut] - total[start]) * inverse[start] + _U((0x8EBC6AF09C88C6E3 * p) % (1 << 64))))
    return np.stack(rows), start


class Words:
    """Words of a batch of texts: 64-bit hashes in order, and where each text's words lie.

    ``hashes[bounds[i]:bounds[i + 1]]`` are the words of text ``i``.
    """

    def __init__(self, texts: list[bytes], rule: WordRule, prefixes: tuple[int, ...] = ()):
        hashes, starts, begins = [np.zeros((1 + len(prefixes), 0), dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        for part in _segments(b" ".join(texts) + b" ", rule):
            found, start = _hashed(part, rule, prefixes)
            hashes.append(found)
            starts.append(start + begins)
            begins += len(part)
        self.hashes, *self.prefixes = np.concatenate(hashes, axis=1)
        self.bounds = np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends))).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, position by position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 0x9FB21C651E98DF25
    for j in range(size):
        out += hashes[j : j + n] * _U(factor)
        factor = (factor * _BASE + 2) & ((1 << 64) - 1) | 1
    return mix64(out)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct ``size``-word shingle hashes per text.

    A text with fewer words is one shingle, its whole word sequence; a text
    without words has none.
    """
    words = Words(texts, SPACED)
    runs = window_hashes(words.hashes, size)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(window_hashes(words.hashes[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(values: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay near ``limit``; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(v) + 1
    if begin < len(values):
        yield begin, len(values)
