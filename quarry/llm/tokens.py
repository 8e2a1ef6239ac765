"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

The vocabulary's pre-tokenizer splits lower-cased text into words that are
encoded independently of each other. Words are found and hashed by array
operations; a worker encodes words it has not met and looks the others up.
Texts with characters outside a range where Python's and the tokenizer's
character rules are known to agree go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import kernels as K

#: The vocabularies' files: of lower-cased words, and of bytes.
VOCABULARY, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Words a worker remembers; beyond that it forgets them all and starts anew.
REMEMBERED = 600_000

_TOP = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.full(_TOP, _OTHER, dtype=np.uint8)
for _c in range(_TOP):
    _kind = unicodedata.category(chr(_c))[0]
    _CLASS[_c] = _LETTER if _kind == "L" else _NUMBER if _kind == "N" else _OTHER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
#: Characters below _TOP whose classes and lower case are the same for both sides.
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, _TOP)] if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < _TOP) + "]*")
_VALUE = K.mix64(np.arange(1, _TOP + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
#: Endings the pre-tokenizer splits off at an apostrophe that begins a word.
_ENDINGS = re.compile("'(?:s|t|re|ve|m|ll|d)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        # The same model, for words that are already split and normalised.
        described["normalizer"] = None
        described["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(described))
        vocabulary = described["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(described["model"]["end_of_word_suffix"])]] = True
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.used = 0

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode new words; ``hashes`` are sorted and not known yet."""
        parts, lengths = [], []
        for a in range(0, len(words), 256):
            some = words[a : a + 256]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in some]
                ids, ends = np.array(sum(own, []), dtype="<u4"), np.cumsum([len(o) for o in own])
            parts.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        self._remember(np.concatenate(parts), np.concatenate(lengths), hashes)

    def _remember(self, flat: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.used += len(flat)

    def _plain(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(texts).lower() + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = _CLASS[code]
        begins = np.ones(len(code), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        if "'" in joined:
            for m in _ENDINGS.finditer(joined):
                a, b = m.span()
                if begins[a]:
                    begins[a + 1 : b] = False
                    begins[b] = True
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(code))
        word = kind[begin] != _SPACE
        return self._looked_up(joined, code, begin[word], end[word], np.cumsum([len(t) + 1 for t in texts]))

    def _looked_up(self, joined: str, code: np.ndarray, begin: np.ndarray, end: np.ndarray, lines: np.ndarray) -> list[bytes]:
        """Ids of texts that end at ``lines``, whose words lie between ``begin`` and ``end``."""
        if not len(begin):
            return [b""] * len(lines)
        power, inverse = K._power(len(code) + 1)
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[code] * power[: len(code)], out=total[1:])
        hashes = K.mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        new = self.hash[at] != distinct if len(self.hash) else np.ones(len(distinct), dtype=bool)
        if new.any():
            places = zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self._learn([joined[a:b] for a, b in places], distinct[new])
            at = np.searchsorted(self.hash, distinct)
        slot = at[which]
        length = self.length[slot]
        stop = np.cumsum(length)
        flat = self.ids[np.repeat(self.start[slot] - stop + length, length) + np.arange(int(stop[-1]))]
        bounds = np.concatenate(([0], np.concatenate(([0], stop))[np.searchsorted(begin, lines)])) * 4
        data, edges = flat.tobytes(), bounds.tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str], limit: int = 600_000) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for i, ids in zip(held, self._plain([texts[i] for i in held]), strict=True):
                    out[i] = ids
            held, size = [], 0

        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and "<|" not in text:
                held.append(i)
                size += len(text)
                if size >= limit:
                    flush()
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        flush()
        return out


class ByteEncoder(Encoder):
    """Ids of the byte-level vocabulary, whose words keep case and the blank before them."""

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(BYTES)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        # The same model, for words that are already split: a line end stands apart from what it separates.
        described["added_tokens"] = []
        described["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": "\n"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(described))
        (self.line_end,) = self.words.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        parts, lengths = [], []
        for a in range(0, len(words), 256):
            some = words[a : a + 256]
            ids = np.array(self.words.encode_batch_fast(["\n".join(some) + "\n"], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) == len(some):
                parts.append(np.delete(ids, ends))
                lengths.append(np.diff(ends, prepend=-1) - 1)
            else:  # a word of line ends is among them
                own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in some]
                parts.append(np.array(sum(own, []), dtype="<u4"))
                lengths.append(np.array([len(o) for o in own], dtype=np.int64))
        self._remember(np.concatenate(parts), np.concatenate(lengths), hashes)

    def _plain(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        if not len(code):
            return [b""] * len(texts)
        lines = np.cumsum([len(t) for t in texts])
        kind = _CLASS[code]
        first = np.zeros(len(code) + 1, dtype=bool)
        first[lines] = True
        first[0] = True
        begins = first[:-1].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # White space before a word of its own text gives up its last character: a blank to the word, others to themselves.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:-1])
        begins[last] = True
        begins[last[code[last] == 0x20] + 1] = False
        if "'" in joined:
            for m in _ENDINGS.finditer(joined):
                a, b = m.span()
                if begins[a] and not first[a + 1 : b].any():
                    begins[a + 1 : b] = False
                    if b < len(code):
                        begins[b] = True
        begin = np.flatnonzero(begins)
        return self._looked_up(joined, code, begin, np.append(begin[1:], len(code)), lines)


_encoders: dict[tuple[type, str | None], Encoder] = {}


def encoder(path: str | None = None, kind: type[Encoder] = Encoder) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
