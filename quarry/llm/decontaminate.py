"""Benchmark decontamination by suffix arrays over the training documents.

Every Arrow batch of documents is one shard. A shard sorts the suffixes of its
word sequence (only those that begin like some test window: no other suffix
can answer a search) and every test suffix that begins like one of them is
binary-searched in it: the others can't be there. A range
of the suffix array holds all places of a window; consecutive hits of one test
text join into the longest verbatim matches with their locations.

The test side is the only thing sent to the executors. Its size is counted
first: up to ``block_words`` words go as one block, a larger test set is
processed block by block over the documents with results written in between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm import kernels as K
from quarry.llm.common import cut, fresh

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Bits of a word and words of a key: for most vocabularies, and for those of very long texts.
_FORMS = ((21, 3), (31, 2))

RESULT = (
    "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>,"
    "match_words:bigint,match_start:bigint,match_item:string,match_item_start:bigint>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pack(words: np.ndarray, at: np.ndarray, depth: int, form: tuple[int, int], size: np.ndarray | None = None, fill: int = 0) -> list[np.ndarray]:
    """The ``depth`` words from each place as 64-bit keys, first words most significant.

    Words beyond ``size`` are replaced by ``fill``: 0 and the largest value
    give the lower and upper ends of a range of suffixes.
    """
    keys = []
    bits, per_key = form
    for first in range(0, depth, per_key):
        key = np.zeros(len(at), dtype=np.uint64)
        for j in range(first, first + per_key):
            w = words[at + j] if j < depth else np.zeros(len(at), dtype=np.uint64)
            if size is not None:
                w = np.where(j < size, w, np.uint64(fill if j < depth else 0))
            key = (key << np.uint64(bits)) | w.astype(np.uint64)
        keys.append(key)
    return keys


def _bound(table: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of many keys at once: first place >= (or, with ``after``, >) each."""
    n = len(table[0])
    lo, hi = np.zeros(len(want[0]), dtype=np.int64), np.full(len(want[0]), n, dtype=np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        open_ = lo < hi
        if not open_.any():
            break
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
        for t, w in zip(table, want, strict=True):
            v = t[mid]
            less |= same & (v < w)
            same &= v == w
        right = (less | same if after else less) & open_
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


class TestTexts:
    """Word ids, windows and owners of one block of test texts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = K.Words([t for _, t in items], K.ALNUM)
        self.vocabulary = np.unique(words.hashes)
        self.form = next(f for f in _FORMS if len(self.vocabulary) < (1 << f[0]) - 1)
        self.names = [n for n, _ in items]
        self.window = window
        ids = np.concatenate((np.searchsorted(self.vocabulary, words.hashes).astype(np.uint64) + np.uint64(1), np.zeros(window, dtype=np.uint64)))
        place, size, owner, inner = [], [], [], []
        for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
            if b > a:
                w = min(window, b - a)
                n = b - a - w + 1
                place.append(np.arange(a, a + n))
                size.append(np.full(n, w))
                owner.append(np.full(n, i))
                inner.append(np.arange(n))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        place, size, owner, inner = join(place), join(size), join(owner), join(inner)
        self.windows = len(place)
        self.lead = int(min(2, size.min())) if len(size) else 1
        first, second = ids[place], ids[place + 1] if self.lead == 2 else np.uint64(0)
        head = (first << np.uint64(32)) | second if len(place) else np.zeros(0, dtype=np.uint64)
        # Windows are kept by how they begin: those of head h are windows edge[h] to edge[h + 1].
        order = np.argsort(head, kind="stable")
        self.heads, self.edge = np.unique(head[order], return_index=True)
        self.edge = np.append(self.edge, len(order))
        place = place[order]
        self.size, self.owner, self.inner = (x[order].astype(np.int32) for x in (size, owner, inner))
        self.low = _pack(ids, place, window, self.form, self.size, 0)
        # Only windows shorter than the rest end a range elsewhere than at themselves.
        self.short = np.flatnonzero(self.size < window)
        self.short_high = _pack(ids, place[self.short], window, self.form, self.size[self.short], (1 << self.form[0]) - 1)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and the places of all windows: text, word within the text, window number."""
        words = K.Words(texts, K.ALNUM)
        counts = words.counts()
        none = np.zeros(0, dtype=np.int64)
        if not self.windows or not len(words.hashes):
            return counts, none, none, none
        slot = np.searchsorted(self.vocabulary, words.hashes)
        slot[slot == len(self.vocabulary)] = 0
        known = np.where(self.vocabulary[slot] == words.hashes, slot + 1, 0).astype(np.uint64)
        text = np.repeat(np.arange(len(texts)), counts)
        # A zero after each text keeps matches within it.
        at = np.arange(len(known)) + text
        sequence = np.zeros(len(known) + len(texts) + self.window + self.form[1], dtype=np.uint64)
        sequence[at] = known
        follow = sequence[at + 1] if self.lead == 2 else np.uint64(0)
        head = (known << np.uint64(32)) | follow
        place = np.searchsorted(self.heads, head)
        place[place == len(self.heads)] = 0
        suffix = np.flatnonzero((self.heads[place] == head) & (known > 0))
        if not len(suffix):
            return counts, none, none, none
        keys = _pack(sequence, at[suffix], self.window, self.form)
        order = np.lexsort(keys[::-1])
        array, keys = suffix[order], [k[order] for k in keys]
        begun = np.unique(place[suffix])
        many = self.edge[begun + 1] - self.edge[begun]
        asked = np.arange(int(many.sum())) + np.repeat(self.edge[begun] - (np.cumsum(many) - many), many)
        low = [k[asked] for k in self.low]
        high = [k.copy() for k in low]
        slot = np.searchsorted(self.short, asked)
        short = np.flatnonzero((slot < len(self.short)) & (self.short[np.minimum(slot, len(self.short) - 1)] == asked)) if len(self.short) else none
        for k, other in zip(high, self.short_high, strict=True):
            k[short] = other[slot[short]]
        lo, hi = _bound(keys, low, False), _bound(keys, high, True)
        found = hi - lo
        own = np.repeat(np.arange(len(lo)), found)
        shift = np.arange(len(own)) - np.repeat(np.cumsum(found) - found, found)
        hit = array[lo[own] + shift]
        return counts, text[hit], hit - words.bounds[text[hit]], asked[own]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(texts: list[bytes], index: TestTexts) -> list[tuple]:
    counts, doc, word, which = index.search(texts)
    rows: list[tuple] = [(int(n), [], [], 0, None, None, None) for n in counts]
    if not len(doc):
        return rows
    size, owner, inner = index.size[which], index.owner[which], index.inner[which]
    # Hits of one text and item on one diagonal that follow each other are one longer match.
    order = np.lexsort((word, word - inner, owner, doc))
    d, w, o, g, s = doc[order], word[order], owner[order], (word - inner)[order], size[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (w[1:] != w[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    matches = zip(d[first].tolist(), w[first].tolist(), (w[last] + s[last]).tolist(), o[first].tolist(), (w[first] - g[first]).tolist(), strict=True)
    per: dict[int, list] = {}
    for text, start, stop, item, item_start in matches:
        per.setdefault(text, []).append((start, stop, index.names[item], item_start))
    for text, own in per.items():
        best = min(own, key=lambda m: (m[0] - m[1], m[0], m[2], m[3]))
        rows[text] = (int(counts[text]), _union([(m[0], m[1]) for m in own]), sorted({m[2] for m in own}), best[1] - best[0], best[0], best[2], best[3])
    return rows


def _merged(a: tuple, b: dict | None) -> tuple:
    """Results of one text from two blocks of test texts."""
    if b is None:
        return a
    other = (b["match_words"], b["match_start"], b["match_item"], b["match_item_start"])
    best = min((x for x in (a[3:], other) if x[0]), key=lambda m: (-m[0], m[1], m[2], m[3]), default=a[3:])
    return (a[0], _union(a[1] + [(s["start"], s["stop"]) for s in b["spans"]]), sorted({*a[2], *b["items"]}), *best)


def _column(index: TestTexts):
    @arrow_udf(RESULT)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        K.trim()
        values = [v or b"" for v in text.cast(pa.binary()).to_pylist()]
        rows: list[tuple] = []
        for a, b in K.text_slices(values):
            rows += _scan(values[a:b], index)
        if before.null_count < len(before):
            rows = [_merged(r, p) for r, p in zip(rows, before.to_pylist(), strict=True)]
        n, spans, items, length, start, item, item_start = zip(*rows, strict=True) if rows else [()] * 7
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(length, pa.int64()), pa.array(start, pa.int64()), pa.array(item, pa.string()), pa.array(item_start, pa.int64())],
            names=["n_words", "spans", "items", "match_words", "match_start", "match_item", "match_item_start"],
        )

    return scan


def with_matches(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``into`` holding all verbatim matches with the benchmark.

    Fields: ``n_words``; ``spans``, the merged word ranges inside any
    occurrence of a window; ``items``, ids of the items with occurring windows;
    and the longest match: its words, its first word in the document, the item
    and the first word there (ties: earliest place, then smallest item id as
    text).

    Edge cases: null and empty texts have no words and no hits. Items with a
    null id or without words are ignored. Items that repeat an id are one item;
    equal texts under two ids are two items. An empty benchmark leaves every
    document without hits. Words are compared by 64-bit hash, ten in a row.
    """
    known = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // (2 * block_words)) + 1
    out = docs.withColumn(into, F.lit(None).cast(RESULT))
    for b in range(blocks):
        # A block's share of the characters is bounded, so is what goes to the executors.
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        index = TestTexts(sorted((r["id"], r["text"].encode()) for r in rows), window)
        out = out.withColumn(into, _column(index)(F.col(text), F.col(into)))
        if b + 1 < blocks:
            out = cut(out, "decontaminate")
    return out


def n_hit(result: str):
    """Words of the document inside any occurrence of a window."""
    return F.aggregate(F.col(result)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that share no window with the benchmark."""
    into = fresh(docs, "matches")
    return with_matches(docs, benchmark, into, text, window).where(F.size(F.col(into)["items"]) == 0).drop(into)
