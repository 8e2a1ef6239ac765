"""Interaction of filters by packed bitmaps.

Every part of a table (a value of a column) gets bitmaps over its documents in
a partition: one for each filter, set where the document fails it, and one for
each label. They are 64-bit words of NumPy, a bit a document. For each set of
filters that may have run before, AND-NOT leaves the documents still there,
AND with a filter's bitmap those it removes, and a popcount their number. The
counts of all partitions are summed; orders of filters are sums over sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import cut, few

#: The filters, in order of their bits.
FILTERS = "ABCDE"
#: Bitmaps of the index: filters, then labels.
BITMAPS = (*FILTERS, "good", "toxic")
#: Documents of a partition that share bitmaps.
BLOCK = 1 << 16
#: Rows of a join's right side that may be sent to all executors.
BROADCAST_ROWS = 200_000
#: A key with more than one in so many rows is joined apart; at most as many keys are.
HOT = 1000
_SPECIAL = np.isin(np.arange(256), list(b"#$%&*|"))


class _Cased(K.WordRule):
    """Words of anything but ASCII white space, case counts."""

    def __init__(self) -> None:
        super().__init__(np.flatnonzero(K.SPACED.mask).tolist())
        self.value = np.where(self.mask, K._BYTE, np.uint64(0))


CASED = _Cased()


def failures(texts: list[bytes]) -> np.ndarray:
    """For each text the filters A to D that it fails, as bits 0 to 3."""
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b in K.text_slices(texts):
        words = K.Words(texts[a:b], CASED)
        count = words.counts()
        edge = words.bounds.tolist()
        distinct = np.array([len(np.unique(words.hashes[x:y])) for x, y in zip(edge[:-1], edge[1:], strict=True)], dtype=np.int64)
        upper, points, special = (np.zeros(b - a, dtype=np.int64) for _ in range(3))
        for i, text in enumerate(texts[a:b]):
            raw = np.frombuffer(text, dtype=np.uint8)
            kinds = np.bincount(raw, minlength=256)
            upper[i], points[i], special[i] = kinds[65:91].sum(), len(raw) - kinds[128:192].sum(), kinds[_SPECIAL].sum()
        bits = (count < 100, 100 * distinct < 80 * count, 100 * upper > 10 * points, special > 0)
        out[a:b] = sum(bit.astype(np.int64) << k for k, bit in enumerate(bits))
    return out


def judged(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, bits of filters A to D, and a digest of the text, of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            digest = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failures(texts)), pa.array(digest, pa.binary())], names=["doc_id", "part", "bits", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id bigint, part string, bits bigint, digest binary")


def joined(left: DataFrame, right: DataFrame, key: str, values: list[str], broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """``left`` with the ``values`` of ``right``, which has at most one row a key; null where it has none.

    A small ``right`` is broadcast, its rows being counted first. Otherwise
    keys with many rows, of which there are at most ``hot``, meet a broadcast
    of their few rows, and only the others are shuffled; null keys meet nothing.
    """
    if few(right, broadcast_rows):
        return left.join(F.broadcast(right), key, "left")
    total = left.count()
    often = cut(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * hot > total).select(key), "often")
    near = right.join(F.broadcast(often), key, "left_semi")
    nothing = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    known = left.where(F.col(key).isNotNull())
    with_often = known.join(F.broadcast(often), key, "left_semi").join(F.broadcast(near), key, "left")
    return with_often.unionByName(known.join(F.broadcast(often), key, "left_anti").join(right, key, "left")).unionByName(nothing)


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang", broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """part and the bits of BITMAPS of every row of ``docs``.

    E holds for rows whose text some smaller doc_id has; rows with a null id
    never fail it and never make others fail. A document with several labels
    has each kind that any of them gives it.
    """
    rows = cut(judged(docs, part), "judged")
    firsts = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "firsts")
    bits = F.col("bits") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    rows = joined(rows, firsts, "digest", ["first"], broadcast_rows, hot).select("doc_id", "part", bits.alias("bits"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    told = cut(told.where("quality + toxic > 0"), "told")
    labelled = F.coalesce(F.col("quality"), F.lit(0)) * 32 + F.coalesce(F.col("toxic"), F.lit(0)) * 64
    return joined(rows, told, "doc_id", ["quality", "toxic"], broadcast_rows, hot).select("part", (F.col("bits") + labelled).cast("bigint").alias("bits"))


def bitmap_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """part, n and one binary column for each of BITMAPS: 64-bit words over a part's documents in a block of a partition."""

    def packed(part: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        names, which = np.unique(part, return_inverse=True)
        order = np.argsort(which, kind="stable")
        edge = np.searchsorted(which[order], np.arange(len(names) + 1)).tolist()
        own = bits[order]
        columns: list[list[bytes]] = [[] for _ in BITMAPS]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            held = np.zeros(-(-(b - a) // 64) * 64, dtype=np.int64)
            held[: b - a] = own[a:b]
            for k, column in enumerate(columns):
                column.append(np.packbits((held >> k & 1).astype(bool), bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.diff(edge), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "n", *BITMAPS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in batches:
            parts.append(np.array(batch.column("part").to_pylist(), dtype=object))
            held.append(batch.column("bits").to_numpy())
            if sum(map(len, held)) >= block:
                yield packed(np.concatenate(parts), np.concatenate(held))
                parts, held = [], []
        if sum(map(len, held)):
            yield packed(np.concatenate(parts), np.concatenate(held))

    return rows.mapInArrow(pack, "part string, n bigint, " + ", ".join(f"`{c}` binary" for c in BITMAPS))


def prefix_counts(index: DataFrame) -> DataFrame:
    """part, before (bits of the filters that ran), filter, and what the filter then does: kept, removed, good_lost, toxic_lost."""
    rows = [(before, k) for before in range(1 << len(FILTERS)) for k in range(len(FILTERS)) if not before >> k & 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            words = -(-n // 64)
            starts = np.cumsum(words) - words
            *fails, good, toxic = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8") for c in BITMAPS)
            there = np.full(len(good), ~np.uint64(0), dtype=np.uint64)
            last = starts + words - 1
            rest = (n % 64).astype(np.uint64)
            there[last[rest > 0]] = (np.uint64(1) << rest[rest > 0]) - np.uint64(1)
            popcount = lambda x: np.add.reduceat(np.bitwise_count(x).astype(np.int64), starts)
            left = {0: there}
            for before in range(1, 1 << len(FILTERS)):
                low = before & -before
                left[before] = left[before ^ low] & ~fails[low.bit_length() - 1]
            kept = {before: popcount(x) for before, x in left.items()}
            part = batch.column("part")
            for before, k in rows:
                gone = left[before] & fails[k]
                counts = kept[before | 1 << k], popcount(gone), popcount(gone & good), popcount(gone & toxic)
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(n), before, dtype=np.int32)), pa.array([FILTERS[k]] * len(n)), *map(pa.array, counts)], names=["part", "before", "filter", "kept", "removed", "good_lost", "toxic_lost"])

    found = index.mapInArrow(count, "part string, before int, filter string, kept bigint, removed bigint, good_lost bigint, toxic_lost bigint")
    return found.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")])


def order_steps() -> list[tuple[str, int, int, str]]:
    """filter_order, step, before and filter of every step of every order."""
    return [("".join(p), i + 1, sum(1 << FILTERS.index(f) for f in p[:i]), p[i]) for p in permutations(FILTERS) for i in range(len(FILTERS))]


def interaction_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """What each filter of each order removes, keeps, repeats and costs, by part.

    Null texts are empty (they fail A only, E too if repeated), a null part is
    the empty string, repeated rows count as often as they come, an empty
    table has no parts and no rows, labels of unknown documents count nowhere.
    Columns of other names are ignored.
    """
    counts = prefix_counts(bitmap_index(flagged(docs, labels, part, broadcast_rows, hot), block))
    own = Window.partitionBy("part", "filter")
    size, last = len(FILTERS), (1 << len(FILTERS)) - 1
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), F.bit_count("before") + 1)
    others = F.lit(last) - F.element_at(F.array(*[F.lit(1 << k) for k in range(size)]), F.instr(F.lit(FILTERS), F.col("filter")))
    facts = counts.select(
        "*",
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own).alias("failing"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.col("removed") * orders).over(own).cast("bigint").alias("shapley"),
    )
    steps = docs.sparkSession.createDataFrame(order_steps(), "filter_order string, step int, before int, filter string")
    return facts.join(F.broadcast(steps), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
