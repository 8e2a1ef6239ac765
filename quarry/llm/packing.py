"""Packing of tokenised documents into sequences of bounded length.

Documents become pieces (only those longer than a sequence are cut), pieces
are dealt evenly into groups of bounded size, and each group is packed on its
own: best fit decreasing gives a start, then swap-based local search works on
the bins that are not full. It moves documents, exchanges one for one and two
for one between them, always increasing the sum of squared fills, so that the
emptiest bins drain until they are gone. Bins that stay underfull in their
group meet those of other groups in a next round, until one group holds them
or a round that fills few of them saves no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import cut, fresh
from quarry.llm.tokens import encoder

CAPACITY = 2048
#: Pieces of one group.
GROUP = 20_000
#: A bin with more free places goes to the next round.
SLACK = 0.03
#: Bins that local search exchanges among at once; windows of them pass over all underfull bins.
WINDOW = 256
#: End of a document.
END = 0


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of all documents.

    A null text counts as empty. Every document has at least one id, its end;
    rows are taken as they are, repeated or null ids included.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            K.trim()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, number, start, length, ids = [], [], [], [], []
            for i, own in enumerate(coder.encode(texts)):
                own += end
                for k, a in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[a : a + 4 * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col(id_column).cast("bigint"), F.col(text)).mapInArrow(encode, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class _Room:
    """Bins by free places, with the smallest sufficient space found by one bit operation."""

    def __init__(self, capacity: int):
        self.of: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, b: int, free: int) -> None:
        self.of[free].add(b)
        self.mask |= 1 << free

    def remove(self, b: int, free: int) -> None:
        self.of[free].discard(b)
        if not self.of[free]:
            self.mask &= ~(1 << free)

    def tightest(self, size: int) -> int:
        """Smallest free space >= size that some bin has, or -1."""
        rest = self.mask >> size
        return size + (rest & -rest).bit_length() - 1 if rest else -1


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length: best fit decreasing, then swap-based local search."""
    size = lengths.tolist()
    room, bins, fill = _Room(capacity), [], []
    place = [0] * len(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        free = room.tightest(size[i])
        if free < 0:
            b, free = len(bins), capacity
            bins.append([])
            fill.append(0)
        else:
            b = min(room.of[free])
            room.remove(b, free)
        bins[b].append(i)
        fill[b] += size[i]
        place[i] = b
        room.add(b, free - size[i])
    _search(size, bins, fill, place, room, capacity)
    _, dense = np.unique(np.array(place, dtype=np.int64), return_inverse=True)
    return dense


def _search(size: list[int], bins: list[list[int]], fill: list[int], place: list[int], room: _Room, capacity: int) -> None:
    """Drain the emptiest bins into other underfull ones; every step raises the sum of squared fills."""

    def apply(moves: list[tuple[int, int]]) -> None:
        """Move documents to bins, all at once."""
        touched = {place[i] for i, _ in moves} | {to for _, to in moves}
        for b in touched:
            room.remove(b, capacity - fill[b])
        for i, to in moves:
            bins[place[i]].remove(i)
            fill[place[i]] -= size[i]
            bins[to].append(i)
            fill[to] += size[i]
            place[i] = to
        for b in touched:
            room.add(b, capacity - fill[b])

    def others(x: int) -> list[int]:
        """Underfull bins fuller than x, fullest first: gains are largest there."""
        return sorted((b for b in under if b != x and fill[b] < capacity and fill[b] >= fill[x] and bins[b]), key=lambda b: -fill[b])

    def drain() -> bool:
        """Whether any step was found."""
        gained = False
        for x in list(under):
            moved = True
            while bins[x] and moved:
                moved = False
                for i in sorted(bins[x], key=lambda i: -size[i]):
                    # Move into the tightest place elsewhere.
                    room.remove(x, capacity - fill[x])
                    free = room.tightest(size[i])
                    room.add(x, capacity - fill[x])
                    if free >= 0 and (capacity - free) + size[i] > fill[x]:
                        gained = True
                        apply([(i, min(b for b in room.of[free] if b != x))])
                        moved = True
                        break
                    # Exchange for one or two smaller ones that leave less free space there.
                    for b in others(x):
                        gap = capacity - fill[b]
                        own = sorted(bins[b], key=lambda j: size[j])
                        swap: list[int] = []
                        best = 0
                        for j in own:
                            gain = size[i] - size[j]
                            if best < gain <= gap:
                                best, swap = gain, [j]
                        lo, hi = 0, len(own) - 1
                        while lo < hi:
                            gain = size[i] - size[own[lo]] - size[own[hi]]
                            if gain > gap:
                                lo += 1
                            else:
                                if gain > best:
                                    best, swap = gain, [own[lo], own[hi]]
                                hi -= 1
                        if swap and best > 0:
                            gained = True
                            apply([(i, b), *((j, x) for j in swap)])
                            moved = True
                            break
                    if moved:
                        break
        return gained

    under: list[int] = []
    least = -(-sum(size) // capacity)
    gained = True
    while gained:
        gained = False
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        # Windows overlap by half, so that bins on both sides of a border meet.
        for a in range(0, max(len(open_bins) - WINDOW // 2, 1), WINDOW // 2):
            if sum(map(bool, bins)) == least:
                return
            under = open_bins[a : a + WINDOW]
            gained |= drain()


def _packed(rows: DataFrame, groups: int, level: int, capacity: int, dealt_to: str, filled: str) -> DataFrame:
    schema = rows.schema
    names = rows.columns

    def pack(group: pa.Table) -> pa.Table:
        own = group.column(dealt_to)[0].as_py()
        length = group.column("length").to_numpy()
        bins = pack_lengths(length, capacity)
        order = np.argsort(bins, kind="stable")
        group = group.take(pa.array(order))
        bins, length = bins[order], length[order]
        stop = np.cumsum(length)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        count = np.diff(np.append(first, len(bins)))
        offset = stop - length - np.repeat((stop - length)[first], count)
        fill = np.repeat(np.add.reduceat(length, first), count)
        return group.select(names).append_column("sequence_id", pa.array((level << 48) + (own << 18) + bins)).append_column("offset", pa.array(offset)).append_column(filled, pa.array(fill))

    dealt = rows.withColumn(dealt_to, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return dealt.groupBy(dealt_to).applyInArrow(pack, f"{out}, sequence_id bigint, offset bigint, `{filled}` bigint")


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``rows`` (with ``length``, 1 to ``capacity``) with sequence_id and offset.

    Lengths of a sequence add up to at most ``capacity``; offsets are gapless
    from 0. Sequence ids are arbitrary. Columns of these names that ``rows``
    have already are replaced. Rows are packed as they come, repeated
    ones too; no rows give no sequences. The rows should not be large: token
    ids stay behind and are joined by document and piece when sequences are
    written.
    """
    if group > 1 << 18:
        raise ValueError("a group has at most 2^18 pieces")
    rows = rows.drop("sequence_id", "offset")
    dealt_to, filled = fresh(rows, "group"), fresh(rows, "fill")
    rest, level, done = cut(rows, "pieces"), 0, []
    kept, was = None, 0
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        # Written, as rows come to a group in the order of the shuffle: all that read the result see one packing.
        packed = cut(_packed(rest, groups, level, capacity, dealt_to, filled), "packed")
        if groups == 1:
            done.append(packed.drop(filled))
            break
        made = packed.select("sequence_id").distinct().count()
        if kept is not None and made >= was and few_filled:
            # Dealing anew saves nothing: those pieces keep the bins they have.
            done.append(kept)
            break
        low = F.col(filled) < int(capacity * (1 - SLACK))
        done.append(packed.where(~low).drop(filled))
        kept = packed.where(low).drop(filled)
        left = kept.drop("sequence_id", "offset")
        few_filled, was = left.count() > 0.9 * n, kept.select("sequence_id").distinct().count()
        level += 1
        rest = cut(left, "pieces")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
