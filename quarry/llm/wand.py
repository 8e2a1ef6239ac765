"""Ranked lexical search by Block-Max WAND.

The index is cut by documents: a shard holds some megabytes of texts, its
terms, and for each term its postings in blocks of 128: a block's first and
last document, its largest impact, and document gaps and term frequencies in
one, two or four bytes each. A search walks all query terms' pointers over
block bounds only. Between two bounds the same blocks lie under the pointers;
where their weighted largest impacts don't add up to the threshold (the k-th
best score so far) no document can enter the result, and the pointers pass
without decompressing anything. Blocks under the other ranges are decompressed
and scored exactly. Ranges with the largest bounds come first, as they raise
the threshold; a task carries it from shard to shard.

Bounds and pointers are moved by array operations over all blocks of a query
in a shard at once. All scores are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import cut, small_batches

#: Postings of a block.
BLOCK = 128
#: Bytes of text after which a shard is closed; a longer text is a shard of its own.
SHARD = 8 << 20
#: Distinct terms of queries that are searched together; a longer query comes alone.
QUERY_TERMS = 1 << 18
#: Queries that are searched together.
QUERIES = 4096
#: Runs that a query's best are merged in before they meet in one task.
RUNS = 64

#: Columns of the index besides shard facts: NumPy type of each.
ARRAYS = {"terms": "<u8", "df": "<i4", "first": "<i4", "last": "<i4", "count": "u1", "widths": "u1", "impact": "<i4", "gaps": "u1", "tfs": "u1", "norm": "<i8"}
INDEX = "docs array<bigint>, " + ", ".join(f"{c} binary" for c in ARRAYS)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int


def corpus(docs: DataFrame) -> Corpus:
    """Counts where words begin; words are neither hashed nor kept."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in K.text_slices(texts):
                inside = K.ALNUM.mask[np.frombuffer(b" ".join([b"", *texts[a:b]]), dtype=np.uint8)]
                begins = np.flatnonzero(inside[1:] & ~inside[:-1])
                ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[a:b]), dtype=np.int64, count=b - a))
                each = np.diff(np.searchsorted(begins, ends), prepend=0)
                documents += int((each > 0).sum())
                terms += len(begins)
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["d", "t"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "d bigint, t bigint")
    row = found.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    return Corpus(row["d"], row["t"])


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` numbers, then start[1] and so on."""
    stop = np.cumsum(length)
    return np.repeat(start - stop + length, length) + np.arange(int(stop[-1]) if len(stop) else 0)


def _narrow(largest: np.ndarray) -> np.ndarray:
    """Bytes a number takes: 1, 2 or 4."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.int64)


def _pack(values: np.ndarray, block: np.ndarray, place: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
    """``values`` of blocks, each value in its block's width, as bytes."""
    size = count * width
    offset = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in (1, 2, 4):
        some = np.flatnonzero(width[block] == w)
        if len(some):
            at = offset[block[some]] + place[some] * w
            out[(at[:, None] + np.arange(w)).ravel()] = values[some].astype(f"<u{w}").view(np.uint8)
    return out


def _unpack(data: np.ndarray, offset: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The values of the given blocks, one after the other."""
    stop = np.cumsum(count)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.int64)
    for w in (1, 2, 4):
        some = np.flatnonzero(width == w)
        if len(some):
            at = _ragged(offset[some], count[some] * w)
            out[_ragged((stop - count)[some], count[some])] = data[at].view(f"<u{w}")
    return out


def shard_of(ids: list[int | None], texts: list[bytes], all_: Corpus) -> dict[str, object]:
    """One shard of the index as a row."""
    words = K.Words(texts, K.ALNUM)
    length = words.counts()
    terms, which = np.unique(words.hashes, return_inverse=True)
    n = max(len(texts), 1)
    pair, tf = np.unique(which * n + np.repeat(np.arange(len(texts)), length), return_counts=True)
    term, doc = np.divmod(pair, n)
    # Python's numbers, as 75 * n * N may pass 64 bits before it is divided.
    norm = np.array([100 - 75 + 75 * x * all_.documents // all_.terms if all_.terms else 0 for x in length.tolist()], dtype=np.int64)
    df = np.bincount(term, minlength=len(terms))
    start = np.cumsum(df) - df
    within = np.arange(len(pair)) - start[term]
    place = within % BLOCK
    begin = np.flatnonzero(place == 0)
    count = np.diff(np.append(begin, len(pair)))
    block = np.repeat(np.arange(len(begin)), count)
    if len(begin):
        gap = np.where(place > 0, np.diff(doc, prepend=0), 0)
        gap_width, tf_width = _narrow(np.maximum.reduceat(gap, begin)), _narrow(np.maximum.reduceat(tf - 1, begin))
        largest = np.maximum.reduceat(impact(tf, norm[doc]), begin)
    else:
        gap, gap_width, tf_width, largest = (np.zeros(0, dtype=np.int64) for _ in range(4))
    arrays = {
        "terms": terms,
        "df": df,
        "first": doc[begin],
        "last": doc[begin + count - 1],
        "count": count - 1,
        "widths": gap_width | tf_width << 4,
        "impact": largest,
        "gaps": _pack(gap, block, place, count, gap_width),
        "tfs": _pack(tf - 1, block, place, count, tf_width),
        "norm": norm,
    }
    return {"docs": ids, **{c: arrays[c].astype(kind).tobytes() for c, kind in ARRAYS.items()}}


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def build_index(docs: DataFrame, all_: Corpus, shard: int = SHARD) -> DataFrame:
    """An index over every row of ``docs`` (doc_id, text), a row a shard; see ARRAYS."""
    small_batches(docs.sparkSession)

    def row(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        made = shard_of(ids, texts, all_)
        return pa.RecordBatch.from_arrays([pa.array([made["docs"]], pa.list_(pa.int64())), *(pa.array([made[c]], pa.binary()) for c in ARRAYS)], names=["docs", *ARRAYS])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(text or b"") > shard:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text or b"")
                size += len(text or b"") + 1
        if texts:
            yield row(ids, texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX)


@dataclass
class Query:
    """An item's terms (numbers into the terms of its batch) and how often it has each."""

    item: object
    terms: np.ndarray
    repeats: np.ndarray


class Shard:
    """A row of the index, and which of its blocks have been decompressed (for tests and measurement)."""

    def __init__(self, row: dict[str, object]):
        for c, kind in ARRAYS.items():
            setattr(self, c, np.frombuffer(row[c], dtype=kind))
        self.docs = row["docs"]
        self.blocks = -(-self.df.astype(np.int64) // BLOCK)
        self.block = np.cumsum(self.blocks) - self.blocks
        self.size = self.count.astype(np.int64) + 1
        self.gap_width, self.tf_width = self.widths.astype(np.int64) & 15, self.widths.astype(np.int64) >> 4
        self.gap_at, self.tf_at = (np.cumsum(self.size * w) - self.size * w for w in (self.gap_width, self.tf_width))
        self.decompressed = self.seen = 0

    def at(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in this shard, -1 where it lacks one."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts and number of the block, of all postings of ``blocks``."""
        self.decompressed += len(blocks)
        size = self.size[blocks]
        gap = _unpack(self.gaps, self.gap_at[blocks], size, self.gap_width[blocks])
        tf = _unpack(self.tfs, self.tf_at[blocks], size, self.tf_width[blocks]) + 1
        which = np.repeat(np.arange(len(blocks)), size)
        # A block's first gap is 0, so sums restart there.
        total = np.cumsum(gap)
        begin = np.cumsum(size) - size
        doc = total - total[begin][which] + self.first[blocks].astype(np.int64)[which]
        return doc, impact(tf, self.norm[doc]), which


class Best:
    """The k best (score, document), best first; of equal scores the smaller document, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.missing, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    @property
    def threshold(self) -> int:
        """A score below this can't enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: list[int | None]) -> None:
        missing = np.array([i is None for i in ids], dtype=bool)
        doc = np.array([i or 0 for i in ids], dtype=np.int64)
        score, missing, doc = np.append(self.score, score), np.append(self.missing, missing), np.append(self.doc, doc)
        order = np.lexsort((doc, missing, -score))[: self.k]
        self.score, self.missing, self.doc = score[order], missing[order], doc[order]


def search_shard(shard: Shard, present: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Takes a shard's best documents into ``best``.

    ``present`` are places of the query's terms in the shard, ``weight`` their
    weights times repeats.
    """
    known = (present >= 0) & (weight > 0)
    present, weight = present[known], weight[known]
    if not len(present):
        return
    each = shard.blocks[present]
    blocks, w = _ragged(shard.block[present], each), np.repeat(weight, each)
    shard.seen += len(blocks)
    first, after = shard.first[blocks].astype(np.int64), shard.last[blocks].astype(np.int64) + 1
    edge = np.unique(np.concatenate((first, after)))
    a, b = np.searchsorted(edge, first), np.searchsorted(edge, after)
    # What the blocks under each range between two edges can add up to.
    upper = w * shard.impact[blocks]
    change = np.zeros(len(edge), dtype=np.int64)
    np.add.at(change, a, upper)
    np.subtract.at(change, b, upper)
    bound = np.cumsum(change)[:-1]
    width = np.diff(edge)
    # Sums of doubles are exact up to 2^53.
    exact = int(upper.sum()) < 1 << 53
    todo = np.argsort(-bound, kind="stable")
    share = 16
    while len(todo):
        todo = todo[bound[todo] >= best.threshold]
        enough = np.searchsorted(np.cumsum(width[todo]), 2 * best.k) + 1
        some, todo = np.split(todo, [max(enough, len(bound) // share)])
        share = max(share // 2, 1)
        if not len(some):
            return
        live = np.zeros(len(edge), dtype=np.int64)
        live[some + 1] = 1
        upto = np.cumsum(live)
        needed = np.flatnonzero(upto[b] > upto[a])
        doc, points, which = shard.postings(blocks[needed])
        inside = live[np.searchsorted(edge, doc, side="right")] > 0
        doc, points = doc[inside], (points * w[needed][which])[inside]
        if exact:
            score = np.bincount(doc, weights=points, minlength=1).astype(np.int64)
        else:
            score = np.zeros(int(doc.max()) + 1 if len(doc) else 1, dtype=np.int64)
            np.add.at(score, doc, points)
        good = np.flatnonzero(score >= best.threshold)
        if len(good) > best.k:
            least = np.partition(score[good], len(good) - best.k)[len(good) - best.k]
            good = good[score[good] >= least]
        best.add(score[good], [shard.docs[i] for i in good.tolist()])


def query_batches(items: DataFrame, terms: int = QUERY_TERMS, queries: int = QUERIES) -> Iterator[tuple[list[Query], np.ndarray]]:
    """Queries in batches of bounded size with their distinct terms; items come to the driver one by one."""
    small_batches(items.sparkSession)

    def finish(held: list[tuple[object, np.ndarray]]) -> tuple[list[Query], np.ndarray]:
        table = np.unique(np.concatenate([h for _, h in held]))
        return [Query(item, np.searchsorted(table, own), repeats) for item, h in held for own, repeats in [np.unique(h, return_counts=True)]], table

    held: list[tuple[object, np.ndarray]] = []
    size = 0
    for row in items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        own = K.Words([row["text"].encode()], K.ALNUM).hashes
        if not len(own):
            continue
        if held and (size + len(own) > terms or len(held) >= queries):
            yield finish(held)
            held, size = [], 0
        held.append((row["item_id"], own))
        size += len(own)
    if held:
        yield finish(held)


def document_frequencies(index: DataFrame, table: np.ndarray) -> np.ndarray:
    """Documents with each of ``table``'s terms."""
    sent = index.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                _, mine, own = np.intersect1d(sent.value, np.frombuffer(terms, dtype=ARRAYS["terms"]), assume_unique=True, return_indices=True)
                total[mine] += np.frombuffer(df, dtype=ARRAYS["df"])[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    out = np.zeros(len(table), dtype=np.int64)
    for row in index.select("terms", "df").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[row["i"]] = row["n"]
    return out


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search_index(index: DataFrame, all_: Corpus, items: DataFrame, k: int = 10, runs: int = RUNS, terms: int = QUERY_TERMS, queries: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each row of ``items`` (item_id, text).

    Queries go over the index in batches whose terms are broadcast; their size
    is bounded by ``terms`` and ``queries``, and one batch is one job.
    """
    spark = index.sparkSession
    item = items.schema["item_id"].dataType
    shape = f"query bigint, item_id {item.simpleString()}, doc_id bigint, score bigint"
    written: list[str] = []
    for asked, table in query_batches(items, terms, queries):
        df = document_frequencies(index, table)
        weights = np.array([term_weight(all_.documents, n) for n in df.tolist()], dtype=np.int64)
        sent = spark.sparkContext.broadcast((asked, table, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, table, weights = sent.value
            best = [Best(k) for _ in asked]
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row)
                    at = shard.at(table)
                    for query, own in zip(asked, best, strict=True):
                        search_shard(shard, at[query.terms], weights[query.terms] * query.repeats, own)
            for number, (query, own) in enumerate(zip(asked, best, strict=True)):
                if len(own.score):
                    n = len(own.score)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * n, pa.int64()), pa.array([query.item] * n), pa.array(own.doc, mask=own.missing), pa.array(own.score)],
                        names=["query", "item_id", "doc_id", "score"],
                    )

        found = index.mapInArrow(run, shape).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        for keys in (("query", "run"), ("query",)):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        # Each batch is written, so its broadcast is needed no longer.
        done = cut(found.select("item_id", "rank", "doc_id", "score"), "ranked")
        sent.destroy()
        written.append(done._cut_path)
    shape = f"item_id {item.simpleString()}, rank int, doc_id bigint, score bigint"
    return spark.read.schema(shape).parquet(*written) if written else spark.createDataFrame([], shape)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, **options) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score above 0.

    A null or wordless text has no terms and is never found, a null or
    wordless item finds nothing, repeated rows of either table stand for
    themselves, equal scores come by ascending doc_id with nulls last, an empty
    table gives no rows. Columns of other names are ignored. Terms are compared
    by 64-bit hashes: with V terms in all texts and Q in the queries two differ
    but compare as equal with a probability of V * Q / 2^64.
    """
    all_ = corpus(docs)
    index = cut(build_index(docs, all_, shard), "index")
    return search_index(index, all_, items, k, **options)
