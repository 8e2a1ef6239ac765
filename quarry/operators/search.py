"""Ranked full-text search with prefixes and typo tolerance, as relations.

``postings`` has a row for each document, field and token: field 0 is the
name, 1 substances, 2 holders; ``first`` marks the name's first token.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import idf, normalize, tokens, trigrams
from quarry.sources.shared import near


@dataclass(frozen=True)
class Rank:
    """Weights and bonuses of the ranking."""

    weights: tuple[float, float, float] = (3.0, 2.0, 1.0)
    exact: float = 50.0
    prefix: float = 20.0
    head: float = 10.0
    marketed: float = 15.0
    active: float = 5.0
    substance_only: float = -5.0
    approximate: float = 0.6
    similarity: float = 0.4
    fallback_below: int = 5
    expansions: int = 512


#: Documents of a block, about.
BLOCK_DOCS = 4096


def _block(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "block"]


def block_of(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def dealt(df: DataFrame, rows: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows with an id, of ``rows`` documents, with their block: by a hash of the id. A block lies whole in one task."""
    return df.withColumn("block", block_of(F.col("id"), max(1, -(-rows // block_docs)))).repartitionByRange(max(1, -(-rows // BLOCK_DOCS)), "block")


def field_texts(df: DataFrame, columns: list[str | None]) -> DataFrame:
    """id, field, text: the fields of one table, by one scan; None stands for a field it doesn't have."""
    each = [F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in enumerate(columns) if c is not None]
    return df.select(*_block(df), "id", F.inline(F.array(*each)))


def postings(texts: DataFrame) -> DataFrame:
    """Postings of (id, field, text); an id may have several texts of a field.

    Texts of :func:`dealt` documents are counted where they lie.
    """
    kept = texts.select(*_block(texts), "id", "field", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return kept.groupBy(*_block(texts), "token", "id", "field").agg(F.count(F.lit(1)).alias("n"), ((F.col("field") == 0) & (F.min("pos") == 0)).alias("first"))


def vocabulary(index: DataFrame) -> DataFrame:
    """token and number of documents that hold it in any field."""
    return index.groupBy("token").agg(F.countDistinct("id").alias("df"))


def gram_counts(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word, trigram and count of each word's byte trigrams, as :func:`quarry.functions.text.trigrams`, and each word's number of them."""
    texts = [w.encode() for w in words.to_pylist()]
    size = np.array([len(w) + 1 for w in texts], np.int64)
    held = np.frombuffer(b"".join(b"  " + w + b" " for w in texts), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(of)) + 2 * of  # a word takes two places more than it has trigrams
    both, n = np.unique(of << 24 | held[at] << 16 | held[at + 1] << 8 | held[at + 2], return_counts=True)
    return both >> 24, both & 0xFFFFFF, n, size


#: Bytes in hexadecimal.
_HEX = np.array([f"{n:02X}".encode() for n in range(256)])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, gram, n, size = gram_counts(batch["token"])
        text = np.stack([_HEX[gram >> 16], _HEX[gram >> 8 & 255], _HEX[gram & 255]], axis=1).view("S6").ravel()
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()).cast(pa.string()), batch["token"].take(pa.array(word)), pa.array(size[word], pa.int32()), pa.array(n, pa.int64())], names=["gram", "token", "size", "n"])


def grams(words: DataFrame) -> DataFrame:
    """gram, token, n and the token's number of grams; repeats count."""
    return words.select("token").mapInArrow(_gram_rows, "gram string, token string, size int, n long")


def similar(terms: DataFrame, grams_: DataFrame, least: float) -> DataFrame:
    """i, term, token of all tokens (their trigrams: ``grams_``) whose multiset trigram similarity reaches ``least``.

    The intersection sums products of counts, so repeated grams inflate it; an
    empty union compares as no match.
    """
    q = terms.select("i", "term", (F.octet_length("term") + 1).alias("qsize"), F.explode(trigrams(F.col("term"))).alias("gram")).groupBy("i", "term", "qsize", "gram").agg(F.count(F.lit(1)).alias("qn"))
    asked = [r["gram"] for r in q.select("gram").distinct().collect()]
    both = grams_.where(F.col("gram").isin(asked)).join(F.broadcast(q), "gram").groupBy("i", "term", "token", "size", "qsize").agg(F.sum(F.col("n") * F.col("qn")).alias("inter"))
    union = F.col("size") + F.col("qsize") - F.col("inter")
    return both.where((union != 0) & (F.col("inter") / union >= least)).select("i", "term", "token")


@dataclass(frozen=True)
class Index:
    """Postings (with their block) and the lists that hold them, what blocks hold of each token, vocabulary (token, df), trigrams of its tokens, and the numbers of documents and blocks."""

    postings: DataFrame
    blocks: DataFrame
    words: DataFrame
    grams: DataFrame
    rows: int
    lists: DataFrame
    parts: int


#: Columns of a posting; a list has an array of each.
POSTING = ("id", "field", "n", "first")


def posting_lists(postings_: DataFrame, fields: int = 3) -> DataFrame:
    """token, block, docs, head, the largest n of each field (n0, n1, ...), and the block's postings of the token as arrays."""
    most = [F.coalesce(F.max(F.when(F.col("field") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(fields)]
    lists = postings_.groupBy("token", "block").agg(F.bool_or("first").alias("head"), *most, F.collect_list(F.struct(*POSTING)).alias("p"))
    return lists.select("token", "block", F.size(F.array_distinct("p.id")).cast("bigint").alias("docs"), "head", *[f"n{k}" for k in range(fields)], *[F.col(f"p.{c}").alias(c) for c in POSTING])


def _lists_of_block(fields: int) -> Callable[[pa.Table], pa.Table]:
    def of_block(texts: pa.Table) -> pa.Table:
        split = pc.split_pattern(texts["text"].cast(pa.large_string()).combine_chunks(), " ")
        row, word = pc.list_parent_indices(split), pc.list_flatten(split)
        long = pc.greater_equal(pc.binary_length(word), 2)
        row, word = row.filter(long).to_numpy(), word.filter(long)
        given = texts["id"].combine_chunks()
        ids = given.unique()
        ids = ids.take(pc.sort_indices(ids))
        document, field = pc.index_in(given, value_set=ids).to_numpy()[row].astype(np.int64), texts["field"].to_numpy()[row]
        coded = word.dictionary_encode()
        key = (coded.indices.to_numpy().astype(np.int64) * len(ids) + document) * fields + field
        head = (field == 0) & np.r_[True, row[1:] != row[:-1]][: len(row)]
        held, n = np.unique(key, return_counts=True)
        first = np.zeros(len(held), bool)
        first[np.searchsorted(held, np.unique(key[head]))] = True
        field, document, code = held % fields, held // fields % len(ids), held // fields // len(ids)
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        of = lambda reduced, x: reduced.reduceat(x, start) if len(start) else x
        other = np.r_[True, (held[1:] // fields) != (held[:-1] // fields)][: len(held)]
        offsets = pa.array(np.r_[start, len(held)], pa.int32())
        listed = lambda x: pa.ListArray.from_arrays(offsets, x)
        most = {f"n{k}": pa.array(of(np.maximum, np.where(field == k, n, 0)), pa.int64()) for k in range(fields)}
        arrays = {"id": ids.take(pa.array(document)), "field": pa.array(field, pa.int32()), "n": pa.array(n, pa.int64()), "first": pa.array(first)}
        return pa.table({
            "token": coded.dictionary.cast(pa.string()),
            "block": pa.array(np.full(len(start), texts["block"][0].as_py()), pa.int32()),
            "docs": pa.array(of(np.add, other.astype(np.int64)), pa.int64()),
            "head": pa.array(of(np.logical_or, first)),
            **most,
            **{c: listed(arrays[c]) for c in POSTING},
        })

    return of_block


def text_lists(texts: DataFrame, fields: int = 3) -> DataFrame:
    """:func:`posting_lists` of :func:`postings` of :func:`dealt` texts (block, id, field, text): a block is counted at once."""
    most = ", ".join(f"n{k} long" for k in range(fields))
    schema = f"token string, block int, docs long, head boolean, {most}, id array<{texts.schema['id'].dataType.simpleString()}>, field array<int>, n array<long>, first array<boolean>"
    return texts.select("block", "id", "field", normalize(F.col("text")).alias("text")).groupBy("block").applyInArrow(_lists_of_block(fields), schema)


def spread(lists: DataFrame) -> DataFrame:
    """The postings of lists, a row each."""
    others = [c for c in lists.columns if c not in POSTING]
    return lists.select(*others, F.inline(F.arrays_zip(*POSTING)))


def publish_index(source: DataFrame, docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """Writes an index to ``path``: tables sorted by the columns they are looked up by.

    ``source`` is postings, or texts (id, field, text), which are quicker
    and move to their blocks unless they were :func:`dealt`; postings don't
    move any more. Blocks of documents go to files, and each file is sorted by
    token, so that a reader skips all pages but those of its query's tokens. A
    block's postings of a token are one row.
    """
    spark = docs.sparkSession

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}")

    rows = docs.count()
    if not _block(source):
        source = dealt(source, rows, block_docs)
    lists = posting_lists(source) if "token" in source.columns else text_lists(source)
    write(lists.sortWithinPartitions("token", "block"), "postings")
    words = spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.sum("docs").alias("df"))
    write(words.repartitionByRange("token").sortWithinPartitions("token"), "words")
    # Dealt by hash: ranges would take a sample first, and so make all grams twice.
    write(grams(spark.read.parquet(f"{path}/words").repartition("token")).repartition("gram").sortWithinPartitions("gram"), "grams")
    spark.createDataFrame([(rows, max(1, -(-rows // block_docs)))], "rows long, blocks int").write.mode("overwrite").parquet(f"{path}/size")


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    lists, size = read("postings"), read("size").first()
    return Index(spread(lists.select("token", "block", *POSTING)), lists.drop(*POSTING), read("words"), read("grams"), size["rows"], lists, size["blocks"])


#: Tokens that are named in a filter, which the scan's statistics can use; more are joined.
NAMED = 2000


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Tokens of a query; computed by the same expression as the index."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def _scored(index: Index, matched: DataFrame, terms: list[str], factor: float, rank: Rank) -> DataFrame:
    """Documents with all terms: the sum of factor, the query term's idf and the field's weight over their postings."""
    spark = matched.sparkSession
    known = {r["token"]: r["df"] for r in index.words.where(F.col("token").isin(terms)).collect()}
    asked = spark.createDataFrame([(i, t, known.get(t, 0)) for i, t in enumerate(terms)], "i int, t string, df long")
    weight = asked.select("i", (F.lit(factor) * idf(F.lit(index.rows), F.col("df"))).alias("w"))
    field = F.element_at(F.array(*map(F.lit, rank.weights)), F.col("field") + 1)
    found = [tuple(r) for r in matched.select("i", "token").limit(NAMED + 1).collect()]
    if len(found) <= NAMED:
        # The scan reads only what holds these tokens.
        matched = F.broadcast(spark.createDataFrame(found, "i int, token string"))
        held = index.postings.where(F.col("token").isin(sorted({t for _, t in found})))
    else:
        # Lists meet the tokens before they are spread.
        held = spread(index.lists.select("token", "block", *POSTING).join(near(matched.select("token").distinct()), "token", "left_semi"))
    rows = held.join(matched.select("i", "token"), "token").join(F.broadcast(weight), "i")
    return rows.groupBy("id").agg(F.sum(F.col("w") * field * F.col("n")).alias("score"), F.bool_or("first").alias("head"), F.every(F.col("field") == 1).alias("only_substance"), F.countDistinct("i").alias("k")).where(F.col("k") == len(terms)).drop("k")


@dataclass(frozen=True)
class Found:
    """Hits (id, score), best first when sorted by :func:`ranked`, and facts about the search."""

    hits: DataFrame
    tokens: int
    exact: int
    fallback: bool

    @property
    def mode(self) -> str:
        return "trigram" if self.fallback else "exact"


def ranked(hits: DataFrame) -> DataFrame:
    """Best first; of equal scores the smaller id."""
    return hits.orderBy(F.desc("score"), "id")


def find(docs: DataFrame, index: Index, query: str, rank: Rank | None = None, marketed: Column | None = None, active: Column | None = None) -> Found:
    """Scored documents of a query. ``docs`` has id and name.

    The last term also matches as a prefix unless the query ends with a blank.
    Below ``fallback_below`` exact hits, documents with similar tokens are
    added behind the exact ones' scores; exact hits win. A query without
    tokens finds nothing. ``exact`` counts exact hits, up to ``fallback_below``.
    """
    rank = rank or Rank()
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    if not terms:
        return Found(docs.select("id", F.lit(0.0).alias("score")).limit(0), 0, 0, False)
    asked = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    exact = index.words.where(F.col("token").isin(terms)).select("token").join(F.broadcast(asked.withColumnRenamed("term", "token")), "token").select("i", "token")
    if not query.endswith(" "):
        last = index.words.where(F.col("token").startswith(terms[-1]) & (F.col("token") != terms[-1])).orderBy("token").limit(rank.expansions)
        exact = exact.unionByName(last.select(F.lit(len(terms) - 1).alias("i"), "token")).distinct()
    hits = _scored(index, exact, terms, 1.0, rank)
    some = hits.limit(rank.fallback_below).count()
    if some < rank.fallback_below:
        near = _scored(index, similar(asked, index.grams, rank.similarity), terms, rank.approximate, rank)
        hits = hits.unionByName(near.join(F.broadcast(hits.select("id").limit(rank.fallback_below)), "id", "left_anti"))
    name, q = normalize(F.col("name")), normalize(F.lit(query))
    flag = lambda c, bonus: F.when(c, bonus).otherwise(0.0)
    bonus = F.when(name == q, rank.exact).when(name.startswith(q), rank.prefix).otherwise(0.0) + flag(F.col("head"), rank.head) + flag(F.col("only_substance"), rank.substance_only)
    for condition, value in ((marketed, rank.marketed), (active, rank.active)):
        if condition is not None:
            bonus = bonus + flag(condition, value)
    scored = docs.join(hits, "id").select("id", (F.col("score") + bonus).alias("score"))
    return Found(scored, len(terms), some, some < rank.fallback_below)


def observed(docs: DataFrame, index: Index, query: str, limit: int, clock: Callable[[], float] = time.perf_counter, **options) -> tuple[list[Row], dict[str, object]]:
    """The best hits, and what is recorded of a search: its mode, seconds, hits in all and tokens."""
    began = clock()
    found = find(docs, index, query, **options)
    best = ranked(found.hits).limit(limit).collect()
    total = len(best) if len(best) < limit else found.hits.count()
    return best, {"mode": found.mode, "seconds": clock() - began, "results": total, "tokens": found.tokens, "fallback": found.fallback}


def search(docs: DataFrame, index: Index, query: str, rank: Rank | None = None, marketed: Column | None = None, active: Column | None = None, limit: int | None = None) -> DataFrame:
    """Hits of :func:`find`, best first; with ``limit`` only the best ones, without a global sort."""
    hits = ranked(find(docs, index, query, rank, marketed, active).hits)
    return hits if limit is None else hits.limit(limit)


def suggest_tokens(words: DataFrame, prefix: str, limit: int, first: int = 200) -> DataFrame:
    """Of the alphabetically first tokens with a prefix the most frequent ones."""
    start = query_terms(words.sparkSession, prefix) or [prefix]
    return words.where(F.col("token").startswith(start[-1])).orderBy("token").limit(first).orderBy(F.desc("df"), "token").limit(limit)


def suggest_names(sources: list[tuple[str, DataFrame]], prefix: str, limit: int) -> DataFrame:
    """kind, id and label of names that start with the prefix, the first source first, each in order of ``row_no``."""
    start = normalize(F.lit(prefix))
    out = None
    for rank, (kind, df) in enumerate(sources):
        rows = df.where(normalize(F.col("label")).startswith(start)).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "row_no", "id", "label")
        rows = rows.orderBy("row_no").limit(limit)
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("rank", "row_no").limit(limit)
