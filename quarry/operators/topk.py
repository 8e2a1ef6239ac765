"""Best hits of a search by bounds of blocks, and searches for a whole table of queries.

Both read the index of :mod:`quarry.operators.search`. Its documents are dealt
to blocks by a hash of their id; ``blocks`` says of each token and block how
many documents hold the token and the largest count in each field. That bounds
what any document of the block can score, before a posting is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions.text import idf, normalize, tokens
from quarry.operators.search import NAMED, POSTING, Index, Rank, block_of, gram_counts, query_terms, similar
from quarry.sources.shared import near, removed, written

#: Blocks that are evaluated first, to find a threshold for the others.
FIRST = 32
#: Digits to which scores are compared: sums of doubles depend on their order.
DIGITS = 6


def _bonus(rank: Rank, name: Column, query: Column, marketed: Column | None, active: Column | None) -> Column:
    flag = lambda c, points: F.when(c, points).otherwise(0.0)
    out = F.when(name == query, rank.exact).when(name.startswith(query), rank.prefix).otherwise(0.0) + flag(F.col("head"), rank.head) + flag(F.col("only_substance"), rank.substance_only)
    for condition, points in ((marketed, rank.marketed), (active, rank.active)):
        if condition is not None:
            out = out + flag(condition, points)
    return out


def _points(rank: Rank) -> Column:
    """A posting's part of the score, without its term's weight."""
    return F.element_at(F.array(*map(F.lit, rank.weights)), F.col("field") + 1) * F.col("n")


@dataclass
class Top:
    """The best hits (rank, id, score), best first, and what was read to find them."""

    rows: list[Row]
    tokens: int
    fallback: bool
    #: Blocks in which all terms occur, and those whose bound reached the threshold.
    candidates: int = 0
    evaluated: int = 0
    #: Blocks read of each term's list, rarest list first.
    read: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class _Search:
    """One conjunctive evaluation: terms, their matched tokens, their weights."""

    docs: DataFrame
    index: Index
    rank: Rank
    terms: list[str]
    weights: list[float]
    matched: list[tuple[int, str]]
    bonus: Column
    most: float
    top: Top

    def candidates(self) -> DataFrame:
        """block, bound of all blocks in which every term has a token."""
        spark = self.index.postings.sparkSession
        asked = spark.createDataFrame([(i, t, self.weights[i]) for i, t in self.matched], "i int, token string, w double")
        held = _named(self.index.blocks, "token", [t for _, t in self.matched]).join(F.broadcast(asked), "token")
        sizes = sum((F.col(f"n{k}") * w for k, w in enumerate(self.rank.weights)), F.lit(0.0))
        each = held.groupBy("block", "i").agg(F.sum(sizes * F.col("w")).alias("most"), F.bool_or("head").alias("head"))
        head = F.when(F.bool_or("head"), self.rank.head).otherwise(0.0)
        return each.groupBy("block").agg(F.count(F.lit(1)).alias("k"), (F.sum("most") + head + self.most).alias("bound")).where(F.col("k") == len(self.terms)).drop("k")

    def evaluated(self, blocks: DataFrame, k: int, without: list) -> list[Row]:
        """The ``k`` best documents of the given blocks, other than those of ``without``.

        Lists are taken from the rarest on. Of later lists only blocks are read
        in which a document is left, and only its postings are kept.
        """
        own: dict[int, list[str]] = {}
        for i, t in self.matched:
            own.setdefault(i, []).append(t)
        count = dict(_named(self.index.words, "token", [t for _, t in self.matched]).select("token", "df").toLocalIterator())
        order = sorted(own, key=lambda i: (sum(count.get(t, 0) for t in own[i]), i))
        alive = None
        for at, i in enumerate(order):
            rows = _named(self.index.postings, "token", own[i])
            numbers = [r["block"] for r in blocks.limit(NAMED + 1).collect()]
            if len(numbers) <= NAMED:
                rows = rows.where(F.col("block").isin(numbers))
                self.top.read.append((self.terms[i], len(numbers)))
            else:
                rows = rows.join(near(blocks), "block", "left_semi")
                self.top.read.append((self.terms[i], blocks.count()))
            found = rows.groupBy("block", "id").agg((F.sum(_points(self.rank)) * self.weights[i]).alias("s"), F.bool_or("first").alias("f"), F.every(F.col("field") == 1).alias("o"))
            if alive is None:
                alive = found.select("block", "id", F.col("s").alias("score"), F.col("f").alias("head"), F.col("o").alias("only_substance"))
            else:
                alive = found.join(near(alive), ["block", "id"]).select("block", "id", (F.col("score") + F.col("s")).alias("score"), (F.col("head") | F.col("f")).alias("head"), (F.col("only_substance") & F.col("o")).alias("only_substance"))
            if at + 1 < len(order):
                alive, path = written(alive, "alive")
                blocks = alive.select("block").distinct()
        if without:
            alive = alive.where(~F.col("id").isin(without))
        scored = self.docs.join(near(alive.drop("block")), "id").select("id", F.round(F.col("score") + self.bonus, DIGITS).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k).collect()

    def best(self, k: int, without: list) -> list[Row]:
        if len({i for i, _ in self.matched}) < len(self.terms):
            return []  # a term without a token: nothing holds all terms
        blocks, path = written(self.candidates(), "candidates")
        first = [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(FIRST).select("block").collect()]
        self.top.candidates += blocks.count()
        if not first:
            return []
        spark = blocks.sparkSession
        found = self.evaluated(spark.createDataFrame([(b,) for b in first], "block int"), k, without)
        least = found[k - 1]["score"] if len(found) == k else float("-inf")
        # A bound is summed in another order than a score, so it gets the room of a digit.
        others = blocks.where((F.col("bound") >= least - 10.0**-DIGITS) & ~F.col("block").isin(first)).select("block")
        more = others.count()
        self.top.evaluated += len(first) + more
        if more:
            found = sorted([*found, *self.evaluated(others, k, without)], key=lambda r: (-r["score"], r["id"]))[:k]
        removed(spark, path)
        return found


def _named(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows with one of ``values``; a filter where they are few, which the scan's statistics can use."""
    values = sorted(set(values))
    if len(values) <= NAMED:
        return df.where(F.col(column).isin(values))
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")), column, "left_semi")


def find_top(docs: DataFrame, index: Index, query: str, k: int, rank: Rank | None = None, marketed: Column | None = None, active: Column | None = None) -> Top:
    """The ``k`` best hits of :func:`quarry.operators.search.find`, in order of score, then id.

    ``docs`` has id and name. Blocks with the largest bounds are scored first;
    of the others only those whose bound reaches the k-th best score so far.
    With fewer exact hits than the fallback's bound, documents with similar
    tokens fill up.
    """
    rank = rank or Rank()
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    top = Top([], len(terms), False)
    if not terms:
        return top
    known = {r["token"]: r["df"] for r in _named(index.words, "token", terms).collect()}
    exact = [(i, t) for i, t in enumerate(terms) if t in known]
    if not query.endswith(" "):
        last = index.words.where(F.col("token").startswith(terms[-1]) & (F.col("token") != terms[-1])).orderBy("token").limit(rank.expansions)
        exact += [(len(terms) - 1, r["token"]) for r in last.select("token").collect()]
    rows = spark.createDataFrame([(known.get(t, 0),) for t in terms], "df long").select(idf(F.lit(index.rows), F.col("df")).alias("w")).collect()
    bonus = _bonus(rank, normalize(F.col("name")), normalize(F.lit(query)), marketed, active)
    most = max(rank.exact, rank.prefix) + (rank.marketed if marketed is not None else 0) + (rank.active if active is not None else 0)

    def best(matched: list[tuple[int, str]], factor: float, k: int, without: list) -> list[Row]:
        return _Search(docs, index, rank, terms, [factor * r["w"] for r in rows], matched, bonus, most, top).best(k, without)

    found = best(exact, 1.0, max(k, rank.fallback_below), [])
    if len(found) < rank.fallback_below:
        top.fallback = True
        asked = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
        alike = [(r["i"], r["token"]) for r in similar(asked, index.grams, rank.similarity).select("i", "token").collect()]
        found = sorted([*found, *best(alike, rank.approximate, k, [r["id"] for r in found])], key=lambda r: (-r["score"], r["id"]))
    top.rows = [Row(rank=n, id=r["id"], score=r["score"]) for n, r in enumerate(found[:k], 1)]
    return top


# Tables of queries


def expanded(words: DataFrame, prefixes: DataFrame, first: int) -> DataFrame:
    """term, token: for each prefix of ``prefixes`` (term) the alphabetically first longer tokens that begin with it.

    Tokens are cut to the lengths that prefixes have and meet them by equality.
    """
    lengths = [r["n"] for r in prefixes.select(F.length("term").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return words.select(F.col("token").alias("term"), "token").limit(0)
    shorter = F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length("token"))
    cut = words.select("token", F.explode(F.transform(shorter, lambda n: F.left("token", n))).alias("term"))
    order = Window.partitionBy("term").orderBy("token")
    return cut.join(near(prefixes), "term", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).select("term", "token")


#: Words of a shard that meets the asked terms, cells of a table of words and terms, and rows of a table that is sent to all tasks.
SHARD_WORDS, CELLS, SENT = 20_000, 1 << 20, 1_000_000


def _alike(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of_shard(words: pa.Table, terms: pa.Table) -> pa.Table:
        terms_, tokens_ = terms["term"], words["token"]
        if not len(terms_) or not len(tokens_):
            return pa.table({"term": pa.array([], pa.string()), "token": pa.array([], pa.string())})
        q, qgram, qn, qsize = gram_counts(terms_)
        order = np.argsort(qgram, kind="stable")
        q, qgram, qn = q[order], qgram[order], qn[order]
        w, gram, n, size = gram_counts(tokens_)
        low, high = np.searchsorted(qgram, gram), np.searchsorted(qgram, gram, "right")
        found, step = [], max(1, CELLS // len(qsize))
        for first in range(0, len(size), step):
            a, b = np.searchsorted(w, (first, first + step))
            each = (high - low)[a:b]
            pair = np.repeat(low[a:b] - np.cumsum(each) + each, each) + np.arange(each.sum())
            cell = np.repeat(w[a:b] - first, each) * len(qsize) + q[pair]
            inter = np.bincount(cell, np.repeat(n[a:b], each) * qn[pair])
            cell = np.flatnonzero(inter)
            token, term = cell // len(qsize) + first, cell % len(qsize)
            union = size[token] + qsize[term] - inter[cell]
            kept = (union != 0) & (inter[cell] >= least * union) & (union > 0)
            kept[kept] = inter[cell][kept] / union[kept] >= least
            found.append((term[kept], token[kept]))
        term, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"term": terms_.take(pa.array(term)), "token": tokens_.take(pa.array(token))})

    return of_shard


def similar_many(terms: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """term, token: as :func:`quarry.operators.search.similar`, for a table of distinct terms and the vocabulary.

    Shards of the vocabulary meet all terms; only pairs that are alike leave a
    task, as those that share a trigram are too many to be moved.
    """
    shards = max(1, -(-words.count() // SHARD_WORDS))
    held = words.select("token", F.pmod(F.xxhash64("token"), F.lit(shards)).alias("shard"))
    asked = terms.select("term", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    return held.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_alike(least), "term string, token string")


def _hits_of_block(rank: Rank, most: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Hits of all texts in one block: text, n, and ids and scores of the ``most`` best.

    ``lists`` has block, key, w and postings; those of a key "=text" are
    names that begin with the text, those of the empty key get points whatever is asked.
    """
    points = np.array([*rank.weights, 1.0])

    def of_block(lists: pa.Table, asked: pa.Table) -> pa.Table:
        held_ids = pc.list_flatten(lists["id"]).combine_chunks()
        known = held_ids.unique()
        known = known.take(pc.sort_indices(known))
        # Ids by their place in order, whatever their type.
        ids, scores, sizes, which, counts = [np.zeros(0, np.int64)], [np.zeros(0)], [0], [], []
        if len(known) and len(asked):
            flat = lambda c: pc.list_flatten(lists[c]).to_numpy()
            coded = lists["key"].combine_chunks().dictionary_encode()
            keys = {k: n for n, k in enumerate(coded.dictionary.to_pylist())}
            length = pc.list_value_length(lists["id"]).to_numpy()
            code, i, field = np.repeat(coded.indices.to_numpy(), length), pc.index_in(held_ids, value_set=known).to_numpy(), flat("field")
            order = np.lexsort((i, code))
            s = (np.repeat(lists["w"].to_numpy(), length) * points[field] * flat("n"))[order]
            code, i, field, head = code[order], i[order], field[order], flat("first")[order]
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (i[1:] != i[:-1])])
            code, i, s, head, only = code[new], i[new], np.add.reduceat(s, new), np.logical_or.reduceat(head, new), np.logical_and.reduceat(field == 1, new)
            start = np.searchsorted(code, np.arange(len(keys) + 1))

            def places(key: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Which of the sorted ids ``x`` the key's list holds, and where."""
                a, b = start[keys[key]], start[keys[key] + 1]
                at = np.searchsorted(i[a:b], x) + a
                held = (at < b) & (i[np.minimum(at, b - 1)] == x)
                return held, at[held]

            for number, (text, wanted) in enumerate(zip(asked["text"].to_pylist(), asked["keys"].to_pylist(), strict=True)):
                if not all(k in keys for k in wanted):
                    continue
                wanted.sort(key=lambda k: (start[keys[k] + 1] - start[keys[k]], k))
                own = slice(start[keys[wanted[0]]], start[keys[wanted[0]] + 1])
                x, score, h, o = i[own], s[own], head[own], only[own]
                for k in wanted[1:]:
                    held, at = places(k, x)
                    x, score, h, o = x[held], score[held] + s[at], h[held] | head[at], o[held] & only[at]
                if not len(x):
                    continue
                which.append(number)
                counts.append(len(x))
                score = score + np.where(h, rank.head, 0.0) + np.where(o, rank.substance_only, 0.0)
                for k in ("=" + text, ""):
                    if k in keys:
                        held, at = places(k, x)
                        score[held] += s[at]
                score = np.floor(score * 10.0**DIGITS + 0.5) / 10.0**DIGITS
                if most is not None and len(x) > most:
                    near_top = score >= (np.partition(score, len(x) - most)[len(x) - most] if most else np.inf)
                    x, score = x[near_top], score[near_top]
                    best = np.lexsort((x, -score))[:most]
                    x, score = x[best], score[best]
                ids.append(x)
                scores.append(score)
                sizes.append(len(x))
        offsets = pa.array(np.cumsum(sizes), pa.int32())
        listed = lambda x: pa.ListArray.from_arrays(offsets, x)
        return pa.table({"text": asked["text"].take(pa.array(which, pa.int64())), "n": pa.array(counts, pa.int64()), "id": listed(known.take(pa.array(np.concatenate(ids), pa.int64()))), "score": listed(pa.array(np.concatenate(scores)))})

    return of_block


def _scored_many(index: Index, matched: DataFrame, points: list[DataFrame], asked: DataFrame, rank: Rank, most: int | None) -> DataFrame:
    """text, n, id, score: a row for each block and text of ``asked`` (text, keys) with hits, their number and the best ones.

    ``matched`` is key, token, w; ``points`` are lists that are no postings. A
    block's lists and all texts meet in one task, and what they share, which
    grows with both, doesn't leave it.
    """
    shape = ["block", "key", "w", *POSTING]
    lists = index.lists.select("token", "block", *POSTING).join(near(matched, SENT), "token").select(*shape)
    for more in points:
        lists = lists.unionByName(more.select(*shape))
    each = asked.select("text", "keys", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))).alias("block"))
    return lists.groupBy("block").cogroup(each.groupBy("block")).applyInArrow(_hits_of_block(rank, most), f"text string, n long, id {index.lists.schema['id'].dataType.simpleString()}, score array<double>")


def _awarded(index: Index, rows: DataFrame) -> DataFrame:
    """Lists of documents that get points: ``rows`` is key, w, id."""
    held = rows.groupBy(block_of(F.col("id"), index.parts).alias("block"), "key", "w").agg(F.sort_array(F.collect_list("id")).alias("id"))
    same = lambda value: F.transform("id", lambda _: F.lit(value))
    return held.select("*", same(-1).alias("field"), same(1).cast("array<bigint>").alias("n"), same(False).alias("first"))


def _named_like(docs: DataFrame, texts: DataFrame, rank: Rank) -> DataFrame:
    """key, w, id of documents whose normalised name is or begins with a text's (text, norm)."""
    lengths = [r["n"] for r in texts.select(F.length("norm").alias("n")).distinct().orderBy("n").collect()]
    names = docs.select("id", normalize(F.col("name")).alias("name"))
    cut = names.select("id", F.length("name").alias("whole"), F.explode(F.array(*[F.struct(F.left("name", F.lit(n)).alias("norm"), F.lit(n).alias("n")) for n in lengths or [0]])).alias("c"))
    cut = cut.select("id", "whole", "c.*").where("n <= whole")
    points = F.when(F.col("n") == F.col("whole"), F.lit(float(rank.exact))).otherwise(F.lit(float(rank.prefix)))
    return cut.join(near(texts, SENT), "norm").select(F.concat(F.lit("="), "text").alias("key"), points.alias("w"), "id")


@dataclass
class Many:
    """Hits (query, id, score) of all queries, and a row of facts for each: query, tokens, exact, fallback."""

    hits: DataFrame
    facts: DataFrame
    release: Callable[[], None]

    def best(self, k: int) -> DataFrame:
        """query, rank, id, score of each query's ``k`` best hits; of equal scores the smaller id comes first."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return self.hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def find_many(docs: DataFrame, index: Index, queries: DataFrame, rank: Rank | None = None, marketed: Column | None = None, active: Column | None = None, most: int | None = None) -> Many:
    """:func:`quarry.operators.search.find` for every row of ``queries`` (query: a key, text).

    Texts are searched once, however many queries have them. Caps on
    expansions are limits of a window by prefix, and each text falls back by
    its own number of exact hits. With ``most`` only so many best hits of a
    query are kept, 0 for the facts alone; all are counted. The number of jobs
    doesn't depend on the number of queries.
    """
    rank = rank or Rank()
    paths: list[str] = []

    def once(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        paths.append(path)
        return out

    queries = once(queries.select("query", "text"), "queries")
    texts = queries.select("text").distinct().select("text", normalize(F.col("text")).alias("norm"), tokens(F.col("text")).alias("t"), F.endswith("text", F.lit(" ")).alias("closed"))
    texts = once(texts.withColumn("k", F.coalesce(F.size("t"), F.lit(0))), "texts")
    # A term's key is itself, with a star where longer tokens match too.
    each = texts.where("k > 0").select("text", "k", "closed", F.posexplode("t").alias("i", "term")).withColumn("open", (F.col("i") == F.col("k") - 1) & ~F.col("closed"))
    each = each.withColumn("key", F.when(F.col("open"), F.concat("term", F.lit("*"))).otherwise(F.col("term")))
    terms = each.select("key", "term", "open").distinct().join(index.words, F.col("term") == F.col("token"), "left")
    terms = once(terms.select("key", "term", "open", F.col("token").isNotNull().alias("known"), idf(F.lit(index.rows), F.coalesce("df", F.lit(0))).alias("w")), "terms")
    longer = expanded(index.words, terms.where("open").select("term").distinct(), rank.expansions)
    matched = terms.where("known").select("key", F.col("term").alias("token"), "w").unionByName(terms.where("open").join(longer, "term").select("key", "token", "w"))
    # Of a text that may fall back all exact hits are needed.
    kept = None if most is None else max(most, rank.fallback_below) if most else 0
    points = []
    if most != 0:
        points = [once(_awarded(index, _named_like(docs, texts.where("k > 0").select("text", "norm"), rank)), "named")]
        for condition, value in ((marketed, rank.marketed), (active, rank.active)):
            if condition is not None:
                points.append(_awarded(index, docs.where(condition).select(F.lit("").alias("key"), F.lit(float(value)).alias("w"), "id")))
    asked = lambda column: F.array_sort(F.collect_list(column)).alias("keys")
    exact = once(_scored_many(index, once(matched, "matched"), points, each.groupBy("text").agg(asked("key")), rank, kept), "exact")
    counts = exact.groupBy("text").agg(F.sum("n").alias("exact"))
    facts = texts.select("text", F.col("k").alias("tokens")).join(counts, "text", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    facts = once(facts.withColumn("fallback", (F.col("tokens") > 0) & (F.col("exact") < rank.fallback_below)), "facts")
    alone = lambda df: df.select("text", F.inline(F.arrays_zip("id", "score")))
    hits = alone(exact)
    if most != 0:
        weak = each.join(near(facts.where("fallback").select("text")), "text", "left_semi")
        alike = similar_many(weak.select("term").distinct(), index.words, rank.similarity)
        matched = once(alike.join(near(terms.select("term", (F.col("w") * rank.approximate).alias("w")).distinct()), "term").select(F.col("term").alias("key"), "token", "w"), "alike")
        # Exact hits of a text, fewer than the bound, may be among its best ones here.
        others = _scored_many(index, matched, points, weak.groupBy("text").agg(asked("term")), rank, None if most is None else kept + rank.fallback_below)
        hits = hits.unionByName(alone(others).join(hits.join(near(facts.where("fallback").select("text")), "text", "left_semi").select("text", "id"), ["text", "id"], "left_anti"))
        if most is not None:
            order = Window.partitionBy("text").orderBy(F.desc("score"), "id")
            hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
        hits = once(hits, "hits")

    def release() -> None:
        for path in paths:
            removed(docs.sparkSession, path)

    return Many(queries.join(hits, "text").select("query", "id", "score"), queries.join(facts, "text").select("query", "tokens", "exact", "fallback"), release)


def suggest_many(words: DataFrame, prefixes: DataFrame, limit: int, first: int = 200) -> DataFrame:
    """query, rank, token, df: for every row of ``prefixes`` (query, text) the most frequent of the alphabetically first tokens with its prefix."""
    t = tokens(F.col("text"))
    starts = prefixes.select("query", F.when(F.size(t) > 0, F.element_at(t, -1)).otherwise(F.col("text")).alias("term"))
    asked = starts.select("term").distinct()
    same = asked.join(words, F.col("term") == F.col("token"), "left_semi").select("term", F.col("term").alias("token"))
    by_token, by_count = Window.partitionBy("term").orderBy("token"), Window.partitionBy("term").orderBy(F.desc("df"), "token")
    some = expanded(words, asked, first).unionByName(same).withColumn("r", F.row_number().over(by_token)).where(F.col("r") <= first).join(words, "token")
    best = some.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= limit)
    return starts.join(best, "term").select("query", "rank", "token", "df")
