"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles (64-bit hashes). All sets are ordered by
one global order, rare shingles first. Two sets that are similar enough share
at least ``l`` shingles among their first ``n - ceil(t * n) + l`` ones, for
every ``l``; each document picks its own ``l`` by the estimated cost of its
candidates, and a pair needs ``min(l1, l2)`` shared prefix shingles before it
is verified on the whole sets.

The steps, each a distributed pass:

1. Per document: size, a 128-bit digest of the set, and the prefix by hash.
   Equal sets are one class, represented by its smallest id.
2. The shingles of all prefixes are counted. Those in several lists, at most
   ``FREQUENT`` of them, go behind all others, rarest first; that order gives
   every document its ``l`` by real list lengths, and its prefix. Any order is
   right, a rougher one only makes more candidates.
3. Prefix rows are dealt by shingle. Lists of at most ``PAIRS`` classes give
   pairs. A pair needs ``min(l1, l2)`` shared prefix shingles, and so many that
   what lies behind the prefix that ends first can make up the rest.
4. Longer lists never become pairs. Their classes are dealt into blocks of
   bounded size that meet with prefixes only: the same bounds, counted by
   matrix products, and only a spanning forest of the candidate pairs leaves
   the task. Every class meets its own block of its longest list and a few
   pivots of that list first; in its other lists only classes that are not
   connected with the list's largest part by then meet the others.
5. Classes connected by candidate pairs are verified together on whole texts:
   one task each where they fit, so that a text travels once. Larger ones are
   split: every block meets itself and a few pivots first, then only classes
   that are not connected with the largest part meet the others.
6. Components of the links by alternating star contractions.

No list, class or component is ever collected; there is no cap on candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernels as K
from quarry.llm.common import cut, few, release

#: Longest list of classes that is expanded into pairs.
PAIRS = 64
#: Shingles whose frequency shapes the order: 24 bytes each go to the executors.
FREQUENT = 1 << 19
#: Matches that a document may ask for, 15 at most.
MATCHES = 12
#: Ids that may be sent to all executors instead of shuffling the texts.
BROADCAST_IDS = 500_000
#: Documents and shingles of one block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Rows of a matrix of pairs that are compared at once.
CHUNK = 128
#: Classes of a large candidate component that meet all its blocks first.
PIVOTS = 8


def _values(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


class Order:
    """The global order of shingles: those not known as frequent first, by hash; then the frequent, rarest first."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        order = np.argsort(token)
        self.token, self.count = token[order], count[order]
        self.rank = np.empty(len(token), dtype=np.int64)
        self.rank[np.lexsort((self.token, self.count))] = np.arange(len(token))

    def prefix(self, s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
        """The prefix of one set, given in hash order, and the matches it asks for."""
        n = len(s)
        least = -(-num * n // den)
        # A different set needs overlap o with den * o >= num * (o + 1).
        if n * (den - num) < num:
            return s[:0], 0
        shortest = n - least
        if not len(self.token):
            return s[: shortest + 1], 1
        slot = np.searchsorted(self.token, s)
        slot[slot == len(self.token)] = 0
        known = self.token[slot] == s
        last = np.flatnonzero(known)
        last = last[np.argsort(self.rank[slot[last]])]
        order = np.concatenate((np.flatnonzero(~known), last))[: shortest + MATCHES]
        s, count = s[order], np.where(known[order], self.count[slot[order]], 1)
        want = np.arange(1, min(MATCHES, least) + 1)
        length = shortest + want
        # Rows to move, list members to visit, and documents that can share so many of the shingles, each verified on n shingles.
        cost = 4 * length + np.cumsum(count - 1)[length - 1] * (1 + n / (8 * want))
        ask = int(want[np.argmin(cost)])
        return s[: shortest + ask], ask


def _frequent(classes: DataFrame) -> Order:
    """The order that the lengths of all prefix lists give.

    At most FREQUENT shingles are kept, the longest lists: a histogram of the
    lengths, as short as there are different ones, gives the bound.
    """
    lists = cut(_lengths(classes).where("n > 1"), "lengths")
    held, bound = 0, None
    for r in lists.groupBy("n").agg(F.count(F.lit(1)).alias("lists")).orderBy(F.desc("n")).toLocalIterator():
        held += r["lists"]
        if held > FREQUENT:
            break
        bound = r["n"]
    rows = lists.where(F.col("n") >= bound).toArrow() if bound is not None else None
    release(lists)
    if rows is None:
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Order(rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy())


def _lengths(classes: DataFrame) -> DataFrame:
    """token, n: the number of classes with it in their prefix."""
    return classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _described(docs: DataFrame, size: int, num: int, den: int, order: Order) -> DataFrame:
    """doc_id, set size, digest, matches asked for, prefix."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            K.trim()
            values = _values(batch)
            ids = batch.column("doc_id")
            for a, b in K.text_slices(values):
                n, d1, d2, ask, parts, ends = [], [], [], [], [], [0]
                for s in K.shingle_sets(values[a:b], size):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    prefix, want = order.prefix(s, num, den)
                    n.append(len(s))
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    ask.append(want)
                    parts.append(prefix)
                    ends.append(ends[-1] + len(prefix))
                flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(ask, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "d1", "d2", "ask", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(describe, "doc_id bigint, n bigint, d1 bigint, d2 bigint, ask int, prefix array<bigint>")


def _classes(described: DataFrame, copies: DataFrame) -> DataFrame:
    """rep, n, ask, prefix of one row of each class; ``copies`` are the classes (d1, d2, rep) with several rows.

    Only rows of such classes are shuffled, unless there are very many of them.
    """
    marked = described.where("n > 0 and doc_id is not null").join(F.broadcast(copies) if few(copies, BROADCAST_IDS) else copies, ["d1", "d2"], "left")
    single = marked.where("rep is null").select(F.col("doc_id").alias("rep"), "n", "ask", "prefix")
    several = marked.where("doc_id = rep").groupBy("d1", "d2").agg(F.first(F.struct("rep", "n", "ask", "prefix")).alias("r")).select("r.*")
    return single.unionByName(several)


def _runs(batches: Iterator[pa.RecordBatch]):
    """Columns of rows sorted by shingle, where each list begins, and its length; lists are short."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        edge = _edges(cols[0])
        tail = int(edge[-2])
        held = [c[tail:] for c in cols]
        if tail:
            yield [c[:tail] for c in cols], edge[:-1], np.diff(edge[:-1])
    if held is not None:
        edge = _edges(held[0])
        yield held, edge, np.diff(edge)


def _edges(token: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)])).astype(np.int64)


def _behind(n: np.ndarray, ask: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set behind its prefix."""
    return -(-num * n // den) - ask


def _pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """x < y and need, the matches it must have, for each two classes of each list of ``rows`` (token, rep, n, ask).

    Beyond the prefix that ends first its set has only so many shingles left,
    and all shared ones before that lie in both prefixes. Pairs whose sizes
    rule a link out are left away.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, doc, n, ask), edge, length in _runs(batches):
            n, ask = n.astype(np.int64), ask.astype(np.int64)
            xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in np.unique(length[length > 1]).tolist():
                i, j = np.triu_indices(m, 1)
                first = edge[:-1][length == m]
                xs.append((first[:, None] + i).ravel())
                ys.append((first[:, None] + j).ravel())
            x, y = np.concatenate(xs), np.concatenate(ys)
            fits = (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & (doc[x] != doc[y])
            x, y = x[fits], y[fits]
            behind = _behind(n, ask, num, den)
            least = -(-num * (n[x] + n[y]) // (num + den))
            need = np.maximum(np.minimum(ask[x], ask[y]), least - np.maximum(behind[x], behind[y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y])), pa.array(need.astype(np.int32))], names=["x", "y", "need"])

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(emit, "x bigint, y bigint, need int")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents named in ``ids`` (column rep).

    Texts travel instead of shingle sets: they take a third of the room after
    compression, and sets are built again where two texts meet.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").where("rep is not null")
    return texts.join(F.broadcast(ids) if few(ids, BROADCAST_IDS) else ids, "rep", "left_semi")


def _forest(m: int, linked) -> np.ndarray:
    """Smallest linked position of each of m positions, followed to the end; ``linked(a, b)`` gives rows a to b of a symmetric matrix."""
    links = np.empty((m, m), dtype=bool)
    for a in range(0, m, CHUNK):
        links[a : a + CHUNK] = linked(a, min(a + CHUNK, m))
    label = np.arange(m)
    while True:
        best = label.copy()
        for a in range(0, m, CHUNK):
            best[a : a + CHUNK] = np.where(links[a : a + CHUNK], label, m).min(axis=1, initial=m)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over slices of the shingles; exact in 32-bit floats up to 2^24."""
    m = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    rename = np.cumsum(count > 1) - 1
    column = rename[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    overlap = np.zeros((m, m), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((m, min(width, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[row[a:b], column[a:b] - first] = 1
        overlap += part @ part.T
        del part
    np.fill_diagonal(overlap, [len(s) for s in sets])
    return overlap


def _partnered(group: pa.Table, num: int, den: int) -> pa.Table:
    """Candidate pairs of one task, by prefixes: a spanning forest of them."""
    reps = group.column("rep").to_numpy()
    n, ask = group.column("n").to_numpy()[:, None], group.column("ask").to_numpy().astype(np.int64)[:, None]
    lists = group.column("prefix").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    behind = _behind(n, ask, num, den)
    shared = _overlaps(sets)

    def fits(a: int, b: int) -> np.ndarray:
        own, least = n[a:b], -(-num * (n[a:b] + n.T) // (num + den))
        need = np.maximum(np.minimum(ask[a:b], ask.T), least - np.maximum(behind[a:b], behind.T))
        return (den * np.minimum(own, n.T) >= num * np.maximum(own, n.T)) & (shared[a:b] >= need)

    return _tree(reps, _forest(len(reps), fits))


def _tree(reps: np.ndarray, label: np.ndarray) -> pa.Table:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"x": pa.array(reps[label[moved]], pa.int64()), "y": pa.array(reps[moved], pa.int64())})


def _block_links(group: pa.Table, size: int, num: int, den: int) -> pa.Table:
    """Links among the classes of one task: a spanning forest of them."""
    reps = group.column("rep").to_numpy()
    texts = [t or b"" for t in group.column("text").cast(pa.binary()).to_pylist()]
    sets = [s for a, b in K.text_slices(texts) for s in K.shingle_sets(texts[a:b], size)]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    shared = _overlaps(sets)
    del sets, texts

    def linked(a: int, b: int) -> np.ndarray:
        both = shared[a:b].astype(np.int64)
        return den * both >= num * (n[a:b, None] + n[None, :] - both)

    label = _forest(len(n), linked)
    K.trim()
    return _tree(reps, label)


def _met(docs: DataFrame, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links among the classes (rep) that meet in a task (key, i, j)."""

    def verify(group: pa.Table) -> pa.Table:
        return _block_links(group, size, num, den)

    with_texts = members.join(_texts(docs, members.select("rep").distinct()), "rep")
    return with_texts.groupBy("key", "i", "j").applyInArrow(verify, "x bigint, y bigint").where("x <> y")


def _block_count(*by: str):
    """Blocks of a key's classes (rep, n), so that no block has many classes or long texts."""
    return lambda rows: rows.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df, BROADCAST_IDS) else df


_OWN = "cast(pmod(xxhash64(rep), blocks) as int)"


def _own_tasks(rows: DataFrame) -> DataFrame:
    """Tasks (key, i, j, rep) in which every block of a key's classes (key, rep, blocks) meets itself and a few pivots of the key."""
    rank = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
    pivots = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PIVOTS).select("key", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return rows.select("key", "rep", F.expr(_OWN).alias("i")).unionByName(pivots).distinct().withColumn("j", F.col("i"))


def _rest_tasks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Tasks in which a key's classes (key, rep, n) that are not in its largest part meet all others of the key.

    ``parts`` are components (node, component) of what is connected so far:
    within the largest part nothing more needs to meet.
    """
    placed = cut(rows.join(_bounded(parts.withColumnRenamed("node", "rep")), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part")), "parts")
    main = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    sided = cut(placed.join(_bounded(cut(main, "main")), "key").select("key", "rep", "n", (F.col("part") != F.col("main")).alias("rest")), "sided")
    counts = _block_count("key", "rest")(sided).groupBy("key").agg(F.max(F.when(F.col("rest"), F.col("blocks"))).alias("rests"), F.coalesce(F.max(F.when(~F.col("rest"), F.col("blocks"))), F.lit(0)).alias("mains"))
    dealt = sided.join(_bounded(cut(counts, "counts")), "key").withColumn("blocks", F.expr("if(rest, rests, mains)")).withColumn("own", F.expr(f"{_OWN} + if(rest, 0, rests)"))
    met = dealt.select("key", "rep", "own", F.explode(F.sequence(F.lit(0), F.expr("if(rest, rests + mains, rests) - 1"))).alias("other"))
    return cut(met.select("key", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).distinct(), "met")


def _long_candidates(classes: DataFrame, long: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs within lists (key, rep, n, length) of more than PAIRS classes: spanning forests of them.

    Copies of a text share most of their lists, so every class meets the
    others of its longest list first. In all its lists only what that has left
    unconnected is looked at again.
    """

    def filter_(group: pa.Table) -> pa.Table:
        return _partnered(group, num, den)

    def met(tasks: DataFrame) -> DataFrame:
        prefixes = tasks.join(classes.select("rep", "n", "ask", "prefix"), "rep")
        return cut(prefixes.groupBy("key", "i", "j").applyInArrow(filter_, "x bigint, y bigint").where("x <> y"), "candidates")

    longest = cut(long.groupBy("rep").agg(F.max_by("key", F.struct("length", "key")).alias("key"), F.max("n").alias("n")), "longest")
    first = met(cut(_own_tasks(longest.join(_bounded(cut(_block_count("key")(longest), "blocks")), "key")), "own"))
    rest = met(_rest_tasks(long.select("key", "rep", "n"), components(first.unionByName(pairs))))
    return first.unionByName(rest)


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a spanning forest of them) among classes that candidate pairs (x, y) connect."""
    label = components(candidates)
    members = label.select(F.col("node").alias("rep"), F.col("component").alias("key")).unionByName(label.select(F.col("component").alias("rep"), F.col("component").alias("key")).distinct())
    # A doc_id that represents several sets counts with the largest.
    sized = cut(_bounded(members).join(classes.select("rep", "n"), "rep").groupBy("key", "rep").agg(F.max("n").alias("n")), "members")
    large = cut(_block_count("key")(sized).where("blocks > 1"), "large")
    alone = sized.join(_bounded(large), "key", "left_anti").select("key", "rep", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if few(large, 0):
        return cut(_met(docs, cut(alone, "met"), size, num, den), "links")
    # Every block meets itself and the pivots first: as many texts as there are classes, and a few per block.
    split = sized.join(_bounded(large), "key")
    first = cut(_met(docs, cut(alone.unionByName(_own_tasks(split)), "met"), size, num, den), "links")
    # What is not connected with the largest part of its component by now meets all the others.
    rest = _rest_tasks(split.drop("blocks"), components(first))
    return first.unionByName(cut(_met(docs, rest, size, num, den), "links"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node each node of ``edges`` (x, y) is connected with, if that is another one.

    Alternating large-star and small-star steps until nothing changes; every
    step is two shuffles of the remaining edges, whose number never grows.
    Null ends are ignored.
    """
    now = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    # Edges never become more, so this holds for all rounds. Hubs stay where they are then; else skewed joins are split.
    held = F.broadcast if few(now, BROADCAST_IDS) else (lambda df: df)
    # Stars around smallest nodes are left when no smaller end has a smaller neighbour itself.
    while not few(now.join(held(now.select(F.col("v").alias("u")).distinct()), "u", "left_semi"), 0):
        # Large star: what is larger than v and next to it points to the smallest around v.
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = now.join(held(least), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: u's smaller neighbours, and u, point to the smallest of them.
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(held(near), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, cut(small, "edges")
        release(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def ngram_jaccard_join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Sets are the distinct ``size``-word shingles of the text, A-Z lower-cased
    (fewer words: the whole sequence as one); two documents link when ``den *
    |intersection| >= num * |union|``. ``component_id`` is the smallest doc_id
    reachable by links.

    Edge cases: null, empty and wordless texts have the empty set and link
    with nothing. Rows that repeat a doc_id are one document: their links are
    joined, their sizes are their own. A null doc_id links with nothing and
    has a null component_id. Only ``doc_id`` and ``text`` are read.
    """
    if not 0 < num < den:
        raise ValueError("the similarity must lie between 0 and 1")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    by_hash = cut(_described(docs, size, num, den, Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))), "by_hash")
    sets = cut(by_hash.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "copies")
    order = _frequent(_classes(by_hash, sets))
    release(by_hash)
    described = cut(_described(docs, size, num, den, order), "described")
    classes = cut(_classes(described, sets), "classes")
    long_lists = cut(_lengths(classes).where(F.col("n") > PAIRS).withColumnRenamed("n", "length"), "long")
    rows = classes.select(F.explode("prefix").alias("token"), "rep", F.col("n").cast("int").alias("n"), "ask")
    hot = _bounded(long_lists)
    pairs = _pairs(rows.join(hot, "token", "left_anti"), num, den)
    found = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need").select("x", "y")
    candidates = cut(found, "pairs")
    if not few(long_lists, 0):
        long = cut(rows.join(hot, "token").select(F.col("token").alias("key"), "rep", "n", "length"), "hot")
        candidates = candidates.unionByName(_long_candidates(classes, long, candidates, num, den))
    links = _verified(docs, classes, candidates, size, num, den)
    # Documents whose rows fall in several classes.
    placed = described.select("doc_id", "n", "d1", "d2").join(_bounded(sets), ["d1", "d2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    split = described.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    again = placed.join(split, "doc_id").where("rep <> doc_id").select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
    joined = components(links.unionByName(again))
    return placed.join(_bounded(joined.withColumnRenamed("node", "rep")), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "rep", "doc_id"), "doc_id")).alias("component_id"))


def near_duplicate_survivors(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Rows of ``docs``, columns unchanged: of each component the row with the smallest doc_id stays.

    Rows with a null doc_id stay. Of rows repeating the kept doc_id all stay.
    """
    lost = ngram_jaccard_join(docs, size, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
