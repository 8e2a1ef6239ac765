"""Best hits by bounds of blocks and searches of a table of queries, against one search at a time."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import search, topk

WORDS = ["dolo", "doli", "prane", "rhume", "forte", "banana", "kaliumo", "natrium", "été", "mg", "500", "bio", "x1"]
QUERIES = ["doli", "doli ", "dolo forte", "natriun", "banan kalium", "!!!", "", "500 mg", "zzz", "zzz forte", "d", "rhume rhume", "doli prane forte"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 6))), rng.choice(WORDS), " ".join(rng.sample(WORDS, 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, name string, substance string, holder string")
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.publish_index(search.postings(search.field_texts(docs, ["name", "substance", "holder"])), docs, path, block_docs=16)
    return docs.select("id", "name"), search.open_index(spark, path)


def one_by_one(docs, index, text, k=None, **options):
    hits = [(r["id"], round(r["score"], 6)) for r in search.find(docs, index, text, **options).hits.collect()]
    return sorted(hits, key=lambda h: (-h[1], h[0]))[:k]


@pytest.mark.parametrize("text", QUERIES)
def test_top_is_the_head_of_the_whole_order(corpus, text):
    docs, index = corpus
    options = {"marketed": F.col("id") % 2 == 0, "active": F.col("id") % 3 == 0}
    for k in (7,):
        found = topk.find_top(docs, index, text, k, **options)
        assert [(r["id"], r["score"]) for r in found.rows] == one_by_one(docs, index, text, k, **options)
        assert [r["rank"] for r in found.rows] == list(range(1, len(found.rows) + 1))
    alone = search.find(docs, index, text)
    assert (found.tokens, found.fallback) == (alone.tokens, alone.fallback)


def test_all_queries_at_once(spark, corpus):
    docs, index = corpus
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string")
    many = topk.find_many(docs, index, asked)
    got: dict[int, list] = {}
    for r in many.best(10_000).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    for n, text in enumerate(QUERIES):
        hits = one_by_one(docs, index, text)
        assert sorted(got.get(n, [])) == [(i, *h) for i, h in enumerate(hits, 1)], text
    facts = {r["query"]: r for r in many.facts.collect()}
    for n, text in enumerate(QUERIES):
        alone = search.find(docs, index, text)
        assert (facts[n]["tokens"], min(facts[n]["exact"], 5), facts[n]["fallback"]) == (alone.tokens, alone.exact, alone.fallback)
    many.release()


def test_expansions_are_limited_by_prefix(spark, corpus):
    docs, index = corpus
    asked = spark.createDataFrame([(0, "d"), (1, "n"), (2, "do"), (3, "zz")], "query int, text string")
    rank = search.Rank(expansions=1, fallback_below=0)
    found = topk.find_many(docs, index, asked, rank).best(1000).collect()
    for n, text in ((0, "d"), (1, "n"), (2, "do"), (3, "zz")):
        assert {r["id"] for r in found if r["query"] == n} == {i for i, _ in one_by_one(docs, index, text, rank=rank)}
    suggested = topk.suggest_many(index.words, asked, 2, first=2).collect()
    for n, text in ((0, "d"), (1, "n"), (2, "do")):
        assert [r["token"] for r in sorted((r for r in suggested if r["query"] == n), key=lambda r: r["rank"])] == [r["token"] for r in search.suggest_tokens(index.words, text, 2, 2).collect()]


def jobs(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_queries(spark, corpus):
    docs, index = corpus
    asked = lambda n: spark.createDataFrame([(i, QUERIES[i % 5]) for i in range(n)], "query int, text string")
    few, many = (jobs(spark, lambda n=n: topk.find_many(docs, index, asked(n)).best(5).collect()) for n in (5, 50))
    assert many <= few + 2


def test_a_rare_word_spares_blocks_of_a_frequent_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(["common"] * rng.randint(1, 3) + (["rarest"] if i in (77, 1900) else []))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, name string")
    search.publish_index(search.postings(search.field_texts(docs, ["name"])), docs, f"file://{tmp_path}/i", block_docs=16)
    index = search.open_index(spark, f"file://{tmp_path}/i")
    alone = topk.find_top(docs, index, "common ", 5)
    both = topk.find_top(docs, index, "common rarest ", 5, search.Rank(fallback_below=0))
    assert [r["id"] for r in both.rows] and {r["id"] for r in both.rows} == {77, 1900}
    # The rare word's list comes first; of the frequent one only blocks with such a document are read.
    assert [t for t, _ in both.read] == ["rarest", "common"] and dict(both.read)["common"] <= 2
    assert sum(n for _, n in alone.read) > dict(both.read)["common"]
    # A term that no document holds ends the search before a posting is read.
    nothing = topk.find_top(docs, index, "common absent ", 5, search.Rank(fallback_below=0))
    assert nothing.rows == [] and nothing.read == []


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path):
    rows = [(i, "word " * (30 if i in (5, 6, 7) else 1)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, name string")
    search.publish_index(search.postings(search.field_texts(docs, [None, "name"])), docs, f"file://{tmp_path}/i", block_docs=16)
    index = search.open_index(spark, f"file://{tmp_path}/i")
    # Idf is small for a word of every document, so weigh it.
    found = topk.find_top(docs, index, "word ", 3, search.Rank(weights=(1.0, 1e9, 1.0), exact=1, prefix=1, fallback_below=0))
    assert [r["id"] for r in found.rows] == [5, 6, 7]
    assert found.candidates > 200 and found.evaluated <= topk.FIRST


def test_texts_in_blocks_are_counted_where_they_lie(spark, tmp_path):
    docs = search.dealt(spark.range(300).select("id", F.concat(F.lit("word w"), F.col("id").cast("string")).alias("name")), 300, 16)
    postings = search.postings(search.field_texts(docs, ["name"]))
    text = search.posting_lists(postings)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    search.publish_index(postings, docs.drop("block"), f"file://{tmp_path}/i", block_docs=16)
    index = search.open_index(spark, f"file://{tmp_path}/i")
    assert index.postings.where("token = 'word'").count() == 300 and index.lists.where("token = 'word'").count() <= 19
    assert [tuple(r) for r in index.words.where("token in ('word', 'w7')").orderBy("token").collect()] == [("w7", 1), ("word", 300)]


def test_many_keeps_only_the_best_and_counts_all(spark, corpus):
    docs, index = corpus
    texts = [q for q in QUERIES if q in ("doli", "dolo forte", "natriun", "zzz forte", "rhume rhume", "500 mg")]
    asked = spark.createDataFrame([(n, texts[n % len(texts)]) for n in range(2 * len(texts))], "query int, text string")
    options = {"marketed": F.col("id") % 2 == 0, "active": F.col("id") % 3 == 0}
    many = topk.find_many(docs, index, asked, **options, most=3)
    hits: dict[int, list] = {}
    for r in many.hits.collect():
        hits.setdefault(r["query"], []).append((r["id"], r["score"]))
    exact = {r["query"]: r["exact"] for r in many.facts.collect()}
    for n in range(2 * len(texts)):
        assert sorted(hits.get(n, []), key=lambda h: (-h[1], h[0])) == one_by_one(docs, index, texts[n % len(texts)], 3, **options), texts[n % len(texts)]
    whole = search.find(docs, index, "doli", search.Rank(fallback_below=0)).hits.count()
    assert whole > 3 and exact[texts.index("doli")] == exact[texts.index("doli") + len(texts)] == whole


def test_similar_tokens_of_many_terms(spark):
    terms = ["banana", "aaaaaa", "été", "natrium", "no"]
    words = spark.createDataFrame([(w,) for w in (*WORDS, "bananana", "aaaaaaaa", "aaab", "anaban", "nona", "etes", "étés", "natr")], "token string")
    asked = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    want = {(r["term"], r["token"]) for r in search.similar(asked, search.grams(words), 0.4).collect()}
    assert {tuple(r) for r in topk.similar_many(asked.select("term"), words, 0.4).collect()} == want and len(want) > 4


def test_an_index_of_texts_is_that_of_postings(spark, tmp_path):
    rows = [("b", 0, "Été forte, dolo-forte a 500"), ("b", 0, "forte"), ("b", 1, None), ("a", 0, " x banana BANANA"), ("a", 2, "forte é forte"), ("c", 0, ""), ("c", 1, "onononon 가각"), ("d", 0, "!")]
    texts = spark.createDataFrame(rows, "id string, field int, text string")
    docs = texts.select("id").distinct()
    dealt = search.dealt(texts, 4, 2)
    assert search.text_lists(dealt)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for name, source in (("t", dealt), ("p", search.postings(texts)), ("u", texts)):
        search.publish_index(source, docs, f"file://{tmp_path}/{name}", block_docs=2)
    one, other, undealt = (search.open_index(spark, f"file://{tmp_path}/{name}") for name in "tpu")
    facts = lambda i: [sorted(map(tuple, df.collect())) for df in (i.postings, i.blocks, i.words, i.grams)]
    assert facts(one) == facts(other) == facts(undealt) and (one.rows, one.parts) == (other.rows, other.parts) == (4, 2)
    assert {tuple(r) for r in one.words.where("token in ('forte', 'ete')").collect()} == {("forte", 2), ("ete", 1)}
    many = topk.find_many(texts.where("field = 0").groupBy("id").agg(F.max("text").alias("name")), one, spark.createDataFrame([(0, "forte ")], "query int, text string"))
    assert {r["id"] for r in many.hits.collect()} == {"a", "b"}
