"""Arrow sequence files, Block-Max WAND and the bitmap audit against brute force, and their odd rows."""

import random
import zlib
from itertools import permutations
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
import regex

from quarry.llm.arrowfile import SequenceFile, read_documents, token_files, write_tokens
from quarry.llm.audit import BITMAPS, FILTERS, bitmap_index, flagged, interaction_audit, prefix_counts
from quarry.llm.tokens import ByteEncoder, encoder
from quarry.llm.wand import Best, Corpus, Shard, build_index, corpus, query_batches, ranked_search, search_index, search_shard, shard_of

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Token files


def brute_tokens(rows):
    tokenizer, at, out = encoder(None, ByteEncoder).tokenizer, 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_byte_encoder_agrees_with_the_library():
    rng = random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "1", "é", "²", "!", "\r", "A", "don't", " '", "''", "日本", "<|endoftext|>", " ", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    own = encoder(None, ByteEncoder)
    plain = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert own.encode(texts) == plain
    assert own.encode(texts, limit=50) == plain


def test_token_files_whole_and_by_sequence(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "l'été", "x1", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["word " * 3000, "", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    manifest = write_tokens(docs, "file://" + str(tmp_path / "t"), length=64, rows=4)
    expected = brute_tokens(sorted(rows))
    found = read_documents(spark, manifest, docs.schema["doc_id"]).collect()
    assert sorted(map(tuple, found)) == expected
    # Every sequence of every file, one by one: with the masks they are all ids in order.
    ids, total = [], 0
    for part in manifest.orderBy("shard").collect():
        held = SequenceFile(part["file"] + ".tokens.arrow")
        order = list(range(len(held)))
        rng.shuffle(order)
        got = {}
        for i in order:
            values, mask = held.sequence(i)
            assert len(values) == len(mask) == 64
            got[i] = values[np.array(mask.to_pylist(), dtype=bool)].tolist()
            assert i == len(held) - 1 or len(got[i]) == 64
        ids += [x for i in sorted(got) for x in got[i]]
        total += part["tokens"]
        with pytest.raises(IndexError):
            held.sequence(len(held))
    assert len(ids) == total == sum(e[2] for e in expected)
    assert zlib.crc32(np.array(ids[: expected[0][2]], dtype="<u4").tobytes()) == expected[0][3]


def test_sequences_are_views_of_the_map(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words of a text " * 50) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    part = write_tokens(docs, "file://" + str(tmp_path / "t"), length=128, rows=8).first()
    held = SequenceFile(part["file"] + ".tokens.arrow")
    before = pa.total_allocated_bytes()
    views = [held.sequence(i)[0] for i in range(len(held))]
    assert pa.total_allocated_bytes() == before and not any(v.flags.owndata or v.flags.writeable for v in views)


def test_token_files_odd_rows(spark):
    rows = [(7, "b"), (7, "a"), (None, "none"), (7, "a"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as shard", "'x' as h")
    found = sorted((tuple(r) for r in token_files(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 3, 4, 7, 7, 7]
    assert [r[1] for r in found] == [sum(x[2] for x in found[:i]) for i in range(6)]
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in brute_tokens(rows))
    assert token_files(docs.limit(0)).collect() == []


def test_a_second_attempt_leaves_files_that_nothing_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    path = "file://" + str(tmp_path / "t")
    write_tokens(docs, path)
    manifest = write_tokens(docs, path)
    assert sorted(map(tuple, read_documents(spark, manifest, docs.schema["doc_id"]).collect())) == brute_tokens([(i, f"text {i}") for i in range(50)])


def test_a_damaged_file_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id bigint, text string").coalesce(1)
    manifest = write_tokens(docs, "file://" + str(tmp_path / "t"))
    wrong = manifest.selectExpr("shard", "file", "docs", "tokens + 1 as tokens")
    with pytest.raises(Exception, match="holds other ids"):
        read_documents(spark, wrong, docs.schema["doc_id"]).collect()


# Search


def brute_search(docs, items, k):
    bags = [(i, WORD.findall(lowered(t or ""))) for i, t in docs]
    n, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = {}
    for _, words in bags:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        asked = WORD.findall(lowered(text or ""))
        scores = []
        for i, words in bags:
            if not words:
                continue
            m = 100 - 75 + 75 * len(words) * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * words.count(w) // (1000 * words.count(w) + 8 * m)) for w in asked if w in words)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made_texts(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "x1", "--", "a_b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("shard", [1, 700, 1 << 20])
def test_search_equals_brute_force(spark, shard):
    texts = made_texts(11)
    texts[5], texts[6] = None, "?! --"
    rows = list(enumerate(texts)) + [(None, texts[20]), (20, texts[20]), (20, texts[20])]
    items = [(f"i{k}", t) for k, t in enumerate(made_texts(12, 30))] + [("none", None), ("blank", " - "), ("unknown", "zzz qqq"), ("double", "w1 w1 w1 w70")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    found = [tuple(r) for r in ranked_search(docs, asked, 10, shard=shard, queries=7, runs=2).collect()]
    assert sorted(found, key=repr) == brute_search(rows, items, 10)


def test_search_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").selectExpr("*", "0 as score", "0 as query")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string").selectExpr("*", "9 as rank", "9 as doc_id")
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == brute_search([(1, "a b"), (2, None)], [(1, "a")], 10)
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs.where("text is null"), items).collect() == []
    assert ranked_search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_wide_gaps_and_counts_are_packed_exactly():
    texts = [b"rare " * 70000 if i in (3, 69990) else b"x" if i % 300 == 0 else b"" for i in range(70000)]
    shard = Shard(shard_of(list(range(70000)), texts, Corpus(300, 200000)))
    by_term = {int(t): k for k, t in enumerate(shard.terms)}
    for term in by_term.values():
        blocks = shard.block[term] + np.arange(shard.blocks[term])
        docs, points, which = shard.postings(blocks)
        assert len(docs) == shard.df[term] and (np.diff(docs) > 0).all()
        for b in range(len(blocks)):
            assert points[which == b].max() == shard.impact[blocks[b]]
            assert docs[which == b].min() == shard.first[blocks[b]] and docs[which == b].max() == shard.last[blocks[b]]
    assert sorted(shard.df.tolist()) == [2, 234]
    assert set((shard.gap_width).tolist()) >= {2, 4} and set(shard.tf_width.tolist()) >= {1, 4}


def test_blocks_below_the_threshold_are_not_decompressed():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["common", "other", "more"], k=400)) for _ in range(20000)]
    for i in range(100, 112):
        texts[i] = "common special " * 3
    encoded = [t.encode() for t in texts]
    lengths = [len(t.split()) for t in texts]
    shard = Shard(shard_of(list(range(len(texts))), encoded, Corpus(len(texts), sum(lengths))))
    from quarry.llm import kernels as K

    terms = np.unique(K.Words([b"common special"], K.ALNUM).hashes)
    weight = np.array([5 if shard.df[p] > 1000 else 9000 for p in shard.at(terms)], dtype=np.int64)
    best = Best(10)
    search_shard(shard, shard.at(terms), weight, best)
    assert set(best.doc.tolist()) <= set(range(100, 112)) and len(best.doc) == 10
    assert shard.decompressed < shard.seen / 10
    # A threshold from elsewhere spares a whole shard.
    again, full = Shard(shard_of(list(range(len(texts))), encoded, Corpus(len(texts), sum(lengths)))), Best(1)
    full.add(np.array([1 << 50]), [1])
    search_shard(again, again.at(terms), weight, full)
    assert again.decompressed == 0 and again.seen > 0


def test_corpus_counts_terms_like_the_index(spark):
    texts = made_texts(2, 50) + [None, "", "é É A"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    facts = corpus(docs)
    assert facts == Corpus(sum(bool(WORD.findall(t or "")) for t in texts), sum(len(WORD.findall(t or "")) for t in texts))
    rows = build_index(docs, facts, shard=300).collect()
    assert sum(len(r["docs"]) for r in rows) == len(texts)
    items = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "item_id bigint, text string")
    assert [len(asked) for asked, _ in query_batches(items, terms=2)] == [1, 1]
    index = build_index(docs, facts)
    assert search_index(index, facts, items, k=1).count() == 2


# Audit


def fails(text, repeated):
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    flags = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), repeated)
    return {f for f, bad in zip(FILTERS, flags, strict=True) if bad}


def brute_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = [(part or "", fails(text, i is not None and i > first[text or ""]), {k for k in (1, 2) if any(row[0] == i and row[k] == 1 for row in labels if i is not None)}) for i, text, part in docs]
    out = []
    for part in sorted({j[0] for j in judged}):
        own = [j for j in judged if j[0] == part]
        removed_all = dict.fromkeys(FILTERS, 0)
        rows = []
        for order in permutations(FILTERS):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                failing = sum(f in j[1] for j in own)
                left = [j for j in left if f not in j[1]]
                removed_all[f] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(j[1] == {f} for j in own), sum(1 in j[2] for j in gone), sum(2 in j[2] for j in gone), f])
        out += [(*r[:9], removed_all[r[9]]) for r in rows]
    return sorted(out)


def made_documents():
    rng = random.Random(9)
    rows = []
    for i in range(150):
        words = [rng.choice(["un", "deux", "trois", "CAPS", "x", "É"]) + str(rng.randint(0, 400)) for _ in range(rng.choice([3, 99, 100, 150]))]
        text = " ".join(words) + rng.choice(["", " #", " |", "\n"])
        rows.append((i, text, rng.choice(["fr", "de", None])))
    rows += [(200 + k, rows[k % 7][1], "fr") for k in range(40)] + [(None, rows[0][1], "de"), (0, rows[0][1], "de"), (300, None, "nl"), (301, "", "nl"), (302, "\t\x1c ", "nl")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(0, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("spread", [(10**6, 1000, 1 << 16), (0, 10, 7)])
def test_audit_equals_brute_force(spark, spread):
    broadcast_rows, hot, block = spread
    rows, labels = made_documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).selectExpr("*", "1 as part", "2 as bits", "3 as first")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "5 as n")
    found = interaction_audit(docs, told, block=block, broadcast_rows=broadcast_rows, hot=hot)
    assert sorted(map(tuple, found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interaction_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    found = interaction_audit(one, labels).collect()
    assert len(found) == 600 and {r["part"] for r in found} == {""}
    assert all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in found)


def test_bitmaps_hold_each_document_once(spark):
    rows, labels = made_documents()
    docs, told = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    bits = flagged(docs, told)
    index = bitmap_index(bits, block=64)
    held = index.collect()
    assert sum(r["n"] for r in held) == len(rows)
    expected = [r["bits"] for r in bits.collect()]
    for k, name in enumerate(BITMAPS):
        assert sum(int(np.bitwise_count(np.frombuffer(r[name], dtype="<u8")).sum()) for r in held) == sum(b >> k & 1 for b in expected)
    assert prefix_counts(index).count() == 80 * len({r["part"] for r in held})
