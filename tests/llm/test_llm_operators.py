"""Operators on small tables, against brute force, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, kernels, language, licenses, media, packing, quality, tokens, toxicity, urlfilter, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "   \n\t", "one", "Étre École ﬁn", "\x00\x1f", "日本語 テキスト", "x" * 30_000, "a " * 20_000]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Tokens and packing


def test_tokens_agree():
    coder = tokens.Encoder()
    texts = [t or "" for t in ODD] + ["It's <|endoftext|> x", "DON'T ''s !'s ½²3 45", "'sabc a'll'd'x don't! 'velo", "İstanbul ΣΑΣ straße", "tab\tnbsp\xa0x"]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert got == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, (2049, 1100, 700, 300)[seed], 1500)
    bins = packing.pack_lengths(lengths)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 2048 and fill.min() > 0
    assert len(fill) <= np.ceil(lengths.sum() / 2048) * 1.12 + 1


def test_pack(spark):
    rng = random.Random(1)
    texts = ODD + [sentence(rng, rng.randrange(1, 900)) for _ in range(60)] + ["same text"] * 5
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["twice"], 0)).withColumn("length", F.lit("clash"))
    pieces = packing.pieces(docs).cache()
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc")), group=40).toPandas()
    assert len(packed) == pieces.count()
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    coder = tokens.Encoder()
    for i in (0, 3, 7, 8):
        ids = coder.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        own = packed[(packed["doc_id"] == i)].sort_values("start")
        own = own[own["crc"].isin([zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)])]
        assert own["length"].sum() >= len(ids)
    assert packing.pack(pieces.limit(0).select("doc_id", "piece", "start", "length")).count() == 0


# Jaccard join


def components_of(texts, ids, size, num, den):
    sets = []
    for t in texts:
        w = spaced(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, sets, strict=True):
            for b, y in zip(ids, sets, strict=True):
                if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_jaccard(spark, monkeypatch, size, num, den):
    monkeypatch.setattr(jaccard, "PAIRS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 60)
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(5):
        base = sentence(rng, 120).split()
        for _ in range(rng.randrange(1, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    texts += [sentence(rng, 40) + " " + sentence(random.Random(9), 30) for _ in range(12)] + ["ONE"] * 3
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets, label = components_of(texts, order, size, num, den)
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(order, texts, strict=True)], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(docs, size, num, den).collect()}
    assert got == {i: (len(s), label[i]) for i, s in zip(order, sets, strict=True)}


def test_jaccard_ids(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "p q r s"), (5, "a b c d"), (9, "p q r s"), (None, "a b c d"), (7, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.ngram_jaccard_join(docs).collect()), key=str)
    assert got == sorted([(7, 5), (7, 5), (7, 5), (5, 5), (9, 5), (None, None)], key=str)
    assert jaccard.ngram_jaccard_join(docs.limit(0)).count() == 0
    assert jaccard.near_duplicate_survivors(docs).columns == ["doc_id", "text"]


# Decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    items = [sentence(rng, n, 60) for n in (25, 40, 10, 4, 1)] + ["", None]
    items.append(items[0])
    texts = ODD + [sentence(rng, 80, 60) for _ in range(40)] + [f"{sentence(rng, 9)} {items[k % 3]} {sentence(rng, 5)}".upper() for k in range(9)]
    docs = docs_of(spark, texts).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for blocks in (decontaminate.BLOCK_WORDS, 60):
        found = decontaminate.with_matches(docs, bench, "m", block_words=blocks).withColumn("n_hit", decontaminate.n_hit("m")).collect()
        for r in found:
            w, hit, own = alnum(texts[r["doc_id"]]), set(), set()
            for i, item in enumerate(items):
                v = alnum(item)
                k = min(10, len(v))
                windows = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
                for p in range(len(w) - k + 1 if k else 0):
                    if tuple(w[p : p + k]) in windows:
                        hit |= set(range(p, p + k))
                        own.add(str(i))
            assert (r["m"]["n_words"], r["n_hit"], sorted(r["m"]["items"])) == (len(w), len(hit), sorted(own))
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)


# Classifiers


def test_quality(spark):
    rng = random.Random(2)
    good = [sentence(rng, 120) + "." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, 120).split()) for _ in range(120)]
    docs = docs_of(spark, good + bad + ODD).withColumn("score", F.lit(3)).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(docs, labels)
    rows = docs.select("doc_id", model.column("text").alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] < 240 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["p"] >= 0.7) == (r["doc_id"] < 120) for r in held]) > 0.95
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert quality.train_quality(docs, labels.limit(0)).scores([b"", b"x"]).tolist() == [0.5, 0.5]


def test_toxicity(spark):
    rng = random.Random(4)
    clean = [sentence(rng, 90) for _ in range(150)]
    toxic = [" ".join(w + (" idiot" if rng.random() < p else "") for w in sentence(rng, 90).split()) + " moron" for p in [0.01, 0.2] * 60]
    docs = docs_of(spark, clean + toxic + ODD).withColumn("severity", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, int(i >= 150)) for i in range(270)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert (np.diff(model.threshold) > 0).all()
    rows = {r["doc_id"]: r["t"] for r in docs.select("doc_id", model.column("text").alias("t")).collect()}
    assert np.mean([(rows[i]["p_toxic"] >= 0.5) == (i >= 150) for i in range(270)]) > 0.97
    assert np.mean([rows[i]["severity"] for i in range(151, 270, 2)]) > np.mean([rows[i]["severity"] for i in range(150, 270, 2)])
    kept = toxicity.toxicity_filter(docs, labels)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    assert toxicity.toxicity_filter(docs, labels.limit(0)).count() == docs.count()


def test_languages(spark):
    rng = random.Random(6)
    words = {"de": ["der", "und", "nicht", "schaft", "über"], "fr": ["le", "être", "pour", "quelle", "eaux"], "es": ["el", "años", "ción", "para", "los"]}
    rows = [(k * 60 + i, " ".join(rng.choice(words[lang]) for _ in range(25)), lang) for k, lang in enumerate(words) for i in range(60)]
    rows += [(1000 + i, t, None) for i, t in enumerate([*ODD, "123 !?"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language.train_languages(docs)
    got = {r["doc_id"]: r["l"] for r in docs.select("doc_id", model.column("text").alias("l")).collect()}
    assert all(got[i]["lang"] == lang for i, _, lang in rows if lang)
    assert got[1000]["lang"] == got[1001]["lang"] == got[1009]["lang"] == "und" and all(0 <= v["score"] <= 1 for v in got.values())
    empty = language.train_languages(docs.limit(0))
    assert {r["l"]["lang"] for r in docs.select(empty.column("text").alias("l")).collect()} == {"und"}


def test_segmentations():
    lattice = language.Lattice()
    table = np.random.default_rng(0).random((lattice.size, 2))
    table[0] = 0
    word = "▁theres"
    number = {(i, j): n[0] for i, j, n in lattice.numbers(np.array([[ord(c) for c in word]], dtype=np.uint32))}

    def total(i):
        return np.ones(2) if i == len(word) else sum((table[number[i, j]] * total(j) for j in range(i + 1, len(word) + 1) if number.get((i, j))), np.zeros(2))

    alpha, _ = language._forward(lattice, np.array([[ord(c) for c in word]], dtype=np.uint32), table)
    assert np.allclose(alpha[-1, 0], total(0))


# Media


def test_films(spark):
    docs = docs_of(spark, [*ODD, "ab" * 3000 + "\x00" * 3000 + "zq" * 3000]).withColumn("payload", F.lit(0))
    rows = docs.select("doc_id", media.film_column("text").alias("m")).withColumn("b", media.read_column("m")).collect()
    for r in rows:
        text = (dict(enumerate([*ODD, "ab" * 3000 + "\x00" * 3000 + "zq" * 3000]))[r["doc_id"]] or "").encode()
        assert bytes(r["b"]["payload"]) == text + b"\xff" * (-len(text) % 576 if text else 576)
        clips = r["b"]["clips"]
        assert clips[0]["first"] == 0 and all(a["last"] + 1 == b["first"] for a, b in zip(clips, clips[1:], strict=False))
    assert len(rows[-1]["b"]["clips"]) >= 2
    noise = np.random.default_rng(1).integers(0, 256, 576 * 9, dtype=np.uint8).tobytes()
    assert media.samples_of(media.film([noise, b"\xff" * 576]))[0].tobytes() == noise
    for broken in (b"", b"RIFF", b"x" * 100):
        with pytest.raises(ValueError):
            media.frames_of(broken)


# Licences, URLs, WARC


def licence_brute(texts):
    """labels of each text, by its definition."""
    words = [alnum(t) for t in texts]
    counts = Counter(w for ws in words for w in set(ws))
    rare = licenses.rare_words(counts)
    out = []
    for ws in words:
        labels = set()
        for t, own in zip(licenses.TEMPLATES, rare, strict=True):
            top = [w for w in own if w in ws][: licenses.LOOKED_UP]
            votes = {}
            for at, w in enumerate(ws):
                for p, x in enumerate(t.words):
                    if x == w and w in top and at >= p:
                        votes.setdefault(at - p, set()).add(w)
            stands = lambda s, p: any(s + k >= 0 and ws[s + k : s + k + len(p.split())] == p.split() for k in range(licenses._offset(t, p) - t.slack, licenses._offset(t, p) + t.slack + 1))  # noqa: B023, E731
            if any(len(v) >= min(licenses.AGREE, len(own)) and all(stands(s, p) for p in t.phrases) for s, v in votes.items()):
                labels.add(t.label)
        out.append(",".join(sorted(labels)))
    return out


def test_licences(spark):
    mit, gpl = next(t.text for t in licenses.TEXTS if t.label == "mit"), next(t.text for t in licenses.TEXTS if t.label == "gpl")
    changed = mit.replace("associated documentation", "its own associated documentation").replace("merge", "")
    long = " ".join(["mit license filler"] * 20_000)
    texts = [*ODD, "The MIT License; mit license", "GNU Lesser General Public License, Apache License", "mit the license", mit, "x " * 30 + changed.upper(), mit[:120], "Kit mit licenKse", gpl + " and " + mit, gpl.replace("redistribute", "sell"), "mit license " + gpl, long, "software license the"]
    n = len(ODD)
    rows = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts).withColumn("words", F.lit(1)).withColumn("index", F.lit(2))).collect()}
    for i, t in enumerate(texts):
        w = alnum(t)
        places = [a for b in licenses.BASE for a in range(len(w)) if w[a : a + len(b.words)] == b.words]
        assert (rows[i]["n_words"], rows[i]["n_base"], rows[i]["first_word"], rows[i]["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert [rows[i]["labels"] for i in range(len(texts))] == licence_brute(texts)
    assert [rows[n + k]["labels"] for k in range(12)] == ["mit", "apache,gpl,lgpl", "", "mit", "mit", "", "", "gpl,mit", "gpl", "gpl,mit", "mit", ""]
    assert rows[n + 1]["base_labels"] == "apache,gpl" and 0 < rows[n + 3]["score"] <= 1 and rows[0]["score"] == 0
    assert licenses.scan(docs_of(spark, ["x"]).limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "mit license"), (None, "mit license"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_base"] for r in licenses.scan(twice).collect()) == [0, 1, 1]


def test_url_filter(spark):
    entries = spark.createDataFrame([("example.com", "block", 10), ("example.com", "remove", 20), ("example.com", "block", 30), ("good.example.com", "allow", 35), ("example.com", "block", 30), (None, "block", 1), ("x.org", "block", None)], "pattern string, action string, since long")
    urls = [("http://User@WWW.example.com:80/a", 5), ("http://www.example.com", 10), ("http://www.example.com", 19), ("http://www.example.com", 20), ("http://a.good.example.com/", 34), ("http://a.good.example.com/", 35), ("http://notexample.com", 12), (None, 12), ("nonsense", 12), ("http://example.com", None)]
    captures = spark.createDataFrame([(i, u, t, "x") for i, (u, t) in enumerate(urls)], "page_id long, url string, fetched_at long, line string")
    for most in (urlfilter.BROADCAST_HOSTS, 0):
        rows = sorted(urlfilter.filter_captures(captures, entries, broadcast_hosts=most).collect(), key=lambda r: r["page_id"])
        assert [r["blocked"] for r in rows] == [False, True, True, False, True, False, False, False, False, False]
        assert (rows[5]["rule"], rows[5]["valid_from"], rows[5]["valid_to"]) == ("good.example.com", 35, None) and rows[1]["valid_to"] == 20
    assert urlfilter.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0
    named = captures.withColumn("Rule", F.lit(7)).withColumn("captured_rule", F.lit(8)).withColumn("host", F.lit("h"))
    row = urlfilter.filter_captures(named, entries).where("page_id = 5").first()
    assert (row["captured_Rule_"], row["captured_rule"], row["captured_host"], row["rule"], row["host"]) == (7, 8, "h", "good.example.com", "a.good.example.com")


def test_url_filter_of_long_lists(spark):
    """Frequent domains, listed or not, give what a small list's broadcast gives, and what a scan of the list gives."""
    hosts = [f"h{i}.s{i % 5}.example.com" for i in range(60)] + [f"h{i}.com" for i in range(20)]
    entries = [(f"s{i}.example.com", ("block", "remove")[k % 2], 10 * k + i) for i in range(3) for k in range(4)] + [("example.com", "allow", 25), ("h3.com", "block", 1), ("h7.s2.example.com", "allow", 5)]
    captures = spark.createDataFrame([(i, f"http://{h}/", i * 7 % 50) for i, h in enumerate(hosts)], "page_id long, url string, fetched_at long")
    listed = spark.createDataFrame(entries, "pattern string, action string, since long")
    brute = {}
    for i, h in enumerate(hosts):
        held = {}
        for p, a, t in sorted(entries, key=lambda e: e[2]):
            if t <= i * 7 % 50 and (h == p or h.endswith("." + p)):
                held[p] = a
        held = {p: a for p, a in held.items() if a != "remove"}
        rule = max(held, key=len, default=None)
        brute[i] = (held.get(rule) == "block", rule)
    for entries_bound, share in ((100, 10), (0, 1), (0, 7), (0, 1000)):
        rows = urlfilter.filter_captures(captures, listed, broadcast_entries=entries_bound, domain_share=share).collect()
        assert len(rows) == len(hosts) and {r["page_id"]: (r["blocked"], r["rule"]) for r in rows} == brute


def test_reachable():
    offset = np.array([0, 10, 15, 30, 44])
    assert warc.reachable(offset, np.array([30, 15, 30, 44, 60])).tolist() == [True, False, False, True, True]
    assert warc.reachable(offset, np.array([12, 15, 30, 44, 60])).tolist() == [True, False, False, False, False]
    assert warc.reachable(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_warc(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    html = [None, "", "<p>é</p>", "<p>é</p>", magic, "x" + magic + magic + "y", magic, "\r\n\r\nWARC/1.1\r\n", "plain", "<p>é</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i} \r\n", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, first string")
    rows = {r["page_id"]: r for r in warc.page_records(pages).collect()}
    assert len(rows) == len(html)
    smallest = {}
    for i, h in enumerate(html):
        smallest.setdefault(h or "", i)
    for i, h in enumerate(html):
        data = (h or "").encode()
        again = smallest[h or ""] != i
        assert tuple(rows[i]) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", smallest[h or ""] if again else None)
    assert warc.page_records(pages.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (1, "u", "other"), (2, "u", "other"), (2, "u", "same"), (None, "u", "same"), (None, None, "alone"), (None, None, "else")], "page_id long, url string, html string")
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(repeated).collect()), key=str)
    assert kinds == sorted([(1, "response", None, 4), (1, "response", None, 4), (1, "response", None, 5), (2, "revisit", 1, 5), (2, "revisit", 1, 4), (None, "revisit", 1, 4), (None, "response", None, 5), (None, "response", None, 4)], key=str)


def test_warc_of_frequent_pieces(spark, monkeypatch):
    """Records that share their pieces, each of which meets one copy of a value, over archives read whole or by name."""
    magic = "WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    pages = spark.createDataFrame([(i, "u", f"{i}{magic * 3}{'tail' * (i % 2)}" if i % 4 else "plain") for i in range(40)], "page_id long, url string, html string").repartition(3)
    expected = sorted((r["page_id"], base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode()) for r in pages.collect())
    for share, groups, files in ((1, 0, 0), (7, 0, 1000), (7, 200_000, 1)):
        monkeypatch.setattr(warc, "SHARE", share)
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
        monkeypatch.setattr(warc, "FILES", files)
        assert sorted((r["page_id"], r["payload_digest"]) for r in warc.page_records(pages).collect()) == expected


def test_warc_reads_may_be_split_differently(spark, tmp_path):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    pages = spark.createDataFrame([(i, "u", f"{i} {magic * (i % 3)} {'z' * (i * 37 % 200)}") for i in range(60)], "page_id long, url string, html string").coalesce(2)
    warc.write_archives(pages, f"file://{tmp_path}/archives")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        records = warc.read_archives(spark, f"file://{tmp_path}/archives")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        found = {r["id"]: r["payload_sha1"] for r in records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {f"<urn:page:{r['page_id']}>": hashlib.sha1(r["html"].encode()).hexdigest() for r in pages.collect()}


def test_words_of_bytes():
    for text in ODD:
        data = [(text or "").encode(), b"zz top"]
        for rule, plain in ((kernels.SPACED, spaced), (kernels.ALNUM, alnum)):
            assert kernels.Words(data, rule).counts().tolist() == [len(plain(text)), 2]
