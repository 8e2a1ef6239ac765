import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import params
from quarry.functions import scalars as S
from quarry.functions.text import normalize, tokens, trigrams
from quarry.sources import scan


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"a {kind}").select(f(F.col("a")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("24,34", 2434), ("1,003,48", 100348), ("1 234,56", 123456), ("", None), ("NaN", None), ("12d", None), ("Infinity", None), ("0", 0), ("1.005", 100), ("-2,5", -250)],
)
def test_price(spark, value, expected):
    assert one(spark, value, S.price_cents) == expected


@pytest.mark.parametrize(("value", "expected"), [("15/08/2024", dt.date(2024, 8, 15)), ("31/02/2020", None), ("1/2/2020", None), (" 01/01/2020", None), ("", None), (None, None)])
def test_date(spark, value, expected):
    assert one(spark, value, S.date_fr) == expected


def test_lists_and_flags(spark):
    assert one(spark, "65 %;30%", S.percentages) == [65, 30]
    assert one(spark, "", S.percentages) == []
    assert one(spark, "x", S.percentages) is None
    assert one(spark, " a ;; b ;", S.split_multi) == ["a", "b"]
    assert one(spark, None, S.split_multi) == []
    assert one(spark, "inconnu", S.tri_bool) is None
    assert one(spark, "ST", S.nature) == "FT"
    assert one(spark, "4294967296", S.unsigned32) is None
    assert one(spark, "12345678\n", lambda c: S.is_digits(c, 8)) is False


def test_text(spark):
    assert one(spark, "  Éléphant-d'Inde ² Œuvre!", normalize) == "elephant d inde œuvre"
    assert one(spark, "a ß bc", tokens) == ["ß", "bc"]
    assert [bytes.fromhex(x) for x in one(spark, "aaa", trigrams)] == [b"  a", b" aa", b"aaa", b"aa "]
    assert one(spark, "!!!", normalize) == ""


def test_html(spark):
    assert one(spark, "<a&b>", lambda c: S.highlight(c, "<a")) == "<em>&lt;a</em>&amp;b&gt;"
    assert one(spark, "ab", lambda c: S.highlight(c, "abc")) == "ab"
    assert one(spark, "abcdef", lambda c: S.truncate(c, 3)) == "abc…"


def test_scan_pitfalls(spark):
    raw = [("utf", "﻿café\tx\r\n\n\t\t\nlast".encode()), ("west", "caf\xe9 \x93q\x94\n".encode("latin-1")), ("none", b"")]
    files = spark.createDataFrame(raw, "name string, content binary").withColumn("text", scan.decode(F.col("content")))
    got = {(r["name"], r["line_no"]): r["fields"] for r in scan.lines(files).collect()}
    assert got == {("utf", 1): ["café", "x"], ("utf", 4): ["last"], ("west", 1): ["café “q”"]}
    facts = {r["name"]: (r["n"], r["e"]) for r in files.select("name", scan.line_count(F.col("text")).alias("n"), scan.line_ending(F.col("text")).alias("e")).collect()}
    assert facts == {"utf": (4, "mixed"), "west": (1, "lf"), "none": (0, "none")}


def test_cursor():
    assert S.decode_cursor(S.encode_cursor(40, "abcdefghij"), "abcdefghij") == 40
    assert S.decode_cursor("", "v") == 0
    with pytest.raises(S.StaleCursorError):
        S.decode_cursor(S.encode_cursor(40, "abcdefghij"), "zzz")
    for bad in ("%%%", "e30", S.encode_cursor(-1, "v")):
        with pytest.raises(S.CursorError):
            S.decode_cursor(bad, "v")


def test_parameters():
    assert params.limit(None) == 20 and params.limit("7") == 7
    for bad in ("0", "101", "x", "1.5", "٣"):
        with pytest.raises(params.ParameterError):
            params.limit(bad)
    assert params.boolean("TRUE") is True and params.boolean("") is None
    assert params.sections("all", ("a", "b")) == ("a", "b")
    with pytest.raises(params.ParameterError):
        params.sections("c", ("a", "b"))
    with pytest.raises(params.ParameterError):
        params.query_text("é" * 101)


def test_every_character_is_folded(spark):
    """Characters that Unicode 3.2 already had, as Java's and Python's tables differ in newer ones."""
    import unicodedata

    from quarry.functions.text import normalize

    known = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Co") and unicodedata.category(c) == unicodedata.ucd_3_2_0.category(c)]

    def plain(text):
        kept = "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn")
        words = "".join(x.lower() if unicodedata.category(x)[0] == "L" or unicodedata.category(x) == "Nd" else " " for x in kept)
        return " ".join(words.split(" ")).strip() if words.strip() else ""

    rows = spark.createDataFrame([(c, f"x{c}x") for c in known], "c string, t string").select("c", normalize(F.col("t")).alias("n")).collect()
    import re

    wrong = [hex(ord(r["c"])) for r in rows if r["n"] != re.sub(" +", " ", plain(f"x{r['c']}x"))]
    assert len(rows) > 90_000 and wrong == []


def test_etag_parameters(spark):
    from quarry.functions.scalars import normalized_params

    of = lambda **k: spark.range(1).select(normalized_params(F.create_map(*[F.lit(x) for p in k.items() for x in p])).alias("p")).first()["p"]
    assert of(q="x", limit="20", utm="1") == of(q=" x ", page="2") == "q=x"
    assert of(sort="date_amm", limit="5", q="  ") == "limit=5&sort=date_amm"
