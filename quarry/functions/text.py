"""Text normalisation, tokens and character trigrams as native columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, which trim() alone doesn't cover.
BLANK_ENDS = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, BLANK_ENDS, "")


#: Hangul syllables, by the rule of the Unicode standard: first syllable, and the first of their leading, middle and trailing letters with their numbers.
_SYLLABLES, _LEADING, _MIDDLE, _TRAILING = (0xAC00, 11172), (0x1100, 19), (0x1161, 21), (0x11A7, 28)


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters of all planes whose decomposition without marks is one other character, and that character; and letters that become several."""
    source, target, several = [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or _SYLLABLES[0] <= code < sum(_SYLLABLES):
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
        elif len(base) > 1 and unicodedata.category(chr(code))[0] == "L":
            several.append((chr(code), base))
    return "".join(source), "".join(target), tuple(several)


def _syllables(c: Column) -> Column:
    """Text with every Hangul syllable as its letters."""
    letters = lambda first, n: F.array(*[F.lit(chr(first + i)) for i in range(n)])
    lead, middle, trail = letters(*_LEADING), letters(*_MIDDLE), letters(*_TRAILING)
    first, last = chr(_SYLLABLES[0]), chr(_SYLLABLES[0] + _SYLLABLES[1] - 1)

    def split(x: Column) -> Column:
        at = F.ascii(x) - _SYLLABLES[0]
        parts = F.concat(F.get(lead, F.floor(at / 588).cast("int")), F.get(middle, F.floor(at % 588 / 28).cast("int")), F.when(at % 28 > 0, F.get(trail, (at % 28).cast("int"))).otherwise(""))
        return F.when(x.between(first, last), parts).otherwise(x)

    # Only texts that hold one are taken apart.
    return F.when(c.rlike(f"[{first}-{last}]"), F.array_join(F.transform(F.split(c, ""), split), "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Accents dropped, lower case, runs of other than letters and decimal digits as one blank, trimmed."""
    source, target, several = _folds()
    folded = _syllables(c)
    for letter, letters in several:
        folded = F.replace(folded, F.lit(letter), F.lit(letters))
    # Only texts with other than ASCII characters hold what is folded.
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(folded, source, target), r"\p{Mn}+", "")).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{Nd}]+", " "))


def tokens(c: Column) -> Column:
    """Normalised words of at least two bytes, in order."""
    return F.filter(F.split(normalize(c), " "), lambda t: F.octet_length(t) >= 2)


def trigrams(token: Column) -> Column:
    """Byte trigrams of a token padded by two blanks before and one behind, repeats kept, as hexadecimal text."""
    padded = F.encode(F.concat(F.lit("  "), token, F.lit(" ")), "UTF-8")
    return F.transform(F.sequence(F.lit(1), F.octet_length(token) + 1), lambda i: F.hex(F.substr(padded, i, F.lit(3))))


def idf(rows: Column, count: Column) -> Column:
    return F.ln(1 + (rows - count + 0.5) / (count + 0.5))
