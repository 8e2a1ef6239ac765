"""Scalar parsers and formatters. A bad value is null; which inputs are bad is told by the caller's rule."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import trim_all

#: Shortage states by code, with slug and label.
SHORTAGE = {
    1: ("rupture_stock", "Rupture de stock"),
    2: ("tension_approvisionnement", "Tension d'approvisionnement"),
    3: ("arret_commercialisation", "Arrêt de commercialisation"),
    4: ("remise_disposition", "Remise à disposition"),
}
#: Roles in a group of generics, in stored data and in responses.
GENERIC_TYPE = {0: "princeps", 1: "générique", 2: "par complémentarité posologique", 4: "substituable"}
GENERIC_VIEW = {0: "princeps", 1: "générique", 2: "générique par complémentarité posologique", 4: "générique substituable"}
#: Fixed value: shortage start dates before this day are approximate.
APPROXIMATE_BEFORE = "2023-10-06"


def lookup(c: Column, table: dict) -> Column:
    """A small fixed table as CASE; null for other keys."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out


def null_if_blank(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def _date(c: Column, pattern: str, form: str) -> Column:
    return F.when(c.rlike(pattern), F.to_date(F.try_to_timestamp(c, F.lit(form))))


def date_fr(c: Column) -> Column:
    """dd/MM/yyyy, strictly."""
    return _date(c, r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z", "dd/MM/yyyy")


def date_fr_optional(c: Column) -> Column:
    return date_fr(null_if_blank(c))


def date_compact(c: Column) -> Column:
    return _date(c, r"\A[0-9]{8}\z", "yyyyMMdd")


def price_cents(c: Column) -> Column:
    """Cents of a price such as 24,34 or 1,003,48: the last of several commas is the decimal point."""
    plain = F.replace(F.regexp_replace(F.replace(trim_all(c), F.lit(" "), F.lit("")), r",(?=.*,)", ""), F.lit(","), F.lit("."))
    numeric = plain.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(numeric, F.round(plain.try_cast("double") * 100, 0).try_cast("int"))


def percentages(c: Column) -> Column:
    """Whole percentages of a list such as 65 %;30%; empty parts are left out, a bad part makes null."""
    parts = F.transform(split_multi(c), lambda x: trim_all(F.regexp_replace(x, r"%\z", "")))
    numbers = F.transform(parts, lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("int")))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def rates(c: Column) -> Column:
    """Percentages from 0 to 100, ascending."""
    return F.array_sort(F.filter(c, lambda x: x.between(0, 100)))


def split_multi(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), trim_all), lambda x: x != "")


def yes_no(c: Column) -> Column:
    return lookup(trim_all(c), {"Oui": True, "Non": False})


def tri_bool(c: Column) -> Column:
    return lookup(trim_all(c), {"oui": True, "non": False})


def https(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), "^http://", "https://")


def nature(c: Column) -> Column:
    return lookup(trim_all(c), {"SA": "SA", "FT": "FT", "ST": "FT"})


def roman_level(c: Column) -> Column:
    return lookup(trim_all(c), {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5})


def is_digits(c: Column, n: int) -> Column:
    return c.rlike(rf"\A[0-9]{{{n}}}\z")


def unsigned32(c: Column) -> Column:
    """ASCII digits, at most 20, below 2^32."""
    n = F.when(c.rlike(r"\A[0-9]{1,20}\z"), c.try_cast("decimal(20,0)"))
    return F.when(n < 4294967296, n.cast("bigint"))


def to_int32(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-(2**31))), F.lit(2**31 - 1)).cast("int")


def to_uint8(c: Column) -> Column:
    return F.when(c.between(0, 255), c).otherwise(0).cast("int")


def approximate_start(day: Column) -> Column:
    return day < F.lit(APPROXIMATE_BEFORE).cast("date")


def pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def substance_code(c: Column) -> Column:
    """A numeric code without padding; 0 is empty."""
    return F.when(c == 0, "").otherwise(c.cast("string"))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlight(label: Column, query: str) -> Column:
    """The first characters, as many as the query has, emphasised; escaped only if the label is shorter."""
    n = len(query)
    marked = F.concat(F.lit("<em>"), escape_html(F.substring(label, 1, n)), F.lit("</em>"), escape_html(F.substr(label, F.lit(n + 1), F.length(label))))
    return F.when(F.length(label) >= n, marked).otherwise(escape_html(label))


def truncate(c: Column, n: int) -> Column:
    """Texts of more than n bytes end after the characters that fit into n bytes, with an ellipsis."""
    whole = F.filter(F.sequence(F.lit(0), F.least(F.length(c), F.lit(n))), lambda k: F.octet_length(F.substr(c, F.lit(1), k)) <= n)
    return F.when(F.octet_length(c) > n, F.concat(F.substr(c, F.lit(1), F.array_max(whole)), F.lit("…"))).otherwise(c)


#: Day number of an absent date.
NO_DAY = -(2**31)


def day_number(c: Column) -> Column:
    """Days since 1970; an absent date has the smallest number, so that it comes last in falling order."""
    return F.coalesce(F.unix_date(c), F.lit(NO_DAY))


def day_of(c: Column) -> Column:
    """The date of a day number as text; null for an absent one."""
    return F.when(c != NO_DAY, F.date_from_unix_date(c).cast("string"))


def group_order(group: Column) -> list[Column]:
    """Sort keys: numbers of at most nine digits first, by value, then others by text."""
    number = F.when(group.rlike(r"\A[0-9]{1,9}\z"), group.try_cast("bigint"))
    return [number.isNull(), number, group]


#: Parameters that an answer hangs on, and the limit that stands for none.
SEED_PARAMS = ("q", "commercialise", "statut_amm", "procedure_amm", "forme", "voie", "titulaire", "substance", "surveillance", "mitm", "generique", "remboursable", "rupture", "sort", "cursor", "include", "statut", "actives", "cis", "depuis")
DEFAULT_LIMIT = "20"


def normalized_params(request: Column) -> Column:
    """A map of request parameters as text, by name: without blank values, parameters that don't change the answer, and the default limit."""
    limit = lambda k, v: (k == "limit") & (v != DEFAULT_LIMIT)
    kept = F.map_filter(request, lambda k, v: (k.isin(*SEED_PARAMS) | limit(k, v)) & (trim_all(v) != ""))
    pairs = F.array_sort(F.map_entries(kept))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), trim_all(e["value"]))), "&")


def etag(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def status_label(status: Column) -> Column:
    return F.when(status.isin(401, 404, 429, 503), status.cast("string")).otherwise(F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def cursor_column(offset: Column, version: str) -> Column:
    """:func:`encode_cursor` of a column of offsets."""
    text = F.concat(F.lit('{"o":'), offset.cast("string"), F.lit(f',"h":{json.dumps(version[:8])}}}'))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def offset_column(cursor: Column, version: str) -> Column:
    """Offsets of a column of cursors: 0 for empty ones, null for stale and unreadable ones."""
    padded = F.concat(F.translate(cursor, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(cursor), F.lit(4))))
    legal = cursor.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.length(cursor) % 4 != 1)
    text = F.when(legal, F.try_to_binary(padded, F.lit("base64")).cast("string"))
    offset = F.get_json_object(text, "$.o")
    fits = (F.get_json_object(text, "$.h") == version[:8]) & offset.rlike(r"\A[0-9]+\z")
    return F.when(cursor == "", F.lit(0).cast("bigint")).when(fits, offset.try_cast("bigint"))


class CursorError(ValueError):
    """A cursor that can't be read."""


class StaleCursorError(CursorError):
    """A cursor of another version of the data."""


def encode_cursor(offset: int, version: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset, "h": version[:8]}, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, version: str) -> int:
    """The offset of a cursor of this version; an empty cursor is offset 0."""
    if not cursor:
        return 0
    try:
        found = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        offset, held = found["o"], found["h"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("the cursor can't be read") from e
    if not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise CursorError("the cursor's offset isn't valid")
    if held != version[:8]:
        raise StaleCursorError("the data have changed since the cursor was made")
    return offset
