"""Queries over the whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.arrowfile import token_files
from quarry.llm.audit import interaction_audit, order_steps
from quarry.llm.common import held_out, table
from quarry.llm.decontaminate import n_hit, with_matches
from quarry.llm.jaccard import ngram_jaccard_join
from quarry.llm.language import train_languages
from quarry.llm.licenses import scan, scan_sql
from quarry.llm.media import FRAME, film_column, read_column
from quarry.llm.packing import pack, pieces
from quarry.llm.quality import GOOD, train_quality
from quarry.llm.toxicity import TOXIC, train_toxicity
from quarry.llm.urlfilter import filter_captures, host_of
from quarry.llm.wand import ranked_search
from quarry.llm.warc import page_records


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    cutting = pieces(table(spark, sf_dir, "documents"))
    return pack(cutting.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column("text").alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def _number(column: str, first: int) -> Column:
    """28 bits of a text's MD5 as a number: dates of the example list and fetch times hang on it."""
    return F.conv(F.substring(F.md5(column), first, 7), 16, 10).cast("bigint")


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list, at its fetch time.

    The tables have neither, so both are derived from the pages: a fetch time
    in 2024 by URL, and entries by host: blocks of sites (three labels), some
    lifted later, and exceptions for hosts below them.
    """
    year, day = 366 * 86400, 86400
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(1704067200) + _number("url", 1) % year)
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    sites = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    at = F.lit(1704067200) + _number("pattern", 1) % 300 * day
    entries = (
        sites.where(_number("pattern", 8) % 3 == 0).select("pattern", F.lit("block").alias("action"), at.alias("since"))
        .unionByName(sites.where(_number("pattern", 8) % 6 == 0).select("pattern", F.lit("remove").alias("action"), (at + (_number("pattern", 15) % 60 + 1) * day).alias("since")))
        .unionByName(hosts.withColumnRenamed("host", "pattern").where(_number("pattern", 8) % 5 == 0).select("pattern", F.lit("allow").alias("action"), (at + 30 * day).alias("since")))
    )
    return filter_captures(captures, entries)


OP5_SQL = r"""
with n as (select page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1), '\.+$', ''), '') as host,
  1704067200 + cast('0x' || substr(md5(url), 1, 7) as bigint) % (366 * 86400) as fetched_at from pages),
h as (select distinct host as pattern from n where host is not null),
t as (select distinct regexp_extract(pattern, '([^.]+\.[^.]+\.[^.]+)$', 1) as pattern from h where regexp_matches(pattern, '[^.]+\.[^.]+\.[^.]+$')),
k as (select pattern, 't' as kind from t union all select pattern, 'h' as kind from h),
x as (select pattern, kind, 1704067200 + cast('0x' || substr(md5(pattern), 1, 7) as bigint) % 300 * 86400 as day0,
  cast('0x' || substr(md5(pattern), 8, 7) as bigint) as b, cast('0x' || substr(md5(pattern), 15, 7) as bigint) as c from k),
e as (select pattern, 'block' as action, day0 as since from x where kind = 't' and b % 3 = 0
  union all select pattern, 'remove', day0 + (c % 60 + 1) * 86400 from x where kind = 't' and b % 6 = 0
  union all select pattern, 'allow', day0 + 30 * 86400 from x where kind = 'h' and b % 5 = 0),
i as (select *, lead(since) over (partition by pattern order by since, action) as until from (select distinct * from e)),
v as (select * from i where (until is null or since < until) and action in ('block', 'allow')),
m as (select n.page_id, n.url, n.fetched_at, n.host, v.*, row_number() over (partition by n.page_id order by length(v.pattern) desc nulls last) as r
  from n left join v on (n.host = v.pattern or n.host like '%.' || v.pattern) and v.since <= n.fetched_at and (v.until is null or n.fetched_at < v.until))
select page_id, url, fetched_at, host, coalesce(action = 'block', false) as blocked, pattern as rule, since as valid_from, until as valid_to from m where r = 1
"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a film, read back, with its shots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), film_column("text").alias("media"))
    back = docs.withColumn("back", read_column("media"))
    payload, media = F.col("back.payload"), F.col("media")
    size = F.octet_length(payload)
    shots = F.transform("back.clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string")))
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length(media).cast("bigint").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        F.concat(F.lit("frames="), (size / FRAME).cast("int").cast("string"), F.lit(";shots="), F.size("back.clips").cast("string"), F.lit(";clips_ms="), F.array_join(shots, ",")).alias("feature"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases in every document."""
    return scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back."""
    return page_records(table(spark, sf_dir, "pages"))


OP8_SQL = """
with d as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((cast('0x' || substr(h, 1 + 10 * (i // 8), 10) as bigint) >> cast(35 - 5 * (i % 8) as bigint)) & 31) as bigint), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of the benchmark, and the items they belong to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark"), "found")
    hit = n_hit("found")
    items = F.array_sort(F.col("found.items"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(F.col("found.spans")) > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, 0 to 3, and whether it counts as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column("text").alias("t"))
    return found.select("doc_id", "held_out", F.col("t.severity").alias("severity"), F.col("t.p_toxic").alias("p_toxic"), F.col("t.grade").alias("grade"), (F.col("t.p_toxic") >= TOXIC).alias("toxic"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Arrow files of equal-length sequences, read back."""
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all orders, by language."""
    return interaction_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda a: a <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select doc_id as x, doc_id as y from s union select r.x, p.y from r join p on r.y = p.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.y) as component_id from s join r on r.x = s.doc_id group by s.doc_id, len(s.s)
"""

OP9_SQL = rf"""
with w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda a: a <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda a: a <> '') as w from benchmark),
g as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as g
  from (select *, least(10, len(w)) as k from b) where k > 0),
d as (select doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'g': array_to_string(w[i : i + k - 1], ' ')}})) as p
  from w, (select distinct k from g) where len(w) >= k),
h as (select d.doc_id, d.k, d.p.i as i, g.item_id from d join g on g.g = d.p.g and g.k = d.k),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as items from h group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from w left join c using (doc_id) left join t using (doc_id)
"""

OP12_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
n as (select count(*) filter (len(w) > 0) as n, cast(coalesce(sum(len(w)), 0) as bigint) as l from d),
q as (select q, any_value(item_id) as item_id, g, count(*) as reps from (select row_number() over () as q, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as g from benchmark) group by q, g),
p as (select r, any_value(doc_id) as doc_id, g, count(*) as tf, any_value(len(w)) as n from (select r, doc_id, w, unnest(w) as g from d) where g in (select g from q) group by r, g),
f as (select g, cast(floor(1000 * ln((2 * any_value(n.n) + 2) / (2 * count(*) + 1))) as bigint) as weight from p, n group by g),
s as (select q.q, any_value(q.item_id) as item_id, p.r, any_value(p.doc_id) as doc_id,
  cast(sum(q.reps * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * n.n) // n.l)))) as bigint) as score
  from q join p using (g) join f using (g), n group by q.q, p.r)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""

_FAILS = """list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') as w, coalesce(text, '') as t"""
OP13_SQL = f"""
with x as (select doc_id, coalesce(lang, '') as part, {_FAILS} from documents),
e as (select *, min(doc_id) over (partition by t) as first from x),
l as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
m as (select part, cast(len(w) < 100 as int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as int) + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as int)
  + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > first, false) as int) as bits,
  count(*) as n, count_if(coalesce(good, false)) as good, count_if(coalesce(toxic, false)) as toxic from e left join l using (doc_id) group by 1, 2),
s(filter_order, step, before, filter) as (values {', '.join(f"('{o}', {i}, {b}, '{f}')" for o, i, b, f in order_steps())}),
c as (select part, filter_order, step, before, filter, 1 << (ascii(filter) - 65) as bit, bits, n, good, toxic from s, m),
r as (select part, filter_order, step, filter, sum(case when bits & (before | bit) = 0 then n else 0 end) as kept, sum(case when bits & before = 0 and bits & bit > 0 then n else 0 end) as removed,
  sum(case when bits & before > 0 and bits & bit > 0 then n else 0 end) as redundant, sum(case when bits = bit then n else 0 end) as unique_fails,
  sum(case when bits & before = 0 and bits & bit > 0 then good else 0 end) as good_lost, sum(case when bits & before = 0 and bits & bit > 0 then toxic else 0 end) as toxic_lost from c group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_quality": op2_quality,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language": op4_language,
    "op5_urlfilter": op5_urlfilter,
    "op6_media": op6_media,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_tokens": op11_tokens,
    "op12_search": op12_search,
    "op13_audit": op13_audit,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": OP3_SQL,
    "op5_urlfilter": OP5_SQL,
    "op7_licenses": scan_sql(),
    "op8_warc": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op12_search": OP12_SQL,
    "op13_audit": OP13_SQL,
}
