"""Lists, filters, joins, duplicates and aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import params
from quarry.functions import scalars as S
from quarry.functions.text import normalize
from quarry.operators import cron, filters, paging, quality, relations, selection
from quarry.plans.registry import Tables, literal, query, values
from quarry.sources import catalog, scan, snapshot

NORM = "trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


@query("""select p_partkey, p_name, p_brand, p_size from part
where p_size between 10 and 30 and lower(p_type) like '%econ%' and exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)
order by p_name, p_partkey limit 20 offset 5""")
def list_filter_page(t: Tables) -> DataFrame:
    parts = t.part.where(F.col("p_size").between(10, 30) & F.lower("p_type").contains("econ"))
    ordered = relations.member(parts, t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
    return paging.page(ordered.select("p_partkey", "p_name", "p_brand", "p_size"), ["p_name", "p_partkey"], 5, 20)


@query("select count(*) as total, 20 as \"limit\", count(*) > 25 as has_more, case when count(*) > 25 then rtrim(to_base64(encode('{\"o\":25,\"h\":\"v1\"}')), '=') end as next_cursor, 'v1' as dataset_version from part where p_size <= 20")
def list_meta(t: Tables) -> DataFrame:
    return paging.meta(t.part.where("p_size <= 20"), 5, 20, "v1")


@query("select d.doc_id, l.toxic = 1 as flag from documents d left join labels l using (doc_id) where (l.quality = 1) = true")
def filter_bool_tristate(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.where(filters.equals_flag(F.col("quality"), 1, True)).select("doc_id", (F.col("toxic") == 1).alias("flag"))


_STATES = {"F": "archivee", "O": "active", "P": "suspendue"}


@query("select o_orderkey, case o_orderstatus when 'O' then 'Autorisation active' else 'Autorisation suspendue' end as statut from orders where o_orderstatus in ('O', 'P')")
def filter_enum_map(t: Tables) -> DataFrame:
    labels = S.lookup(F.col("o_orderstatus"), {k: filters.AUTHORISATION[v] for k, v in _STATES.items()})
    wanted = [params.enum(name, filters.AUTHORISATION) for name in ("ACTIVE", " suspendue ")]
    return t.orders.select("o_orderkey", labels.alias("statut")).where(F.col("statut").isin(*wanted))


@query("select c_custkey, c_mktsegment from customer where lower(c_mktsegment) = lower('Building')")
def filter_ci_equals(t: Tables) -> DataFrame:
    return t.customer.where(filters.equals_ignoring_case(F.col("c_mktsegment"), "Building")).select("c_custkey", "c_mktsegment")


@query("select p_partkey from part where list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), 'widget')")
def filter_array_any(t: Tables) -> DataFrame:
    return t.part.where(filters.any_equals(F.split("p_name", " "), "Widget")).select("p_partkey")


@query(f"select doc_id from documents where {NORM.format('text')} like '%' || {NORM.format("'Étre'")} || '%'")
def filter_norm_contains(t: Tables) -> DataFrame:
    return t.documents.where(filters.norm_contains(F.col("text"), "Étre")).select("doc_id")


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_discount > 0.08)")
def filter_semi(t: Tables) -> DataFrame:
    return relations.member(t.part.select("p_partkey"), t.lineitem.where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_discount > 0.08)")
def filter_anti(t: Tables) -> DataFrame:
    return relations.member(t.part.select("p_partkey"), t.lineitem.where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", wanted=False)


@query(f"""select distinct p_partkey from part where exists (select 1 from lineitem join supplier on s_suppkey = l_suppkey
where l_partkey = p_partkey and (cast(s_suppkey as varchar) = '7' or {NORM.format('s_name')} like '%7%' or {NORM.format('s_name')} like '%' || {NORM.format("'00003'")} || '%'))""")
def filter_code_or_name(t: Tables) -> DataFrame:
    wanted = filters.code_or_name(F.col("s_suppkey").cast("string"), F.col("s_name"), "7") | filters.norm_contains(F.col("s_name"), "00003")
    rows = t.lineitem.join(t.supplier.where(wanted).select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return relations.member(t.part.select("p_partkey"), rows.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("select p_brand as brand, max(p_partkey) as last_part from part group by p_brand having max_by(p_size, p_partkey) % 5 in (0, 1)")
def filter_group_role(t: Tables) -> DataFrame:
    role = F.col("p_size") % 5
    last = relations.last_group(t.part, "p_brand", ["p_partkey"], F.struct("p_partkey", role.alias("role")))
    return last.where(F.col("value.role").isin(0, 1)).select(F.col("p_brand").alias("brand"), F.col("value.p_partkey").alias("last_part"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 4 end as code, cast(o_orderdate as date) as day from orders
where o_orderstatus = 'O' and cast(o_orderdate as date) >= date '1996-06-01'""")
def filter_shortages(t: Tables) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    rows = t.orders.select("o_orderkey", code.alias("code_statut"), F.col("o_orderdate").cast("date").alias("date_mise_a_jour"), F.lit(None).cast("date").alias("date_remise_disposition"))
    return filters.shortages(rows, "tension", since="1996-06-01", ties=("o_orderkey",)).select("o_orderkey", F.col("code_statut").alias("code"), F.col("date_mise_a_jour").alias("day"))


DATES = [("15/08/2024", "20240815"), ("1/2/2020", "2020012"), ("31/02/2020", "20200231"), ("", ""), (" 01/01/2020", " 20200101"), ("29/02/2024", "20240229"), (None, None)]


@query(f"""select 'o' || o_orderkey as k, cast(o_orderdate as date) as fr, cast(o_orderdate as date) as optional, cast(o_orderdate as date) as compact from orders
union all select 'x' || coalesce(a, '?') as k, case when regexp_full_match(a, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then cast(try_strptime(a, '%d/%m/%Y') as date) end,
case when regexp_full_match(trim(a), '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then cast(try_strptime(trim(a), '%d/%m/%Y') as date) end,
case when regexp_full_match(b, '[0-9]{{8}}') then cast(try_strptime(b, '%Y%m%d') as date) end from {values(DATES, 'a, b')}""")
def parse_dates(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("k"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("a"), F.date_format("o_orderdate", "yyyyMMdd").alias("b"))
    odd = literal(t.spark, DATES, "a string, b string").select(F.concat(F.lit("x"), F.coalesce("a", F.lit("?"))).alias("k"), "a", "b")
    return rows.unionByName(odd).select("k", S.date_fr(F.col("a")).alias("fr"), S.date_fr_optional(F.col("a")).alias("optional"), S.date_compact(F.col("b")).alias("compact"))


PRICES = [("24,34", 2434), ("1,003,48", 100348), ("1 234,56", 123456), ("", None), ("abc", None), ("NaN", None), ("12d", None), ("0", 0), (" 7.5 ", 750)]


@query(f"""select cast(l_orderkey as varchar) || '-' || l_linenumber as k, sum(cast(round(l_extendedprice * 100) as bigint)) as cents from lineitem group by 1
union all select 'x' || a, cast(b as bigint) from {values(PRICES, 'a, b')}""")
def price_cents(t: Tables) -> DataFrame:
    text = F.replace(F.round("l_extendedprice", 2).cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(","))
    rows = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"), S.price_cents(text).cast("bigint").alias("cents")).groupBy("k").agg(F.sum("cents").alias("cents"))
    odd = literal(t.spark, PRICES, "a string, b int").select(F.concat(F.lit("x"), "a").alias("k"), S.price_cents(F.col("a")).cast("bigint").alias("cents"))
    return rows.unionByName(odd)


PERCENT = [("65%", "65", "65"), ("65 %;30%", "65,30", "30,65"), ("", "", ""), ("x%", None, None), ("100%;120%;0", "100,120,0", "0,100"), ("65 %;", "65", "65"), ("65;;30", "65,30", "30,65"), (";", "", ""), ("6%5", None, None), (" 15 % ; ", "15", "15")]


@query(f"""select a, b as parsed, c as kept from {values(PERCENT, 'a, b, c')}
union all select l_orderkey || '-' || l_linenumber || ': ' || a, a, a from (select l_orderkey, l_linenumber, cast(cast(round(l_discount * 100) as int) as varchar) as a from lineitem group by all)""")
def percent_list(t: Tables) -> DataFrame:
    text = lambda c: F.when(c.isNotNull(), F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    rate = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", rate.alias("r")).distinct()
    rows = rows.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"), F.concat(F.lit(" ;"), "r", F.lit(" % ;")).alias("v"), "r")
    lines = rows.select(F.concat("k", F.lit(": "), "r").alias("a"), text(S.percentages(F.col("v"))).alias("parsed"), text(S.rates(S.percentages(F.col("v")))).alias("kept"))
    parsed = S.percentages(F.col("a"))
    return lines.unionByName(literal(t.spark, PERCENT, "a string, b string, c string").select("a", text(parsed).alias("parsed"), text(S.rates(parsed)).alias("kept")))


@query("select page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from pages")
def split_multi(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(S.split_multi(F.replace("url", F.lit("/"), F.lit(";"))), "|").alias("parts"))


BLANKS = [("a", "a"), ("", None), ("  ", None), (" b ", "b"), ("\tc ", "c"), (None, None)]


@query(f"select coalesce(a, '?') as a, b as kept, case when b is null then 'absent' else 'there' end as state from (select a, b from {values(BLANKS, 'a, b')} union all select a, nullif(trim(a), '') from (select case when event_id % 3 = 0 then '  ' || coalesce(props, '') || ' ' else repeat(' ', event_id % 3) end as a from events))")
def null_vs_empty(t: Tables) -> DataFrame:
    kept = S.null_if_blank(F.col("a"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.coalesce("props", F.lit("")), F.lit(" "))).otherwise(F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")))
    rows = t.events.select(text.alias("a"), F.lit(None).cast("string").alias("b"))
    return rows.unionByName(literal(t.spark, BLANKS, "a string, b string")).select(F.coalesce("a", F.lit("?")).alias("a"), kept.alias("kept"), F.when(kept.isNull(), "absent").otherwise("there").alias("state"))


@query("select page_id, regexp_replace(trim(url), '^http://', 'https://') as url from pages")
def url_https(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.https(F.col("url")).alias("url"))


@query("""select o_orderkey, case c when 1 then 'rupture_stock' when 2 then 'tension_approvisionnement' when 3 then 'arret_commercialisation' when 4 then 'remise_disposition' end as slug,
case c when 1 then 'Rupture de stock' when 2 then 'Tension d''approvisionnement' when 3 then 'Arrêt de commercialisation' when 4 then 'Remise à disposition' end as label,
case c when 0 then 'princeps' when 1 then 'générique' when 2 then 'par complémentarité posologique' when 4 then 'substituable' end as stored,
case c when 0 then 'princeps' when 1 then 'générique' when 2 then 'générique par complémentarité posologique' when 4 then 'générique substituable' end as shown,
cast(o_orderdate as date) < date '2023-10-06' as approximate from (select *, o_orderkey % 6 as c from orders)""")
def status_dim(t: Tables) -> DataFrame:
    c = F.col("o_orderkey") % 6
    slug, label = ({k: v[i] for k, v in S.SHORTAGE.items()} for i in (0, 1))
    return t.orders.select("o_orderkey", S.lookup(c, slug).alias("slug"), S.lookup(c, label).alias("label"), S.lookup(c, S.GENERIC_TYPE).alias("stored"), S.lookup(c, S.GENERIC_VIEW).alias("shown"), S.approximate_start(F.col("o_orderdate").cast("date")).alias("approximate"))


ROMAN = [("I", 1), ("II", 2), ("III", 3), ("IV", 4), ("V", 5), ("VI", None), ("iv", None), (" V ", 5), ("", None)]


@query(f"select a, b as level from {values(ROMAN, 'a, b')} union all select o_orderkey || ['I', 'II', 'III', 'IV', 'V', 'X'][1 + o_orderkey % 6], case when o_orderkey % 6 < 5 then 1 + o_orderkey % 6 end from orders")
def roman_level(t: Tables) -> DataFrame:
    numeral = F.get(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "X"))), (F.col("o_orderkey") % 6).cast("int"))
    rows = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), numeral).alias("a"), S.roman_level(numeral).alias("level"))
    return rows.unionByName(literal(t.spark, ROMAN, "a string, b int").select("a", S.roman_level(F.col("a")).alias("level")))


DIGITS = [("12345678",), ("1234567",), ("1234567a",), ("12345678\n",), ("４２３４５６７８",), ("4294967295",), ("4294967296",), ("",)]


@query(f"select a, regexp_full_match(a, '[0-9]{{8}}') as eight, case when regexp_full_match(a, '[0-9]{{1,20}}') and cast(a as hugeint) < 4294967296 then cast(a as bigint) end as small from (select a from {values(DIGITS, 'a')} union all select c_name from customer union all select cast(c_custkey * 100003 as varchar) from customer)")
def digits_check(t: Tables) -> DataFrame:
    rows = t.customer.select(F.explode(F.array("c_name", (F.col("c_custkey") * 100003).cast("string"))).alias("a"))
    return rows.unionByName(literal(t.spark, DIGITS, "a string")).select("a", S.is_digits(F.col("a"), 8).alias("eight"), S.unsigned32(F.col("a")).alias("small"))


@query("select p_partkey, lpad(cast(p_partkey as varchar), 8, '0') as code8, lpad(cast(p_partkey as varchar), 13, '0') as code13, case when p_size % 10 = 0 then '' else cast(p_size % 10 as varchar) end as bare from part")
def pad_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.pad(F.col("p_partkey"), 8).alias("code8"), S.pad(F.col("p_partkey"), 13).alias("code13"), S.substance_code(F.col("p_size") % 10).alias("bare"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


@query(f"select page_id, '<em>' || {_ESC.format('substr(html, 1, 9)')} || '</em>' || {_ESC.format('substr(html, 10)')} as marked from pages")
def html_highlight(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.highlight(F.col("html"), "paracetam").alias("marked"))


@query("select conv_id, sha256(string_agg(sha256(text), '' order by turn, sha256(text))) as hash from conversations group by conv_id")
def content_hash(t: Tables) -> DataFrame:
    """Every conversation counts as a set of files, its turns."""
    return scan.content_hash(t.conversations.select("conv_id", F.col("turn").alias("name"), F.col("text").alias("content")), ("conv_id",))


@query("select r_regionkey, substr(sha256('v1|GET|/regions/' || r_regionkey || '|limit=20'), 1, 16) as etag from region")
def etag_seed(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", S.etag(F.lit("v1"), F.lit("GET"), F.concat(F.lit("/regions/"), F.col("r_regionkey").cast("string")), F.lit("limit=20")).alias("etag"))


@query("""select case when s in (401, 404, 429, 503) then cast(s as varchar) else cast(s // 100 as varchar) || 'xx' end as label, count(*) as n
from (select [200, 304, 400, 401, 404, 429, 500, 503][1 + event_id % 8] as s from events) group by 1""")
def status_class(t: Tables) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 304, 400, 401, 404, 429, 500, 503))), (F.col("event_id") % 8).cast("int"))
    return t.events.groupBy(S.status_label(status).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'events' as file, 'event_type' as field, event_type as value, count(*) as n from events where event_type not in ('click', 'view') and event_type <> '' group by 3")
def unknown_enum(t: Tables) -> DataFrame:
    return catalog.unknown_values(t.events, "events", catalog.Spec("events", 0, [], {}, {"event_type": ("click", "view")}))


@query("""select p_partkey is not null as kept, count(*) as n, sum(cast(l_quantity as bigint))::bigint as quantity from lineitem left join (select p_partkey from part where p_size > 10) on p_partkey = l_partkey group by 1""")
def integrity_scope(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    kept, orphans = quality.in_scope(rows, t.part.where("p_size > 10"), "p_partkey")
    both = kept.select(F.lit(True).alias("kept"), "l_quantity").unionByName(orphans.select(F.lit(False).alias("kept"), "l_quantity"))
    return both.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("select o_orderkey, c_custkey, c_custkey is null as orphan from orders left join (select c_custkey from customer where c_acctbal > 0) on c_custkey = o_custkey")
def integrity_neutralise(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return quality.neutralise(rows, t.customer.where("c_acctbal > 0"), "c_custkey")


_ALL = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_ALL}) = 1")
def dedupe_first(t: Tables) -> DataFrame:
    return quality.first_wins(t.lineitem, ["l_orderkey", "l_linenumber"], _ALL.split(", "))[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in _ALL.split(', '))}) = 1")
def dedupe_last(t: Tables) -> DataFrame:
    return quality.last_wins(t.lineitem, ["l_orderkey", "l_linenumber"], _ALL.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select o_orderkey, o_custkey, last as last_price from orders left join (select o_custkey as c, max_by(cast(round(o_totalprice * 100) as bigint), o_orderkey) as last from orders where o_orderstatus = 'F' group by 1) on c = o_custkey")
def left_link(t: Tables) -> DataFrame:
    links = t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("last_price"), "o_orderkey")
    return relations.linked_last(t.orders.select("o_orderkey", "o_custkey"), links, "o_custkey", "last_price", "o_orderkey").select("o_orderkey", "o_custkey", "last_price")


@query("select p_partkey, p_name, s_name, count(*) as n from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by all")
def relation_inner(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    named = relations.parents(pairs, t.part, "l_partkey", "p_partkey", ["p_name"])
    return relations.parents(named, t.supplier, "l_suppkey", "s_suppkey", ["s_name"]).select("p_partkey", "p_name", "s_name", "n")


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_suppkey = 3)")
def semi_substance(t: Tables) -> DataFrame:
    return relations.member(t.part.select("p_partkey", "p_name"), t.lineitem.where("l_suppkey = 3").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("""select p_partkey, coalesce(packs, '') as packs, coalesce(suppliers, '') as suppliers from part
left join (select l_partkey, string_agg(cast(l_orderkey as varchar) || ':' || l_linenumber, ',' order by l_orderkey, l_linenumber, l_suppkey) as packs from lineitem group by 1) a on a.l_partkey = p_partkey
left join (select l_partkey, string_agg(s_name, ',' order by s_suppkey) as suppliers from (select distinct l_partkey, l_suppkey from lineitem) join supplier on s_suppkey = l_suppkey group by 1) b on b.l_partkey = p_partkey""")
def expand_record(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    packs = relations.nested(lines, "p_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"], F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), "packs")
    sold = lines.select("p_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct().join(t.supplier, "s_suppkey")
    suppliers = relations.nested(sold, "p_partkey", ["s_suppkey"], F.col("s_name"), "suppliers")
    full = relations.expand(t.part.select("p_partkey"), "p_partkey", {"packs": packs, "suppliers": suppliers})
    return full.select("p_partkey", F.array_join("packs", ",").alias("packs"), F.array_join("suppliers", ",").alias("suppliers"))


@query("select l_orderkey, l_linenumber, l_partkey, p_name, count(*) as n from lineitem join part on p_partkey = l_partkey group by all")
def parent_lookup(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return relations.parents(rows, t.part, "l_partkey", "p_partkey", ["p_name"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "n")


@query("select cast(l_suppkey as varchar) as code, arg_min(l_returnflag, {'a': l_partkey, 'b': l_returnflag}) as name, count(distinct l_partkey) as parents from lineitem group by 1")
def substance_rollup(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("code"), "l_partkey", F.col("l_returnflag").alias("name"))
    return relations.rollup_first_name(rows, "code", "l_partkey", "name")


@query("select r.r_regionkey as grp, min_by(n.n_name, n.n_nationkey) as label, string_agg(cast(n.n_nationkey % 4 as varchar) || '/' || n.n_nationkey, ',' order by n.n_nationkey % 4, n.n_nationkey) as members from nation n join region r on r.r_regionkey = n.n_regionkey group by 1")
def group_denorm(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 4).alias("rank"), "n_nationkey")
    found = relations.groups(relations.member(rows, t.region.select(F.col("r_regionkey").alias("grp")), "grp"), "grp", "label", "rank", ["n_nationkey"], "n_nationkey")
    return found.select("grp", "label", F.array_join(F.transform("members", lambda m: F.concat_ws("/", m["rank"].cast("string"), m["n_nationkey"].cast("string"))), ",").alias("members"))


_ENTITIES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{e}' as entity, count(*) as n from {e}" for e in _ENTITIES))
def entity_counts(t: Tables) -> DataFrame:
    return quality.entity_counts({e: getattr(t, e) for e in _ENTITIES})


@query("select 'orders' as entity, (select count(*) from orders) - (select count(*) from orders where o_orderstatus = 'F') as delta union all select 'part', (select count(*) from part) - (select count(*) from part where p_size > 5)")
def delta_counts(t: Tables) -> DataFrame:
    now = quality.entity_counts({"orders": t.orders, "part": t.part, "region": t.region})
    before = quality.entity_counts({"orders": t.orders.where("o_orderstatus = 'F'"), "part": t.part.where("p_size > 5"), "region": t.region})
    return quality.delta_counts(now, before)


@query("""select k as kept, r as rejected, s as out_of_scope, round(r / (k + r), 6) as reject_ratio, round(s / (k + s), 6) as scope_ratio, r / (k + r) <= 0.01 as accepted
from (select count(*) filter (l_quantity > 2 and l_suppkey > 5) as k, count(*) filter (l_quantity <= 2) as r, count(*) filter (l_quantity > 2 and l_suppkey <= 5) as s from lineitem)""")
def quality_gates(t: Tables) -> DataFrame:
    good = F.col("l_quantity") > 2
    one = t.lineitem.agg(F.count_if(good & (F.col("l_suppkey") > 5)).alias("kept"), F.count_if(~good).alias("rejected"), F.count_if(good & (F.col("l_suppkey") <= 5)).alias("out_of_scope"))
    reject, scope = quality.scope_ratios(F.col("kept"), F.col("rejected"), F.col("out_of_scope"))
    return one.select("*", F.round(reject, 6).alias("reject_ratio"), F.round(scope, 6).alias("scope_ratio"), (reject <= quality.Gates.reject_ratio).alias("accepted"))


@query("select event_type as reason, count(*) as n from events group by 1 order by n desc, reason limit 1")
def dominant_reason(t: Tables) -> DataFrame:
    return quality.dominant_reason(t.events.withColumnRenamed("event_type", "reason"))


@query("select user_id as file, (select event_type from events group by 1 order by count(*) desc, event_type limit 1) as reason, count(*) as n from events group by 1")
def dominant_reason_files(t: Tables) -> DataFrame:
    return quality.keyed_reasons(t.events.select(F.col("user_id").alias("file"), F.col("event_type").alias("reason")))


@query("""select p_partkey, count(l_orderkey) as packs, coalesce(max(f), '') as flags
from part left join lineitem on l_partkey = p_partkey left join (select l_partkey as k, string_agg(l_returnflag, ',' order by m) as f from
(select l_partkey, l_returnflag, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_returnflag}) as m from lineitem group by 1, 2) group by 1) on k = p_partkey group by p_partkey""")
def child_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    flags = relations.nested(lines, "p_partkey", ["l_orderkey", "l_linenumber"], F.col("l_returnflag"), "flags")
    counts = lines.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("packs"))
    out = t.part.select("p_partkey").join(counts, "p_partkey", "left").join(flags, "p_partkey", "left")
    return out.select("p_partkey", F.coalesce("packs", F.lit(0)).alias("packs"), F.coalesce(F.array_join(F.array_distinct("flags"), ","), F.lit("")).alias("flags"))


@query("select count(distinct p_type) as forms, count(distinct p_brand) as holders, count(distinct p_size) as sizes from part")
def cardinalities(t: Tables) -> DataFrame:
    return t.part.agg(F.countDistinct("p_type").alias("forms"), F.countDistinct("p_brand").alias("holders"), F.countDistinct("p_size").alias("sizes"))


@query("select o_orderkey, cast(o_orderdate as date) as day, row_number() over (order by o_orderdate desc nulls last, o_orderkey) as position from orders")
def sort_stable(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate")
    sorted_rows = paging.positions(rows, [F.col("o_orderdate").desc_nulls_last(), "o_orderkey"])
    return sorted_rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "position")


@query(f"select p_partkey, norm, row_number() over (order by norm nulls last, p_partkey) as position from (select p_partkey, {NORM.format('p_name')} as norm from part)")
def sort_names(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", normalize(F.col("p_name")).alias("norm"))
    return paging.positions(rows, [F.col("norm").asc_nulls_last(), "p_partkey"])


@query("select o_orderkey, position from (select o_orderkey, row_number() over (order by o_totalprice desc nulls last, o_orderkey) as position from orders) where position > (select count(*) from orders) * 9 // 10 and position <= (select count(*) from orders) * 9 // 10 + 50")
def deep_page(t: Tables) -> DataFrame:
    """Fifty rows far behind in a total order, from the ranges that hold them."""
    held = selection.ordered(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc_nulls_last(), "o_orderkey"])
    return held.page(held.total * 9 // 10, 50).select("o_orderkey", "position")


@query("select p_partkey, p_size from part order by p_size desc, p_partkey limit 25")
def topk(t: Tables) -> DataFrame:
    return paging.page(t.part.select("p_partkey", "p_size"), [F.desc("p_size"), "p_partkey"], 0, 25)


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r > 2 and o_orderkey % 10 <> 0")
def retention(t: Tables) -> DataFrame:
    """Every customer's orders count as snapshots, those with keys divisible by ten as published; all but the two newest go."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return snapshot.surplus_rows(rows, "o_orderkey", "o_orderdate", 2, F.col("o_orderkey") % 10 == 0, ("o_custkey",)).select("o_custkey", "o_orderkey")


_VERSION = "0123456789abcdef"


@query("""select o_orderkey, rtrim(replace(replace(to_base64(encode('{"o":' || o_orderkey || ',"h":"01234567"}')), '+', '-'), '/', '_'), '=') as cursor, o_orderkey as back, cast(null as bigint) as stale, cast(null as bigint) as broken from orders""")
def cursor_codec(t: Tables) -> DataFrame:
    """Cursors to every order's position and back; those of other data and cut-off ones give nothing."""
    cursor = S.cursor_column(F.col("o_orderkey"), _VERSION)
    rows = t.orders.select("o_orderkey", cursor.alias("cursor"), S.cursor_column(F.col("o_orderkey"), "other").alias("old"))
    return rows.select("o_orderkey", "cursor", S.offset_column(F.col("cursor"), _VERSION).alias("back"), S.offset_column(F.col("old"), _VERSION).alias("stale"), S.offset_column(F.substr("cursor", F.lit(6), F.length("cursor")), _VERSION).alias("broken"))


#: Expressions with their minutes of a day and the days they mean, as SQL over a day d.
_CRONS = {
    "*/15 * * * *": (list(range(0, 1440, 15)), "true"),
    "0 4 * * 1": ([240], "dayofweek(d) = 1"),
    "30 2 29 2 *": ([150], "month(d) = 2 and day(d) = 29"),
    "0 0 13 * 5": ([0], "(day(d) = 13 or dayofweek(d) = 5)"),
    "0 12,18 1,15 * *": ([720, 1080], "day(d) in (1, 15)"),
}


@query("with e as (select event_id, ts from events) " + " union all ".join(
    f"""select event_id, '{x}' as expression, (select min(s) from (select d + to_minutes(unnest({minutes})) as s from (select unnest(generate_series(cast(ts as date), cast(ts as date) + interval 1461 day, interval 1 day)) as d) where {days}) where s > date_trunc('minute', ts)) as next from e"""
    if x.startswith("*") is False else f"select event_id, '{x}' as expression, date_trunc('hour', ts) + to_minutes(15 * (1 + minute(ts) // 15)) as next from e"
    for x, (minutes, days) in _CRONS.items()))
def cron_next(t: Tables) -> DataFrame:
    """The next time of every expression after every event."""
    each = t.events.select("event_id", "ts")
    out = None
    for x in _CRONS:
        one = each.select("event_id", F.lit(x).alias("expression"), cron.next_column(cron.parse(x), F.col("ts")).alias("next"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select doc_id, {NORM.format('text')} as norm from documents")
def norm_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalize(F.col("text")).alias("norm"))
