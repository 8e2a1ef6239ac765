"""Search, scans of lines, and metrics on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import idf, tokens, trim_all
from quarry.operators import metrics, search, selection, topk
from quarry.plans.lists import NORM
from quarry.plans.registry import Tables, file_facts, literal, query
from quarry.sources import scan
from quarry.sources.shared import removed, shared_dir
from quarry.streaming.limits import token_bucket as limited



def _tok(column: str) -> str:
    return f"list_filter(string_split({NORM.format(column)}, ' '), lambda x: strlen(x) >= 2)"


_NAME = "string_split(text, chr(10))[1]"
_REST = "array_to_string(string_split(text, chr(10))[2:], chr(10))"
#: Corpus: the first line of a document is its name, the rest stands for substances, its source for the holder.
_INDEX = f"""
raw as (select doc_id as id, 0 as field, unnest({_tok(_NAME)}) as token, generate_subscripts({_tok(_NAME)}, 1) as pos from documents
  union all select doc_id, 1, unnest({_tok(_REST)}), generate_subscripts({_tok(_REST)}, 1) from documents
  union all select doc_id, 2, unnest({_tok('source')}), generate_subscripts({_tok('source')}, 1) from documents),
postings as (select token, id, field, count(*) as n, field = 0 and min(pos) = 1 as first from raw group by token, id, field),
vocab as (select token, count(distinct id) as df from postings group by token),
size as (select count(*) as rows from documents)"""


def _parts(t: Tables, in_blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and their postings; for an index their texts, which go to their blocks and are counted there."""
    lines = F.split("text", "\n")
    rows = t.documents.select(F.col("doc_id").alias("id"), "text", "source")
    name, rest = F.get(lines, F.lit(0)).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("rest")
    held = search.dealt(rows, rows.count()) if in_blocks else rows
    docs = held.select(*[c for c in ("block",) if in_blocks], "id", name, rest, "source")
    texts = search.field_texts(docs, ["name", "rest", "source"])
    return rows.select("id", name), texts if in_blocks else search.postings(texts)


_published: dict[tuple[str, str], str] = {}


def _index(t: Tables) -> tuple[DataFrame, search.Index]:
    """The corpus and its published index; the first search of a session over these files builds it, as a load does."""
    key = (t.spark.sparkContext.applicationId, file_facts(t.documents))
    if key not in _published:
        docs, index = _parts(t, in_blocks=True)
        path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
        search.publish_index(index, docs, path)
        _published[key] = path
    return _parts(t)[0], search.open_index(t.spark, _published[key])


def _search_sql(query_: str, fallback: bool = True, extra: str = "") -> str:
    """Ranking of a query of plain lower-case words."""
    terms = query_.split()
    asked = ", ".join(f"({i}, '{w}')" for i, w in enumerate(terms))
    last = len(terms) - 1
    prefix = "" if query_.endswith(" ") else f" union select {last}, '{terms[-1]}', token from (select token from vocab where starts_with(token, '{terms[-1]}') and token <> '{terms[-1]}' order by token limit 512)"
    grams = "unnest(list_transform(range(1, strlen(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"
    scored = """select p.id, sum(w.w * [3.0, 2.0, 1.0][p.field + 1] * p.n) as score, bool_or(p.first) as head, bool_and(p.field = 1) as only_substance
  from postings p join {m} m on m.token = p.token join (select distinct m.i, {f} * ln(1 + (size.rows - coalesce(v.df, 0) + 0.5) / (coalesce(v.df, 0) + 0.5)) as w
  from {m} m left join vocab v on v.token = m.term, size) w on w.i = m.i group by p.id having count(distinct m.i) = {k}"""
    return f"""with {_INDEX},
asked(i, term) as (values {asked}),
exact as (select i, term, token from asked join vocab on token = term{prefix}),
e as ({scored.format(m='exact', f='1.0', k=len(terms))}),
qg as (select i, term, strlen(term) + 1 as size, g, count(*) as n from (select i, term, term as w, {grams} as g from asked) group by all),
vg as (select token, strlen(token) + 1 as size, g, count(*) as n from (select token, token as w, {grams} as g from vocab where regexp_full_match(token, '[a-z0-9]+')) group by all),
near as (select qg.i, qg.term, vg.token, sum(qg.n * vg.n) as inter, any_value(qg.size) + any_value(vg.size) as sizes from qg join vg using (g) group by all having sizes <> inter and inter / (sizes - inter) >= 0.4),
a as ({scored.format(m='near', f='0.6', k=len(terms))}),
h as (select * from e union all select * from a where (select count(*) from e) < {5 if fallback else 0} and id not in (select id from e)),
d as (select doc_id as id, {NORM.format(_NAME)} as name from documents)
select h.id, round(score + case when name = '{query_.strip()}' then 50 when starts_with(name, '{query_.strip()}') then 20 else 0 end + case when head then 10 else 0 end + case when only_substance then -5 else 0 end{extra}, 6) as score
from h join d using (id)"""


def _found(t: Tables, text: str) -> DataFrame:
    docs, index = _index(t)
    return search.find(docs, index, text).hits.select("id", F.round("score", 6).alias("score"))


@query(f"with {_INDEX} select token, df from vocab")
def tokens_df(t: Tables) -> DataFrame:
    return search.vocabulary(_parts(t)[1])


@query(f"with {_INDEX} select token, field, count(*) as docs, cast(sum(n) as bigint) as places, count_if(first) as firsts from postings group by token, field")
def postings(t: Tables) -> DataFrame:
    return _parts(t)[1].groupBy("token", "field").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("places"), F.count_if("first").alias("firsts"))


_WORDS = f"select distinct unnest({_tok('p_name')}) as w from part"
_GRAMS = "unnest(list_transform(range(1, strlen(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"


def _part_words(t: Tables) -> DataFrame:
    return t.part.select(F.explode(tokens(F.col("p_name"))).alias("token")).distinct()


@query(f"select hex(g) as gram, w as token, count(*) as n from (select w, {_GRAMS} as g from ({_WORDS})) group by all")
def trigram_index(t: Tables) -> DataFrame:
    return search.grams(_part_words(t)).select("gram", "token", "n")


@query(f"""with v as ({_WORDS}), q(i, term) as (values (0, 'wiget'), (1, 'banana'), (2, 'aaaaaa'), (3, 'ring')),
a as (select i, term, strlen(term) + 1 as size, g, count(*) as n from (select i, term, term as w, {_GRAMS} as g from q) group by all),
b as (select w as token, strlen(w) + 1 as size, g, count(*) as n from (select w, {_GRAMS} as g from v) group by all)
select i, term, token from (select a.i, a.term, b.token, sum(a.n * b.n) as inter, any_value(a.size) + any_value(b.size) as sizes from a join b using (g) group by all) where sizes <> inter and inter / (sizes - inter) >= 0.4""")
def jaccard_candidates(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(0, "wiget"), (1, "banana"), (2, "aaaaaa"), (3, "ring")], "i int, term string")
    return search.similar(terms, search.grams(_part_words(t)), 0.4)


@query(f"with {_INDEX} select token, round(ln(1 + (rows - df + 0.5) / (df + 0.5)), 6) as idf from vocab, size")
def idf_table(t: Tables) -> DataFrame:
    index = _index(t)[1]
    return index.words.select("token", F.round(idf(F.lit(index.rows), F.col("df")), 6).alias("idf"))


@query(_search_sql("thing ", fallback=True))
def search_exact(t: Tables) -> DataFrame:
    return _found(t, "thing ")


@query(_search_sql("thingou"))
def search_prefix(t: Tables) -> DataFrame:
    return _found(t, "thingou")


@query(_search_sql("the anea"))
def search_conj(t: Tables) -> DataFrame:
    return _found(t, "the anea")


@query(_search_sql("thnterbleee"))
def search_fallback(t: Tables) -> DataFrame:
    return _found(t, "thnterbleee")


@query(_search_sql("the anea", extra=" + case when id % 2 = 0 then 15 else 0 end + case when id % 3 = 0 then 5 else 0 end"))
def search_bonus(t: Tables) -> DataFrame:
    """Documents with even ids count as marketed, those divisible by three as active."""
    docs, index = _index(t)
    found = search.find(docs, index, "the anea", marketed=F.col("id") % 2 == 0, active=F.col("id") % 3 == 0)
    return found.hits.select("id", F.round("score", 6).alias("score"))


def _topk_sql(q: str, k: int) -> str:
    return f"select cast(row_number() over (order by score desc, id) as int) as rank, id, score from ({_search_sql(q)}) order by score desc, id limit {k}"


_RANKED = ("the anea", "thing ", "thnterbleee", "the and", "ha", "zzzzzz the")


@query(" union all ".join(f"select '{q}' as query, rank, id, score from ({_topk_sql(q, 10)})" for q in _RANKED))
def search_topk(t: Tables) -> DataFrame:
    """The ten best hits of each query text, in order: by bounds of blocks, rarest list first."""
    docs, index = _index(t)
    rows = [(q, r["rank"], r["id"], r["score"]) for q in _RANKED for r in topk.find_top(docs, index, q, 10).rows]
    return literal(t.spark, rows, "query string, rank int, id long, score double")


#: Query texts: the first and the last word of every fiftieth document, the last one open.
_QUERIES = f"select doc_id as query, coalesce(w[1], '') || ' ' || coalesce(w[len(w)], '') as text from (select doc_id, {_tok('text')} as w from documents where doc_id % 50 = 0)"
#: Byte trigrams as hexadecimal text.
_HEX = "unnest(list_transform(range(0, strlen({w}) + 1), lambda i: substr(hex('  ' || {w} || ' '), 2 * i + 1, 6)))"
_TERMS = f"""{_INDEX},
q as (select query, text, list_filter(string_split(text, ' '), lambda x: strlen(x) >= 2) as t from ({_QUERIES})),
term as (select query, len(t) as k, unnest(t) as term, generate_subscripts(t, 1) as i from q),
weight as (select term, ln(1 + (rows - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as w from (select distinct term from term) left join vocab on token = term, size),
longer as (select term, token from (select term, token, row_number() over (partition by term order by token) as r from (select distinct term from term where i = k) join vocab on starts_with(token, term) and token <> term) where r <= 512),
exact as (select query, k, i, term, term as token from term where term in (select token from vocab) union all select query, k, i, term, token from term join longer using (term) where i = k),
qg as (select term, strlen(term) + 1 as size, g, count(*) as n from (select term, {_HEX.format(w='term')} as g from (select distinct term from term)) group by all),
vg as (select token, strlen(token) + 1 as size, g, count(*) as n from (select token, {_HEX.format(w='token')} as g from vocab) group by all)"""


def _many_scored(matched: str, factor: float) -> str:
    return f"""select m.query, p.id, sum({factor} * w.w * [3.0, 2.0, 1.0][p.field + 1] * p.n) as score, bool_or(p.first) as head, bool_and(p.field = 1) as only_substance
  from {matched} m join postings p using (token) join weight w on w.term = m.term group by m.query, p.id having count(distinct m.i) = any_value(m.k)"""


_MANY = f"""{_TERMS},
e as ({_many_scored('exact', 1.0)}),
weak as (select query from q left join (select query, count(*) as n from e group by 1) using (query) where coalesce(n, 0) < 5),
alike as (select qg.term, vg.token from qg join vg using (g) group by all having any_value(qg.size) + any_value(vg.size) <> sum(qg.n * vg.n) and sum(qg.n * vg.n) / (any_value(qg.size) + any_value(vg.size) - sum(qg.n * vg.n)) >= 0.4),
near as (select query, k, i, term, token from term join alike using (term) where query in (select query from weak)),
a as ({_many_scored('near', 0.6)}),
h as (select * from e union all select * from a where (query, id) not in (select (query, id) from e)),
d as (select doc_id as id, {NORM.format(_NAME)} as name from documents),
found as (select h.query, h.id, round(score + case when name = text then 50 when starts_with(name, text) then 20 else 0 end + case when head then 10 else 0 end + case when only_substance then -5 else 0 end, 6) as score from h join d using (id) join q on q.query = h.query)"""


def _queries(t: Tables) -> DataFrame:
    words = tokens(F.col("text"))
    text = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), text.alias("text"))


@query(f"with {_MANY} select query, cast(r as int) as rank, id, score from (select *, row_number() over (partition by query order by score desc, id) as r from found) where r <= 10")
def search_many(t: Tables) -> DataFrame:
    """The ten best hits of each of a table of queries, by one plan."""
    docs, index = _index(t)
    return topk.find_many(docs, index, _queries(t), most=10).best(10)


@query(f"with {_MANY} select q.query, cast(len(q.t) as int) as tokens, coalesce(n, 0) as exact, len(q.t) > 0 and coalesce(n, 0) < 5 as fallback from q left join (select query, count(*) as n from e group by 1) using (query)")
def search_many_stats(t: Tables) -> DataFrame:
    """What the searches of a table of queries report: tokens, exact hits, whether each fell back."""
    docs, index = _index(t)
    return topk.find_many(docs, index, _queries(t), most=0).facts


@query(f"""with {_INDEX}, p as (select doc_id as query, coalesce(w[1][1:2], '') as term from (select doc_id, {_tok('text')} as w from documents where doc_id % 50 = 0)),
s as (select term, token, df from (select term, token, df, row_number() over (partition by term order by token) as r from (select distinct term from p) join vocab on starts_with(token, term)) where r <= 200)
select query, cast(r as int) as rank, token, df from (select query, token, df, row_number() over (partition by query order by df desc, token) as r from p join s using (term)) where r <= 5""")
def suggest_many(t: Tables) -> DataFrame:
    """The five most frequent of the first 200 tokens with a prefix, for a table of prefixes."""
    words = tokens(F.col("text"))
    asked = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.coalesce(F.left(F.get(words, F.lit(0)), F.lit(2)), F.lit("")).alias("text"))
    return topk.suggest_many(_index(t)[1].words, asked, 5)


_ASKED = ("thing ", "the anea", "thnterbleee", "!!!")


@query(" union all ".join(f"select '{q}' as query, {len(q.split()) if q != '!!!' else 0} as tokens, {m} as mode, n as hits from (select count(*) as n from ({_search_sql(q)}))" for q, m in (("thing ", "'exact'"), ("the anea", "'exact'"), ("thnterbleee", "'trigram'"))) + " union all select '!!!', 0, 'exact', 0")
def search_stats(t: Tables) -> DataFrame:
    """What a search reports: its tokens, whether it fell back to similar ones, its hits."""
    docs, index = _index(t)
    out = None
    for text in _ASKED:
        found = search.find(docs, index, text)
        one = found.hits.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(text).alias("query"), F.lit(found.tokens).alias("tokens"), F.lit(found.mode).alias("mode"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_INDEX} select 'postings' as entity, count(*) as n from postings union all select 'words', count(*) from vocab")
def search_index_build(t: Tables) -> DataFrame:
    """What a load publishes for searches, built anew: its tables and their rows. Only the counts stay."""
    docs, index = _parts(t, in_blocks=True)
    path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    search.publish_index(index, docs, path)
    found = search.open_index(t.spark, path)
    counts = [(name, getattr(found, name).count()) for name in ("postings", "words")]
    removed(t.spark, path)
    return literal(t.spark, counts, "entity string, n long")


@query(f"with {_INDEX} select token, df from (select token, df from vocab where starts_with(token, 'th') order by token limit 200) order by df desc, token limit 10")
def suggest_tokens(t: Tables) -> DataFrame:
    return search.suggest_tokens(_index(t)[1].words, "th", 10)


@query(f"""select kind, id, label from (
(select 0 as rank, 'part' as kind, p_partkey as id, p_name as label from part where starts_with({NORM.format('p_name')}, 're') order by p_partkey limit 12)
union all (select 1, 'supplier', s_suppkey, s_name from supplier where starts_with({NORM.format('s_name')}, 're') order by s_suppkey limit 12)) order by rank, id limit 12""")
def suggest_names(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("row_no"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("row_no"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return search.suggest_names([("part", parts), ("supplier", suppliers)], "re", 12).select("kind", "id", "label")


@query("""select cast(doc_id as varchar) as name, pos as line_no, len(f) as fields from (select doc_id, pos, string_split(regexp_replace(line, '\\r+$', ''), ' ') as f, line
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)) where trim(line) <> ''""")
def scan_lines(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit(" "), F.lit("\t")).alias("text"))
    return scan.lines(files).select("name", F.col("line_no").cast("bigint").alias("line_no"), F.size("fields").alias("fields"))


_FILE = "case when doc_id % 2 = 0 then replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) else '€' || regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '', 'g') end"


@query(f"""select doc_id, case when doc_id % 2 = 0 then 'utf-8' else 'windows-1252' end as encoding, case when lf = 0 then 'none' when crlf = 0 then 'lf' when crlf = lf then 'crlf' else 'mixed' end as line_ending,
case when body = '' then 0 else length(body) - length(replace(body, chr(10), '')) + 1 end as lines, md5(t) as md5
from (select *, length(t) - length(replace(t, chr(10), '')) as lf, (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2 as crlf, regexp_replace(t, '[ \t\r\n]+$', '') as body from (select doc_id, {_FILE} as t from documents))""")
def scan_files(t: Tables) -> DataFrame:
    """Every document as a file: even ones in UTF-8 with a mark and carriage returns, odd ones in Windows-1252, with the characters it has."""
    text = F.coalesce("text", F.lit(""))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    western = F.concat(F.unhex(F.lit("80")), F.encode(F.regexp_replace(text, r"[^\x00-\x7F\xA0-\xFF]", ""), "ISO-8859-1"))
    files = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(western).alias("content"))
    decoded = files.select("doc_id", scan.encoding(F.col("content")).alias("encoding"), scan.decode(F.col("content")).alias("t"))
    return decoded.select("doc_id", "encoding", scan.line_ending(F.col("t")).alias("line_ending"), scan.line_count(F.col("t")).alias("lines"), F.md5("t").alias("md5"))


_REASON = "case when len(f) <> 8 then 'column_count' when strlen(f[1]) < 3 then 'short_key' when not regexp_full_match(f[2], '[a-z]+') then 'bad_word' end"


@query(f"""select file, reason, count(*) as n from (select lang as file, {_REASON} as reason from (select lang, string_split(line, ' ') as f from
(select lang, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> '')) where reason is not null group by grouping sets ((file), (reason), ())""")
def reject_reasons(t: Tables) -> DataFrame:
    from quarry.operators.quality import reject_counters

    lines = t.documents.select(F.col("lang").alias("file"), F.explode(F.split("text", "\n")).alias("line")).where(trim_all(F.col("line")) != "").withColumn("f", F.split("line", " "))
    first, second = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    reason = F.when(F.size("f") != 8, "column_count").when(F.octet_length(first) < 3, "short_key").when(~second.rlike(r"\A[a-z]+\z"), "bad_word")
    return reject_counters(lines.select("file", reason.alias("reason")).where("reason is not null"))


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)
_HIST = "select event_type, le, n from (select event_type, unnest([{b}, 'inf'::double]) as le, unnest([{c}, count(value)]) as n from events group by event_type)".format(b=", ".join(f"{b}::double" for b in _BOUNDS), c=", ".join(f"count(*) filter (value <= {b})" for b in _BOUNDS))


@query(_HIST)
def latency_histogram(t: Tables) -> DataFrame:
    return metrics.histogram(t.events, ["event_type"], "value", _BOUNDS)


@query("select event_type, v[1 + cast(floor((len(v) - 1) * 0.5) as bigint)] as p50, v[1 + cast(floor((len(v) - 1) * 0.95) as bigint)] as p95, v[1 + cast(floor((len(v) - 1) * 0.99) as bigint)] as p99 from (select event_type, list_sort(list(value)) as v from events where value is not null group by 1)")
def latency_percentiles(t: Tables) -> DataFrame:
    return selection.exact_quantiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def _quantile_sql(q: float) -> str:
    return f"""with h as ({_HIST}), t as (select event_type, max(n) * {q}::double as target, max(n) as total from h group by 1),
l as (select h.*, lag(le, 1, 0) over (partition by event_type order by le) as low, lag(n, 1, 0) over (partition by event_type order by le) as below from h),
f as (select event_type, min(le) as le from l join t using (event_type) where n >= target group by 1)
select event_type, round(case when l.le = 'inf'::double then low when n = below then l.le else low + (l.le - low) * (target - below) / (n - below) end, 6) as quantile from l join f using (event_type, le) join t using (event_type)"""


@query(_quantile_sql(0.9))
def histogram_quantile(t: Tables) -> DataFrame:
    found = metrics.histogram_quantile(metrics.histogram(t.events, ["event_type"], "value", _BOUNDS), ["event_type"], 0.9)
    return found.select("event_type", F.round("quantile", 6).alias("quantile"))


_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("select event_type, a.quantile as p50, b.quantile as p95, c.quantile as p99 from " + " join ".join(f"({_quantile_sql(q)}) as {name}{'' if name == 'a' else ' using (event_type)'}" for name, q in zip("abc", _POINTS.values(), strict=True)))
def histogram_quantiles(t: Tables) -> DataFrame:
    """Median, 95th and 99th percentile of every type from its histogram."""
    found = metrics.histogram_quantiles(metrics.histogram(t.events, ["event_type"], "value", _BOUNDS), ["event_type"], _POINTS)
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in _POINTS])


@query("select event_type, strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M') as start, count(*) as n, round(count(*) / 300, 6) as rate from events group by 1, 2")
def rate_window(t: Tables) -> DataFrame:
    found = metrics.rate(t.events, ["event_type"], "ts", "5 minutes")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("rate", 6).alias("rate"))


@query("""with h as (select event_type, unnest([5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0]) as le, unnest([count(*) filter (value <= 5), count(*) filter (value <= 10), count(*) filter (value <= 25), count(*) filter (value <= 50), count(*) filter (value <= 75), count(*) filter (value <= 100), count(*) filter (value <= 250)]) as n from events group by 1)
select le, cast(sum(n) as bigint) as n from h group by 1 union all select 'inf'::double, count(value) from events""")
def histogram_summed(t: Tables) -> DataFrame:
    return metrics.summed(metrics.histogram(t.events, ["event_type"], "value", _BOUNDS), [])


@query("""select event_type, label, n from (select event_type, case when s in (401, 404, 429, 503) then cast(s as varchar) else cast(s // 100 as varchar) || 'xx' end as label, count(*) as n
from (select event_type, [200, 304, 400, 401, 404, 429, 500, 503][1 + event_id % 8] as s from events) group by 1, 2)""")
def request_counts(t: Tables) -> DataFrame:
    return _requests(t)["requests"].withColumnRenamed("status", "label")


def _requests(t: Tables) -> dict[str, DataFrame]:
    status = F.get(F.array(*map(F.lit, (200, 304, 400, 401, 404, 429, 500, 503))), (F.col("event_id") % 8).cast("int"))
    rows = t.events.withColumn("seconds", F.col("value") / 1000).withColumn("bytes", F.col("event_id") % 5000 * 100).withColumn("hits", F.col("event_id") % 700)
    return metrics.request_metrics(rows, "event_type", status, "seconds", "bytes", "hits")


def _histogram_sql(kind: str, value: str, bounds: tuple) -> str:
    counts = ", ".join(f"count(*) filter ({value} <= {b}::double)" for b in bounds)
    return f"select '{kind}' as kind, event_type, unnest([{', '.join(f'{b}::double' for b in bounds)}, 'inf'::double]) as le, unnest([{counts}, count({value})]) as n from events group by event_type"


@query(" union all ".join((_histogram_sql("durations", "(value / 1000)", metrics.LATENCY), _histogram_sql("sizes", "(event_id % 5000 * 100)", metrics.SIZES), _histogram_sql("results", "(event_id % 700)", metrics.RESULTS))))
def request_histograms(t: Tables) -> DataFrame:
    """Durations, sizes and result numbers of requests at the fixed bounds."""
    found = _requests(t)
    parts = [found[kind].select(F.lit(kind).alias("kind"), "event_type", "le", "n") for kind in ("durations", "sizes", "results")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select event_type, count(*) filter (ts > timestamp '2024-01-02 12:00:00' - interval 24 hour and ts <= timestamp '2024-01-02 12:00:00') as increase from events group by 1")
def increase_day(t: Tables) -> DataFrame:
    return metrics.increase(t.events, ["event_type"], "ts", "2024-01-02 12:00:00", "24 hours")


@query("""with s as (select event_type, event_id, ts, value > 60 as breach, last_value(case when not coalesce(value > 60, false) then event_id end ignore nulls) over w as calm from events window w as (partition by event_type order by event_id rows between unbounded preceding and current row)),
r as (select *, min(case when breach then event_id end) over (partition by event_type, calm order by event_id rows between unbounded preceding and current row) as since from s)
select event_type, event_id, coalesce(breach, false) and event_id - since >= 3 as firing from r""")
def alert_rule(t: Tables) -> DataFrame:
    """Values above 60 at every event of a type for three seconds, an event's number counting as its second."""
    samples = t.events.select("event_type", "event_id", F.timestamp_seconds("event_id").alias("at"), "value")
    return metrics.alerts(samples, ["event_type"], "at", "value", 60, 3).select("event_type", "event_id", "firing")


@query("select user_id, count(*) filter (event_type = 'error' or value > 90) as errors, count(*) as n, round(count(*) filter (event_type = 'error' or value > 90) / greatest(count(*), 0.001), 6) as ratio from events group by 1")
def error_ratio(t: Tables) -> DataFrame:
    found = metrics.error_ratio(t.events, ["user_id"], (F.col("event_type") == "error") | (F.col("value") > 90))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("""with recursive e as (select user_id, event_id, ts, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null),
r as (select user_id, event_id, ts, us, k, true as allowed, 0.0::double as wait, 2.0::double as level from e where k = 1
  union all select user_id, event_id, ts, us, k, level >= 1, case when level >= 1 then 0.0 else greatest(1.0, (1 - level) / 0.0005::double) end, case when level >= 1 then level - 1 else level end
  from (select e.*, least(3.0::double, r.level + (e.us - r.us) / 1e6::double * 0.0005::double) as level from r join e on e.user_id = r.user_id and e.k = r.k + 1))
select user_id, ts, event_id, allowed, round(wait, 3) as wait from r""")
def token_bucket(t: Tables) -> DataFrame:
    found = limited(t.events, "user_id", "ts", "event_id", 0.0005, 3.0)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("wait", F.round("wait", 3))
