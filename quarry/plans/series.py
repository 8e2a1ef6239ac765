"""Counters, alerts, quantiles, distinct counts and keys of nested values on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import counters, nested, selection
from quarry.plans.registry import Tables, query
from quarry.sources.shared import shared_dir
from quarry.streaming import buckets

_HOUR = 3600
#: A counter for each type of event, reset every 400 events, on a grid of hours with ranges of six.
_RATES = """s as (select event_type, epoch_us(ts) as us, cast(event_id % 400 as double) as v from events),
a as (select *, lag(v) over (partition by event_type order by us, v) as p from s),
t as (select *, v + sum(case when v < p then p else 0 end) over (partition by event_type order by us, v rows unbounded preceding) as total from a),
g as (select unnest(range(lo, hi + 1)) as step from (select cast(ceil(min(us) / 3600000000.0) as bigint) as lo, cast(ceil(max(us) / 3600000000.0) as bigint) + 5 as hi from s)),
w as (select event_type, step, count(*) as n, min(us) as us0, max(us) as us1, arg_min(total, us) as t0, arg_max(total, us) as t1, arg_min(v, us) as v0 from t join g on us > (step - 6) * 3600000000 and us <= step * 3600000000 group by all having count(*) > 1 and min(us) < max(us)),
e as (select *, (us1 - us0) / 1e6::double as sampled, t1 - t0 as gain, (us1 - us0) / 1e6::double / (n - 1) as mean, us0 / 1e6::double - (step * 3600 - 21600) as b0, step * 3600 - us1 / 1e6::double as a0 from w),
f as (select *, case when b0 >= mean * 1.1::double then mean / 2 else b0 end as b1, case when a0 >= mean * 1.1::double then mean / 2 else a0 end as a1, case when gain > 0 and v0 >= 0 then sampled * (v0 / gain) end as z from e),
r as (select event_type, step * 3600 as "at", n, gain * ((sampled + case when z < b1 then z else b1 end + a1) / sampled) as increase from f)"""


def _rates(t: Tables) -> DataFrame:
    samples = t.events.select("event_type", "ts", (F.col("event_id") % 400).alias("v"))
    return counters.increases(samples, ["event_type"], "ts", "v", 6 * _HOUR, _HOUR)


@query(f'with {_RATES} select event_type, "at", n, round(increase, 4) as increase, round(increase / 21600, 9) as rate from r')
def counter_rate(t: Tables) -> DataFrame:
    """Increase and rate of a counter over the six hours before every full hour."""
    return _rates(t).select("event_type", "at", "n", F.round("increase", 4).alias("increase"), F.round("rate", 9).alias("rate"))


@query(f"""with {_RATES}, b as (select event_type, "at", n > (select count(*) / 600.0 from events) as breach from r),
i as (select *, "at" // 3600 - row_number() over (partition by event_type, breach order by "at") as run from b),
d as (select *, min("at") over (partition by event_type, breach, run) as since from i)
select event_type, "at", case when not breach then 'inactive' when "at" - since >= 7200 then 'firing' else 'pending' end as state from d""")
def alert_states(t: Tables) -> DataFrame:
    """More samples than usual in six hours, for two hours: inactive, pending or firing at every hour."""
    bound = t.events.count() / 600
    return counters.alert_states(_rates(t), ["event_type"], "at", F.col("n") > bound, 2 * _HOUR, _HOUR, bin_steps=64).select("event_type", "at", "state")


def _daily(t: Tables) -> DataFrame:
    return t.events.withColumn("day", F.date_trunc("day", F.col("ts")))


@query("select event_type, true as p50, true as p95, true as p99 from events group by 1")
def quantile_sketch_merge(t: Tables) -> DataFrame:
    """Quantiles from the merged sketches of every day: whether each lies within a hundredth of its rank."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    daily = selection.quantile_sketches(_daily(t), ["event_type", "day"], "value")
    found = selection.merged_quantiles(daily, ["event_type"], points)
    values = t.events.where("value is not null").select("event_type", "value").join(F.broadcast(found), "event_type")
    # Rows below and up to the estimate: a rank within them is exact where values repeat.
    near = [((F.count_if(F.col("value") < F.col(p)) / F.count("value") - 0.01 <= q) & (F.count_if(F.col("value") <= F.col(p)) / F.count("value") + 0.01 >= q)).alias(p) for p, q in points.items()]
    return values.groupBy("event_type").agg(*near)


@query("select event_type, count(distinct user_id) as users, true as near from events group by 1")
def distinct_sketch(t: Tables) -> DataFrame:
    """Users of every type from the merged sketches of every day: whether the estimate lies within a fiftieth."""
    daily = selection.distinct_sketches(_daily(t), ["event_type", "day"], "user_id")
    exact = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    found = exact.join(selection.merged_distinct(daily, ["event_type"]), "event_type")
    return found.select("event_type", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") / 50).alias("near"))


@query("""with h as (select event_type, user_id, bool_or(ts < timestamp '2024-01-16') as old, bool_or(ts >= timestamp '2024-01-16') as new from events where user_id is not null group by all)
select event_type, count_if(old and new) as both, count(*) as either, count_if(old and not new) as gone from h group by 1 having bool_or(old) and bool_or(new)""")
def distinct_overlap(t: Tables) -> DataFrame:
    """Users of two versions of the events: in both, in either, and no longer there."""
    return selection.exact_overlap(t.events, ["event_type"], "user_id", F.col("ts") < "2024-01-16")


@query("select path, kind, count(*) as n from (select regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from events, json_tree(cast(props as json))) group by all")
def json_keys(t: Tables) -> DataFrame:
    """Every key at any depth of the events' properties."""
    return nested.key_walk(t.events, F.col("props"))


_DEEP = """select to_json({'id': conv_id, 'turns': list({'turn': turn, 'from': {'role': role, 'empty': text = ''}} order by turn)}) as doc from conversations group by conv_id"""


@query(f"select path, kind, count(*) as n from (select regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') as path, case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from ({_DEEP}), json_tree(doc)) group by all")
def json_keys_deep(t: Tables) -> DataFrame:
    """Every key of conversations as nested values."""
    turn = F.struct("turn", F.struct("role", (F.col("text") == "").alias("empty")).alias("from"))
    docs = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.col("conv_id").alias("id"), F.array_sort(F.collect_list(turn)).alias("turns")), {"ignoreNullFields": "false"}).alias("doc"))
    return nested.key_walk(docs, F.col("doc"))


@query("""with recursive e as (select user_id, event_id, ts, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null),
r as (select user_id, event_id, ts, us, k, true as allowed, 0.0::double as wait, 2.0::double as level from e where k = 1
  union all select user_id, event_id, ts, us, k, level >= 1, case when level >= 1 then 0.0 else greatest(1.0, (1 - level) / 0.0005::double) end, case when level >= 1 then level - 1 else level end
  from (select e.*, least(3.0::double, r.level + (e.us - r.us) / 1e6::double * 0.0005::double) as level from r join e on e.user_id = r.user_id and e.k = r.k + 1))
select user_id, us, event_id, allowed, round(wait, 3) as wait from r""")
def token_bucket_swept(t: Tables) -> DataFrame:
    """All events once through the stream whose idle buckets are swept, in one micro-batch: equal to the fold."""
    buckets.use_rocksdb(t.spark)
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    base = f"{shared_dir(t.spark)}/swept-{uuid.uuid4().hex}"
    stream = buckets.swept_token_bucket(events, "user_id", "ts", "event_id", 0.0005, 3.0)
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = t.spark.read.schema("k bigint, us bigint, o bigint, allowed boolean, wait double").parquet(f"{base}/out")
    return found.select(F.col("k").alias("user_id"), "us", F.col("o").alias("event_id"), "allowed", F.round("wait", 3).alias("wait"))
