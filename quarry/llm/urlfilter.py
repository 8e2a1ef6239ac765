"""URL filtering against a dated list, in DataFrame functions only.

List entries are dated events of host patterns; each is valid from its date
until the pattern's next entry. A pattern covers its host and all hosts below
it, and the most specific valid entry decides. Per distinct host the intervals
of its patterns are merged into one timeline; an as-of join gives every
capture the timeline's state at its fetch time. A capture meets one row of
its host, so a host with a third of all captures multiplies nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, few, fresh

#: Hosts whose timelines may be sent to all executors; beyond that only those of hot hosts are, which have at least one of so many captures.
BROADCAST_HOSTS, HOT_SHARE = 50_000, 1000
#: Dated entries that may be sent to all executors; of a longer list, domains above more than so many hosts are dealt to several tasks.
BROADCAST_ENTRIES, DOMAIN_SHARE = 100_000, 10_000
#: End of an interval that is still open.
OPEN = 2**62


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dots; null without any."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until of entries (pattern, action, since).

    Actions: block, allow (an exception to a wider block) and remove (no entry
    from then on). Entries with a null are ignored, repeated ones count once;
    of entries of one pattern at one time the last by action holds.
    """
    known = entries.select(F.lower("pattern").alias("pattern"), "action", F.col("since").cast("bigint").alias("since")).dropna().distinct()
    later = F.lead("since").over(Window.partitionBy("pattern").orderBy("since", "action"))
    return known.withColumn("until", F.coalesce(later, F.lit(OPEN))).where("since < until and action in ('block', 'allow')")


def _above(host: Column) -> Column:
    """The host and the domains above it; an address has none above."""
    address = host.startswith("[") | host.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    return F.when(address, F.array(host)).otherwise(domains)


def _meet(pairs: DataFrame, listed: DataFrame, share: int) -> DataFrame:
    """Join of (host, pattern) with a long list.

    Domains above more than ``share`` hosts are counted first: those not
    listed (as ``com``) go, and the hosts of listed ones are dealt to several
    copies of their entries. There is at most one such domain in ``share`` pairs.
    """
    counts = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    names = listed.select("pattern", F.lit(True).alias("known")).distinct()
    hot = cut(counts.join(names, "pattern", "left").select("pattern", F.when(F.col("known"), F.ceil(F.col("n") / share).cast("int")).otherwise(0).alias("shares")), "domains")
    hot = F.broadcast(hot) if few(hot, BROADCAST_ENTRIES) else hot
    dealt = pairs.join(hot, "pattern", "left").where("shares is null or shares > 0")
    dealt = dealt.select("host", "pattern", F.coalesce(F.pmod(F.xxhash64("host"), F.col("shares")), F.lit(0)).cast("int").alias("share"))
    copies = listed.join(hot, "pattern", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return dealt.join(copies, ["pattern", "share"]).drop("share")


def timelines(hosts: DataFrame, listed: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, domain_share: int = DOMAIN_SHARE) -> DataFrame:
    """host, line: states of each listed host in time order, each from ``since`` on.

    A state has the deciding pattern, its action, and since when and until when that entry is valid; nulls: no entry.
    """
    pairs = hosts.select("host", F.explode(_above(F.col("host"))).alias("pattern"))
    met = pairs.join(F.broadcast(listed), "pattern") if few(listed, broadcast_entries) else _meet(pairs, listed, domain_share)
    own = met.groupBy("host").agg(F.collect_list(F.struct(F.length("pattern").alias("rank"), "pattern", "action", "since", "until")).alias("all"))
    times = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda e: F.array(e["since"], e["until"])))))
    state = lambda t: F.array_max(F.filter(F.col("all"), lambda e: (e["since"] <= t) & (t < e["until"])))
    return own.select("host", F.transform(times, lambda t: F.struct(t.alias("at"), state(t).alias("state"))).alias("line"))


def filter_captures(captures: DataFrame, entries: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS, broadcast_entries: int = BROADCAST_ENTRIES, domain_share: int = DOMAIN_SHARE) -> DataFrame:
    """``captures`` (url, fetched_at and any others) with host, blocked, rule, valid_from and valid_to.

    ``rule`` is the deciding pattern, whether it blocks or allows; ``valid_to``
    is null for entries still valid. Captures without a host or a fetch time
    have no rule and are not blocked. An empty list blocks nothing. Equal
    captures give equal rows, one each. A capture's own column of one of these
    names is kept as ``captured_<name>``.
    """
    taken = {c.lower() for c in captures.columns}
    for name in [c for c in captures.columns if c.lower() in ("host", "blocked", "rule", "valid_from", "valid_to")]:
        kept = f"captured_{name}"
        while kept.lower() in taken:
            kept += "_"
        taken.add(kept.lower())
        captures = captures.withColumnRenamed(name, kept)
    host, line, state = (fresh(captures, n) for n in ("host", "line", "state"))
    rows = captures.withColumn(host, host_of(F.col("url")))
    hosts = rows.select(F.col(host).alias("host")).where("host is not null").distinct()
    lines = timelines(hosts, cut(intervals(entries), "intervals"), broadcast_entries, domain_share).select(F.col("host").alias(host), F.col("line").alias(line))
    if few(lines, broadcast_hosts):
        joined = rows.join(F.broadcast(lines), host, "left")
    else:
        counts = cut(rows.groupBy(host).agg(F.count(F.lit(1)).alias("n")), "hosts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        # At most HOT_SHARE hosts can have so large a part of the captures.
        hot = [r[0] for r in counts.where((F.col("n") * HOT_SHARE >= total) & F.col(host).isNotNull()).select(host).collect()]
        is_hot = F.coalesce(F.col(host).isin(hot), F.lit(False))
        joined = rows.where(is_hot).join(F.broadcast(lines.where(is_hot)), host, "left").unionByName(rows.where(~is_hot).join(lines.where(~is_hot), host, "left"))
    past = F.filter(F.col(line), lambda s: s["at"] <= F.col("fetched_at"))
    found = joined.withColumn(state, F.when(F.size(past) > 0, F.element_at(past, -1)["state"]))
    s = F.col(state)
    return found.select(
        *captures.columns,
        F.col(host).alias("host"),
        F.coalesce(s["action"] == "block", F.lit(False)).alias("blocked"),
        s["pattern"].alias("rule"),
        s["since"].alias("valid_from"),
        F.when(s["until"] < OPEN, s["until"]).alias("valid_to"),
    )
