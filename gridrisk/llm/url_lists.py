"""Temporal URL lists: dated entries become validity intervals, and an as-of join judges each capture by those active then.

An entry names a pattern (a domain, which covers its subdomains, or host/path), an action (block, allow or remove) and
the time from which it holds. An entry holds until the next one of the same pattern. Of the patterns that are active
for a capture when it was fetched, the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RANK = {"remove": 0, "allow": 1, "block": 2}


def host(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none. An IPv6 address keeps its brackets."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    return F.when(h != "", h)


def patterns(url: Column) -> Column:
    """What may list a URL: its host, each parent domain with a dot in it (none of an IP address), and host/path."""
    h = host(url)
    parts = F.split(h, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(parts, i, n), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(h.isNotNull(), F.array_union(F.when(h.rlike(r"^(\[|[0-9.]+$)"), F.array(h)).otherwise(domains), F.array(F.concat(h, path))))


def low_host(pattern: Column) -> Column:
    """The pattern with its host, but not its path, in lower case."""
    h = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(h), F.substring(pattern, F.char_length(h) + 1, F.char_length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: open) of the entries that block or allow.

    Repeated entries count once; of several with one pattern and time, block goes before allow and allow before remove.
    Rows without pattern, time or a known action are no entries. The next entry is sought within the month and, past
    it, among the months' first entries, so that no task has to hold all entries of a pattern with very many.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    e = entries.select(low_host(F.col("pattern").cast("string")).alias("pattern"), F.col("listed_at").cast("timestamp").alias("valid_from"), F.lower("action").alias("action"))
    e = e.where(F.col("pattern").isNotNull() & F.col("valid_from").isNotNull() & F.col("action").isin(*RANK))
    e = e.groupBy("pattern", "valid_from").agg(F.max_by("action", rank[F.col("action")]).alias("action")).withColumn("month", F.trunc("valid_from", "month"))
    later = e.groupBy("pattern", "month").agg(F.min("valid_from").alias("first"))
    later = later.select("pattern", "month", F.lead("first").over(Window.partitionBy("pattern").orderBy("month")).alias("next_month"))
    e = e.withColumn("next", F.lead("valid_from").over(Window.partitionBy("pattern", "month").orderBy("valid_from")))
    return e.join(later, ["pattern", "month"]).where(F.col("action") != "remove").select("pattern", "action", "valid_from", F.coalesce("next", "next_month").alias("valid_to"))


def judge(captures: DataFrame, entries: DataFrame, split: int = 50_000) -> DataFrame:
    """captures with verdict (block, allow or none), matched_pattern and listed_at, as of fetched_at.

    Captures need url and fetched_at; a null in either, or a URL without a host, gives none, and repeated rows each get
    their verdict. Hosts are compared without regard to case, paths with it. Columns of captures with the new names are
    replaced. The join is on pattern and month: an interval is repeated for those months that it touches and in which the
    pattern was fetched. A pattern fetched more than `split` times in a month is dealt over so many more keys, by the
    URL; one URL fetched again at the same time is judged once. Without entries all verdicts are none.
    """
    captures = captures.drop("verdict", "matched_pattern", "listed_at")
    at = captures.select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at")).where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct()
    asked = at.select("*", F.explode(patterns(F.col("url"))).alias("pattern"), F.trunc("fetched_at", "month").alias("month"))
    fetched = common.settle(asked.groupBy("pattern", "month").agg(F.ceil(F.count("*") / split).cast("int").alias("shares")), "fetched-months")
    end = fetched.agg(F.last_day(F.max("month")).alias("end"))

    listed = intervals(entries).crossJoin(F.broadcast(end)).where(F.col("valid_from") < F.date_add("end", 1))
    touched = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.col("end").cast("timestamp"), "valid_to"), "month"), F.expr("interval 1 month"))
    listed = listed.withColumn("month", F.explode(touched)).join(fetched, ["pattern", "month"])
    listed = listed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("end", "shares")
    asked = asked.join(common.small(fetched.where("shares > 1")), ["pattern", "month"], "left")
    asked = asked.withColumn("share", F.pmod(F.xxhash64("url", "fetched_at"), F.coalesce("shares", F.lit(1))).cast("int"))

    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    found = asked.join(listed, ["pattern", "month", "share"]).where(active)
    best = found.groupBy("url", "fetched_at").agg(F.max_by(F.struct("action", "pattern", "valid_from"), F.struct(F.char_length("pattern"), "pattern")).alias("best"))
    best = best.select("url", F.col("fetched_at").alias("_at"), F.col("best.action").alias("verdict"), F.col("best.pattern").alias("matched_pattern"), F.col("best.valid_from").alias("listed_at"))
    same = (F.col("c.url") == F.col("b.url")) & (F.col("c.fetched_at").cast("timestamp") == F.col("b._at"))
    return captures.alias("c").join(best.alias("b"), same, "left").select("c.*", F.coalesce("b.verdict", F.lit("none")).alias("verdict"), "b.matched_pattern", "b.listed_at")
