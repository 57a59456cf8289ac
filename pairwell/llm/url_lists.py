"""URL filters from dated lists: every capture is judged by the entries in force when it was fetched.

List entries are events: an entry is added to or removed from a list on a date. Per list and rule they become validity intervals, each cut at the borders
of fixed spans of days. A capture asks for its host, the host's parent domains, and the host with each leading part of the path. The as-of join is an equi-join on (rule, span) with the interval's ends as a
condition. No step above it needs the captures of a rule together, so a host with a third of all captures is split like any other skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.session import stored

SPAN_DAYS = 365
OPEN = "9999-12-31"


def host_of(url: Column) -> Column:
    """The host of a url with a scheme, in lower case, without user, port and final dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)", 2)), F.lit("."))
    return F.when(host != "", host)


def rules_of(url: Column, host: Column) -> Column:
    """The rules that speak of a url: its host, every parent domain, and ``host/a``, ``host/a/b`` and so on for the parts of its path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    paths = F.transform(parts, lambda x, i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.array_distinct(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """list, rule, verdict, since, until (exclusive): when each rule is in force on each list.

    ``entries``: list, rule, verdict (``block`` or ``allow``), action (``add`` or ``remove``), day. A rule is in force from an ``add`` to the next event
    of its list; of events on one day a ``remove`` counts over an ``add`` and ``allow`` over ``block``. Repeated events count once, and an ``add`` while
    in force goes on with the newer verdict. Rows with a null, or another action or verdict, are not events.
    """
    events = entries.where(F.col("list").isNotNull() & F.col("rule").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove") & F.col("verdict").isin("allow", "block"))
    daily = events.groupBy("list", "rule", "day").agg(F.max(F.struct("action", (F.col("verdict") == "allow").alias("kind"), "verdict")).alias("e"))
    later = F.lead("day").over(Window.partitionBy("list", "rule").orderBy("day"))
    return daily.select("list", "rule", "day", "e.*", F.coalesce(later, F.lit(OPEN).cast("date")).alias("until")).where("action = 'add'").select("list", "rule", "verdict", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Per capture: id, host, fetched, n_rules (in force at that time, over all lists), blocked, rule, since.

    ``rule`` is the deciding one, in force since ``since``: the longest; of equally long ones the first by name, then one that allows, then the latest,
    then the first list by name. A capture is blocked if that one says ``block``. Without one, or without host or time, it is not blocked, and rule
    and since are null. Repeated captures give a row each, a null id too, and an empty list blocks nothing. Other columns are not read.
    """
    span = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / SPAN_DAYS).cast("int")
    host = host_of(F.col(url))
    rows = stored(captures.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(fetched).cast("date").alias("fetched"), F.monotonically_increasing_id().alias("row")), "url-captures")
    asked = rows.where("host is not null and fetched is not null").select("row", "fetched", span(F.col("fetched")).alias("span"), F.explode(rules_of(F.col("url"), F.col("host"))).alias("rule"))
    last = rows.agg(F.max("fetched").alias("last")).first()["last"]
    known = intervals(entries).where(F.col("since") <= F.lit(last).cast("date"))
    end = F.least(F.date_sub("until", 1), F.lit(last).cast("date"))
    spans = stored(known.withColumn("span", F.explode(F.sequence(span(F.col("since")), span(end)))), "url-intervals")
    met = asked.join(spans, ["rule", "span"]).where("since <= fetched and fetched < until")
    order = F.struct(-F.length("rule"), F.col("rule"), F.when(F.col("verdict") == "allow", 0).otherwise(1), -F.datediff("since", F.lit("1970-01-01").cast("date")), F.col("list"))
    best = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_rules"), F.min_by(F.struct("rule", "verdict", "since"), order).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select(
        "page_id", "host", "fetched", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
        F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"), F.col("best.rule").alias("rule"), F.col("best.since").alias("since"),
    )
