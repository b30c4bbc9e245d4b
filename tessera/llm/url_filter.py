"""URL filters (7): block lists whose entries come and go, judged as of each capture's fetch time.

Method, a temporal list join. The dated events of a list entry become validity intervals: an event
holds from its time until the entry's next event, and the entry is active while that is an ``add``.
A capture is looked up under each of its keys (its host and the domains above it; its host with each
leading part of the path), and matches the entries active at its fetch time. As at most one event of
an entry holds at a time, the join on key and interval is the as-of join. Native operations only.

Scale. A capture has one key for each label of its host and segment of its path, whatever the list's
size. Spark broadcasts the intervals where their size is known to be under its threshold, and else
sort-merges with skewed keys split; rows of a hot host are never gathered, and matches are summed
before they meet.

Defined cases. Null or unreadable URL: no host, no keys, not blocked. Null fetch time: no entry is
active; nor for a time that can't be read, and a list event with such a time is none. An IPv6 host is
one key, in its brackets. Repeated captures: a result each. Events of an entry at one time: ``remove`` comes after
``add``. An empty list blocks nothing. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values: (list, kind, value, action, date).
EVENTS = (
    ("spam", "domain", "spam-farm.example.org", "add", "2024-01-15"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-05-01"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-08-10"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-11-20"),
    ("adult", "domain", "tiontion.example.com", "add", "2024-03-05"),
    ("adult", "domain", "tionsh.example.net", "add", "2024-06-01"),
    ("adult", "domain", "tionsh.example.net", "remove", "2024-06-15"),
    ("malware", "prefix", "ththed.example.org/en", "add", "2024-04-01"),
    ("malware", "prefix", "blog.ththan.example.net/es", "add", "2024-01-01"),
    ("malware", "prefix", "blog.ththan.example.net/es", "remove", "2024-09-30"),
)


def events_table(spark: SparkSession, events: Sequence[tuple[str, str, str, str, str]] = EVENTS) -> DataFrame:
    return spark.createDataFrame(list(events), "list string, kind string, value string, action string, at string").withColumn("at", F.try_to_timestamp("at"))


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, value, valid_from, valid_to) of the times in which an entry is active."""
    order = Window.partitionBy("list", "kind", "value").orderBy("at", "action")
    return events.withColumn("at", F.col("at").try_cast("timestamp")).where("at is not null").withColumn("valid_to", F.lead("at").over(order)).where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1), F.lit(""))


def keys_of(url: Column) -> Column:
    """Array of (kind, value): domain keys from the host's labels, prefix keys from the path's."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels, parts = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\.")), F.filter(F.split(path, "/"), lambda x: x != "")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: key("prefix", F.concat_ws("/", F.array(host), F.slice(parts, F.lit(1), i))))
    return F.when(host.isNotNull(), F.concat(domains, prefixes))


def url_filter(captures: DataFrame, events: DataFrame, id_column: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(page_id, host, fetched, n_active, matched, blocked) for each capture: the number of active
    entries that match, and their distinct ``list:kind:value`` in order, comma-joined. Times are
    timestamps; a date is its first instant."""
    rows = captures.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(fetched).try_cast("timestamp").alias("fetched")).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.select("row", "page_id", "fetched", host_of(F.col("url")).alias("host"), F.explode_outer(keys_of(F.col("url"))).alias("key")).select("*", "key.kind", "key.value")
    active = intervals(events)
    joined = keyed.join(active, (keyed["kind"] == active["kind"]) & (keyed["value"] == active["value"]) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))), "left")
    name = F.when(F.col("list").isNotNull(), F.concat_ws(":", "list", active["kind"], active["value"]))
    found = joined.groupBy("row", "page_id", "host", "fetched").agg(F.array_sort(F.collect_set(name)).alias("names"))
    return found.select("page_id", "host", "fetched", F.size("names").cast("long").alias("n_active"), F.array_join("names", ",").alias("matched"), (F.size("names") > 0).alias("blocked"))
