"""URL filters by a temporal list join.

Dated list entries (a domain is added to or removed from a list) become validity intervals
[valid_from, valid_to). An as-of join evaluates each capture against the entries that were
active when it was fetched: an entry for a domain covers its subdomains, and the entry with most labels decides;
at equal labels an allowing list beats a blocking one.

Intervals are matched to distinct hosts, not to captures: each host gets one array of its intervals,
and captures are joined to their host's row. That side is broadcast if its counted rows and bytes are within
bounds; beyond it the join shuffles, with captures salted so that a host with a third of them is spread.

Defined cases: a null or malformed url has no host and is kept with no hit; so is a capture without a fetch
time. Entries without domain, list, date, or an action and a kind that is known are ignored. Entries of one list, domain and instant: adding wins; equal entries
count once. Repeated captures get equal results. Empty lists keep everything; no captures, no rows. Other columns of captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.common import BROADCAST_BYTES, cut, width

MOST_HOSTS, SALTS = 100_000, 32


def host(url: Column) -> Column:
    """The lower-case host of an http or https url; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def suffixes(h: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(h.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, domain, valid_from, valid_to) from dated entries (list, kind 'block' or 'allow', domain, action 'add' or 'remove', dated)."""
    clean = entries.select("list", "kind", F.lower("domain").alias("domain"), "action", "dated").filter("list is not null and domain is not null and dated is not null and action in ('add', 'remove') and kind in ('block', 'allow')")
    at = clean.groupBy("list", "kind", "domain", "dated").agg(F.max(F.col("action") == "add").alias("added"))
    along = Window.partitionBy("list", "kind", "domain").orderBy("dated")
    turns = at.withColumn("was", F.lag("added").over(along)).filter("added <> coalesce(was, false)")
    return turns.withColumn("valid_to", F.lead("dated").over(along)).filter("added").select("list", "kind", "domain", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """(page_id, host, fetched_at, n_active, domain, list, verdict) of each capture (page_id, url, fetched_at); domain and list are those that decide."""
    rows = captures.select("page_id", host(F.col("url")).alias("host"), "fetched_at")
    hosts = rows.select("host").filter("host is not null").distinct()
    keys = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    spans = cut(keys.join(intervals(entries), "domain").groupBy("host").agg(
        F.collect_list(F.struct(F.size(F.split("domain", r"\.")).alias("labels"), (F.col("kind") == "allow").alias("allows"), "domain", "list", "valid_from", "valid_to")).alias("spans")
    ))
    n, size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(width(spans)), F.lit(0))).first()
    if n <= most_hosts and size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(spans), "host", "left")
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    at = F.col("fetched_at")
    active = F.coalesce(F.filter("spans", lambda s: (s["valid_from"] <= at) & (s["valid_to"].isNull() | (at < s["valid_to"]))), F.array().cast(spans.schema["spans"].dataType))
    best = F.array_max(F.transform("active", lambda s: F.struct(s["labels"].alias("labels"), s["allows"].alias("allows"), s["domain"].alias("domain"), s["list"].alias("list"))))
    found = joined.withColumn("active", active).withColumn("best", best)
    verdict = F.when(F.col("best").isNull(), "kept").when(F.col("best.allows"), "allowed").otherwise("blocked")
    return found.select("page_id", "host", "fetched_at", F.size("active").cast("long").alias("n_active"), F.col("best.domain").alias("domain"), F.col("best.list").alias("list"), verdict.alias("verdict"))


def kept(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no active entry blocks."""
    return evaluate(captures, entries).filter("verdict <> 'blocked'")
