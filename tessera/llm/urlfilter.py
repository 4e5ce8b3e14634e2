"""URL filters by a temporal list join, in DataFrame functions only.

A list's dated entries become validity intervals, and an as-of join judges every capture by the entries that were active when it
was fetched: an entry for a domain holds for the domain and all below it, and the longest domain decides.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Length of the time slots by which long histories of one domain are spread over tasks.
SLOT_DAYS = 64
#: The list of the query, fixed values: domain, date from which the entry holds, action ('clear' ends what held before).
ENTRIES = [
    ("cheap-pills.example.com", "2024-01-01", "block"),
    ("cheap-pills.example.com", "2024-06-01", "clear"),
    ("cheap-pills.example.com", "2024-09-15", "block"),
    ("spam-farm.example.org", "2024-02-10", "block"),
    ("tionsh.example.net", "2024-03-01", "block"),
    ("tionsh.example.net", "2024-04-01", "allow"),
    ("example.org", "2024-08-01", "block"),
    ("ththth.example.org", "2024-08-20", "allow"),
    ("blog.tionble.example.com", "2024-05-05", "block"),
    ("tionble.example.com", "2024-10-01", "block"),
    ("therea.example.net", "2024-07-01", "block"),
    ("therea.example.net", "2024-07-02", "clear"),
]
#: Captures of the pages table, which has no times, count as fetched on this day plus as many days as their id leaves by this number.
FIRST_DAY, DAYS = "2024-01-01", 366


def host(url: Column) -> Column:
    """The host of a URL: lower case, without user, port, brackets' end and final dot; null where there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    name = F.regexp_replace(name, r"\.+$", "")
    return F.when(F.length(name) > 0, name)


def domains(name: Column) -> Column:
    """The host and every domain above it, as an array from the longest on."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame, domain_col: str = "domain", from_col: str = "listed_at", action_col: str = "action") -> DataFrame:
    """Validity intervals (domain, action, valid_from, valid_to) of dated entries: each holds from its time until the domain's next entry.

    valid_to is null for the last one. Entries without a domain or a time are void. Of entries of one domain and time the action that
    comes first by name among allow, block, clear holds; repeated entries are one. An action `clear` (or null) ends the one before and
    makes no interval.
    """
    rows = entries.select(F.regexp_replace(F.lower(F.trim(F.col(domain_col))), r"^\.+|\.+$", "").alias("domain"), F.col(from_col).cast("timestamp").alias("valid_from"), F.coalesce(F.lower(F.col(action_col)), F.lit("clear")).alias("action"))
    rows = rows.filter((F.col("domain") != "") & F.col("valid_from").isNotNull()).groupBy("domain", "valid_from").agg(F.min("action").alias("action"))
    following = Window.partitionBy("domain").orderBy("valid_from")
    return rows.withColumn("valid_to", F.lead("valid_from").over(following)).filter(F.col("action") != "clear")


def slot(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (SLOT_DAYS * 86_400))


def decisions(hosts: DataFrame, times: DataFrame) -> DataFrame:
    """For distinct hosts (column host): (host, since, until, domain, action, listed_at), the entry that decides from `since` until before `until`.

    The spans of a host don't overlap, so that at any time at most one holds. They come from the intervals of its own few domains: each
    point in time at which one begins or ends starts a span, in which the longest active domain decides.
    """
    above = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain"))
    met = above.join(times, "domain").select("host", F.struct(F.length("domain").alias("size"), "domain", "action", "valid_from", "valid_to").alias("x"))
    met = met.groupBy("host").agg(F.collect_set("x").alias("xs"))
    points = F.array_sort(F.array_distinct(F.concat(F.transform("xs", lambda x: x["valid_from"]), F.filter(F.transform("xs", lambda x: x["valid_to"]), lambda t: t.isNotNull()))))
    spans = met.select("host", "xs", F.posexplode(points).alias("i", "since"), points.alias("points")).withColumn("until", F.expr("get(points, i + 1)"))
    active = F.filter("xs", lambda x: (x["valid_from"] <= F.col("since")) & (x["valid_to"].isNull() | (x["valid_to"] > F.col("since"))))
    best = spans.select("host", "since", "until", F.array_max(active).alias("best")).filter("best IS NOT NULL")
    return best.select("host", "since", "until", F.col("best.domain").alias("domain"), F.col("best.action").alias("action"), F.col("best.valid_from").alias("listed_at"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """A row per capture: its id, host, fetched_at, matched_domain, action, listed_at (of the entry that decides) and allowed.

    The entry of the longest domain that is active at the fetch time decides; without one the capture is allowed and the middle three
    columns are null. A null or hostless URL, and a null time, match nothing. Repeated captures are judged each; other columns are not
    read. An empty list allows everything, an empty table gives an empty result.

    The list first meets the distinct hosts, of which each gets its spans; then every capture takes the span it falls into, by one
    equi-join on the host and a slot of time, in which a span stands once for each slot it covers. A host with a third of all captures is
    so dealt over its slots, and beyond that a skewed join splits; only ids, hosts and times are moved, never the pages.
    """
    rows = captures.select(F.col(id_col).alias("_id"), host(F.col(url_col)).alias("host"), F.col(time_col).cast("timestamp").alias("at"))
    last = rows.agg(F.max("at")).first()[0]
    if last is None:
        last = datetime.datetime(1970, 1, 1)
    spans = decisions(rows.select("host").filter("host IS NOT NULL").distinct(), intervals(entries)).filter(F.col("since") <= F.lit(last))
    spans = spans.withColumn("slot", F.explode(F.sequence(slot(F.col("since")), slot(F.least("until", F.lit(last))))))
    spans = spans.select(F.col("host").alias("_host"), "slot", "since", "until", "domain", "action", "listed_at")
    rows = rows.withColumn("_slot", slot(F.col("at")))
    inside = (F.col("host") == F.col("_host")) & (F.col("_slot") == F.col("slot")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    out = rows.join(spans, inside, "left")
    return out.select(F.col("_id").alias(id_col), "host", F.col("at").alias("fetched_at"), F.col("domain").alias("matched_domain"), "action", "listed_at", (F.coalesce("action", F.lit("allow")) != "block").alias("allowed"))


def op7_temporal_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")).cast("timestamp").alias("fetched_at"))
    entries = spark.createDataFrame(ENTRIES, "domain string, listed_at string, action string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return filter_urls(captures, entries).select("page_id", "host", day("fetched_at"), "matched_domain", "action", day("listed_at"), "allowed")


OP7_SQL = f"""
WITH entries(domain, listed_at, action) AS (VALUES {", ".join(str(e) for e in ENTRIES)}),
times AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY domain ORDER BY listed_at) AS until FROM entries
), captures AS (
  SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
    strftime(DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER), '%Y-%m-%d') AS fetched_at
  FROM pages
), met AS (
  SELECT page_id, t.domain, t.action, t.listed_at, row_number() OVER (PARTITION BY page_id ORDER BY length(t.domain) DESC) AS nth
  FROM captures c JOIN times t ON (c.host = t.domain OR ends_with(c.host, '.' || t.domain))
    AND t.action <> 'clear' AND t.listed_at <= c.fetched_at AND (t.until IS NULL OR c.fetched_at < t.until)
)
SELECT c.page_id, c.host, c.fetched_at, m.domain AS matched_domain, m.action, m.listed_at, coalesce(m.action, 'allow') <> 'block' AS allowed
FROM captures c LEFT JOIN met m ON m.page_id = c.page_id AND m.nth = 1
"""
