"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

An entry names a host, a domain with all hosts below it, or a host and first path segment, and is
added or removed at a time.  Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import table

DAY = 86_400
#: Entries that are still valid at the end of the list hold for this time.
FOREVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.rtrim(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))


def first_segment(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1)


def patterns(url: Column) -> Column:
    """All patterns that apply to a URL: its host, every domain above it, its first path segment."""
    name, segment = host(url), first_segment(url)
    labels = F.split(name, r"\.")
    above = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: i < F.size(labels) - 1),
        lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    own = F.concat(F.lit("*."), name)
    path = F.when(segment != "", F.array(F.concat(name, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(F.array(name, own), above, path)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from dated entries (pattern, at, number, added).

    An entry holds from the time it is added until the next entry of the same pattern; of entries at
    one time the highest number counts.  The next entry is looked for inside its day first and then
    among the first entries of later days, so a pattern with very many entries is spread over days.
    Entries without a pattern or a time are no entries.
    """
    sound = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull()).select(
        "pattern", "at", F.to_date("at").alias("day"), "number", F.coalesce("added", F.lit(False)).alias("added"))
    last = sound.groupBy("pattern", "day", "at").agg(F.max(F.struct("number", "added"))["added"].alias("added"))
    inside = Window.partitionBy("pattern", "day").orderBy("at")
    days = last.groupBy("pattern", "day").agg(F.min("at").alias("first"))
    later = days.select("pattern", "day", F.lead("first").over(Window.partitionBy("pattern").orderBy("day")).alias("later"))
    ended = (last.withColumn("next", F.lead("at").over(inside)).join(later, ["pattern", "day"])
             .withColumn("valid_to", F.coalesce("next", "later", F.lit(FOREVER).cast("timestamp"))))
    return ended.where("added").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, copies, matches, blocked) of every different capture.

    `captures` has (page_id, url, fetched), `entries` (pattern, at, number, added).  `matches` are the
    patterns in force at the fetch time, sorted.  Captures that are repeated are answered once, with
    their number; one without a URL, host or time is matched by nothing.  The join's key is a pattern
    and a day: an interval stands in every day that captures were fetched while it held, so a host with
    a third of all captures is spread over the days, and Spark splits what is still large.
    """
    seen = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies"))
    first_day, last_day = captures.agg(F.min(F.to_date("fetched")), F.max(F.to_date("fetched"))).first()
    asked = (seen.where(F.col("fetched").isNotNull())
             .select("page_id", "url", "fetched", F.to_date("fetched").alias("day"), F.explode(patterns(F.col("url"))).alias("pattern")))
    # What holds outside of the days of captures meets none.
    held = (intervals(entries)
            .withColumn("from_day", F.greatest(F.to_date("valid_from"), F.lit(first_day).cast("date")))
            .withColumn("to_day", F.least(F.to_date("valid_to"), F.lit(last_day).cast("date")))
            .where("from_day <= to_day")
            .select("pattern", "valid_from", "valid_to", F.explode(F.sequence("from_day", "to_day")).alias("day")))
    hits = (asked.join(held, ["pattern", "day"])
            .where((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
            .groupBy("page_id", "url", "fetched").agg(F.array_join(F.array_sort(F.collect_set("pattern")), " ").alias("matches"))
            .select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched").alias("f"), "matches"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("fetched") == F.col("f"))
    return seen.join(hits, same, "left").select(
        "page_id", "url", "fetched", "copies", F.coalesce("matches", F.lit("")).alias("matches"),
        F.col("matches").isNotNull().alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from the pages table: the fetch times, which it lacks, follow from the page ids over 30 days."""
    second = F.pmod(F.col("page_id") * 7_919, F.lit(30 * DAY))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("fetched"))


def entries_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A dated list from the events table: each event adds or removes a pattern of one page's URL.

    The page is the one whose id is the event's user id.  Errors add and signups remove the host,
    clicks add and purchases remove its first path segment, views add (even event id) or remove the
    domain above the host.
    """
    named = events.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    name, kind = host(F.col("url")), F.col("event_type")
    pattern = (F.when(kind.isin("error", "signup"), name)
               .when(kind.isin("click", "purchase"), F.concat(name, F.lit("/"), first_segment(F.col("url"))))
               .when(kind == "view", F.concat(F.lit("*."), F.regexp_replace(name, r"^[^.]*\.", ""))))
    added = kind.isin("error", "click") | ((kind == "view") & (F.col("event_id") % 2 == 0))
    return named.select(pattern.alias("pattern"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), added.alias("added"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return as_of(captures_of(pages), entries_of(table(spark, sf_dir, "events"), pages))


_HOST = r"rtrim(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '.')"
_SEGMENT = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1)"
ORACLE = rf"""
WITH seen AS (
  SELECT page_id, url, make_timestamp((1704067200 + page_id * 7919 % 2592000) * 1000000) AS fetched, count(*) AS copies
  FROM pages GROUP BY ALL),
named AS (SELECT *, {_HOST} AS h, {_SEGMENT} AS s FROM seen),
listed AS (
  SELECT CASE WHEN event_type IN ('error', 'signup') THEN h
              WHEN event_type IN ('click', 'purchase') THEN h || '/' || s
              WHEN event_type = 'view' THEN '*.' || regexp_replace(h, '^[^.]*\.', '') END AS pattern,
         ts AS since, event_id AS number,
         event_type IN ('error', 'click') OR (event_type = 'view' AND event_id % 2 = 0) AS added
  FROM events JOIN (SELECT page_id, {_HOST} AS h, {_SEGMENT} AS s FROM pages) ON page_id = user_id),
entries AS (SELECT pattern, since, arg_max(added, number) AS added FROM listed WHERE pattern IS NOT NULL AND since IS NOT NULL GROUP BY pattern, since),
labels AS (SELECT *, string_split(h, '.') AS l FROM named WHERE h <> ''),
asked AS (
  SELECT DISTINCT page_id, url, fetched, pattern FROM (
    SELECT page_id, url, fetched, unnest(list_concat(
      [h, '*.' || h],
      list_transform(range(2, greatest(len(l), 2)), lambda i: '*.' || array_to_string(l[i:], '.')),
      CASE WHEN s <> '' THEN [h || '/' || s] ELSE [] END)) AS pattern
    FROM labels)),
hits AS (
  SELECT a.page_id, a.url, a.fetched, string_agg(a.pattern, ' ' ORDER BY a.pattern) AS matches
  FROM asked AS a ASOF JOIN entries AS e ON a.pattern = e.pattern AND a.fetched >= e.since
  WHERE e.added GROUP BY ALL)
SELECT n.page_id, n.url, n.fetched, n.copies, coalesce(h.matches, '') AS matches, h.matches IS NOT NULL AS blocked
FROM named AS n LEFT JOIN hits AS h USING (page_id, url, fetched)
"""
