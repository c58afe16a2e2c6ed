"""URL filters with dated lists, in DataFrame operations only.

A list is a history of entries, each added or removed at a time. Its changes become intervals in which an entry is valid,
and every capture is judged by the entries valid when it was fetched: an as-of join on each suffix of the capture's host.
Captures are first reduced to their distinct hosts and times. The intervals of an entry are one sorted array, in which each
capture finds the last that began by its time in a few halvings; a host with very many captures is one side of a plain join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port or closing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"\.$", ""))
    return F.when(F.length(host) > 0, host)


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, down to the last label."""
    labels = F.split(host, r"\.")
    cut = lambda n: F.array_join(F.slice(labels, n, F.size(labels)), ".")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), cut)


def validity(changes: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of (pattern, added, at); a null end is open. Added wins over removed at the same time."""
    usable = changes.filter("pattern is not null and at is not null").groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    following = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return usable.withColumn("valid_to", following).filter("added").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def begun(starts: Column, time: Column) -> Column:
    """How many of the sorted times `starts` aren't after `time`, by bisection."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        left = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(starts, middle) <= time, right).otherwise(left)

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi")), halved)["lo"]


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether each capture was listed when it was fetched.

    captures: page_id, url, fetched_at timestamp (more columns are ignored); changes: pattern (a host or any domain above it,
    a last label alone too; an entry with a scheme, port or path matches nothing), added boolean, at timestamp. Returns per row
    of captures: page_id, host, fetched_at, listed, pattern (the longest that was valid), valid_from. A URL without a scheme or
    host and a capture without a time are not listed; a URL may be of any length; repeated rows are judged alike; an empty list
    lists nothing; an empty table gives an empty result.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    distinct = rows.filter("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    asked = distinct.withColumn("pattern", F.explode(suffixes(F.col("host"))))
    spans = validity(changes).groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("spans"))
    # The starts are a column before the join: within the bisection they would be made anew at each step.
    spans = spans.withColumn("starts", F.transform("spans", lambda s: s["valid_from"]))
    last = F.get("spans", begun(F.col("starts"), F.col("fetched_at")) - 1)
    met = asked.join(spans, "pattern").select("host", "fetched_at", "pattern", last.alias("span"))
    valid = F.col("span").isNotNull() & (F.col("span.valid_to").isNull() | (F.col("fetched_at") < F.col("span.valid_to")))
    hit = F.struct(F.length("pattern").alias("n"), "pattern", F.col("span.valid_from").alias("valid_from"))
    verdict = met.filter(valid).groupBy("host", "fetched_at").agg(F.max(hit).alias("hit"))
    judged = rows.join(verdict, ["host", "fetched_at"], "left")
    return judged.select("page_id", "host", "fetched_at", F.col("hit").isNotNull().alias("listed"), F.col("hit.pattern").alias("pattern"), F.col("hit.valid_from").alias("valid_from"))
