"""URL filters as a temporal list join (operator 8), with DataFrame functions only.

Dated list events (add, remove) become validity intervals per entry; each capture is expanded to the
keys that an entry could have (its host's domains, its host with each leading path), and an as-of
join keeps the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many intervals (about 100 bytes each) the list is broadcast; beyond, both sides are salted.
BROADCAST_ROWS = 200_000
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    rest = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "[/?#].*$", ""), "^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(rest, ":[0-9]*$", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment; empty if there is none."""
    rest = F.regexp_replace(F.trim(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All keys under which an entry matches: the host's domains of two labels or more, and the host with each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """Events ``(list, entry, action, day)`` → ``(list, entry, valid_from, valid_to)``, open ends null.

    An entry is active from an ``add`` to the next ``remove``; repeated adds extend it, stray removes
    do nothing, and of an add and a remove on one day the remove counts.  Null or blank entries and
    days, and other actions, are ignored.  Entries are matched in lower case, without final slashes.
    """
    entry = F.regexp_replace(F.trim("entry"), "/+$", "")
    slash = F.instr(entry, "/")
    entry = F.when(slash > 0, F.concat(F.lower(F.substring_index(entry, "/", 1)), F.expr("substring(regexp_replace(trim(entry), '/+$', ''), instr(regexp_replace(trim(entry), '/+$', ''), '/'))"))).otherwise(F.lower(entry))
    clean = events.select("list", entry.alias("entry"), F.lower("action").alias("action"), F.col("day").cast("date").alias("day"))
    clean = clean.filter("entry <> '' and day is not null and action in ('add', 'remove')")
    daily = clean.groupBy("list", "entry", "day").agg(F.max("action").alias("action"))  # 'remove' is the larger
    order = Window.partitionBy("list", "entry").orderBy("day")
    turns = daily.withColumn("before", F.lag("action").over(order)).filter("before is null or before <> action")
    turns = turns.withColumn("valid_to", F.lead("day").over(order))
    return turns.filter("action = 'add'").select("list", "entry", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures(capture_id, url, fetched)`` → ``(capture_id, host, blocked, n_entries, lists, entries)``, one row each.

    A capture with null url or fetch day matches nothing.  Rows with one capture_id share their hits.
    """
    active = intervals(events)
    spread = captures.select("capture_id", F.col("fetched").cast("date").alias("fetched"), F.explode(keys_of(F.col("url"))).alias("entry"))
    if active.count() <= BROADCAST_ROWS:
        joined = spread.join(F.broadcast(active), "entry")
    else:
        salted = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = spread.withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).join(salted, ["entry", "salt"])
    hits = joined.filter("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    hits = hits.groupBy("capture_id").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.sort_array(F.collect_set("entry")).alias("entries"))
    hits = hits.select(F.col("capture_id").alias("_id"), "lists", "entries")
    out = captures.select("capture_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")).join(hits, F.col("capture_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "capture_id", "host", F.col("entries").isNotNull().alias("blocked"), F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", none).alias("lists"), F.coalesce("entries", none).alias("entries"),
    )
