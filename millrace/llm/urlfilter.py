"""Temporal URL lists: dated entries become validity intervals, and each capture meets those valid when it was fetched.

An entry says from when on a list has an action (block, allow, or remove) for a value: a host, a domain with all below
it, or a host with a path prefix. The next entry of the same list, scope and value ends it. A capture's URL has a few
keys (its host, each parent domain, each directory prefix), which meet entries by equality; the as-of condition is the
rest of that join, so that a host with a third of all captures is a skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and last dot; empty if there is none."""
    h = F.regexp_replace(F.regexp_extract(url, HOST, 1), "^.*@", "")
    return F.regexp_replace(F.lower(h), r"\.?(:[0-9]*)?$", "")


def _keys(url: Column) -> Column:
    """Array of (scope, value, specificity)."""
    h, path = host(url), F.regexp_extract(url, PATH, 1)
    entry = lambda scope, value, level: F.struct(F.lit(scope).alias("scope"), value.alias("value"), level.cast("int").alias("level"))

    def domains(labels: Column) -> Column:
        n = F.size(labels)
        return F.transform(F.sequence(F.lit(1), n), lambda i: entry("domain", F.array_join(F.slice(labels, i, n), "."), n - i + 1))

    def prefixes(parts: Column) -> Column:
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(2), n), lambda i: entry("prefix", F.concat(h, F.array_join(F.slice(parts, 1, i), "/")), F.lit(1000) + i))

    bind = lambda value, f: F.transform(F.array(value), f)[0]
    none = F.array().cast("array<struct<scope:string,value:string,level:int>>")
    with_path = F.when(F.length(path) > 1, bind(F.split(F.regexp_replace(path, "/+$", ""), "/"), lambda p: F.when(F.size(p) > 1, prefixes(p)).otherwise(none))).otherwise(none)
    return F.when(h != "", F.concat(F.array(entry("host", h, F.lit(1000))), bind(F.split(h, r"\."), domains), with_path)).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """list_id, scope, value, action, valid_from, valid_to (null: still valid), of entries whose action is not remove.

    Of entries of one list, scope, value and date, the last by action's name holds. Null dates, values or actions are left out.
    """
    key = ["list_id", "scope", "value"]
    one = entries.filter("listed_at is not null and value is not null and action is not null and scope is not null").groupBy(*key, "listed_at").agg(F.max("action").alias("action"))
    after = F.lead("listed_at").over(Window.partitionBy(*key).orderBy("listed_at"))
    return one.withColumn("valid_to", after).filter("action <> 'remove'").select(*key, "action", F.col("listed_at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, host, active (valid entries that match), decision (block, allow or none), and the rule: list_id, scope, value.

    The most specific match decides: a longer prefix, then the host, then the domain of most labels; of equal ones the
    latest, then block before allow, then the least list. Null URLs, URLs without a host, and null fetch dates match
    nothing. Captures that repeat an id and a URL and a date give one row each. Entries: list_id, scope, value, action,
    listed_at. Captures: page_id, url, fetched_at; other columns are not read. No captures give an empty result.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    keyed = rows.filter("fetched_at is not null").distinct().select("page_id", "url", "fetched_at", F.explode(_keys(F.col("url"))).alias("k")).select("page_id", "url", "fetched_at", "k.*")
    valid = intervals(entries)
    met = keyed.join(valid, ["scope", "value"]).filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    won = met.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("active"), F.min_by(F.struct("action", "list_id", "scope", "value"), F.struct(-F.col("level"), -F.unix_micros(F.col("valid_from").cast("timestamp_ltz")), F.when(F.col("action") == "block", 0).otherwise(1), F.col("list_id"))).alias("w"))
    won = won.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("f"), "active", "w")
    out = rows.join(won, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f")), "left")
    none = F.coalesce("w.action", F.lit("none")).alias("decision")
    return out.select("page_id", "url", "fetched_at", host(F.coalesce("url", F.lit(""))).alias("host"), F.coalesce("active", F.lit(0)).cast("long").alias("active"), none, F.col("w.list_id").alias("list_id"), F.col("w.scope").alias("scope"), F.col("w.value").alias("value"))


def _draw(value: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 6), 16, 10).cast("int")


def dated(pages: DataFrame) -> DataFrame:
    """Captures of the pages: a page is fetched on a day of 2024 that its id gives."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A list for each of three scopes, from the hosts of the pages themselves: the rule draws from a digest of the value."""
    hosts = pages.select(host(F.col("url")).alias("value")).filter("value <> ''").distinct()
    domains = hosts.select(F.substring_index("value", ".", -2).alias("value")).distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    row = lambda df, which, list_id, scope, value, action, at: df.filter(which).select(F.lit(list_id).alias("list_id"), F.lit(scope).alias("scope"), value.alias("value"), F.lit(action).alias("action"), day(at).alias("listed_at"))
    v = F.col("value")
    a, b = _draw(v, "a"), _draw(v, "b")
    return (
        row(hosts, a % 3 == 0, "hosts", "host", v, "block", a % 200)
        .unionAll(row(hosts, (a % 3 == 0) & (b % 2 == 0), "hosts", "host", v, "remove", a % 200 + 1 + b % 160))
        .unionAll(row(hosts, a % 5 == 0, "paths", "prefix", F.concat(v, F.lit("/en")), "allow", b % 300))
        .unionAll(row(domains, a % 2 == 0, "domains", "domain", v, "block", b % 366))
        .unionAll(row(domains, a % 4 == 0, "domains", "domain", v, "allow", b % 366 + 40))
    )


SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched_at,
  regexp_replace(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '\.?(:[0-9]*)?$', '') AS host,
  regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
h AS (SELECT DISTINCT host AS value FROM p WHERE host <> ''),
hd AS (SELECT value, CAST('0x' || substr(md5('a' || value), 1, 6) AS INTEGER) AS a, CAST('0x' || substr(md5('b' || value), 1, 6) AS INTEGER) AS b FROM h),
d AS (SELECT DISTINCT array_to_string(string_split(value, '.')[-2:], '.') AS value FROM h),
dd AS (SELECT value, CAST('0x' || substr(md5('a' || value), 1, 6) AS INTEGER) AS a, CAST('0x' || substr(md5('b' || value), 1, 6) AS INTEGER) AS b FROM d),
e AS (SELECT 'hosts' AS list_id, 'host' AS scope, value, 'block' AS action, DATE '2024-01-01' + a % 200 AS listed_at FROM hd WHERE a % 3 = 0
  UNION ALL SELECT 'hosts', 'host', value, 'remove', DATE '2024-01-01' + (a % 200 + 1 + b % 160) FROM hd WHERE a % 3 = 0 AND b % 2 = 0
  UNION ALL SELECT 'paths', 'prefix', value || '/en', 'allow', DATE '2024-01-01' + b % 300 FROM hd WHERE a % 5 = 0
  UNION ALL SELECT 'domains', 'domain', value, 'block', DATE '2024-01-01' + b % 366 FROM dd WHERE a % 2 = 0
  UNION ALL SELECT 'domains', 'domain', value, 'allow', DATE '2024-01-01' + (b % 366 + 40) FROM dd WHERE a % 4 = 0),
i AS (SELECT *, lead(listed_at) OVER (PARTITION BY list_id, scope, value ORDER BY listed_at) AS valid_to FROM e),
k AS (SELECT page_id, url, fetched_at, 'host' AS scope, host AS value, 1000 AS level FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'domain', array_to_string(string_split(host, '.')[n:], '.'), len(string_split(host, '.')) - n + 1 FROM p, range(1, 40) r(n) WHERE host <> '' AND n <= len(string_split(host, '.'))
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', host || array_to_string(string_split(path, '/')[1:n], '/'), 1000 + n FROM p, range(2, 60) r(n) WHERE host <> '' AND length(path) > 0 AND n <= len(string_split(path, '/'))),
m AS (SELECT k.page_id, k.url, k.fetched_at, i.action, i.list_id, i.scope, i.value, k.level, i.listed_at FROM k JOIN i ON k.scope = i.scope AND k.value = i.value
  WHERE i.action <> 'remove' AND k.fetched_at >= i.listed_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)),
w AS (SELECT *, count(*) OVER (PARTITION BY page_id, url) AS active, row_number() OVER (PARTITION BY page_id, url ORDER BY level DESC, listed_at DESC, CASE WHEN action = 'block' THEN 0 ELSE 1 END, list_id) AS rn FROM m)
SELECT p.page_id, p.url, CAST(p.fetched_at AS VARCHAR) AS fetched_on, p.host, coalesce(w.active, 0) AS active, coalesce(w.action, 'none') AS decision, w.list_id, w.scope, w.value
FROM p LEFT JOIN (SELECT * FROM w WHERE rn = 1) w ON p.page_id = w.page_id AND p.url = w.url
"""
