"""Queries that run streams: table rows are written as files in the order of their time, and a stream reads them to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.stepwise import Steps
from millrace.plans.base import EV, events, query
from millrace.streaming import live
from millrace.streaming import replay as R
from millrace.streaming import stateful as T

_LATER = 10 * 365 * 86_400  # seconds after all recorded ones


def _log(spark, d):
    return events(spark, d).select((F.col("user_id") % 8).alias("log"), "event_id", "sec")


def _end(rows):
    """A row without a request or entry of a log, long after the last."""
    return [F.lit(-1).cast(rows.schema[0].dataType).alias(rows.columns[0]), F.lit(None).cast("long").alias(rows.columns[1]), F.lit(rows.agg(F.max("sec")).first()[0] + _LATER).cast("long").alias("sec")]


@query("coalesced_stream", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id % 8 AS log, event_id, sec, row_number() OVER (PARTITION BY user_id % 8 ORDER BY sec, event_id) AS r FROM ev),
s AS (SELECT log, event_id, sec, r, 0::BIGINT AS batch, 1 AS n, sec AS began FROM o WHERE r = 1 UNION ALL
SELECT o.log, o.event_id, o.sec, o.r, batch + CASE WHEN n >= 4 OR o.sec - began >= 3600 THEN 1 ELSE 0 END, CASE WHEN n >= 4 OR o.sec - began >= 3600 THEN 1 ELSE n + 1 END, CASE WHEN n >= 4 OR o.sec - began >= 3600 THEN o.sec ELSE began END FROM s JOIN o ON o.log = s.log AND o.r = s.r + 1)
SELECT log, event_id, sec, batch FROM s""")
def _(spark, d):
    steps, rows = Steps(spark, "coalesced"), _log(spark, d)
    return R.finished(T.coalesced_batches(R.replayed(rows, "sec", 2, steps, _end(rows)), "log", "event_id", "sec", 4, 3600), "append", steps)


@query("expired_entries", f"""WITH {EV}, g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS entry FROM g)
SELECT user_id, entry::BIGINT AS entry, min(sec) AS since, max(sec) AS until, count(*) AS uses FROM e GROUP BY user_id, entry""")
def _(spark, d):
    """A user's entry goes when it is not used for six hours."""
    steps = Steps(spark, "expired")
    rows = events(spark, d).select("user_id", "event_id", "sec")
    end = [F.lit(-1).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), F.lit(rows.agg(F.max("sec")).first()[0] + _LATER).cast("long").alias("sec")]
    out = R.finished(T.ended_entries(R.replayed(rows, "sec", 2, steps, end), "user_id", "sec", 21_600), "append", steps)
    return T.numbered(out.filter("user_id >= 0"), "user_id")


@query("report_stream", f"WITH {EV} SELECT event_type, count(*) AS count, count(*) FILTER (WHERE cents >= 5000) AS correct, coalesce(count(*) FILTER (WHERE cents >= 5000)::DOUBLE / nullif(count(cents >= 5000), 0), 0) AS accuracy FROM ev GROUP BY event_type")
def _(spark, d):
    """The report that is written again after each batch, as it stands at the end."""
    steps = Steps(spark, "report")
    rows = events(spark, d).select("event_type", "sec", (F.col("cents") >= 5000).alias("ok"))
    return R.finished(live.running_report(R.replayed(rows, "sec", 2, steps), "event_type", "ok"), "complete", steps)


@query("dedupe_stream", f"WITH {EV} SELECT DISTINCT user_id % 40 AS call_id FROM ev")
def _(spark, d):
    """Calls that come again within the time that ids are kept for, which here is all time."""
    steps = Steps(spark, "dedupe")
    rows = events(spark, d).select((F.col("user_id") % 40).alias("call_id"), "sec")
    stream = R.replayed(rows, "sec", 2, steps).withColumn("at", F.timestamp_seconds("sec"))
    return R.finished(live.distinct_calls(stream, "at", "call_id", "3650 days"), "append", steps).select("call_id")


@query("upsert_stream", f"WITH {EV} SELECT user_id, max_by(event_id, {{'s': sec, 'e': event_id}}) AS event_id, max_by(event_type, {{'s': sec, 'e': event_id}}) AS event_type FROM ev GROUP BY user_id")
def _(spark, d):
    """A user's last event, from a table that each batch renews."""
    steps = Steps(spark, "upsert")
    rows = events(spark, d).select("user_id", "event_id", "event_type", "sec", (F.col("sec") * 10_000_000 + F.col("event_id")).alias("version"))
    stream = R.replayed(rows, "sec", 2, steps)
    R.ran(lambda s: live.upserted(s, f"{steps.root}/store", "user_id", "version", f"{steps.root}/upserts"), stream, steps)
    return live.newest_version(spark, f"{steps.root}/store").select("user_id", "event_id", "event_type")


@query("hysteresis_stream", f"WITH {EV}, m AS (SELECT *, CASE WHEN cents >= 9000 THEN 1 WHEN cents < 4000 THEN 0 END AS k FROM ev) SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS readings, coalesce(max_by(k, {{'s': sec, 'e': event_id}}) FILTER (WHERE k IS NOT NULL), 0) = 1 AS paused FROM m GROUP BY user_id")
def _(spark, d):
    """How the switch of each user stands after the last reading."""
    steps = Steps(spark, "hysteresis")
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("user_id"), "cents", "sec", (F.col("sec") * 10_000_000 + F.col("event_id")).alias("ordinal"))
    return R.latest(R.finished(live.hysteresis(R.replayed(rows, "sec", 2, steps), "user_id", "cents", 9000, 4000, None), "update", steps), "user_id")


@query("windowed_stream", f"WITH {EV} SELECT sec // 3600 * 3600 AS hour_start, event_type, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    """Hours as they close behind the watermark."""
    steps = Steps(spark, "windows")
    rows = events(spark, d).select("event_type", F.col("event_id").alias("id"), "sec")
    end = [F.lit("end").alias("event_type"), F.lit(-1).cast("long").alias("id"), F.lit(rows.agg(F.max("sec")).first()[0] + _LATER).cast("long").alias("sec")]
    stream = R.replayed(rows, "sec", 2, steps, end).withColumn("at", F.timestamp_seconds("sec"))
    out = R.finished(live.windowed_counts(stream, "at", "event_type", "1 hour", "0 seconds"), "append", steps)
    return out.select(F.unix_timestamp("window.start").alias("hour_start"), "event_type", "n").filter("event_type <> 'end'")
