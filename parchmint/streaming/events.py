"""Windowed counts, sessions and repeat removal; the same functions take a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import table


def window_counts(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """start, event_type, n of tumbling windows; a stream drops what comes later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: runs of a user's events that are less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_only(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys; a stream forgets keys after ``late``."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def rate_excess(events: DataFrame, limit: int, size: str = "1 minute") -> DataFrame:
    """user_id, start, n of windows with more than ``limit`` events."""
    counted = events.groupBy("user_id", F.window("ts", size)).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return counted.select("user_id", F.col("window.start").alias("start"), "n")


def current(spark, path: str) -> tuple[int, DataFrame | None]:
    """(version, table) of the newest whole version under ``path``; (-1, None) where there is none.

    A version counts once Spark's writer has marked it whole by _SUCCESS.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1, None
    whole = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName()[:1] == "v" and s.getPath().getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (max(whole), spark.read.parquet(f"{path}/v{max(whole)}")) if whole else (-1, None)


def upsert(batch: DataFrame, path: str, key: str, order: str, batch_id: int | None = None) -> None:
    """For foreachBatch: the latest row of each key, merged with the newest version at ``path`` into the next one.

    No version is ever written over: a crash leaves a version without _SUCCESS, which is ignored and
    replaced by the next run. With ``batch_id`` a batch that is run again builds on the version before it.
    """
    spark = batch.sparkSession
    at, rows = current(spark, path)
    if batch_id is not None and at >= batch_id:
        return
    both = batch if rows is None else rows.unionByName(batch)
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in batch.columns]
    latest = both.groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(*columns), F.col(order)).alias("row")).select("row.*")
    latest.write.mode("overwrite").parquet(f"{path}/v{at + 1 if batch_id is None else batch_id}")


def _windows(spark, d):
    return window_counts(table(spark, d, "events"), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def _sessions(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions(table(spark, d, "events"), "2 hours").select("user_id", text("start"), "n")


def _rates(spark, d):
    return rate_excess(table(spark, d, "events"), 1, "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _first(spark, d):
    return first_only(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


def _cube(spark, d):
    return table(spark, d, "events").cube("event_type", (F.col("user_id") % 5).alias("shard")).agg(F.count("*").alias("n"))


QUERIES = {
    "window_counts": (_windows, "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all"),
    "session_windows": (_sessions, """
with g as (select user_id, ts, case when ts < lag(ts) over w + interval 2 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k"""),
    "rate_excess": (_rates, "select user_id, strftime(time_bucket(interval 6 hours, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events group by all having count(*) > 1"),
    "first_events": (_first, "select distinct user_id, event_type from events"),
    "event_cube": (_cube, "select event_type, user_id % 5 as shard, count(*) as n from events group by cube (event_type, user_id % 5)"),
}
