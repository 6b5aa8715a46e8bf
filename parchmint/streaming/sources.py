"""The state of sources as a stream: last known good, first and last seen, health, and silence.

Each source has keyed state that any later reading can only move forward, whatever the order in which
readings come, so the stream's rows equal ``states`` over all that has come so far, after each batch and
after a restart from the checkpoint. A timer in event time turns a source stale that has been silent for
longer than it may be; its next reading ends that.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from parchmint.session import fresh_path, ship, table

STATE = "first_seen timestamp, last_seen timestamp, last_ok boolean, last_digest string, good_at timestamp, digest string, timer long"
COLUMNS = "source string, first_seen timestamp, last_seen timestamp, digest string, health string, stale boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(key, s: tuple, stale: bool) -> pd.DataFrame:
    first, last, ok, _, _, digest = s[:6]
    health = "healthy" if ok else "degraded" if digest is not None else "failed"
    return pd.DataFrame({"source": [key[0]], "first_seen": [first], "last_seen": [last], "digest": [digest], "health": [health], "stale": [stale]})


def movers(part: pd.DataFrame, few: int = 64) -> pd.DataFrame:
    """Of many readings of a source those that can move its state: the first, the last, and the last good ones."""
    if len(part) <= few:
        return part
    at = part["at"]
    good = at.where(part["ok"].astype(bool))
    return part[(at == at.min()) | (at == at.max()) | (good == good.max())]


class SourceState(StatefulProcessor):
    """State of one source; ``silence`` (seconds) is how long it may say nothing.

    Each call to the state's store is a message to the JVM, so a batch reads and writes a source once: a
    timer stays where it is set and moves on when it fires too early.
    """

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self._known()
        timer = found[6] if found else None
        found = found and found[:6]
        for part in map(movers, rows):
            for at, ok, digest in zip(part["at"], part["ok"], part["digest"]):
                at, ok = at.to_pydatetime(), bool(ok)
                first, last, last_ok, last_digest, good_at, good = found or (at, None, None, None, None, None)
                now = (at, ok, digest or "")
                if last is None or now > (last, last_ok, last_digest):
                    last, last_ok, last_digest = now
                if ok and (good_at is None or (at, digest) > (good_at, good)):
                    good_at, good = at, digest
                found = (min(first, at), last, last_ok, last_digest, good_at, good)
        due = self._due(found)
        silent = due <= timerValues.getCurrentWatermarkInMs()
        if silent and timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        elif not silent and timer is None:
            self.handle.registerTimer(due)
            timer = due
        self.state.update((*found, timer))
        yield _row(key, found, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._known()
        due = self._due(found)
        silent = due <= timerValues.getCurrentWatermarkInMs()
        if not silent:
            self.handle.registerTimer(due)
        self.state.update((*found[:6], None if silent else due))
        if silent:
            yield _row(key, found, True)

    def _known(self) -> tuple | None:
        """The state, or None before the first reading."""
        found = self.state.get()
        return None if found is None else tuple(None if x is pd.NaT else x for x in found)

    def _due(self, found: tuple) -> int:
        """When the source has been silent for too long, in milliseconds."""
        return int((found[1] - datetime.datetime(1970, 1, 1)).total_seconds() * 1000) + self.silence * 1000

    def close(self) -> None:
        pass


def follow(readings: DataFrame, silence: int, late: str = "0 seconds") -> DataFrame:
    """source, first_seen, last_seen, digest (last good), health, stale: a row for each source that a batch concerns.

    readings: a stream of source, at, ok, digest.
    """
    spark = ship(readings.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = readings.select(F.col("source").cast("string").alias("source"), "at", F.coalesce("ok", F.lit(False)).alias("ok"), "digest").withWatermark("at", late)
    return rows.groupBy("source").transformWithStateInPandas(SourceState(silence), outputStructType=COLUMNS, outputMode="Update", timeMode="EventTime")


def states(readings: DataFrame) -> DataFrame:
    """The same for a table, without staleness: what the stream has told once it has seen all of it."""
    ok = F.coalesce("ok", F.lit(False))
    last = F.max(F.struct("at", ok.alias("ok"), F.coalesce("digest", F.lit("")).alias("digest")))
    good = F.max(F.when(ok, F.struct("at", "digest")))
    rows = readings.groupBy(F.col("source").cast("string").alias("source")).agg(F.min("at").alias("first_seen"), last.alias("last"), good.alias("good"))
    health = F.when(F.col("last.ok"), "healthy").when(F.col("good.digest").isNotNull(), "degraded").otherwise("failed")
    return rows.select("source", "first_seen", F.col("last.at").alias("last_seen"), F.col("good.digest").alias("digest"), health.alias("health"))


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each source among all that a stream has written, with the batch that wrote it."""
    return changes.groupBy("source").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "source"]), "batch").alias("x")).select("source", "x.*")


def run_to_end(stream: DataFrame, at: str) -> DataFrame:
    """All rows of a stream over what is there now, written below ``at`` with their batch; a next run goes on from the checkpoint."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/batch_{batch}")  # a batch that runs again writes the same rows

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(f"{COLUMNS}, batch long").parquet(f"{at}/rows")


# --- queries --------------------------------------------------------------------------------------


def _readings(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 5 > 1).alias("ok"), F.md5("props").alias("digest"))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Users as sources: the events in four files, read as a stream in four batches."""
    at = fresh_path(spark, "stream")
    events = table(spark, d, "events")
    events.repartitionByRange(4, "ts").write.parquet(f"{at}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/events")
    found = latest(run_to_end(follow(_readings(stream), 10**9, "36500 days"), at))
    return found.select("source", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "digest", "health")


def _stated(spark, d):
    found = states(_readings(table(spark, d, "events")))
    return found.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})


_SQL = """
with e as (select user_id::varchar as source, ts, event_id % 5 > 1 as ok, md5(props) as digest from events),
a as (select source, min(ts) as first_seen, max(struct_pack(a := ts, b := ok, c := digest)) as last, max(struct_pack(a := ts, b := digest)) filter (ok) as good from e group by source)
select source, epoch_us(first_seen) as first_seen, epoch_us(last.a) as last_seen, good.b as digest, case when last.b then 'healthy' when good.b is not null then 'degraded' else 'failed' end as health from a"""
QUERIES = {"streamed_source_states": (_streamed, _SQL), "source_states": (_stated, _SQL)}
