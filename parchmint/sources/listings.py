"""A publisher's dated listings as a data source of Spark, with partitions planned from stated counts.

A folder holds a table of entries for each day (day=2024-01-31/...) and another states how many there are
on each day. The reader halves the range of days until each part holds fewer entries than a limit, so
no task reads much more than that, and one day stands however large it is. A day whose entries are not
as many as stated has drifted: it is read again until two readings agree.

As a stream, the last day that was read is the offset; later days are planned the same way.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from parchmint.session import fresh_path, ship, table

#: Entries of a part, readings of a day that does not settle.
LIMIT, READINGS = 10_000, 5
SCHEMA = "day date, number string, title string, low date, high date, drifted boolean, settled boolean"
_DAY = datetime.timedelta(days=1)


def split_range(days: int, count: Callable[[int, int], int], limit: int) -> list[tuple[int, int]]:
    """Ranges of days [first, last] with fewer than ``limit`` rows each: a full one is halved again and again, one day stands.

    ``count`` says how many rows lie in a range; it runs on the driver, over the counts of days.
    """
    todo, done = [(0, days - 1)], []
    while todo:
        low, high = todo.pop()
        if low == high or count(low, high) < limit:
            done.append((low, high))
        else:
            mid = (low + high) // 2
            todo += [(mid + 1, high), (low, mid)]
    return done


def planned(stated: dict[datetime.date, int], limit: int) -> list[tuple[datetime.date, datetime.date]]:
    """Ranges of days from the first to the last stated one; a row a day on the driver."""
    if not stated:
        return []
    first, last = min(stated), max(stated)
    upto, total = [], 0
    for i in range((last - first).days + 1):
        total += stated.get(first + i * _DAY, 0)
        upto.append(total)
    ranges = split_range(len(upto), lambda low, high: upto[high] - (upto[low - 1] if low else 0), limit)
    return [(first + low * _DAY, first + high * _DAY) for low, high in ranges if upto[high] > (upto[low - 1] if low else 0)]


@dataclass
class Range(InputPartition):
    """Days that one task reads, with their stated counts."""

    low: datetime.date
    high: datetime.date
    stated: dict


class Folder:
    """A folder of listings and its statement of counts, by Arrow's file systems (local, HDFS, S3 and others by their address)."""

    def __init__(self, options: dict):
        self.entries, self.counts = options["entries"], options["counts"]
        self.limit = int(options.get("limit", LIMIT))

    @staticmethod
    def _rows(address: str) -> pa.Table | None:
        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", address))
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return ds.dataset(path, filesystem=system, format="parquet").to_table()

    def stated(self) -> dict[datetime.date, int]:
        found = self._rows(self.counts)
        return {} if found is None else dict(zip(pc.cast(found["day"], pa.date32()).to_pylist(), found["n"].to_pylist()))

    def day(self, day: datetime.date) -> list[tuple[str, str]]:
        """The entries of a day as they are now."""
        found = self._rows(f"{self.entries.rstrip('/')}/day={day.isoformat()}")
        return [] if found is None else list(zip(found["number"].to_pylist(), found["title"].to_pylist()))

    def read(self, part: Range) -> Iterator[tuple]:
        day = part.low
        while day <= part.high:
            rows = self.day(day)
            drifted, settled, tries = len(rows) != part.stated.get(day, 0), True, 1
            while drifted:
                again = self.day(day)
                tries += 1
                settled = sorted(again) == sorted(rows)
                rows = again
                if settled or tries >= READINGS:
                    break
            for number, title in rows:
                yield day, number, title, part.low, part.high, drifted, settled
            day += _DAY

    def parts(self, stated: dict[datetime.date, int]) -> list[Range]:
        return [Range(low, high, {d: n for d, n in stated.items() if low <= d <= high}) for low, high in planned(stated, self.limit)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self) -> list[Range]:
        return self.folder.parts(self.folder.stated())

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.folder.read(partition)


class StreamReader(DataSourceStreamReader):
    """Days after the last one that was read; a day's entries are read once it is stated."""

    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"day": "0001-01-01"}

    def latestOffset(self) -> dict:
        return {"day": max(self.folder.stated(), default=datetime.date.min).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (datetime.date.fromisoformat(x["day"]) for x in (start, end))
        return self.folder.parts({d: n for d, n in self.folder.stated().items() if low < d <= high})

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.folder.read(partition)


class Listings(DataSource):
    """``spark.read.format("listings")`` with the options entries, counts and limit."""

    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark).dataSource.register(Listings)


def write(entries: DataFrame, entries_at: str, counts_at: str) -> None:
    """Entries (day, number, title) as a folder of listings with its statement."""
    entries.select("day", "number", "title").repartition("day").write.partitionBy("day").mode("append").parquet(entries_at)
    entries.groupBy("day").agg(F.count("*").alias("n")).write.mode("append").parquet(counts_at)


# --- queries --------------------------------------------------------------------------------------


def _entries(spark, d) -> DataFrame:
    """Orders as a register's entries, on the first day of their month."""
    return table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("day"), F.col("o_orderkey").cast("string").alias("number"), F.col("o_orderpriority").alias("title"))


def _listed(spark, d):
    """All entries through the data source, in parts of fewer than a twentieth of them."""
    rows = _entries(spark, d)
    register(spark)
    base = fresh_path(spark, "listing")
    write(rows, f"{base}/entries", f"{base}/counts")
    limit = rows.count() // 20 + 1
    found = spark.read.format("listings").option("entries", f"{base}/entries").option("counts", f"{base}/counts").option("limit", limit).load()
    return found.select(F.col("number").cast("long").alias("o_orderkey"), "day", "title", "low", "high", "drifted")


#: Ranges of [days] by halving, from a table n (day, n) and a limit: a range that is full and longer than a day is halved.
HALVED = """
c as (select day, sum(n) over (order by day) as upto, n from n), ends as (select min(day) as a, max(day) as b from n),
r as (
  select 0 as low, (b - a)::int as high, (select sum(n) from n) as rows from ends
  union all
  select x.low, x.high, (select coalesce(sum(n), 0) from n, ends where day between a + x.low and a + x.high)
  from (select unnest([{'low': low, 'high': (low + high) // 2}, {'low': (low + high) // 2 + 1, 'high': high}]) as x from r where rows >= (select l from lim) and low < high)),
leaf as (select low, high, rows from r where (rows < (select l from lim) or low = high) and rows > 0)
"""

QUERIES = {
    "listing_rows": (_listed, """
with recursive n as (select date_trunc('month', o_orderdate)::date as day, count(*) as n from orders group by 1), lim as (select count(*) // 20 + 1 as l from orders),""" + HALVED + """
select o_orderkey, date_trunc('month', o_orderdate)::date as day, o_orderpriority as title, a + low as low, a + high as high, false as drifted
from orders, ends join leaf on true where date_trunc('month', o_orderdate)::date between a + low and a + high"""),
}
