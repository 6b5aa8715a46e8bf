"""Dates as sources state them, comparisons of open and partial dates, local days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.session import table

#: Month names in order (fixed values).
MONTHS = "January February March April May June July August September October November December".split()


def stated_date(text: Column, year: Column | None = None) -> Column:
    """struct(value, precision) of a date as written: ISO year, month or day, "Month D, YYYY", "Month YYYY" or mm/dd/yy(yy).

    A two-digit year needs ``year``, whose century it takes. What is no calendar day is unknown.
    """
    t = F.trim(text)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    named, month_year, slashed = rf"^({'|'.join(MONTHS)}) (\d{{1,2}}), (\d{{4}})$", rf"^({'|'.join(MONTHS)}) (\d{{4}})$", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    number = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("string"), 2, "0")
    two = lambda x: F.lpad(x, 2, "0")
    short = part(slashed, 3)
    full = F.when(F.length(short) == 4, short).otherwise(F.concat(F.substring(year.cast("string"), 1, 2), short) if year is not None else F.lit(None).cast("string"))
    day = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(t.rlike(named), F.concat_ws("-", part(named, 3), number(part(named, 1)), two(part(named, 2))))
        .when(t.rlike(slashed), F.concat(full, F.lit("-"), two(part(slashed, 1)), F.lit("-"), two(part(slashed, 2))))
    )
    month = F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), t).when(t.rlike(month_year), F.concat_ws("-", part(month_year, 2), number(part(month_year, 1))))
    sure = F.when(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), day)
    value = F.coalesce(sure, month, F.when(t.rlike(r"^\d{4}$"), t))
    precision = F.when(sure.isNotNull(), "day").when(month.isNotNull(), "month").when(t.rlike(r"^\d{4}$"), "year").otherwise("unknown")
    return F.struct(value.alias("value"), precision.alias("precision"))


def compare_points(a: Column, a_open: Column, b: Column, b_open: Column, ends: bool = False) -> Column:
    """before, after, same or indeterminate of two interval ends that may be open (exclusive) or null.

    With ``ends`` both are upper ends, else both are lower ends: at one instant an exclusive upper
    end comes before an inclusive one, an exclusive lower end after it.
    """
    early, late = ("before", "after") if ends else ("after", "before")
    return F.when(a.isNull() | b.isNull(), "indeterminate").when(a < b, "before").when(a > b, "after").when(a_open == b_open, "same").when(a_open, early).otherwise(late)


def shared_time(a_from: Column, a_to: Column, b_from: Column, b_to: Column, a_kind: Column, b_kind: Column) -> Column:
    """struct(state, start, stop): when both hold. Other precisions are indeterminate, no common time is disjoint.

    Null ends are open.
    """
    start, stop = F.greatest(a_from, b_from), F.least(a_to, b_to)
    state = F.when(a_kind != b_kind, "indeterminate").when(start > stop, "disjoint").otherwise("shared")
    keep = lambda x: F.when(state == "shared", x)
    return F.struct(state.alias("state"), keep(start).alias("start"), keep(stop).alias("stop"))


def compatible(earlier: Column, later: Column) -> Column:
    """Whether a partial date (year, month or day text) can be no later than another: their common length decides."""
    n = F.least(F.length(earlier), F.length(later))
    return earlier.isNull() | later.isNull() | (F.substring(earlier, F.lit(1), n) <= F.substring(later, F.lit(1), n))


def local_day(instant: Column, zone: str) -> Column:
    """The calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def since_day(checked: Column, zone: str, days: int) -> Column:
    """From which local day on a check looks for news: some days before the last check."""
    return F.date_sub(local_day(checked, zone), days)


def overlaps(low: Column, high: Column, start: str | None, end: str | None) -> Column:
    """Whether an interval of days meets [start, end]; open ends fit always, unknown intervals never if there is an end."""
    test = F.lit(True)
    if start:
        test = test & (high >= F.lit(start).cast("timestamp"))
    if end:
        test = test & (low <= F.lit(f"{end} 23:59:59.999").cast("timestamp"))
    return F.coalesce(test, F.lit(False))


def display_day(value: Column, precision: Column) -> Column:
    """A date for a citation: "5 Mar. 1996", "Mar. 1996", "1996" or "n.d."."""
    dot = lambda c: F.when(F.date_format(c, "MMM") == "May", "May").otherwise(F.concat(F.date_format(c, "MMM"), F.lit(".")))
    day, month = F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.concat(value, F.lit("-01")), F.lit("yyyy-MM-dd"))
    return (
        F.when(precision == "day", F.concat_ws(" ", F.dayofmonth(day).cast("string"), dot(day), F.year(day).cast("string")))
        .when(precision == "month", F.concat_ws(" ", dot(month), F.year(month).cast("string")))
        .when(precision == "year", value)
        .otherwise("n.d.")
    )


# --- queries: order dates written in the ways that sources write them -----------------------------


def _written(spark, d) -> DataFrame:
    o, k, day = table(spark, d, "orders"), F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy")).when(k == 3, F.date_format(day, "MMMM d, yyyy"))
        .when(k == 4, F.date_format(day, "M/d/yy")).when(k == 5, F.date_format(day, "MMMM yyyy")).otherwise(F.date_format(day, "yyyy-02-31"))
    )
    return o.select("o_orderkey", "o_orderdate", text.alias("text"), F.year("o_orderdate").alias("year"))


def _stated(spark, d):
    return _written(spark, d).select("o_orderkey", stated_date(F.col("text"), F.col("year")).alias("s")).select("o_orderkey", "s.value", "s.precision")


def _displayed(spark, d):
    return _written(spark, d).select("o_orderkey", stated_date(F.col("text"), F.col("year")).alias("s")).select("o_orderkey", display_day(F.col("s.value"), F.col("s.precision")).alias("day"))


def _points(spark, d):
    line = table(spark, d, "lineitem")
    a, b = F.to_date("l_shipdate"), F.when(F.col("l_suppkey") % 9 > 0, F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") % 3 - 1).cast("int")))
    said = lambda ends: compare_points(a, F.col("l_partkey") % 2 == 0, b, F.col("l_partkey") % 3 == 0, ends)
    return line.select("l_orderkey", "l_linenumber", said(False).alias("lower"), said(True).alias("upper"))


def _shared(spark, d):
    o = table(spark, d, "orders")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    kind = lambda n: F.when(k % n == 0, "date_time").otherwise("date")
    s = shared_time(day, F.when(k % 5 > 0, F.date_add(day, (k % 40).cast("int"))), F.date_add(day, (k % 30).cast("int")), F.date_add(day, 60), kind(11), kind(13))
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.state", F.date_format("s.start", "yyyy-MM-dd").alias("start"), F.date_format("s.stop", "yyyy-MM-dd").alias("stop"))


def _compatible(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    cut = lambda n, k: F.substring("day", F.lit(1), F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10)), (F.col("o_orderkey") % n % 3 + 1).cast("int"))) if k else None
    later = F.date_format(F.date_sub(F.to_date("day"), (F.col("o_orderkey") % 50).cast("int")), "yyyy-MM-dd")
    return o.withColumn("other", later).select("o_orderkey", compatible(cut(5, 1), F.col("other")).alias("fits"))


def _local(spark, d):
    e = table(spark, d, "events")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select("event_id", text(local_day(F.col("ts"), "-07:00")).alias("day"), text(since_day(F.col("ts"), "-07:00", 3)).alias("since"))


def _overlap(spark, d):
    o = table(spark, d, "orders")
    low = F.when(F.col("o_orderkey") % 10 > 0, F.date_trunc("month", "o_orderdate"))
    high = F.timestamp_millis(F.unix_millis(F.add_months(low, 1).cast("timestamp")) - 1)
    return o.select("o_orderkey", low.alias("low"), high.alias("high")).filter(overlaps(F.col("low"), F.col("high"), "1995-03-10", "1996-02-01")).select("o_orderkey")


_TEXT = """with w as (select o_orderkey, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y') when 3 then strftime(o_orderdate, '%B %-d, %Y')
  when 4 then strftime(o_orderdate, '%-m/%-d/%y') when 5 then strftime(o_orderdate, '%B %Y') else null end as text, o_orderdate::date as day from orders),
s as (select o_orderkey, day, o_orderkey % 7 as k, case when o_orderkey % 7 in (0, 3, 4) then 'day' when o_orderkey % 7 in (1, 5) then 'month' when o_orderkey % 7 = 2 then 'year' else 'unknown' end as precision from w)
"""

QUERIES = {
    "stated_dates": (_stated, _TEXT + "select o_orderkey, case precision when 'day' then strftime(day, '%Y-%m-%d') when 'month' then strftime(day, '%Y-%m') when 'year' then strftime(day, '%Y') end as value, precision from s"),
    "citation_days": (_displayed, _TEXT + "select o_orderkey, case when precision = 'unknown' then 'n.d.' when precision = 'year' then strftime(day, '%Y') else (case when precision = 'day' then strftime(day, '%-d ') else '' end) || replace(strftime(day, '%b') || '. ', 'May.', 'May') || strftime(day, '%Y') end as day from s"),
    "interval_end_order": (_points, """
with p as (select l_orderkey, l_linenumber, l_shipdate::date as a, case when l_suppkey % 9 > 0 then l_shipdate::date + (l_linenumber % 3 - 1)::int end as b, l_partkey % 2 = 0 as ao, l_partkey % 3 = 0 as bo from lineitem)
select l_orderkey, l_linenumber, case when b is null then 'indeterminate' when a < b then 'before' when a > b then 'after' when ao = bo then 'same' when ao then 'after' else 'before' end as lower,
  case when b is null then 'indeterminate' when a < b then 'before' when a > b then 'after' when ao = bo then 'same' when ao then 'before' else 'after' end as upper from p"""),
    "shared_valid_time": (_shared, """
with p as (select o_orderkey as k, o_orderdate::date as af, case when o_orderkey % 5 > 0 then o_orderdate::date + (o_orderkey % 40)::int end as at_, o_orderdate::date + (o_orderkey % 30)::int as bf, o_orderdate::date + 60 as bt from orders),
q as (select k, greatest(af, bf) as start, least(at_, bt) as stop, case when (k % 11 = 0) != (k % 13 = 0) then 'indeterminate' when greatest(af, bf) > least(at_, bt) then 'disjoint' else 'shared' end as state from p)
select k as o_orderkey, state, case when state = 'shared' then strftime(start, '%Y-%m-%d') end as start, case when state = 'shared' then strftime(stop, '%Y-%m-%d') end as stop from q"""),
    "partial_dates_fit": (_compatible, """
with p as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d')[1:[4, 7, 10][1 + o_orderkey % 5 % 3]] as a, strftime(o_orderdate::date - (o_orderkey % 50)::int, '%Y-%m-%d') as b from orders)
select o_orderkey, a <= b[1:length(a)] as fits from p"""),
    "local_days": (_local, "select event_id, strftime(ts - interval 7 hour, '%Y-%m-%d') as day, strftime((ts - interval 7 hour)::date - 3, '%Y-%m-%d') as since from events"),
    "publication_overlap": (_overlap, "select o_orderkey from orders where o_orderkey % 10 > 0 and date_trunc('month', o_orderdate) + interval 1 month > timestamp '1995-03-10' and date_trunc('month', o_orderdate) <= timestamp '1996-02-01'"),
}
