"""Imprecise dates, version selection as of a date, and order checks.

A date is (value, precision) with precision year, month, day or unknown. It stands for the interval
of instants [lower, upper]; unknown dates have none and are reported, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import table

#: Why a version is not selected, in the order in which reasons are tried.
REASONS = ("not_yet_observed_in_corpus", "unknown_source_availability", "future_source_version", "partial_date_crosses_cutoff", "no_source_effective_event_by_cutoff", "later_source_repeal_or_withdrawal_event")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row and not copied into every place that names it."""
    return F.transform(F.array(value), body)[0]


def lower_bound(value: Column, precision: Column) -> Column:
    """First instant of a date; null if unknown or malformed."""
    full = F.when(precision == "year", F.concat(value, F.lit("-01-01"))).when(precision == "month", F.concat(value, F.lit("-01"))).when(precision == "day", value)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd"))


def upper_bound(value: Column, precision: Column) -> Column:
    """Last millisecond of a date."""
    low = lower_bound(value, precision)
    end = F.when(precision == "year", F.add_months(low, 12)).when(precision == "month", F.add_months(low, 1)).when(precision == "day", F.date_add(low, 1))
    return F.timestamp_millis(F.unix_millis(end.cast("timestamp")) - 1)


def date_bounds(value: Column, precision: Column) -> Column:
    """struct(low, high) of a date: the text is read once."""

    def both(low: Column) -> Column:
        end = F.when(precision == "year", F.add_months(low, 12)).when(precision == "month", F.add_months(low, 1)).when(precision == "day", F.date_add(low, 1))
        return F.struct(low.alias("low"), F.timestamp_millis(F.unix_millis(end.cast("timestamp")) - 1).alias("high"))

    return let(lower_bound(value, precision), both)


def cutoff(value: str) -> Column:
    """The instant up to which things count: a bare day means its end."""
    return F.lit(f"{value} 23:59:59.999" if len(value) == 10 else value).cast("timestamp")


def later(a: Column, b: Column) -> Column:
    """The later of two bounds; a null one doesn't count."""
    return F.greatest(F.coalesce(a, b), F.coalesce(b, a))


def as_of(versions: DataFrame, events: DataFrame, when: str, basis: str) -> DataFrame:
    """Versions with lower, upper and reason (null: a candidate) as of ``when``.

    versions: work, version, observed, p_low, p_high, v_low, v_high. events: version, type, low, high.
    basis: source_available, corpus_observed or source_effective.
    """
    limit = cutoff(when)
    known = events.filter(F.col("high") <= limit).groupBy("version").agg(
        F.max(F.when(F.col("type") == "effective", F.col("high"))).alias("e_high"),
        F.max(F.when(F.col("type").isin("repealed", "withdrawn"), F.col("low"))).alias("r_low"),
    )
    rows = versions.join(known, "version", "left")
    if basis == "corpus_observed":
        low = high = F.col("observed")
    else:
        low, high = later(F.col("p_low"), F.col("v_low")), later(F.col("p_high"), F.col("v_high"))

    def judged(span: Column) -> Column:
        reason = F.when((F.col("observed") > limit) & F.lit(basis == "corpus_observed"), REASONS[0]).when(span.upper.isNull(), REASONS[1]).when(span.lower > limit, REASONS[2]).when(span.upper > limit, REASONS[3])
        if basis == "source_effective":
            reason = reason.when(F.col("e_high").isNull(), REASONS[4]).when(F.col("r_low") >= F.col("e_high"), REASONS[5])
        return F.struct(span.lower.alias("lower"), span.upper.alias("upper"), reason.alias("reason"))

    # The interval is made once a row; inlined into every reason it would outgrow a generated method.
    rows = rows.withColumn("__j", let(F.struct(low.alias("lower"), high.alias("upper")), judged)).select("*", "__j.*")
    if basis == "source_effective":
        rows = rows.withColumns({"lower": F.col("e_high"), "upper": F.col("e_high")})  # the latest event's last instant: dates that overlap it are no tie
    return rows.select("work", "version", "lower", "upper", "reason")


def select_versions(judged: DataFrame, works: DataFrame) -> DataFrame:
    """work, state, versions: the latest candidate of each work with all that may be as late.

    One is a supported snapshot, several are ambiguous, none leaves the work unknown.
    """
    order = Window.partitionBy("work").orderBy(F.desc("upper"), "version")
    live = judged.filter("reason is null").withColumn("first", F.first("lower").over(order)).filter("upper >= first")
    chosen = live.groupBy("work").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("version").cast("string"))), ",").alias("versions"))
    state = F.when(F.col("n") == 1, "supported_source_snapshot").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return works.select("work").distinct().join(chosen, "work", "left").select("work", state.alias("state"), F.coalesce("versions", F.lit("")).alias("versions"))


def provably_latest(rows: DataFrame, key: str, low: str, high: str, row_id: str) -> DataFrame:
    """The row of each key that lies after all others of the key, where there is one.

    The latest-starting row needs only be compared with the latest end among the rest: no pairs.
    """
    order = Window.partitionBy(key).orderBy(F.desc(low), F.desc(high), row_id)
    rest = Window.partitionBy(key).orderBy(F.desc(low), F.desc(high), row_id).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({"__n": F.row_number().over(order), "__rest": F.max(high).over(rest)}).filter(f"__n = 1 and (__rest is null or {low} > __rest)").select(key, row_id)


def total_order(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """key, ordered: whether the intervals of a key follow on each other without touching."""
    order = Window.partitionBy(key).orderBy(low, high)
    prior = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__prior", prior).groupBy(key).agg(F.bool_and(F.col("__prior").isNull() | (F.col(low) > F.col("__prior"))).alias("ordered"))


def compare(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """before, after or indeterminate."""
    return F.when(a_high < b_low, "before").when(a_low > b_high, "after").otherwise("indeterminate")


def interval_join(left: DataFrame, right: DataFrame, on: str, at: str) -> DataFrame:
    """Rows of ``left`` with those rows of ``right`` (on, from, through or null) that hold at its date."""
    return left.join(right, (left[on] == right[on]) & (right["from"] <= left[at]) & (right["through"].isNull() | (left[at] <= right["through"]))).drop(right[on])


# --- the driver's tables in these shapes ----------------------------------------------------------


def _orders(spark, d):
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 4
    precision = F.when(kind == 0, "day").when(kind == 1, "month").when(kind == 2, "year").otherwise("unknown")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = o.withColumn("precision", precision).withColumn("value", F.when(F.col("precision") == "day", day).when(F.col("precision") == "month", F.substring(day, 1, 7)).when(F.col("precision") == "year", F.substring(day, 1, 4)))
    none = F.lit(None).cast("timestamp")
    o = o.select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("version"), F.date_add("o_orderdate", 30).cast("timestamp").alias("observed"), "value", "precision", date_bounds(F.col("value"), F.col("precision")).alias("b"))
    return o.select("work", "version", "observed", "value", "precision", F.col("b.low").alias("p_low"), F.col("b.high").alias("p_high"), none.alias("v_low"), none.alias("v_high"))


def _events(spark, d):
    """Lines as events, dated by day, month or year in turn."""
    kind = F.when(F.col("l_returnflag") == "A", "effective").when(F.col("l_returnflag") == "R", "repealed").otherwise("published")
    n = F.col("l_linenumber") % 3
    precision = F.when(n == 0, "day").when(n == 1, "month").otherwise("year")
    value = F.substring(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(1), F.when(n == 0, 10).when(n == 1, 7).otherwise(4))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), kind.alias("type"), date_bounds(value, precision).alias("b"))
    return rows.select("version", "type", F.col("b.low").alias("low"), F.col("b.high").alias("high"))


_CUT = "1996-06-30"
_DATES = """
with o as (select o_custkey as work, o_orderkey as version, o_orderdate::date + 30 as observed, strftime(o_orderdate, '%Y-%m-%d') as day,
  ['day', 'month', 'year', 'unknown'][1 + o_orderkey % 4] as precision from orders),
v as (select *, case precision when 'day' then day when 'month' then day[1:7] when 'year' then day[1:4] end as value,
  case precision when 'day' then day::timestamp when 'month' then date_trunc('month', day::timestamp) when 'year' then date_trunc('year', day::timestamp) end as p_low from o),
b as (select *, p_low + case precision when 'day' then interval 1 day when 'month' then interval 1 month when 'year' then interval 1 year end - interval 1 millisecond as p_high from v),
e as (select l_orderkey as version, case l_returnflag when 'A' then 'effective' when 'R' then 'repealed' else 'published' end as type,
  date_trunc(['day', 'month', 'year'][1 + l_linenumber % 3], l_shipdate)::timestamp as low,
  date_trunc(['day', 'month', 'year'][1 + l_linenumber % 3], l_shipdate)::timestamp + case l_linenumber % 3 when 0 then interval 1 day when 1 then interval 1 month else interval 1 year end - interval 1 millisecond as high from lineitem),
"""


def _judged_sql(basis: str) -> str:
    low, high = ("observed::timestamp",) * 2 if basis == "corpus_observed" else ("p_low", "p_high")
    cut = f"timestamp '{_CUT} 23:59:59.999'"
    reason = "case"
    if basis == "corpus_observed":
        reason += f" when observed::timestamp > {cut} then '{REASONS[0]}'"
    reason += f" when {high} is null then '{REASONS[1]}' when {low} > {cut} then '{REASONS[2]}' when {high} > {cut} then '{REASONS[3]}'"
    if basis == "source_effective":
        reason += f" when e_high is null then '{REASONS[4]}' when r_low >= e_high then '{REASONS[5]}'"
        low, high = "e_high", "e_high"
    return _DATES + f"""
k as (select version, max(case when type = 'effective' then high end) as e_high, max(case when type = 'repealed' then low end) as r_low from e where high <= {cut} group by version),
j as (select work, b.version, {low} as lower_, {high} as upper_, {reason} end as reason from b left join k using (version))
"""


def _selection(basis):
    def run(spark, d):
        versions = _orders(spark, d)
        return select_versions(as_of(versions, _events(spark, d), _CUT, basis), versions)

    sql = _judged_sql(basis) + """,
f as (select *, first_value(lower_) over (partition by work order by upper_ desc, version) as first_ from j where reason is null),
c as (select work, count(*) as n, string_agg(version::varchar, ',' order by version::varchar) as versions from f where upper_ >= first_ group by work)
select w.work, case when n = 1 then 'supported_source_snapshot' when n > 1 then 'ambiguous' else 'unknown' end as state, coalesce(versions, '') as versions
from (select distinct work from b) w left join c using (work)"""
    return run, sql


def _excluded(basis):
    def run(spark, d):
        return as_of(_orders(spark, d), _events(spark, d), _CUT, basis).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("versions"))

    return run, _judged_sql(basis) + "select reason, count(*) as versions from j where reason is not null group by reason"


def _bounds(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return _orders(spark, d).select("version", "precision", text("p_low"), text("p_high"))


def _spans(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.col("ts").alias("low"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 50 as int), 0)")).alias("high"))


_SPANS = "with s as (select user_id, event_id, ts as low, ts + to_minutes((event_id % 50)::int) as high from events)"


def _latest(spark, d):
    return provably_latest(_spans(spark, d), "user_id", "low", "high", "event_id")


def _ordered(spark, d):
    return total_order(_spans(spark, d), "user_id", "low", "high")


def _crosswalk(spark, d):
    years = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("target"), F.make_date(1992 + F.col("n_nationkey") % 5, F.lit(1), F.lit(1)).alias("from"), F.when(F.col("n_nationkey") % 3 > 0, F.make_date(1996 + F.col("n_nationkey") % 3, F.lit(6), F.lit(30))).alias("through"))
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("n_nationkey"), F.to_date("o_orderdate").alias("day"))
    return interval_join(orders, years, "n_nationkey", "day").select("o_orderkey", "target")


QUERIES = {
    "date_bounds": (_bounds, _DATES.rstrip().rstrip(",") + " select version, precision, strftime(p_low, '%Y-%m-%d %H:%M:%S.%g') as p_low, strftime(p_high, '%Y-%m-%d %H:%M:%S.%g') as p_high from b"),
    "select_source_available": _selection("source_available"),
    "select_corpus_observed": _selection("corpus_observed"),
    "select_source_effective": _selection("source_effective"),
    "excluded_source_available": _excluded("source_available"),
    "excluded_corpus_observed": _excluded("corpus_observed"),
    "excluded_source_effective": _excluded("source_effective"),
    "provably_latest": (_latest, _SPANS + " select a.user_id, a.event_id from s a where not exists (select 1 from s b where b.user_id = a.user_id and b.event_id != a.event_id and not a.low > b.high)"),
    "total_order_check": (_ordered, _SPANS + " select user_id, bool_and(ok) as ordered from (select a.user_id, not exists (select 1 from s b where b.user_id = a.user_id and b.event_id != a.event_id and not (a.high < b.low or a.low > b.high)) as ok from s a) group by user_id"),
    "interval_crosswalk_join": (_crosswalk, """
with y as (select n_nationkey, n_name as target, make_date(1992 + n_nationkey % 5, 1, 1) as f, case when n_nationkey % 3 > 0 then make_date(1996 + n_nationkey % 3, 6, 30) end as t from nation)
select o_orderkey, target from orders join y on o_custkey % 25 = n_nationkey and f <= o_orderdate::date and (t is null or o_orderdate::date <= t)"""),
}
