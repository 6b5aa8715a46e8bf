"""Plans of searches over several sources, their lanes, and the merged answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.operators.records import merge_listings, text_key
from parchmint.session import table
from parchmint.sources.listings import HALVED, planned


def plan(searches: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """lane, search, source, state: a lane for each search and each source that supports its kind.

    Lanes of one text and source are one. The first ``budget`` in order run, later ones wait.
    """
    lanes = searches.join(sources, "kind").withColumn("lane", F.concat_ws("|", "source", "kind", F.lower("text")))
    once = lanes.groupBy("lane").agg(F.min("position").alias("position"), F.min("source").alias("source"), F.min("precedence").alias("precedence"))
    first = once.orderBy("position", "precedence", "lane").limit(budget).select("lane", F.lit("run").alias("state"))
    return once.join(first, "lane", "left").select("lane", "source", F.coalesce("state", F.lit("over_budget")).alias("state"))


def left_out(listings: DataFrame, lane: str, keep) -> DataFrame:
    """lane, kept, left_out: how many listings a lane's filter keeps."""
    return listings.groupBy(lane).agg(F.count_if(F.coalesce(keep, F.lit(False))).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("left_out"))


def with_reasons(listings: DataFrame) -> DataFrame:
    """document, rank, primary, alternates, reasons: merged listings with all lanes that found them."""
    merged = merge_listings(listings)
    key = F.coalesce(F.concat(F.lit("match:"), "match"), F.concat(F.lit("listing:"), "listing"))
    reasons = listings.select(key.alias("document"), "lane").distinct().groupBy("document").agg(F.array_join(F.array_sort(F.collect_list("lane")), ",").alias("reasons"))
    return merged.join(reasons, "document")


def worst_outcome(rows: DataFrame, source: str, outcome: str) -> DataFrame:
    """source, outcome: the worst of each source's lanes (ok, partial, failed)."""
    rank = F.when(F.col(outcome) == "failed", 2).when(F.col(outcome) == "partial", 1).otherwise(0)
    return rows.groupBy(source).agg(F.max_by(F.col(outcome), rank).alias("outcome"))


def blockers(sources: DataFrame, checks: dict) -> DataFrame:
    """Adds blockers (names of checks that fail, in order) and usable."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    return sources.withColumn("blockers", F.array_join(found, ",")).withColumn("usable", F.size(found) == 0)


def exact_or_unknown(listings: DataFrame, lane: str, exact, complete: str) -> DataFrame:
    """lane, kept, left_out, state: an exact match behind a loose search; without one, unknown where the answer was only a part."""
    n = listings.groupBy(lane).agg(F.count_if(F.coalesce(exact, F.lit(False))).alias("kept"), F.count_if(~F.coalesce(exact, F.lit(False))).alias("left_out"), F.bool_and(complete).alias("__all"))
    state = F.when(F.col("kept") > 0, "found").when(F.col("__all"), "none").otherwise("unknown")
    return n.select(lane, "kept", "left_out", state.alias("state"))


def shown_total(rows: DataFrame, total: str, listed: str, page: int, most: int = 10_000) -> DataFrame:
    """Adds shown (a total from ``most`` on is a floor), unresolved (nothing listed though something is there) and capped (ten pages are listed)."""
    return rows.withColumns({
        "shown": F.when(F.col(total) >= most, F.concat(F.lit(str(most)), F.lit("+"))).otherwise(F.col(total).cast("string")),
        "unresolved": (F.col(listed) == 0) & (F.coalesce(total, F.lit(1)) > 0),
        "capped": F.col(listed) >= page * 10,
    })


def grouped(rows: DataFrame, section: str, order: list[str]) -> DataFrame:
    """section, n, first: merged rows by section, with the one that stands first."""
    return rows.groupBy(section).agg(F.count("*").alias("n"), F.min(F.struct(*order, "document")).alias("f")).select(section, "n", F.col("f.document").alias("first"))


def continuation(rows: DataFrame, total: str, cap: int, page: int) -> DataFrame:
    """Adds paging: complete, cap, unknown or more."""
    state = F.when(F.col(total).isNull(), "unknown").when(F.col(total) <= page, "complete").when(F.col(total) > cap, "cap").otherwise("more")
    return rows.withColumn("paging", state)


def linked(rows: DataFrame, keys: list[str], targets: DataFrame, target: str) -> DataFrame:
    """rows with the first of several keys that finds a target (fallback in order)."""
    out, found = rows, []
    for i, k in enumerate(keys):
        t = targets.select(F.col(target).alias(f"__t{i}")).distinct()
        out = out.join(t, F.col(k) == F.col(f"__t{i}"), "left")
        found.append(F.col(f"__t{i}"))
    return out.withColumn("target", F.coalesce(*found)).drop(*(f"__t{i}" for i in range(len(keys))))


def _listings(spark, d):
    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("doc_id").cast("string").alias("listing"), "source", "lang", F.substring("source", 4, 9).cast("int").alias("precedence"), rank.alias("rank"), text_key("text").alias("match"), F.concat_ws(":", "lang", "source").alias("lane"))


def _plan(spark, d):
    """A search for each benchmark item, of one of three kinds; suppliers as sources that support one or two of them."""
    i, k = F.col("item_id"), F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("words", "docket", "citation")))
    kind = lambda n: F.element_at(kinds, (n % 3 + 1).cast("int"))
    searches = table(spark, d, "benchmark").select(i.alias("position"), kind(i).alias("kind"), F.concat(F.when(i % 2 == 0, "Q").otherwise("q"), (i % 15).cast("string")).alias("text"))
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("source"), (k % 10).alias("precedence"), F.explode(F.array_distinct(F.array(kind(k), kind(k * k)))).alias("kind"))
    return plan(searches, sources, 60)


def _left(spark, d):
    return left_out(_listings(spark, d), "source", F.col("lang") == "en")


def _reasons(spark, d):
    return with_reasons(_listings(spark, d))


def _worst(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_totalprice") > 450_000, "failed").otherwise("ok").alias("o"))
    return worst_outcome(rows, "o_orderpriority", "o")


def _exact(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 8 == 0).alias("hit"), (F.col("o_custkey") % 3 > 0).alias("complete"))
    return exact_or_unknown(rows, "o_custkey", F.col("hit"), "complete")


def _totals(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = rows.select("l_suppkey", F.when(F.col("l_suppkey") % 7 > 0, F.col("n") * (F.col("l_suppkey") % 50)).alias("total"), F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(F.col("n")).alias("listed"))
    return shown_total(rows, "total", "listed", 60).select("l_suppkey", "shown", "unresolved", "capped")


def _grouped(spark, d):
    listings = _listings(spark, d)
    sections = listings.select(F.coalesce(F.concat(F.lit("match:"), "match"), F.concat(F.lit("listing:"), "listing")).alias("document"), "lang").groupBy("document").agg(F.min("lang").alias("section"))
    return grouped(merge_listings(listings).join(sections, "document"), "section", ["rank"])


def _ranges(spark, d):
    """Ranges of order days with fewer than a tenth of all orders each, planned from the counts of days, with what lies in them."""
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    stated = dict(map(tuple, days.groupBy("day").agg(F.count("*").alias("n")).collect()))  # a row a day
    ranges = spark.createDataFrame(planned(stated, sum(stated.values()) // 10 + 1), "low date, high date")
    return days.join(ranges, F.col("day").between(F.col("low"), F.col("high"))).groupBy("low", "high").agg(F.count("*").alias("rows"))


def _coverage(spark, d):
    s = table(spark, d, "supplier")
    return blockers(s, {"review_expired": F.col("s_acctbal") > 0, "no_terms": F.col("s_nationkey") % 4 > 0, "inactive": F.col("s_suppkey") % 5 > 0}).select("s_suppkey", "blockers", "usable")


def _paging(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return continuation(sums.withColumn("total", F.when(F.col("l_partkey") % 7 > 0, F.col("n"))), "total", 40, 25).select("l_partkey", "paging")


def _linked(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k1"), (F.col("o_custkey") + 3).alias("k2"))
    return linked(o, ["k1", "k2"], table(spark, d, "customer"), "c_custkey").select("o_orderkey", "target")


_LIST = "with l as (select doc_id::varchar as listing, source, lang, source[4:]::int as precedence, row_number() over (partition by source order by doc_id)::int as rank, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as m, lang || ':' || source as lane from documents), k as (select *, coalesce('match:' || m, 'listing:' || listing) as document from l)"

QUERIES = {
    "search_plan": (_plan, """
with s as (select item_id as position, ['words', 'docket', 'citation'][item_id % 3 + 1] as kind, 'q' || item_id % 15 as text from benchmark),
r as (select distinct 's' || s_suppkey as source, s_suppkey % 10 as precedence, ['words', 'docket', 'citation'][x % 3 + 1] as kind from (select s_suppkey, unnest([s_suppkey, s_suppkey * s_suppkey]) as x from supplier)),
o as (select source || '|' || kind || '|' || text as lane, min(position) as position, min(source) as source, min(precedence) as precedence from s join r using (kind) group by 1)
select lane, source, case when row_number() over (order by position, precedence, lane) <= 60 then 'run' else 'over_budget' end as state from o"""),
    "lane_left_out": (_left, "select source, count_if(lang = 'en') as kept, count_if(lang is null or lang != 'en') as left_out from documents group by source"),
    "merged_lanes": (_reasons, _LIST + " select document, min(rank) as rank, (min(struct_pack(a := precedence, b := rank, c := listing))).c as primary, count(*) - 1 as alternates, string_agg(distinct lane, ',' order by lane) as reasons from k group by document"),
    "exact_or_unknown": (_exact, "select o_custkey, count_if(o_orderkey % 8 = 0) as kept, count_if(o_orderkey % 8 != 0) as left_out, case when count_if(o_orderkey % 8 = 0) > 0 then 'found' when o_custkey % 3 > 0 then 'none' else 'unknown' end as state from orders group by o_custkey"),
    "shown_totals": (_totals, """
with r as (select l_suppkey, case when l_suppkey % 7 > 0 then count(*) * (l_suppkey % 50) end as total, case when l_suppkey % 4 = 0 then 0 else count(*) end as listed from lineitem group by 1)
select l_suppkey, case when total >= 10000 then '10000+' else total::varchar end as shown, listed = 0 and coalesce(total, 1) > 0 as unresolved, listed >= 600 as capped from r"""),
    "grouped_results": (_grouped, _LIST + """, m as (select document, min(rank) as rank, min(lang) as section from k group by document) select section, count(*) as n, (min(struct_pack(a := rank, b := document))).b as first from m group by section"""),
    "range_split": (_ranges, "with recursive n as (select o_orderdate::date as day, count(*) as n from orders group by 1), lim as (select count(*) // 10 + 1 as l from orders)," + HALVED + "select a + low as low, a + high as high, rows::bigint as rows from leaf, ends"),
    "worst_outcome": (_worst, "select o_orderpriority, arg_max(o, case o when 'failed' then 2 when 'partial' then 1 else 0 end) as outcome from (select o_orderpriority, case when o_orderstatus = 'P' then 'partial' when o_totalprice > 450000 then 'failed' else 'ok' end as o from orders) group by 1"),
    "coverage_blockers": (_coverage, "with b as (select s_suppkey, concat_ws(',', case when not s_acctbal > 0 then 'review_expired' end, case when not s_nationkey % 4 > 0 then 'no_terms' end, case when not s_suppkey % 5 > 0 then 'inactive' end) as blockers from supplier) select s_suppkey, blockers, blockers = '' as usable from b"),
    "paging_state": (_paging, "select l_partkey, case when l_partkey % 7 = 0 then 'unknown' when count(*) <= 25 then 'complete' when count(*) > 40 then 'cap' else 'more' end as paging from lineitem group by l_partkey"),
    "fallback_lookup": (_linked, "select o_orderkey, coalesce(a.c_custkey, b.c_custkey) as target from orders left join customer a on a.c_custkey = o_custkey * 2 left join customer b on b.c_custkey = o_custkey + 3"),
}
