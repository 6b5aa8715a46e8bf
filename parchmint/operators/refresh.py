"""Incremental refresh: last-known-good merges, changes, news since a day, budgets, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import table


def last_known_good(prior: DataFrame, refresh: DataFrame, key: str, value: str, ok: str) -> DataFrame:
    """key, value, state: a good refresh replaces, a failed one keeps the prior value or leaves none."""
    p = prior.select(key, F.col(value).alias("__old"), F.lit(True).alias("__had"))
    r = refresh.select(key, F.col(value).alias("__new"), F.col(ok).alias("__ok"))
    good = F.coalesce("__ok", F.lit(False))
    had = F.coalesce("__had", F.lit(False))
    state = F.when(good, "healthy").when(had, "degraded").otherwise("unavailable")
    return p.join(r, key, "full").select(key, F.when(good, F.col("__new")).when(had, F.col("__old")).alias(value), state.alias("state"))


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, changed, unchanged or gone."""
    b, a = before.select(key, F.col(digest).alias("__b")), after.select(key, F.col(digest).alias("__a"))
    kind = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "gone").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return b.join(a, key, "full").select(key, kind.alias("change"))


def new_since(listings: DataFrame, seen: DataFrame, key: str, date: str, since: str) -> DataFrame:
    """Listings that state a day on or after ``since`` and were not seen; undated ones are never new."""
    return listings.filter(F.col(date) >= F.lit(since).cast("timestamp")).join(seen.select(key), key, "left_anti")


def within_budget(rows: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Of each group the first rows in order whose running cost stays within the budget."""
    upto = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__upto", upto).filter(F.col("__upto") <= budget).drop("__upto")


def active(rows: DataFrame, group: str, row_id: str, replaces: str) -> DataFrame:
    """group, state, n: what no later row replaces; one is active, several are ambiguous."""
    gone = rows.filter(F.col(replaces).isNotNull()).select(F.col(replaces).alias(row_id)).distinct()
    left = rows.join(gone, row_id, "left_anti").groupBy(group).agg(F.count("*").alias("n"))
    return left.select(group, F.when(F.col("n") == 1, "active").otherwise("ambiguous").alias("state"), "n")


def active_deadlines(rows: DataFrame, group: str, row_id: str, replaces: str, review: str) -> DataFrame:
    """group, state, n: what no accepted row replaces; review_required if any of it isn't accepted, else active or ambiguous."""
    gone = rows.filter(F.col(replaces).isNotNull() & (F.col(review) == "accepted")).select(F.col(replaces).alias(row_id)).distinct()
    left = rows.join(gone, row_id, "left_anti").groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(review) != "accepted").alias("open"))
    return left.select(group, F.when(F.col("open") > 0, "review_required").when(F.col("n") == 1, "active").otherwise("ambiguous").alias("state"), "n")


def settled(checks: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """follow, state, fresh, undated, mark: what a check brings to each follow.

    checks: follow, since, failed. found: follow, listing, stated. seen: follow, listing. New is what
    states a day on or after ``since`` and was not seen; undated listings are counted apart. A failed
    check is unavailable and leaves the mark where it was.
    """
    news = found.join(seen, ["follow", "listing"], "left_anti")
    rows = checks.join(news, "follow", "left").groupBy("follow", "since", "failed").agg(
        F.count_if(F.coalesce(F.col("stated") >= F.col("since"), F.lit(False))).alias("fresh"),
        F.count_if(F.col("listing").isNotNull() & F.col("stated").isNull()).alias("undated"),
        F.max("stated").alias("latest"),
    )
    state = F.when(F.col("failed"), "unavailable").when(F.col("fresh") > 0, "new").otherwise("nothing_new")
    return rows.select("follow", state.alias("state"), F.when(F.col("failed"), 0).otherwise(F.col("fresh")).alias("fresh"), F.when(F.col("failed"), 0).otherwise(F.col("undated")).alias("undated"), F.when(F.col("failed"), F.col("since")).otherwise(F.greatest("since", "latest")).alias("mark"))


def last_good(rows: DataFrame, source: str, run: str, ok: str) -> DataFrame:
    """All rows of each source's latest run that went well."""
    best = rows.filter(F.col(ok)).groupBy(source).agg(F.max(run).alias("__run"))
    return rows.join(best, source).filter(F.col(run) == F.col("__run")).drop("__run")


def at_revision(log: DataFrame, key: str, revision: str, upto: int) -> DataFrame:
    """The state of each key at a revision: its last entry by then."""
    order = Window.partitionBy(key).orderBy(F.desc(revision))
    return log.filter(F.col(revision) <= upto).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def forecast(rows: DataFrame, group: str, size: str, ceiling: int) -> DataFrame:
    """group, files, bytes, forecast (a half more), state against a ceiling."""
    sums = rows.groupBy(group).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))
    ahead = F.floor(F.col("bytes") * 3 / 2).cast("long")
    return sums.select(group, "files", "bytes", ahead.alias("forecast"), F.when(F.col("bytes") > ceiling, "over").when(ahead > ceiling, "near").otherwise("within").alias("state"))


def _lkg(spark, d):
    e = table(spark, d, "events")
    prior = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("latest"))
    fresh = e.filter("event_id % 2 = 1").groupBy("user_id").agg(F.max("event_id").alias("latest"), (F.max("event_id") % 3 > 0).alias("ok"))
    return last_known_good(prior, fresh, "user_id", "latest", "ok")


def _changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    after = docs.withColumn("digest", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("digest", F.lit("x")))).otherwise(F.col("digest")))
    return changes(docs.filter("doc_id % 10 != 1"), after.filter("doc_id % 10 != 2"), "doc_id", "digest")


def _since(spark, d):
    e = table(spark, d, "events")
    return new_since(e, e.filter("event_id % 3 = 0"), "event_id", "ts", "2024-01-15").select("event_id", "user_id")


def _budget(spark, d):
    return within_budget(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000.0).select("o_custkey", "o_orderkey")


def _active(spark, d):
    e = table(spark, d, "events").withColumn("replaces", F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 40))
    return active(e, "user_id", "event_id", "replaces")


def _revision(spark, d):
    """At the revision halfway to the largest id."""
    e = table(spark, d, "events")
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    return at_revision(e, "user_id", "event_id", half).select("user_id", "event_id", "event_type")


def _settled(spark, d):
    k = F.col("o_orderkey")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("follow"), k.alias("listing"), F.when(k % 6 > 0, F.col("o_orderdate")).alias("stated"))
    checks = table(spark, d, "customer").select(F.col("c_custkey").alias("follow"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("timestamp").alias("since"), (F.col("c_custkey") % 5 == 0).alias("failed"))
    seen = found.filter("listing % 4 = 0").select("follow", "listing")
    return settled(checks, found, seen).select("follow", "state", "fresh", "undated", F.date_format("mark", "yyyy-MM-dd").alias("mark"))


def _loaded(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("item"), F.col("event_id").alias("run"), (F.col("event_id") % 3 > 0).alias("ok"))
    return last_good(e, "source", "run", "ok").select("source", "run")


def _deadlines(spark, d):
    e = table(spark, d, "events").withColumns({"replaces": F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 40), "review": F.when(F.col("event_id") % 5 == 0, "proposed").otherwise("accepted")})
    return active_deadlines(e, "user_id", "event_id", "replaces", "review")


def _forecast(spark, d):
    return forecast(table(spark, d, "documents").select("source", F.octet_length("text").alias("size")), "source", "size", 120_000)


QUERIES = {
    "lkg_merge": (_lkg, """
with p as (select user_id, max(event_id) as old from events where event_id % 2 = 0 group by 1), r as (select user_id, max(event_id) as new_, max(event_id) % 3 > 0 as ok from events where event_id % 2 = 1 group by 1)
select user_id, case when coalesce(ok, false) then new_ when old is not null then old end as latest, case when coalesce(ok, false) then 'healthy' when old is not null then 'degraded' else 'unavailable' end as state from p full join r using (user_id)"""),
    "change_kind": (_changes, """
with d as (select doc_id, md5(text) as h from documents), b as (select doc_id, h from d where doc_id % 10 != 1), a as (select doc_id, case when doc_id % 7 = 0 then md5(h || 'x') else h end as g from d where doc_id % 10 != 2)
select doc_id, case when h is null then 'new' when g is null then 'gone' when g = h then 'unchanged' else 'changed' end as change from b full join a using (doc_id)"""),
    "new_since": (_since, "select event_id, user_id from events where ts >= timestamp '2024-01-15' and event_id % 3 != 0"),
    "budget_prefix": (_budget, "select o_custkey, o_orderkey from (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as upto from orders) where upto <= 500000"),
    "active_deadline": (_active, """
with e as (select *, case when event_id % 2 = 0 then event_id - 40 end as replaces from events)
select user_id, case when count(*) = 1 then 'active' else 'ambiguous' end as state, count(*) as n from e where event_id not in (select replaces from e where replaces is not null) group by user_id"""),
    "revision_state": (_revision, "select user_id, event_id, event_type from events where event_id <= (select max(event_id) // 2 from events) qualify row_number() over (partition by user_id order by event_id desc) = 1"),
    "settled_checks": (_settled, """
with c as (select c_custkey as follow, (date '1995-01-01' + (c_custkey % 300)::int)::timestamp as since, c_custkey % 5 = 0 as failed from customer),
n as (select o_custkey as follow, o_orderkey as listing, case when o_orderkey % 6 > 0 then o_orderdate end as stated from orders where o_orderkey % 4 != 0),
r as (select follow, since, failed, count_if(coalesce(stated >= since, false)) as fresh, count_if(listing is not null and stated is null) as undated, max(stated) as latest from c left join n using (follow) group by all)
select follow, case when failed then 'unavailable' when fresh > 0 then 'new' else 'nothing_new' end as state, case when failed then 0 else fresh end as fresh, case when failed then 0 else undated end as undated,
  strftime(case when failed then since else greatest(since, coalesce(latest, since)) end, '%Y-%m-%d') as mark from r"""),
    "last_good_source": (_loaded, "select event_type as source, max(event_id) as run from events where event_id % 3 > 0 group by 1"),
    "deadline_reviews": (_deadlines, """
with e as (select *, case when event_id % 2 = 0 then event_id - 40 end as replaces, event_id % 5 = 0 as proposed from events),
n as (select user_id, count(*) as n, count_if(proposed) as open from e where event_id not in (select replaces from e where replaces is not null and not proposed) group by 1)
select user_id, case when open > 0 then 'review_required' when n = 1 then 'active' else 'ambiguous' end as state, n from n"""),
    "storage_forecast": (_forecast, """
with s as (select source, count(*) as files, sum(strlen(text))::bigint as bytes from documents group by source)
select source, files, bytes, (bytes * 3 // 2)::bigint as forecast, case when bytes > 120000 then 'over' when bytes * 3 // 2 > 120000 then 'near' else 'within' end as state from s"""),
}
