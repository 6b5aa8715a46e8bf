"""Checks as queries: each returns what violates it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import table


def duplicate_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """id, tables: ids that stand more than once over all tables (name: table with a column id)."""
    all_ = None
    for name, rows in tables.items():
        part = rows.select(F.col("id"), F.lit(name).alias("t"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tables")).filter("n > 1")


def orphans(rows: DataFrame, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not a parent's key."""
    return rows.join(parents.select(F.col(key).alias("__k")), F.col(reference) == F.col("__k"), "left_anti")


def reconcile(stated: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, stated, actual: where stated counts and counted rows differ, either side missing included."""
    a = actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = stated.select(key, "stated").join(a, key, "full")
    return both.select(key, F.coalesce("stated", F.lit(0)).cast("long").alias("stated"), F.coalesce("actual", F.lit(0)).alias("actual")).filter("stated != actual")


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows of each side that the other lacks, repeats counted; empty if both are equal."""
    left = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n")
    return left.unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("right").alias("side"), "n")).filter("n > 0")


def recall_at(ranked: DataFrame, wanted: DataFrame, question: str, item: str, k: int) -> DataFrame:
    """question, wanted, found, complete: how many wanted items stand among the first k."""
    top = ranked.filter(F.col("rank") <= k).select(question, item).withColumn("__hit", F.lit(1))
    return wanted.join(top, [question, item], "left").groupBy(question).agg(F.count("*").alias("wanted"), F.count("__hit").alias("found"), F.bool_and(F.col("__hit").isNotNull()).alias("complete"))


def segment_faults(segments: DataFrame, renditions: DataFrame) -> DataFrame:
    """segment, fault: byte ranges that are out of their text, cut a character, or don't have the stated digest.

    segments: segment, rendition, start, end, digest. renditions: rendition, text.
    """
    rows = segments.join(renditions, "rendition")
    data = F.col("text").cast("binary")
    part = F.substring(data, F.col("start") + 1, F.col("end") - F.col("start"))
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")  # noqa: E731  a byte within a character
    fault = (
        F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.octet_length("text")), "range")
        .when(inside(F.col("start")) | inside(F.col("end")), "boundary")
        .when(F.sha2(part, 256) != F.col("digest"), "digest")
    )
    return rows.select("segment", fault.alias("fault")).filter("fault is not null")


def replayed(citations: DataFrame, renditions: DataFrame) -> DataFrame:
    """citation, replays: whether the bytes that a citation names still give its quotation and its text's digest."""
    rows = citations.join(renditions, "rendition", "left")
    part = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("citation", F.coalesce((F.sha2("text", 256) == F.col("text_digest")) & (part == F.col("quote").cast("binary")), F.lit(False)).alias("replays"))


def unattested(values: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Values that are stated as the source's but that no text of their evidence holds. values: key, value. evidence: key, text."""
    hit = values.join(evidence, key).filter(F.col("text").contains(F.col("value"))).select(key, "value").distinct()
    return values.join(hit, [key, "value"], "left_anti")


def coverage_faults(rows: DataFrame) -> DataFrame:
    """Adds fault: what a source's coverage may not say together.

    healthy: counted, dated, without a failure. degraded: a failure and a last known good state.
    unavailable: a failure, nothing counted.
    """
    failed, kept = F.col("failure").isNotNull(), F.col("last_good").isNotNull()
    fault = (
        F.when((F.col("status") == "healthy") & failed, "healthy_with_failure")
        .when((F.col("status") == "healthy") & F.col("data_as_of").isNull(), "healthy_without_date")
        .when((F.col("status") == "degraded") & ~failed, "degraded_without_failure")
        .when((F.col("status") == "degraded") & ~kept, "degraded_without_last_good")
        .when((F.col("status") == "unavailable") & (F.coalesce("documents", F.lit(0)) > 0), "unavailable_with_documents")
    )
    return rows.withColumn("fault", fault)


def prior_faults(current: DataFrame, prior: DataFrame) -> DataFrame:
    """source, fault: last known good states that are not those of an earlier run under the same schema and snapshot."""
    p = prior.select("source", F.col("run_at").alias("__at"), F.col("schema").alias("__schema"), F.col("digest").alias("__digest"))
    rows = current.join(p, "source", "left")
    fault = F.when(F.col("__at").isNull(), "no_prior").when(F.col("__at") >= F.col("run_at"), "not_earlier").when(F.col("__schema") != F.col("schema"), "schema").when(F.col("__digest") != F.col("digest"), "snapshot")
    return rows.select("source", fault.alias("fault")).filter("fault is not null")


def artifact_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, fault: files that a manifest misses, that it lists in vain, or whose size or digest differ."""
    f = files.select("path", F.col("bytes").alias("__b"), F.col("digest").alias("__d"))
    rows = manifest.join(f, "path", "full")
    fault = F.when(F.col("__b").isNull(), "missing").when(F.col("bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("__b"), "size").when(F.col("digest") != F.col("__d"), "digest")
    return rows.select("path", fault.alias("fault")).filter("fault is not null")


def data_as_of(rows: DataFrame, key: str, at: str, generated: str) -> DataFrame:
    """key, as_of: the latest date of each key's data, or when all was generated if it has none."""
    return rows.groupBy(key).agg(F.coalesce(F.max(at), F.lit(generated).cast("timestamp")).alias("as_of"))


def below_minimum(rows: DataFrame, key: str, minimum: dict[str, int]) -> DataFrame:
    """key, n, least: keys with fewer rows than they must have, those without any included."""
    want = rows.sparkSession.createDataFrame(list(minimum.items()), f"{key} string, least int")
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return want.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "least").filter("n < least")


def stale(rows: DataFrame, key: str, at: str, now, days: int) -> DataFrame:
    """key, age: indexes whose newest entry is more than ``days`` days old."""
    return rows.groupBy(key).agg(F.date_diff(now, F.max(at)).alias("age")).filter(F.col("age") > days)


def all_issues(checks: dict[str, DataFrame]) -> DataFrame:
    """check, id: all violations of several checks (each a table with id), none of which stops the others."""
    out = None
    for name, rows in checks.items():
        part = rows.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def enough(found: DataFrame, group: str, num: int = 9, den: int = 10) -> DataFrame:
    """group, wanted, complete, needed, passes: whether enough questions of a group are complete; needed is their share, rounded up in whole numbers."""
    n = found.groupBy(group).agg(F.count("*").alias("wanted"), F.count_if("complete").alias("complete"))
    needed = F.floor((F.col("wanted") * num + den - 1) / den).cast("long")
    return n.withColumn("needed", needed).withColumn("passes", F.col("complete") >= F.col("needed"))


def _duplicates(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return duplicate_ids({"orders": o, "customer": c})


def _orphans(spark, d):
    return orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").filter("o_orderkey % 11 != 0"), "o_orderkey").select("l_orderkey", "l_linenumber")


def _reconcile(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    stated = o.select("o_orderkey", (4 + F.col("o_orderkey") % 3).alias("stated"))
    return reconcile(stated, line.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


def _compound(spark, d):
    return not_unique(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


def _same(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return same_rows(c.filter("c_custkey % 5 != 0"), c.filter("c_custkey % 7 != 0"))


def _recall(spark, d):
    from pyspark.sql import Window

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    ranked = docs.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    wanted = labels.filter("quality = 1").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "doc_id")
    return recall_at(ranked, wanted, "lang", "doc_id", 50)


def _texts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("doc_id").alias("rendition")).agg(F.min("text").alias("text"))


def _faults(spark, d):
    k, n = F.col("rendition"), F.octet_length("text")
    start, end = k % 11, F.when(k % 7 == 0, n + 5).otherwise(F.least(n, k % 60 + 30))
    part = F.substring(F.col("text").cast("binary"), start + 1, end - start)
    rows = _texts(spark, d).select(k.alias("segment"), "rendition", start.alias("start"), end.alias("end"), F.when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(part, 256)).alias("digest"))
    return segment_faults(rows, _texts(spark, d))


def _replayed(spark, d):
    k = F.col("rendition")
    rows = _texts(spark, d).select(k.alias("citation"), "rendition", F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(k % 3 == 0, "?").otherwise(F.substring("text", 1, 1)).alias("quote"), F.when(k % 4 == 0, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256)).alias("text_digest"))
    return replayed(rows, _texts(spark, d).filter("rendition % 10 > 0"))


def _unattested(spark, d):
    values = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "the").otherwise("license").alias("value")).distinct()
    return unattested(values, table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _coverage(spark, d):
    k = F.col("s_suppkey")
    status = F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unavailable")), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", status.alias("status"), F.when(k % 4 == 0, "fetch").alias("failure"), F.when(k % 5 > 0, "d").alias("last_good"), F.when(k % 7 > 0, "2024").alias("data_as_of"), (k % 6).alias("documents"))
    return coverage_faults(rows).filter("fault is not null").select("s_suppkey", "fault")


def _prior(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier")
    current = rows.select(k.alias("source"), (k + 5).alias("run_at"), F.lit(2).alias("schema"), F.md5(k.cast("string")).alias("digest"))
    prior = rows.filter("s_suppkey % 9 > 0").select(k.alias("source"), (k + k % 7).alias("run_at"), F.when(k % 5 == 0, 1).otherwise(2).alias("schema"), F.md5((k - k % 2).cast("string")).alias("digest"))
    return prior_faults(current, prior)


def _artifacts(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    files = n.filter("n_nationkey > 3").select(F.col("n_name").alias("path"), (k * 10).alias("bytes"), F.md5("n_name").alias("digest"))
    listed = n.filter("n_nationkey < 20").select(F.col("n_name").alias("path"), F.when(k % 5 == 0, 1).otherwise(k * 10).alias("bytes"), F.when(k % 6 == 0, "?").otherwise(F.md5("n_name")).alias("digest"))
    return artifact_faults(listed, files)


def _as_of(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "click", F.col("ts")).alias("at"))
    return data_as_of(rows, "event_type", "at", "2024-06-01").select("event_type", F.date_format("as_of", "yyyy-MM-dd HH:mm").alias("as_of"))


def _minimum(spark, d):
    return below_minimum(table(spark, d, "documents"), "lang", {"en": 10, "de": 1_000_000, "xx": 1})


def _stale(spark, d):
    return stale(table(spark, d, "orders"), "o_custkey", "o_orderdate", F.lit("1998-08-02").cast("date"), 120)


def _issues(spark, d):
    o = table(spark, d, "orders")
    return all_issues({
        "negative": table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")),
        "unknown_customer": orphans(o, "o_custkey", table(spark, d, "customer").filter("c_nationkey > 2"), "c_custkey").select(F.col("o_orderkey").alias("id")),
        "repeated": not_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"]).select(F.col("l_orderkey").alias("id")),
    })


def _enough(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % F.when(F.col("o_orderpriority") < "3", 40).otherwise(9) > 0).alias("complete"))
    return enough(rows, "o_orderpriority")


QUERIES = {
    "segment_faults": (_faults, """
with t as (select doc_id as k, min(text) as text from documents group by 1),
s as (select k, strlen(text) as n, hex(encode(text)) as h, k % 11 as a, case when k % 7 = 0 then strlen(text) + 5 else least(strlen(text), k % 60 + 30) end as b from t where text is not null),
f as (select k as segment, case when b <= a or b > n then 'range' when regexp_matches(substr(h, 2 * a + 1, 1), '[89AB]') or regexp_matches(substr(h, 2 * b + 1, 1), '[89AB]') then 'boundary'
  when k % 5 = 0 and substr(h, 2 * a + 1, 2 * (b - a)) != '78' then 'digest' end as fault from s)
select * from f where fault is not null"""),
    "citation_replay": (_replayed, "with d as (select doc_id as k, min(text) as t from documents group by 1) select k as citation, k % 10 > 0 and k % 4 > 0 and k % 3 > 0 and coalesce(ascii(t), 0) between 1 and 127 as replays from d"),
    "unattested_values": (_unattested, """
with v as (select distinct doc_id, case when quality = 1 then 'the' else 'license' end as value from labels) select doc_id, value from v where not exists (select 1 from documents d where d.doc_id = v.doc_id and contains(text, value))"""),
    "coverage_states": (_coverage, """
with s as (select s_suppkey, s_suppkey % 3 as st, s_suppkey % 4 = 0 as failed, s_suppkey % 5 > 0 as kept, s_suppkey % 7 > 0 as dated, s_suppkey % 6 > 0 as filled from supplier),
f as (select s_suppkey, case when st = 0 and failed then 'healthy_with_failure' when st = 0 and not dated then 'healthy_without_date' when st = 1 and not failed then 'degraded_without_failure' when st = 1 and not kept then 'degraded_without_last_good' when st = 2 and filled then 'unavailable_with_documents' end as fault from s)
select * from f where fault is not null"""),
    "prior_evidence": (_prior, "with s as (select s_suppkey as k from supplier), f as (select k as source, case when k % 9 = 0 then 'no_prior' when k % 7 >= 5 then 'not_earlier' when k % 5 = 0 then 'schema' when k % 2 > 0 then 'snapshot' end as fault from s) select * from f where fault is not null"),
    "artifact_faults": (_artifacts, "with f as (select n_name as path, case when n_nationkey <= 3 then 'missing' when n_nationkey >= 20 then 'unlisted' when n_nationkey % 5 = 0 then 'size' when n_nationkey % 6 = 0 then 'digest' end as fault from nation) select * from f where fault is not null"),
    "data_as_of": (_as_of, "select event_type, coalesce(strftime(max(ts) filter (event_type != 'click'), '%Y-%m-%d %H:%M'), '2024-06-01 00:00') as as_of from events group by event_type"),
    "minimum_counts": (_minimum, "with w(lang, least) as (values ('en', 10), ('de', 1000000), ('xx', 1)) select lang, count(doc_id) as n, least from w left join documents using (lang) group by lang, least having count(doc_id) < least"),
    "stale_indexes": (_stale, "select o_custkey, date_diff('day', max(o_orderdate)::date, date '1998-08-02')::int as age from orders group by 1 having date_diff('day', max(o_orderdate)::date, date '1998-08-02') > 120"),
    "record_set_issues": (_issues, """
select 'negative' as check, c_custkey::varchar as id from customer where c_acctbal < 0 union all select 'unknown_customer', o_orderkey::varchar from orders where o_custkey not in (select c_custkey from customer where c_nationkey > 2)
union all select 'repeated', l_orderkey::varchar from (select l_orderkey, l_partkey from lineitem group by all having count(*) > 1)"""),
    "share_thresholds": (_enough, """
with n as (select o_orderpriority, count(*) as wanted, count_if(o_orderkey % case when o_orderpriority < '3' then 40 else 9 end > 0) as complete from orders group by 1)
select *, (wanted * 9 + 9) // 10 as needed, complete >= (wanted * 9 + 9) // 10 as passes from n"""),
    "duplicate_ids": (_duplicates, "with a as (select o_orderkey as id, 'orders' as t from orders union all select c_custkey, 'customer' from customer) select id, count(*) as n, string_agg(distinct t, ',' order by t) as tables from a group by id having count(*) > 1"),
    "orphan_refs": (_orphans, "select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderkey % 11 != 0)"),
    "coverage_reconcile": (_reconcile, "with a as (select l_orderkey as o_orderkey, count(*) as actual from lineitem group by 1), s as (select o_orderkey, 4 + o_orderkey % 3 as stated from orders) select o_orderkey, coalesce(stated, 0)::bigint as stated, coalesce(actual, 0) as actual from s full join a using (o_orderkey) where coalesce(stated, 0) != coalesce(actual, 0)"),
    "compound_uniqueness": (_compound, "select l_partkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1"),
    "snapshot_equality": (_same, "with a as (select c_custkey, c_nationkey from customer where c_custkey % 5 != 0), b as (select c_custkey, c_nationkey from customer where c_custkey % 7 != 0) select * from (select 'left' as side, count(*) as n from (from a except all from b) union all select 'right', count(*) from (from b except all from a)) where n > 0"),
    "recall_at_k": (_recall, "with r as (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents), w as (select d.lang, doc_id from labels join documents d using (doc_id) where quality = 1) select w.lang, count(*) as wanted, count(r.doc_id) as found, bool_and(r.doc_id is not null) as complete from w left join (select * from r where rank <= 50) r using (lang, doc_id) group by w.lang"),
}
