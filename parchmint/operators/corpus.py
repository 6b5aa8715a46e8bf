"""Evidence closures, policy projections and receipts over a corpus of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.session import materialize, table


#: Relations whose targets a projection must keep (fixed values).
PROCEDURAL = ("amends", "corrects", "repeals", "supersedes")


def work_node(c: str) -> Column:
    return F.concat(F.lit("w:"), F.col(c).cast("string"))


def profile_node(c: str) -> Column:
    return F.concat(F.lit("p:"), F.col(c).cast("string"))


def evidence_edges(works: DataFrame, degraded: DataFrame, captured: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """node, needed: what a projection that keeps a node must keep too. Works are w:id, source profiles p:id.

    A profile needs all of its works. A work needs its profile if that is degraded (the last good
    state is kept as a whole), the profile of a capture that is its only evidence (captured: work,
    profile), the owners of its evidence's segments (evidence: work, owner) and the targets of its
    procedural relations, of all relations if its profile is degraded (relations: work, type, target).
    """
    bad = degraded.select("profile").distinct()
    of_profile = works.select(profile_node("profile").alias("node"), work_node("work").alias("needed"))
    whole = works.join(bad, "profile", "left_semi").select(work_node("work").alias("node"), profile_node("profile").alias("needed"))
    only = captured.select(work_node("work").alias("node"), profile_node("profile").alias("needed"))
    owners = evidence.select(work_node("work").alias("node"), work_node("owner").alias("needed"))
    kept = relations.join(works, "work").join(bad.withColumn("bad", F.lit(True)), "profile", "left").filter(F.col("type").isin(*PROCEDURAL) | F.col("bad"))
    targets = kept.select(work_node("work").alias("node"), work_node("target").alias("needed"))
    return of_profile.unionByName(whole).unionByName(only).unionByName(owners).unionByName(targets).filter("needed is not null and node != needed").distinct()


def closure(seed: DataFrame, needs: DataFrame) -> DataFrame:
    """node: the seed (node) and all that it needs (node, needed), to a fixpoint by frontiers.

    Each round joins only what the last one found; found nodes are written, which ends lineage.
    """
    needs = materialize(needs, "needs")
    seen = frontier = materialize(seed.select("node").distinct(), "closed")
    while True:
        fresh = frontier.join(needs, "node").select(F.col("needed").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(fresh, "closure")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "closed")


def kept_works(works: DataFrame, closed: DataFrame) -> DataFrame:
    """Works whose node a closure holds."""
    return works.join(closed, work_node("work") == F.col("node"), "left_semi")


def manifest(works: DataFrame, kept: DataFrame) -> DataFrame:
    """profile, works, kept, omitted, complete: what a projection keeps of each profile."""
    mark = kept.select("work").withColumn("there", F.lit(True))
    n = works.join(mark, "work", "left").groupBy("profile").agg(F.count("*").alias("works"), F.count("there").alias("kept"))
    return n.select("profile", "works", "kept", (F.col("works") - F.col("kept")).alias("omitted"), (F.col("works") == F.col("kept")).alias("complete"))


def omitted(works: DataFrame, kept: DataFrame) -> DataFrame:
    """work: what a projection leaves out."""
    return works.select("work").join(kept, "work", "left_anti")


def displayed(rows: DataFrame, policy: str, text: str) -> DataFrame:
    """Masks texts by display policy: only full_text shows, else null with the reason."""
    shown = F.col(policy) == "full_text"
    return rows.withColumn("reason", F.when(~shown, F.concat(F.lit("display_policy_"), policy))).withColumn(text, F.when(shown, F.col(text)))


def current_receipts(receipts: DataFrame, subject: str, at: str) -> DataFrame:
    """subject, state: none, current or conflict, by receipts (issued, expires) that hold at a time; half open."""
    live = (F.col("issued") <= F.lit(at).cast("timestamp")) & (F.col("expires") > F.lit(at).cast("timestamp"))
    n = F.count_if(live)
    return receipts.groupBy(subject).agg(F.when(n == 0, "none").when(n == 1, "current").otherwise("conflict").alias("state"))


def denials(requests: DataFrame, permissions: DataFrame, on: str) -> DataFrame:
    """request, denied: a transfer is allowed only if every permission of its source allows it.

    requests: request, on, purpose, field. permissions: on, purpose, fields (array).
    """
    both = requests.join(permissions.withColumnRenamed("purpose", "__p"), on)
    reason = F.when(F.col("purpose") != F.col("__p"), "purpose").when(~F.array_contains("fields", F.col("field")), "field")
    return both.groupBy("request").agg(F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("denied"))


def _projection(spark, d) -> tuple[DataFrame, DataFrame]:
    """(works, kept): orders as works of their customers' collections; seeded by publication, closed over their evidence."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    works = o.select(k.alias("work"), (F.col("o_custkey") % 400).alias("profile"))
    degraded = works.select("profile").distinct().filter("profile % 40 = 7")
    captured = o.filter("o_orderkey % 50 = 3").select(k.alias("work"), (k % 400).alias("profile"))
    evidence = o.filter("o_orderkey % 6 = 1").select(k.alias("work"), (k * 2 % 15013).alias("owner")).join(works.select(F.col("work").alias("owner")), "owner", "left_semi")
    kind = F.element_at(F.array(*map(F.lit, ("cites", *PROCEDURAL))), (k % 5 + 1).cast("int"))
    relations = o.filter("o_orderkey % 4 = 2").select(k.alias("work"), kind.alias("type"), (k * 3 % 15017).alias("target")).join(works.select(F.col("work").alias("target")), "target", "left_semi")
    seed = o.filter("o_orderkey < 30").select(work_node("o_orderkey").alias("node"))
    return works, kept_works(works, closure(seed, evidence_edges(works, degraded, captured, evidence, relations)))


def _closure(spark, d):
    return _projection(spark, d)[1].select("work")


def _omitted(spark, d):
    works, kept = _projection(spark, d)
    return omitted(works, kept.select("work"))


def _manifest(spark, d):
    return manifest(*_projection(spark, d))


def _displayed(spark, d):
    docs = table(spark, d, "documents").withColumn("policy", F.element_at(F.array(F.lit("full_text"), F.lit("excerpt"), F.lit("metadata_link")), (F.col("doc_id") % 3 + 1).cast("int")))
    return displayed(docs, "policy", "text").select("doc_id", "reason", F.length("text").alias("n"))


def _receipts(spark, d):
    r = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("issued"), F.date_add("o_orderdate", 90).cast("timestamp").alias("expires"))
    return current_receipts(r, "o_custkey", "1995-06-01")


def _denials(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 2 == 0, "study").otherwise("export").alias("purpose"), F.when(F.col("c_custkey") % 5 == 0, "name").otherwise("place").alias("field"))
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "study").otherwise("export").alias("purpose"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("name"), F.lit("place"))).otherwise(F.array(F.lit("place"))).alias("fields"))
    return denials(c, n, "n_nationkey")


_CLOSED = """with recursive w as (select o_orderkey as work, o_custkey % 400 as profile from orders),
n as (select 'p:' || profile as node, 'w:' || work as needed from w union select 'w:' || work, 'p:' || profile from w where profile % 40 = 7 union select 'w:' || work, 'p:' || work % 400 from w where work % 50 = 3
  union select 'w:' || work, 'w:' || work * 2 % 15013 from w where work % 6 = 1 and work * 2 % 15013 in (select work from w)
  union select 'w:' || work, 'w:' || work * 3 % 15017 from w where work % 4 = 2 and (work % 5 > 0 or profile % 40 = 7) and work * 3 % 15017 in (select work from w)),
r as (select 'w:' || work as node from w where work < 30 union select needed from r join n using (node)),
kept as (select work, profile from w where 'w:' || work in (select node from r))"""

QUERIES = {
    "closure_projection": (_closure, _CLOSED + " select work from kept"),
    "closure_omitted": (_omitted, _CLOSED + " select work from w where work not in (select work from kept)"),
    "closure_manifest": (_manifest, _CLOSED + " select w.profile, count(*) as works, count(kept.work) as kept, count(*) - count(kept.work) as omitted, count(*) = count(kept.work) as complete from w left join kept using (work) group by w.profile"),
    "display_policy": (_displayed, "select doc_id, case doc_id % 3 when 1 then 'display_policy_excerpt' when 2 then 'display_policy_metadata_link' end as reason, case when doc_id % 3 = 0 then length(text)::int end as n from documents"),
    "current_receipts": (_receipts, "select o_custkey, case count_if(o_orderdate <= timestamp '1995-06-01' and o_orderdate::date + 90 > timestamp '1995-06-01') when 0 then 'none' when 1 then 'current' else 'conflict' end as state from orders group by o_custkey"),
    "transfer_denials": (_denials, """
select c_custkey as request, case when (case when c_custkey % 2 = 0 then 'study' else 'export' end) != (case when n_nationkey % 3 = 0 then 'study' else 'export' end) then 'purpose'
  when c_custkey % 5 = 0 and n_nationkey % 2 = 1 then 'field' else '' end as denied from customer join nation on c_nationkey = n_nationkey"""),
}
