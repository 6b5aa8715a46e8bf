"""What holds along paths whose links hold for a time: delegated authority, terms under their ancestors.

Intervals are half-open, [from, to); a null end is open. A path holds only where all its links do, so
its interval is their intersection; what a node has from a root is the union over all paths. Rounds
follow only what the last one has added (semi-naive) and what is not already covered (subsumption), so
cycles end. A round deals out what is known once and writes only what it has added.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import materialize, table

#: Stands for an open end; rounds after which what is known is written as one table, which bounds a plan.
OPEN, ROUNDS = 1 << 40, 16


def merged(rows: DataFrame, *keys: str, old: str | None = None) -> DataFrame:
    """keys, from, to: the unions of intervals by key; those that touch are one.

    ``old``, a boolean column: only the unions that none of the old rows is.
    """
    order = Window.partitionBy(*keys).orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "from", "to", *([old] if old else [])).withColumn("__reach", reach)
    groups = marked.withColumn("__g", F.sum((F.col("__reach").isNull() | (F.col("from") > F.col("__reach"))).cast("int")).over(order))
    union = [F.min("from").alias("from"), F.max("to").alias("to")]
    if old is None:
        return groups.groupBy(*keys, "__g").agg(*union).drop("__g")
    widest = F.max(F.when(F.col(old), F.struct(-F.col("from"), F.col("to")))).alias("__old")  # of the old rows that begin first
    found = groups.groupBy(*keys, "__g").agg(*union, widest)
    return found.filter(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(-F.col("from"), F.col("to")))).drop("__g", "__old")


def _bounded(rows: DataFrame) -> DataFrame:
    """Intervals with numbers for open ends; empty ones and those of null nodes go."""
    out = rows.withColumns({"from": F.coalesce(F.col("from").cast("long"), F.lit(-OPEN)), "to": F.coalesce(F.col("to").cast("long"), F.lit(OPEN))})
    return out.filter("`from` < `to`")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, from, to: all that each root's authority reaches, as disjoint intervals.

    edges: src, dst, from, to. roots: root, node, from, to: what a root has by itself. Open ends are null
    again in the result.
    """
    steps = materialize(_bounded(edges.select("src", "dst", "from", "to").filter("src is not null and dst is not null")).select(F.col("src").alias("node"), "dst", F.col("from").alias("f"), F.col("to").alias("t")), "links")
    known = fresh = materialize(merged(_bounded(roots.select("root", "node", "from", "to")), "root", "node"), "held")
    for n in itertools.count(1):
        step = fresh.join(steps, "node").select("root", F.col("dst").alias("node"), F.greatest("from", "f").alias("from"), F.least("to", "t").alias("to")).filter("`from` < `to`")
        both = known.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        fresh = materialize(merged(both, "root", "node", old="old"), "fresh")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)  # what it replaces stays: it is covered
        if n % ROUNDS == 0:
            known = materialize(merged(known, "root", "node"), "held")
    return merged(known, "root", "node").withColumns({"from": F.nullif("from", F.lit(-OPEN)), "to": F.nullif("to", F.lit(OPEN))})


def holds(day, low: str, high: str):
    """Whether a day lies in an interval with open ends."""
    return (F.col(low).isNull() | (F.col(low) <= day)) & (F.col(high).isNull() | (day < F.col(high)))


#: Why an assignment fails, in the order in which reasons are told.
REASONS = ("unknown_term", "term_not_valid", "no_crosswalk", "foreign_target")


def rolled_up(assignments: DataFrame, terms: DataFrame, parents: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """id, ancestor, targets, reasons: a row for each term that an assignment counts under on its day, itself included.

    assignments: id, taxonomy, term, day, target (the taxonomy that it is to be told in). terms: taxonomy,
    term, from, to. parents: taxonomy, term, parent, from, to. crosswalk: taxonomy, term, target, target_term,
    from, to. An assignment with a target outside its own target taxonomy fails as a whole: one row with its
    reasons and no ancestor.
    """
    node = lambda term: F.struct("taxonomy", F.col(term).alias("term"))
    own = assignments.select("id", "day", "target", node("term").alias("node"))
    valid = terms.select(node("term").alias("node"), F.col("from").alias("t_from"), F.col("to").alias("t_to"))
    known = own.join(valid, "node", "left").groupBy("id").agg(F.count("t_from").alias("n"), F.bool_or(holds(F.col("day"), "t_from", "t_to") & F.col("t_from").isNotNull()).alias("now"))
    walk = crosswalk.select(node("term").alias("node"), F.col("target").alias("into"), "target_term", F.col("from").alias("c_from"), F.col("to").alias("c_to"))
    found = own.join(walk, "node").filter(holds(F.col("day"), "c_from", "c_to")).groupBy("id").agg(F.bool_or(F.col("into") != F.col("target")).alias("foreign"), F.array_join(F.array_sort(F.collect_set("target_term")), ",").alias("targets"))
    tests = own.join(known, "id", "left").join(found, "id", "left")
    bad = (F.col("n") == 0, (F.col("n") > 0) & ~F.col("now"), F.col("targets").isNull(), F.coalesce("foreign", F.lit(False)))
    judged = tests.withColumn("reasons", F.concat_ws(",", *(F.when(b, r) for b, r in zip(bad, REASONS))))
    up = closure(parents.select(node("term").alias("src"), node("parent").alias("dst"), "from", "to"), own.select(F.col("node").alias("root"), "node").distinct().withColumns({"from": F.lit(None).cast("long"), "to": F.lit(None).cast("long")}))
    above = up.select(F.col("root").alias("node"), F.col("node.term").alias("ancestor"), F.col("from").alias("a_from"), F.col("to").alias("a_to"))
    passed = judged.filter("reasons = ''").join(above, "node").filter(holds(F.col("day"), "a_from", "a_to"))
    failed = judged.filter("reasons != ''").select("id", F.lit(None).cast(dict(parents.dtypes)["term"]).alias("ancestor"), F.lit(None).cast("string").alias("targets"), "reasons")
    return passed.select("id", "ancestor", "targets", "reasons").unionByName(failed)


# --- queries --------------------------------------------------------------------------------------


def _links(spark, d) -> DataFrame:
    """Delegations between customers, one an order, for thirty days; every twentieth also back, which makes cycles."""
    n = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    day = F.date_diff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders")
    there = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % n + 1).alias("dst"), day.alias("from"), (day + 30).alias("to"), "o_orderkey")
    back = there.filter("o_orderkey % 20 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "from", "to", "o_orderkey")
    return there.unionByName(back).drop("o_orderkey")


def _authority(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("root"), F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 1000).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    return closure(_links(spark, d), c)


def _roll_up(spark, d):
    p = table(spark, d, "part").select(F.lit("p").alias("taxonomy"), F.col("p_partkey").alias("k"), (F.col("p_size") * 10).cast("long").alias("f"))
    terms = p.filter("k % 13 != 5").select("taxonomy", F.col("k").alias("term"), F.col("f").alias("from"), (F.col("f") + 500).alias("to"))
    parents = p.filter("k > 1").select("taxonomy", F.col("k").alias("term"), F.floor(F.col("k") / 3).alias("parent"), F.col("f").alias("from"), F.when(F.col("k") % 4 > 0, F.col("f") + 400).alias("to"))
    walk = p.filter("k % 11 > 0").select("taxonomy", F.col("k").alias("term"), F.lit("x").alias("target"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("target_term"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    other = p.filter("k % 7 = 0").select("taxonomy", F.col("k").alias("term"), F.lit("y").alias("target"), F.concat(F.lit("y"), F.col("k").cast("string")).alias("target_term"), F.lit(100).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("p").alias("taxonomy"), (F.col("o_orderkey") % n + 1).alias("term"), (F.col("o_orderkey") % 700).alias("day"), F.lit("x").alias("target"))
    return rolled_up(a, terms, parents, walk.unionByName(other))


QUERIES = {
    "delegated_authority": (_authority, """
with recursive l as (
  select o_custkey as s, (o_custkey * 31 + o_orderkey) % (select max(c_custkey) from customer) + 1 as t, date_diff('day', date '1992-01-01', o_orderdate::date) as a, o_orderkey % 20 = 0 as back from orders),
e as (select s, t, a, a + 30 as b from l union all select t, s, a, a + 30 from l where back),
p as (
  select c_custkey as root, c_custkey as node, case when c_custkey % 3 > 0 then c_custkey % 1000 else -1000000000 end as a, 1000000000::bigint as b from customer
  union
  select root, t, greatest(p.a, e.a), least(p.b, e.b) from p join e on p.node = e.s where greatest(p.a, e.a) < least(p.b, e.b)),
m as (select *, max(b) over (partition by root, node order by a, b rows between unbounded preceding and 1 preceding) as reach from p),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by root, node order by a, b rows unbounded preceding) as g from m)
select root, node, nullif(min(a), -1000000000) as "from", nullif(max(b), 1000000000) as "to" from g group by root, node, g"""),
    "taxonomy_roll_up": (_roll_up, """
with recursive p as (select p_partkey as k, p_size * 10 as f from part),
a as (select o_orderkey as id, o_orderkey % (select max(p_partkey) from part) + 1 as term, o_orderkey % 700 as day from orders),
j as (
  select id, term, day, concat_ws(',', case when term % 13 = 5 then 'unknown_term' end, case when term % 13 != 5 and not (day >= f and day < f + 500) then 'term_not_valid' end,
    case when term % 11 = 0 and not (term % 7 = 0 and day >= 100) then 'no_crosswalk' end, case when term % 7 = 0 and day >= 100 then 'foreign_target' end) as reasons,
    case when term % 11 > 0 then 'x' || term end as targets from a join p on p.k = a.term),
up as (
  select id, term as ancestor, day from j where reasons = ''
  union
  select id, k // 3, day from up join p on p.k = up.ancestor where k > 1 and day >= f and (k % 4 = 0 or day < f + 400))
select up.id, ancestor, targets, reasons from up join j using (id) union all select id, null, null, reasons from j where reasons != ''"""),
}
