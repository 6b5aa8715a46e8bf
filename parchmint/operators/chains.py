"""Chains of records: supersession, corrections, revision logs with rollbacks, digests over children.

Chains are followed by pointer doubling: each round doubles how far a row has looked, and is a written
table, so a chain of n links takes about log2(n) rounds. What branches, meets or turns in a circle is a
fault with a name, never an endless loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import materialize, table


def chains(docs: DataFrame, successors: DataFrame) -> DataFrame:
    """doc, head, place, tip, length, fault: where each document stands in its chain of successors.

    docs: doc. successors: doc, next. Where a document has several successors (fork) or is the successor
    of several (join), none of these links is followed and each part is a chain of its own. Documents
    on a circle have no place. Successors that are no documents end a chain (missing).
    """
    links = successors.select("doc", "next").filter("doc is not null and next is not null").distinct()
    forks = links.groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("fork"))
    joins = links.groupBy("next").count().filter("count > 1").select(F.col("next").alias("doc"), F.lit(True).alias("meet"))
    names = docs.select("doc").distinct()
    here = names.select(F.col("doc").alias("next"), F.lit(True).alias("there"))
    good = links.join(forks.select("doc"), "doc", "left_anti").join(joins.select(F.col("doc").alias("next")), "next", "left_anti")
    good = good.join(here, "next", "left")
    base = names.join(good, "doc", "left").join(forks, "doc", "left").join(joins, "doc", "left")
    ends = F.col("next").isNull() | F.col("there").isNull()
    missing = F.col("next").isNotNull() & F.col("there").isNull()
    start = materialize(base.select("doc", F.when(ends, F.col("doc")).otherwise(F.col("next")).alias("at"), F.when(ends, 0).otherwise(1).cast("long").alias("dist"), ends.alias("ends"), F.concat_ws(",", F.when(F.col("fork"), "fork"), F.when(F.col("meet"), "join"), F.when(missing, "missing")).alias("fault")), "places")
    now = start.select("doc", "at", "dist")
    for _ in range(max(1, start.count().bit_length())):
        ahead = now.select(F.col("doc").alias("at"), F.col("at").alias("further"), F.col("dist").alias("more"))
        now = materialize(now.join(ahead, "at").select("doc", F.col("further").alias("at"), (F.col("dist") + F.col("more")).alias("dist")), "places")
    # After so many rounds every path has come to its tip; what has not turns in a circle, be it of one document.
    tips = start.filter("ends").select(F.col("doc").alias("at"), F.lit(True).alias("is_tip"))
    out = now.join(tips, "at", "left").join(start.select("doc", "fault"), "doc")
    whole = out.filter("is_tip").groupBy("at").agg((F.max("dist") + 1).alias("length"), F.max_by("doc", "dist").alias("head"))
    fault = F.concat_ws(",", F.nullif("fault", F.lit("")), F.when(F.col("is_tip").isNull(), "circle"))
    return out.join(whole, "at", "left").select("doc", "head", (F.col("length") - F.col("dist")).alias("place"), F.when(F.col("is_tip"), F.col("at")).alias("tip"), "length", fault.alias("fault"))


def corrections(forward: DataFrame, backward: DataFrame, fields: list[str]) -> DataFrame:
    """correcting, corrected, faults: both ends of every correction, compared field by field.

    forward: correcting, corrected and fields, as the correcting document states them. backward: the same
    as the corrected one states them. Faults: missing_back, missing_forward, repeated, and each field that differs.
    """
    key = ["correcting", "corrected"]
    one = lambda rows, side: rows.groupBy(*key).agg(F.count("*").alias(f"{side}_n"), *(F.min(f).alias(f"{side}_{f}") for f in fields))
    both = one(forward, "f").join(one(backward, "b"), key, "full")
    differs = [F.when(F.col("f_n").isNotNull() & F.col("b_n").isNotNull() & ~F.col(f"f_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]
    repeated = F.when((F.coalesce("f_n", F.lit(0)) > 1) | (F.coalesce("b_n", F.lit(0)) > 1), "repeated")
    return both.select(*key, F.concat_ws(",", F.when(F.col("b_n").isNull(), "missing_back"), F.when(F.col("f_n").isNull(), "missing_forward"), repeated, *differs).alias("faults"))


def revisions(log: DataFrame) -> DataFrame:
    """study, rev, content, bindings, fault: the state of a study after each entry of its log.

    log: study, rev (1, 2, ...), kind, target, name, value, refs (map of names to what they point to).
    set: content of its own with refs. rollback: the state after the entry ``target`` holds again, and a
    rollback may point to a rollback. rebind: the state before it, with ``name`` pointing to ``value``.
    content is the set entry whose content holds. An entry that leads to none (no_such_revision: a target
    that is missing or not earlier, or nothing before a rebind) has no state, nor has what leads to it.
    """
    kind, rev = F.col("kind"), F.col("rev")
    step = F.when(kind == "set", rev).when((kind == "rollback") & (F.col("target") < rev), F.col("target")).when(kind == "rebind", rev - 1)
    own = F.when(kind == "rebind", F.map_from_arrays(F.array("name"), F.array("value"))).when(kind == "set", F.coalesce("refs", F.expr("cast(map() as map<string,string>)"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    now = materialize(log.select("study", "rev", step.alias("at"), own.alias("bound"), (kind == "set").alias("done")), "log")
    for _ in range(max(1, now.groupBy("study").count().agg(F.max("count")).first()[0] or 1).bit_length() + 1):
        # What is nearer to the entry goes before what it leads to.
        ahead = now.select("study", F.col("rev").alias("at"), F.col("at").alias("further"), F.col("bound").alias("old"), F.col("done").alias("there"))
        joined = now.filter("not done and at is not null").join(ahead, ["study", "at"], "left")
        over = F.map_concat("bound", F.map_filter(F.coalesce("old", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~F.map_contains_key("bound", k)))
        moved = joined.select("study", "rev", F.col("further").alias("at"), over.alias("bound"), F.coalesce("there", F.lit(False)).alias("done"))
        now = materialize(now.filter("done or at is null").unionByName(moved), "log")
        if now.filter("not done and at is not null").isEmpty():
            break
    told = F.array_join(F.transform(F.array_sort(F.map_entries("bound")), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return now.select("study", "rev", F.when(F.col("done"), F.col("at")).alias("content"), F.when(F.col("done"), told).alias("bindings"), F.when(~F.col("done"), "no_such_revision").alias("fault"))


def node_digest(body: Column, children: Column) -> Column:
    """SHA-256 over a body and the sorted digests of children, one a line."""
    return F.sha2(F.concat_ws("\n", body, F.array_join(F.array_sort(children), "\n")), 256)


def digest_blame(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """node, stated, made, state: digests made again from the leaves up, and which nodes explain all differences.

    nodes: node, body, stated. children: node, child. cause: the stated digest does not follow from the
    node's own body and the stated digests of its children; no smaller set explains what differs. effect: only
    what lies below differs. circle: never made. A child that is no node counts as an empty digest.
    """
    nodes = materialize(nodes.select("node", "body", "stated"), "nodes")
    links = materialize(children.select("node", "child").distinct(), "children")
    below = links.join(nodes.select(F.col("node").alias("child"), F.coalesce("stated", F.lit("")).alias("s")), "child", "left")
    local = nodes.join(below.groupBy("node").agg(F.collect_list(F.coalesce("s", F.lit(""))).alias("c")), "node", "left").select("node", node_digest(F.col("body"), F.coalesce("c", F.array().cast("array<string>"))).alias("local"))
    waiting = nodes.select("node", "body")
    made = None
    while True:
        held = links.join(waiting.select(F.col("node").alias("child")), "child", "left_semi").select("node").distinct()
        ready = waiting.join(held, "node", "left_anti")
        if made is None:
            known = links.limit(0).select("child", F.lit("").alias("m"))
        else:
            known = made.select(F.col("node").alias("child"), F.col("made").alias("m"))
        mine = links.join(ready.select("node"), "node", "left_semi").join(known, "child", "left").groupBy("node").agg(F.collect_list(F.coalesce("m", F.lit(""))).alias("c"))
        level = materialize(ready.join(mine, "node", "left").select("node", node_digest(F.col("body"), F.coalesce("c", F.array().cast("array<string>"))).alias("made")), "level")
        if level.isEmpty():
            break
        made = level if made is None else made.unionByName(level)
        waiting = materialize(waiting.join(level.select("node"), "node", "left_anti"), "waiting")
    every = nodes.join(made if made is not None else nodes.select("node", F.lit("").alias("made")).limit(0), "node", "left").join(local, "node")
    state = F.when(F.col("made").isNull(), "circle").when(~F.col("local").eqNullSafe(F.col("stated")), "cause").when(F.col("made") != F.col("stated"), "effect").otherwise("same")
    return every.select("node", "stated", "made", state.alias("state"))


# --- queries --------------------------------------------------------------------------------------


def _chains(spark, d):
    """Orders of a customer supersede each other by date; every fortieth also another one, every seventieth turns back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = o.withColumns({"next": F.lead("o_orderkey").over(order), "first": F.first("o_orderkey").over(order)})
    usual = ranked.select(F.col("o_orderkey").alias("doc"), "next")
    more = o.filter("o_orderkey % 40 = 0").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") + 1).alias("next"))
    back = ranked.filter("next is null and o_custkey % 7 = 0").select(F.col("o_orderkey").alias("doc"), F.col("first").alias("next"))
    return chains(o.select(F.col("o_orderkey").alias("doc")), usual.unionByName(more).unionByName(back))


def _corrections(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select((k + 1_000_000).alias("correcting"), k.alias("corrected"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("title"), "o_orderkey")
    forward = rows.filter("o_orderkey % 9 != 1").drop("o_orderkey")
    changed = rows.withColumns({"day": F.when(k % 5 == 0, "1990-01-01").otherwise(F.col("day")), "title": F.when(k % 6 == 0, F.lower("title")).otherwise(F.col("title"))})
    backward = changed.filter("o_orderkey % 8 != 3").drop("o_orderkey")
    return corrections(forward, backward.unionByName(backward.filter("corrected % 50 = 0")), ["day", "title"])


def _log(spark, d) -> DataFrame:
    """A study for each customer, an entry for each order: contents, rollbacks (some to rollbacks, some to what is not there), rebinds."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("study"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("rev"), "o_orderkey")
    k, r = F.col("o_orderkey"), F.col("rev")
    kind = F.when((r > 1) & (k % 3 == 0), "rollback").when((r > 1) & (k % 3 == 1) | (r == 1) & (k % 29 == 0), "rebind").otherwise("set")
    target = F.when(kind == "rollback", F.when(k % 11 == 0, r + 1).otherwise(F.greatest(F.lit(1), r - 1 - k % 4)))
    refs = F.create_map(F.lit("a"), k.cast("string"), F.lit("b"), (k % 10).cast("string"))
    return rows.select("study", "rev", kind.alias("kind"), target.alias("target"), F.concat(F.lit("n"), (k % 2).cast("string")).alias("name"), k.cast("string").alias("value"), F.when(kind == "set", refs).alias("refs"))


def _revisions(spark, d):
    return revisions(_log(spark, d))


def _digests(spark, d):
    """Regions hold nations, nations customers, customers orders; some orders' and nations' bodies have changed since."""
    one = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    r = table(spark, d, "region").select(one("r", "r_regionkey").alias("node"), F.col("r_name").alias("body"), F.lit(False).alias("changed"))
    n = table(spark, d, "nation").select(one("n", "n_nationkey").alias("node"), F.col("n_name").alias("body"), (F.col("n_nationkey") == 3).alias("changed"))
    c = table(spark, d, "customer").select(one("c", "c_custkey").alias("node"), F.col("c_name").alias("body"), F.lit(False).alias("changed"))
    o = table(spark, d, "orders").select(one("o", "o_orderkey").alias("node"), F.col("o_orderpriority").alias("body"), (F.col("o_orderkey") % 997 == 5).alias("changed"))
    children = table(spark, d, "nation").select(one("r", "n_regionkey").alias("node"), one("n", "n_nationkey").alias("child"))
    children = children.unionByName(table(spark, d, "customer").select(one("n", "c_nationkey").alias("node"), one("c", "c_custkey").alias("child")))
    children = children.unionByName(table(spark, d, "orders").select(one("c", "o_custkey").alias("node"), one("o", "o_orderkey").alias("child")))
    every = r.unionByName(n).unionByName(c).unionByName(o)
    none = every.select("node", "body", F.lit("").alias("stated"))
    stated = digest_blame(none, children).select("node", F.col("made").alias("stated"))  # what was right before the change
    now = every.join(stated, "node").select("node", F.when(F.col("changed"), F.concat("body", F.lit(" (changed)"))).otherwise(F.col("body")).alias("body"), "stated")
    return digest_blame(now, children).select("node", F.col("stated") == F.col("made"), "state").toDF("node", "same", "state")


QUERIES = {
    "successor_chains": (_chains, """
with recursive w as (select o_orderkey as doc, o_custkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as first from orders),
l as (select doc, next from w where next is not null union select doc, doc + 1 from w where doc % 40 = 0 union select doc, first from w where next is null and o_custkey % 7 = 0),
f as (select doc from l group by doc having count(*) > 1), j as (select next as doc from l group by next having count(*) > 1),
g as (select * from l where doc not in (select doc from f) and next not in (select doc from j)),
e as (select * from g where next in (select doc from w)),
p as (select doc as tip, doc, 0 as dist from w where doc not in (select doc from e) union all select tip, e.doc, dist + 1 from p join e on e.next = p.doc),
t as (select tip, max(dist) + 1 as length, arg_max(doc, dist) as head from p group by tip)
select w.doc, head, length - dist as place, p.tip, length, concat_ws(',', case when w.doc in (select doc from f) then 'fork' end, case when w.doc in (select doc from j) then 'join' end,
  case when w.doc in (select doc from g where next not in (select doc from w)) then 'missing' end, case when p.tip is null then 'circle' end) as fault
from w left join p on w.doc = p.doc left join t on p.tip = t.tip"""),
    "correction_ends": (_corrections, """
select o_orderkey + 1000000 as correcting, o_orderkey as corrected, concat_ws(',', case when o_orderkey % 8 = 3 then 'missing_back' end, case when o_orderkey % 9 = 1 then 'missing_forward' end, case when o_orderkey % 50 = 0 and o_orderkey % 8 != 3 then 'repeated' end,
  case when o_orderkey % 5 = 0 and o_orderkey % 8 != 3 and o_orderkey % 9 != 1 then 'day' end, case when o_orderkey % 6 = 0 and o_orderkey % 8 != 3 and o_orderkey % 9 != 1 then 'title' end) as faults from orders where not (o_orderkey % 8 = 3 and o_orderkey % 9 = 1)"""),
    "revision_states": (_revisions, """
with recursive e as (select o_custkey as study, row_number() over (partition by o_custkey order by o_orderkey) as rev, o_orderkey as k from orders),
l as (select *, case when rev > 1 and k % 3 = 0 then 'rollback' when rev > 1 and k % 3 = 1 or rev = 1 and k % 29 = 0 then 'rebind' else 'set' end as kind, case when k % 11 = 0 then rev + 1 else greatest(1, rev - 1 - k % 4) end as target from e),
s as (
  select study, rev, rev as at_, 0 as depth, null::bigint as via, null::varchar as name, null::varchar as value, kind as end_ from l
  union all
  select s.study, s.rev, n.rev, depth + 1, null, case when c.kind = 'rebind' then 'n' || c.k % 2 end, case when c.kind = 'rebind' then c.k::varchar end, n.kind
  from s join l c on c.study = s.study and c.rev = s.at_ join l n on n.study = s.study and n.rev = case c.kind when 'rollback' then case when c.target < c.rev then c.target end when 'rebind' then c.rev - 1 end),
b as (select study, rev, name, arg_min(value, depth) as value from s where name is not null group by all),
done as (select study, rev, at_ as content from s where end_ = 'set'),
bound as (
  select d.study, d.rev, 'a' as name, l.k::varchar as value from done d join l on l.study = d.study and l.rev = d.content
  union all select d.study, d.rev, 'b', (l.k % 10)::varchar from done d join l on l.study = d.study and l.rev = d.content
  union all select b.* from b join done d using (study, rev)),
told as (select study, rev, string_agg(name || '=' || value, ',' order by name) as bindings from bound group by all)
select l.study, l.rev, content, bindings, case when content is null then 'no_such_revision' end as fault from l left join done d using (study, rev) left join told using (study, rev)"""),
    "digest_blame": (_digests, """
with o as (select *, o_orderkey % 997 = 5 as x from orders), c as (select c_custkey, c_nationkey, coalesce(bool_or(x), false) as x from customer left join o on o_custkey = c_custkey group by all),
n as (select n_nationkey, n_regionkey, n_nationkey = 3 as own, coalesce(bool_or(x), false) as below from nation left join c on c_nationkey = n_nationkey group by all),
r as (select r_regionkey, coalesce(bool_or(own or below), false) as x from region left join n on n_regionkey = r_regionkey group by all)
select 'o' || o_orderkey as node, not x as same, case when x then 'cause' else 'same' end as state from o union all select 'c' || c_custkey, not x, case when x then 'effect' else 'same' end from c
union all select 'n' || n_nationkey, not (own or below), case when own then 'cause' when below then 'effect' else 'same' end from n union all select 'r' || r_regionkey, not x, case when x then 'effect' else 'same' end from r"""),
}
