"""Reviews that add to a corpus, transfers under all their permissions, facts and what is derived from them, cases, parcels.

Each operator says for every row which of its tests fail, in a fixed order; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import table

#: Tests in the order in which they are told.
SELECTOR_TESTS = ("unknown_version", "out_of_scope", "no_segment", "ambiguous_segment", "digest_differs", "review_before_capture")
TRANSFER_TESTS = ("not_active", "recipient", "purpose", "fields", "onward_sharing", "retention", "revoked")
FACT_TESTS = ("id_differs", "no_source", "interval_inverted", "observed_after_recorded")
DERIVED_TESTS = ("no_inputs", "input_unknown", "input_broken", "derived_before_input", "outside_inputs")
PARCEL_TESTS = ("id_malformed", "no_layers", "layer_unknown", "layer_not_valid", "evidence_missing", "evidence_after_parcel")


def _failing(tests: dict[str, Column]) -> Column:
    """Names of tests that fail, comma-joined; null counts as no failure."""
    return F.concat_ws(",", *(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in tests.items()))


def enriched(items: DataFrame, selectors: DataFrame, segments: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, kind, segments of items whose selectors all resolve; item, selector, faults of the others).

    items: item, kind, scope (a version or null), reviewed. selectors: item, selector, version, locator,
    rendition and digest (or null). segments: segment, rendition, version, locator, digest, captured. versions:
    version. A selector must name exactly one segment, captured before the review.
    """
    asked = selectors.join(items.select("item", "scope", "reviewed"), "item").join(versions.select("version", F.lit(True).alias("there")).distinct(), "version", "left")
    held = segments.select("segment", F.col("rendition").alias("s_rendition"), "version", "locator", F.col("digest").alias("s_digest"), "captured")
    hits = asked.join(held, ["version", "locator"], "left").filter(F.col("rendition").isNull() | F.col("s_rendition").isNull() | (F.col("rendition") == F.col("s_rendition")))
    first = hits.groupBy("item", "selector").agg(F.count("segment").alias("n"), F.min("segment").alias("segment"), F.min("s_digest").alias("s_digest"), F.max("captured").alias("captured"))
    judged = asked.join(first, ["item", "selector"], "left")
    n = F.coalesce("n", F.lit(0))
    tests = {
        "unknown_version": F.col("there").isNull(), "out_of_scope": F.col("scope").isNotNull() & (F.col("scope") != F.col("version")), "no_segment": F.col("there").isNotNull() & (n == 0), "ambiguous_segment": n > 1,
        "digest_differs": (n == 1) & (F.col("digest") != F.col("s_digest")), "review_before_capture": (n == 1) & (F.col("reviewed") < F.col("captured")),
    }
    judged = judged.select("item", "selector", "segment", _failing(tests).alias("faults"))
    bad = judged.filter("faults != ''")
    good = items.join(bad.select("item").distinct(), "item", "left_anti").join(judged.select("item", "segment"), "item")
    added = good.groupBy("item", "kind").agg(F.array_sort(F.collect_set("segment")).alias("segments"))
    return added, bad.select("item", "selector", "faults")


def transfers(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """request, allowed, denials (test:n, in the order of TRANSFER_TESTS): a transfer needs every permission of its source.

    requests: request, source, at, recipient, purpose, fields (array), onward (bool), days. permissions:
    source, from, to (half-open, null open), recipients, purposes, fields (arrays), onward, days, revoked (or
    null). Without any permission: denied (no_permission).
    """
    p = permissions.select("source", F.col("from").alias("p_from"), F.col("to").alias("p_to"), "recipients", "purposes", F.col("fields").alias("p_fields"), F.col("onward").alias("p_onward"), F.col("days").alias("p_days"), "revoked")
    both = requests.join(p, "source")
    tests = {
        "not_active": (F.col("at") < F.col("p_from")) | (F.col("at") >= F.col("p_to")), "recipient": ~F.array_contains("recipients", F.col("recipient")), "purpose": ~F.array_contains("purposes", F.col("purpose")),
        "fields": F.size(F.array_except("fields", "p_fields")) > 0, "onward_sharing": F.col("onward") & ~F.col("p_onward"), "retention": F.col("days") > F.col("p_days"), "revoked": F.col("revoked") <= F.col("at"),
    }
    counted = both.groupBy("request").agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(bad, F.lit(False))).alias(t) for t, bad in tests.items()))
    told = F.concat_ws(",", *(F.when(F.col(t) > 0, F.concat(F.lit(f"{t}:"), F.col(t).cast("string"))) for t in TRANSFER_TESTS))
    denials = F.when(F.col("n").isNull(), "no_permission").otherwise(told)
    return requests.select("request").join(counted, "request", "left").select("request", (denials == "").alias("allowed"), denials.alias("denials"))


def fact_id(*parts: Column) -> Column:
    """The id of a fact or an assertion: from its content."""
    return F.concat(F.lit("f-"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 20))


def fact_faults(facts: DataFrame) -> DataFrame:
    """id, faults of facts: id, subject, value, source, from, to, observed, recorded."""
    tests = {"id_differs": F.col("id") != fact_id(F.col("subject"), F.col("value"), F.col("source")), "no_source": F.col("source").isNull(), "interval_inverted": F.col("from") >= F.col("to"), "observed_after_recorded": F.col("observed") > F.col("recorded")}
    return facts.select("id", _failing(tests).alias("faults"))


def derived_faults(derived: DataFrame, inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """id, faults of assertions derived from facts.

    derived: id, from, to, recorded. inputs: id, fact. The interval of an assertion lies within that which
    all its inputs share, and it is recorded after them; a broken fact breaks what is derived from it.
    """
    sound = fact_faults(facts).select(F.col("id").alias("fact"), (F.col("faults") != "").alias("broken"))
    known = inputs.join(facts.select(F.col("id").alias("fact"), F.col("from").alias("f"), F.col("to").alias("t"), F.col("recorded").alias("r")).join(sound, "fact"), "fact", "left")
    sums = known.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("broken").isNull()).alias("unknown"), F.count_if("broken").alias("broken"), F.max("r").alias("r"), F.max("f").alias("f"), F.min("t").alias("t"))
    rows = derived.join(sums, "id", "left")
    tests = {"no_inputs": F.col("n").isNull(), "input_unknown": F.col("unknown") > 0, "input_broken": F.col("broken") > 0, "derived_before_input": F.col("recorded") < F.col("r"), "outside_inputs": (F.col("from") < F.col("f")) | (F.col("to") > F.col("t")) | (F.col("to").isNull() & F.col("t").isNotNull()) | (F.col("from").isNull() & F.col("f").isNotNull())}
    return rows.select("id", _failing(tests).alias("faults"))


def case_states(cases: DataFrame, events: DataFrame, at) -> DataFrame:
    """case, state, since, event: the state of each case by its events up to a day.

    events: case, event, type, day, resolves (the event that it undoes, or null). What is undone does not
    count. No event: unknown; two latest ones of other types: ambiguous; else the type of the latest.
    """
    known = events.filter(F.col("day") <= F.lit(at))
    undone = known.filter("resolves is not null").select("case", F.col("resolves").alias("event")).distinct()
    live = known.filter("resolves is null").join(undone, ["case", "event"], "left_anti")
    last = live.withColumn("latest", F.max("day").over(Window.partitionBy("case"))).filter("day = latest")
    one = last.groupBy("case").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type"), F.min("day").alias("since"), F.min("event").alias("event"))
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise(F.col("type"))
    return cases.select("case").distinct().join(one, "case", "left").select("case", state.alias("state"), "since", F.when(F.col("n") == 1, F.col("event")).alias("event"))


def parcel_faults(parcels: DataFrame, layers: DataFrame, registry: DataFrame) -> DataFrame:
    """parcel, faults of land parcels and their layers of jurisdiction.

    parcels: parcel, day. layers: parcel, jurisdiction, url, evidence_day. registry: jurisdiction, from, to:
    what holds as a jurisdiction, half-open.
    """
    known = registry.groupBy("jurisdiction").agg(F.collect_list(F.struct("from", "to")).alias("times"))
    joined = layers.join(parcels.select("parcel", "day"), "parcel").join(known, "jurisdiction", "left")
    holds = F.exists("times", lambda t: (t["from"].isNull() | (t["from"] <= F.col("day"))) & (t["to"].isNull() | (F.col("day") < t["to"])))
    sums = joined.groupBy("parcel").agg(F.count("*").alias("n"), F.count_if(F.col("times").isNull()).alias("unknown"), F.count_if(F.col("times").isNotNull() & ~holds).alias("past"), F.count_if(F.col("url").isNull()).alias("bare"), F.count_if(F.col("evidence_day") > F.col("day")).alias("late"))
    tests = {"id_malformed": ~F.col("parcel").rlike("^[A-Z]{2}-[0-9]{1,12}$"), "no_layers": F.col("n").isNull(), "layer_unknown": F.col("unknown") > 0, "layer_not_valid": F.col("past") > 0, "evidence_missing": F.col("bare") > 0, "evidence_after_parcel": F.col("late") > 0}
    return parcels.join(sums, "parcel", "left").select("parcel", _failing(tests).alias("faults"))


# --- queries: every test fails for some rows --------------------------------------------------------


def _enriched(spark, d):
    """Orders as versions with their lines as segments; an item for each order that selects its first lines."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    day = F.col("o_orderdate").cast("date")
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("shipped"))
    segments = lines.select(text("g", F.col("l_orderkey"), "-", n).alias("segment"), text("r", F.col("l_orderkey")).alias("rendition"), F.col("l_orderkey").alias("version"), text("/p[", n, "]").alias("locator"), F.md5(n.cast("string")).alias("digest"), F.col("shipped").cast("date").alias("captured"))
    twice = segments.filter("version % 10 = 0").withColumns({"segment": F.concat("segment", F.lit("b")), "rendition": F.concat("rendition", F.lit("b"))})
    items = o.select(k.alias("item"), F.when(k % 2 == 0, "finding").otherwise("relation").alias("kind"), F.when(k % 6 == 0, k + 1).when(k % 3 == 0, k).alias("scope"), F.date_add(day, 400).alias("reviewed"))
    selectors = o.select(k.alias("item"), F.explode(F.array(F.lit(1), F.lit(2))).alias("selector")).select("item", "selector", F.when(F.col("item") % 7 == 0, F.col("item") + 10_000_000).otherwise(F.col("item")).alias("version"), text("/p[", F.col("selector"), "]").alias("locator"), F.when(F.col("item") % 20 == 0, text("r", F.col("item"))).alias("rendition"), F.when(F.col("item") % 11 == 0, F.lit("other")).alias("digest"))
    versions = o.select(k.alias("version"))
    added, bad = enriched(items, selectors, segments.unionByName(twice), versions)
    return added.select("item", F.col("kind").alias("what"), F.array_join("segments", ",").alias("detail")).unionByName(bad.select("item", F.concat(F.lit("selector "), F.col("selector").cast("string")).alias("what"), F.col("faults").alias("detail")))


def _transfers(spark, d):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    day = F.col("o_orderdate").cast("date")
    requests = table(spark, d, "orders").select(k.alias("request"), (k % 120 + 1).alias("source"), day.alias("at"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("recipient"), F.when(k % 3 == 0, "export").otherwise("study").alias("purpose"), F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("fields"), (k % 7 == 0).alias("onward"), (k % 100).alias("days"))
    rows = table(spark, d, "supplier").select(s.alias("source"), F.explode(F.sequence(F.lit(0), (s % 3).cast("int"))).alias("i"))
    i, n = F.col("i"), F.col("source")
    permissions = rows.select("source", F.when(i == 0, F.lit("1993-01-01").cast("date")).alias("from"), F.when(i == 1, F.lit("1997-01-01").cast("date")).alias("to"), F.array(F.lit("r0"), F.lit("r1"), F.when(n % 2 == 0, "r2").otherwise("r3")).alias("recipients"), F.when(i == 2, F.array(F.lit("study"))).otherwise(F.array(F.lit("study"), F.lit("export"))).alias("purposes"), F.when(n % 5 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("fields"), (i == 0).alias("onward"), F.lit(60).alias("days"), F.when(n % 9 == 0, F.lit("1996-06-01").cast("date")).alias("revoked"))
    return transfers(requests, permissions)


def _fact_rows(spark, d) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    source = F.when(k % 17 > 0, F.concat(F.lit("s"), (k % 5).cast("string")))
    subject, value = F.col("o_custkey").cast("string"), k.cast("string")
    made = F.when(k % 13 == 0, F.concat(F.lit("x-"), value)).otherwise(fact_id(subject, value, source))
    return table(spark, d, "orders").select(made.alias("id"), subject.alias("subject"), value.alias("value"), source.alias("source"), day.alias("from"), F.when(k % 11 == 0, day).when(k % 3 > 0, F.date_add(day, 900)).alias("to"), F.when(k % 7 == 0, F.date_add(day, 9)).otherwise(day).alias("observed"), F.date_add(day, 5).alias("recorded"), "o_custkey", "o_orderkey")


def _facts(spark, d):
    rows = _fact_rows(spark, d)
    return rows.select("id", "o_orderkey").join(fact_faults(rows), "id").select("o_orderkey", "faults")


def _derived(spark, d):
    """An assertion for each customer, from all facts about them."""
    rows, c = _fact_rows(spark, d), F.col("c_custkey")
    inputs = rows.select(F.col("o_custkey").alias("id"), F.col("id").alias("fact")).unionByName(table(spark, d, "customer").filter("c_custkey % 50 = 1").select(c.alias("id"), F.lit("f-none").alias("fact")))
    derived = table(spark, d, "customer").select(c.alias("id"), F.date_add(F.lit("1994-01-01").cast("date"), (c % 1800).cast("int")).alias("from"), F.when(c % 4 > 0, F.date_add(F.lit("1994-03-01").cast("date"), (c % 1800).cast("int"))).alias("to"), F.date_add(F.lit("1998-01-01").cast("date"), (c % 400).cast("int")).alias("recorded"))
    return derived_faults(derived, inputs, rows)


def _cases(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    events = o.select(F.col("o_custkey").alias("case"), k.alias("event"), F.when(k % 3 == 0, "opened").when(k % 3 == 1, "stayed").otherwise("closed").alias("type"), F.trunc("o_orderdate", "month").alias("day"), F.when(k % 8 == 0, k + 8).alias("resolves"))
    return case_states(table(spark, d, "customer").select(F.col("c_custkey").alias("case")), events, "1997-06-30")


def _parcels(spark, d):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    parcels = table(spark, d, "orders").select(F.concat(F.when(k % 19 == 0, "wa-").otherwise("WA-"), k.cast("string")).alias("parcel"), day.alias("day"), k.alias("k"))
    layers = parcels.filter("k % 10 != 4").select("parcel", F.explode(F.array(F.col("k") % 27, (F.col("k") + 7) % 25)).alias("j"), "day", "k").select("parcel", F.concat(F.lit("n"), F.col("j").cast("string")).alias("jurisdiction"), F.when(F.col("k") % 6 > 0, "https://a.org").alias("url"), F.date_add("day", F.when(F.col("k") % 14 == 0, 1).otherwise(-1)).alias("evidence_day"))
    n = F.col("n_nationkey")
    registry = table(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("jurisdiction"), F.when(n % 5 == 0, F.lit("1994-01-01").cast("date")).alias("from"), F.when(n % 5 == 1, F.lit("1996-01-01").cast("date")).alias("to"))
    return parcel_faults(parcels.drop("k"), layers, registry)


def _sql_faults(tests: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {bad} then '{name}' end" for name, bad in tests.items()) + ")"


QUERIES = {
    "review_enrichment": (_enriched, f"""
with l as (select l_orderkey as k, l_linenumber as n, min(l_shipdate)::date as shipped from lineitem group by all),
s as (select o_orderkey as k, o_orderdate::date + 400 as reviewed, unnest([1, 2]) as i from orders),
j as (select s.*, l.shipped, case when l.n is null or s.k % 7 = 0 then 0 when s.k % 10 = 0 and s.k % 20 != 0 then 2 else 1 end as hits from s left join l on l.k = s.k and l.n = s.i),
f as (select k, i, {_sql_faults({"unknown_version": "k % 7 = 0", "out_of_scope": "k % 6 = 0 or k % 3 = 0 and k % 7 = 0", "no_segment": "k % 7 > 0 and hits = 0", "ambiguous_segment": "hits > 1", "digest_differs": "hits = 1 and k % 11 = 0", "review_before_capture": "hits = 1 and reviewed < shipped"})} as faults from j)
select k as item, 'selector ' || i as what, faults as detail from f where faults != ''
union all select k, case when k % 2 = 0 then 'finding' else 'relation' end, string_agg('g' || k || '-' || i, ',' order by i) from f group by k having bool_and(faults = '')"""),
    "transfer_tests": (_transfers, """
with r as (select o_orderkey as k, o_orderkey % 120 + 1 as source, o_orderdate::date as at_ from orders),
p as (select s_suppkey as s, unnest(range(s_suppkey % 3 + 1)) as i from supplier),
b as (
  select k, i is null as none, case when i = 0 and at_ < date '1993-01-01' or i = 1 and at_ >= date '1997-01-01' then 1 else 0 end as t1, case when k % 5 in (0, 1) or k % 5 = 2 and s % 2 = 0 or k % 5 = 3 and s % 2 = 1 then 0 else 1 end as t2,
    case when k % 3 = 0 and i = 2 then 1 else 0 end as t3, case when k % 4 = 0 and s % 5 != 0 then 1 else 0 end as t4, case when k % 7 = 0 and i != 0 then 1 else 0 end as t5, case when k % 100 > 60 then 1 else 0 end as t6, case when s % 9 = 0 and date '1996-06-01' <= at_ then 1 else 0 end as t7
  from r left join p on s = source),
g as (select k, bool_or(none) as none, sum(t1)::int as t1, sum(t2)::int as t2, sum(t3)::int as t3, sum(t4)::int as t4, sum(t5)::int as t5, sum(t6)::int as t6, sum(t7)::int as t7 from b group by k),
t as (select k, case when none then 'no_permission' else concat_ws(',', case when t1 > 0 then 'not_active:' || t1 end, case when t2 > 0 then 'recipient:' || t2 end, case when t3 > 0 then 'purpose:' || t3 end, case when t4 > 0 then 'fields:' || t4 end, case when t5 > 0 then 'onward_sharing:' || t5 end, case when t6 > 0 then 'retention:' || t6 end, case when t7 > 0 then 'revoked:' || t7 end) end as denials from g)
select k as request, denials = '' as allowed, denials from t"""),
    "fact_faults": (_facts, f"""
select o_orderkey, {_sql_faults({"id_differs": "o_orderkey % 13 = 0", "no_source": "o_orderkey % 17 = 0", "interval_inverted": "o_orderkey % 11 = 0", "observed_after_recorded": "o_orderkey % 7 = 0"})} as faults from orders"""),
    "derived_faults": (_derived, f"""
with f as (select o_custkey as c, o_orderdate::date as a, case when o_orderkey % 11 = 0 then o_orderdate::date when o_orderkey % 3 > 0 then o_orderdate::date + 900 end as b, o_orderdate::date + 5 as r, o_orderkey % 13 = 0 or o_orderkey % 17 = 0 or o_orderkey % 11 = 0 or o_orderkey % 7 = 0 as bad from orders),
g as (select c, bool_or(bad) as bad, max(a) as a, min(b) as b, max(r) as r from f group by c),
d as (select c_custkey as k, date '1994-01-01' + (c_custkey % 1800)::int as a, case when c_custkey % 4 > 0 then date '1994-03-01' + (c_custkey % 1800)::int end as b, date '1998-01-01' + (c_custkey % 400)::int as r from customer)
select k as id, {_sql_faults({"no_inputs": "g.c is null and k % 50 != 1", "input_unknown": "k % 50 = 1", "input_broken": "g.bad", "derived_before_input": "d.r < g.r", "outside_inputs": "d.a < g.a or d.b > g.b or d.b is null and g.b is not null"})} as faults from d left join g on g.c = k"""),
    "case_states": (_cases, """
with e as (select o_custkey as c, o_orderkey as k, ['opened', 'stayed', 'closed'][o_orderkey % 3 + 1] as type, date_trunc('month', o_orderdate)::date as day from orders where date_trunc('month', o_orderdate)::date <= date '1997-06-30'),
l as (select * from e where k % 8 != 0 and not exists (select 1 from e u where u.k % 8 = 0 and u.c = e.c and u.k + 8 = e.k)),
t as (select * from l qualify day = max(day) over (partition by c)),
g as (select c, count(distinct type) as n, min(type) as type, min(day) as since, min(k) as k from t group by c)
select c_custkey as case, case when n is null then 'unknown' when n > 1 then 'ambiguous' else type end as state, since, case when n = 1 then k end as event from customer left join g on c = c_custkey"""),
    "parcel_faults": (_parcels, f"""
with p as (select o_orderkey as k, o_orderdate::date as day from orders), l as (select k, day, unnest([k % 27, (k + 7) % 25]) as j from p where k % 10 != 4),
g as (select k, bool_or(j > 24) as unknown, bool_or(j <= 24 and (j % 5 = 0 and day < date '1994-01-01' or j % 5 = 1 and day >= date '1996-01-01')) as past from l group by k)
select case when k % 19 = 0 then 'wa-' else 'WA-' end || k as parcel, {_sql_faults({"id_malformed": "k % 19 = 0", "no_layers": "k % 10 = 4", "layer_unknown": "unknown", "layer_not_valid": "past", "evidence_missing": "k % 10 != 4 and k % 6 = 0", "evidence_after_parcel": "k % 10 != 4 and k % 14 = 0"})} as faults from p left join g using (k)"""),
}
