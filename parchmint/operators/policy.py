"""Predicates and projections over policy records, catalogs of sources, and access to both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import table

#: Ranks of visibility and sensitivity, lowest first (fixed values).
VISIBILITY = ("public", "community", "internal", "restricted")
SENSITIVITY = ("none", "low", "moderate", "high")


def in_area(memberships: Column, category: str, subcategories: list[str]) -> Column:
    """Whether a record belongs to a category; with subcategories chosen, to one of them. memberships: array<struct<category, subcategory>>."""
    fits = lambda m: (m["category"] == category) & (m["subcategory"].isin(subcategories) if subcategories else F.lit(True))
    return F.coalesce(F.exists(memberships, fits), F.lit(False))


def available(level: Column, states: Column, associations: Column, nation: Column, covered: Column) -> Column:
    """Whether a record is shown to a nation.

    Federal records always are; state records if the nation's coverage names their state; county and
    tribal ones only by an association that isn't rejected, as is everything else.
    """
    named = F.exists(associations, lambda a: (a["nation"] == nation) & (a["state"] != "rejected"))
    return F.coalesce(F.when(level == "federal", True).when(level == "state", F.array_contains(covered, states) | named).otherwise(named), F.lit(False))


def scoped(rows: DataFrame, facets: dict[str, str | None], reviewed: tuple[str, str] | None = None) -> DataFrame:
    """Rows within a search's facets (null: not asked for), and with a reviewed reference (column, value) if one is asked for."""
    for name, value in facets.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if reviewed:
        column, value = reviewed
        rows = rows.filter(F.exists(column, lambda r: (r["ref"] == value) & (r["state"] == "reviewed")))
    return rows


def compact(memberships: Column) -> Column:
    """Distinct "category/subcategory" of a record, sorted."""
    return F.array_sort(F.array_distinct(F.transform(memberships, lambda m: F.concat_ws("/", m["category"], m["subcategory"]))))


def covers(regions: Column, wanted: list[str]) -> Column:
    """Whether a source discovers any of the regions; one for "US" discovers all."""
    return F.array_contains(regions, "US") | F.arrays_overlap(regions, F.array(*map(F.lit, wanted)))


def review_status(reviewed: Column, expires: Column, qualified: Column, at: Column) -> Column:
    """future, unqualified, expired or current, in this order."""
    return F.when(reviewed > at, "future").when(~F.coalesce(qualified, F.lit(False)), "unqualified").when(expires <= at, "expired").otherwise("current")


def states_identifier(kind: str, value: Column, dockets: Column, rins: Column, parts: Column) -> Column:
    """Whether a listing states a docket, a RIN or a CFR part."""
    where = {"docket": dockets, "rin": rins, "cfr": parts}[kind]
    return F.coalesce(F.exists(where, lambda x: F.lower(x) == F.lower(value)), F.lit(False))


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place in an order of names; unknown names rank highest."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def may_read(rows: DataFrame, visibility: str, sensitivity: str) -> DataFrame:
    """Adds readable: whether a request and its clearances reach a row's visibility and sensitivity."""
    test = (rank(F.col("visibility"), VISIBILITY) <= VISIBILITY.index(visibility)) & (rank(F.col("sensitivity"), SENSITIVITY) <= SENSITIVITY.index(sensitivity))
    return rows.withColumn("readable", test)


def gates(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Adds passed (all stages hold) and reasons: the stages that don't, in their order; unknown ones fail."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in stages.items())))
    return rows.withColumn("reasons", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def accepted(low: Column, high: Column, at: Column, required: list[Column]) -> Column:
    """Whether an assertion holds at an instant: within its interval, and all required dates known by then."""
    test = F.coalesce(low <= at, F.lit(True)) & F.coalesce(at < high, F.lit(True))
    for day in required:
        test = test & F.coalesce(day <= at, F.lit(False))
    return test


def sorted_records(rows: DataFrame, by: str, title: str, event: str, updated: str, row_id: str) -> DataFrame:
    """Records by title, by event (earliest first) or by update (latest first); unknown dates count as earliest, ties go by id."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    order = {"title": [F.col(title)], "event": [text(event)], "updated": [text(updated).desc()]}[by]
    return rows.orderBy(*order, row_id)


def placed(rows: DataFrame, by: str, title: str, event: str, updated: str, row_id: str, group: str) -> DataFrame:
    """row_id, place: the place of each row in its group under ``sorted_records``' order."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    order = {"title": [F.col(title)], "event": [text(event)], "updated": [text(updated).desc()]}[by]
    return rows.select(row_id, F.row_number().over(Window.partitionBy(group).orderBy(*order, row_id)).alias("place"))


def timeline(rows: DataFrame, group: str, day: str, row_id: str) -> DataFrame:
    """row_id, place: entries of a group by date, undated ones last, then by id."""
    order = Window.partitionBy(group).orderBy(F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("9999")), row_id)
    return rows.select(row_id, F.row_number().over(order).alias("place"))


def audit_days(rows: DataFrame, group: str, day: str) -> DataFrame:
    """group, day: the first, the median (upper half's first) and the last distinct day of each group."""
    days = rows.select(group, F.to_date(day).alias("day")).filter("day is not null").distinct()
    w = Window.partitionBy(group)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("day"))
    return days.withColumns({"n": n, "k": k}).filter("k = 1 or k = n or k = ceil(n / 2)").select(group, "day")


def section(groups: DataFrame, row: str, group: str, specificity: str) -> DataFrame:
    """row, section: the most specific of the groups that a row is in; ties go by name."""
    return groups.groupBy(row).agg(F.min(F.struct(F.col(specificity).alias("s"), F.col(group).alias("g"))).alias("m")).select(row, F.col("m.g").alias("section"))


def names_contain(names: Column, text: str) -> Column:
    """Whether a name or an alias holds a text, whatever the case."""
    return F.exists(names, lambda n: F.lower(n).contains(text.lower()))


def rejected_keys(schema, protected: set[str], path: str = "") -> list[str]:
    """Paths of a schema's protected keys, at any depth: what must not leave. Works on the schema, not on rows."""
    out = []
    for f in getattr(schema, "fields", ()):
        at = f"{path}.{f.name}" if path else f.name
        kind = f.dataType
        while hasattr(kind, "elementType"):
            kind = kind.elementType
        out += ([at] if f.name.lower() in protected else []) + rejected_keys(kind, protected, at)
    return out


def filled(stated: DataFrame, read: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with fields merged: what was read wins, what was stated fills its gaps."""
    r = read.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return stated.join(r, key, "left").select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


# --- queries --------------------------------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    """Orders as records: memberships, level, state, associations."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    member = lambda a, b: F.struct(F.concat(F.lit("c"), (k % a).cast("string")).alias("category"), F.concat(F.lit("s"), (k % b).cast("string")).alias("subcategory"))
    level = F.element_at(F.array(*map(F.lit, ["federal", "state", "county", "tribal"])), (k % 4 + 1).cast("int"))
    links = F.array(F.struct((k % 25).alias("nation"), F.when(k % 3 == 0, "rejected").otherwise("pending").alias("state")))
    return o.select(k.alias("id"), "o_custkey", "o_orderdate", "o_orderstatus", F.array(member(3, 4), member(5, 2), member(3, 4)).alias("memberships"), level.alias("level"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("state"), links.alias("associations"))


def _area(spark, d):
    rows = _records(spark, d)
    return rows.select("id", in_area(F.col("memberships"), "c1", []).alias("broad"), in_area(F.col("memberships"), "c1", ["s1"]).alias("narrow"), F.array_join(compact(F.col("memberships")), ",").alias("compact"))


def _available(spark, d):
    rows = _records(spark, d)
    return rows.select("id", available(F.col("level"), F.col("state"), F.col("associations"), F.lit(8), F.array(F.lit("S1"), F.lit("S4"))).alias("shown"))


def _scoped(spark, d):
    rows = _records(spark, d).withColumn("refs", F.array(F.struct(F.col("state").alias("ref"), F.when(F.col("id") % 3 == 0, "reviewed").otherwise("proposed").alias("state"))))
    return scoped(rows, {"level": "state", "o_orderstatus": "O", "state": None}, ("refs", "S3")).select("id")


def _catalog(spark, d) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    regions = F.when(k % 9 == 0, F.array(F.lit("US"))).otherwise(F.array(F.concat(F.lit("R"), (k % 4).cast("string")), F.concat(F.lit("R"), (k % 5).cast("string"))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    return s.select("s_suppkey", "s_acctbal", regions.alias("regions"), day.alias("reviewed"), F.when(k % 4 > 0, F.date_add(day, 20)).alias("expires"))


def _regions(spark, d):
    return _catalog(spark, d).filter(covers(F.col("regions"), ["R1", "R7"])).select("s_suppkey")


def _review(spark, d):
    return _catalog(spark, d).select("s_suppkey", review_status(F.col("reviewed"), F.col("expires"), F.col("s_acctbal") > 0, F.lit("2024-02-10").cast("date")).alias("status"))


def _identifiers(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("EPA-"), (k % 50).cast("string"))).alias("dockets"), F.array(F.concat(F.lit("1076-af"), (k % 20).cast("string"))).alias("rins"), F.array(F.concat(F.lit("40 CFR "), (k % 30).cast("string")), F.lit(None).cast("string")).alias("parts"))
    said = lambda kind, v: states_identifier(kind, F.lit(v), F.col("dockets"), F.col("rins"), F.col("parts"))
    return rows.filter(said("docket", "epa-7") | said("rin", "1076-AF5") | said("cfr", "40 CFR 9")).select("o_orderkey")


def _readable(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, (*VISIBILITY, "secret"))), (k % 5 + 1).cast("int")).alias("visibility"), F.element_at(F.array(*map(F.lit, SENSITIVITY)), (k % 4 + 1).cast("int")).alias("sensitivity"))
    return may_read(rows, "internal", "moderate").select("c_custkey", "readable")


def _gates(spark, d):
    o = table(spark, d, "orders")
    stages = {"not_final": F.col("o_orderstatus") == "F", "no_review": F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderkey") % 5 > 0), "too_large": F.col("o_totalprice") < 300_000}
    return gates(o, stages).select("o_orderkey", "reasons", "passed")


def _accepted(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    at = F.lit("1996-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", accepted(F.when(k % 5 > 0, day), F.when(k % 4 > 0, F.date_add(day, 200)), at, [F.when(k % 3 > 0, F.date_sub(day, 10))]).alias("holds"))


def _sorts(spark, d):
    rows = _records(spark, d).withColumn("event", F.when(F.col("id") % 5 > 0, F.col("o_orderdate")))
    by = lambda name: placed(rows, name, "state", "event", "event", "id", "o_custkey").withColumnRenamed("place", name)
    return by("title").join(by("event"), "id").join(by("updated"), "id")


def _timeline(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    return timeline(rows, "user_id", "day", "event_id")


def _audit(spark, d):
    return audit_days(table(spark, d, "orders"), "o_custkey", "o_orderdate").select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _section(spark, d):
    k = F.col("o_orderkey")
    pair = lambda name, n: F.when(k % n == 0, F.struct(F.lit(name).alias("group"), F.lit(-n).alias("depth")))
    rows = table(spark, d, "orders").select("o_orderkey", F.inline(F.array_compact(F.array(pair("all", 1), pair("even", 2), pair("third", 3), pair("sixth", 6)))))
    return section(rows, "o_orderkey", "group", "depth")


def _names(spark, d):
    n = table(spark, d, "nation")
    return n.filter(names_contain(F.array("n_name", F.concat(F.lit("People of "), F.reverse("n_name"))), "an")).select("n_nationkey")


def _filled(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), "c_name")
    read = table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.lower("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("c_name"))
    return filled(c, read, "c_custkey", ["segment", "c_name"])


_RANKED = "case v when 'public' then 0 when 'community' then 1 when 'internal' then 2 when 'restricted' then 3 else 4 end"

QUERIES = {
    "policy_area": (_area, "select o_orderkey as id, o_orderkey % 3 = 1 or o_orderkey % 5 = 1 as broad, (o_orderkey % 3 = 1 and o_orderkey % 4 = 1) or (o_orderkey % 5 = 1 and o_orderkey % 2 = 1) as narrow, array_to_string(list_sort(list_distinct(['c' || o_orderkey % 3 || '/s' || o_orderkey % 4, 'c' || o_orderkey % 5 || '/s' || o_orderkey % 2])), ',') as compact from orders"),
    "nation_availability": (_available, "select o_orderkey as id, case when o_orderkey % 4 = 0 then true when o_orderkey % 4 = 1 then o_orderkey % 7 in (1, 4) or (o_orderkey % 25 = 8 and o_orderkey % 3 != 0) else o_orderkey % 25 = 8 and o_orderkey % 3 != 0 end as shown from orders"),
    "search_scope": (_scoped, "select o_orderkey as id from orders where o_orderkey % 4 = 1 and o_orderstatus = 'O' and o_orderkey % 7 = 3 and o_orderkey % 3 = 0"),
    "source_regions": (_regions, "select s_suppkey from supplier where s_suppkey % 9 = 0 or s_suppkey % 4 = 1 or s_suppkey % 5 = 1"),
    "review_status": (_review, "with c as (select *, date '2024-01-01' + (s_suppkey % 60)::int as r from supplier) select s_suppkey, case when r > date '2024-02-10' then 'future' when not s_acctbal > 0 then 'unqualified' when s_suppkey % 4 > 0 and r + 20 <= date '2024-02-10' then 'expired' else 'current' end as status from c"),
    "stated_identifiers": (_identifiers, "select o_orderkey from orders where o_orderkey % 50 = 7 or o_orderkey % 20 = 5 or o_orderkey % 30 = 9"),
    "access_rank": (_readable, f"with r as (select c_custkey, ['public', 'community', 'internal', 'restricted', 'secret'][1 + c_custkey % 5] as v, c_custkey % 4 as s from customer) select c_custkey, {_RANKED} <= 2 and s <= 2 as readable from r"),
    "lifecycle_gates": (_gates, "with g as (select o_orderkey, concat_ws(',', case when o_orderstatus != 'F' then 'not_final' end, case when o_orderkey % 6 = 0 or o_orderkey % 5 = 0 then 'no_review' end, case when not o_totalprice < 300000 then 'too_large' end) as reasons from orders) select o_orderkey, reasons, reasons = '' as passed from g"),
    "assertion_holds": (_accepted, "select o_orderkey, (o_orderkey % 5 = 0 or o_orderdate::date <= date '1996-01-01') and (o_orderkey % 4 = 0 or date '1996-01-01' < o_orderdate::date + 200) and o_orderkey % 3 > 0 and o_orderdate::date - 10 <= date '1996-01-01' as holds from orders"),
    "record_sorts": (_sorts, """
with r as (select o_orderkey as id, o_custkey, 'S' || o_orderkey % 7 as title, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d') else '' end as day from orders)
select id, row_number() over (partition by o_custkey order by title, id)::int as title, row_number() over (partition by o_custkey order by day, id)::int as event, row_number() over (partition by o_custkey order by day desc, id)::int as updated from r"""),
    "timeline_order": (_timeline, "select event_id, row_number() over (partition by user_id order by case when event_id % 4 > 0 then strftime(ts, '%Y-%m-%d') else '9999' end, event_id)::int as place from events"),
    "audit_days": (_audit, """
with d as (select distinct o_custkey, o_orderdate::date as day from orders), k as (select *, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by day) as k from d)
select o_custkey, strftime(day, '%Y-%m-%d') as day from k where k = 1 or k = n or k = ceil(n / 2.0)"""),
    "row_section": (_section, "select o_orderkey, case when o_orderkey % 6 = 0 then 'sixth' when o_orderkey % 3 = 0 then 'third' when o_orderkey % 2 = 0 then 'even' else 'all' end as section from orders"),
    "nation_names": (_names, "select n_nationkey from nation where contains(lower(n_name), 'an') or contains(lower('People of ' || reverse(n_name)), 'an')"),
    "field_merge": (_filled, "select c_custkey, coalesce(case when c_custkey % 2 = 0 and c_custkey % 5 > 0 then lower(c_mktsegment) end, case when c_custkey % 3 > 0 then c_mktsegment end) as segment, c_name from customer"),
}
