"""Faceted record queries, joins of records with areas and rules, and listing merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.session import table


def facet_filter(rows: DataFrame, facets: dict[str, list], contains: tuple[str, str] | None = None, between: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """Rows that match every facet (an empty list is no filter), a substring and a day range; null dates fail a range."""
    for name, values in facets.items():
        if values:
            rows = rows.filter(F.col(name).isin(values))
    if contains:
        rows = rows.filter(F.lower(contains[0]).contains(contains[1].lower()))
    if between:
        day = F.date_format(between[0], "yyyy-MM-dd")
        if between[1]:
            rows = rows.filter(day >= between[1])
        if between[2]:
            rows = rows.filter(day <= between[2])
    return rows


def facet_values(rows: DataFrame, names: list[str]) -> DataFrame:
    """facet, value, n: distinct values of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))
    return rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def first_date(*columns: str) -> Column:
    """The first date that is known."""
    return F.coalesce(*columns)


def why_shown(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that holds."""
    out = None
    for test, name in tests:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def union_match(rows: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key, basis: rows that any layer matches, with all layers that do; never their intersection."""
    all_ = None
    for name, part in rows:
        part = part.select(key, F.lit(name).alias("layer"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("layer")), ",").alias("basis"))


def merge_listings(rows: DataFrame) -> DataFrame:
    """One row for each document that several sources list.

    rows: listing, source, precedence, rank, match (null: never merged). A listing counts once, at
    its first place; documents stand in the order of their first listing (rank, then precedence);
    the listing of the best source is the primary one, the others are alternates.
    """
    first = Window.partitionBy("listing").orderBy("rank", "precedence")
    once = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    once = once.withColumn("document", F.coalesce(F.concat(F.lit("match:"), "match"), F.concat(F.lit("listing:"), "listing")))
    return once.groupBy("document").agg(
        F.min(F.struct("rank", "precedence", "listing")).alias("place"),
        F.min(F.struct("precedence", "rank", "listing")).alias("best"),
        (F.count("*") - 1).alias("alternates"),
    ).select("document", F.col("place.rank").alias("rank"), F.col("best.listing").alias("primary"), "alternates")


def text_key(text: str) -> Column:
    """A hash of the whole normalised text (lower case, white space as single blanks), of any length; null for null."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def passages_within(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id: documents that hold an item's whole text, of any length; a row for each such row of ``docs``.

    A word of the item with white space on both sides is a word of the document too, so the longest
    one finds the candidates; words move without the texts. Items without such a word are found by
    their first characters (up to three) among those of the documents.
    """
    inner = F.transform(F.regexp_extract_all("text", F.lit(r"(?<=\s)\S+(?=\s)"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    keys = items.select("item_id", F.col("text").alias("passage"), F.array_max(inner)["w"].alias("word")).filter("length(passage) > 0").distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("word"))
    found = words.join(keys.filter("word is not null").select("item_id", "word"), "word").select("item_id", "doc_id")
    short = keys.filter("word is null")
    if not short.isEmpty():
        starts = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, n))))
        grams = docs.filter("length(text) > 0").select("doc_id", F.explode(F.array_distinct(starts)).alias("gram"))
        found = found.unionByName(grams.join(short.select("item_id", F.substring("passage", 1, 3).alias("gram")), "gram").select("item_id", "doc_id"))
    pairs = found.distinct().join(keys.select("item_id", "passage"), "item_id")
    return docs.select("doc_id", "text").join(pairs, "doc_id").filter("contains(text, passage)").select("item_id", "doc_id")


def group_places(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key with the number of its places."""
    return rows.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("places"))


def unique_changes(left: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """text, change: texts that stand on one side only, once there (removed or added), or once on both (kept)."""
    a = left.groupBy(text).agg(F.count("*").alias("na"))
    b = right.groupBy(text).agg(F.count("*").alias("nb"))
    both = a.join(b, text, "full").fillna(0, ["na", "nb"]).filter("na <= 1 and nb <= 1")
    return both.select(text, F.when(F.col("nb") == 0, "removed").when(F.col("na") == 0, "added").otherwise("kept").alias("change"))


def dimension_pivot(rows: DataFrame, key: str, dimension: str, value: str, dimensions: list[str]) -> DataFrame:
    """key, dimension, state, values: every dimension of every key, coded or not_coded_unknown."""
    coded = rows.groupBy(key, dimension).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"))
    every = rows.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, dimensions))).alias(dimension))
    out = every.join(coded, [key, dimension], "left")
    return out.select(key, dimension, F.when(F.col("values").isNull(), "not_coded_unknown").otherwise("coded").alias("state"), F.coalesce("values", F.lit("")).alias("values"))


def universal(rows: DataFrame, key: str, test: Column) -> DataFrame:
    """key, holds: whether all rows of a key pass."""
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(test, F.lit(False))).alias("holds"))


# --- queries --------------------------------------------------------------------------------------


def _filter(spark, d):
    rows = facet_filter(table(spark, d, "orders"), {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, between=("o_orderdate", "1995-01-01", "1996-12-31"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _facets(spark, d):
    return facet_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def _coalesced(spark, d):
    o = table(spark, d, "orders")
    known = lambda k, days: F.when(F.col("o_orderkey") % k == 0, F.date_add("o_orderdate", days))
    rows = o.withColumns({"decided": known(5, 40), "updated": known(3, 20), "published": F.to_date("o_orderdate")})
    return rows.select("o_orderkey", F.date_format(first_date("decided", "updated", "published"), "yyyy-MM-dd").alias("event_date"))


def _why(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", why_shown((F.col("c_nationkey") == 7, "association"), (F.col("c_mktsegment") == "BUILDING", "landmark"), (F.col("c_acctbal") > 5000, "relevance")).alias("why"))


def _layers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    in_region = c.join(n.filter("r_name = 'ASIA'"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return union_match([("region", in_region), ("nation", c.filter("c_nationkey in (3, 8)")), ("segment", c.filter("c_mktsegment = 'MACHINERY'")), ("rich", c.filter("c_acctbal > 9000"))], "c_custkey")


def _subjects(spark, d):
    rules = spark.createDataFrame([("BUILDING", "housing"), ("BUILDING", "land"), ("MACHINERY", "industry"), ("HOUSEHOLD", "housing")], "label string, topic string")
    c = table(spark, d, "customer")
    return c.join(rules, c["c_mktsegment"] == rules["label"]).select("c_custkey", "topic").distinct()


def _unclassified(spark, d):
    rules = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("HOUSEHOLD",)], "label string")
    c = table(spark, d, "customer")
    return c.join(rules, c["c_mktsegment"] == rules["label"], "left_anti").select("c_custkey", "c_mktsegment")


def _merge(spark, d):
    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = docs.select(F.col("doc_id").cast("string").alias("listing"), "source", F.substring("source", 4, 9).cast("int").alias("precedence"), rank.alias("rank"), text_key("text").alias("match"))
    return merge_listings(rows)


def _places(spark, d):
    return group_places(passages_within(table(spark, d, "documents"), table(spark, d, "benchmark")), ["item_id"], "doc_id")


def _diff(spark, d):
    c = table(spark, d, "conversations")
    return unique_changes(c.filter("conv_id % 2 = 0").select("text"), c.filter("conv_id % 2 = 1").select("text"), "text").select(F.md5("text").alias("text"), "change")


def _pivot(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return dimension_pivot(e, "user_id", "event_type", "k", ["click", "view", "purchase", "refund"])


def _evidence(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").select("o_orderkey", (F.col("l_orderkey").isNull() | (F.col("l_shipdate") <= F.lit("1997-01-01").cast("timestamp"))).alias("ok"))
    return universal(rows, "o_orderkey", F.col("ok"))


def _scalars(spark, d):
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", T.squash(F.col("c_name")).alias("squashed"), T.formula_safe(F.concat(F.when(F.col("c_custkey") % 3 == 0, "=").otherwise(""), "c_name")).alias("cell"), T.base64url(F.col("c_name")).alias("token"), T.public_message(F.concat(F.lit("see https://x.org/a?b=1 "), "c_name")).alias("message"), T.byte_slice(F.col("c_name"), F.lit(2), F.lit(6)).alias("slice"))


QUERIES = {
    "facet_filter_sort": (_filter, "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('O', 'F') and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate::date between '1995-01-01' and '1996-12-31'"),
    "facet_values": (_facets, "select 'o_orderstatus' as facet, o_orderstatus as value, count(*) as n from orders group by all union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by all"),
    "event_date_coalesce": (_coalesced, "select o_orderkey, strftime(coalesce(case when o_orderkey % 5 = 0 then o_orderdate::date + 40 end, case when o_orderkey % 3 = 0 then o_orderdate::date + 20 end, o_orderdate::date), '%Y-%m-%d') as event_date from orders"),
    "why_shown": (_why, "select c_custkey, case when c_nationkey = 7 then 'association' when c_mktsegment = 'BUILDING' then 'landmark' when c_acctbal > 5000 then 'relevance' else 'general' end as why from customer"),
    "layer_union_match": (_layers, """
with m as (select c_custkey, 'region' as layer from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'
  union select c_custkey, 'nation' from customer where c_nationkey in (3, 8) union select c_custkey, 'segment' from customer where c_mktsegment = 'MACHINERY' union select c_custkey, 'rich' from customer where c_acctbal > 9000)
select c_custkey, string_agg(layer, ',' order by layer) as basis from m group by c_custkey"""),
    "subject_mapping": (_subjects, "select distinct c_custkey, topic from customer join (values ('BUILDING', 'housing'), ('BUILDING', 'land'), ('MACHINERY', 'industry'), ('HOUSEHOLD', 'housing')) r(label, topic) on c_mktsegment = label"),
    "unclassified_anti": (_unclassified, "select c_custkey, c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"),
    "rank_interleave_merge": (_merge, """
with r as (select doc_id::varchar as listing, source[4:]::int as precedence, row_number() over (partition by source order by doc_id)::int as rank, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as m from documents),
k as (select *, coalesce('match:' || m, 'listing:' || listing) as document from r)
select document, min(rank) as rank, (min(struct_pack(a := precedence, b := rank, c := listing))).c as primary, count(*) - 1 as alternates from k group by document"""),
    "in_text_group_places": (_places, "select item_id, min(doc_id) as first, count(*) as places from documents d join (select distinct item_id, text from benchmark where length(text) > 0) b on contains(d.text, b.text) group by item_id"),
    "version_diff_unique_text": (_diff, """
with a as (select text, count(*) as na from conversations where conv_id % 2 = 0 group by text), b as (select text, count(*) as nb from conversations where conv_id % 2 = 1 group by text)
select md5(text) as text, case when nb is null then 'removed' when na is null then 'added' else 'kept' end as change from a full join b using (text) where coalesce(na, 0) <= 1 and coalesce(nb, 0) <= 1"""),
    "dimension_pivot": (_pivot, """
with e as (select user_id, event_type, json_extract_string(props, '$.k') as k from events),
c as (select user_id, event_type, string_agg(distinct k, ',' order by k) as v from e group by all),
x as (select user_id, unnest(['click', 'view', 'purchase', 'refund']) as event_type from (select distinct user_id from e))
select user_id, event_type, case when v is null then 'not_coded_unknown' else 'coded' end as state, coalesce(v, '') as values from x left join c using (user_id, event_type)"""),
    "universal_evidence_join": (_evidence, "select o_orderkey, bool_and(l_orderkey is null or l_shipdate <= timestamp '1997-01-01') as holds from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey"),
    "scalar_text_functions": (_scalars, r"""
select c_custkey, array_to_string(regexp_extract_all(lower(c_name), '[\p{L}\p{N}]+'), '') as squashed, case when c_custkey % 3 = 0 then '''=' || c_name else c_name end as cell,
 rtrim(translate(base64(encode(c_name)), '+/', '-_'), '=') as token, 'see [source] ' || c_name as message, c_name[3:6] as slice from customer"""),
}
