"""Policies over records, their evidence of jurisdiction, and collections of nations: a row for each rule that is broken.

Every rule is tried, none stops the others. Rules about one row are conditions; rules about evidence are
joins with the tables that hold it. A value that a rule needs and that is missing breaks the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.guards import names_state, safe_url
from parchmint.session import table

#: Rules in the order in which they are told.
RECORD_RULES = ("id_unstable", "source_unknown", "source_disabled", "adapter_missing", "adapter_differs", "url_unsafe", "host_foreign", "term_unknown", "term_repeated", "nation_unknown", "nation_unattested")
EVIDENCE_RULES = ("evidence_unreviewed", "quote_not_in_source", "evidence_url_foreign", "nation_unattributed", "issuer_differs", "review_out_of_history")
COLLECTION_RULES = ("version_not_semantic", "baseline_after_collection", "review_after_collection", "check_before_retrieval", "synthetic_differs", "baseline_url_unsafe", "count_differs")
NATION_RULES = ("name_not_canonical", "name_repeated", "alias_is_another_name", "state_without_evidence", "evidence_url_unsafe")


def _told(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: rules whose condition does not hold; null doesn't."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def squashed(name: Column) -> Column:
    """What makes names the same: letters and digits in lower case, white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}\s]", "")), r"\s+", " "))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https://([^/?#]+)", 1))


def record_breaches(records: DataFrame, sources: DataFrame, terms: DataFrame, memberships: DataFrame, nations: DataFrame, associations: DataFrame) -> DataFrame:
    """record, rule: what records break of RECORD_RULES.

    records: record, source, adapter, adapter_version, url. sources: source, enabled, adapter,
    adapter_version, hosts (array). terms: term. memberships: record, term. nations: nation.
    associations: record, nation, evidence.
    """
    known = sources.select("source", "enabled", F.col("adapter").alias("s_adapter"), F.col("adapter_version").alias("s_version"), "hosts", F.lit(True).alias("known"))
    rows = records.join(known, "source", "left")
    there = F.col("known").isNotNull()
    rules = {
        "id_unstable": F.col("record").rlike("^[a-z0-9]+(?:[:._-][a-z0-9]+)*$"),
        "source_unknown": there,
        "source_disabled": ~there | F.col("enabled"),
        "adapter_missing": ~there | F.col("s_adapter").isNotNull(),
        "adapter_differs": ~there | F.col("s_adapter").isNull() | (F.col("adapter").eqNullSafe(F.col("s_adapter")) & F.col("adapter_version").eqNullSafe(F.col("s_version"))),
        "url_unsafe": safe_url(F.col("url")),
        "host_foreign": ~there | ~safe_url(F.col("url")) | F.array_contains("hosts", host(F.col("url"))),
    }
    own = _told(rows, "record", rules)
    member = memberships.groupBy("record", "term").agg(F.count("*").alias("n")).join(terms.select("term", F.lit(True).alias("known")).distinct(), "term", "left")
    of_terms = _told(member, "record", {"term_unknown": F.col("known"), "term_repeated": F.col("n") == 1})
    linked = associations.join(nations.select("nation", F.lit(True).alias("known")).distinct(), "nation", "left")
    of_nations = _told(linked, "record", {"nation_unknown": F.col("known"), "nation_unattested": F.trim("evidence") != ""})
    return own.unionByName(of_terms).unionByName(of_nations).distinct()


def evidence_breaches(claims: DataFrame, records: DataFrame, sources: DataFrame, associations: DataFrame) -> DataFrame:
    """record, rule: what statements of a record's jurisdiction break of EVIDENCE_RULES.

    claims: record, jurisdiction, basis, quote, url, state, reviewed. records: record, source, texts and urls
    (arrays), retrieved, validated. sources: source, jurisdiction, basis, state. associations: record,
    nation, evidence. A statement about a nation needs an association of its own that holds the quotation;
    an issuing authority needs a source that is reviewed for the same one.
    """
    stated = sources.select("source", F.col("jurisdiction").alias("s_jurisdiction"), F.col("basis").alias("s_basis"), F.col("state").alias("s_state"))
    rows = claims.join(records, "record").join(stated, "source", "left")
    nation = F.col("jurisdiction").startswith("nation:")
    held = claims.filter(nation).select("record", "jurisdiction", "quote").join(associations, "record").filter((F.col("nation") == F.col("jurisdiction")) & F.contains("evidence", "quote"))
    rows = rows.join(held.select("record", "jurisdiction", F.lit(True).alias("attributed")).distinct(), ["record", "jurisdiction"], "left")
    issuer = (F.col("s_basis") == "issuing_authority") & (F.col("s_state") == "reviewed") & (F.col("s_jurisdiction") == F.col("jurisdiction"))
    rules = {
        "evidence_unreviewed": F.col("state") == "reviewed",
        "quote_not_in_source": (F.length("quote") > 0) & F.exists("texts", lambda t: F.contains(t, F.col("quote"))),
        "evidence_url_foreign": F.array_contains("urls", F.col("url")),
        "nation_unattributed": ~nation | F.col("attributed").isNotNull(),
        "issuer_differs": (F.col("basis") != "issuing_authority") | F.coalesce(issuer, F.lit(False)),
        "review_out_of_history": F.col("reviewed").between(F.col("retrieved"), F.col("validated")),
    }
    return _told(rows, "record", rules).distinct()


def collection_breaches(collections: DataFrame, nations: DataFrame) -> DataFrame:
    """collection, rule: what collections of nations break of COLLECTION_RULES.

    collections: collection, version, generated, published (of the baseline), reviewed, retrieved, checked,
    synthetic, baseline_synthetic, baseline_url, count. nations: collection.
    """
    counted = nations.groupBy("collection").agg(F.count("*").alias("n"))
    rows = collections.join(counted, "collection", "left")
    rules = {
        "version_not_semantic": F.col("version").rlike(r"^(?:0|[1-9]\d*)(?:\.(?:0|[1-9]\d*)){2}$"),
        "baseline_after_collection": F.col("published") <= F.col("generated"),
        "review_after_collection": F.col("reviewed") <= F.col("generated"),
        "check_before_retrieval": F.col("retrieved") <= F.col("checked"),
        "synthetic_differs": F.col("synthetic") == F.col("baseline_synthetic"),
        "baseline_url_unsafe": safe_url(F.col("baseline_url")),
        "count_differs": F.coalesce("n", F.lit(0)) == F.col("count"),
    }
    return _told(rows, "collection", rules)


def nation_breaches(nations: DataFrame, aliases: DataFrame, evidence: DataFrame) -> DataFrame:
    """collection, nation, rule: what nations of collections break of NATION_RULES.

    nations: collection, nation, name. aliases: collection, nation, alias. evidence: collection, nation, state
    (that is claimed), text, url: the text must name the state as a whole word.
    """
    key = ["collection", "nation"]
    names = nations.select(*key, "name", squashed(F.col("name")).alias("same"))
    counted = names.groupBy("collection", "same").agg(F.count("*").alias("n"), F.min("nation").alias("owner"))
    one = names.join(counted, ["collection", "same"]).select(F.struct(*key).alias("key"), "name", "n")
    own = _told(one, "key", {"name_not_canonical": (F.col("name") == F.trim(F.regexp_replace("name", r"\s+", " "))) & (F.length("name") > 0), "name_repeated": F.col("n") == 1})
    said = aliases.select(*key, squashed(F.col("alias")).alias("same")).join(counted.select("collection", "same", "owner", "n"), ["collection", "same"], "left")
    shadow = _told(said.select(F.struct(*key).alias("key"), "owner", "nation", "n"), "key", {"alias_is_another_name": F.col("owner").isNull() | ((F.col("owner") == F.col("nation")) & (F.col("n") == 1))})
    states = [r[0] for r in evidence.select("state").distinct().collect() if r[0]]  # a closed list of names
    proofs = evidence.select(F.struct(*key).alias("key"), F.array_contains(names_state(F.col("text"), states), F.col("state")).alias("names"), "url") if states else evidence.select(F.struct(*key).alias("key"), F.lit(False).alias("names"), "url")
    of_states = _told(proofs, "key", {"state_without_evidence": F.col("names"), "evidence_url_unsafe": safe_url(F.col("url"))})
    return own.unionByName(shadow).unionByName(of_states).distinct().select("key.*", "rule")


# --- queries: each rule is broken by some rows ------------------------------------------------------


def _record(k) -> Column:
    return F.concat(F.when(k % 31 == 0, "Order ").otherwise("order:"), k.cast("string"))


def _sources(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    host_ = F.concat(F.lit("s"), k.cast("string"), F.lit(".org"))
    return table(spark, d, "supplier").select(k.alias("source"), (k % 10 != 3).alias("enabled"), F.when(k % 8 != 5, F.concat(F.lit("a"), (k % 4).cast("string"))).alias("adapter"), F.lit("1.0.0").alias("adapter_version"), F.array(host_).alias("hosts"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("jurisdiction"), F.when(k % 3 > 0, "issuing_authority").otherwise("subject").alias("basis"), F.when(k % 7 > 0, "reviewed").otherwise("proposed").alias("state"))


def _with_source(spark, d) -> DataFrame:
    """Orders with a source of theirs: suppliers by number, and one that is not there."""
    n = table(spark, d, "supplier").count()
    return table(spark, d, "orders").withColumn("s", F.col("o_orderkey") % (n + 1) + 1)


def _record_breaches(spark, d):
    k, s = F.col("o_orderkey"), F.col("s")
    o = _with_source(spark, d)
    url = F.concat(F.when(k % 17 == 0, "http://s").otherwise("https://s"), F.when(k % 19 == 0, s + 1).otherwise(s).cast("string"), F.lit(".org/x"))
    records = o.select(_record(k).alias("record"), s.alias("source"), F.concat(F.lit("a"), (s % 4).cast("string")).alias("adapter"), F.when(k % 23 == 0, "1.0.1").otherwise("1.0.0").alias("adapter_version"), url.alias("url"))
    terms = table(spark, d, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("term"))
    member = o.select(_record(k).alias("record"), F.explode(F.when(k % 13 == 0, F.array(F.lit("t1"), F.lit("t1"))).otherwise(F.array(F.concat(F.lit("t"), (k % 6).cast("string"))))).alias("term"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))
    linked = o.filter("o_orderkey % 4 = 0").select(_record(k).alias("record"), (k % 27).alias("nation"), F.when(k % 9 == 0, " ").otherwise("named").alias("evidence"))
    return record_breaches(records, _sources(spark, d), terms, member, nations, linked)


def _evidence_breaches(spark, d):
    k, s = F.col("o_orderkey"), F.col("s")
    o = _with_source(spark, d)
    day = F.col("o_orderdate").cast("date")
    quote = F.concat(F.lit("held by "), (k % 25).cast("string"))
    records = o.select(_record(k).alias("record"), s.alias("source"), F.array(F.lit("a title"), F.when(k % 7 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("land "), quote, F.lit(".")))).alias("texts"), F.array(F.lit("https://a.org/1"), F.lit("https://a.org/2")).alias("urls"), day.alias("retrieved"), F.date_add(day, 30).alias("validated"))
    nation = F.when(k % 3 == 0, F.concat(F.lit("nation:"), (k % 25).cast("string"))).otherwise("state:OR")
    claims = o.select(_record(k).alias("record"), nation.alias("jurisdiction"), F.when(k % 5 == 0, "issuing_authority").otherwise("subject").alias("basis"), quote.alias("quote"), F.when(k % 11 == 0, "https://b.org/").otherwise("https://a.org/2").alias("url"), F.when(k % 8 == 0, "proposed").otherwise("reviewed").alias("state"), F.date_add(day, (k % 40 - 3).cast("int")).alias("reviewed"))
    linked = o.filter("o_orderkey % 2 = 0").select(_record(k).alias("record"), F.concat(F.lit("nation:"), (k % 25).cast("string")).alias("nation"), F.when(k % 10 == 0, F.lit("no such words")).otherwise(F.concat(F.lit("they say "), quote)).alias("evidence"))
    return evidence_breaches(claims, records, _sources(spark, d), linked)


def _collections(spark, d) -> DataFrame:
    k, day = F.col("s_suppkey"), F.lit("2024-06-01").cast("date")
    return table(spark, d, "supplier").select(k.alias("collection"), F.when(k % 9 == 0, "1.0").otherwise("1.0.0").alias("version"), day.alias("generated"), F.date_add(day, F.when(k % 7 == 0, 1).otherwise(-9)).alias("published"), F.date_add(day, F.when(k % 11 == 0, 2).otherwise(0)).alias("reviewed"), day.alias("retrieved"), F.date_add(day, F.when(k % 5 == 0, -1).otherwise(1)).alias("checked"), F.lit(True).alias("synthetic"), (k % 6 > 0).alias("baseline_synthetic"), F.when(k % 4 == 0, "https://u@a.org").otherwise("https://a.org").alias("baseline_url"), F.when(k % 3 == 0, 24).otherwise(25).alias("count"))


def _members(spark, d) -> DataFrame:
    """All nations in the collection of each supplier; two of a name where the collection's number says so."""
    c, n = F.col("collection"), F.col("n_nationkey")
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("collection"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    name = F.when((n == 3) & (c % 4 == 0), F.lit("Nation  One")).when((n == 4) & (c % 4 == 0), F.lit("nation one")).otherwise(F.col("n_name"))
    return pairs.select("collection", n.alias("nation"), name.alias("name"), F.col("n_name"))


def _collection_breaches(spark, d):
    return collection_breaches(_collections(spark, d), _members(spark, d))


def _nation_breaches(spark, d):
    rows = _members(spark, d)
    c, n = F.col("collection"), F.col("nation")
    aliases = rows.select("collection", "nation", F.when((n == 7) & (c % 5 == 0), F.lit("NATION ONE!")).when(n == 8, F.concat(F.lit("  "), F.upper("n_name"))).otherwise(F.concat(F.lit("People "), n.cast("string"))).alias("alias"))
    text = F.when((n == 9) & (c % 3 == 0), F.lit("in West Virginia")).otherwise(F.lit("in Virginia and Oregon"))
    evidence = rows.select("collection", "nation", F.when(n % 2 == 0, "Oregon").otherwise("Virginia").alias("state"), text.alias("text"), F.when((n == 2) & (c % 2 == 0), "ftp://x").otherwise("https://a.org/e").alias("url"))
    return nation_breaches(rows, aliases, evidence.unionByName(evidence.filter("nation = 1").withColumn("state", F.lit("West Virginia"))))


_RECORD = "case when o_orderkey % 31 = 0 then 'Order ' else 'order:' end || o_orderkey"
QUERIES = {
    "record_breaches": (_record_breaches, f"""
with o as (select *, {_RECORD} as record, o_orderkey as k, o_orderkey % ((select count(*) from supplier) + 1) + 1 as s from orders),
x as (select *, s_suppkey is not null as there, k % 17 = 0 as unsafe from o left join supplier on s_suppkey = s)
select record, 'id_unstable' as rule from x where k % 31 = 0 union all select record, 'source_unknown' from x where not there union all select record, 'source_disabled' from x where there and s % 10 = 3
union all select record, 'adapter_missing' from x where there and s % 8 = 5 union all select record, 'adapter_differs' from x where there and s % 8 != 5 and k % 23 = 0
union all select record, 'url_unsafe' from x where unsafe union all select record, 'host_foreign' from x where there and not unsafe and k % 19 = 0
union all select record, 'term_unknown' from x where k % 13 != 0 and k % 6 = 5 union all select record, 'term_repeated' from x where k % 13 = 0
union all select record, 'nation_unknown' from x where k % 4 = 0 and k % 27 > 24 union all select record, 'nation_unattested' from x where k % 4 = 0 and k % 9 = 0"""),
    "evidence_breaches": (_evidence_breaches, f"""
with o as (select *, {_RECORD} as record, o_orderkey as k, o_orderkey % ((select count(*) from supplier) + 1) + 1 as s from orders),
x as (select *, case when k % 3 = 0 then 'nation:' || k % 25 else 'state:OR' end as j from o left join supplier on s_suppkey = s)
select record, 'evidence_unreviewed' as rule from x where k % 8 = 0 union all select record, 'quote_not_in_source' from x where k % 7 = 0 union all select record, 'evidence_url_foreign' from x where k % 11 = 0
union all select record, 'nation_unattributed' from x where k % 3 = 0 and (k % 2 = 1 or k % 10 = 0)
union all select record, 'issuer_differs' from x where k % 5 = 0 and not coalesce(s % 3 > 0 and s % 7 > 0 and 'nation:' || s_nationkey = j, false)
union all select record, 'review_out_of_history' from x where k % 40 < 3 or k % 40 > 33"""),
    "collection_breaches": (_collection_breaches, """
select s_suppkey as collection, unnest(list_filter([case when s_suppkey % 9 = 0 then 'version_not_semantic' end, case when s_suppkey % 7 = 0 then 'baseline_after_collection' end, case when s_suppkey % 11 = 0 then 'review_after_collection' end,
  case when s_suppkey % 5 = 0 then 'check_before_retrieval' end, case when s_suppkey % 6 = 0 then 'synthetic_differs' end, case when s_suppkey % 4 = 0 then 'baseline_url_unsafe' end, case when s_suppkey % 3 = 0 then 'count_differs' end], lambda x: x is not null)) as rule from supplier"""),
    "nation_breaches": (_nation_breaches, """
with c as (select s_suppkey as c from supplier)
select c as collection, 3 as nation, 'name_not_canonical' as rule from c where c % 4 = 0 union all select c, 3, 'name_repeated' from c where c % 4 = 0 union all select c, 4, 'name_repeated' from c where c % 4 = 0
union all select c, 7, 'alias_is_another_name' from c where c % 5 = 0 and c % 4 = 0 union all select c, 9, 'state_without_evidence' from c where c % 3 = 0 union all select c, 1, 'state_without_evidence' from c
union all select c, 2, 'evidence_url_unsafe' from c where c % 2 = 0"""),
}
