"""Studies over a corpus: projections for audiences, assembly, migration, context, identities and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.operators.graph import reach, shortest_paths
from parchmint.operators.policy import rank
from parchmint.session import materialize, table


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: every rule that a row breaks; a rule that is unknown for a row is broken. One pass, one row a breach."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def readable_rows(rows: DataFrame, passages: DataFrame, sensitivity: int, audience: list[str]) -> DataFrame:
    """Rows (id, passages array) all of whose passages (id, sensitivity, audience) may be read; rows without passages stay."""
    ok = passages.filter((F.col("sensitivity") <= sensitivity) & F.col("audience").isin(audience)).select(F.col("id").alias("p"))
    hidden = rows.select("id", F.explode("passages").alias("p")).join(ok, "p", "left_anti").select("id").distinct()
    return rows.join(hidden, "id", "left_anti")


def inventory_drift(before: DataFrame, after: DataFrame, collected: DataFrame, key: str) -> DataFrame:
    """key, before, after, collected, state: daily counts around a collection; changed ones must be collected again, differing ones are short or over."""
    n = lambda t, name: t.select(key, F.col("n").alias(name))
    c = collected.groupBy(key).agg(F.count("*").alias("collected"))
    rows = n(before, "before").join(n(after, "after"), key, "full").join(c, key, "full").fillna(0, ["before", "after", "collected"])
    state = F.when(F.col("before") != F.col("after"), "retry").when(F.col("collected") < F.col("after"), "short").when(F.col("collected") > F.col("after"), "over").otherwise("whole")
    return rows.withColumn("state", state)


def recognised(lines: DataFrame, text: str, known: DataFrame, name: str) -> DataFrame:
    """name, place, state: entries of a list of names (one a line) against those that are known; either side may lack one."""
    rows = lines.select(F.posexplode(F.split(text, "\n")).alias("place", "raw")).select("place", F.trim(F.regexp_replace("raw", r"\s*\([^)]*\)\s*$", "")).alias(name)).filter(F.col(name) != "")
    first = rows.groupBy(name).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    both = first.join(known.select(name, F.lit(True).alias("__k")), name, "full")
    state = F.when(F.col("place").isNull(), "not_listed").when(F.col("__k").isNull(), "unknown").when(F.col("n") > 1, "repeated").otherwise("reconciled")
    return both.select(name, "place", state.alias("state"))


def is_heading(text: Column) -> Column:
    """Whether a passage opens a section: "Section 4.", "Sec. 2.1", "§ 12", also behind "NEW SECTION"; marks of amendments don't count."""
    plain = F.trim(F.regexp_replace(text, r"\[\[/?(?:INSERTION|DELETION)\]\]", ""))
    return F.coalesce(plain.rlike(r"(?i)^(?:new section\.?\s*)?(?:sec(?:tion)?\.?\s*\d+(?:\.\d+)*[.\s]|§\s*\d)"), F.lit(False))


#: Named character references that occur in notices (fixed values).
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "sect": "§"}


def decoded(text: Column) -> Column:
    """Text without named character references; &amp; last, so that what it escapes stays as it is."""
    out = text
    for name, ch in list(ENTITIES.items())[1:] + [("amp", "&")]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(ch))
    return out


def synopsis(text: Column) -> Column:
    """Lines of a synopsis: markup breaks are line ends, other tags go, empty lines too."""
    broken = F.regexp_replace(F.regexp_replace(text, r"(?i)<(?:br|/p|/li|/div)[^>]*>", "\n"), r"<[^>]+>", "")
    return F.filter(F.transform(F.split(decoded(broken), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def replay_equal(stored: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """key, change: rows of a stored projection that making it again does not give, or gives anew. Empty: equal."""
    columns = sorted(stored.columns)
    said = lambda t: t.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    both = said(stored).withColumnRenamed("h", "__s").join(said(made).withColumnRenamed("h", "__m"), key, "full")
    change = F.when(F.col("__m").isNull(), "gone").when(F.col("__s").isNull(), "fresh").when(F.col("__s") != F.col("__m"), "differs")
    return both.select(key, change.alias("change")).filter("change is not null")


def authorised(registry: DataFrame, stated: DataFrame) -> DataFrame:
    """entry, state: entries against the registry's digests; what went needs an explicit removal."""
    now = registry.select("entry", F.sha2(F.concat_ws("\n", "entry", "body"), 256).alias("__d"))
    rows = stated.join(now, "entry", "full")
    state = F.when(F.col("digest").isNull(), "added").when(F.col("__d").isNull(), F.when(F.col("removed"), "removed").otherwise("missing")).when(F.col("digest") == F.col("__d"), "same").otherwise("changed")
    return rows.select("entry", state.alias("state"))


#: Hexadecimal digits of a name's hash by which runs of words are picked before the join, and the most such beginnings that the driver holds.
DIGITS, BEGINNINGS = 5, 10_000


def known_names(texts: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """id, name_hash: texts that hold a name of at most ``words`` words, found by the hashes of their word runs alone.

    names carries hashes only (name_hash of the words joined by blanks), so the list itself is not told.
    Only runs whose hash begins as a name's does come to the join; a list with more beginnings than
    BEGINNINGS meets all runs.
    """
    w = T.tokens(F.col("text"))
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    rows = texts.select("id", w.alias("w")).select("id", F.explode(F.array_distinct(F.flatten(F.array(*(grams(n) for n in range(1, words + 1)))))).alias("g"))
    hashed = rows.select("id", F.sha2("g", 256).alias("name_hash"))
    begins = [r[0] for r in names.select(F.substring("name_hash", 1, DIGITS)).filter("name_hash is not null").distinct().limit(BEGINNINGS + 1).collect()]
    if len(begins) <= BEGINNINGS:
        hashed = hashed.filter(F.substring("name_hash", 1, DIGITS).isin(begins))
    return hashed.join(names, "name_hash", "left_semi").distinct()


def vocabulary(terms: DataFrame, mapped: DataFrame, names: DataFrame) -> DataFrame:
    """term, target, state: terms with their mapping; those that are names are held back, the rest unmapped."""
    held = names.select(F.lower("name").alias("__n")).distinct().withColumn("__held", F.lit(True))
    rows = terms.withColumn("__n", F.lower("term")).join(mapped, "term", "left").join(held, "__n", "left")
    return rows.select("term", F.when(F.col("__held").isNull(), F.col("target")).alias("target"), F.when(F.col("__held"), "held_back").when(F.col("target").isNotNull(), "mapped").otherwise("unmapped").alias("state"))


def assembled(captures: DataFrame, reviews: DataFrame) -> DataFrame:
    """work, version, captures, observed: works and versions of captures whose review accepts them.

    captures: capture, work, version, retrieved. reviews: capture, state.
    """
    ok = captures.join(reviews.filter("state = 'accepted'").select("capture").distinct(), "capture", "left_semi")
    return ok.groupBy("work", "version").agg(F.count("*").alias("captures"), F.min("retrieved").alias("observed"))


def projected(lifecycles: DataFrame) -> DataFrame:
    """subject, status, refusal, losses: a lifecycle's latest accepted state as a record, or why there is none; what a record cannot hold is listed.

    lifecycles: subject, at, state, accepted, extras (array of names without a place in a record).
    """
    ok = F.col("accepted")
    best = lifecycles.groupBy("subject").agg(F.max(F.when(ok, F.struct("at", "state"))).alias("m"), F.count_if(ok).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("extras")))).alias("losses"))
    tie = lifecycles.filter(ok).groupBy("subject", "at").agg(F.count_distinct("state").alias("k")).filter("k > 1").select(F.col("subject").alias("__s"), F.col("at").alias("__t"))
    rows = best.join(tie, (F.col("subject") == F.col("__s")) & (F.col("m.at") == F.col("__t")), "left")
    refusal = F.when(F.col("n") == 0, "nothing_accepted").when(F.col("__t").isNotNull(), "latest_is_ambiguous")
    return rows.select("subject", F.when(refusal.isNull(), F.col("m.state")).alias("status"), refusal.alias("refusal"), F.array_join("losses", ",").alias("losses"))


def study_context(direct: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node, role, path: a study's versions, direct ones and those that a chain of relations brings, with a shortest chain as diagnosis."""
    found = shortest_paths(edges, direct, depth)
    role = F.when(F.size("path") == 1, "direct").otherwise("contextual")
    return found.select("node", role.alias("role"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def catalog_manifest(sources: DataFrame, needs: list[str]) -> DataFrame:
    """source, capabilities, missing: active sources with what they lack of the needed capabilities."""
    lack = F.array_except(F.array(*map(F.lit, needs)), F.col("capabilities"))
    return sources.filter("active").select("source", F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"), F.array_join(lack, ",").alias("missing"))


def migrated(rows: DataFrame) -> DataFrame:
    """Records of the first contract in the second: one date struct for three columns, unknown statuses named, dropped fields counted."""
    dates = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.date_format(c, "yyyy-MM-dd").alias("value"))) for c in ("introduced", "published", "updated"))))
    return rows.select("id", F.array_join(F.transform(dates, lambda x: F.concat_ws("=", x["kind"], x["value"])), ";").alias("dates"), F.coalesce("status", F.lit("unknown")).alias("status"), F.col("legacy").isNotNull().cast("int").alias("dropped"))


def deployed(rules: DataFrame, deployments: DataFrame, records: DataFrame, persona: str, order: tuple[str, ...], reach_: str) -> DataFrame:
    """record, rules: what a persona's deployment watches among records whose visibility it may reach."""
    own = deployments.filter(F.col("persona") == persona).select("rule")
    seen = records.filter(rank(F.col("visibility"), order) <= order.index(reach_)).select("record")
    hits = rules.join(own, "rule", "left_semi").select("rule", F.explode("records").alias("record")).distinct()
    return hits.join(seen, "record", "left_semi").groupBy("record").agg(F.count("*").alias("rules"))


def digest_ids(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Adds fact_id: kind and the first 32 hex digits of the SHA-256 of the columns' canonical JSON."""
    return rows.withColumn("fact_id", F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 32)))


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, where: ids of two sets, each once: left, right or both."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(True)), b.select(key).distinct().withColumn("__b", F.lit(True))
    return x.join(y, key, "full").select(key, F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both").alias("where"))


def parcels(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, level, authority, nation, fault: jurisdiction layers of land parcels as JSON; layers without a level or evidence have a fault."""
    schema = "parcelId string, jurisdictionLayers array<struct<level:string,authorityName:string,nationId:string,evidenceUrl:string,validationState:string>>"
    layers = rows.select(key, F.inline_outer(F.from_json(json, schema)["jurisdictionLayers"]))
    fault = F.when(F.col("level").isNull(), "no_level").when(~F.coalesce(F.col("evidenceUrl").startswith("https://"), F.lit(False)), "no_evidence").when((F.col("level") == "tribal") & (F.coalesce("validationState", F.lit("")) != "validated"), "not_validated")
    return layers.select(key, "level", F.col("authorityName").alias("authority"), F.col("nationId").alias("nation"), fault.alias("fault"))


# --- queries --------------------------------------------------------------------------------------


def _violations(spark, d):
    rules = {"positive": F.col("o_totalprice") > 1000, "dated": F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp"), "status": F.col("o_orderstatus").isin("O", "F"), "even": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 2 == 0)}
    return violations(table(spark, d, "orders"), "o_orderkey", rules)


def _readable(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 6 > 0, F.array(k % 1000 + 1, k % 700 + 1)).otherwise(F.array().cast("array<bigint>")).alias("passages"))
    passages = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("sensitivity"), F.when(F.col("c_nationkey") % 3 == 0, "staff").otherwise("public").alias("audience"))
    return readable_rows(rows, passages, 2, ["public"]).select("id")


def _drift(spark, d):
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    n = days.groupBy("day").agg(F.count("*").alias("n"))
    k = F.dayofmonth(F.col("day").cast("date"))
    return inventory_drift(n, n.withColumn("n", F.col("n") + F.when(k == 7, 1).otherwise(0)), days.filter(~F.col("day").endswith("-11") | (F.col("o_orderkey") % 3 > 0)), "day")


def _recognised(spark, d):
    lines = table(spark, d, "nation").groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " (note)").otherwise("")))), "\n").alias("text"))  # a list of at most 25 names
    return recognised(lines, "text", table(spark, d, "nation").filter("n_nationkey % 4 > 0").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("NOWHERE",)], "name string")), "name").select("name", "state")


def _headings(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 5 == 0, "NEW SECTION. Sec. 4 ").when(k % 5 == 1, "§ 12 ").when(k % 5 == 2, "[[INSERTION]]Section 3. ").when(k % 5 == 3, "Sections of ").otherwise("In sec. 3 "), "c_name")
    return table(spark, d, "customer").select("c_custkey", is_heading(text).alias("heading"))


def _synopsis(spark, d):
    text = F.concat(F.lit("<p>A &amp; B<br/>of "), F.col("c_name"), F.lit(" &sect; 3 &amp;lt; <b>x</b></p><p> </p>"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(synopsis(text), "|").alias("lines"))


def _replay(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    made = rows.filter("c_custkey % 9 > 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_nationkey")))
    return replay_equal(rows.filter("c_custkey % 8 > 0"), made, "c_custkey")


def _authorised(spark, d):
    k, body = F.col("s_suppkey"), F.col("s_name")
    registry = table(spark, d, "supplier").filter("s_suppkey % 6 > 0").select(k.cast("string").alias("entry"), body.alias("body"))
    digest = F.when(k % 4 == 0, F.lit("?")).otherwise(F.sha2(F.concat_ws("\n", k.cast("string"), body), 256))
    return authorised(registry, table(spark, d, "supplier").filter("s_suppkey % 5 > 0").select(k.cast("string").alias("entry"), digest.alias("digest"), (k % 12 == 0).alias("removed")))


def _names(spark, d):
    names = spark.createDataFrame([("mit license",), ("the license",), ("of the",)], "n string").select(F.sha2("n", 256).alias("name_hash"))
    return known_names(table(spark, d, "documents").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")), names, 2)


def _vocabulary(spark, d):
    terms = table(spark, d, "part").select(F.col("p_type").alias("term")).distinct()
    mapped = table(spark, d, "part").filter("p_size > 48").groupBy(F.col("p_type").alias("term")).agg(F.min("p_brand").alias("target"))
    return vocabulary(terms, mapped, table(spark, d, "part").filter("p_partkey % 40 = 0").select(F.upper("p_type").alias("name")))


def _assembled(spark, d):
    line = table(spark, d, "lineitem")
    cap = F.concat_ws(":", "l_orderkey", "l_linenumber")
    made = assembled(line.select(cap.alias("capture"), F.col("l_suppkey").alias("work"), F.col("l_partkey").alias("version"), F.col("l_shipdate").alias("retrieved")), line.select(cap.alias("capture"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("state")))
    return made.select("work", "version", "captures", F.date_format("observed", "yyyy-MM-dd").alias("observed"))


def _projected(spark, d):
    e = table(spark, d, "events")
    return projected(e.select(F.col("user_id").alias("subject"), F.date_trunc("hour", "ts").alias("at"), F.col("event_type").alias("state"), (F.col("event_id") % 4 > 0).alias("accepted"), F.when(F.col("event_id") % 9 == 0, F.array(F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("extras")))


def _context(spark, d):
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 3 + 1) % 97).alias("dst"))
    return study_context(s.filter("s_suppkey in (4, 9)").select(F.col("s_suppkey").alias("node")), edges, 3)


def _manifest(spark, d):
    k = F.col("s_suppkey")
    has = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("search")), F.when(k % 3 == 0, F.lit("capture")), F.lit("link")))
    return catalog_manifest(table(spark, d, "supplier").select(k.alias("source"), has.alias("capabilities"), (k % 5 > 0).alias("active")), ["capture", "search"])


def _migrated(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    return migrated(table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 > 0, day).alias("introduced"), day.alias("published"), F.when(k % 2 > 0, F.date_add(day, 3)).alias("updated"), F.when(k % 7 > 0, F.col("o_orderstatus")).alias("status"), F.when(k % 4 == 0, "x").alias("legacy")))


def _deployed(spark, d):
    k = F.col("s_suppkey")
    rules = table(spark, d, "supplier").select(k.alias("rule"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (k * i * 5) % 300).alias("records"))
    deployments = table(spark, d, "supplier").select(F.when(k % 2 == 0, "staff").otherwise("public").alias("persona"), k.alias("rule"))
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("restricted")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("visibility"))
    return deployed(rules, deployments, records, "staff", ("public", "internal", "restricted"), "internal")


def _ids(spark, d):
    return digest_ids(table(spark, d, "nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey"))), "fact", "n_name", "n_regionkey").select("n_nationkey", "fact_id")


def _sets(spark, d):
    e = table(spark, d, "events")
    return id_sets(e.filter("event_id % 3 = 0"), e.filter("event_type = 'click'"), "user_id")


def _parcels(spark, d):
    k = F.col("c_custkey")
    layer = F.struct(F.when(k % 5 > 0, F.when(k % 2 == 0, "tribal").otherwise("state")).alias("level"), F.col("c_mktsegment").alias("authorityName"), F.when(k % 2 == 0, F.col("c_nationkey").cast("string")).alias("nationId"), F.when(k % 7 > 0, "https://x.org/1").otherwise("http://x.org").alias("evidenceUrl"), F.when(k % 3 > 0, "validated").alias("validationState"))
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(k.cast("string").alias("parcelId"), F.array(layer).alias("jurisdictionLayers"))).alias("json"))
    return parcels(rows, "c_custkey", "json")


def _proceeding(spark, d):
    """Proceedings that a study reaches, with their parents: reachability down, then a climb."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    down = s.select(k.alias("src"), ((k * 3 + 1) % 97).alias("dst"))
    up = s.select(k.alias("src"), F.floor(k / 2).cast("long").alias("dst")).filter("dst > 0")
    found = materialize(reach(down, s.filter("s_suppkey = 40").select(k.alias("node")), 2), "found")
    return reach(up, found.select("node"), 20).select("node").distinct()


QUERIES = {
    "rule_violations": (_violations, """
select o_orderkey, rule from (select o_orderkey, unnest([case when not o_totalprice > 1000 then 'positive' end, case when not o_orderdate >= timestamp '1993-01-01' then 'dated' end, case when o_orderstatus not in ('O', 'F') then 'status' end,
  case when o_orderkey % 5 = 0 or o_orderkey % 2 > 0 then 'even' end]) as rule from orders) where rule is not null"""),
    "readable_rows": (_readable, """
with p as (select c_custkey as id from customer where c_custkey % 4 <= 2 and c_nationkey % 3 > 0)
select o_orderkey as id from orders where o_orderkey % 6 = 0 or (o_orderkey % 1000 + 1 in (select id from p) and o_orderkey % 700 + 1 in (select id from p))"""),
    "inventory_drift": (_drift, """
with n as (select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as before, count(*) + (day(o_orderdate::date) = 7)::int as after, count_if(day(o_orderdate::date) != 11 or o_orderkey % 3 > 0) as collected from orders group by o_orderdate::date, 1, day(o_orderdate::date))
select *, case when before != after then 'retry' when collected < after then 'short' when collected > after then 'over' else 'whole' end as state from n"""),
    "recognition_list": (_recognised, "select n_name as name, case when n_nationkey % 4 > 0 then 'reconciled' else 'unknown' end as state from nation union all select 'NOWHERE', 'not_listed'"),
    "section_headings": (_headings, "select c_custkey, c_custkey % 5 < 3 as heading from customer"),
    "synopsis_lines": (_synopsis, "select c_custkey, 'A & B|of ' || c_name || ' § 3 &lt; x' as lines from customer"),
    "replay_equality": (_replay, "select c_custkey, case when c_custkey % 9 = 0 then 'gone' when c_custkey % 8 = 0 then 'fresh' else 'differs' end as change from customer where (c_custkey % 8 > 0 or c_custkey % 9 > 0) and (c_custkey % 9 = 0 or c_custkey % 8 = 0 or c_custkey % 7 = 0)"),
    "registry_digests": (_authorised, """
select s_suppkey::varchar as entry, case when s_suppkey % 5 = 0 then 'added' when s_suppkey % 6 = 0 then case when s_suppkey % 12 = 0 then 'removed' else 'missing' end when s_suppkey % 4 = 0 then 'changed' else 'same' end as state from supplier where s_suppkey % 5 > 0 or s_suppkey % 6 > 0"""),
    "name_hashes": (_names, r"""
with d as (select doc_id as id, ' ' || array_to_string(regexp_extract_all(lower(min(text)), '[\p{L}\p{N}]+'), ' ') || ' ' as t from documents group by 1)
select id, sha256(n) as name_hash from d, (values ('mit license'), ('the license'), ('of the')) v(n) where contains(t, ' ' || n || ' ')"""),
    "vocabulary_mapping": (_vocabulary, """
with t as (select distinct p_type as term from part), m as (select p_type as term, min(p_brand) as target from part where p_size > 48 group by 1), h as (select distinct lower(p_type) as n from part where p_partkey % 40 = 0)
select term, case when n is null then target end as target, case when n is not null then 'held_back' when target is not null then 'mapped' else 'unmapped' end as state from t left join m using (term) left join h on n = lower(term)"""),
    "corpus_assembly": (_assembled, "select l_suppkey as work, l_partkey as version, count(*) as captures, strftime(min(l_shipdate), '%Y-%m-%d') as observed from lineitem where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from lineitem where l_returnflag != 'R') group by all"),
    "lifecycle_projection": (_projected, """
with e as (select user_id, date_trunc('hour', ts) as t, event_type, event_id % 4 > 0 as ok, case when event_id % 9 = 0 then 'f' || event_id % 5 end as x from events),
b as (select user_id, max(t) filter (ok) as t, count_if(ok) as n, coalesce(string_agg(distinct x, ',' order by x), '') as losses from e group by 1),
l as (select b.user_id, max(event_type) as status, count(distinct event_type) as k from b join e on e.user_id = b.user_id and e.t = b.t and ok group by 1)
select b.user_id as subject, case when n > 0 and k = 1 then status end as status, case when n = 0 then 'nothing_accepted' when k > 1 then 'latest_is_ambiguous' end as refusal, losses from b left join l using (user_id)"""),
    "study_context": (_context, """
with recursive r as (select s_suppkey as node, [s_suppkey] as path from supplier where s_suppkey in (4, 9) union all select (node * 3 + 1) % 97, list_append(path, (node * 3 + 1) % 97) from r where len(path) <= 3 and node in (select s_suppkey from supplier)),
b as (select node, min(len(path)) as n from r group by node)
select node, case when n = 1 then 'direct' else 'contextual' end as role, array_to_string(min(path), '>') as path from r join b using (node) where len(path) = n group by node, n"""),
    "catalog_manifest": (_manifest, "select s_suppkey as source, concat_ws(',', case when s_suppkey % 3 = 0 then 'capture' end, 'link', case when s_suppkey % 2 = 0 then 'search' end) as capabilities, concat_ws(',', case when s_suppkey % 3 > 0 then 'capture' end, case when s_suppkey % 2 > 0 then 'search' end) as missing from supplier where s_suppkey % 5 > 0"),
    "contract_migration": (_migrated, "select o_orderkey as id, concat_ws(';', case when o_orderkey % 3 > 0 then 'introduced=' || strftime(o_orderdate, '%Y-%m-%d') end, 'published=' || strftime(o_orderdate, '%Y-%m-%d'), case when o_orderkey % 2 > 0 then 'updated=' || strftime(o_orderdate::date + 3, '%Y-%m-%d') end) as dates, case when o_orderkey % 7 > 0 then o_orderstatus else 'unknown' end as status, (o_orderkey % 4 = 0)::int as dropped from orders"),
    "deployment_projection": (_deployed, "with h as (select distinct s_suppkey, (s_suppkey * i * 5) % 300 as record from supplier, range(1, 7) t(i) where s_suppkey % 2 = 0) select record, count(*) as rules from h join customer on c_custkey = record where c_custkey % 3 < 2 group by record"),
    "digest_ids": (_ids, """select n_nationkey, 'fact-' || sha256('{"n_name":"' || n_name || '","n_regionkey":' || case when n_nationkey % 4 > 0 then n_regionkey::varchar else 'null' end || '}')[1:32] as fact_id from nation"""),
    "id_sets": (_sets, "with a as (select distinct user_id from events where event_id % 3 = 0), b as (select distinct user_id from events where event_type = 'click') select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'right' when b.user_id is null then 'left' else 'both' end as where from a full join b on a.user_id = b.user_id"),
    "parcel_layers": (_parcels, "select c_custkey, case when c_custkey % 5 > 0 then case when c_custkey % 2 = 0 then 'tribal' else 'state' end end as level, c_mktsegment as authority, case when c_custkey % 2 = 0 then c_nationkey::varchar end as nation, case when c_custkey % 5 = 0 then 'no_level' when c_custkey % 7 = 0 then 'no_evidence' when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'not_validated' end as fault from customer"),
    "proceeding_parents": (_proceeding, """
with recursive r as (select s_suppkey as node, 0 as depth from supplier where s_suppkey = 40 union all select (node * 3 + 1) % 97, depth + 1 from r where depth < 2 and node in (select s_suppkey from supplier)),
u as (select node from r union select node // 2 from u where node // 2 > 0 and node in (select s_suppkey from supplier))
select distinct node from u"""),
}
