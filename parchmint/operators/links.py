"""Joins of a corpus' catalogs, of issues with listings, of rules and reviews with records, and the links that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.session import materialize, table


def resolved(segments: DataFrame, renditions: DataFrame, versions: DataFrame, works: DataFrame, profiles: DataFrame) -> DataFrame:
    """Segments with their rendition, version, work and profile: one equi-join for each step of the chain."""
    return segments.join(renditions, "rendition").join(versions, "version").join(works, "work").join(profiles, "profile")


def with_events(versions: DataFrame, events: DataFrame, key: str, *columns: str) -> DataFrame:
    """Versions with their events as an array of structs in the columns' order; none is an empty array."""
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("events"))
    joined = versions.join(listed, key, "left")
    return joined.withColumn("events", F.coalesce("events", F.array().cast(joined.schema["events"].dataType)))


def first_observed(renditions: DataFrame, captures: DataFrame) -> DataFrame:
    """version, observed: when the first capture of a version's renditions was retrieved."""
    return renditions.join(captures, "capture").groupBy("version").agg(F.min("retrieved").alias("observed"))


def issue_counts(issues: DataFrame, listings: DataFrame) -> DataFrame:
    """issue, listings, rows: distinct listings that state one of an issue's identifiers, and rows that do.

    issues: issue, kind, identifier. listings: listing, kind, identifier, name_only. Identifiers are
    compared without case and blanks; rows that only share a name are not counted.
    """
    norm = F.regexp_replace(F.lower("identifier"), r"\s+", "").alias("identifier")
    a, b = issues.select("issue", "kind", norm).distinct(), listings.filter(~F.col("name_only")).select("listing", "kind", norm).distinct()
    found = a.join(b, ["kind", "identifier"]).select("issue", "listing").distinct().groupBy("issue").agg(F.count("*").alias("listings"))
    return issues.select("issue").distinct().join(found, "issue", "left").select("issue", F.coalesce("listings", F.lit(0)).cast("long").alias("listings"))


def cited_weight(issues: DataFrame, cited: DataFrame) -> DataFrame:
    """issue, rows, places: rows in whose text an issue's section is cited, weighted by their places.

    Sections are compared by title and base section: letters and subsections behind it don't count.
    """
    base = F.regexp_extract("section", r"^(\d+)", 1)
    a, b = issues.select("issue", "title", base.alias("base")).distinct(), cited.select("row", "title", base.alias("base"), F.coalesce("places", F.lit(1)).alias("places"))
    return a.join(b, ["title", "base"]).groupBy("issue").agg(F.count_distinct("row").alias("rows"), F.sum("places").cast("long").alias("places"))


def watched(deployments: DataFrame, rules: DataFrame) -> DataFrame:
    """record, rules: the rules of a deployment that watch each record, sorted. deployments: deployment, rule. rules: rule, records array."""
    hits = deployments.join(rules, "rule").select("rule", F.explode("records").alias("record")).distinct()
    return hits.groupBy("record").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))


def bad_targets(rules: DataFrame, records: DataFrame, basis) -> DataFrame:
    """rule, record, reason: targets that are missing, outside of the rule's region, or fail its basis."""
    rows = rules.select("rule", "region", F.explode("records").alias("record")).join(records, "record", "left")
    reason = F.when(F.col("record_region").isNull(), "missing").when(F.col("record_region") != F.col("region"), "region").when(~F.coalesce(basis, F.lit(False)), "basis")
    return rows.withColumn("reason", reason).filter("reason is not null").select("rule", "record", "reason")


def granted(grants: DataFrame, reviews: DataFrame, kinds: list[str]) -> DataFrame:
    """grant, eligible: whether every review of a grant is accepted and every required kind of review is there."""
    found = reviews.groupBy("grant").agg(F.bool_and(F.col("state") == "accepted").alias("ok"), F.collect_set("kind").alias("kinds"))
    all_ = F.size(F.array_except(F.array(*map(F.lit, kinds)), F.coalesce("kinds", F.array().cast("array<string>")))) == 0
    return grants.join(found, "grant", "left").select("grant", (F.coalesce("ok", F.lit(False)) & all_).alias("eligible"))


def targets_known(edges: DataFrame, versions: DataFrame, cutoff: Column) -> DataFrame:
    """edge, state, known: an edge's candidates that are known by a cutoff.

    edges: edge, state (resolved, ambiguous, unresolved), candidates array. A resolved edge whose
    target is not yet known becomes unresolved. Ambiguous ones lose unknown candidates, but one that
    is left alone is not promoted to resolved.
    """
    at = versions.filter(F.col("known_at") <= cutoff).select(F.col("version").alias("candidate"), F.lit(True).alias("ok"))
    rows = edges.select("edge", "state", F.explode_outer("candidates").alias("candidate")).join(at, "candidate", "left")
    found = rows.groupBy("edge", "state").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("candidate")))).alias("known"))
    state = F.when(F.size("known") == 0, "unresolved").otherwise(F.col("state"))
    return found.select("edge", state.alias("state"), F.array_join(F.transform("known", lambda x: x.cast("string")), ",").alias("known"))


def exactly_one(locators: DataFrame, segments: DataFrame, on: list[str]) -> DataFrame:
    """Locators with matches and state: found if exactly one segment fits, else missing or ambiguous."""
    n = segments.groupBy(*on).agg(F.count("*").alias("matches"))
    out = locators.join(n, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("state", F.when(F.col("matches") == 1, "found").when(F.col("matches") == 0, "missing").otherwise("ambiguous"))


def unresolved_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (id, version) that no definition has in exactly that version, with whether another version is there."""
    exact = references.join(known.select("id", "version"), ["id", "version"], "left_anti")
    other = known.select("id").distinct().withColumn("other_version", F.lit(True))
    return exact.join(other, "id", "left").withColumn("other_version", F.coalesce("other_version", F.lit(False)))


def related_drift(documents: DataFrame) -> DataFrame:
    """document, target, reason: related documents that are missing or state another title than their own."""
    pairs = documents.select("document", F.explode("related").alias("r"))
    own = documents.select(F.col("document").alias("target"), F.col("title").alias("own"))
    rows = pairs.select("document", F.col("r.target").alias("target"), F.col("r.title").alias("said")).join(own, "target", "left")
    reason = F.when(F.col("own").isNull(), "missing").when(~F.col("own").eqNullSafe(F.col("said")), "title")
    return rows.withColumn("reason", reason).filter("reason is not null").select("document", "target", "reason")


def one_sided(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges without the edge back."""
    back = edges.select(F.col(b).alias("__a"), F.col(a).alias("__b")).distinct()
    return edges.join(back, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left_anti")


def latest_coverage(rows: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """key, row, tie: the latest row of each key; a tie on time is an error that is told, not resolved."""
    best = rows.withColumn("__m", F.max(at).over(Window.partitionBy(key))).filter(F.col(at) == F.col("__m"))
    return best.groupBy(key).agg(F.min(row_id).alias(row_id), (F.count("*") > 1).alias("tie"))


def current_reviews(reviews: DataFrame, roles: DataFrame, owners: DataFrame, at: Column) -> DataFrame:
    """Reviews that hold: in time, usable, by a role and for an owner that are current themselves."""
    live = lambda t: t.filter((F.col("issued") <= at) & (F.col("expires") > at))
    ok = live(reviews).filter("usable")
    return ok.join(live(roles).select("reviewer"), "reviewer", "left_semi").join(live(owners).select("owner"), "owner", "left_semi")


def ordered_reasons(codes: Column, order: list[str]) -> Column:
    """Distinct reason codes in a fixed order; codes that it doesn't have come last, by name."""
    place = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    keyed = F.transform(F.array_distinct(codes), lambda c: F.struct(F.coalesce(F.element_at(place, c), F.lit(len(order))).alias("p"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def unmapped(assignments: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """assignment, state: classified with a target that holds and is granted, unmapped if no binding crosswalk has an edge, else ineligible.

    assignments: assignment, node, state (accepted or not), day. crosswalks: node, from, through,
    binding, granted.
    """
    live = assignments.join(crosswalks, "node", "left").withColumn("holds", (F.col("from") <= F.col("day")) & (F.col("through").isNull() | (F.col("day") <= F.col("through"))))
    found = live.groupBy("assignment", "state").agg(F.coalesce(F.bool_or(F.col("holds") & F.col("binding")), F.lit(False)).alias("bound"), F.coalesce(F.bool_or(F.col("holds") & F.col("granted")), F.lit(False)).alias("open"))
    out = F.when(F.col("state") != "accepted", "not_assessed").when(F.col("open"), "classified").when(~F.col("bound"), "unmapped").otherwise("ineligible")
    return found.select("assignment", out.alias("result"))


def append_pages(pages: DataFrame, cap: int) -> DataFrame:
    """query, row, page: rows of pages up to the first cursor that repeats, each once, at most ``cap`` of a query.

    pages: query, page, cursor, rows array.
    """
    again = F.row_number().over(Window.partitionBy("query", "cursor").orderBy("page")) > 1
    stop = F.max(F.col("again").cast("int")).over(Window.partitionBy("query").orderBy("page"))
    kept = pages.withColumn("again", again).withColumn("stop", stop).filter("stop = 0")
    rows = kept.select("query", "page", F.posexplode("rows").alias("at", "row")).groupBy("query", "row").agg(F.min(F.struct("page", "at")).alias("p"))
    order = Window.partitionBy("query").orderBy("p")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).select("query", "row", F.col("p.page").alias("page"))


def imported(new: DataFrame, known: DataFrame, owner: str, key: str, order: str, cap: int) -> DataFrame:
    """Each new entry with outcome: already there, added, or dropped beyond ``cap`` entries of its owner."""
    have = known.groupBy(owner).agg(F.count("*").alias("__have"))
    seen = known.select(owner, key, F.lit(True).alias("__seen"))
    rows = new.join(seen, [owner, key], "left").join(have, owner, "left")
    rank = F.sum(F.when(F.col("__seen").isNull(), 1).otherwise(0)).over(Window.partitionBy(owner).orderBy(order, key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.col("__seen"), "already").when(rank + F.coalesce("__have", F.lit(0)) <= cap, "added").otherwise("dropped")
    return rows.select(owner, key, outcome.alias("outcome"))


def first_wording(rows: DataFrame, source: str, target: str, text: str, order: str) -> DataFrame:
    """source, target, text: each distinct link with the wording that stands first."""
    return rows.groupBy(source, target).agg(F.min(F.struct(order, text)).alias("__f")).select(source, target, F.col(f"__f.{text}").alias(text))


def lookups(records: DataFrame, followed: bool = False) -> DataFrame:
    """record, lane: searches that a record's identifiers give; only those of followed records if asked for.

    records: record, dockets, rins, parts (arrays), followed.
    """
    rows = records.filter("followed") if followed else records
    kinds = {"docket": "dockets", "rin": "rins", "cfr": "parts"}
    lanes = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x))
    found = F.flatten(F.array(*(F.transform(c, lanes(k)) for k, c in kinds.items())))
    return rows.select("record", F.explode(F.array_distinct(found)).alias("lane"))


def link_rows(records: DataFrame) -> DataFrame:
    """record, label, target: what a record links to, labelled by kind. records: record, cites array<struct<kind, title, number>>."""
    rows = records.select("record", F.inline("cites"))
    label = F.when(F.col("kind") == "cfr", F.format_string("%s CFR %s", "title", "number")).when(F.col("kind") == "usc", F.format_string("%s U.S.C. %s", "title", "number")).when(F.col("kind") == "public_law", F.format_string("Pub. L. %s-%s", "title", "number")).otherwise(F.concat_ws(" ", "title", "kind", "number"))
    target = F.concat_ws("/", F.col("kind"), F.col("title"), F.regexp_extract("number", r"^\d+", 0))
    return rows.select("record", label.alias("label"), target.alias("target")).distinct()


def related_rows(links: DataFrame) -> DataFrame:
    """record, other, shared: records that link to the same targets, by number of targets; each pair once.

    A target that many records share is met by its smallest record only, so no target makes all pairs.
    """
    least = links.groupBy("target").agg(F.min("record").alias("other"))
    return links.select("record", "target").distinct().join(least, "target").filter("record != other").groupBy("record", "other").agg(F.count("*").alias("shared"))


def held_snapshot(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of stored JSON text with fields and damaged: whole entries are kept, damaged ones flagged."""
    parsed = F.from_json("json", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("p", parsed).select("key", "p.*").withColumn("damaged", F.col("_corrupt").isNotNull()).drop("_corrupt")


# --- queries --------------------------------------------------------------------------------------


def _chain(spark, d):
    line, o, c, n = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = resolved(
        line.select("l_linenumber", F.col("l_orderkey").alias("rendition")),
        o.select(F.col("o_orderkey").alias("rendition"), F.col("o_custkey").alias("version")),
        c.select(F.col("c_custkey").alias("version"), F.col("c_nationkey").alias("work")),
        n.select(F.col("n_nationkey").alias("work"), F.col("n_regionkey").alias("profile")),
        table(spark, d, "region").select(F.col("r_regionkey").alias("profile"), "r_name"),
    )
    return rows.select("rendition", "l_linenumber", "r_name")


def _listed(spark, d):
    o, line = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    listed = with_events(o, line, "o_orderkey", "l_linenumber", "l_returnflag")
    return listed.select("o_orderkey", F.array_join(F.transform("events", lambda e: F.concat(e["l_linenumber"].cast("string"), e["l_returnflag"])), ",").alias("events"))


def _observed(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("capture"), "l_shipdate")
    return first_observed(line.select("version", "capture"), line.select("capture", F.col("l_shipdate").alias("retrieved")).distinct()).select("version", F.date_format("observed", "yyyy-MM-dd").alias("observed"))


def _issue_rows(spark, d):
    k = F.col("n_nationkey")
    issues = table(spark, d, "nation").select("n_name", F.inline(F.array(F.struct(F.lit("docket").alias("kind"), F.concat(F.lit("EPA "), k.cast("string")).alias("identifier")), F.struct(F.lit("rin").alias("kind"), F.concat(F.lit("1076-AF"), k.cast("string")).alias("identifier"))))).withColumnRenamed("n_name", "issue")
    o = F.col("o_orderkey")
    listings = table(spark, d, "orders").select(o.alias("listing"), F.when(o % 2 == 0, "docket").otherwise("rin").alias("kind"), F.when(o % 2 == 0, F.concat(F.lit("epa"), (o % 40).cast("string"))).otherwise(F.concat(F.lit("1076-af"), (o % 40).cast("string"))).alias("identifier"), (o % 7 == 0).alias("name_only"))
    return issues, listings


def _issues(spark, d):
    return issue_counts(*_issue_rows(spark, d))


def _cited(spark, d):
    issues = table(spark, d, "nation").select(F.col("n_name").alias("issue"), F.lit(25).alias("title"), F.concat((F.col("n_nationkey") + 450).cast("string"), F.lit("a")).alias("section"))
    k = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.when(k % 2 == 0, 25).otherwise(26).alias("title"), F.concat((k % 60 + 440).cast("string"), F.when(k % 3 == 0, "(b)").otherwise("")).alias("section"), F.when(k % 5 > 0, (k % 4).cast("int")).alias("places"))
    return cited_weight(issues, rows)


def _rules(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.format_string("r%03d", k).alias("rule"), (k % 5).alias("region"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (k * i * 7 + i) % 400).alias("records"), k)


def _watched(spark, d):
    rules = _rules(spark, d)
    return watched(rules.filter("s_suppkey % 3 = 0").select(F.lit("main").alias("deployment"), "rule"), rules)


def _bad(spark, d):
    c = table(spark, d, "customer").filter("c_custkey < 350").select(F.col("c_custkey").alias("record"), (F.col("c_nationkey") % 5).cast("long").alias("record_region"), "c_acctbal")
    return bad_targets(_rules(spark, d), c, F.col("c_acctbal") > 0).distinct()


def _granted(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("grant"))
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grant"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("state"), F.when(F.col("l_linestatus") == "O", "legal").otherwise("source").alias("kind"))
    return granted(o, line, ["legal", "source"])


def _edges_known(spark, d):
    k = F.col("o_orderkey")
    edges = table(spark, d, "orders").select(k.alias("edge"), F.when(k % 3 == 0, "resolved").when(k % 3 == 1, "ambiguous").otherwise("unresolved").alias("state"), F.when(k % 3 == 0, F.array(k % 200 + 1)).when(k % 3 == 1, F.array(k % 200 + 1, k % 90 + 1)).otherwise(F.array().cast("array<bigint>")).alias("candidates"))
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("known_at"))
    return targets_known(edges.withColumn("candidates", F.array_distinct("candidates")), versions, F.lit("1995-06-01").cast("timestamp"))


def _one(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 7 + 1).alias("supp"))
    return exactly_one(wanted, line, ["part", "supp"]).select("part", "matches", "state")


def _references(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("version")).distinct()
    known = table(spark, d, "part").filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 + 1).cast("long").alias("version"))
    return unresolved_references(refs.withColumn("version", F.col("version").cast("long")), known)


def _drift(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("document"), F.col("c_mktsegment").alias("title"), F.array(F.struct((k * 2).alias("target"), F.col("c_mktsegment").alias("title"))).alias("related"))
    return related_drift(rows)


def _reciprocal(spark, d):
    k = F.col("s_suppkey")
    return one_sided(table(spark, d, "supplier").select(F.explode(F.array(F.struct(k.alias("a"), (k % 10).alias("b")), F.struct((k % 10).alias("a"), (k % 50).alias("b")))).alias("e")).select("e.*").distinct(), "a", "b")


def _latest(spark, d):
    rows = table(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("at"), "event_id")
    return latest_coverage(rows, "user_id", "at", "event_id")


def _reviews(spark, d):
    day = F.to_date("o_orderdate")
    span = lambda n: [day.alias("issued"), F.date_add(day, n).alias("expires")]
    o = table(spark, d, "orders")
    reviews = o.select("o_orderkey", F.col("o_custkey").alias("reviewer"), (F.col("o_custkey") % 100).alias("owner"), (F.col("o_orderkey") % 4 > 0).alias("usable"), *span(400))
    roles = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("reviewer"), *span(300)).distinct()
    owners = o.filter("o_orderkey % 5 = 0").select((F.col("o_custkey") % 100).alias("owner"), *span(90)).distinct()
    return current_reviews(reviews, roles, owners, F.lit("1995-06-01").cast("date")).select("o_orderkey")


def _reasons(spark, d):
    codes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("codes"))
    return codes.select("l_orderkey", F.array_join(ordered_reasons(F.col("codes"), ["RF", "NO", "AF"]), ",").alias("reasons"))


def _unmapped(spark, d):
    o, k = table(spark, d, "orders"), F.col("n_nationkey")
    assignments = o.select(F.col("o_orderkey").alias("assignment"), (F.col("o_custkey") % 25).cast("int").alias("node"), F.when(F.col("o_orderkey") % 6 > 0, "accepted").otherwise("pending").alias("state"), F.to_date("o_orderdate").alias("day"))
    walks = table(spark, d, "nation").filter("n_nationkey % 4 > 0").select(k.alias("node"), F.make_date(1993 + k % 3, F.lit(1), F.lit(1)).alias("from"), F.when(k % 2 > 0, F.lit("1996-06-30").cast("date")).alias("through"), (k % 3 > 0).alias("binding"), (k % 5 > 0).alias("granted"))
    return unmapped(assignments, walks)


def _pages_(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), k.alias("page"), (k % 4).alias("cursor"), F.array(k % 10, k % 3, k % 7).alias("rows"))
    return append_pages(rows, 5)


def _imported(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), "event_id")
    new = e.groupBy("user_id", "key").agg(F.min("event_id").alias("at"))
    known = e.filter("event_id % 5 = 0").select("user_id", "key").distinct()
    return imported(new, known, "user_id", "key", "at", 3)


def _wording(spark, d):
    line = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return first_wording(line, "l_suppkey", "l_returnflag", "text", "at")


def _records(spark, d):
    k = F.col("o_orderkey")
    cite = lambda kind, title, number: F.struct(F.lit(kind).alias("kind"), title.cast("string").alias("title"), number.alias("number"))
    cites = F.array(cite("cfr", k % 3 + 40, F.concat((k % 500).cast("string"), F.lit(".1"))), cite("usc", F.lit(25), (k % 300 + 400).cast("string")), cite("public_law", k % 20 + 90, (k % 9).cast("string")))
    text = lambda p, n: F.array(F.concat(F.lit(p), (k % n).cast("string")))
    return table(spark, d, "orders").select(k.alias("record"), cites.alias("cites"), text("EPA-", 80).alias("dockets"), text("1076-AF", 30).alias("rins"), text("40 CFR ", 30).alias("parts"), (k % 4 == 0).alias("followed"))


def _lookups(spark, d):
    return lookups(_records(spark, d), followed=True).groupBy("lane").agg(F.count("*").alias("records"))


def _link_rows(spark, d):
    return link_rows(_records(spark, d))


def _related(spark, d):
    links = materialize(link_rows(_records(spark, d)), "links")
    return related_rows(links)


def _snapshot(spark, d):
    k = F.col("c_custkey")
    json = F.when(k % 4 == 0, F.concat(F.lit('{"id": '), k.cast("string"))).otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "name": "'), F.col("c_mktsegment"), F.lit('"}')))
    return held_snapshot(table(spark, d, "customer").select(k.alias("key"), json.alias("json")), "id long, name string").select("key", F.when(~F.col("damaged"), F.col("name")).alias("name"), "damaged")


_LINKS = """with c as (select o_orderkey as record, o_orderkey % 3 + 40 as ct, o_orderkey % 500 as cn, o_orderkey % 300 + 400 as un, o_orderkey % 20 + 90 as pt, o_orderkey % 9 as pn from orders),
l as (select distinct record, ct || ' CFR ' || cn || '.1' as label, 'cfr/' || ct || '/' || cn as target from c union select record, '25 U.S.C. ' || un, 'usc/25/' || un from c union select record, 'Pub. L. ' || pt || '-' || pn, 'public_law/' || pt || '/' || pn from c)"""

QUERIES = {
    "corpus_chain": (_chain, "select l_orderkey as rendition, l_linenumber, r_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "version_events": (_listed, "select o_orderkey, coalesce(string_agg(l_linenumber || l_returnflag, ',' order by l_linenumber, l_returnflag) filter (l_linenumber > 2), '') as events from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey"),
    "first_observed": (_observed, "select l_orderkey as version, strftime(min(l_shipdate), '%Y-%m-%d') as observed from lineitem group by l_orderkey"),
    "issue_listings": (_issues, """
with l as (select o_orderkey, o_orderkey % 2 as kind, o_orderkey % 40 as id from orders where o_orderkey % 7 != 0)
select n_name as issue, (select count(*) from l where id = n_nationkey) as listings from nation"""),
    "cited_sections": (_cited, """
with r as (select l_orderkey as row, case when l_partkey % 2 = 0 then 25 else 26 end as title, l_partkey % 60 + 440 as base, coalesce(case when l_partkey % 5 > 0 then l_partkey % 4 end, 1) as places from lineitem)
select n_name as issue, count(distinct row) as rows, sum(places)::bigint as places from nation join r on title = 25 and base = n_nationkey + 450 group by n_name"""),
    "watch_rules": (_watched, """
with h as (select distinct s_suppkey, (s_suppkey * i * 7 + i) % 400 as record from supplier, range(1, 9) t(i) where s_suppkey % 3 = 0)
select record, string_agg(printf('r%03d', s_suppkey), ',' order by printf('r%03d', s_suppkey)) as rules from h group by record"""),
    "rule_targets": (_bad, """
with h as (select printf('r%03d', s_suppkey) as rule, s_suppkey % 5 as region, (s_suppkey * i * 7 + i) % 400 as record from supplier, range(1, 9) t(i)), c as (select * from customer where c_custkey < 350)
select distinct rule, record, case when c_custkey is null then 'missing' when c_nationkey % 5 != region then 'region' else 'basis' end as reason from h left join c on c_custkey = record where c_custkey is null or c_nationkey % 5 != region or not c_acctbal > 0"""),
    "grant_reviews": (_granted, "select o_orderkey as grant, coalesce(bool_and(l_returnflag != 'R') and bool_or(l_linestatus = 'O') and bool_or(l_linestatus != 'O'), false) as eligible from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey"),
    "relation_targets": (_edges_known, """
with e as (select o_orderkey as edge, case o_orderkey % 3 when 0 then 'resolved' when 1 then 'ambiguous' else 'unresolved' end as state, case o_orderkey % 3 when 0 then [o_orderkey % 200 + 1] when 1 then list_distinct([o_orderkey % 200 + 1, o_orderkey % 90 + 1]) else [] end as c from orders),
k as (select edge, string_agg(v::varchar, ',' order by v) as known from (select edge, unnest(c) as v from e) join orders on o_orderkey = v where o_orderdate <= timestamp '1995-06-01' group by edge)
select edge, case when known is null then 'unresolved' else state end as state, coalesce(known, '') as known from e left join k using (edge)"""),
    "exact_locators": (_one, """
with n as (select p_partkey as part, count(l_orderkey) as matches from part left join lineitem on l_partkey = p_partkey and l_suppkey = p_partkey % 7 + 1 group by 1)
select part, matches, case matches when 1 then 'found' when 0 then 'missing' else 'ambiguous' end as state from n"""),
    "reference_versions": (_references, """
with k as (select p_partkey as id, (p_size % 7 + 1)::bigint as version from part where p_partkey % 3 > 0)
select distinct l_partkey as id, l_linenumber::bigint as version, exists (select 1 from k where k.id = l_partkey) as other_version from lineitem where not exists (select 1 from k where k.id = l_partkey and k.version = l_linenumber)"""),
    "related_drift": (_drift, "select a.c_custkey as document, a.c_custkey * 2 as target, case when b.c_custkey is null then 'missing' else 'title' end as reason from customer a left join customer b on b.c_custkey = a.c_custkey * 2 where b.c_custkey is null or b.c_mktsegment != a.c_mktsegment"),
    "reciprocal_edges": (_reciprocal, "with e as (select s_suppkey as a, s_suppkey % 10 as b from supplier union select s_suppkey % 10, s_suppkey % 50 from supplier) select a, b from e where not exists (select 1 from e f where f.a = e.b and f.b = e.a)"),
    "latest_coverage": (_latest, "with m as (select user_id, event_id, date_trunc('day', ts) as t, max(date_trunc('day', ts)) over (partition by user_id) as m from events) select user_id, min(event_id) as event_id, count(*) > 1 as tie from m where t = m group by user_id"),
    "current_reviews": (_reviews, """
with o as (select *, o_orderdate::date as day, date '1995-06-01' as t from orders)
select o_orderkey from o where day <= t and day + 400 > t and o_orderkey % 4 > 0 and o_custkey in (select o_custkey from o where o_orderkey % 3 = 0 and day <= t and day + 300 > t)
  and o_custkey % 100 in (select o_custkey % 100 from o where o_orderkey % 5 = 0 and day <= t and day + 90 > t)"""),
    "reason_order": (_reasons, """
with c as (select distinct l_orderkey, l_returnflag || l_linestatus as c from lineitem)
select l_orderkey, string_agg(c, ',' order by case c when 'RF' then 0 when 'NO' then 1 when 'AF' then 2 else 3 end, c) as reasons from c group by l_orderkey"""),
    "taxonomy_assignments": (_unmapped, """
with w as (select n_nationkey as node, make_date(1993 + n_nationkey % 3, 1, 1) as f, case when n_nationkey % 2 > 0 then date '1996-06-30' end as t, n_nationkey % 3 > 0 as b, n_nationkey % 5 > 0 as g from nation where n_nationkey % 4 > 0),
a as (select o_orderkey, o_orderkey % 6 > 0 as ok, coalesce(bool_or(f <= o_orderdate::date and (t is null or o_orderdate::date <= t) and b), false) as bound, coalesce(bool_or(f <= o_orderdate::date and (t is null or o_orderdate::date <= t) and g), false) as open from orders left join w on node = o_custkey % 25 group by 1, 2)
select o_orderkey as assignment, case when not ok then 'not_assessed' when open then 'classified' when not bound then 'unmapped' else 'ineligible' end as result from a"""),
    "page_append": (_pages_, """
with p as (select o_custkey as query, o_orderkey as page, row_number() over (partition by o_custkey, o_orderkey % 4 order by o_orderkey) > 1 as again from orders),
k as (select *, bool_or(again) over (partition by query order by page) as stop from p),
r as (select query, row, min(struct_pack(p := page, i := i)) as m from (select query, page, i, [page % 10, page % 3, page % 7][i] as row from k, range(1, 4) t(i) where not stop) group by query, row)
select query, row, m.p as page from r qualify row_number() over (partition by query order by m) <= 5"""),
    "import_merge": (_imported, """
with n as (select user_id, event_type as key, min(event_id) as t, bool_or(event_id % 5 = 0) as seen from events group by all),
h as (select *, count_if(seen) over (partition by user_id) as have, sum(case when seen then 0 else 1 end) over (partition by user_id order by t, key rows unbounded preceding) as rank from n)
select user_id, key, case when seen then 'already' when rank + have <= 3 then 'added' else 'dropped' end as outcome from h"""),
    "first_wording": (_wording, "select l_suppkey, l_returnflag, arg_min(l_linestatus || l_linenumber, l_orderkey * 10 + l_linenumber) as text from lineitem group by all"),
    "record_lanes": (_lookups, "select lane, count(*) as records from (select unnest(['docket:epa-' || o_orderkey % 80, 'rin:1076-af' || o_orderkey % 30, 'cfr:40 cfr ' || o_orderkey % 30]) as lane from orders where o_orderkey % 4 = 0) group by lane"),
    "link_rows": (_link_rows, _LINKS + " select * from l"),
    "related_rows": (_related, _LINKS + ", f as (select target, min(record) as other from l group by target) select record, other, count(*) as shared from (select distinct record, target from l) join f using (target) where record != other group by all"),
    "snapshot_restore": (_snapshot, "select c_custkey as key, case when c_custkey % 4 != 0 then c_mktsegment end as name, c_custkey % 4 = 0 as damaged from customer"),
}
