"""Edge cases of the operators on hand-made tables."""

import itertools
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmint.functions import citations, issues, labels
from parchmint.functions import text as T
from parchmint.operators import corpus, graph, records, refresh, retrieval, spatial, temporal, validate
from parchmint.plans import federation
from parchmint.sources import html, sinks
from parchmint.streaming import events


def test_date_bounds(spark):
    rows = [("2024", "year"), ("2024-02", "month"), ("2024-02-29", "day"), (None, "unknown"), ("2023-02-30", "day")]
    df = spark.createDataFrame(rows, "value string, precision string")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    got = df.select(text(temporal.lower_bound(F.col("value"), F.col("precision"))), text(temporal.upper_bound(F.col("value"), F.col("precision")))).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-01 00:00:00.000", "2024-12-31 23:59:59.999"),
        ("2024-02-01 00:00:00.000", "2024-02-29 23:59:59.999"),
        ("2024-02-29 00:00:00.000", "2024-02-29 23:59:59.999"),
        (None, None),
        (None, None),
    ]


def test_versions_with_ties_and_unknown_dates(spark):
    t = lambda d: f"{d} 00:00:00"
    rows = [(1, 10, t("2020-01-01"), t("2020-03-01"), t("2020-03-02")), (1, 11, t("2020-01-01"), t("2020-01-01"), t("2020-03-01")), (2, 20, t("2020-01-01"), t("2020-01-01"), t("2020-01-02")), (3, 30, t("2020-01-01"), None, None), (4, 40, t("2020-01-01"), t("2022-01-01"), t("2022-01-01")), (5, 50, t("2020-01-01"), t("2020-12-01"), t("2021-02-01"))]
    v = spark.createDataFrame(rows, "work long, version long, o string, a string, b string").select("work", "version", *(F.col(x).cast("timestamp").alias(y) for x, y in (("o", "observed"), ("a", "p_low"), ("b", "p_high"), ("a", "v_low"), ("b", "v_high"))))
    none = spark.createDataFrame([], "version long, type string, low timestamp, high timestamp")
    judged = temporal.as_of(v, none, "2020-12-31", "source_available")
    reasons = {r["version"]: r["reason"] for r in judged.collect()}
    assert reasons == {10: None, 11: None, 20: None, 30: "unknown_source_availability", 40: "future_source_version", 50: "partial_date_crosses_cutoff"}
    got = {r["work"]: (r["state"], r["versions"]) for r in temporal.select_versions(judged, v).collect()}
    assert got == {1: ("ambiguous", "10,11"), 2: ("supported_source_snapshot", "20"), 3: ("unknown", ""), 4: ("unknown", ""), 5: ("unknown", "")}
    effective = {r["reason"] for r in temporal.as_of(v, none, "2020-12-31", "source_effective").filter("version < 30").collect()}
    assert effective == {"no_source_effective_event_by_cutoff"}


def test_stems(spark):
    words = ["policies", "churches", "lands", "status", "treated", "running", "election", "totally", "cat", "déjà", "houses", "boxes"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(zip(words, (r[0] for r in df.select(T.fold(F.col("w"))).collect())))
    assert (got["policies"], got["churches"], got["lands"], got["status"], got["cat"], got["election"]) == ("policy", "church", "land", "status", "cat", "elect")
    assert all(len(s) >= 3 for s in got.values())


def test_search_phrase_and_terms(spark):
    docs = spark.createDataFrame([(1, "s", "en", "tribal consultation policy\nother words here"), (2, "s", "en", "policy consultation tribal"), (3, "s", "en", "nothing"), (4, "s", "en", None)], "doc_id long, source string, lang string, text string")
    p = retrieval.passages(docs)
    assert p.count() == 4
    both = retrieval.search(p, ["tribal", "policy"], 10).collect()
    assert {(r["doc_id"], r["pos"]) for r in both} == {(1, 0), (2, 0)}
    assert [r["doc_id"] for r in retrieval.search(p, ["tribal", "policy"], 10, phrase=["tribal", "consultation"]).collect()] == [1]
    assert retrieval.search(p, ["tribal", "absent"], 10, all_terms=True).collect() == []
    assert retrieval.search(p.filter("doc_id = 9"), ["tribal"], 10).collect() == []


def test_merge_keeps_null_matches_apart_and_first_places(spark):
    rows = [("a", "s1", 1, 1, "m"), ("b", "s2", 2, 1, "m"), ("c", "s1", 1, 2, None), ("d", "s2", 2, 2, None), ("a", "s2", 2, 3, "m")]
    schema = "listing string, source string, precedence int, rank int, match string"
    want = None
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 29):
        got = sorted(map(tuple, records.merge_listings(spark.createDataFrame(list(order), schema)).collect()))
        want = want or got
        assert got == want
    assert want == [("listing:c", 2, "c", 0), ("listing:d", 2, "d", 0), ("match:m", 1, "a", 1)]


def test_facets_and_ranges(spark):
    df = spark.createDataFrame([(1, "x", "2020-01-01"), (2, "y", None), (3, "x", "2021-01-01")], "id long, f string, d string").withColumn("d", F.to_date("d"))
    assert {r["id"] for r in records.facet_filter(df, {"f": []}).collect()} == {1, 2, 3}
    assert {r["id"] for r in records.facet_filter(df, {"f": ["x", "y"]}, between=("d", None, "2020-12-31")).collect()} == {1}


def test_refresh_states(spark):
    prior = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    fresh = spark.createDataFrame([("a", 9, True), ("b", 8, False), ("c", 7, False), ("d", 6, True)], "k string, v int, ok boolean")
    got = {r["k"]: (r["v"], r["state"]) for r in refresh.last_known_good(prior, fresh, "k", "v", "ok").collect()}
    assert got == {"a": (9, "healthy"), "b": (2, "degraded"), "c": (None, "unavailable"), "d": (6, "healthy")}
    once = refresh.last_known_good(prior, fresh, "k", "v", "ok").filter("state != 'unavailable'").select("k", "v")
    again = {r["k"]: r["v"] for r in refresh.last_known_good(once, fresh, "k", "v", "ok").collect()}
    assert again == {"a": 9, "b": 2, "c": None, "d": 6}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 4, 9: 4, 7: 7}
    assert graph.connected_components(edges.filter("a = 99")).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}
    near = graph.reach(edges.withColumnsRenamed({"a": "src", "b": "dst"}), spark.createDataFrame([(9,)], "node long"), 2)
    assert {tuple(r) for r in near.collect()} == {(9, 0), (8, 1), (5, 2)}
    refs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4)], "id long, ref long")
    assert {r["id"] for r in graph.shrink(refs, "id", "ref").collect()} == {1, 2, 3}
    refs = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 201), (201, 200)], "id long, ref long")
    assert {r["id"] for r in graph.shrink(refs, "id", "ref").collect()} == {*range(1, 60), 200, 201}
    needs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "node long, needed long")
    assert {r["node"] for r in corpus.closure(spark.createDataFrame([(1,)], "node long"), needs).collect()} == {1, 2, 3}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 6), (6, 5), (7, 7), (8, 1)], "src long, dst long")
    assert {r["node"] for r in graph.cycles(ring).collect()} == {4, 5, 6, 7}
    paths = graph.shortest_paths(spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long"), spark.createDataFrame([(1,)], "node long"), 5)
    assert {r["node"]: r["path"] for r in paths.collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 2, 4]}


def brute_relation(a, b):
    ax0, ax1, ay0, ay1 = a
    bx0, bx1, by0, by1 = b
    if ax1 < bx0 or bx1 < ax0 or ay1 < by0 or by1 < ay0:
        return "disjoint"
    if ax1 == bx0 or bx1 == ax0 or ay1 == by0 or by1 == ay0:
        return "touches"
    if ax0 < bx0 and bx1 < ax1 and ay0 < by0 and by1 < ay1:
        return "contains"
    return "within" if bx0 < ax0 and ax1 < bx1 and by0 < ay0 and ay1 < by1 else "intersects"


def test_tolerant_relations_equal_all_shifts(spark):
    pairs = [((0, 10, 0, 10), b) for b in [(20, 30, 0, 5), (12, 20, 0, 9), (11, 20, 0, 9), (3, 7, 3, 7), (4, 6, 4, 6), (1, 9, 1, 9), (5, 30, 5, 30), (-20, 40, -20, 40), (0, 10, 0, 10), (-5, 15, 3, 7)]]
    names = [f"{n}{k}" for n in "ab" for k in ("x0", "x1", "y0", "y1")]
    df = spark.createDataFrame([a + b for a, b in pairs], ", ".join(f"{n} long" for n in names))
    got = [r[0] for r in df.select(spatial.tolerant_relation("a", "b", 1)).collect()]
    for (a, b), g in zip(pairs, got):
        seen = {brute_relation(tuple(x + d for x, d in zip(a, da)), tuple(x + d for x, d in zip(b, db))) for da in itertools.product((-1, 1), repeat=4) for db in itertools.product((-1, 1), repeat=4)} | {brute_relation(a, b)}
        assert g == (seen.pop() if len(seen) == 1 else "ambiguous"), (a, b)


def test_citations_do_not_overlap():
    found = citations.find("See 25 U.S.C. § 5301 and 40 CFR part 1502, Pub. L. No. 93-638, 61 Fed. Reg. 18840; 515 U.S. 277.")
    assert [f[:3] for f in found] == [("usc", "25", "5301"), ("cfr", "40", "1502"), ("public_law", "93", "638"), ("register", "61", "18840"), ("reports", "515", "277")]
    assert citations.find(None) == []


@given(st.text(alphabet="25 U.S.C. § 1 CFR93-6AF", max_size=60))
@settings(max_examples=60, deadline=None)
def test_citation_spans_are_disjoint(text):
    spans = [f[3:] for f in citations.find(text)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_whole_texts_decide_matches(spark, tmp_path):
    lead = "the same beginning of a page " * 5
    texts = [lead + "one end", lead + "another end", "short copy", "Short \n copy", lead + "one  end", None, "xshort copy it is", "a word"]
    docs = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, lead + "one end"), (2, lead + "no such end"), (3, "short copy"), (4, "copy it is"), (5, ""), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    merged = records.QUERIES["rank_interleave_merge"][0](spark, str(tmp_path)).collect()
    assert sorted(r["alternates"] for r in merged) == [0, 0, 0, 0, 1, 1]
    lanes = federation.QUERIES["merged_lanes"][0](spark, str(tmp_path)).collect()
    assert sorted(r["alternates"] for r in lanes) == [0, 0, 0, 0, 1, 1]
    got = records.QUERIES["in_text_group_places"][0](spark, str(tmp_path)).collect()
    want = {i: [d for d, t, *_ in docs if t and p in t] for i, p in items if p}
    assert {tuple(r) for r in got} == {(i, min(h), len(h)) for i, h in want.items() if h}


def test_whole_tables_are_read(spark, tmp_path):
    rng = random.Random(5)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda module, name: [tuple(r) for r in module.QUERIES[name][0](spark, str(tmp_path)).collect()]
    kinds = ["click", "view", "purchase", "refund"]
    log = [(i, rng.randrange(80), rng.choice(kinds), rng.choice("ab")) for i in range(1, 1301)]
    put("events", [(i, u, t, f'{{"k": "{k}"}}') for i, u, t, k in log], "event_id long, user_id long, event_type string, props string")
    coded = {(u, t): ",".join(sorted({k for _, v, s, k in log if (v, s) == (u, t)})) for u in {r[1] for r in log} for t in kinds}
    assert sorted(run(records, "dimension_pivot")) == sorted((u, t, "coded" if v else "not_coded_unknown", v) for (u, t), v in coded.items())
    assert sorted(run(refresh, "revision_state")) == sorted((u, i, t) for u, (i, t) in {u: (i, t) for i, u, t, _ in log if i <= 650}.items())
    sizes = {k: rng.randint(1, 50) for k in range(1, 121)}
    put("part", list(sizes.items()), "p_partkey long, p_size int")
    box = lambda k, fx, fy: (k * fx % 1000, k * fx % 1000 + sizes[k], k * fy % 1000, k * fy % 1000 + 2 * sizes[k])
    pairs = Counter(brute_relation(box(a, 37, 91), box(b, 53, 29)) for a in sizes for b in sizes)
    assert dict(run(spatial, "box_overlap_join")) == {k: n for k, n in pairs.items() if k != "disjoint"}
    put("documents", [(1, "once twice\ntwice twice", "en", "s"), (2, "rare", "en", "s")], "doc_id long, text string, lang string, source string")
    assert dict(run(retrieval, "term_df")) == {"once": 1, "twice": 2, "rare": 1}
    put("supplier", [(k,) for k in range(1, 150)], "s_suppkey long")
    assert {r[0] for r in run(graph, "supersession_tips")} == set(range(1, 150)) - {(k * 3 + 1) % 97 for k in range(1, 150)}


def test_citation_counts_scan_whole_texts(spark, tmp_path):
    late = "words " * 30
    texts = [late + "see 25 U.S.C. 450 and 40 CFR 1502.4", late + "88 Stat. 2203 " + late + "61 FR 18840 ", "", None, "515 U.S. 277, " + late]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cites = [" 25 U.S.C. 450", " 40 CFR 1502.4", " Pub. L. 93-638", " 88 Stat. 2203", " 61 FR 18840", " 515 U.S. 277", " 1076-AF18"]
    got = {r["doc_id"]: r.asDict() for r in citations.QUERIES["citation_counts"][0](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        kinds = [h[0] for h in citations.find(t + cites[i % 7])] if t is not None else None
        assert all(got[i][f"n_{k}"] == (kinds.count(k) if kinds is not None else None) for k in citations.PATTERNS)


def test_blocks(spark):
    page = "<html><title>T</title><script>no</script><h1>One &amp; all</h1><p>a <b>b</b><br>é</p><nav><p>menu</p></nav><ul><li>x<li>y</ul></html>"
    assert html.read_blocks(page) == [("title", "T"), ("h1", "One & all"), ("p", "a b é"), ("li", "x"), ("li", "y")]
    rows = html.blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["start"], r["end"], r["heading"]) for r in rows] == [(0, 1, None), (3, 12, None), (14, 20, "One & all"), (22, 23, "One & all"), (25, 26, "One & all")]


def test_typo_suggestions(spark):
    names = ["Navajo Nation", "Nevada", "Oregon", "Coos Bay", "Oregon City"]
    labels_ = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, place int")
    typed = spark.createDataFrame([("navaho",), ("nav",), ("oregonn",), ("roegon",), ("orgeon",), ("OERGON",), ("coso",), ("nevade nat",), ("oregon cti",), ("oregon ctiy",)], "typed string")
    got = {}
    for r in labels.possible(typed, labels_).collect():
        got.setdefault(r["typed"], []).append((r["label"], r["edits"]))
    # Swaps are one edit, the first letter stays, short capitals allow none, the last word may be a start.
    assert {k: sorted(v) for k, v in got.items()} == {"navaho": [("Navajo Nation", 1)], "nav": [("Navajo Nation", 0)], "oregonn": [("Oregon", 1), ("Oregon City", 1)], "orgeon": [("Oregon", 1), ("Oregon City", 1)], "coso": [("Coos Bay", 1)], "oregon ctiy": [("Oregon City", 1)]}
    ranked = {(r["typed"], r["label"]): (r["tier"], r["extra"]) for r in labels.ranked(spark.createDataFrame([("oregon",), ("ore",), ("nation nav",)], "typed string"), labels_).collect()}
    assert ranked == {("oregon", "Oregon"): (0, 0), ("oregon", "Oregon City"): (1, 1), ("ore", "Oregon"): (2, 0), ("ore", "Oregon City"): (2, 1), ("nation nav", "Navajo Nation"): (2, 0)}


def test_issue_rules(spark):
    text = "The agency will consult with each Indian Tribe. See 40 CFR part 1502 and the E.O. Handbook. Comments are due by March 5, 2024. It is a pro- posed rule. It is a pro- posed rule."
    rows = issues.issues(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " ".join(f"Tribe number {i} met." for i in range(9)))], "doc_id long, text string"), "doc_id", "text").collect()
    got = {(r["doc_id"], r["kind"], r["n"]): r["quote"] for r in rows}
    assert {k for k in got if k[0] == 1} == {(1, "consultation", 1), (1, "tribal", 1), (1, "cross_reference", 1), (1, "deadline", 1), (1, "status", 1)}
    assert got[1, "status", 1] == "It is a proposed rule." and got[1, "cross_reference", 1].endswith("E.O. Handbook.")
    assert sum(k[0] == 4 for k in got) == issues.PER_KIND and not any(k[0] in (2, 3) for k in got)
    long = "word " * 200 + "the Tribe met " + "more " * 200
    quote = issues.issues(spark.createDataFrame([(1, long)], "doc_id long, text string"), "doc_id", "text").first()["quote"]
    assert "Tribe" in quote and len(quote) <= issues.QUOTE and quote in long and quote == quote.strip()


def test_segments_and_replay(spark):
    import hashlib

    text = "aé𝄞b"
    data = text.encode()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = [(1, 9, 0, 3, sha(data[:3])), (2, 9, 0, 2, sha(data[:2])), (3, 9, 3, 99, ""), (4, 9, 3, 7, sha(b"x")), (5, 9, 4, 7, sha(data[4:7])), (6, 9, 7, 8, sha(b"b")), (7, 9, 2, 2, sha(b""))]
    segments = spark.createDataFrame(rows, "segment long, rendition long, start long, end long, digest string")
    texts = spark.createDataFrame([(9, text)], "rendition long, text string")
    assert {tuple(r) for r in validate.segment_faults(segments, texts).collect()} == {(2, "boundary"), (3, "range"), (4, "digest"), (5, "boundary"), (7, "range")}
    cites = spark.createDataFrame([(1, 9, 1, 7, "é𝄞", sha(data)), (2, 9, 1, 7, "é", sha(data)), (3, 9, 1, 3, "é", "x"), (4, 8, 0, 1, "a", sha(data))], "citation long, rendition long, start int, end int, quote string, text_digest string")
    assert {tuple(r) for r in validate.replayed(cites, texts).collect()} == {(1, True), (2, False), (3, False), (4, False)}


def test_effective_dates_that_overlap_are_no_tie(spark):
    stamp = lambda t: None if t is None else __import__("datetime").datetime.fromisoformat(t)
    versions = spark.createDataFrame([("w", 1, *map(stamp, ("2020-01-01", "2020-01-01", "2020-01-01T23:59:59.999", None, None))), ("w", 2, *map(stamp, ("2020-01-01", "2020-01-01", "2020-01-01T23:59:59.999", None, None)))], "work string, version long, observed timestamp, p_low timestamp, p_high timestamp, v_low timestamp, v_high timestamp")
    dated = spark.createDataFrame([(1, "effective", *map(stamp, ("2020-03-01", "2020-03-31T23:59:59.999"))), (2, "effective", *map(stamp, ("2020-03-15", "2020-03-15T23:59:59.999")))], "version long, type string, low timestamp, high timestamp")
    got = temporal.select_versions(temporal.as_of(versions, dated, "2021-01-01", "source_effective"), versions).first()
    assert (got["state"], got["versions"]) == ("supported_source_snapshot", "1")


def test_written_files(spark, tmp_path):
    from parchmint.sources import sinks

    rows = spark.createDataFrame([(1, '=1+"2"'), (2, None)], "id long, x string").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"), ["id", "x"])
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert data == b'"id","x"\r\n"1","\'=1+""2"""\r\n"2",""\r\n'
    entry = sinks.calendar(spark.createDataFrame([(7, __import__("datetime").date(2024, 5, 1), "é, " * 60)], "n long, day date, title string"), "n", "day", "title").first()["entry"]
    lines = entry.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and max(len(x.encode()) for x in lines) > 72 and "\n" not in entry.replace("\r\n", "")
    unfolded = entry.replace("\r\n ", "")
    assert "SUMMARY:" + "é\\, " * 60 in unfolded
    a = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "asset string, content string")
    one = {r["asset"]: r["digest"] for r in sinks.manifest(a, "asset", "content").collect()}
    two = {r["asset"]: r["digest"] for r in sinks.manifest(a.orderBy(F.desc("content")), "asset", "content").collect()}
    assert one == two and one["a"] != {r["asset"]: r["digest"] for r in sinks.manifest(a.filter("content != 'y'"), "asset", "content").collect()}["a"]


def test_personal_data_kinds(spark):
    from parchmint.functions import guards

    texts = {"email": "a.b@c.org", "spelled_email": "x [at] y [dot] gov", "phone": "(503) 555-0123", "extension": "ext. 4521", "person_title": "Dr. Longname", "contact_lead": "Contact: Anna B. Smith", "postal_block": "12 Main Street, Salem, OR 97301"}
    docs = spark.createDataFrame([*enumerate(texts.values()), (90, "OAR 340-041-0001 and 12.5 x1 Honor"), (91, None)], "id long, t string")
    got = {r["id"]: r.asDict() for r in docs.select("id", *(c.alias(k) for k, c in guards.personal(F.col("t")).items())).collect()}
    for i, kind in enumerate(texts):
        assert [k for k in texts if got[i][k]] == [kind]
    assert not any(got[i][k] for i in (90, 91) for k in texts)


def test_citations_of_all_kinds():
    text = "25 U.S.C. 450, 451 and 452a, 40 CFR 1500-1508, 42 U.S.C. 4321 et seq., RCW 43.376.020, ORS 182.164, Executive Order 13175, /us/pl/93/638"
    got = [(k, t, n, m) for k, t, n, m, *_ in citations.find(text)]
    assert got == [("usc", "25", "450", ""), ("usc", "25", "451", ""), ("usc", "25", "452a", ""), ("cfr", "40", "1500", "1508"), ("usc", "42", "4321", "et seq."), ("washington", "43", "376.020", ""), ("oregon", "182", "164", ""), ("executive_order", "Order", "13175", ""), ("uslm_public_law", "93", "638", "")]
    assert citations.find(None) == []


def test_written_tables_are_swept(spark):
    from parchmint import session

    made = session.materialize(spark.range(3), "swept")
    folder = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    kept = session._WRITTEN[spark.sparkContext.applicationId]
    session._WRITTEN[spark.sparkContext.applicationId] = [p for p in kept if "swept" in p]
    session.sweep(spark)
    session._WRITTEN[spark.sparkContext.applicationId] = [p for p in kept if "swept" not in p]
    assert not os.path.isdir(folder)


def test_search_over_an_index(spark):
    from parchmint.operators import search

    lines = {1: ["Water rights", "The agency grants licenses for water", "Tribal consultation is due"], 2: ["Mining", "A license to mine, no water right", "water water water"], 3: ["Empty", "nothing at all"], 4: ["Consultation of tribes", "mit license text"]}
    rows = spark.createDataFrame([(v, i, t) for v, ts in lines.items() for i, t in enumerate(ts)], "version long, pos int, text string")
    entries = spark.createDataFrame([(v, f"w{v % 2}", ts[0], [f"DOC-{v}"], "en" if v < 4 else "de") for v, ts in lines.items()], "version long, work string, title string, identifiers array<string>, lang string")
    index = search.build(rows, entries, F.col("pos") == 0, 4)
    found = lambda **k: [r["version"] for r in search.search(index, search.Request(**k)).select("version", "place").distinct().orderBy("place").collect()]
    assert found(query="the licensed") == found(query="license") and set(found(query="license")) == {1, 2, 4}
    assert found(query='"mit license"') == [4] and found(query='"license mit"') == []
    assert set(found(query="license water", all_terms=True)) == {1, 2} and found(query="license", facets={"lang": "de"}) == [4]
    assert found(query="license", versions=spark.createDataFrame([(2,), (3,)], "version long")) == [2]
    assert found(query="doc 3") == [3] and found(query="license", limit=1) == found(query="license")[:1]
    assert found(query="") == [] and found(query="the of and") == [] and found(query="zebra") == []
    best = search.best_passages(index, ["water"], 2).collect()
    assert [(r["version"], r["pos"]) for r in best][0] == (2, 2)


def test_checks(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert [tuple(r) for r in validate.same_rows(a, a).collect()] == []
    assert {tuple(r) for r in validate.same_rows(a, a.distinct()).collect()} == {("left", 1)}
    assert [tuple(r) for r in validate.duplicate_ids({"a": a, "b": spark.createDataFrame([(2,)], "id long")}).orderBy("id").collect()] == [(1, 2, "a"), (2, 2, "a,b")]


def test_csv_cells(spark):
    df = spark.createDataFrame([("=1+1", 'a "b"', None)], "x string, y string, z string")
    assert df.select(sinks.csv_line("x", "y", "z")).first()[0] == '"\'=1+1","a ""b""",""'


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i % 3, "click") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = events.window_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, events.window_counts(df, "1 hour").collect()))
    events.upsert(df, str(tmp_path / "state"), "user_id", "event_id")
    events.upsert(df.withColumn("event_id", F.col("event_id") + 100), str(tmp_path / "state"), "user_id", "event_id")
    at, rows = events.current(spark, str(tmp_path / "state"))
    assert at == 1 and {r["event_id"] for r in rows.collect()} == {127, 128, 129}
    # A crash leaves a version without its mark: the next run builds on the one before it.
    (tmp_path / "state/v2").mkdir()
    assert events.current(spark, str(tmp_path / "state"))[0] == 1
    events.upsert(df.filter("user_id = 0").withColumn("event_id", F.col("event_id") + 200), str(tmp_path / "state"), "user_id", "event_id")
    assert {r["event_id"] for r in events.current(spark, str(tmp_path / "state"))[1].collect()} == {227, 128, 129}
    events.upsert(df, str(tmp_path / "state"), "user_id", "event_id", batch_id=2)  # a batch that has been taken
    assert events.current(spark, str(tmp_path / "state"))[0] == 2
    assert events.current(spark, str(tmp_path / "nowhere")) == (-1, None)


@pytest.mark.parametrize("gone", [True])
def test_library_stands_without_the_subpackage(gone, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "parchmint", tmp_path / "parchmint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-800:]
