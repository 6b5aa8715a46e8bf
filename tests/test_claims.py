"""Claims over typed queries and protected spans, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parchmint.functions import claims

LAWS = [("Clean Air Act", "law_name", "air"), ("Clean Air Act of 1970", "law_name", "air70"), ("CAA", "acronym", "air"), ("CAA", "acronym", "appropriations"), ("Section 106", "issue", "review"), ("E.O. 13175", "issue", "consultation")]
TYPED = [
    ("docket EPA-HQ-OAR-2022-0829", "docket EPA-HQ-OAR-2022-0829 federal", False), ("RIN 1018-BG39", "rin 1018-BG39 federal", False), ("FR doc 2023-09876", "fr_document 2023-09876 federal", False), ("2025-2026 plans", "", False),
    ("40 C.F.R. § 131.10", "cfr 40 131.10 federal", False), ("25 USC 450f et seq.", "usc 25 450f federal", False), ("PL 115-141", "public_law 115-141 federal", False), ("PL 115-141, 88 Stat. 2203", "public_law 115-141 federal;statute 88 2203 federal", True),
    ("Sample v. Georgia 699 U.S. 515", "us_reports 699 515 federal", False), ("hr 1234 119", "federal_bill hr 1234 119 federal", False), ("S. 99 119", "federal_bill s 99 119 federal", False), ("S1001", "state_bill S1001 ID;federal_bill s 1001 federal", True), ("S1001 Idaho", "state_bill S1001 ID", False),
    ("HB 2500", "state_bill HB 2500 WA;state_bill HB 2500 OR", True), ("OR HB 2500", "state_bill HB 2500 OR", False), ("SB 5500 WA", "state_bill SB 5500 WA", False), ("HB 1234", "state_bill HB 1234 WA", True), ("Oregon HB 1234", "", False), ("Oregon City HB 1234", "state_bill HB 1234 WA", True), ("Washington SB 5100 2025-26", "state_bill SB 5100 2025-26 WA", False),
    ("WAC 173-201A", "state_code WAC 173-201A WA", False), ("Idaho Code § 67-5201", "state_code IDAHO CODE 67-5201 ID", False), ("No. 98-451 Supreme Court", "court_docket 98-451 supreme", False), ("Ninth Circuit 21-35000", "court_docket 21-35000 ca9", False), ("98-451", "public_law 98-451 federal;court_docket 98-451 supreme;court_docket 98-451 circuit", True),
    ("clean  air act of 1970", "law_name air70 federal", False), ("the CAA", "law_name air federal;law_name appropriations federal", True), ("the caa", "", False), ("E.O. 13175", "executive_order E.O. 13175 federal;issue consultation federal", True), ("section 106 review", "issue review federal", False), ("Unclean Air Actors", "", False), ("", "", False), (None, "", False), ("id or wa", "", False),
]


@pytest.fixture(scope="module")
def laws(spark):
    return spark.createDataFrame(LAWS, "name string, kind string, target string")


def test_typed_queries(spark, laws):
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(TYPED)], "id long, q string")
    got = {r["id"]: (";".join(" ".join(x) for x in r["readings"]), r["ambiguous"]) for r in claims.routes(queries, "id", "q", claims.claims(queries, "id", "q", laws)).collect()}
    assert {q: got[i] for i, (q, _, _) in enumerate(TYPED)} == {q: (r, a) for q, r, a in TYPED}


def test_first_claim_wins_in_every_order_of_candidates(spark, laws):
    """Claims are what a plain loop takes from the candidates sorted by form and place, however they come."""
    rng = random.Random(2)
    parts = ["25 U.S.C. 450", "HB 2500", "Clean Air Act", "98-451", "and", "Pub. L. 93-638", "2024-28302", "S. 12", "CAA", "EPA-2023-0017"]
    typed = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    queries = spark.createDataFrame(list(enumerate(typed)), "id long, q string")
    found = [(r["id"], r["form"], r["start"], r["stop"]) for r in claims.candidates(queries, "id", "q").collect()]
    names = claims.name_hits(queries, "id", "q", laws.select("name", "kind").distinct()).collect()
    found += [(r["id"], {"law_name": 0, "acronym": len(claims.KINDS) - 2, "issue": len(claims.KINDS) - 1}[r["kind"]], r["start"], r["stop"]) for r in names]
    want = {}
    for i in range(len(typed)):
        mine = [f[1:] for f in found if f[0] == i]
        rng.shuffle(mine)
        kept = []
        for _, start, stop in sorted(mine, key=lambda f: (f[0], f[1] - f[2] if f[0] == 0 else 0, f[1])):
            if all(stop <= a or b <= start for a, b in kept):
                kept.append((start, stop))
        want[i] = sorted(kept)
    got = {i: [] for i in range(len(typed))}
    islands = {i: [] for i in range(len(typed))}
    for r in claims.claims(queries, "id", "q", laws).orderBy("id", "place").collect():
        got[r["id"]].append((r["start"], r["stop"]))
        islands[r["id"]].append(r["island"])
    assert got == want
    for i, spans in got.items():
        fresh = [1 if not k or typed[i][spans[k - 1][1] : s].strip() else 0 for k, (s, _) in enumerate(spans)]
        assert islands[i] == [sum(fresh[: k + 1]) for k in range(len(spans))]


def test_names_stand_as_whole_words(spark):
    names = ["Nez Perce", "O'odham", "ABC", "perce tribe"]
    texts = ["the NEZ\n  perce tribe", "Nez Percean", "tohono o'odham land", "ABC abc", "", None, "x nez-perce"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame([(n, "law_name") for n in names], "name string, kind string")
    got = {(r["id"], texts[r["id"]][r["start"] : r["stop"]], r["name"]) for r in claims.name_hits(rows, "id", "t", table).collect()}
    assert got == {(0, "NEZ\n  perce", "Nez Perce"), (0, "perce tribe", "perce tribe"), (2, "o'odham", "O'odham"), (3, "ABC", "ABC"), (6, "nez-perce", "Nez Perce")}


def test_protected_spans_grow_from_anchors(spark):
    texts = {
        "The Confederated Salish and Kootenai Tribes met.": "nation_name", "of the Nez Perce Tribe of Idaho today": "nation_name", "a diatribe of the village": None, "Old Harbor Village": "nation_name", "the Sampletribe rule": "nation_name",
        "Treaty of Point Elliott, 1855": "treaty_title", "treaty with the Walla Walla": "treaty_title", "Smith v. Georgia Pacific": "case_caption", "v. Georgia": None, "": None,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    spans = claims.protected(rows, "id", "t")
    got = {r["id"]: (r["kind"]) for r in spans.collect()}
    assert {t: got.get(i) for i, t in enumerate(texts)} == texts
    hidden = {r["id"]: r["masked"] for r in claims.masked(rows, "id", "t", spans).collect()}
    assert hidden[0] == "The " + " " * 39 + " met." and all(len(hidden[i]) == len(t) for i, t in enumerate(texts))
    both = claims.protected(rows.filter("id = 3").withColumn("t", F.lit("Old Harbor Village  makah coast")), "id", "t", spark.createDataFrame([("Makah",)], "name string"))
    assert [tuple(r)[1:] for r in both.collect()] == [(0, 25, "nation_name")]
