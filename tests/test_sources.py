"""Markup, XML rows, written indexes, wording and personal data: plain walks and fixtures."""

import random
import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from parchmint.functions import citations, guards, issues
from parchmint.operators import search
from parchmint.sources import feeds, markup


def plain_blocks(root):
    """(locator, text) of the blocks of a well-formed tree, by recursion."""
    out = []

    def has_block(e):
        return any(c.tag in markup.BLOCKS or has_block(c) for c in e)

    def inline(e):
        return (e.text or "") + "".join(inline(c) + (c.tail or "") for c in e)

    def walk(e, path):
        if e.tag in markup.BLOCKS and not has_block(e):
            text = " ".join(inline(e).split())
            if text:
                out.append((path, text))
            return
        counts, k, run = {}, 0, e.text or ""
        for c in e:
            counts[c.tag] = counts.get(c.tag, 0) + 1
            at = f"{path}/{c.tag}[{counts[c.tag]}]"
            if c.tag in markup.BLOCKS:
                if run.strip():
                    k += 1
                    out.append((f"{path}/text-run[{k}]", " ".join(run.split())))
                walk(c, at)
                run = c.tail or ""
            else:
                run += inline(c) + (c.tail or "")
        if run.strip():
            out.append((f"{path}/text-run[{k + 1}]", " ".join(run.split())))

    walk(root, "/main[1]")
    return out


def random_tree(rng, depth=0):
    """Markup without implied ends: divs and sections in each other, paragraphs, lists and inline elements at the leaves."""
    words = lambda: " ".join(rng.choice(["a", "é𝄞", "x", "of"]) for _ in range(rng.randrange(0, 3)))
    inline = lambda: words() + rng.choice(["", "<b>" + words() + "</b>", "<i><b>k</b></i>"]) + words()
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(5)
        if kind == 0 and depth < 3:
            tag = rng.choice(["div", "section", "blockquote"])
            out.append(f"<{tag}>{random_tree(rng, depth + 1)}</{tag}>")
        elif kind == 1:
            out.append("<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(2)) + "</ul>")
        elif kind == 2:
            out.append(f"<p>{inline()}</p>")
        elif kind == 3:
            out.append(f"<h2>{inline()}</h2>")
        else:
            out.append(inline())
    return " ".join(out)


def test_block_tree_equals_a_plain_walk(spark):
    rng = random.Random(11)
    pages = [f"<main>{random_tree(rng)}</main>" for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in markup.block_tree(rows, base=None).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["locator"], r["text"]))
        source = pages[r["page_id"]].encode()[r["start"] : r["stop"]].decode()
        assert " ".join(re.sub("<[^>]*>", "", source).split()) == r["text"]
    assert got == {i: b for i, p in enumerate(pages) if (b := plain_blocks(ET.fromstring(p)))}


def test_headings_stand_above_until_one_of_their_level(spark):
    page = "<h1>A</h1><h3>B</h3>x<h2>C</h2><p>y<h3>D</h3>z<h2>E<p>w<h1>F</h1><table><caption>G</caption><tr><td>1<td>2<tr><th>3</table>"
    rows = markup.block_tree(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), base=None).orderBy("pos").collect()
    assert [(r["text"], r["headings"]) for r in rows][:7] == [("A", []), ("B", ["A"]), ("x", ["A", "B"]), ("C", ["A"]), ("y", ["A", "C"]), ("D", ["A", "C"]), ("z", ["A", "C", "D"])]
    assert [(r["text"], r["kind"]) for r in rows][-3:] == [("G", "heading"), ("1 | 2", "table_row"), ("3", "table_row")]


@pytest.mark.parametrize("page", ["</p></div>", "<p", "<a href='x", "<!-- open", "<script>x</p>", "<p><p><b></i>t</b></p></p>", "<<p>", "<table><td>x", "a < b & c &amp; &nope;"])
def test_malformed_markup_never_fails(spark, page):
    runs = markup.read_runs(page)
    assert ("x" in "".join(r[4] for r in runs)) == (page in ("<a href='x", "<table><td>x"))
    assert all(0 <= r[8] <= r[9] <= len(page) for r in runs)


def test_xml_items_keep_their_fields(spark):
    body = "<r><i n='7'><x>1</x></i><i><x>2</x><y>b</y><y>c</y></i><i/></r>"
    rows = spark.createDataFrame([(1, body), (2, None), (3, "busy"), (4, "<r><i>")], "k long, b string")
    got = feeds.xml_rows(rows, "k", "b", "/r/i", {"x": "x", "y": "y", "all": "y[]", "n": "@n"}).orderBy("pos").collect()
    assert [tuple(r) for r in got if r["k"] == 1] == [(1, 0, "1", None, [], "7"), (1, 1, "2", "b", ["b", "c"], None), (1, 2, None, None, [], None)][: len([r for r in got if r["k"] == 1])]
    assert {r["k"] for r in got} == {1}
    code = spark.createDataFrame([(1, "<c><section identifier='a'><content><p>A</p><p>B</p></content></section><section identifier='b'><heading>H</heading></section></c>")], "k long, b string")
    assert [tuple(r)[1:] for r in feeds.sections(code, "k", "b").orderBy("identifier").collect()] == [("a", None, "A\nB"), ("b", "H", "")]


def test_the_index_follows_its_files(spark, tmp_path):
    from parchmint import session

    docs = spark.createDataFrame([(1, "alpha tribal license\nbeta", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one = search.index_of(spark, str(tmp_path))
    assert search.index_of(spark, str(tmp_path)) is one
    assert search.best_passages(one, ["alpha"], 9).count() == 1
    docs.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert search.best_passages(search.index_of(spark, str(tmp_path)), ["alpha"], 9).count() == 2
    application, kept = spark.sparkContext.applicationId, session._WRITTEN.pop(spark.sparkContext.applicationId)
    session.sweep(spark)
    assert not [k for k in search._INDEXES if k[0] == application]
    session._WRITTEN[application] = kept
    assert search.best_passages(search.index_of(spark, str(tmp_path)), ["alpha"], 9).count() == 2


def test_overlapping_citations_are_found_in_linear_time():
    text = "25 U.S.C. 450, 451 and 452; 40 CFR 1502.4. " * 20_000
    assert len(citations.find(text)) == 80_000


PERSONAL = [
    ("write to a.b+c@example.org", "email"), ("name (at) example (dot) gov", "spelled_email"), ("jane [at] example.gov", "spelled_email"),
    ("Call (555) 010-0199", "phone"), ("555.010.0199", "phone"), ("phone: +1 555 010 0199", "phone"), ("(555) 010–0101", "phone"), ("direct line: 555 010 0199", "phone"),
    ("office, ext. 4412", "extension"), ("dial x4412", "extension"), ("Mr. Example spoke", "person_title"), ("Ms Sample replied", "person_title"), ("Hon. Example presided", "person_title"), ("MR SAMPLE", "person_title"), ("MR. SAMPLE", "person_title"),
    ("CONTACT: JANE SAMPLE", "contact_lead"), ("For further information contact Jane Q. Sample at the office", "contact_lead"), ("Attn: Jane Sample", "contact_lead"),
    ("1234 Example Street, Sampletown, WA 98501", "postal_block"), ("to 55 Sample Ave. Suite 200, Example City, Oregon 97301-1234", "postal_block"), ("P.O. Box 123, Sampleville, ID 83702", "postal_block"),
    ("MS Gulf Coast", None), ("Honor Example", None), ("Contact: Office of Lands", None), ("25 CFR 900.6 and 40 CFR part 131", None), ("WAC 173-201-0020", None), ("RIN 1076-AF81 of 12 May 2020", None), ("Sample Dr is closed", None), ("x1 and x", None),
]


def test_forms_of_personal_data(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PERSONAL)], "i int, t string")
    got = {r["i"]: [k for k in guards.FORMS if r[k]] for r in rows.select("i", *(c.alias(k) for k, c in guards.personal(F.col("t")).items())).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(PERSONAL)} == {t: [k] if k else [] for t, k in PERSONAL}


WORDING = [
    ("The agency consults Tribes.", {"consultation", "tribal"}), ("A consulting firm was paid.", set()), ("Government-to-government talks.", {"consultation"}), ("It coordinates with Indian Tribes.", {"consultation", "tribal"}),
    ("Comments are due March 5, 2024.", {"deadline"}), ("91 FR 37840 (June 24, 2026) is effective.", set()), ("BLUE January 23, 2026 Comments at 4.", set()), ("On March 5, 2024 it rained.", set()),
    ("The rule was withdrawn.", {"status"}), ("Reopening of the comment period.", {"status"}), ("See 25 U.S.C. 450 and Pub. L. 93-638.", {"cross_reference"}), ("Executive Order 13175 applies.", {"consultation", "cross_reference"}), ("A diatribe on correctness.", set()),
]


def test_wording_of_each_kind(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDING)], "i long, t string")
    got = {}
    for r in issues.issues(rows, "i", "t").collect():
        got.setdefault(r["i"], set()).add(r["kind"])
    assert {t: got.get(i, set()) for i, (t, _) in enumerate(WORDING)} == dict(WORDING)
