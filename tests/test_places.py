"""Places, references, numbers and circles that larger tables bring."""

import itertools
import tracemalloc

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from parchmint import session
from parchmint.functions import citations, claims
from parchmint.functions import text as T
from parchmint.operators import chains, intervals, search, spatial, study
from parchmint.sources import html, markup
from parchmint.streaming import sources


def test_boxes_of_one_place_are_joined_once(spark, monkeypatch):
    sides = {"a": [(0, 9, 0, 9), (5, 30, 5, 30), (100, 120, 0, 5)], "b": [(9, 20, 0, 4), (6, 8, 6, 8), (110, 111, 1, 2), (500, 501, 0, 1)]}
    boxes = {n: spark.createDataFrame(rows, f"{n}x0 int, {n}x1 int, {n}y0 int, {n}y1 int") for n, rows in sides.items()}
    meets = lambda p, q: p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
    want = sum(meets(p, q) for p, q in itertools.product(*sides.values())) * 3000 * 3000
    joined, join = [], spatial.overlap_join
    monkeypatch.setattr(spatial, "overlap_join", lambda left, right, *more: (joined.extend((left.count(), right.count())), join(left, right, *more))[1])
    many = spark.range(3000)
    got = spatial.overlap_counts(boxes["a"].crossJoin(many), boxes["b"].crossJoin(many), 60, F.lit("met"), "relation").collect()
    assert [tuple(r) for r in got] == [("met", want)] and joined == [3, 4]


def test_blocks_keep_references_that_are_cut_off():
    page = "<title>One&amp; two&amp</title><h1>x &am &unknown; &#233; &eacute</h1>"
    assert html.read_blocks(page) == [("title", "One& two&amp"), ("h1", "x &am &unknown; é &eacute")]


def test_trees_keep_references_that_are_cut_off():
    page = '<h1>One&amp; two&amp</h1><p>x &am &unknown; &#233; <a href="/q?a=1&copy=2&amp;b">l</a></p>'
    runs = markup.read_runs(page, base="https://x.org/")
    assert "".join(r[4] for r in runs) == "One& two&ampx &am &unknown; é l"
    assert {r[5] for r in runs} - {None} == {"https://x.org/q?a=1&copy=2&b"}


def test_numbers_of_many_digits(spark):
    rows = spark.createDataFrame([("FR Doc. 2024-100001",), ("FR Doc. 2024-00012",), ("FR Doc. 2024-123",)], "t string")
    assert [r[0] for r in rows.select(T.register_key(F.col("t"))).collect()] == ["2024-100001", "2024-00012", None]


def test_pages_of_many_digits_point_to_nothing(spark):
    rows = spark.createDataFrame([("88 Stat. 100004",), ("88 Stat. 2203",)], "t string").select(citations.parsed(F.col("t")).alias("p"))
    told = [f(F.col("p.kind"), F.col("p.title"), F.col("p.number")) for f in (citations.target, citations.label)]
    assert [tuple(r) for r in rows.select("p.kind", *told).collect()] == [("statutes", None, "88 Stat. 100004"), ("statutes", "/us/stat/88/2203", "88 Stat. 2203")]


def test_a_document_that_succeeds_itself_is_a_circle(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    links = spark.createDataFrame([("a", "a")], "doc string, next string")
    assert {r["doc"]: tuple(r)[1:] for r in chains.chains(docs, links).collect()} == {"a": (None, None, None, None, "circle"), "b": ("b", 1, "b", 1, "")}


def test_names_are_found_with_and_without_the_pick_before_the_join(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "under the MIT License now"), (2, "of the"), (3, None), (4, "mit licenses")], "id long, text string")
    names = spark.createDataFrame([("mit license",), ("of the",), (None,)], "n string").select(F.sha2("n", 256).alias("name_hash"))
    found = []
    for most in (0, 10_000):
        monkeypatch.setattr(study, "BEGINNINGS", most)
        found.append(sorted(r["id"] for r in study.known_names(texts, names, 2).collect()))
    assert found == [[1, 2], [1, 2]]


def test_a_page_of_many_rows_is_told_as_it_is_read():
    page = "<table>" + "".join(f'<tr><td>{i}<td><a href="/o/{i}">n</a></tr>\n' for i in range(5000)) + "</table>"
    code = "<t identifier='a'>" + "".join(f'<section identifier="/s{i}"><content><p>One <b>{i}</b></p></content></section>' for i in range(5000)) + "</t>"
    for source, levels, n in ((page, None, 20_000), (code, frozenset(("t", "section")), 15_001)):
        tracemalloc.start()
        told = sum(1 for _ in markup.each_run(source, levels is not None, levels or frozenset()))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert told == n and peak < 1 << 20


def test_runs_that_wait_keep_their_order():
    page = "<main> a<b>b</b><div> c</div> d<p>e<hr>f"
    assert [(r[0], r[4]) for r in markup.read_runs(page)] == [("/main[1]/text-run[1]", " a"), ("/main[1]/text-run[1]", "b"), ("/main[1]/div[1]", " c"), ("/main[1]/text-run[2]", " d"), ("/main[1]/p[1]", "e"), ("/main[1]/text-run[3]", "f")]


def test_rounds_add_only_what_is_not_covered(spark):
    rows = spark.createDataFrame([("a", 0, 5, True), ("a", 2, 4, False), ("b", 0, 5, True), ("b", 5, 9, False), ("c", 1, 2, False), ("c", 1, 2, False), ("d", 0, 9, True), ("d", 0, 3, True)], "k string, from long, to long, old boolean")
    assert sorted(map(tuple, intervals.merged(rows, "k", old="old").collect())) == [("b", 0, 9), ("c", 1, 2)]


def test_long_paths_are_written_as_one_table_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROUNDS", 2)
    edges = spark.createDataFrame([(i, (i + 1) % 7, i, 20 - i) for i in range(7)], "src long, dst long, from long, to long")
    roots = spark.createDataFrame([(0, 0, None, 9)], "root long, node long, from long, to long")
    assert sorted(map(tuple, intervals.closure(edges, roots).collect())) == [(0, 0, None, 9), *((0, i, i - 1, 9) for i in range(1, 7))]


def test_names_meet_runs_of_their_own_lengths_without_a_window(spark):
    rows = spark.createDataFrame([(1, "one two  three four"), (2, "Four"), (3, None)], "id long, t string")
    names = spark.createDataFrame([("Two Three", "law_name"), ("four", "issue")], "name string, kind string")
    hits = claims.name_hits(rows, "id", "t", names)
    assert sorted(tuple(r)[:4] for r in hits.collect()) == [(1, 4, 14, "Two Three"), (1, 15, 19, "four"), (2, 0, 4, "four")]
    assert "Window" not in hits._jdf.queryExecution().toString()
    assert claims.name_hits(rows, "id", "t", names.limit(0)).collect() == []


def test_phrases_are_found_without_moving_texts(spark):
    lines = spark.createDataFrame([(1, 0, "The MIT License of MIT"), (1, 1, "mit x license"), (2, 0, "a mit licenses"), (2, 1, "Software; mit\tlicense")], "version long, pos int, text string")
    index = search.Index(None, None, lines, None, 4, 3.0)
    found = search.with_phrases(index, [["mit", "license"], ["software", "mit"]])
    assert sorted((r["version"], r["pos"], r["which"]) for r in found.collect()) == [(1, 0, [True, False]), (2, 1, [True, True])]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_ranges_of_postings_follow_the_number_of_words(spark, monkeypatch):
    texts = ["b a b", "", "c", " ".join(f"w{i % 40} a" for i in range(90))]
    rows = spark.createDataFrame([(v, p, t) for v in range(3) for p, t in enumerate(texts)], "version long, pos int, text string")
    entries = spark.createDataFrame([(0, "x", "b a b"), (1, "x", None)], "version long, work string, title string")
    monkeypatch.setattr(search, "RANGE_WORDS", 20)
    index = search.build(rows, entries, F.col("len") <= 1)
    assert len(index.postings.inputFiles()) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(t, v, p, x.split().count(t), len(x.split())) for v in range(3) for p, x in enumerate(texts) for t in x.split()} | {("a", 0, -1, 1, 3), ("b", 0, -1, 2, 3)}
    got = [tuple(r) for r in index.postings.select("term", "version", "pos", "tf", "len").collect()]
    assert set(got) == want and len(got) == len(want)
    assert "text" not in index.around.columns and {tuple(r)[1:] for r in index.around.collect()} == {(0, 3, None, None, 1), (1, 0, None, 0, 2), (2, 1, 1, 1, 3), (3, 180, 2, 2, None)}
    assert search.best_passages(index, ["w1"], 9).count() == 3


def test_long_texts_come_to_python_in_small_batches(spark):
    rows = spark.range(0, 150, 1, 1).select("id", F.concat(F.repeat(F.lit("x "), 50_000), F.lit("25 U.S.C. 450")).alias("t"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    found = citations.spans(rows, "id", "t")
    assert found.filter("number = '450' and stop - start = 13").count() == 150
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 150 and max(r["size"] for r in sizes) < 2 * session.BATCH_BYTES


def test_only_readings_that_move_a_state_are_gone_through():
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"at": [at + pd.Timedelta(seconds=i % 500) for i in range(1000)], "ok": [i % 500 < 300 for i in range(1000)], "digest": [str(i) for i in range(1000)]})
    assert list(sources.movers(rows)["digest"]) == ["0", "299", "499", "500", "799", "999"]
    assert len(sources.movers(rows.assign(ok=False))) == 4 and len(sources.movers(rows.head(3))) == 3
