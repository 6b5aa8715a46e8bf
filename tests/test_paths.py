"""Listings with drift, canonical JSON, intervals along paths, chains, revision logs, digests and streamed states, against plain replays."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from parchmint.functions import canonical
from parchmint.operators import chains, intervals
from parchmint.sources import listings
from parchmint.streaming import sources

DAY = datetime.date(2024, 1, 1)


def entries(spark, days):
    return spark.createDataFrame([(DAY + datetime.timedelta(days=d), f"{d}-{i}", "t") for d, n in days.items() for i in range(n)], "day date, number string, title string")


def test_ranges_stay_under_the_limit():
    rng = random.Random(4)
    for _ in range(50):
        stated = {DAY + datetime.timedelta(days=rng.randrange(200)): rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))}
        ranges = listings.planned(stated, 50)
        assert all(sum(n for d, n in stated.items() if a <= d <= b) < 50 or a == b for a, b in ranges)
        assert sorted(d for a, b in ranges for d in stated if a <= d <= b) == sorted(stated)
    assert listings.planned({}, 5) == []


def test_listing_source_reads_every_row_once(spark, tmp_path):
    days = {0: 3, 1: 30, 2: 1, 9: 8}
    at = f"file://{tmp_path}"
    listings.write(entries(spark, days), f"{at}/entries", f"{at}/counts")
    listings.register(spark)
    found = spark.read.format("listings").option("entries", f"{at}/entries").option("counts", f"{at}/counts").option("limit", 10).load()
    rows = found.collect()
    assert sorted(r["number"] for r in rows) == sorted(f"{d}-{i}" for d, n in days.items() for i in range(n))
    assert found.rdd.getNumPartitions() >= 3 and not any(r["drifted"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["low"], r["high"]] = sizes.get((r["low"], r["high"]), 0) + 1
    assert all(n < 10 or a == b for (a, b), n in sizes.items())


def test_a_drifted_day_is_read_again(spark, tmp_path):
    at = f"file://{tmp_path}"
    options = {"entries": f"{at}/entries", "counts": f"{at}/counts", "limit": "100"}
    listings.write(entries(spark, {0: 2, 1: 3}), options["entries"], options["counts"])
    reader = listings.Reader(options)
    parts = reader.partitions()
    entries(spark, {1: 1}).withColumn("number", F.lit("late")).write.partitionBy("day").mode("append").parquet(options["entries"])
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted((r[1], r[5], r[6]) for r in rows) == [("0-0", False, True), ("0-1", False, True), ("1-0", True, True), ("1-1", True, True), ("1-2", True, True), ("late", True, True)]

    class Restless(listings.Folder):
        """A day that is another one at each of its first readings."""

        def day(self, day):
            self.n = getattr(self, "n", 0) + 1
            return [(str(i), "t") for i in range(min(self.n, self.top))]

    part = listings.Range(DAY, DAY, {DAY: 9})
    for top, settled in ((3, True), (99, False)):
        folder = Restless(options)
        folder.top = top
        out = list(folder.read(part))
        assert len(out) == min(top, listings.READINGS) and {r[6] for r in out} == {settled}


def test_listing_stream_goes_on_after_its_last_day(spark, tmp_path):
    at = f"file://{tmp_path}"
    listings.register(spark)

    def run():
        stream = spark.readStream.format("listings").option("entries", f"{at}/entries").option("counts", f"{at}/counts").option("limit", 4).load()
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["number"] for r in spark.read.parquet(f"{at}/out").collect())

    listings.write(entries(spark, {0: 2, 1: 5}), f"{at}/entries", f"{at}/counts")
    assert len(run()) == 7
    listings.write(entries(spark, {2: 3}), f"{at}/entries", f"{at}/counts")
    assert run() == sorted([f"{d}-{i}" for d, n in {0: 2, 1: 5, 2: 3}.items() for i in range(n)])


@pytest.mark.parametrize("text,want", [
    ('{"b":1,"a":{"d":[],"c":{}}}', '{"a":{"c":{},"d":[]},"b":1}'), ('[1.0,-0.0,1e21,1e20,1e-7,0.000001,123456789012345680000,0.1,5e-324,-1.5]', "[1,0,1e+21,100000000000000000000,1e-7,0.000001,123456789012345680000,0.1,5e-324,-1.5]"),
    ('{"\\ue000":1,"\\ud83d\\ude00":2}', '{"😀":2,"":1}'), ('"\\u001f\\/\\ud800\\"é"', '"\\u001f/\\ud800\\"é"'), ('{"a":1,"a":2}', '{"a":2}'), (" true ", "true"), ("{", None), ("[1e999]", None), ("NaN", None), ("", None), (None, None),
])
def test_canonical_text(text, want):
    assert canonical.canonical_text(text) == want


def test_canonical_text_does_not_depend_on_the_order_of_keys():
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 4 else 4)
        return [None, True, rng.choice([0.5, 3, -2e30, 7e-9]), rng.choice(["x", "é", "\U0001f600"])][kind] if kind < 4 else [value(depth + 1) for _ in range(3)] if kind == 4 else {rng.choice("abc\U0001f600") + str(i): value(depth + 1) for i in range(4)}

    def shuffled(v):
        if isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            return {k: shuffled(x) for k, x in items}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    for _ in range(200):
        v = value()
        one = canonical.canonical_text(json.dumps(v))
        assert one == canonical.canonical_text(json.dumps(shuffled(v), indent=2, ensure_ascii=False)) == canonical.canonical_text(one)
        assert json.loads(one) == v


def test_protected_keys_at_any_depth():
    deep = '{"x":' * 400 + '{"Parcel-Id":1}' + "}" * 400
    assert canonical.pointers(deep, frozenset(["parcelid"])) == ["/x" * 400 + "/Parcel-Id"]
    assert canonical.pointers('["parcelId", {"parcel": {"id": 1}}]', frozenset(["parcelid"])) == []


def test_authority_equals_a_search_by_day(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12), a := rng.choice([None, rng.randrange(40)]), rng.choice([None, (a or 0) + rng.randrange(-2, 12)])) for _ in range(60)]
    roots = [(r, r, rng.choice([None, 5]), None) for r in range(4)]
    got = intervals.closure(spark.createDataFrame(edges, "src int, dst int, from long, to long"), spark.createDataFrame(roots, "root int, node int, from long, to long")).collect()
    on = lambda day, a, b: (a is None or a <= day) and (b is None or day < b)
    for day in range(-3, 60):
        want = set()
        for root, node, a, b in roots:
            todo = [node] if on(day, a, b) else []
            while todo:
                n = todo.pop()
                if (root, n) not in want:
                    want.add((root, n))
                    todo += [d for s, d, f, t in edges if s == n and on(day, f, t)]
        assert {(r["root"], r["node"]) for r in got if on(day, r["from"], r["to"])} == want
    by_node = {}
    for r in got:
        by_node.setdefault((r["root"], r["node"]), []).append((-(10**9) if r["from"] is None else r["from"], 10**9 if r["to"] is None else r["to"]))
    assert all(a[1] < b[0] for v in by_node.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_a_long_chain_is_ranked(spark):
    n = 100_000
    docs = spark.range(n).selectExpr("id * 7919 % 100003 as doc")
    links = spark.range(n - 1).selectExpr("id * 7919 % 100003 as doc", "(id + 1) * 7919 % 100003 as next")
    r = chains.chains(docs, links).agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place"), F.countDistinct("head"), F.countDistinct("tip"), F.max("length")).first()
    assert tuple(r) == (n, n, 1, n, 1, 1, n)


def test_chain_faults(spark):
    docs = spark.createDataFrame([(x,) for x in "abcdefghijk"], "doc string")
    links = spark.createDataFrame([*zip("abdefgg", "bcefdhi"), ("j", "z"), ("k", "i"), ("a", "b"), (None, "a")], "doc string, next string")
    got = {r["doc"]: tuple(r)[1:] for r in chains.chains(docs, links).collect()}
    assert got["a"] == ("a", 1, "c", 3, "") and got["c"] == ("a", 3, "c", 3, "")
    assert all(got[x] == (None, None, None, None, "circle") for x in "def")
    assert got["g"] == ("g", 1, "g", 1, "fork") and got["i"] == ("i", 1, "i", 1, "join") and got["j"] == ("j", 1, "j", 1, "missing")
    assert chains.chains(docs.filter("doc = 'none'"), links).collect() == []


def test_revisions_equal_a_replay(spark):
    rng = random.Random(3)
    log, want = [], {}
    for study in range(40):
        states = {}
        for rev in range(1, 25):
            kind = rng.choice(["set", "rollback", "rollback", "rebind"])
            target, name, value = rng.randrange(0, rev + 2), rng.choice("abc"), str(rng.randrange(99))
            refs = {rng.choice("abcd"): str(rev)} if rng.random() < 0.8 else None
            log.append((study, rev, kind, target, name, value, refs))
            if kind == "set":
                states[rev] = (rev, dict(refs or {}))
            elif kind == "rollback":
                states[rev] = states.get(target) if target < rev else None
            else:
                before = states.get(rev - 1)
                states[rev] = before and (before[0], {**before[1], name: value})
            s = states[rev]
            want[study, rev] = (s[0], ",".join(f"{k}={v}" for k, v in sorted(s[1].items())), None) if s else (None, None, "no_such_revision")
    rows = spark.createDataFrame(log, "study int, rev long, kind string, target long, name string, value string, refs map<string,string>")
    assert {(r["study"], r["rev"]): tuple(r)[2:] for r in chains.revisions(rows).collect()} == want


def test_a_changed_leaf_blames_one_node(spark):
    rng = random.Random(6)
    nodes = {i: f"body{i}" for i in range(30)}
    kids = {i: sorted({rng.randrange(i) for _ in range(rng.randrange(0, 4))}) if i else [] for i in nodes}  # children are smaller: no circles

    def digest(i, bodies):
        return hashlib.sha256("\n".join([bodies[i], "\n".join(sorted(digest(c, bodies) for c in kids[i]))]).encode()).hexdigest()

    stated = {i: digest(i, nodes) for i in nodes}
    now = {**nodes, 0: "changed"}
    rows = spark.createDataFrame([(i, now[i], stated[i]) for i in nodes] + [(100, "x", "s"), (101, "y", "s")], "node int, body string, stated string")
    links = spark.createDataFrame([(i, c) for i in nodes for c in kids[i]] + [(100, 101), (101, 100)], "node int, child int")
    got = {r["node"]: (r["made"], r["state"]) for r in chains.digest_blame(rows, links).collect()}
    assert [i for i, (_, s) in got.items() if s == "cause"] == [0]
    assert all(got[i][0] == digest(i, now) and got[i][1] in ("cause", "effect" if got[i][0] != stated[i] else "same") for i in nodes)
    assert got[100] == (None, "circle")


def test_stream_equals_batch_after_every_batch_and_a_restart(spark, tmp_path):
    at = f"file://{tmp_path}"
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    schema = "source string, at timestamp, ok boolean, digest string"
    seen = []

    def told(changes):
        return {r["source"]: (r["first_seen"], r["last_seen"], r["digest"], r["health"]) for r in changes.collect()}

    for batch in range(3):
        rows = [(rng.choice("abcd"), start + datetime.timedelta(minutes=60 * batch + rng.randrange(60)), rng.random() < 0.5, f"d{rng.randrange(4)}") for _ in range(12)]
        rows += [("silent", start, False, None)] if batch == 0 else [("waker", start + datetime.timedelta(days=3), True, "w")] if batch == 2 else []
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        out = sources.run_to_end(sources.follow(stream, 3600), at)  # a new run each time, from the checkpoint
        assert told(sources.latest(out)) == told(sources.states(spark.createDataFrame(seen, schema)))
    stale = {r["source"]: r["stale"] for r in sources.latest(out).collect()}
    assert stale["silent"] and stale["a"] and not stale["waker"]
