"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import materialize, table


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are moved to the smallest known neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # a > b holds for every edge, so v is smaller than u
        pass
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = both.join(least, "u")
    if larger:
        out = moved.filter("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that edges connect with each node of the table.

    Alternating star steps; a logarithmic number of rounds, each of which moves one row per edge.
    Loops keep a node that has no other edge. Edges with a null end are ignored.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    ends = materialize(ends, "edges")
    now = ends.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    mark = None
    while True:
        now = materialize(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, depth: nodes within ``max_depth`` edges of the start (a column node), by frontiers."""
    seen = frontier = start.select("node").distinct().withColumn("depth", F.lit(0))
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    for depth in range(1, max_depth + 1):
        fresh = frontier.join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = materialize(fresh.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shrink(rows: DataFrame, row_id: str, reference: str) -> DataFrame:
    """Rows whose references lead to rows that stay; dropping repeats until no reference dangles. Null refers to nothing.

    Pointer doubling: a row is dropped if following its reference ever meets a missing row. Each round
    doubles how far a row has looked, so long chains take a logarithmic number of rounds.
    """
    now = materialize(rows.select(F.col(row_id).alias("node"), F.col(reference).alias("next")).distinct(), "ahead")
    ahead = now
    for _ in range(max(1, now.count().bit_length()) + 1):
        hop = ahead.select(F.col("node").alias("next"), F.col("next").alias("further"), F.lit(True).alias("there"))
        # A node that has met a missing one has gone; one whose reference is null has come to an end.
        step = ahead.filter("next is not null").join(hop, "next").select("node", F.col("further").alias("next"))
        ahead = materialize(step.unionByName(ahead.filter("next is null")), "ahead")
        if ahead.filter("next is not null").isEmpty():
            break
    return rows.join(ahead.select(F.col("node").alias("__k")).distinct(), F.col(row_id) == F.col("__k"), "left_semi")


def reach_as_of(edges: DataFrame, start: DataFrame, nodes: DataFrame, cutoff, max_depth: int) -> DataFrame:
    """node, depth over edges (src, dst, known_at) that are known by a cutoff, through nodes (node, known_at) that are too."""
    live = nodes.filter(F.col("known_at") <= cutoff).select("node")
    ok = edges.filter(F.col("known_at") <= cutoff).select("src", "dst")
    ok = ok.join(live.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return reach(ok, start.join(live, "node", "left_semi"), max_depth)


def shortest_paths(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """node, path: a shortest way from the start to each node within ``max_depth`` edges; of equal ones the first by nodes.

    start: node. edges: src, dst. Each round writes the nodes that it reaches first.
    """
    found = frontier = materialize(start.select("node").distinct().withColumn("path", F.array("node")), "paths")
    for _ in range(max_depth):
        steps = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = steps.join(found.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = materialize(fresh, "paths")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """node: nodes that lie on a cycle or lead into one, where every node has at most one edge (src, dst), as parents do.

    Pointer doubling: after k rounds each node points 2^k edges ahead, so a chain of any length ends
    in a logarithmic number of rounds; what still points anywhere then cannot end.
    """
    now = materialize(edges.select("src", "dst").filter("dst is not null"), "ahead")
    left = now.count()
    for _ in range(max(1, left.bit_length()) + 1):
        hop = now.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
        now = materialize(now.join(hop, "dst").select("src", F.col("further").alias("dst")), "ahead")
    return now.select(F.col("src").alias("node")).distinct()


def frontier_closure(seed: DataFrame, related: DataFrame, known: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(node, round: what the seed's relations reach among known nodes; node: targets that are not known).

    Rounds end when nothing new is found; more than ``cap`` targets raise an error instead of being cut.
    """
    seen = frontier = materialize(seed.select("node").distinct().withColumn("round", F.lit(0)), "frontier")
    step = 0
    while True:
        step += 1
        fresh = frontier.join(related, "node").select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = materialize(fresh.join(known.select("node"), "node", "left_semi").withColumn("round", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier), "closed")
        if seen.count() > cap:
            raise ValueError(f"more than {cap} related nodes")
    missing = seen.join(related, "node").select(F.col("target").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
    return seen, missing


def tips(edges: DataFrame, new: str, old: str, nodes: DataFrame) -> DataFrame:
    """node: what no edge supersedes."""
    return nodes.select("node").join(edges.select(F.col(old).alias("node")), "node", "left_anti")


def _supply(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 3 + 1) % 97).alias("dst"))


_SUPPLY = "select s_suppkey as src, (s_suppkey * 3 + 1) % 97 as dst from supplier"


def _reach(spark, d):
    return reach(_supply(spark, d), spark.createDataFrame([(1,), (5,)], "node long"), 6).select("node", "depth")


def _components(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return connected_components(docs.join(first, "h"), "doc_id", "first")


def _shrink(spark, d):
    rows = table(spark, d, "orders").filter("o_orderkey % 13 != 5").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.floor(F.col("o_orderkey") / 2).cast("long")).alias("parent"))
    return shrink(rows, "o_orderkey", "parent")


def _tips(spark, d):
    return tips(_supply(spark, d), "src", "dst", table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))


def _known(spark, d):
    at = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).alias("known_at")
    edges = _supply(spark, d).select("src", "dst", at(F.col("src") * 3))
    return edges, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), at(F.col("s_suppkey") * 7))


def _reach_as_of(spark, d):
    edges, nodes = _known(spark, d)
    start = nodes.filter("node <= 20").select("node")
    return reach_as_of(edges, start, nodes, F.lit("2024-03-10").cast("date"), 8)


def _paths(spark, d):
    k = F.col("s_suppkey")
    more = table(spark, d, "supplier").select(k.alias("src"), ((k * 5 + 2) % 97).alias("dst"))
    return shortest_paths(_supply(spark, d).unionByName(more), spark.createDataFrame([(1,)], "node long"), 5).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _cycles(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("src"), F.when(k % 5 > 0, F.when(k % 3 == 0, F.floor(k / 2).cast("long")).otherwise((k * 7 + 3) % 1000)).alias("dst"))
    return cycles(rows)


def _frontier(spark, d):
    k = F.col("o_orderkey")
    related = table(spark, d, "orders").filter("o_orderkey % 4 != 0").select(k.alias("node"), (k * 3 % 20011).alias("target"))
    known = table(spark, d, "orders").select(k.alias("node"))
    seen, missing = frontier_closure(known.filter("node <= 40"), related, known, 100_000)
    return seen.select("node", F.lit("reached").alias("state")).unionByName(missing.select("node", F.lit("missing").alias("state")))


QUERIES = {
    "reachability": (_reach, f"with recursive e as ({_SUPPLY}), r as (select node, 0 as depth from (values (1::bigint), (5::bigint)) t(node) union select dst, depth + 1 from r join e on src = node where depth < 6) select node, min(depth) as depth from r group by node"),
    "components_of_copies": (_components, "select doc_id as node, min(doc_id) over (partition by md5(text)) as component from documents"),
    "referential_shrink": (_shrink, """
with recursive o as (select o_orderkey, case when o_orderkey % 4 > 0 then o_orderkey // 2 end as parent from orders where o_orderkey % 13 != 5),
k as (select o_orderkey, parent from o where parent is null union all select o.o_orderkey, o.parent from o join k on o.parent = k.o_orderkey) select distinct o_orderkey, parent from k
union select o_orderkey, parent from o where parent = o_orderkey"""),
    "supersession_tips": (_tips, f"with e as ({_SUPPLY}) select s_suppkey as node from supplier where s_suppkey not in (select dst from e)"),
    "reach_as_of": (_reach_as_of, f"""
with recursive live as (select s_suppkey as node from supplier where date '2024-01-01' + (s_suppkey * 7 % 90)::int <= date '2024-03-10'),
e as (select src, dst from ({_SUPPLY}) where date '2024-01-01' + (src * 3 % 90)::int <= date '2024-03-10' and dst in (select node from live)),
r as (select node, 0 as depth from live where node <= 20 union select dst, depth + 1 from r join e on src = node where depth < 8) select node, min(depth) as depth from r group by node"""),
    "dependency_paths": (_paths, f"""
with recursive e as ({_SUPPLY} union select s_suppkey, (s_suppkey * 5 + 2) % 97 from supplier),
r as (select 1::bigint as node, [1::bigint] as path union all select dst, list_append(path, dst) from r join e on src = node where len(path) <= 5 and not list_contains(path, dst))
select node, array_to_string(min(path), '>') as path from (select *, min(len(path)) over (partition by node) as n from r) where len(path) = n group by node"""),
    "parent_cycles": (_cycles, """
with recursive e as (select o_orderkey as src, case when o_orderkey % 5 > 0 then case when o_orderkey % 3 = 0 then o_orderkey // 2 else (o_orderkey * 7 + 3) % 1000 end end as dst from orders),
ends as (select src from e where dst is null or dst not in (select src from e) union select e.src from e join ends on e.dst = ends.src)
select src as node from e where src not in (select src from ends)"""),
    "related_frontier": (_frontier, """
with recursive t as (select o_orderkey as node, o_orderkey * 3 % 20011 as target from orders where o_orderkey % 4 != 0),
r as (select o_orderkey as node from orders where o_orderkey <= 40 union select target from r join t using (node) where target in (select o_orderkey from orders))
select node, 'reached' as state from r union all select distinct target, 'missing' from r join t using (node) where target not in (select o_orderkey from orders)"""),
}
