"""Relations of axis-aligned boxes with whole-number sides, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.session import table


def relation(a: str, b: str) -> Column:
    """disjoint, touches, contains, within or intersects of boxes a and b (x0, x1, y0, y1 behind each name)."""
    c = lambda n, k: F.col(f"{n}{k}")
    apart = (c(a, "x1") < c(b, "x0")) | (c(b, "x1") < c(a, "x0")) | (c(a, "y1") < c(b, "y0")) | (c(b, "y1") < c(a, "y0"))
    touch = (c(a, "x1") == c(b, "x0")) | (c(b, "x1") == c(a, "x0")) | (c(a, "y1") == c(b, "y0")) | (c(b, "y1") == c(a, "y0"))
    inside = lambda p, q: (c(p, "x0") < c(q, "x0")) & (c(q, "x1") < c(p, "x1")) & (c(p, "y0") < c(q, "y0")) & (c(q, "y1") < c(p, "y1"))
    return F.when(apart, "disjoint").when(touch, "touches").when(inside(a, b), "contains").when(inside(b, a), "within").otherwise("intersects")


def tolerant_relation(a: str, b: str, t: int) -> Column:
    """The relation if every shift of the sides by at most t gives the same, else ambiguous.

    Along each axis only the order of four sides matters, so the extreme shifts decide.
    """
    c = lambda n, k: F.col(f"{n}{k}")
    gaps = [c(b, "x0") - c(a, "x1"), c(a, "x0") - c(b, "x1"), c(b, "y0") - c(a, "y1"), c(a, "y0") - c(b, "y1")]
    surely_apart = (gaps[0] > 2 * t) | (gaps[1] > 2 * t) | (gaps[2] > 2 * t) | (gaps[3] > 2 * t)
    surely_over = (gaps[0] < -2 * t) & (gaps[1] < -2 * t) & (gaps[2] < -2 * t) & (gaps[3] < -2 * t)
    deep = lambda p, q: (c(q, "x0") - c(p, "x0") > 2 * t) & (c(p, "x1") - c(q, "x1") > 2 * t) & (c(q, "y0") - c(p, "y0") > 2 * t) & (c(p, "y1") - c(q, "y1") > 2 * t)
    never = lambda p, q: (c(q, "x0") - c(p, "x0") <= -2 * t) | (c(p, "x1") - c(q, "x1") <= -2 * t) | (c(q, "y0") - c(p, "y0") <= -2 * t) | (c(p, "y1") - c(q, "y1") <= -2 * t)
    return F.when(surely_apart, "disjoint").when(surely_over & deep(a, b), "contains").when(surely_over & deep(b, a), "within").when(surely_over & never(a, b) & never(b, a), "intersects").otherwise("ambiguous")


#: Why a relation is unknown, in the order in which reasons are tried.
UNKNOWN = ("missing_geometry", "partial_coverage", "unknown_coverage", "observation_uncertain", "resolution_mismatch", "valid_time_mixed_precision", "valid_time_disjoint", "tolerance_ambiguity")


def outcome(a: str, b: str, t: int, shared_state: Column) -> Column:
    """struct(relation, reason) of two observed boxes: unknown with the first reason that holds, else how they lie.

    Besides the sides each has coverage (complete, partial, missing or unknown), uncertain and
    resolution behind its name; ``shared_state`` is that of ``functions.dates.shared_time``.
    """
    either = lambda name, value: (F.col(f"{a}{name}") == value) | (F.col(f"{b}{name}") == value)
    found = tolerant_relation(a, b, t)
    tests = [
        either("coverage", "missing"), either("coverage", "partial"), either("coverage", "unknown"), either("uncertain", F.lit(True)),
        F.col(f"{a}resolution") != F.col(f"{b}resolution"), shared_state == "indeterminate", shared_state == "disjoint", found == "ambiguous",
    ]
    reason = None
    for test, name in zip(tests, UNKNOWN):
        reason = F.when(F.coalesce(test, F.lit(False)), name) if reason is None else reason.when(F.coalesce(test, F.lit(False)), name)
    return F.struct(F.when(reason.isNull(), found).otherwise("unknown").alias("relation"), reason.alias("reason"))


def overlap_join(left: DataFrame, right: DataFrame, cell: int, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose boxes meet, by an equi-join on cells of both axes; each pair stands once.

    Cells of one size in x and y: candidates grow with the boxes in a cell, not with those in a strip.
    """
    along = lambda n, x: F.sequence(F.floor(F.col(f"{n}{x}0") / cell), F.floor(F.col(f"{n}{x}1") / cell))
    cells = lambda rows, n: rows.withColumn("__x", F.explode(along(n, "x"))).withColumn("__y", F.explode(along(n, "y")))
    pairs = cells(left, a).join(cells(right, b), ["__x", "__y"])
    meet = lambda x: (F.col(f"{a}{x}0") <= F.col(f"{b}{x}1")) & (F.col(f"{b}{x}0") <= F.col(f"{a}{x}1"))
    first = lambda x: F.col(f"__{x}") == F.floor(F.greatest(f"{a}{x}0", f"{b}{x}0") / cell)  # noqa: E731  the first cell that both reach
    return pairs.filter(first("x") & first("y") & meet("x") & meet("y")).drop("__x", "__y")


def overlap_counts(left: DataFrame, right: DataFrame, cell: int, by: Column, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """name, pairs: how many pairs of boxes that meet there are for each value of ``by``, a column of their sides.

    Boxes with the same sides meet the same boxes, so each place is joined once and pairs are counted by
    the products of their numbers: copies are never expanded into pairs.
    """
    sides = lambda n: [f"{n}x0", f"{n}x1", f"{n}y0", f"{n}y1"]
    places = lambda rows, n: rows.groupBy(*sides(n)).agg(F.count("*").alias(f"__{n}"))
    pairs = overlap_join(places(left, a), places(right, b), cell, a, b)
    return pairs.groupBy(by.alias(name)).agg(F.sum(F.col(f"__{a}") * F.col(f"__{b}")).alias("pairs"))


def _boxes(spark, d, name: str):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    x, y = (k * (37 if name == "a" else 53)) % 1000, (k * (91 if name == "a" else 29)) % 1000
    return p.select(k.alias(f"{name}_id"), x.alias(f"{name}x0"), (x + F.col("p_size")).alias(f"{name}x1"), y.alias(f"{name}y0"), (y + F.col("p_size") * 2).alias(f"{name}y1"))


_BOXES = "with a as (select p_partkey as a_id, p_partkey * 37 % 1000 as ax0, p_partkey * 37 % 1000 + p_size as ax1, p_partkey * 91 % 1000 as ay0, p_partkey * 91 % 1000 + p_size * 2 as ay1 from part), b as (select p_partkey as b_id, p_partkey * 53 % 1000 as bx0, p_partkey * 53 % 1000 + p_size as bx1, p_partkey * 29 % 1000 as by0, p_partkey * 29 % 1000 + p_size * 2 as by1 from part)"
_REL = "case when ax1 < bx0 or bx1 < ax0 or ay1 < by0 or by1 < ay0 then 'disjoint' when ax1 = bx0 or bx1 = ax0 or ay1 = by0 or by1 = ay0 then 'touches' when ax0 < bx0 and bx1 < ax1 and ay0 < by0 and by1 < ay1 then 'contains' when bx0 < ax0 and ax1 < bx1 and by0 < ay0 and ay1 < by1 then 'within' else 'intersects' end"


def _topology(spark, d):
    return _boxes(spark, d, "a").join(_boxes(spark, d, "b"), F.col("a_id") == F.col("b_id")).select("a_id", relation("a", "b").alias("relation"))


def _overlaps(spark, d):
    return overlap_counts(_boxes(spark, d, "a"), _boxes(spark, d, "b"), 60, relation("a", "b"), "relation")


def _pairs(spark, d):
    return _boxes(spark, d, "a").join(_boxes(spark, d, "b"), F.col("a_id") == F.col("b_id"))


def _near(spark, d):
    """Boxes that lie about where their partners do."""
    k = F.col("a_id")
    rows = _boxes(spark, d, "a")
    size = F.col("ax1") - F.col("ax0")
    return rows.select("*", (F.col("ax0") + k % 7 - 3).alias("bx0"), (F.col("ax1") + k % 5 - 2 + F.when(k % 3 == 0, size).otherwise(0)).alias("bx1"), (F.col("ay0") + k % 9 - 4 + F.when(k % 4 == 0, size * 2).otherwise(0)).alias("by0"), (F.col("ay1") + k % 11 - 5 + F.when(k % 4 == 0, size * 2).otherwise(0)).alias("by1"))


def _tolerant(spark, d):
    return _near(spark, d).select("a_id", tolerant_relation("a", "b", 1).alias("relation"))


def _outcome(spark, d):
    k = F.col("a_id")
    said = lambda n, m: F.when(k % n == 0, "missing").when(k % m == 0, "partial").when(k % (n + m) == 0, "unknown").otherwise("complete")
    rows = _near(spark, d).withColumns({"acoverage": said(13, 17), "bcoverage": said(19, 23), "auncertain": k % 29 == 0, "buncertain": k % 31 == 0, "aresolution": (k % 37 == 0).cast("int"), "bresolution": F.lit(0)})
    state = F.when(k % 41 == 0, "indeterminate").when(k % 43 == 0, "disjoint").otherwise("shared")
    return rows.select("a_id", outcome("a", "b", 1, state).alias("o")).select("a_id", "o.relation", "o.reason")


_NEAR = """, n as (select a_id, ax0, ax1, ay0, ay1, ax0 + a_id % 7 - 3 as bx0, ax1 + a_id % 5 - 2 + case when a_id % 3 = 0 then ax1 - ax0 else 0 end as bx1,
  ay0 + a_id % 9 - 4 + case when a_id % 4 = 0 then (ax1 - ax0) * 2 else 0 end as by0, ay1 + a_id % 11 - 5 + case when a_id % 4 = 0 then (ax1 - ax0) * 2 else 0 end as by1 from a),
g as (select a_id, [bx0 - ax1, ax0 - bx1, by0 - ay1, ay0 - by1] as gap, [bx0 - ax0, ax1 - bx1, by0 - ay0, ay1 - by1] as ab, [ax0 - bx0, bx1 - ax1, ay0 - by0, by1 - ay1] as ba from n),
t as (select a_id, case when list_max(gap) > 2 then 'disjoint' when list_max(gap) < -2 and list_min(ab) > 2 then 'contains' when list_max(gap) < -2 and list_min(ba) > 2 then 'within'
  when list_max(gap) < -2 and list_min(ab) <= -2 and list_min(ba) <= -2 then 'intersects' else 'ambiguous' end as relation from g)
"""

QUERIES = {
    "box_topology": (_topology, f"{_BOXES} select a_id, {_REL} as relation from a join b on a_id = b_id"),
    "box_overlap_join": (_overlaps, f"{_BOXES} select relation, count(*) as pairs from (select {_REL} as relation from a join b on ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1) group by relation"),
    "tolerant_topology": (_tolerant, _BOXES + _NEAR + "select * from t"),
    "relation_outcome": (_outcome, _BOXES + _NEAR + """, r as (select a_id, relation, case when a_id % 13 = 0 or a_id % 19 = 0 then 'missing_geometry' when a_id % 17 = 0 or a_id % 23 = 0 then 'partial_coverage' when a_id % 30 = 0 or a_id % 42 = 0 then 'unknown_coverage'
  when a_id % 29 = 0 or a_id % 31 = 0 then 'observation_uncertain' when a_id % 37 = 0 then 'resolution_mismatch' when a_id % 41 = 0 then 'valid_time_mixed_precision' when a_id % 43 = 0 then 'valid_time_disjoint' when relation = 'ambiguous' then 'tolerance_ambiguity' end as reason from t)
select a_id, case when reason is null then relation else 'unknown' end as relation, reason from r"""),
}
