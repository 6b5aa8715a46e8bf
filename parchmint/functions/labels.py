"""Typed words against labels: ranked word-start matches, then matches within a typo budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.session import ship, table

#: Most suggestions within the budget.
MOST = 5


def ranked(typed: DataFrame, labels: DataFrame) -> DataFrame:
    """typed, label, tier, extra, place: labels that hold every typed word, the last one as a word's start.

    Tier 0 is the whole label, 1 has the last word in full, 2 only its start. ``labels`` has label
    and place (its position in the list). Only labels that share the first typed word's first letter
    with one of their words are compared.
    """
    q = typed.select("typed", T.tokens(F.col("typed")).alias("t")).filter(F.size("t") > 0)
    q = q.withColumn("first", F.substring(F.get("t", F.lit(0)), 1, 1))
    names = labels.select("label", "place", T.tokens(F.col("label")).alias("w"))
    names = names.withColumn("first", F.explode(F.array_distinct(F.transform("w", lambda x: F.substring(x, 1, 1)))))
    last = F.element_at("t", -1)
    earlier = F.forall(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: F.array_contains("w", x))
    found = q.join(names, "first").filter(earlier & F.exists("w", lambda x: x.startswith(last)))
    tier = F.when(F.col("t") == F.col("w"), 0).when(F.array_contains("w", last), 1).otherwise(2)
    return found.select("typed", "label", tier.alias("tier"), (F.size("w") - F.size("t")).alias("extra"), "place")


def budget(word: Column) -> Column:
    """Edits that a typed word may have: none with digits, under 4 letters or in short capitals; one under 8; else two."""
    capitals = (F.length(word) <= 6) & (word == F.upper(word)) & (word != F.lower(word))
    return F.when(word.rlike(r"\p{N}") | capitals | (F.length(word) < 4), 0).when(F.length(word) < 8, 1).otherwise(2)


def _alignment(a: str, b: str) -> list[int]:
    """Optimal string alignment distance of a to every prefix of b."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one


def edits(typed: Column, word: Column, most: Column, prefix: Column) -> Column:
    """Edits from a typed word to a word or, where ``prefix`` holds, to its closest start; null beyond the budget.

    A swap of neighbours is one edit. The first letter may not change.
    """

    def count(a: pd.Series, b: pd.Series, m: pd.Series, p: pd.Series) -> pd.Series:
        def one(x, y, k, start):
            if x[:1] != y[:1] or (len(y) < len(x) - k if start else abs(len(x) - len(y)) > k):
                return None
            row = _alignment(x, y)
            near = row[max(1, len(x) - k) : len(x) + k + 1] if start else []
            d = min([row[-1], *near])
            return d if d <= k else None

        return pd.Series([one(*x) for x in zip(a, b, m, p)], dtype="Int32")

    exact = F.when(F.when(prefix, word.startswith(typed)).otherwise(word == typed), 0)
    return F.when(most == 0, exact).otherwise(F.pandas_udf(count, "int", F.PandasUDFType.SCALAR)(typed, word, most, prefix))


def possible(typed: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """typed, label, edits, extra, place: for each typed text the best labels within its words' budgets.

    Every typed word needs a close word of the label. Words are compared once for each distinct pair
    that shares its first letter and, but for the last word, a length within the budget.
    """
    ship(typed.sparkSession)
    words = F.regexp_extract_all("typed", F.lit(T.WORD), F.lit(0))
    q = typed.select("typed", words.alias("t")).filter(F.size("t") > 0).distinct()
    asked = q.select("typed", F.size("t").alias("n"), F.posexplode("t").alias("k", "word"))
    asked = asked.select("typed", "n", "k", F.lower("word").alias("word"), budget(F.col("word")).alias("most"), (F.col("k") == F.col("n") - 1).alias("last"))
    names = labels.select("label", "place", T.tokens(F.col("label")).alias("w"))
    known = names.select(F.explode("w").alias("other")).distinct().withColumn("first", F.substring("other", 1, 1))
    pairs = asked.select("word", "most", "last", F.substring("word", 1, 1).alias("first")).distinct().join(known, "first")
    pairs = pairs.filter(F.when(F.col("last"), F.length("other") >= F.length("word") - F.col("most")).otherwise(F.abs(F.length("other") - F.length("word")) <= F.col("most")))
    close = pairs.withColumn("d", edits(F.col("word"), F.col("other"), F.col("most"), F.col("last"))).filter("d is not null").select("word", "most", "last", "other", "d")
    held = names.select("label", "place", F.size("w").alias("size"), F.explode(F.array_distinct("w")).alias("other"))
    best = asked.join(close, ["word", "most", "last"]).join(held, "other").groupBy("typed", "n", "k", "label", "place", "size").agg(F.min("d").alias("d"))
    total = best.groupBy("typed", "n", "label", "place", "size").agg(F.count("*").alias("found"), F.sum("d").cast("int").alias("edits")).filter("found = n")
    total = total.withColumn("extra", F.col("size") - F.col("n"))
    order = Window.partitionBy("typed").orderBy("edits", "extra", "place")
    return total.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("typed", "label", "edits", "extra", "place")


def folded(text: Column) -> Column:
    """Lower case, white space as single blanks."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def phrases(typed: DataFrame, known: DataFrame) -> DataFrame:
    """typed, term: rows of a phrase table that equal what was typed, whatever case and spacing."""
    return typed.withColumn("__f", folded(F.col("typed"))).join(known.withColumn("__f", folded(F.col("phrase"))), "__f").select("typed", "term")


def _parts(spark, d):
    """Distinct part names as labels, in order; their place is made without a window over all rows."""
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("place"))
    return names


def _ranked(spark, d):
    typed = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 4)).alias("typed")).unionByName(_parts(spark, d).filter("place % 50 = 1").select(F.expr("substring(label, 1, length(label) - 2)").alias("typed"))).distinct()
    names = _parts(spark, d).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("place")))
    return ranked(typed, names)


def _typed(spark, d):
    """Labels with two neighbours swapped, a letter dropped, or a letter doubled, by turns."""
    c = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("l"))
    k = F.col("n_nationkey") % 3
    return c.filter("length(l) > 4").select(F.when(k == 0, F.concat(F.substring("l", 1, 2), F.substring("l", 4, 1), F.substring("l", 3, 1), F.expr("substring(l, 5)"))).when(k == 1, F.concat(F.substring("l", 1, 3), F.expr("substring(l, 5)"))).otherwise(F.concat(F.substring("l", 1, 3), F.expr("substring(l, 3)"))).alias("typed")).select(F.initcap(F.lower("typed")).alias("typed"))


def _possible(spark, d):
    return possible(_typed(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("place")))


def _phrases(spark, d):
    n = table(spark, d, "nation")
    typed = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("  The "), F.lower("n_name"), F.lit("   of "), F.col("c_mktsegment")).alias("typed")).distinct()
    known = n.select(F.concat(F.lit("the "), F.col("n_name"), F.lit(" of building")).alias("phrase"), F.concat(F.lit("term "), F.col("n_nationkey").cast("string")).alias("term"))
    return phrases(typed, known)


_TYPED = """with l as (select n_nationkey as k, n_name as l from nation where length(n_name) > 4),
t as (select k, case k % 3 when 0 then l[1:2] || l[4:4] || l[3:3] || l[5:] when 1 then l[1:3] || l[5:] else l[1:3] || l[3:] end as x from l)"""

QUERIES = {
    "label_ranking": (_ranked, r"""
with t as (select distinct typed from (select lower(n_name[1:4]) as typed from nation union all select label[1:length(label) - 2] from (select p_name as label, min(p_partkey) as place from part group by 1) where place % 50 = 1)),
n as (select label, place, regexp_extract_all(lower(label), '[\p{L}\p{N}]+') as w from (select p_name as label, min(p_partkey) as place from part group by 1 union all select n_name, n_nationkey::bigint from nation)),
q as (select typed, regexp_extract_all(lower(typed), '[\p{L}\p{N}]+') as t from t)
select typed, label, case when t = w then 0 when list_contains(w, t[-1]) then 1 else 2 end as tier, (len(w) - len(t))::int as extra, place
from q, n where len(t) > 0 and len(list_filter(t[:-2], lambda x: not list_contains(w, x))) = 0 and len(list_filter(w, lambda x: starts_with(x, t[-1]))) > 0"""),
    # Each typed name is one edit off its first word; its number may be the start of others.
    "typo_suggestions": (_possible, _TYPED + """,
q as (select upper(x[1:1]) || lower(x[2:]) as typed, string_split(x, '_')[2] as n from t)
select distinct typed, n_name as label, 1 as edits, 0 as extra, n_nationkey as place from q join nation on starts_with(string_split(n_name, '_')[2], n) qualify row_number() over (partition by typed order by n_nationkey) <= 5"""),
    "phrase_table": (_phrases, "select distinct '  The ' || lower(n_name) || '   of ' || c_mktsegment as typed, 'term ' || n_nationkey as term from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING'"),
}
