"""Ranked passage search.

A query reads the passages once for the collection's statistics and once for the scores; only
counts of the query's own terms are kept, so no posting table is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.session import table

K1, B = 1.2, 0.75


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, pos, text: the lines of each text that hold a word."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))


def term_counts(rows: DataFrame, terms: list[str], folded: bool = False) -> DataFrame:
    """Adds len (words) and tf (array of the terms' counts)."""
    same = lambda t: lambda x: x == t
    words = F.transform(T.tokens(F.col("text")), T.fold) if folded else T.tokens(F.col("text"))
    rows = rows.withColumn("__w", words)
    return rows.withColumn("len", F.size("__w")).withColumn("tf", F.array(*(F.size(F.filter("__w", same(t))) for t in terms))).drop("__w")


def statistics(counted: DataFrame, terms: list[str]) -> dict:
    """Passages, mean length and document frequency of each term: one row."""
    df = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    r = counted.agg(F.count("*").alias("n"), F.sum("len").alias("words"), *df).first()
    return {"n": r["n"], "mean": (r["words"] or 0) / max(1, r["n"]), "df": [r[f"df{i}"] for i in range(len(terms))]}


def bm25(stats: dict) -> Column:
    """Score of a counted row; terms are summed in their order."""
    norm = K1 * (1 - B + B * F.col("len") / max(1.0, stats["mean"]))
    out = F.lit(0.0)
    for i, df in enumerate(stats["df"]):
        idf = F.log(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        tf = F.col("tf")[i]
        out = out + idf * tf * (K1 + 1) / (tf + norm)
    return out


def search(rows: DataFrame, terms: list[str], k: int, phrase: list[str] | None = None, all_terms: bool = False, folded: bool = False) -> DataFrame:
    """The k best passages; ties go to the smaller (doc_id, pos)."""
    counted = term_counts(rows, terms, folded)
    stats = statistics(counted, terms)
    if phrase:
        counted = counted.filter(T.has_phrase(T.tokens(F.col("text")), phrase))
    if all_terms:
        counted = counted.filter(F.forall("tf", lambda x: x > 0))
    matched = F.size(F.filter("tf", lambda x: x > 0))
    scored = counted.filter(matched > 0).withColumn("score", F.round(bm25(stats) + 1.25 * matched + (4.0 if phrase else 0.0), 6))
    return scored.orderBy(F.desc("score"), "doc_id", "pos").limit(k)


def with_context(rows: DataFrame) -> DataFrame:
    """Adds heading (last earlier line of at most three words), before and after (neighbours' texts)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    short = F.when(F.size(T.tokens(F.col("text"))) <= 3, F.col("text"))
    carried = F.last(short, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"heading": carried, "before": F.lag("text").over(order), "after": F.lead("text").over(order)})


def rerank(scored: DataFrame) -> DataFrame:
    """doc_id, score: best passage, a quarter of the three best, later passages counting ever less."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")) - 1
    ranked = scored.withColumn("rank", rank)
    return ranked.groupBy("doc_id").agg(
        F.round(F.max("score") + 0.25 * F.sum(F.when(F.col("rank") < 3, F.col("score"))), 6).alias("doc_score"),
        F.round(F.sum(F.col("score") / (1 + 0.18 * F.col("rank"))), 6).alias("reweighted"),
        F.count("*").alias("passages"),
    )


TERMS = ["license", "therhean", "erreth"]
_P = r"""
with line as (select doc_id, source, lang, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
p as (select *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from line where regexp_matches(text, '[\p{L}\p{N}]')),
c as (select *, len(w) as n, [len(list_filter(w, lambda x: x = t)) for t in ['license', 'therhean', 'erreth']] as tf from p),
s as (select count(*) as total, sum(n) / count(*) as mean, count_if(tf[1] > 0) as d1, count_if(tf[2] > 0) as d2, count_if(tf[3] > 0) as d3 from c),
k as (select doc_id, pos, text, w, n, tf, len(list_filter(tf, lambda x: x > 0)) as matched,
  ln(1 + (total - d1 + 0.5) / (d1 + 0.5)) * tf[1] * 2.2 / (tf[1] + 1.2 * (0.25 + 0.75 * n / greatest(1, mean)))
  + ln(1 + (total - d2 + 0.5) / (d2 + 0.5)) * tf[2] * 2.2 / (tf[2] + 1.2 * (0.25 + 0.75 * n / greatest(1, mean)))
  + ln(1 + (total - d3 + 0.5) / (d3 + 0.5)) * tf[3] * 2.2 / (tf[3] + 1.2 * (0.25 + 0.75 * n / greatest(1, mean))) as bm from c, s)
"""


def _all_terms(spark, d):
    return search(passages(table(spark, d, "documents")), ["license", "mit"], 50, all_terms=True).select("doc_id", "pos")


def _context(spark, d):
    rows = with_context(passages(table(spark, d, "documents")))
    return rows.select("doc_id", "pos", F.md5(F.coalesce("heading", F.lit(""))).alias("heading"), F.md5(F.coalesce("before", F.lit(""))).alias("before"), F.md5(F.coalesce("after", F.lit(""))).alias("after"))


def _rerank(spark, d):
    counted = term_counts(passages(table(spark, d, "documents")), TERMS)
    scored = counted.withColumn("score", F.round(bm25(statistics(counted, TERMS)), 6)).filter("score > 0")
    return rerank(scored)


def _df(spark, d):
    words = passages(table(spark, d, "documents")).select("doc_id", "pos", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def _lengths(spark, d):
    return passages(table(spark, d, "documents")).groupBy("lang").agg(F.count("*").alias("passages"), F.sum(F.size(T.tokens(F.col("text")))).cast("long").alias("words"))


def _fold(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.fold(F.col("word")).alias("stem"))


_STEM = "cast(word as varchar)"
_FOLD = r"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as word from documents),
a as (select word, case when regexp_matches(word, 'ies$') then regexp_replace(word, 'ies$', 'y')
  when regexp_matches(word, '(?:ches|shes|sses|xes|zes)$') then regexp_replace(word, 'es$', '')
  when regexp_matches(word, '[^sui]s$') then regexp_replace(word, 's$', '') else word end as v from w),
b as (select word, case when length(regexp_replace(v, '(?:ation|ating|ated|ate)$', '')) >= 4 then regexp_replace(v, '(?:ation|ating|ated|ate)$', '') else v end as v from a),
c as (select word, case when length(regexp_replace(v, '(?:ing|ed)$', '')) >= 4 then regexp_replace(v, '(?:ing|ed)$', '') else v end as v from b),
d as (select word, case when length(v) >= 5 and right(v, 1) = v[-2:-2] and contains('bcdfgkmnprt', right(v, 1)) then v[:-2] else v end as v from c),
e as (select word, case when length(regexp_replace(v, '([st])ion$', '\1')) >= 4 then regexp_replace(v, '([st])ion$', '\1') else v end as v from d),
f as (select word, case when length(regexp_replace(v, '(?:ly|al)$', '')) >= 4 then regexp_replace(v, '(?:ly|al)$', '') else v end as v from e),
g as (select word, case when length(regexp_replace(v, 'e$', '')) >= 4 then regexp_replace(v, 'e$', '') else v end as v from f)
select word, case when regexp_matches(word, '^[a-z]{5,}$') then v else word end as stem from g
"""

QUERIES = {
    "all_terms_gate": (_all_terms, r"""
with line as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
p as (select *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from line where regexp_matches(text, '[\p{L}\p{N}]')),
c as (select *, len(w) as n, [len(list_filter(w, lambda x: x = t)) for t in ['license', 'mit']] as tf from p),
s as (select count(*) as total, sum(n) / count(*) as mean, count_if(tf[1] > 0) as d1, count_if(tf[2] > 0) as d2 from c)
select doc_id, pos from (select doc_id, pos, round(ln(1 + (total - d1 + 0.5) / (d1 + 0.5)) * tf[1] * 2.2 / (tf[1] + 1.2 * (0.25 + 0.75 * n / greatest(1, mean)))
  + ln(1 + (total - d2 + 0.5) / (d2 + 0.5)) * tf[2] * 2.2 / (tf[2] + 1.2 * (0.25 + 0.75 * n / greatest(1, mean))) + 2.5, 6) as score
from c, s where tf[1] > 0 and tf[2] > 0) order by score desc, doc_id, pos limit 50"""),
    "heading_neighbour_context": (_context, r"""
with line as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
p as (select *, case when len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) <= 3 then text end as short from line where regexp_matches(text, '[\p{L}\p{N}]')),
x as (select doc_id, pos, last_value(short ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as h,
  lag(text) over (partition by doc_id order by pos) as b, lead(text) over (partition by doc_id order by pos) as a from p)
select doc_id, pos, md5(coalesce(h, '')) as heading, md5(coalesce(b, '')) as before, md5(coalesce(a, '')) as after from x"""),
    "passage_rerank": (_rerank, _P + """, z as (select doc_id, pos, round(bm, 6) as score from k where round(bm, 6) > 0),
r as (select *, row_number() over (partition by doc_id order by score desc, pos) - 1 as rank from z)
select doc_id, round(max(score) + 0.25 * sum(case when rank < 3 then score end), 6) as doc_score, round(sum(score / (1 + 0.18 * rank)), 6) as reweighted, count(*) as passages from r group by doc_id"""),
    "term_df": (_df, r"""
with line as (select unnest(string_split(text, chr(10))) as text from documents)
select term, count(*) as df from (select unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as term from line)  group by term"""),
    "doc_length_stats": (_lengths, r"""
with line as (select lang, unnest(string_split(text, chr(10))) as text from documents)
select lang, count(*) as passages, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))::bigint as words from line where regexp_matches(text, '[\p{L}\p{N}]') group by lang"""),
    "fold_terms": (_fold, _FOLD),
}
