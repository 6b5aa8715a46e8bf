"""Quality rules: fixed counts, then distribution divergence from language references.

Each text gives two histograms: characters by class (upper case, digits, white space, punctuation,
symbols, bytes beyond the first of a character, all others) and words by the common words of its
language (one bin each, one for all others). Common words and references are learned for every
labelled language: its words of at most SHORT letters that most of its texts hold, and the sums of
the histograms of all its texts that pass the fixed rules. A text is kept if, for both
histograms, its Jensen-Shannon distance to its language's reference is small enough for its length;
histograms below a minimum length are not judged. All of it is DataFrame functions.

Null or empty text: no words, so it fails the fixed rules. Texts of a null language, or of one with
fewer than MIN_TEXTS texts that pass the fixed rules, are held to the fixed rules only. Ties among
common words are broken by the word. Repeated rows: a result each. Empty table: empty result. Other
columns are ignored by ``judged`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import WORD, quoted
from parchmint.session import held, materialize

#: Common words of a language, their letters at most, and texts that its reference must come from.
BINS, SHORT, MIN_TEXTS = 24, 5, 50
#: Largest distance (base 2) of classes; that of words is FLOOR + SPREAD / sqrt(words), as chance differs by length.
MAX_CLASS, FLOOR, SPREAD = 0.25, 0.05, 2.8
#: Lengths below which a histogram isn't judged.
MIN_CHARS, MIN_LETTER_WORDS = 200, 40
SYMBOLS = r"[^#*$%&|<>]+"
#: Upper case, digits and punctuation are what is left without these patterns.
UPPER, DIGITS, MARKS, KINDS = r"[^A-Z]+", r"[^0-9]+", r"[^.,;:!?'\x22()-]+", 7
#: What none of the four keeps: taken away first, so that they read a few characters instead of the whole text.
OTHERS = r"[^A-Z0-9.,;:!?'\x22()#*$%&|<>-]+"
#: Runs of letters in lower case.
LETTERS = r"[^\x00-\x60\x7B-\x7F]+"
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated(tri: Column) -> Column:
    """Words that stand in 3-word windows (as 64-bit hashes: a clash within a text is not to be expected) found twice or more."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["t"] == x["t"])) | F.coalesce(F.get(s, i + 1)["t"] == x["t"], F.lit(False)))
        return let(F.transform(twice, lambda x: x["i"]), lambda p: F.size(F.array_distinct(F.flatten(F.array(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))))

    placed = F.transform(tri, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), 0).otherwise(let(F.array_sort(placed), covered))


def language(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def common_words(docs: DataFrame) -> DataFrame:
    """lang, bins: the BINS words that most texts of each labelled language hold.

    Written, so that its size is known to the optimizer when it is joined.
    """
    short = F.filter(letter_words(F.col("text").cast("string")), lambda x: F.length(x) <= SHORT)
    words = docs.select(language(docs).alias("lang"), F.explode(F.array_distinct(short)).alias("word")).filter("lang is not null")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BINS)
    return materialize(best.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("bins")).coalesce(1), "common")


def features(docs: DataFrame, common: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, the fixed counts, base_failed, classes array<long>, words array<int>; row, if carried.

    words is null for languages without common words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace("s", pattern, ""))  # noqa: E731  what is left without the pattern
    more = ["row"] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(docs).alias("lang"), text.alias("t"), *([F.struct(*quoted(docs)).alias("row")] if carry else []))
    rows = rows.withColumn("s", F.regexp_replace("t", OTHERS, ""))
    rows = rows.join(common, "lang", "left").select(
        "doc_id", "lang", *more, "bins", F.length("t").alias("n"), F.octet_length("t").alias("octets"), left(SYMBOLS).alias("n_symbols"), left(UPPER).alias("upper"), left(DIGITS).alias("digits"), left(MARKS).alias("marks"),
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        letter_words(F.col("t")).alias("lw"),
    )
    rows = rows.withColumn("blank", F.col("n") - F.length(F.array_join("w", "")))
    rows = rows.withColumn("c", F.filter(F.transform(F.filter("lw", lambda x: F.length(x) <= SHORT), lambda x: F.array_position("bins", x)), lambda x: x > 0))
    rows = rows.withColumn("tri", F.when(F.size("w") >= 3, F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(
        "doc_id", "lang", *more,
        F.size("w").cast("long").alias("n_words"),
        (F.col("n") - F.col("blank")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("tri")).cast("long").alias("n_repeat_words"),
        F.array("upper", "digits", "blank", "marks", "n_symbols", F.col("octets") - F.col("n"), F.col("n") - F.col("upper") - F.col("digits") - F.col("blank") - F.col("marks") - F.col("n_symbols")).cast("array<long>").alias("classes"),
        F.when(F.col("bins").isNotNull(), F.concat(F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda k: F.size("c") - F.size(F.array_remove("c", k.cast("long")))), F.array(F.size("lw") - F.size("c")))).alias("words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def total(name: str) -> Column:
    return F.aggregate(F.col(name), F.lit(0).cast("long"), lambda a, x: a + x)


def references(made: DataFrame) -> DataFrame:
    """lang, class_share, word_share: distributions of each language, from all its texts that pass the fixed rules.

    Written, so that its size is known to the optimizer when it is joined.
    """
    # Conditional sums: a filter on base_failed would be moved below the features and make them twice.
    good = lambda x: F.coalesce(F.sum(F.when(~F.col("base_failed") & F.col("words").isNotNull(), x)), F.lit(0))
    sums = lambda name, n: F.array(*(good(F.get(F.col(name), F.lit(i))) for i in range(n)))
    rows = made.filter(F.col("lang").isNotNull()).groupBy("lang").agg(good(F.lit(1)).alias("texts"), sums("classes", KINDS).alias("c"), sums("words", BINS + 1).alias("w"))
    shares = lambda name: let(total(name).cast("double"), lambda n: F.transform(name, lambda x: x / n))
    rows = rows.filter((F.col("texts") >= MIN_TEXTS) & (total("c") > 0) & (total("w") > 0))
    return materialize(rows.select("lang", shares("c").alias("class_share"), shares("w").alias("word_share")).coalesce(1), "references")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts to a distribution."""
    half = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    terms = lambda n: F.zip_with(counts, reference, lambda x, q: let(x / n, lambda p: half(p, (p + q) / 2) + half(q, (p + q) / 2)))
    return let(n.cast("double"), lambda n: F.sqrt(F.greatest(F.aggregate(terms(n), F.lit(0.0), lambda a, x: a + x) / 2 / F.log(F.lit(2.0)), F.lit(0.0))))


def verdict() -> Column:
    """Whether a row of ``features`` with its language's reference is kept."""
    classes = (total("classes") < MIN_CHARS) | (distance(F.col("classes"), F.col("class_share")) <= MAX_CLASS)
    words = (total("words") < MIN_LETTER_WORDS) | (distance(F.col("words"), F.col("word_share")) <= FLOOR + SPREAD / F.sqrt(total("words").cast("double")))
    return F.when(F.col("base_failed"), F.lit(False)).when(F.col("word_share").isNull(), F.lit(True)).otherwise(classes & words)


def judged(docs: DataFrame) -> DataFrame:
    """The fixed counts, base_failed and kept of every row; what is kept passes both."""
    made = held(features(docs, common_words(docs)))
    found = materialize(made.join(references(made), "lang", "left").select("doc_id", *FACTS, "base_failed", verdict().alias("kept")), "judged")
    made.unpersist()
    return found


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Features are made once and kept with their rows on the executors' disks (``session.let_go``
    frees them). inline() of one row or none filters after the verdict is made; a filter's condition
    would be computed twice.
    """
    made = held(features(docs, common_words(docs), carry=True).select("row", "lang", "base_failed", "classes", "words"))
    return made.join(references(made), "lang", "left").select(F.inline(F.when(verdict(), F.array("row"))))
