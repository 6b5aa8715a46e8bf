"""Personal data, addresses and names in texts, as column expressions.

A text is read as tokens: words, numbers, runs of white space, single marks. Each token has a kind,
told by one letter (``kinds``), and a form of personal data is a production over kinds (``FORMS``). So
a form says what it consists of, not how its letters look:

    m  Mr, Mrs, Ms, Mx          M  the same in capitals        d  Dr, Hon (only with a full stop)
    c  a contact label          i  information                 f  a telephone label
    e  an extension label       x  x                           a  at             o  dot
    s  a street word            b  Box                         u  a word for a unit
    r  a series of rule numbers N  a capitalised word          C  a word in capitals
    S  two capitals             I  one capital                 w  any other word
    1 to 5  a number of so many digits, 6 a longer one         a blank for white space
    marks stand for themselves; dashes of any width are -, marks that no form uses are !

Numbers of rule series (OAR 340-041-0001) are no telephone numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.session import table

_TOKEN = r"\p{L}[\p{L}\p{M}'’]*|\d+|\s+|[^\p{L}\d\s]"
#: Words of each kind, lower case (fixed values: titles, labels; suffixes of the postal service's list with their abbreviations).
WORDS = {
    "m": "mr mrs ms mx",
    "d": "dr hon",
    "c": "attention attn contact director manager officer",
    "i": "information",
    "f": "cell direct fax line mobile phone tel telephone",
    "e": "ext extension",
    "x": "x",
    "a": "at",
    "o": "dot",
    "s": "alley aly avenue ave boulevard blvd bridge brg circle cir court ct crossing xing drive expressway expy freeway fwy heights hts highway hwy lane ln loop parkway pkwy path pike place pl plaza plz point pt ridge rdg road rd route rte row square sq street st terrace ter trail trl turnpike tpke way",
    "b": "box",
    "u": "apartment apt floor fl room rm suite ste unit",
    "r": "oar wac idapa",
}
_WORD = "mMdcifexaosburNCSIw"  # all kinds of words
_CAPITAL = "NCSIsmMdb"  # kinds that a capitalised word may have
_NAME = "[NCs]"
_PLACE = f"[{_CAPITAL}][.]?(?: [{_CAPITAL}][.]?){{0,3}}"
_CODE = "(?:S|[NC](?: [NC])?) 5(?:-4)?"
#: Productions over the kinds of tokens.
FORMS = {
    "email": f"[{_WORD}1-6][{_WORD}1-6._+-]*@[{_WORD}1-6-]+(?:[.][{_WORD}1-6-]+)+",
    "spelled_email": f"[{_WORD}1-6][{_WORD}1-6._-]* ?[(\\[]a[)\\]] ?[{_WORD}1-6-]+(?: ?(?:[(\\[]o[)\\]]|[.]| o ) ?[{_WORD}1-6-]+)+",
    "phone": "(?:[(]3[)][ .-]?|3[ .-])3[ .-]4|f: ?[+]?[1-6](?:[ .()/-]{1,2}[1-6])+",
    "extension": "e[.]? ?#? ?[1-6]|x[2-6]",
    "person_title": f"(?:m[.]?|[Md][.]) {_NAME}|M C",
    "contact_lead": f"(?:c(?: [wi])?: ?|i,? c:? ){_NAME}(?: I[.])? {_NAME}",
    "postal_block": f"[1-6] (?:[{_CAPITAL}1-6][.]? ){{0,4}}s[.]?(?:,? (?:u[.]?|#) ?[{_WORD}1-6-]+|,? [SI])*,? {_PLACE},? {_CODE}|I[.]? ?I?[.]? b [1-6],? {_PLACE},? {_CODE}|S b [1-6],? {_PLACE},? {_CODE}",
}
#: A rule number in kinds, and what takes its place.
RULE_NUMBER = ("r 3-3-4", "!")


def kinds(text: Column) -> Column:
    """The kinds of a text's tokens, one letter each."""

    def kind(token: Column) -> Column:
        low, out = F.lower(token), F.when(token.rlike(r"^\s"), F.lit(" "))
        out = out.when(token.rlike(r"^\d"), F.least(F.length(token), F.lit(6)).cast("string"))
        out = out.when(low.isin(*WORDS["m"].split()), F.when(token.rlike("^[A-Z]{2,}$"), "M").when(token.rlike("^[A-Z]"), "m").otherwise("w"))
        for k in "cifexaobr":
            out = out.when(low.isin(*WORDS[k].split()), F.lit(k))
        for k in "dsu":  # only with a capital
            out = out.when(token.rlike("^[A-Z]") & low.isin(*WORDS[k].split()), F.lit(k))
        return (
            out.when(token.rlike("^[A-Z]$"), "I")
            .when(token.rlike("^[A-Z]{2}$"), "S")
            .when(token.rlike("^[A-Z][A-Z'’]+$"), "C")
            .when(token.rlike("^[A-Z]"), "N")
            .when(token.rlike(r"^\p{L}"), "w")
            .when(token.rlike("^[‐-―-]$"), "-")
            .when(token.rlike(r"^[.,@()\[\]:#/_+]$"), token)
            .otherwise("!")
        )

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.regexp_replace(F.array_join(F.transform(tokens, kind), ""), *RULE_NUMBER)


def personal(text: Column) -> dict[str, Column]:
    """How often each form of personal data stands in a text; null has none."""
    read = kinds(text)
    return {name: F.regexp_count(read, F.lit(p)).cast("long") for name, p in FORMS.items()}


def guarded(rows: DataFrame, text: str, cap: int, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without personal data, at most ``cap`` of each key in order; key, withheld, cut: what is left out)."""
    from pyspark.sql import Window

    hit = sum(personal(F.col(text)).values(), F.lit(0)) > 0
    marked = rows.withColumn("__hit", hit)
    rank = F.row_number().over(Window.partitionBy(key, "__hit").orderBy(*order))
    ranked = marked.withColumn("__n", rank)
    out = ranked.groupBy(key).agg(F.count_if("__hit").alias("withheld"), F.count_if(~F.col("__hit") & (F.col("__n") > cap)).alias("cut"))
    return ranked.filter(~F.col("__hit") & (F.col("__n") <= cap)).drop("__hit", "__n"), out


def safe_url(url: Column) -> Column:
    """Whether an address may be shown: https, a host with a dot, no user, port or white space."""
    return F.coalesce(url.rlike(r"^https://[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?:[/?#]\S*)?$"), F.lit(False))


def names_state(text: Column, names: list[str]) -> Column:
    """Names of states that stand in a text as whole words; of overlapping ones the longest (West Virginia, not Virginia)."""
    pattern = r"\b(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def caption(court: Column, name: Column) -> Column:
    """A case as shown: its caption, or only its court where the caption names a person by title."""
    return F.when(kinds(name).rlike(FORMS["person_title"]), F.concat(F.lit("Case in "), court)).otherwise(F.concat_ws(", ", name, court))


#: One text of each form, to be found behind the documents' own texts, and some that are none.
_SAMPLES = ["mail a.b@c.org now", "write x [at] y [dot] gov", "call (503) 555-0123", "at ext. 4521", "ask Dr. Longname today", "Contact: Anna B. Smith", "to 12 Main Street, Salem, OR 97301", "see OAR 340-041-0001", "P.O. Box 12, Salem, OR 97301", "MS Gulf Coast", "Contact: Office of Lands", "MRS SAMPLE of 9 Oak Ter. Apt 4, Bend, Oregon 97701-1234"]


def _guard(spark, d):
    sample = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % len(_SAMPLES) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", kinds(F.concat_ws(" ", "text", sample)).alias("k"))
    return rows.select("doc_id", *(F.regexp_count("k", F.lit(p)).cast("long").alias(n) for n, p in FORMS.items()))


def _capped(spark, d):
    rows = table(spark, d, "conversations")
    kept, out = guarded(rows.withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" call (503) 555-0123"))).otherwise(F.col("text"))), "text", 2, "conv_id", ["turn"])
    return out.join(kept.groupBy("conv_id").agg(F.count("*").alias("shown")), "conv_id", "left").select("conv_id", "withheld", "cut", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"))


def _urls(spark, d):
    k = F.col("page_id") % 5
    url = F.when(k == 1, F.regexp_replace("url", "^https", "http")).when(k == 2, F.regexp_replace("url", "^https?://", "https://user@")).when(k == 3, F.concat("url", F.lit(" x"))).otherwise(F.regexp_replace("url", "^http:", "https:"))
    return table(spark, d, "pages").select("page_id", safe_url(url).alias("safe"))


def _states(spark, d):
    n = F.col("c_custkey") % 4
    text = F.concat(F.lit("In "), F.when(n == 0, "West Virginia and Oregon").when(n == 1, "Virginia").when(n == 2, "Washingtonian Idaho").otherwise("no state"), F.lit(" the law of "), F.when(F.col("c_nationkey") % 2 == 0, "Oregon").otherwise("the land"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(names_state(text, ["Virginia", "West Virginia", "Oregon", "Washington", "Idaho"]), ",").alias("states"))


def _captions(spark, d):
    c = table(spark, d, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Mr. Smith").otherwise("Smith"), F.lit(" v. "), "c_name")
    return c.select("c_custkey", caption(F.concat(F.lit("Court of "), F.col("c_mktsegment")), name).alias("shown"))


def _kinds_sql() -> str:
    """The tokens' kinds in SQL."""
    words = lambda k: "lower(x) in (" + ", ".join(f"'{w}'" for w in WORDS[k].split()) + ")"
    test = lambda p: f"regexp_matches(x, '{p}')"
    cases = [(test(r"^\s"), "' '"), (test(r"^\d"), "least(length(x), 6)::varchar"), (f"{words('m')} and {test('^[A-Z]{2,}$')}", "'M'"), (f"{words('m')} and {test('^[A-Z]')}", "'m'"), (words("m"), "'w'")]
    cases += [(words(k), f"'{k}'") for k in "cifexaobr"] + [(f"{test('^[A-Z]')} and {words(k)}", f"'{k}'") for k in "dsu"]
    cases += [(test("^[A-Z]$"), "'I'"), (test("^[A-Z]{2}$"), "'S'"), (test("^[A-Z][A-Z''’]+$"), "'C'"), (test("^[A-Z]"), "'N'"), (test(r"^\p{L}"), "'w'"), (test("^[‐-―-]$"), "'-'"), (test(r"^[.,@()\[\]:#/_+]$"), "x")]
    case = "case " + " ".join(f"when {a} then {b}" for a, b in cases) + " else '!' end"
    samples = ", ".join(f"'{x}'" for x in _SAMPLES)
    token = _TOKEN.replace("'", "''")
    return f"""with t as (select doc_id, regexp_extract_all(concat_ws(' ', text, [{samples}][1 + doc_id % {len(_SAMPLES)}]), '{token}') as t from documents),
c as (select doc_id, replace(array_to_string(list_transform(t, lambda x: {case}), ''), '{RULE_NUMBER[0]}', '{RULE_NUMBER[1]}') as k from t)
select doc_id, """ + ", ".join(f"len(regexp_extract_all(k, '{p}'))::bigint as {n}" for n, p in FORMS.items()) + " from c"


QUERIES = {
    "pii_guard": (_guard, _kinds_sql()),
    "guarded_rows": (_capped, """
with r as (select conv_id, conv_id % 3 = 0 as hit, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, count_if(hit) as withheld, count_if(not hit and n > 2) as cut, count_if(not hit and n <= 2) as shown from r group by conv_id"""),
    "safe_urls": (_urls, r"""
with u as (select page_id, case page_id % 5 when 1 then regexp_replace(url, '^https', 'http') when 2 then regexp_replace(url, '^https?://', 'https://user@') when 3 then url || ' x' else regexp_replace(url, '^http:', 'https:') end as u from pages)
select page_id, starts_with(u, 'https://') and not contains(u, '@') and not contains(u, ' ') as safe from u"""),
    "state_names": (_states, """
select c_custkey, array_to_string(list_sort(list_distinct(case c_custkey % 4 when 0 then ['West Virginia', 'Oregon'] when 1 then ['Virginia'] when 2 then ['Idaho'] else [] end || case when c_nationkey % 2 = 0 then ['Oregon'] else [] end)), ',') as states from customer"""),
    "safe_captions": (_captions, "select c_custkey, case when c_custkey % 3 = 0 then 'Case in Court of ' || c_mktsegment else 'Smith v. ' || c_name || ', Court of ' || c_mktsegment end as shown from customer"),
}
