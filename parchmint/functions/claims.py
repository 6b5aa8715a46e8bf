"""Span claims over typed queries: what each part of a query is read as, and spans that are protected.

Candidates come from forms (identifiers with their places in a text) and from a table of names
(laws, their acronyms, issues), which meets the queries by an equality join on runs of words, so that
any number of names costs one shuffle. In the order of forms, then of places, a candidate becomes a
claim if it overlaps no earlier claim. A claim may have several readings; it is open if none is chosen.

Names of peoples, treaties and case captions are productions over kinds of words that grow from an
anchor to both sides; spans that only white space parts are one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.citations import PATTERNS
from parchmint.session import ship, table

_FREE, _END = r"(?<![\w-])", r"(?![\w-])"
_NUMBER = r"\s*(?:No\.?\s*)?(\d{1,5})(?![\w-])"
_CONGRESS = r"(?:,?\s*\(?(\d{2,3})(?:st|nd|rd|th)?(?:\s+Congress)?\)?(?![\w-])(?!\s*(?:U\.?\s?S|C\.?\s?F|Stat|F(?:ed)?\.?\s?R)))?"
_BIENNIUM = r"(?:,?\s+((?:19|20)\d\d-\d\d)(?![\w-]))?"
#: Forms of identifiers in the order in which they claim: kind, pattern with up to three parts. Names of laws
#: come before the first, acronyms and names of issues after the last.
FORMS = (
    ("docket", rf"{_FREE}([a-z]{{2,}}(?:-[a-z0-9]{{1,10}}){{0,4}}-(?:19|20)\d\d-\d{{4,6}}){_END}"),
    ("usc", PATTERNS["usc"]),
    ("cfr", PATTERNS["cfr"]),
    ("public_law", r"\b(?:Pub(?:lic|\.)\s+L(?:aw|\.)|P\.?\s?L\.?)\s+(?:No\.\s+)?(\d{2,3})[-‐–](\d{1,4})"),
    ("statute", PATTERNS["statutes"]),
    ("fr_citation", r"\b(\d{1,3})\s+F(?:ed)?\.?\s?R(?:eg)?\.?\s+(\d{1,6})\b"),
    ("us_reports", r"\b(\d{1,3})\s+U\.?\s?S\.?\s+(\d{1,4})\b"),
    ("state_code", r"\b(RCW|WAC|ORS|OAR|IDAPA|Idaho\s+Code)\s+(?:§+\s*)?(\d+(?:[.-]\d+){1,2}[A-Z]?)\b"),
    ("federal_bill", rf"(?<![\w.])(H\.?\s?R\.?|[HS]\.?\s?(?:(?:J|Con)\.?\s?)?Res\.?){_NUMBER}{_CONGRESS}"),
    ("state_bill", rf"(?<![\w.])(H\.?\s?B\.?|House\s+Bill|S\.?\s?B\.?|Senate\s+Bill){_NUMBER}{_BIENNIUM}"),
    ("short_bill", rf"(?<![\w.])(H|S\.?){_NUMBER}{_CONGRESS}"),
    ("district_docket", rf"{_FREE}(\d{{1,2}}:\d\d-(?:cv|cr|mc|md|mj)-\d{{3,6}}){_END}"),
    ("court_docket", rf"{_FREE}(\d\d)-(\d{{1,5}}){_END}"),
    ("rin", rf"{_FREE}(\d{{4}})-([a-z]{{2}}\d\d){_END}"),
    ("fr_document", rf"{_FREE}(199[4-9]|20\d\d)-(\d{{4,5}}){_END}"),
    ("executive_order", r"\b(?:Executive|Exec\.)\s+Order\s+(?:No\.\s*)?(\d{4,5})\b|(?<![\w.])[EX]\.?\s?O\.?\s*(\d{5})\b"),
)
KINDS = ("law_name", *(k for k, _ in FORMS), "acronym", "issue")
#: Numbers of bills by state and chamber (fixed values).
RANGES = {"WA": {"house": (1000, 2999), "senate": (5000, 6999)}, "OR": {"house": (2001, 4999), "senate": (1, 1999)}, "ID": {"house": (1, 999), "senate": (1001, 1999)}}
STATES = {"WA": "Washington", "OR": "Oregon", "ID": "Idaho"}
#: Codes by state (fixed values).
CODES = {"RCW": "WA", "WAC": "WA", "ORS": "OR", "OAR": "OR", "IDAPA": "ID", "IDAHO CODE": "ID"}
CIRCUITS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh".split()
#: Most words of a name.
LONGEST = 14
_READINGS = "array<struct<kind:string,identifier:string,jurisdiction:string>>"


def spots(patterns: tuple[str, ...], flags: int = 0):
    """A function of a text: array of (form, start, stop, a, b, c) for every match of every pattern."""
    names = ("form", "start", "stop", "a", "b", "c")

    @F.pandas_udf("array<struct<form:int,start:int,stop:int,a:string,b:string,c:string>>")
    def found(col: pd.Series) -> pd.Series:
        rules = [re.compile(p, flags) for p in patterns]

        def one(text):
            return [dict(zip(names, (i, *m.span(), *(*m.groups(), None, None, None)[:3]))) for i, r in enumerate(rules) for m in r.finditer(text or "")]

        return col.map(one, na_action=None)

    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’.]*"), F.lit(0))


def name_hits(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, start, stop, name, kind: names (name, kind) that stand in a text as whole words, whatever their case and white space.

    Names in capitals only (acronyms) must stand as they are.
    """
    folded = names.select("name", "kind", F.filter(F.split("name", r"[^\p{L}\p{N}'’]+"), lambda w: w != "").alias("ws"))
    folded = folded.select("name", "kind", F.array_join("ws", " ").alias("said"), F.size("ws").alias("n"))
    longest = min(LONGEST, folded.agg(F.max("n")).first()[0] or 0)  # longer runs meet no name
    # Places of words: pieces between them keep their lengths.
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[\p{L}\p{N}'’])(?![\p{L}\p{N}'’])|(?<![\p{L}\p{N}'’])(?=[\p{L}\p{N}'’])")
    ends = F.aggregate("w", F.array(F.lit(0)), lambda at, p: F.concat(at, F.array(F.element_at(at, -1) + F.length(p))))
    rows = rows.select(F.col(key).alias("__k"), pieces.alias("w")).withColumn("at", ends)
    placed = F.filter(F.transform(F.arrays_zip("w", "at"), lambda x: F.struct(x.w.alias("w"), x.at.alias("at"))), lambda x: x.w.rlike(r"^[\p{L}\p{N}]"))
    runs = rows.select("__k", placed.alias("words")).select("__k", "words", F.posexplode("words").alias("i", "first"))
    runs = runs.select("__k", F.col("first.at").alias("start"), F.slice("words", F.col("i") + 1, F.lit(max(1, longest))).alias("run"))
    grams = runs.select("__k", "start", F.posexplode("run").alias("n", "last"), "run")
    said = F.array_join(F.transform(F.slice("run", F.lit(1), F.col("n") + 1), lambda r: r.w), " ")
    grams = grams.select("__k", "start", (F.col("last.at") + F.length("last.w")).alias("stop"), said.alias("said"))
    folded = folded.drop("n")
    capitals = folded.filter(F.col("name").rlike("^[A-Z0-9]+$"))
    others = folded.filter(~F.col("name").rlike("^[A-Z0-9]+$")).withColumn("said", F.lower("said"))
    hits = grams.join(capitals, "said").unionByName(grams.withColumn("said", F.lower("said")).join(others, "said"))
    return hits.select(F.col("__k").alias(key), "start", "stop", "name", "kind").distinct()


def _reading(kind: str, identifier: Column, jurisdiction: Column | str = "federal") -> Column:
    where = F.lit(jurisdiction) if isinstance(jurisdiction, str) else jurisdiction
    return F.struct(F.lit(kind).alias("kind"), identifier.alias("identifier"), where.alias("jurisdiction"))


def _context(text: Column) -> dict[str, Column]:
    """What a whole query says about its parts: states, a Congress, courts."""
    state = lambda n: text.rlike(rf"(?i)\b{n}\b(?!\s*,?\s*D\.?\s?C\b)(?!\s+(?:County|City|Falls)\b)(?!.*\bv\.)")
    circuit = [F.when(text.rlike(rf"(?i)\b{c}\s+circuit\b|\bca{i + 1}\b"), F.lit(f"ca{i + 1}")) for i, c in enumerate(CIRCUITS)]
    return {
        "states": F.array_compact(F.array(*(F.when(state(n), F.lit(s)) for s, n in STATES.items()))),
        "congress": F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\b(\d{2,3})(?:st|nd|rd|th)\s+Congress\b", 1), F.lit("")), F.regexp_extract(text, r"(?i)\bCongress\s+(\d{2,3})\b", 1)), F.lit("")),
        "federal": text.rlike(r"(?i)\bcongress(?:ional)?\b|\bU\.S\.\s+(?:House|Senate)\b"),
        "courts": F.array_compact(F.array(F.when(text.rlike(r"(?i)\b(?:supreme\s+court|scotus)\b"), F.lit("supreme")), *circuit)),
    }


def candidates(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, start, stop, readings, open: identifiers in queries with all they may be read as."""
    ship(queries.sparkSession)
    rows = queries.select(key, F.col(text).alias("text"), *(c.alias(n) for n, c in _context(F.col(text)).items()))
    found = spots(tuple(p for _, p in FORMS), re.IGNORECASE)(F.col("text"))
    rows = rows.withColumn("spots", found).select("*", F.inline("spots")).drop("spots")
    a, b, c = F.upper("a"), F.upper("b"), F.col("c")
    number = F.coalesce(F.when(F.col("b").rlike(r"^\d{1,5}$"), F.col("b").cast("int")), F.lit(0))
    kind = F.element_at(F.array(*(F.lit(k) for k, _ in FORMS)), F.col("form") + 1)
    code = F.regexp_replace(a, r"\s+", " ")
    letters = F.regexp_replace(F.lower("a"), r"[.\s]", "")
    near = F.concat(F.expr("substring(text, greatest(1, start - 3), least(start, 4))"), F.lit("|"), F.expr("substring(text, stop + 1, 4)"))
    postal = [F.when(near.rlike(rf"(?:^|\W){s} *\||\| *{s}(?:\W|$)"), F.lit(s)) for s in STATES]
    states = F.array_union("states", F.array_compact(F.array(*postal)))
    chamber = F.when(letters.isin("hb", "housebill", "h"), "house").otherwise("senate")
    short = kind == "short_bill"

    def bill(state: str) -> Column:
        fits = F.lit(False)
        for name, (low, high) in RANGES[state].items():
            fits = fits | ((chamber == name) & number.between(low, high))
        said = F.concat(F.when(chamber == "house", "H").otherwise("S"), F.lpad(number.cast("string"), 4, "0")) if state == "ID" else F.concat_ws(" ", F.concat(F.when(chamber == "house", "H").otherwise("S"), F.lit("B"), F.lit(" "), number.cast("string")), F.col("c") if state == "WA" else F.lit(None))
        return F.when(fits & (~short | F.lit(state == "ID")), _reading("state_bill", said, state))

    congress = F.coalesce(F.when(c.rlike(r"^\d+$"), c), F.col("congress"))
    federal = F.when(number.between(1, 9999), _reading("federal_bill", F.concat_ws(" ", letters, number.cast("string"), congress)))
    every = F.array_compact(F.array(*map(bill, STATES), F.when(short & (letters == "s"), federal)))
    named = (F.size(states) > 0) | F.col("federal") | (short & congress.isNotNull())
    in_favour = F.filter(every, lambda r: F.array_contains(states, r.jurisdiction) | ((r.jurisdiction == "federal") & (F.col("federal") | congress.isNotNull())))
    docket = F.concat_ws("-", "a", "b")
    courts = F.transform("courts", lambda x: F.named_struct(F.lit("kind"), F.lit("court_docket"), F.lit("identifier"), docket, F.lit("jurisdiction"), x))
    guesses = F.array_compact(F.array(F.when((F.length("b") <= 3) & (F.col("a").cast("int") > 0), _reading("public_law", docket)), F.when(F.length("b") <= 4, _reading("court_docket", docket, "supreme")), _reading("court_docket", docket, "circuit")))
    none = F.from_json(F.lit("[]"), _READINGS)
    one = {
        "docket": _reading("docket", a), "usc": _reading("usc", F.concat_ws(" ", "a", F.lower("b"))), "cfr": _reading("cfr", F.concat_ws(" ", "a", "b")), "public_law": _reading("public_law", F.concat_ws("-", "a", "b")),
        "statute": _reading("statute", F.concat_ws(" ", "a", "b")), "fr_citation": _reading("fr_citation", F.concat_ws(" ", "a", "b")), "us_reports": _reading("us_reports", F.concat_ws(" ", "a", "b")),
        "state_code": _reading("state_code", F.concat_ws(" ", code, b), F.element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), code)),
        "district_docket": _reading("court_docket", F.lower("a"), "district"), "rin": _reading("rin", F.concat_ws("-", a, b)), "executive_order": _reading("executive_order", F.concat(F.lit("E.O. "), F.coalesce("a", "b"))),
    }
    readings = F.when(kind == "federal_bill", F.array_compact(F.array(federal))).when(kind.isin("state_bill", "short_bill"), F.when(named, in_favour).otherwise(every))
    readings = readings.when(kind == "court_docket", F.when(F.size("courts") > 0, courts).otherwise(guesses))
    # Four digits after a year that make a later year are a range of years.
    years = F.col("b").rlike("^(?:19|20)[0-9]{2}$") & (number > F.col("a").cast("int"))
    readings = readings.when(kind == "fr_document", F.when(years, none).otherwise(F.array(_reading("fr_document", docket))))
    for k, r in one.items():
        readings = readings.when(kind == k, F.array(r))
    open_ = F.when(kind.isin("state_bill", "short_bill"), ~named).when(kind == "court_docket", F.size("courts") == 0).otherwise(F.lit(False))
    # A bill whose number fits no state claims nothing; if it fits one that is not named, its place is taken without a reading.
    by_state = F.col("form").isin(KINDS.index("state_bill"), KINDS.index("short_bill"))
    out = rows.select(key, (F.col("form") + 1).alias("form"), "start", "stop", readings.cast(_READINGS).alias("readings"), open_.alias("open"), (named & (F.size(every) > 0)).alias("taken"))
    return out.filter((F.size("readings") > 0) | (by_state & F.col("taken"))).drop("taken")


def claims(queries: DataFrame, key: str, text: str, names: DataFrame | None = None) -> DataFrame:
    """key, place, island, start, stop, readings, open: the claims of each query in order.

    names: name, kind (law_name, acronym or issue), target. Claims that only white space parts share an
    island. Names claim by their kind's turn, longer ones first; one that stands for several targets
    stays open. Of two that start and end alike, the later adds its readings and leaves the claim open.
    """
    every = candidates(queries, key, text)
    if names is not None:
        by_name = names.groupBy("name", "kind").agg(F.array_sort(F.collect_set("target")).alias("targets"))
        hits = name_hits(queries, key, text, names.select("name", "kind").distinct()).join(by_name, ["name", "kind"])
        turn = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
        said = F.when(F.col("kind") == "issue", "issue").otherwise("law_name")
        read = F.transform("targets", lambda t: F.named_struct(F.lit("kind"), said, F.lit("identifier"), t, F.lit("jurisdiction"), F.lit("federal")))
        every = every.unionByName(hits.select(key, turn.alias("form"), "start", "stop", read.cast(_READINGS).alias("readings"), (F.size("targets") > 1).alias("open")))
    # Candidates of a query compete: by form, then by place; names of a form by length first.
    rank = F.struct("form", F.when(F.col("form").isin(0, len(KINDS) - 1), F.col("start") - F.col("stop")).otherwise(0).alias("size"), "start", "stop", "readings", "open")
    sorted_ = every.groupBy(key).agg(F.array_sort(F.collect_list(rank)).alias("all"))
    empty = F.array().cast("array<struct<form:int,size:int,start:int,stop:int,readings:" + _READINGS + ",open:boolean>>")
    overlaps = lambda kept, x: F.exists(kept, lambda k: (k.start < x.stop) & (x.start < k.stop))
    kept = F.aggregate("all", empty, lambda kept, x: F.when(overlaps(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    # What says more of a span that an order or a law has claimed is offered too.
    more = lambda x: F.flatten(F.transform(F.filter("all", lambda y: (y.start == x.start) & (y.stop == x.stop) & (y.form == len(KINDS) - 1) & (x.form != y.form)), lambda y: y.readings))
    rows = sorted_.select(key, F.inline(F.transform(kept, lambda x: F.named_struct(F.lit("start"), x.start, F.lit("stop"), x.stop, F.lit("readings"), F.concat(x.readings, more(x)), F.lit("open"), x.open | (F.size(more(x)) > 0)))))
    rows = rows.join(queries.select(key, F.col(text).alias("text")), key)
    order = Window.partitionBy(key).orderBy("start")
    apart = F.expr("substring(text, coalesce(lag_ + 1, 1), start - coalesce(lag_, 0))").rlike(r"\S")
    rows = rows.withColumn("lag_", F.lag("stop").over(order)).withColumn("fresh", (F.col("lag_").isNull() | apart).cast("int"))
    return rows.select(key, F.row_number().over(order).alias("place"), F.sum("fresh").over(order).cast("int").alias("island"), "start", "stop", "readings", "open")


def routes(queries: DataFrame, key: str, text: str, claimed: DataFrame) -> DataFrame:
    """key, readings, ambiguous, plain, rest: all readings of a query in order, and its text outside the claims."""
    spans = claimed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "readings", "open"))).alias("claims"))
    rows = queries.select(key, F.col(text).alias("text")).join(spans, key, "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<start:int,stop:int,readings:" + _READINGS + ",open:boolean>>")))
    readings = F.flatten(F.transform("claims", lambda c: c.readings))
    blank = lambda t, c: F.concat(F.substring(t, F.lit(1), c.start), F.repeat(F.lit(" "), c.stop - c.start), F.substring(t, c.stop + 1, F.length(t)))
    rest = F.aggregate("claims", F.coalesce(F.col("text"), F.lit("")), blank)
    ambiguous = (F.size(readings) > 1) | F.exists("claims", lambda c: c.open & (F.size(c.readings) > 0))
    return rows.select(key, readings.alias("readings"), ambiguous.alias("ambiguous"), (F.size(readings) == 0).alias("plain"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("rest"))


# --- protected spans ------------------------------------------------------------------------------

#: Words that anchor names of peoples, by kind, and what may stand between the words of a name (fixed values).
ANCHORS = {"T": "band bands colony indians nation nations pueblo pueblos rancheria rancherias reservation reservations tribe tribes".split(), "k": "village villages island islands community communities".split()}
_LETTERS = {"C": ["confederated"], "R": ["treaty"], "o": ["of"], "l": ["the"], "&": ["and", "&"], "w": ["with"], "v": ["v", "v.", "vs", "vs."]}
#: Productions over the kinds of words (N: capitalised, Y: a year, x: any other), a blank between two words.
PROTECTED = {
    "nation_name": "(?:N (?:o )?){0,6}T(?: o (?:l )?N(?: (?:& )?N){0,7})?|C (?:[Nol&] ){0,6}T|(?:N ){1,6}k",
    "treaty_title": "R [ow] (?:l )?N(?: N){0,7}(?:,? Y)?",
    "case_caption": "[NT](?: [NTo&]){0,5} v(?: [NTol&]){0,5} [NT]",
}
_PIECE = r"\s+|[\p{L}\p{N}][\p{L}\p{N}'’.-]*|[^\s\p{L}\p{N}]"


def protected(rows: DataFrame, key: str, text: str, names: DataFrame | None = None) -> DataFrame:
    """key, start, stop, kind: names of peoples, treaties and captions; names: name, a list that is protected too.

    Overlapping spans and those that only white space parts are one, of the first one's kind.
    """
    ship(rows.sparkSession)
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_PIECE), F.lit(0))

    def kind(piece: Column) -> Column:
        low = F.lower(F.regexp_replace(piece, r"[.]+$", ""))
        out = F.when(piece.rlike(r"^\s"), F.lit(" "))
        for k, words in {**_LETTERS, **ANCHORS}.items():
            out = out.when(low.isin(*words), F.lit(k))
        return out.when(low.rlike(r"^(?!diatribes?$)\p{L}+tribes?$"), "T").when(piece.rlike(r"^(?:1[5-9]|20)\d\d$"), "Y").when(piece == ",", ",").when(piece.rlike(r"^\p{Lu}"), "N").otherwise("x")

    base = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), pieces.alias("pieces"))
    base = base.withColumn("kinds", F.array_join(F.transform("pieces", kind), "")).withColumn("ends", F.aggregate("pieces", F.array(F.lit(0)), lambda at, p: F.concat(at, F.array(F.element_at(at, -1) + F.length(p)))))
    found = base.withColumn("s", spots(tuple(PROTECTED.values()))(F.col("kinds"))).select(key, "ends", F.inline("s"))
    spans = found.select(key, F.get("ends", F.col("start")).alias("start"), F.get("ends", F.col("stop")).alias("stop"), F.element_at(F.array(*map(F.lit, PROTECTED)), F.col("form") + 1).alias("kind"))
    if names is not None:
        spans = spans.unionByName(name_hits(rows, key, text, names.select("name", F.lit("nation_name").alias("kind"))).select(key, "start", "stop", "kind"))
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"))
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.join(rows.select(key, F.col(text).alias("text")), key).withColumn("reach", reach)
    fresh = F.col("reach").isNull() | ((F.col("start") > F.col("reach")) & F.expr("substring(text, reach + 1, start - reach)").rlike(r"\S"))
    groups = spans.withColumn("g", F.sum(fresh.cast("int")).over(order))
    return groups.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", -F.col("stop"))).alias("kind")).drop("g")


def masked(rows: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """key, masked: texts with blanks in place of their spans, as many characters."""
    all_ = spans.groupBy(key).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    blank = lambda t, c: F.concat(F.substring(t, F.lit(1), c.start), F.repeat(F.lit(" "), c.stop - c.start), F.substring(t, c.stop + 1, F.length(t)))
    both = rows.select(key, F.col(text).alias("text")).join(all_, key, "left")
    return both.select(key, F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", F.col("text"), blank)).alias("masked"))


# --- queries --------------------------------------------------------------------------------------


def _typed(spark, d) -> DataFrame:
    """Typed queries of many forms, one an order, with the nation of its number."""
    k, n = F.col("o_orderkey"), F.col("n_name")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    five = F.lpad(k % 100_000, 5, "0")
    forms = [
        text("EPA-2023-", five), text("25 USC ", k % 1000 + 1, " and Pub. L. 93-638"), text("HB ", k % 4000 + 1000), text("Oregon HB ", k % 4000 + 1000), text("see ", F.lower(n), " relations  act"),
        text("about R", F.col("n_regionkey"), "RA 2024-2025"), text("salmon habitat ", k), text("ca9 21-", five, "  1076-AF", F.lpad(k % 100, 2, "0")),
    ]
    rows = table(spark, d, "orders").join(table(spark, d, "nation"), F.expr("o_orderkey % 25 = n_nationkey"))
    return rows.select("o_orderkey", F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("q"))


def _laws(spark, d) -> DataFrame:
    """A law's name and an acronym for each nation; nations of a region share the acronym."""
    n = table(spark, d, "nation")
    target = F.concat(F.lit("law-"), F.col("n_nationkey").cast("string"))
    name = n.select(F.concat("n_name", F.lit(" Relations Act")).alias("name"), F.lit("law_name").alias("kind"), target.alias("target"))
    return name.unionByName(n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("RA")).alias("name"), F.lit("acronym").alias("kind"), target.alias("target")))


def _claims(spark, d):
    rows = claims(_typed(spark, d), "o_orderkey", "q", _laws(spark, d))
    told = F.array_join(F.transform("readings", lambda r: F.concat_ws(" ", r.kind, r.identifier, r.jurisdiction)), ";")
    return rows.select("o_orderkey", "place", "island", "start", "stop", told.alias("readings"), "open")


def _routed(spark, d):
    typed = _typed(spark, d)
    rows = routes(typed, "o_orderkey", "q", claims(typed, "o_orderkey", "q", _laws(spark, d)))
    return rows.select("o_orderkey", F.size("readings").alias("n"), "ambiguous", "plain", "rest")


def _lake(spark, d) -> DataFrame:
    """A name in letters for each nation."""
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Lake"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")).alias("name"))


def _named(spark, d) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("name")
    text = F.when(k % 4 == 0, F.concat(F.lit("the old "), n, F.lit(" Tribe of the Lake met"))).when(k % 4 == 1, F.concat(F.lit("under Treaty of "), n, F.lit(", 1855 fishing"))).when(k % 4 == 2, F.concat(F.lit("Smith v. "), n, F.lit("  lower "), F.lower("name"))).otherwise(F.concat(F.lit("a diatribe about "), F.lower("name"), F.lit("s")))
    return table(spark, d, "customer").join(_lake(spark, d), F.expr("c_nationkey = n_nationkey")).select("c_custkey", text.alias("t"))


def _protected(spark, d):
    return protected(_named(spark, d), "c_custkey", "t", _lake(spark, d).filter("n_nationkey % 2 = 0"))


def _hidden(spark, d):
    rows = _named(spark, d)
    return masked(rows, "c_custkey", "t", protected(rows, "c_custkey", "t"))


_TYPED_SQL = """
with t as (select o_orderkey as k, n_name as n, n_regionkey as r, case when o_orderkey >= 100000 then right(o_orderkey::varchar, 5) else lpad(o_orderkey::varchar, 5, '0') end as five, o_orderkey % 4000 + 1000 as bill from orders join nation on o_orderkey % 25 = n_nationkey),
s as (select r, string_agg('law_name law-' || x || ' federal', ';' order by x) as laws from (select n_regionkey as r, n_nationkey::varchar as x from nation) group by r),
b as (select k, case when bill between 1000 and 2999 then 'state_bill HB ' || bill || ' WA' end as wa, case when bill between 2001 and 4999 then 'state_bill HB ' || bill || ' OR' end as orr from t),
c as (
  select k, 1 as place, 1 as island, 0 as start, 14 as stop, 'docket EPA-2023-' || five || ' federal' as readings, false as open from t where k % 8 = 0
  union all select k, 1, 1, 0, 7 + length((k % 1000 + 1)::varchar), 'usc 25 ' || (k % 1000 + 1) || ' federal', false from t where k % 8 = 1
  union all select k, 2, 2, 12 + length((k % 1000 + 1)::varchar), 26 + length((k % 1000 + 1)::varchar), 'public_law 93-638 federal', false from t where k % 8 = 1
  union all select k, 1, 1, 0, 7, concat_ws(';', wa, orr), true from b where k % 8 = 2
  union all select k, 1, 1, 7, 14, coalesce(orr, ''), false from b where k % 8 = 3
  union all select k, 1, 1, 4, 4 + length(n) + 15, 'law_name law-' || (k % 25) || ' federal', false from t where k % 8 = 4
  union all select k, 1, 1, 6, 10, laws, true from t join s using (r) where k % 8 = 5
  union all select k, 1, 1, 4, 12, 'court_docket 21-' || five || ' ca9', false from t where k % 8 = 7
  union all select k, 2, 1, 14, 23, 'rin 1076-AF' || lpad((k % 100)::varchar, 2, '0') || ' federal', false from t where k % 8 = 7)
"""

QUERIES = {
    "query_claims": (_claims, _TYPED_SQL + "select k as o_orderkey, place, island, start, stop, readings, open from c"),
    "claim_routes": (_routed, _TYPED_SQL + """, g as (select k, sum(case when readings = '' then 0 else len(string_split(readings, ';')) end)::int as n, bool_or(open) as open from c group by k)
select t.k as o_orderkey, coalesce(g.n, 0) as n, coalesce(g.n, 0) > 1 or coalesce(open and g.n > 0, false) as ambiguous, coalesce(g.n, 0) = 0 as plain,
  case t.k % 8 when 1 then 'and' when 3 then 'Oregon' when 4 then 'see' when 5 then 'about 2024-2025' when 6 then 'salmon habitat ' || t.k when 7 then 'ca9' else '' end as rest from t left join g using (k)"""),
    "protected_spans": (_protected, """
with t as (select c_custkey as k, c_nationkey % 2 = 0 as listed, 4 + length(c_nationkey::varchar) as l from customer)
select k as c_custkey, 8 as start, (8 + l + 18)::int as stop, 'nation_name' as kind from t where k % 4 = 0
union all select k, 6, (16 + l + 6)::int, 'treaty_title' from t where k % 4 = 1
union all select k, 0, (9 + l)::int, 'case_caption' from t where k % 4 = 2
union all select k, (17 + l)::int, (17 + 2 * l)::int, 'nation_name' from t where k % 4 = 2 and listed"""),
    "protected_masked": (_hidden, """
with t as (select c_custkey as k, 4 + length(c_nationkey::varchar) as l, 'lake' || translate(c_nationkey::varchar, '0123456789', 'abcdefghij') as low from customer)
select k as c_custkey, case k % 4 when 0 then 'the old ' || repeat(' ', l + 18) || ' met' when 1 then 'under ' || repeat(' ', l + 16) || ' fishing' when 2 then repeat(' ', 9 + l) || '  lower ' || low else 'a diatribe about ' || low || 's' end as masked from t"""),
}
