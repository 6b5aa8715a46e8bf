"""Publishers' pages and answers as records: tables under a heading, sections of an agreement, JSON of registers.

Readers take what fits their shape and tell what does not: a row keeps its faults, and a page that states how
much it shows is held against that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.guards import safe_url
from parchmint.session import table
from parchmint.sources.feeds import answers
from parchmint.sources.markup import block_tree, runs

#: States of executive orders (fixed values of the publisher's list).
ORDER_STATES = ("Active", "Expired", "Superseded", "Rescinded")
#: Columns of the publishers' lists (fixed values).
OPINIONS, ORDERS = ("R-", "Date", "Docket", "Name", "J.", "Citation"), ("Number", "Issued Date", "Title", "Status", "Governor")


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_rows(pages: DataFrame, key: str, source: str = "html", base: str | None = "url") -> DataFrame:
    """key, table, row, cells (map of column names to texts), link, heading, fault: the rows of a page's tables.

    A table's first row names its columns; heading is the last one before the table. fault: cells, where a
    row has other than as many cells as there are columns, repeated_column where names repeat.
    """
    found = runs(pages, key, source, base).filter("reason is null")
    gap = lambda r: (r.start == r.stop) & (r.text == " | ")  # noqa: E731  between two cells
    one = found.filter("tag = 'tr'").groupBy(key, "locator").agg(F.min("run").alias("first"), F.array_sort(F.collect_list(F.struct("run", "text", "link", "start", "stop"))).alias("runs"))
    joined = F.array_join(F.transform("runs", lambda r: F.when(gap(r), F.lit("\0")).otherwise(r.text)), "")
    link = F.get(F.filter(F.transform("runs", lambda r: r.link), lambda u: u.isNotNull()), F.lit(0))
    rows = one.select(key, F.regexp_replace("locator", r"(?:/(?:thead|tbody|tfoot)\[\d+\])?/tr\[\d+\]$", "").alias("table"), "first", F.transform(F.split(joined, "\0"), _clean).alias("list"), link.alias("link"))
    order = Window.partitionBy(key, "table").orderBy("first")
    rows = rows.withColumns({"row": F.row_number().over(order) - 1, "names": F.first("list").over(order)}).filter("row > 0")
    # The heading that stands before: headings and tables of a page in one order.
    titles = found.filter(F.col("tag").rlike("^h[1-6]$")).groupBy(key, "locator").agg(F.min("run").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r.text), "").alias("title"))
    both = rows.unionByName(titles.select(key, "first", _clean(F.col("title")).alias("title")), allowMissingColumns=True)
    heading = F.last("title", ignorenulls=True).over(Window.partitionBy(key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("heading", heading).filter("row is not null")
    fault = F.when(F.size("list") != F.size("names"), "cells").when(F.size(F.array_distinct("names")) != F.size("names"), "repeated_column")
    cells = F.when(fault.isNull(), F.map_from_arrays("names", "list"))
    return both.select(key, "table", "row", cells.alias("cells"), "link", "heading", fault.alias("fault"))


def _day(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def _faults(tests: dict[str, Column]) -> Column:
    """The names of tests that do not hold, comma-joined; null doesn't."""
    return F.concat_ws(",", *(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in tests.items()))


def opinions(pages: DataFrame, key: str, source: str = "html", base: str | None = "url") -> DataFrame:
    """key, row, term, day, docket, name, citation, link, faults: opinions of a term's list (columns OPINIONS).

    A term runs from October of its year to September of the next. Tables of other shapes are none.
    """
    rows = table_rows(pages, key, source, base).filter(F.col("fault").isNotNull() | (F.array_sort(F.map_keys("cells")) == F.array_sort(F.array(*map(F.lit, OPINIONS)))))
    rows = rows.withColumn("term", F.regexp_extract("heading", r"(?i)^opinions of the court\s*-\s*(\d{4})$", 1)).filter("term != ''")
    cell = lambda n: F.element_at("cells", F.lit(n))
    day = _day(cell("Date"), "M/d/yy")
    term = F.col("term").cast("int")
    repeated = F.count("*").over(Window.partitionBy(key, cell("Docket")))
    tests = {
        "cells": F.col("fault").isNull(),
        "day": F.col("fault").isNotNull() | day.isNotNull(),
        "outside_term": day.isNull() | day.between(F.make_date(term, F.lit(10), F.lit(1)), F.make_date(term + 1, F.lit(9), F.lit(30))),
        "docket": F.col("fault").isNotNull() | cell("Docket").rlike(r"^\d{1,3}-\d{1,5}$|^\d{1,3}, Orig\.$"),
        "docket_repeated": F.col("fault").isNotNull() | (repeated == 1),
        "citation": F.col("fault").isNotNull() | cell("Citation").rlike(r"^\d{3} U\. ?S\. (?:\d{1,4}|_+)$"),
        "link": safe_url(F.col("link")),
    }
    return rows.select(key, "row", term.alias("term"), day.alias("day"), cell("Docket").alias("docket"), cell("Name").alias("name"), cell("Citation").alias("citation"), "link", _faults(tests).alias("faults"))


def executive_orders(pages: DataFrame, key: str, source: str = "html", base: str | None = "url") -> DataFrame:
    """key, number, issued, title, status, link, faults: a governor's orders (columns ORDERS, others may follow).

    A number begins with the year in which it was issued. ``shown_of`` on each row tells whether the page lists
    as many as it says (Displaying 1 - n of m).
    """
    rows = table_rows(pages, key, source, base).filter("fault is null").filter(F.size(F.array_except(F.array(*map(F.lit, ORDERS)), F.map_keys("cells"))) == 0)
    stated = block_tree(pages, key, source, base).select(key, F.regexp_extract("text", r"^Displaying (\d+) - (\d+) of (\d+)$", 2).alias("upto"), F.regexp_extract("text", r"^Displaying (\d+) - (\d+) of (\d+)$", 3).alias("of")).filter("upto != ''").groupBy(key).agg(F.max(F.col("upto").cast("int")).alias("upto"), F.max(F.col("of").cast("int")).alias("of"))
    listed = rows.groupBy(key).agg(F.count("*").alias("n"))
    cell = lambda n: F.element_at("cells", F.lit(n))
    issued = _day(cell("Issued Date"), "MM/dd/yyyy")
    both = rows.join(stated, key, "left").join(listed, key)
    tests = {
        "number": cell("Number").rlike(r"^\d\d-\d\d$"),
        "issued": issued.isNotNull(),
        "other_year": issued.isNull() | (F.substring(cell("Number"), 1, 2) == F.date_format(issued, "yy")),
        "title": cell("Title") != "",
        "status": cell("Status").isin(*ORDER_STATES),
        "link": safe_url(F.col("link")),
        "page_incomplete": (F.col("upto") == F.col("of")) & (F.col("n") == F.col("of")),
    }
    return both.select(key, cell("Number").alias("number"), issued.alias("issued"), cell("Title").alias("title"), cell("Status").alias("status"), "link", _faults(tests).alias("faults"))


def agreements(pages: DataFrame, key: str, title: str, source: str = "html", base: str | None = "url") -> DataFrame:
    """key, title, executed, sections (array of heading, paragraphs), faults: an agreement under the heading that ``title`` matches.

    Its sections are the headings below; it was executed on the date that a paragraph states ("on the date of ...").
    """
    blocks = block_tree(pages, key, source, base)
    named = blocks.filter((F.col("kind") == "heading") & F.col("text").rlike(title)).groupBy(key).agg(F.min_by("text", "pos").alias("title"), F.count("*").alias("n"))
    inside = blocks.join(named, key).filter(F.array_contains("headings", F.col("title")) & (F.col("kind") != "heading"))
    section = F.element_at("headings", -1)
    parts = inside.select(key, "pos", section.alias("heading"), "text").withColumn("g", F.min("pos").over(Window.partitionBy(key, "heading")))
    grouped = parts.groupBy(key, "g", "heading").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps")).select(key, "g", F.struct("heading", F.transform("ps", lambda p: p.text).alias("paragraphs")).alias("s"))
    sections = grouped.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "s"))), lambda x: x.s).alias("sections"))
    said = r"on the date of (\p{L}+ \d{1,2}, \d{4})"
    dated = inside.filter(F.col("text").rlike(said)).groupBy(key).agg(F.min(_day(F.regexp_extract("text", said, 1), "MMMM d, yyyy")).alias("executed"), F.count("*").alias("dates"))
    both = named.join(sections, key, "left").join(dated, key, "left")
    tests = {"several_titles": F.col("n") == 1, "no_sections": F.col("sections").isNotNull(), "no_date": F.col("executed").isNotNull(), "several_dates": F.coalesce("dates", F.lit(1)) == 1}
    return both.select(key, "title", "executed", F.coalesce("sections", F.array().cast("array<struct<heading:string,paragraphs:array<string>>>")).alias("sections"), _faults(tests).alias("faults"))


#: Shapes of the registers' answers.
BILL = "bill struct<congress:int,type:string,number:string,title:string,updateDate:string,latestAction:struct<actionDate:string,text:string>>"
PACKAGE = "packageId string, title string, dateIssued string, docClass string, download struct<txtLink:string,pdfLink:string>, nextPage string"
DOCUMENTS = "data array<struct<id:string,type:string,attributes:struct<docketId:string,title:string,documentType:string,postedDate:string,commentEndDate:string,withdrawn:boolean>>>, meta struct<totalElements:long,hasNextPage:boolean>"


def bills(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, bill, title, action, acted, faults: a legislature's bills; bill is type, number and Congress."""
    found = answers(rows, key, body, BILL).withColumn("b", F.col("answer.bill"))
    kind = F.lower("b.type")
    acted = _day(F.col("b.latestAction.actionDate"), "yyyy-MM-dd")
    good = F.col("fault").isNotNull()
    tests = {"json": ~good, "type": good | kind.isin("hr", "s", "hjres", "sjres", "hconres", "sconres", "hres", "sres"), "number": good | F.col("b.number").rlike(r"^[1-9]\d{0,4}$"), "congress": good | F.col("b.congress").between(1, 200), "action": good | acted.isNotNull()}
    return found.select(key, F.when(kind.isNotNull(), F.concat_ws(" ", kind, "b.number", F.col("b.congress").cast("string"))).alias("bill"), F.col("b.title").alias("title"), F.col("b.latestAction.text").alias("action"), acted.alias("acted"), _faults(tests).alias("faults"))


def packages(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, package, title, issued, class, link, complete, faults: packages of a printing office; the class is the id's beginning."""
    found = answers(rows, key, body, PACKAGE)
    a, good = F.col("answer"), F.col("fault").isNotNull()
    issued, link = _day(a["dateIssued"], "yyyy-MM-dd"), F.coalesce(a["download"]["txtLink"], a["download"]["pdfLink"])
    tests = {"json": ~good, "package": good | a["packageId"].rlike(r"^[A-Z]+-[\w-]+$"), "class": good | F.lower(a["packageId"]).startswith(F.concat(F.lower(a["docClass"]), F.lit("-"))), "issued": good | issued.isNotNull(), "link": good | safe_url(link)}
    return found.select(key, a["packageId"].alias("package"), a["title"].alias("title"), issued.alias("issued"), a["docClass"].alias("class"), link.alias("link"), (~good & a["nextPage"].isNull()).alias("complete"), _faults(tests).alias("faults"))


def docket_documents(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, document, docket, title, kind, posted, closes, faults: documents of dockets; withdrawn ones are told, not dropped."""
    found = answers(rows, key, body, DOCUMENTS).filter("fault is null")
    items = found.select(key, F.col("answer.meta.totalElements").alias("total"), F.col("answer.meta.hasNextPage").alias("more"), F.size("answer.data").alias("n"), F.explode("answer.data").alias("d"))
    t, posted, closes = F.col("d.attributes"), _day(F.substring("d.attributes.postedDate", 1, 10), "yyyy-MM-dd"), _day(F.substring("d.attributes.commentEndDate", 1, 10), "yyyy-MM-dd")
    tests = {"id": F.col("d.id").startswith(F.concat(t["docketId"], F.lit("-"))), "posted": posted.isNotNull(), "closes_before_posted": closes.isNull() | posted.isNull() | (posted <= closes), "withdrawn": ~F.coalesce(t["withdrawn"], F.lit(False)), "page_incomplete": F.col("more") | (F.col("n") == F.col("total"))}
    return items.select(key, F.col("d.id").alias("document"), t["docketId"].alias("docket"), t["title"].alias("title"), t["documentType"].alias("kind"), posted.alias("posted"), closes.alias("closes"), _faults(tests).alias("faults"))


# --- queries: the given rows in the publishers' shapes ----------------------------------------------


def _text(*x) -> Column:
    return F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))


def _pages(spark, d, head: Column, cells: Column, group: str, tail: str = "</table>") -> DataFrame:
    """A page for each nation or so, a row for each of its customers."""
    rows = table(spark, d, "customer").select(F.col(group).cast("long").alias("page"), F.struct("c_custkey", cells.alias("row")).alias("r"), F.col("c_custkey"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.row), "")
    return rows.groupBy("page").agg(inner.alias("inner"), F.count("*").alias("n")).select("page", F.lit("https://x.org/list").alias("url"), F.concat(head, "inner", F.lit(tail)).alias("html"))


def _opinions(spark, d):
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2018-10-01").cast("date"), (k % 400).cast("int"))
    cells = _text("<tr><td>", k, "<td>", F.when(k % 17 == 0, "soon").otherwise(F.date_format(day, "M/d/yy")), "<td>", F.when(k % 13 == 0, "none").otherwise(_text("17-", k)), '<td><a href="', F.when(k % 11 == 0, "http://x.org/").otherwise("/o/"), k, '.pdf">', F.col("c_name"), "</a><td>X", F.when(k % 19 == 0, "").otherwise(_text("<td>", F.when(k % 7 == 0, "1 U.S.").otherwise(_text("586 U.S. ", k % 900 + 1)))), "</tr>")
    head = _text("<table><tr><td>other</td></tr></table><h3>Opinions of the Court - 2018</h3><table><thead><tr>", *(f"<th>{n}</th>" for n in OPINIONS), "</tr></thead>")
    return opinions(_pages(spark, d, head, cells, "c_nationkey"), "page").select("page", "term", "day", "docket", "name", "citation", "link", "faults")


def _orders(spark, d):
    k = F.col("c_custkey")
    issued = F.date_add(F.lit("2025-01-01").cast("date"), (k % 365).cast("int"))
    cells = _text("<tr><td>", F.when(k % 9 == 0, "24").otherwise("25"), "-", F.lpad(k % 100, 2, "0"), "<td>", F.date_format(issued, "MM/dd/yyyy"), '<td><a href="/eo/', k, '.pdf">', F.when(k % 8 == 0, " ").otherwise(F.col("c_name")), "</a><td>", F.when(k % 7 == 0, "Lost").otherwise("Active"), "<td>G<td></tr>")
    head = _text("<div class='view'>Displaying 1 - ", F.col("n"), " of ", F.when(F.col("page") % 4 == 0, F.col("n") + 1).otherwise(F.col("n")), "</div><table><thead><tr>", *(f"<th>{n}</th>" for n in (*ORDERS, "")), "</tr></thead><tbody>")
    return executive_orders(_pages(spark, d, head, cells, "c_nationkey", "</tbody></table>"), "page")


def _agreements(spark, d):
    k = F.col("n_nationkey")
    html = _text("<h1>All</h1><h2>Accord with ", F.col("n_name"), "</h2><h3>A</h3><p>one ", k, "</p><p>two</p><h3>B</h3>", F.when(k % 3 > 0, _text("<p>This was signed on the date of August ", k + 1, ", 1989.</p>")).otherwise("<p>three</p>"), "<h2>Later</h2><p>not of it</p>", F.when(k % 5 == 0, "<h2>Accord with others</h2>").otherwise(""))
    rows = table(spark, d, "nation").select(k.cast("long").alias("page"), F.lit("https://x.org/").alias("url"), html.alias("html"))
    found = agreements(rows, "page", "^Accord with")
    return found.select("page", "title", "executed", F.array_join(F.transform("sections", lambda s: F.concat(s.heading, F.lit(":"), F.array_join(s.paragraphs, "/"))), ";").alias("sections"), "faults")


def _bills(spark, d):
    k = F.col("o_orderkey")
    body = _text('{"bill": {"congress": ', k % 210, ', "type": "', F.when(k % 6 == 0, "XX").otherwise("HR"), '", "number": "', k % 100_000, '", "title": "', F.col("o_orderpriority"), '", "latestAction": {"actionDate": "', F.when(k % 8 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), '", "text": "Became law."}', F.when(k % 10 == 0, "").otherwise("}"), "}")
    return bills(table(spark, d, "orders").select("o_orderkey", body.alias("body")), "o_orderkey", "body")


def _packages(spark, d):
    k = F.col("p_partkey")
    body = _text('{"packageId": "', F.when(k % 7 == 0, "PLAW-").otherwise("BILLS-"), k, '", "title": "', F.col("p_type"), '", "dateIssued": "', F.when(k % 5 == 0, "2024-13-01").otherwise("2024-03-01"), '", "docClass": "bills", "download": {', F.when(k % 3 == 0, '"pdfLink": "https://x.org/p"').when(k % 3 == 1, '"txtLink": "http://x.org/t"').otherwise('"txtLink": "https://x.org/t", "pdfLink": "https://x.org/p"'), "}", F.when(k % 4 == 0, ', "nextPage": "2"').otherwise(""), "}")
    return packages(table(spark, d, "part").select("p_partkey", body.alias("body")), "p_partkey", "body").drop("title")


def _dockets(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    item = _text('{"id": "', F.when(k % 9 == 0, "OTHER-").otherwise(_text("EPA-", F.col("o_custkey"), "-")), k, '", "type": "documents", "attributes": {"docketId": "EPA-', F.col("o_custkey"), '", "title": "t", "documentType": "Rule", "postedDate": "', day, 'T04:00:00Z", "commentEndDate": ', F.when(k % 4 == 0, "null").when(k % 7 == 0, '"1990-01-01"').otherwise(_text('"', day, 'T00:00:00Z"')), ', "withdrawn": ', F.when(k % 11 == 0, "true").otherwise("null"), "}}")
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", item.alias("item")).alias("x"))
    made = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.item), ",").alias("items"), F.count("*").alias("n"))
    body = _text('{"data": [', F.col("items"), '], "meta": {"totalElements": ', F.when(F.col("o_custkey") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")), ', "hasNextPage": false}}')
    return docket_documents(made.select("o_custkey", body.alias("body")), "o_custkey", "body").drop("o_custkey", "title")


def _sql_faults(tests: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {bad} then '{name}' end" for name, bad in tests.items()) + ")"


QUERIES = {
    "court_opinions": (_opinions, f"""
with c as (select *, c_custkey as k, date '2018-10-01' + (c_custkey % 400)::int as d, c_custkey % 19 = 0 as short from customer)
select c_nationkey::bigint as page, 2018 as term, case when not short and k % 17 != 0 then d end as day, case when not short then case when k % 13 = 0 then 'none' else '17-' || k end end as docket, case when not short then c_name end as name,
  case when not short then case when k % 7 = 0 then '1 U.S.' else '586 U.S. ' || (k % 900 + 1) end end as citation, case when k % 11 = 0 then 'http://x.org/' else 'https://x.org/o/' end || k || '.pdf' as link,
  {_sql_faults({"cells": "short", "day": "not short and k % 17 = 0", "outside_term": "not short and k % 17 != 0 and d > date '2019-09-30'", "docket": "not short and (k % 13 = 0 or length(k::varchar) > 5)", "docket_repeated": "not short and k % 13 = 0 and (select count(*) from c x where x.c_nationkey = c.c_nationkey and x.k % 13 = 0 and not x.short) > 1", "citation": "not short and k % 7 = 0", "link": "k % 11 = 0"})} as faults from c"""),
    "governor_orders": (_orders, f"""
with c as (select *, c_custkey as k, date '2025-01-01' + (c_custkey % 365)::int as d from customer)
select c_nationkey::bigint as page, case when k % 9 = 0 then '24' else '25' end || '-' || lpad((k % 100)::varchar, 2, '0') as number, d as issued, case when k % 8 = 0 then '' else c_name end as title, case when k % 7 = 0 then 'Lost' else 'Active' end as status,
  'https://x.org/eo/' || k || '.pdf' as link, {_sql_faults({"other_year": "k % 9 = 0", "title": "k % 8 = 0", "status": "k % 7 = 0", "page_incomplete": "c_nationkey % 4 = 0"})} as faults from c"""),
    "agreements": (_agreements, f"""
select n_nationkey::bigint as page, 'Accord with ' || n_name as title, case when n_nationkey % 3 > 0 then make_date(1989, 8, n_nationkey + 1) end as executed,
  'A:one ' || n_nationkey || '/two;B:' || case when n_nationkey % 3 > 0 then 'This was signed on the date of August ' || (n_nationkey + 1) || ', 1989.' else 'three' end as sections,
  {_sql_faults({"several_titles": "n_nationkey % 5 = 0", "no_date": "n_nationkey % 3 = 0"})} as faults from nation"""),
    "congress_bills": (_bills, f"""
with o as (select *, o_orderkey as k, o_orderkey % 10 = 0 as bad from orders)
select o_orderkey, case when not bad then case when k % 6 = 0 then 'xx' else 'hr' end || ' ' || k % 100000 || ' ' || k % 210 end as bill, case when not bad then o_orderpriority end as title, case when not bad then 'Became law.' end as action, case when not bad and k % 8 > 0 then o_orderdate::date end as acted,
  {_sql_faults({"json": "bad", "type": "not bad and k % 6 = 0", "number": "not bad and k % 100000 = 0", "congress": "not bad and (k % 210 = 0 or k % 210 > 200)", "action": "not bad and k % 8 = 0"})} as faults from o"""),
    "printed_packages": (_packages, f"""
with p as (select *, p_partkey as k from part)
select p_partkey, case when k % 7 = 0 then 'PLAW-' else 'BILLS-' end || k as package, case when k % 5 > 0 then date '2024-03-01' end as issued, 'bills' as class, case k % 3 when 0 then 'https://x.org/p' when 1 then 'http://x.org/t' else 'https://x.org/t' end as link, k % 4 > 0 as complete,
  {_sql_faults({"class": "k % 7 = 0", "issued": "k % 5 = 0", "link": "k % 3 = 1"})} as faults from p"""),
    "docket_documents": (_dockets, f"""
with o as (select *, o_orderkey as k, o_orderdate::date as d from orders)
select case when k % 9 = 0 then 'OTHER-' else 'EPA-' || o_custkey || '-' end || k as document, 'EPA-' || o_custkey as docket, 'Rule' as kind, d as posted, case when k % 4 = 0 then null when k % 7 = 0 then date '1990-01-01' else d end as closes,
  {_sql_faults({"id": "k % 9 = 0", "closes_before_posted": "k % 4 > 0 and k % 7 = 0", "withdrawn": "k % 11 = 0", "page_incomplete": "o_custkey % 5 = 0"})} as faults from o"""),
}
