"""Feeds of publishers as tables: JSON answers, OData bundles, XML documents, archives, lists of links.

Readers declare the shape that they expect; what does not fit is a row with a reason, not an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.session import ship, table
from parchmint.sources.markup import code_levels

#: Shapes of answers, as schemas.
REGISTER = "count long, results array<struct<document_number:string,title:string,type:string,agencies:array<struct<name:string,id:long>>,publication_date:string,abstract:string>>"
ODATA = "`odata.metadata` string, value array<struct<Key:string,Name:string,Modified:string>>"


def answers(rows: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """key, answer, fault: JSON bodies in their shape; not_json where they aren't any."""
    parsed = F.from_json(body, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.select(key, parsed.alias("answer"))
    return out.withColumn("fault", F.when(F.col("answer").isNull() | F.col("answer._bad").isNotNull(), "not_json"))


def register_records(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Records of a register's answers: number, title, kind, agencies, published, fault. An answer without results has none."""
    found = answers(rows, key, body, REGISTER)
    items = found.filter("fault is null").select(key, F.inline(F.coalesce("answer.results", F.from_json(F.lit("[]"), "array<struct<document_number:string,title:string,type:string,agencies:array<struct<name:string,id:long>>,publication_date:string,abstract:string>>"))))
    day = F.try_to_timestamp("publication_date", F.lit("yyyy-MM-dd"))
    fault = F.when(F.col("document_number").isNull(), "no_number").when(F.col("title").isNull(), "no_title").when(day.isNull(), "no_date")
    return items.select(key, F.col("document_number").alias("number"), "title", F.lower("type").alias("kind"), F.array_join(F.array_sort(F.transform("agencies", lambda a: a["name"])), "; ").alias("agencies"), day.alias("published"), fault.alias("fault"))


def page_faults(rows: DataFrame, key: str, body: str, page: int) -> DataFrame:
    """key, fault: answers that cannot be one page: more rows than a page or than the stated count."""
    found = answers(rows, key, body, REGISTER)
    n = F.coalesce(F.size("answer.results"), F.lit(0))
    fault = F.coalesce("fault", F.when(F.col("answer.count").isNull(), "no_count").when(n > page, "over_page").when(n > F.col("answer.count"), "over_count"))
    return found.select(key, fault.alias("fault")).filter("fault is not null")


def odata_rows(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Entries of OData bundles; the /Date(ms)/ form of an instant is read."""
    found = answers(rows, key, body, ODATA)
    ms = F.regexp_extract("Modified", r"^/Date\((-?\d+)\)/$", 1)
    items = found.filter("fault is null").select(key, F.inline("answer.value"))
    return items.select(key, F.col("Key").alias("entry"), F.col("Name").alias("name"), F.when(ms != "", F.timestamp_millis(ms.cast("long"))).alias("modified"))


def _shape(paths: list[list[str]]) -> T.ArrayType:
    """The type of an element that holds these paths: every child may be missing or stand several times."""
    names = dict.fromkeys(p[0] for p in paths)
    inner = {n: [p[1:] for p in paths if p[0] == n and len(p) > 1] for n in names}
    return T.ArrayType(T.StructType([T.StructField(n, _shape(inner[n]) if inner[n] else T.StringType() if n[0] == "_" else T.ArrayType(T.StringType())) for n in names]))


def _below(at: Column, path: list[str]) -> Column:
    """The values under a path of child elements (_name: an attribute) of an array of elements, in order."""
    for name in path:
        found = F.transform(at, _field(name))
        at = F.filter(found, lambda v: v.isNotNull()) if name[0] == "_" else F.flatten(F.filter(found, lambda v: v.isNotNull()))
    return at


def _field(name: str):
    return lambda element: element[name]


def xml_rows(rows: DataFrame, key: str, body: str, item: str, fields: dict[str, str]) -> DataFrame:
    """key, pos and a column for each field: the elements of a path, by paths below them (@name: an attribute).

    A path that ends in [] gives the array of all its values; others give the first value, null where an
    item lacks it. Prefixes of namespaces don't count. Malformed markup or a SOAP fault gives no rows:
    see ``xml_faults``.
    """
    steps = item.strip("/").split("/")[1:]
    paths = {n: [s.replace("@", "_") for s in p.removesuffix("[]").split("/")] for n, p in fields.items()}
    shape = _shape([steps + p for p in paths.values()]).elementType
    root = F.array(F.from_xml(body, shape, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))
    items = rows.select(key, F.posexplode(_below(F.filter(root, lambda r: r.isNotNull()), steps)).alias("pos", "x"))
    value = lambda n: _below(F.array("x"), paths[n])
    return items.select(key, "pos", *((value(n) if p.endswith("[]") else F.get(value(n), F.lit(0))).alias(n) for n, p in fields.items()))


def xml_faults(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, fault: answers that are a SOAP fault (its text), or that hold no markup."""
    text = F.coalesce(F.col(body), F.lit(""))
    fault = F.when(~text.rlike(r"^\s*<"), "not_xml").when(text.rlike(r"<(?:\w+:)?Fault[\s>]"), F.regexp_extract(text, r"<(?:\w+:)?faultstring>([^<]*)<", 1))
    return rows.select(key, fault.alias("fault")).filter("fault is not null")


def sections(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, identifier, heading, text: sections of a code in its legislative XML, with all their paragraphs, one a line."""
    found = code_levels(rows, key, body, ("section",))
    return found.select(key, "identifier", "heading", F.array_join("paragraphs", "\n").alias("text"))


def part_order(part: Column) -> Column:
    """What sorts parts such as 9, 10, 10a, 100.2 by their numbers: array of padded pieces."""
    pieces = F.regexp_extract_all(part, F.lit(r"(\d+|[a-z]+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p))


def version_order(version: Column) -> Column:
    """What sorts semantic versions: major, minor, patch; a release after its pre-releases."""
    p = r"^(\d+)\.(\d+)\.(\d+)(?:-(.+))?$"
    number = lambda k: F.regexp_extract(version, p, k).cast("long")
    pre = F.regexp_extract(version, p, 4)
    return F.when(version.rlike(p), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), pre.alias("pre")))


def pointed(json: Column, pointer: Column) -> Column:
    """The value that a JSON pointer names (~1 is /, ~0 is ~), as text; the whole for an empty pointer, null where nothing is."""
    pieces = F.transform(F.slice(F.split(pointer, "/"), F.lit(2), F.greatest(F.size(F.split(pointer, "/")) - 1, F.lit(0))), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    path = F.concat(F.lit("$"), F.array_join(F.transform(pieces, lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("['"), s, F.lit("']")))), ""))
    return F.when(pointer == "", json).otherwise(F.call_function("get_json_object", json, path))


def members(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """path, member, bytes, data, fault: members of ZIP archives (columns path, content), one row each.

    Members larger than ``most`` bytes are rows with fault too_large and no data, damaged archives one
    row with fault not_zip.
    """
    ship(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("data", pa.binary()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                large = info.file_size > most
                                rows.append((path, info.filename, info.file_size, None if large else archive.read(info), "too_large" if large else None))
                except (zipfile.BadZipFile, OSError):
                    rows = [(path, None, None, None, "not_zip")]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, member string, bytes long, data binary, fault string")


def located(packs: DataFrame, texts: DataFrame) -> DataFrame:
    """pack, field, start, stop, state: where a curated field's value stands in its text, in bytes.

    found once, missing, or ambiguous where it stands more than once. packs: pack, rendition, field,
    value. texts: rendition, text.
    """
    rows = packs.join(texts, "rendition")
    at = F.instr("text", F.col("value"))
    again = F.instr(F.expr("substring(text, instr(text, value) + 1)"), F.col("value"))
    start = F.octet_length(F.expr("substring(text, 1, instr(text, value) - 1)"))
    state = F.when(at == 0, "missing").when(again > 0, "ambiguous").otherwise("found")
    return rows.select("pack", "field", F.when(state == "found", start).alias("start"), F.when(state == "found", start + F.octet_length("value")).alias("stop"), state.alias("state"))


def session_laws(links: DataFrame, url: str) -> DataFrame:
    """Adds year, chapter, reason: links to session laws by their path; others with why they are left out."""
    p = r"(?i)/session%20laws/(\d{4})(?:-\d{2})?/(?:[^/]+/)*(\d{1,4})(?:-s\d?)?\.(pdf|htm)$|/sessionlaws/(\d{4})/c(\d{1,4})\.(pdf|htm)$"
    part = lambda a, b: F.when(F.regexp_extract(url, p, a) != "", F.regexp_extract(url, p, a)).otherwise(F.regexp_extract(url, p, b))
    reason = F.when(~F.col(url).rlike(r"(?i)session"), "not_a_session_law").when(~F.col(url).rlike(p), "unknown_path").when(F.lower(part(3, 6)) == "pdf", "not_text")
    return links.withColumns({"year": F.when(reason.isNull(), part(1, 4).cast("int")), "chapter": F.when(reason.isNull(), part(2, 5).cast("int")), "reason": reason})


def popular_names(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, alias, law: names of laws in list items "Name (see Pub. L. 93-638)"."""
    items = F.regexp_extract_all(html, F.lit(r"<li>([^<]*)</li>"), F.lit(1))
    rows = pages.select(key, F.explode(items).alias("item"))
    p = r"^\s*(.+?)\s*\(see (?:Pub\. L\.) (\d+-\d+)\)\s*$"
    return rows.filter(F.col("item").rlike(p)).select(key, F.regexp_extract("item", p, 1).alias("alias"), F.regexp_extract("item", p, 2).alias("law"))


# --- queries: the driver's rows in publishers' shapes ----------------------------------------------


def _bodies(spark, d) -> DataFrame:
    """One answer for each customer, of their orders; some broken, some without results."""
    o = table(spark, d, "orders")
    item = F.struct(F.concat(F.lit("2024-"), F.lpad("o_orderkey", 5, "0")).alias("document_number"), F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("title"), F.lit("RULE").alias("type"), F.array(F.struct(F.col("o_orderpriority").alias("name"), F.lit(1).alias("id")), F.struct(F.lit("Agency").alias("name"), F.lit(2).alias("id"))).alias("agencies"), F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publication_date"))
    made = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("results"))
    k = F.col("o_custkey")
    good = F.to_json(F.struct((F.col("n") - F.when(k % 9 == 0, 1).otherwise(0)).alias("count"), F.when(k % 4 > 0, F.col("results")).alias("results")))
    return made.select("o_custkey", "n", F.when(k % 11 == 0, F.substring(good, 1, 30)).otherwise(good).alias("body"))


def _register(spark, d):
    rows = register_records(_bodies(spark, d), "o_custkey", "body")
    return rows.select("o_custkey", "number", "title", "kind", "agencies", F.date_format("published", "yyyy-MM-dd").alias("published"), "fault")


def _page_faults(spark, d):
    return page_faults(_bodies(spark, d), "o_custkey", "body", 12)


def _odata(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.lit("x").alias("odata.metadata"), F.array(F.struct(F.col("c_custkey").cast("string").alias("Key"), F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("/Date("), (F.col("c_custkey") * 86_400_000).cast("string"), F.lit(")/"))).alias("Modified"))).alias("value"))).alias("body"))
    return odata_rows(c, "c_custkey", "body").select("c_custkey", "entry", "name", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


def _soap(spark, d):
    k = F.col("n_nationkey")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    name = lambda i: F.when(i % 2 == 1, text("<x:Name>", F.col("n_name"), "</x:Name>")).otherwise("")  # the second item has none
    tags = lambda i: F.when(i == 2, "").when(i == 3, text("<Tag>c</Tag>")).otherwise("<Tag>a</Tag><Tag>b</Tag>")
    items = F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: text('<Item no="', i * 10, '"><Id>', i, "</Id>", name(i), tags(i), "</Item>"))
    good = text('<x:Envelope xmlns:x="u"><x:Body><Items>', F.array_join(items, ""), "</Items></x:Body></x:Envelope>")
    body = F.when(k % 7 == 0, F.lit("<Envelope><Body><Fault><faultstring>no such bill</faultstring></Fault></Body></Envelope>")).when(k % 11 == 0, F.lit("busy")).otherwise(good)
    return table(spark, d, "nation").select("n_nationkey", body.alias("body"))


def _xml(spark, d):
    rows = _soap(spark, d).filter(F.col("body").startswith("<"))
    found = xml_rows(rows, "n_nationkey", "body", "/Envelope/Body/Items/Item", {"id": "Id", "name": "Name", "number": "@no", "tags": "Tag[]"})
    return found.withColumn("tags", F.array_join("tags", ","))


def _xml_faults(spark, d):
    return xml_faults(_soap(spark, d), "n_nationkey", "body")


def _sections(spark, d):
    k = F.col("p_partkey")
    heading = F.when(k % 3 > 0, F.concat(F.lit("<heading> "), F.col("p_brand"), F.lit("</heading>"))).otherwise("")
    more = F.when(k % 2 == 0, "<p>Second</p>").otherwise("")
    one = F.concat(F.lit('<section identifier="/us/usc/t25/s'), k.cast("string"), F.lit('"><num>x</num>'), heading, F.lit("<content><p>Text of "), F.col("p_type"), F.lit("</p>"), more, F.lit("</content></section>"))
    # Another section follows, so that what the first lacks could be taken from it.
    body = F.concat(F.lit("<code>"), one, F.lit('<section identifier="/us/usc/t25/s'), k.cast("string"), F.lit('a"><heading>Next</heading></section></code>'))
    return sections(table(spark, d, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")


def _orders_(spark, d):
    k = F.col("p_partkey")
    part = F.concat((k % 120).cast("string"), F.when(k % 3 == 0, "a").when(k % 3 == 1, F.concat(F.lit("."), (k % 7).cast("string"))).otherwise(""))
    version = F.concat_ws(".", (k % 3).cast("string"), (k % 12).cast("string"), F.concat((k % 5).cast("string"), F.when(k % 4 == 0, "-rc").otherwise("")))
    from pyspark.sql import Window

    rows = table(spark, d, "part").select("p_partkey", "p_brand", part_order(part).alias("a"), version_order(version).alias("b"))
    w = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(c, "p_partkey"))
    return rows.select("p_partkey", w("a").alias("by_part"), w("b").alias("by_version"))


def _pointers(spark, d):
    k = F.col("event_id") % 4
    json = F.concat(F.lit('{"a/b": {"x~y": '), F.col("user_id").cast("string"), F.lit('}, "list": [1, {"k": "'), F.col("event_type"), F.lit('"}], "p": '), F.col("props"), F.lit("}"))
    pointer = F.when(k == 0, "/a~1b/x~0y").when(k == 1, "/list/1/k").when(k == 2, "/p/k").otherwise("/none/3")
    return table(spark, d, "events").select("event_id", pointed(json, pointer).alias("value"))


def _zips(spark, d):
    """Archives made of the nations' names; every fifth damaged."""
    ship(spark)

    def pack(col):
        def one(name):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("name.txt", name)
                z.writestr("large.txt", name * 40)
            return out.getvalue()

        return col.map(one)

    packed = F.pandas_udf(pack, "binary", F.PandasUDFType.SCALAR)("n_name")
    files = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("x").cast("binary")).otherwise(packed).alias("content"))
    return members(files, 200).select("path", "member", "bytes", F.md5("data").alias("data"), "fault")


def _located(spark, d):
    docs = table(spark, d, "documents").groupBy(F.col("doc_id").alias("rendition")).agg(F.min("text").alias("text")).filter("length(text) > 60")
    k = F.col("rendition")
    packs = docs.select(k.alias("pack"), "rendition", F.lit("/title").alias("field"), F.when(k % 5 == 0, F.lit("no such value")).when(k % 5 == 1, F.lit("e")).otherwise(F.substring("text", 5, 40)).alias("value"))
    return located(packs, docs)


def _laws(spark, d):
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://x.org/SessionLaws/"), (k % 30 + 1990).cast("string"), F.lit("/c"), (k % 400).cast("string"), F.lit(".htm"))).when(k % 4 == 1, F.concat(F.lit("https://x.org/Session%20Laws/"), (k % 30 + 1990).cast("string"), F.lit("/House/"), (k % 400).cast("string"), F.lit("-S.htm"))).when(k % 4 == 2, F.concat(F.lit("https://x.org/sessionlaws/2001/c"), (k % 400).cast("string"), F.lit(".pdf"))).otherwise(F.when(k % 3 == 0, "https://x.org/bills/1").otherwise("https://x.org/session/1"))
    return session_laws(table(spark, d, "orders").select("o_orderkey", url.alias("url")), "url").drop("url")


def _popular(spark, d):
    k = F.col("n_nationkey")
    html = F.concat(F.lit("<ul><li> "), F.col("n_name"), F.lit(" Act (see Pub. L. 93-"), (k + 600).cast("string"), F.lit(")</li><li>no law</li></ul>"))
    return popular_names(table(spark, d, "nation").select("n_nationkey", html.alias("html")), "n_nationkey", "html")


QUERIES = {
    "register_records": (_register, """
select o_custkey, '2024-' || lpad(o_orderkey::varchar, greatest(5, 5), '0') as number, case when o_orderkey % 7 > 0 then 'Order ' || o_orderkey end as title, 'rule' as kind, least(o_orderpriority, 'Agency') || '; ' || greatest(o_orderpriority, 'Agency') as agencies,
  case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as published, case when o_orderkey % 7 = 0 then 'no_title' when o_orderkey % 5 = 0 then 'no_date' end as fault from orders where o_custkey % 4 > 0 and o_custkey % 11 != 0"""),
    "page_faults": (_page_faults, """
with n as (select o_custkey, count(*) as n from orders group by 1), f as (select o_custkey, case when o_custkey % 11 = 0 and o_custkey % 4 > 0 then 'not_json' when o_custkey % 4 = 0 then null when n > 12 then 'over_page' when o_custkey % 9 = 0 then 'over_count' end as fault from n) select * from f where fault is not null"""),
    "odata_rows": (_odata, "select c_custkey, c_custkey::varchar as entry, c_name as name, case when c_custkey % 3 > 0 then strftime(date '1970-01-01' + c_custkey::int, '%Y-%m-%d') end as modified from customer"),
    "xml_rows": (_xml, "select n_nationkey, (i - 1)::int as pos, i::varchar as id, case when i % 2 = 1 then n_name end as name, (10 * i)::varchar as number, ['a,b', '', 'c'][i] as tags from nation, range(1, 4) t(i) where n_nationkey % 7 != 0 and n_nationkey % 11 != 0 and i <= n_nationkey % 3 + 1"),
    "xml_faults": (_xml_faults, "select n_nationkey, case when n_nationkey % 7 = 0 then 'no such bill' else 'not_xml' end as fault from nation where n_nationkey % 7 = 0 or n_nationkey % 11 = 0"),
    "code_sections": (_sections, "select p_partkey, '/us/usc/t25/s' || p_partkey as identifier, case when p_partkey % 3 > 0 then p_brand end as heading, 'Text of ' || p_type || case when p_partkey % 2 = 0 then chr(10) || 'Second' else '' end as text from part union all select p_partkey, '/us/usc/t25/s' || p_partkey || 'a', 'Next', '' from part"),
    "part_and_version_order": (_orders_, """
with p as (select p_partkey, p_brand, p_partkey % 120 as n, p_partkey % 3 as k, p_partkey % 7 as s, p_partkey % 12 as minor, p_partkey % 5 as patch, p_partkey % 4 = 0 as pre from part)
select p_partkey, row_number() over (partition by p_brand order by n, case k when 2 then -1 when 1 then s else 100 end, p_partkey)::int as by_part, row_number() over (partition by p_brand order by k, minor, patch, case when pre then 0 else 1 end, p_partkey)::int as by_version from p"""),
    "json_pointers": (_pointers, "select event_id, case event_id % 4 when 0 then user_id::varchar when 1 then event_type when 2 then json_extract_string(props, '$.k') end as value from events"),
    "zip_members": (_zips, """
select n_name as path, 'name.txt' as member, length(n_name)::bigint as bytes, md5(n_name) as data, null::varchar as fault from nation where n_nationkey % 5 != 0
union all select n_name, 'large.txt', length(n_name) * 40, case when length(n_name) > 5 then null else md5(repeat(n_name, 40)) end, case when length(n_name) > 5 then 'too_large' end from nation where n_nationkey % 5 != 0
union all select n_name, null, null, null, 'not_zip' from nation where n_nationkey % 5 = 0"""),
    "located_fields": (_located, """
with t as (select doc_id as k, min(text) as text from documents group by 1 having length(min(text)) > 60),
v as (select *, case when k % 5 = 0 then 'no such value' when k % 5 = 1 then 'e' else text[5:44] end as v from t), s as (select *, instr(text, v) as spot, instr(text[instr(text, v) + 1:], v) as again from v)
select k as pack, '/title' as field, case when spot > 0 and again = 0 then strlen(text[1:spot - 1])::int end as start, case when spot > 0 and again = 0 then (strlen(text[1:spot - 1]) + strlen(v))::int end as stop, case when spot = 0 then 'missing' when again > 0 then 'ambiguous' else 'found' end as state from s"""),
    "session_laws": (_laws, "select o_orderkey, case when o_orderkey % 4 < 2 then (o_orderkey % 30 + 1990)::int end as year, case when o_orderkey % 4 < 2 then (o_orderkey % 400)::int end as chapter, case when o_orderkey % 4 = 2 then 'not_text' when o_orderkey % 4 = 3 then case when o_orderkey % 3 = 0 then 'not_a_session_law' else 'unknown_path' end end as reason from orders"),
    "popular_names": (_popular, "select n_nationkey, n_name || ' Act' as alias, '93-' || (n_nationkey + 600) as law from nation"),
}
