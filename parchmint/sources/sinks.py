"""Written results: canonical JSON, seals, safe CSV, manifests, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.functions import text as T
from parchmint.session import table


def canonical(*columns: str) -> Column:
    """JSON text of the columns with keys in code-unit order; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def sealed(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds digest: SHA-256 of the canonical JSON."""
    return rows.withColumn("digest", F.sha2(canonical(*columns), 256))


def build_id(assets: DataFrame, path: str, digest: str) -> DataFrame:
    """build: the first 20 hex digits of SHA-256 over the sorted lines path, character 0, digest. One row.

    Assets are the files of one build, not documents: their list, which is what is hashed, is bounded
    by the budgets of ``over_budget``.
    """
    lines = F.array_sort(F.collect_list(F.concat(path, F.lit("\0"), digest)))
    return assets.agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 20).alias("build"))


def csv_line(*columns: str) -> Column:
    """One quoted CSV line; cells that a spreadsheet would read as formulas are defused, nulls are empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(T.formula_safe(F.col(c).cast("string")), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(cell, columns))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Lines of ``csv_line`` with a header in each part, all ended by CRLF. Spark's text writer ends lines by LF, so CR is written."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    lines = rows.select(F.concat(csv_line(*columns), F.lit("\r")).alias("value"))

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([header + "\r"] * first, values.type), values])], names=["value"])
            first = False

    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def manifest(rows: DataFrame, asset: str, content: str) -> DataFrame:
    """asset, rows, bytes, largest, digest: SHA-256 over the row count, the bytes and the position-free sums of the contents' hashes.

    Equal rows in any order give one digest; nothing is gathered.
    """
    half = lambda at: F.sum(F.conv(F.substring(F.sha2(content, 256), at, 15), 16, 10).cast("decimal(38,0)"))
    made = rows.groupBy(asset).agg(F.count("*").alias("rows"), F.sum(F.octet_length(content)).cast("long").alias("bytes"), F.max(F.octet_length(content)).cast("long").alias("largest"), half(1).alias("__a"), half(16).alias("__b"))
    said = F.concat_ws(":", *(F.col(c).cast("string") for c in ("rows", "bytes", "__a", "__b")))
    return made.select(asset, "rows", "bytes", "largest", F.sha2(said, 256).alias("digest"))


def over_budget(made: DataFrame, budgets: dict[str, int], default: int) -> DataFrame:
    """asset, bytes, budget of the assets that are too large."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair]), F.col("asset")), F.lit(default)) if budgets else F.lit(default)
    return made.withColumn("budget", limit.cast("long")).filter("bytes > budget").select("asset", "bytes", "budget")


@F.pandas_udf(StringType())
def folded_line(lines):
    """A calendar line in parts of at most 75 octets; the following ones begin with a blank. No character is cut."""

    def fold(line):
        parts, room, part = [], 75, ""
        size = 0
        for ch in line:
            n = len(ch.encode("utf-8", "surrogatepass"))
            if size + n > room:
                parts.append(part)
                part, size, room = "", 0, 74
            part, size = part + ch, size + n
        return "\r\n ".join([*parts, part])

    return lines.map(fold, na_action="ignore")


def calendar(rows: DataFrame, number: str, closing: str, title: str) -> DataFrame:
    """number, entry: one calendar entry for each document whose comments close; lines end by CRLF and are folded at 75 octets."""
    first = rows.filter(F.col(closing).isNotNull()).groupBy(number).agg(F.min(F.struct(closing, title)).alias("x"))
    summary = folded_line(F.concat(F.lit("SUMMARY:"), F.regexp_replace(F.regexp_replace(F.col(f"x.{title}"), "([,;\\\\])", "\\\\$1"), "\n", "\\\\n")))
    return first.select(number, F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(f"x.{closing}", "yyyyMMdd")), summary, F.lit("END:VEVENT")).alias("entry"))


def study_tables(evidence: DataFrame, events: DataFrame, gaps: DataFrame) -> dict[str, DataFrame]:
    """A study's exports, ready for ``write_csv``: evidence by question, timeline by date, open gaps with their reasons."""
    return {
        "evidence": evidence.select("question", "segment", "quote").orderBy("question", "segment"),
        "timeline": events.select(F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("9999")).alias("day"), "id", "label").orderBy("day", "id"),
        "gaps": gaps.filter("resolved is null").select("question", "gap").orderBy("question", "gap"),
    }


def attributed_graph(nodes: DataFrame, edges: DataFrame, audience: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that an audience may see: an edge stays only with both of its ends. nodes: id, kind, audience. edges: src, dst, kind, audience."""
    seen = nodes.filter(F.col("audience").isin(audience))
    ids = seen.select("id")
    kept = edges.filter(F.col("audience").isin(audience)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return seen, kept


def citation_export(citations: DataFrame) -> DataFrame:
    """Adds text and faults: a citation as it is exported, and what it lacks for that (nothing: it may be)."""
    need = {"no_title": F.col("title"), "no_source": F.col("source"), "no_locator": F.col("locator"), "no_digest": F.when(F.col("digest").rlike("^[0-9a-f]{64}$"), F.col("digest"))}
    faults = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.lit(k)) for k, v in need.items())))
    return citations.withColumn("text", F.concat_ws(", ", "title", "source", "locator")).withColumn("faults", F.array_join(faults, ","))


def _seal(spark, d):
    return sealed(table(spark, d, "nation"), "n_nationkey", "n_name", "n_regionkey").select("n_nationkey", "digest")


def _build(spark, d):
    return build_id(table(spark, d, "nation").select("n_name", F.md5("n_name").alias("h")), "n_name", "h")


def _csv(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "=SUM").otherwise('say "x"'), "c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("seg"))
    return rows.select("c_custkey", csv_line("c_custkey", "name", "seg").alias("line"))


def _manifest(spark, d):
    return manifest(table(spark, d, "documents"), "source", "text")


def _budget(spark, d):
    made = manifest(table(spark, d, "documents"), "source", "text").withColumnRenamed("source", "asset")
    return over_budget(made, {"src0": 10_000_000, "src1": 1}, 100_000)


def _graph(spark, d):
    k = F.col("s_suppkey")
    kind = lambda n: F.when(k % n == 0, "internal").otherwise("public").alias("audience")
    nodes = table(spark, d, "supplier").select(k.alias("id"), F.lit("source").alias("kind"), kind(4))
    edges = table(spark, d, "supplier").select(k.alias("src"), ((k * 3 + 1) % 90).alias("dst"), F.lit("cites").alias("kind"), kind(7))
    return attributed_graph(nodes, edges, ["public"])[1].select("src", "dst")


def _export(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 5 > 0, F.col("c_name")).alias("title"), F.when(k % 4 > 0, F.col("c_mktsegment")).otherwise(" ").alias("source"), F.concat(F.lit("p. "), k.cast("string")).alias("locator"), F.when(k % 3 > 0, F.sha2("c_name", 256)).otherwise("?").alias("digest"))
    return citation_export(rows).select("c_custkey", "text", "faults")


def _study(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("day"), F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    empty = e.limit(0).select(F.lit("").alias("question"), F.lit("").alias("segment"), F.lit("").alias("quote"), F.lit("").alias("gap"), F.lit("").alias("resolved"))
    rows = study_tables(empty, e, empty)["timeline"]
    return rows.select("id", csv_line("day", "id", "label").alias("line"))


def _calendar(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")).alias("closes"), F.concat(F.lit("Comments close, order "), F.col("o_orderkey").cast("string"), F.lit(" of a rule with a title é that is longer than a calendar line may be")).alias("title"))
    return calendar(o, "o_custkey", "closes", "title")


QUERIES = {
    "sealed_rows": (_seal, """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as digest from nation"""),
    "build_id": (_build, "select sha256(string_agg(n_name || chr(0) || md5(n_name), chr(10) order by n_name || chr(0) || md5(n_name)))[1:20] as build from nation"),
    "csv_lines": (_csv, """
with r as (select c_custkey, case when c_custkey % 2 = 0 then '=SUM' else 'say "x"' end || c_name as name, case when c_custkey % 3 > 0 then c_mktsegment end as seg from customer)
select c_custkey, '"' || c_custkey || '","' || replace(case when name[1] = '=' then '''' || name else name end, '"', '""') || '","' || coalesce(seg, '') || '"' as line from r"""),
    "artifact_manifest": (_manifest, """
with m as (select source, count(*) as rows, sum(strlen(text))::bigint as bytes, max(strlen(text))::bigint as largest, sum(('0x' || sha256(text)[1:15])::bigint::hugeint) as a, sum(('0x' || sha256(text)[16:30])::bigint::hugeint) as b from documents group by source)
select source, rows, bytes, largest, sha256(rows || ':' || bytes || ':' || a || ':' || b) as digest from m"""),
    "attributed_graph": (_graph, "with e as (select s_suppkey as src, (s_suppkey * 3 + 1) % 90 as dst from supplier where s_suppkey % 7 != 0), n as (select s_suppkey as id from supplier where s_suppkey % 4 != 0) select src, dst from e where src in (select id from n) and dst in (select id from n)"),
    "citation_export": (_export, "select c_custkey, concat_ws(', ', case when c_custkey % 5 > 0 then c_name end, case when c_custkey % 4 > 0 then c_mktsegment else ' ' end, 'p. ' || c_custkey) as text, concat_ws(',', case when c_custkey % 5 = 0 then 'no_title' end, case when c_custkey % 4 = 0 then 'no_source' end, case when c_custkey % 3 = 0 then 'no_digest' end) as faults from customer"),
    "study_timeline": (_study, """select event_id as id, '"' || case when event_id % 4 > 0 then strftime(ts, '%Y-%m-%d') else '9999' end || '","' || event_id || '","' || event_type || '"' as line from events"""),
    "artifact_over_budget": (_budget, "select source as asset, sum(strlen(text))::bigint as bytes, (case source when 'src0' then 10000000 when 'src1' then 1 else 100000 end)::bigint as budget from documents group by source having sum(strlen(text)) > case source when 'src0' then 10000000 when 'src1' then 1 else 100000 end"),
    "comment_calendar": (_calendar, """
with f as (select o_custkey, min(struct_pack(c := o_orderdate::date, t := 'Comments close, order ' || o_orderkey || ' of a rule with a title é that is longer than a calendar line may be')) as x from orders where o_orderkey % 3 = 0 group by 1),
s as (select *, 'SUMMARY:' || replace(x.t, ',', '\\,') as s from f)
select o_custkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(x.c, '%Y%m%d') || chr(13) || chr(10) || s[1:74] || chr(13) || chr(10) || ' ' || s[75:] || chr(13) || chr(10) || 'END:VEVENT' as entry from s"""),
}
