"""Canonical JSON at every depth, and protected keys wherever they stand.

Two texts of one value have one canonical text: keys in the order of their UTF-16 code units, no blanks,
numbers as the shortest decimal text that gives the same double, strings with the fewest escapes. Of a
repeated key the last value counts. What is no JSON has none (null).
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchmint.session import ship, table

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def number_text(x: float) -> str:
    """The shortest text of a double: digits up to 21 places before the point and 6 zeros behind it, else with an exponent."""
    if x == 0:
        return "0"
    sign, (digits, exponent) = "-" if x < 0 else "", f"{abs(x):.17e}".split("e")
    for places in range(17):  # the fewest digits that read as the same double
        short = f"{abs(x):.{places}e}"
        if float(short) == abs(x):
            digits, exponent = short.split("e")
            break
    digits, e = digits.replace(".", "").rstrip("0") or "0", int(exponent)
    n = len(digits)
    if 0 <= e < 21:
        return sign + (digits + "0" * (e + 1 - n) if n <= e + 1 else f"{digits[: e + 1]}.{digits[e + 1 :]}")
    if -7 < e < 0:
        return sign + "0." + "0" * (-e - 1) + digits
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def string_text(s: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " or "\ud800" <= c <= "\udfff" else c) for c in s) + '"'


def canonical_text(text: str | None) -> str | None:
    """The canonical text of a JSON text; null for null, for what is none and for numbers beyond doubles."""
    try:
        value = json.loads(text, parse_int=float, parse_constant=lambda _: math.inf)
    except (TypeError, ValueError, RecursionError):
        return None

    def told(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{string_text(k)}:{told(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(told, v)) + "]"
        if isinstance(v, str):
            return string_text(v)
        if isinstance(v, bool) or v is None:
            return {True: "true", False: "false", None: "null"}[v]
        if not math.isfinite(v):
            raise OverflowError
        return number_text(v)

    try:
        return told(value)
    except OverflowError:
        return None


def pointers(text: str | None, keys: frozenset) -> list[str]:
    """JSON pointers of all keys that are among ``keys``, whatever their case and marks, in document order."""
    try:
        todo = [("", json.loads(text))]
    except (TypeError, ValueError, RecursionError):
        return []
    found = []
    while todo:
        at, v = todo.pop()
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        below = [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", k, x) for k, x in inner]
        found += [p for p, k, _ in below if isinstance(k, str) and squashed(k) in keys]
        todo += [(p, x) for p, _, x in reversed(below)]
    return sorted(found)


def squashed(key: str) -> str:
    return "".join(c for c in key.lower() if c.isalnum())


@F.pandas_udf(StringType())
def canonical_json(col: pd.Series) -> pd.Series:
    """The canonical text of a column of JSON texts."""
    return col.map(canonical_text, na_action="ignore")


def sealed_json(rows: DataFrame, json_: str) -> DataFrame:
    """Adds canonical and digest: the canonical text and its SHA-256, equal for equal values."""
    ship(rows.sparkSession)
    out = rows.withColumn("canonical", canonical_json(F.col(json_)))
    return out.withColumn("digest", F.sha2("canonical", 256))


def protected_keys(rows: DataFrame, key: str, json_: str, keys: list[str]) -> DataFrame:
    """key, pointer: where protected keys stand in JSON texts, at any depth. Case and marks within a key don't count."""
    ship(rows.sparkSession)
    named = frozenset(map(squashed, keys))

    @F.pandas_udf("array<string>")
    def found(col: pd.Series) -> pd.Series:
        return col.map(lambda t: pointers(t, named), na_action=None)

    return rows.select(key, F.explode(found(F.col(json_))).alias("pointer"))


# --- queries --------------------------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    """One value for each event, written in two ways: other order of keys, blanks, forms of numbers and escapes."""
    k = F.col("event_id").cast("string")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    one = text('{"b": {"z": ', k, '.0, "a": [1.50, {"y": "\\u00e9", "x": ', F.col("props"), '}, true, null]}, "a": "', F.col("event_type"), '", "": -0.0, "\U0001f600": 1e21, "A": 0.000001}')
    two = text('{"A":1e-6,"a":"', F.col("event_type"), '","":0,"b":{"a":[15e-1,{"x":', F.col("props"), ',"y":"é"},true,null],"z":1,"z":', k, '},"\\ud83d\\ude00":1000000000000000000000}')
    broken = F.when(F.col("event_id") % 9 == 0, F.substring(two, 1, 20)).otherwise(two)
    return table(spark, d, "events").select("event_id", one.alias("one"), broken.alias("two"))


def _sealed(spark, d):
    rows = sealed_json(_documents(spark, d), "one").withColumnsRenamed({"canonical": "text", "digest": "digest_one"})
    return sealed_json(rows, "two").select("event_id", F.md5("text").alias("text"), (F.col("digest_one") == F.col("digest")).alias("equal"))


def _protected(spark, d):
    k = F.col("event_id")
    inner = F.when(k % 3 == 0, '{"Parcel-ID": 1, "x": [{"parcel_id": 2}]}').when(k % 3 == 1, '{"a/b": {"~": {"parcelId": []}}, "parcels": 0}').otherwise("[[0, {\"name\": 1}]]")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"props": '), "props", F.lit(', "more": '), inner, F.lit("}")).alias("json"))
    return protected_keys(rows, "event_id", "json", ["parcelId", "owner name"])


QUERIES = {
    "sealed_documents": (_sealed, """
with v as (select event_id, '{"A":0.000001,"a":"' || event_type || '","b":{"a":[1.5,{"x":{"k":' || json_extract_string(props, '$.k') || '},"y":"é"},true,null],"z":' || event_id || '},"' || chr(128512) || '":1e+21,"' || chr(57344) || '":0}' as t from events)
select event_id, md5(t) as text, case when event_id % 9 > 0 then true end as equal from v"""),
    "protected_keys": (_protected, """
select event_id, unnest(case event_id % 3 when 0 then ['/more/Parcel-ID', '/more/x/0/parcel_id'] when 1 then ['/more/a~1b/~0/parcelId'] else [] end) as pointer from events"""),
}
