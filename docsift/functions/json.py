"""JSON metadata object -> map<string,string>.

String values stay as they are; any other JSON value becomes compact JSON text
(objects with sorted keys). A number written with a point or an exponent is shown as
the shortest text of its double (``1.0``, ``100.0``, ``1e+16``); one that no double holds
is invalid. Malformed JSON, a repeated key or a non-object gives NULL, which validation
turns into a rejected row. Numbers nested in arrays and objects keep Spark's JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_text(x: Column) -> Column:
    """A finite double as text: plain from 1e-4 to under 1e15, else ``d.dde+XX``."""
    plain = F.rtrim(x.cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    parts = F.split(x.cast("string"), "E")
    exponent = F.get(parts, 1).cast("int")
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    science = F.concat(F.regexp_replace(F.get(parts, 0), r"\.0$", ""), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    big = (F.abs(x) >= 1e15) | ((F.abs(x) < 1e-4) & (x != 0))
    return F.when(big, science).otherwise(plain)


def _once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once, however often it is named."""
    return F.transform(F.array(value), of)[0]


def metadata_map(variant: Column) -> Column:
    """The map of a JSON object given as a variant; NULL if it isn't usable."""
    real = lambda kind: kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    told = lambda v, kind: F.struct(v.alias("v"), kind.alias("kind"), F.when(real(kind), v.try_cast("double")).alias("d"))
    text = lambda k, x: (
        F.when(x["kind"] == "STRING", x["v"].try_cast("string"))
        .when(real(x["kind"]), double_text(x["d"]))
        .otherwise(F.to_json(x["v"]))
    )
    # The JSON is parsed once, a value's kind found once, and its double only where it is a number.
    values = lambda m: F.transform_values(m, lambda k, v: _once(F.schema_of_variant(v), lambda kind: told(v, kind)))
    endless = lambda m: F.exists(F.map_values(m), lambda x: F.abs(x["d"]) == float("inf"))
    usable = lambda m: F.when(~F.coalesce(endless(m), F.lit(False)), F.transform_values(m, text))
    return _once(values(variant.try_cast("map<string,variant>")), usable)


def normalise_metadata_json(json_col) -> Column:
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return metadata_map(F.try_parse_json(c))
