"""Tolerant reading of JSON that a text model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What opens and closes a block of code in a text (a fixed value), and the language that may follow it.
FENCE, LANGUAGE = "```", "json"


def fenced(text: Column) -> Column:
    """What the first block of code in ``text`` holds, without blanks around it; null without a closed block."""
    inside = F.split_part(text, F.lit(FENCE), F.lit(2))
    closed = F.length(text) - F.length(F.replace(text, F.lit(FENCE), F.lit(""))) >= 2 * len(FENCE)
    bare = F.when(F.startswith(inside, F.lit(LANGUAGE)), F.substr(inside, F.lit(len(LANGUAGE) + 1))).otherwise(inside)
    return F.when(closed, F.regexp_replace(bare, r"^\s+|\s+$", ""))


def parsed(text: Column | str) -> Column:
    """The object in ``text`` as a variant: of a fenced block if there is one, else the whole, else its outermost braces; null without any."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    # most texts have no block and are looked at once; braces are sought only where the whole can't be read
    body = F.when(F.contains(raw, F.lit(FENCE)), F.coalesce(F.nullif(fenced(raw), F.lit("")), raw)).otherwise(raw)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    # an empty string is no JSON, so a text without braces gives null
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(braces))


def dumped(value: Column) -> Column:
    """JSON of a struct or map, with times in ISO 8601."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def whole(v: Column, default: int, low: int, high: int) -> Column:
    """An integer as ``int()`` of the value gives it, clamped: numbers are cut, strings must be integers, truth is 1; else ``default``."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")
    digits = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("double"))
    got = F.when(kind == "STRING", digits).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(number)
    got = F.when(F.isnan(got), None).otherwise(got)
    return F.when(got.isNull(), F.lit(default)).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), got)).cast("int"))


def real(v: Column, default: float, low: float, high: float) -> Column:
    """A number, from a number or a string of one, clamped; else ``default``."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.when(kind == "STRING", F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))).otherwise(F.try_variant_get(v, "$", "double"))
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))
