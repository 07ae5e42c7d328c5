"""Casts and divisions that give NULL where ANSI mode would stop the query.

Payload values arrive as text and the metric definitions rely on lenient casts.
Every helper gives the same result with ``spark.sql.ansi.enabled`` on or off.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECIMAL_TEXT = r"^\s*[+-]?[0-9]*\.[0-9]*\s*$"


def json_texts(payload: str, keys: Iterable[str]) -> Column:
    """A struct holding the text of each top-level key; NULL where a key is absent.

    One parse of the payload serves all keys. A key with a dot in it is one key. Raw control
    characters inside strings, such as a pasted tab, do not spoil the payload. Of a repeated key the
    first value that is not null counts; that parse would keep the last, so payloads whose list
    of keys repeats one of ``keys`` are read key by key instead.
    """
    keys = list(keys)
    schema = T.StructType([T.StructField(key, T.StringType()) for key in keys])
    options = {"allowNonNumericNumbers": "false", "allowUnquotedControlChars": "true"}
    named = F.json_object_keys(payload)
    wanted = F.filter(named, lambda key: key.isin(keys))
    first_values = [F.get_json_object(payload, f"$['{key}']").alias(key) for key in keys]
    # Few payloads repeat any key; only those are looked at more closely.
    repeats = _has_repeats(named) & _has_repeats(wanted)
    return F.when(repeats, F.struct(*first_values)).otherwise(F.from_json(payload, schema, options))


def _has_repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def loose_double(text: Column) -> Column:
    return text.try_cast("double")


def loose_int(text: Column) -> Column:
    """Text to int, dropping a decimal fraction: '3.9' is 3, '1e2' and 'x' are NULL."""
    # A lone point has no digits to read as a double, yet counts as 0.
    value = F.coalesce(text.try_cast("double"), F.lit(0.0))
    truncated = F.when(text.rlike(_DECIMAL_TEXT), value.try_cast("int"))
    return F.coalesce(text.try_cast("int"), truncated)


def loose_bool(text: Column) -> Column:
    return text.try_cast("boolean")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(100 * numerator, denominator)
