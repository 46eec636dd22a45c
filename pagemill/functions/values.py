"""Small conversions (FN-16, FN-18, JSN-1 to JSN-3)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_of(epoch: Column) -> Column:
    """UTC date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))


def parse_bool(c: Column) -> Column:
    """true 1 yes on; false 0 no off and empty; null for anything else."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off", ""), False)


def json_valid(c: Column) -> Column:
    """Whether a text is one JSON value."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.try_parse_json(c).isNotNull() & (F.size(alone) == 1), F.lit(False))


def json_get(c: Column, path: str, kind: str) -> Column:
    """A typed value at a path; null where the text is malformed, the path missing or the type another."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def json_count(c: Column, path: str) -> Column:
    """A number at a path as a count: null below 0, cut towards 0."""
    v = json_get(c, path, "double")
    return F.when(v >= 0, F.floor(v))


def json_of(**fields: Column) -> Column:
    """An object with sorted keys as JSON text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
