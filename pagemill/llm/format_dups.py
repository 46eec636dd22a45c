"""Records that differ by formatting only (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.plans.durable import durable
from pagemill.plans.skew import lookup

#: White space of Unicode, as a Java character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: The operators of a query.
OPERATORS = "site|lang|after|filetype"
_FIELD = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{OPERATORS}):[^{SPACE}]*"


def only_alnum(c: Column) -> Column:
    """Lower case, without all that is neither letter nor digit."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def url_fields(c: Column) -> Column:
    """Canonical fields of an address: before the first ``?`` (kept first, with its own mark) and each ``&`` part after it.

    Null where the part before the ``?`` has no letter or digit.
    """
    head = only_alnum(F.substring_index(c, "?", 1))
    rest = F.when(F.instr(c, "?") > 0, F.substr(c, F.instr(c, "?") + 1)).otherwise(F.lit(""))
    parts = F.filter(F.transform(F.split(rest, "&"), only_alnum), lambda x: x != "")
    return F.when(head != "", F.concat(F.array(F.concat(F.lit("/"), head)), F.transform(parts, lambda x: F.concat(F.lit("&"), x))))


def query_fields(c: Column) -> Column:
    """Canonical fields of a query: each operator with its value, and the rest, whose words keep their order.

    An operator without a value is an empty field.  Null where nothing is left.
    """
    found = F.regexp_extract_all(c, F.lit(f"({_FIELD})"), F.lit(1))
    ops = F.filter(F.transform(found, lambda x: F.concat(only_alnum(F.substring_index(x, ":", 1)), F.lit(":"), only_alnum(F.regexp_replace(x, "^[^:]*:", "")))),
                   lambda x: ~x.endswith(":"))
    rest = only_alnum(F.regexp_replace(c, _FIELD, " "))
    fields = F.when(rest != "", F.concat(ops, F.array(F.concat(F.lit("/"), rest)))).otherwise(ops)
    return F.when(F.size(fields) > 0, fields)


def codes(fields: Column) -> Column:
    """A record as a compact tuple without a dictionary: the sorted 64-bit hashes of its fields, after one 64-bit check value of them all.

    For keys that must be the same in every batch and session (``history``).
    Two unlike records fall together only if a field's identifier and the check value agree by chance: 2**-128 a pair.
    """
    return F.concat(F.array(F.xxhash64(F.lit("check"), F.array_join(F.array_sort(fields), "\x1f"))), F.array_sort(F.transform(fields, lambda x: F.xxhash64(x))))


def format_duplicates(df: DataFrame, key: str, value: str, fields) -> DataFrame:
    """Groups of equal records: (first_id, copy_id, copies), a row for each record of a group but the one with the smallest key.

    ``fields`` maps the column ``_raw`` to an array of canonical fields, or null where the record is no case.  Each
    distinct value is canonicalised once.  Its fields are encoded by a dictionary: each distinct field is an integer, numbered as the dictionary is
    written; so records are compact tuples of sorted integers, and the groups are formed over tuples with partial counts.  Equal tuples are equal records, nothing
    is hashed.  The ways into the dictionary and back to the records are lookups safe against hot fields and values.  Rows with a null key or value are no case; ``copies`` is
    the number of rows of the group, those included that repeat a key; a repeated row comes out once.
    """
    rows = df.select(F.col(key).alias("copy_id"), F.col(value).alias("_raw")).where(F.col("copy_id").isNotNull() & F.col("_raw").isNotNull())
    values = rows.groupBy("_raw").agg(F.min("copy_id").alias("_first"), F.count("*").alias("_n"))
    values = durable(values.withColumn("_f", fields(F.col("_raw"))).where(F.col("_f").isNotNull()).withColumn("_v", F.monotonically_increasing_id()), "values")
    parts = values.select("_v", "_first", "_n", F.explode("_f").alias("_field"))
    dictionary = durable(parts.select("_field").distinct().withColumn("_i", F.monotonically_increasing_id()), "dictionary")
    tuples = lookup(parts, dictionary, "_field", F.col("_v")).groupBy("_v").agg(
        F.array_sort(F.collect_list("_i")).alias("_code"), F.first("_first").alias("_first"), F.first("_n").alias("_n"))
    tuples = durable(tuples, "tuples")
    groups = tuples.groupBy("_code").agg(F.min("_first").alias("first_id"), F.sum("_n").alias("copies")).where("copies > 1")
    known = lookup(tuples.select("_v", "_code"), groups, "_code", F.col("_v"), "inner").select("_v", "first_id", "copies")
    known = durable(values.select("_v", "_raw").join(known, "_v").drop("_v"), "known")
    found = lookup(rows, known, "_raw", F.col("copy_id"), "inner")
    return found.where("copy_id <> first_id").select("first_id", "copy_id", "copies").distinct()
