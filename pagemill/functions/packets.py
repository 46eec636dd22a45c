"""DNS packets (FN-15): queries and the heads of responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def build_query(fqdn: Column, qtype: Column, ident: Column) -> Column:
    """A standard query with one question, recursion desired, as BINARY."""
    two = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    labels = F.array_join(F.transform(F.split(fqdn, r"\."), lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 2, "0"), F.hex(F.encode(x, "UTF-8")))), "")
    return F.concat(two(ident), F.unhex(F.lit("01000001000000000000")), F.unhex(labels), F.unhex(F.lit("00")), two(qtype), F.unhex(F.lit("0001")))


def _after_name(b: bytes, at: int) -> int | None:
    while at < len(b):
        n = b[at]
        if n == 0:
            return at + 1
        if n >= 0xC0:
            return at + 2
        if n >= 0x40:
            return None
        at += 1 + n
    return None


def head_of(b: bytes | None) -> tuple[int, int, bool] | None:
    """(response code, number of answers, truncated), or None where the packet isn't whole: names may be compressed."""
    if b is None or len(b) < 12:
        return None
    flags, questions, answers = (int.from_bytes(b[i:i + 2], "big") for i in (2, 4, 6))
    at = 12
    for n in range(questions + answers):
        at = _after_name(b, at)
        if at is None:
            return None
        if n < questions:
            at += 4
        else:
            if at + 10 > len(b):
                return None
            at += 10 + int.from_bytes(b[at + 8:at + 10], "big")
            if at > len(b):
                return None
    return flags & 15, answers, bool(flags & 0x200)


@F.pandas_udf(T.StructType().add("rcode", T.IntegerType()).add("ancount", T.IntegerType()).add("truncated", T.BooleanType()))
def _heads(packets: pd.Series) -> pd.DataFrame:
    rows = [head_of(None if p is None else bytes(p)) or (None, None, None) for p in packets]
    return pd.DataFrame(rows, columns=["rcode", "ancount", "truncated"]).astype({"rcode": "Int32", "ancount": "Int32", "truncated": "boolean"})


def parse_response(packet: Column) -> Column:
    """(rcode, ancount, truncated) of a response; all null where it can't be read."""
    return _heads(packet)
