"""Hashes and fingerprints (FN-1 to FN-4).  64-bit hashes are LONGs in two's complement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pagemill.functions.urls import SPACE

#: FNV-1a's offset basis as a LONG, and its prime without the part 2**40.
BASIS, LOW_PRIME = -3750763034362895579, 435
_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def hex_bytes(c: Column) -> Column:
    """The UTF-8 bytes of a text as a list of two hexadecimal digits each, cut in one pass."""
    return F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))


def fnv1a64(c: Column) -> Column:
    """64-bit FNV-1a over UTF-8 bytes, in two 32-bit halves, so that nothing overflows under ANSI."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    codes = F.transform(hex_bytes(c), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo, hi = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        low = lo * F.lit(LOW_PRIME)
        high = (hi * F.lit(LOW_PRIME) + F.shiftrightunsigned(low, 32) + F.shiftleft(lo, 8).bitwiseAND(mask)).bitwiseAND(mask)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))

    return F.when(F.octet_length(c) > 0, F.aggregate(codes, F.lit(BASIS).cast("long"), step)).when(c.isNotNull(), F.lit(BASIS).cast("long"))


def _fnv_grams(text: str) -> np.ndarray:
    """FNV-1a of every substring of four characters, all at once: the n-th byte of each is mixed in one step."""
    if len(text) < 4:
        parts = [text.encode("utf-8", "surrogatepass")]
        raw, begin, size = np.frombuffer(parts[0], np.uint8), np.zeros(1, np.int64), np.array([len(parts[0])])
    else:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        begin, size = starts[:-4], starts[4:] - starts[:-4]
    h = np.full(len(begin), _BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            on = size > k
            h[on] = (h[on] ^ raw[begin[on] + k]) * _PRIME
    return h


def simhash_of(text: str | None) -> int | None:
    """Bit i is set if more of the substrings of four characters have it in their FNV-1a than not; the whole text if shorter; 0 if empty."""
    if text is None:
        return None
    if not text:
        return 0
    h = _fnv_grams(text)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series([simhash_of(t) for t in b], dtype="Int64")


def simhash(c: Column) -> Column:
    """SimHash over substrings of four characters; null for null."""
    return _simhash(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_text(domain: Column, text: Column) -> Column:
    """A text without its domain and hyphens, white space collapsed."""
    s = F.when(domain != "", F.replace(text, domain, F.lit(""))).otherwise(text)
    s = F.replace(F.replace(s, F.lit(" - "), F.lit(" ")), F.lit("-"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(s, f"[{SPACE}]+", " "), "^ | $", "")
