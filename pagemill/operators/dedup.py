"""Exact and near duplicates by fingerprint (JOIN-4, JOIN-5, AGG-3, FLT-2)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.hashing import fingerprint_text, fnv1a64, simhash
from pagemill.plans.durable import durable
from pagemill.plans.greedy import STAYS, decide
from pagemill.plans.skew import lookup

#: Near means at most so many bits apart, texts of so many bytes at least, lengths apart by a third of ten at most.
NEAR_BITS, LEAST_BYTES, GAP_TENTHS = 6, 128, 3


def fingerprints(df: DataFrame, key: str, text: Column, domain: Column | None = None) -> DataFrame:
    """(key, fnv, simhash, fp_len) of the fingerprint text of each row; a null text is as an empty one."""
    fp = fingerprint_text(F.lit("") if domain is None else F.coalesce(domain, F.lit("")), F.coalesce(text, F.lit("")))
    return df.select(key, fp.alias("_fp")).select(key, fnv1a64(F.col("_fp")).alias("fnv"), simhash(F.col("_fp")).alias("simhash"), F.octet_length("_fp").cast("long").alias("fp_len"))


def exact_duplicates(df: DataFrame, key: str, value: str) -> DataFrame:
    """(first, key): every row whose value has been seen with a smaller key, and the smallest one.

    Values are compared by two 64-bit hashes, so that long texts never cross a shuffle: 2**-128 a pair to be wrong.  The groups are made with
    partial aggregation and looked up, so a value that a third of all rows share is never gathered.  Nulls are no case.
    """
    hashed = F.struct(F.xxhash64(value).alias("x"), F.xxhash64(F.lit(7), F.col(value)).alias("y"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_id"), hashed.alias("_v"))
    first = rows.groupBy("_v").agg(F.min("_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return lookup(rows, first, "_v", F.col("_id"), "inner").where("_id <> first").select("first", F.col("_id").alias(key))


def _near(bits: int):
    """Arrow function: rows sorted by group to pairs that are near and agree in no earlier block of bits."""
    cuts = [(64 * i) // (bits + 1) for i in range(bits + 2)]
    masks = np.array([((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])], np.uint64)

    def pairs(k: int, i, s, n, role):
        left, right = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        for at in range(0, len(left), 256):
            rows = left[at:at + 256]
            differ = s[rows, None] ^ s[None, right]
            a, b = np.nonzero(np.bitwise_count(differ) <= bits)
            if not len(a):
                continue
            differ = differ[a, b]
            a, b = rows[a], right[b]
            ok = 10 * np.abs(n[a] - n[b]) <= GAP_TENTHS * np.maximum(n[a], n[b])
            ok &= (i[a] < i[b]) | ((role[a] == 1) & (i[a] != i[b]))
            for m in masks[:k]:
                ok &= differ & m != 0
            a, b = i[a[ok]], i[b[ok]]
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def groups(cols):
        starts = np.flatnonzero(np.diff(cols[0], prepend=~cols[0][:1]))
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(cols[0])]):
            if y - x > 1:
                yield from pairs(int(cols[1][x]), *[c[x:y] for c in cols[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("g", "k", "id", "s", "n", "role")]
            cols[3] = cols[3].astype(np.int64).view(np.uint64)  # of signed numbers, the bits of the absolute value would be counted
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.flatnonzero(cols[0] == cols[0][-1])[0])
            if cut:
                yield from groups([c[:cut] for c in cols])
            left = [c[cut:] for c in cols]
        if left is not None and len(left[0]):
            yield from groups(left)

    return run


def near_pairs(prints: DataFrame, key: str, *, bits: int = NEAR_BITS, block: int = 4096) -> DataFrame:
    """All pairs (a, b), a < b, of fingerprints at most ``bits`` bits apart, long enough and of like length; exact.

    Of ``bits + 1`` blocks of a fingerprint, such a pair agrees in one at least: each row goes to so many groups, one for each block, by the
    block's value and its class of length (bounds are a factor 10/7 apart, so partners are in the same class or the next; a row also goes to the class below).
    A pair is given in the first block in which it agrees, so nothing is given twice.  A group of more than ``block`` rows is
    cut into blocks of rows by hash, whose pairs are groups of their own; sizes are found by partial counts.
    """
    rows = prints.where(F.col("fp_len") >= LEAST_BYTES).select(F.col(key).cast("long").alias("id"), F.col("simhash").alias("s"), F.col("fp_len").alias("n"))
    cuts = [(64 * i) // (bits + 1) for i in range(bits + 2)]
    value = lambda lo, hi: F.shiftrightunsigned("s", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    rows = durable(rows.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / math.log(10 / (10 - GAP_TENTHS)))), "prints")
    keyed = rows.select("id", "s", "n", "c", F.posexplode(F.array(*[value(lo, hi) for lo, hi in zip(cuts, cuts[1:])])).alias("k", "v"))
    sizes = keyed.groupBy("k", "v", "c").agg(F.count("*").alias("m"))
    crowded = durable(sizes.where(F.col("m") > block).select(F.struct("k", "v", "c").alias("g"), F.ceil(F.col("m") / block).alias("parts")), "crowded")
    # a row is in its own class (as either end) and, as the longer end, in the class below
    placed = keyed.select("id", "s", "n", "k", "v", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("down")).withColumn("lo", F.col("c") - F.col("down"))
    placed = placed.withColumn("g", F.struct("k", "v", F.col("c").alias("c"))).withColumn("og", F.struct("k", "v", F.when(F.col("down") == 1, F.col("lo")).otherwise(F.col("c") + 1).alias("c")))
    mine = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    split = lookup(placed, crowded, "g", F.col("id")).withColumn("w", mine)
    split = lookup(split, crowded.select(F.col("g").alias("og"), F.col("parts").alias("others")), "og", F.col("id"))
    seq = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1)
    cell = lambda kind, x, y, role: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    w = F.col("w")
    within = F.transform(seq(F.col("parts")), lambda o: F.when(o == w, cell(0, w, w, 0)).when(o > w, cell(1, w, o, 1)).otherwise(cell(1, o, w, 2)))
    up = F.transform(seq(F.col("others")), lambda o: cell(2, w, o, 1))
    below = F.transform(seq(F.col("others")), lambda o: cell(2, o, w, 2))
    cells = split.select("id", "s", "n", "k", "v", "lo", F.explode(F.when(F.col("down") == 0, F.concat(within, up)).otherwise(below)).alias("x")).select("id", "s", "n", "k", "v", "lo", "x.*")
    grouped = cells.select(F.xxhash64("k", "v", "lo", "kind", "x", "y").alias("g"), F.col("k").cast("int"), "id", "s", "n", F.col("role").cast("int"))
    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(_near(bits), "a long, b long")


def representatives(prints: DataFrame, key: str, *, pairs: DataFrame | None = None) -> DataFrame:
    """(key, representative): rows taken by key; one that is equal or near to an earlier representative is a duplicate of the smallest such.

    Not components: with a ~ b ~ c only, a and c stay.  ``plans.greedy.decide`` settles chains of any length.  Copies (equal fnv) follow
    their first row, which is decided like any other.
    """
    rows = prints.select(F.col(key).cast("long").alias("id"), "fnv", "simhash", "fp_len")
    first = rows.groupBy("fnv").agg(F.min("id").alias("first"))
    rows = durable(lookup(rows, first, "fnv", F.col("id")), "firsts")
    heads = rows.where("id = first")
    pairs = durable((near_pairs(heads.select("id", "simhash", "fp_len"), "id") if pairs is None else pairs).select("a", "b"), "near")
    entry = lambda cid, x, pub: pairs.select(F.col(cid).alias("cid"), F.col(x).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(pub).alias("pub"), F.lit(False).alias("more"))
    heard = entry("b", "a", False).unionByName(entry("a", "a", True).distinct()).unionByName(entry("b", "b", True).distinct())
    kept = decide(durable(heard.distinct(), "heard")).where(F.col("s") == STAYS).select(F.col("cid").alias("a"), F.lit(True).alias("kept"))
    told = lookup(pairs, kept, "a", F.col("b"), "inner")
    gone = told.groupBy("b").agg(F.min("a").alias("rep")).join(kept.select(F.col("a").alias("b")), "b", "left_anti")
    return lookup(rows, gone.select(F.col("b").alias("first"), "rep"), "first", F.col("id")).select(F.col("id").alias(key), F.coalesce("rep", "first").alias("representative"))


def dup_counts(found: DataFrame, key: str) -> DataFrame:
    """(representative, dup_count): rows that came together in each representative, itself included."""
    return found.groupBy("representative").agg(F.count("*").alias("dup_count"))


def excluding(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """``df`` without rows whose value is listed; rows of null stay (blocklists, visited and queued addresses)."""
    names = listed.select(F.col(listed_column).alias("_x")).where("_x is not null").distinct()
    return df.join(names, F.col(column) == F.col("_x"), "left_anti")


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` and those rows of ``new`` whose key it doesn't have (SET-5)."""
    return df.unionByName(new.dropDuplicates([key]).join(df.select(key), key, "left_anti"))


def removed(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose key is in ``gone``; rows with a null key stay (SET-5)."""
    return excluding(df, key, gone, key)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
