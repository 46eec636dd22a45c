"""A left lookup join that no hot key can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of the lookup table that are broadcast at most: a key with a larger share than 1/HOT_KEYS is among them.
HOT_KEYS = 1000
#: Hot keys are found among one of so many rows; a key that is hot in a table that matters has thousands of them.
SAMPLED = 16
#: Rows that may share a key of a shuffle: a task takes so many anyway.
EVEN = 8192


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", crowd: int | None = None) -> DataFrame:
    """``left`` with the other columns of ``right``, which has at most one row for each ``key``.

    The HOT_KEYS most frequent keys of ``left``, by a sample of one row in SAMPLED, meet their rows of ``right`` by broadcast (at most
    HOT_KEYS rows, whatever the data); all others by a shuffle in which no key holds much more than 1/HOT_KEYS of the rows.
    The sample only places the work: what is found doesn't depend on it.
    ``spread`` scatters the rows already answered over the partitions of that shuffle.
    Null keys find nothing.  ``how`` is ``left`` or ``inner``.  Columns of both sides must differ but for the key.
    ``crowd``: the most rows of ``left`` that share a key, where that is known; if they are EVEN or fewer no hot keys are looked for, and nothing is broadcast for them.
    """
    others = [c for c in right.columns if c != key]
    if crowd is not None and crowd <= EVEN:
        cold = right.select(F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), *others)
        alone = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(100_000)) + 1).otherwise(F.lit(0).cast("long"))
        return left.withColumn("_s", alone).join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), how).select(*left.columns, *others)
    counts = left.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(spread, F.lit(16)), F.lit(SAMPLED)) == 0)).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where("_n > 1").orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(key)
    hot_rows = right.join(F.broadcast(hot), key, "left_semi").select(
        F.col(key).alias("_hk"), F.struct(*[F.col(c) for c in others]).alias("_hot"))
    marked = left.join(F.broadcast(hot_rows), F.col(key) == F.col("_hk"), "left").drop("_hk").withColumn(
        "_s", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(100_000)) + 1)
        .otherwise(F.lit(0).cast("long")))
    cold = right.select(F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"),
                        F.struct(*[F.col(c) for c in others]).alias("_cold"))
    joined = marked.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*[F.col(c) for c in left.columns], *[found[c].alias(c) for c in others])
