"""Capping the rows of dominant contributors (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.heavy_hitters import WHITE
from pagemill.plans.durable import durable
from pagemill.plans.skew import lookup


def reservoir_key(score: Column, ident: Column, temperature: float, seed: int) -> Column:
    """The key by which a reservoir keeps its rows, larger first; null ranks last.

    An exponential key E/w, the row with the smallest staying, orders rows as ln w - ln E does.  ``temperature`` scales
    the random part: at 1 this is weighted sampling without replacement with w = score (rows without a positive
    score come last), at 0 the part is gone and the best scores stay.
    """
    s = F.when(F.isnan(score), F.lit(None)).otherwise(score)
    if not temperature:
        return s
    u = (F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.when(s > 0, F.log(s) - temperature * F.log(-F.log(u)))


def cap_contributors(df: DataFrame, key: str, contributor: str, score: str, cap: int | None = None, *, share: float | None = None, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """``df``'s (key, contributor, kept): false for the rows that must go for each contributor to keep at most ``cap``, or at most ``share`` of all rows of ``df``.

    With both, the smaller limit holds; a share is rounded down.

    Reservoirs of the ``cap`` largest keys are kept for each contributor and partition before the shuffle (the window
    limit), so a contributor with a third of all rows sends ``cap`` rows from each; the smallest key of the merged reservoir
    is then looked up by every row.  Among equal keys the smaller ``key`` stays.  Null and NaN scores rank last, alike;
    rows with a null contributor all stay; a null ``key`` ranks after the others.  ``cap`` 0 lets every known contributor's rows go.
    """
    none = F.col("_k").isNull()
    if cap is None and share is None:
        raise ValueError("a cap or a share is needed")
    rows = durable(df.select(F.col(key).alias("_id"), F.col(contributor).alias("_c"), reservoir_key(F.col(score).cast("double"), F.col(key), temperature, seed).alias("_k")), "keys")
    if share is not None:
        part = int(rows.count() * share)
        cap = part if cap is None else min(cap, part)
    order = [F.col("_k").desc_nulls_last(), F.col("_id").asc_nulls_last()]
    bounds = (rows.where(F.col("_c").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(*order)))
              .where(F.col("_r") <= max(cap, 1)).where(F.col("_r") == max(cap, 1)).select("_c", F.col("_k").alias("_bk"), F.col("_id").alias("_bid")))
    all_ = lookup(rows, bounds.withColumn("_full", F.lit(True)), "_c", F.col("_id"))
    last, worse = F.coalesce(F.col("_bid"), F.lit(2**63 - 1)), F.col("_id").isNull() | (F.col("_id") > F.col("_bid"))
    gone = F.when(F.col("_full").isNull(), F.lit(False)).when(F.col("_bk").isNull(), none & worse & (last < 2**63 - 1)).otherwise(
        none | (F.col("_k") < F.col("_bk")) | ((F.col("_k") == F.col("_bk")) & worse))
    if cap == 0:
        gone = F.col("_c").isNotNull()
    return all_.select(F.col("_id").alias(key), F.col("_c").alias(contributor), (~gone).alias("kept"))


def clean_domain(c: Column) -> Column:
    """Lower case, without outer white space and final dots; null where nothing is left."""
    t = F.rtrim(F.trim(F.lower(c), F.lit(WHITE)), F.lit("." + WHITE))
    return F.when(t != "", t)
