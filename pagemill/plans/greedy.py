"""Who stays, where rows are taken in order and one that meets an earlier one that stayed goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.plans.durable import durable
from pagemill.plans.skew import lookup

#: States: undecided, stays, goes, and open: what it depends on isn't all known.
UNDECIDED, STAYS, GOES, OPEN = range(4)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows (cid, x, y, pub, more, s) sorted by cid: the state of each cid that was undecided."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    cid, x, y, pub, more, s = (t.column(c).to_numpy() for c in ("cid", "x", "y", "pub", "more", "s"))
    order = np.lexsort((y, x))
    new = np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])
    key = np.empty(len(x), np.int64)
    key[order] = np.cumsum(new) - 1
    told = np.zeros(int(new.sum()), np.int8)  # the state last said at each key: STAYS beats OPEN
    starts = np.flatnonzero(np.concatenate([[True], np.diff(cid) != 0]))
    ids, states = [], []
    keys, pubs = key.tolist(), pub.tolist()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cid)]):
        if (now := int(s[a])) == UNDECIDED:
            heard = {told[k] for k in keys[a:b]}
            now = GOES if STAYS in heard else OPEN if OPEN in heard or more[a:b].any() else STAYS
            ids.append(int(cid[a]))
            states.append(now)
        if now != GOES:
            for k, p in zip(keys[a:b], pubs[a:b]):
                if p and told[k] != STAYS:
                    told[k] = now
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(states, pa.int32())], names=["cid", "n"])


def decide(heard: DataFrame, *, block: int = 400_000, rounds: int = 6) -> DataFrame:
    """(cid, s) for each cid of ``heard``: (cid long, x long, y long, pub boolean, more boolean).

    A cid listens at its keys (x, y) and, where ``pub``, speaks there.  Taken in order, a cid goes if an earlier one that stays
    speaks at one of its keys; else it stays, unless ``more`` says that it depends on keys not given, or an earlier open one speaks there: then it is open.

    Rounds decide every cid that no undecided earlier one speaks to, over all rows at once.  What is left (long chains, in which each
    depends on the one before) is taken in blocks of the next ``block`` rows, each in one pass in one task, so the number of
    steps is bounded by rows / block and the memory by the block, however long a chain.
    """
    state = heard.select("cid", "x", "y", "pub", F.coalesce("more", F.lit(False)).alias("more"), F.lit(UNDECIDED).alias("s"))
    done: DataFrame | None = None
    left, turn = state.count(), 0
    pass_ = lambda rows: rows.repartition(1).sortWithinPartitions("cid").mapInArrow(_in_order, "cid long, n int")
    while True:
        if left <= block:
            news = pass_(state)
        elif turn < rounds:
            mine = state.withColumn("k", F.struct("x", "y"))
            low = lambda s: F.min(F.when(F.col("s") == s, F.col("cid")))
            said = mine.where("pub").groupBy("k").agg(low(UNDECIDED).alias("mu"), low(STAYS).alias("ms"), low(OPEN).alias("mo"))
            told = lookup(mine.where(F.col("s") == UNDECIDED).select("cid", "more", "k"), said, "k", F.col("cid")).groupBy("cid").agg(
                F.min("mu").alias("mu"), F.min("ms").alias("ms"), F.min("mo").alias("mo"), F.max("more").alias("more"))
            news = told.select("cid", F.when(F.col("ms") < F.col("cid"), GOES).when(F.col("mu") < F.col("cid"), UNDECIDED).when(
                F.col("more") | (F.col("mo") < F.col("cid")), OPEN).otherwise(STAYS).alias("n"))
        else:
            undecided = state.where(F.col("s") == UNDECIDED)
            last = undecided.orderBy("cid").limit(block).agg(F.max("cid")).first()[0]
            mine = state.where(F.col("cid") <= last)
            near = undecided.where(F.col("cid") <= last).select("x", "y").distinct()
            news = pass_(mine.join(near, ["x", "y"], "left_semi"))
        news = durable(news.where(F.col("n") != UNDECIDED), "decided")
        done = news if done is None else done.unionByName(news)
        if left <= block:
            return done.select("cid", F.col("n").alias("s"))
        moved = state.join(news, "cid", "left").select("cid", "x", "y", "pub", "more", F.coalesce("n", "s").alias("s")).where(F.col("s") != GOES)
        open_ = moved.where(F.col("s") == UNDECIDED)
        state = durable(open_.unionByName(moved.where((F.col("s") != UNDECIDED) & F.col("pub")).join(open_.select("x", "y").distinct(), ["x", "y"], "left_semi")), "state")
        left = state.where(F.col("s") == UNDECIDED).count()
        turn += 1
        if not left:
            return done.select("cid", F.col("n").alias("s"))
