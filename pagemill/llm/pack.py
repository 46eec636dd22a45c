"""Filling containers of fixed capacity with items of varying length (problem 8)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.plans.durable import durable


#: Buckets of lengths that a histogram is reduced to, whatever the capacity; patterns of each in a fit; fits at most.
BUCKETS, TRIES, FITS = 256, 12, 8


def nnls(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 with least |a x - b| for the sparse matrix a of ``values`` at (rows, cols), cols ascending from 0 without a gap.

    Accelerated projected gradients over columns of length 1; the step is from a bound on the norm by power iteration.
    """
    if not len(cols):
        return np.zeros(0)
    first = np.flatnonzero(np.diff(cols, prepend=-1))
    size = np.sqrt(np.add.reduceat(values * values, first))
    v = values / size[cols]
    times = lambda x: np.bincount(rows, v * x[cols], len(b))
    back = lambda r: np.add.reduceat(v * r[rows], first)
    x = np.ones(len(first))
    for _ in range(30):
        x = back(times(x))
        x /= max(1e-300, np.sqrt((x * x).sum()))
    rate = 1.0 / max(1e-12, 1.05 * np.sqrt((back(times(x)) ** 2).sum()))
    x = y = np.zeros(len(first))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(times(y) - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / size


def patterns(mean: np.ndarray, counts: np.ndarray, capacity: int, slack: float, rng) -> list[tuple[int, ...]]:
    """Multisets of buckets, largest first, whose ``mean`` lengths fill a container to within ``slack``.

    Each bucket starts TRIES of them; the next ones are drawn as frequent as they are among those not larger that fit, the last is the one that fits best.
    None has more than 8 lengths and twice what the mean length asks for.
    """
    found: set[tuple[int, ...]] = set()
    total, means, held = np.cumsum(counts).tolist(), mean.tolist(), counts.tolist()
    most = 8 + int(2 * capacity * total[-1] / max(1.0, float((mean * counts).sum())))
    draws = iter(())
    for a in np.flatnonzero(counts).tolist():
        for _ in range(TRIES):
            p, room = [a], capacity - means[a]
            while room > slack and len(p) < most:
                fits = min(a, bisect_right(means, room) - 1)
                if fits < 0 or not total[fits]:
                    break
                if room <= means[fits] + slack and held[fits]:
                    b = fits  # the last one
                else:
                    if (u := next(draws, None)) is None:
                        draws = iter(rng.random(4096).tolist())
                        u = next(draws)
                    b = bisect_right(total, u * total[fits])
                p.append(b)
                room -= means[b]
            if 0 <= room <= slack:
                found.add(tuple(sorted(p, reverse=True)))
    return sorted(found, reverse=True)


class Stock:
    """How many items of each length are left."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.lengths, self.left = lengths.astype(np.int64), counts.astype(np.int64).copy()
        self.next = np.arange(len(lengths) + 1) - 1  # path to the largest index not above that has any left

    def largest(self, i: int) -> int:
        """The largest index up to ``i`` with items left, or -1."""
        path = []
        while i >= 0 and not self.left[i]:
            path.append(i)
            i = int(self.next[i])
        for x in path:
            self.next[x] = i
        return i


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(patterns of lengths with the number of containers filled by each, items placed by fitted patterns); each length is held ``counts`` times.

    The histogram is reduced to BUCKETS buckets of equal width.  Patterns of buckets are fitted to it by non-negative least squares and rounded;
    each is filled with lengths of its buckets, the last one by the largest that fits, so containers are full to the unit although buckets are wide.  What is
    left is fitted anew, until a fit places less than a twentieth of it; the rest is packed by best fit: the largest length that remains, then again
    and again the largest that fits.  Each step uses up a length or ends a pattern, so the work depends on the numbers of lengths and patterns, not of items.
    """
    stock = Stock(lengths, counts)
    done: list[tuple[tuple[int, ...], int]] = []
    fitted = 0

    def take(chosen: list[int], times: int) -> int:
        index, need = np.unique(chosen, return_counts=True)
        times = min(times, int((stock.left[index] // need).min()))
        stock.left[index] -= need * times
        if times:
            done.append((tuple(int(stock.lengths[i]) for i in chosen), times))
        return times

    def fill(first: list[int], times: int) -> int:
        """Containers that begin with one length of each bucket of ``first`` and end with the largest that fits; how many came about."""
        made = 0
        while made < times:
            chosen, room, used, carry = [], capacity, {}, 0.0
            for k, b in enumerate(first):
                low, high = starts[b], starts[b + 1] - 1
                # about the mean, less what the ones before had more than theirs
                high = max(low, min(high, int(np.searchsorted(stock.lengths, mean[b] + carry, "right")) - 1))
                if k == len(first) - 1:  # the last one may be of another bucket, if that fills the container better
                    low, high = 0, int(np.searchsorted(stock.lengths, room, "right")) - 1
                i = stock.largest(min(high, int(np.searchsorted(stock.lengths, room, "right")) - 1))
                while i >= low and used.get(i, 0) >= stock.left[i]:
                    i = stock.largest(i - 1)
                if i < low:
                    i = next((x for x in range(max(low, high), starts[b + 1]) if used.get(x, 0) < stock.left[x] and stock.lengths[x] <= room), -1)
                if i < 0:
                    return made
                carry += mean[b] - float(stock.lengths[i])
                chosen.append(i)
                used[i] = used.get(i, 0) + 1
                room -= int(stock.lengths[i])
            if room > width // 4 + 1 and len(first) > 1:
                return made
            made += take(chosen, times - made)
        return made

    width = max(1, -(-capacity // BUCKETS))
    bucket = (stock.lengths - 1) // width
    starts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    rng = np.random.default_rng(8)
    for _ in range(FITS if len(lengths) else 0):
        held = np.bincount(bucket, stock.left, BUCKETS)
        total = int(stock.left.sum())
        mean = np.where(held > 0, np.bincount(bucket, stock.left * stock.lengths, BUCKETS) / np.maximum(1, held), (np.arange(BUCKETS) + 1) * width)
        ps = patterns(mean, held.astype(np.int64), capacity, width / 2, rng)
        if not ps:
            break
        cells = [(x, j, p.count(x)) for j, p in enumerate(ps) for x in dict.fromkeys(p)]
        rows, cols, n = (np.array(x) for x in zip(*cells))
        scale = 1 / np.sqrt(np.maximum(1, held))
        fit = nnls(rows, cols, n * scale[rows], held * scale)
        placed = 0
        for j in np.argsort(-fit, kind="stable").tolist():
            if times := int(fit[j] + 0.5):
                placed += fill(list(ps[j]), times) * len(ps[j])
        fitted += placed
        if placed * 20 < total:
            break
    top = len(lengths) - 1
    while (i := stock.largest(top)) >= 0:
        top, chosen, room, used = i, [], capacity, {}
        while i >= 0:
            chosen.append(i)
            used[i] = used.get(i, 0) + 1
            room -= int(stock.lengths[i])
            i = stock.largest(min(i, int(np.searchsorted(stock.lengths, room, "right")) - 1))
            while i >= 0 and used.get(i, 0) >= stock.left[i]:
                i = stock.largest(i - 1)
        take(chosen, 1 << 62)
    return done, fitted


def pack(df: DataFrame, key: str, size: str, capacity: int, *, buckets: int = 4096) -> DataFrame:
    """(container, slot, key, first, n): every unit of every item exactly once, n units of it from ``first``.

    Items longer than ``capacity`` give full containers of their own, and what is left of them is an item; no other is split.  Items of
    null, zero or negative size have no unit and no row; equal keys are told apart by their place.  Only the histogram of
    sizes, ``capacity`` counts at most, comes to the driver.  Items of a size are numbered by hash bucket: counts of
    bucket and size are summed up, then rows numbered within their bucket, so a size that all items share is still spread over all tasks.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_n"))
    rows = durable(rows.where(F.col("_n") > 0), "sizes").withColumn("_rest", F.pmod("_n", F.lit(capacity)))
    items = rows.where("_rest > 0").select("_key", (F.col("_n") - F.col("_rest")).alias("_first"), F.col("_rest").alias("_len"))
    items = items.withColumn("_b", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    table = durable(items.groupBy("_len", "_b").agg(F.count("*").alias("_c")), "counts")
    hist = sorted(tuple(r) for r in table.groupBy("_len").agg(F.sum("_c")).collect())
    lengths, counts = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    pieces: dict[int, list[tuple[int, int, int, int]]] = {int(x): [] for x in lengths}
    used, containers = dict.fromkeys(pieces, 0), 0
    for p, times in plan(lengths, counts, capacity)[0]:
        for slot, x in enumerate(p):
            pieces[x].append((used[x], containers, slot, times))
            used[x] += times
        containers += times
    plan_ = df.sparkSession.sparkContext.broadcast({x: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for x, v in pieces.items()})
    before = table.withColumn("_at", F.sum("_c").over(Window.partitionBy("_len").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_b", "_len").orderBy("_key", "_first"))
    ranked = items.withColumn("_r", within).join(before.select("_len", "_b", F.coalesce("_at", F.lit(0)).alias("_at")), ["_len", "_b"]).withColumn("_r", F.col("_at") + F.col("_r") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container, slot = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            n, r = b["_len"].to_numpy(), b["_r"].to_numpy()
            for x in np.unique(n):
                at = np.flatnonzero(n == x)
                begin, first, slots, _ = plan_.value[int(x)]
                i = np.searchsorted(begin, r[at], "right") - 1
                container[at], slot[at] = first[i] + r[at] - begin[i], slots[i]
            yield pd.DataFrame({"container": container, "slot": slot, "_key": b["_key"], "first": b["_first"], "n": n})

    kind = dict(df.dtypes)[key]
    placed = ranked.select("_key", "_first", "_len", "_r").mapInPandas(place, f"container long, slot long, _key {kind}, first long, n long")
    wide = rows.where(F.col("_n") >= capacity).select("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_n div {capacity}") - 1)).alias("_part"))
    full = wide.select((-1 - F.monotonically_increasing_id()).alias("container"), F.lit(0).cast("long").alias("slot"), "_key",
                       (F.col("_part") * capacity).alias("first"), F.lit(capacity).cast("long").alias("n"))
    return placed.unionByName(full).withColumnRenamed("_key", key)
