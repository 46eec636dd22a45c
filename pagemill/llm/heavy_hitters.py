"""Most frequent values of a column, in bounded memory (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagemill.plans.durable import durable

# The characters with the Unicode property White_Space, and the separators U+001C to U+001F.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Odd 64-bit multipliers, one for each row of a sketch.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)


def clean_query(c):
    """A query as the statistics count it: without outer white space of any kind, in lower case."""
    return F.lower(F.trim(c, F.lit(WHITE)))


class Sketch:
    """Count-min sketch with conservative update, and a bounded set of the heaviest values seen."""

    def __init__(self, width: int, depth: int, heap: int):
        self.shift = np.uint64(64 - (width - 1).bit_length())
        self.cells = np.zeros((depth, 1 << (width - 1).bit_length()), np.int64)
        self.heap = heap
        self.best: dict[str, int] = {}
        self.total = 0
        self.floor = 0

    def add(self, values: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Values that differ from each other, with 64-bit hashes and counts; an estimate never falls below the truth."""
        self.total += int(counts.sum())
        with np.errstate(over="ignore"):
            at = [(hashes * np.uint64(ODD[d])) >> self.shift for d in range(len(self.cells))]
        now = np.min([row[i] for row, i in zip(self.cells, at)], axis=0) + counts
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, now)
        heavy = np.flatnonzero(now > self.floor)
        if len(heavy) > 2 * self.heap:
            heavy = heavy[np.argpartition(now[heavy], -self.heap)[-self.heap:]]
        self.best.update(zip(values.take(pa.array(heavy)).to_pylist(), now[heavy].tolist()))
        if len(self.best) > 2 * self.heap:
            kept = sorted(self.best.items(), key=lambda x: (-x[1], x[0]))[: self.heap]
            self.best, self.floor = dict(kept), kept[-1][1]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by hash within each batch: a hot value crosses the shuffle once for a batch."""
    for b in batches:
        if b.num_rows:
            v = pc.value_counts(b.column(0))
            yield pa.record_batch([v.field("values"), v.field("counts").cast(pa.int64())], names=["h", "n"])


def _sketch(width: int, depth: int, heap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(width, depth, heap)
        for b in batches:
            g = pa.table(b).group_by("h").aggregate([("n", "sum")]).combine_chunks()
            if g.num_rows:
                s.add(g["h"].chunk(0), g["h"].to_numpy().astype(np.uint64), g["n_sum"].to_numpy())
        if s.total:
            top = sorted(s.best.items(), key=lambda x: (-x[1], x[0]))[:heap]
            yield pa.record_batch([pa.array([None, *(v for v, _ in top)], pa.int64()), pa.array([s.total, *(n for _, n in top)], pa.int64())], names=["h", "n"])

    return run


def heavy_hitters(df: DataFrame, value: str, *, key: str | None = None, support: float = 0.005, width: int = 1 << 16,
                  depth: int = 4, heap: int = 1024) -> DataFrame:
    """Values that make up at least ``support`` of all rows: (value, approx_count, total).

    ``value`` is a string column; rows whose value is null or empty don't count.  Rows with the same ``key`` and value
    count once (repeated deliveries); rows with a null key all count.  Values take part as 64-bit hashes, so texts aren't shuffled.  The rows, counted
    within each Arrow batch, go by hash to sketches, so that each value is in exactly one and the heaps are disjoint; a hot value
    arrives as one row of a batch.  Memory of a task: ``width * depth`` cells and ``2 * heap`` hashes, whatever the
    data.  Estimates are never below the truth, and above it by more than e/width of a partition's rows with
    probability exp(-depth) at most.  Only the rows of the candidates, those whose estimate reaches ``support``, are read again, for their texts and
    exact counts: so nothing below ``support`` comes out.  ``heap`` must be at least 2/support.  An empty table gives no row.
    """
    if heap * support < 2:
        raise ValueError("heap must be at least 2 / support")
    rows = df.select(F.col(value).alias("v"), *([F.col(key).alias("k")] if key else [])).where(F.col("v") != "").withColumn("h", F.xxhash64("v"))
    # a row without a key is told apart by its place, which nothing else is computed from
    once = lambda some, c: some.select("k", F.when(F.col("k").isNull(), F.monotonically_increasing_id()).alias("_null"), c).distinct().select(c) if key else some.select(c)
    parts = once(rows, "h").mapInArrow(_partial, "h long, n long").repartition("h")
    found = durable(parts.mapInArrow(_sketch(width, depth, heap), "h long, n long"), "heaps")
    total = found.where("h is null").agg(F.sum("n")).first()[0] or 0
    likely = found.where(F.col("h").isNotNull() & (F.col("n") >= support * total)).select("h")  # some 1/support hashes, heap of each partition at most
    counts = once(rows.join(F.broadcast(likely), "h", "left_semi"), "v").groupBy("v").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= support * total).select(F.col("v").alias("value"), F.col("n").alias("approx_count"), F.lit(total).cast("long").alias("total"))
