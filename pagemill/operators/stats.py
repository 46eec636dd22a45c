"""Counters over logs (AGG-6 to AGG-8, AGG-12, AGG-18, FLT-14, FLT-16, WIN-5, WIN-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagemill.functions.urls import strip


def query_key(c):
    """A query as it is counted: lower case, without outer white space."""
    return F.lower(strip(c))


def query_counts(log: DataFrame, query: str = "query") -> DataFrame:
    return log.select(query_key(F.col(query)).alias("query")).where("query <> ''").groupBy("query").agg(F.count("*").alias("n"))


def top_queries(log: DataFrame, n: int = 20, query: str = "query") -> DataFrame:
    return query_counts(log, query).orderBy(F.desc("n"), "query").limit(max(n, 1))


def daily(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def latency(log: DataFrame, column: str = "latency_ms") -> DataFrame:
    """One row: samples, sum and mean of what isn't null or negative; the mean of none is 0."""
    v = F.when(F.col(column) >= 0, F.col(column))
    return log.agg(F.count(v).alias("samples"), F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("total_ms"), F.coalesce(F.round(F.avg(v), 6), F.lit(0.0)).alias("mean_ms"))


def hit_rate(log: DataFrame, hit: str = "from_cache") -> DataFrame:
    hits, misses = F.count_if(F.col(hit)), F.count_if(~F.col(hit))
    return log.agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.round(F.try_divide(hits, hits + misses), 6), F.lit(0.0)).alias("rate"))


def engine_counts(log: DataFrame, engine: str = "engine") -> DataFrame:
    return log.where(F.col(engine).isNotNull()).groupBy(engine).agg(F.count("*").alias("n"))


def merged_counters(saved: DataFrame, query: str = "query", hits: str = "hits") -> DataFrame:
    """Counters of several nodes brought together by query."""
    return saved.select(query_key(F.col(query)).alias("query"), F.coalesce(hits, F.lit(0)).alias("h")).where("query <> ''").groupBy("query").agg(F.sum("h").alias("hits"), F.count("*").alias("rows"))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; by minimum with map-side combine, so a hot key is never sorted."""
    cols = [c for c in df.columns if c not in (key, *order)]
    b = df.groupBy(key).agg(F.min(F.struct(*order, *cols)).alias("b"))
    return b.select(key, *[F.col(f"b.{c}") for c in (*order, *cols)])


def tail(log: DataFrame, seq: str, after: int | None = None, capacity: int = 500) -> DataFrame:
    """The last ``capacity`` rows by sequence, or those of them after a number."""
    last = log.orderBy(F.desc(seq)).limit(capacity)
    return last if after is None else last.where(F.col(seq) > after)


def due(tasks: DataFrame, now: str = "now") -> DataFrame:
    return tasks.where(F.col("enabled") & (F.col(now) - F.col("last_run") >= F.col("interval_secs")))


def list_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: words of a list that are no comments."""
    word = F.explode(F.split(strip(F.col(column)), r"\s+")).alias("w")
    return lines.where(~strip(F.col(column)).startswith("#")).select(word).where((F.col("w") != "") & ~F.col("w").startswith("#")).agg(F.count("*").alias("entries"))


def cache_hits(requests: DataFrame, key: list[str], ts: str, order: str, ttl_seconds: int = 60) -> DataFrame:
    """``requests`` with ``hit``: whether its key was put at most ``ttl_seconds`` before; a hit doesn't renew, an expired one is put again.

    An ordered fold for each key, streamed through sorted partitions.  Keys are folded in sessions of requests that start where the gap to
    the one before exceeds the time to live, for there nothing of what came before counts; a key's sessions are spread over tasks.
    Sessions are found from the first and last request of each stretch of time as long as the time to live, by partial aggregation: within one
    no gap is that long, so only these ends are ever ordered for a key, however many requests it has.
    """
    width = max(1, ttl_seconds * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = F.floor(at / F.lit(width)).alias("_b")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    ends = requests.select(*keys, stretch, at.alias("_t")).groupBy(*[f"_k{i}" for i in range(len(key))], "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_b")
    new = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > ttl_seconds * 1_000_000, F.lit(True)).cast("long")
    found = ends.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w)).select(*[f"_k{i}" for i in range(len(key))], "_b", "_s")
    same = F.col("_b").eqNullSafe(F.col("_rb"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    parted = requests.withColumn("_rb", stretch).join(found, same).select(*requests.columns, "_s")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*requests.dtypes, ("hit", "boolean")])

    def fold(batches):
        last, put = None, None
        for pdf in batches:
            hits = []
            for *k, t in zip(*[pdf[c] for c in (*key, "_s")], pdf[ts]):
                if k != last:
                    last, put = k, None
                hit = put is not None and (t - put).total_seconds() <= ttl_seconds
                put = put if hit else t
                hits.append(hit)
            yield pdf.drop(columns=["_s"]).assign(hit=hits)

    return parted.repartition(*key, "_s").sortWithinPartitions(*key, "_s", ts, order).mapInPandas(fold, schema)
