"""Structured Streaming forms of the counters and caches (STR-1, STR-2, STR-4, STR-7, and event-time windows)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.stats import query_key


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_trigger`` limits the rate."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def running_counts(stream: DataFrame, query: str = "query") -> DataFrame:
    return stream.select(query_key(F.col(query)).alias("query")).where("query <> ''").groupBy("query").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding windows of event time; rows later than the watermark are dropped, as Spark does."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w, *([by] if by else [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *([by] if by else []), "n")


def sessions(stream: DataFrame, ts: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cache_stream(stream: DataFrame, key: str, ts: str, ttl_seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """(key, ts, hit) for each request: state holds when a key was put; a hit doesn't renew it.

    State goes when the watermark, ``late`` behind the latest request, passes the time to live.
    """

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        put = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(ts, kind="stable")
        hits = []
        for t in rows[ts]:
            at = t.value // 1000
            hit = put is not None and at - put <= ttl_seconds * 1_000_000
            put = put if hit else at
            hits.append(hit)
        state.update((put,))
        state.setTimeoutTimestamp(max(put // 1000 + ttl_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "hit": hits})

    kind = dict(stream.dtypes)[key]
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {ts} timestamp, hit boolean", "put long", "append", GroupStateTimeout.EventTimeTimeout)


def bounded_cache_stream(stream: DataFrame, node: str, key: str, ts: str, *, ttl_seconds: int = 60, capacity: int = 1000) -> DataFrame:
    """(node, key, ts, hit) for each request of each node's own cache of at most ``capacity`` entries, in order of ``ts`` and then ``key`` within a micro-batch.

    A miss puts an entry; beyond the capacity the entry put first goes, whether used or not.  A hit doesn't renew; an expired entry is put again, as
    the youngest.  A row with a null key is a rebuild: it empties the cache, and its ``hit`` is null.  State is bounded by the capacity, and a null node is a node.
    """

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(batches).sort_values([ts, key], kind="stable", na_position="first")
        hits: list[bool | None] = []
        for t, x in zip(rows[ts], rows[key]):
            if x is None or x != x:
                cache.clear()
                hits.append(None)
                continue
            at = t.value // 1000
            hit = x in cache and at - cache[x] <= ttl_seconds * 1_000_000
            if not hit:
                cache.pop(x, None)
                cache[x] = at
                if len(cache) > capacity:
                    del cache[next(iter(cache))]
            hits.append(hit)
        state.update((list(cache), list(cache.values())))
        yield pd.DataFrame({node: [k[0]] * len(rows), key: rows[key].to_numpy(), ts: rows[ts].to_numpy(), "hit": pd.array(hits, dtype="boolean")})

    kinds = dict(stream.dtypes)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).select(node, key, ts)
    return rows.groupBy(node).applyInPandasWithState(fold, f"{node} {kinds[node]}, {key} {kinds[key]}, {ts} timestamp, hit boolean", f"keys array<{kinds[key]}>, puts array<long>", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, checkpoint: str, write, mode: str = "update") -> None:
    """Drive a stream over all that is there, batch by batch through ``write(batch, number)``, and stop."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def counts_of_files(spark: SparkSession, path: str, schema, work: str, query: str = "query") -> DataFrame:
    """``running_counts`` of a folder of files through a stream that ends, below ``work``.

    Each batch writes the counts that it changed under its number, so a batch that is done again replaces itself; the result is the last count of each query.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/number={number}")

    run_available(running_counts(read_log(spark, path, schema), query), f"{work}/checkpoint", write, "update")
    written = spark.read.schema("query string, n long, number long").parquet(f"{work}/out")
    return written.groupBy("query").agg(F.max_by("n", "number").alias("n"))


def start_flushing(df: DataFrame, checkpoint: str, write, every: str = "60 seconds", mode: str = "update"):
    """A running stream whose results go to ``write(batch, number)`` at most once in ``every``; the caller stops it."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()


class Progress(StreamingQueryListener):
    """Calls ``tell(number, rows, rows per second)`` after each batch of any stream of the session."""

    def __init__(self, tell):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
