"""The inverted index (AGG-1, AGG-2, SRC-3 to SRC-5, SNK-1, SNK-2, SRT-3, FN-7)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.functions.text import chunk_of, tokens
from pagemill.functions.urls import strip


def index_text(title: str = "title", description: str = "description", domain: str = "domain", keywords: str = "keywords") -> Column:
    return F.concat_ws(" ", title, description, domain, F.array_join(keywords, " "))


def postings(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(chunk, term, key): each term of each document once; a document's terms are made distinct before the shuffle there may be later."""
    return df.select(key, F.explode(F.array_distinct(terms)).alias("term")).select(chunk_of(F.col("term")).alias("chunk"), "term", key)


def rolled_up(post: DataFrame, key: str, shard: int = 100_000) -> DataFrame:
    """(chunk, term, part, ids): sorted lists of documents, cut by ranges of ``shard`` keys so that no list grows with the corpus."""
    part = F.floor(F.col(key) / shard).alias("part")
    return post.groupBy("chunk", "term", part).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("chunk", "term").agg(F.count("*").alias("df"))


def stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: documents, terms, chunks."""
    per = post.groupBy("chunk", "term").agg(F.lit(1).alias("_")).groupBy("chunk").agg(F.count("*").alias("n"))
    return docs.agg(F.count("*").alias("documents")).join(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count("*").alias("chunks")))


def suggest(frequency: DataFrame, prefix: str, limit: int = 10, cached: DataFrame | None = None) -> DataFrame:
    """(word, weight): words that start with a prefix, by min(df, 50) and 100 more for a cached query, then by word.

    An empty prefix suggests nothing.  The chunk of the prefix is a literal, so one partition of a stored index is read.
    """
    p = prefix.strip().lower()
    found = frequency.where((F.col("chunk") == chunk_of(F.lit(p))) & F.col("term").startswith(p)).select(F.col("term").alias("word"), F.least("df", F.lit(50)).alias("w"))
    if cached is not None:
        found = found.unionByName(cached.where(F.col("query").startswith(p)).select(F.col("query").alias("word"), F.lit(100).cast("long").alias("w")).distinct())
    if not p:
        found = found.limit(0)
    return found.groupBy("word").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "word").limit(max(limit, 1))


def load_docs(raw: DataFrame) -> DataFrame:
    """Documents read from JSON: rows that lack a mandatory field go, ``dup_count`` is 1 at least."""
    need = ["domain", "title", "description", "url", "keywords"]
    return raw.dropna(subset=need).withColumn("dup_count", F.greatest(F.coalesce(F.col("dup_count"), F.lit(1)), F.lit(1)).cast("long"))


def save(docs: DataFrame, post: DataFrame, key: str, path: str, rows_per_file: int = 100_000) -> str:
    """Write documents (JSON shards), postings (Parquet by chunk) and a row about the build as a new version below ``path``; publish it last.

    A version is complete before the pointer names it, so readers never see half of one; the pointer is a row of its own.
    """
    spark = docs.sparkSession
    version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    docs.write.option("maxRecordsPerFile", rows_per_file).json(f"{path}/{version}/docs")
    post.repartition("chunk", F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("term", key).write.partitionBy("chunk").parquet(f"{path}/{version}/postings")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("built_at")).coalesce(1).write.mode("append").json(f"{path}/versions")
    return version


def load(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of the latest published version."""
    version = spark.read.json(f"{path}/versions").orderBy(F.desc("version")).first()["version"]
    return load_docs(spark.read.schema(schema).json(f"{path}/{version}/docs")), spark.read.parquet(f"{path}/{version}/postings")


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings of the latest published version alone; a filter on ``chunk`` reads its folders only."""
    version = spark.read.json(f"{path}/versions").orderBy(F.desc("version")).first()["version"]
    return spark.read.parquet(f"{path}/{version}/postings")


def corpus(docs: DataFrame, key: str, text: Column, keywords: list[str], sites: int = 10_000) -> DataFrame:
    """The texts a vocabulary is trained on: the first ``sites`` by key, and the words of a list."""
    spark = docs.sparkSession
    listed = spark.createDataFrame([(k,) for k in keywords], "text string")
    return docs.orderBy(key).limit(sites).select(strip(text).alias("text")).unionByName(listed)


__all__ = ["corpus", "document_frequency", "index_text", "load", "load_docs", "load_postings", "postings", "rolled_up", "save", "stats", "suggest", "tokens"]
