"""Readers and writers of the engine's files (SRC-1 to SRC-12, SNK-3 to SNK-10)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions.urls import domain_of, file_name, strip


def site_pages(spark: SparkSession, root: str) -> DataFrame:
    """(domain, rel, html) of a tree of sites: each ``.html`` file below a directory for each domain."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").option("wholetext", "true").text(root)
    rel = F.regexp_extract(F.input_file_name(), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/([^/]+)/(.+)$", 2)
    return files.select(F.regexp_extract(F.input_file_name(), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/([^/]+)/(.+)$", 1).alias("domain"), rel.alias("rel"), F.col("value").alias("html"))


def save_pages(pages: DataFrame, path: str) -> None:
    """Pages (url, html) by domain, with the name each would have as a file."""
    pages.select(domain_of(F.col("url")).alias("domain"), file_name(F.col("url")).alias("file"), "html").where("domain is not null").write.mode("overwrite").partitionBy("domain").parquet(path)


def space_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos, word): words of a list in order, without comments."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~strip(F.col("value")).startswith("#"))
    return lines.select("line", F.posexplode(F.split(strip(F.col("value")), r"\s+")).alias("pos", "word")).where((F.col("word") != "") & ~F.col("word").startswith("#"))


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of names, one a line, in lower case; a missing file is an empty list."""
    try:
        return spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("fragment")).where((F.col("fragment") != "") & ~F.col("fragment").startswith("#"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "fragment string")


@dataclass
class Config:
    """``key = value`` settings of a run."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        out = {}
        for n, line in enumerate(text.splitlines(), 1):
            t = line.strip()
            if t and not t.startswith("#"):
                key, eq, value = t.partition("=")
                if not eq:
                    raise ValueError(f"line {n} has no '='")
                out[key.strip()] = value.strip()
        return cls(out)


def json_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON shards, each an array or lines; see ``operators.index.load_docs`` for defaults."""
    schema = "doc_id long, domain string, title string, description string, keywords array<string>, url string, dup_count long"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("domain string, reason string, added_at long").option("multiLine", "true").json(path)
    return rows.where("domain is not null").select("domain", F.coalesce("reason", F.lit("manual")).alias("reason"), F.coalesce("added_at", F.lit(0)).cast("long").alias("added_at"))


def cached_results(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, snippet, engine) of tab-separated lines of four fields; others are skipped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") == 4)
    return parts.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("title", "url", "snippet", "engine"))])


def save_results(results: DataFrame, path: str) -> None:
    """Results as such lines; an empty table isn't written."""
    from pagemill.operators.federate import clean_tsv

    if results.take(1):
        results.select(F.concat_ws("\t", *[clean_tsv(F.coalesce(F.col(n), F.lit(""))) for n in ("title", "url", "snippet", "engine")]).alias("value")).write.mode("overwrite").text(path)


def write_list(df: DataFrame, order: list[str], column: str, path: str) -> None:
    """A column in order as text: names of a dry run, discovered domains.  Files are in order by name, each a range of the order, so no task has more than one."""
    df.orderBy(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Small state tables (vocabularies, blocklists, tasks, counters), written whole."""
    df.write.mode("overwrite").parquet(path)
