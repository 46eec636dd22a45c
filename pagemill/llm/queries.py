"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm.cap import cap_contributors, clean_domain
from pagemill.llm import forest, language
from pagemill.llm.encode import encode_corpus
from pagemill.llm.format_dups import format_duplicates, query_fields, url_fields
from pagemill.llm.heavy_hitters import WHITE, clean_query, heavy_hitters
from pagemill.llm.history import repeats
from pagemill.llm.pack import pack
from pagemill.llm.stuffing import stuffed_pages
from pagemill.plans.skew import lookup


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log").select("log_id", clean_query(F.col("query")).alias("query"))
    return heavy_hitters(log, "query", key="log_id", support=0.005).select(F.col("value").alias("query"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    urls = format_duplicates(table(spark, d, "meta_results"), "result_id", "url", url_fields)
    asked = format_duplicates(table(spark, d, "query_stats"), "stat_id", "query", query_fields)
    return urls.select(F.lit("meta_results").alias("src"), "first_id", "copy_id").unionByName(
        asked.select(F.lit("query_stats").alias("src"), "first_id", "copy_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "meta_results"), "batch_id", "result_id", "url", "title")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc_meta").groupBy("doc_id").agg(F.min(clean_domain(F.col("domain"))).alias("_domain")).where("_domain is not null")
    hits = table(spark, d, "search_hits").select("hit_id", "doc_id", "score")
    return lookup(hits, docs, "doc_id", F.col("hit_id")).withColumnRenamed("_domain", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cap_contributors(_hits(spark, d), "hit_id", "source", "score", 20).where("not kept").select("hit_id")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a weighted sample of at most 20 of each domain keeps."""
    return cap_contributors(_hits(spark, d), "hit_id", "source", "score", 20, temperature=1.0).where("kept").select("hit_id", "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "doc_meta"), "doc_id", "description", "keywords").where("stuffed_text or stuffed_keywords").select("doc_id")


def _near(spark: SparkSession, d: str, every: bool = True):
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return forest.near_duplicates(table(spark, d, "doc_meta"), "doc_id", forest.clean(text), threshold=0.7, least=80, every=every)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.all_pairs(*_near(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document of a group of two or more: the group, and its size as the right dup_count."""
    return forest.groups(*_near(spark, d, every=False)).select(F.col("_id").alias("doc_id"), F.col("group").alias("group_id"), F.col("size").alias("dup_count"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens filled with the documents: container, slot, doc_id, first token of the document, number of tokens."""
    sizes = encode_corpus(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("ids").alias("tokens"))
    return pack(sizes, "doc_id", "tokens", 2048)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    codes = sorted(r[0] for r in table(spark, d, "languages").select("code").collect())
    return language.languages(table(spark, d, "documents"), "doc_id", "text", "lang", codes)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.spoken(_scored(spark, d), "doc_id").where("named is null or named <> lang").select("doc_id", "lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document, with its language and the confidence."""
    return _scored(spark, d).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_CHARS = " || ".join(f"chr({ord(c)})" for c in WHITE)
_SP = r"\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}"


def _p2_sql() -> str:
    alnum = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    op = rf"(?i)(^|[^\p{{L}}\p{{N}}])((?:site|lang|after|filetype):[^{_SP}]*)"
    return f"""
WITH u AS (SELECT result_id AS id, url, CASE WHEN instr(url, '?') > 0 THEN substr(url, 1, instr(url, '?') - 1) ELSE url END AS head,
                  CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) ELSE '' END AS tail FROM meta_results WHERE url IS NOT NULL),
uk AS (SELECT 'meta_results' AS src, id, {alnum('head')} || '/' || array_to_string(list_sort(list_filter(list_transform(string_split(tail, '&'), lambda p: {alnum('p')}), lambda p: p <> '')), '&') AS k FROM u WHERE {alnum('head')} <> ''),
q AS (SELECT stat_id AS id, query, array_to_string(list_sort(list_filter(list_transform(regexp_extract_all(query, '{op}', 2), lambda p: {alnum("regexp_replace(p, ':', ' ')")}), lambda p: NOT (p IN ('site','lang','after','filetype')))), '&') AS ops,
             {alnum(f"regexp_replace(query, '{op}', '\\1 ', 'g')")} AS rest FROM query_stats WHERE query IS NOT NULL),
qk AS (SELECT 'query_stats' AS src, id, rest || '/' || ops AS k FROM q WHERE rest || ops <> ''),
a AS (SELECT src, id, min(id) OVER (PARTITION BY src, k) AS first_id FROM (SELECT * FROM uk UNION ALL SELECT * FROM qk))
SELECT src, first_id, id AS copy_id FROM a WHERE id <> first_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH q AS (SELECT DISTINCT log_id, lower(trim(query, {_CHARS})) AS query FROM query_log), k AS (SELECT query FROM q WHERE query <> '')
SELECT query FROM k GROUP BY query HAVING count(*) >= 0.005 * (SELECT count(*) FROM k)""",
        "p2_found": _p2_sql(),
        "p4_found": f"""
WITH d AS (SELECT doc_id, rtrim(trim(lower(domain), {_CHARS}), '.' || {_CHARS}) AS domain FROM doc_meta),
h AS (SELECT hit_id, row_number() OVER (PARTITION BY d.domain ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, hit_id) AS r
      FROM search_hits JOIN d USING (doc_id) WHERE d.domain <> '')
SELECT hit_id FROM h WHERE r > 20""",
        "p6_found": r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS c FROM doc_meta),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) AS g FROM t WHERE length(c) >= 80),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.7 * (x.n + y.n - c)""",
    }
