"""Results of outside engines (PRJ-9, FLT-9 to FLT-12, SET-3, SRT-4, SRT-5, SNK-8, SNK-11, SNK-12, UDF-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.html import decode_entities, strip_tags
from pagemill.functions.text import is_ad, title_bad
from pagemill.functions.urls import SPACE, resolve_redirect, strip, url_encode

#: Marks of addresses that only redirect.
JUMPS = ["sogou.com/link", "baidu.com/link", "bing.com/ck/", "so.com/link"]


def request_url(template: Column, query: Column, page: Column) -> Column:
    """An engine's address for a query: ``{q}`` and ``{p}`` of its template filled in."""
    return F.replace(F.replace(template, F.lit("{q}"), url_encode(query)), F.lit("{p}"), page.cast("string"))


def parse_serps(pages: DataFrame, noise: Column, most: int = 10, kept: int = 5) -> DataFrame:
    """(engine, page, pos, title, url, snippet) of result pages (engine, page, base, html): their ``h2`` and ``h3`` blocks.

    A block counts if its first reference is a page that holds none of the engine's ``noise``, and its title is neither bad nor an
    advertisement; of the first ``most`` of these the first ``kept`` with different addresses stay.
    """
    blocks = pages.select("engine", "page", "base", noise.alias("noise"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<h[23][^>]*>(.*?)(?:</h|$)"), F.lit(1))).alias("pos", "block"))
    href = strip(F.regexp_extract("block", '(?s)href="([^"]*)', 1))
    rows = blocks.where(F.col("block").contains('href="')).withColumn("href", href)
    rows = rows.where((F.col("href") != "") & ~F.col("href").rlike("^(?:#|javascript:)") & ~F.exists(F.coalesce("noise", F.array().cast("array<string>")), lambda n: F.col("href").contains(n)))
    title = decode_entities(strip_tags(F.regexp_extract("block", r'(?s)href="[^"]*"?[^>]*>(.*?)(?:</a>|$)', 1)))
    rows = rows.withColumn("title", title).where((F.col("title") != "") & ~title_bad(F.col("title")) & ~is_ad(F.col("title")))
    url = F.when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).otherwise(resolve_redirect(F.col("base"), F.col("href")))
    text = F.replace(decode_entities(strip_tags(F.col("block"))), F.col("title"), F.lit(""))
    rows = rows.select("engine", "page", "pos", "title", url.alias("url"), F.substring(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")), 1, 180).alias("snippet"))
    w = Window.partitionBy("engine", "page")
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy("pos"))).where(F.col("_n") <= most)
    first = rows.withColumn("_d", F.row_number().over(Window.partitionBy("engine", "page", "url").orderBy("pos"))).where("_d = 1")
    return first.withColumn("_k", F.row_number().over(w.orderBy("pos"))).where(F.col("_k") <= kept).drop("_n", "_d", "_k")


def enabled(results: DataFrame, switches: DataFrame) -> DataFrame:
    """Results of engines that aren't switched off; engines without a switch are on."""
    off = switches.where("not enabled").select("engine")
    return results.join(F.broadcast(off), "engine", "left_anti")


def merge(results: DataFrame, order: list[str], most: int = 60) -> DataFrame:
    """Results in the order of priority, page, place; each address once where it is first; the first ``most``."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in order]), F.col("engine")).cast("int"), F.lit(0))
    at = F.struct(F.when(rank == 0, 1_000_000).otherwise(rank).alias("rank"), F.col("page"), F.col("pos"))
    cols = [c for c in results.columns if c not in ("url", "page", "pos")]
    first = results.groupBy("url").agg(F.min(F.struct(at.alias("at"), *cols)).alias("b"))
    return first.select("url", "b.at.page", "b.at.pos", F.col("b.at.rank").alias("rank"), *[F.col(f"b.{c}") for c in cols]).orderBy("rank", "page", "pos", "url").limit(most)


def by_quality(results: DataFrame, title: str = "title") -> DataFrame:
    """Results with clean titles first, garbled ones last, otherwise in order."""
    return results.withColumn("bad", F.coalesce(title_bad(F.col(title)) | F.col(title).contains("�"), F.lit(True)))


def serp_page(results: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page of at most 60 merged results; a number beyond the last page gives the last."""
    total = results.count()
    last = max(1, -(-total // size))
    return results.orderBy("bad", "rank", "page", "pos", "url").offset((min(max(number, 1), last) - 1) * size).limit(size)


def clean_tsv(c: Column) -> Column:
    return F.regexp_replace(c, "[\t\r\n]", " ")


def to_queue(results: DataFrame, queued: DataFrame) -> DataFrame:
    """Addresses to fetch: not redirects, not queued before, each once."""
    wanted = results.select("url").where((F.col("url") != "") & ~F.col("url").rlike("|".join(j.replace(".", r"\.") for j in JUMPS))).distinct()
    return wanted.join(queued.select("url"), "url", "left_anti")


def drain(queue: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` addresses of a queue: one drain's share."""
    return queue.orderBy("url").limit(most)


def ingested(queue: DataFrame, fetched: DataFrame, docs: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(queue, documents) after a drain: the share is marked done, and what was fetched (url and a document's columns) joins the documents.

    ``queue`` is (url, done); an address whose fetch failed is done too, and one that the documents have already isn't added twice.
    """
    share = drain(queue.where("not done").select("url"), most)
    marked = queue.join(share.withColumn("_now", F.lit(True)), "url", "left").select("url", (F.col("done") | F.coalesce("_now", F.lit(False))).alias("done"))
    some = fetched.dropDuplicates(["url"]).join(share, "url", "left_semi").join(docs.select("url"), "url", "left_anti")
    return marked, docs.unionByName(some, allowMissingColumns=True)
