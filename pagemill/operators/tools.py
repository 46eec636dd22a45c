"""The engine as a handful of named tools (UDF-1, UDF-4, UDF-5, SRT-7, PRJ-13): what a service would put on its endpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.html import sitemap_urls, sitemap_xml
from pagemill.operators import index, search, stats


def clamp(n: int, low: int, high: int) -> int:
    return min(max(n, low), high)


def context(hits: DataFrame, most: int = 10) -> DataFrame:
    """(rank, line): numbered lines of the best hits, as a text generator would be given them."""
    best = hits.orderBy(F.desc("score"), "doc_id").limit(most)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.lit("-"), F.coalesce("description", F.lit("")), F.concat(F.lit("("), F.coalesce("url", F.lit("")), F.lit(")")))
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", text.alias("t")))).alias("h"))  # at most ``most`` rows
    return ranked.select(F.posexplode("h").alias("i", "x")).select((F.col("i") + 1).alias("rank"), F.concat((F.col("i") + 1).cast("string"), F.lit(". "), F.col("x.t")).alias("line"))


@dataclass
class Tools:
    """Search, suggestions, status and sitemaps over an index; arguments out of range are clamped."""

    index: search.SearchIndex
    log: DataFrame | None = None

    def search(self, q: str, page: int = 1, limit: int = 10) -> DataFrame:
        return search.page(self.index.search(q), page, clamp(limit, 1, 100))

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        return index.suggest(index.document_frequency(self.index.post), prefix, clamp(limit, 1, 50))

    def status(self) -> DataFrame:
        return index.stats(self.index.docs, self.index.post)

    def top_queries(self, n: int = 20) -> DataFrame:
        return stats.top_queries(self.log, n)

    def duplicates(self, page: int = 1, limit: int = 50) -> DataFrame:
        limit = clamp(limit, 1, 200)
        return search.duplicate_titles(self.index.docs).orderBy(F.desc("n"), "fold").offset((max(page, 1) - 1) * limit).limit(limit)

    @staticmethod
    def sitemap(pages: DataFrame) -> DataFrame:
        """(domain, xml) of pages (domain, html)."""
        return pages.select("domain", sitemap_xml(sitemap_urls(F.col("html"), F.col("domain"))).alias("xml"))
