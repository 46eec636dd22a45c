"""Ranked search over documents and postings (JOIN-1, JOIN-2, JOIN-6, JOIN-7, AGG-4, AGG-5, WIN-1, SRT-1, SRT-2, FLT-3, FLT-6, FLT-7)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from pagemill.functions.text import TLDS, fold_key, relevance, tokens
from pagemill.operators.dedup import excluding
from pagemill.operators.index import chunk_of, index_text, postings


@dataclass
class Query:
    """A parsed query: its phrase in lower case, and the site that the last ``site:`` names."""

    phrase: str
    site: str | None

    @classmethod
    def parse(cls, text: str) -> Query:
        site, words = None, []
        for part in text.split():
            if part.startswith("site:"):
                site = part[5:].strip().rstrip("/").lower() or site
            else:
                words.append(part)
        return cls(" ".join(words).lower(), site)

    def terms(self, words: list[str]) -> list[str]:
        """Each word once, without those that tell little: see ``text.is_low_info_token``."""
        return list(dict.fromkeys(w for w in words if not low_info(w)))


def is_tld(w: str) -> bool:
    return bool(re.fullmatch(r"\.[A-Za-z.]*", w)) and len(w) <= 12 or w in TLDS


def low_info(w: str) -> bool:
    b = len(w.encode("utf-8"))
    return b < 2 or "�" in w or is_tld(w) or len(w) == 1 and b == 3


def words_of(phrase: str) -> list[str]:
    """The same words as ``text.tokens`` gives, for a query."""
    han = re.findall("[一-鿿㐀-䶿]", phrase)
    return re.findall("[0-9a-z]{2,}", phrase.lower()) + han + [a + b for a, b in zip(han, han[1:])]


@dataclass
class SearchIndex:
    """Documents (doc_id, domain, title, description, keywords, url, dup_count) and their postings (chunk, term, doc_id).

    ``tokenize`` turns a phrase into words as those of the postings were made; ``blocked`` holds domains that are never shown.
    """

    docs: DataFrame
    post: DataFrame
    blocked: DataFrame | None = None
    tokenize: object = staticmethod(words_of)

    @classmethod
    def from_df(cls, docs: DataFrame, blocked: DataFrame | None = None) -> SearchIndex:
        return cls(docs, postings(docs, "doc_id", tokens(index_text())), blocked)

    def candidates(self, q: Query, terms: list[str]) -> DataFrame:
        """Documents that hold a term; without any term, those whose text holds the phrase (all of a site if that is empty)."""
        if terms:
            asked = self.docs.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(chunk_of(F.col("term")).alias("chunk"), "term")
            ids = self.post.where(F.col("chunk").isin(sorted({t[0] if re.match("[0-9a-z]", t) else "_" for t in terms}))).join(F.broadcast(asked), ["chunk", "term"]).select("doc_id").distinct()
            return self.docs.join(ids, "doc_id", "left_semi")
        if q.site is None and (is_tld(q.phrase) or len(q.phrase.encode("utf-8")) < 2):
            return self.docs.where(F.lit(False))
        return self.docs.where(F.lower(index_text()).contains(q.phrase))

    def scored(self, text: str) -> DataFrame:
        """Every document that matches, with its score; unfolded and unordered."""
        q = Query.parse(text)
        terms = q.terms(self.tokenize(q.phrase))
        found = self.candidates(q, terms)
        if q.site is not None:
            d = F.lower(F.col("domain"))
            found = found.where((d == q.site) | d.endswith("." + q.site))
        if self.blocked is not None:
            found = excluding(found, "domain", self.blocked, "domain")
        return found.withColumn("score", relevance(F.col("title"), F.col("description"), F.col("domain"), F.col("keywords"), q.phrase, terms)).where("score > 0")

    def search(self, text: str) -> DataFrame:
        """The best document of each fold with the fold's size; not yet ordered."""
        return fold(self.scored(text))


def fold(scored: DataFrame) -> DataFrame:
    """The best row of each fold (score, then doc_id) and ``fold_count``: one aggregation with map-side combine, so no fold is gathered or sorted
    and the scores are made once."""
    key = F.coalesce(fold_key(F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit(""))), F.lit(""))
    best = F.min_by(F.struct(*[F.col(c) for c in scored.columns]), F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("i")))
    return scored.groupBy(key.alias("_fold")).agg(best.alias("_b"), F.count("*").alias("fold_count")).select("_b.*", "fold_count")


def page(hits: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """Page ``number`` of hits by score, then doc_id; beyond the last one it is empty."""
    size, number = min(max(size, 1), 100), max(number, 1)
    return hits.orderBy(F.desc("score"), "doc_id").offset((number - 1) * size).limit(size)


def pages(total: int, size: int) -> int:
    return math.ceil(total / size)


def duplicate_titles(docs: DataFrame, samples: int = 10) -> DataFrame:
    """(fold, n, samples): folds of two documents or more with the domains of their first ``samples`` documents.

    The samples of a fold are cut to ``samples`` for each task before they are brought together.
    """
    rows = docs.select("doc_id", "domain", fold_key(F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit(""))).alias("fold"))
    counts = rows.groupBy("fold").agg(F.count("*").alias("n")).where("n > 1")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy("doc_id"))).where(F.col("r") <= samples)
    some = top.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("doc_id", "domain"))).alias("samples"))
    return counts.join(some, "fold")


def with_fallback(local: DataFrame, other: DataFrame) -> DataFrame:
    """``local``, or ``other`` if that is empty (SET-6): one plan, decided by an anti join on a constant."""
    some = local.limit(1).select(F.lit(1).alias("_x"))
    return local.unionByName(other.withColumn("_x", F.lit(1)).join(some, "_x", "left_anti").drop("_x"))
