"""Training and use of a byte-pair vocabulary (FN-10 to FN-13, AGG-14)."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.hashing import hex_bytes
from pagemill.functions.urls import SPACE

#: Words of so many bytes are trained on, so many of them at most, the bounds of a vocabulary, and its size by default.
BYTES, MOST_WORDS, SMALLEST, LARGEST, DEFAULT = (2, 64), 50_000, 300, 1_000_000, 81_920


def words_in_order(df: DataFrame, key: str, text: str, most: int | None = MOST_WORDS) -> DataFrame:
    """(word, key, pos): distinct words of 2 to 64 bytes where each occurs first; the ``most`` first of them (None: all, in no order).

    The first place of a word is a minimum with map-side combine; the limit is the feature's own bound on training.
    """
    each = df.select(key, F.posexplode(F.split(F.col(text), f"[{SPACE}]+")).alias("pos", "word")).where(F.octet_length("word").between(*BYTES))
    first = each.groupBy("word").agg(F.min(F.struct(key, "pos")).alias("at"))
    words = first.select("word", f"at.{key}", "at.pos")
    return words if most is None else words.orderBy(key, "pos").limit(most)


def pair_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """(l, r, n): how often each two bytes stand together in distinct words; ids are byte + 1."""
    ids = F.transform(hex_bytes(F.col(word)), lambda x: F.conv(x, 16, 10).cast("int") + 1)
    pairs = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return words.where(F.octet_length(word) >= 2).select(F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.count("*").alias("n"))


@dataclass
class Vocabulary:
    """Tokens by id (0 unknown, then the 256 bytes), and merges by rank; a pair merged twice keeps its later rank."""

    tokens: list[bytes] = field(default_factory=lambda: [b"<UNK>", *(bytes([b]) for b in range(256))])
    merges: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.rank = {(l, r): i for i, (l, r, _) in enumerate(self.merges)}

    def _merge(self, l: int, r: int) -> int:  # noqa: E741
        new = len(self.tokens)
        self.tokens.append(self.tokens[l] + self.tokens[r])
        self.rank[l, r] = len(self.merges)
        self.merges.append((l, r, new))
        return new

    @classmethod
    def train(cls, words: list[str], size: int) -> Vocabulary:
        """Merge the most frequent pair (ties: the smallest) until ``size`` tokens or none occurs twice; then chain what is left of each word.

        Counts are kept per pair with the words that hold it, so a merge visits those words only.
        """
        v, size = cls(), min(max(size, SMALLEST), LARGEST)
        seqs = [[b + 1 for b in w.encode("utf-8")] for w in dict.fromkeys(words)]
        counts, where = defaultdict(int), defaultdict(set)
        for i, s in enumerate(seqs):
            for p in zip(s, s[1:]):
                counts[p] += 1
                where[p].add(i)
        heap = [(-n, p) for p, n in counts.items()]  # entries whose count has changed since are skipped
        heapq.heapify(heap)
        while len(v.tokens) < size and heap:
            n, best = heapq.heappop(heap)
            if counts.get(best, 0) != -n:
                continue
            if n > -2:
                break
            new = v._merge(*best)
            counts.pop(best)
            changed = set()
            for i in where.pop(best):
                s, out, at = seqs[i], [], 0
                while at < len(s):
                    if at + 1 < len(s) and (s[at], s[at + 1]) == best:
                        out.append(new)
                        at += 2
                    else:
                        out.append(s[at])
                        at += 1
                for p, by in ((p, by) for seq, by in ((s, -1), (out, 1)) for p in zip(seq, seq[1:]) if p != best):
                    counts[p] += by
                    changed.add(p)
                    if by > 0:
                        where[p].add(i)
                seqs[i] = out
            for p in changed:
                if counts[p] > 0:
                    heapq.heappush(heap, (-counts[p], p))
                else:
                    del counts[p]
        for s in seqs:
            last = s[0] if s else 0
            for t in s[1:]:
                if len(v.tokens) >= size:
                    return v
                last = v._merge(last, t)
        return v

    def encode(self, text: str) -> list[int]:
        """Ids of the words of a text, each merged by lowest rank first, leftmost first."""
        return [i for w in text.split() for i in self._word([b + 1 for b in w.encode("utf-8", "replace")])]

    def _word(self, s: list[int]) -> list[int]:
        """Pairs wait in a heap, parts are linked: n log n steps for a word of n bytes, as long as words without spaces can be."""
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j >= n or self.rank.get((s[i], s[j])) != r:
                continue
            s[i], s[j] = self.merges[r][2], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := self.rank.get((s[k], s[after[k]]))) is not None:
                    heapq.heappush(heap, (q, k))
        return [x for x in s if x >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids if i and i < len(self.tokens)).decode("utf-8", "replace")

    def token_str(self, i: int) -> str:
        return self.tokens[i].decode("utf-8", "replace") if 0 <= i < len(self.tokens) else "<UNK>"

    def tokenize(self, text: str) -> list[str]:
        return [self.token_str(i) for i in self.encode(text)]

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        """(id, token) and (rank, l, r, merged) as tables."""
        return (spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(self.tokens)], "id int, token binary"),
                spark.createDataFrame([(i, *m) for i, m in enumerate(self.merges)], "rank int, l int, r int, merged int"))

    @classmethod
    def from_frames(cls, vocab: DataFrame, merges: DataFrame) -> Vocabulary:
        return cls([bytes(r[0]) for r in vocab.orderBy("id").select("token").collect()], [tuple(r) for r in merges.orderBy("rank").select("l", "r", "merged").collect()])

    def encoder(self, spark, kind: str = "array<int>"):
        """Column function: ids of texts, by a pandas function with the vocabulary as a broadcast; words seen are remembered."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            v, known = shared.value, {}
            for b in batches:
                out = []
                for t in b:
                    if t is None:
                        out.append(None)
                        continue
                    ids = []
                    for w in t.split():
                        if (x := known.get(w)) is None:
                            x = known[w] = v.encode(w) if kind == "array<int>" else v.tokenize(w)
                            if len(known) > 500_000:
                                known.clear()
                        ids += x
                    out.append(ids)
                yield pd.Series(out)

        return run


def train(df: DataFrame, key: str, text: str, size: int) -> Vocabulary:
    """A vocabulary from the distinct words of a table, at most MOST_WORDS of them: bounded, so merged on the driver."""
    return Vocabulary.train([r[0] for r in words_in_order(df, key, text).select("word").collect()], size)


def core_terms(column: Column) -> Column:
    """Tokens without those that tell little, each once in order of appearance."""
    from pagemill.functions.text import is_low_info_token

    return F.array_distinct(F.filter(column, lambda t: ~is_low_info_token(t)))
