"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.plans.durable import durable, new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the vocabulary's authors that splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: In place of a token: no merge.
NONE = 2**31 - 1
#: Words of more bytes are merged one by one.
LONG = 64
#: The same for the JVM, whose white space is that of Unicode under this flag only.
_JAVA_PATTERN = f"(?U)({PATTERN})"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: again and again the adjacent pair of lowest rank, the leftmost first, becomes one token.

    Pairs wait in a heap and parts form a linked list, so a word of n bytes takes n log n steps, however long.
    """
    import heapq

    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (m := after[k]) < n and (r := ranks.get(both := parts[k] + parts[m])) is not None:
                heapq.heappush(heap, (r, k, len(both)))
    return [ranks[p] for p in parts if p is not None]


class Pairs:
    """Which adjacent tokens merge, and to what: an open hash table in flat arrays, and the ids of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(r)
        self.bits = max(4, (len(keys) * 3).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        key, value = np.array(keys, np.int64), np.array(ids, np.int32)
        at = self.slot(key)
        while len(key):
            free = self.keys[at] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ids[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each two tokens give, NONE where they don't merge."""
        key = a << 32 | b
        at = self.slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.ids[at], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words: in each round every word merges its pair of lowest rank, the leftmost first."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            place = np.array(order[at:at + 4096])
            left = np.fromiter((len(words[i]) for i in place), np.int64, len(place))
            step = np.arange(int(left[-1]) + 1)
            ids = np.zeros((len(place), len(step)), np.int64)
            ids[step < left[:, None]] = self.bytes[np.frombuffer(b"".join(words[i] for i in place), np.uint8)]
            ranks = np.full(ids.shape, NONE, np.int32)
            pair = step[:-1] < left[:, None] - 1
            ranks[:, :-1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
            while len(place):
                best = ranks.argmin(1)
                go = ranks[np.arange(len(place)), best] < NONE
                if not go.all():
                    for i, row, n in zip(place[~go].tolist(), ids[~go].tolist(), left[~go].tolist()):
                        out[i] = row[:n]
                    place, left, ids, ranks, best = place[go], left[go] - 1, ids[go], ranks[go], best[go]
                else:
                    left = left - 1
                if not len(place):
                    break
                row = np.arange(len(place))
                new = ranks[row, best]
                keep = np.ones(ids.shape, bool)
                keep[row, best + 1] = False
                ids = ids[keep].reshape(len(place), -1)
                ids[row, best] = new
                keep[row, best + 1], keep[row, best] = True, False
                ranks = ranks[keep].reshape(len(place), -1)
                for k in (best - 1, best):
                    some = (k >= 0) & (k + 1 < left)
                    ranks[row[k >= 0], k[k >= 0]] = NONE
                    r, k = row[some], k[some]
                    ranks[r, k] = self.rank(ids[r, k], ids[r, k + 1])
        return out


class Lexicon:
    """A minimal acyclic transducer from words to lists of ids, as flat arrays that can be memory-mapped.

    States with equal futures are one (the suffixes are shared); each arc carries the number of words that come before it among
    those of its state, so the sum along a path is the word's place in sorted order, and with it its list of ids.
    """

    FIELDS = ("keys", "target", "skip", "final", "start", "ids")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        count: list[int] = []
        path: list[list] = [[False, []]]  # of each byte of the last word: final, arcs

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                at = register.get(key)
                if at is None:
                    at = register[key] = len(states)
                    states.append(key)
                    count.append(final + sum(count[t] for _, t in arcs))
                path[-1][1][-1] = (path[-1][1][-1][0], at)

        last = b""
        for w in words:
            same = len(os.path.commonprefix([last, w]))
            close(same)
            for c in w[same:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        order = len(states) - 1  # the root is the last state
        keys, target, skip = [], [], []
        for i, (final, arcs) in enumerate(states):
            n = int(final)
            for c, t in arcs:
                keys.append(i * 256 + c)
                target.append(t)
                skip.append(n)
                n += count[t]
        lists = [entries[w] for w in words]
        return cls(keys=np.array(keys, np.int64), target=np.array(target, np.int32), skip=np.array(skip, np.int32),
                   final=np.array([s[0] for s in states], bool), start=np.cumsum([0, *map(len, lists)], dtype=np.int64),
                   ids=np.array(list(chain.from_iterable(lists)), np.int32), root=order)

    def dump(self) -> bytes:
        import io

        f = io.BytesIO()
        for name in self.FIELDS:
            np.save(f, getattr(self, name))
        return f.getvalue()

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Memory-map the arrays: tasks of one machine share the pages."""
        found, at = {}, 0
        with open(path, "rb") as f:
            for name in cls.FIELDS:
                f.seek(at)
                version = np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                body, size = f.tell(), int(np.prod(shape)) * kind.itemsize
                found[name] = np.asarray(np.memmap(path, kind, "r", body, shape)) if size else np.empty(shape, kind)
                at = body + size
        return cls(root=len(found["final"]) - 1, **found)

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None where it isn't in the lexicon; all words advance together, byte by byte."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.keys):
            return [None] * len(words)
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for depth in range(int(n.max(initial=0))):
            live = live[n[live] > depth]
            want = state[live] * 256 + flat[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            state[live], place[live] = self.target[arc], place[live] + self.skip[arc]
            if not len(live):
                break
        ok = (state >= 0) & self.final[state]
        return [self.ids[self.start[p]:self.start[p + 1]].tolist() if y else None for p, y in zip(place.tolist(), ok.tolist())]


def frequent_words(df: DataFrame, text: str, most: int) -> list[str]:
    """The most frequent words of all texts that occur twice or more, ``most`` at most, whole classes of about equal counts.

    The counts are made over everything; a histogram of their logarithms (1,024 classes at most) tells how frequent a
    word must be, so that the driver gets no more than ``most`` words, whatever the number of partitions.
    """
    said = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_JAVA_PATTERN), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    said = durable(said.where((F.col("n") > 1) & (F.octet_length("w") <= LONG)).select("w", F.floor(F.log2("n") * 16).alias("c")), "words")
    room, least = most, 1 << 20
    for c, m in sorted(map(tuple, said.groupBy("c").agg(F.count("*")).collect()), reverse=True):
        room -= m
        if room < 0:
            break
        least = c
    return [r[0] for r in said.where(F.col("c") >= least).select("w").collect()]


def publish(spark: SparkSession, data: bytes) -> str:
    """Give a file to all executors, also ones that start later; its name for ``SparkFiles``."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "files") + f"/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encoder(name: str, ranks, split: str, remember: int = 400_000):
    """Arrow function: (key, text) to (key, ids).  Words seen before come from a bounded memory of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = regex.compile(split).findall
        lexicon, known, (table, pairs) = Lexicon.open(SparkFiles.get(name)), {}, ranks.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [words_of(t) if t else [] for t in part.column(1).to_pylist()]
                if len(known) > remember:
                    known.clear()
                new = [w for w in set(chain.from_iterable(texts)) if w not in known]
                raw = [w.encode("utf-8", "replace") for w in new]
                unseen = []
                for w, r, ids in zip(new, raw, lexicon.find(raw)):
                    if ids is None:
                        ids = [table[r]] if r in table else merge(r, table) if len(r) > LONG else None
                    if ids is None:
                        unseen.append((w, r))
                    else:
                        known[w] = ids
                for (w, _), ids in zip(unseen, pairs.merge([r for _, r in unseen])):
                    known[w] = ids
                lists = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in texts]
                ends = np.cumsum([0, *map(len, lists)])
                ids = pa.array(np.fromiter(chain.from_iterable(lists), np.int32, ends[-1]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)], names=["_key", "ids"])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY, split: str = PATTERN, most_words: int = 65_536) -> DataFrame:
    """(key, ids): every text as ids of a byte-level BPE vocabulary, without special tokens, exactly.

    The ``most_words`` most frequent words of all texts are merged once on the driver and compiled into a lexicon that each task maps
    into memory; other words are merged where they occur.  The lexicon decides speed only.  Null and empty texts have an
    empty list; blank ones are encoded as they are; rows with equal keys are encoded each.
    """
    spark = df.sparkSession
    ranks = load_ranks(vocabulary)
    entries = {(b := w.encode("utf-8", "replace")): merge(b, ranks) for w in frequent_words(df, text, most_words)}
    name = publish(spark, Lexicon.build(entries).dump())
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        encoder(name, spark.sparkContext.broadcast((ranks, Pairs(ranks))), split), f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
