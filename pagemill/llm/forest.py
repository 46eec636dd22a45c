"""Near-duplicate records with small edits: a MinHash LSH forest with exact verification (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.plans.durable import durable
from pagemill.plans.graph import components
from pagemill.plans.skew import HOT_KEYS, lookup

BINS = 64
#: Odd multipliers of the hash functions, each of which fills BINS values of a signature.
FUNCTIONS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_EMPTY = np.uint32(0xFFFFFFFF)
#: Texts of so many unlike grams at most get a function of their own for each value: bins they can't fill would borrow the same few values.
FEW = 64
#: Values of a trie's deepest nodes, bits of each, and bits of a sketch; a node is a number of trie, values in order, and what ``Depths`` adds.
DEEP, WIDE, BITS = 6, 9, 112
_TRIE, _EXTRA = 3 + DEEP * WIDE, 7
#: The numbers of unlike grams at which recall is measured, for texts of few grams and for others.
SIZES = ((3, 4, 6, 8, 12, 16, 24, 32, 48, FEW), (45, 56, FEW, 80, 96, 128, 192, 256, 400))


def clean(c: Column) -> Column:
    """Clean form: lower case, runs of other than letters and digits as one space, none outside."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All substrings of three characters as exact 63-bit numbers, and the text each is from."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.repeat(np.arange(len(texts)), n)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    keep = own[:-2] == own[2:]
    return g[keep], own[:-2][keep]


def minhashes(texts: list[str]) -> np.ndarray:
    """Signatures of len(FUNCTIONS) * BINS values: each function puts a gram in one bin, whose least value stays.

    An empty bin borrows from the next full one (densified one-permutation hashing).
    """
    return binned(*grams(texts), len(texts))


def binned(g: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """The signatures of ``minhashes`` from the grams ``g`` of the texts ``own``."""
    out = []
    with np.errstate(over="ignore"):
        for m in FUNCTIONS:
            h = g * np.uint64(m)
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            least = np.full(texts * BINS, _EMPTY)
            np.minimum.at(least, own * BINS + (h >> np.uint64(58)).astype(np.int64), (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
            least = least.reshape(-1, BINS)
            full, missing = least, least == _EMPTY
            for step in range(1, BINS):
                if not missing.any():
                    break
                near = np.roll(full, -step, 1)
                take = missing & (near != _EMPTY)
                least = np.where(take, near + np.uint32((step * 0x9E3779B1) & 0xFFFFFFFF), least)
                missing &= ~take
            # the lowest bit of a value was cleared above: mix again, so that any bit will do for a sketch
            x = least.astype(np.uint32) * np.uint32(0x85EBCA6B)
            out.append(x ^ (x >> np.uint32(15)))
    return np.concatenate(out, 1)


def unlike(g: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """The number of unlike grams of each of at most 2,048 texts, grams told apart by 53 bits."""
    with np.errstate(over="ignore"):
        h = g * np.uint64(FUNCTIONS[0])
        h ^= h >> np.uint64(32)
        h = np.sort(own.astype(np.uint64) << np.uint64(53) | h * _MIX >> np.uint64(11))
    return np.bincount((h[np.flatnonzero(np.diff(h, prepend=~h[:1]))] >> np.uint64(53)).astype(np.int64), minlength=texts)


def independent(g: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """Signatures of as many values, each the least of all grams by a function of its own; ``own`` ascends and every text has a gram."""
    out = np.empty((texts, len(FUNCTIONS) * BINS), np.uint32)
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    with np.errstate(over="ignore"):
        for i in range(out.shape[1]):
            h = (g ^ np.uint64(i + 1) * np.uint64(FUNCTIONS[1])) * np.uint64(FUNCTIONS[0])
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            x = np.minimum.reduceat((h >> np.uint64(16)).astype(np.uint32), starts) * np.uint32(0x85EBCA6B)
            out[:, i] = x ^ (x >> np.uint32(15))
    return out


def leaves(sig: np.ndarray, trees: int, kind: int) -> np.ndarray:
    """(texts, trees): the leaf of each trie as a number whose order is that of the trie, the last bits free; ``kind`` of signatures have tries of their own."""
    out = np.tile((np.arange(trees, dtype=np.int64) + kind * trees) << _TRIE, (len(sig), 1))
    for k in range(DEEP):
        value = (sig[:, k * trees:(k + 1) * trees] >> np.uint32(10)).astype(np.int64) & ((1 << WIDE) - 1)
        out |= value << (3 + WIDE * (DEEP - 1 - k))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values two leaves of a trie share from the root on."""
    differ = (a ^ b) >> 3
    return sum((differ >> (WIDE * k) == 0).astype(np.int64) for k in range(DEEP))


def sketch(sig: np.ndarray) -> np.ndarray:
    return (sig[:, -BITS:] >> np.uint32(9) & np.uint32(1)).astype(np.uint64)


def bits_for(threshold: float) -> int:
    """Bits in which sketches of a pair at the threshold differ at most, 3.5 standard deviations granted."""
    agree = (1 + threshold) / 2
    return BITS - int(BITS * agree - 3.5 * (BITS * agree * (1 - agree)) ** 0.5)


def made_pairs(pool: np.ndarray, size: int, threshold: float, pairs: int, rng) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(grams, owner) of ``pairs`` sets of ``size`` grams of ``pool``, and of their partners, as little above the threshold as can be."""
    options = [((size - x) / (size + y), x, y) for x in range(size) for y in (x - 1, x, x + 1) if y >= 0 and x + y and (size - x) / (size + y) >= threshold]
    _, x, y = min(options, default=(1.0, 0, 0))
    n = size + y
    at = np.concatenate([rng.choice(len(pool), n, replace=False) for _ in range(pairs)]).reshape(pairs, n)
    sets = pool[at]
    return tuple((part.ravel(), np.repeat(np.arange(pairs), part.shape[1])) for part in (sets[:, :size], sets[:, x:]))


def shortened(found: np.ndarray, near: np.ndarray, recall: float) -> tuple[np.ndarray, float]:
    """(depth in each trie, recall reached): matched prefixes start at DEEP values and lose one in one trie after the other until ``recall`` is reached.

    ``found`` has the values that pairs share in each trie, ``near`` tells the pairs whose sketches pass.
    """
    trees = found.shape[1]
    depth = np.full(trees, DEEP)
    hit = (found >= depth).any(1)
    for step in range(DEEP * trees):
        reached = float((hit & near).mean())
        if reached >= recall:
            break
        t = step % trees
        depth[t] -= 1
        hit |= found[:, t] >= depth[t]
    return np.maximum(depth, 1), float((hit & near).mean())


class Depths:
    """How long a prefix must match, for each kind of signatures, number of unlike grams and trie: found by ``shortened`` on pairs of known similarity.

    Pairs whose exact similarity is right at the threshold are made of the grams of ``texts``: those the data holds are too few
    for most numbers of grams, and nearer pairs would flatter.  Between two of SIZES, the shorter prefix of both holds.
    """

    def __init__(self, texts: list[str], threshold: float, trees: int, recall: float, pairs: int = 400):
        rng = np.random.default_rng(6)
        pool = np.unique(grams(texts)[0])
        if len(pool) < 1000:
            pool = np.unique(np.concatenate([pool, rng.integers(0, 1 << 62, 1000, dtype=np.int64).astype(np.uint64)]))
        self.recalls: list[list[float]] = []
        self.table: list[np.ndarray] = []
        for kind, (sizes, signatures) in enumerate(zip(SIZES, (independent, binned))):
            depths, reached = [], []
            for size in sizes:
                a, b = (signatures(g, own, pairs) for g, own in made_pairs(pool, size, threshold, pairs, rng))
                near = (sketch(a) != sketch(b)).sum(1) <= bits_for(threshold)
                d, r = shortened(shared(leaves(a, trees, kind), leaves(b, trees, kind)), near, recall)
                depths.append(d)
                reached.append(r)
            self.recalls.append(reached)
            d = np.array(depths)
            self.table.append(np.minimum(d, np.concatenate([d[1:], d[-1:]])))
        #: The shortest prefix of each trie that any text has there: what is brought together; texts may ask for more.
        self.base = np.concatenate([t.min(0) for t in self.table])
        self.shift = 3 + WIDE * (DEEP - self.base)

    def extra(self, kind: int, n: np.ndarray) -> np.ndarray:
        """(texts, trees): values of the prefix beyond the base for texts of ``n`` unlike grams."""
        at = np.clip(np.searchsorted(SIZES[kind], n, "right") - 1, 0, len(SIZES[kind]) - 1)
        trees = self.table[kind].shape[1]
        return self.table[kind][at] - self.base[kind * trees:(kind + 1) * trees]


def signer(trees: int, depths: Depths, threshold: float):
    """Arrow function: (_id, _c, _text) to (_id, _c, _keys: the leaf of each trie with the text's extra depth, _s0 and _s1: a sketch of one bit a value).

    Texts of FEW unlike grams or fewer have signatures of the first kind; others, and those similar texts of more may have, of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(2).to_pylist()
                g, own = grams(texts)
                n = unlike(g, own, len(texts))
                for kind, which, signatures in ((0, (n > 0) & (n <= FEW), independent), (1, n >= threshold * FEW, binned)):
                    if not which.any():
                        continue
                    mine, row = which[own], np.cumsum(which) - 1
                    sig = signatures(g[mine], row[own[mine]], int(which.sum()))
                    keys, bits = leaves(sig, trees, kind) | depths.extra(kind, n[which]), sketch(sig)
                    s = [(bits[:, i:i + 56] << np.arange(56, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64) for i in (0, 56)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * trees), pa.array(keys.ravel()))
                    some = pa.array(which)
                    yield pa.record_batch([part.column(0).filter(some), part.column(1).filter(some), lists, pa.array(s[0]), pa.array(s[1])], names=["_id", "_c", "_keys", "_s0", "_s1"])

    return run


def pairer(depths: Depths, most_bits: int, mode: str):
    """Arrow function: rows sorted by (_o, _n) to candidate pairs (a, b) of a node: a long enough prefix is shared, sketches differ in ``most_bits`` at most.

    ``all`` gives every such pair; ``star`` those of each row with the one before it and with the node's first; ``across`` those of rows of unlike ``_c``.
    """

    def near(cols, x, y):
        _, n, i, c, s0, s1 = cols
        ok = np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y]) <= most_bits
        x, y = x[ok], y[ok]
        asked = depths.base[n[x] >> _TRIE] + np.minimum(n[x] & _EXTRA, n[y] & _EXTRA)
        ok = ((n[x] ^ n[y]) >> (3 + WIDE * (DEEP - asked)) == 0) & (i[x] != i[y])
        x, y = i[x[ok]], i[y[ok]]
        if len(x):
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def pairs(cols):
        o, n, _, c, *_ = cols
        size = len(n)
        node = n >> depths.shift[n >> _TRIE] << depths.shift[n >> _TRIE]
        new = np.concatenate([[True], (np.diff(node) != 0) | (np.diff(o) != 0)])
        if mode == "across":  # of the rows of a node, those of one component follow each other
            order = np.lexsort((c, np.cumsum(new)))
            cols = [x[order] for x in cols]
            _, n, _, c, *_ = cols
            run = np.flatnonzero(new | np.concatenate([[True], np.diff(c) != 0]))
            skip = np.repeat(np.append(run[1:], size), np.diff(np.append(run, size)))
        else:
            skip = np.arange(size) + 1
        first = np.flatnonzero(new)
        end = np.repeat(np.append(first[1:], size), np.diff(np.append(first, size)))
        if mode == "star":
            x = np.flatnonzero(~new)
            yield from near(cols, x - 1, x)
            yield from near(cols, np.repeat(first, np.diff(np.append(first, size)))[x], x)
            return
        at, to = np.arange(size), skip
        while True:
            live = to < end[at]
            at, to = at[live], to[live]
            if not len(at):
                return
            yield from near(cols, at, to)
            to = to + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            cols = [b.column(n).to_numpy() for n in ("_o", "_n", "_id", "_c", "_s0", "_s1")]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            if not len(cols[0]):
                continue
            shift = depths.shift[cols[1] >> _TRIE]
            node = cols[1] >> shift << shift
            cut = int(np.flatnonzero((node == node[-1]) & (cols[0] == cols[0][-1]))[0])
            if cut:
                yield from pairs([c[:cut] for c in cols])
            left = [c[cut:] for c in cols]
        if left is not None:
            yield from pairs(left)

    return run


def similarity(a: str, b: str) -> float:
    x, y = _set(a), _set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def _set(t: str) -> frozenset[str]:
    return frozenset(t[i:i + 3] for i in range(len(t) - 2))


class Exact:
    """Exact similarities of a text to some of ``texts``: the grams of all as numbers from 0, so that a text's grams are marked once and counted by lookup."""

    def __init__(self, texts: list[str]):
        g, own = grams(texts)
        self.known, number = np.unique(g, return_inverse=True)
        pairs = np.unique(own.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
        self.number = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.size = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        self.mark = np.zeros(len(self.known) + 1, np.int64)

    def similarities(self, text: str, nodes: np.ndarray) -> np.ndarray:
        q = np.unique(grams([text])[0])
        at = np.searchsorted(self.known, q)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, max(0, len(self.known) - 1))] == q)] if len(self.known) else at[:0]
        self.mark[at] = 1
        n = self.size[nodes]
        start = np.cumsum(n) - n
        hits = self.mark[self.number[np.repeat(self.first[nodes] - start, n) + np.arange(int(n.sum()))]]
        both = np.concatenate([[0], np.cumsum(hits)])
        both = both[start + n] - both[start]
        self.mark[at] = 0
        return both / np.maximum(1, n + len(q) - both)


def verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                left, right = (b.column(c).dictionary_encode() for c in ("_ta", "_tb"))
                texts, exact = left.dictionary.to_pylist(), Exact(right.dictionary.to_pylist())
                asked, nodes = left.indices.to_numpy(), right.indices.to_numpy().astype(np.int64)
                s, order = np.empty(len(asked)), np.argsort(asked, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(asked[order])) + 1) if len(order) else []:
                    s[rows] = exact.similarities(texts[asked[rows[0]]], nodes[rows])
                yield pa.record_batch([b.column("a"), b.column("b"), pa.array(s)], names=["a", "b", "similarity"]).filter(pa.array(s >= threshold))

    return run


def _twice(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.reverse(text), F.length(text)).alias("y"))


def representatives(df: DataFrame, key: str, text: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``least`` characters or more: (_id, _text) of the smallest key of equal texts; (_id, _rep) of the others."""
    rows = df.select(F.col(key).alias("_id"), text.alias("_text")).where(F.col("_id").isNotNull() & (F.length("_text") >= least))
    hashed = rows.select("_id", _twice(F.col("_text")).alias("_h"))
    first = hashed.groupBy("_h").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = durable(lookup(hashed, first, "_h", F.col("_id"), "inner").where("_id <> _rep").select("_id", "_rep", "_h").distinct(), "copies")
    kept = rows.withColumn("_h", _twice(F.col("_text"))).join(found, ["_id", "_h"], "left_anti").select("_id", "_text")
    return kept, found.select("_id", "_rep").distinct()


def near_pairs(rows: DataFrame, *, threshold: float, trees: int = 24, recall: float = 0.98, hot: int = 4096, mode: str = "all", parts: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b, similarity) of unlike texts (_id, _text) at ``threshold`` or above, a < b, similarity exact.

    An LSH forest: each of ``trees`` tries sorts the texts by DEEP values of their MinHash signatures, and texts meet where they share a prefix.  The
    prefix starts at all values and is shortened, one trie after the other, until pairs right at the threshold are found with ``recall``, measured for
    each of 19 numbers of unlike grams (``Depths``, on pairs made of the grams of 1,000 rows), with signatures of two kinds, as bins fail texts of
    few grams.  So a text's matched prefix depends on the trie and on its number of grams.  A pair that meets is looked at first by sketches of 112
    bits, with a bound 3.5 standard deviations below what the threshold gives, then exactly.

    Nodes of more than about ``hot`` rows (found by the counts of a 16th of the rows; this only spreads work) are cut into blocks, all of them; each
    pair of blocks is a node of its own, so none is capped.  ``mode`` and ``parts`` (_id, _c: a row's component) are those of ``links``.
    """
    some = rows.where(F.pmod(F.xxhash64("_id"), F.lit(16)) == 0).select(F.substring("_text", 1, 1000)).limit(1000).collect()
    depths = Depths([r[0] for r in some], threshold, trees, recall)
    kind = dict(rows.dtypes)["_id"]
    given = rows.select("_id", F.lit(0).cast("long").alias("_c"), "_text") if parts is None else rows.join(parts, "_id").select("_id", "_c", "_text")
    sign = lambda df: df.mapInArrow(signer(trees, depths, threshold), f"_id {kind}, _c long, _keys array<long>, _s0 long, _s1 long")
    node = F.expr(f"shiftright(_n, element_at(array({', '.join(map(str, depths.shift))}), cast(shiftright(_n, {_TRIE}) as int) + 1))")
    sampled = sign(given.where(F.pmod(F.xxhash64("_id"), F.lit(16)) == 0)).select(F.explode("_keys").alias("_n")).groupBy(node.alias("_g"), F.shiftright("_n", _TRIE).alias("_t")).agg(F.count("*").alias("_m"))
    key = F.xxhash64("_g", "_t").alias("_k")
    crowded = durable(sampled.where(F.col("_m") * 16 > hot).select(key, F.ceil(F.col("_m") * 32 / hot).alias("_b")), "crowded")
    entries = sign(given).select(F.explode("_keys").alias("_n"), "_id", "_c", "_s0", "_s1")
    many = crowded.count()
    if many:
        entries = entries.withColumn("_g", node).withColumn("_t", F.shiftright("_n", _TRIE)).withColumn("_k", key).drop("_g", "_t")
        if many <= HOT_KEYS:
            entries = entries.join(F.broadcast(crowded), "_k", "left")
        else:
            entries = lookup(entries, crowded, "_k", F.col("_id"))
        own = F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_b"))
        blocks = F.when(F.col("_b").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
            F.sequence(F.lit(0).cast("long"), F.coalesce("_b", F.lit(1)) - 1), lambda o: F.least(own, o) * 2**31 + F.greatest(own, o) + 1))
        entries = entries.select(F.explode(blocks).alias("_o"), "_n", "_id", "_c", "_s0", "_s1")
    else:
        entries = entries.select(F.lit(0).cast("long").alias("_o"), "_n", "_id", "_c", "_s0", "_s1")
    spread = entries.repartition(node, F.shiftright("_n", _TRIE), "_o").sortWithinPartitions("_o", "_n")
    found = spread.mapInArrow(pairer(depths, bits_for(threshold), mode), f"a {kind}, b {kind}").distinct()
    texts = rows.select("_id", "_text")
    both = found.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
    checked = both.mapInArrow(verifier(threshold), f"a {kind}, b {kind}, similarity double")
    return checked.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def links(rows: DataFrame, **options) -> DataFrame:
    """Pairs (a, b) whose components are those of ``near_pairs``, without all pairs of a crowd.

    First each row meets the one before it in each node and the node's first: so crowds of near copies become components with a few pairs for each
    row.  Then only rows of unlike components are compared within the nodes; a pair of one component would join nothing.
    """
    stars = durable(near_pairs(rows, mode="star", **options).select("a", "b"), "stars")
    found = durable(components(stars, "a", "b"), "parts")
    ids = rows.select("_id").distinct()
    labels = ids.join(found.select(F.col("node").alias("_id"), F.col("component").alias("_c")), "_id", "left").select("_id", F.coalesce("_c", "_id").cast("long").alias("_c"))
    return stars.unionByName(near_pairs(rows, mode="across", parts=durable(labels, "labels"), **options).select("a", "b"))


def near_duplicates(df: DataFrame, key: str, text: Column, *, threshold: float, least: int, every: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs between representatives of equal texts, and the other copies: ((a, b[, similarity]), (_id, _rep)).

    ``text`` is a clean form; rows with a null key or text, or fewer than ``least`` characters, take no part.  Rows of equal key and
    text are one; rows with equal keys and unlike texts are linked to whatever one of the texts is.  ``every``: all pairs;
    else those of ``links``, enough for ``groups`` (keys must be whole numbers).
    """
    reps, copies = representatives(df, key, text, least)
    reps = durable(reps, "texts")
    return durable((near_pairs if every else links)(reps, threshold=threshold, **options), "pairs"), copies


def all_pairs(pairs: DataFrame, copies: DataFrame, *, block: int = 4096) -> DataFrame:
    """Every pair (a, b) of rows, a < b, from pairs of representatives and their copies.

    The copies of a text are cut into blocks of about ``block`` rows, each of which meets all of them in a task of its own.
    """
    ends = pairs.select("a", "b")
    nodes = ends.select(F.col("a").alias("_rep")).unionByName(ends.select(F.col("b").alias("_rep"))).unionByName(copies.select("_rep")).distinct()
    members = nodes.select("_rep", F.col("_rep").alias("_id")).unionByName(copies.select("_rep", "_id"))
    left, right = members.select(F.col("_rep").alias("a"), F.col("_id").alias("x")), members.select(F.col("_rep").alias("b"), F.col("_id").alias("y"))
    across = ends.join(left, "a").join(right, "b").where("x <> y").select("x", "y")
    sizes = copies.groupBy("_rep").agg((F.floor(F.count("*") / block) + 1).alias("_n"))
    own = lookup(members, sizes, "_rep", F.col("_id"), "inner")
    mine = own.select("_rep", F.pmod(F.xxhash64("_id"), F.col("_n")).alias("_b"), F.col("_id").alias("x"))
    others = own.select("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_b"), F.col("_id").alias("y"))
    within = mine.join(others, ["_rep", "_b"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(_id, group, size): groups of rows linked by pairs or as copies; group is the smallest key."""
    found = durable(components(pairs.select("a", "b").unionByName(copies.select(F.col("_rep").alias("a"), F.col("_id").alias("b"))), "a", "b"), "groups")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return lookup(found, sizes, "component", F.col("node")).select(F.col("node").alias("_id"), F.col("component").alias("group"), "size")
