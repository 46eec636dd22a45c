"""Keys under which near titles meet, whatever else there is: bands of MinHash values, and a filter of pairs that loses none (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pagemill.llm.forest import grams

#: Keys of a title, and MinHash values in a key: a pair at a similarity of 0.6 shares no key with probability (1 - 0.6 ** 4) ** 64 = 0.00014.
BANDS, ROWS = 64, 4
#: Ranges of keys, texts and pairs looked at in one step.
PARTS, _TEXTS, _STEP = 1024, 2000, 1 << 20
_SEEDS = np.random.default_rng(3).integers(0, 2**32, (2, BANDS * ROWS), np.uint32)
_ENTRY = np.dtype([("key", "<u4"), ("size", "<u2"), ("id", "<i8"), ("odd", "<u8", 2)])


def _mixed(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = g * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ h >> np.uint64(29)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each text; a text of fewer than three characters is one gram, so that it is near to its like and to no other."""
    return grams([t if len(t) > 2 else t.ljust(3, "\0") for t in texts])


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, number of unlike grams, odd sketch) of each text.

    A bit of an odd sketch is the parity of the number of grams that hash to it, so that two sketches differ in no more bits than their texts in grams.
    """
    g, own = _grams(texts)
    known, number = np.unique(g, return_inverse=True)
    pairs = np.unique(own.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
    own, number = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.bincount(own, minlength=len(texts))
    h = _mixed(known)
    bit = (h >> np.uint64(57)).astype(np.int64)[number]
    odd = np.packbits((np.bincount(own * 128 + bit, minlength=128 * len(texts)) & 1).astype(np.uint8).reshape(-1, 128), axis=1).view(np.uint64)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    with np.errstate(over="ignore"):
        x = (low ^ _SEEDS[0]) * (_SEEDS[1] | np.uint32(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
    # the texts with most grams first: of those that have a further gram it is one step for all
    order = np.argsort(-size, kind="stable")
    start, more = (np.cumsum(size) - size)[order], np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    least = np.full((len(texts), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for place, n in enumerate(more.tolist()):
        np.minimum(least[:n], x[number[start[:n] + place]], out=least[:n])
    values, out = least.reshape(len(texts), BANDS, ROWS), np.empty((len(texts), BANDS), np.uint64)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS))
    for r in range(0, ROWS, 2):
        band = _mixed(band ^ (values[:, :, r].astype(np.uint64) << np.uint64(32) | values[:, :, r + 1]))
    out[order] = band
    return out, size, odd


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(asked, id, title) to (part, asked, entries): the keys of many titles, by range of keys."""
    for b in batches:
        asked = np.array(b.column(0).to_pylist(), bool)
        for side in (False, True):
            t = b.filter(pa.array(asked == side))
            if not t.num_rows:
                continue
            texts = t.column(2).to_pylist()
            k, size, odd = (np.concatenate(c) for c in zip(*(keys(texts[at:at + _TEXTS]) for at in range(0, len(texts), _TEXTS))))
            where = (k >> np.uint64(54)).astype(np.int16).ravel()
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(PARTS + 1))
            once = np.empty(len(k), _ENTRY)
            once["key"], once["size"], once["odd"], once["id"] = 0, np.minimum(size, 65535), odd, t.column(1).to_numpy()
            e = once[order // BANDS]
            e["key"] = (k.ravel()[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = np.flatnonzero(np.diff(ends))
            yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([side] * len(full)), pa.array([e[ends[p]:ends[p + 1]].tobytes() for p in full.tolist()], pa.binary())],
                                  names=["part", "asked", "entries"])


def _pairs(part: np.ndarray, asked: np.ndarray, e: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, ...]:
    """(id, found, more): see ``meet``."""
    key = part.astype(np.uint64) << np.uint64(32) | e["key"]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)
    at = at[np.lexsort((e["id"][at], asked[at], key[at]))]
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    key, asked, ids, size, odd = key[at], asked[at], e["id"][at], e["size"][at].astype(np.int64), np.ascontiguousarray(e["odd"][at])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(first, np.diff(np.append(first, len(key))))
    if most:  # the members of a group before each
        end = np.arange(len(key))
    else:  # the members of a group that don't ask
        end = group + np.add.reduceat((~asked).astype(np.int64), first)[np.searchsorted(first, group)]
    live = np.flatnonzero(asked & (end > group))
    cursor, got, more = group.copy(), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    out, width = [], 16
    while len(live):
        n = np.minimum(end[live] - cursor[live], width)
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]), _STEP):  # rows of some _STEP pairs
            rows = slice(*np.searchsorted(ends, [a, a + _STEP], "right"))
            if rows.start == rows.stop:
                continue
            j, m = live[rows], n[rows]
            q = np.repeat(np.arange(len(j)), m)
            x, y = j[q], np.arange(int(m.sum())) + np.repeat(cursor[j] - (np.cumsum(m) - m), m)
            # titles as alike as that differ in so many grams at most, and so in bits
            ok = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64) * (1 + threshold) <= (1 - threshold) * (size[x] + size[y]) + 1e-6
            ok &= (ids[x] != ids[y]) if most else True
            q, x, y = q[ok], x[ok], y[ok]
            if most:
                place = got[x] + np.arange(len(q)) - np.searchsorted(q, q)
                more[x[place >= most]] = True
                got[j] += np.bincount(q, minlength=len(j))
                x, y = x[place < most], y[place < most]
            out.append((ids[x], ids[y]))
        cursor[live] += n
        if most:
            more[live] |= (got[live] >= most) & (cursor[live] < end[live])
            live = live[(got[live] < most) & (cursor[live] < end[live])]
        else:
            live = live[cursor[live] < end[live]]
        width = min(width * 4, _STEP)
    x, y = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)]) if len(x) else np.empty(0, bool)
    return x[new], y[new], np.unique(ids[more])


def meet(threshold: float, most: int):
    """Rows (part, asked, entries) to (tid, found): who shares a key with an id that asks, and may be as similar as that.

    With ``most`` all ids ask for smaller ones: the ``most`` smallest of each key, and a row (found null) that tells that there may be more.
    Without, they ask for all that don't ask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(p, a, x) for b in batches for p, a, x in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: r[0])
        at = 0
        while at < len(rows):
            to, total = at, 0
            while to < len(rows) and (total < 2 * _STEP or rows[to][0] == rows[to - 1][0]):  # whole parts
                total += len(rows[to][2]) // _ENTRY.itemsize
                to += 1
            mine = rows[at:to]
            n = [len(r[2]) // _ENTRY.itemsize for r in mine]
            e = np.frombuffer(b"".join(r[2] for r in mine), _ENTRY)
            x, y, more = _pairs(np.repeat([r[0] for r in mine], n), np.repeat([r[1] for r in mine], n), e, threshold, most)
            late = pa.nulls(len(more), pa.int64())
            yield pa.record_batch([pa.array(np.concatenate([x, more])), pa.concat_arrays([pa.array(y), late])], names=["tid", "found"])
            at = to

    return run


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """The exact similarity of each text of ``left`` to that of ``right`` in its place."""
    n = len(left)
    g, own = _grams(left + right)
    _, number = np.unique(g, return_inverse=True)
    pairs = np.unique(own.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
    size = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=2 * n)
    place = np.sort(np.where(pairs >> np.uint64(32) < n, pairs, pairs - np.uint64(n << 32)))
    both = np.bincount((place[1:][place[1:] == place[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
    return both / np.maximum(1, size[:n] + size[n:] - both)


def verified(threshold: float):
    """Rows (tid, found, _ta, _tb) to those (tid, found) whose texts are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                b = batch.slice(at, _TEXTS)
                s = similarities(b.column("_ta").to_pylist(), b.column("_tb").to_pylist())
                yield b.select(["tid", "found"]).filter(pa.array(s >= threshold))

    return run
