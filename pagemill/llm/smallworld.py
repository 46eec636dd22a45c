"""A navigable small-world graph over MinHash sketches: the index of one segment of a history."""

from __future__ import annotations

import numpy as np

from pagemill.llm.forest import binned, grams

#: Prefix tables of a segment, values of a signature in a key, and words of 64 bits in a sketch.
TABLES, DEEP, WORDS = 16, 8, 4
#: Links of a node: to its nearest nodes, back from nodes it is near to, and far ones at random.
NEAR, BACK, FAR = 8, 3, 1
#: Segments of so many nodes are searched exhaustively.
TINY = 512
_NONE = np.int64(2**62)


def sketches(texts: list[str], cells: int = 0) -> tuple[np.ndarray, ...]:
    """(bytes of the first TABLES * DEEP values, sketch of one bit of each value), and with ``cells`` the so many least hashes of grams, -1 where there are fewer."""
    g, own = grams(texts)
    found = split(((binned(g, own, len(texts)) >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8))
    return (*found, least_grams(g, own, len(texts), cells)) if cells else found


def least_grams(g: np.ndarray, own: np.ndarray, texts: int, cells: int) -> np.ndarray:
    """The ``cells`` least unlike hashes of 40 bits of each text's grams, in order."""
    out = np.full((texts, cells), -1, np.int64)
    with np.errstate(over="ignore"):
        h = g * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(32)
        h = (h * np.uint64(0x9FB21C651E98DF25) >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(own) != 0)]) if len(h) else np.empty(0, bool)
    h, own = h[new], own[new]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    out[own[place < cells], place[place < cells]] = h[place < cells]
    return out


def split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.packbits(values & 1, axis=1).view(np.uint64)
    return np.ascontiguousarray(values[:, : TABLES * DEEP]), np.ascontiguousarray(bits)


def keys(prefixes: np.ndarray) -> np.ndarray:
    """(tables, rows): the values of each table as one number, so that order of numbers is that of a prefix tree."""
    return np.ascontiguousarray(prefixes.reshape(len(prefixes), TABLES, DEEP)).view(">u8")[:, :, 0].T.astype(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Segment:
    """Nodes, links, and per table the order of the nodes; ``beam`` is the width found by ``tune``, ``recall`` what it reached there.

    A segment in which no beam reaches the target has beam 0 and is searched exhaustively.
    """

    def __init__(self, prefixes: np.ndarray, sketch: np.ndarray, links: np.ndarray | None = None, beam: int = 0, recall: float = 1.0):
        self.prefixes, self.sketch, self.n = prefixes, sketch, len(sketch)
        k = keys(prefixes) if self.n else np.empty((TABLES, 0), np.uint64)
        self.order = np.argsort(k, axis=1, kind="stable")
        self.sorted = np.take_along_axis(k, self.order, 1)
        self.links, self.beam, self.recall = links, beam, recall
        if links is None and self.n > TINY:
            self.links = self._link(self._entries(keys(prefixes), 3), np.arange(self.n))
            self.links = self._link(self._walk(prefixes, sketch, 24)[0], np.arange(self.n))
            self.beam, self.recall = self.tune()

    def _entries(self, k: np.ndarray, near: int) -> np.ndarray:
        """Nodes next to each query in the order of each table: they share the longest prefixes with it."""
        step = np.arange(-near, near)
        at = [np.clip(np.searchsorted(self.sorted[t], k[t])[:, None] + step, 0, self.n - 1) for t in range(TABLES)]
        return np.concatenate([self.order[t][a] for t, a in enumerate(at)], 1)

    def _link(self, found: np.ndarray, own: np.ndarray) -> np.ndarray:
        links = np.full((self.n, NEAR + BACK + FAR), -1, np.int32)
        for at in range(0, self.n, 4096):
            f = found[at:at + 4096]
            d = distance(self.sketch[np.maximum(f, 0)], self.sketch[own[at:at + 4096], None])
            key = np.sort(np.where((f < 0) | (f == own[at:at + 4096, None]), _NONE, d << 32 | f), 1)
            key[:, 1:][key[:, 1:] == key[:, :-1]] = _NONE
            key = np.sort(key, 1)[:, :NEAR]
            links[at:at + 4096, : key.shape[1]] = np.where(key < _NONE, key & 0xFFFFFFFF, -1)
        u, c = np.nonzero(links[:, :NEAR] >= 0)
        v = links[u, c].astype(np.int64)
        o = np.lexsort((u, distance(self.sketch[u], self.sketch[v]), v))
        u, v = u[o], v[o]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
        some = place < BACK
        links[v[some], NEAR + place[some]] = u[some]
        links[:, NEAR + BACK:] = np.random.default_rng(self.n).integers(0, self.n, (self.n, FAR))
        return links

    def _walk(self, prefixes: np.ndarray, sketch: np.ndarray, beam: int, wide: int = 4, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nodes nearest to each query that walks along links reach, and their distances; -1 where there are fewer."""
        out, far = np.full((len(sketch), beam), -1, np.int64), np.full((len(sketch), beam), 1 << 20, np.int64)
        for at in range(0, len(sketch), block):
            q, start = sketch[at:at + block], self._entries(keys(prefixes[at:at + block]), 2)
            state = self._merge(distance(self.sketch[start], q[:, None]) << 33 | start << 1 | 1, beam)
            live = np.arange(len(q))
            while len(live):
                s = state[live]
                new = (s < _NONE) & (s & 1 == 1)
                some = new.any(1)
                live, s, new = live[some], s[some], new[some]
                if not len(live):
                    break
                take = np.argsort(~new, 1, kind="stable")[:, :wide]
                chosen = np.take_along_axis(new, take, 1)
                nodes = (np.take_along_axis(s, take, 1) & 0x1FFFFFFFF) >> 1
                np.put_along_axis(s, take, np.where(chosen, np.take_along_axis(s, take, 1) & ~np.int64(1), np.take_along_axis(s, take, 1)), 1)
                nb = np.where(chosen[:, :, None], self.links[np.where(chosen, nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
                d = distance(self.sketch[np.maximum(nb, 0)], q[live][:, None])
                state[live] = self._merge(np.concatenate([s, np.where(nb < 0, _NONE, d << 33 | nb << 1 | 1)], 1), beam)
            ok = state < _NONE
            out[at:at + block] = np.where(ok, (state & 0x1FFFFFFFF) >> 1, -1)
            far[at:at + block] = np.where(ok, state >> 33, 1 << 20)
        return out, far

    @staticmethod
    def _merge(state: np.ndarray, beam: int) -> np.ndarray:
        """The ``beam`` least entries of each row, each node once (walked before unwalked)."""
        s = np.sort(state, 1)
        s[:, 1:][s[:, 1:] >> 1 == s[:, :-1] >> 1] = _NONE
        s = np.sort(s, 1)[:, :beam]
        return s if s.shape[1] == beam else np.pad(s, ((0, 0), (0, beam - s.shape[1])), constant_values=_NONE)

    def exhaustive(self, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all nodes at ``most`` bits or fewer."""
        found = []
        step = max(1, (1 << 20) // max(1, self.n))
        for at in range(0, len(sketch), step):
            d = distance(self.sketch[None], sketch[at:at + step, None])
            q, n = np.nonzero(d <= most)
            found.append((q + at, n, d[q, n]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def tune(self, probes: int = 256, alike: float = 0.65, target: float = 0.99) -> tuple[int, float]:
        """(beam, recall) at which queries made from nodes by replacing values, down to ``alike``, find what an exhaustive search finds.

        The beam is doubled until ``target`` is reached; one of more than a quarter of the nodes would cost more than looking at
        all of them: then 0, and recall 1, for an exhaustive search.
        """
        rng = np.random.default_rng(self.n + 1)
        pick = rng.choice(self.n, min(probes, self.n), replace=False)
        bits = np.unpackbits(self.sketch[pick].view(np.uint8), axis=1)
        values = rng.integers(0, 256, bits.shape, np.uint8)
        values = values & 0xFE | bits
        values[:, : TABLES * DEEP] = self.prefixes[pick]
        swap = rng.random(bits.shape) > alike
        values[swap] = rng.integers(0, 256, int(swap.sum()), np.uint8)
        p, s = split(values)
        q, n, d = self.exhaustive(s, 64)
        order = np.lexsort((d, q))
        q, n = q[order], n[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        beam = 16
        while 4 * beam <= self.n:
            some = place < beam
            got, _ = self._walk(p, s, beam)
            reached = np.concatenate([np.isin(n[some & (q == i)], got[i]) for i in range(len(p))])
            if reached.mean() >= target if len(reached) else True:
                return beam, float(reached.mean()) if len(reached) else 1.0
            beam *= 2
        return 0, 1.0

    def near(self, prefixes: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at a distance of ``most`` bits at most.

        A beam that is near to its end is widened for its query until it isn't; where that comes to a quarter of the nodes, all are looked at.
        """
        if self.n <= TINY or self.links is None or not self.beam:
            return self.exhaustive(sketch, most)[:2]
        qs, ns, beam, todo = [], [], self.beam, np.arange(len(sketch))
        while len(todo) and 4 * beam <= self.n:
            nodes, d = self._walk(prefixes[todo], sketch[todo], beam)
            ok = d <= most
            full = ok[:, -1]
            q, c = np.nonzero(ok & ~full[:, None])
            qs.append(todo[q])
            ns.append(nodes[q, c])
            todo, beam = todo[full], beam * 4
        if len(todo):
            q, n, _ = self.exhaustive(sketch[todo], most)
            qs.append(todo[q])
            ns.append(n)
        return np.concatenate(qs) if qs else np.empty(0, np.int64), np.concatenate(ns) if ns else np.empty(0, np.int64)
