"""Language of documents and of the segments of mixed ones (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lengths of the substrings of a blended spectrum, and the number of cells they are hashed to.
SPECTRUM = (1, 2, 3, 4)
CELLS = 1 << 18
_WIDE = "぀-ヿ㐀-鿿豈-﫿"
#: Ends of segments: line ends, and ends of sentences with their closing signs.
_END = r"[\r\n\x0b\x0c\x85  ]+|(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])"
_SPLIT = re.compile(_END)
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”)\]]*$")
_WORDS = re.compile(rf"[{_WIDE}]|[^\W\d_{_WIDE}]+")
_OTHER = re.compile(r"[\W\d_]+")
#: Letters that a sentence has at least: words, a character of a script without spaces being half a word.
LEAST_WORDS = 4.0


def label(c: Column, codes: list[str]) -> Column:
    """The language of ``codes`` that a label names: its code in any case, with or without a region; else null."""
    code = F.regexp_extract(F.lower(c), r"^([a-z]+)(?:[-_].*)?$", 1)
    return F.when(code.isin([x.lower() for x in codes]), code)


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a full sentence) of each segment: lines, cut at the ends of sentences."""
    out, at = [], 0
    for m in [*_SPLIT.finditer(text), None]:
        end, following = (m.start(), m.end()) if m else (len(text), len(text))
        s = text[at:end]
        if t := s.strip():
            a = at + s.index(t[0])
            closed = bool(_SENTENCE.search(t))
            words = _WORDS.findall(t) if closed else []
            size = sum(0.5 if ord(w[0]) > 0x303F and len(w) == 1 else 1.0 for w in words)
            out.append((a, a + len(t), closed and size >= LEAST_WORDS))
        at = following
    return out


def spectrum(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the substrings present in each text, each once: (text, cell), sorted.

    Lower case; all that is no letter is one space, so that neither numbers nor signs count.
    """
    plain = [" " + _OTHER.sub(" ", t.lower()).strip() + " " for t in texts]
    n = np.fromiter(map(len, plain), np.int64, len(plain))
    c = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(plain), dtype=np.int64), n)
    keys, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(SPECTRUM) + 1):
            if len(c) < k:
                break
            h = (h[: len(c) - k + 1] + c[k - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k in SPECTRUM:
                own_k = own[: len(h)]
                inside = own_k == own[k - 1:]
                cell = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int64)
                keys.append((own_k << 18 | cell)[inside])
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> 18, key & (CELLS - 1)


def kernel_rows(own: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by text, each divided by the root of the text's number of cells."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(own):
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(begin, len(own)))
        out[own[begin]] = np.add.reduceat(values, begin, axis=0) / np.sqrt(size)[:, None]
    return out


def fit(sentences: list[str], labels: list[str], codes: list[str], landmarks: int = 480, ridge: float = 1e-2) -> np.ndarray:
    """One-versus-rest kernel ridge regression with Nyström landmarks: the weight of each cell for each language.

    The kernel of two texts is the number of cells present in both, over the root of the product of their numbers.  With
    landmarks L, features are k(x, L) K(L, L)^-1/2; with their ridge solution w, the scores k(x, L) K^-1/2 w are a product of the presence
    of x by a matrix (cell, landmark) by one (landmark, language); the product of these two is what is returned.
    Sentences that the first fit gives to another language than their label are left out of a second.
    """
    y = np.array([codes.index(x) for x in labels])
    own, cell = spectrum(sentences)
    take = np.concatenate([np.flatnonzero(y == c)[: max(1, landmarks // len(codes))] for c in range(len(codes))])
    place = np.full(len(sentences), -1)
    place[take] = np.arange(len(take))
    chosen = place[own] >= 0
    size = np.bincount(own, minlength=len(sentences))
    member = np.zeros((CELLS, len(take)), bool)
    member[cell[chosen], place[own[chosen]]] = True
    k = np.zeros((len(sentences), len(take)), np.float32)
    for at in range(0, len(take), 16):
        k[:, at:at + 16] = kernel_rows(own, len(sentences), member[:, at:at + 16][cell].astype(np.float32))
    k /= np.sqrt(np.maximum(1, size[take]))[None, :]
    lam, u = np.linalg.eigh(k[take].astype(np.float64))
    root = u / np.sqrt(np.maximum(lam, 1e-6))[None, :]
    z = k @ root
    target = np.where(y[:, None] == np.arange(len(codes))[None, :], 1.0, -1.0)
    good = np.ones(len(y), bool)
    for _ in range(2):
        zg = z[good]
        w = np.linalg.solve(zg.T @ zg + ridge * good.sum() / len(codes) * np.eye(z.shape[1]), zg.T @ target[good])
        good = (z @ w).argmax(1) == y
    beta = (root @ w) / np.sqrt(np.maximum(1, size[take]))[:, None]
    out = np.zeros((CELLS, len(codes)), np.float32)
    for at in range(0, CELLS, 1 << 15):
        out[at:at + (1 << 15)] = member[at:at + (1 << 15)].astype(np.float32) @ beta.astype(np.float32)
    return out


def training_sentences(df: DataFrame, key: str, text: str, lang: str, codes: list[str], documents: int, sentences: int) -> list[tuple[str, str]]:
    """A bounded sample: of each language ``documents`` labelled documents by hash of the key, and ``sentences`` sentences of them."""
    named = df.select(key, label(F.col(lang), codes).alias("_l"), F.xxhash64(key).alias("_h")).where("_l is not null")
    chosen = named.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", key))).where(F.col("_r") <= documents)
    texts = df.select(key, F.col(text).alias("_t")).join(F.broadcast(chosen.select(key, "_l").distinct()), key)
    said = texts.select("_l", F.explode(F.split("_t", _END)).alias("_s")).where((F.length("_s") >= 8) & (F.length("_s") <= 400) & F.col("_s").rlike(r"[.!?。！？]$"))
    rows = said.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_s"), "_s"))).where(F.col("_r") <= sentences)
    return sorted(tuple(r) for r in rows.select("_l", "_s").collect())


def scorer(weights, codes: list[str]):
    """Arrow function: (key, text) to (key, segments: start, end, sentence, lang, confidence).

    Confidence is that of a logistic on the lead of the best score over the second; a full sentence with a lead under ``CLOSE``
    takes the language of most other full sentences of its document if that is one of its two best.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.bool_()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, names = weights.value, np.array(codes, dtype=object)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [segments(t) for t in texts]
            doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            parts = [t[s:e] for t, f in zip(texts, found) for s, e, _ in f]
            full = np.array([x for f in found for _, _, x in f], bool)
            score = np.zeros((len(parts), len(codes)), np.float32)
            size = np.cumsum([0, *map(len, parts)])
            at = 0
            while at < len(parts):
                to = max(at + 1, int(np.searchsorted(size, size[at] + 200_000, "right")) - 1)
                own, cell = spectrum(parts[at:to])
                score[at:to] = kernel_rows(own, to - at, w[cell])
                at = to
            order = np.argsort(-score, axis=1, kind="stable")
            best = order[:, 0] if len(parts) else np.empty(0, np.int64)
            lead = np.take_along_axis(score, order[:, :1], 1)[:, 0] - np.take_along_axis(score, order[:, 1:2], 1)[:, 0] if len(parts) else np.empty(0)
            sure = full & (lead >= CLOSE)
            votes = np.zeros((len(texts), len(codes)), np.int64)
            np.add.at(votes, (doc[sure], best[sure]), 1)
            main = votes.argmax(1)
            doubt = full & ~sure
            turn = doubt & (votes[doc].max(1, initial=0) > 0) & (order[:, 1] == main[doc]) if len(parts) else doubt
            best = np.where(turn, main[doc], best) if len(parts) else best
            lead = np.where(turn, 0, lead)
            conf = 1 / (1 + np.exp(-6.0 * lead.astype(np.float64)))
            rows = [{"start": s, "end": e, "sentence": x} for f in found for s, e, x in f]
            for r, l, c in zip(rows, names[best], conf):
                r["lang"], r["confidence"] = l, round(float(c), 4)
            ends = np.cumsum([0, *[len(f) for f in found]]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows, kind.value_type))], names=["_key", "segments"])

    return run


#: Lead of the best score over the second below which a sentence also heeds its document.
CLOSE = 0.25


def languages(df: DataFrame, key: str, text: str, lang: str, codes: list[str], *, documents: int = 400, sentences: int = 1000) -> DataFrame:
    """(key, named, segments): the language a row's label names, if any, and every segment of its whole text.

    Segments: start, end (code points), sentence (a full one), lang, confidence.  The classifier is fitted on at most
    ``sentences`` sentences for each language, of labelled documents whose labels may be wrong; scoring reads all
    texts.  Null, empty and blank texts have no segment; rows with equal keys are scored each.  Without
    labelled sentences of two languages or more there is nothing to learn from: a ValueError, but for tables without any text.
    """
    said = training_sentences(df, key, text, lang, codes, documents, sentences)
    known = [c for c in codes if any(x == c for x, _ in said)]
    if len(known) < 2:
        if df.where(F.length(F.trim(F.col(text))) > 0).take(1):
            raise ValueError(f"labelled sentences of two languages or more are needed, found: {known}")
        weights = np.zeros((CELLS, len(codes)), np.float32)
        known = list(codes)
    else:
        weights = fit([s for _, s in said], [x for x, _ in said], known)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    kind = dict(df.dtypes)[key]
    rows = df.select(F.struct(F.col(key).alias("k"), label(F.col(lang), codes).alias("l")).alias("_key"), F.col(text).alias("_text"))
    scored = rows.mapInArrow(scorer(shared, known), f"_key struct<k:{kind},l:string>, segments array<struct<start:int,end:int,sentence:boolean,lang:string,confidence:double>>")
    return scored.select(F.col("_key.k").alias(key), F.col("_key.l").alias("named"), "segments")


def spoken(scored: DataFrame, key: str, least: float = 0.55) -> DataFrame:
    """(key, named, lang, sentences, confidence): a row for each language with a full sentence of ``least`` confidence or more."""
    one = scored.select(key, "named", F.explode(F.filter("segments", lambda s: s["sentence"] & (s["confidence"] >= least))).alias("s"))
    return one.groupBy(key, "named", F.col("s.lang").alias("lang")).agg(F.count("*").alias("sentences"), F.max("s.confidence").alias("confidence"))
