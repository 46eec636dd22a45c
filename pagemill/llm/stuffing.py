"""Keyword-stuffed pages and lists of links, tags or places (problem 5)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Scripts written without spaces: each character is a word.
_WIDE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Scripts with sentence words of their own; all others count as one.
SCRIPTS = ("Latin", "Han", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Hiragana", "Katakana")
_JAVA_WIDE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WORD = re.compile(rf"[{_WIDE}]|[^\W\d_{_WIDE}]+(?:['’][^\W\d_{_WIDE}]+)*|\d+")
_PAIR = re.compile(rf"(?=([{_WIDE}]{{2}}))")
# Each pattern starts at a bound of its own or ends at the next candidate, so no text makes it quadratic.
_MARKED = re.compile(r"<a\s[^<>]*>[^<]*</a\s*>|\[[^\[\]\n]*\]\([^()\s]*\)", re.I)
_LABEL = re.compile(r"(?:^|(?<=[\n|,;·•]))[^\n|,;·•]*>>")
_DOT = re.compile(r"\.[^\W\d_]|://|\]\(|<a\s", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.-])(?:[\w-]+\.)+(?:[a-z]{2,})(?:/\S*)?", re.I)
_TAG = re.compile(r"(?<!\S)[#+@][^\s,;|·•]+")
_PARTS = re.compile(r"[\n\r]+|(?<=[.!?…])\s+|(?<=[。！？])|(?<!\s)\s+[|·•–—-]\s+|[|·•;]")
_ITEMS = re.compile(r"[\n\r,，、;；|·•/\[\]]+|\s[-–—>+]+\s")
_JOINED = re.compile(r"(?<![^\W_])[^\W_]+(?:[_-][^\W_]+)+")
_KEY = re.compile(r"[\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentence_words(df: DataFrame, text: str, keywords: str, share: float = 0.002, most: int = 4000) -> DataFrame:
    """Words (and pairs of characters of scripts without spaces) that carry sentences: (word, n).

    Counted over every line of 8 or more words of every row, once a row, where at most a third of the words repeat.  Each script has a measure of
    its own, as a rare one has a small share of all rows: words in at least ``share`` of the rows or a hundredth of the rows of
    the script's commonest word, whichever is less, and in 5 rows; the ``most`` most frequent of a script at most; at least 20 times as frequent there as in
    the keyword lists.  Languages too rare for that within their script are left to ``formed``.
    """
    token = rf"([{_JAVA_WIDE}](?=([{_JAVA_WIDE}]?))|[\p{{L}}&&[^{_JAVA_WIDE}]]+)"


    def tokens(c):
        return F.zip_with(F.regexp_extract_all(c, F.lit(token), F.lit(1)), F.regexp_extract_all(c, F.lit(token), F.lit(2)), lambda a, b: F.concat(a, b))

    lines = df.select(F.explode(F.array_distinct(F.flatten(F.filter(F.transform(
        F.split(F.lower(F.col(text)), r"[\n\r]+|(?<=[.!?])\s+|(?<=[。！？])|[|;·•]"), tokens),
        lambda w: (F.size(w) >= 8) & (F.size(F.array_distinct(w)) * 3 >= F.size(w) * 2))))).alias("word"))
    said = lines.groupBy("word").agg(F.count("*").alias("n"))
    listed = df.select(F.explode(F.array_distinct(tokens(F.lower(F.array_join(F.col(keywords), " "))))).alias("word")).groupBy("word").agg(F.count("*").alias("m"))
    rows = df.where(F.length(text) > 0).count()
    script = F.coalesce(*[F.when(F.col("word").rlike(rf"^\p{{Is{x}}}"), F.lit(x)) for x in SCRIPTS], F.lit("other"))
    said = said.where("n >= 5").withColumn("script", script)
    top = said.groupBy("script").agg(F.max("n").alias("top"))
    often = said.join(F.broadcast(top), "script").where(F.col("n") >= F.least(F.lit(share * rows), F.col("top") / 100))
    common = often.withColumn("r", F.row_number().over(Window.partitionBy("script").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    return common.join(listed, "word", "left").where(F.col("n") >= 20 * F.coalesce("m", F.lit(0))).select("word", "n")


def formed(part: str) -> bool:
    """Whether a part has the form of a sentence, whatever its language: 6 words or more and an end mark, few words said again or
    capital within, some of them short, and few separators."""
    if part[-1:] not in ".!?…。！？":
        return False
    ws = _WORD.findall(part)
    n = len(ws)
    if n < 6:
        return False
    some = {w.lower() for w in ws}
    capital = sum(w[:1].isupper() or w.isdigit() for w in ws[1:])
    return 10 * len(some) >= 8 * n and 2 * capital < n and 6 * sum(len(w) <= 3 for w in some) >= n and 5 * sum(map(part.count, ",、，/|;:")) <= n


def shape(part: str, carriers: set[str]) -> tuple[str, int]:
    """The shape of a part of a text, and its weight in words.

    ``S`` stands for a sentence: at least 5 words, at least a fifth and two of them carriers, and few said again.
    Others are named by what they hold: ``T`` tags, ``C`` a capital first, ``W`` words (with their number up to 9),
    ``J`` most of them joined by signs.
    """
    tags = _TAG.findall(part) if "#" in part or "+" in part or "@" in part else []
    if tags:
        part = _TAG.sub(" ", part)
    ws = words(part)
    n = len(ws)
    if not n:
        return ("T" if tags else "", 2 * len(tags))
    others = [w for w in ws if w not in carriers]
    carried = n - len(others)
    if n - carried >= 5 and len(wide := _PAIR.findall(part)) > carried:
        carried += sum(w in carriers for w in wide)
    again = len(others) - len(set(others))
    if n >= 5 and carried >= 2 and 5 * carried >= n and not (again >= 3 and 2 * again >= len(others)):
        return "S", n + 2 * len(tags)
    joined = 2 * len(_JOINED.findall(part)) >= n
    return f"{'T' if tags else ''}{'C' if part[:1].isupper() else ''}W{min(n, 9)}{'J' if joined else ''}", n + 2 * len(tags)


def describe(text: str, carriers: set[str]) -> dict[str, float]:
    """Words in sentences and in other parts, number of links; of the other parts, the share of words said again, items, tags, and the share of
    the three commonest shapes (links are a shape too)."""
    links = 0
    if _DOT.search(text):
        if "](" in text or "<" in text:
            text, links = _MARKED.subn("\n", text)
        text, more = _URL.subn("\n", text)
        links += more
        if ">>" in text:
            text = _LABEL.sub("\n", text)
    shapes: Counter[str] = Counter({"L": 4 * links}) if links else Counter()
    rest: list[str] = []
    said = other = 0
    parts = [p for p in _PARTS.split(text) if p]
    shaped = [shape(p, carriers) for p in parts]
    if any(s != "S" and formed(p) for p, (s, _) in zip(parts, shaped)):
        ws = words(text)
        # too few words that carry sentences for one of the languages that were learned: the form decides
        if 5 * sum(w in carriers for w in ws) < len(ws):
            shaped = [("S", w) if formed(p) else (s, w) for p, (s, w) in zip(parts, shaped)]
    for part, (s, w) in zip(parts, shaped):
        if s == "S":
            said += w
        elif w:
            other += w
            shapes[s] += w
            rest.append(part)
    d = {"said": said, "other": other, "links": links}
    if other <= said:
        return d
    tail = " ".join(rest)
    items = [x for x in (_KEY.sub("", i.lower()) for i in _ITEMS.split(tail)) if x]
    ws = words(tail)
    twice = [n for n in Counter(ws).values() if n > 1]
    return d | {"again": (sum(twice) / len(ws)) if ws else 0.0, "items": len(items),
            "tags": len(_TAG.findall(tail)) + len(_JOINED.findall(tail)), "few": (sum(n for _, n in shapes.most_common(3)) / (other + shapes["L"])) if other else 0.0}


def stuffed_text(text: str | None, carriers: set[str]) -> bool:
    """Whether the larger part of a text is repetition, variation of a phrase, links or tags."""
    if not text or not text.strip():
        return False
    d = describe(text, carriers)
    if d["links"] >= 3 and 4 * d["links"] + d["other"] > d["said"]:
        return True
    if d["other"] <= d["said"] or d["other"] < 8:
        return False
    return d["few"] >= 0.5 and (d["again"] >= 0.4 or d["tags"] >= 4 or d["items"] >= 6 or d["other"] >= 20)


def head(keyword: str, width: float = 14) -> str:
    """The start of a keyword, where only letters and digits count; a wide character is as long as 3.5 others."""
    s, w = _KEY.sub("", keyword.lower()), 0.0
    for i, c in enumerate(s):
        w += 3.5 if ord(c) > 0x2E80 else 1
        if w >= width:
            return s[: i + 1]
    return s


def marks(keyword: str, bare: str) -> set[str]:
    """What a keyword can share with its variations, wherever it stands: words, pairs of wide characters, its start where words are joined."""
    found = {w for w in words(keyword) if len(w) > 2}
    if bare.isascii():
        found.add("^" + bare[:14])
    else:
        found.update(_PAIR.findall(keyword))
        found.add("^" + head(keyword))
    return found


def families(marked: list[set[str]], most: int) -> float:
    """The share of keywords that ``most`` marks cover at most, the commonest among those left first; each is in two keywords or more."""
    left, n = marked, len(marked)
    for _ in range(most):
        counts = Counter(m for ms in left for m in ms)
        best, times = max(counts.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if times < 2:
            break
        left = [ms for ms in left if best not in ms]
    return 1 - len(left) / n


def stuffed_keywords(keywords) -> bool:
    """Whether a list of six or more is links or tags for the most part, a phrase for each six or more with changing words, or said twice on average."""
    if keywords is None:
        return False
    kept = [(k, bare) for k in keywords if k and (bare := _KEY.sub("", k.lower()))]
    n = len(kept)
    if n < 6:
        return False
    if 2 * sum(1 for k, _ in kept if _TAG.match(k) or _URL.match(k)) > n:
        return True
    bares = [bare for _, bare in kept]
    kinds = len(set(bares))
    if n >= 2 * kinds:  # said twice on average
        return True
    marked = [marks(k, bare) for k, bare in kept]
    # no choice covers more than the commonest together: most lists are settled by that
    if sum(times for _, times in Counter(m for ms in marked for m in ms).most_common(n // 6)) < 0.9 * n:
        return False
    return families(marked, n // 6) >= 0.9


def stuffed_pages(df: DataFrame, key: str, text: str, keywords: str) -> DataFrame:
    """``df``'s keys with (stuffed_text, stuffed_keywords).

    Every part of a whole text, split at line ends, sentence ends and separators, is reduced to a shape of its count of
    words, links, tags and joined words; a text is stuffed where parts that are no sentences outweigh the sentences, fall into
    few shapes and repeat or enumerate.  What makes a sentence is learned from all rows (``sentence_words``).  Null and
    empty texts, null lists and null keywords in lists aren't stuffed; rows with equal keys are judged each.
    """
    carriers = frozenset(r[0] for r in sentence_words(df, text, keywords).collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_k": b["_k"], "stuffed_text": [stuffed_text(t, carriers) for t in b["_t"]], "stuffed_keywords": [stuffed_keywords(k) for k in b["_w"]]})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(keywords).alias("_w"))
    return rows.mapInPandas(run, f"_k {kind}, stuffed_text boolean, stuffed_keywords boolean").withColumnRenamed("_k", key)
