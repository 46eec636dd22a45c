"""Words, keys and scores (FN-5 to FN-9, FLT-4 to FLT-7, FLT-9, FLT-10).  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.urls import strip

# Names of top-level domains that carry no information as words.
TLDS = ["com", "net", "org", "cn", "co", "uk", "io", "cc", "tv", "me", "xyz", "top", "vip", "shop", "site", "online", "app", "dev", "info", "biz", "us", "jp", "de", "ru", "fr", "au", "in", "hk", "tw", "kr", "sg"]
# Marks of advertisements, within a title and as whole English words.
AD_MARKS = ["博彩", "棋牌", "彩票", "赌博", "开户", "注册送", "真人娱乐", "六合彩", "时时彩", "电竞竞猜", "百家乐", "澳门娱乐", "皇冠", "大发娱乐", "代开发票", "办证", "信用卡套现"]
AD_WORDS = ["bet", "bet365", "casino", "gambling", "porn", "xxx"]
_HAN = "\\u4E00-\\u9FFF\\u3400-\\u4DBF"


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 4 where the lengths differ by more than 3."""
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > 3, 4).otherwise(F.levenshtein(a, b))


def tokens(text: Column) -> Column:
    """ASCII words of two characters or more in lower case, then every Han character, then pairs of neighbours among these."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]{2,}"), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(f"[{_HAN}]"), F.lit(0))
    # the list of characters is bound once, as the only element of a list
    both = F.transform(F.array(han), lambda h: F.concat(h, F.when(F.size(h) > 1, F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)), lambda a, b: F.concat(a, b)))
                                                        .otherwise(F.array().cast("array<string>"))))
    return F.concat(words, F.flatten(both))


def chunk_of(word: Column) -> Column:
    """The block of an index that holds a word: its first character if an ASCII digit or lower-case letter, else ``_``."""
    return F.when(word.rlike("^[0-9a-z]"), F.substring(word, 1, 1)).otherwise("_")


def fold_key(title: Column, domain: Column) -> Column:
    """The key under which like titles are folded: without a final ``- domain`` or domain, else in lower case."""
    t, d = strip(title), strip(domain)
    low, tail = F.lower(t), F.lower(F.concat(F.lit(" - "), d))
    cut = lambda n: strip(F.substr(t, F.lit(1), F.char_length(t) - n))
    return F.when(low.endswith(tail), cut(F.char_length(tail))).when(low.endswith(d), cut(F.char_length(d))).otherwise(low)


def is_tld_token(t: Column) -> Column:
    return (t.rlike(r"^\.[A-Za-z.]*$") & (F.octet_length(t) <= 12)) | t.isin(TLDS)


def is_low_info_token(t: Column) -> Column:
    """Fewer than two bytes, a replacement character, a top-level domain, or a single character of three bytes."""
    return (F.octet_length(t) < 2) | t.contains("�") | is_tld_token(t) | ((F.char_length(t) == 1) & (F.octet_length(t) == 3))


def title_bad(t: Column) -> Column:
    return t.rlike('[<>&="{]')


def is_ad(t: Column) -> Column:
    """A mark of advertisements in a title, or one of their English words as a whole word."""
    low = F.lower(t)
    return low.rlike("|".join(AD_MARKS)) | F.arrays_overlap(F.split(low, "[^0-9a-z]+"), F.array(*[F.lit(w) for w in AD_WORDS]))


def relevance(title: Column, description: Column, domain: Column, keywords: Column, phrase: str, terms: list[str]) -> Column:
    """The additive score of a document: phrase 30 in the title, 20 description, 15 a keyword, 10 domain; each term 8, 4, 2, 2.

    Without phrase hit (a keyword isn't one) and term: 5 if there are no terms, else 0; with some of the terms only, times
    0.3.  Terms are literals, so the score is one expression of native functions.
    """
    t, d, h = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, description, domain))
    ks = F.lower(F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), "\x00"))
    points = lambda c, needle, n: F.when(c.contains(needle), float(n)).otherwise(0.0)
    score, hit, matched = F.lit(0.0), F.lit(False), F.lit(0)
    if phrase:
        score = points(t, phrase, 30) + points(d, phrase, 20) + points(ks, phrase, 15) + points(h, phrase, 10)
        hit = t.contains(phrase) | d.contains(phrase) | h.contains(phrase)
    for term in terms:
        score = score + points(t, term, 8) + points(d, term, 4) + points(h, term, 2) + points(ks, term, 2)
        matched = matched + (t.contains(term) | d.contains(term) | h.contains(term) | ks.contains(term)).cast("int")
    none = ~hit & (matched == 0)
    partial = ~hit & (matched < len(terms)) if terms else F.lit(False)
    return F.when(none, F.lit(0.0 if terms else 5.0)).when(partial, score * 0.3).otherwise(score)
