"""Column functions against the cases that define them."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import hashing, html, packets, text, urls, values


def one(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column.alias("x")).collect()]


@pytest.mark.parametrize("url, want", [
    ("http://A.Example", "http://a.example/"), (" HTTPS://B.example/X?Q#f ", "https://b.example/X?Q"), ("ftp://x", None), ("http://", None), ("http://h:80#f", "http://h:80/"), (None, None), ("", None),
])
def test_normalize(spark, url, want):
    assert one(spark, "u string", [(url,)], urls.normalize_url(F.col("u"))) == [want]


@pytest.mark.parametrize("base, href, want", [
    ("http://a.com/x/y.html", "z.html", "http://a.com/x/z.html"), ("http://a.com/x/y.html", "/r", "http://a.com/r"), ("http://a.com", "x", "http://a.com/x"),
    ("http://a.com/x", "//b.com/p", "http://b.com/p"), ("http://a.com/x", "https://B.com/p#f", "https://b.com/p"), ("http://a.com/x", "#f", None),
    ("http://a.com/x", "javascript:void(0)", None), ("http://a.com/x", "mailto:a@b", None), ("a.com/x", "y", None), ("http://a.com/d/", "../up", "http://a.com/d/../up"),
])
def test_resolve(spark, base, href, want):
    assert one(spark, "b string, h string", [(base, href)], urls.resolve_url(F.col("b"), F.col("h"))) == [want]


def test_paths_and_codes(spark):
    assert one(spark, "u string", [("http://a/b?c",), ("http://a",), ("x",), (None,)], urls.url_path(F.col("u"))) == ["/b?c", "/", "x", None]
    assert one(spark, "u string", [("a b~*/é",)], urls.url_encode(F.col("u"))) == ["a%20b~%2A%2F%C3%A9"]
    assert one(spark, "u string", [("a+b%20c%zz%41",)], urls.url_decode(F.col("u"))) == ["a b c%zzA"]
    assert one(spark, "u string", [("8.8.8.8",), ("[::1]:53",), ("::1",), ("a:5353",)], urls.dns_server(F.col("u"))) == ["8.8.8.8:53", "[::1]:53", "[::1]:53", "a:5353"]
    assert one(spark, "u string", [("http://X.com/",)], urls.seed_domain(F.col("u"))) == ["x.com"]


PAGE = """<html><TITLE>Tea &amp; Cake </TITLE><meta charset=x><META content="no name"><meta name="Description" content=" Hot Tea "><meta name="keywords" content="Tea，cake, İx  pot">
<a class=x href="/a">A</a><a href='b.html'>B</a><script>window.open("http://C.example/Z")</script> text https://d.example/q) <a name=x>no</a></html>"""


def test_html(spark):
    h, b = F.col("h"), F.lit("http://s.example/dir/p")
    assert one(spark, "h string", [(PAGE,), ("<title>x",), (None,), ("",)], html.title(h)) == ["tea &amp; cake", None, None, None]
    assert one(spark, "h string", [(PAGE,), ("<meta name=\"description\">",)], html.meta(h, "description")) == ["hot tea", None]
    assert len(one(spark, "h string", [(PAGE,)], html.keywords(h))[0]) == 4
    found = one(spark, "h string", [(PAGE,)], html.links(h, b))[0]
    assert {"http://s.example/a", "http://s.example/dir/b.html", "http://c.example/z", "https://d.example/q"} <= set(found)
    assert one(spark, "h string", [("a <b>c</b>\n d > e <unclosed",)], html.strip_tags(h)) == ["a c d e"]
    assert one(spark, "h string", [("&amp;lt; &#65;&#x4e2d;&nope; &quot;&#99999999; & x;",)], html.decode_entities(h)) == ['&lt; A中&nope; "&#99999999; & x;']
    assert one(spark, "h string", [("<url><loc> HTTP://A/ </loc></url><loc></loc><loc>b</loc>",)], html.sitemap_locs(h)) == [["http://a/", "b"]]
    assert one(spark, "h string", [('<link rel="icon" href="/f.ico">',)], html.icon_link(h, F.lit("https://a.example/"))) == ["https://a.example/f.ico"]


def fnv(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_hashes(spark):
    texts = ["", "hello", "é漢字", "a" * 300, None]
    assert one(spark, "t string", [(t,) for t in texts], hashing.fnv1a64(F.col("t"))) == [None if t is None else fnv(t) for t in texts]
    for t in ("abc", "hello world", "漢字仮名交じり文"):
        grams = [t[i:i + 4] for i in range(len(t) - 3)] or [t]
        want = sum(1 << b for b in range(64) if sum(1 if fnv(g) % 2**64 >> b & 1 else -1 for g in grams) > 0)
        assert hashing.simhash_of(t) % 2**64 == want
    assert hashing.simhash_of("") == 0 and hashing.simhash_of(None) is None
    assert one(spark, "d string, t string", [("a.com", "x a.com - y-z  w"), ("", " a ")], hashing.fingerprint_text(F.col("d"), F.col("t"))) == ["x y z w", "a"]


def test_words(spark):
    assert one(spark, "t string", [("Ab c 12 中x文字",), ("",), (None,)], text.tokens(F.col("t"))) == [["ab", "12", "中", "文", "字", "中文", "文字"], [], None]
    assert one(spark, "a string, b string", [("kitten", "sitting"), ("a", "abcdef"), ("", "")], text.edit_distance(F.col("a"), F.col("b"))) == [3, 4, 0]
    folds = [("Smart Home - k.eu", "k.eu"), ("Smart Home K.EU", "k.eu"), ("Plain Title", "k.eu"), (" X ", "")]
    assert one(spark, "t string, d string", folds, text.fold_key(F.col("t"), F.col("d"))) == ["Smart Home", "Smart Home", "plain title", "X"]
    assert one(spark, "t string", [("better alphabet",), ("Best BET now",), ("本站博彩",), ("",)], text.is_ad(F.col("t"))) == [False, True, True, False]


def test_relevance(spark):
    row = [("Tea pot - a.com", "fine tea", "a.com", ["tea", "pot"])]
    score = lambda p, ts: one(spark, "t string, d string, h string, k array<string>", row, text.relevance(F.col("t"), F.col("d"), F.col("h"), F.col("k"), p, ts))[0]
    assert score("tea", ["tea"]) == 30 + 20 + 15 + 8 + 4 + 2
    assert score("tea kettle", ["tea", "kettle"]) == pytest.approx(14 * 0.3)
    assert score("zzz", ["zzz"]) == 0 and score("zzz", []) == 5


def test_packets(spark):
    whole = "BEEF8180000100010000000003616263036E65740000010001C00C000100010000003C000401020304"
    got = one(spark, "p string", [(whole,), ("00018583000100000000000001610000010001",), ("0001",), (None,), (whole[:-4],)], packets.parse_response(F.unhex("p")))
    assert [None if r["rcode"] is None else tuple(r) for r in got] == [(0, 1, False), (3, 0, False), None, None, None]
    built = one(spark, "f string", [("a.bc",)], packets.build_query(F.col("f"), F.lit(1), F.lit(7)))[0]
    assert bytes(built).hex() == "0007010000010000000000000161026263000001" + "0001"


def test_values(spark):
    assert one(spark, "v string", [("on",), ("No",), ("",), ("x",), (None,)], values.parse_bool(F.col("v"))) == [True, False, False, None, None]
    assert one(spark, "v string", [('{"a": {"b": 3}}',), ("{",), (None,)], values.json_count(F.col("v"), "$.a.b")) == [3, None, None]
