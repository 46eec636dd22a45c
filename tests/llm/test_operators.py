"""Operators for training data beside brute force, with dirty rows, ties, empty tables and columns of clashing names."""

import random
import string
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bands, cap, encode, forest, format_dups, heavy_hitters, history, language, pack, smallworld, stuffing
from pagemill.llm import queries as Q
from pagemill.plans import skew
from tests.compare import compare, oracle

RNG = random.Random(5)
VOCABULARY = encode.VOCABULARY
DATA = "/root/testdata/sf0.001"


def word(n=7):
    return "".join(RNG.choice(string.ascii_lowercase) for _ in range(n))


# ------------------------------------------------------------------------------------------------------------ problem 1
def test_sketch_never_under_and_finds_the_heavy():
    s, truth = heavy_hitters.Sketch(1 << 10, 4, 64), Counter()
    import pyarrow as pa

    for _ in range(20):
        batch = Counter(RNG.choice(["hot", "warm"]) if RNG.random() < 0.4 else word(5) for _ in range(2000))
        truth += batch
        values = list(batch)
        s.add(pa.array(values), np.array([hash(v) & (2**64 - 1) for v in values], np.uint64), np.array([batch[v] for v in values]))
    assert all(s.best[v] >= truth[v] for v in ("hot", "warm")) and s.best["hot"] <= truth["hot"] * 1.1
    assert len(s.best) <= 2 * 64 and s.total == sum(truth.values())


def test_heavy_hitters(spark):
    rows = [(i, "a") for i in range(300)] + [(i, "a") for i in range(100)] + [(1000 + i, word()) for i in range(690)] + [(5000 + i, "tie") for i in range(10)] + [(None, "n"), (None, "n"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "k long, value string").withColumn("n", F.lit(1)).withColumn("v", F.lit("x")).withColumn("h", F.lit(0))
    got = {r["value"]: (r["approx_count"], r["total"]) for r in heavy_hitters.heavy_hitters(df, "value", key="k", support=0.01).collect()}
    assert got == {"a": (300, 1002)}
    assert heavy_hitters.heavy_hitters(df.limit(0), "value", key="k").count() == 0
    with pytest.raises(ValueError):
        heavy_hitters.heavy_hitters(df, "value", support=0.001, heap=100)
    blank = spark.createDataFrame([("　  A\u0085\n",)], "q string").select(heavy_hitters.clean_query(F.col("q"))).first()[0]
    assert blank == "a"


# ------------------------------------------------------------------------------------------------------------ problem 2
def test_format_duplicates(spark):
    rows = [(5, "http://A.example/x?b=2&a=1"), (2, "HTTP://a.example/x?a=1&b=2"), (9, "http://a.example/x?a=1&b=2"), (9, "http://a.example/x?a=1&b=2"), (1, "http://a.example/x?a=1"), (3, None), (4, "?a"), (6, ""), (7, "http://a.example/x?&a=1&"), (8, "http://a.example/y" + "z" * 40000)]
    df = spark.createDataFrame(rows, "first_id long, url string").withColumn("copies", F.lit(1))
    got = {tuple(r) for r in format_dups.format_duplicates(df, "first_id", "url", format_dups.url_fields).collect()}
    assert got == {(2, 5, 4), (2, 9, 4), (1, 7, 2)}
    asks = [(1, "Site:A.example tea  Pot"), (2, "tea-pot site:a.EXAMPLE"), (3, "pot tea site:a.example"), (4, "teapot site:"), (5, "teapot"), (6, "- !"), (7, "lang:de"), (8, "LANG:DE ."), (9, "teasite pot:aexample")]
    got = {tuple(r)[:2] for r in format_dups.format_duplicates(spark.createDataFrame(asks, "i long, q string"), "i", "q", format_dups.query_fields).collect()}
    assert got == {(1, 2), (4, 5), (7, 8)}
    assert format_dups.format_duplicates(df.limit(0), "first_id", "url", format_dups.url_fields).count() == 0


# ------------------------------------------------------------------------------------------------------------ problem 3
def clean(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())


def greedy(rows):
    """The sequential rule, pair by pair."""
    accepted, out = [], {}
    for _, i, url, title in sorted((b, i, u, t) for i, b, u, t in rows):
        k, t = (url or "").lower().replace("/", "").replace(":", "").replace(".", "") or None, clean(title or "")
        hits = [a for a, ak, at in accepted if (k and k == ak) or (min(len(t), len(at)) >= 20 and forest.similarity(t, at) >= 0.6)]
        if hits:
            out[i] = min(hits)
        else:
            accepted.append((i, k, t))
    return out


def stream(n=260):
    titles = [" ".join(word(6) for _ in range(6)) for _ in range(40)]
    rows = []
    for i in range(n):
        t = RNG.choice(titles)
        if RNG.random() < 0.7:
            ws = t.split()
            ws[RNG.randrange(6)] = word(6)
            t = " ".join(ws)
        rows.append((i, i // 60, f"http://h.example/{RNG.randrange(200)}" if RNG.random() < 0.8 else None, RNG.choice([t, t, t, t.upper(), "home", "", None])))
    return rows


@pytest.mark.parametrize("one_by_one", [False, True])
def test_history(spark, one_by_one):
    rows = stream()
    df = spark.createDataFrame(rows, "id long, b int, url string, t string").withColumn("u", F.lit(1)).withColumn("tid", F.lit(2))
    if one_by_one:
        h = history.History(spark, segment=16, fanout=2, few=2)
        path, got = h.path, {}
        for b in range(3):
            got |= {r["id"]: r["first_id"] for r in h.add(df.where(F.col("b") == b), "id", "url", "t").collect()}
            h = history.History.open(spark.newSession(), path)  # a new session, which knows nothing but the path
        assert any(s.level for s in h.shards) and any(s.routed for s in h.shards) and len(h.urls["parts"]) == 3
        rows = [r for r in rows if r[1] < 3]
    else:
        got = {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", together=100).collect()}
    assert got == greedy(rows)


def test_history_chains_and_crowds(spark):
    """A chain of edits in which each title is near to the next ones only, and a crowd of which each is near to all, with addresses across."""
    ws = [word(6) for _ in range(320)]
    rows = [(i, 0, f"http://c.example/{i % 97}" if i % 5 == 0 else None, " ".join(ws[i:i + 8])) for i in range(300)]
    stem = " ".join(word(8) for _ in range(8))
    rows += [(1000 + i, 0, f"http://c.example/{i}" if i % 3 else None, f"{stem} {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, b int, url string, t string")
    got = {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", segment=256, few=1).collect()}
    assert got == greedy(rows)


@pytest.fixture
def same_draws():
    """Leaves the numbers that later tests draw as they are."""
    state = RNG.getstate()
    yield
    RNG.setstate(state)


def test_history_searches_once(spark, monkeypatch, same_draws):
    """A batch is searched in itself once, and in the history once: the pairs found tell all that is asked later."""
    calls, search = [], history.History._search
    monkeypatch.setattr(history.History, "_search", lambda self, *args, **more: calls.append(args[1]) or search(self, *args, **more))
    rows = stream(120)
    df = spark.createDataFrame(rows, "id long, b int, url string, t string")
    got = {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", together=50).collect()}
    assert got == greedy(rows) and sum(n > 10 for n in calls) <= 3


@pytest.mark.parametrize("even", [-1, 8192])
def test_history_looks_for_crowds_only(spark, monkeypatch, same_draws, even):
    """Where no address, title or id is in more rows than a task takes, hot keys aren't broadcast; the result is the same."""
    plans, look = [], history.lookup
    monkeypatch.setattr(skew, "EVEN", even, raising=False)
    monkeypatch.setattr(history, "lookup", lambda *args, **more: plans.append(look(*args, **more)) or plans[-1])
    rows = stream(120)
    df = spark.createDataFrame(rows, "id long, b int, url string, t string")
    got = {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", together=50).collect()}
    assert got == greedy(rows)
    assert {"strategy=broadcast" in p._jdf.queryExecution().analyzed().toString() for p in plans} == {even < 0}


def test_similar_titles_meet(same_draws):
    """Keys by which titles meet cost the same for each title, however many share a gram, and lead to few others."""
    texts = [f"{RNG.randrange(10, 99)} ways to {word(7)} {word(8)} {word(6)} by {word(9)}" for _ in range(1500)]
    batch = pa.record_batch([pa.array([True] * 1500), pa.array(range(1500), pa.int64()), pa.array(texts)], names=["asked", "id", "title"])
    entries = list(bands.spread(iter([batch])))
    assert sum(len(x) for b in entries for x in b.column("entries").to_pylist()) == 1500 * bands.BANDS * bands._ENTRY.itemsize
    met = {(a, b) for r in bands.meet(0.6, 32)(iter(entries)) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
    near = {(a, b) for a in range(0, 1500, 10) for b in range(a) if forest.similarity(texts[a], texts[b]) >= 0.6}
    assert near <= met and len(met) < 1500


def test_history_of_any_size(spark):
    """What is near is found in a small history and in one of many segments: pairs that share none of their six least gram hashes too."""
    rng, pairs = random.Random(5), []
    while len(pairs) < 6:
        texts = []
        for _ in range(2000):
            t = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(9)]
            e = list(t)
            e[rng.randrange(9)] = e[rng.randrange(9)] = "xyxyxy"
            texts += [" ".join(t), " ".join(e)]
        cells = smallworld.sketches(texts, 6)[2]
        pairs += [(a, b) for a, b, x, y in zip(texts[::2], texts[1::2], cells[::2], cells[1::2]) if forest.similarity(a, b) >= 0.6 and not set(x.tolist()) & set(y.tolist())]
    pairs = pairs[:6]
    rows = [(i, 0, None, t) for i, t in enumerate([*(a for a, _ in pairs), *texts[:600:2]])] + [(1000 + i, 1, None, b) for i, (_, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, b int, url string, t string")
    for options in ({}, {"segment": 16, "few": 1}):
        found = {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", together=1, **options).collect()}
        assert {i: found.get(1000 + i) for i in range(6)} == {i: i for i in range(6)}


def test_history_of_short_titles(spark):
    """Equal titles of one or two characters repeat each other, in one addition and in several; how many rows are added together tells nothing."""
    rows = [(1, 0, None, "ab"), (2, 0, None, "cd"), (3, 0, None, "AB"), (4, 0, None, ""), (5, 1, None, "ab!"), (6, 1, None, "x"), (7, 1, None, "-"), (8, 1, None, "abc")]
    df = spark.createDataFrame(rows, "id long, b int, url string, t string")
    for together in (1, 100):
        assert {r["id"]: r["first_id"] for r in history.repeats(df, "b", "id", "url", "t", together=together, least=0).collect()} == {3: 1, 5: 1}


def test_routing_recall():
    """Titles at the threshold share a cell: what routing loses against searching every segment."""
    lost = n = 0
    for _ in range(3000):
        t = [word(6) for _ in range(9)]
        e = list(t)
        for _ in range(RNG.randrange(1, 4)):
            e[RNG.randrange(9)] = word(6)
        a, b = " ".join(t), " ".join(e)
        if 0.6 <= forest.similarity(a, b) <= 0.75:
            x, y = smallworld.sketches([a, b], 6)[2]
            n, lost = n + 1, lost + (not set(x) & set(y))
    print(f"routing: {n - lost} of {n} pairs share a cell")
    assert n > 500 and lost <= 0.005 * n


def test_exact_similarities():
    texts = [" ".join(word(4) for _ in range(RNG.randrange(1, 9))) for _ in range(60)] + ["", "ab", "漢字かな漢字かな"]
    for t in texts:
        nodes = np.array(RNG.sample(range(len(texts)), 9))
        assert np.allclose(forest.Exact(texts).similarities(t, nodes), [forest.similarity(t, texts[i]) for i in nodes])


def test_history_empty(spark):
    df = spark.createDataFrame([], "id long, b int, url string, t string")
    assert history.repeats(df, "b", "id", "url", "t").count() == 0
    none = spark.createDataFrame([(1, None, None, None), (2, 0, "?", "short"), (None, 0, "http://a.example", "x" * 30)], df.schema)
    assert history.repeats(none, "b", "id", "url", "t").count() == 0


def test_small_world_recall():
    """Recall of the graph's beams against exhaustive search, at sizes where it isn't exhaustive itself."""
    base = [" ".join(word(6) for _ in range(7)) for _ in range(3000)]
    asked = []
    for t in base[:400]:
        ws = t.split()
        ws[RNG.randrange(7)] = word(6)
        asked.append(" ".join(ws))
    g = smallworld.Segment(*smallworld.sketches(base))
    assert g.links is not None and g.beam >= 16
    p, s = smallworld.sketches(asked)
    q, n = g.near(p, s, 85)
    got = set(zip(q.tolist(), n.tolist()))
    truth = set(zip(*(x.tolist() for x in g.exhaustive(s, 85)[:2])))
    assert g.recall >= 0.99
    assert got <= truth and len(got) >= 0.97 * len(truth) and sum((i, i) in got for i in range(400)) >= 0.98 * sum((i, i) in truth for i in range(400))


# ------------------------------------------------------------------------------------------------------------ problem 4
def test_cap(spark):
    rows = [(i, RNG.choice(["x", "x", "x", "y", None]), RNG.choice([1.0, 2.0, 2.0, None, float("nan"), -1.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, s double").withColumn("kept", F.lit(1)).withColumn("_k", F.lit(1))
    key = lambda r: (0, 0, r[0]) if r[2] is not None and r[2] == r[2] else (1, 0, r[0])
    for n in (20, 0, 1000):
        gone = set()
        for c in "xy":
            mine = sorted([r for r in rows if r[1] == c], key=lambda r: (key(r)[0], -r[2] if key(r)[0] == 0 else 0, r[0]))
            gone |= {r[0] for r in mine[n:]}
        assert {r["id"] for r in cap.cap_contributors(df, "id", "c", "s", n).where("not kept").collect()} == gone
    some = cap.cap_contributors(df, "id", "c", "s", 20, temperature=1.0)
    assert {r["c"]: r["n"] for r in some.where("kept and c is not null").groupBy("c").agg(F.count("*").alias("n")).collect()} == {"x": 20, "y": 20}
    assert cap.cap_contributors(df.limit(0), "id", "c", "s", 5).count() == 0 and cap.cap_contributors(df.limit(0), "id", "c", "s", share=0.1).count() == 0
    kept = lambda **o: {r["c"]: r["n"] for r in cap.cap_contributors(df, "id", "c", "s", **o).where("kept and c is not null").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert kept(share=0.051) == {"x": 15, "y": 15} and kept(cap=12, share=0.051) == {"x": 12, "y": 12}
    with pytest.raises(ValueError):
        cap.cap_contributors(df, "id", "c", "s")
    d = spark.createDataFrame([(" A.Example. 　",), (" .",), (None,)], "d string").select(cap.clean_domain(F.col("d"))).collect()
    assert [r[0] for r in d] == ["a.example", None, None]


def test_weighted_sample_prefers_weight(spark):
    df = spark.range(20000).select("id", F.lit("c").alias("c"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("s"))
    kept = cap.cap_contributors(df, "id", "c", "s", 2000, temperature=1.0).where("kept")
    even = kept.where("id % 2 = 0").count()
    assert kept.count() == 2000 and 1400 < even < 1560  # 3 : 1, less what is drawn without replacement


# ------------------------------------------------------------------------------------------------------------ problem 5
CARRIERS = frozenset("the a of in is and was with for to has about der die und ist in von sur le la de".split())


def test_stuffed():
    f = lambda t: stuffing.stuffed_text(t, CARRIERS)
    assert f("red tea pot, red tea pot, cheap red tea pot, red tea pot shop, red tea pot, red tea pot")
    assert f("http://a.example/x | www.b.example | c.example | [d](http://d.example)")
    assert f("#tea_pot #red_pot #big_pot #old_pot #new_pot #tin_pot #hot_pot")
    assert not f("The owner of the shop is known for a good list of pots. The tea in it was made with care and has a name.")
    assert not f("The owner of the shop is known for pots, see https://a.example/x for the list of them.")
    assert not f(None) and not f("") and not f("   ") and not f("short title")
    assert f("tea pot " * 20000) and not stuffing.stuffed_keywords(None) and not stuffing.stuffed_keywords([])
    assert not stuffing.stuffed_keywords(["a", None, "", "b", "a"]) and stuffing.stuffed_keywords(["red pot", "tin pot", "old pot"] * 3)
    assert stuffing.stuffed_keywords([f"waterproof teapot {word()}" for _ in range(40)]) and not stuffing.stuffed_keywords([word() for _ in range(60)])


def test_stuffed_keywords_whole():
    """Variations of a phrase are told wherever the changing word stands and however long the list; links and tags as such."""
    for n in (6, 12, 20, 60):
        assert stuffing.stuffed_keywords([f"{word()} linen sofa" for _ in range(n)])
        assert stuffing.stuffed_keywords([f"sofa {word()}" for _ in range(n)])
        assert stuffing.stuffed_keywords([f"#{word()}" for _ in range(n)]) and stuffing.stuffed_keywords([f"http://{word()}.example" for _ in range(n)])
        assert not stuffing.stuffed_keywords([f"{word()} {word()}" for _ in range(n)])
    assert stuffing.stuffed_keywords([f"{word()} 海滨枕头" for _ in range(8)])
    assert stuffing.stuffed_keywords(["shoes"] * 10 + ["boots"] * 3) and stuffing.stuffed_keywords([f"cheap shoes {c}" for c in string.ascii_lowercase])
    assert stuffing.stuffed_keywords([f"{word()} {word()}" for _ in range(6)] * 3 + ["tea pot"])
    assert not stuffing.stuffed_keywords(["linen sofa", "cheap sofa", "red lamp", "old chair", "tea pot", "tin roof", "oak desk"])
    assert not stuffing.stuffed_keywords(["cours de musique", "sauvegarde de données", "sauvegarde de données", "animaux de compagnie", "moteurs de recherche", "animaux de compagnie"])


RARE = ["Il negozio della nonna vende tessuti di lino e di lana da molti anni. La consegna arriva in pochi giorni e il personale risponde volentieri alle domande. Chi ha bisogno di un consiglio può passare al mattino.",
        "Nasz sklep od wielu lat sprzedaje tkaniny z lnu i z wełny. Dostawa trwa kilka dni, a obsługa chętnie odpowiada na pytania. Kto potrzebuje porady, może przyjść rano do naszego sklepu.",
        "Магазин много лет продаёт ткани из льна и шерсти. Доставка идёт пару дней, и мы рады любым вопросам о ней. Кто хочет совет, тот может зайти к нам утром."]


def test_languages_too_rare_to_learn_are_ordinary(spark):
    rows = [(i, sentence("en") + " " + sentence("de"), ["tea"]) for i in range(200)] + [(1000 + i, t, ["lino"]) for i, t in enumerate(RARE)]
    rows += [(2000, ", ".join(["tessuti di lino", "tessuti di lana", "tessuti di seta"] * 6), None)]
    df = spark.createDataFrame(rows, "k long, d string, w array<string>")
    assert {r["k"] for r in stuffing.stuffed_pages(df, "k", "d", "w").where("stuffed_text").collect()} == {2000}


def test_stuffed_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", []), (2, "x" * 100_000, [None])], "k long, d string, w array<string>").withColumn("_k", F.lit(0)).withColumn("stuffed_text", F.lit(0))
    got = stuffing.stuffed_pages(df, "k", "d", "w").collect()
    assert len(got) == 3 and not any(r["stuffed_text"] or r["stuffed_keywords"] for r in got)
    assert stuffing.stuffed_pages(df.limit(0), "k", "d", "w").count() == 0


# ------------------------------------------------------------------------------------------------------------ problem 6
@pytest.mark.parametrize("hot", [4096, 32])
def test_forest(spark, hot):
    texts = []
    for i in range(150):
        t = " ".join(word() for _ in range(20))
        texts.append(t)
        for _ in range(RNG.randrange(3)):
            ws = t.split()
            for _ in range(RNG.randrange(1, 5)):
                ws[RNG.randrange(20)] = word()
            texts.append(RNG.choice([" ".join(ws), t, t.upper() + "!"]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (9003, "short"), (9004, "z" * 5000), (9005, "z" * 5000)]
    df = spark.createDataFrame(rows, "a long, t string").withColumn("_id", F.lit(1)).withColumn("b", F.lit(1))
    pairs, copies = forest.near_duplicates(df, "a", forest.clean(F.col("t")), threshold=0.7, least=80, hot=hot)
    got = {tuple(r) for r in forest.all_pairs(pairs, copies).collect()}
    c = [(i, clean(t)) for i, t in rows if t and len(clean(t)) >= 80]
    like = {(i, j): forest.similarity(x, y) for n, (i, x) in enumerate(c) for j, y in c[n + 1:]}
    want, clear = ({p for p, s in like.items() if s >= least} for least in (0.7, 0.76))
    # the forest's own promise: 0.95 of pairs right at the threshold, 0.99 a little above
    assert got <= want and len(want - got) <= 0.05 * len(want) and len(clear - got) <= 0.01 * len(clear) and (9004, 9005) in got
    groups = {r["_id"]: (r["group"], r["size"]) for r in forest.groups(pairs, copies).collect()}
    assert groups[9005] == (9004, 2) and all(groups[i][0] == groups[j][0] for i, j in got)
    none = forest.near_duplicates(df.limit(0), "a", forest.clean(F.col("t")), threshold=0.7, least=80)
    assert forest.all_pairs(*none).count() == 0 and forest.groups(*none).count() == 0


def test_forest_finds_texts_of_few_grams(spark):
    """Texts of 80 characters or more that say a few words again and again: their grams are too few for bins."""
    texts, alphabet = [], string.ascii_lowercase + string.digits
    for _ in range(250):
        cycle = RNG.sample(alphabet, RNG.randrange(5, 30))
        for t in (cycle, cycle[: len(cycle) // 2] + cycle[len(cycle) // 2 + 1:] if len(cycle) < 20 else [*cycle[:9], "é", *cycle[10:]]):
            texts.append("".join(t) * 60)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    pairs, copies = forest.near_duplicates(df, "k", F.col("t"), threshold=0.7, least=80)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if forest.similarity(texts[i], texts[j]) >= 0.7}
    assert len(want) > 100 and got <= want and len(want - got) <= 0.05 * len(want)


def test_forest_keeps_the_other_text_of_a_copied_key(spark):
    x, y = (" ".join(word() for _ in range(20)) for _ in range(2))
    df = spark.createDataFrame([(1, x), (5, x), (5, y), (7, y + " end")], "k long, t string")
    reps, _ = forest.representatives(df, "k", F.col("t"), 80)
    assert sorted(map(tuple, reps.collect())) == sorted([(1, x), (5, y), (7, y + " end")])
    pairs, copies = forest.near_duplicates(df, "k", F.col("t"), threshold=0.7, least=80)
    assert sorted(map(tuple, forest.all_pairs(pairs, copies).collect())) == [(1, 5), (5, 7)]
    df = spark.createDataFrame([(1, x), (5, x), (5, x + " end")], "k long, t string")
    assert list(map(tuple, forest.all_pairs(*forest.near_duplicates(df, "k", F.col("t"), threshold=0.7, least=80)).collect())) == [(1, 5)]


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.85])
def test_prefixes_are_shortened_until_the_recall_is_reached(threshold):
    texts = [" ".join(word() for _ in range(20)) for _ in range(200)]
    d = forest.Depths(texts, threshold, 24, 0.95)
    assert all(r >= 0.95 for kind in d.recalls for r in kind)
    assert all((1 <= t).all() and (t <= forest.DEEP).all() for t in d.table) and (threshold > 0.8 or any(len(set(t.ravel().tolist())) > 1 for t in d.table))
    loose = forest.Depths(texts, threshold, 24, 0.5)
    assert all((a >= b).all() for a, b in zip(loose.table, d.table)) and (threshold > 0.8 or sum(t.sum() for t in loose.table) > sum(t.sum() for t in d.table))


def test_leaves_sort_as_tries():
    sig = np.random.default_rng(3).integers(0, 2**32, (50, 256), dtype=np.uint32)
    sig[1:, :72] = sig[:1, :72]  # three values of each of 24 tries
    k = forest.leaves(sig, 24, 1)
    assert (forest.shared(k[0], k[1]) >= 3).all() and (forest.shared(k[0], k[0]) == forest.DEEP).all() and (k >> forest._TRIE == np.arange(24, 48)).all()


def test_links_join_crowds_without_all_pairs(spark):
    """A crowd of near copies gives a few pairs a row, and the same groups as all pairs."""
    stem = [word() for _ in range(20)]
    texts = []
    for i in range(400):
        ws = list(stem)
        ws[RNG.randrange(20)] = word()
        texts.append(" ".join(ws))
    for i in range(60):
        t = [word() for _ in range(20)]
        texts += [" ".join(t), " ".join([word(), *t[1:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    run = lambda **o: forest.near_duplicates(df, "k", F.col("t"), threshold=0.7, least=80, **o)
    every, copies = run()
    few, _ = run(every=False, hot=64)
    as_set = lambda x: {tuple(r) for r in forest.groups(x, copies).collect()}
    assert as_set(every) == as_set(few) and few.count() < 60 * len(texts) < every.count()


# ------------------------------------------------------------------------------------------------------- problems 7, 8
WILD = ["", None, "   ", "\r\n\t ", "Hello world's <|endoftext|>", "漢字かな交じり文、🙂👍🏽", "a" * 3000, "x" * 70 + " " + "é" * 200, " 　 z", "퟿￿\x00", "I'll've 12 345", "İẞ ß"]


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_encode(spark):
    import tiktoken

    ranks = encode.load_ranks(VOCABULARY)
    ref = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i % 9, t) for i, t in enumerate(WILD * 2)] + [(100 + i, " ".join(word(RNG.randrange(1, 12)) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("ids", F.lit(1)).withColumn("_key", F.lit(1))
    for most in (65_536, 3):
        got = Counter((r["k"], tuple(r["ids"])) for r in encode.encode_corpus(df, "k", "t", most_words=most).collect())
        assert got == Counter((k, tuple(ref.encode_ordinary(t) if t else ())) for k, t in rows)
    assert encode.encode_corpus(df.limit(0), "k", "t").count() == 0
    words = [word(RNG.randrange(1, 30)).encode() for _ in range(500)] + ["漢字" .encode() * 9, b"\xff\xfe", b" "]
    assert encode.Pairs(ranks).merge(words) == [encode.merge(w, ranks) for w in words] == [ref._encode_single_piece(w) for w in words]


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "", "ta"])}
    lex = encode.Lexicon.build(words)
    assert len(lex.final) < 9  # the suffixes of tap, top, stop are shared
    (tmp_path / "l").write_bytes(lex.dump())
    again = encode.Lexicon.open(str(tmp_path / "l"))
    asked = [*words, b"t", b"tapss", b"x", b"tops "]
    assert again.find(asked) == [words.get(w) for w in asked]
    none = encode.Lexicon.build({})
    (tmp_path / "n").write_bytes(none.dump())
    assert encode.Lexicon.open(str(tmp_path / "n")).find([b"a"]) == [None]


def check_packing(sizes, rows, capacity):
    fill, parts = Counter(), {}
    for r in rows:
        fill[r["container"]] += r["n"]
        parts.setdefault(r["k"], []).append((r["first"], r["n"]))
    assert not fill or max(fill.values()) <= capacity
    for k, n in sizes:
        at = 0
        for first, m in sorted(parts.get(k, [])):
            assert first == at
            at += m
        assert at == max(0, n or 0)
        assert n is None or n > capacity or len(parts.get(k, [])) <= 1
    return len(fill)


@pytest.mark.parametrize("sizes", [[], [0, None, -3], [5000], [7] * 500, [int(RNG.lognormvariate(5, 1)) for _ in range(3000)], [1024] * 9 + [2048, 2049, 1]])
def test_pack(spark, sizes):
    rows = list(enumerate(sizes))
    df = spark.createDataFrame(rows, "k long, s int").withColumn("container", F.lit(0)).withColumn("n", F.lit(0))
    got = pack.pack(df, "k", "s", 2048).collect()
    n = check_packing(rows, got, 2048)
    total = sum(x for x in sizes if x and x > 0)
    if total > 100_000:
        assert total / 2048 / n > 0.99


def test_nnls():
    a = np.abs(np.random.default_rng(0).normal(size=(30, 10)))
    x = np.maximum(0, np.random.default_rng(1).normal(size=10))
    cols, rows = (i.ravel() for i in np.meshgrid(np.arange(10), np.arange(30), indexing="ij"))
    assert np.allclose(pack.nnls(rows, cols, a.T.ravel(), a @ x, 20_000), x, atol=1e-2)


@pytest.mark.parametrize("capacity", [2048, 32_768])
def test_patterns_do_the_packing(capacity):
    """Fitted patterns place most items, nearly no space is unused, and the work is that of the histogram."""
    rng = np.random.default_rng(2)
    n = rng.lognormal(np.log(capacity / 8), 1.1, 200_000).astype(np.int64) % capacity
    lengths, counts = np.unique(n[n > 0], return_counts=True)
    done, fitted = pack.plan(lengths, counts, capacity)
    held = Counter()
    for p, times in done:
        assert sum(p) <= capacity
        for x in p:
            held[x] += times
    assert held == dict(zip(lengths.tolist(), counts.tolist()))
    assert fitted >= 0.7 * counts.sum() and (lengths * counts).sum() / capacity / sum(t for _, t in done) > 0.995


# ------------------------------------------------------------------------------------------------------------ problem 9
LANG = {"en": "the old teapot in this house has been rated by many of the people who live here", "de": "der alte Teekessel in diesem Haus wurde von vielen Leuten gelobt die hier wohnen",
        "fr": "la vieille théière de cette maison a été notée par beaucoup de gens qui habitent ici", "ru": "старый чайник в этом доме хвалили многие люди которые здесь живут", "zh": "这个房子里的旧茶壶得到了很多住在这里的人的称赞"}


def sentence(lang):
    ws = list(LANG[lang]) if lang == "zh" else LANG[lang].split()
    ws = [RNG.choice(ws) for _ in range(RNG.randrange(9, 14))]
    return "".join(ws) + "。" if lang == "zh" else " ".join(ws).capitalize() + "."


def test_languages(spark):
    rows, truth = [], {}
    for i in range(300):
        a, b = RNG.choice(list(LANG)), RNG.choice(list(LANG)) if RNG.random() < 0.3 else None
        langs = [a] * 4 + ([b] * 2 if b else [])
        lab = RNG.choice([a, a, a.upper(), f"{a}-XX", f"{a}_YY", None, "", "und", RNG.choice(list(LANG))])
        rows.append((i, "Home | Menu\n" + " ".join(sentence(x) for x in langs) + "\nGET /x HTTP/1.1", lab))
        truth[i] = set(langs)
    rows += [(900, None, "en"), (901, "", None), (902, " \n ", "fr"), (903, "Home | Products", "en"), (904, 'fn main() { let x = 1; }', None)]
    df = spark.createDataFrame(rows, "k long, t string, l string").withColumn("named", F.lit(0)).withColumn("segments", F.lit(0))
    scored = language.languages(df, "k", "t", "l", sorted(LANG)).collect()
    got = {r["k"]: {s["lang"] for s in r["segments"] if s["sentence"]} for r in scored}
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert not any(got[k] for k in (900, 901, 902, 903, 904))
    assert {r["k"]: r["named"] for r in scored}[900] == "en"
    assert all(0.5 <= s["confidence"] <= 1 for r in scored for s in r["segments"])
    text = dict((r[0], r[1]) for r in rows)
    assert all(0 <= s["start"] < s["end"] <= len(text[r["k"]]) for r in scored for s in r["segments"])
    assert language.spoken(language.languages(df.limit(0), "k", "t", "l", sorted(LANG)), "k").count() == 0
    for one in (df.where("l = 'en' or l is null"), df.withColumn("l", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            language.languages(one, "k", "t", "l", sorted(LANG))


def test_held_out_accuracy():
    """Kernel ridge regression on sentences it hasn't seen, a tenth of the training labels being wrong."""
    said = [(x, sentence(x)) for x in LANG for _ in range(120)]
    RNG.shuffle(said)
    train, test = said[:400], said[400:]
    labels = [RNG.choice(list(LANG)) if RNG.random() < 0.1 else x for x, _ in train]
    codes = sorted(LANG)
    w = language.fit([s for _, s in train], labels, codes, landmarks=100)
    own, cell = language.spectrum([s for _, s in test])
    best = language.kernel_rows(own, len(test), w[cell]).argmax(1)
    assert np.mean([codes[b] == x for b, (x, _) in zip(best, test)]) >= 0.98


# ---------------------------------------------------------------------------------------------------------------- queries
@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return oracle(DATA)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    sql = Q.oracle_sql().get(name)
    if sql:
        assert not compare(spark, con, DATA, name, Q.queries()[name], sql)
    else:
        assert Q.queries()[name](spark, DATA).count() >= 0
