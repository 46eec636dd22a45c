"""Operators on small relations, beside plain models of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import bpe, crawl, dedup, federate, index, names, search, stats
from pagemill.plans.graph import components
from pagemill.plans.skew import lookup
from pagemill.sources import files
from pagemill.streaming import counters

DOCS = "doc_id long, domain string, title string, description string, keywords array<string>, url string, dup_count long"


def test_lookup_keeps_every_row(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r["i"]: r["v"] for r in lookup(left, right, "k", F.col("i")).collect()}
    assert len(got) == 5000 and got[3] == 14 and got[2] == 4 and got[1] is None and got[4999] is None
    assert lookup(left, right, "k", F.col("i"), "inner").count() == sum(v is not None for v in got.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def model(prints):
    kept, out, fnvs = [], {}, {}
    for i, fnv, s, n in prints:
        if fnv in fnvs:
            out[i] = out[fnvs[fnv]]
            continue
        fnvs[fnv] = i
        near = [k for k, ks, kn in kept if n >= 128 and kn >= 128 and 10 * abs(n - kn) <= 3 * max(n, kn) and bin(s ^ ks).count("1") <= 6]
        out[i] = min(near) if near else i
        if not near:
            kept.append((i, s, n))
    return out


def test_representatives(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(12)]
    prints = []
    for i in range(200):
        s = rng.choice(base)
        for _ in range(rng.randrange(5)):
            s ^= 1 << rng.randrange(63)
        prints.append((i, rng.randrange(150), s, rng.choice([100, 130, 150, 200, 320, 5000])))
    byfnv = {}
    prints = [byfnv.setdefault(p[1], p)[:0] or (p[0], p[1], *byfnv[p[1]][2:]) for p in prints]
    df = spark.createDataFrame(prints, "id long, fnv long, simhash long, fp_len long")
    heads = [p for p in prints if byfnv[p[1]][0] == p[0]]
    near = {(a[0], b[0]) for a in heads for b in heads if a[0] < b[0] and min(a[3], b[3]) >= 128 and 10 * abs(a[3] - b[3]) <= 3 * max(a[3], b[3]) and bin(a[2] ^ b[2]).count("1") <= 6}
    assert {tuple(r) for r in dedup.near_pairs(spark.createDataFrame(heads, df.schema), "id", block=16).collect()} == near
    assert {r["id"]: r["representative"] for r in dedup.representatives(df, "id").collect()} == model(prints)
    assert dedup.near_pairs(df.limit(0), "id").count() == 0


@pytest.mark.parametrize("block", [700, 100_000])
def test_decide(spark, block):
    """Chains of 1,000 that each depend on the one before, keys that many share, and open ones, beside the sequential rule."""
    from pagemill.plans.greedy import GOES, OPEN, STAYS, decide

    rng = random.Random(8)
    entries = [(i, x, 0, x == i, False) for i in range(1000) for x in (i, i - 1)]
    entries += [(c, 10_000 + rng.randrange(20), 1, rng.random() < 0.8, rng.random() < 0.05) for c in range(2000, 2060) for _ in range(3)]
    told, want = {}, {}
    for c in sorted({e[0] for e in entries}):
        mine = [e for e in entries if e[0] == c]
        heard = {s for e in mine for s in told.get(e[1:3], ())}
        want[c] = GOES if STAYS in heard else OPEN if OPEN in heard or any(e[4] for e in mine) else STAYS
        for e in mine:
            if e[3] and want[c] != GOES:
                told.setdefault(e[1:3], set()).add(want[c])
    df = spark.createDataFrame(entries, "cid long, x long, y long, pub boolean, more boolean")
    got = {r["cid"]: r["s"] for r in decide(df, block=block, rounds=2).collect()}
    assert got == want


def test_exact_duplicates_and_sets(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "id long, v string")
    assert [tuple(r) for r in dedup.exact_duplicates(df, "id", "v").collect()] == [(1, 3)]
    new = spark.createDataFrame([(5, "x"), (6, "y"), (6, "z")], "id long, v string")
    assert sorted(r["id"] for r in dedup.upsert(df, new, "id").collect()) == [1, 2, 3, 4, 5, 6]


CORPUS = [(1, "a.example", "Smart home - a.example", "all about homes", ["home"], "u1", 1), (2, "b.example", "smart home", "other", [], "u2", 1), (3, "c.example", "Kitchen", None, None, "u3", 1), (4, None, None, None, None, None, None)]


def test_search(spark):
    docs = spark.createDataFrame(CORPUS, DOCS)
    ix = search.SearchIndex.from_df(docs, spark.createDataFrame([("zzz",)], "domain string"))
    hits = {r["doc_id"]: r for r in ix.search("Smart").collect()}
    assert hits.keys() == {1, 2} or hits.keys() == {1}
    assert ix.search("nothing here").count() == 0 and ix.search("com").count() == 0
    assert [r["doc_id"] for r in ix.search("home site:b.example").collect()] == [2]
    assert search.SearchIndex.from_df(docs, spark.createDataFrame([("a.example",)], "domain string")).search("home").count() == 1
    page = lambda n: [r["doc_id"] for r in search.page(ix.search("home"), n, 1).collect()]
    assert page(1) + page(2) + page(3) == [r["doc_id"] for r in search.page(ix.search("home"), 1, 50).collect()]
    assert search.with_fallback(ix.search("zzzz").select("title"), docs.select("title")).count() == 4
    assert [r[0] for r in index.suggest(index.document_frequency(ix.post), "ho", 5).collect()] == ["home", "homes"]
    assert index.suggest(index.document_frequency(ix.post), "  ").count() == 0


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS[:3], DOCS)
    post = search.SearchIndex.from_df(docs).post
    index.save(docs, post, "doc_id", str(tmp_path))
    index.save(docs.where("doc_id < 3"), post, "doc_id", str(tmp_path))
    again, posts = index.load(spark, str(tmp_path), DOCS)
    assert again.count() == 2 and posts.count() == post.count()
    assert index.stats(docs, post).first()["documents"] == 3


def test_bpe(spark):
    rows = [(1, "low lower lowest newest widest 低碳 低碳生活"), (2, "low new wide"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    v = bpe.train(df, "id", "t", 300)
    for _, t in rows[:2]:
        assert v.decode(v.encode(t)) == t.replace(" ", "")
    assert v.merges[0][:2] == (ord("e") + 1, ord("s") + 1) and len(v.tokens) <= 300
    again = bpe.Vocabulary.from_frames(*v.frames(spark))
    assert again.merges == v.merges and again.tokens == v.tokens
    got = {r[0]: r[1] for r in df.select("id", v.encoder(spark)("t")).collect()}
    assert got[1] == v.encode(rows[0][1]) and got[3] is None and got[4] == []
    pairs = {(r["l"], r["r"]): r["n"] for r in bpe.pair_counts(bpe.words_in_order(df, "id", "t", None)).collect()}
    assert pairs[ord("l") + 1, ord("o") + 1] == 3


def test_names(spark):
    got = [r["name"] for r in names.names(spark, "12ab", 1, 2).orderBy("length", "id").collect()]
    assert got == list("12ab") + [a + b for a in "12ab" for b in "12ab"]
    assert names.total("x" * 36, 1, 3, 1) == 36 + 36**2 + 36**3
    with pytest.raises(ValueError):
        names.names(spark, "x" * 36, 13, 13)
    obs = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 3, 0), ("c", 1, 2, 0), ("c", 2, 3, 0), ("d", 1, None, None)], "fqdn string, attempt int, rcode int, ancount int")
    assert dict(map(tuple, names.retried(obs).collect())) == {"a": "registered", "b": "available", "c": "available", "d": "error"}
    assert names.routed(names.retried(obs)).count() == 6
    rr = names.round_robin(spark.range(50).select((F.lit(100) - F.col("id")).alias("n")), "n", ["x", "y", "z"]).orderBy("n").collect()
    assert [r["keyword"] for r in rr] == [("x", "y", "z")[i % 3] for i in range(50)]
    assert names.sampled_servers(obs.select("fqdn").distinct(), ["1", "2", "3"], 2).count() == 8


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", None)], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert dict(map(tuple, crawl.bfs(edges, start, 5).collect())) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert dict(map(tuple, crawl.bfs(edges, start, 5, most=3).collect())) == {"a": 0, "b": 1, "d": 1}
    http = edges.select(*[F.concat(F.lit("http://h.example/"), F.col(c)).alias(c) for c in ("src", "dst")])
    assert crawl.bfs(http, spark.createDataFrame([("http://h.example/a",)], "url string"), 5, cap_per_domain=2).count() == 2


def test_serp(spark):
    page = '<h2><a href="/login">x</a></h2><h3><a href="//e.example/p">A &amp;amp; B</a> more</h3><h3><a href="rel?q">Good <b>one</b></a> and text</h3><h3><a href="http://k.example">casino</a></h3><h3>none</h3>'
    df = spark.createDataFrame([("s", 1, "https://se.example/x/y", page, ["login"])], "engine string, page int, base string, html string, noise array<string>")
    got = [(r["title"], r["url"], r["snippet"]) for r in federate.parse_serps(df, F.col("noise")).orderBy("pos").collect()]
    assert got == [("Good one", "https://se.example/x/rel?q", "and text")]


def test_cache_hits(spark):
    t0, rng = datetime(2025, 1, 1), random.Random(3)
    rows = [(i, rng.choice("ab"), t0 + timedelta(seconds=rng.randrange(2000))) for i in range(300)]
    put, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = k in put and (t - put[k]).total_seconds() <= 60
        put[k] = put[k] if hit else t
        want[i] = hit
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp")
    assert {r["i"]: r["hit"] for r in stats.cache_hits(df, ["k"], "ts", "i", 60).collect()} == want
    assert stats.cache_hits(df.limit(0), ["k"], "ts", "i", 60).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(" A ",), ("a",), ("b",), ("",), (None,)], "query string")
    for i in range(3):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = counters.counts_of_files(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "work"))
    assert dict(map(tuple, got.collect())) == {"a": 6, "b": 3}


def test_cache_stream(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t0), ("a", t0 + timedelta(seconds=30)), ("a", t0 + timedelta(seconds=70)), ("b", t0)], "k string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    counters.run_available(counters.cache_stream(counters.read_log(spark, str(tmp_path / "in"), df.schema), "k", "ts"), str(tmp_path / "cp"), lambda b, n: out.extend((r["k"], r["ts"], r["hit"]) for r in b.collect()), "append")
    assert sorted(out) == [("a", t0, False), ("a", t0 + timedelta(seconds=30), True), ("a", t0 + timedelta(seconds=70), False), ("b", t0, False)]


def test_windows_stream(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(minutes=m), "x") for m in (0, 1, 7, 200)], "ts timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = counters.read_log(spark, str(tmp_path / "in"), df.schema)
    for name, q, want in (("w", counters.windowed(s, "ts", "5 minutes"), {2, 1}), ("s", counters.sessions(s, "ts", "10 minutes", "k"), {3, 1})):
        out = []
        counters.run_available(q, str(tmp_path / name), lambda b, n: out.extend(r["n"] for r in b.collect()), "append" if name == "s" else "update")
        assert set(out) <= want and out


def test_files(spark, tmp_path):
    (tmp_path / "sites/a.example/sub").mkdir(parents=True)
    (tmp_path / "sites/a.example/index.html").write_text("<title>x</title>")
    (tmp_path / "sites/a.example/sub/p.html").write_text("y")
    (tmp_path / "sites/a.example/n.txt").write_text("z")
    assert {(r["domain"], r["rel"]) for r in files.site_pages(spark, str(tmp_path / "sites")).collect()} == {("a.example", "index.html"), ("a.example", "sub/p.html")}
    (tmp_path / "l.txt").write_text("# c\na b #x\n\n c\n")
    assert [r["word"] for r in files.space_list(spark, str(tmp_path / "l.txt")).orderBy("line", "pos").collect()] == ["a", "b", "c"]
    assert files.block_list(spark, str(tmp_path / "missing.txt")).count() == 0
    assert files.Config.parse("a = b = c\n# x\n").values == {"a": "b = c"}
    with pytest.raises(ValueError):
        files.Config.parse("nonsense")
    r = spark.createDataFrame([("t\t1", "u", None, "e")], "title string, url string, snippet string, engine string")
    files.save_results(r, str(tmp_path / "cache"))
    assert [tuple(x) for x in files.cached_results(spark, str(tmp_path / "cache")).collect()] == [("t 1", "u", "", "e")]
    files.save_pages(spark.createDataFrame([("http://A.example/x?y", "h"), ("bad", "h")], "url string, html string"), str(tmp_path / "pages"))
    assert [(r["domain"], r["file"]) for r in spark.read.parquet(str(tmp_path / "pages")).collect()] == [("a.example", "_x_y.html")]


def test_tools(spark, tmp_path):
    from pagemill.operators.tools import Tools, context

    docs = spark.createDataFrame(CORPUS, DOCS)
    tools = Tools(search.SearchIndex.from_df(docs), spark.createDataFrame([("A",), ("a ",)], "query string"))
    assert tools.search("home", 1, 1000).count() == tools.search("home", 0, 0).count() + 1
    assert [r["line"] for r in context(tools.search("home")).orderBy("rank").collect()][0].startswith("1. Smart home")
    assert tools.suggest("ho", 500).count() == 2 and tools.status().first()["documents"] == 4 and tools.top_queries().first()["n"] == 2
    assert tools.duplicates(0, 0).count() <= 1
    xml = tools.sitemap(spark.createDataFrame([("a.example", '<a href="/x">')], "domain string, html string")).first()["xml"]
    assert "<loc>https://a.example/x</loc>" in xml
    files.write_list(spark.createDataFrame([(2, "b"), (1, "a")], "n int, v string"), ["n"], "v", str(tmp_path / "l"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*"))) == "a\nb\n"


def test_queue_is_drained_into_documents(spark):
    queue = spark.createDataFrame([("u1", False), ("u2", False), ("u3", True), ("u4", False)], "url string, done boolean")
    docs = spark.createDataFrame([("u1", "old")], "url string, title string")
    fetched = spark.createDataFrame([("u1", "new"), ("u2", "two"), ("u2", "two"), ("u4", "four")], "url string, title string")
    left, found = federate.ingested(queue, fetched, docs, 2)
    assert {tuple(r) for r in left.collect()} == {("u1", True), ("u2", True), ("u3", True), ("u4", False)}
    assert sorted(map(tuple, found.collect())) == [("u1", "old"), ("u2", "two")]
    assert dedup.removed(docs, queue.where("done"), "url").count() == 1 and dedup.removed(docs, queue, "url").count() == 0
    empty = federate.ingested(queue.limit(0), fetched.limit(0), docs.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_parse_query(spark):
    from pagemill.functions.urls import parse_query

    df = spark.createDataFrame([("q=a+b&p=2&q=%41&x&=y&z=1=2",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(parse_query(F.col("q"))).collect()] == [{"q": "A", "p": "2", "x": "", "": "y", "z": "1=2"}, {}, None]


def test_bounded_cache_stream(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    asks = [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("a", 4), ("b", 5), (None, 6), ("b", 7), ("b", 8), ("b", 80)]
    schema = "n string, k string, ts timestamp"
    for part in (asks[:5], asks[5:]):  # two micro-batches
        spark.createDataFrame([("s1", k, t0 + timedelta(seconds=s)) for k, s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = counters.read_log(spark, str(tmp_path / "in"), schema, 1)
    counters.run_available(counters.bounded_cache_stream(stream, "n", "k", "ts", capacity=2), str(tmp_path / "cp"), lambda b, n: out.extend((r["k"], int((r["ts"] - t0).total_seconds()), r["hit"]) for r in b.collect()), "append")
    # c puts out a, a puts out b
    assert sorted(out, key=lambda x: x[1]) == [("a", 0, False), ("b", 1, False), ("a", 2, True), ("c", 3, False), ("a", 4, False), ("b", 5, False), (None, 6, None), ("b", 7, False), ("b", 8, True), ("b", 80, False)]


def test_flush_and_progress(spark, tmp_path):
    spark.createDataFrame([("x",)], "query string").coalesce(1).write.parquet(str(tmp_path / "in"))
    told, out = [], []
    listener = counters.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    q = counters.start_flushing(counters.running_counts(counters.read_log(spark, str(tmp_path / "in"), "query string")), str(tmp_path / "cp"), lambda b, n: out.extend(b.collect()), "1 second")
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(listener)
    assert [tuple(r) for r in out] == [("x", 1)]
