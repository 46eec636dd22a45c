"""Registry of the engine's queries over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions import hashing, html, packets, text, urls, values
from pagemill.operators import bpe, crawl, dedup, federate, index, names, search, stats
from pagemill.plans.durable import durable, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function, with its SQL where SQL can express it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values_sql(name: str, columns: str, data: list[tuple]) -> str:
    """The same rows for DuckDB, as a common table expression."""
    body = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in data)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}))"


# ---------------------------------------------------------------------------------------------- pages made from doc_meta
_HTML = """concat('<html><head><title>', coalesce(title, ''), ' </title><META name="description" content="', replace(coalesce(description, ''), '"', ''),
 '"><meta name="keywords" content="', coalesce({kw}, ''), '"></head><body><h2><a class="t" href="', coalesce(url, ''), '">', coalesce(title, ''),
 '</a></h2><a href="/', cast(doc_id as string), '.html#Top">more</a> <A href=''about/us?x=1''>about</A><p>', coalesce(description, ''), ' ', coalesce(url, ''), '</p></body></html>')"""
PAGES = "pages AS (SELECT doc_id, url, domain, " + _HTML.format(kw="array_to_string(keywords, ', ')") + " AS html FROM doc_meta)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_meta").selectExpr("doc_id", "url", "domain", _HTML.format(kw="array_join(keywords, ', ')") + " AS html")


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"


def d_squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g')"


def d_domain(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^https?://([^/]*)', 1)), '')"


def d_norm(u: str) -> str:
    c = f"regexp_replace({d_strip(u)}, '#.*$', '', 's')"
    host, path = f"lower(regexp_extract({c}, '^https?://([^/]*)', 1, 'i'))", f"regexp_extract({c}, '^https?://[^/]*(/.*)$', 1, 'is')"
    return f"CASE WHEN {host} <> '' THEN lower(regexp_extract({c}, '^(https?)://', 1, 'i')) || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END END"


def d_path(u: str) -> str:
    p = f"regexp_extract({u}, '^.*?://[^/]*(/.*)$', 1, 's')"
    return f"CASE WHEN NOT contains({u}, '://') THEN {u} WHEN {p} = '' THEN '/' ELSE {p} END"


def d_resolve(base: str, href: str) -> str:
    h, home = d_strip(href), f"nullif(regexp_extract({base}, '^(.*?://[^/]*)', 1, 's'), '')"
    return f"""CASE WHEN {h} = '' OR regexp_matches({h}, '^(?:{urls.NO_PAGE})') THEN NULL WHEN regexp_matches({h}, '^https?://') THEN {d_norm(h)}
 WHEN starts_with({h}, '//') THEN {d_norm(f"('http:' || {h})")} WHEN starts_with({h}, '/') THEN {home} || {h} ELSE {home} || regexp_extract({d_path(base)}, '^(.*/)', 1, 's') || {h} END"""


# ---------------------------------------------------------------------------------------------- extraction and addresses
_TITLE = "CASE WHEN regexp_matches(lower(html), '<title>.*?</title>', 's') THEN " + d_strip("regexp_extract(lower(html), '<title>(.*?)</title>', 1, 's')") + " END"


@query(f"WITH {PAGES} SELECT doc_id, coalesce({_TITLE}, domain) AS title FROM pages")
def page_titles(spark, d):
    return pages(spark, d).select("doc_id", html.title_or(F.col("html"), F.col("domain")).alias("title"))


@query(f"SELECT result_id, {d_domain('url')} AS domain FROM meta_results")
def page_domains(spark, d):
    return table(spark, d, "meta_results").select("result_id", urls.domain_of(F.col("url")).alias("domain"))


@query(f"SELECT {d_domain('url')} AS domain, count(*) AS n FROM meta_results WHERE url IS NOT NULL GROUP BY 1")
def pages_per_domain(spark, d):
    return table(spark, d, "meta_results").where("url is not null").groupBy(urls.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"SELECT result_id, {d_norm('url')} AS normal FROM meta_results")
def url_normalize(spark, d):
    return table(spark, d, "meta_results").select("result_id", urls.normalize_url(F.col("url")).alias("normal"))


@query(f"SELECT result_id, {d_path('url')} AS path FROM meta_results")
def url_paths(spark, d):
    return table(spark, d, "meta_results").select("result_id", urls.url_path(F.col("url")).alias("path"))


V_URLS = [(i, b, h) for i, (b, h) in enumerate([
    ("http://a.example/x/y.html", h) for h in ("z.html", "/root?q=1#F", "//Other.Example/p", "HTTP://no", "http://A.Example", "https://B.example/P#f", "#top", "javascript:void(0)", "mailto:x@y", "tel:1", "data:,", "about:blank", " ", "", "../up", "?q")
] + [("http://a.example", "x"), ("a.example/x", "y"), ("https://a.example:8080/d/", "e f"), ("https://a.example/d", "/e"), ("https://a.example/d/e", "e")])]


@query(f"WITH {values_sql('v', 'id, base, href', V_URLS)} SELECT id, {d_resolve('base', 'href')} AS url FROM v")
def url_resolve(spark, d):
    return rows(spark, "id int, base string, href string", V_URLS).select("id", urls.resolve_url(F.col("base"), F.col("href")).alias("url"))


@query(f"""WITH {values_sql('v', 'id, base, href', V_URLS)}, t AS (SELECT *, {d_strip('href')} AS t FROM v)
SELECT id, CASE WHEN regexp_matches(t, '^https?://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
 WHEN starts_with(t, '/') THEN CASE WHEN starts_with(base, 'https://') THEN 'https://' ELSE 'http://' END || coalesce(string_split(base, '/')[3], '') || t
 ELSE CASE WHEN contains(base, '/') THEN regexp_extract(base, '^(.*)/', 1, 's') ELSE base END || '/' || t END AS url FROM t""")
def url_redirect_resolve(spark, d):
    return rows(spark, "id int, base string, href string", V_URLS).select("id", urls.resolve_redirect(F.col("base"), F.col("href")).alias("url"))


@query("SELECT stat_id, url_encode(query) AS encoded FROM query_stats")
def query_encoded(spark, d):
    return table(spark, d, "query_stats").select("stat_id", urls.url_encode(F.col("query")).alias("encoded"))


@query("SELECT result_id, url_decode(replace(url, '+', ' ')) AS decoded FROM meta_results")
def url_decoded(spark, d):
    return table(spark, d, "meta_results").select("result_id", urls.url_decode(F.col("url")).alias("decoded"))


V_SERVERS = [(1, "8.8.8.8"), (2, "8.8.8.8:5353"), (3, "2001:db8::1"), (4, "[2001:db8::1]:53"), (5, "ns.example")]


@query(f"""WITH {values_sql('v', 'id, s', V_SERVERS)} SELECT id, CASE WHEN starts_with(s, '[') THEN s WHEN length(s) - length(replace(s, ':', '')) >= 2 THEN '[' || s || ']:53'
 WHEN NOT contains(s, ':') THEN s || ':53' ELSE s END AS server FROM v""")
def dns_server_normalize(spark, d):
    return rows(spark, "id int, s string", V_SERVERS).select("id", urls.dns_server(F.col("s")).alias("server"))


@query(f"""WITH p AS (SELECT result_id, {d_path('url')} AS path FROM meta_results WHERE {d_domain('url')} IS NOT NULL), s AS (SELECT *, regexp_replace(path, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') AS safe FROM p)
SELECT result_id, CASE WHEN path IN ('', '/') THEN 'index.html' WHEN ends_with(safe, '.html') THEN safe ELSE safe || '.html' END AS file FROM s""")
def page_files(spark, d):
    return table(spark, d, "meta_results").where(urls.domain_of(F.col("url")).isNotNull()).select("result_id", urls.file_name(F.col("url")).alias("file"))


_BASE = "('http://' || coalesce(domain, 'none.example') || '/dir/page')"
_LINKS = f"""{PAGES}, tags AS (SELECT doc_id, {_BASE} AS base, html, unnest(regexp_extract_all(html, '<a [^>]*', 0, 'is')) AS tag FROM pages),
hrefs AS (SELECT doc_id, base, CASE WHEN regexp_matches(tag, 'href="[^"]*"', 'is') THEN regexp_extract(tag, 'href="([^"]*)"', 1, 'is') END AS h FROM tags
 UNION ALL SELECT doc_id, base, CASE WHEN regexp_matches(tag, 'href=''[^'']*''', 'is') THEN regexp_extract(tag, 'href=''([^'']*)''', 1, 'is') END FROM tags),
bare AS (SELECT doc_id, unnest(regexp_extract_all(lower(html), 'https?://[^\\s\\x{{0B}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}"'')><\\]`]*')) AS u FROM pages),
links AS (SELECT doc_id, {d_resolve('base', 'h')} AS link FROM hrefs WHERE h IS NOT NULL UNION ALL SELECT doc_id, {d_norm('u')} FROM bare)"""


def _links(spark, d):
    base = F.concat(F.lit("http://"), F.coalesce("domain", F.lit("none.example")), F.lit("/dir/page"))
    return pages(spark, d).select("doc_id", base.alias("base"), F.explode(html.links(F.col("html"), base)).alias("link"))


@query(f"WITH {_LINKS} SELECT doc_id, link, count(*) AS n FROM links WHERE link IS NOT NULL GROUP BY ALL")
def page_links(spark, d):
    return _links(spark, d).groupBy("doc_id", "link").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT doc_id, count(DISTINCT link) AS out_degree FROM links WHERE link IS NOT NULL GROUP BY 1")
def out_degree(spark, d):
    return _links(spark, d).groupBy("doc_id").agg(F.countDistinct("link").alias("out_degree"))


@query(f"""WITH {_LINKS}, e AS (SELECT p.doc_id, {d_domain(_BASE)} AS s, {d_domain('l.link')} AS domain FROM pages p JOIN links l USING (doc_id))
SELECT DISTINCT domain FROM e WHERE domain IS NOT NULL AND domain IS DISTINCT FROM s""")
def discovered_domains(spark, d):
    return crawl.discovered(_links(spark, d).select(F.col("base").alias("src_url"), F.col("link").alias("dst_url")))


def _d_meta(name: str) -> str:
    t = f"list_filter(regexp_extract_all(lower(html), '<meta([^>]*)', 1, 's'), lambda t: regexp_extract(t, 'name=\"([^\"]*)', 1) = '{name}' AND contains(t, 'content=\"'))[1]"
    return d_strip(f"regexp_extract({t}, 'content=\"([^\"]*)', 1, 's')")


@query(f"WITH {PAGES} SELECT doc_id, {_d_meta('description')} AS description FROM pages")
def meta_description(spark, d):
    return pages(spark, d).select("doc_id", html.meta(F.col("html"), "description").alias("description"))


_KW = rf"list_filter(regexp_split_to_array({_d_meta('keywords')}, '[,，\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda k: k <> '')"


@query(f"WITH {PAGES}, k AS (SELECT doc_id, unnest({_KW}) AS keyword FROM pages) SELECT doc_id, keyword, count(*) AS n FROM k GROUP BY ALL")
def meta_keywords(spark, d):
    return pages(spark, d).select("doc_id", F.explode(html.keywords(F.col("html"))).alias("keyword")).groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))


@query(f"WITH {PAGES} SELECT doc_id, coalesce({_TITLE}, '') || coalesce(' ' || {_d_meta('description')}, '') || coalesce(array_to_string(list_transform({_KW}, lambda k: ' ' || k), ''), '') AS text FROM pages")
def page_text(spark, d):
    return pages(spark, d).select("doc_id", html.page_text(F.col("html")).alias("text"))


_STRIPPED = d_strip(d_squeeze("replace(regexp_replace(html, '<[^>]*(?:>|$)', '', 'gs'), '>', '')"))


@query(f"WITH {PAGES} SELECT doc_id, {_STRIPPED} AS text FROM pages")
def strip_tags(spark, d):
    return pages(spark, d).select("doc_id", html.strip_tags(F.col("html")).alias("text"))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '&(?:quot|amp|lt|gt|nbsp|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&|[^&]+', 0, 's')) AS p, generate_subscripts(regexp_extract_all(text, '&(?:quot|amp|lt|gt|nbsp|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&|[^&]+', 0, 's'), 1) AS i FROM documents),
o AS (SELECT doc_id, string_agg(CASE p WHEN '&quot;' THEN '"' WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&nbsp;' THEN ' ' WHEN '&apos;' THEN '''' ELSE
 CASE WHEN regexp_matches(p, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(p, '^&#([0-9]+);$', 1) AS INTEGER)) WHEN regexp_matches(p, '^&#[xX]') THEN chr(CAST('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+);$', 1) AS INTEGER)) ELSE p END END, '' ORDER BY i) AS text FROM p GROUP BY 1)
SELECT d.doc_id, CASE WHEN contains(d.text, '&') THEN o.text ELSE d.text END AS text FROM documents d LEFT JOIN o USING (doc_id)""")
def entity_decode(spark, d):
    return table(spark, d, "documents").select("doc_id", html.decode_entities(F.col("text")).alias("text"))


@query(f"""WITH {PAGES}, t AS (SELECT doc_id, coalesce(domain, 'none.example') AS domain, list_transform(list_filter(regexp_extract_all(lower(html), '<a [^>]*', 0, 's'), lambda t: contains(t, 'href="')), lambda t: regexp_extract(t, 'href="([^"]*)', 1, 's')) AS hs FROM pages)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['https://' || domain || '/'], list_transform(list_filter(hs, lambda h: regexp_matches(h, '^(?:/|https?://)')), lambda h: CASE WHEN starts_with(h, '/') THEN 'https://' || domain || h ELSE h END)))), ' ') AS urls FROM t""")
def sitemap_urls(spark, d):
    return pages(spark, d).select("doc_id", F.array_join(html.sitemap_urls(F.col("html"), F.coalesce("domain", F.lit("none.example"))), " ").alias("urls"))


@query("""SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(lower(text), '<loc>(.*?)</loc>', 1, 's'), lambda u: trim(u)), lambda u: u <> '')) AS loc FROM documents""")
def sitemap_locs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(html.sitemap_locs(F.col("text"))).alias("loc"))


# ---------------------------------------------------------------------------------------------- words, index, search
_HAN = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"


def _d_terms(c: str) -> str:
    han = f"regexp_extract_all({c}, '{_HAN}')"
    return f"list_concat(regexp_extract_all(lower({c}), '[0-9a-z]{{2,}}'), {han}, list_transform(range(1, len({han})), lambda i: {han}[i] || {han}[i + 1]))"


@query("SELECT doc_id, count(*) AS n, count(DISTINCT t) AS kinds FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]{2,}')) AS t FROM documents) GROUP BY 1")
def tokens_ascii(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]{2,}"), F.lit(0))).alias("t"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("t").alias("kinds"))


@query(f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_HAN}')) AS h, generate_subscripts(regexp_extract_all(text, '{_HAN}'), 1) AS i FROM documents),
w AS (SELECT doc_id, h || lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM h UNION ALL SELECT doc_id, h FROM h UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]{{2,}}')) FROM documents)
SELECT t AS term, count(DISTINCT doc_id) AS df FROM w WHERE t IS NOT NULL GROUP BY 1""")
def term_document_frequency(spark, d):
    return index.document_frequency(index.postings(table(spark, d, "documents"), "doc_id", text.tokens(F.col("text")))).select("term", "df")


_INDEX_TEXT = "concat_ws(' ', title, description, domain, array_to_string(keywords, ' '))"
_POST = f"""ix AS (SELECT doc_id, {_INDEX_TEXT} AS x FROM doc_meta), hx AS (SELECT doc_id, unnest(regexp_extract_all(x, '{_HAN}')) AS h, generate_subscripts(regexp_extract_all(x, '{_HAN}'), 1) AS i FROM ix),
post AS (SELECT DISTINCT doc_id, t AS term, CASE WHEN regexp_matches(t, '^[0-9a-z]') THEN substr(t, 1, 1) ELSE '_' END AS chunk FROM (SELECT doc_id, h || lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM hx
 UNION ALL SELECT doc_id, h FROM hx UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(x), '[0-9a-z]{{2,}}')) FROM ix) WHERE t IS NOT NULL)"""


def _post(spark, d):
    return index.postings(table(spark, d, "doc_meta"), "doc_id", text.tokens(index.index_text()))


@query(f"WITH {_POST} SELECT chunk, term, CAST(floor(doc_id / 100000) AS BIGINT) AS part, array_to_string(list_sort(list(doc_id)), ' ') AS ids FROM post GROUP BY ALL")
def postings_by_chunk(spark, d):
    return index.rolled_up(_post(spark, d), "doc_id").select("chunk", "term", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query(f"WITH {_POST} SELECT (SELECT count(*) FROM doc_meta) AS documents, count(DISTINCT (chunk, term)) AS terms, count(DISTINCT chunk) AS chunks FROM post")
def index_stats(spark, d):
    return index.stats(table(spark, d, "doc_meta"), _post(spark, d))


@query(f"WITH {_POST} SELECT term AS word, CAST(least(count(*), 50) AS BIGINT) AS weight FROM post WHERE starts_with(term, 'ma') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def suggest_prefix(spark, d):
    return index.suggest(index.document_frequency(_stored(spark, d)), " Ma", 10)


@query(f"""WITH {_POST}, c AS (SELECT DISTINCT lower({d_strip('query')}) AS q FROM query_log WHERE from_cache)
SELECT word, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT term AS word, least(count(*), 50) AS w FROM post WHERE starts_with(term, 'li') GROUP BY 1 UNION ALL SELECT q, 100 FROM c WHERE starts_with(q, 'li')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def suggest_cached(spark, d):
    """Suggestions in which queries answered from the cache count."""
    cached = table(spark, d, "query_log").where("from_cache").select(stats.query_key(F.col("query")).alias("query")).distinct()
    return index.suggest(index.document_frequency(_stored(spark, d)), "li", 12, cached)


_BUILT: dict[tuple[str, str], str] = {}


def _stored(spark, d):
    """Postings of the stored index of ``d``: built and saved once for each application, read by every search."""
    known = (spark.sparkContext.applicationId, d)
    if known in _BUILT:
        try:
            return index.load_postings(spark, _BUILT[known])
        except AnalysisException:  # its folder is gone
            pass
    _BUILT[known] = new_path(spark, "index")
    index.save(table(spark, d, "doc_meta"), _post(spark, d), "doc_id", _BUILT[known])
    return index.load_postings(spark, _BUILT[known])


def _index(spark, d, blocked=None):
    return search.SearchIndex(table(spark, d, "doc_meta"), _stored(spark, d), blocked)


def _d_score(phrase: str, terms: list[str]) -> str:
    f = {"t": "lower(coalesce(title, ''))", "d": "lower(coalesce(description, ''))", "h": "lower(coalesce(domain, ''))", "k": "lower(coalesce(array_to_string(keywords, chr(1)), ''))"}
    has = lambda c, x: f"contains({f[c]}, {_lit(x)})"
    add = [f"CASE WHEN {has(c, phrase)} THEN {n} ELSE 0 END" for c, n in (("t", 30), ("d", 20), ("k", 15), ("h", 10))] if phrase else ["0"]
    add += [f"CASE WHEN {has(c, x)} THEN {n} ELSE 0 END" for x in terms for c, n in (("t", 8), ("d", 4), ("h", 2), ("k", 2))]
    hit = " OR ".join(has(c, phrase) for c in "tdh") if phrase else "false"
    matched = " + ".join(f"CASE WHEN {' OR '.join(has(c, x) for c in 'tdhk')} THEN 1 ELSE 0 END" for x in terms) or "0"
    return f"CASE WHEN NOT ({hit}) AND ({matched}) = 0 THEN {0 if terms else 5} WHEN NOT ({hit}) AND ({matched}) < {len(terms)} THEN ({' + '.join(add)}) * 3 ELSE ({' + '.join(add)}) * 10 END"


_FOLD = f"""CASE WHEN ends_with(lower(t), lower(' - ' || dm)) THEN {d_strip("substr(t, 1, length(t) - length(' - ' || dm))")} WHEN ends_with(lower(t), dm) THEN {d_strip('substr(t, 1, length(t) - length(dm))')} ELSE lower(t) END"""


def _d_search(phrase: str, terms: list[str], where: str = "true", tail: str = "ORDER BY score10 DESC, doc_id LIMIT 10", scan: bool = False) -> str:
    asked = ", ".join(map(_lit, terms)) or "''"
    cand = f"contains(lower({_INDEX_TEXT}), {_lit(phrase)})" if scan else f"doc_id IN (SELECT doc_id FROM post WHERE term IN ({asked}))"
    return f"""WITH {_POST}, s AS (SELECT doc_id, {d_strip("coalesce(title, '')")} AS t, {d_strip("coalesce(domain, '')")} AS dm, CAST({_d_score(phrase, terms)} AS BIGINT) AS score10 FROM doc_meta WHERE {cand} AND ({where})),
f AS (SELECT doc_id, score10, {_FOLD} AS fold FROM s WHERE score10 > 0),
g AS (SELECT doc_id, score10, count(*) OVER (PARTITION BY fold) AS fold_count, row_number() OVER (PARTITION BY fold ORDER BY score10 DESC, doc_id) AS r FROM f)
SELECT doc_id, score10, fold_count FROM g WHERE r = 1 {tail}"""


def _tenths(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round(F.col("score") * 10).cast("long").alias("score10"), "fold_count")


@query(_d_search("linen sofa", ["linen", "sofa"]))
def search_ranked(spark, d):
    return _tenths(search.page(_index(spark, d).search("Linen sofa")))


@query(_d_search("linen sofa", ["linen", "sofa"], tail="ORDER BY score10 DESC, doc_id LIMIT 7 OFFSET 14"))
def search_paged(spark, d):
    return _tenths(search.page(_index(spark, d).search("Linen sofa"), 3, 7))


_SITE = "pagehavn.com.example"


@query(_d_search("linen", ["linen"], f"lower(domain) = '{_SITE}' OR ends_with(lower(domain), '.{_SITE}')", tail=""))
def search_site_filter(spark, d):
    return _tenths(_index(spark, d).search(f"linen site:{_SITE}/"))


@query(_d_search("linen", ["linen"], f"domain IS DISTINCT FROM '{_SITE}'", tail=""))
def search_blacklist(spark, d):
    return _tenths(_index(spark, d, rows(spark, "domain string", [(_SITE,)])).search("linen"))


@query(_d_search("a", [], tail="", where="lower(domain) = 'mallorix.shop.example' OR ends_with(lower(domain), '.mallorix.shop.example')", scan=True))
def search_phrase_scan(spark, d):
    return _tenths(_index(spark, d).search("a site:mallorix.shop.example"))


def _vocabulary(docs: DataFrame) -> bpe.Vocabulary:
    """A vocabulary of the default size, trained on the whole text of every page with its keywords."""
    return bpe.train(docs.select("doc_id", index.index_text().alias("text")), "doc_id", "text", bpe.DEFAULT)


@query()
def search_bpe(spark, d):
    """The same search over tokens of a trained byte-pair vocabulary instead of words."""
    docs = table(spark, d, "doc_meta")
    v = _vocabulary(docs)
    post = index.postings(docs, "doc_id", v.encoder(spark, "array<string>")(F.lower(index.index_text())))
    return _tenths(search.page(search.SearchIndex(docs, post, tokenize=v.tokenize).search("Linen sofa")))


@query(f"""WITH s AS (SELECT doc_id, {d_strip("coalesce(title, '')")} AS t, {d_strip("coalesce(domain, '')")} AS dm FROM doc_meta) SELECT doc_id, {_FOLD} AS fold FROM s""")
def fold_titles(spark, d):
    return table(spark, d, "doc_meta").select("doc_id", text.fold_key(F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit(""))).alias("fold"))


@query(f"""WITH s AS (SELECT doc_id, {d_strip("coalesce(title, '')")} AS t, {d_strip("coalesce(domain, '')")} AS dm FROM doc_meta), f AS (SELECT doc_id, {_FOLD} AS fold FROM s)
SELECT fold, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:10], ' ') AS samples FROM f GROUP BY 1 HAVING count(*) > 1""")
def duplicate_titles(spark, d):
    return search.duplicate_titles(table(spark, d, "doc_meta")).select("fold", "n", F.array_join(F.transform("samples", lambda s: s["doc_id"].cast("string")), " ").alias("samples"))


V_WORDS = [(w,) for w in (".com", ".net", ".co.uk", ".com.cn", "com", "io", "gfan", "gfan.com", "comic", ".", "网", "网站", "a", "ab", "x�", ".toolongforatld", "shop")]


@query(f"""WITH {values_sql('v', 'w', V_WORDS)}, t AS (SELECT w, (regexp_matches(w, '^\\.[A-Za-z.]*$') AND strlen(w) <= 12) OR w IN ({', '.join(map(_lit, text.TLDS))}) AS tld FROM v)
SELECT w, tld, strlen(w) < 2 OR contains(w, '�') OR tld OR (length(w) = 1 AND strlen(w) = 3) AS low FROM t""")
def word_filters(spark, d):
    w = F.col("w")
    return rows(spark, "w string", V_WORDS).select("w", text.is_tld_token(w).alias("tld"), text.is_low_info_token(w).alias("low"))


# ---------------------------------------------------------------------------------------------- fingerprints
def _d_fnv(c: str) -> str:
    h = f"hex(encode({c}))"
    data = f"list_transform(range(0, strlen({c})), lambda i: (instr('123456789ABCDEF', substr({h}, 2 * i + 1, 1)) * 16 + instr('123456789ABCDEF', substr({h}, 2 * i + 2, 1)))::hugeint)"
    u = f"list_reduce(list_prepend(14695981039346656037::hugeint, {data}), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"
    return f"CAST(CASE WHEN {u} >= 9223372036854775808::hugeint THEN {u} - 18446744073709551616::hugeint ELSE {u} END AS BIGINT)"


@query(f"SELECT doc_id, {_d_fnv('title')} AS fnv FROM doc_meta")
def fnv_hash(spark, d):
    return table(spark, d, "doc_meta").select("doc_id", hashing.fnv1a64(F.col("title")).alias("fnv"))


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS first, doc_id FROM documents WHERE text IS NOT NULL QUALIFY first <> doc_id")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


def _d_sim(rel: str, key: str, c: str) -> str:
    """Common table expressions up to sim(key, simhash); the hash of each distinct gram is made once."""
    return f"""gr AS (SELECT {key}, unnest(CASE WHEN length({c}) >= 4 THEN list_transform(range(1, length({c}) - 2), lambda i: substr({c}, i, 4)) ELSE [{c}] END) AS g FROM {rel} WHERE {c} IS NOT NULL AND {c} <> ''),
gh AS (SELECT g, {_d_fnv('g')} AS h FROM (SELECT DISTINCT g FROM gr)), gb AS (SELECT {key}, h FROM gr JOIN gh USING (g)),
bits AS (SELECT {key}, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM gb, range(64) r(b) GROUP BY ALL),
ones AS (SELECT {key}, sum(CASE WHEN s > 0 THEN 1::hugeint << b::integer ELSE 0 END) AS u FROM bits GROUP BY 1),
sim AS (SELECT {key}, CAST(CASE WHEN u >= 9223372036854775808::hugeint THEN u - 18446744073709551616::hugeint ELSE u END AS BIGINT) AS simhash FROM ones)"""


@query(f"WITH {_d_sim('doc_meta', 'doc_id', 'title')} SELECT doc_id, CASE WHEN title IS NULL THEN NULL ELSE coalesce(simhash, 0) END AS simhash FROM doc_meta LEFT JOIN sim USING (doc_id)")
def simhash64(spark, d):
    return table(spark, d, "doc_meta").select("doc_id", hashing.simhash(F.col("title")).alias("simhash"))


_D_PRINT = d_strip(d_squeeze("replace(replace(CASE WHEN coalesce(domain, '') <> '' THEN replace(x, domain, '') ELSE x END, ' - ', ' '), '-', ' ')"))
_D_PRINTS = f"fx AS (SELECT doc_id, domain, coalesce(title, '') || ' ' || coalesce(description, '') AS x FROM doc_meta), fp AS (SELECT doc_id, {_D_PRINT} AS fp FROM fx)"


def _prints(spark, d):
    x = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return dedup.fingerprints(table(spark, d, "doc_meta"), "doc_id", x, F.col("domain"))


@query(f"WITH {_D_PRINTS} SELECT doc_id, fp FROM fp")
def fingerprint_text(spark, d):
    x = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return table(spark, d, "doc_meta").select("doc_id", hashing.fingerprint_text(F.coalesce("domain", F.lit("")), x).alias("fp"))


@query(f"""WITH {_D_PRINTS}, {_d_sim('fp', 'doc_id', 'fp')}, l AS (SELECT doc_id, simhash, strlen(fp) AS n FROM sim JOIN fp USING (doc_id) WHERE strlen(fp) >= 128)
SELECT a.doc_id AS a, b.doc_id AS b FROM l a JOIN l b ON a.doc_id < b.doc_id AND 10 * abs(a.n - b.n) <= 3 * greatest(a.n, b.n) AND bit_count(xor(a.simhash, b.simhash)) <= 6""")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(_prints(spark, d), "doc_id")


_D_REPS = f"""WITH RECURSIVE {_D_PRINTS}, {_d_sim('fp', 'doc_id', 'fp')}, h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS head FROM fp),
l AS (SELECT doc_id, simhash, strlen(fp) AS n FROM sim JOIN fp USING (doc_id) JOIN h USING (doc_id) WHERE strlen(fp) >= 128 AND doc_id = head),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM l a JOIN l b ON a.doc_id < b.doc_id AND 10 * abs(a.n - b.n) <= 3 * greatest(a.n, b.n) AND bit_count(xor(a.simhash, b.simhash)) <= 6),
n AS MATERIALIZED (SELECT id, near, row_number() OVER (ORDER BY id) AS i FROM (SELECT b AS id, list(a) AS near FROM e GROUP BY 1 UNION ALL SELECT DISTINCT a, CAST([] AS BIGINT[]) FROM e WHERE a NOT IN (SELECT b FROM e))),
r(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.i, CASE WHEN list_has_any(near, kept) THEN kept ELSE list_append(kept, id) END FROM r JOIN n ON n.i = r.i + 1),
k AS (SELECT unnest(arg_max(kept, i)) AS a FROM r), g AS (SELECT b, min(a) AS rep FROM e JOIN k USING (a) WHERE b NOT IN (SELECT a FROM k) GROUP BY 1),
reps AS (SELECT doc_id, coalesce(rep, head) AS representative FROM h LEFT JOIN g ON head = b)"""


@query(f"{_D_REPS} SELECT doc_id, representative FROM reps")
def near_dup_representatives(spark, d):
    return dedup.representatives(_prints(spark, d), "doc_id")


@query(f"""WITH {_D_PRINTS}, {_d_sim('fp', 'doc_id', 'fp')} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM sim a JOIN sim b ON b.doc_id = a.doc_id + 1""")
def hamming_pairs(spark, d):
    """Bits in which the fingerprints of documents with following keys differ."""
    p = dedup.fingerprints(table(spark, d, "doc_meta"), "doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))), F.col("domain")).select("doc_id", "simhash")
    nxt = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("simhash").alias("other"))
    return p.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), "b", hashing.hamming(F.col("simhash"), F.col("other")).alias("distance"))


@query(f"{_D_REPS} SELECT representative, count(*) AS dup_count FROM reps GROUP BY 1")
def dup_counts(spark, d):
    return dedup.dup_counts(near_dup_representatives(spark, d), "doc_id")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN abs(length(a.n_name) - length(b.n_name)) > 3 THEN 4 ELSE CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) END AS distance FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def edit_distance_names(spark, d):
    n = table(spark, d, "nation")  # 25 rows at any scale
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))), F.col("a") < F.col("b"))
    return pairs.select("a", "b", text.edit_distance(F.col("x"), F.col("y")).alias("distance"))


V_TYPOS = ["sofaa", "linnen", "teapo", "gardn", "kettel"]


@query(f"""WITH {_POST}, {values_sql('v', 'q', [(t,) for t in V_TYPOS])}, t AS (SELECT term, count(*) AS df FROM post WHERE regexp_matches(term, '^[0-9a-z]+$') GROUP BY 1)
SELECT q, term, CAST(levenshtein(q, term) AS INTEGER) AS distance, df FROM v JOIN t ON abs(length(q) - length(term)) <= 2 AND levenshtein(q, term) <= 2""")
def fuzzy_expand(spark, d):
    """Terms of the index within two edits of a query's words; the words are the query's own few."""
    t = index.document_frequency(_post(spark, d)).where(F.col("term").rlike("^[0-9a-z]+$"))
    q = F.explode(F.array(*[F.lit(w) for w in V_TYPOS])).alias("q")
    return t.select(q, "term", "df").where(F.abs(F.char_length("q") - F.char_length("term")) <= 2).select("q", "term", text.edit_distance(F.col("q"), F.col("term")).alias("distance"), "df").where("distance <= 2")


_WORDS = rf"w AS (SELECT DISTINCT unnest(regexp_split_to_array(title, '[\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) AS word FROM doc_meta)"


@query(f"""WITH {_WORDS}, h AS (SELECT hex(encode(word)) AS h, strlen(word) AS n FROM w WHERE strlen(word) BETWEEN 2 AND 64), p AS (SELECT substr(h, 2 * i - 1, 4) AS p FROM h, range(1, 64) r(i) WHERE i < n)
SELECT CAST(instr('123456789ABCDEF', p[1]) * 16 + instr('123456789ABCDEF', p[2]) + 1 AS INTEGER) AS l, CAST(instr('123456789ABCDEF', p[3]) * 16 + instr('123456789ABCDEF', p[4]) + 1 AS INTEGER) AS r, count(*) AS n FROM p GROUP BY ALL""")
def bpe_pair_counts(spark, d):
    return bpe.pair_counts(bpe.words_in_order(table(spark, d, "doc_meta"), "doc_id", "title", None))


@query()
def bpe_train_merges(spark, d):
    v = _vocabulary(table(spark, d, "doc_meta"))
    return v.frames(spark)[1]


@query()
def bpe_encode(spark, d):
    docs = table(spark, d, "doc_meta")
    return docs.select("doc_id", _vocabulary(docs).encoder(spark)(F.coalesce(index.index_text(), F.lit(""))).alias("ids"))


# ---------------------------------------------------------------------------------------------- names and observations
V_TLDS = [(0, "com"), (1, "net"), (2, "hk"), (3, "hk"), (4, "co.example")]
_CS = "abcdefghijklmnopqrstuvwxyz0123456789"
_NAMES = " UNION ALL ".join(f"SELECT {n} AS length, id, " + " || ".join(f"substr('{_CS}', CAST((id // {36 ** k}) % 36 + 1 AS INTEGER), 1)" for k in range(n - 1, -1, -1)) + f" AS name FROM range({36 ** n}) r(id)" for n in (1, 2, 3))


@query(f"SELECT * FROM ({_NAMES})")
def enumerate_names(spark, d):
    return names.names(spark, _CS, 1, 3)


def _fqdn(spark):
    return names.with_tlds(names.names(spark, _CS, 1, 3), rows(spark, "pos int, tld string", V_TLDS))


@query(f"WITH {values_sql('v', 'pos, tld', V_TLDS)} SELECT length, id, name, pos AS tld_pos, name || '.' || tld AS fqdn FROM ({_NAMES}), v")
def enumerate_fqdn(spark, d):
    return _fqdn(spark)


@query(f"WITH {values_sql('v', 'pos, tld', V_TLDS)} SELECT length, id, pos AS tld_pos, name || '.' || tld AS fqdn FROM ({_NAMES}), v WHERE NOT (contains(name || '.' || tld, '11') OR contains(name || '.' || tld, 'b.net'))")
def enumerate_blocked(spark, d):
    return _fqdn(spark).where(~names.blocked(F.col("fqdn"), ["11", "", "b.net"])).select("length", "id", "tld_pos", "fqdn")


@query("SELECT CAST(sum(list_reduce(list_transform(range(n), lambda i: CAST(36 AS HUGEINT)), lambda a, b: a * b)) * 134 AS VARCHAR) AS total FROM range(1, 21) r(n)")
def enumerate_total(spark, d):
    return rows(spark, "total string", [(str(names.total("abcdefghijklmnopqrstuvwxyz0123456789", 1, 20, 134)),)])


# Observations of a name by three servers in two attempts, made from suppliers.
_OBS = """obs AS (SELECT concat('s', cast(s_suppkey as string), '.example') AS fqdn, cast(a as int) AS attempt, cast(v as int) AS server,
 cast(CASE (s_suppkey * 7 + a * 3 + v * (s_suppkey % 4)) % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 2 END as int) AS rcode, cast(CASE WHEN (s_suppkey + a + v) % 11 = 0 THEN 1 ELSE 0 END as int) AS ancount FROM supplier, {seq})"""
_D_OBS = _OBS.format(seq="(SELECT unnest([1, 2]) AS a) x, (SELECT unnest([1, 2, 3]) AS v) y")
_STATUS = "CASE WHEN coalesce(bool_or(ancount > 0 OR rcode = 0), false) THEN 'registered' WHEN coalesce(bool_or(rcode = 3), false) THEN 'available' ELSE 'error' END"
_D_RETRY = f"{_D_OBS}, c AS (SELECT fqdn, attempt, {_STATUS} AS s FROM obs GROUP BY ALL), st AS (SELECT fqdn, coalesce(nullif(max(s) FILTER (attempt = 1), 'error'), max(s) FILTER (attempt = 2), 'error') AS status FROM c GROUP BY 1)"


def _observations(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("_supplier")
    body = _OBS.format(seq="(SELECT explode(array(1, 2)) AS a) x, (SELECT explode(array(1, 2, 3)) AS v) y").replace("FROM supplier", "FROM _supplier")
    return spark.sql(body[len("obs AS ("):-1])


@query(f"WITH {_D_OBS} SELECT fqdn, {_STATUS} AS status FROM obs GROUP BY 1")
def dns_classify(spark, d):
    return names.classify(_observations(spark, d), "fqdn")


@query(f"WITH {_D_RETRY} SELECT * FROM st")
def dns_retry(spark, d):
    return names.retried(_observations(spark, d))


@query(f"WITH {_D_RETRY} SELECT fqdn, unnest(CASE WHEN status = 'error' THEN ['available', 'errors', 'uncertain'] ELSE [status] END) AS target FROM st")
def dns_route_sinks(spark, d):
    return names.routed(names.retried(_observations(spark, d)))


@query(f"WITH {_D_RETRY} SELECT count(*) AS total, count(*) FILTER (status = 'registered') AS registered, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'error') AS errors, CAST(0 AS BIGINT) AS skipped FROM st")
def scan_counters(spark, d):
    return names.scan_counters(names.retried(_observations(spark, d)))


@query(f"WITH {_D_OBS}, h AS (SELECT server, bool_or(coalesce(rcode IN (0, 3), false)) AS ok FROM obs GROUP BY 1) SELECT server FROM h WHERE ok OR NOT (SELECT bool_or(ok) FROM h)")
def dns_health(spark, d):
    return names.healthy(_observations(spark, d))


V_PACKETS = [(1, "BEEF81800001000200000000036162630378797A00000100010C0C00010001000000040004010203"), (2, "00018583000100000000000001610000010001"), (3, "0001"), (4, None),
             (5, "BEEF8180000100010000000003616263036E65740000010001C00C000100010000003C000401020304"), (6, "BEEF820000000000"+"00000000")]


_WHOLE = (2, 5, 6)  # the packets that can be read to their end; heads of the others are no answers


@query(f"""WITH {values_sql('v', 'id, hex', V_PACKETS)}, n AS (SELECT id, list_transform(range(1, length(hex) + 1), lambda i: instr('123456789ABCDEF', substr(hex, i, 1))) AS x, id IN {_WHOLE} AS whole FROM v)
SELECT id, CASE WHEN whole THEN CAST(x[8] AS INTEGER) END AS rcode, CASE WHEN whole THEN CAST(x[15] * 16 + x[16] AS INTEGER) END AS ancount, CASE WHEN whole THEN (x[6] // 2) % 2 = 1 END AS truncated FROM n""")
def dns_packet_parse(spark, d):
    p = rows(spark, "id int, hex string", V_PACKETS).select("id", packets.parse_response(F.unhex("hex")).alias("r"))
    return p.select("id", "r.*")


@query("SELECT s_suppkey, '1234' || '01000001000000000000' || upper(printf('%02x', strlen('s' || s_suppkey))) || hex(encode('s' || s_suppkey)) || '07' || hex(encode('example')) || '00' || '0001' || '0001' AS packet FROM supplier")
def dns_packet_build(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.hex(packets.build_query(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")), F.lit(1), F.lit(0x1234))).alias("packet"))


V_SENT = [("a.example", "s1", 7), ("b.example", "s1", 8), ("c.example", "s2", 7), ("d.example", "s2", 9), ("e.example", None, 7)]
V_RECEIVED = [("s1", 7, 2, 3, 0), ("s1", 7, 1, 0, 1), ("s2", 7, 5, 3, 0), ("s1", 9, 1, 0, 1), (None, 7, 1, 0, 1), ("s2", 9, 4, 2, 0)]


@query(f"""WITH {values_sql('q', 'fqdn, server, qid', V_SENT)}, {values_sql('r', 'server, qid, got, rcode, ancount', V_RECEIVED)}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY server, qid ORDER BY got, rcode, ancount) = 1)
SELECT fqdn, q.server, q.qid, rcode, ancount FROM q LEFT JOIN f ON q.server = f.server AND q.qid = f.qid""")
def dns_match(spark, d):
    """Responses brought to their questions by server and number."""
    return names.matched(rows(spark, "fqdn string, server string, qid int", V_SENT), rows(spark, "server string, qid int, got int, rcode int, ancount int", V_RECEIVED))


_KEYWORDS = ["alpha", "beta", "gamma"]


@query("SELECT s_suppkey, ['alpha', 'beta', 'gamma'][CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 3 + 1 AS INTEGER)] AS keyword FROM supplier")
def site_round_robin(spark, d):
    return names.round_robin(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", _KEYWORDS)


_TEMPLATE = '<html><title>{kw} - {fqdn}</title><link rel="canonical" href="https://{fqdn}/"><h1>{kw}</h1></html>'


@query(f"SELECT s_suppkey, replace(replace({_lit(_TEMPLATE)}, '{{kw}}', s_name), '{{fqdn}}', 's' || s_suppkey || '.example') AS page FROM supplier")
def site_render(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", html.render_page(_TEMPLATE, kw=F.col("s_name"), fqdn=F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example"))).alias("page"))


@query("""WITH d AS (SELECT s_suppkey, 's' || s_suppkey || '.example' AS x FROM supplier) SELECT s_suppkey, CAST(list_reduce(list_prepend(0::hugeint, list_transform(range(1, length(x) + 1), lambda i: ascii(substr(x, i, 1))::hugeint)), lambda h, b: (h * 31 + b) % 18446744073709551616::hugeint) % 360 AS INTEGER) AS hue FROM d""")
def icon_hues(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", html.icon_hue(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example"))).alias("hue"))


@query("""SELECT fqdn, server FROM (SELECT 's' || s_suppkey || '.example' AS fqdn, '10.0.0.' || i AS server FROM supplier, range(20) r(i)) QUALIFY row_number() OVER (PARTITION BY fqdn ORDER BY md5(fqdn || '|' || server || '|0')) <= 5""")
def server_sample_k(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("fqdn"))
    return names.sampled_servers(s, [f"10.0.0.{i}" for i in range(20)], 5)


# ---------------------------------------------------------------------------------------------- crawling
V_ROBOTS = [("a.example", "User-agent: *\nDisallow: /admin\nDisallow:\n# x\nDisallow: /wiki/\n\nUser-agent: other\nDisallow: /view"), ("b.example", "User-Agent: MyCrawler\r\ndisallow: /Big\r\nUser-agent: x\r\nDisallow: /c"), ("c.example", "")]
_RULES = ["/admin", "/wiki/"]


@query(f"""WITH {values_sql('v', 'domain, body', V_ROBOTS)}, s AS (SELECT domain, regexp_split_to_array(body, '\r?\n') AS ls FROM v), l AS (SELECT domain, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS i FROM s),
g AS (SELECT *, starts_with(lower(line), 'user-agent:') AS ua, count(*) FILTER (starts_with(lower(line), 'user-agent:')) OVER (PARTITION BY domain ORDER BY i) AS g FROM l),
a AS (SELECT domain, g FROM g WHERE ua AND (trim(substr(lower(line), 12)) = '*' OR contains(lower(line), 'crawler')))
SELECT domain, trim(substr(line, 10)) AS rule FROM g SEMI JOIN a USING (domain, g) WHERE starts_with(lower(line), 'disallow:') AND trim(substr(line, 10)) <> ''""")
def robots_rules(spark, d):
    return rows(spark, "domain string, body string", V_ROBOTS).select("domain", F.explode(crawl.robots_rules(F.col("body"))).alias("rule"))


@query(f"SELECT result_id, NOT ({' OR '.join(f'starts_with({d_path(chr(117) + chr(114) + chr(108))}, {_lit(r)})' for r in _RULES)}) AS allowed FROM meta_results WHERE url IS NOT NULL")
def robots_allowed(spark, d):
    return table(spark, d, "meta_results").where("url is not null").select("result_id", crawl.allowed(F.col("url"), F.array(*[F.lit(r) for r in _RULES])).alias("allowed"))


_EDGES = "e AS (SELECT cast(doc_id as string) AS src, cast(doc_id * 2 as string) AS dst FROM documents UNION ALL SELECT cast(doc_id as string), cast(doc_id * 3 + 1 as string) FROM documents)"


@query(f"""WITH RECURSIVE {_EDGES}, w(url, depth) AS (SELECT '1', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = url WHERE depth < 5) SELECT url, min(depth) AS depth FROM w GROUP BY 1""")
def crawl_bfs(spark, d):
    docs = table(spark, d, "documents")
    e = docs.selectExpr("cast(doc_id as string) src", "cast(doc_id * 2 as string) dst").unionByName(docs.selectExpr("cast(doc_id as string) src", "cast(doc_id * 3 + 1 as string) dst"))
    return crawl.bfs(e, rows(spark, "url string", [("1",)]), 5)


@query(f"SELECT result_id, {d_domain('url')} AS domain FROM meta_results WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {d_domain('url')} ORDER BY result_id, url) <= 5")
def crawl_caps(spark, d):
    return crawl.per_domain(table(spark, d, "meta_results").where("url is not null").select("result_id", "url"), "result_id", 5).select("result_id", "domain")


V_RULES = [(x,) for x in ("; comment", "[Wildcard]", "*.Example.cn", "*.cn", "*.1.2.3.4", "*.a.*.b", " *.b.example ", "# x", "plain.example", "*.example.cn", "*.x.example/p", "*.")]


@query(f"""WITH {values_sql('v', 'value', V_RULES)}, t AS (SELECT lower(trim(substr(trim(value), 3))) AS domain FROM v WHERE starts_with(trim(value), '*.'))
SELECT DISTINCT domain FROM t WHERE contains(domain, '.') AND NOT regexp_matches(domain, '[*/]') AND NOT regexp_matches(domain, '^[0-9.]*$')""")
def whitelist_parse(spark, d):
    return crawl.whitelist(rows(spark, "value string", V_RULES))


@query(f"""WITH s AS (SELECT lower(domain) AS domain FROM doc_meta UNION SELECT {d_domain('url')} FROM meta_results), t AS (SELECT lower(regexp_replace(regexp_replace(domain, '^(?:http://)+', ''), '/+$', '')) AS domain FROM s)
SELECT DISTINCT domain FROM t WHERE domain <> '' AND domain <> '{_SITE}'""")
def seed_union(spark, d):
    return crawl.seeds(table(spark, d, "doc_meta").select(F.lower("domain")), table(spark, d, "meta_results").select(urls.domain_of(F.col("url"))), excluded=rows(spark, "domain string", [(_SITE,)]))


V_FETCH = [(1, "u1", 200, "abc"), (2, "u1", 200, "abcd"), (3, "u1", 404, "abcdefg"), (4, "u2", 301, ""), (5, "u3", None, None), (6, "u4", 200, "x")]


@query(f"WITH {values_sql('v', 'id, url, status, html', V_FETCH)} SELECT url, arg_min(html, (-length(html), html)) AS html FROM v WHERE status = 200 GROUP BY 1")
def best_body(spark, d):
    return crawl.best_body(rows(spark, "id int, url string, status int, html string", V_FETCH))


@query(f"WITH {values_sql('v', 'id, url, status, html', V_FETCH)} SELECT count(*) FILTER (status = 200) AS fetched, count(*) FILTER (status BETWEEN 300 AND 399) AS redirects, count(*) FILTER (status IS NULL OR status >= 400) AS failed FROM v")
def crawl_stats(spark, d):
    return crawl.crawl_stats(rows(spark, "id int, url string, status int, html string", V_FETCH))


# ---------------------------------------------------------------------------------------------- outside engines
@query("SELECT p.id AS engine, s.stat_id, replace(replace(p.url, '{q}', url_encode(s.query)), '{p}', '2') AS request FROM meta_providers p, query_stats s WHERE s.query IS NOT NULL")
def request_urls(spark, d):
    s = table(spark, d, "query_stats").where("query is not null")
    engines = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("url")) for r in table(spark, d, "meta_providers").select("id", "url").collect()])).alias("e")  # a handful at any scale
    return s.select("stat_id", "query", engines).select(F.col("e.id").alias("engine"), "stat_id", federate.request_url(F.col("e.url"), F.col("query"), F.lit(2)).alias("request"))


@query()
def serp_parse(spark, d):
    """Result pages made from meta_results, one a row, with the engine's noise, an advertisement and the result."""
    noise = table(spark, d, "meta_providers").select(F.col("id").alias("engine"), "noise")
    body = F.concat(F.lit('<h2><a href="/login?x">Login</a></h2><h3 class="r"><a href="http://ad.example/">Best casino 开户</a></h3><h3 class="t"><a target="_blank" href="'), F.coalesce("url", F.lit("/x")), F.lit('">'), F.coalesce("title", F.lit("")), F.lit("</a> <em>"), F.coalesce("snippet", F.lit("")), F.lit("</em></h3>"))
    p = table(spark, d, "meta_results").select("engine", F.col("result_id").alias("page"), F.lit("https://search.example/find?q=1").alias("base"), body.alias("html"))
    return federate.parse_serps(p.join(F.broadcast(noise), "engine", "left"), F.col("noise"))


_AD = f"(regexp_matches(lower(title), '{'|'.join(text.AD_MARKS)}') OR regexp_matches(lower(title), '(^|[^0-9a-z])({'|'.join(text.AD_WORDS)})([^0-9a-z]|$)'))"


@query(f"""SELECT result_id, {_AD} AS ad, regexp_matches(title, '[<>&="{{]') AS bad FROM meta_results WHERE title IS NOT NULL""")
def serp_ad_filter(spark, d):
    t = F.col("title")
    return table(spark, d, "meta_results").where("title is not null").select("result_id", text.is_ad(t).alias("ad"), text.title_bad(t).alias("bad"))


_ORDER = ["hanquan", "trigo", "veloseek", "mirasou", "orbiq", "zhicha"]
_D_MERGED = f"""m AS (SELECT url, engine, batch_id AS page, result_id AS pos, title, coalesce(list_position([{', '.join(map(_lit, _ORDER))}], engine), 1000000) AS rank FROM meta_results WHERE url IS NOT NULL),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY rank, page, pos) = 1), top AS (SELECT * FROM f ORDER BY rank, page, pos, url LIMIT 60)"""


def _merged(spark, d):
    r = table(spark, d, "meta_results").where("url is not null").select("url", "engine", F.col("batch_id").alias("page"), F.col("result_id").alias("pos"), "title")
    return federate.merge(r, _ORDER)


@query(f"WITH {_D_MERGED} SELECT url, engine, page, pos FROM top")
def serp_merge(spark, d):
    return _merged(spark, d).select("url", "engine", "page", "pos")


@query(f"""WITH {_D_MERGED} SELECT url, title FROM (SELECT *, coalesce(regexp_matches(title, '[<>&="{{]') OR contains(title, '�'), true) AS bad FROM top) ORDER BY bad, rank, page, pos, url LIMIT 10 OFFSET 50""")
def serp_page(spark, d):
    return federate.serp_page(federate.by_quality(durable(_merged(spark, d), "merged")), 99).select("url", "title")


@query("SELECT engine, count(*) AS n FROM meta_results WHERE engine IS DISTINCT FROM 'trigo' GROUP BY 1")
def engines_enabled(spark, d):
    return federate.enabled(table(spark, d, "meta_results"), rows(spark, "engine string, enabled boolean", [("trigo", False), ("orbiq", True)])).groupBy("engine").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT url FROM meta_results WHERE url <> '' AND url NOT IN (SELECT url FROM doc_meta WHERE url IS NOT NULL)")
def ingest_queue(spark, d):
    return federate.to_queue(table(spark, d, "meta_results"), table(spark, d, "doc_meta").select("url"))


@query("SELECT result_id AS id, title FROM meta_results WHERE title IS NOT NULL")
def federated_fallback(spark, d):
    local = _index(spark, d).search("zzzzunknownword").select(F.col("doc_id").alias("id"), "title")
    return search.with_fallback(local, table(spark, d, "meta_results").where("title is not null").select(F.col("result_id").alias("id"), "title"))


# ---------------------------------------------------------------------------------------------- counters, logs, streams
_Q = f"lower({d_strip('query')})"


@query(f"SELECT {_Q} AS query, count(*) AS n FROM query_log WHERE {_Q} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_queries(spark, d):
    return stats.top_queries(table(spark, d, "query_log"), 20)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM query_log WHERE ts IS NOT NULL GROUP BY 1")
def daily_searches(spark, d):
    return stats.daily(table(spark, d, "query_log"))


@query("SELECT count(*) AS samples, coalesce(CAST(sum(latency_ms) AS BIGINT), 0) AS total_ms, coalesce(round(avg(latency_ms), 6), 0) AS mean_ms FROM query_log WHERE latency_ms >= 0")
def latency_avg(spark, d):
    return stats.latency(table(spark, d, "query_log"))


@query("SELECT count(*) FILTER (from_cache) AS hits, count(*) FILTER (NOT from_cache) AS misses, coalesce(round(count(*) FILTER (from_cache) / nullif(count(*) FILTER (from_cache) + count(*) FILTER (NOT from_cache), 0), 6), 0) AS rate FROM query_log")
def hit_rate(spark, d):
    return stats.hit_rate(table(spark, d, "query_log"))


@query("SELECT engine, count(*) AS n FROM query_log WHERE engine IS NOT NULL GROUP BY 1")
def engine_counts(spark, d):
    return stats.engine_counts(table(spark, d, "query_log"))


@query(f"SELECT {_Q} AS query, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits, count(*) AS rows FROM query_stats WHERE {_Q} <> '' GROUP BY 1")
def merged_counters(spark, d):
    return stats.merged_counters(table(spark, d, "query_stats"))


@query("SELECT log_id, ts, query FROM (SELECT DISTINCT log_id, ts, query FROM query_log) QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY ts, query) = 1")
def first_delivery(spark, d):
    return stats.first_seen(table(spark, d, "query_log").select("log_id", "ts", "query"), "log_id", ["ts"])


def _d_cache(key: str, ttl: str, where: str = "true") -> str:
    """Rows that put an entry, by recursion from one to the first request after its time; all others are hits."""
    return f"""WITH RECURSIVE e AS (SELECT * FROM events WHERE {where}), p AS (SELECT {key}, min(ts) AS ts FROM e GROUP BY ALL UNION ALL SELECT {key}, min(e.ts) AS ts FROM p JOIN (SELECT {key}, ts FROM e) e USING ({key}) WHERE e.ts > p.ts + INTERVAL {ttl} GROUP BY ALL),
q AS (SELECT min(event_id) AS event_id FROM e JOIN p USING ({key}, ts) GROUP BY {key}, ts)"""


@query(f"{_d_cache('user_id, event_type', '6 HOUR')} SELECT event_id, ts, user_id, event_type, event_id NOT IN (SELECT event_id FROM q) AS hit FROM e")
def cache_ttl_hits(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return stats.cache_hits(e, ["user_id", "event_type"], "ts", "event_id", 6 * 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""{_d_cache('user_id', '300 SECOND', "event_type = 'error'")} SELECT event_id, ts, user_id, event_id NOT IN (SELECT event_id FROM q) AS suppressed FROM e""")
def fail_suppression_300s(spark, d):
    """Errors of each user: one within 300 s of the last that counted is suppressed."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return stats.cache_hits(e, ["user_id"], "ts", "event_id", 300).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("hit", "suppressed")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def log_tail(spark, d):
    e = table(spark, d, "events")
    return stats.tail(e, "event_id", e.agg(F.max("event_id")).first()[0] - 100).select("event_id", "event_type")


V_TASKS = [("a", True, 60, 0, 100), ("b", True, 60, 50, 100), ("c", False, 30, 0, 100), ("d", True, 50, 50, 100), ("e", True, None, 0, 100)]


@query(f"WITH {values_sql('v', 'id, enabled, interval_secs, last_run, now', V_TASKS)} SELECT id FROM v WHERE enabled AND now - last_run >= interval_secs")
def due_tasks(spark, d):
    return stats.due(rows(spark, "id string, enabled boolean, interval_secs long, last_run long, now long", V_TASKS)).select("id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS start, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def window_sliding(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "3 hours", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def window_session(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"SELECT {_Q} AS query, count(*) AS n FROM query_log WHERE {_Q} <> '' GROUP BY 1")
def stream_counts(spark, d):
    from pagemill.streaming.counters import counts_of_files

    schema = table(spark, d, "query_log").schema
    import os

    path = f"{d}/query_log.parquet"  # a folder of files, or one file: a stream wants a folder or a pattern
    return counts_of_files(spark, path if os.path.isdir(path) else f"{d}/query_log.parque[t]", schema, new_path(spark, "stream"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def json_props(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", values.json_get(p, "$.k", "bigint").alias("k"), values.json_valid(p).alias("valid"))


V_JSON = [(1, '{"a": 1, "b": [true, null]}', True), (2, "{", False), (3, "[1,]", False), (4, '"x"', True), (5, "1 2", False), (6, "nul", False), (7, '{"a": 01}', False), (8, None, False), (9, '{"a" 1}', False), (10, "-1.5e3", True)]


@query(f"WITH {values_sql('v', 'id, raw, valid', V_JSON)} SELECT id, coalesce(json_valid(raw) AND NOT regexp_matches(raw, ',\\s*[]}}]'), false) AS valid FROM v")
def json_validate(spark, d):
    return rows(spark, "id int, raw string, valid boolean", V_JSON).select("id", values.json_valid(F.col("raw")).alias("valid"))


V_BOOLS = [(x,) for x in ("true", " 1", "YES", "on", "false", "0", "No", "off", "", "maybe")]


@query(f"WITH {values_sql('v', 'raw', V_BOOLS)} SELECT raw, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no', 'off', '') THEN false END AS value FROM v")
def parse_bools(spark, d):
    return rows(spark, "raw string", V_BOOLS).select("raw", values.parse_bool(F.col("raw")).alias("value"))


@query("SELECT hit_id, CAST(served_at AS DATE) AS day FROM search_hits WHERE served_at IS NOT NULL")
def epoch_dates(spark, d):
    h = table(spark, d, "search_hits").where("served_at is not null")
    return h.select("hit_id", values.date_of(F.floor(F.unix_micros(F.col("served_at").cast("timestamp")) / 1_000_000)).alias("day"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Extract, index, score, fold and rank: the query 'linen sofa' over the documents of a table."""
    return _tenths(search.page(_index(spark, d).search("Linen sofa")))
