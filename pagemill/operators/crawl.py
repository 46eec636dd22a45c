"""Link graphs and crawls over tables of pages (JOIN-10, FLT-8, FLT-13, WIN-2, SNK-6, SRC-17, SRC-18, AGG-16, AGG-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.urls import domain_of, seed_domain, url_path
from pagemill.operators.dedup import excluding
from pagemill.plans.durable import durable


def robots_rules(body: Column) -> Column:
    """Disallowed prefixes of the groups for ``*`` or a crawler; each user-agent line starts a group anew."""
    lines = F.transform(F.split(body, r"\r?\n"), F.trim)
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rules"))

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        agent = F.trim(F.substring(low, 12, 10_000))
        rule = F.trim(F.substring(line, 10, 10_000))
        on = F.when(low.startswith("user-agent:"), (agent == "*") | agent.contains("crawler")).otherwise(acc["on"])
        add = low.startswith("disallow:") & acc["on"] & (rule != "")
        return F.struct(on.alias("on"), F.when(add, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]).alias("rules"))

    return F.aggregate(lines, start, step)["rules"]


def allowed(url: Column, rules: Column) -> Column:
    """Whether no rule is a prefix of the address's path."""
    return ~F.exists(rules, lambda r: url_path(url).startswith(r))


def whitelist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Domains of ``*.domain`` lines: without comments, sections, wildcards, paths, bare endings and numbers; each once, sorted."""
    t = F.trim(F.col(column))
    d = F.lower(F.trim(F.substring(t, 3, 10_000)))
    kept = lines.where(t.startswith("*.")).select(d.alias("domain"))
    return kept.where((F.col("domain") != "") & ~F.col("domain").rlike(r"[*/]") & F.col("domain").contains(".") & ~F.col("domain").rlike(r"^[0-9.]*$")).distinct().orderBy("domain")


def discovered(edges: DataFrame, src: str = "src_url", dst: str = "dst_url") -> DataFrame:
    """Foreign domains that pages lead to, sorted."""
    d = edges.select(domain_of(F.col(src)).alias("s"), domain_of(F.col(dst)).alias("domain"))
    return d.where(F.col("domain").isNotNull() & ~F.col("domain").eqNullSafe(F.col("s"))).select("domain").distinct().orderBy("domain")


def seeds(*sources: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Distinct domains of all sources, without the excluded ones."""
    from pagemill.operators.dedup import union_all

    found = union_all(*[s.select(seed_domain(F.col(s.columns[0])).alias("domain")) for s in sources]).where("domain <> ''").distinct()
    return found if excluded is None else excluding(found, "domain", excluded, "domain")


def per_domain(urls: DataFrame, order: str, cap: int) -> DataFrame:
    """The first ``cap`` addresses of each domain; the window limit cuts every task's share before the shuffle."""
    ranked = urls.withColumn("domain", domain_of(F.col("url"))).withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy(order, "url")))
    return ranked.where(F.col("_r") <= cap).drop("_r")


def bfs(edges: DataFrame, start: DataFrame, depth: int, *, cap_per_domain: int | None = None, most: int | None = None) -> DataFrame:
    """(url, depth): addresses reachable in at most ``depth`` steps, level by level; each level is written once, so lineage stays short.

    Order within a level is by address; caps count levels before it.  Edges are (src, dst); nulls lead nowhere.
    """
    frontier = durable(start.select("url", F.lit(0).alias("depth")).where("url is not null").distinct(), "level")
    seen = frontier
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).where("url is not null").distinct()
        new = step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        if cap_per_domain is not None:
            dom = domain_of(F.col("url")).alias("_d")
            used = seen.groupBy(dom).agg(F.count("*").alias("_u"))
            ranked = new.withColumn("_d", domain_of(F.col("url"))).withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy("url"))).where(F.col("_r") <= cap_per_domain)
            new = ranked.join(used, "_d", "left").where(F.col("_r") + F.coalesce("_u", F.lit(0)) <= cap_per_domain).select("url", "depth")
        if most is not None:
            new = new.orderBy("url").limit(max(0, most - seen.count()))
        frontier = durable(new, "level")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def best_body(fetches: DataFrame) -> DataFrame:
    """(url, html): the longest body with status 200 of each address; among equals the smallest."""
    ok = fetches.where("status = 200").select("url", F.struct((-F.length("html")).alias("n"), F.col("html").alias("html")).alias("b"))
    return ok.groupBy("url").agg(F.min("b").alias("b")).select("url", "b.html")


def crawl_stats(fetches: DataFrame) -> DataFrame:
    s = F.col("status")
    return fetches.agg(F.count_if(s == 200).alias("fetched"), F.count_if(s.between(300, 399)).alias("redirects"), F.count_if(s.isNull() | (s >= 400)).alias("failed"))
