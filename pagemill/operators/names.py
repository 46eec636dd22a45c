"""Names and their observations (FN-14, JOIN-3, JOIN-9, JOIN-11, FLT-1, FLT-15, AGG-9 to AGG-11, AGG-15, SNK-3, WIN-3, WIN-4)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def names(spark: SparkSession, charset: str, shortest: int, longest: int) -> DataFrame:
    """(length, id, name): all words over a set of characters, in the order of a counter of mixed radix for each length.

    Each length is a range whose numbers are written in base ``len(charset)``: generated in parallel, nothing is shuffled.
    A length whose count exceeds a LONG is an error.
    """
    base, parts = len(charset), None
    for n in range(shortest, longest + 1):
        if base**n >= 2**63:
            raise ValueError(f"{base}**{n} names don't fit a LONG range")
        digits = [F.substr(F.lit(charset), (F.expr(f"id div {base ** k}") % base + 1).cast("int"), F.lit(1)) for k in range(n - 1, -1, -1)]
        part = spark.range(base**n).select(F.lit(n).alias("length"), "id", F.concat(*digits).alias("name"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def total(charset: str, shortest: int, longest: int, tlds: int) -> Decimal:
    """How many full names there are: exact, beyond a LONG."""
    return Decimal(sum(len(charset) ** n for n in range(shortest, longest + 1)) * tlds)


def with_tlds(name: DataFrame, tlds: DataFrame) -> DataFrame:
    """(length, id, name, tld_pos, fqdn): each name with each entry of a list of at most a few hundred, repeated entries included."""
    entries = [tuple(r) for r in tlds.select("pos", "tld").orderBy("pos").collect()]
    listed = F.array(*[F.struct(F.lit(p).cast("int").alias("pos"), F.lit(t).alias("tld")) for p, t in entries])
    return name.select("length", "id", "name", F.explode(listed).alias("t")).select("length", "id", "name", F.col("t.pos").alias("tld_pos"), F.concat("name", F.lit("."), "t.tld").alias("fqdn"))


def blocked(fqdn: Column, fragments: list[str]) -> Column:
    """Whether a name holds any of the fragments; empty ones are ignored."""
    kept = [f for f in fragments if f]
    return F.exists(F.array(*[F.lit(f) for f in kept]), lambda f: fqdn.contains(f)) if kept else F.lit(False)


def classify(observations: DataFrame, *keys: str) -> DataFrame:
    """(keys, status) of (fqdn, rcode, ancount) observations: an answer or no error anywhere: registered; else a denial: available; else error."""
    some = F.coalesce(F.bool_or((F.col("ancount") > 0) | (F.col("rcode") == 0)), F.lit(False))
    none = F.coalesce(F.bool_or(F.col("rcode") == 3), F.lit(False))
    return observations.groupBy(*keys).agg(some.alias("_r"), none.alias("_n")).select(*keys, F.when(F.col("_r"), "registered").when(F.col("_n"), "available").otherwise("error").alias("status"))


def matched(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(fqdn, qid, rcode, ancount) of each question (fqdn, server, qid): its first response (server, qid, got, rcode, ancount), null where none came.

    A response is that of a question only if server and number are; others (late, forged) match nothing.  Nulls match nothing.
    """
    first = received.groupBy("server", "qid").agg(F.min(F.struct("got", "rcode", "ancount")).alias("r"))
    return sent.join(first, ["server", "qid"], "left").select("fqdn", "server", "qid", "r.rcode", "r.ancount")


def retried(observations: DataFrame) -> DataFrame:
    """(fqdn, status) where the second attempt counts if the first was an error."""
    each = classify(observations, "fqdn", "attempt").groupBy("fqdn").agg(F.max(F.when(F.col("attempt") == 1, F.col("status"))).alias("v1"), F.max(F.when(F.col("attempt") == 2, F.col("status"))).alias("v2"))
    return each.select("fqdn", F.coalesce(F.nullif("v1", F.lit("error")), "v2", F.lit("error")).alias("status"))


def routed(status: DataFrame) -> DataFrame:
    """(fqdn, target): where each verdict is written; an error goes to three places."""
    to = F.when(F.col("status") == "error", F.array(F.lit("available"), F.lit("errors"), F.lit("uncertain"))).otherwise(F.array("status"))
    return status.select("fqdn", F.explode(to).alias("target"))


def write_routed(status: DataFrame, path: str) -> None:
    """A text folder for each target."""
    routed(status).select("target", F.col("fqdn").alias("value")).write.mode("overwrite").partitionBy("target").text(path)


def scan_counters(status: DataFrame, skipped: int = 0) -> DataFrame:
    s = F.col("status")
    return status.agg(F.count("*").alias("total"), F.count_if(s == "registered").alias("registered"), F.count_if(s == "available").alias("available"), F.count_if(s == "error").alias("errors"), F.lit(skipped).cast("long").alias("skipped"))


def healthy(probes: DataFrame) -> DataFrame:
    """Servers that answered with no error or a denial; all of them if none did."""
    marked = probes.select("server", F.coalesce(F.col("rcode").isin(0, 3), F.lit(False)).alias("ok")).groupBy("server").agg(F.bool_or("ok").alias("ok"))
    good = marked.where("ok").limit(1).select(F.lit(True).alias("_ok"))
    return marked.where("ok").select("server").unionByName(marked.withColumn("_ok", F.lit(True)).join(good, "_ok", "left_anti").select("server"))


def sampled_servers(fqdn: DataFrame, servers: list[str], k: int, seed: int = 0) -> DataFrame:
    """(fqdn, server): ``k`` servers of each name in the order of a hash, from a list of a few hundred."""
    ranked = F.array_sort(F.transform(F.array(*[F.lit(s) for s in servers]), lambda s: F.struct(F.md5(F.concat_ws("|", F.col("fqdn"), s, F.lit(str(seed)))).alias("h"), s.alias("s"))))
    return fqdn.select("fqdn", F.explode(F.slice(ranked, 1, k)).alias("x")).select("fqdn", F.col("x.s").alias("server"))


def round_robin(df: DataFrame, order: str, keywords: list[str]) -> DataFrame:
    """``df`` with the keyword that a counter over ``order`` gives: (rank - 1) mod n.

    Ranks come from counts by range of ``order``, summed up, and ranks within a range: no task sees more than its range.
    """
    n = df.sparkSession.sparkContext.defaultParallelism * 4
    parted = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    from pagemill.plans.durable import durable

    parted = durable(parted, "ranges")
    counts = parted.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    place = (F.col("_before") + F.col("_r")) % len(keywords)
    return local.join(F.broadcast(counts.drop("count")), "_p").withColumn("keyword", F.element_at(F.array(*[F.lit(k) for k in keywords]), (place + 1).cast("int"))).drop("_p", "_r", "_before")
