"""Checking new batches against all that was accepted before (problem 3)."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import bands
from pagemill.llm.forest import clean
from pagemill.llm.format_dups import codes, url_fields
from pagemill.plans.durable import durable, new_path
from pagemill.plans.greedy import OPEN, STAYS, decide
from pagemill.plans.skew import lookup

#: Titles whose keys a task sorts.
_BLOCK = 8192


@dataclass
class Shard:
    """Accepted titles (id, title) at ``path``; ``routed``: they are met by their keys, in a shard of any size."""

    path: str
    titles: int
    level: int = 0
    routed: bool = True

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, title string").parquet(self.path)


class History:
    """What has been accepted so far, kept at ``path``: keys of addresses, and shards of title graphs.  ``add`` checks and takes in a batch.

    *Titles.*  Each batch makes a shard of the titles it adds, in files of about ``segment``; when ``fanout`` shards of a level have come together, they are
    compacted into one of the next level.  Only accepted titles are kept, of which no two are near, so no crowd can form.  Two titles meet where they share one of
    ``bands.BANDS`` keys; what may be near by a filter that loses none is checked exactly.  Whether two titles meet depends on these two alone, not on how many
    there are or in which shards or additions they are; of pairs at a similarity of 0.6 0.00014 don't, of nearer ones fewer.

    *Addresses.*  A table of 128-bit keys in buckets of their own: a batch is brought to the buckets, the history isn't shuffled.  After 16 additions
    the files of each bucket are merged, and buckets are added as the table grows.

    Every state is complete before ``versions`` names it, so ``History.open`` in another session goes on where the last ``add`` ended.
    Titles of one batch are told apart by 63-bit hashes, addresses by 128 bits.  ``few`` told large shards from small ones once; nothing depends on it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, threshold: float = 0.6, least: int = 20, segment: int = 16_384, fanout: int = 4, few: int = 16, buckets: int = 8):
        self.spark, self.path = spark, path or new_path(spark, "history")
        self.options = {"threshold": threshold, "least": least, "segment": segment, "fanout": fanout, "few": few, "buckets": buckets}
        self.shards: list[Shard] = []
        self.urls: dict | None = None  # path, buckets, parts (one for each addition), rows
        self.version = 0

    def __getattr__(self, name: str):
        if name != "options" and name in self.options:
            return self.options[name]
        raise AttributeError(name)

    # ------------------------------------------------------------------------------------------------------------ state
    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history at ``path`` as its last complete ``add`` left it."""
        last = spark.read.schema("version long, state string").json(f"{path}/versions").orderBy(F.desc("version")).first()
        state = json.loads(last["state"])
        h = cls(spark, path, **state["options"])
        h.version, h.urls, h.shards = last["version"], state["urls"], [Shard(**s) for s in state["shards"]]
        return h

    def _publish(self) -> None:
        self.version += 1
        state = json.dumps({"options": self.options, "urls": self.urls, "shards": [asdict(s) for s in self.shards]})
        self.spark.createDataFrame([(self.version, state)], "version long, state string").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def _new(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    # -------------------------------------------------------------------------------------------------------- addresses
    def _table(self) -> str:
        """The name under which this session knows the table of addresses."""
        name = "history_" + self.urls["path"].rsplit("-", 1)[-1]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (x BIGINT, y BIGINT, aid BIGINT, part STRING) USING parquet CLUSTERED BY (x) INTO {self.urls['buckets']} BUCKETS LOCATION '{self.urls['path']}'")
        return name

    def _urls(self) -> DataFrame:
        """(x, y, aid) of the additions that a version names: what a failed ``add`` left behind isn't read."""
        return self.spark.table(self._table()).where(F.col("part").isin(self.urls["parts"])).select("x", "y", "aid")

    def _known_urls(self, asked: DataFrame) -> DataFrame | None:
        """(u, hu) of the keys ``u`` that are in the history; only these rows leave its buckets."""
        if not self.urls:
            return None
        keys = asked.select("u.x", F.col("u.y").alias("_y")).distinct()
        # the second half is compared by a difference, so that the bucket's column alone is the key of the join
        return self._urls().join(keys, "x").where("(y ^ _y) = 0").select(F.struct("x", "y").alias("u"), F.col("aid").alias("hu"))

    def _add_urls(self, new: DataFrame, n: int) -> None:
        """Append ``n`` rows (x, y, aid), one file for each bucket."""
        if not self.urls:
            self.urls = {"path": self._new("urls"), "buckets": self.buckets, "parts": [], "rows": 0}
        old, part = self._urls(), uuid.uuid4().hex
        self.urls = self.urls | {"parts": [*self.urls["parts"], part], "rows": self.urls["rows"] + n}
        if len(self.urls["parts"]) > 16:
            grown = self.buckets
            while grown * 4_000_000 < self.urls["rows"]:
                grown *= 2
            self.urls = {"path": self._new("urls"), "buckets": grown, "parts": [part], "rows": self.urls["rows"]}
            new = old.unionByName(new)
        new.select("x", "y", "aid", F.lit(part).alias("part")).repartition(self.urls["buckets"], "x").write.insertInto(self._table())

    # ----------------------------------------------------------------------------------------------------------- titles
    def _shard(self, titles: DataFrame, n: int, level: int = 0) -> Shard:
        """Write a shard of ``n`` titles (id, title)."""
        path = self._new("shard")
        titles.select("id", "title").repartition(max(1, min(10_000, -(-n // self.segment))), "id").write.option("compression", "zstd").parquet(path)
        return Shard(path, n, level)

    def _search(self, titles: DataFrame, n: int, known: DataFrame | None = None, m: int = 0, *, most: int = 0) -> tuple[DataFrame, int, bool]:
        """(tid, found): the ids of the ``m`` titles ``known`` (id, title) that each of ``n`` titles (tid, title) is near; the most rows that share an id; if that is all.

        Without ``known`` the smaller tids it is near, of each key the ``most`` smallest that may be; where there may be more, found is null in a last row.
        """
        rows = titles.select(F.lit(True).alias("asked"), F.col("tid").alias("id"), "title")
        others = titles.select(F.col("tid").alias("id"), "title") if known is None else known
        if known is not None:
            rows = rows.unionByName(known.select(F.lit(False).alias("asked"), "id", "title"))
        tasks = max(1, -(-(n + m) // _BLOCK))
        entries = rows.repartition(tasks, "id").mapInArrow(bands.spread, "part int, asked boolean, entries binary")
        met = entries.repartition(min(bands.PARTS, tasks), "part").mapInArrow(bands.meet(self.threshold, most), "tid long, found long")
        met = durable(met.distinct(), "met")
        ids = met.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("tid").alias("id")), F.struct(F.lit(1).alias("side"), F.col("found").alias("id")))).alias("k"))
        crowd, more = ids.groupBy("k").count().agg(F.max(F.when(F.col("k.id").isNotNull(), F.col("count"))), F.max(F.col("k.id").isNull())).first()
        crowd = crowd or 0
        pairs = met.where("found is not null").join(titles.select("tid", F.col("title").alias("_ta")), "tid")
        pairs = lookup(pairs, others.select(F.col("id").alias("found"), F.col("title").alias("_tb")), "found", F.col("tid"), "inner", crowd)
        near = pairs.select("tid", "found", "_ta", "_tb").mapInArrow(bands.verified(self.threshold), "tid long, found long")
        return durable(near.unionByName(met.where("found is null")) if most else near, "found"), crowd, not more

    def _compact(self) -> None:
        level = 0
        while len(same := [s for s in self.shards if s.level == level]) >= self.fanout:
            merged = self._shard(reduce(DataFrame.unionByName, [s.rows(self.spark) for s in same]), sum(s.titles for s in same), level + 1)
            self.shards = [s for s in self.shards if s.level != level] + [merged]
            level += 1

    # -------------------------------------------------------------------------------------------------------------- add
    def add(self, new: DataFrame, key: str, url: str, title: str) -> DataFrame:
        """(first_id, key): the rows of a batch that repeat an accepted row, and the smallest one they repeat.

        Rows are taken by key.  Rows with a null key are left out; a null, empty or short title and an address without letter or digit before
        its ``?`` repeat nothing; repeated rows are one.  Rows that share address and title are one class, of which only the first can be accepted.

        First the history is asked, by address and title.  The classes it doesn't know are compared with each other in waves: each title's
        first partners before it are searched in the batch, ``decide`` settles all that is certain from them, and what is still open is compared with
        the titles accepted so and goes into the next wave with more partners.  The first open title is always settled, and nearly all are in the first wave.
        Only if a title had more partners than the first wave took are the accepted titles searched again; else that wave's pairs are all there are.
        """
        c = codes(url_fields(F.col(url)))
        u = F.struct(F.get(c, F.lit(0)).alias("x"), F.xxhash64(F.lit("tail"), c).alias("y"))
        t = clean(F.col(title))
        rows = new.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("i"), F.when(c.isNotNull(), u).alias("u"), F.when(F.length(t) >= max(1, self.least), t).alias("title"))
        rows = rows.withColumn("tid", F.when(F.col("title").isNotNull(), F.xxhash64("title").bitwiseAND(F.lit(2**63 - 1)))).where("u is not null or tid is not null")
        rows = durable(rows.withColumn("ck", F.struct(F.coalesce("u.x", F.lit(0)).alias("x"), F.coalesce("u.y", F.lit(0)).alias("y"), F.coalesce("tid", F.lit(-1)).alias("t"))), "rows")
        classes = durable(rows.groupBy("ck").agg(F.min("i").alias("cid"), F.first("u").alias("u"), F.first("tid").alias("tid")), "classes")
        named = rows.where("tid is not null").groupBy("tid").agg(F.min("title").alias("title"))
        titles = durable(named, "titles")
        shared = F.array("u", F.when(F.col("tid").isNotNull(), F.struct(F.col("tid").alias("x"), F.lit(None).cast("long").alias("y"))))
        shared = rows.select(F.explode(shared).alias("k")).where("k is not null").groupBy("k").count()
        # the most rows that share an address or a title, and so of a class
        crowd, count = shared.agg(F.max("count"), F.count(F.when(F.col("k.y").isNull(), 1))).first()
        crowd = crowd or 0
        none = F.lit(None).cast("long")
        known = self._known_urls(rows.where("u is not null"))
        classes = lookup(classes, known, "u", F.col("cid"), crowd=crowd) if known is not None else classes.withColumn("hu", none)
        found = None
        if count and self.shards:
            history = reduce(DataFrame.unionByName, [s.rows(self.spark) for s in self.shards])
            found = self._search(titles, count, history, sum(s.titles for s in self.shards))[0].groupBy("tid").agg(F.min("found").alias("ht"))
        classes = lookup(classes, found, "tid", F.col("cid"), crowd=crowd) if found is not None else classes.withColumn("ht", none)
        classes = durable(classes.select("cid", "ck", "u", "tid", F.least("hu", "ht").alias("h")), "classes")

        todo = classes.where("h is null").select("cid", "u", "tid")
        accepted: list[DataFrame] = []
        counted: list[list] = []  # of each wave: the least cid accepted, classes, titles, addresses
        pairs: DataFrame | None = None
        whole, most, met = None, 32, 0
        while True:
            state, found, those, all_ = self._wave(todo, titles, most, crowd)
            if whole is None:
                pairs, met, whole = found, those, all_
            left = durable(todo.join(state.where(F.col("s").isin(STAYS, OPEN)), "cid").select("cid", "u", "tid", "s"), "left")
            stays, rest = (left.where(F.col("s") == x).drop("s") for x in (STAYS, OPEN))
            accepted.append(stays)
            mine = F.col("s") == STAYS
            some, *bounds = left.agg(F.count(F.when(~mine, 1)), F.min(F.when(mine, F.col("cid"))), *(F.count(F.when(mine, F.col(c))) for c in ("cid", "tid", "u"))).first()
            counted.append(bounds)
            if not some:
                break
            gone = stays.where("u is not null").select("u").distinct().withColumn("gu", F.lit(True))
            rest = lookup(rest, gone, "u", F.col("cid"), crowd=crowd)
            rest = lookup(rest, self._partners(rest, stays, titles, pairs if whole else None, met).withColumnRenamed("aid", "gt"), "tid", F.col("cid"), crowd=crowd)
            todo = durable(rest.where("gu is null and gt is null").select("cid", "u", "tid"), "todo")
            most *= 4

        taken = reduce(DataFrame.unionByName, accepted)
        low, *bounds = zip(*counted)
        bounds = [min((x for x in low if x is not None), default=None), *map(sum, bounds)]
        # who repeats what: rows the history knows need the batch only where it has smaller ids
        asks = classes.join(taken.select("cid"), "cid", "left_anti").where(F.col("h").isNull() | (F.col("h") > F.lit(bounds[0])))
        first = classes.where("h is not null").select("cid", F.col("h").alias("first"))
        if bounds[1]:
            asks = durable(asks.select("cid", "u", "tid"), "asks")
            by_url = lookup(asks, taken.where("u is not null").groupBy("u").agg(F.min("cid").alias("aid")), "u", F.col("cid"), "inner", crowd)
            first = first.unionByName(by_url.where("aid < cid").select("cid", F.col("aid").alias("first")))
            whole = whole and not classes.where(F.col("h") > F.lit(bounds[0])).take(1)  # the waves' pairs are of titles the history doesn't know
            hit = self._partners(asks, taken, titles, pairs if whole else None, met)
            first = first.unionByName(lookup(asks, hit, "tid", F.col("cid"), "inner", crowd).where("aid < cid").select("cid", F.col("aid").alias("first")))
        known = classes.join(first.groupBy("cid").agg(F.min("first").alias("first")), "cid", "left").select("ck", "cid", "first")
        out = lookup(rows.select("i", "ck"), known, "ck", F.col("i"), "inner", crowd)
        out = out.select(F.when(F.col("i") == F.col("cid"), F.col("first")).otherwise(F.coalesce("first", "cid")).alias("first_id"), F.col("i").alias(key))
        out = durable(out.where("first_id is not null").distinct(), "repeats")

        if bounds[1]:
            self._add_urls(taken.where("u is not null").select("u.x", "u.y", F.col("cid").alias("aid")), bounds[3])
        if bounds[1] and bounds[2]:
            self.shards.append(self._shard(titles.join(taken.where("tid is not null").select("tid", F.col("cid").alias("id")), "tid"), bounds[2]))
        self._compact()
        self._publish()
        return out

    def _partners(self, asks: DataFrame, taken: DataFrame, titles: DataFrame, pairs: DataFrame | None, met: int) -> DataFrame:
        """(tid, aid): the smallest of the accepted classes ``taken`` whose title is near one of ``asks``; by ``pairs`` (tid, found) if they are all there are, ``met`` at most with the same id on a side."""
        asked, have = asks.where("tid is not null").select("tid").distinct(), taken.where("tid is not null").select("tid", F.col("cid").alias("id"))
        if pairs is not None:
            both = pairs.unionByName(pairs.select(F.col("found").alias("tid"), F.col("tid").alias("found"))).unionByName(asked.select("tid", F.col("tid").alias("found")))
            near = lookup(both, have.withColumnRenamed("tid", "found"), "found", F.col("tid"), "inner", 2 * met + 1)
            return near.groupBy("tid").agg(F.min("id").alias("aid"))
        asked, known = durable(titles.join(asked, "tid", "left_semi"), "asked"), durable(titles.join(have, "tid").select("id", "title"), "known")
        return self._search(asked, asked.count(), known, known.count())[0].groupBy("tid").agg(F.min("found").alias("aid"))

    def _wave(self, todo: DataFrame, titles: DataFrame, most: int, crowd: int) -> tuple[DataFrame, DataFrame | None, int, bool]:
        """(cid, s) of classes (cid, u, tid) that the history doesn't know, from their ``most`` first partners; the pairs (tid, found) of titles, the most with the same id, and if these are all.

        At most ``crowd`` classes share an address or a title.

        A title speaks and is heard through its first class here; its other classes go with it or stay open.
        """
        ranks = todo.where("tid is not null").groupBy("tid").agg(F.min("cid").alias("rank"))
        first = durable(titles.join(ranks, "tid").select(F.col("rank").alias("tid"), F.col("tid").alias("_t"), "title"), "firsts")
        n = first.count()
        mine = lookup(todo, first.select(F.col("_t").alias("tid"), F.col("tid").alias("rank")), "tid", F.col("cid"), crowd=crowd)
        by_url = mine.where("u is not null").select("cid", "u.x", "u.y", F.lit(True).alias("pub"), F.lit(False).alias("more"))
        zero = F.lit(0).cast("long").alias("y")
        # every class has an entry, and so a state: that of its title, or of its address alone
        by_title = mine.where("rank is not null").select("cid", F.col("rank").alias("x"), zero, F.lit(True).alias("pub"), (F.col("rank") < F.col("cid")).alias("more"))
        heard = by_url.unionByName(by_title)
        pairs, met, whole = None, 0, True
        if n > 1:
            edges, met, whole = self._search(first, n, most=most)
            partners = edges.select(F.col("tid").alias("cid"), F.coalesce("found", F.lit(-1)).alias("x"), F.when(F.col("found").isNull(), 1).otherwise(0).cast("long").alias("y"), F.lit(False).alias("pub"), F.col("found").isNull().alias("more"))
            heard = heard.unionByName(partners.distinct())
            named = first.select(F.col("tid").alias("found"), F.col("_t").alias("_f"))
            pairs = durable(lookup(edges.join(first.select("tid", "_t"), "tid"), named, "found", F.col("tid"), crowd=met).select(F.col("_t").alias("tid"), F.col("_f").alias("found")), "pairs")
        return decide(durable(heard, "heard")), pairs, met, whole


def repeats(df: DataFrame, batch: str, key: str, url: str, title: str, *, together: int = 65_536, **options) -> DataFrame:
    """(first_id, key) of a whole table: its batches, null first, are added to a new history one after the other.

    Following batches are taken together until they hold ``together`` rows, where their keys ascend from batch to batch: then the order by key is that by
    batch and key, so the result is that of adding each by itself, with fewer small jobs.
    """
    history = History(df.sparkSession, **options)
    b = F.col(batch).cast("long")
    sizes = df.where(F.col(key).isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    groups: list[list] = []
    for x in sorted(sizes, key=lambda x: (x["b"] is not None, x["b"])):
        if groups and sum(y["n"] for y in groups[-1]) < together and groups[-1][-1]["high"] < x["low"]:
            groups[-1].append(x)
        else:
            groups.append([x])
    found = [history.add(df.where(reduce(lambda p, q: p | q, [b.eqNullSafe(F.lit(x["b"]).cast("long")) for x in g])), key, url, title) for g in groups]
    return reduce(DataFrame.unionByName, found) if found else df.select(F.col(key).cast("long").alias("first_id"), F.col(key).cast("long").alias(key)).limit(0)
