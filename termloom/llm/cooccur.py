"""Items that appear together: an incremental table of pair counts.

A store keeps, as Parquet below one folder, the current baskets, pair counts, item counts and the
members of hot baskets, each in hash buckets. A change (new contents of some baskets) emits signed
deltas, -1 for every pair and item of the old contents and +1 for the new ones. Deltas are summed, and
only the buckets they fall into are read, merged and written again; a table of paths says where each
bucket stands, so all others stay as they are. ``scores`` computes association from the counts,
``affected`` only that of pairs whose counts or items the last change moved.

The number of buckets follows the pairs of the first contents (``PER_BUCKET`` a bucket) and then stays.

A basket of more than ``hot`` items never emits its pairs: it is kept as membership rows, and a pair
that is asked for gets from them one more count for each hot basket holding both, found block by block
of ``BLOCK`` hot baskets. That is exact as long as the wanted count exceeds the number of hot baskets,
since a pair must then also stand in some other basket; ``counts`` checks it and, where it does not
hold, builds the store again with a higher limit, once.

Defined cases: null baskets and null items are no members; an item counts once in a basket; a basket
of one item has no pairs; a basket whose new contents are empty (item null) is removed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import kept, scratch_path

PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 8, 16_384
#: Hot baskets that are intersected at a time.
BLOCK = 4096
TABLES = {"baskets": ("basket",), "pairs": ("item_a", "item_b"), "items": ("item",), "hot": ("basket",)}
SCHEMAS = {"baskets": "basket string, item string", "pairs": "item_a string, item_b string, n bigint", "items": "item string, n bigint", "hot": "basket string, item string"}


def pairs(baskets: DataFrame, sign: int = 1) -> DataFrame:
    """(item_a, item_b, n) summed over baskets (basket, item) of bounded size, item_a < item_b."""
    held = baskets.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    one = held.select("items", F.posexplode("items").alias("i", "item_a"))
    rest = F.slice("items", F.col("i") + 2, F.size("items"))
    both = one.where(F.col("i") + 1 < F.size("items")).select("item_a", F.explode(rest).alias("item_b"))
    return both.groupBy("item_a", "item_b").agg((F.count(F.lit(1)) * sign).alias("n"))


@dataclass
class State:
    """Where each bucket of each table stands, and what the store was made with."""

    buckets: int
    hot: int
    paths: dict[str, dict[int, str]] = field(default_factory=lambda: {t: {} for t in TABLES})


class PairStore:
    """Pair counts over baskets that change. ``apply`` merges a change, ``scores`` reads."""

    def __init__(self, spark, path: str | None = None, hot: int = 256) -> None:  # noqa: ANN001
        self.spark, self.path, self.version = spark, path or scratch_path(spark, "pairs"), 0
        self.state: State | None = None
        self.hot = hot
        self.delta: tuple[DataFrame, DataFrame] | None = None  # of pairs and of items, by the last change

    def _bucket(self, *by: str) -> Column:
        return F.pmod(F.hash(*by), F.lit(self.state.buckets)).alias("bucket")

    def _write(self, df: DataFrame, table: str, touched: set[int] | None) -> None:
        """The rows of the touched buckets (all, if None) written; the others keep their place."""
        at = f"{self.path}/v{self.version}/{table}"
        tasks = min(self.state.buckets, max(self.spark.sparkContext.defaultParallelism, len(touched or ()) or self.state.buckets))
        df.withColumn("bucket", self._bucket(*TABLES[table])).repartition(tasks, "bucket").write.partitionBy("bucket").parquet(at)
        files = self.spark.read.schema(f"{SCHEMAS[table]}, bucket int").parquet(at).inputFiles()
        new = {int(m.group(1)): f"{at}/bucket={m.group(1)}" for f in files if (m := re.search(r"/bucket=(\d+)/", f))}
        held = self.state.paths[table]
        for b in list(held) if touched is None else touched:
            held.pop(b, None)
        held.update(new)

    def _read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        at = [p for b, p in sorted(self.state.paths[table].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*at) if at else self.spark.createDataFrame([], SCHEMAS[table])

    def _touched(self, df: DataFrame, table: str) -> set[int]:
        """The buckets rows fall into: as many values as there are buckets at most."""
        return {r["bucket"] for r in df.select(self._bucket(*TABLES[table])).distinct().collect()}

    def _merge(self, table: str, delta: DataFrame) -> None:
        by = TABLES[table]
        if not self.state.paths[table]:
            self._write(_summed([delta], *by), table, None)
            return
        touched = self._touched(delta, table)
        self._write(_summed([delta, self._read(table, touched)], *by), table, touched)

    def _replace(self, table: str, keys: DataFrame, rows: DataFrame, touched: set[int]) -> None:
        if not self.state.paths[table]:
            self._write(rows, table, None)
        else:
            self._write(self._read(table, touched).join(keys, "basket", "left_anti").unionByName(rows), table, touched)

    def _split(self, baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Small baskets, and hot ones. The list of hot baskets is at most items / hot long."""
        large = baskets.groupBy("basket").count().where(F.col("count") > self.hot).select("basket")
        return baskets.join(large, "basket", "left_anti"), baskets.join(large, "basket", "left_semi")

    def apply(self, changed: DataFrame) -> "PairStore":
        """Merge baskets (basket, item) that replace those of the same name."""
        new = kept(changed.where("basket is not null").select("basket", "item").distinct(), "changed")
        full = new.where("item is not null")
        small, large = self._split(full)
        marks = full.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        self.version += 1
        keys = new.select("basket").distinct()
        if self.state is None:
            n = full.groupBy("basket").count().where(F.col("count") <= self.hot).agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] or 0
            size = LEAST_BUCKETS
            while size < min(n // PER_BUCKET, MOST_BUCKETS):
                size *= 2
            self.state = State(size, self.hot)
            self._merge("pairs", pairs(small))
            self._merge("items", marks)
            self._replace("baskets", keys, full, set())
            self._replace("hot", keys, large, set())
            return self
        touched = self._touched(keys, "baskets")
        old = self._read("baskets", touched).join(keys, "basket", "left_semi")
        old_small, _ = self._split(old)
        gone = old.groupBy("item").agg((-F.count(F.lit(1))).alias("n"))
        delta = kept(_summed([pairs(small), pairs(old_small, -1)], *TABLES["pairs"]), "pair-delta")
        moved = kept(_summed([marks, gone], "item"), "item-delta")
        self._merge("pairs", delta)
        self._merge("items", moved)
        self._replace("hot", keys, large, touched)
        self._replace("baskets", keys, full, touched)
        self.delta = (delta, moved)
        return self

    def counts(self, least: int, of: DataFrame | None = None) -> DataFrame:
        """(item_a, item_b, n): exact counts of all pairs (or of the pairs ``of``) in at least ``least`` baskets."""
        members = self._read("hot")
        many = members.select("basket").distinct().count()
        if many >= least:
            # the hot baskets alone could reach the count: built again with a higher limit, which stays, until
            # only fewer than ``least`` baskets are hot
            higher = PairStore(self.spark, f"{self.path}/hot{self.hot * 4}", self.hot * 4).apply(self._read("baskets"))
            self.hot, self.state, self.path, self.version = higher.hot, higher.state, higher.path, higher.version
            return self.counts(least, of)
        held = self._read("pairs").where(F.col("n") >= least - many)
        if of is not None:
            held = held.join(of.select("item_a", "item_b").distinct(), ["item_a", "item_b"], "left_semi")
        frequent = self._read("items").where(F.col("n") >= least).select("item")
        held = held.join(frequent.withColumnRenamed("item", "item_a"), "item_a", "left_semi").join(frequent.withColumnRenamed("item", "item_b"), "item_b", "left_semi")
        if not many:
            return held
        blocked = members.withColumn("block", F.pmod(F.xxhash64("basket"), F.lit(-(-many // BLOCK))))
        sets = kept(blocked.groupBy("item", "block").agg(F.collect_set(F.xxhash64("basket")).alias("in")), "hot-sets")  # about BLOCK each
        a, b = sets.withColumnsRenamed({"item": "item_a", "in": "in_a"}), sets.withColumnsRenamed({"item": "item_b", "in": "in_b"})
        more = held.select("item_a", "item_b").join(a, "item_a").join(b, ["item_b", "block"]).groupBy("item_a", "item_b").agg(F.sum(F.size(F.array_intersect("in_a", "in_b"))).alias("h"))
        got = held.join(more, ["item_a", "item_b"], "left")
        return got.select("item_a", "item_b", (F.col("n") + F.coalesce("h", F.lit(0))).alias("n")).where(F.col("n") >= least)

    def _scored(self, counts: DataFrame, total: int) -> DataFrame:
        items = self._read("items")
        a, b = items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
        s = counts.withColumnRenamed("n", "n_ab").join(a, "item_a").join(b, "item_b")
        return s.withColumn("lift", F.col("n_ab") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b")))

    def scores(self, total: int, least: int) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, lift): lift is n_ab * total / (n_a * n_b)."""
        return self._scored(self.counts(least), total)

    def affected(self, total: int, least: int) -> DataFrame:
        """``scores`` of the pairs the last change moved: those whose count it changed and those with an item
        whose count it changed. With the same ``total`` all other scores are as they were."""
        if self.delta is None:
            return self.scores(total, least)
        pairs_, items = self.delta
        moved = items.select("item")
        p = self._read("pairs").select("item_a", "item_b")
        by_item = p.join(moved.withColumnRenamed("item", "item_a"), "item_a", "left_semi").unionByName(p.join(moved.withColumnRenamed("item", "item_b"), "item_b", "left_semi").select("item_a", "item_b"))
        return self._scored(self.counts(least, pairs_.select("item_a", "item_b").unionByName(by_item)), total)


def _summed(parts: list[DataFrame], *by: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy(*by).agg(F.sum("n").alias("n"))
    return out.where("n <> 0")


def concept_baskets(entities: DataFrame, evidence: DataFrame, concepts: DataFrame, cut: object = None) -> DataFrame:
    """(basket, item, late): the known concepts found under each docid, each once; ``late`` if all its spans
    were loaded after ``cut``."""
    late = F.coalesce(F.col("loaded_at") > F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    e = entities.where("docid is not null").select("entity_id", "docid", late.alias("late"))
    v = evidence.where("cui is not null").select("entity_id", "cui").join(concepts.select("cui").distinct(), "cui", "left_semi")
    return e.join(v, "entity_id").groupBy(F.col("docid").alias("basket"), F.col("cui").alias("item")).agg(F.min("late").alias("late"))
