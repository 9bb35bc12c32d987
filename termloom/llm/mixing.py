"""Mixing sources to target weights by a low-discrepancy schedule.

With T the tokens of all documents of the listed sources, source s is due q_s = min(share_s * T,
max_repeats_s * tokens_s). The documents of every source are put in a seeded random order and cut
into blocks of about ``block`` tokens. Slot i of the mix takes the point frac(i * golden ratio)
through the cumulative q_s; the r-th slot of a source takes its block r, starting over when all have
been used. Reported are the tokens each source got and its share of the mix.

Defined cases: documents of unlisted or null source are no part of the mix; a source without
documents gets nothing; null and empty texts weigh nothing and travel with their block; a source
listed twice counts with its first row.

Nothing runs over a whole source in one task: prefix sums go over hash buckets first, and within a
bucket next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import tokens
from termloom.session import kept, spread

#: The step of the sequence: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: The weights are a table of settings; a larger one is refused rather than collected.
MOST_SOURCES = 10_000


def sizes(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n): tokens of the documents of listed sources, each once."""
    listed = targets.select("source").where("source is not null").distinct()
    d = docs.select("doc_id", "source", "text").join(listed, "source", "left_semi")
    return spread(d).select("doc_id", "source", tokens.count(F.col("text"), path).alias("n"))


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """A row of settings and totals for each source, in order of name; bounded by MOST_SOURCES."""
    t = targets.where("source is not null").groupBy("source").agg(F.first("target_share").alias("share"), F.first("max_repeats").alias("repeats"))
    totals = sized.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = t.join(totals, "source", "left").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(r["tokens"] or 0 for r in rows)
    out = []
    for r in rows:
        have, share, repeats = r["tokens"] or 0, r["share"] or 0.0, max(0, r["repeats"] or 0)
        out.append({"source": r["source"], "share": share, "repeats": repeats, "tokens": have, "docs": r["docs"] or 0, "total": total, "wanted": share * total, "due": min(share * total, float(repeats * have))})
    return out


def _ranked(df: DataFrame, group: str, bucket: str, order: list[Column], size: Column, to: str) -> DataFrame:
    """``to``: the sum of ``size`` before each row of its group, in the order (bucket, *order)."""
    sums = df.groupBy(group, bucket).agg(F.sum(size).alias("_s"))
    before = sums.withColumn("_b", F.sum("_s").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).select(group, bucket, F.coalesce("_b", F.lit(0)).alias("_b"))
    own = F.sum(size).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(before, [group, bucket]).withColumn(to, F.col("_b") + F.coalesce(own, F.lit(0))).drop("_b")


def blocks(sized: DataFrame, plan_: list[dict], block: int, seed: int, per_bucket: int = 2000) -> DataFrame:
    """(source, block, doc_id, n): each source in random order, cut into blocks of ``block`` tokens."""
    buckets = max(1, max([p["docs"] for p in plan_], default=1) // per_bucket)
    h = F.xxhash64("doc_id", F.lit(seed))
    d = sized.withColumn("_h", h).withColumn("_k", F.floor((F.shiftrightunsigned("_h", 1)) / F.lit(2**63 / buckets)))
    return _ranked(d, "source", "_k", [F.col("_h"), F.col("doc_id")], F.col("n"), "_at").select("source", F.floor(F.col("_at") / block).alias("block"), "doc_id", "n")


#: Cells of the unit interval; a point meets only the sources whose weights reach into its cell.
CELLS = 4096


def schedule(spark, plan_: list[dict], block: int, per_bucket: int = 5000) -> DataFrame:  # noqa: ANN001
    """(slot, source, block, repeat_no): the slots of the mix in order.

    A point finds its source in a table of intervals by a join on its cell; the table has a row for every
    source and cell it reaches into, so ``CELLS`` + MOST_SOURCES at most."""
    due = [(p["source"], p["due"], max(1, -(-p["tokens"] // block)), p["repeats"]) for p in plan_ if p["due"] > 0]
    total = sum(d for _, d, _, _ in due)
    if not due:
        return spark.createDataFrame([], "slot bigint, source string, block bigint, repeat_no bigint")
    slots = -(-int(total) // block)
    rows, at = [], 0.0
    for i, (name, d, n, most) in enumerate(due):
        upto = 1.0 if i == len(due) - 1 else min(1.0, at + d / total)
        rows += [(c, at, upto, name, n, most) for c in range(int(at * CELLS), min(CELLS, int(upto * CELLS) + 1))]
        at = upto
    table = F.broadcast(spark.createDataFrame(rows, "cell int, lo double, hi double, source string, n bigint, most int"))
    point = F.expr(f"(id + 1) * {GOLDEN}D - floor((id + 1) * {GOLDEN}D)")
    s = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / per_bucket).alias("_k"))
    s = s.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int")).join(table, "cell").where("point >= lo and point < hi").select("slot", "source", "n", "most", "_k")
    r = _ranked(s, "source", "_k", [F.col("slot")], F.lit(1), "rank")
    return r.where("rank < n * most").select("slot", "source", (F.col("rank") % F.col("n")).alias("block"), F.floor(F.col("rank") / F.col("n")).alias("repeat_no"))


def mix(docs: DataFrame, targets: DataFrame, path: str, block: int | None = None, seed: int = 17) -> tuple[DataFrame, list[dict]]:
    """The mix as (slot, source, repeat_no, doc_id, n) and the plan behind it.

    Unless given, a block is a 4000th of all tokens, 512 at least and 65,536 at most."""
    sized = kept(sizes(docs, targets, path), "sizes")
    p = plan(sized, targets)
    block = block or max(512, min(65_536, (p[0]["total"] if p else 0) // 4000))
    out = schedule(docs.sparkSession, p, block).join(blocks(sized, p, block, seed), ["source", "block"])
    return out.select("slot", "source", "repeat_no", "doc_id", "n"), p


def report(mixed: DataFrame, plan_: list[dict]) -> DataFrame:
    """(source, target_share, tokens, wanted, mixed_tokens, share, short): what each source reached;
    ``short`` where the mix gives it less than its share asks for and even all its repeats hold fewer
    tokens than that (a mix in whole blocks may miss a share by some tokens without that)."""
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.sum("n").alias("mixed_tokens"))
    rows = [(p["source"], float(p["share"]), int(p["tokens"]), float(p["wanted"]), bool(p["repeats"] * p["tokens"] < p["wanted"])) for p in plan_]
    base = spark.createDataFrame(rows, "source string, target_share double, tokens bigint, wanted double, limited boolean")
    all_ = Window.partitionBy()  # as many rows as there are sources
    full = base.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    full = full.withColumn("short", F.col("limited") & (F.col("mixed_tokens") < F.col("wanted")))
    full = full.withColumn("share", F.coalesce(F.col("mixed_tokens") / F.sum("mixed_tokens").over(all_), F.lit(0.0)))
    return full.select("source", "target_share", "tokens", "wanted", "short", "mixed_tokens", "share")
