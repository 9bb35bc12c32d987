"""Analytics over mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import kept


def corpus_summary(mentions: DataFrame, top: int) -> DataFrame:
    """G1: the ``top`` concepts by mentions, with documents and the commonest term."""
    per = mentions.groupBy("cui", F.lower("term").alias("norm_term")).agg(F.count(F.lit(1)).alias("n"))
    common = per.groupBy("cui").agg(F.max_by("norm_term", F.struct("n", "norm_term")).alias("commonest_term"))
    s = mentions.groupBy("cui").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("docid").alias("documents"))
    return s.orderBy(F.col("mentions").desc(), "cui").limit(top).join(common, "cui")


def document_stats(mentions: DataFrame) -> DataFrame:
    """Per document its spans, negated spans and distinct concepts."""
    span = F.struct("passage_id", "start", "length")
    return mentions.groupBy("docid").agg(F.count_distinct(span).alias("spans"), F.count_distinct(F.when(F.col("negated"), span)).alias("negated_spans"), F.count_distinct("cui").alias("concepts"))


def cohort(documents: DataFrame, mentions: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document as affirmed, negated_only or absent for the target concepts; a span counts
    once whichever of its concepts is a target."""
    hit = mentions.join(targets.select("cui").distinct(), "cui", "left_semi").select("docid", "passage_id", "start", "length", "negated").distinct()
    n = hit.groupBy("docid").agg(F.count_if(~F.col("negated")).alias("n_affirmed"), F.count_if("negated").alias("n_negated"))
    d = documents.select("docid").distinct().join(n, "docid", "left")
    a, g = F.coalesce("n_affirmed", F.lit(0)), F.coalesce("n_negated", F.lit(0))
    return d.select("docid", F.when(a > 0, "affirmed").when(g > 0, "negated_only").otherwise("absent").alias("status"), a.alias("n_affirmed"), g.alias("n_negated"))


def agreement(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Tp, fp, fn, precision, recall and f1 of ``left`` against ``right`` as sets."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(1))
    b = right.select(*on).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, on, "full").agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("tp"), F.count_if(F.col("_r").isNull()).alias("fp"), F.count_if(F.col("_l").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return j.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def differences(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Keys on one side only, and on shared keys the mismatches of each field."""
    r = right.select(*on, *[F.col(f).alias(f"_r_{f}") for f in fields]).withColumn("_r", F.lit(1))
    j = left.select(*on, *fields).withColumn("_l", F.lit(1)).join(r, on, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), *[F.count_if(both & ~F.col(f).eqNullSafe(F.col(f"_r_{f}"))).alias(f"{f}_differs") for f in fields])


def top_concepts(evidence: DataFrame, concepts: DataFrame, top: int) -> DataFrame:
    """Concepts by evidence rows."""
    n = evidence.groupBy("cui").agg(F.count(F.lit(1)).alias("n"))
    return n.join(concepts, "cui").orderBy(F.col("n").desc(), "cui").limit(top)


def resolved_terms(terms: DataFrame, term: str, dict_: DataFrame, concepts: DataFrame, types_: DataFrame) -> DataFrame:
    """(term, cui, preferred_name, semantic_types): every concept a bare term leads to, each once."""
    from termloom.operators import dictionary as D
    from termloom.operators import match

    hit = D.preferred(match.looked_up(terms, term, dict_).select(term, "cui").distinct(), concepts)
    return hit.join(D.semantic_types(types_), "cui", "left").select(term, "cui", "preferred_name", F.coalesce("semantic_types", F.array()).alias("semantic_types"))


def search_log(search_id: str, ran_at: str, term: str | None, corpus: str, found: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """The tables one search adds to a log: search, concepts, documents and console. ``found``: a
    cohort; ``resolved``: (cui, preferred_name, semantic_types) of its targets."""
    sid = F.lit(search_id).alias("search_id")
    cuis = resolved.agg(F.array_join(F.array_sort(F.collect_set("cui")), ",").alias("cuis"))  # the targets asked for
    n = found.agg(F.count(F.lit(1)).alias("n_documents"), *[F.count_if(F.col("status") == v).alias(c) for v, c in (("affirmed", "n_affirmed"), ("negated_only", "n_negated"), ("absent", "n_absent"))])
    search = n.join(cuis).select(sid, F.lit(ran_at).alias("ran_at"), F.lit(term).cast("string").alias("term"), "cuis", F.lit(corpus).alias("corpus"), "n_documents", "n_affirmed", "n_negated", "n_absent")
    rows = found.where("status <> 'absent'").select(sid, F.col("docid").alias("source"), "status", "n_affirmed", "n_negated")
    said = n.select(sid, F.posexplode(F.array(F.format_string("%d documents", "n_documents"), F.format_string("%d affirmed", "n_affirmed"), F.format_string("%d negated only", "n_negated"), F.format_string("%d absent", "n_absent"))).alias("line_no", "line"))
    return {"search": search, "concepts": resolved.select(sid, "cui", "preferred_name", F.array_join("semantic_types", ",").alias("semantic_types")), "documents": rows, "console": said.withColumn("line_no", F.col("line_no") + 1)}


def append_log(tables: dict[str, DataFrame], path: str) -> None:
    """The tables added below ``path``; the row of ``search`` is written last, so a search that broke
    off is not listed."""
    for name in ("concepts", "documents", "console", "search"):
        tables[name].write.mode("append").parquet(f"{path}/{name}")


def running(df: DataFrame, group: list[str], order: list[str], to: str, size: str | None = None, ranges: int | None = None) -> DataFrame:
    """``to``: the sum of ``size`` (or the number) of the rows before each row of its group in an order,
    without one task for a group, however many rows it has: rows are put into ranges by group and
    order, each range is summed, and within a range rows are summed on their own. As many ranges as
    the session has shuffle partitions, unless given."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(n, *group, *order).withColumn("_p", F.spark_partition_id()), "ranged")  # read twice
    s = F.col(size) if size else F.lit(1)
    sums = ranged.groupBy("_p", *group).agg(F.sum(s).alias("_n"))  # a row for each range and group in it
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_b")
    own = F.coalesce(F.sum(s).over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranged.withColumn("_o", own).join(base, on).select(*df.columns, (F.col("_o") + F.col("_b")).alias(to))


def numbered(df: DataFrame, order: list[str], to: str, ranges: int | None = None) -> DataFrame:
    """F8: a global rank by ``order``, from 1."""
    return running(df, [], order, to, None, ranges).withColumn(to, F.col(to) + 1)
