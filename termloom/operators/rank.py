"""Term frequencies, ranking and the orders of output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T


def term_frequency(mentions: DataFrame) -> DataFrame:
    """(docid, cui, frequency, concept, title_flag, average_value, first_start): occurrences of a
    concept in a document; all but the count come from the first occurrence."""
    m = mentions.withColumn("_o", F.struct("passage_id", "start", F.col("length")))
    first = lambda c: F.min_by(c, "_o")
    return m.groupBy("docid", "cui").agg(F.count(F.lit(1)).alias("frequency"), first("concept_string").alias("concept"), first(F.coalesce(F.col("fieldid").isin("title", "TI"), F.lit(False))).cast("int").alias("title_flag"), first(F.lit(0.0)).alias("average_value"), F.min("start").alias("first_start"))


def squashed(n: float, value: Column) -> Column:
    """A value of 0 to 1 bent by n: logarithmic for negative n, logistic for positive."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    if n == 0:
        return value
    if n < 0:
        e = F.exp(F.lit(float(-n)))
        a, b = e + 1, e - 1
        return F.log((a + b * v) / (a - b * v)) / F.lit(float(-n))
    e = F.exp(F.lit(float(n)))
    c = F.exp(-F.lit(float(n)) * v)
    return (e + 1) / (e - 1) * (1 - c) / (1 + c)


def score(frequency: Column, value: Column, depth: Column, title: Column) -> Column:
    """the rank of a concept in a document, 0 to 10000. ``depth``: summed depth of its tree codes."""
    spec = (squashed(-10, value / 1000) + F.lit(14.0) * (F.greatest(F.lit(1), depth) / 8)) / 15
    return F.lit(10000.0) * F.when(title, spec).otherwise(squashed(-5, frequency / 1000) * spec)


def score_text(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value, 2), ",", "")


def mmi_lines(tf: DataFrame) -> DataFrame:
    """(docid, line): ranked lines of fields with a bar after each. ``tf``: term_frequency with
    preferred_name, semantic_types, occurrences (array<struct>), codes and score."""
    o = F.transform("occurrences", lambda x: F.concat(F.lit('"'), x["concept_string"], F.lit('"-'), x["fieldid"], F.lit("-"), x["window_no"].cast("string"), F.lit('-"'), x["term"], F.lit('"-'), F.coalesce(x["pos"], F.lit("null")), F.lit("-"), x["negated"].cast("string")))
    where = F.transform("occurrences", lambda x: F.concat(x["start"].cast("string"), F.lit("/"), x["length"].cast("string")))
    fields = F.array_distinct(F.transform("occurrences", lambda x: x["fieldid"]))
    line = F.concat_ws("|", "docid", F.lit("MMI"), score_text(F.col("score")), "preferred_name", "cui", F.concat(F.lit("["), F.array_join("semantic_types", ", "), F.lit("]")), F.array_join(o, ","), F.array_join(fields, ";"), F.array_join(where, ";"), F.array_join("codes", ";"), F.lit(""))
    return tf.select("docid", (-F.col("score")).alias("rank"), "preferred_name", line.alias("line"))


def hash_order(df: DataFrame, group: list[str], item: str, by: str) -> DataFrame:
    """the distinct items of each group with ``place``, their order in a hash table of strings;
    within a bucket in the order of ``by``."""
    d = df.groupBy(*group, item).agg(F.min(by).alias("_o"))
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    b = d.join(n, group).withColumn("_b", T.hash_bucket(T.doc_hash(F.col(item)), F.col("_n").cast("bigint")))
    ordered = b.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_b", "_o", F.col(item).alias("v")))).alias("_l"))
    return ordered.select(*group, F.posexplode(F.transform("_l", lambda x: x["v"])).alias("place", item))
