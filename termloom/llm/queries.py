"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import cooccur, encoding, frequency, lookalike, mixing, pii, sentences, subjects, tokens
from termloom.session import kept, read, spread

Query = Callable[[SparkSession, str], DataFrame]


def p1_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of personal information with its place."""
    row = lambda df, table: df.select(F.lit(table).alias("table_name"), F.col(df.columns[0]).alias("row_id"), "pii_type", "start_pos", "end_pos")
    p, d_ = read(spark, d, "passages"), read(spark, d, "documents")
    return row(pii.cases(p, "passage_id", "text"), "passages").unionByName(row(pii.cases(d_, "doc_id", "text"), "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_cases(spark, d).select("table_name", "row_id", "pii_type", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every passage and document with placeholders for its personal information, each once."""
    row = lambda df, table, key: spread(df.select(F.col(key).alias("row_id"), "text").distinct()).select(F.lit(table).alias("table_name"), "row_id", pii.redacted(F.col("text")).alias("text"))
    return row(read(spark, d, "passages"), "passages", "passage_id").unionByName(row(read(spark, d, "documents"), "documents", "doc_id"))


def p2_store(spark: SparkSession, d: str) -> tuple[cooccur.PairStore, int, int]:
    """The store after two changes: what was loaded by the time the last span was found, and the baskets
    that later deliveries changed."""
    entities = read(spark, d, "entities")
    total, cut = entities.agg(F.count_distinct("docid"), F.max("found_at")).first()
    least = max(5, -(-3 * total // 1000))
    members = kept(cooccur.concept_baskets(entities, read(spark, d, "evidence"), read(spark, d, "concepts"), cut), "members")
    store = cooccur.PairStore(spark).apply(members.where("not late").select("basket", "item"))
    changed = members.where("late").select("basket").distinct()
    return store.apply(members.join(changed, "basket", "left_semi").select("basket", "item")), total, least


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts in at least max(5, 0.3 %) of the baskets and 5 times as often as by chance."""
    store, total, least = p2_store(spark, d)
    s = store.scores(total, least).where("lift >= 5")
    return s.select(F.col("item_a").alias("cui_a"), F.col("item_b").alias("cui_b"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """All frequent pairs with their counts and lift."""
    store, total, least = p2_store(spark, d)
    return store.scores(total, least).select(F.col("item_a").alias("cui_a"), F.col("item_b").alias("cui_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p2_affected(spark: SparkSession, d: str) -> DataFrame:
    """Of the frequent pairs those whose score the last change moved."""
    store, total, least = p2_store(spark, d)
    return store.affected(total, least).select(F.col("item_a").alias("cui_a"), F.col("item_b").alias("cui_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_normal(spark: SparkSession, d: str) -> DataFrame:
    """Values not in their consistent form, with it; rows decoded wrongly are left out."""
    c, e = read(spark, d, "cuisourceinfo"), read(spark, d, "entities")
    wrong = _wrong(spark, d, "cuisourceinfo").withColumnRenamed("row_id", "ord")
    row = lambda df, table, field: df.select(F.lit(table).alias("table_name"), F.lit(field).alias("field"), F.col(df.columns[0]).alias("row_id"), "text", "normal")
    of = lambda field: row(lookalike.changed(c, "ord", field).join(wrong, "ord", "left_anti"), "cuisourceinfo", field)
    return of("str").unionByName(of("norm")).unionByName(row(lookalike.changed(e, "entity_id", "matched_text"), "entities", "matched_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_normal(spark, d).select("table_name", "field", "row_id")


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every sentence unit with its position, of the passages and of the sentences."""
    p, s = read(spark, d, "passages"), read(spark, d, "sentences")
    row = lambda df, table: df.select(F.lit(table).alias("table_name"), F.col(df.columns[0]).alias("row_id"), "start_pos", "unit")
    return row(sentences.sentences(p, "passage_id", "text"), "passages"), row(sentences.sentences(s, "sent_id", "text"), "sentences")


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence unit of every text with its position, of texts decoded wrongly too."""
    of_p, of_s = _units(spark, d)
    return of_p.unionByName(of_s)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the units start; by the query's definition without those of passages decoded wrongly."""
    of_p, of_s = _units(spark, d)
    found = of_p.join(_wrong(spark, d, "passages"), "row_id", "left_anti").unionByName(of_s)
    return found.select("table_name", "row_id", "start_pos")


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The units of the corpus by row, and the repairs made from them; each written once. Names and
    preferred names that no row is asked of only add to the vocabulary."""
    c, p = read(spark, d, "cuisourceinfo"), read(spark, d, "passages")
    parts = [encoding.unit_rows(c, "cuisourceinfo", "str", "ord"), encoding.unit_rows(p, "passages", "text", "passage_id"), encoding.unit_rows(c, "", "norm"), encoding.unit_rows(read(spark, d, "concepts"), "", "preferred_name")]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    rows = kept(every, "unit-rows")
    return rows, kept(encoding.repairs(kept(encoding.counted(rows), "units")), "repairs")


def _wrong(spark: SparkSession, d: str, table: str) -> DataFrame:
    rows, fixes = _corpus(spark, d)
    return encoding.affected_rows(rows, table, fixes)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text was decoded wrongly, wholly or in part."""
    rows, fixes = _corpus(spark, d)
    of = lambda t: encoding.affected_rows(rows, t, fixes).select(F.lit(t).alias("table_name"), "row_id")
    return of("cuisourceinfo").unionByName(of("passages"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The affected rows with their text as it was and as restored."""
    fixes = _corpus(spark, d)[1]
    c = encoding.repaired(read(spark, d, "cuisourceinfo"), "ord", "str", fixes).select(F.lit("cuisourceinfo").alias("table_name"), F.col("ord").alias("row_id"), "text", "repaired")
    p = encoding.repaired(read(spark, d, "passages"), "passage_id", "text", fixes).select(F.lit("passages").alias("table_name"), F.col("passage_id").alias("row_id"), "text", "repaired")
    return c.unionByName(p)


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """(field, term, occurrences, records) of both fields."""
    held = frequency.latest_counts(read(spark, d, "termfrequency"))
    cui = held.select(F.lit("cui").alias("field"), F.col("cui").alias("term"), F.col("frequency").alias("occurrences"), F.col("docid").isNotNull().cast("int").alias("records"))
    names = read(spark, d, "cuisourceinfo").where("norm is not null").select("ord", "norm", "cui").distinct()
    first = F.row_number().over(Window.partitionBy("norm", "cui").orderBy("ord")) == 1  # a concept is a record once
    norm = names.select(F.lit("norm").alias("field"), F.col("norm").alias("term"), F.lit(1).cast("bigint").alias("occurrences"), (first & F.col("cui").isNotNull()).cast("int").alias("records"))
    return frequency.term_counts(cui.unionByName(norm))


def p7_marks(spark: SparkSession, d: str) -> DataFrame:
    """p7_counts with the mark of each term: rare, common or ''."""
    docs = read(spark, d, "termfrequency").agg(F.count_distinct("docid").alias("docs"))
    cuis = read(spark, d, "cuisourceinfo").agg(F.count_distinct("cui").alias("cuis"))
    c = p7_counts(spark, d).crossJoin(F.broadcast(docs)).crossJoin(F.broadcast(cuis))  # one row each
    is_cui = F.col("field") == "cui"
    rare = F.when(is_cui, F.col("occurrences") <= 3).otherwise(F.col("occurrences") == 1)
    common = F.when(is_cui, F.col("records") * 10 > F.col("docs")).otherwise(F.col("records") * 200 > F.col("cuis"))
    return c.select("field", "term", "occurrences", "records", F.when(rare, "rare").when(common, "common").otherwise("").alias("mark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_marks(spark, d).where("mark <> ''").select("field", "term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokens.ids(F.col("text"), tokens.tokenizer_path()).alias("ids"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids decoded again, and whether the spans of its tokens cover it."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    path = tokens.tokenizer_path()
    got = docs.select("doc_id", "text", tokens.ids(F.col("text"), path).alias("ids"), tokens.spans(F.col("text"), path).alias("spans"))
    end = F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"])), F.lit(0))
    return got.select("doc_id", (tokens.decode(F.col("ids"), path) == F.coalesce("text", F.lit(""))).alias("same"), (end == F.length(F.coalesce("text", F.lit("")))).alias("covered"))


def _mix(spark: SparkSession, d: str):  # noqa: ANN202
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"), tokens.tokenizer_path())


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: which document stands in which slot, and for the how-manieth time."""
    return _mix(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share, from the report of the mix."""
    return p9_report(spark, d).where("short").select("source")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Assigned subjects with their score and calibrated probability."""
    return subjects.assign(read(spark, d, "documents"), read(spark, d, "subject_labels"))[0].select("doc_id", "subject", F.round("score", 4).alias("score"), F.round("probability", 4).alias("probability"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).select("doc_id", "subject")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and k not in ("p2_store",)}


_BASKETS = """
n as (select count(distinct docid) n from entities),
b as (select distinct e.docid, v.cui from entities e join evidence v using (entity_id) join (select distinct cui from concepts) c on c.cui = v.cui where e.docid is not null),
m as (select cui, count(*) c from b group by 1),
f as (select * from b where cui in (select cui from m, n where c >= greatest(5, 0.003 * n.n))),
p as (select a.cui cui_a, b.cui cui_b, count(*) n_ab from f a join f b on a.docid = b.docid and a.cui < b.cui group by 1, 2),
s as (select p.*, x.c n_a, y.c n_b, p.n_ab * n.n::double / (x.c::double * y.c) lift from p join m x on x.cui = cui_a join m y on y.cui = cui_b, n where n_ab >= greatest(5, 0.003 * n.n))
"""
_COUNTS = """
h as (select docid, cui, arg_max(frequency, (loaded_at, frequency)) frequency from termfrequency where cui is not null and cui <> '' group by 1, 2),
u as (select distinct ord, norm, cui from cuisourceinfo where norm is not null),
c as (select 'cui' field, cui term, sum(frequency)::bigint occurrences, count(docid)::bigint records from h group by 2
      union all select 'norm', norm, count(*)::bigint, count(distinct cui)::bigint from u group by 2),
k as (select *, case when field = 'cui' then case when occurrences <= 3 then 'rare' when records * 10 > (select count(distinct docid) from termfrequency) then 'common' else '' end
      else case when occurrences = 1 then 'rare' when records * 200 > (select count(distinct cui) from cuisourceinfo) then 'common' else '' end end mark from c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"with {_BASKETS} select cui_a, cui_b from s where lift >= 5",
        "p2_scores": f"with {_BASKETS} select cui_a, cui_b, n_ab, n_a, n_b, round(lift, 6) lift from s",
        "p8_round_trip": "select doc_id, true same, true covered from documents",
        "p2_affected": f"""with {_BASKETS.strip()}, cut as (select max(found_at) t from entities),
ol as (select distinct e.docid, v.cui from entities e join evidence v using (entity_id) join (select distinct cui from concepts) c on c.cui = v.cui, cut where e.docid is not null and (e.loaded_at is null or e.loaded_at <= cut.t)),
nb as (select * from b except select * from ol), tb as (select distinct docid from nb),
ch as (select distinct x.cui cui_a, y.cui cui_b from nb x join b y on x.docid = y.docid and x.cui < y.cui union select distinct y.cui, x.cui from nb x join b y on x.docid = y.docid and y.cui < x.cui)
select cui_a, cui_b, n_ab, n_a, n_b, round(lift, 6) lift from s where cui_a in (select cui from nb) or cui_b in (select cui from nb) or (cui_a, cui_b) in (select (cui_a, cui_b) from ch)""",
        "p7_counts": f"with {_COUNTS} select * from c",
        "p7_marks": f"with {_COUNTS} select * from k",
        "p7_found": f"with {_COUNTS} select field, term, mark from k where mark <> ''",
    }
