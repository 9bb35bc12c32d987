"""Output formats of mentions and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.analytics import numbered, running

_SPAN = ["docid", "passage_id", "start", "length", "term"]


def mention_rows(mentions: DataFrame) -> DataFrame:
    """one row per span and concept with the columns of the flat export; those not assessed are
    left out."""
    have = mentions.columns
    cols = [F.col("docid").alias("document"), "cui", *[c for c in ("preferred_name",) if c in have], "term", *[c for c in ("semantic_types", "negated", "assertion", "temporality", "experiencer") if c in have], "start", (F.col("start") + F.col("length")).alias("end")]
    return mentions.select(*cols)


def _entities(mentions: DataFrame, ev: Column) -> DataFrame:
    """Spans with what is true of each and ``l``, the rows of their concepts."""
    marks = [F.first(c).alias(c) for c in ("assertion", "temporality", "experiencer", "pos") if c in mentions.columns]
    return mentions.groupBy(*_SPAN).agg(F.first("fieldid").alias("fieldid"), F.bool_or("negated").alias("negated"), *marks, F.array_sort(F.collect_list(ev)).alias("l"))


def json_entities(mentions: DataFrame) -> DataFrame:
    """(docid, passage_id, start, length, json): every span as a JSON object; its concepts in the hash
    order of start + length + cui, their types and sources in hash order. Null members are written.

    A line for each span, so a document of any size is no one row; ``json_passages`` joins them."""
    types, sources = (T.hash_ordered(F.coalesce(c, F.array().cast("array<string>"))) for c in ("semantic_types", "sources"))
    concept = F.struct(F.col("cui"), F.col("preferred_name").alias("preferredname"), F.col("concept_string").alias("conceptstring"), types.alias("semantictypes"), sources.alias("sources"))
    ev = F.struct(F.lit("ev0").alias("id"), F.col("term").alias("matchedtext"), F.lit(0.0).alias("score"), "start", "length", concept.alias("conceptinfo"))
    key = (T.doc_hash(F.col("cui")) + F.col("start") + F.col("length")).bitwiseAND(F.lit(0xFFFFFFFF))
    per = _entities(mentions, F.struct(F.col("cui").alias("c"), key.alias("h"), ev.alias("ev")))
    per = per.withColumn("b", F.array_sort(F.transform("l", lambda x: F.struct(T.hash_bucket(x["h"], F.size("l").cast("bigint")).alias("b"), x["c"].alias("c"), x["ev"].alias("ev")))))
    entity = F.struct("docid", F.lit("en0").alias("id"), F.col("term").alias("matchedtext"), "fieldid", "start", "length", "negated", F.transform("b", lambda x: x["ev"]).alias("evlist"))
    return per.select("docid", "passage_id", "start", "length", F.to_json(entity, {"ignoreNullFields": "false"}).alias("json"))


def json_passages(mentions: DataFrame) -> DataFrame:
    """(docid, passage_id, json): the spans of a passage as a JSON array, in order."""
    rows = json_entities(mentions).select("docid", "passage_id", F.struct("start", (-F.col("length")).alias("l"), "json").alias("r"))
    return rows.groupBy("docid", "passage_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]), ","), F.lit("]")).alias("json"))


def _reference(kind: str, value: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("k"), value.alias("v"), text.alias("t"))


def brat_lines(mentions: DataFrame, type_name: str = "Concept") -> DataFrame:
    """(docid, no, part, line): a T line (part 0) for each distinct (start, end, text) of a document in
    order, and after it its N lines, numbered through the document: the score where there is one, then
    of every concept its id, types and sources, and whether it is negated; equal ones once."""
    cui = F.col("cui")
    lists = {c: T.hash_ordered(F.coalesce(c, F.array().cast("array<string>"))) for c in ("semantic_types", "sources")}
    refs = F.concat(
        F.array(_reference("ConceptId", cui, F.coalesce("preferred_name", cui))),
        F.transform(lists["semantic_types"], lambda x: _reference("SemanticType", F.concat(cui, F.lit(":"), x), x)),
        F.transform(lists["sources"], lambda x: _reference("Source", F.concat(cui, F.lit(":"), x), x)),
        F.when(F.col("negated"), F.array(_reference("Negated", F.col("term"), F.col("term")))).otherwise(F.array().cast("array<struct<k:string,v:string,t:string>>")),
    )
    score = F.col("score") if "score" in mentions.columns else F.lit(0.0)
    # offsets count from the document's start: spans of one place and text are one, of the first passage
    first = F.struct("passage_id", cui.alias("c"))
    s = mentions.groupBy("docid", "start", (F.col("start") + F.col("length")).alias("end"), "term").agg(F.min("passage_id").alias("_p"), F.array_sort(F.collect_list(F.struct(first.alias("o"), refs.alias("r")))).alias("_l"), F.max(score).alias("_s"))
    own = F.array_distinct(F.flatten(F.transform(F.filter("_l", lambda x: x["o"]["passage_id"].eqNullSafe(F.col("_p"))), lambda x: x["r"])))
    said = F.when(F.col("_s") > 0, F.array(_reference("Score", F.col("_s").cast("string"), F.col("_s").cast("string")))).otherwise(F.array().cast("array<struct<k:string,v:string,t:string>>"))
    s = s.select("docid", "start", "end", "term", F.concat(said, own).alias("refs")).withColumn("n", F.size("refs"))
    order = ["start", "end", "term"]
    s = running(running(s, ["docid"], order, "t"), ["docid"], order, "before", "n")
    t = F.concat(F.lit("T"), (F.col("t") + 1).cast("string"))
    head = F.concat(t, F.lit(f"\t{type_name} "), F.col("start").cast("string"), F.lit(" "), F.col("end").cast("string"), F.lit("\t"), F.col("term"))
    notes = F.transform("refs", lambda r, i: F.concat(F.lit("N"), (F.col("before") + i + 1).cast("string"), F.lit("\tReference "), t, F.lit(" "), r["k"], F.lit(":"), r["v"], F.lit("\t"), r["t"]))
    return s.select("docid", (F.col("t") + 1).alias("no"), F.posexplode(F.concat(F.array(head), notes)).alias("part", "line"))


def cui_list(mentions: DataFrame) -> DataFrame:
    """(cui, place): distinct concepts by first occurrence."""
    first = mentions.groupBy("cui").agg(F.min(F.struct("passage_id", "start")).alias("o"))
    return numbered(first.select("cui", "o.*"), ["passage_id", "start", "cui"], "place").select("cui", "place")


def ranked_tsv(tf: DataFrame) -> DataFrame:
    """F8: docid, text, global rank and score."""
    return numbered(tf.withColumn("_s", -F.col("score")), ["_s", "docid", "cui"], "rank").select("docid", "cui", "rank", "score")


def quoted(text: Column) -> Column:
    """A text in quotes, with escapes for what would break its line."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\xa0", "\\xa0")):
        t = F.replace(t, F.lit(c), F.lit(e))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def full_text(mentions: DataFrame) -> DataFrame:
    """(docid, passage_id, start, length, text): for a reader, a line for each span with its marks, and
    below it a line for each of its concepts."""
    lists = {c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",") for c in ("semantic_types", "sources")}
    ev = F.concat(F.lit("    "), F.col("cui"), F.lit(" "), F.coalesce("preferred_name", "cui"), F.lit(" ["), lists["semantic_types"], F.lit("] {"), lists["sources"], F.lit("} <- "), quoted(F.col("concept_string")), F.lit("\n"))
    per = _entities(mentions, F.struct("cui", ev.alias("e")))
    have = per.columns
    none = F.lit(None).cast("string")
    marks = F.concat(
        F.when(F.col("negated"), F.lit(" [negated]")).otherwise(""),
        F.when((F.col("assertion") if "assertion" in have else none) == "Possible", F.lit(" [possible]")).otherwise(""),
        *[F.when(F.coalesce(F.col(c) if c in have else none, F.lit("")) != "", F.concat(F.lit(" ["), F.col(c) if c in have else none, F.lit("]"))).otherwise("") for c in ("temporality", "experiencer")],
    )
    head = F.concat(F.col("start").cast("string"), F.lit(":"), F.col("length").cast("string"), F.lit(" "), quoted(F.col("term")), F.lit(" ("), F.coalesce(F.col("pos") if "pos" in have else none, F.lit("")), F.lit(")"), marks, F.lit("\n"))
    return per.select("docid", "passage_id", "start", "length", F.concat(head, F.array_join(F.transform("l", lambda x: x["e"]), "")).alias("text"))


def star_tables(mentions: DataFrame) -> dict[str, DataFrame]:
    """documents with their counts, and annotations."""
    rows = mention_rows(mentions).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return {"annotations": rows, "documents": rows.groupBy("document").agg(F.count(F.lit(1)).alias("n_annotations"))}


def normalized_tables(mentions: DataFrame) -> dict[str, DataFrame]:
    """entities, concepts, concept_semantic_types, concept_sources and evidence, each row once."""
    ent = mentions.select(*_SPAN, "negated").distinct()
    con = mentions.groupBy("cui").agg(F.first("preferred_name", True).alias("preferred_name"), F.first("semantic_types", True).alias("st"), F.first("sources", True).alias("so"))
    return {
        "entities": ent,
        "concepts": con.select("cui", "preferred_name"),
        "concept_semantic_types": con.select("cui", F.explode("st").alias("semantic_type")).distinct(),
        "concept_sources": con.select("cui", F.explode("so").alias("source")).distinct(),
        "evidence": mentions.select("docid", "passage_id", "start", "length", "cui", "term", "concept_string").distinct(),
    }


_RESULT = "docid string, matched_text string, fieldid string, start int, length int, negated boolean, ev_no int, ev_text string, score double, ev_start int, ev_length int, cui string, preferred_name string, concept_string string, semantic_types array<string>, sources array<string>"


def read_json(files: DataFrame) -> DataFrame:
    """The rows of JSON results (content binary, a list of entities each): one per entity and concept,
    in UTF-8 with or without byte order mark, UTF-16 or UTF-32. What is no list is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["content"]:
                entities = json.loads(bytes(data))
                if not isinstance(entities, list):
                    raise TypeError(f"expected a list of entities, got {type(entities).__name__}")
                for e in entities:
                    own = (e["docid"], e["matchedtext"], e.get("fieldid"), e["start"], e["length"], bool(e["negated"]))
                    for k, v in enumerate(e["evlist"]):
                        c = v["conceptinfo"]
                        out.append((*own, k, v["matchedtext"], v["score"], v["start"], v["length"], c["cui"], c["preferredname"], c["conceptstring"], c["semantictypes"], c["sources"]))
                    if not e["evlist"]:
                        out.append((*own, *[None] * 10))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return files.select("content").mapInPandas(run, _RESULT)


def result_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows of ``read_json`` as the five tables of F12."""
    held = rows.where("cui is not null")
    return {
        "entities": rows.select("docid", "matched_text", "fieldid", "start", "length", "negated").distinct(),
        "concepts": held.groupBy("cui").agg(F.min("preferred_name").alias("preferred_name")),
        "concept_semantic_types": held.select("cui", F.explode("semantic_types").alias("semantic_type")).distinct(),
        "concept_sources": held.select("cui", F.explode("sources").alias("source")).distinct(),
        "evidence": held.select("docid", F.col("start").alias("entity_start"), F.col("length").alias("entity_length"), "cui", F.col("ev_text").alias("matched_text"), "concept_string", "score", F.col("ev_start").alias("start"), F.col("ev_length").alias("length")),
    }


#: Extensions of the formats that are written one file for each document.
EXTENSIONS = {"json": "json", "brat": "ann", "full": "txt", "mmi": "mmi", "cuilist": "cui"}


def write_by_document(df: DataFrame, path: str, mode: str = "overwrite", per_file: int = 1_000_000) -> None:
    """one folder per document; only the documents written are replaced. A document with more
    than ``per_file`` rows has several files, so none is one task's burden."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", per_file)
    w.partitionBy("docid").parquet(path)


def write_lines(lines: DataFrame, path: str, format: str, order: list[str], line: str = "line") -> None:  # noqa: A002
    """the lines of every document as text below ``path/format=.../docid=...``, in order within each
    file. Documents are split over tasks by range, so the hot one is written by several."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartitionByRange(n, "docid", *order).sortWithinPartitions("docid", *order)
    rows.select("docid", F.col(line).alias("value")).write.mode("overwrite").partitionBy("docid").text(f"{path}/format={EXTENSIONS[format]}")
