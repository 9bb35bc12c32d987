"""Document formats. Every reader gives passages: (docid, passage_no, fieldid, base_offset, text, infons).

``of_*`` functions read a frame with a column ``content`` (a whole file or a whole line), so the same
reader serves files, tables and streams; ``load`` reads files by format name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T

# The ids a document gets where its source names none.
DEFAULT_TEXT_ID, DEFAULT_DOC_ID, DEFAULT_PASSAGE_ID, DEFAULT_LINE_ID = "00000000.tx", "0000000.TXT", "00000000", "00000.txt"
SCHEMA = "docid string, passage_no int, fieldid string, base_offset int, text string, infons map<string,string>"


def _passage(docid: Column, no: Column, fieldid: Column, offset: Column, text: Column, infons: Column | None = None) -> list[Column]:
    return [docid.alias("docid"), no.cast("int").alias("passage_no"), fieldid.cast("string").alias("fieldid"), offset.cast("int").alias("base_offset"), text.alias("text"), (infons if infons is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("infons")]


def read_files(spark: SparkSession, path: str, encoding: str = "utf-8", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, name, content): whole files, decoded with bad bytes as U+FFFD, one leading byte
    order mark dropped, line ends untouched."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    raw = (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content")

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode(encoding, "replace"))

    text = F.regexp_replace(decoded("content"), r"^\x{feff}", "")
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("content"))


def duplicate_names(files: DataFrame) -> DataFrame:
    """File names that occur more than once."""
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def of_freetext(files: DataFrame, section: str | None = None) -> DataFrame:
    """A file is one passage; its id is the last component of its name."""
    return files.select(*_passage(F.element_at(F.split("name", "/"), -1), F.lit(0), F.lit(section), F.lit(0), F.col("content")))


def file_lines(files: DataFrame) -> DataFrame:
    """(name, line_no, content): the lines of files, ended by LF, CRLF or CR."""
    return files.select("name", F.posexplode(T.read_lines(F.col("content"))).alias("line_no", "content"))


def of_single_lines(lines: DataFrame, section: str | None = "text") -> DataFrame:
    """Every line is a document of its own that begins at 0."""
    return lines.select(*_passage(F.lit(DEFAULT_LINE_ID), F.lit(0), F.lit(section), F.lit(0), F.col("content")), "line_no")


def of_id_lines(lines: DataFrame, delimiter: str = r"\|") -> DataFrame:
    """Id and text; further fields are dropped, a line with fewer is an empty document."""
    f = T.split_trimmed(F.col("content"), delimiter)
    ok = F.size(f) >= 2
    return lines.select(*_passage(F.when(ok, f[0]).otherwise(F.lit(DEFAULT_LINE_ID)), F.lit(0), F.lit("text"), F.lit(0), F.when(ok, f[1]).otherwise("")), "line_no")


def _title_abstract(lines: DataFrame, docid: Column, title: Column, abstract: Column) -> DataFrame:
    parts = F.array(F.struct(F.lit("title").alias("s"), title.alias("t")), F.struct(F.lit("abstract").alias("s"), abstract.alias("t")))
    return lines.select(docid.alias("_d"), F.posexplode(parts).alias("_n", "_p"), "line_no").select(*_passage(F.col("_d"), F.col("_n"), F.col("_p.s"), F.lit(0), F.col("_p.t")), "line_no")


def of_title_abstract(lines: DataFrame) -> DataFrame:
    """Id, title and abstract by tabs: two passages, both from 0; short lines are skipped."""
    f = F.split("content", "\t")
    return _title_abstract(lines.where(F.size(f) >= 3), f[0], f[1], f[2])


def of_tagged_title_abstract(lines: DataFrame) -> DataFrame:
    """As S5, after the category marks are taken out."""
    return of_title_abstract(lines.withColumn("content", F.regexp_replace("content", r'<category="[A-Za-z]+">|</category>', "")))


def of_bar_title_abstract(lines: DataFrame) -> DataFrame:
    """``id|title<TAB>abstract``."""
    f = F.split("content", r"\|", 2)
    g = F.split(f[1], "\t")
    return _title_abstract(lines.where((F.size(f) >= 2) & (F.size(g) >= 2)), f[0], g[0], g[1])


def of_pubtator(lines: DataFrame) -> DataFrame:
    """``id|t|title`` and ``id|a|abstract``; the last line of an id and kind holds, the abstract
    begins where the title ends; other lines are ignored."""
    f = F.split("content", r"\|", -1)
    rows = lines.withColumn("f", f).where((F.size("f") >= 3) & F.col("f")[1].isin("t", "a"))
    last = lambda k: F.max_by(F.when(F.col("f")[1] == k, F.col("f")[2]), F.when(F.col("f")[1] == k, F.col("line_no")))
    g = rows.groupBy("name", F.col("f")[0].alias("_d")).agg(last("t").alias("t"), last("a").alias("a"), F.min(F.struct(F.when(F.col("f")[1] == "t", 0).otherwise(1), "line_no")).alias("_o"))
    parts = F.filter(F.array(F.struct(F.lit("title").alias("s"), F.lit(0).alias("o"), F.col("t").alias("x")), F.struct(F.lit("abstract").alias("s"), F.coalesce(F.length("t"), F.lit(0)).alias("o"), F.col("a").alias("x"))), lambda p: p["x"].isNotNull())
    return g.select("_d", "_o", F.posexplode(parts).alias("_n", "_p")).select(*_passage(F.col("_d"), F.col("_n"), F.col("_p.s"), F.col("_p.o"), F.col("_p.x")), F.col("_o.line_no").alias("line_no"))


def of_medline(files: DataFrame) -> DataFrame:
    """Tagged records; lines of four blanks continue the field before, each with a blank after;
    a blank line ends a record and its title and abstract, not its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["content"]:
                pmid, parts, tag = DEFAULT_DOC_ID, {}, ""

                def flush(pmid: str, parts: dict, out: list) -> None:
                    for n, t in enumerate(k for k in ("TI", "AB") if k in parts):
                        out.append((pmid, n, t, 0, parts[t], {"docid": pmid, "section": t}))

                for line in re.split(r"\r\n|\r|\n", text):
                    if not line.strip():
                        flush(pmid, parts, out)
                        parts, tag = {}, ""
                        continue
                    if line[:4].strip():
                        tag = line[:4].strip()
                        value = line[6:]
                    else:
                        value = line.strip()
                    if tag == "PMID":
                        pmid = value.strip()
                    elif tag in ("TI", "AB"):
                        parts[tag] = parts.get(tag, "") + value + " "
                flush(pmid, parts, out)
            yield pd.DataFrame(out, columns=["docid", "passage_no", "fieldid", "base_offset", "text", "infons"])

    return files.select("content").mapInPandas(run, SCHEMA)


def _xml(files: DataFrame, parse: Callable[[bytes], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["content"]:
                out += parse(text.encode("utf-8"))
            yield pd.DataFrame(out, columns=["docid", "passage_no", "fieldid", "base_offset", "text", "infons"])

    return files.select("content").mapInPandas(run, SCHEMA)


def _pubmed(data: bytes) -> list[tuple]:
    out: list[tuple] = []
    for _, el in ElementTree.iterparse(BytesIO(data), events=("end",)):
        if el.tag != "PubmedArticle":
            continue
        cite = el.find("MedlineCitation")
        pmid = (cite.findtext("PMID") if cite is not None else None) or DEFAULT_DOC_ID
        found = [("title", x) for x in el.iter("ArticleTitle")] + [("abstract", x) for x in el.iter("AbstractText")]
        for n, (section, x) in enumerate(found):
            infons = {"docid": pmid, "section": section} | {k: v for k, v in x.attrib.items() if k == "Label"}
            out.append((pmid, n, section, 0, "".join(x.itertext()), infons))
        el.clear()
    return out


def of_pubmed(files: DataFrame) -> DataFrame:
    """A passage for every title and abstract part of an article, inline markup flattened. Files
    are parsed one element at a time."""
    return _xml(files, _pubmed)


def _bioc(data: bytes) -> list[tuple]:
    out: list[tuple] = []
    infons = lambda e: {i.get("key", ""): i.text or "" for i in e.findall("infon")}
    for _, el in ElementTree.iterparse(BytesIO(data), events=("end",)):
        if el.tag != "document":
            continue
        docid, n = el.findtext("id") or DEFAULT_DOC_ID, 0
        for p in el.findall("passage"):
            info = infons(el) | infons(p)
            section = info.get("section") or info.get("type")
            if (t := p.findtext("text")) is not None:
                out.append((docid, n, section, 0, t, info))
                n += 1
            for s in p.findall("sentence"):
                out.append((docid, n, section, int(s.findtext("offset") or 0), s.findtext("text") or "", info | infons(s)))
                n += 1
        el.clear()
    return out


def of_bioc(files: DataFrame) -> DataFrame:
    """Passages from 0, every sentence as a further passage at its own offset, infons merged."""
    return _xml(files, _bioc)


def filled(passages: DataFrame) -> DataFrame:
    """Blank ids replaced; a passage's own docid infon holds before its document's."""
    own = F.col("infons")["docid"]
    fill = F.when(F.trim("docid") == "", DEFAULT_DOC_ID).otherwise(F.coalesce("docid", F.lit(DEFAULT_DOC_ID)))
    return passages.withColumn("docid", F.coalesce(own, fill))


def text_at(text: Column, base_offset: Column, start: Column, length: Column) -> Column:
    """The stretch of a passage at an absolute position."""
    return F.substring(text, start - base_offset + 1, length)


_LINES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sli": of_single_lines,
    "sldi": of_single_lines,
    "sldiwi": of_id_lines,
    "chemdner": of_title_abstract,
    "ncbicorpus": of_tagged_title_abstract,
    "chemdnersldi": of_bar_title_abstract,
    "pubtator": of_pubtator,
}
_FILES: dict[str, Callable[[DataFrame], DataFrame]] = {"freetext": of_freetext, "pubmed": of_pubmed, "medline": of_medline, "bioc": of_bioc}
_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {k: (lambda files, f=f: f(file_lines(files))) for k, f in _LINES.items()} | _FILES


def register(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """A reader of frames (name, content) under a name; a known name is replaced."""
    _REGISTRY[name.lower()] = reader


def reader(name: str) -> Callable[[DataFrame], DataFrame]:
    if name.lower() not in _REGISTRY:
        raise ValueError(f"format {name!r} is none of {sorted(_REGISTRY)}")
    return _REGISTRY[name.lower()]


def load(spark: SparkSession, path: str, format: str = "freetext", encoding: str = "utf-8", recursive: bool = False) -> DataFrame:  # noqa: A002
    """Passages of files in one of the registered formats."""
    return filled(reader(format)(read_files(spark, path, encoding, recursive)))


def read_export(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:  # noqa: A002
    """Exported mentions: CSV with a header, or JSON lines with nested annotations."""
    if format == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    j = spark.read.json(path)
    return j.select(*[c for c in j.columns if c != "annotations"], F.explode("annotations").alias("_a")).select(*[c for c in j.columns if c != "annotations"], "_a.*")
