"""Building and querying a terminology.

The tables: ``names`` (ord, cui, sui, str, norm, sab, tty), ``concepts`` (cui, preferred_name),
``types`` (cui, tui, abbrev), ``treecodes`` (ord, term, treecode) and ``meta`` (key, value). Row
order means something here, so every row has its ``ord``. Lookups are joins, not point queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T

NORM_VERSION = "1"
# Fields of the pipe-delimited files, by position.
CONSO = {"cui": 0, "lat": 1, "ts": 2, "stt": 4, "sui": 5, "sab": 11, "tty": 12, "str": 14, "suppress": 16}
DEFAULT_SOURCES = ("SNOMEDCT_US", "ICD10CM", "RXNORM", "LNC")
NO_TREECODE = "x.x.x.x"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(ord, f): the fields of a pipe-delimited file. No quoting; ``ord`` follows file order."""
    raw = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    # dense ranks by file and block: counts of blocks are small, their prefix sum gives each its base
    per = raw.groupBy("p", "b").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    base = per.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("p", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "b", "first", "base")
    own = F.row_number().over(Window.partitionBy("p", "b").orderBy("i")) - 1
    return raw.join(base, ["p", "b"]).select((F.col("base") + own).alias("ord"), F.split("value", r"\|", -1).alias("f"))


def conso(fields: DataFrame) -> DataFrame:
    """The columns used of name rows; short rows are skipped."""
    return fields.where(F.size("f") > 16).select("ord", *[F.col("f")[i].alias(n) for n, i in CONSO.items()])


def names(conso_rows: DataFrame, sources: tuple[str, ...] | None = None, include_suppressed: bool = False) -> DataFrame:
    """English names that are not suppressed, of the wanted sources, with their key."""
    rows = conso_rows.where("lat = 'ENG'").withColumn("norm", T.index_key(F.col("str"))).where("norm <> ''")
    if sources:
        rows = rows.where(F.col("sab").isin(*sources))
    if not include_suppressed:
        rows = rows.where(~F.col("suppress").isin("O", "E", "Y"))
    return rows.select("ord", "cui", "sui", "str", "norm", "sab", "tty")


def preferred_names(conso_rows: DataFrame) -> DataFrame:
    """Per concept its last English preferred form, or else the last of its other rows."""
    form = F.expr("lat = 'ENG' and ts = 'P' and stt = 'PF'")
    last = lambda c: F.max_by(F.when(c, F.col("str")), F.when(c, F.col("ord")))
    return conso_rows.groupBy("cui").agg(F.coalesce(last(form), last(~form)).alias("preferred_name"))


def types(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(cui, tui, abbrev); an unknown type keeps its own code. The catalogue has 127 rows."""
    rows = fields.select(F.col("f")[0].alias("cui"), F.col("f")[1].alias("tui"))
    return rows.join(F.broadcast(catalogue.select("tui", "abbrev")), "tui", "left").select("cui", "tui", F.coalesce("abbrev", "tui").alias("abbrev"))


def treecodes(conso_rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Tree codes of all MSH strings, duplicates included, in order; a dummy where there is none."""
    codes = attributes.where((F.size("f") > 10) & (F.col("f")[8] == "MN")).select(F.col("ord").alias("o2"), F.col("f")[0].alias("cui"), F.col("f")[10].alias("treecode"))
    msh = conso_rows.where("sab = 'MSH'").select("ord", "cui", F.lower("str").alias("term"))
    return msh.join(codes, "cui", "left").select("ord", "o2", "term", F.coalesce("treecode", F.lit(NO_TREECODE)).alias("treecode"))


def build(spark: SparkSession, out: str, conso_path: str, sty_path: str, catalogue: DataFrame, sat_path: str | None = None, sources: tuple[str, ...] | None = None, include_suppressed: bool = False, overwrite: bool = False) -> None:
    """All tables below ``out``. Refuses a folder that holds an index unless told to overwrite;
    ``meta`` is written last, so a build that broke off is never taken for an index."""
    mode = "overwrite" if overwrite else "errorifexists"
    c = conso(scan(spark, conso_path))
    names(c, sources, include_suppressed).repartition("norm").sortWithinPartitions("norm").write.mode(mode).parquet(f"{out}/names")
    preferred_names(c).write.mode(mode).parquet(f"{out}/concepts")
    types(scan(spark, sty_path), catalogue).write.mode(mode).parquet(f"{out}/types")
    if sat_path:
        treecodes(c, scan(spark, sat_path)).write.mode(mode).parquet(f"{out}/treecodes")
    spark.createDataFrame([("norm_version", NORM_VERSION), ("sources", ",".join(sources or ())), ("include_suppressed", str(include_suppressed))], "key string, value string").write.mode(mode).parquet(f"{out}/meta")


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; one made with another normalization is refused."""
    meta = spark.read.parquet(f"{path}/meta")
    got = {r["key"]: r["value"] for r in meta.limit(100).collect()}
    if got.get("norm_version") != NORM_VERSION:
        raise ValueError(f"the index has norm_version {got.get('norm_version')}, this code {NORM_VERSION}")
    return {"meta": meta} | {t: spark.read.parquet(f"{path}/{t}") for t in ("names", "concepts", "types")}


def keep_sources(fields: DataFrame, sources: tuple[str, ...] = DEFAULT_SOURCES) -> DataFrame:
    """The lines of the wanted sources, verbatim."""
    return fields.where(F.col("f")[CONSO["sab"]].isin(*sources))


def source_counts(fields: DataFrame, sources: tuple[str, ...] = DEFAULT_SOURCES) -> DataFrame:
    """Rows per wanted source, zero included."""
    want = fields.sparkSession.createDataFrame([(s,) for s in sources], "sab string")
    n = keep_sources(fields, sources).groupBy(F.col("f")[CONSO["sab"]].alias("sab")).agg(F.count(F.lit(1)).alias("n"))
    return want.join(n, "sab", "left").select("sab", F.coalesce("n", F.lit(0)).alias("n"))


def keep_relations(fields: DataFrame, rules: DataFrame, sab: Column, rel: Column, rela: Column) -> DataFrame:
    """Rows of which (source, relation) or (source, finer relation) stands in the rule table."""
    r = rules.select("sab", "value").distinct()
    x = fields.withColumn("_sab", sab).withColumn("_v", F.array_distinct(F.array(rel, rela)))
    hit = F.broadcast(r.groupBy(F.col("sab").alias("_sab")).agg(F.collect_set("value").alias("_ok")))  # a row per source
    return x.join(hit, "_sab").where(F.arrays_overlap("_v", "_ok")).drop("_sab", "_v", "_ok")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, value): rows of every table and distinct keys."""
    parts = [t.agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"{n}_rows").alias("key"), "value") for n, t in tables.items()]
    parts.append(tables["names"].agg(F.count_distinct("norm").alias("value")).select(F.lit("distinct_keys").alias("key"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- lookups ---------------------------------------------------------------------------------------


def with_keys(terms: DataFrame, term: str) -> DataFrame:
    """Q1: a row for every key of a term, with its rank."""
    return terms.select("*", F.posexplode(T.lookup_keys(F.col(term))).alias("key_rank", "norm"))


def cuis_for_terms(terms: DataFrame, term: str, names_: DataFrame) -> DataFrame:
    """Q2, Q3: (term, cuis): sorted concepts under any key of each term; absent terms are absent."""
    keys = with_keys(terms.select(term).distinct(), term)
    return keys.join(names_.select("norm", "cui").distinct(), "norm").groupBy(term).agg(F.array_sort(F.collect_set("cui")).alias("cuis"))


def known_terms(terms: DataFrame, term: str, names_: DataFrame) -> DataFrame:
    """Q4: the terms that have an entry."""
    return with_keys(terms.select(term).distinct(), term).join(names_.select("norm"), "norm", "left_semi").select(term).distinct()


def concept_strings(pairs: DataFrame, names_: DataFrame) -> DataFrame:
    """Q5: of (norm, cui) the first string in row order, or the key itself; and all distinct ones."""
    got = names_.groupBy("norm", "cui").agg(F.min_by("str", "ord").alias("first"), F.array_sort(F.collect_set("str")).alias("strings"))
    return pairs.join(got, ["norm", "cui"], "left").select("norm", "cui", F.coalesce("first", "norm").alias("concept_string"), F.coalesce("strings", F.array()).alias("strings"))


def preferred(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Q6: the preferred name of each cui, or the cui itself."""
    return pairs.join(concepts, "cui", "left").withColumn("preferred_name", F.coalesce("preferred_name", "cui"))


def semantic_types(types_: DataFrame) -> DataFrame:
    """Q7: (cui, semantic_types) in order."""
    return types_.groupBy("cui").agg(F.sort_array(F.collect_list("abbrev")).alias("semantic_types"))


def sources(names_: DataFrame) -> DataFrame:
    """Q8: (cui, sources): distinct sources in order of first appearance."""
    first = names_.groupBy("cui", "sab").agg(F.min("ord").alias("ord"))
    return first.groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sab"))), lambda x: x.sab).alias("sources"))


def mesh_treecodes(terms: DataFrame, term: str, codes: DataFrame) -> DataFrame:
    """Q9: (term, codes): tree codes of a name whatever its case, duplicates kept, in order."""
    got = terms.withColumn("_k", F.lower(term)).join(codes.withColumnRenamed("term", "_k"), "_k", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("treecode").isNotNull(), F.struct("ord", "o2", "treecode"))))
    return got.groupBy(term).agg(F.transform(ordered, lambda x: x.treecode).alias("codes"))


def lookup(terms: DataFrame, term: str, names_: DataFrame, concepts: DataFrame, types_: DataFrame, only_sources: set[str] | None = None, only_types: set[str] | None = None) -> DataFrame:
    """Q10: a row per (term, cui, sab, tty), the first string holding; the source filter looks at the
    matched row alone, the type filter at the concept."""
    rows = with_keys(terms.select(term).distinct(), term).join(names_, "norm")
    if only_sources:
        rows = rows.where(F.col("sab").isin(*only_sources))
    one = rows.groupBy(term, "cui", "sab", "tty").agg(F.min_by("str", F.struct("key_rank", "ord")).alias("matched"))
    st = types_.groupBy("cui").agg(F.array_sort(F.collect_set("abbrev")).alias("semantic_types"), F.collect_set("tui").alias("tuis"))
    out = preferred(one, concepts).join(st, "cui", "left")
    if only_types:
        out = out.where(F.arrays_overlap("tuis", F.array(*[F.lit(t) for t in sorted(only_types)])))
    return out.select(term, "cui", "preferred_name", "matched", "sab", "tty", F.coalesce("semantic_types", F.array()).alias("semantic_types"))


def type_restriction(spec: str | None, catalogue: dict[str, str]) -> set[str]:
    """Q12: type codes named in a comma list by code or abbreviation, in any case; empty: all.
    ``catalogue``: abbreviation to code."""
    by = {a.lower(): t for a, t in catalogue.items()} | {t.lower(): t for t in catalogue.values()}
    wanted = [w.strip().lower() for w in (spec or "").split(",") if w.strip()]
    if not wanted or "all" in wanted:
        return set()
    unknown = [w for w in wanted if w not in by]
    if unknown:
        raise ValueError(f"unknown semantic types: {', '.join(unknown)}")
    return {by[w] for w in wanted}


def source_restriction(spec: str | None) -> set[str]:
    """Q12: source names of a comma list in upper case; empty: all."""
    wanted = {w.strip().upper() for w in (spec or "").split(",") if w.strip()}
    return set() if "ALL" in wanted else wanted
