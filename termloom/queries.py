"""Queries of the core and, where SQL can say it, their SQL.

The tables of the data folder stand for the engine's own: ``cuisourceinfo`` for dictionary names,
``concepts`` for preferred names, ``passages`` for loaded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import abbreviation, analytics, context, match, negation, nested, rank, semtypes, tagging
from termloom.operators import dictionary as D
from termloom.plans.pipeline import Settings, annotate
from termloom.session import kept, read, scratch_path
from termloom.sources import documents, sinks

Query = Callable[[SparkSession, str], DataFrame]

#: Semantic types of the derived type table, by place (the last digits of a cui choose one).
TYPES = (("T047", "dsyn"), ("T184", "sosy"), ("T121", "phsu"), ("T059", "lbpr"), ("T061", "topp"), ("T033", "fndg"), ("T191", "neop"), ("T079", "tmco"))
RELATIONS = (("A", "F"), ("N", "O"), ("R", "1-URGENT"))


# --- derived inputs ----------------------------------------------------------------------------


def _names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cuisourceinfo").distinct()


def _conso(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d)
    return n.select("ord", "cui", "sui", "str", "sab", "tty", F.lit("ENG").alias("lat"), F.when(F.col("tty") == "PT", "P").otherwise("S").alias("ts"), F.lit("PF").alias("stt"), F.lit("N").alias("suppress"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("cui", -3, 3).cast("int") % len(TYPES)
    table = F.array(*[F.struct(F.lit(t).alias("tui"), F.lit(a).alias("abbrev")) for t, a in TYPES])
    return read(spark, d, "concepts").select("cui", table[n].alias("t")).select("cui", "t.tui", "t.abbrev")


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """Passages as delivered; operators that end in mentions count a repeated one once by themselves."""
    return read(spark, d, "passages").select("passage_id", "docid", "fieldid", "base_offset", "text").where("text is not null")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return match.distinct_passages(_delivered(spark, d))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return match.sentence_rows(_passages(spark, d))


def _raw_sentences(spark: SparkSession, d: str) -> DataFrame:
    return match.sentence_rows(_delivered(spark, d))


def _found(spark: SparkSession, d: str, **how: object) -> DataFrame:
    n = read(spark, d, "cuisourceinfo")
    return match.found(_raw_sentences(spark, d), match.dictionary(n), keys=n, **how)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


def _negated(spark: SparkSession, d: str) -> DataFrame:
    """By the whole lexicon, for concepts of types that can be negated. Spans are marked as they are made,
    the scope is a column of the dictionary: nothing is joined back."""
    n = read(spark, d, "cuisourceinfo")
    dict_ = match.dictionary(n).join(negation.negatable(_types(spark, d)).withColumn("in_scope", F.lit(True)), "cui", "left")
    return negation.scoped(match.found(_raw_sentences(spark, d), dict_, keys=n, flag=negation.scanner().flag))


def _full(spark: SparkSession, d: str) -> DataFrame:
    m = _negated(spark, d).withColumn("pos", F.lit(""))
    return D.preferred(m, read(spark, d, "concepts")).join(D.semantic_types(_types(spark, d)), "cui", "left").join(D.sources(_names(spark, d)), "cui", "left")


def _treecodes(spark: SparkSession, d: str) -> DataFrame:
    codes = read(spark, d, "concepts").where("substring(cui, -1, 1) in ('1', '2')").select(F.substring("cui", 2, 8).cast("bigint").alias("ord"), F.array(F.col("cui"), *[F.lit("")] * 7, F.lit("MN"), F.lit("MSH"), F.concat(F.lit("C"), F.substring("cui", -2, 2), F.lit(".1")), F.lit("N"), F.lit("")).alias("f"))
    msh = _conso(spark, d).withColumn("sab", F.when(F.col("sab") == "LEXA", "MSH").otherwise(F.col("sab")))
    return D.treecodes(msh, codes)


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """(cui, codes): the tree codes of every concept's preferred name."""
    c = read(spark, d, "concepts")
    return c.join(D.mesh_treecodes(c.select("preferred_name").distinct(), "preferred_name", _treecodes(spark, d)), "preferred_name").select("cui", "codes")


def _defined(spark: SparkSession, d: str) -> DataFrame:
    """Passages that define an abbreviation: every concept's name of several words with its initials."""
    c = read(spark, d, "concepts").where("preferred_name like '% %'")
    initials = F.array_join(F.transform(F.split("preferred_name", " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    text = F.concat("preferred_name", F.lit(" ("), initials, F.lit(") was noted. "), initials, F.lit(" is stable."))
    return c.select(F.substring("cui", 2, 8).cast("bigint").alias("passage_id"), F.col("cui").alias("docid"), F.lit("text").alias("fieldid"), F.lit(10).alias("base_offset"), text.alias("text"))


def _plain(text: str) -> Column:
    """A text without controls and what markup can't hold."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f\x{fffe}\x{ffff}]", " ")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text is not null")
    one = F.regexp_replace("text", r"[\t\r\n|]", " ")
    return docs.select(F.lit("f").alias("name"), F.col("doc_id").alias("line_no"), F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.substring(one, 1, 20), F.lit("\t"), F.expr("substring(regexp_replace(text, '[\\\\t\\\\r\\\\n|]', ' '), 21)")).alias("content"))


# --- queries -----------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over all passages: mentions with assertion, after subsumption."""
    return annotate(_delivered(spark, d), read(spark, d, "cuisourceinfo"), Settings(), _types(spark, d)).select("docid", "passage_id", "start", "length", "term", "cui", "concept_string", "negated")


def e14_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The same without abbreviations."""
    return annotate(_delivered(spark, d), read(spark, d, "cuisourceinfo"), Settings(abbreviations=False), _types(spark, d)).select("docid", "passage_id", "start", "length", "term", "cui", "concept_string", "negated")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every readable child of the nested records with its link to the parent."""
    return nested.children(read(spark, d, "annotation_records"))


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema of the payloads."""
    return nested.merged_schema(read(spark, d, "annotation_records"), "payload")


def _flat(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A flat table of the nested records, a record delivered again once."""
    return nested.annotation_tables(read(spark, d, "annotation_records"))[name].distinct()


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "passage")


def p3_infons(spark: SparkSession, d: str) -> DataFrame:
    """The infons of the passages with their values."""
    return _flat(spark, d, "infon")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "entity")


def p3_evs(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "ev")


def p3_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "concept")


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "source")


def p3_semantic_types(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "semantic_type")


def d3_names(spark: SparkSession, d: str) -> DataFrame:
    return D.names(_conso(spark, d), ("LEXA", "CLINT")).select("ord", "cui", "norm", "sab")


def d5_preferred_name(spark: SparkSession, d: str) -> DataFrame:
    return D.preferred_names(_conso(spark, d))


def d6_semtypes(spark: SparkSession, d: str) -> DataFrame:
    rows = _types(spark, d).select(F.array("cui", "tui").alias("f"))
    known = spark.createDataFrame([t for t in TYPES if t[1] != "tmco"], "tui string, abbrev string")
    return D.types(rows, known)


def d7_treecodes(spark: SparkSession, d: str) -> DataFrame:
    return _treecodes(spark, d).select("ord", "term", "treecode")


def d8_build(spark: SparkSession, d: str) -> DataFrame:
    """The names of an index built from pipe-delimited files and opened again."""
    n = _names(spark, d).orderBy("ord")
    out = scratch_path(spark, "index")
    fields = ["cui", F.lit("ENG"), F.lit("P"), F.lit("L"), F.lit("PF"), "sui", F.lit("Y"), F.lit("A"), F.lit(""), F.lit(""), F.lit("D"), "sab", "tty", F.lit("1"), F.regexp_replace("str", r"[|\r\n]", " "), F.lit("0"), F.lit("N"), F.lit("")]
    n.select(F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in fields]).alias("value")).write.text(f"{out}/conso")
    _types(spark, d).select(F.concat_ws("|", "cui", "tui", F.lit(""))).write.text(f"{out}/sty")
    D.build(spark, f"{out}/built", f"{out}/conso", f"{out}/sty", semtypes.catalogue(spark))
    return D.open_index(spark, f"{out}/built")["names"].select("cui", "sui", "str", "norm", "sab", "tty")


def d10_source_counts(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d)
    f = n.select(F.array(*[F.lit("")] * 11, F.col("sab")).alias("f"))
    return D.source_counts(f, ("LEXA", "CLINT", "NOSUCH"))


def d11_relations(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(list(RELATIONS), "sab string, value string")
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    return D.keep_relations(x, rules, F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linestatus")).select("l_orderkey", "l_linenumber")


def d12_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.stats({"names": _names(spark, d), "concepts": read(spark, d, "concepts"), "types": _types(spark, d)})


def q2_cuis(spark: SparkSession, d: str) -> DataFrame:
    return D.cuis_for_terms(read(spark, d, "concepts"), "preferred_name", _names(spark, d)).select("preferred_name", F.array_join("cuis", ",").alias("cuis"))


def q4_known(spark: SparkSession, d: str) -> DataFrame:
    return D.known_terms(read(spark, d, "entities").where("matched_text is not null"), "matched_text", _names(spark, d))


def q5_strings(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d)
    return D.concept_strings(n.select("norm", "cui").distinct(), n).select("norm", "cui", "concept_string", F.size("strings").alias("n_strings"))


def q6_preferred(spark: SparkSession, d: str) -> DataFrame:
    return D.preferred(read(spark, d, "evidence").select("cui").distinct(), read(spark, d, "concepts")).select("cui", "preferred_name")


def q7_types(spark: SparkSession, d: str) -> DataFrame:
    return D.semantic_types(_types(spark, d)).select("cui", F.array_join("semantic_types", ",").alias("semantic_types"))


def q8_sources(spark: SparkSession, d: str) -> DataFrame:
    return D.sources(_names(spark, d)).select("cui", F.array_join("sources", ",").alias("sources"))


def q9_treecodes(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("cui", F.array_join("codes", ",").alias("codes"))


def q12_restriction(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the types named by code or abbreviation in any case."""
    wanted = D.type_restriction("DSYN, t184,Neop", {a: t for t, a, _ in semtypes.rows()})
    return _types(spark, d).where(F.col("tui").isin(*sorted(wanted))).select("cui", "tui")


def q13_types(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's name of every concept's type."""
    return _types(spark, d).join(semtypes.catalogue(spark).select("tui", "name"), "tui").select("cui", "tui", "name")


def q10_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = read(spark, d, "concepts").select(F.col("preferred_name").alias("query"))
    r = D.lookup(terms, "query", _names(spark, d), read(spark, d, "concepts"), _types(spark, d), {"LEXA", "CLINT"}, {"T047", "T184"})
    return r.select("query", "cui", "preferred_name", "matched", "sab", "tty", F.array_join("semantic_types", ",").alias("semantic_types"))


def s1_freetext(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").where("text is not null").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    return documents.of_freetext(files, "text").select("docid", "passage_no", "fieldid", "base_offset", "text")


def s2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a document of its own."""
    files = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    lines = documents.of_single_lines(documents.file_lines(files))
    return lines.select("docid", "passage_no", "fieldid", "base_offset", "line_no", "text")


def s4_id_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).withColumn("content", F.concat(F.col("line_no").cast("string"), F.when(F.col("line_no") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("|"), F.regexp_replace("content", "\t", " "), F.lit("|more")))))
    return documents.of_id_lines(lines).select("docid", "line_no", "fieldid", "base_offset", "text")


def s6_tagged(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).withColumn("content", F.regexp_replace("content", "the", '<category="Disease">the</category>'))
    return documents.of_tagged_title_abstract(lines).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s7_bar_title_abstract(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).withColumn("content", F.regexp_replace("content", "^([0-9]+)\t", "$1|"))
    return documents.of_bar_title_abstract(lines).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s9_pubmed(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("k"), _escaped(_plain("text")).alias("t"))
    xml = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), "k", F.lit("</PMID><Article><ArticleTitle>Note <i>"), "k", F.lit("</i></ArticleTitle><Abstract><AbstractText Label='A'>"), "t", F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"))
    return documents.of_pubmed(x.select(xml.alias("content"))).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s10_medline(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").where("text is not null and trim(text) <> ''").select(F.col("doc_id").cast("string").alias("k"), _plain("text").alias("t"))
    text = F.concat(F.lit("PMID- "), "k", F.lit("\nTI  - Note\n      "), "k", F.lit("\nAB  - x"), "t", F.lit("\n"))
    return documents.of_medline(x.select(text.alias("content"))).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s10b_bioc(spark: SparkSession, d: str) -> DataFrame:
    x = _passages(spark, d).select(F.col("passage_id").cast("string").alias("k"), _escaped(_plain("text")).alias("t"))
    xml = F.concat(F.lit("<collection><document><id>"), "k", F.lit("</id><infon key='type'>note</infon><passage><offset>7</offset><text>"), "t", F.lit("</text><sentence><offset>9</offset><text>"), "t", F.lit("</text></sentence></passage></document></collection>"))
    return documents.of_bioc(x.select(xml.alias("content"))).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s12_filled(spark: SparkSession, d: str) -> DataFrame:
    return documents.filled(read(spark, d, "passages").select("passage_id", "docid", "infons").dropDuplicates(["passage_id"])).select("passage_id", "docid")


def s13b_text_at(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "sentences").where("text is not null").dropDuplicates(["sent_id"]).select("sent_id", "passage_id", "sent_offset", F.length("text").alias("n"))
    p = _passages(spark, d).select("passage_id", "base_offset", "text")
    return s.join(p, "passage_id").select("sent_id", documents.text_at(F.col("text"), F.col("base_offset"), F.col("sent_offset"), F.col("n")).alias("piece"))


def s14_export(spark: SparkSession, d: str) -> DataFrame:
    """Entities exported as JSON lines with nested annotations, and read again."""
    out = scratch_path(spark, "export")
    e = read(spark, d, "entities").dropDuplicates(["entity_id"])
    e.select(F.col("docid").alias("document"), F.array(F.struct("entity_id", "start", F.col("matched_text").alias("term"))).alias("annotations")).write.json(out)
    return documents.read_export(spark, out, "json").select("document", "entity_id", "start", "term")


def s15_results(spark: SparkSession, d: str) -> DataFrame:
    """JSON results of every entity, read back to the table of evidence."""
    e = read(spark, d, "entities").dropDuplicates(["entity_id"]).where("docid is not null and start is not null")
    v = read(spark, d, "evidence").dropDuplicates(["evidence_id"])
    ev = F.struct(F.lit("ev0").alias("id"), v["matched_text"].alias("matchedtext"), v["score"], v["start"], v["length"], F.struct(v["cui"], v["concept_string"].alias("preferredname"), v["concept_string"].alias("conceptstring"), F.array(F.lit("dsyn")).alias("semantictypes"), F.array(F.lit("A"), F.lit("B")).alias("sources")).alias("conceptinfo"))
    rows = e.join(v, "entity_id").select(F.array(F.struct("docid", F.lit("en0").alias("id"), e["matched_text"].alias("matchedtext"), "fieldid", e["start"], e["length"], (F.coalesce("negated", F.lit(0)) == 1).alias("negated"), F.array(ev).alias("evlist"))).alias("l"))
    back = sinks.read_json(rows.select(F.encode(F.to_json("l", {"ignoreNullFields": "false"}), "utf-8").alias("content")))
    return sinks.result_tables(back)["evidence"].select("docid", "entity_start", "entity_length", "cui", "matched_text", F.round("score", 6).alias("score"), "start", "length")


def s5_title_abstract(spark: SparkSession, d: str) -> DataFrame:
    return documents.of_title_abstract(_lines(spark, d)).select("docid", "passage_no", "fieldid", "base_offset", "text")


def s8_pubtator(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d).select("passage_id", F.regexp_replace("text", r"[\r\n|]", " ").alias("t"))
    lines = p.select(F.lit("f").alias("name"), F.col("passage_id").alias("line_no"), F.concat((F.col("passage_id") / 4).cast("bigint").cast("string"), F.when(F.col("passage_id") % 2 == 0, "|t|").otherwise("|a|"), F.col("t")).alias("content"))
    return documents.of_pubtator(lines).select("docid", "passage_no", "fieldid", "base_offset", "text")


def t1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("passage_id", "sent_idx", "sent_start", "sent")


def t2_blanklines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.blank_line_blocks(F.col("text"))).alias("i", "s")).select("doc_id", "i", "s.start", "s.text")


def t3_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "s")).select("doc_id", "i", "s.start", "s.text")


def t5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.explode_tokens(_passages(spark, d), "text", ["passage_id"])


def t8_words(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without white space, and the length of the text they join to again."""
    t = T.token_texts(F.col("text"))
    return _passages(spark, d).select("passage_id", F.size(T.without_blanks(t)).alias("words"), F.length(T.joined(t)).alias("chars"))


def t7_token_classes(spark: SparkSession, d: str) -> DataFrame:
    return t5_tokens(spark, d).groupBy(T.token_class(F.col("token")).alias("token_class")).agg(F.count(F.lit(1)).alias("n"))


def t9_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("ord", T.normalize(F.col("str")).alias("normal"))


def t12_number_format(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.number_format(F.col("p_retailprice")).alias("price"))


def e1_candidates(spark: SparkSession, d: str) -> DataFrame:
    return match.candidates(_sentences(spark, d)).select("passage_id", "start", "length", "term")


def e2_matches(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("passage_id", "start", "length", "term", "cui", "concept_string", "window_no")


def e1_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Spans where a tagger says which words may begin one."""
    t = tagging.LexiconTagger({w: {"DT": 1.0} for w in ("the", "a", "this")} | {"was": {"VBD": 0.9}, "dose": {"VB": 0.9, "NN": 0.1}})
    return match.candidates(_sentences(spark, d), tagger=t).select("passage_id", "start", "length", "term")


def e4_excluded(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "cuisourceinfo")
    out = n.where("substring(cui, -1, 1) = '3'").select("cui", "norm").distinct()
    return match.found(_raw_sentences(spark, d), match.dictionary(n), out, keys=n).select("passage_id", "start", "length", "cui")


def e5_custom(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([("U0000001", "Dose"), ("U0000002", "The Margin")], "cui string, term string")
    m = match.found(_raw_sentences(spark, d), match.dictionary(_names(spark, d), own))
    return m.where("is_custom = 1").select("passage_id", "start", "length", "cui", "concept_string")


def e6_entities(spark: SparkSession, d: str) -> DataFrame:
    e = match.entities(_mentions(spark, d))
    return e.select("docid", "passage_id", "start", "length", "term", F.array_join(F.transform("evs", lambda x: x["cui"]), ",").alias("cuis"))


def e8_first_origin(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary mentions of longer texts, and a user's mentions of any: at one span those of the first."""
    m = _mentions(spark, d).select("passage_id", "start", "length", "cui", "sent_idx")
    both = m.where("length > 12").withColumn("origin_rank", F.lit(0)).unionByName(m.withColumn("cui", F.lit("U")).distinct().withColumn("origin_rank", F.lit(1)))
    return match.first_per_span(both).select("passage_id", "start", "length", "cui")


def e9_lookup_term(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "cuisourceinfo")
    return match.looked_up(read(spark, d, "concepts"), "preferred_name", match.dictionary(n)).select("preferred_name", "start", "length", "cui")


def e13_order(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with their place in the final order of their passage."""
    w = Window.partitionBy("passage_id").orderBy("start", F.col("length").desc(), "cui")
    return match.in_order(_mentions(spark, d)).withColumn("place", F.row_number().over(w)).select("passage_id", "start", "length", "cui", "place")


def e10_restrict(spark: SparkSession, d: str) -> DataFrame:
    m = match.restrict(_mentions(spark, d), _types(spark, d), _names(spark, d).select("cui", "sab").distinct(), ("dsyn", "sosy", "neop"), ("LEXA",))
    return m.select("passage_id", "start", "length", "cui")


def e11_subsumption(spark: SparkSession, d: str) -> DataFrame:
    return match.drop_subsumed(_mentions(spark, d)).select("passage_id", "start", "length", "term", "cui")


def e12_precision(spark: SparkSession, d: str) -> DataFrame:
    return match.precise(match.drop_subsumed(_mentions(spark, d)), _names(spark, d)).select("passage_id", "start", "length", "cui")


def a1_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """The abbreviations of the passages, and of passages that define one for every name of several words."""
    return abbreviation.definitions(match.sentence_rows(_passages(spark, d).unionByName(_defined(spark, d))))


def a1_defined(spark: SparkSession, d: str) -> DataFrame:
    return abbreviation.definitions(match.sentence_rows(_defined(spark, d)))


def a4_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Mentions copied to the short forms that the passages define."""
    p = _passages(spark, d).unionByName(_defined(spark, d))
    n = read(spark, d, "cuisourceinfo")
    s = match.sentence_rows(p)
    return abbreviation.propagated(match.found(s, match.dictionary(n), keys=n), abbreviation.definitions(s), p).select("passage_id", "start", "length", "term", "cui")


def a4_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """What the pipeline finds in the passages that define abbreviations, short forms included."""
    m = annotate(_defined(spark, d), read(spark, d, "cuisourceinfo"), Settings(remove_subsumed=False), _types(spark, d))
    return m.where("origin_rank = 2").select("passage_id", "start", "length", "term", "cui")


def a6_user_acronyms(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "concepts").agg(F.min(F.struct("cui", "preferred_name")).alias("m")).select(F.lit("pH").alias("acronym"), F.col("m.preferred_name").alias("long_form"))
    a = abbreviation.user_acronyms(first, match.dictionary(_names(spark, d)))
    return abbreviation.user_mentions(_passages(spark, d), a).select("passage_id", "start", "length", "term", "cui", "score")


def n1_meta_tokens(spark: SparkSession, d: str) -> DataFrame:
    return negation.words(_sentences(spark, d))


def n3_triggers(spark: SparkSession, d: str) -> DataFrame:
    return negation.triggers(_sentences(spark, d)).select("passage_id", "sent_idx", "pos", "size", "kind")


def n4_longest(spark: SparkSession, d: str) -> DataFrame:
    return negation.longest(negation.triggers(_sentences(spark, d))).select("passage_id", "sent_idx", "pos", "size", "kind")


def n5_negation(spark: SparkSession, d: str) -> DataFrame:
    return _negated(spark, d).select("passage_id", "start", "length", "cui", "negated")


def n5_negation_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same for mentions made elsewhere, which meet their sentences in a join."""
    return negation.negated(_mentions(spark, d), _sentences(spark, d), None, negation.negatable(_types(spark, d))).select("passage_id", "start", "length", "cui", "negated")


def n6_positions(spark: SparkSession, d: str) -> DataFrame:
    return negation.positions(_mentions(spark, d), _sentences(spark, d))


def c3_context(spark: SparkSession, d: str) -> DataFrame:
    m = context.detected(match.drop_subsumed(_mentions(spark, d)), _sentences(spark, d), strict=False)
    return m.select("passage_id", "start", "length", "cui", "negated", "assertion", "temporality", "experiencer")


def c6_context_passage(spark: SparkSession, d: str) -> DataFrame:
    m = context.detected(match.drop_subsumed(_mentions(spark, d)), _sentences(spark, d))
    return m.select("passage_id", "start", "length", "cui", "negated", "assertion", "temporality", "experiencer")


def f1_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rank.term_frequency(_mentions(spark, d)).select("docid", "cui", "frequency", "title_flag")


def _depth() -> Column:
    """The summed depth of a concept's tree codes."""
    return F.aggregate(F.transform("codes", lambda c: F.size(F.split(c, r"\."))), F.lit(0), lambda a, x: a + x)


def f2_mmi_score(spark: SparkSession, d: str) -> DataFrame:
    tf = rank.term_frequency(_mentions(spark, d)).join(_codes(spark, d), "cui", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    s = rank.score(F.col("frequency"), F.col("average_value"), _depth(), F.col("title_flag") == 1)
    return tf.select("docid", "cui", F.round(s, 6).alias("score"))


def f3_mmi_lines(spark: SparkSession, d: str) -> DataFrame:
    m = kept(_full(spark, d), "mentions")
    tf = rank.term_frequency(m).join(_codes(spark, d), "cui", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    occ = m.groupBy("docid", "cui").agg(F.array_sort(F.collect_list(F.struct("passage_id", "start", "length", "concept_string", F.coalesce("fieldid", F.lit("text")).alias("fieldid"), "window_no", "term", "pos", F.col("negated").cast("int").alias("negated")))).alias("occurrences"))
    same = tf["docid"].eqNullSafe(occ["docid"]) & (tf["cui"] == occ["cui"])
    x = tf.join(occ, same).drop(occ["docid"], occ["cui"]).withColumn("score", rank.score(F.col("frequency"), F.col("average_value"), _depth(), F.col("title_flag") == 1))
    x = D.preferred(x.join(D.semantic_types(_types(spark, d)), "cui", "left"), read(spark, d, "concepts"))
    return rank.mmi_lines(x.withColumn("semantic_types", T.hash_ordered(F.coalesce("semantic_types", F.array().cast("array<string>"))))).select("docid", "preferred_name", "line")


def f4_hash_order(spark: SparkSession, d: str) -> DataFrame:
    return rank.hash_order(_names(spark, d), ["cui"], "sab", "ord")


def f5_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_entities(_full(spark, d))


def f6_brat(spark: SparkSession, d: str) -> DataFrame:
    return sinks.brat_lines(match.drop_subsumed(_full(spark, d)))


def f7_cuilist(spark: SparkSession, d: str) -> DataFrame:
    return sinks.cui_list(_mentions(spark, d))


def f8_ranked(spark: SparkSession, d: str) -> DataFrame:
    tf = rank.term_frequency(_mentions(spark, d)).withColumn("score", F.col("frequency").cast("double"))
    return sinks.ranked_tsv(tf).select("docid", "cui", "rank", "score")


def f9_full(spark: SparkSession, d: str) -> DataFrame:
    return sinks.full_text(_full(spark, d))


def f10_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.mention_rows(_negated(spark, d)).select("document", "cui", "term", "negated", "start", "end")


def f11_star(spark: SparkSession, d: str) -> DataFrame:
    return sinks.star_tables(_negated(spark, d))["documents"]


def f11_annotations(spark: SparkSession, d: str) -> DataFrame:
    return sinks.star_tables(_negated(spark, d))["annotations"].select("document", "cui", "term", "negated", "start_pos", "end_pos")


def f12_entities(spark: SparkSession, d: str) -> DataFrame:
    return sinks.normalized_tables(_full(spark, d))["entities"]


def f12_concepts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.normalized_tables(_full(spark, d))["concepts"]


def f12_types(spark: SparkSession, d: str) -> DataFrame:
    return sinks.normalized_tables(_full(spark, d))["concept_semantic_types"]


def f12_sources(spark: SparkSession, d: str) -> DataFrame:
    return sinks.normalized_tables(_full(spark, d))["concept_sources"]


def f12_evidence(spark: SparkSession, d: str) -> DataFrame:
    return sinks.normalized_tables(_full(spark, d))["evidence"].select("docid", "passage_id", "start", "length", "cui", "concept_string")


def f13_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every document, written below its own folder and read again."""
    out = scratch_path(spark, "files")
    sinks.write_lines(f6_brat(spark, d).where("docid is not null"), out, "brat", ["no", "part"])
    return spark.read.option("recursiveFileLookup", "false").text(f"{out}/format=ann").select(F.col("docid").cast("string").alias("docid"), F.col("value").alias("line"))


def g1_top_concepts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.corpus_summary(_mentions(spark, d), 25)


def g2_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.document_stats(_negated(spark, d))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "concepts").where("substring(cui, -1, 1) in ('3', '7')").select("cui")


def g3_cohort(spark: SparkSession, d: str) -> DataFrame:
    return analytics.cohort(_passages(spark, d), _negated(spark, d), _targets(spark, d))


def g4_resolved(spark: SparkSession, d: str) -> DataFrame:
    r = analytics.resolved_terms(read(spark, d, "concepts").select(F.col("preferred_name").alias("query")), "query", match.dictionary(read(spark, d, "cuisourceinfo")), read(spark, d, "concepts"), _types(spark, d))
    return r.select("query", "cui", "preferred_name", F.array_join("semantic_types", ",").alias("semantic_types"))


def g5_search(spark: SparkSession, d: str) -> DataFrame:
    """The row a search adds to the log, read from the log."""
    known = D.preferred(_targets(spark, d), read(spark, d, "concepts")).join(D.semantic_types(_types(spark, d)), "cui")
    log, path = analytics.search_log("1", "2026-01-01T00:00:00", None, "passages", kept(g3_cohort(spark, d), "cohort"), known), scratch_path(spark, "log")
    analytics.append_log(log, path)
    return spark.read.parquet(f"{path}/search").select("search_id", "corpus", F.length("cuis").alias("cuis"), "n_documents", "n_affirmed", "n_negated", "n_absent")


def g6_evidence_top(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_concepts(read(spark, d, "evidence").dropDuplicates(["evidence_id"]), read(spark, d, "concepts"), 10)


def g7_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entities").where("docid is not null")
    gold = e.join(read(spark, d, "evidence").select("entity_id", "cui"), "entity_id").select("docid", "cui")
    return analytics.agreement(_mentions(spark, d).where("docid is not null").select("docid", "cui"), gold, ["docid", "cui"]).select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def g8_differences(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entities").dropDuplicates(["entity_id"])
    later = e.where("entity_id % 7 <> 0").withColumn("negated", F.when(F.col("entity_id") % 5 == 0, 1).otherwise(F.col("negated")))
    return analytics.differences(e, later, ["entity_id"], ["negated", "temporality"])


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if callable(f) and (k == "flagship" or (len(k) > 2 and k[0] in "acdefgnpqst" and k[1].isdigit()))}


# --- SQL ---------------------------------------------------------------------------------------

_SP = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SEP = r"""~!@#$%^&*()_+\-=|\\<>?/,.`'';:\[\]{}"\x09-\x0d\x1c-\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"""
_EDGE = r"[0-9A-Za-z\x{370}-\x{377}\x{37a}-\x{37e}\x{384}-\x{38a}\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{3ff}]"
_WORDS = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


def _guard(x: str) -> str:
    return rf"""regexp_replace({x}, '(^|[{_SP}\x01])((?i:{_WORDS})|\p{{L}})\.([.?!]*)(["'')\]]*)\x01([{_SP}]+)\x01', '\1\2.\3\4\5', 'g')"""


def _normal(x: str) -> str:
    greek = ", ".join("'" + k.replace("'", "''") + "': '" + v + "'" for k, v in T.greek_names().items())
    spelled = f"(case when regexp_matches({x}, '[\\x{{370}}-\\x{{3ff}}]') then array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(map {{{greek}}}[c], c)), '') else {x} end)"
    tag = r"'^\[(?:X|V|D|M|EDTA|SO|Q)\]'"
    plain = f"(case when regexp_matches({spelled}, {tag}) then regexp_replace({spelled}, {tag}, '') else trim(regexp_replace({spelled}, ' +', ' ', 'g'), ' ') end)"
    words = rf"list_filter(regexp_split_to_array(lower({plain}), '[ \t\n\r\f$|~]+'), lambda w: w <> '')"
    one = r"case when w like '%''s' then regexp_replace(w, '([\p{L}\p{N}])''s$', '\1') else regexp_replace(w, 's''$', 's') end"
    return f"array_to_string(list_transform({words}, lambda w: {one}), ' ')"


_P = "p as (select passage_id, any_value(docid) docid, any_value(fieldid) fieldid, coalesce(any_value(base_offset), 0) base_offset, any_value(text) as text from passages where text is not null group by 1)"
_NAMES = "nm as (select distinct * from cuisourceinfo)"
_TYPES_SQL = "ty as (select cui, ([" + ", ".join(f"'{t}'" for t, _ in TYPES) + f"])[cast(right(cui, 3) as int) % {len(TYPES)} + 1] tui, ([" + ", ".join(f"'{a}'" for _, a in TYPES) + f"])[cast(right(cui, 3) as int) % {len(TYPES)} + 1] abbrev from concepts)"
_CUTS = rf"""regexp_replace(text, '([.?!]+)(["'')\]]*)([{_SP}]+)(["''(\[]*[A-Z0-9])', '\1\2' || chr(1) || '\3' || chr(1) || '\4', 'g')"""
_SENT = f"""{_P},
s0 as (select passage_id, docid, fieldid, base_offset, string_split({_guard(_guard(_CUTS))}, chr(1)) parts from p),
s1 as (select passage_id, docid, fieldid, base_offset, unnest(parts) part, generate_subscripts(parts, 1) k from s0),
s2 as (select *, sum(length(part)) over (partition by passage_id order by k) - length(part) ofs, regexp_replace(part, '^[{_SP}]+', '') l from s1),
s3 as (select passage_id, docid, fieldid, base_offset, ofs + length(part) - length(l) a, regexp_replace(l, '[{_SP}]+$', '') sent, k from s2),
se as (select passage_id, docid, fieldid, cast(row_number() over (partition by passage_id order by k) - 1 as int) sent_idx, cast(base_offset + a as int) sent_start, sent from s3 where length(sent) > 0)"""
_CAND = f"""{_SENT},
t0 as (select passage_id, docid, fieldid, sent_idx, sent_start, sent, regexp_extract_all(sent, '[^{_SEP}]+|[{_SEP}]') toks from se),
t1 as (select * exclude (toks), unnest(toks) tok, generate_subscripts(toks, 1) - 1 i, len(toks) n from t0),
t2 as (select *, sum(length(tok)) over (partition by passage_id, sent_idx order by i) - length(tok) ofs, sum(length(tok)) over (partition by passage_id, sent_idx order by i) fin from t1),
t3 as (select *, list(fin) over w fins, list(tok) over w nexts from t2 window w as (partition by passage_id, sent_idx order by i rows between current row and 14 following)),
t4 as (select *, unnest(range(1, len(fins) + 1)) k from t3 where regexp_matches(tok, '^{_EDGE}') and lower(tok) <> 'other'),
ca as (select passage_id, docid, fieldid, sent_idx, tok, i, i + k j, cast(sent_start + ofs as int) "start", cast(fins[k] - ofs as int) "length", substring(sent, cast(ofs + 1 as bigint), cast(fins[k] - ofs as bigint)) term
  from t4 where fins[k] - ofs > 2 and regexp_matches(nexts[k], '{_EDGE}$'))"""
_TERMS = "se as (select distinct preferred_name passage_id, preferred_name docid, null fieldid, 0 sent_idx, 0 sent_start, preferred_name sent from concepts where preferred_name is not null)"
_MATCH = f"""{_CAND}, {_NAMES},
di as (select norm, cui, arg_min(str, ord) concept_string from nm group by 1, 2),
k0 as (select distinct term from ca), k1 as (select term, lower(term) k, {_normal("term")} n from k0),
k2 as (select term, k norm, 0 r from k1 union all select term, n, 1 from k1 where n <> k),
h as (select k2.term, k2.norm, r, cui, concept_string from k2 join di using (norm)),
mt as (select ca.*, h.norm, h.cui, h.concept_string, greatest(0, j - 15) window_no from ca join h using (term) qualify row_number() over (partition by passage_id, "start", "length", cui order by r, sent_idx) = 1)"""
_TOP = """sp as (select distinct passage_id, "start", "start" + "length" e from mt),
tp as (select *, max(e) over (partition by passage_id order by "start", e desc rows between unbounded preceding and 1 preceding) m from sp),
su as (select mt.* from mt join tp on tp.passage_id = mt.passage_id and tp."start" = mt."start" and tp.e = mt."start" + mt."length" where m is null or m < e)"""
_LX = ", ".join(f"([{', '.join(repr(w) for w in p)}], '{k}', {i})" for i, (p, k) in enumerate(negation.default_lexicon()))
_SCOPE = "'acab', 'anab', 'biof', 'cgab', 'comd', 'dsyn', 'emod', 'fndg', 'inpo', 'lbtr', 'menp', 'mobd', 'neop', 'patf', 'phsf', 'sosy'"
_WORDS_SQL = rf"""
lx as (select * from (values {_LX}) v(phrase, kind, lex_ord)),
sg as (select phrase[1] w from lx where len(phrase) = 1),
x0 as (select *, regexp_matches(tok, '^[ \t\n\x0b\f\r]$') blank, tok = '.' or regexp_matches(tok, '^[ \t\n\x0b\f\r]$') halt, tok in (select w from sg) trig from t2),
x1 as (select *, lead(blank, 1) over s b1, lead(halt, 2) over s h2, lead(trig, 2) over s g2, min(case when halt then i end) over (partition by passage_id, sent_idx order by i rows between 3 following and unbounded following) e3 from x0 window s as (partition by passage_id, sent_idx order by i)),
x2 as (select *, case when i + 3 < n and not blank and not b1 and not h2 and not g2 then coalesce(e3, n) else i + 1 end nxt from x1),
rc as (select passage_id, sent_idx, 0::bigint i from x2 where i = 0 union all select x2.passage_id, x2.sent_idx, x2.nxt from rc join x2 using (passage_id, sent_idx, i) where x2.nxt < x2.n),
x3 as (select x2.*, z.fin f2 from rc join x2 using (passage_id, sent_idx, i) join x2 z on z.passage_id = x2.passage_id and z.sent_idx = x2.sent_idx and z.i = x2.nxt - 1),
x4 as (select *, substring(sent, cast(ofs + 1 as bigint), cast(f2 - ofs as bigint)) whole from x3),
w0 as (select passage_id, sent_idx, sent_start + ofs a, sent_start + f2 z, lower(whole) w, i from x4 where not halt or whole in (select w from sg)),
w1 as (select *, cast(row_number() over (partition by passage_id, sent_idx order by i) - 1 as int) pos, list(w) over (partition by passage_id, sent_idx order by i rows between current row and 6 following) nxt from w0),
tr as (select passage_id, sent_idx, pos, a, len(phrase) size, kind, lex_ord from w1 join lx on w = phrase[1] and nxt[1:len(phrase)] = phrase),
lb as (select distinct passage_id, sent_idx, lex_ord from (select * from tr qualify row_number() over (partition by passage_id, sent_idx, pos order by size desc, lex_ord) = 1)),
lo as (select tr.* from tr join lb using (passage_id, sent_idx, lex_ord))"""
_NEG = f"""{_MATCH}, {_TYPES_SQL}, {_WORDS_SQL},
sn as (select distinct passage_id, sent_idx, "start", "length" from mt),
ep as (select sn.passage_id, sn.sent_idx, sn."start", sn."length", max(pos) epos from sn join w1 on w1.passage_id = sn.passage_id and w1.sent_idx = sn.sent_idx and (a = sn."start" or (a < sn."start" and z >= sn."start" + sn."length")) group by 1, 2, 3, 4),
sc as (select distinct passage_id, "start", "length" from mt where cui in (select cui from ty where abbrev in ({_SCOPE}))),
ng as (select distinct ep.passage_id, ep."start", ep."length" from ep join sc using (passage_id, "start", "length") join lo using (passage_id, sent_idx) where abs(epos - pos) <= 6 and ((kind = 'nega' and a <= ep."start") or (kind = 'negb' and a > ep."start"))
  and not exists (select 1 from tr c where c.kind = 'conj' and c.passage_id = ep.passage_id and c.sent_idx = ep.sent_idx and c.pos > least(lo.pos, epos) and c.pos < greatest(lo.pos, epos))),
nn as (select mt.*, ng.passage_id is not null negated from mt left join ng on ng.passage_id = mt.passage_id and ng."start" = mt."start" and ng."length" = mt."length")"""
_CODES = f"""{{NM}}tc as (select lower(str) term, ord, case when right(cui, 1) in ('1', '2') and cui in (select cui from concepts) then 'C' || right(cui, 2) || '.1' else 'x.x.x.x' end treecode from nm where sab = 'LEXA'),
cd as (select c.cui, list(treecode order by ord) filter (treecode is not null) codes from concepts c left join tc on tc.term = lower(c.preferred_name) group by 1)"""


def _hash_sql(x: str) -> str:
    return f"cast(list_reduce(list_prepend(0::bigint, list_transform(string_split({x}, ''), lambda c: ord(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) as bigint)"


def _bucket_sql(h: str, n: str) -> str:
    cap = f"cast(pow(2, 4 + greatest(0, ceil(log2({n} / 12.0)))) as bigint)"
    return f"(xor({h}, {h} >> 16) & ({cap} - 1))"


def _quoted_sql(x: str) -> str:
    t = f"replace(replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(160), chr(92) || 'xa0')"
    return f"""case when contains({x}, chr(39)) and not contains({x}, '"') then '"' || {t} || '"' else chr(39) || replace({t}, chr(39), chr(92) || chr(39)) || chr(39) end"""


_FULL = f"""{_NEG},
so as (select cui, list(sab order by o, sab) sources from (select cui, sab, min(ord) o from nm where sab is not null group by 1, 2) group by 1),
fu as (select nn.*, coalesce(c.preferred_name, nn.cui) preferred_name, ty.abbrev, so.sources from nn left join concepts c on c.cui = nn.cui left join ty on ty.cui = nn.cui left join so on so.cui = nn.cui),
sh as (select cui, list(sab order by b, k) hashed from (select cui, sab, k, {_bucket_sql(_hash_sql("sab"), "n")} b from (select cui, unnest(sources) sab, generate_subscripts(sources, 1) k, len(sources) n from so)) group by 1)"""
_TOPS = _TOP.replace("select mt.* from mt", "select {M}.* from {M}").replace("{M}.passage_id", "{M}.passage_id").replace("tp.passage_id = mt.passage_id", "tp.passage_id = {M}.passage_id").replace('tp."start" = mt."start" and tp.e = mt."start" + mt."length"', 'tp."start" = {M}."start" and tp.e = {M}."start" + {M}."length"')
_DEF = """cn as (select cui, cast(substring(cui, 2, 8) as bigint) passage_id, preferred_name p, array_to_string(list_transform(string_split(preferred_name, ' '), lambda w: upper(substring(w, 1, 1))), '') sf from concepts where preferred_name like '% %'),
al as (select cui, p, sf, cast(length(regexp_replace(sf, '[^\\p{L}\\p{N}]', '', 'g')) as int) letters, lower(p) lp, regexp_replace(lower(sf), '[^\\p{L}\\p{N}]', '', 'g') ls, regexp_matches(sf, '^[\\p{L}\\p{N}]') first_in from cn),
wk as (select cui, length(lp) + 1 pz, length(ls) k from al union all
  select wk.cui, case when wk.k = 1 and first_in then coalesce(list_max(list_filter(range(1, wk.pz), lambda x: substring(lp, x, 1) = substring(ls, 1, 1) and (x = 1 or not regexp_matches(substring(lp, x - 1, 1), '[\\p{L}\\p{N}]')))), 0)
    else coalesce(list_max(list_filter(range(1, wk.pz), lambda x: substring(lp, x, 1) = substring(ls, wk.k, 1))), 0) end, wk.k - 1 from wk join al using (cui) where wk.k > 0 and wk.pz > 0),
bg as (select al.*, coalesce(list_max(list_filter(range(1, wk.pz), lambda x: substring(p, x, 1) = ' ')), 0) b from wk join al using (cui) where wk.k = 0 and wk.pz > 0),
lf as (select *, substring(p, b + 1) lo from bg),
df as (select cast(substring(cui, 2, 8) as bigint) passage_id, cui, sf short, cast(10 + length(p) + 2 as int) short_start, lo "long", cast(10 + b as int) long_start from lf
  where length(sf) between 2 and length(lo) and letters <= 10 and len(regexp_extract_all(lo, '[^\\s-]+')) <= least(2 * letters, letters + 5) and not lo like '%' || sf and not contains(lo, sf || ' ') and regexp_matches(sf, '[\\p{L}]') and first_in)"""
_TF = f"""{_MATCH},
tf as (select docid, cui, count(*) frequency, cast(coalesce(arg_min(coalesce(fieldid in ('title', 'TI'), false), (passage_id, "start", "length")), false) as int) title_flag from mt group by 1, 2)"""


def _nn(x: str) -> str:
    return f"(case when json_type({x}) = 'NULL' then null else {x} end)"


def _json_list(x: str) -> str:
    return f"(case when {x} is null or json_type({x}) = 'NULL' then []::json[] when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') else [{x}] end)"


def _json_text(x: str) -> str:
    return f"(case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') and regexp_matches({x} ->> '$', '^\\s*[\\[{{{{]') then ({x} ->> '$')::json else {x} end)"


_NESTED = f"""
r as (select distinct rec_id, cast(payload as json) j from annotation_records where json_valid(payload)),
e0 as (select rec_id, case when json_type(j) = 'ARRAY' then j else {_nn("(j -> 'entities')")} end x from r),
e1 as (select rec_id, {_json_list("x")} l from e0),
e2 as (select rec_id, unnest(l) e, cast(generate_subscripts(l, 1) - 1 as int) parent_no from e1),
e3 as (select * from e2 where json_type(e) <> 'NULL'),
v0 as (select rec_id, parent_no, coalesce({_nn("(e -> 'evs')")}, {_nn("(e -> 'evlist')")}) x from e3),
v1 as (select rec_id, parent_no, {_json_list("x")} l from v0),
v2 as (select rec_id, parent_no, unnest(l) v, cast(generate_subscripts(l, 1) - 1 as int) ev_no from v1),
v3 as (select *, coalesce({_nn("(v -> 'concept')")}, {_nn("(v -> 'conceptinfo')")}) x from v2 where json_type(v) <> 'NULL'),
v4 as (select *, {_json_text("x")} y from v3),
v5 as (select rec_id, parent_no, ev_no, {_json_list("y")} l from v4),
c0 as (select rec_id, parent_no, ev_no, unnest(l) c from v5),
s0 as (select rec_id, parent_no, ev_no, {_nn("(c -> 'sources')")} x from c0),
s1 as (select rec_id, parent_no, ev_no, unnest({_json_list("x")}) s from s0),
q0 as (select rec_id, {_nn("(j -> 'passages')")} x from r where json_type(j) = 'OBJECT'),
q1 as (select rec_id, {_json_list("x")} l from q0),
q2 as (select rec_id, unnest(l) p, cast(generate_subscripts(l, 1) - 1 as int) parent_no from q1),
q3 as (select rec_id, parent_no, {_nn("(p -> 'infons')")} f from q2 where json_type(p) <> 'NULL'),
q4 as (select rec_id, parent_no, unnest(case when json_type(f) = 'OBJECT' then json_keys(f) when json_type(f) = 'ARRAY' then list_transform(json_extract(f, '$[*]'), lambda k: k ->> 'key') else []::varchar[] end) item from q3)
select 'entity' child, rec_id, parent_no, cast(-1 as int) ev_no, '' item from e3
union select 'ev', rec_id, parent_no, ev_no, coalesce(list_filter(list_transform(l, lambda c: c ->> 'cui'), lambda k: k is not null)[1], '') from v5
union select 'source', rec_id, parent_no, ev_no, s ->> '$' from s1 where json_type(s) <> 'NULL'
union select 'infon', rec_id, parent_no, -1, item from q4 where item is not null"""


_V5 = _NESTED.strip()[: _NESTED.strip().index("c0 as (")].rstrip(", \n")
_C1 = f"""{_V5},
c1 as (select rec_id, parent_no entity_no, ev_no, unnest(l) c, cast(generate_subscripts(l, 1) - 1 as int) concept_no from v5),
c2 as (select * from c1 where json_type(c) <> 'NULL')"""


def _below(member: str, no: str) -> str:
    """SQL of the strings of a list below each concept."""
    return f"""with {_C1}, d0 as (select * exclude (c), {member} x from c2), d1 as (select * exclude (x), {_json_list("x")} l from d0), d2 as (select * exclude (l), unnest(l) s, cast(generate_subscripts(l, 1) - 1 as int) {no} from d1)
select distinct rec_id, entity_no, ev_no, concept_no, {no}, s ->> '$' as value from d2 where json_type(s) <> 'NULL'"""


def oracle_sql() -> dict[str, str]:
    one = r"regexp_replace(text, '[\t\r\n|]', ' ', 'g')"
    lines = rf"x as (select doc_id, cast(doc_id as varchar) docid, {one} t from documents where text is not null)"
    out = {
        "p3_found": f"with {_NESTED.strip()}",
        "d3_names": f"with {_NAMES} select ord, cui, lower(str) norm, sab from nm where lower(str) <> '' and sab in ('LEXA', 'CLINT')",
        "d5_preferred_name": f"with {_NAMES} select cui, coalesce(arg_max(str, ord) filter (tty = 'PT'), arg_max(str, ord) filter (coalesce(tty, '') <> 'PT')) preferred_name from nm group by 1",
        "d6_semtypes": f"with {_TYPES_SQL} select cui, tui, case when abbrev = 'tmco' then tui else abbrev end abbrev from ty",
        "d7_treecodes": f"with {_NAMES} select ord, lower(str) term, case when right(cui, 1) in ('1', '2') and cui in (select cui from concepts) then 'C' || right(cui, 2) || '.1' else 'x.x.x.x' end treecode from nm where sab = 'LEXA'",
        "d10_source_counts": f"with {_NAMES} select sab, (select count(*) from nm where nm.sab = v.sab) n from (values ('LEXA'), ('CLINT'), ('NOSUCH')) v(sab)",
        "d11_relations": "select l_orderkey, l_linenumber from lineitem where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O'))",
        "d12_stats": f"with {_NAMES} select 'names_rows' as key, count(*) as value from nm union all select 'concepts_rows', count(*) from concepts union all select 'types_rows', count(*) from concepts union all select 'distinct_keys', count(distinct norm) from nm",
        "q2_cuis": f"with {_NAMES}, k as (select preferred_name, lower(preferred_name) n from concepts union select preferred_name, {_normal('preferred_name')} from concepts) select preferred_name, string_agg(distinct cui, ',' order by cui) cuis from k join nm on nm.norm = k.n group by 1",
        "q4_known": f"with {_NAMES}, t as (select distinct matched_text from entities where matched_text is not null), k as (select matched_text, lower(matched_text) n from t union select matched_text, {_normal('matched_text')} from t) select distinct matched_text from k where n in (select norm from nm where norm is not null)",
        "q5_strings": f"with {_NAMES}, u as (select distinct norm, cui from nm), g as (select norm, cui, arg_min(str, ord) f, count(distinct str) n from nm where norm is not null and cui is not null group by 1, 2) select norm, cui, coalesce(f, norm) concept_string, coalesce(n, 0) n_strings from u left join g using (norm, cui)",
        "q6_preferred": "select distinct e.cui, coalesce(c.preferred_name, e.cui) preferred_name from evidence e left join concepts c using (cui)",
        "q7_types": f"with {_TYPES_SQL} select cui, string_agg(abbrev, ',' order by abbrev) semantic_types from ty group by 1",
        "q8_sources": f"with {_NAMES}, f as (select cui, sab, min(ord) o from nm where sab is not null group by 1, 2) select cui, string_agg(sab, ',' order by o, sab) sources from f group by 1",
        "q10_lookup": f"with {_NAMES}, {_TYPES_SQL}, k as (select preferred_name query, lower(preferred_name) n, 0 r from concepts union select preferred_name, {_normal('preferred_name')}, 1 from concepts), m as (select query, nm.cui, sab, tty, arg_min(str, (r, ord)) matched from k join nm on nm.norm = k.n where sab in ('LEXA', 'CLINT') group by 1, 2, 3, 4) select query, m.cui, coalesce(c.preferred_name, m.cui) preferred_name, matched, sab, tty, ty.abbrev semantic_types from m left join concepts c on c.cui = m.cui join ty on ty.cui = m.cui where ty.tui in ('T047', 'T184')",
        "s2_lines": r"with x as (select doc_id k, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') l from documents where text is not null) select '00000.txt' docid, 0 passage_no, 'text' fieldid, 0 base_offset, cast(generate_subscripts(l, 1) - 1 as int) line_no, unnest(l) as text from x",
        "s5_title_abstract": f"with {lines} select docid, 0 passage_no, 'title' fieldid, 0 base_offset, substring(t, 1, 20) as text from x union all select docid, 1, 'abstract', 0, substring(t, 21) from x",
        "s8_pubtator": rf"with {_P}, l as (select passage_id, cast(passage_id // 4 as varchar) d, passage_id % 2 k, regexp_replace(text, '[\r\n|]', ' ', 'g') t from p), g as (select d, arg_max(t, passage_id) filter (k = 0) t, arg_max(t, passage_id) filter (k = 1) a from l group by 1) select d docid, 0 passage_no, 'title' fieldid, 0 base_offset, t as text from g where t is not null union all select d, case when t is null then 0 else 1 end, 'abstract', coalesce(length(t), 0), a from g where a is not null",
        "n4_longest": f"with recursive {_CAND}, {_WORDS_SQL} select passage_id, sent_idx, pos, cast(size as int) size, kind from lo",
        "n1_meta_tokens": f'with recursive {_CAND}, {_WORDS_SQL} select passage_id, sent_idx, pos, cast(a as int) "start", cast(z as int) "end", w from w1',
        "n5_negation_joined": f'with recursive {_NEG} select passage_id, "start", "length", cui, negated from nn',
        "n6_positions": f'with recursive {_NEG} select passage_id, sent_idx, "start", "length", epos from ep',
        "e14_pipeline": f'with recursive {_NEG}, {_TOPS.replace("{M}", "nn")} select docid, passage_id, "start", "length", term, cui, concept_string, negated from su',
        "e1_tagged": f"""with {_CAND} select passage_id, "start", "length", term from ca where lower(tok) not in ('the', 'a', 'this', 'was', 'to')""",
        "e6_entities": f"""with {_MATCH} select docid, passage_id, "start", "length", term, string_agg(cui, ',' order by cui) cuis from mt group by all""",
        "e8_first_origin": f"""with {_MATCH} select passage_id, "start", "length", cui from mt where "length" > 12 union all select distinct passage_id, "start", "length", 'U' from mt where "length" <= 12""",
        "e13_order": f"""with {_MATCH} select passage_id, "start", "length", cui, cast(row_number() over (partition by passage_id order by "start", "length" desc, cui) as int) place from mt""",
        "e9_lookup_term": f"""with {_MATCH.replace(_SENT, _TERMS)} select distinct passage_id preferred_name, "start", "length", cui from mt""",
        "g4_resolved": f"""with {_MATCH.replace(_SENT, _TERMS)}, {_TYPES_SQL}, r as (select distinct passage_id query, cui from mt) select query, r.cui, coalesce(c.preferred_name, r.cui) preferred_name, coalesce(ty.abbrev, '') semantic_types from r left join concepts c using (cui) left join ty on ty.cui = r.cui""",
        "f11_annotations": f'with recursive {_NEG} select docid document, cui, term, negated, "start" start_pos, "start" + "length" end_pos from nn',
        "f12_entities": f'with recursive {_NEG} select distinct docid, passage_id, "start", "length", term, negated from nn',
        "f12_concepts": f"with {_MATCH} select distinct m.cui, coalesce(c.preferred_name, m.cui) preferred_name from mt m left join concepts c using (cui)",
        "f12_types": f"with {_MATCH}, {_TYPES_SQL} select distinct m.cui, ty.abbrev semantic_type from mt m join ty using (cui)",
        "f12_sources": f"with {_MATCH} select distinct m.cui, n.sab source from mt m join nm n using (cui) where n.sab is not null",
        "g5_search": f"""with recursive {_NEG}, hit as (select distinct docid, passage_id, "start", "length", negated from nn where cui in (select cui from concepts) and right(cui, 1) in ('3', '7')), n as (select docid, count(*) filter (not negated) a, count(*) filter (negated) g from hit group by 1), dd as (select distinct docid from p), st as (select case when coalesce(a, 0) > 0 then 'a' when coalesce(g, 0) > 0 then 'n' else 'x' end s from dd left join n on n.docid = dd.docid) select '1' search_id, 'passages' corpus, (select length(string_agg(distinct cui, ',')) from concepts where right(cui, 1) in ('3', '7'))::int cuis, count(*) n_documents, count(*) filter (s = 'a') n_affirmed, count(*) filter (s = 'n') n_negated, count(*) filter (s = 'x') n_absent from st""",
        "q9_treecodes": f"with {_NAMES}, {_CODES.replace('{NM}', '')} select cui, coalesce(array_to_string(codes, ','), '') codes from cd",
        "q12_restriction": f"with {_TYPES_SQL} select cui, tui from ty where abbrev in ('dsyn', 'sosy', 'neop')",
        "q13_types": f"with {_TYPES_SQL}, nx as (select * from (values ('T047', 'Disease or Syndrome'), ('T184', 'Sign or Symptom'), ('T121', 'Pharmacologic Substance'), ('T059', 'Laboratory Procedure'), ('T061', 'Therapeutic or Preventive Procedure'), ('T033', 'Finding'), ('T191', 'Neoplastic Process'), ('T079', 'Temporal Concept')) v(tui, name)) select cui, tui, name from ty join nx using (tui)",
        "d8_build": f"with {_NAMES} select cui, sui, regexp_replace(str, '[|\\r\\n]', ' ', 'g') str, lower(regexp_replace(str, '[|\\r\\n]', ' ', 'g')) norm, sab, tty from nm where str <> ''",
        "s1_freetext": "select doc_id || '.txt' docid, 0 passage_no, 'text' fieldid, 0 base_offset, text from documents where text is not null",
        "s4_id_lines": rf"with {lines} select case when doc_id % 3 = 0 then '00000.txt' else docid end docid, doc_id line_no, 'text' fieldid, 0 base_offset, case when doc_id % 3 = 0 then '' else docid || ' ' || substring(t, 1, 20) || ' ' || substring(t, 21) end as text from x",
        "s6_tagged": f"with {lines} select docid, 0 passage_no, 'title' fieldid, 0 base_offset, substring(t, 1, 20) as text from x union all select docid, 1, 'abstract', 0, substring(t, 21) from x",
        "s7_bar_title_abstract": f"with {lines} select docid, 0 passage_no, 'title' fieldid, 0 base_offset, substring(t, 1, 20) as text from x union all select docid, 1, 'abstract', 0, substring(t, 21) from x",
        "s9_pubmed": rf"with x as (select doc_id::varchar k, regexp_replace(text, '[\x00-\x1f\x7f-\x{{9f}}\x{{fffe}}\x{{ffff}}]', ' ', 'g') t from documents where text is not null) select k docid, 0 passage_no, 'title' fieldid, 0 base_offset, 'Note ' || k as text from x union all select k, 1, 'abstract', 0, t from x",
        "s10_medline": rf"with x as (select doc_id::varchar k, regexp_replace(text, '[\x00-\x1f\x7f-\x{{9f}}\x{{fffe}}\x{{ffff}}]', ' ', 'g') t from documents where text is not null and trim(text, ' ') <> '') select k docid, 0 passage_no, 'TI' fieldid, 0 base_offset, 'Note ' || k || ' ' as text from x union all select k, 1, 'AB', 0, 'x' || t || ' ' from x",
        "s10b_bioc": rf"with {_P}, x as (select passage_id::varchar k, regexp_replace(text, '[\x00-\x1f\x7f-\x{{9f}}\x{{fffe}}\x{{ffff}}]', ' ', 'g') t from p) select k docid, 0 passage_no, 'note' fieldid, 0 base_offset, t as text from x union all select k, 1, 'note', 9, t from x",
        "s12_filled": "select passage_id, coalesce(any_value(infons['docid']), case when trim(any_value(docid), ' ') = '' then '0000000.TXT' else coalesce(any_value(docid), '0000000.TXT') end) docid from passages group by 1",
        "s13b_text_at": f"with {_P}, s as (select distinct sent_id, passage_id, sent_offset, length(text) n from sentences where text is not null) select sent_id, substring(text, sent_offset - base_offset + 1, n) piece from s join p using (passage_id)",
        "s14_export": 'select any_value(docid) document, entity_id, any_value("start") "start", any_value(matched_text) term from entities group by 2',
        "s15_results": 'with e as (select distinct on (entity_id) * from entities order by entity_id), v as (select distinct on (evidence_id) * from evidence order by evidence_id) select e.docid, e."start" entity_start, e."length" entity_length, cui, v.matched_text, round(score, 6) score, v."start", v."length" from e join v using (entity_id) where e.docid is not null and e."start" is not null and cui is not null',
        "t8_words": rf"""with {_P}, t0 as (select passage_id, text, regexp_extract_all(text, '[^{_SEP}]+|[{_SEP}]') toks from p) select passage_id, len(list_filter(toks, lambda w: not regexp_matches(w, '^[ \t\n\x0b\f\r]$')))::int words, length(text)::int chars from t0""",
        "t12_number_format": "select p_partkey, regexp_replace(format('{:,.2f}', p_retailprice), '\\.?0+$', '') price from part",
        "a1_defined": f"with recursive {_DEF} select passage_id, short, short_start, \"long\", long_start from df",
        "a4_pipeline": f"""with recursive {_NAMES}, di as (select norm, cui, arg_min(str, ord) concept_string from nm group by 1, 2), {_DEF}, hit as (select df.passage_id, short, short_start, d.cui, length(c.p) pl from df join cn c on c.cui = df.cui join di d on d.norm in (lower("long"), {_normal('"long"')})),
st as (select passage_id, short_start "start", short, cui from hit union select passage_id, 10 + pl + 2 + length(short) + 13, short, cui from hit where regexp_full_match(short, '[^{_SEP}]+')) select passage_id, cast("start" as int) "start", cast(length(short) as int) "length", short term, cui from st""",
        "a6_user_acronyms": f"""with {_P}, {_NAMES}, t0 as (select passage_id, base_offset, regexp_extract_all(text, '[^{_SEP}]+|[{_SEP}]') toks from p), t1 as (select passage_id, base_offset, unnest(toks) tok, generate_subscripts(toks, 1) i from t0), t2 as (select *, sum(length(tok)) over (partition by passage_id order by i) - length(tok) o from t1), f as (select arg_min(preferred_name, (cui, preferred_name)) n from concepts), k as (select distinct cui from nm, f where norm = case when lower(n) in (select norm from nm) then lower(n) else {_normal("n")} end) select passage_id, cast(base_offset + o as int) "start", 2 "length", tok term, cui, 100.0::double score from t2, k where tok = 'pH'""",
        "f4_hash_order": f"with {_NAMES}, u as (select cui, sab, min(ord) o from nm group by 1, 2), n as (select *, count(*) over (partition by cui) n from u), h as (select *, {_bucket_sql(_hash_sql('sab'), 'n')} b from n) select cui, cast(row_number() over (partition by cui order by b, o, sab) - 1 as int) place, sab from h",
        "f5_json": f"""with recursive {_FULL}, ev as (select fu.*, coalesce(sh.hashed, []::varchar[]) hs, count(*) over (partition by docid, passage_id, "start", "length", term) n, ({_hash_sql("fu.cui")} + "start" + "length") % 4294967296 h from fu left join sh on sh.cui = fu.cui), eb as (select *, {_bucket_sql("h", "n")} b from ev)
select docid, passage_id, "start", "length", to_json({{'docid': docid, 'id': 'en0', 'matchedtext': term, 'fieldid': any_value(fieldid), 'start': "start", 'length': "length", 'negated': bool_or(negated), 'evlist': list({{'id': 'ev0', 'matchedtext': term, 'score': 0.0::double, 'start': "start", 'length': "length", 'conceptinfo': {{'cui': cui, 'preferredname': preferred_name, 'conceptstring': concept_string, 'semantictypes': case when abbrev is null then []::varchar[] else [abbrev] end, 'sources': hs}}}} order by b, cui)}})::varchar json from eb group by docid, passage_id, "start", "length", term""",
        "f6_brat": f"""with recursive {_FULL}, {_TOPS.replace("{M}", "fu")}, sf as (select *, min(passage_id) over (partition by docid, "start", "length", term) fp from su), g as (select docid, "start", "start" + "length" "end", term, list({{'c': sf.cui, 't': abbrev, 'p': preferred_name, 's': coalesce(sh.hashed, []::varchar[]), 'n': negated}} order by sf.cui) l from sf left join sh on sh.cui = sf.cui where passage_id = fp group by all),
r0 as (select docid, "start", "end", term, list_distinct_ordered from (select docid, "start", "end", term, flatten(list_transform(l, lambda x: list_concat(['ConceptId:' || x.c || chr(9) || x.p], case when x.t is null then []::varchar[] else ['SemanticType:' || x.c || ':' || x.t || chr(9) || x.t] end, list_transform(x.s, lambda y: 'Source:' || x.c || ':' || y || chr(9) || y), case when x.n then ['Negated:' || term || chr(9) || term] else []::varchar[] end))) list_distinct_ordered from g)),
r1 as (select docid, "start", "end", term, list_filter(list_distinct_ordered, lambda v, i: list_position(list_distinct_ordered, v) = i) refs from r0),
r2 as (select *, row_number() over w no, sum(len(refs)) over w - len(refs) bf from r1 window w as (partition by docid order by "start", "end", term)),
r3 as (select docid, no, 0 part, 'T' || no || chr(9) || 'Concept ' || "start" || ' ' || "end" || chr(9) || term line from r2 union all select docid, no, k, 'N' || (bf + k) || chr(9) || 'Reference T' || no || ' ' || ref from (select docid, no, bf, unnest(refs) ref, generate_subscripts(refs, 1) k from r2))
select docid, no, cast(part as int) part, line from r3""",
        "f3_mmi_lines": f"""with recursive {_FULL}, {_CODES.replace('{NM}', '')},
oc as (select docid, fu.cui, any_value(preferred_name) preferred_name, any_value(abbrev) abbrev, count(*) frequency, coalesce(arg_min(coalesce(fieldid in ('title', 'TI'), false), (passage_id, "start", "length")), false) title, list(coalesce(fieldid, 'text') order by passage_id, "start", "length") fields,
  string_agg('"' || concept_string || '"-' || coalesce(fieldid, 'text') || '-' || window_no || '-"' || term || '"--' || negated::int, ',' order by passage_id, "start", "length") occ, string_agg("start" || '/' || "length", ';' order by passage_id, "start", "length") pl from fu group by docid, fu.cui),
sx as (select oc.*, coalesce(codes, []::varchar[]) codes from oc left join cd using (cui)),
sy as (select *, (14.0 * greatest(1, coalesce(list_sum(list_transform(codes, lambda c: len(string_split(c, '.')))), 0)) / 8) / 15 spec, ln(((exp(5) + 1) + (exp(5) - 1) * least(1.0, frequency / 1000.0)) / ((exp(5) + 1) - (exp(5) - 1) * least(1.0, frequency / 1000.0))) / 5 nf from sx)
select docid, preferred_name, concat_ws('|', docid, 'MMI', format('{{:.2f}}', 10000 * case when title then spec else nf * spec end), preferred_name, cui, '[' || coalesce(abbrev, '') || ']', occ, array_to_string(list_filter(fields, lambda v, i: list_position(fields, v) = i), ';'), pl, array_to_string(codes, ';'), '') line from sy""",
        "p3_sources": _below(_nn("(c -> 'sources')"), "source_no"),
        "p3_semantic_types": _below(f"coalesce({_nn("(c -> 'semantic_types')")}, {_nn("(c -> 'semantictypes')")})", "semantic_type_no"),
        "p3_infons": f"""with {_NESTED.strip()[: _NESTED.strip().index("q4 as (")].rstrip(", " + chr(10))},
k0 as (select rec_id, parent_no, f, unnest(json_keys(f)) item from q3 where json_type(f) = 'OBJECT'),
k1 as (select rec_id, parent_no, unnest(json_extract(f, '$[*]')) e, generate_subscripts(json_extract(f, '$[*]'), 1) - 1 n from q3 where json_type(f) = 'ARRAY')
select distinct rec_id, parent_no passage_no, cast(null as int) infon_no, item, {_nn("(f -> item)")} ->> '$' as value from k0
union select rec_id, parent_no, cast(n as int), e ->> 'key', {_nn("(e -> 'value')")} ->> '$' from k1 where e ->> 'key' is not null""",
        "t1_sentences": f"with {_SENT} select passage_id, sent_idx, sent_start, sent from se",
        "t3_lines": rf"with x as (select doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) l from documents where text is not null), y as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) k from x), z as (select *, cast(sum(length(text)) over (partition by doc_id order by k) - length(text) as int) \"start\" from y) select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) i, \"start\", text from z where k % 2 = 1 and regexp_replace(text, '[{_SP}]+', '', 'g') <> ''".replace('\\"', '"'),
        "t5_tokens": f"""with {_P}, t0 as (select passage_id, regexp_extract_all(text, '[^{_SEP}]+|[{_SEP}]') toks from p), t1 as (select passage_id, unnest(toks) token, cast(generate_subscripts(toks, 1) - 1 as int) tok from t0) select passage_id, tok, cast(sum(length(token)) over (partition by passage_id order by tok) - length(token) as int) tok_start, token from t1""",
        "t9_normalize": f"with {_NAMES} select ord, {_normal('str')} normal from nm",
        "e1_candidates": f'with {_CAND} select passage_id, "start", "length", term from ca',
        "e2_matches": f'with {_MATCH} select passage_id, "start", "length", term, cui, concept_string, cast(window_no as int) window_no from mt',
        "e10_restrict": f"""with {_MATCH}, {_TYPES_SQL} select passage_id, "start", "length", cui from mt where cui in (select cui from ty where abbrev in ('dsyn', 'sosy', 'neop')) and cui in (select cui from nm where sab = 'LEXA')""",
        "e11_subsumption": f'with {_MATCH}, {_TOP} select passage_id, "start", "length", term, cui from su',
        "n3_triggers": f"with recursive {_CAND}, {_WORDS_SQL} select passage_id, sent_idx, pos, cast(size as int) size, kind from tr",
        "n5_negation": f'with recursive {_NEG} select passage_id, "start", "length", cui, negated from nn',
        "f1_term_frequency": f"with {_TF} select docid, cui, frequency, title_flag from tf",
        "f2_mmi_score": f"with {_TF}, {_CODES.replace('{NM}', '')}, y as (select tf.*, (14.0 * greatest(1, coalesce(list_sum(list_transform(codes, lambda c: len(string_split(c, '.')))), 0)) / 8) / 15 spec, ln(((exp(5) + 1) + (exp(5) - 1) * least(1.0, frequency / 1000.0)) / ((exp(5) + 1) - (exp(5) - 1) * least(1.0, frequency / 1000.0))) / 5 nf from tf left join cd using (cui)) select docid, cui, round(10000 * case when title_flag = 1 then spec else nf * spec end, 6) score from y",
        "f10_rows": f'with recursive {_NEG} select docid document, cui, term, negated, "start", "start" + "length" "end" from nn',
        "f11_star": f"with {_MATCH} select docid document, count(*) n_annotations from mt group by 1",
        "f12_evidence": f'with {_MATCH} select distinct docid, passage_id, "start", "length", cui, concept_string from mt',
        "g1_top_concepts": f"with {_MATCH}, t as (select cui, lower(term) lt, count(*) n from mt group by 1, 2), c as (select cui, arg_max(lt, (n, lt)) commonest_term from t group by 1), m as (select cui, count(*) mentions, count(distinct docid) documents from mt group by 1 order by 2 desc, 1 limit 25) select m.cui, mentions, documents, commonest_term from m join c using (cui)",
        "g2_doc_stats": f"""with recursive {_NEG} select docid, count(distinct (passage_id, "start", "length")) spans, count(distinct case when negated then (passage_id, "start", "length") end) negated_spans, count(distinct cui) concepts from nn group by 1""",
        "g3_cohort": f"""with recursive {_NEG}, hit as (select distinct docid, passage_id, "start", "length", negated from nn where cui in (select cui from concepts) and right(cui, 1) in ('3', '7')), n as (select docid, count(*) filter (not negated) a, count(*) filter (negated) g from hit group by 1), dd as (select distinct docid from p) select dd.docid, case when coalesce(a, 0) > 0 then 'affirmed' when coalesce(g, 0) > 0 then 'negated_only' else 'absent' end status, coalesce(a, 0) n_affirmed, coalesce(g, 0) n_negated from dd left join n on n.docid = dd.docid""",
        "g6_evidence_top": "with e as (select distinct evidence_id, cui from evidence) select cui, count(*) n, any_value(preferred_name) preferred_name from e join concepts using (cui) group by 1 order by 2 desc, 1 limit 10",
        "g7_agreement": f"with {_MATCH}, a as (select distinct docid, cui from mt where docid is not null), b as (select distinct docid, cui from entities join evidence using (entity_id) where docid is not null and cui is not null), x as (select (select count(*) from (select * from a intersect select * from b)) tp, (select count(*) from (select * from a except select * from b)) fp, (select count(*) from (select * from b except select * from a)) fn) select tp, fp, fn, round(tp / (tp + fp), 9) \"precision\", round(tp / (tp + fn), 9) recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 9) f1 from x",
        "g8_differences": "with e as (select distinct on (entity_id) * from entities order by entity_id), r as (select entity_id, case when entity_id % 5 = 0 then 1 else negated end negated, temporality from e where entity_id % 7 <> 0) select count(*) filter (r.entity_id is null) left_only, 0 right_only, count(*) filter (r.entity_id is not null and e.negated is distinct from r.negated) negated_differs, count(*) filter (r.entity_id is not null and e.temporality is distinct from r.temporality) temporality_differs from e left join r using (entity_id)",
    }
    classes = " ".join(f"when regexp_matches(token, '{p.replace(chr(39), chr(39) * 2)}') then '{n}'" for n, p in T.TOKEN_CLASSES)
    tokens = out["t5_tokens"]
    caps = lambda c: f"(upper({c}) = {c} and lower({c}) <> {c})"
    words = ", ".join(f"'{w}'" for w in match.FUNCTION_WORDS)
    return out | {
        "t2_blanklines": r"""with x as (select doc_id, regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(2) || chr(3)), '((?:\x02\x03|\r|\n){2,})', chr(1) || '\1' || chr(1), 'g'), chr(1)) l from documents where text is not null), y as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) k from x), z as (select *, cast(sum(length(text)) over (partition by doc_id order by k) - length(text) as int) "start" from y) select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) i, "start", replace(text, chr(2) || chr(3), chr(13) || chr(10)) as text from z where k % 2 = 1 and text <> ''""",
        "t7_token_classes": f"select case {classes} else 'unknown' end token_class, count(*) n from ({tokens}) group by 1",
        "e4_excluded": f'with {_MATCH} select passage_id, "start", "length", cui from mt where right(cui, 1) <> \'3\'',
        "e5_custom": f"""with {_CAND}, c as (select 'U0000001' cui, 'dose' n union all select 'U0000002', 'the margin') select distinct passage_id, "start", "length", cui, n concept_string from ca join c on n in (lower(term), {_normal("term")})""",
        "e12_precision": f"""with {_MATCH}, {_TOP}, ac as (select norm, cui from nm group by 1, 2 having bool_and({caps("str")} and not contains(str, ' ') and length(regexp_replace(str, '[^\\p{{L}}]', '', 'g')) >= 2)) select passage_id, "start", "length", cui from su where ({caps("term")} or (norm, cui) not in (select (norm, cui) from ac)) and not (regexp_full_match(term, '[\\p{{L}}\\p{{N}}]+') and not {caps("term")} and lower(term) in ({words}))""",
        "f7_cuilist": f'with {_MATCH}, f as (select cui, min((passage_id, "start")) o from mt group by 1) select cui, row_number() over (order by o, cui) place from f',
        "f8_ranked": f"with {_TF} select docid, cui, row_number() over (order by -cast(frequency as double), docid nulls first, cui) rank, cast(frequency as double) score from tf",
        "f9_full": f"""with recursive {_FULL}, ss as (select cui, array_to_string(list_sort(sources), ',') s from so) select docid, passage_id, "start", "length", "start" || ':' || "length" || ' ' || {_quoted_sql("term")} || ' ()' || case when bool_or(negated) then ' [negated]' else '' end || chr(10) || string_agg('    ' || fu.cui || ' ' || preferred_name || ' [' || coalesce(abbrev, '') || '] {{' || coalesce(s, '') || '}} <- ' || {_quoted_sql("concept_string")} || chr(10), '' order by fu.cui) as text from fu left join ss on ss.cui = fu.cui group by docid, passage_id, "start", "length", term""",
    }
