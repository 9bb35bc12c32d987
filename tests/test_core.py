"""Golden values and brute-force models of the core operators."""

import json
import random

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import abbreviation, analytics, context, match, negation, nested, rank
from termloom.operators import dictionary as D
from termloom.plans.pipeline import Settings, annotate
from termloom.sources import documents


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark):
    for given, want in {"Alzheimer's disease": "alzheimer disease", "[X]Other disorders": "other disorders", "TNF-α": "tnf-alpha", "cost $5": "cost 5", "a  b": "a b", "'s": "'s", "boys' home": "boys home"}.items():
        assert one(spark, T.normalize, given) == want


def test_tokens_rebuild_the_text(spark):
    assert one(spark, T.token_texts, "a  b--c") == ["a", " ", " ", "b", "-", "-", "c"]
    for s in ("β-blocker 😀 x", "", "a\r\nb"):
        assert "".join(one(spark, T.token_texts, s)) == s


def test_sentences(spark):
    got = one(spark, T.sentences, "A. B. Smith went home. He slept.")
    assert [r["text"] for r in got] == ["A. B. Smith went home.", "He slept."]
    assert [r["start"] for r in got] == [0, 23]


def test_hash_order(spark):
    df = spark.createDataFrame([("g", s, i) for i, s in enumerate(["D1", "D2", "OWN"])], "g string, s string, o int")
    assert [r["s"] for r in rank.hash_order(df, ["g"], "s", "o").orderBy("place").collect()] == ["OWN", "D1", "D2"]


def test_rank_of_sample_lines(spark):
    for depth, want in ((5, "2.30"), (8, "3.68"), (18, "8.29")):
        s = spark.range(1).select(rank.score_text(rank.score(F.lit(1), F.lit(0.0), F.lit(depth), F.lit(False))).alias("x"))
        assert s.first()["x"] == want


NAMES = [
    (0, "C1", "Diabetes Mellitus", "SNO", "PT"),
    (1, "C1", "Diabetes", "SNO", "SY"),
    (2, "C2", "Type 2 Diabetes Mellitus", "MSH", "PT"),
    (3, "C3", "Pneumonia", "SNO", "PT"),
    (4, "C4", "PNEUMONIA", "MSH", "SY"),
    (5, "C5", "US", "SNO", "SY"),
]


def names(spark):
    return spark.createDataFrame([(o, c, f"S{o}", s, s.lower(), a, t) for o, c, s, a, t in NAMES], "ord bigint, cui string, sui string, str string, norm string, sab string, tty string")


def passages(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", None, 0, t) for i, t in enumerate(texts)], "passage_id bigint, docid string, fieldid string, base_offset int, text string")


def test_matching_and_subsumption(spark):
    p = passages(spark, "He has Type 2 Diabetes Mellitus.")
    m = match.matches(match.candidates(match.sentence_rows(p)), match.dictionary(names(spark)))
    assert {(r["start"], r["length"], r["cui"]) for r in m.collect()} == {(7, 24, "C2"), (14, 8, "C1"), (14, 17, "C1")}
    assert [(r["start"], r["cui"]) for r in match.drop_subsumed(m).collect()] == [(7, "C2")]


def test_subsumption_equals_pairs(spark):
    rnd = random.Random(3)
    rows = sorted({(g, s, n) for g in range(40) for _ in range(12) for s, n in [(rnd.randrange(20), 1 + rnd.randrange(9))]})
    df = spark.createDataFrame([(g, s, n, "c") for g, s, n in rows], "passage_id int, start int, length int, cui string")
    inside = lambda a, b: a != b and a[0] == b[0] and b[1] <= a[1] and a[1] + a[2] <= b[1] + b[2]
    want = {r for r in rows if not any(inside(r, o) for o in rows)}
    assert {(r["passage_id"], r["start"], r["length"]) for r in match.drop_subsumed(df).collect()} == want


def test_negation(spark):
    p = passages(spark, "No pneumonia but diabetes persists.", "Pneumonia was ruled out.", "Pneumonia was not ruled out.")
    s = match.sentence_rows(p)
    m = match.matches(match.candidates(s), match.dictionary(names(spark)))
    got = {(r["passage_id"], r["cui"]): r["negated"] for r in negation.negated(m, s, negation.lexicon(spark)).collect()}
    assert got[0, "C3"] and not got[0, "C1"] and got[1, "C3"] and not got[2, "C3"]


def test_queries_with_the_whole_lexicon(spark, tmp_path):
    import pytest

    from termloom import queries

    texts = ["She came without pneumonia.", "No pneumonia however diabetes persists.", "No aspirin."]
    passages(spark, *texts).write.parquet(f"{tmp_path}/passages.parquet")
    known = [(0, "C0000000", "pneumonia"), (1, "C0000001", "diabetes"), (2, "C0000002", "aspirin")]
    spark.createDataFrame([(o, c, f"S{o}", s, s, "A", "PT") for o, c, s in known], "ord bigint, cui string, sui string, str string, norm string, sab string, tty string").write.parquet(f"{tmp_path}/cuisourceinfo.parquet")
    spark.createDataFrame([(c, s) for _, c, s in known], "cui string, preferred_name string").write.parquet(f"{tmp_path}/concepts.parquet")
    want = {(0, "C0000000", True), (1, "C0000000", True), (1, "C0000001", False), (2, "C0000002", False)}
    for name in ("flagship", "n5_negation", "n5_negation_joined"):
        assert {(r["passage_id"], r["cui"], r["negated"]) for r in queries.queries()[name](spark, str(tmp_path)).collect()} == want
    many = spark.range(negation.MOST_PHRASES + 1).selectExpr("array(string(id)) phrase", "'nega' kind", "int(id) lex_ord")
    with pytest.raises(ValueError, match="trigger phrases"):
        negation.triggers(match.sentence_rows(passages(spark, "x")), many)


STRICT = """No chest pain.|Negated|Recent|Patient
absence of chest pain.|Negated|Recent|Patient
The patient denies chest pain.|Negated|Recent|Patient
no chest pain but fever|Negated|Recent|Patient
no  chest   pain|Negated|Recent|Patient
History of chest pain.|Affirmed|Historical|Patient
if chest pain recurs, return.|Affirmed|Hypothetical|Patient
Her mother had chest pain.|Affirmed|Recent|Other
chest pain is ruled out.|Affirmed|Recent|Patient
possible chest pain.|Affirmed|Recent|Patient
chest pain is unlikely.|Affirmed|Recent|Patient
gram negative chest pain|Affirmed|Recent|Patient
no increase in chest pain|Affirmed|Recent|Patient
CHEST PAIN denied|Affirmed|Recent|Patient
for the past 3 months of chest pain|Affirmed|Recent|Patient
since last june chest pain|Affirmed|Recent|Patient
previous chest pain|Affirmed|Recent|Patient
chest pain, no fever|Affirmed|Recent|Patient"""
LOOSE = """pneumonia|No evidence of pneumonia.|Negated|Recent|Patient
pneumonia|Without evidence of pneumonia.|Negated|Recent|Patient
pneumonia|Negative for pneumonia.|Negated|Recent|Patient
pneumonia|Denies pneumonia.|Negated|Recent|Patient
pneumonia|Admitted with pneumonia.|Affirmed|Recent|Patient
pneumonia|Pneumonia was ruled out.|Negated|Recent|Patient
pneumonia|Rule out pneumonia.|Possible|Recent|Patient
pneumonia|Plan: r/o pneumonia, recheck.|Possible|Recent|Patient
pneumonia|Cannot exclude pneumonia.|Possible|Recent|Patient
pneumonia|Pneumonia cannot be excluded.|Possible|Recent|Patient
pneumonia|Findings concerning for pneumonia.|Possible|Recent|Patient
pneumonia|Pneumonia is suspected.|Possible|Recent|Patient
pneumonia|Absent pneumonia.|Negated|Recent|Patient
infection|no gram negative infection.|Negated|Recent|Patient
fatigue|Patient had 3 months of fatigue.|Affirmed|Historical|Patient
cough|Present for the past 20 days of cough.|Affirmed|Historical|Patient
fatigue|Patient has had fatigue since last march.|Affirmed|Historical|Patient
stroke|Patient with previous stroke.|Affirmed|Historical|Patient
stroke|previous surgery, now stroke.|Affirmed|Recent|Patient
cough|Seen after 114 days of rest; cough today.|Affirmed|Recent|Patient
family history of hypertension|Family history of hypertension in mother.|Affirmed|Historical|Other
no known allergies|No known allergies.|Affirmed|Recent|Patient
allergies|No known allergies.|Negated|Recent|Patient"""


def test_context(spark):
    df = spark.createDataFrame([("History of chest pain.", "chest pain"), ("Patient denies chest pain.", "chest pain"), ("Her mother had chest pain.", "chest pain"), ("x", None)], "s string, c string")
    got = [tuple(r) for r in context.classified(df, "s", "c").select("assertion", "temporality", "experiencer").collect()]
    assert got == [("Affirmed", "Historical", "Patient"), ("Negated", "Recent", "Patient"), ("Affirmed", "Recent", "Other"), (None, None, None)]
    for line in STRICT.splitlines():
        sentence, *want = line.split("|")
        assert context.rules().classify(sentence, "chest pain") == tuple(want), line
    for line in LOOSE.splitlines():
        concept, sentence, *want = line.split("|")
        assert context.rules(strict=False).classify(sentence, concept) == tuple(want), line
    assert context.rules().classify("", "x") is context.rules().classify("x", "") is context.rules().classify("abc", "x") is None


def test_context_of_mentions(spark):
    p = passages(spark, "Family history of pneumonia. Pneumonia today.", "Denies: \n- diabetes mellitus\n- us today\n pneumonia")
    s = match.sentence_rows(p)
    m = match.found(s, match.dictionary(names(spark)))
    rows = lambda strict: {(r["passage_id"], r["start"], r["cui"]): (r["negated"], r["experiencer"]) for r in context.detected(m, s, strict).collect()}
    own, every = rows(False), rows(True)
    assert own[0, 18, "C3"] == (False, "Other") and own[0, 29, "C3"] == (False, "Patient")
    assert every[0, 18, "C3"] == every[0, 29, "C3"] == (False, "Patient")  # the last sentence holds
    context.register_classifier("shout", lambda sent, spans: [{"assertion": "Negated", "temporality": None, "experiencer": None} if sent[a:b].isupper() else None for a, b in spans])
    assert not any(r["negated"] for r in context.detector("shout")(m, s).collect())


def test_abbreviations(spark):
    text = "type 2 diabetes mellitus (T2DM) is common. T2DM is treatable."
    assert abbreviation.pairs(text) == [{"short": "T2DM", "short_start": 26, "long": "type 2 diabetes mellitus", "long_start": 0}]
    assert abbreviation.pairs(None) == abbreviation.pairs("no (") == []
    m = annotate(passages(spark, text), names(spark), Settings())
    assert {(r["start"], r["term"]) for r in m.collect()} == {(0, "type 2 diabetes mellitus"), (26, "T2DM"), (43, "T2DM")}


def test_propagation_query(spark, tmp_path):
    from termloom import queries

    passages(spark, "x", "Type 2 diabetes mellitus (T2DM) is common. T2DM is treatable.", "Pneumonia again.", "Pneumonia of long standing.").write.parquet(f"{tmp_path}/passages.parquet")
    names(spark).write.parquet(f"{tmp_path}/cuisourceinfo.parquet")
    spark.createDataFrame([("C0000001", "Pneumonia")], "cui string, preferred_name string").write.parquet(f"{tmp_path}/concepts.parquet")
    got = queries.a4_propagation(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 26, 4, "T2DM", "C2"), (1, 43, 4, "T2DM", "C2")}


def test_propagation_broadcasts_nothing_exploded(spark, tmp_path):
    rows = {
        "passages": ([(1, "d", "t", 0, "Type 2 diabetes (T2D) is common. T2D again.")], "passage_id bigint, docid string, fieldid string, base_offset int, text string"),
        "mentions": ([(1, "d", "C1", "type 2 diabetes", "Type 2 diabetes")], "passage_id bigint, docid string, cui string, concept_string string, term string"),
    }
    for name, (r, schema) in rows.items():  # from files, so that their sizes are known
        spark.createDataFrame(r, schema).write.parquet(f"{tmp_path}/{name}")
    p, m = (spark.read.parquet(f"{tmp_path}/{n}") for n in rows)
    out = abbreviation.propagated(m, abbreviation.definitions(match.sentence_rows(p)), p)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["start"], r["term"], r["cui"]) for r in out.collect()) == [(17, "T2D", "C1"), (33, "T2D", "C1")]


def test_meta_tokens():
    scan = negation.scanner()
    words = lambda t: [w for _, _, w in scan.words(t, match.token_spans(t))]
    assert words("No b.i.d. dosing (T2DM).") == ["no", "b.i", "d", "dosing", "(t2dm)"]
    assert words("no. sign") == ["no", "sign"] and words("") == []


def test_negation_golden():
    scan, wide = negation.scanner(), negation.scanner(reach=10)

    def says(text, span, by=scan):
        tell = by.flag(text, match.token_spans(text))
        at = text.index(span)
        return bool(tell and tell(at, at + len(span)))

    yes = [("There was no sign of pneumonia.", "pneumonia"), ("She denies chest pain.", "chest pain"), ("No history of myocardial infarction.", "myocardial infarction"), ("Pneumonia was ruled out.", "Pneumonia"), ("This rules out pneumonia.", "pneumonia")]
    no = [("She has chest pain.", "chest pain"), ("Please rule out pneumonia.", "pneumonia"), ("Pneumonia was not ruled out.", "Pneumonia"), ("No fever but pneumonia persists.", "pneumonia"), ("No evidence of a b c d e f pneumonia.", "pneumonia")]
    assert all(says(*c) for c in yes) and not any(says(*c) for c in no)
    assert says("No evidence of a b c d e f pneumonia.", "pneumonia", wide)
    # a phrase that stands somewhere counts where a longer one hides it, too
    own = negation.Scanner([(["no"], "nega"), (["no", "change"], "pnega")])
    assert not says("No change in fever today.", "fever", own) and says("No change in fever, no rash.", "fever", own)


def test_negation_flags_equal_the_join(spark):
    texts = ["No pneumonia but diabetes persists.", "Pneumonia was ruled out. Diabetes denied.", "US. Denies type 2 diabetes mellitus, pneumonia.", "Pneumonia-free b.i.d. No US."]
    s = match.sentence_rows(passages(spark, *texts))
    d = match.dictionary(names(spark))
    keys = ["passage_id", "start", "length", "cui", "negated"]
    joined = negation.negated(match.matches(match.candidates(s), d), s)
    inline = negation.scoped(match.found(s, d, flag=negation.scanner().flag), scope=None)
    rows = lambda df: sorted(map(tuple, df.select(*keys).collect()))
    assert rows(joined) == rows(inline) and any(r[-1] for r in rows(inline))


def test_key_filter_has_every_key(spark):
    keys = [f"k{i}" for i in range(3000)] + ["naïve α", ""]
    known = match.key_filter(spark.createDataFrame([(k,) for k in keys] + [(None,)], "norm string"))
    assert all(k in known for k in keys)
    assert sum(f"x{i}" in known for i in range(3000)) < 100


def test_keys_in_python_equal_the_columns(spark):
    hard = ["Alzheimer's disease", "[X]Other  disorders", "TNF-α", " a ", "boys' home", "'s", "x|y~z$ w", "ΑΣ ΟΔΟΣ", "É'S", "a\tb", "[SO]α's", "s'", "İx", "\x01'"]
    got = spark.createDataFrame([(t,) for t in hard], "t string").select("t", T.lookup_keys(F.col("t")).alias("k")).collect()
    assert [(r["t"], T.keys_of(r["t"])) for r in got] == [(r["t"], r["k"]) for r in got]


def test_text_with_the_cut_mark(spark):
    got = one(spark, T.sentences, "Ab\x01 cd. Ef\x01 gh.")
    assert [(r["start"], r["text"]) for r in got] == [(0, "Ab\x01 cd."), (8, "Ef\x01 gh.")]
    assert [(r["start"], r["text"]) for r in one(spark, T.lines, "a\x01b\nc\x01")] == [(0, "a\x01b"), (4, "c\x01")]


def test_long_texts_take_time_in_proportion(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("The dose was kept, no sign of it. " * n,)], "t string").coalesce(1)
        best = 1e9
        for _ in range(2):
            t = time.perf_counter()
            df.select(F.size(T.sentences(F.col("t"))), F.size(T._spans(T.token_texts(F.col("t"))))).collect()
            best = min(best, time.perf_counter() - t)
        return best

    took(10)
    small, large = took(3000), took(12000)  # 100 and 400 KB
    assert large < 8 * small + 1
    starts = spark.createDataFrame([([1, 2, 3] * 100,)], "a array<int>").select(T._starts(F.col("a")).alias("x")).first()["x"]
    assert starts == [sum(([1, 2, 3] * 100)[:i]) for i in range(300)]


def test_taggers(spark):
    import pytest

    from termloom.operators import tagging

    t = tagging.LexiconTagger({"rose": {"VBD": 0.9, "NN": 0.1}, "fell": {"VBD": 0.99, "NN": 0.01}}, default="NN")
    assert t([["It", "rose", "to", "fell"]]) == [["NN", "NN", "TO", "VBD"]]
    s = match.sentence_rows(passages(spark, "Pneumonia fell rose"))
    got = {r["term"] for r in match.candidates(s, tagger=t).collect()}
    assert got == {"Pneumonia", "Pneumonia fell", "Pneumonia fell rose", "rose"}
    with pytest.raises(ValueError, match="one tag per token"):
        tagging.tags_of([["a", " ", "b"]], lambda b: [["NN"]], lambda w: w == " ")


def test_segmenter_of_ones_own(spark):
    T.register_segmenter("halves", lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))])
    got = spark.createDataFrame([("abcd",), (None,)], "t string").select(T.segment(F.col("t"), "halves").alias("x")).collect()
    assert [(r["start"], r["text"]) for r in got[0]["x"]] == [(0, "ab"), (2, "cd")] and got[1]["x"] is None


def test_lookup_of_bare_terms(spark):
    terms = spark.createDataFrame([("Type 2 Diabetes Mellitus",), ("none",), (None,)], "q string")
    got = match.looked_up(terms, "q", match.dictionary(names(spark)))
    assert [(r["start"], r["text"], r["cui"]) for r in got.collect()] == [(0, "Type 2 Diabetes Mellitus", "C2"), (7, "Diabetes Mellitus", "C1"), (7, "Diabetes", "C1")]
    types = spark.createDataFrame([("C1", "T047", "dsyn")], "cui string, tui string, abbrev string")
    concepts = spark.createDataFrame([("C1", "Diabetes")], "cui string, preferred_name string")
    r = analytics.resolved_terms(terms, "q", match.dictionary(names(spark)), concepts, types)
    assert sorted((x["cui"], x["preferred_name"], x["semantic_types"]) for x in r.collect()) == [("C1", "Diabetes", ["dsyn"]), ("C2", "C2", [])]


def test_dictionary_build(spark, tmp_path):
    conso = ["C1|ENG|P|L|PF|S1|Y|A|||D|MSH|MH|1|Type 2 Diabetes|0|N||", "C1|ENG|S|L|VO|S2|Y|A|||D|SNOMEDCT_US|SY|1|T2D|0|O||", "C2|FRE|P|L|PF|S3|Y|A|||D|MSH|MH|1|Fièvre|0|N||", "short|row"]
    (tmp_path / "c.rrf").write_text("\n".join(conso) + "\n")
    (tmp_path / "s.rrf").write_text("C1|T047|x|y||\nC1|T999|x|y||\n")
    catalogue = spark.createDataFrame([("T047", "dsyn")], "tui string, abbrev string")
    D.build(spark, f"{tmp_path}/i", f"{tmp_path}/c.rrf", f"{tmp_path}/s.rrf", catalogue)
    t = D.open_index(spark, f"{tmp_path}/i")
    assert [(r["cui"], r["norm"]) for r in t["names"].collect()] == [("C1", "type 2 diabetes")]
    assert {(r["cui"], r["preferred_name"]) for r in t["concepts"].collect()} == {("C1", "Type 2 Diabetes"), ("C2", "Fièvre")}
    assert {r["abbrev"] for r in t["types"].collect()} == {"dsyn", "T999"}


def test_scan_keeps_file_order(spark, tmp_path):
    (tmp_path / "x").write_text("".join(f"{i}|v\n" for i in range(500)))
    got = D.scan(spark, f"{tmp_path}/x").orderBy("ord").select(F.col("f")[0].alias("v")).collect()
    assert [r["v"] for r in got] == [str(i) for i in range(500)]


def test_formats(spark, tmp_path):
    bioc = "<collection><document><id>7</id><infon key='a'>b</infon><passage><offset>5</offset><text>Hi &lt;x&gt;</text><sentence><offset>9</offset><text>yo</text></sentence></passage></document></collection>"
    med = "PMID- 1\nTI  - A title\n      goes on\nAB  - Text\n\nPMID- 2\nTI  - B\n"
    (tmp_path / "b.xml").write_text(bioc)
    (tmp_path / "m.txt").write_text(med)
    (tmp_path / "p.txt").write_text("1|t|Ti\n1|a|Abs\n1\t2\tann\n2|a|Only\n")
    b = [tuple(r) for r in documents.load(spark, f"{tmp_path}/b.xml", "bioc").select("docid", "base_offset", "text").collect()]
    assert b == [("7", 0, "Hi <x>"), ("7", 9, "yo")]
    m = [tuple(r) for r in documents.load(spark, f"{tmp_path}/m.txt", "medline").select("docid", "fieldid", "text").collect()]
    assert m == [("1", "TI", "A title goes on "), ("1", "AB", "Text "), ("2", "TI", "B ")]
    p = {tuple(r) for r in documents.load(spark, f"{tmp_path}/p.txt", "pubtator").select("docid", "fieldid", "base_offset", "text").collect()}
    assert p == {("1", "title", 0, "Ti"), ("1", "abstract", 2, "Abs"), ("2", "abstract", 0, "Only")}


def test_cohort_keeps_every_document(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "docid string")
    m = spark.createDataFrame([("a", 1, 0, 3, "C1", False), ("b", 2, 0, 3, "C1", True), ("c", 3, 0, 3, "C9", False)], "docid string, passage_id int, start int, length int, cui string, negated boolean")
    t = spark.createDataFrame([("C1",)], "cui string")
    assert {(r["docid"], r["status"]) for r in analytics.cohort(docs, m, t).collect()} == {("a", "affirmed"), ("b", "negated_only"), ("c", "absent")}


def test_numbered(spark):
    got = analytics.numbered(spark.range(100).withColumn("x", 99 - F.col("id")), ["x"], "n", 4).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 101)) and [r["id"] for r in got] == list(range(99, -1, -1))


def test_nested_shapes(spark):
    e = lambda **k: {"id": "e", **k}
    recs = [
        {"entities": [None, e(evs={"concept": {"cui": "A", "sources": "X"}})], "passages": {"infons": {"k": None}}},
        [e(evlist=[None, {"conceptinfo": json.dumps({"cui": "B", "sources": ["X", "Y", "X"]})}])],
        {"passages": [None, {"infons": [{"key": "q", "value": 1}, {"value": 2}]}], "entities": None},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(recs)] + [(7, None), (8, ""), (9, '{"entities": [{"id"'), (0, json.dumps(recs[0]))]
    df = spark.createDataFrame([(i, p, "x") for i, p in rows], "rec_id int, payload string, value string")
    assert {tuple(r) for r in nested.children(df).collect()} == {
        ("entity", 0, 1, -1, ""), ("ev", 0, 1, 0, "A"), ("source", 0, 1, 0, "X"), ("infon", 0, 0, -1, "k"),
        ("entity", 1, 0, -1, ""), ("ev", 1, 0, 1, "B"), ("source", 1, 0, 1, "X"), ("source", 1, 0, 1, "Y"), ("infon", 2, 1, -1, "q"),
    }
    assert nested.children(df.limit(0)).count() == 0
    types = {r["path"]: r["types"] for r in nested.merged_schema(df, "payload").collect()}
    assert types["$"] == "array|object" and types["$.passages"] == "array|object"


def test_nested_levels_follow_the_schema(spark):
    recs = [
        {"entities": [{"id": "e", "tags": [{"t": 1, "x.y": [5, [6]]}], "Note": "n", "evs": [{"concept": json.dumps({"cui": "A", "semantic_types": ["T1", "T2"]})}]}]},
        [{"id": "f", "tags": [None, {"t": "2"}], "evs": [{"conceptinfo": [{"cui": "B", "semantictypes": "T3"}], "value": "v"}]}],
        {"extra": {"k": [1]}, "entities": {"tags": "[x"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "rec_id int, payload string")
    t = nested.annotation_tables(df)
    rows = lambda name, *cols: sorted(tuple(r) for r in t[name].select("rec_id", *cols).collect())
    assert rows("semantic_type", "entity_no", "ev_no", "concept_no", "semantic_type_no", "value") == [(0, 0, 0, 0, 0, "T1"), (0, 0, 0, 0, 1, "T2"), (1, 0, 0, 0, 0, "T3")]
    assert rows("tags", "entity_no", "tags_no", "t") == [(0, 0, 0, "1"), (1, 0, 1, "2"), (2, 0, 0, None)]
    assert rows("x_y", "tags_no", "x_y_no", "value") == [(0, 0, 0, "5"), (0, 0, 1, "[6]")]
    assert rows("x_y_item", "x_y_no", "x_y_item_no", "value") == [(0, 1, 0, "6")]
    assert rows("k", "extra_no", "k_no", "value") == [(2, 0, 0, "1")]
    assert [r["Note"] for r in t["entity"].orderBy("rec_id").collect()] == ["n", None, None]
    assert rows("ev", "value_") == [(0, None), (1, "v")]


def test_nested_flat_tables(spark, tmp_path):
    from termloom import queries

    recs = [
        {"passages": [{"offset": 3, "text": "T", "infons": {"a": "1", "b": None, "c": {"d": 2}}}, {"infons": [{"key": "q", "value": 1}, {"value": 2}, {"key": "q", "value": "x"}]}]},
        {"entities": [{"id": "e", "text": "m", "evs": [{"id": "v", "score": 1.5, "concept": {"cui": "A", "preferred_name": "P", "sources": ["X"], "semantic_types": ["T1"]}}]}]},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate([*recs, recs[0]])]
    rows[2] = (0, rows[0][1])
    spark.createDataFrame(rows, "rec_id int, payload string").write.parquet(f"{tmp_path}/annotation_records.parquet")
    known = queries.queries()
    got = lambda name, *cols: sorted((tuple(r) for r in known[name](spark, str(tmp_path)).select(*cols).collect()), key=str)
    assert got("p3_infons", "rec_id", "passage_no", "infon_no", "item", "value") == [(0, 0, None, "a", "1"), (0, 0, None, "b", None), (0, 0, None, "c", '{"d":2}'), (0, 1, 0, "q", "1"), (0, 1, 2, "q", "x")]
    assert got("p3_passages", "rec_id", "passage_no", "offset", "text") == [(0, 0, "3", "T"), (0, 1, None, None)]
    assert got("p3_entities", "rec_id", "entity_no", "entity_id", "matched_text") == [(1, 0, "e", "m")]
    assert got("p3_evs", "rec_id", "entity_no", "ev_no", "ev_id", "score") == [(1, 0, 0, "v", "1.5")]
    assert got("p3_concepts", "ev_no", "concept_no", "cui", "preferred_name") == [(0, 0, "A", "P")]
    assert got("p3_sources", "concept_no", "source_no", "value") == [(0, 0, "X")] and got("p3_semantic_types", "semantic_type_no", "value") == [(0, "T1")]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "p").write_text("# c\ndetector=context\nprecision_filter: true\n")
    monkeypatch.setenv("TERMLOOM_DETECTOR", "none")
    s = Settings.load(str(tmp_path / "p"), sources=("A",))
    assert (s.detector, s.precision_filter, s.sources) == ("none", True, ("A",))


def test_stream(spark, tmp_path):
    from termloom.streaming.micro import annotate_stream

    passages(spark, "No pneumonia.").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(passages(spark, "x").schema).parquet(f"{tmp_path}/in")
    annotate_stream(src, names(spark), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [(r["cui"], r["negated"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("cui").collect()] == [("C3", True), ("C4", True)]
