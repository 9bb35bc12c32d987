"""Brute-force versions, round trips and defined cases of the training-data operators."""

import json
import random
from collections import Counter
from itertools import combinations, takewhile

import pytest
from pyspark.sql import functions as F

from termloom.llm import cooccur, encoding, frequency, lookalike, mixing, pii, sentences, subjects, tokens

HARD = [None, "", "   \n", "x" * 200_000, "à​😀 «é» №", "�\x85"]


# --- 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please reach Elira M. Lindqvarn at e.lind+notes (at) box [dot] test before noon.", [("name", "Elira M. Lindqvarn"), ("email", "e.lind+notes (at) box [dot] test")]),
        ("The patient was seen by Dr. de la Vorne on the ward.", [("name", "de la Vorne")]),
        ("Signs of Vantrose syndrome were absent. The @ward tag is not an address.", []),
        ("Mail the form to Flat 4, 75 Quillfern Row.", [("address", "Flat 4, 75 Quillfern Row")]),
        ("Le courrier part au 70 bis, rue des Verlières.", [("address", "70 bis, rue des Verlières")]),
        ("Post geht an Silberauer Allee 60 b.", [("address", "Silberauer Allee 60 b")]),
        ("Identity card QQ 09 71 68 C was copied.", [("id", "QQ 09 71 68 C")]),
        ("Counts were 120-130-1400 over three runs. Lot 485-4471-88 was opened.", []),
        ("insurance no. 00009810T Oryn Ivaschko lives at 9 Old Lane.", [("id", "00009810T"), ("name", "Oryn Ivaschko"), ("address", "9 Old Lane")]),
        ("25. 5555550194 is the daytime line.", [("phone", "5555550194")]),
        ("Joindre NADIELA QUILLMARSH au 06.39.98.77.11.", [("name", "NADIELA QUILLMARSH"), ("phone", "06.39.98.77.11")]),
    ],
)
def test_pii(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == want


def test_pii_keeps_the_rest(spark):
    text = "According to Okonwe, Elira the pain began. Call +44 7700 900112."
    assert pii.redact(text) == "According to [NAME] the pain began. Call [PHONE]."
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*HARD, text, text])], "id int, text string, start_pos string")
    assert pii.cases(df, "id", "text").count() == 4
    assert [r["x"] for r in df.select(pii.redacted(F.col("text")).alias("x")).collect()][:3] == HARD[:3]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("I spoke with Maria Garcia yesterday.", "Maria Garcia"), ("Best regards, Peter Brown", "Peter Brown"), ("Il s'appelle Jean Dupont.", "Jean Dupont"), ("Ring 555-123-4567 for Karen White.", "Karen White"),
        ("The form was prepared by Anna-Lena Vogt.", "Anna-Lena Vogt"), ("Se llama Lucía Ortega.", "Lucía Ortega"), ("Sie heißt Greta van der Berg.", "Greta van der Berg"), ("Reviewed by J. K. Omondi on Monday.", "J. K. Omondi"),
        ("We met with Saint Mary Hospital staff.", None), ("This is Parkinson Disease.", None), ("A budget for North America was set.", None),
    ],
)
def test_names_in_other_frames(text, name):
    assert [text[a:b] for k, a, b in pii.find(text) if k == "name"] == ([name] if name else [])


def _in_proportion(run, text, n=1500):
    import time

    def took(k):
        t = time.perf_counter()
        run(text * k)
        return time.perf_counter() - t

    took(10)
    small = min(took(n) for _ in range(2))
    assert min(took(4 * n) for _ in range(2)) < 9 * small + 0.2


@pytest.mark.parametrize("text", ["Call +44 7700 900112. ", "Flat 4, 75 Quillfern Row. ", "Dear Ms Ada Lovelace, "])
def test_pii_takes_time_in_proportion(text):
    _in_proportion(pii.find, text)


@pytest.mark.parametrize("text", ["see e.g. the i.e. part vs. x ", "a line that runs\nover many ", "(((", "a.b.c.d", "the 5. of it "])
def test_sentences_take_time_in_proportion(text):
    _in_proportion(sentences.split, text)


@pytest.mark.parametrize("text", ["\u202aa", "е\u0301a ", "Ｖ\u200d"])
def test_lookalike_takes_time_in_proportion(text):
    _in_proportion(lookalike.normalize, text)


def test_redacted_tables(spark, tmp_path):
    from termloom.llm import queries

    text = "Call +44 7700 900112."
    for table, key in (("passages", "passage_id"), ("documents", "doc_id")):
        rows = [(1, text), (2, None), (3, ""), *([(1, text)] if table == "passages" else [])]
        spark.createDataFrame(rows, f"{key} bigint, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    got = sorted(map(tuple, queries.p1_redacted(spark, str(tmp_path)).collect()))
    assert got == [(t, i, x) for t in ("documents", "passages") for i, x in ((1, "Call [PHONE]."), (2, None), (3, ""))]


# --- 2


def brute(baskets, least):
    n, ab = Counter(), Counter()
    for items in baskets.values():
        n.update(items)
        ab.update(combinations(sorted(items), 2))
    return {(a, b, k, n[a], n[b]) for (a, b), k in ab.items() if k >= least}


def frame(spark, baskets):
    rows = [(b, i) for b, s in baskets.items() for i in (s or [None])]
    return spark.createDataFrame(rows + rows[:5], "basket string, item string")


def test_pairs_incremental(spark, tmp_path):
    rnd = random.Random(1)
    all_items = [f"i{k:02}" for k in range(30)]
    first = {f"b{k}": set(rnd.sample(all_items, rnd.randrange(1, 7))) for k in range(60)} | {"hot": set(all_items)}
    store = cooccur.PairStore(spark, f"{tmp_path}/s", hot=10).apply(frame(spark, first))
    got = lambda s: {(r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"]) for r in s.scores(61, 3).collect()}
    assert got(store) == brute(first, 3)
    change = {"b1": set(all_items[:12]), "b2": set(), "hot": set(all_items[:5]), "new": {"i01", "i02"}}
    store.apply(frame(spark, change))
    now = brute({k: v for k, v in (first | change).items() if v}, 3)
    assert got(store) == now
    moved = {(r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"]) for r in store.affected(61, 3).collect()}
    assert now - brute(first, 3) <= moved <= now


def test_pairs_change_touches_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cooccur, "LEAST_BUCKETS", 32)
    b = {f"b{k}": {f"i{k}", f"i{k + 1}"} for k in range(100)}
    store = cooccur.PairStore(spark, f"{tmp_path}/s").apply(frame(spark, b))
    before = {t: dict(p) for t, p in store.state.paths.items()}
    store.apply(spark.createDataFrame([("b7", "i1"), ("b7", "i2")], "basket string, item string"))
    for t, most in (("baskets", 1), ("pairs", 2), ("items", 4)):
        moved = {k for k in before[t] | store.state.paths[t] if before[t].get(k) != store.state.paths[t].get(k)}
        assert 1 <= len(moved) <= most
    b["b7"] = {"i1", "i2"}
    assert {(r["item_a"], r["item_b"], r["n"]) for r in store.counts(1).collect()} == {(x, y, n) for x, y, n, _, _ in brute(b, 1)}


def test_pairs_many_hot_baskets(spark):
    b = {f"b{k}": {f"i{j}" for j in range(6)} for k in range(4)}
    s = cooccur.PairStore(spark, hot=2).apply(frame(spark, b))
    assert {(r["item_a"], r["item_b"], r["n"]) for r in s.counts(3).collect()} == {(x, y, 4) for x, y in combinations(sorted({f"i{j}" for j in range(6)}), 2)}


def test_pairs_empty(spark):
    e = spark.createDataFrame([], "basket string, item string")
    assert cooccur.PairStore(spark).apply(e).scores(0, 5).count() == 0


# --- 4


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Ｖｉｓｉｔ ｏｆ", "Visit of"), ("fi​br\xado͏sis", "fibrosis"), ("a b\xa0c‑d", "a b c-d"), ("Infеction bу", "Infection by"), ("iν οf", "iv of"),
        ("été", "été"), ("ﬁnding", "finding"), ("type Ⅱ", "type II"), ("페기파나", "페기파나"), ("ﾌﾟﾛ", "プロ"), ("Болeзнь", "Болезнь"), ("type І", "type I"),
    ],
)
def test_lookalike(given, want):
    assert lookalike.normalize(given) == want
    assert lookalike.normalize(want) == want


@pytest.mark.parametrize("legit", ["leveseno-γ blocker", "TNFα", "Болезнь Лаветибу", "بیماری‌های tisatuko", "ヌプベコ症", "누하다구 증후군", "Entzündung", "Σίγμα", "👩‍🔬", "क्‍ष"])
def test_lookalike_leaves(legit):
    assert lookalike.normalize(legit) == legit


def test_lookalike_cases(spark):
    for t in HARD:
        once = lookalike.normalize(t)
        assert lookalike.normalize(once) == once
    df = spark.createDataFrame([(1, "ａ"), (1, "ａ"), (2, "a"), (3, None)], "id int, text string")
    assert [(r["id"], r["normal"]) for r in lookalike.changed(df, "id", "text").collect()] == [(1, "a")]


# --- 5


@pytest.mark.parametrize(
    "parts",
    [
        ["The dose (see Tab. 55.) was kept at 17.7 mg q.i.d.", "The patient was seen by Dr. Okonwe on the ward."],
        ["“It burns.”", "Give 10 mg.", "He said: “I fell. Then I slept.”", "“Did it hurt?” she asked."],
        ["Am 1. und 2. Tag ca. 36 ml.", "Das war am 3. Mai.", "Besteht z. B. eine Entzündung?"],
        ["It rose to 2.7.", "i.v. fluids were started.", "pH was 5.", "59 patients were enrolled in arm B.", "Why now?!"],
        ["« C'est passé. »", "Le Dr Lindqvarn a examiné le patient.", "L'état s'est amélioré !"],
        ["Доза составила 7,7 мг и т. д.", "«Больно?» — спросил врач.", "Осмотр на 3-й день."],
        ["Mail the form to 7 Marrowgate St.", "He is 5 ft. 9 in. tall.", "(The scan was repeated.)", "It showed x."],
    ],
)
def test_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


def test_sentences_other_scripts():
    for text, n in (("“不疼了。”患者说。护士问：“睡得好吗？”详见图3。", 3), ("「眠れた？」と看護師が尋ねた。血圧は2であった（安静時。座位）。", 2), ("ผู้ป่วยมีอุณหภูมิ 0.5 องศา ผู้ป่วยกลับบ้านหลังจาก 27 วัน", 2), ("क्या सूजन है? तापमान 39.4 डिग्री था।", 2), ("راجع الصفحة 22. هل يوجد التهاب؟", 2), ("No new complaints\nThe dose was\nthen halved.", 2)):
        assert len(sentences.split(text)) == n, text


def test_sentences_cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, "It was. So it is.", "It was. So it is."])], "id int, text string")
    got = sentences.sentences(df, "id", "text").collect()
    assert {(r["id"], r["start_pos"]) for r in got if r["id"] >= 6} == {(6, 0), (6, 8), (7, 0), (7, 8)}
    assert not [r for r in got if r["id"] < 3]


def test_sentences_in_other_frames():
    for parts in (
        ["She boards at 5 p.m. on Fridays.", "The fee is 3.5 % of the total.", "Prof. Abara agreed."],
        ["Siehe Abb. 4 auf S. 12.", "Danach z. B. die Leber.", "Er kam am 5. Juni."],
        ["Voir p. 12 et fig. 3.", "« Pourquoi pas ? » demanda-t-elle.", "Fin."],
        ["El Dr. Ruiz llegó a las 8 a.m. con la Sra. Paz.", "¿Quién firmó?", "Nadie."],
    ):
        text = " ".join(parts)
        assert [text[a:b] for a, b in sentences.split(text)] == parts


def test_units_of_every_text(spark, tmp_path):
    from termloom.llm import queries

    passages = [(1, "Der Fuß schmerzt. Er ruht."), (2, "EntzÃ¼ndung der Leber. Er ruht."), (2, "EntzÃ¼ndung der Leber. Er ruht."), (3, "Entzündung der Leber."), (4, None), (5, " ")]
    spark.createDataFrame(passages, "passage_id bigint, text string").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([(2, "EntzÃ¼ndung. So.")], "sent_id bigint, text string").write.parquet(f"{tmp_path}/sentences.parquet")
    spark.createDataFrame([(1, "Leber", "leber")], "ord bigint, str string, norm string").write.parquet(f"{tmp_path}/cuisourceinfo.parquet")
    spark.createDataFrame([("Leber",)], "preferred_name string").write.parquet(f"{tmp_path}/concepts.parquet")
    of_s = [("sentences", 2, 0, "EntzÃ¼ndung."), ("sentences", 2, 13, "So.")]
    clean = [("passages", 1, 0, "Der Fuß schmerzt."), ("passages", 1, 18, "Er ruht."), ("passages", 3, 0, "Entzündung der Leber.")]
    wrong = [("passages", 2, 0, "EntzÃ¼ndung der Leber."), ("passages", 2, 23, "Er ruht.")]
    assert sorted(map(tuple, queries.p5_units(spark, str(tmp_path)).collect())) == sorted(clean + wrong + of_s)
    assert sorted(map(tuple, queries.p5_found(spark, str(tmp_path)).collect())) == sorted(x[:3] for x in clean + of_s)


# --- 6


def test_forms_letter_by_letter_equal_whole_words():
    import pandas as pd

    words = ["Entzündung", "Болезнь", "投与量を減らした", "Σίγμα", "naïve—x", "ﾌﾟ", "ÄÖ", "\ufffdx"]
    made = {(g, w) for g, w, _ in next(encoding._word_forms(iter([pd.DataFrame({"unit": words, "n": [1] * len(words)})]))).itertuples(index=False)}
    want = set()
    for w in words:
        want |= {(g, w) for g in encoding.forms(w, encoding.UTF8_AS + encoding.TWICE + encoding.EASTERN * any(c >= "\u1100" for c in w))}
        for v in {w, w.lower(), w.capitalize(), w.upper()}:
            want |= {(g, v) for g in encoding.forms(v, encoding.CROSSED + encoding.LOST) if g.strip("\ufffd")}
    assert made == want


def test_encoding(spark):
    clean = ["Entzündung der Gefäße", "Infección crónica", "Болезнь Лаветибу", "médecin noté", "投与量を減らした。", "«Así está bien»"] * 3
    wrong = ["EntzÃ¼ndung der Leber", "Infecci—n", "Áîëåçíü Ëàâåòèáó", "mŽdecin", "L├⌐ger", "Caf�", "MÃƒÂ¶bel", "ˆ“—^—Ê‚ð"]
    legit = ["leveseno-γ blocker", "Жалоб нет", "SÃO PREVISTAS", "l'hôpital", "Infеction"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *wrong[:7], *legit, None, "", *wrong[:1]])], "id int, text string")
    fixes = encoding.corpus_repairs([df.select("text")])
    found = {r["id"] for r in encoding.affected(df, "id", "text", fixes).collect()}
    assert found == {*range(18, 25), 32}
    got = {r["text"]: r["repaired"] for r in encoding.repaired(df, "id", "text", fixes).collect()}
    assert got["EntzÃ¼ndung der Leber"] == "Entzündung der Leber" and got["Áîëåçíü Ëàâåòèáó"] == "Болезнь Лаветибу" and got["MÃƒÂ¶bel"].endswith("bel")


def test_encoding_between_cyrillic_sets(spark):
    rows = ["опухоль лёгкого"] * 6 + ["НОСУНКЭ", "жалоб нет"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    fixes = encoding.corpus_repairs([df.select("text")])
    assert [(r["id"], r["repaired"]) for r in encoding.repaired(df, "id", "text", fixes).collect()] == [(6, "опухоль")]


def test_encoding_round_trip():
    for chain in encoding.UTF8_AS + encoding.TWICE:
        assert encoding._undone(encoding.garbled("Größe", chain), chain) == "Größe"


# --- 7


def test_burst_trie():
    rnd = random.Random(2)
    terms = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(9))) for _ in range(5000)]
    t, u, c = frequency.BurstTrie(8), frequency.BurstTrie(5), Counter(terms)
    for i, w in enumerate(terms):
        (t if i % 2 else u).add(w, 1, 1)
    t.merge(u)
    assert list(t.items()) == [(w, n, n) for w, n in sorted(c.items())]


def test_term_counts(spark):
    rows = [("f", t, 2, 1) for t in ["a", "a", "", "ab", "x" * 5000]] + [("g", "a", 1, 1), ("f", None, 1, 1)]
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in frequency.term_counts(spark.createDataFrame(rows, "field string, term string, occurrences int, records int")).collect()}
    assert got == {("f", "a"): (4, 2), ("f", ""): (2, 1), ("f", "ab"): (2, 1), ("f", "x" * 5000): (2, 1), ("g", "a"): (1, 1)}


def test_term_counts_of_more_terms_than_held(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [(f, t, 1, 1) for _ in range(3) for f in "fg" for t in "abcdefghij"]
        df = spark.createDataFrame(rows, "field string, term string, occurrences int, records int").repartition(3)
        got = sorted(tuple(r) for r in frequency.term_counts(df, partitions=1, most=3).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == [(f, t, 3, 3) for f in "fg" for t in "abcdefghij"]


# --- 8


def test_tokens(spark):
    path = tokens.tokenizer_path()
    texts = [*HARD[:3], "naïve 😀<|endoftext|> œuvre", "tab\tend\r\n", "日本語のテキスト"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    rows = df.select("id", "text", tokens.ids(F.col("text"), path).alias("ids"), tokens.count(F.col("text"), path).alias("n"), tokens.spans(F.col("text"), path).alias("s")).withColumn("back", tokens.decode(F.col("ids"), path)).orderBy("id").collect()
    assert rows[0]["ids"] == rows[1]["ids"] == []
    for r in rows:
        assert r["back"] == (r["text"] or "") and r["n"] == len(r["ids"]) == len(r["s"])
        assert 50256 not in r["ids"]
        assert {i for s in r["s"] for i in range(s["start"], s["end"])} == set(range(len(r["text"] or "")))
    assert sorted(json.load(open(path, encoding="utf-8"))["model"]["vocab"].values())[:3] == [0, 1, 2]


# --- 9


def test_mix(spark):
    docs = [(k, s, f"word {k} " * 30) for k, s in enumerate(["a"] * 60 + ["b"] * 6 + ["c"] * 30 + [None, "zz"])]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 2), ("c", 0.35, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mix(df, targets, tokens.tokenizer_path(), block=200)
    rows = mixed.collect()
    times = Counter((r["source"], r["doc_id"]) for r in rows)
    assert {s for s, _ in times} == {"a", "b", "c"} and all(n <= {"a": 2, "b": 2, "c": 4}[s] for (s, _), n in times.items())
    rep = {r["source"]: r for r in mixing.report(mixed, plan).collect()}
    assert rep["b"]["short"] and rep["none"]["short"] and not rep["a"]["short"]
    assert abs(rep["a"]["mixed_tokens"] - rep["a"]["wanted"]) < 500 and abs(rep["c"]["mixed_tokens"] - rep["c"]["wanted"]) < 500
    assert mixing.mix(df.limit(0), targets, tokens.tokenizer_path())[0].count() == 0


def test_short_follows_the_mix(spark):
    plan = [{"source": s, "share": 0.5, "repeats": 1, "tokens": n, "docs": 1, "total": 100, "wanted": 50.0, "due": float(min(50, n))} for s, n in (("a", 90), ("b", 10))]
    short = lambda n: mixing.report(spark.createDataFrame([("a", 50), ("b", n)], "source string, n bigint"), plan).where("short").select("source")
    assert [r["source"] for r in short(10).collect()] == ["b"] and not short(50).collect()
    assert "Join" in short(10)._jdf.queryExecution().optimizedPlan().toString()


# --- 10


def test_subjects_held_out(spark):
    rnd = random.Random(5)
    topics = {"sport": ["marathon pace", "rowing crew", "match fitness"], "law": ["court order", "liability claim", "witness statement"]}
    def doc():
        s = rnd.choice(["sport", "law", None])
        body = ["The visit lasted long.", "A copy goes to the desk."] + ([f"We discussed the {rnd.choice(topics[s])}." for _ in range(4)] if s else [])
        other = rnd.choice(["sport", "law"])
        if other != s:
            body.append(f"In passing, the {rnd.choice(topics[other])} came up.")
        rnd.shuffle(body)
        return " ".join(body), s
    made = [doc() for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s or "none") for i, (_, s) in enumerate(made) if i < 200] + [(5000, "law")], "doc_id bigint, subject string")
    out, _ = subjects.assign(docs, labels)
    got = {(r["doc_id"], r["subject"]) for r in out.collect() if r["doc_id"] >= 200}
    want = {(i, s) for i, (_, s) in enumerate(made) if i >= 200 and s}
    assert len(got & want) / len(want) > 0.95 and len(got - want) / max(1, len(got)) < 0.05
    assert subjects.assign(docs, labels.limit(0))[0].count() == 0


def test_grown_rules_equal_all_patterns():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(7)]
    rows = [(sorted(rnd.sample(words, rnd.randrange(1, 6))), sorted(rnd.sample(["a", "b"], rnd.randrange(3)))) for _ in range(60)]
    want = {}
    for k in range(1, subjects.LONGEST + 1):
        for p in combinations(words, k):
            hit = [s for ws, s in rows if set(p) <= set(ws)]
            for subject in "ab":
                n = sum(subject in s for s in hit)
                if n >= 3 and n / len(hit) >= 0.4:
                    want[p, subject] = (n, n / len(hit))
    got = {}
    for w in words:
        held = [(ws[: ws.index(w)], s) for ws, s in rows if w in ws]
        if held:
            for p, subject, n, c in subjects.grown(w, [b for b, _ in held], [s for _, s in held], 3, 0.4):
                assert (tuple(p), subject) not in got
                got[tuple(p), subject] = (n, c)
    assert got == want


def _labelled(spark, n):
    """Documents of many rules of one, two and three words, and their labels."""
    rnd = random.Random(8)
    topics = {s: [f"{s}{chr(97 + i)}word" for i in range(12)] for s in ("sport", "law")}
    made = [(i, s, ". ".join(" ".join(rnd.sample(topics[s] + ["desk", "visit"], 5) + rnd.sample(topics["law"], i % 2)) for _ in range(4))) for i in range(n) for s in [rnd.choice(["sport", "law"])]]
    return spark.createDataFrame([(i, t) for i, _, t in made], "doc_id bigint, text string"), spark.createDataFrame([(i, s) for i, s, _ in made], "doc_id bigint, subject string")


def test_rules_are_no_burden_of_the_driver(spark, monkeypatch):
    docs, labels = _labelled(spark, 60)
    frame, seen = type(docs), []
    collect = frame.collect

    def counted(df):
        seen.append(collect(df))
        return seen[-1]

    monkeypatch.setattr(frame, "collect", counted)
    subjects.assign(docs, labels)
    monkeypatch.undo()
    texts = docs.join(labels.select("doc_id", F.array("subject").alias("subjects")), "doc_id")
    rules = subjects.mine(texts, 1000, 3, 0.4)
    assert rules.count() > 50 and max(map(len, seen)) < 50  # the bins of the scores at most
    assert len({(tuple(r["antecedent"]), r["subject"]) for r in rules.collect()}) == rules.count()


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], subjects.kept
    monkeypatch.setattr(subjects, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    docs, labels = _labelled(spark, 60)
    subjects.mine(docs.join(labels.select("doc_id", F.array("subject").alias("subjects")), "doc_id"), 1000, 3, 0.4)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for lines in map(str.splitlines, plans):
        for k, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = "\n".join(takewhile(lambda x: depth(x) > depth(line), lines[k + 1 :]))
                assert "Generate explode(words" not in below and "Generate explode(transform" not in below
    assert sum("Generate explode(words" in p for p in plans) == 1 and sum("Generate explode(transform" in p for p in plans) == 1


def test_pruned_rules_equal_those_compared_one_by_one(spark):
    rnd = random.Random(3)
    sure = {(p, s): rnd.randrange(40, 100) / 100 for k in (1, 2, 3) for p in combinations("abcdef", k) for s in "xy" if rnd.random() < 0.7}
    want = {(a, s) for (a, s), c in sure.items() if all(c > sure.get((p, s), -1) + subjects.SURER for k in range(1, len(a)) for p in combinations(a, k))}
    found = spark.createDataFrame([(list(a), s, 3, c) for (a, s), c in sure.items()], subjects._RULES)
    assert {(tuple(r["antecedent"]), r["subject"]) for r in subjects.pruned(found).collect()} == want


def test_more_rules_than_a_task_holds_give_the_same_scores(spark, monkeypatch):
    docs, labels = _labelled(spark, 60)
    docs = docs.union(spark.createDataFrame([(59, "sportaword. lawbword lawcword."), (61, None), (62, "")], docs.schema))  # an id that stands twice
    got = lambda: sorted(map(tuple, subjects.assign(docs, labels)[1].collect()))
    whole = got()
    monkeypatch.setattr(subjects, "MOST_RULES", 7)
    assert got() == whole and len({d for d, _, _ in whole}) == 60 and sum(d == 59 for d, _, _ in whole) > len({s for d, s, _ in whole if d == 59})


def test_matching_rules_of_a_long_sentence():
    rules = {("a",): [("s", 0.5)], ("a", "c"): [("s", 0.9)], ("b", "x"): [("t", 0.8)]}
    words = frozenset(w for a in rules for w in a)
    tree = subjects.compiled(rules)
    assert subjects.evidence("C and a. B alone. X b", tree, words) == {"s": 0.9, "t": 0.8}
    many = {(f"v{i:04}",): [("s", 0.5)] for i in range(3000)}
    _in_proportion(lambda t: subjects.evidence(t, subjects.compiled(many), frozenset(w for a in many for w in a)), "".join(f"v{i:04} " for i in range(300)).replace("0", "o"), 5)


def test_isotonic():
    import numpy as np

    assert subjects.isotonic(np.array([10.0, 10, 10]), np.array([5.0, 1, 9])).tolist() == [0.3, 0.3, 0.9]
