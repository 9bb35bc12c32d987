"""Garbled text from wrong character encoding.

Clean words of the corpus are garbled on purpose under every chain of encodings (written as A, read
as B, up to twice), and the tokens of the texts are hash-joined against that table: a token that
equals a garbled form is restored to the word it came from, if the word is the cleaner or the far
more frequent of the two. Units of the join are whole words and, for UTF-8 read as a single-byte
encoding, single characters, so that words the corpus nowhere holds clean are restored too.

A word is a run without white space and digits that holds a character beyond ASCII; scripts without
spaces are also cut after sentence marks, whether these are clean or garbled themselves. Everything
runs over distinct units, so the cost follows the vocabulary.

Defined cases: null and empty texts are not affected; U+FFFD is what a lost character was replaced
by, so a text with one is affected and keeps it unless a word of the corpus explains it; repeated
rows count once; a text of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.match import key_filter
from termloom.session import kept, spread

# --- encodings -------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _table(enc: str) -> tuple[list[str], dict[str, int]]:
    """A single-byte encoding; bytes it leaves undefined stand for the control of the same number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


WIDE = {"utf-8", "cp932", "euc_kr", "gb18030", "big5", "euc_jp"}


def written(s: str, enc: str) -> bytes | None:
    try:
        if enc in WIDE:
            return s.encode(enc)
        back = _table(enc)[1]
        return bytes([back[c] for c in s])
    except (UnicodeEncodeError, KeyError):
        return None


def read_as(b: bytes, enc: str) -> str:
    return b.decode(enc, "replace") if enc in WIDE or enc == "ascii" else "".join(map(_table(enc)[0].__getitem__, b))


SINGLE = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "koi8_r", "cp1253", "cp1250", "cp866")
#: UTF-8 read as a single-byte encoding; these also hold character by character.
UTF8_AS = tuple(("utf-8", d) for d in SINGLE)
#: The same mistake made twice.
TWICE = tuple(("utf-8", a, "utf-8", b) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1"))
#: One single-byte encoding read as another, and wide encodings of East Asia read as Western.
CROSSED = (
    ("mac_roman", "cp1252"),
    ("mac_roman", "latin-1"),
    ("latin-1", "mac_roman"),
    ("cp437", "cp1252"),
    ("cp1252", "cp437"),
    ("cp850", "cp1252"),
    ("cp1252", "cp850"),
    ("cp1251", "cp1252"),
    ("cp1251", "latin-1"),
    ("cp1251", "mac_roman"),
    ("cp1252", "cp1251"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1252"),
    ("cp866", "cp1251"),
    ("cp1252", "cp1253"),
    ("cp1253", "cp1252"),
)
EASTERN = tuple((a, b) for a in ("cp932", "euc_kr", "gb18030", "big5", "euc_jp") for b in ("cp1252", "latin-1"))
#: Read as UTF-8 or ASCII: what is no valid sequence becomes U+FFFD.
LOST = tuple((a, "utf-8") for a in ("latin-1", "cp1251", "cp1253", "cp932", "euc_kr", "gb18030"))


@lru_cache(maxsize=64)
def _crossing(a: str, b: str) -> dict[str, str]:
    """The characters beyond ASCII of one single-byte encoding as another shows them."""
    return {c: d for c, d in zip(_table(a)[0][128:], _table(b)[0][128:], strict=True)}


def garbled(word: str, chain: tuple[str, ...]) -> str | None:
    """The word after a chain of (written as, read as); None where the chain cannot hold it."""
    for a, b in zip(chain[::2], chain[1::2], strict=True):
        if a not in WIDE and b not in WIDE:
            over = _crossing(a, b)
            if not all(c < "\x80" or c in over for c in word):
                return None
            word = "".join([over.get(c, c) for c in word])
            continue
        raw = written(word, a)
        if raw is None:
            return None
        word = read_as(raw, b)
    return word


def forms(word: str, chains: tuple[tuple[str, ...], ...]) -> set[str]:
    return {g for c in chains if (g := garbled(word, c)) and g != word}


# --- how clean a unit looks ------------------------------------------------------------------------

_ODD = re.compile("[\u0080-\u009f�-─-▟√∫≈≤≥≠∞∂∆◊⌐₧¬­]")
_MARK = set("¢£¤¥¦§¨©ª®¯°²³´µ¶·¸¹º¼½¾¿¡«»±ƒˆ˜–—‘‚“”„†‡•…‰‹›€™ №")
_OPEN, _CLOSE = set("«“„‘¿¡‚‹"), set("»”“…›")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "O" if unicodedata.category(c)[0] in "LM" else ""


def badness(u: str) -> int:
    """How many places of a unit no correctly written word shows; 0 for a clean unit."""
    bad = 3 * len(_ODD.findall(u))
    for i, c in enumerate(u):
        if c < "\x80":
            continue
        p, n = u[i - 1] if i else "", u[i + 1] if i + 1 < len(u) else ""
        if c in _MARK:
            inside = p.isalpha() and n.isalpha()
            hung = p.isalpha() and c not in _CLOSE and c not in "–—ºª°™®" or n.isalpha() and c not in _OPEN and c not in "–—°±µ‘№§”»"
            paired = bool(p) and p in _MARK and p not in "…»”" and c not in "«»“”…—–¡¿"
            bad += inside or hung or paired
        elif c.isalpha():
            s, q = _script(c), _script(p) if p else ""
            if s == "L" and c.isupper() and p.isalpha() and p.islower():
                bad += 1
            if s == "L" and p >= "\x80" and q == "L":
                bad += 1
            if p and q and s != q:
                bad += 1
            elif s != "L" and n and _script(n) == "L":
                bad += 1
            if s == "C" and (0x402 <= ord(c) <= 0x40F and c != "Ё" or 0x452 <= ord(c) <= 0x45F):
                bad += 1
            if s == "C" and c.isupper() and p and q == "C" and p.islower():
                bad += 1
    return bad


# --- units -----------------------------------------------------------------------------------------

_CJK = r"　-ヿ㐀-鿿가-힯＀-￯"
_ENDS = "。！？」）；：，、、"


@lru_cache(maxsize=1)
def _cut() -> str:
    """A pattern after which units are cut: sentence marks of scripts without spaces, clean or garbled
    (garbled ones only where they are two characters or more, tried only at a character one begins with)."""
    marks = {g for m in _ENDS for g in forms(m, UTF8_AS + TWICE + (("cp932", "cp1252"), ("cp932", "latin-1"))) if len(g) > 1 and "�" not in g}
    leads = "".join(sorted({_quoted(m[0]) for m in marks}))
    return "([" + _ENDS + "]|(?=[" + leads + "])(?:" + "|".join(sorted(map(_quoted, marks), key=lambda m: (-len(m), m))) + "))"


def _quoted(s: str) -> str:
    return "".join("\\x{%x}" % ord(c) for c in s)


def units(text: Column) -> Column:
    """array<string>: the units of a text, each with and without ASCII marks around it."""
    edges = F.regexp_replace(text, f"(?<=[{_CJK}])(?=[^{_CJK}])|(?<=[^{_CJK}])(?=[{_CJK}])", " ")
    apart = F.regexp_replace(F.when(text.rlike(f"[{_CJK}]"), edges).otherwise(text), _cut(), "$1 ")
    raw = F.regexp_extract_all(apart, F.lit(r"(?<![^\x00-\x20\x7f0-9])([\x21-\x2f\x3a-\x7e]*+[^\x00-\x7f][^\x00-\x20\x7f0-9]*+)"), F.lit(1))
    core = F.transform(raw, lambda u: F.regexp_replace(u, r"^[!-/:-@\[-`{-~]++|(?<![!-/:-@\[-`{-~])[!-/:-@\[-`{-~]++$", ""))
    return F.array_distinct(F.concat(raw, core))


def _scored(b: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in b:
        yield s.map(badness).astype("int32")


def _sbcs_regex(enc: str) -> re.Pattern[str]:
    t = _table(enc)[0]
    cls = lambda lo, hi: "[" + "".join(map(re.escape, t[lo : hi + 1])) + "]"
    c = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{c}|{cls(0xE0, 0xEF)}{c}{c}|{cls(0xF0, 0xF4)}{c}{c}{c}")


@lru_cache(maxsize=1)
def _seekers() -> tuple[tuple[tuple[str, ...], re.Pattern[str]], ...]:
    return tuple((c, _sbcs_regex(c[1])) for c in UTF8_AS)


def _undone(g: str, chain: tuple[str, ...]) -> str | None:
    """The word behind a garbled form, if the chain can be reversed without loss."""
    for a, b in reversed(list(zip(chain[::2], chain[1::2], strict=True))):
        raw = written(g, b)
        if raw is None:
            return None
        try:
            g = raw.decode(a)
        except UnicodeDecodeError:
            return None
    return g


class Unheld(Exception):
    """No lookup error, which ``str.translate`` would take for a letter that stays."""


class _Letters(dict):
    """What a chain that works letter by letter makes of each letter, found out once; a letter the chain
    cannot hold is an ``Unheld``."""

    def __init__(self, chain: tuple[str, ...]) -> None:
        super().__init__()
        self.chain, self.unheld = chain, set()

    def __missing__(self, o: int) -> str:
        if o in self.unheld:
            raise Unheld
        g = garbled(chr(o), self.chain)
        if g is None:
            self.unheld.add(o)
            raise Unheld
        self[o] = g
        return g


@lru_cache(maxsize=1)
def _letterwise() -> tuple[list[_Letters], list[_Letters], list[_Letters]]:
    """All chains but those that read as UTF-8 or ASCII keep letters apart: what they make of a word is what
    they make of its letters."""
    return tuple([_Letters(c) for c in chains] for chains in (UTF8_AS + TWICE, EASTERN, CROSSED))


def _through(word: str, tables: list[_Letters]) -> Iterator[str]:
    for t in tables:
        try:
            g = word.translate(t)
        except Unheld:
            continue
        if g != word:
            yield g


def _word_forms(batches: Iterator[pd.DataFrame], known: object = None) -> Iterator[pd.DataFrame]:
    """(unit, word, word_n): the forms of clean words; of those no unit can have (``known``: a filter of the
    units) none is sent on."""
    wide, eastern, crossed = _letterwise()
    held = known.value if known is not None else None
    for b in batches:
        out = []
        for w, n in zip(b["unit"], b["n"], strict=True):
            found = {(g, w) for g in _through(w, wide + eastern if any(c >= "\u1100" for c in w) else wide)}
            for v in {w, w.lower(), w.capitalize(), w.upper()}:
                found |= {(g, v) for g in _through(v, crossed) if g.strip("\ufffd")}
                found |= {(g, v) for g in forms(v, LOST) if g.strip("\ufffd")}
            out += [(g, v, n) for g, v in found if held is None or g in held]
        yield pd.DataFrame(out, columns=["unit", "word", "word_n"])


def _char_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for c in b["char"]:
            for ch in UTF8_AS + TWICE:
                g = garbled(c, ch)
                if g and g != c:
                    out.append((g, c, "|".join(ch)))
        yield pd.DataFrame(out, columns=["piece", "char", "chain"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of units that look garbled, the stretches that may each be one character read wrongly."""
    for b in batches:
        out = []
        for u in b["unit"]:
            for chain, rx in _seekers():
                out += [(u, "|".join(chain), p) for p in set(rx.findall(u))]
            for chain in TWICE:
                outer, inner = _sbcs_regex(chain[3]), _sbcs_regex(chain[1])
                once = outer.sub(lambda m: _undone(m.group(0), chain[2:]) or m.group(0), u)
                if once != u:
                    out += [(u, "|".join(chain), g) for p in set(inner.findall(once)) if (g := garbled(p, chain[2:]))]
        yield pd.DataFrame(sorted(set(out)), columns=["unit", "chain", "piece"])


def _restore(u: pd.Series, chain: pd.Series, pieces: pd.Series) -> pd.Series:
    out = []
    for s, _c, ps in zip(u, chain, pieces, strict=True):
        for p in sorted(ps, key=lambda x: -len(x["piece"])):
            s = s.replace(p["piece"], p["char"])
        out.append(s)
    return pd.Series(out, dtype=object)


def unit_rows(df: DataFrame, table: str, text: str, key: str | None = None) -> DataFrame:
    """(table_name, row_id, unit): the units of every row; without ``key`` they only count."""
    rows = spread(df.select(F.lit(table).alias("table_name"), (F.col(key) if key else F.lit(None)).cast("bigint").alias("row_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")))
    return rows.select("table_name", "row_id", F.explode(units(F.col("text"))).alias("unit")).where("unit rlike '[^\\\\x00-\\\\x7f]'")


def counted(rows: DataFrame) -> DataFrame:
    """(unit, n, bad): distinct units with the rows they stand in, and how bad they look."""
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("bad", F.pandas_udf(_scored, "int")("unit"))


def vocabulary(texts: list[DataFrame]) -> DataFrame:
    """``counted`` units of text columns. Each frame has one column, ``text``."""
    every = unit_rows(texts[0], "", "text")
    for t in texts[1:]:
        every = every.unionByName(unit_rows(t, "", "text"))
    return counted(every)


#: A unit and its word both of Cyrillic letters alone: one read as the other in two 8-bit Cyrillic sets.
CYRILLIC = r"(unit rlike '^\\p{IsCyrillic}+$' and word rlike '^\\p{IsCyrillic}+$')"


def repairs(vocab: DataFrame) -> DataFrame:
    """(unit, original): garbled units with what they were; original null where that is lost."""
    v = vocab
    clean = v.where("bad = 0").withColumn("fold", F.lower("unit"))
    folds = clean.groupBy("fold").agg(F.sum("n").alias("n"), F.min("unit").alias("unit"))
    cores = v.sparkSession.sparkContext.defaultParallelism
    # few bytes, much work: by size alone these rows would be one task
    known = v.sparkSession.sparkContext.broadcast(key_filter(v.select("unit"), "unit"))  # bounded, see there
    table = folds.select("unit", "n").repartition(cores * 2).mapInPandas(partial(_word_forms, known=known), "unit string, word string, word_n bigint")
    met = v.join(table, "unit").where(f"bad > 0 or word_n >= 2 * n and word_n >= 3 and length(unit) > 3 and (unit rlike '[A-Za-z]' or {CYRILLIC})")
    met = met.where("word <> unit")
    by_word = met.groupBy("unit").agg(F.max_by("word", F.struct("word_n", "word")).alias("original"))
    chars = clean.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("char")).where("char rlike '[^\\\\x00-\\\\x7f]'").distinct()
    small = chars.mapInPandas(_char_forms, "piece string, char string, chain string")
    seen = v.where("bad > 0").select("unit").repartition(cores * 2).mapInPandas(_pieces, "unit string, chain string, piece string")
    hits = seen.join(small, ["piece", "chain"]).groupBy("unit", "chain").agg(F.collect_set(F.struct("piece", "char")).alias("pieces"))
    tried = hits.withColumn("original", F.pandas_udf(_restore, "string")("unit", "chain", "pieces"))
    tried = tried.withColumn("left", F.pandas_udf(_scored, "int")("original"))
    by_char = tried.groupBy("unit").agg(F.min_by("original", F.struct("left", F.length("original"), "chain")).alias("original"), F.min("left").alias("left"))
    by_char = by_char.join(v.select("unit", "bad"), "unit").where("left < bad").select("unit", F.col("original").alias("by_char"), "left")
    lost = v.where(F.col("unit").contains("�")).select("unit")
    every = by_word.join(by_char, "unit", "full").join(lost.withColumn("lost", F.lit(True)), "unit", "full")
    return every.select("unit", F.when(F.col("left") == 0, F.col("by_char")).otherwise(F.coalesce("original", "by_char")).alias("original"))


def affected(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """(key): rows of which a unit is garbled, each once."""
    u = spread(df.where(F.col(text).rlike(r"[^\x00-\x7f]"))).select(F.col(key), F.explode(units(F.col(text))).alias("unit"))
    return u.join(fixes.select("unit"), "unit", "left_semi").select(key).distinct()


def affected_rows(rows: DataFrame, table: str, fixes: DataFrame) -> DataFrame:
    """(row_id): as ``affected``, from ``unit_rows`` made before."""
    return rows.where((F.col("table_name") == table) & F.col("row_id").isNotNull()).join(fixes.select("unit"), "unit", "left_semi").select("row_id").distinct()


def _replaced(text: pd.Series, fixes: pd.Series) -> pd.Series:
    out = []
    for s, fs in zip(text, fixes, strict=True):
        if fs is not None and s:
            found = {f["unit"]: f["original"] for f in fs if f["original"] is not None}
            if found:
                rx = re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True))))
                s = rx.sub(lambda m, found=found: found[m.group(0)], s)
        out.append(s)
    return pd.Series(out, dtype=object)


def repaired(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """(key, text, repaired): the affected rows with their text restored as far as it can be."""
    rows = df.select(F.col(key), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")).dropDuplicates([key])
    u = rows.select(key, F.explode(units(F.col("text"))).alias("unit"))
    found = u.join(fixes, "unit").groupBy(key).agg(F.collect_set(F.struct("unit", "original")).alias("fixes"))
    return rows.join(found, key).select(key, "text", F.pandas_udf(_replaced, "string")("text", "fixes").alias("repaired"))


def corpus_repairs(texts: list[DataFrame]) -> DataFrame:
    """Vocabulary and repairs of a corpus, each written once for its several readers."""
    return kept(repairs(kept(vocabulary(texts), "units")), "repairs")
