"""Visually identical text with different characters.

A transducer goes once over the grapheme clusters of a text. Clusters are looked up in a precomputed
table (longest match first: a whole cluster, then its parts) that maps widths, missing compositions,
spaces and invisible characters to the ordinary spelling; a word is held back until it ends, and
letters of a foreign alphabet in it are then mapped to their look-alikes in the word's own alphabet.
``table`` builds the mapping by rule from Unicode data and refuses conflicts: no key may have two
results, and every result must be a fixed point.

What a script needs stays: joiners between Arabic letters that would otherwise join, in Indic
clusters and in emoji, direction marks next to right-to-left text, Greek letters as symbols, and all
correctly composed text of any script.

Defined cases: null gives null; the empty text and pure ASCII are returned as they are; a text of
any length is processed whole; normalizing twice changes nothing.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

# Letters that look the same, Cyrillic and Greek with their Latin counterparts.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I",
}
GREEK = {
    "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "α": "a", "κ": "k", "χ": "x", "γ": "y", "τ": "t", "ω": "w", "ε": "e", "η": "n", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
#: Greek letters that are written as symbols inside Latin words (TNFα, IFNγ).
SYMBOLS = set("αβγδεκλμπστωΔΩηχ")
#: Characters that show nothing.
INVISIBLE = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), 0x3164, 0xFFA0}
INVISIBLE_CHARS = frozenset(map(chr, INVISIBLE))
_CLUSTER = regex.compile(r"\X")
JOINERS = {"‌", "‍"}
MARKS = {"‎", "‏", "؜"}


class Conflict(ValueError):
    pass


def _width() -> dict[str, str]:
    """Full and half width forms, ligatures, Roman numerals, Arabic presentation forms, spaces, hyphens."""
    out: dict[str, str] = {}
    for o in [*range(0xA0, 0x3000), *range(0x3000, 0x3001), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(o)
        d = unicodedata.decomposition(c)
        kind = d[1 : d.index(">")] if d.startswith("<") else ""
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif o in INVISIBLE:
            continue
        elif kind in ("wide", "narrow", "font") or kind == "compat" and (0xFB00 <= o <= 0xFB17 or 0x2160 <= o <= 0x217F) or kind in ("initial", "medial", "final", "isolated"):
            out[c] = unicodedata.normalize("NFKC", c)
        elif kind == "noBreak" and unicodedata.category(c) == "Pd":
            out[c] = "-"
    out["‐"] = "-"
    return {k: v for k, v in out.items() if k != v}


def _composition() -> dict[str, str]:
    """Every decomposed spelling of a precomposed character, Hangul syllables included."""
    out = {}
    for o in [*range(0xC0, 0x3100), *range(0xAC00, 0xD7A4), *range(0xF900, 0xFB00), *range(0x11000, 0x11940)]:
        c = chr(o)
        if unicodedata.normalize("NFC", c) == c:
            d = unicodedata.normalize("NFD", c)
            if d != c:
                out[d] = c
        elif not unicodedata.decomposition(c).startswith("<"):
            out[c] = unicodedata.normalize("NFC", c)
    return out


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """The mapping of clusters and characters, checked for conflicts."""
    width = _width()
    over = {k: "".join(width.get(c, c) for c in v) for k, v in _composition().items() if k not in width}
    out: dict[str, str] = {}
    for part in (width, over):
        for k, v in part.items():
            v = unicodedata.normalize("NFC", v)
            if out.get(k, v) != v:
                raise Conflict(f"{k!r} maps to {out[k]!r} and {v!r}")
            if k != v:
                out[k] = v
    for k, v in out.items():
        if v in out or any(c in out for c in v):
            raise Conflict(f"{k!r} maps to {v!r}, which is mapped again")
    return out


@lru_cache(maxsize=1)
def foreign() -> dict[tuple[str, str], str]:
    """(letter, script of the word) to its look-alike in that script."""
    out: dict[tuple[str, str], str] = {}

    def put(c: str, s: str, to: str) -> None:
        if out.setdefault((c, s), to) != to:
            raise Conflict(f"{c!r} in {s} maps to {out[c, s]!r} and {to!r}")

    for src, name in ((CYRILLIC, "C"), (GREEK, "G")):
        back: dict[str, str] = {}
        for f, latin in src.items():
            put(f, "L", latin)
            back.setdefault(latin, f)
        for latin, f in back.items():
            put(latin, name, f)
    latin_c, latin_g = {v: k for k, v in reversed(CYRILLIC.items())}, {v: k for k, v in reversed(GREEK.items())}
    for c, latin in GREEK.items():
        if latin in latin_c:
            put(c, "C", latin_c[latin])
    for c, latin in CYRILLIC.items():
        if latin in latin_g:
            put(c, "G", latin_g[latin])
    return out


def script(c: str) -> str:
    """L, C or G for letters of the alphabets with look-alikes, else ''."""
    o = ord(c)
    if o < 0x80:
        return "L" if c.isalpha() else ""
    if 0xC0 <= o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if c.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C" if c.isalpha() else ""
    return ""


def _rtl(c: str) -> bool:
    return unicodedata.bidirectional(c) in ("R", "AL", "AN") if c else False


#: Arabic letters that do not join to the next one.
_RIGHT_JOINING = set("اأإآٱدذرزژوؤڈڑےۀةى")


def _needed(s: str, i: int, mixed: bool) -> bool:
    """Whether the invisible character at ``i`` does something there. ``mixed``: the text has letters that
    run from right to left."""
    c, p, n = s[i], s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""
    if c == "‌" and p and n:
        arabic = 0x600 <= ord(p) < 0x780 and 0x600 <= ord(n) < 0x780
        return (arabic and p not in _RIGHT_JOINING) or unicodedata.combining(p) == 9
    if c == "‍" and p:
        emoji = ord(p) >= 0x2190 and unicodedata.category(p) in ("So", "Sk", "Mn") and n != "" and ord(n) >= 0x2190 and unicodedata.category(n) == "So"
        return emoji or unicodedata.combining(p) == 9 or (0x600 <= ord(p) < 0x780 and not (n and 0x600 <= ord(n) < 0x780) and p not in _RIGHT_JOINING)
    if c in MARKS:
        return _rtl(p) != _rtl(n) and (_rtl(p) or _rtl(n)) and not (p.isalpha() and n.isalpha() and _rtl(p) and _rtl(n))
    if 0xFE00 <= ord(c) <= 0xFE0F:
        return bool(p) and (unicodedata.category(p) in ("So", "Sm", "Po", "Nd") or 0x3400 <= ord(p))
    if 0x202A <= ord(c) <= 0x202E or 0x2066 <= ord(c) <= 0x2069:
        return mixed
    return False


def _word(word: str, text_scripts: set[str]) -> str:
    """A word with letters of foreign alphabets mapped to its own."""
    found = [script(c) for c in word]
    present = {s for s in found if s}
    look = foreign()
    if not present:
        return word
    if len(present) == 1:
        (s,) = present
        if s == "C" and "L" in text_scripts and all((c, "L") in look for c, f in zip(word, found, strict=True) if f):
            return "".join(look.get((c, "L"), c) for c in word)
        return word
    own = {s: sum(1 for c, f in zip(word, found, strict=True) if f == s and not any((c, t) in look for t in present if t != s)) for s in present}
    count = {s: found.count(s) for s in present}
    home = max(present, key=lambda s: (own[s] > 0 and s != "G" or own[s] > 1, own[s], count[s], s == "L"))
    out = []
    for i, c in enumerate(word):
        f = found[i]
        if f and f != home and (c, home) in look:
            if f == "G" and c in SYMBOLS and (i == 0 or i == len(word) - 1 or not (found[i - 1] and found[i + 1])) and not any(x == "G" and word[k] not in SYMBOLS for k, x in enumerate(found)):
                out.append(c)
            else:
                out.append(look[c, home])
        else:
            out.append(c)
    return "".join(out)


class Transducer:
    """The table compiled to a trie over grapheme clusters. A text is read once, from cluster to cluster:
    the longest sequence of clusters that is a key gives its output; a cluster that is none is put
    together from its characters, once for all texts (``closed``). Letters go on to the open word,
    which is given out when it ends."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = mapping
        self.root: dict = {}
        for key, to in mapping.items():
            node = self.root
            for g in _CLUSTER.findall(key):
                node = node.setdefault(g, {})
            node[None] = to
        self.closed: dict[str, str] = {}

    def longest(self, clusters: list[str], i: int) -> tuple[int, str] | None:
        """(clusters read, output) of the longest key that begins at ``i``."""
        node, best, k = self.root, None, i
        while k < len(clusters) and (node := node.get(clusters[k])) is not None:
            k += 1
            if None in node:
                best = k - i, node[None]
        return best

    def close(self, g: str) -> str:
        """A cluster that is no key: its characters mapped one by one and composed again."""
        r = self.closed.get(g)
        if r is None:
            r = "".join([self.mapping.get(c, c) for c in g])
            r = self.mapping.get(r) or (unicodedata.normalize("NFC", r) if len(r) > 1 else r)
            if len(self.closed) < 100_000:
                self.closed[g] = r
        return r

    def run(self, s: str) -> str:
        clusters = _CLUSTER.findall(s)
        scripts_in: set[str] = set()
        mixed = False
        latin = foreign()
        for c in set(s):
            f = script(c)
            if f and not (f == "C" and (c, "L") in latin):
                scripts_in.add(f)
            mixed = mixed or _rtl(c)
        if not INVISIBLE_CHARS.isdisjoint(s):
            at, kept = 0, []
            for g in clusters:
                if len(g) == 1 and g < "\x80" or INVISIBLE_CHARS.isdisjoint(g):
                    kept.append(g)
                else:
                    kept.append("".join(c for k, c in enumerate(g) if c not in INVISIBLE_CHARS or _needed(s, at + k, mixed)))
                at += len(g)
            clusters = kept
        out: list[str] = []
        word: list[str] = []

        def end() -> None:
            w = "".join(word)
            word.clear()
            out.append(w if w.isascii() else _word(w, scripts_in))

        i = 0
        while i < len(clusters):
            g = clusters[i]
            if len(g) == 1 and g < "\x80":
                n, r = 1, g
            else:
                n, r = self.longest(clusters, i) or (1, self.close(g))
            i += n
            for c in r:
                if script(c) or unicodedata.combining(c) or c in INVISIBLE_CHARS:
                    word.append(c)
                else:
                    if word:
                        end()
                    out.append(c)
        if word:
            end()
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(table())


def normalize(s: str | None) -> str | None:
    """The text in its one consistent form. What was taken out may leave marks side by side that compose, so
    a text that is not composed then is composed."""
    if s is None or s.isascii():
        return s
    done = transducer().run(s)
    return done if unicodedata.is_normalized("NFC", done) else unicodedata.normalize("NFC", done)


def normalized(text: Column) -> Column:
    """The consistent form of a text column. Pure ASCII never leaves the JVM."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize)

    beyond = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.when(beyond.isNull(), text).otherwise(run(beyond))


def changed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, normal): the rows whose text is not in its consistent form, each once."""
    rows = df.select(F.col(key), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize)

    return spread(rows).withColumn("normal", run("text")).where("normal <> text").distinct()
