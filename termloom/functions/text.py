"""Text operators as native column expressions: segmenting, tokenizing, normalizing.

Positions are 0-based code points. Nothing here leaves the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The abbreviations that guard a sentence boundary.
ABBREVIATIONS = (
    "dr mr mrs ms prof sr jr st vs etc e.g i.e cf fig figs eq eqs ref refs no nos vol approx dept univ inc ltd co corp al ca "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun"
).split()
# The characters that are tokens of their own.
PUNCTUATION = "~!@#$%^&*()_+-=|\\<>?/,.`';:[]{}\""
#: White space of the Unicode standard in the basic plane, as a character class body.
SPACE = r"\x09-\x0d\x1c-\x20\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_ALL = r"\x85" + SPACE
_PUNCT_CLASS = r"~!@#$%^&*()_+\-=|\\<>?/,.`';:\[\]{}" + '"'
SEPARATOR = _PUNCT_CLASS + SPACE

# A sentence ends at a run of terminators, closing marks and white space; what must follow.
BOUNDARY = rf"([.?!]+)([\"')\]]*)([{SPACE_ALL}]+)"
_ENDS = rf"(?<![.?!])([.?!]++)([\"')\]]*+)([{SPACE_ALL}]++)"  # the same, tried once for a run of marks
OPENING = r"[\"'(\[]*[A-Z0-9]"
# Token classes in the order they are tried.
TOKEN_CLASSES = (
    ("ws", r"^[ \t\n\x0b\f\r]$"),
    ("an", r"^[A-Za-z]+[0-9]+$"),
    ("uc", r"^[A-Z][A-Z0-9]+$"),
    ("lc", r"^[a-z]+$"),
    ("ic", r"^[A-Za-z]+$"),
    ("nu", r"^[0-9]+$"),
    ("gr", r"^[\x{370}-\x{3ff}]+$"),
    ("op", r"^\($"),
    ("cp", r"^\)$"),
    ("ob", r"^\[$"),
    ("cb", r"^\]$"),
    ("cm", r"^,$"),
    ("pd", r"^\.$"),
    ("pn", r"^[()!@#$%^&*+=\-_\[\]{}.,?/']+$"),
)
#: Marks the places where a text is cut. A text that holds the mark itself is cut as if it held
#: ``_STANDIN`` there, another control character, and the pieces are then taken from the text by position.
_CUT, _STANDIN = "\x01", "\x02"
#: Pieces per block of a running sum over an array.
_BLOCK = 64


def _trimmed_span(piece: Column, start: Column) -> Column:
    lead = F.length(piece) - F.length(F.regexp_replace(piece, f"^[{SPACE_ALL}]++", ""))
    return F.struct((start + lead).cast("int").alias("start"), F.regexp_replace(piece, f"^[{SPACE_ALL}]++|(?<![{SPACE_ALL}])[{SPACE_ALL}]++$", "").alias("text"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: what a lambda takes from
    outside would be worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(a: Column) -> Column:
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(a, init, lambda x, n: F.struct((x["at"] + n).alias("at"), F.concat(x["out"], F.array(x["at"])).alias("out")), lambda x: x["out"])


def _starts(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each one.

    An array grows by copying, so a sum is carried over blocks first and within a block next: the work
    stays in proportion to the array up to millions of pieces."""

    def long(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda k: F.slice(a, k * _BLOCK + 1, F.lit(_BLOCK)))
        return _bound(blocks, lambda b: F.flatten(F.zip_with(b, _running(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda y, n: y + n))), lambda x, at: F.transform(_running(x), lambda y: y + at))))

    return _bound(lengths, lambda a: F.when(F.size(a) <= _BLOCK, _running(a)).otherwise(long(a)))


def _spans(pieces: Column) -> Column:
    """array<struct<start,text>>: consecutive pieces with the position each begins at."""
    return _bound(pieces, lambda p: F.zip_with(_starts(F.transform(p, F.length)), p, lambda at, x: F.struct(at.alias("start"), x.alias("text"))))


def _cuttable(text: Column) -> Column:
    """The text without the mark; positions stay."""
    return F.translate(text, _CUT, _STANDIN)


def _stored(spans: Column, text: Column) -> Column:
    """The spans with the text as stored."""
    own = F.transform(spans, lambda p: F.struct(p["start"].alias("start"), F.substring(text, p["start"] + 1, F.length(p["text"])).alias("text")))
    return F.when(text.contains(_CUT), own).otherwise(spans)


def sentences(text: Column) -> Column:
    """array<struct<start,text>>: sentences by terminators, guarded by abbreviations and initials.

    A boundary is a run of terminators, optional closing marks and white space before a capital, a
    digit or an opening mark; one that begins with a full stop is none after an abbreviation or a
    single letter. Sentences are trimmed; empty ones are dropped; null gives null."""
    cut = F.regexp_replace(_cuttable(text), f"{_ENDS}(?={OPENING})", f"$1$2{_CUT}$3{_CUT}")
    words = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guard = rf"(?i)(?<![^{SPACE_ALL}{_CUT}])((?:{words})|\p{{L}})\.([.?!]*)([\"')\]]*){_CUT}([{SPACE_ALL}]+){_CUT}"
    joined = F.regexp_replace(cut, guard, "$1.$2$3$4")
    pieces = _spans(F.split(joined, _CUT))
    trimmed = F.transform(pieces, lambda p: _trimmed_span(p["text"], p["start"]))
    return _stored(F.filter(trimmed, lambda p: F.length(p["text"]) > 0), text)


def _cut_lines(text: Column, pattern: str) -> Column:
    pieces = _spans(F.split(F.regexp_replace(_cuttable(text), f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT))
    return _stored(F.filter(pieces, lambda p, i: i % 2 == 0), text)


def blank_line_blocks(text: Column) -> Column:
    """array<struct<start,text>>: pieces between two or more line breaks; empty pieces are dropped."""
    return F.filter(_cut_lines(text, r"(?>\r\n|\r|\n){2,}"), lambda p: F.length(p["text"]) > 0)


def lines(text: Column) -> Column:
    """array<struct<start,text>>: lines, not trimmed; those of white space only are dropped."""
    return F.filter(_cut_lines(text, r"\r\n|\r|\n"), lambda p: F.length(F.regexp_replace(p["text"], f"[{SPACE_ALL}]+", "")) > 0)


Segmenter = Callable[[Column], Column]
_SEGMENTERS: dict[str, Segmenter] = {}


def register_segmenter(name: str, spans: Callable[[str], list[tuple[int, int]]]) -> None:
    """T4: a sentence detector of one's own, ``text -> [(start, end)]``, under a new name. It runs over
    Arrow batches; spans out of the text's bounds are an error."""
    if name.upper() in ("SENTENCES", "BLANKLINES", "LINES"):
        raise ValueError(f"{name} is built in")

    def cut(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        found = spans(text)
        if any(not 0 <= a <= b <= len(text) for a, b in found):
            raise ValueError(f"a span of {name} lies outside its text")
        return [{"start": a, "text": text[a:b]} for a, b in found]

    def column(text: Column) -> Column:
        @F.pandas_udf("array<struct<start:int,text:string>>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(cut)

        return run(text)

    _SEGMENTERS[name.upper()] = column


def segment(text: Column, method: str = "SENTENCES") -> Column:
    """One of SENTENCES, BLANKLINES, LINES and the registered ones; any other name is refused."""
    known = {"SENTENCES": sentences, "BLANKLINES": blank_line_blocks, "LINES": lines} | _SEGMENTERS
    if method.upper() not in known:
        raise ValueError(f"segmentation method {method!r} is none of {sorted(known)}")
    return known[method.upper()](text)


def token_texts(text: Column) -> Column:
    """array<string>: runs of other characters, and every separator by itself; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"([^{SEPARATOR}]+|[{SEPARATOR}])"), F.lit(1))


def without_blanks(tokens: Column) -> Column:
    """The tokens that are no white space."""
    return F.filter(tokens, lambda w: ~w.rlike(TOKEN_CLASSES[0][1]))


def joined(tokens: Column) -> Column:
    """The text of tokens."""
    return F.array_join(tokens, "")


def token_class(token: Column) -> Column:
    c = F.when(token.rlike(TOKEN_CLASSES[0][1]), TOKEN_CLASSES[0][0])
    for name, pattern in TOKEN_CLASSES[1:]:
        c = c.when(token.rlike(pattern), name)
    return c.otherwise("unknown")


def explode_tokens(df: DataFrame, text: str, keys: list[str], start: str | None = None) -> DataFrame:
    """(keys, tok, tok_start, token): the tokens of a text by position, as rows.

    The position is found without a window: the array carries its running length."""
    pairs = _spans(token_texts(F.col(text)))
    at = F.col(start) if start else F.lit(0)
    return df.select(*keys, at.alias("_at"), F.posexplode(pairs).alias("tok", "_t")).select(*keys, "tok", (F.col("_at") + F.col("_t.start")).cast("int").alias("tok_start"), F.col("_t.text").alias("token"))


def index_key(text: Column) -> Column:
    return F.lower(text)


def greek_names() -> dict[str, str]:
    """Greek letters and the names they are expanded to, made from their Unicode names: the plain
    letters by the bare name, capital letters with an initial capital, all others by the full name."""
    out = {}
    for o in range(0x370, 0x400):
        c = chr(o)
        name = unicodedata.name(c, "")
        parts = name.split()
        if not name:
            continue
        if len(parts) == 4 and parts[:3] == ["GREEK", "SMALL", "LETTER"]:
            out[c] = parts[3].lower()
        elif len(parts) == 4 and parts[:3] == ["GREEK", "CAPITAL", "LETTER"]:
            out[c] = parts[3].capitalize()
        elif parts == ["GREEK", "SMALL", "LETTER", "FINAL", "SIGMA"]:
            out[c] = "sigma"
        else:
            out[c] = name
    return {k: ("lambda" if v == "lamda" else "Lambda" if v == "Lamda" else v) for k, v in out.items()}


def greek_to_ascii(text: Column) -> Column:
    """Greek letters expanded to their names. The map is only consulted for texts that have any."""
    table = F.create_map(*[F.lit(x) for kv in greek_names().items() for x in kv])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(text.rlike(r"[\x{370}-\x{3ff}]"), spelled).otherwise(text)


def remove_possessives(token: Column) -> Column:
    """A trailing 's after a letter or digit goes; else a trailing ' after an s."""
    return F.when(token.endswith("'s"), F.regexp_replace(token, r"(?<=[\p{L}\p{N}])'s$", "")).otherwise(F.regexp_replace(token, r"(?<=s)'$", ""))


def normalize(text: Column) -> Column:
    """Greek letters spelled out, one leading tag taken off or else blanks collapsed, lower case,
    possessives taken off every word."""
    spelled = greek_to_ascii(text)
    tag = r"^\[(?:X|V|D|M|EDTA|SO|Q)\]"
    plain = F.when(spelled.rlike(tag), F.regexp_replace(spelled, tag, "")).otherwise(F.regexp_replace(F.regexp_replace(spelled, " +", " "), "^ | $", ""))
    words = F.filter(F.split(F.lower(plain), r"[ \t\n\r\f$|~]+"), lambda w: w != "")
    full = F.array_join(F.transform(words, remove_possessives), " ")
    # most texts have nothing to change but their case
    plainly = ~text.rlike(r"[\x{370}-\x{3ff}\[$|~\t\n\r\f']|  |^ | $")
    return F.when(plainly, F.lower(text)).otherwise(full)


@lru_cache(maxsize=1)
def _greek() -> dict[int, str]:
    return {ord(k): v for k, v in greek_names().items()}


_TAG = re.compile(r"\[(?:X|V|D|M|EDTA|SO|Q)\]")
_MORE = re.compile("[\u0370-\u03ff\\[$|~\t\n\r\f']|  |^ | $")
_WORDS = re.compile(r"[ \t\n\r\f$|~]+")


def _unpossessed(w: str) -> str:
    if w.endswith("'s"):
        return w[:-2] if w[-3:-2].isalnum() else w
    return w[:-1] if w.endswith("s'") else w


def keys_of(text: str) -> list[str]:
    """``lookup_keys`` of one text, for Arrow functions."""
    low = text.lower()
    if not _MORE.search(text):
        return [low]
    spelled = text.translate(_greek())
    tag = _TAG.match(spelled)
    plain = spelled[tag.end() :] if tag else re.sub(" +", " ", spelled)
    normal = " ".join(_unpossessed(w) for w in _WORDS.split(plain.lower()) if w)
    return [low] if normal == low else [low, normal]


def lookup_keys(text: Column) -> Column:
    """The keys a text is looked up by: its lower case, and its normal form if that differs."""
    return F.array_distinct(F.array(F.lower(text), normalize(text)))


def number_format(value: Column) -> Column:
    """Grouped, at most two decimals, without trailing zeros."""
    return F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")


def split_trimmed(text: Column, pattern: str) -> Column:
    """Fields of a line with empty ones at the end dropped."""
    fields = F.split(text, pattern)
    kept = F.aggregate(F.transform(fields, lambda f, i: F.when(f != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.slice(fields, 1, F.greatest(kept, F.lit(0))))


def trim_controls(text: Column) -> Column:
    """Characters up to the blank taken off both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def read_lines(text: Column) -> Column:
    """Lines ended by LF, CRLF or CR; a final terminator starts no line."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|\r|\n)$", ""), r"\r\n|\r|\n")


def doc_hash(text: Column) -> Column:
    """The 31-polynomial hash of a string, 32 bits unsigned, over its UTF-16 units."""

    def step(h: Column, c: Column) -> Column:
        o = F.when(c == "", 0).otherwise(F.ascii(c)).cast("bigint")
        two = (h * 31 + F.shiftright(o - 0x10000, 10) + 0xD800) * 31 + (o - 0x10000) % 1024 + 0xDC00
        return F.when(o > 0xFFFF, two).otherwise(h * 31 + o).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), step)


def hash_bucket(h: Column, size: Column) -> Column:
    """The place of a hash in a table that doubles from 16 whenever it is filled beyond 3/4."""
    steps = F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(12.0))))
    cap = F.pow(F.lit(2.0), steps + 4).cast("bigint")
    spread = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return spread.bitwiseAND(cap - 1)


def hash_ordered(items: Column) -> Column:
    """The distinct strings of an array in the order of a hash table they were put into one by one."""
    one = F.array_distinct(items)
    n = F.size(one).cast("bigint")
    keyed = F.transform(one, lambda x, i: F.struct(hash_bucket(doc_hash(x), n).alias("b"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])
