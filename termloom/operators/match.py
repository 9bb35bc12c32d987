"""Matching spans of text to the dictionary.

Canonical row: a mention, one span with one concept. Spans are made inside each sentence row by one
Arrow function, which also asks a Bloom filter of the dictionary's keys, so that spans no dictionary
entry can have never become rows; what is left meets the dictionary in an equi-join, and one exchange
by passage serves every later stage (first key, scope, subsumption).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from termloom.functions import text as T
from termloom.operators import tagging
from termloom.session import partitions_of, size_of, spread

#: Tokens in a span at most.
LONGEST = 15
# Part-of-speech tags a span may begin with; '' is not tagged.
START_TAGS = ("ADJ", "CD", "FW", "RB", "IN", "NN", "NNS", "NNP", "NNPS", "NOUN", "JJ", "JJR", "JJS", "LS", "PROPN", "")
#: Letters and digits a span may begin and end with: ASCII and the Greek block without its gaps.
EDGE = r"[0-9A-Za-z\x{370}-\x{377}\x{37a}-\x{37e}\x{384}-\x{38a}\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{3ff}]"


def sentence_rows(passages: DataFrame, method: str = "SENTENCES") -> DataFrame:
    """(passage_id, docid, fieldid, sent_idx, sent_start, sent): the sentences of passages, positions
    counted from the document's start."""
    p = spread(passages).select("passage_id", "docid", "fieldid", F.coalesce("base_offset", F.lit(0)).alias("base_offset"), F.posexplode(T.segment(F.col("text"), method)).alias("sent_idx", "s"))
    return p.select("passage_id", "docid", "fieldid", "sent_idx", (F.col("base_offset") + F.col("s.start")).cast("int").alias("sent_start"), F.col("s.text").alias("sent"))


# --- spans of a sentence, in Python -----------------------------------------------------------------


def _in_python(char_class: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", char_class)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern[str], frozenset[str], re.Pattern[str]]:
    """Tokens; the characters a span may begin and end with; white space tokens."""
    edge = re.compile(_in_python(EDGE))
    sep = _in_python(T.SEPARATOR)
    return re.compile(f"[^{sep}]+|[{sep}]"), frozenset(chr(o) for o in range(0x400) if edge.match(chr(o))), re.compile(r"[ \t\n\x0b\f\r]\Z")


def token_spans(sentence: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a sentence."""
    return [m.span() for m in _patterns()[0].finditer(sentence)]


class KeyFilter:
    """A Bloom filter of dictionary keys: bits by the same 64-bit hash on both sides. Its size is a power
    of two between ``LEAST`` and ``MOST`` bits, so what is sent to the workers is 16 MB at most; a
    dictionary too large for it only lets more spans through to the join."""

    LEAST, MOST, HASHES, SEED = 1 << 16, 1 << 27, 4, 42

    def __init__(self, bits: bytes) -> None:
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __contains__(self, key: str) -> bool:
        import xxhash

        h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), self.SEED)
        at, step, bits, mask = h & 0xFFFFFFFF, (h >> 32) | 1, self.bits, self.mask
        for _ in range(self.HASHES):
            p = at & mask
            if not bits[p >> 3] >> (p & 7) & 1:
                return False
            at += step
        return True


def key_filter(keys: DataFrame, key: str = "norm") -> KeyFilter:
    """The filter of a column of keys. The words of its bit map are made by the workers; only they come
    to the driver, a bounded number."""
    import numpy as np

    size = size_of(keys)
    rows = keys.count() if size is None else max(1, size // 8)
    m = KeyFilter.LEAST
    while m < min(16 * rows, KeyFilter.MOST):
        m *= 2
    h = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    at = [f"(h & 4294967295L) + {k}L * ((shiftrightunsigned(h, 32)) | 1L)" for k in range(KeyFilter.HASHES)]
    p = h.select(F.explode(F.array(*[F.expr(f"({a}) & {m - 1}L") for a in at])).alias("p"))
    words = p.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63L as int)))").alias("b")).toPandas()
    out = np.zeros(m // 64, dtype="<i8")
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return KeyFilter(out.tobytes())


#: A judge of the spans of one sentence: given the sentence and its tokens, None if it says nothing of any
#: span, or a function from (start, end) to a truth value.
SpanFlag = Callable[[str, list[tuple[int, int]]], Callable[[int, int], bool] | None]


def spans_of(sent: str, tokens: list[tuple[int, int]], tags: list[str] | None, allowed: frozenset[str], longest: int, known: KeyFilter | None) -> Iterator[tuple[int, int, int, int, str, list[str]]]:
    """E1 for one sentence: (first token, token after the last, start, end, text, keys); the keys only
    where ``known`` was asked."""
    edge = _patterns()[1]
    ends = [j for j, (_, y) in enumerate(tokens) if sent[y - 1] in edge]
    lo, have = 0, []
    for i, (x, y) in enumerate(tokens):
        while lo < len(ends) and ends[lo] < i:
            lo += 1
        if sent[x] not in edge or sent[x:y].lower() == "other" or (tags and tags[i] not in allowed):
            continue
        for j in ends[lo : lo + longest]:
            if j >= i + longest:
                break
            z = tokens[j][1]
            if z - x <= 2:
                continue
            term = sent[x:z]
            if known is not None:
                have = T.keys_of(term)
                if not any(k in known for k in have):
                    continue
            yield i, j + 1, x, z, term, have


def tags_of(sents: list[str], tokens: list[list[tuple[int, int]]], tagger: tagging.Tagger | None) -> list[list[str]] | None:
    blank = _patterns()[2]
    return tagging.tags_of([[s[x:y] for x, y in t] for s, t in zip(sents, tokens)], tagger, lambda w: bool(blank.match(w))) if tagger else None


def _made(batches: Iterator[pa.RecordBatch], keep: list[str], longest: int, tags: frozenset[str], tagger: tagging.Tagger | None, known: object, flag: SpanFlag | None) -> Iterator[pa.RecordBatch]:
    known = known.value if known is not None else None
    for b in batches:
        sents = b.column("sent").to_pylist()
        begins = b.column("sent_start").to_pylist()
        tokens = [token_spans(s) for s in sents]
        tagged_ = tags_of(sents, tokens, tagger)
        row, first, last, start, length, terms, keys, flags = [], [], [], [], [], [], [], []
        for r, (s, t) in enumerate(zip(sents, tokens)):
            says, asked = None, False
            for i, j, x, z, term, have in spans_of(s, t, tagged_ and tagged_[r], tags, longest, known):
                if flag and not asked:
                    says, asked = flag(s, t), True
                row.append(r)
                first.append(i)
                last.append(j)
                start.append(begins[r] + x)
                length.append(z - x)
                terms.append(term)
                keys.append(have)
                flags.append(says is not None and says(x, z))
        at = pa.array(row, pa.int32())
        ints = [pa.array(v, pa.int32()) for v in (first, last, start, length)]
        more = [("keys", pa.array(keys, pa.list_(pa.string())))] if known is not None else []
        more += [("flag", pa.array(flags, pa.bool_()))] if flag else []
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in keep] + ints + [pa.array(terms, pa.string())] + [a for _, a in more], [*keep, "i", "j", "start", "length", "term", *(n for n, _ in more)])


def candidates(sentences: DataFrame, longest: int = LONGEST, start_tags: tuple[str, ...] = START_TAGS, tagger: tagging.Tagger | None = None, known: KeyFilter | None = None, flag: SpanFlag | None = None) -> DataFrame:
    """Every span of up to ``longest`` tokens with an allowed first tag and letters or digits at
    both ends; spans of up to two characters and those beginning with 'other' are left out.

    ``known``: only spans that may be keys of a dictionary (a few that are none get through), with ``keys``.
    ``flag``: a truth value of every span, as column ``flag``."""
    keep = [c for c in sentences.columns if c != "sent"]
    fields = [sentences.schema[c] for c in keep] + [StructField(c, IntegerType()) for c in ("i", "j", "start", "length")] + [StructField("term", StringType())] + ([StructField("keys", ArrayType(StringType()))] if known is not None else []) + ([StructField("flag", BooleanType())] if flag else [])
    sent = sentences.sparkSession.sparkContext.broadcast(known) if known is not None else None
    run = partial(_made, keep=keep, longest=longest, tags=frozenset(start_tags) | {""}, tagger=tagger, known=sent, flag=flag)
    return sentences.mapInArrow(run, StructType(fields))


def custom_dictionary(custom: DataFrame) -> DataFrame:
    """E5: (norm, cui, concept_string, is_custom) of user concepts (cui, term)."""
    return custom.select(F.lower("term").alias("norm"), "cui", F.lower("term").alias("concept_string"), F.lit(1).alias("is_custom"))


def dictionary(names: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(norm, cui, concept_string, is_custom): the first string of each key and concept."""
    d = names.where("norm is not null and cui is not null").groupBy("norm", "cui").agg(F.min_by("str", "ord").alias("concept_string")).withColumn("is_custom", F.lit(0))
    return d.unionByName(custom_dictionary(custom)) if custom is not None else d


def dictionary_keys(names: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(norm): the keys of ``dictionary``, as often as they stand in the tables."""
    k = names.select("norm")
    return k.unionByName(custom_dictionary(custom).select("norm")) if custom is not None else k


def matches(spans: DataFrame, dict_: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Mentions: for every span and concept the first key that gives it; the dictionary's
    entry before a user's. ``excluded``: (cui, norm), cui '*' for all. Passages delivered twice count once.

    Spans should come from ``candidates`` with the dictionary's ``key_filter``: the join then moves
    little more than the mentions themselves. The one exchange by passage is shared by what follows."""
    keyed = spans if "keys" in spans.columns else spans.withColumn("keys", T.lookup_keys(F.col("term")))
    keyed = keyed.select("*", F.posexplode("keys").alias("key_rank", "norm")).drop("keys")
    hit = keyed.join(dict_, "norm")
    if excluded is not None:
        one = excluded.select(F.col("cui").alias("xc"), F.col("norm").alias("xn"))
        hit = hit.join(one, (F.col("xn") == F.col("norm")) & ((F.col("xc") == F.col("cui")) | (F.col("xc") == "*")), "left_anti")
    best = Window.partitionBy("passage_id", "start", "length", "cui").orderBy("key_rank", "is_custom", "sent_idx")
    return hit.repartition("passage_id").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").withColumn("window_no", F.greatest(F.lit(0), F.col("j") - LONGEST))


def first_keys(hit: DataFrame) -> DataFrame:
    """Of the rows of a span and concept the one of the first key; the dictionary before a user's."""
    best = Window.partitionBy("passage_id", "start", "length", "cui").orderBy("origin_rank", "key_rank", "is_custom", "sent_idx")
    return hit.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def found(sentences: DataFrame, dict_: DataFrame, excluded: DataFrame | None = None, flag: SpanFlag | None = None, keys: DataFrame | None = None, **how: object) -> DataFrame:
    """The mentions of sentences: ``candidates`` that pass the filter of the dictionary's keys (column norm
    of ``keys`` where a table plainer than the dictionary holds them all), and ``matches``."""
    return matches(candidates(sentences, known=key_filter((dict_ if keys is None else keys).select("norm")), flag=flag, **how), dict_, excluded)


def looked_up(terms: DataFrame, term: str, dict_: DataFrame) -> DataFrame:
    """(term, start, length, text, cui, concept_string): the mentions of a bare term, neither
    segmented nor tagged nor filtered, by start and longest first."""
    rows = terms.select(F.col(term).alias("_term")).where("_term is not null").distinct()
    s = rows.select(F.xxhash64("_term").alias("passage_id"), F.col("_term").alias("docid"), F.lit(0).alias("sent_idx"), F.lit(0).alias("sent_start"), F.col("_term").alias("sent"))
    m = found(s, dict_)
    return m.select(F.col("docid").alias(term), "start", "length", F.col("term").alias("text"), "cui", "concept_string").orderBy(term, "start", F.col("length").desc(), "cui")


def in_order(mentions: DataFrame) -> DataFrame:
    """Mentions in their final order, by start and longest first within each passage. A sort for a
    sink: no later operator needs it."""
    return mentions.orderBy("passage_id", "start", F.col("length").desc(), "cui")


def restrict(mentions: DataFrame, concept_types: DataFrame | None, concept_sources: DataFrame | None, want_types: tuple[str, ...] = (), want_sources: tuple[str, ...] = ()) -> DataFrame:
    """Mentions whose concept has a wanted type and stands in a wanted source (of all its
    sources, whichever row matched). Spans without mention left vanish."""
    out = mentions
    if want_types:
        ok = concept_types.where(F.col("abbrev").isin(*want_types)).select("cui").distinct()
        out = out.join(ok, "cui", "left_semi")
    if want_sources:
        ok = concept_sources.where(F.col("sab").isin(*want_sources)).select("cui").distinct()
        out = out.join(ok, "cui", "left_semi")
    return out


def drop_subsumed(mentions: DataFrame) -> DataFrame:
    """Mentions whose span lies in no other span of the passage. Spans of one place stay.

    One window and no join: among the spans that begin before or with it, a span that lies in none
    has the greatest end, and of those with that end the first start."""
    end = F.col("start") + F.col("length")
    upto = Window.partitionBy("passage_id").orderBy(F.struct("start", -F.col("length"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct(end.alias("e"), (-F.col("start")).alias("s"))
    return mentions.withColumn("_m", F.max(own).over(upto)).where((F.col("_m.e") == end) & (F.col("_m.s") == -F.col("start"))).drop("_m")


# Words that are no mention by themselves, unless in capitals.
FUNCTION_WORDS = """
a about above across after against along among an and any are as at be been before being below beneath beside between
beyond both but by can could did do does down during each either for from had has have he her hers him his how i if in
into is it its may me might must my neither nor not of off on onto or our out over per shall she should since so some
than that the their them then there these they this those though through throughout to toward towards under unless
until up upon us via was we were what when where whether which while who whom whose why will with within without would
yet you your
""".split()


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_acronym(c: Column) -> Column:
    return is_upper(c) & ~c.contains(" ") & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 2)


def precise(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Without concepts all whose strings under the matched keys are acronyms, unless the text is
    in capitals, and without one-word function words."""
    only = names.groupBy("norm", "cui").agg(F.bool_and(is_acronym(F.col("str"))).alias("_a")).where("_a")
    word = F.col("term").rlike(r"^[\p{L}\p{N}]+$") & ~is_upper(F.col("term")) & F.lower("term").isin(*FUNCTION_WORDS)
    return mentions.where(~word).join(only, ["norm", "cui"], "left").where(F.col("_a").isNull() | is_upper(F.col("term"))).drop("_a")


def first_per_span(mentions: DataFrame) -> DataFrame:
    """Of mentions of several origins at one span those of the first: dictionary, then user
    acronyms, then abbreviation copies."""
    w = Window.partitionBy("passage_id", "start", "length").orderBy("origin_rank", "sent_idx")
    m = mentions.withColumn("_r", F.dense_rank().over(w))
    return m.where("_r = 1").drop("_r")


def entities(mentions: DataFrame) -> DataFrame:
    """One row per span with its concepts."""
    return mentions.groupBy("docid", "passage_id", "start", "length", "term").agg(F.array_sort(F.collect_set(F.struct("cui", "concept_string"))).alias("evs"))


def distinct_passages(passages: DataFrame) -> DataFrame:
    """Passages delivered again count once. The one exchange also spreads the rows over the cores."""
    return passages.repartition(partitions_of(passages), "passage_id").dropDuplicates(["passage_id"])
