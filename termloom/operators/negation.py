"""Negation by trigger phrases within a window of tokens.

A lexicon is a table (phrase array<string>, kind, lex_ord); kinds are nega (before), negb (after),
pnega and pnegb (look like triggers but are none) and conj (ends a scope). ``LEXICON`` is the usual
English one; any other is a parameter.

Whether a span is negated depends on its sentence alone, so the scan is one pass over the sentence's
tokens in Python, started only for sentences that have a span at all: ``flag`` gives it to
``match.candidates``, which marks every span as it is made, and no later stage has to meet the
sentence again. ``negated`` marks mentions made elsewhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators import match

#: Tokens between trigger and entity at most.
REACH = 6
#: A lexicon is a table of settings and goes to every task; a larger one is refused.
MOST_PHRASES = 20_000
# Semantic types whose concepts can be negated.
NEGATABLE = "acab anab biof cgab comd dsyn emod fndg inpo lbtr menp mobd neop patf phsf sosy".split()
# The trigger phrases with their kinds, one a line; of phrases of one length at one place
# the first holds.
LEXICON = """
rules out nega
rules him out for nega
can rule her out against nega
did rule her out nega
sufficient to rule out against nega
adequate to rule the patient out against nega
never developed nega
denied nega
no signs of nega
no sign of nega
sufficient to rule the patient out for nega
not had nega
not to be nega
can rule out for nega
no findings to indicate nega
can rule out against nega
checked for nega
not nega
sufficient to rule out nega
no evidence nega
did rule him out against nega
sufficient to rule him out against nega
no cause of nega
not appear nega
did rule him out nega
no other evidence nega
did rule her out for nega
sufficient to rule her out nega
sufficient to rule the patient out against nega
adequate to rule her out for nega
unremarkable for nega
no new nega
absence of nega
adequate to rule the patient out nega
no new evidence nega
to exclude nega
sufficient to rule her out for nega
not known to have nega
no findings of nega
not feel nega
can rule him out against nega
sufficient to rule out for nega
adequate to rule out for nega
cannot nega
denying nega
not exhibit nega
rules out for nega
with no nega
ruled out against nega
without any evidence of nega
no radiographic evidence of nega
rules him out nega
ruled the patient out nega
rules the patient out nega
can rule her out nega
no nega
no mammographic evidence of nega
denies nega
rules the patient out for nega
did rule the patient out nega
did rule out against nega
no suggestion of nega
patient was not nega
adequate to rule the patient out for nega
no abnormal nega
negative for nega
ruled him out for nega
did rule out nega
evaluate for nega
fails to reveal nega
ruled her out nega
cannot see nega
did rule her out against nega
not demonstrate nega
sufficient to rule him out nega
ruled him out nega
can rule the patient out against nega
no suspicious nega
can rule him out nega
can rule her out for nega
rules her out nega
declined nega
ruled out for nega
can rule the patient out nega
not associated with nega
resolved nega
adequate to rule out nega
not complain of nega
without indication of nega
without nega
not reveal nega
without evidence nega
ruled the patient out for nega
sufficient to rule her out against nega
no evidence to suggest nega
test for nega
declines nega
sufficient to rule the patient out nega
ruled out nega
did rule him out for nega
can rule the patient out for nega
rules her out for nega
never had nega
not have nega
did rule the patient out against nega
not know of nega
without sign of nega
adequate to rule her out nega
no significant nega
can rule him out for nega
deny nega
not appreciate nega
ruled her out for nega
ruled the patient out against nega
rather than nega
did rule the patient out for nega
no complaints of nega
adequate to rule him out nega
free of nega
can rule out nega
ruled him out against nega
ruled her out against nega
did rule out for nega
adequate to rule him out for nega
not see nega
sufficient to rule him out for nega
unlikely negb
has been ruled out negb
free negb
was ruled out negb
have been ruled out negb
are ruled out negb
is ruled out negb
ought to be ruled out for pnega
rule the patient out pnega
rule her out pnega
might be ruled out for pnega
could be ruled out for pnega
rule the patient out for pnega
will be ruled out for pnega
rule him out for pnega
what must be ruled out is pnega
may be ruled out for pnega
r/o pnega
ro pnega
can be ruled out for pnega
should be ruled out for pnega
rule him out pnega
rule out pnega
rule her out for pnega
rule out for pnega
be ruled out for pnega
must be ruled out for pnega
is to be ruled out for pnega
be ruled out pnegb
not ruled out pnegb
being ruled out pnegb
will be ruled out pnegb
did not rule out pnegb
might be ruled out pnegb
ought to be ruled out pnegb
may be ruled out pnegb
not been ruled out pnegb
should be ruled out pnegb
can be ruled out pnegb
could be ruled out pnegb
must be ruled out pnegb
is to be ruled out pnegb
although conj
apart from conj
as a cause for conj
as a cause of conj
as a etiology for conj
as a etiology of conj
as a reason for conj
as a reason of conj
as a secondary cause for conj
as a secondary cause of conj
as a secondary etiology for conj
as a secondary etiology of conj
as a secondary origin for conj
as a secondary origin of conj
as a secondary reason for conj
as a secondary reason of conj
as a secondary source for conj
as a secondary source of conj
as a source for conj
as a source of conj
as an cause for conj
as an cause of conj
as an etiology for conj
as an etiology of conj
as an origin for conj
as an origin of conj
as an reason for conj
as an reason of conj
as an secondary cause for conj
as an secondary cause of conj
as an secondary etiology for conj
as an secondary etiology of conj
as an secondary origin for conj
as an secondary origin of conj
as an secondary reason for conj
as an secondary reason of conj
as an secondary source for conj
as an secondary source of conj
as an source for conj
as an source of conj
as the cause for conj
as the cause of conj
as the etiology for conj
as the etiology of conj
as the origin for conj
as the origin of conj
as the reason for conj
as the reason of conj
as the secondary cause for conj
as the secondary cause of conj
as the secondary etiology for conj
as the secondary etiology of conj
as the secondary origin for conj
as the secondary origin of conj
as the secondary reason for conj
as the secondary reason of conj
as the secondary source for conj
as the secondary source of conj
as the source for conj
as the source of conj
aside from conj
but conj
cause for conj
cause of conj
causes for conj
causes of conj
etiology for conj
etiology of conj
except conj
however conj
nevertheless conj
origin for conj
origin of conj
origins for conj
origins of conj
other possibilities of conj
reason for conj
reason of conj
reasons for conj
reasons of conj
secondary to conj
source for conj
source of conj
sources for conj
sources of conj
still conj
though conj
trigger event for conj
yet conj
other than conj
otherwise conj
then conj
to account for conj
to explain conj
"""


def default_lexicon() -> list[tuple[list[str], str]]:
    """The phrases of ``LEXICON`` with their kinds."""
    rows = [line.rpartition(" ") for line in LEXICON.strip().splitlines()]
    return [(p.split(), k) for p, _, k in rows]


def lexicon(spark: SparkSession, rows: list[tuple[list[str], str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(rows or default_lexicon())], "phrase array<string>, kind string, lex_ord int")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file of lines ``phrase<TAB>kind``."""
    raw = spark.read.text(path).where("value like '%\t%'").select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("lex_ord"))
    return raw.select(F.split(F.trim(F.lower(F.col("f")[0])), " +").alias("phrase"), F.trim(F.col("f")[1]).alias("kind"), "lex_ord")


def negatable(types: DataFrame) -> DataFrame:
    """(cui) of concepts that can be negated, of a type table (cui, abbrev)."""
    return types.where(F.col("abbrev").isin(*NEGATABLE)).select("cui").distinct()


class Scanner:
    """Finds triggers in a sentence and tells which spans they negate."""

    def __init__(self, phrases: list[tuple[list[str], str]], reach: int = REACH) -> None:
        self.reach = reach
        self.single = {p[0] for p, _ in phrases if len(p) == 1}
        self.by_first: dict[str, list[tuple[tuple[str, ...], str, int]]] = {}
        for order, (p, kind) in enumerate(phrases):
            self.by_first.setdefault(p[0], []).append((tuple(p), kind, order))

    def words(self, sent: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """(start, end, lower case) of the tokens that are counted. Marks glued to a word and to
        each other make one token with it (from a token on whose next two are no white space and the
        second neither a full stop nor a one-word trigger, all up to white space or a full stop);
        white space and full stops are left out unless they are triggers."""
        text = [sent[a:b] for a, b in spans]
        n = len(text)
        blank = [t in " \t\n\x0b\f\r" for t in text]
        halt = [x or t == "." for x, t in zip(blank, text)]
        until = [n] * (n + 1)  # the first halt from each token on
        for k in range(n - 1, -1, -1):
            until[k] = k if halt[k] else until[k + 1]
        out: list[tuple[int, int, str]] = []
        k = 0
        while k < n:
            end = k + 1
            if k + 3 < n and not (blank[k] or blank[k + 1] or halt[k + 2]) and text[k + 2] not in self.single:
                end = until[k + 3]
            whole = sent[spans[k][0] : spans[end - 1][1]]
            if not halt[k] or whole in self.single:
                out.append((spans[k][0], spans[end - 1][1], whole.lower()))
            k = end
        return out

    def phrases(self, words: list[str]) -> list[tuple[int, int, str, int]]:
        """(pos, size, kind, order) of every phrase found."""
        out = []
        for pos, w in enumerate(words):
            for phrase, kind, order in self.by_first.get(w, ()):
                if len(phrase) == 1 or tuple(words[pos : pos + len(phrase)]) == phrase:
                    out.append((pos, len(phrase), kind, order))
        return out

    @staticmethod
    def standing(found: list[tuple[int, int, str, int]]) -> set[int]:
        """The phrases that are the longest at some position, so a pseudo-trigger hides the true one in
        it. A phrase that stands somewhere counts at all its positions."""
        best: dict[int, tuple[int, int]] = {}
        for pos, size, _, order in found:
            best[pos] = max(best.get(pos, (0, 0)), (size, -order))
        return {-o for _, o in best.values()}

    @staticmethod
    def position(starts: list[int], ends: list[int], start: int, end: int) -> int | None:
        """The last token that begins where the span does or holds it."""
        k = bisect_right(starts, start) - 1
        return k if k >= 0 and (starts[k] == start or end <= ends[k]) else None

    def flag(self, sent: str, spans: list[tuple[int, int]]) -> Callable[[int, int], bool] | None:
        """Tells of a span of this sentence whether it is negated; None if nothing here negates."""
        words = self.words(sent, spans)
        found = self.phrases([w for _, _, w in words])
        if not any(kind in ("nega", "negb") for _, _, kind, _ in found):
            return None
        standing = self.standing(found)
        triggers = [(pos, kind == "nega") for pos, _, kind, order in found if kind in ("nega", "negb") and order in standing]
        ends_scope = sorted({pos for pos, _, kind, _ in found if kind == "conj"})
        starts, ends = [a for a, _, _ in words], [b for _, b, _ in words]

        def negates(start: int, end: int) -> bool:
            at = self.position(starts, ends, start, end)
            if at is None:
                return False
            for pos, before in triggers:
                if abs(at - pos) <= self.reach and (starts[pos] <= start) == before:
                    lo, hi = min(at, pos), max(at, pos)
                    if bisect_right(ends_scope, hi - 1) == bisect_right(ends_scope, lo):
                        return True
            return False

        return negates


def scanner(lex: DataFrame | None = None, reach: int = REACH) -> Scanner:
    """The scanner of a lexicon table."""
    if lex is None:
        return Scanner(default_lexicon(), reach)
    rows = lex.select("phrase", "kind", "lex_ord").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} trigger phrases")
    return Scanner([(r["phrase"], r["kind"]) for r in sorted(rows, key=lambda r: r["lex_ord"]) if r["phrase"]], reach)


def _rows(batches: Iterator[pa.RecordBatch], scan: Scanner, what: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, cols = [], ([], [], [], [])
        for r, (s, base) in enumerate(zip(b.column("sent").to_pylist(), b.column("sent_start").to_pylist())):
            words = scan.words(s, match.token_spans(s))
            if what == "words":
                made = [(p, base + a, base + z, w) for p, (a, z, w) in enumerate(words)]
            else:
                made = scan.phrases([w for _, _, w in words])
            row += [r] * len(made)
            for c, v in zip(cols, zip(*made)):
                c.extend(v)
        at = pa.array(row, pa.int32())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string()) if what == "words" else (pa.int32(), pa.int32(), pa.string(), pa.int32())
        names = ["pos", "start", "end", "w"] if what == "words" else ["pos", "size", "kind", "lex_ord"]
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("passage_id", "sent_idx")] + [pa.array(c, k) for c, k in zip(cols, kinds)], ["passage_id", "sent_idx", *names])


def _scanned(sentences: DataFrame, scan: Scanner, what: str, columns: str) -> DataFrame:
    s = sentences.select("passage_id", "sent_idx", "sent_start", "sent")
    key = s.schema["passage_id"].dataType.simpleString()
    return s.mapInArrow(partial(_rows, scan=scan, what=what), f"passage_id {key}, sent_idx int, {columns}")


def words(sentences: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """(passage_id, sent_idx, pos, start, end, w): the tokens that are counted."""
    return _scanned(sentences, scanner(lex), "words", "pos int, start int, end int, w string")


def triggers(sentences: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """(passage_id, sent_idx, pos, size, kind, lex_ord): phrases found token by token."""
    return _scanned(sentences, scanner(lex), "phrases", "pos int, size int, kind string, lex_ord int")


def longest(found: DataFrame) -> DataFrame:
    """The phrases found that are the longest at some position of their sentence, at all their
    positions."""
    at = Window.partitionBy("passage_id", "sent_idx", "pos").orderBy(F.col("size").desc(), "lex_ord")
    of = Window.partitionBy("passage_id", "sent_idx", "lex_ord")
    return found.withColumn("_r", F.row_number().over(at)).withColumn("_b", F.min("_r").over(of)).where("_b = 1").drop("_r", "_b")


def _marked(batches: Iterator[pa.RecordBatch], scan: Scanner, keep: list[str], positions: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, starts, lengths, says = [], [], [], []
        for r, (s, base, spans) in enumerate(zip(b.column("sent").to_pylist(), b.column("sent_start").to_pylist(), b.column("spans").to_pylist())):
            tokens = match.token_spans(s)
            if positions:
                w = scan.words(s, tokens)
                a, z = [x for x, _, _ in w], [y for _, y, _ in w]
                tell = lambda x, y, a=a, z=z: scan.position(a, z, x, y)
            else:
                tell = scan.flag(s, tokens)
            for x in spans if tell else ():
                got = tell(x["start"] - base, x["start"] - base + x["length"])
                if got is not None and got is not False:
                    row.append(r)
                    starts.append(x["start"])
                    lengths.append(x["length"])
                    says.append(got)
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in keep] + [pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(says, pa.int32() if positions else pa.bool_())], [*keep, "start", "length", "says"])


def _of_spans(mentions: DataFrame, sentences: DataFrame, scan: Scanner, positions: bool) -> DataFrame:
    keys = ["passage_id", "sent_idx"]
    spans = mentions.groupBy(*keys).agg(F.collect_set(F.struct("start", "length")).alias("spans"))  # those of a sentence
    rows = spans.join(sentences.select(*keys, "sent_start", "sent").dropDuplicates(keys), keys)
    key = mentions.schema["passage_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_marked, scan=scan, keep=keys, positions=positions), f"passage_id {key}, sent_idx int, start int, length int, says {'int' if positions else 'boolean'}")


def positions(mentions: DataFrame, sentences: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """(passage_id, sent_idx, start, length, epos): the last token that begins where the span does
    or holds it."""
    return _of_spans(mentions, sentences, scanner(lex), True).withColumnRenamed("says", "epos")


def negated(mentions: DataFrame, sentences: DataFrame, lex: DataFrame | None = None, scope: DataFrame | None = None, reach: int = REACH) -> DataFrame:
    """Mentions with ``negated``. A span is negated if a ``nega`` begins at or before it or a
    ``negb`` after it, at most ``reach`` tokens away, with no ``conj`` strictly between. ``scope``:
    (cui) of concepts that can be negated; a span is in scope if any of its concepts is."""
    inside = mentions.join(scope.select("cui").distinct(), "cui", "left_semi") if scope is not None else mentions
    yes = _of_spans(inside, sentences, scanner(lex, reach), False).select("passage_id", "start", "length", "says").distinct()
    return mentions.join(yes, ["passage_id", "start", "length"], "left").withColumn("negated", F.coalesce("says", F.lit(False))).drop("says")


def scoped(mentions: DataFrame, flag: str = "flag", scope: str | None = "in_scope") -> DataFrame:
    """N5 for mentions whose spans are marked already: ``negated`` is the mark of the span where any of
    its concepts is in scope; no join, and no exchange where rows lie together by passage."""
    say = F.coalesce(flag, F.lit(False))
    if scope is None:
        return mentions.withColumn("negated", say).drop(flag)
    any_ = F.max(F.coalesce(scope, F.lit(False))).over(Window.partitionBy("passage_id", "start", "length"))
    return mentions.withColumn("negated", say & any_).drop(flag, scope)
