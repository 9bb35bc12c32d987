"""Assertion, temporality and experiencer of a concept in its sentence, from trigger phrases.

A lexicon is a list of entries ``phrase,position,kind`` (``load_lexicon`` reads a file of them);
position is pre, post, termin, one or pseudo. The sentence is in lower case, the first occurrence of
the concept stands as [0], and every trigger is replaced by a tag. What a tag says of the concept is
then a matter of walking from the tag towards it: ``WALKS`` names direction, reach, the tags that stop
the walk and the verdict. The classes depend on sentence and concept text alone, so they are made once
for each distinct text of a sentence, over Arrow batches.

Two modes. ``strict``: tags are put in bucket by bucket, a phrase stored with a blank at its end needs
two separators after it, the first pseudo-phrase is without its first letter, and every sentence of a
passage judges every concept text that occurs in it. Otherwise: one alternation, longest phrase first,
with a few phrases more; a mention is judged in its own sentence and list item only, and triggers of
time and person inside the concept's own name count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The trigger entries in the order in which they are tried. Blanks before the first comma count.
LEXICON = """
absence of ,pre,neg
adequate to rule her out ,pre,neg
adequate to rule him out ,pre,neg
adequate to rule out ,pre,neg
adequate to rule the patient out ,pre,neg
although ,termin,neg
any other,pre,neg
apart from ,termin,neg
are ruled out ,post,neg
as a cause for ,termin,neg
as a cause of ,termin,neg
as a etiology for ,termin,neg
as a etiology of ,termin,neg
as a reason for ,termin,neg
as a reason of ,termin,neg
as a secondary cause for ,termin,neg
as a secondary cause of ,termin,neg
as a secondary etiology for ,termin,neg
as a secondary etiology of ,termin,neg
as a secondary origin for ,termin,neg
as a secondary origin of ,termin,neg
as a secondary reason for ,termin,neg
as a secondary reason of ,termin,neg
as a secondary source for ,termin,neg
as a secondary source of ,termin,neg
as a source for ,termin,neg
as a source of ,termin,neg
as an cause for ,termin,neg
as an cause of ,termin,neg
as an etiology for ,termin,neg
as an etiology of ,termin,neg
as an origin for ,termin,neg
as an origin of ,termin,neg
as an reason for ,termin,neg
as an reason of ,termin,neg
as an secondary cause for ,termin,neg
as an secondary cause of ,termin,neg
as an secondary etiology for ,termin,neg
as an secondary etiology of ,termin,neg
as an secondary origin for ,termin,neg
as an secondary origin of ,termin,neg
as an secondary reason for ,termin,neg
as an secondary reason of ,termin,neg
as an secondary source for ,termin,neg
as an secondary source of ,termin,neg
as an source for ,termin,neg
as an source of ,termin,neg
as has,termin,neg
as needed,pre,hypo
as the cause for ,termin,neg
as the cause of ,termin,neg
as the etiology for ,termin,neg
as the etiology of ,termin,neg
as the origin for ,termin,neg
as the origin of ,termin,neg
as the reason for ,termin,neg
as the reason of ,termin,neg
as the secondary cause for ,termin,neg
as the secondary cause of ,termin,neg
as the secondary etiology for ,termin,neg
as the secondary etiology of ,termin,neg
as the secondary origin for ,termin,neg
as the secondary origin of ,termin,neg
as the secondary reason for ,termin,neg
as the secondary reason of ,termin,neg
as the secondary source for ,termin,neg
as the secondary source of ,termin,neg
as the source for ,termin,neg
as the source of ,termin,neg
as well as any,pre,neg
aside from ,termin,neg
aunt,pre,exp
aunt\\'s,pre,exp
be ruled out ,post,poss
be ruled out for ,pre,poss
because,termin,hypo
being ruled out ,post,poss
brother,pre,exp
brother\\'s,pre,exp
but ,termin,neg
can be ruled out ,post,poss
can be ruled out for ,pre,poss
can rule her out ,pre,neg
can rule her out against ,pre,neg
can rule her out for ,pre,neg
can rule him out ,pre,neg
can rule him out against ,pre,neg
can rule him out for ,pre,neg
can rule out ,pre,neg
can rule out against ,pre,neg
can rule out for ,pre,neg
can rule the patient out ,pre,neg
can rule the patinet out against ,pre,neg
can rule the patinet out for ,pre,neg
cannot ,pre,neg
cause for ,termin,neg
cause of ,termin,neg
causes for ,termin,neg
causes of ,termin,neg
checked for ,pre,neg
clear of,pre,neg
come back for,pre,hypo
come back to,pre,hypo
complains,termin,histexp
could be ruled out ,post,poss
could be ruled out for ,pre,poss
currently,termin,histexp
dad,pre,exp
dad\\'s,pre,exp
declined ,pre,neg
declines ,pre,neg
denied ,pre,neg
denies ,pre,neg
denying ,pre,neg
did not rule out ,post,poss
did rule her out ,pre,neg
did rule her out against ,pre,neg
did rule her out for ,pre,neg
did rule him out ,pre,neg
did rule him out against ,pre,neg
did rule him out for ,pre,neg
did rule out ,pre,neg
did rule out against ,pre,neg
did rule out for ,pre,neg
did rule the patient out ,pre,neg
did rule the patient out against ,pre,neg
did rule the patient out for ,pre,neg
doesn\\'t look like,pre,neg
ED,termin,hist
emergency department,termin,hist
etiology for ,termin,neg
etiology of ,termin,neg
evaluate for ,pre,neg
except ,termin,neg
fails to reveal ,pre,neg
family,pre,exp
fam hx,pre,exp
father,pre,exp
father\\'s,pre,exp
free ,post,neg
free of ,pre,neg
gram negative ,pseudo,neg
grandfather,pre,exp
grandfather\\'s,pre,exp
grandmother,pre,exp
grandmother\\'s,pre,exp
has been negative,post,neg
has been ruled out ,post,neg
have been ruled out ,post,neg
her,termin,hypoexp
his,termin,hypoexp
history,pre,hist
history and,pseudo,hist
history and examination,pseudo,hist
history and physical,pseudo,hist
history for,pseudo,hist
history of chief complaint,pseudo,hist
history of present illness,pseudo,hist
history taking,pseudo,hist
"history, physical",pseudo,hist
however ,termin,neg
if,pre,hypo
if negative,pseudo,hypo
inconsistent with,pre,neg
is not,pre,neg
is ruled out ,post,neg
is to be ruled out ,post,poss
is to be ruled out for ,pre,poss
isn\\'t,pre,neg
lack of,pre,neg
lacked,pre,neg
may be ruled out ,post,poss
may be ruled out for ,pre,poss
might be ruled out ,post,poss
might be ruled out for ,pre,poss
mom,pre,exp
mom\\'s,pre,exp
mother,pre,exp
mother\\'s,pre,exp
must be ruled out ,post,poss
must be ruled out for ,pre,poss
negative for ,pre,neg
never developed ,pre,neg
never had ,pre,neg
nevertheless ,termin,neg
no ,pre,neg
no abnormal ,pre,neg
no cause of ,pre,neg
no change ,pseudo,neg
no complaints of ,pre,neg
no definite change ,pseudo,neg
no evidence ,pre,neg
no evidence to suggest ,pre,neg
no findings of ,pre,neg
no findings to indicate ,pre,neg
no history of,pre,neg
no increase ,pseudo,neg
no interval change ,pseudo,neg
no longer present,post,neg
no mammographic evidence of ,pre,neg
no new ,pre,neg
no new evidence ,pre,neg
no other evidence ,pre,neg
no radiographic evidence of ,pre,neg
no sign of ,pre,neg
no significant ,pre,neg
no significant change ,pseudo,neg
no significant interval change ,pseudo,neg
no signs of ,pre,neg
no suggestion of ,pre,neg
no suspicious ,pre,neg
no suspicious change ,pseudo,neg
non diagnostic,post,neg
not ,pre,neg
not appear ,pre,neg
not appreciate ,pre,neg
not associated with ,pre,neg
not been ruled out ,post,poss
not cause ,pseudo,neg
not certain if ,pseudo,neg
not certain whether ,pseudo,neg
not complain of ,pre,neg
not demonstrate ,pre,neg
not drain ,pseudo,neg
not exhibit ,pre,neg
not extend ,pseudo,neg
not feel ,pre,neg
not had ,pre,neg
not have ,pre,neg
not have evidence of,pre,neg
not know of ,pre,neg
not known to have ,pre,neg
not necessarily ,pseudo,neg
not on,pseudo,neg
not only ,pseudo,neg
not reveal ,pre,neg
not ruled out ,post,poss
not see ,pre,neg
not to be ,pre,neg
noted,termin,histexp
now resolved,post,neg
origin for ,termin,neg
origin of ,termin,neg
origins for ,termin,neg
origins of ,termin,neg
other possibilities of ,termin,neg
ought to be ruled out ,post,poss
ought to be ruled out for ,pre,poss
past history,pre,hist
past medical history,pre,hist
patient,termin,hypoexp
patient was not ,pre,neg
patient\\'s,termin,hypoexp
poor history,pseudo,hist
presenting,termin,histexp
presents,termin,histexp
previous,one,hist
prophylaxis,post,neg
r/o ,pre,poss
rather than ,pre,neg
reason for ,termin,neg
reason of ,termin,neg
reasons for ,termin,neg
reasons of ,termin,neg
reported,termin,histexp
reports,termin,histexp
resolved ,pre,neg
return,pre,hypo
ro ,pre,poss
rule her out ,pre,poss
rule her out for ,pre,poss
rule him out ,pre,poss
rule him out for ,pre,poss
rule out ,pre,poss
rule out for ,pre,poss
rule the patient out ,pre,poss
rule the patinet out for ,pre,poss
ruled her out ,pre,neg
ruled her out against ,pre,neg
ruled her out for ,pre,neg
ruled him out ,pre,neg
ruled him out against ,pre,neg
ruled him out for ,pre,neg
ruled out ,pre,neg
ruled out against ,pre,neg
ruled out for ,pre,neg
ruled the patient out ,pre,neg
ruled the patient out against ,pre,neg
ruled the patient out for ,pre,neg
rules her out ,pre,neg
rules her out for ,pre,neg
rules him out ,pre,neg
rules him out for ,pre,neg
rules out ,pre,neg
rules out for ,pre,neg
rules the patient out ,pre,neg
rules the patient out for ,pre,neg
secondary,termin,neg
secondary to,termin,neg
should be ruled out ,post,poss
should be ruled out for ,pre,poss
should he,pre,hypo
should she,pre,hypo
should the patient,pre,hypo
should there,pre,hypo
since,termin,hypo
sister,pre,exp
sister\\'s,pre,exp
social history,pseudo,hist
source for ,termin,neg
source of ,termin,neg
sources for ,termin,neg
sources of ,termin,neg
states,termin,histexp
still ,termin,neg
sudden onset of,pseudo,hist
sufficient to rule her out ,pre,neg
sufficient to rule her out against ,pre,neg
sufficient to rule her out for ,pre,neg
sufficient to rule him out ,pre,neg
sufficient to rule him out against ,pre,neg
sufficient to rule him out for ,pre,neg
sufficient to rule out ,pre,neg
sufficient to rule out against ,pre,neg
sufficient to rule out for ,pre,neg
sufficient to rule the patient out ,pre,neg
sufficient to rule the patient out against ,pre,neg
sufficient to rule the patient out for ,pre,neg
test for ,pre,neg
though ,termin,neg
to exclude ,pre,neg
today,termin,histexp
trigger event for ,termin,neg
uncle,pre,exp
uncle\\'s,pre,exp
unlikely ,post,neg
unremarkable for ,pre,neg
was found,termin,histexp
was negative,post,neg
was not,pre,neg
was ruled out ,post,neg
wasn\\'t,pre,neg
what must be ruled out is ,pre,poss
which,termin,exp
who,termin,hypoexp
will be ruled out ,post,poss
will be ruled out for ,pre,poss
with no ,pre,neg
without ,pre,neg
without any evidence of ,pre,neg
without difficulty ,pseudo,neg
without evidence ,pre,neg
without indication of ,pre,neg
without sign of ,pre,neg
yet ,termin,neg
"""
# Entries for the mode that is not strict.
MORE = """
cannot exclude,pre,poss
can not exclude,pre,poss
could not exclude,pre,poss
unable to exclude,pre,poss
cannot rule out,pre,poss
cannot be excluded,post,poss
cannot be ruled out,post,poss
concerning for,pre,poss
concern for,pre,poss
suspicious for,pre,poss
suspected,pre,poss
is suspected,post,poss
differential includes,pre,poss
differential diagnosis includes,pre,poss
low suspicion for,pre,poss
possible,pre,poss
probable,pre,poss
absent,pre,neg
is absent,post,neg
are absent,post,neg
"""
# What the places of the lexicon are called as tags, in the order of replacement.
TAGS = {
    ("pre", "neg"): "NEG_PRE",
    ("pre", "poss"): "POSS_PRE",
    ("post", "neg"): "NEG_POST",
    ("post", "poss"): "POSS_POST",
    ("termin", "neg"): "NEG_END",
    ("pre", "exp"): "EXP_PRE",
    ("termin", "exp"): "EXP_END",
    ("pre", "hypo"): "HYPO_PRE",
    ("termin", "hypo"): "HYPO_END",
    ("pre", "hist"): "HIST_PRE",
    ("one", "hist"): "HIST_1W",
    ("termin", "hist"): "HIST_END",
    ("termin", "hypoexp"): "HYPO_EXP_END",
    ("termin", "histexp"): "HIST_EXP_END",
}
# Phrases of time, in both modes; the brackets of the strict ones are character classes.
_TIME = r"((1[4-9]|[1-9]?[2-9][0-9])[ |-][day|days] of)|(([2-9]|[1-9][0-9])[ |-][week|weeks] of)|(([1-9]?[0-9])[ |-][month|months|year|years] of)"
_SINCE = (
    r"since [last|the last]? ((([2-9]|[1-9][0-9]) weeks ago)|(([1-9]?[0-9])? [month|months|year|years] ago)"
    r"|([january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|fall|winter]))"
)
_TIME_FIXED = r"(\b(1[4-9]|[1-9]?[2-9][0-9])[ -]days? of)|(\b([2-9]|[1-9][0-9])[ -]weeks? of)|(\b([1-9]?[0-9])[ -](months?|years?) of)"
_SINCE_FIXED = (
    r"since (?:(?:the )?last )?((\b([2-9]|[1-9][0-9]) weeks ago)|(\b([1-9]?[0-9] )?(months?|years?) ago)"
    r"|((january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|fall|winter)\b))"
)
TIMES = {
    True: ((rf"[for|over] the [last|past] ({_TIME})", "TIME_PRE"), (_TIME, "TIME_PRE"), (_SINCE, "TIME_POST")),
    False: ((rf"(for|over) the (last|past) ({_TIME_FIXED})", "TIME_PRE"), (_TIME_FIXED, "TIME_PRE"), (_SINCE_FIXED, "TIME_POST")),
}
# A line of a list.
ITEM = re.compile(r"\n[ \t]*(?:[-*•]|\d{1,2}[.)])[ \t]")
_S = r" \t\n\x0b\f\r"
_GAP = f"[{_S}-]"
_BLANKS = re.compile(f"[{_S}]+")
_APART = re.compile(f"[,;{_S}]+")
_HERE = re.compile(r"\[[0-9]+\]")
#: Words walked from a tag of negation or possibility at most.
WINDOW = 14


@dataclass(frozen=True)
class Walk:
    """From a tag to the concept: forward or back, over so many words, unless a tag of ``stops`` is met."""

    verdict: str
    forward: bool = True
    stops: frozenset[str] = frozenset()
    reach: int | None = None

    def meets(self, words: list[str], at: int) -> bool:
        far = len(words) if self.reach is None else self.reach
        ahead = words[at + 1 : at + 1 + far] if self.forward else words[max(0, at - far) : at][::-1]
        for w in ahead:
            if w in self.stops:
                return False
            if _HERE.fullmatch(w):
                return True
        return False


def _tags(*names: str) -> frozenset[str]:
    return frozenset(f"<{n}>" for n in names)


_BACK = _tags("NEG_PRE", "POSS_PRE", "NEG_POST", "POSS_POST", "NEG_END")
_PAST = _tags("HIST_END", "HIST_EXP_END", "HIST_PRE", "HIST_1W")


def _walks(strict: bool) -> tuple[dict[str, Walk], dict[str, Walk], dict[str, Walk]]:
    """What each tag says of assertion, temporality and experiencer."""
    ahead = _BACK - _tags("POSS_PRE") if strict else _BACK
    assertion = {"<NEG_PRE>": Walk("Negated", True, ahead, WINDOW), "<NEG_POST>": Walk("Negated", False, _BACK, WINDOW), "<POSS_POST>": Walk("Possible", False, _BACK, WINDOW)}
    if not strict:
        assertion["<POSS_PRE>"] = Walk("Possible", True, ahead, WINDOW)
    past = {"<HYPO_PRE>": Walk("Hypothetical"), "<HIST_PRE>": Walk("Historical", True, _PAST), "<TIME_PRE>": Walk("Historical", True, _PAST), "<TIME_POST>": Walk("Historical", False, _PAST), "<HIST_1W>": Walk("Historical", reach=1)}
    return assertion, past, {"<EXP_PRE>": Walk("Other")}


def _entries(lexicon: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """(phrase, position, kind); the phrase ends at the first comma, the kind begins after the last."""
    for e in lexicon:
        yield e[: e.index(",")], e[e.index(",") + 1 : e.rindex(",")], e[e.rindex(",") + 1 :]


def default_lexicon(strict: bool = True) -> tuple[str, ...]:
    lines = LEXICON.strip("\n").split("\n")
    return tuple(lines if strict else lines + MORE.strip("\n").split("\n"))


def load_lexicon(path: str) -> tuple[str, ...]:
    """A lexicon file: an entry on each line; blank lines and those that begin with # are none."""
    with open(path, encoding="utf-8") as f:
        return tuple(x for line in f if (x := line.rstrip("\r\n")).count(",") >= 2 and not x.startswith("#"))


class Rules:
    """A lexicon made ready to tag and classify sentences."""

    def __init__(self, lexicon: tuple[str, ...] | None = None, strict: bool = True) -> None:
        self.strict = strict
        entries = list(_entries(default_lexicon(strict) if lexicon is None else lexicon))
        self.walks = _walks(strict)
        self.times = [(re.compile(p), f" <{t}> ") for p, t in TIMES[strict]]
        pseudo = "|".join(p.replace(" ", _GAP) for p, at, _ in entries if at == "pseudo")
        self.pseudo = re.compile(pseudo[1:] if strict else pseudo) if pseudo[strict:] else None
        held: dict[str, list[str]] = {}
        for p, at, kind in entries:
            tag = TAGS.get((at, kind))
            if tag and not (strict and tag == "HIST_1W"):
                held.setdefault(tag, []).append(p if strict else p.strip())
        self.buckets: list[tuple[frozenset[str], re.Pattern[str], str]] = []
        if strict:
            for tag in TAGS.values():
                if tag in held:
                    either = "|".join(p.replace(" ", _GAP) for p in held[tag])
                    self.buckets.append((self._firsts(held[tag]), re.compile(rf"[{_S}.]+(?:{either})[{_S}.:;,]+"), f" <{tag}> "))
        else:
            order = [(p, tag) for p, at, kind in entries if (tag := TAGS.get((at, kind))) for p in [p.strip()]]
            order.sort(key=lambda x: -len(x[0]))
            self.tag_of: dict[str, str] = {}
            for p, tag in order:
                self.tag_of.setdefault(p, f" <{tag}> ")
            self.firsts = self._firsts([p for p, _ in order])
            either = "|".join(p.replace(" ", _GAP) for p, _ in order)
            self.any_ = re.compile(rf"[{_S}.]+({either})(?=[{_S}.:;,]|$)") if order else None

    @staticmethod
    def _firsts(phrases: list[str]) -> frozenset[str]:
        return frozenset(re.split(r"[\s-]", p, maxsplit=1)[0] for p in phrases)

    def tagged(self, text: str) -> str:
        """The text with a tag for every trigger. Alternations whose first words don't occur are not
        tried."""
        for rx, tag in () if self.strict else self.times:
            text = rx.sub(tag, text)
        if self.pseudo:
            text = self.pseudo.sub(" <NEG_PSEUDO> ", text)
        have = set(re.split(rf"[{_S}.:;,-]+", text))
        if self.strict:
            for firsts, rx, tag in self.buckets:
                if not firsts.isdisjoint(have):
                    text = rx.sub(tag, text)
            for rx, tag in self.times:
                text = rx.sub(tag, text)
        elif self.any_ and not self.firsts.isdisjoint(have):
            text = self.any_.sub(lambda m: self.tag_of[re.sub(f"{_GAP}+", " ", m.group(1))], text)
        return text

    def _marker(self, concept: str) -> str:
        """[0], with the triggers of time and person in the concept's own name around it."""
        if self.strict:
            return " [0] "
        keep = _tags("EXP_PRE", "HYPO_PRE", "HIST_PRE", "HIST_1W", "TIME_PRE", "TIME_POST")
        out: list[str] = []
        for w in _APART.split(self.tagged(f" {concept} ")):
            if w in keep:
                out.append(w)
            elif w and not w.startswith("<") and out[-1:] != ["[0]"]:
                out.append("[0]")
        return " " + " ".join(out if "[0]" in out else [*out, "[0]"]) + " "

    def classify(self, sentence: str | None, concept: str | None) -> tuple[str, str, str] | None:
        """(assertion, temporality, experiencer); None where the concept does not occur."""
        if not sentence or not concept:
            return None
        text, needle = " " + _BLANKS.sub(" ", sentence).lower(), _BLANKS.sub(" ", concept).lower()
        at = text.find(needle)
        if at < 0:
            return None
        words = _APART.split(self.tagged(text[:at] + self._marker(needle) + text[at + len(needle) :]))

        def first(walks: dict[str, Walk], otherwise: str) -> str:
            for i, w in enumerate(words):
                if w in walks and walks[w].meets(words, i):
                    return walks[w].verdict
            return otherwise

        return first(self.walks[0], "Affirmed"), first(self.walks[1], "Recent"), first(self.walks[2], "Patient")

    def of_span(self, sentence: str, start: int, term: str) -> tuple[str, str, str] | None:
        """Within the list item that holds the mention, or the sentence where the mention goes on
        beyond it."""
        lo, hi = 0, len(sentence)
        for m in ITEM.finditer(sentence):
            if m.start() >= start:
                hi = m.start()
                break
            lo = m.start()
        return self.classify(sentence[lo:hi], term) or self.classify(sentence, term)


@lru_cache(maxsize=8)
def rules(lexicon: tuple[str, ...] | None = None, strict: bool = True) -> Rules:
    return Rules(lexicon, strict)


_CLASSES = "assertion string, temporality string, experiencer string"


def classified(df: DataFrame, sentence: str, concept: str, lexicon: tuple[str, ...] | None = None, strict: bool = True) -> DataFrame:
    """``df`` with assertion (Affirmed, Negated, Possible), temporality (Recent, Historical,
    Hypothetical) and experiencer (Patient, Other); null where the concept does not occur."""

    @F.pandas_udf(_CLASSES)
    def run(s: pd.Series, c: pd.Series) -> pd.DataFrame:
        r = rules(lexicon, strict)
        return pd.DataFrame([r.classify(x, y) or (None, None, None) for x, y in zip(s, c)], columns=["assertion", "temporality", "experiencer"], dtype=object)

    return df.withColumn("_c", run(sentence, concept)).select("*", "_c.*").drop("_c")


def _judged(batches: Iterator[pa.RecordBatch], lexicon: tuple[str, ...] | None, strict: bool) -> Iterator[pa.RecordBatch]:
    r = rules(lexicon, strict)
    for b in batches:
        row, out = [], []
        for k, (s, base, spans) in enumerate(zip(b.column("sent").to_pylist(), b.column("sent_start").to_pylist(), b.column("spans").to_pylist())):
            low = _BLANKS.sub(" ", s).lower() if strict else ""
            for x in spans:
                if strict and _BLANKS.sub(" ", x["term"]).lower() not in " " + low:
                    continue
                got = r.classify(s, x["term"]) if strict else r.of_span(s, x["start"] - base, x["term"])
                if got:
                    row.append(k)
                    out.append((x["start"], x["term"], *got))
        at = pa.array(row, pa.int32())
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("passage_id", "sent_idx")] + [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.string()) for c in cols[1:]], ["passage_id", "sent_idx", "start", "term", "assertion", "temporality", "experiencer"])


def detected(mentions: DataFrame, sentences: DataFrame, strict: bool = True, lexicon: tuple[str, ...] | None = None) -> DataFrame:
    """Mentions with their classes. ``strict``: every sentence of the passage in which the text
    occurs counts, negation in any of them, the other classes from the last; else the mention's own.
    The work is bounded by the passage either way: a join on the passage, no cross join."""
    s = sentences.select("passage_id", "sent_idx", "sent_start", "sent").dropDuplicates(["passage_id", "sent_idx"])
    if strict:
        spans = mentions.groupBy("passage_id").agg(F.collect_set(F.struct(F.lit(-1).alias("start"), "term")).alias("spans"))  # texts of a passage
        rows = s.join(spans, "passage_id")
    else:
        rows = s.join(mentions.groupBy("passage_id", "sent_idx").agg(F.collect_set(F.struct("start", "term")).alias("spans")), ["passage_id", "sent_idx"])
    key = mentions.schema["passage_id"].dataType.simpleString()
    c = rows.select("passage_id", "sent_idx", "sent_start", "sent", "spans").mapInArrow(partial(_judged, lexicon=lexicon, strict=strict), f"passage_id {key}, sent_idx int, start int, term string, {_CLASSES}")
    by = ["passage_id", "term"] if strict else ["passage_id", "start", "term"]
    last = lambda x: F.max_by(x, "sent_idx").alias(x)
    one = c.groupBy(*by).agg(F.bool_or(F.col("assertion") == "Negated").alias("negated"), last("assertion"), last("temporality"), last("experiencer"))
    return mentions.drop("negated").join(one, by, "left").withColumn("negated", F.coalesce("negated", F.lit(False)))


Detector = Callable[[DataFrame, DataFrame], DataFrame]
_DETECTORS: dict[str, Detector] = {}
BUILT_IN = ("negex", "context", "none")


def register_detector(name: str, detector: Detector) -> None:
    """A detector (mentions, sentences) -> mentions under a new name; built-in names are refused."""
    if name.lower() in BUILT_IN:
        raise ValueError(f"{name} is built in")
    _DETECTORS[name.lower()] = detector


def register_classifier(name: str, classify: Callable[[str, list[tuple[int, int]]], list[dict | None]]) -> None:
    """A classifier of one's own, (sentence, spans) -> for each span None or its assertion,
    temporality and experiencer, as a detector over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for k, (s, base, spans) in enumerate(zip(b.column("sent").to_pylist(), b.column("sent_start").to_pylist(), b.column("spans").to_pylist())):
                at = [(x["start"] - base, x["start"] - base + x["length"]) for x in spans]
                for x, got in zip(spans, classify(s, at)):
                    if got is not None:
                        row.append(k)
                        out.append((x["start"], x["length"], *(got.get(c) for c in ("assertion", "temporality", "experiencer"))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("passage_id").take(pa.array(row, pa.int32()))] + [pa.array(c, pa.int32()) for c in cols[:2]] + [pa.array(c, pa.string()) for c in cols[2:]], ["passage_id", "start", "length", "assertion", "temporality", "experiencer"])

    def detector(m: DataFrame, s: DataFrame) -> DataFrame:
        keys = ["passage_id", "sent_idx"]
        spans = m.groupBy(*keys).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        rows = s.select(*keys, "sent_start", "sent").dropDuplicates(keys).join(spans, keys)
        key = m.schema["passage_id"].dataType.simpleString()
        one = rows.mapInArrow(run, f"passage_id {key}, start int, length int, {_CLASSES}")
        return m.drop("negated").join(one, ["passage_id", "start", "length"], "left").withColumn("negated", F.coalesce(F.col("assertion") == "Negated", F.lit(False)))

    register_detector(name, detector)


def detector(name: str, types: DataFrame | None = None, strict: bool = True) -> Detector:
    """A detector by name. ``types`` (cui, abbrev): negex then negates only concepts of the types
    that can be negated."""
    from termloom.operators import negation

    key = name.lower()
    if key == "negex":
        return lambda m, s: negation.negated(m, s, None, negation.negatable(types) if types is not None else None)
    if key == "context":
        return lambda m, s: detected(m, s, strict)
    if key == "none":
        return lambda m, s: m.withColumn("negated", F.lit(None).cast("boolean"))
    if key not in _DETECTORS:
        raise ValueError(f"detector {name!r} is none of {sorted([*BUILT_IN, *_DETECTORS])}")
    return _DETECTORS[key]
