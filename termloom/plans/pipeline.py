"""The whole pipeline as one logical plan, and its facade."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import abbreviation, context, match, negation, tagging
from termloom.session import spread


@dataclass(frozen=True)
class Settings:
    """Options of a run; precedence: keyword, environment TERMLOOM_*, properties file, default."""

    segmentation_method: str = "SENTENCES"
    detector: str = "negex"
    remove_subsumed: bool = True
    precision_filter: bool = False
    abbreviations: bool = True
    semantic_types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    strict: bool = True

    @staticmethod
    def load(path: str | None = None, **given: object) -> "Settings":
        props: dict[str, str] = {}
        if path:
            for line in open(path, encoding="utf-8"):
                s = line.strip()
                if s and s[0] not in "#!":
                    cut = min([i for i in (s.find("="), s.find(":")) if i >= 0], default=-1)
                    if cut > 0:
                        props[s[:cut].strip()] = s[cut + 1 :].strip()
        out: dict[str, object] = {}
        for f in fields(Settings):
            v = given.get(f.name, os.environ.get(f"TERMLOOM_{f.name.upper()}", props.get(f.name)))
            if v is None:
                continue
            if isinstance(f.default, bool) and isinstance(v, str):
                v = v.lower() in ("1", "true", "yes")
            elif isinstance(f.default, tuple) and isinstance(v, str):
                v = tuple(x.strip() for x in v.split(",") if x.strip())
            out[f.name] = v
        return Settings(**out)


#: What keeps a user's acronym apart from the keys of the dictionary.
_OWN = "\x00"


def _passage_spans(batches: Iterator[pa.RecordBatch], known: object, scanner: negation.Scanner | None, abbreviations: bool, acronyms: frozenset[str], tagger: tagging.Tagger | None) -> Iterator[pa.RecordBatch]:
    """All spans of passages that may be mentions: those of the dictionary, of a user's acronyms, and the
    short forms of long forms that are spans themselves; each with its keys and its mark of negation."""
    known = known.value
    names = ("sent_idx", "start", "length", "term", "keys", "window_no", "origin_rank", "flag")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_())
    tags = frozenset(match.START_TAGS)
    for b in batches:
        row: list[int] = []
        out: list[list] = [[] for _ in names]

        def put(r: int, *values: object) -> None:
            row.append(r)
            for c, v in zip(out, values):
                c.append(v)

        for r, (base, spans) in enumerate(zip(b.column("base_offset").to_pylist(), b.column("sents").to_pylist())):
            sents = [x["text"] for x in spans]
            tokens = [match.token_spans(s) for s in sents]
            given = match.tags_of(sents, tokens, tagger)
            defined: dict[str, tuple[str, int]] = {}
            if abbreviations:
                found = [(p["long"], p["short"], x["start"] + p["short_start"]) for x in spans if " (" in x["text"] for p in abbreviation.pairs(x["text"])]
                for long, short, at in sorted(found, key=lambda f: f[2]):
                    defined.setdefault(long, (short, at))
            wanted = {short for short, _ in defined.values()} | acronyms
            at_token: dict[str, list[tuple[int, int]]] = {}
            if wanted:
                for k, (x, s, t) in enumerate(zip(spans, sents, tokens)):
                    for y, z in t:
                        if (w := s[y:z]) in wanted:
                            at_token.setdefault(w, []).append((k, x["start"] + y))
            flags: dict[int, object] = {}

            def says(k: int, y: int, z: int) -> bool:
                """Of a span of sentence ``k``, whether it is negated."""
                if scanner is None:
                    return False
                if k not in flags:
                    flags[k] = scanner.flag(sents[k], tokens[k])
                return flags[k] is not None and flags[k](y, z)

            copied: set[str] = set()
            for k, (x, s, t) in enumerate(zip(spans, sents, tokens)):
                for _, j, y, z, term, keys in match.spans_of(s, t, given and given[k], tags, match.LONGEST, known):
                    put(r, k, base + x["start"] + y, z - y, term, keys, max(0, j - match.LONGEST), 0, says(k, y, z))
                    if term in defined and term not in copied:
                        copied.add(term)
                        short, at = defined[term]
                        sites = set(at_token.get(short, ()))
                        if base + at > 0:  # a definition at the document's start is none
                            sites.add((max(i for i, v in enumerate(spans) if v["start"] <= at), at))
                        for i, a in sorted(sites):
                            a0 = a - spans[i]["start"]
                            put(r, i, base + a, len(short), short, keys, 1, 2, says(i, a0, a0 + len(short)))
            for w in acronyms & at_token.keys():
                for i, a in at_token[w]:
                    a0 = a - spans[i]["start"]
                    put(r, i, base + a, len(w), w, [_OWN + w], 1, 1, says(i, a0, a0 + len(w)))
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("passage_id", "docid", "fieldid")] + [pa.array(c, k) for c, k in zip(out, kinds)], ["passage_id", "docid", "fieldid", *names])


#: A user's acronyms go to every task; more are refused.
MOST_ACRONYMS = 100_000


def annotate(passages: DataFrame, names: DataFrame, settings: Settings = Settings(), types: DataFrame | None = None, custom: DataFrame | None = None, excluded: DataFrame | None = None, acronyms: DataFrame | None = None, tagger: tagging.Tagger | None = None) -> DataFrame:
    """Mentions of passages. Order: match, user acronyms, abbreviations, assertion, restriction,
    subsumption, precision. Assertion sees the unrestricted mentions on purpose; with ``types`` (cui,
    abbrev) it negates only concepts of types that can be negated.

    One pass over each passage makes its spans, asks the filter of the dictionary's keys, copies long
    forms to their short forms and marks negation. What is left meets the dictionary once and is
    exchanged once, by passage; the rest are windows over that. Passages delivered twice count once."""
    spark = passages.sparkSession
    negex = settings.detector.lower() == "negex"
    dict_ = match.dictionary(names, custom)
    own: frozenset[str] = frozenset()
    keys = match.dictionary_keys(names, custom)
    if acronyms is not None:
        rows = acronyms.select("acronym").distinct().limit(MOST_ACRONYMS + 1).collect()
        if len(rows) > MOST_ACRONYMS:
            raise ValueError(f"more than {MOST_ACRONYMS} acronyms")
        own = frozenset(r["acronym"] for r in rows if r["acronym"])
        dict_ = dict_.unionByName(acronyms.select(F.concat(F.lit(_OWN), "acronym").alias("norm"), "cui", "concept_string", F.lit(1).alias("is_custom")))
    if negex and types is not None:  # a join of the size of the dictionary, not of the corpus
        dict_ = dict_.join(negation.negatable(types).withColumn("in_scope", F.lit(True)), "cui", "left")
    else:
        dict_ = dict_.withColumn("in_scope", F.lit(True))
    known = spark.sparkContext.broadcast(match.key_filter(keys))
    run = partial(_passage_spans, known=known, scanner=negation.scanner() if negex else None, abbreviations=settings.abbreviations, acronyms=own, tagger=tagger)
    p = spread(passages.where("text is not null")).select("passage_id", "docid", F.col("fieldid").cast("string").alias("fieldid"), F.coalesce("base_offset", F.lit(0)).alias("base_offset"), T.segment(F.col("text"), settings.segmentation_method).alias("sents"))
    key = passages.schema["passage_id"].dataType.simpleString()
    spans = p.mapInArrow(run, f"passage_id {key}, docid string, fieldid string, sent_idx int, start int, length int, term string, keys array<string>, window_no int, origin_rank int, flag boolean")
    hit = spans.select("*", F.posexplode("keys").alias("key_rank", "norm")).drop("keys").join(dict_, "norm")
    if excluded is not None:
        one = excluded.select(F.col("cui").alias("xc"), F.col("norm").alias("xn"))
        hit = hit.join(one, (F.col("xn") == F.col("norm")) & ((F.col("xc") == F.col("cui")) | (F.col("xc") == "*")), "left_anti")
    m = match.first_per_span(match.first_keys(hit.repartition("passage_id")))
    m = m.drop("key_rank", "is_custom")
    if negex:
        m = negation.scoped(m)
    else:
        s = match.sentence_rows(passages.where("text is not null"), settings.segmentation_method)
        m = context.detector(settings.detector, types, settings.strict)(m.drop("flag", "in_scope"), s)
    if settings.semantic_types or settings.sources:
        m = match.restrict(m, types, names.select("cui", "sab").distinct(), settings.semantic_types, settings.sources)
    if settings.remove_subsumed:
        m = match.drop_subsumed(m)
    return match.precise(m, names) if settings.precision_filter else m
