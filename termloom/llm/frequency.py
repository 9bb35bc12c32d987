"""Frequency of every distinct term by burst tries.

Every task counts its rows in a burst trie: terms are routed by their leading characters to small
containers, and a container that outgrows its capacity bursts into one per next character, so hot
prefixes get deep and rare ones stay shallow. Each task emits one row per term it saw (a hot term
costs one row per task, however many rows it has). The subtrees are then routed to workers by term
range and merged there, trie into trie.

Defined cases: null terms are not counted, the empty term is a term; a repeated (term, record) pair
counts as one record only where ``record`` pairs were made distinct by the caller; very long terms
are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import kept

CAPACITY = 4096
#: Terms a task holds before it emits what it has.
MOST_HELD = 2_000_000


class BurstTrie:
    """Occurrence and record counters by term. Inner nodes are dicts by character, containers are
    ``Leaf`` dicts from the rest of the term to its two counters."""

    class Leaf(dict):
        pass

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.root, self.size = capacity, BurstTrie.Leaf(), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, at, i = self.root, None, "", 0
        while type(node) is dict:
            c = term[i : i + 1]
            parent, at, i = node, c, i + 1
            node = node.get(c)
            if node is None:
                node = parent[c] = BurstTrie.Leaf()
        rest = term[i:]
        held = node.get(rest)
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return
        node[rest] = [occurrences, records]
        self.size += 1
        if len(node) > self.capacity and any(node):
            self._burst(node, parent, at)

    def _burst(self, leaf: dict, parent: dict | None, at: str) -> None:
        """One container becomes an inner node; ended terms stay under the empty character."""
        inner: dict = {}
        for rest, n in leaf.items():
            inner.setdefault(rest[:1], BurstTrie.Leaf())[rest[1:]] = n
        if parent is None:
            self.root = inner
        else:
            parent[at] = inner

    def merge(self, other: "BurstTrie") -> None:
        for term, o, r in other.items():
            self.add(term, o, r)

    def items(self) -> Iterator[tuple[str, int, int]]:
        """All terms in trie order."""
        todo: list[tuple[str, dict]] = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if type(node) is dict:
                todo += [(prefix + c, node[c]) for c in sorted(node, reverse=True)]
            else:
                for rest in sorted(node):
                    yield prefix + rest, *node[rest]


def _frames(tries: dict[str, BurstTrie], size: int = 20_000) -> Iterator[pd.DataFrame]:
    for field, trie in tries.items():
        rows = []
        for row in trie.items():
            rows.append((field, *row))
            if len(rows) == size:
                yield pd.DataFrame(rows, columns=["field", "term", "occurrences", "records"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["field", "term", "occurrences", "records"])


def _count(batches: Iterator[pd.DataFrame], most: int = MOST_HELD, in_order: bool = False) -> Iterator[pd.DataFrame]:
    """Counts of the rows' terms. A task with more than ``most`` terms emits them and begins again, so
    a term may come out several times; not so with ``in_order``, for rows sorted by (field, term):
    of those every term but the last is complete, and the last one is held back."""
    tries: dict[str, BurstTrie] = {}
    for b in batches:
        for field, part in b.groupby("field", sort=False):
            add = tries.setdefault(str(field), BurstTrie()).add
            for term, o, r in zip(part["term"], part["occurrences"], part["records"], strict=True):
                add(term, o, r)
        if sum(t.size for t in tries.values()) > most:  # a task's memory: emit and begin again
            open_ = (str(b["field"].iloc[-1]), b["term"].iloc[-1]) if in_order else None
            rest: dict[str, BurstTrie] = {}
            for f in _frames(tries):
                last = (f["field"] == open_[0]) & (f["term"] == open_[1]) if open_ else pd.Series(False, index=f.index)
                for field, term, o, r in f[last].itertuples(index=False):
                    rest.setdefault(field, BurstTrie()).add(term, int(o), int(r))
                yield f[~last]
            tries = rest
    yield from _frames(tries)


SCHEMA = "field string, term string, occurrences bigint, records bigint"


def term_counts(df: DataFrame, partitions: int | None = None, most: int = MOST_HELD) -> DataFrame:
    """(field, term, occurrences, records) of rows (field, term, occurrences, records).

    Terms reach their merging worker by range, so that matching subtrees meet; the ranges follow the
    counted terms, which were written once for that. A range comes sorted, so that it may hold more
    terms than a task can.
    """
    rows = df.where("term is not null").select("field", "term", F.col("occurrences").cast("bigint"), F.col("records").cast("bigint"))
    counted = kept(rows.mapInPandas(partial(_count, most=most), SCHEMA), "tries")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = counted.repartitionByRange(n, "field", "term").sortWithinPartitions("field", "term")
    return ranges.mapInPandas(partial(_count, most=most, in_order=True), SCHEMA)


def latest_counts(tf: DataFrame) -> DataFrame:
    """The rows of a term-frequency table that hold: of one (docid, cui) the one loaded last; equal
    times are settled by the larger frequency. A null docid is a docid of its own here."""
    t = tf.where("cui is not null and cui <> ''").select("docid", "cui", "frequency", "loaded_at")
    best = F.max(F.struct(F.col("loaded_at"), F.col("frequency"))).alias("m")
    return t.groupBy("docid", "cui").agg(best).select("docid", "cui", F.coalesce("m.frequency", F.lit(0)).alias("frequency"))
