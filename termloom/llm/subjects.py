"""Subject areas of documents by class-association rules.

From a labelled sample the rules {words} -> subject are mined by parallel frequent-pattern growth over
sentences: words are ranked, every sentence goes to the group of each of its words with the words
ranked before it, and each group grows the patterns that end in its word, none longer than
``LONGEST``, so the work of a group is bounded however long a sentence is. Words that no subject
prefers are left out before (they would only multiply patterns), and a rule is dropped if a shorter
one concludes the same as surely. Every sentence of a document gives each subject the confidence of
its best matching rule; the sums over a document are calibrated by isotonic regression on labelled
documents that no rule was mined from, and a subject is assigned from a probability of 0.5 on.

Only the labelled sample is bounded (``most_labels``, whole documents in the order of a hash);
every document is scored whole, by all rules (``scores``).

Defined cases: null, empty and blank texts have no subject; labels 'none' and null subjects count as
labelled without subject; conflicting labels of a document all count; labels of unknown documents
and repeated labels are ignored; without labels there are no rules and no assignments.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import kept, spread

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words in an antecedent at most.
LONGEST = 3
#: Rules a task holds at once; more are matched a part at a time, every part over all documents.
MOST_RULES = 200_000
#: A rule is needed only if it is surer by more than this than every rule of fewer of its words.
SURER = 0.02
#: One labelled document in so many calibrates; the others give the rules.
HELD_OUT = 4


def words(sentence: str) -> list[str]:
    """The distinct words of a sentence, lower case, a plural s taken off."""
    out = dict.fromkeys(w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in _WORD.findall(sentence.lower()))
    return list(out)


def sentence_words(text: str | None) -> list[list[str]]:
    return [w for s in _SENTENCE.split(text or "") if (w := words(s))]


def resolved(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, subjects): the labelled sample, whole documents in the order of a hash."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("subject") != "none", F.col("subject")))).alias("subjects"))
    return by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def grown(word: str, before: list[list[str]], of: list[list[str]], support: int, confidence: float) -> Iterator[tuple[list[str], str, int, float]]:
    """(antecedent, subject, support, confidence): the rules of the patterns that end in ``word``.
    ``before``: for each sentence with the word its words ranked earlier; ``of``: its subjects.

    Equal sentences are counted once (``Counter``); a pattern is grown by one word only from the sentences
    that hold it, and only by words frequent among those."""

    def rules(pattern: tuple[str, ...], rows: Counter) -> Iterator[tuple[list[str], str, int, float]]:
        n = sum(rows.values())
        hits: Counter = Counter()
        for (_, subjects), k in rows.items():
            for s in subjects:
                hits[s] += k
        for s, k in sorted(hits.items()):
            if k >= support and k / n >= confidence:
                yield sorted(pattern), s, k, k / n
        if len(pattern) == LONGEST:
            return
        have: Counter = Counter()
        for (ws, _), k in rows.items():
            for w in ws:
                have[w] += k
        for w, k in sorted(have.items()):
            if k >= support:
                # the words before w go on, so every pattern is grown once
                held: Counter = Counter()
                for (ws, subjects), m in rows.items():
                    if w in ws:
                        held[ws[: ws.index(w)], subjects] += m
                yield from rules((*pattern, w), held)

    yield from rules((word,), Counter((tuple(b), tuple(sorted(s))) for b, s in zip(before, of)))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every sentence for each of its words, with the words ranked before it."""
    for b in batches:
        out = [(w, ws[:i], s) for ws, s in zip(b["words"], b["subjects"]) for i, w in enumerate(list(ws))]
        yield pd.DataFrame([(w, list(x), list(s)) for w, x, s in out], columns=["word", "before", "subjects"])


def _grow(part: pd.DataFrame, support: int, confidence: float) -> pd.DataFrame:
    """The rules of a group. No rule is compared with one of the greatest length, so such a rule is left out here
    if a shorter one of its group concludes the same as surely."""
    rows = list(grown(part["word"].iloc[0], list(part["before"]), list(part["subjects"]), support, confidence))
    sure = {(tuple(a), s): c for a, s, _, c in rows if len(a) < LONGEST}
    needed = [r for r in rows if len(r[0]) < LONGEST or all(r[3] > sure.get((p, r[1]), -1) + SURER for k in range(1, LONGEST) for p in combinations(r[0], k))]
    return pd.DataFrame(needed, columns=["antecedent", "subject", "support", "confidence"])


def pruned(found: DataFrame) -> DataFrame:
    """Of rules (antecedent, subject, confidence, ...) those that no rule of fewer of their words makes needless.
    The joins are merged, since Spark takes the exploded parts to be as few as the rules and would broadcast them."""
    subsets = F.expr("transform(sequence(1, cast(pow(2, size(antecedent)) as int) - 2), m -> filter(antecedent, (x, i) -> shiftright(m, i) % 2 = 1))")
    parts = found.where("size(antecedent) > 1").select("antecedent", "subject", F.explode(subsets).alias("part"))
    by = found.where(F.size("antecedent") < LONGEST).select(F.col("antecedent").alias("part"), "subject", F.col("confidence").alias("c"))
    best = parts.join(by.hint("merge"), ["part", "subject"]).groupBy("antecedent", "subject").agg(F.max("c").alias("shorter"))
    return found.join(best.hint("merge"), ["antecedent", "subject"], "left").where(F.col("shorter").isNull() | (F.col("confidence") > F.col("shorter") + SURER)).drop("shorter")


_RULES = "antecedent array<string>, subject string, support int, confidence double"


def mine(texts: DataFrame, most_labels: int, support: int, confidence: float) -> DataFrame:
    """(antecedent, subject, support, confidence): the pruned rules of labelled texts (doc_id, subjects, text).
    They are pruned where they were grown and stay a table; the driver sees none."""

    @F.pandas_udf("array<array<string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(sentence_words)

    sent = kept(spread(texts).select("doc_id", "subjects", F.posexplode(cut("text")).alias("no", "words")), "labelled-sentences")
    docs = texts.select("doc_id", "subjects")
    n = docs.count()
    if not n:
        return texts.sparkSession.createDataFrame([], _RULES)
    base = docs.select(F.explode("subjects").alias("subject")).groupBy("subject").agg((F.count(F.lit(1)) / n).alias("p"))
    held = sent.select("doc_id", "subjects", F.explode("words").alias("word")).distinct()
    total = held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    own = held.select("word", F.explode("subjects").alias("subject")).groupBy("word", "subject").agg(F.count(F.lit(1)).alias("k"))
    # an exploded table counts as no larger than what it came from, so Spark would broadcast it: these joins are merged
    keen = own.join(total.hint("merge"), "word").join(base.hint("merge"), "subject").where("k / n >= 1.5 * p and k / n >= 0.35").select("word", "n").distinct()
    tokens = sent.select("doc_id", "no", "subjects", F.explode("words").alias("word")).join(keen.hint("merge"), "word")
    # frequent words first, so that the groups of the frequent ones have little before them
    rank = F.struct((-F.col("n")).alias("r"), "word")
    baskets = tokens.groupBy("doc_id", "no").agg(F.transform(F.array_sort(F.collect_set(rank)), lambda x: x["word"]).alias("words"), F.first("subjects").alias("subjects"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        return _grow(part, support, confidence)

    grouped = baskets.select("words", "subjects").mapInPandas(_groups, "word string, before array<string>, subjects array<string>")
    found = kept(grouped.groupBy("word").applyInPandas(grow, _RULES), "rules-found")
    return kept(pruned(found), "rules")


def compiled(rules: dict[tuple[str, ...], list[tuple[str, float]]]) -> dict:
    """The rules as a tree by their words in order; what a path concludes stands under None."""
    root: dict = {}
    for a, said in rules.items():
        node = root
        for w in a:
            node = node.setdefault(w, {})
        node[None] = said
    return root


def _matching(node: dict, known: list[str], at: int) -> Iterator[tuple[str, float]]:
    """What the rules below a node conclude whose words are all among ``known``. Goes over the rules' next
    words or the sentence's, whichever are fewer."""
    yield from node.get(None, ())
    left = known[at:]
    if len(node) < len(left):
        place = {w: i for i, w in enumerate(left)}
        steps = [(place[w], w) for w in node if w is not None and w in place]
    else:
        steps = [(i, w) for i, w in enumerate(left) if w in node]
    for i, w in steps:
        yield from _matching(node[w], known, at + i + 1)


def surest(text: str | None, tree: dict, vocabulary: frozenset[str]) -> Iterator[tuple[int, str, float]]:
    """(no, subject, confidence): the best matching rule for each sentence of a text and each subject."""
    for no, ws in enumerate(sentence_words(text)):
        known = sorted(w for w in ws if w in vocabulary)
        best: dict[str, float] = {}
        for s, c in _matching(tree, known, 0) if known else ():
            if c > best.get(s, 0.0):
                best[s] = c
        for s, c in best.items():
            yield no, s, c


def evidence(text: str | None, tree: dict, vocabulary: frozenset[str]) -> dict[str, float]:
    """Summed confidence of each subject over the sentences of a text."""
    out: dict[str, float] = {}
    for _, s, c in surest(text, tree, vocabulary):
        out[s] = out.get(s, 0.0) + c
    return out


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    """Rules as the bytes of their tree and its words."""
    rules: dict[tuple[str, ...], list[tuple[str, float]]] = {}
    for a, s, c in zip(part["antecedent"], part["subject"], part["confidence"], strict=True):
        rules.setdefault(tuple(a), []).append((s, float(c)))
    return pd.DataFrame({"tree": [pickle.dumps((compiled(rules), frozenset(w for a in rules for w in a)))]})


@lru_cache(maxsize=1)
def _unpacked(tree: bytes) -> tuple[dict, frozenset[str]]:
    """Once for all tasks of a worker."""
    return pickle.loads(tree)


def scores(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, subject, score) of every document and subject with any evidence. The trees of the rules are
    made by tasks, and only their bytes pass through the driver, one tree at a time.

    Rules that fit one tree are summed in one pass. Else every part of them gives its best for each sentence,
    the best of all parts counts, and sums are in the order of the sentences: the same as with one tree."""
    parts = max(1, -(-rules.count() // MOST_RULES))
    packed = rules.groupBy(F.pmod(F.xxhash64("antecedent"), F.lit(parts)).alias("part")).applyInPandas(_packed, "tree binary")
    sc = docs.sparkSession.sparkContext
    trees = [sc.broadcast(bytes(r["tree"])) for r in packed.toLocalIterator()] or [sc.broadcast(pickle.dumps(({}, frozenset())))]
    d = spread(docs.select("doc_id", "text").where("text is not null"))
    if len(trees) == 1:
        return d.select("doc_id", F.explode(_summed(trees[0])("text")).alias("e")).select("doc_id", "e.*")
    # the place of a text in its partition tells apart texts that share an id
    told = kept(d.withColumn("at", F.monotonically_increasing_id()), "texts")
    every = [told.select("doc_id", "at", F.explode(_by_sentence(t)("text")).alias("e")).select("doc_id", "at", "e.*") for t in trees]
    hits = every[0]
    for x in every[1:]:
        hits = hits.unionByName(x)
    best = hits.groupBy("doc_id", "at", "subject", "no").agg(F.max("c").alias("c"))
    said = best.groupBy("doc_id", "at", "subject").agg(F.array_sort(F.collect_list(F.struct("no", "c"))).alias("said"))
    return said.select("doc_id", "subject", F.aggregate("said", F.lit(0.0), lambda x, y: x + y["c"]).alias("score"))


def _summed(sent: Broadcast) -> Callable[[str], Column]:
    @F.pandas_udf("array<struct<subject:string,score:double>>")
    def run(s: pd.Series) -> pd.Series:
        r, v = _unpacked(sent.value)
        return s.map(lambda t: [{"subject": k, "score": x} for k, x in sorted(evidence(t, r, v).items())])

    return run


def _by_sentence(sent: Broadcast) -> Callable[[str], Column]:
    @F.pandas_udf("array<struct<no:int,subject:string,c:double>>")
    def run(s: pd.Series) -> pd.Series:
        r, v = _unpacked(sent.value)
        return s.map(lambda t: [{"no": no, "subject": k, "c": c} for no, k, c in surest(t, r, v)])

    return run


def isotonic(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Probabilities of ordered bins with n cases and k hits that never fall (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, b in zip(n, k, strict=True):
        blocks.append([float(a), float(b), 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    return np.concatenate([[b / a] * int(m) for a, b, m in blocks]) if blocks else np.array([])


STEP = 0.2


def calibrate(scored: DataFrame, labelled: DataFrame) -> list[tuple[float, float]]:
    """(score from, probability), in order of score; scores are put into bins of ``STEP``."""
    hit = F.array_contains("subjects", F.col("subject")).cast("int")
    bins = scored.join(labelled, "doc_id").groupBy(F.least(F.floor(F.col("score") / STEP), F.lit(500)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("k"))
    rows = sorted(tuple(r) for r in bins.collect())  # 501 rows at most
    if not rows:
        return []
    b, n, k = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    return list(zip((b * STEP).tolist(), isotonic(n, k).tolist(), strict=True))


def assign(docs: DataFrame, labels: DataFrame, most_labels: int = 100_000, support: int = 3, confidence: float = 0.4, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, subject, score, probability) of all assignments; and the scores behind them."""
    chosen = kept(resolved(labels, most_labels).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0), "labels")
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen.where("not held").drop("held"), "doc_id")
    rules = mine(texts, most_labels, support, confidence)
    scored = kept(scores(docs, rules), "scores")
    steps = calibrate(scored, chosen.where("held").drop("held"))
    # one flat choice, the highest score first; where the probability does not rise no step is needed
    rises = [x for k, x in enumerate(steps) if not k or x[1] > steps[k - 1][1]]
    p = F.lit(0.0)
    for k, (at, prob) in enumerate(reversed(rises)):
        p = (F if not k else p).when(F.col("score") >= F.lit(at - 1e-9), F.lit(prob))
    p = p.otherwise(F.lit(0.0)) if rises else p
    return scored.withColumn("probability", p).where(F.col("probability") >= least), scored
