"""Part-of-speech taggers: one tag for every token that is no white space, batch by batch.

A tagger is any callable from a batch of sentences, each a list of words, to a batch of tag lists. It
is sent to the workers once and called with one Arrow batch at a time, so a costly model is loaded
once per worker by a tagger that does so at its first call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

Tagger = Callable[[Sequence[Sequence[str]]], Sequence[Sequence[str]]]
#: The tag of white space, which no tagger sees.
BLANK = "WS"
# Tags of verbs, and of the nouns and adjectives a doubtful verb is read as.
VERBS = ("VB", "VBD", "VBP", "VBZ")
RESCUED_AS = ("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS")
#: How probable a noun or adjective must be for a verb to be read as one.
RESCUE = 0.03


def untagged(batch: Sequence[Sequence[str]]) -> list[list[str]]:
    """Every tag is ''."""
    return [[""] * len(words) for words in batch]


@dataclass(frozen=True)
class LexiconTagger:
    """Tags by the probabilities a lexicon gives a word, {word: {tag: probability}}. The likeliest
    holds, but 'to' is TO, and a verb is read as its likeliest noun or adjective from ``rescue`` on."""

    lexicon: dict[str, dict[str, float]] = field(default_factory=dict)
    default: str = "NN"
    rescue: float | None = RESCUE

    def tag(self, word: str) -> str:
        w = word.lower()
        if w == "to":
            return "TO"
        odds = self.lexicon.get(w)
        if not odds:
            return self.default
        best = max(sorted(odds), key=odds.__getitem__)
        if self.rescue is not None and best in VERBS:
            other = max((t for t in sorted(odds) if t in RESCUED_AS), key=odds.__getitem__, default=None)
            if other and odds[other] >= self.rescue:
                return other
        return best

    def __call__(self, batch: Sequence[Sequence[str]]) -> list[list[str]]:
        return [[self.tag(w) for w in words] for words in batch]


def tags_of(batch: list[list[str]], tagger: Tagger, blank: Callable[[str], bool]) -> list[list[str]]:
    """Tags aligned with all tokens of a batch; white space is WS; another number of tags than of
    words is an error."""
    words = [[t for t in tokens if not blank(t)] for tokens in batch]
    given = tagger(words)
    if len(given) != len(batch) or any(len(g) != len(w) for g, w in zip(given, words)):
        raise ValueError("a tagger must give one tag per token")
    out = []
    for tokens, tags in zip(batch, given):
        it = iter(tags)
        out.append([BLANK if blank(t) else next(it) for t in tokens])
    return out
