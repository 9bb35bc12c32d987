"""Sentence boundaries across languages and scripts.

A pushdown automaton goes once over a text, from one character that matters to the next: sentence
marks, line ends, brackets, quotation marks. Its stack holds the open brackets and quotations; marks
inside them end nothing, unless the quotation or bracket is itself the whole unit. What a full stop
means is decided by a trie of abbreviations read backwards from the stop, by what follows, and by
the script: letters without case have no capitals to wait for, and Thai, which has no marks at all,
is cut at spaces between Thai letters.

Defined cases: null, empty and blank texts have no units; a line without final mark (heading, list
item) is a unit, a line that only was wrapped is not; a blank line ends any unit, whatever is open;
an opening mark that is never closed before the next blank line opens nothing; positions are code
points of the text as stored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

#: Abbreviations that are followed by what they belong to, so a stop after them ends nothing.
BOUND = """mr mrs ms dr prof rev hon gen sgt capt st fig figs tab tabs eq no nr nos vol ch sec p pp art cf vs e.g i.e approx ca circa resp temp wt ht dx hx rx tx sx neg pos incl excl spec spp sp al viz
vgl abb bd hr fr frau z.b d.h u.a s bzw ggf evtl inkl zzgl geb pat med str jh
m mm mme mlle me pr c.-à-d p.ex ex env chap éd réf
sr sra srta dra dn dña p.ej ej pág págs núm tel av avda cf c
см стр рис табл т.е т.к т.н напр им проф доц акад д-р г ул кв ред ср ок exmo exma fls séc
د أ م ص""".split()
#: Abbreviations that may also stand at the end of a sentence.
LOOSE = """etc p.m a.m hrs hr min sec in ft yd oz lb lbs cm mm mg ml kg kcal q.i.d b.i.d t.i.d q.d o.d p.r.n q.6h q.4h q.8h o.k u.s u.k u.s.a inc ltd co corp jr ave rd blvd dept est av
jan feb mar apr jun jul aug sep sept oct nov dec usw u.s.w std tägl min m.w.z
и др и т.д т.д и т.п т.п и пр др пр руб тыс млн ч мин сек р.м""".replace("и др", "др").replace("и т.д", "т.д").replace("и т.п", "т.п").replace("и пр", "пр").split()
#: Of these, those a number may follow in a new sentence.
CLOSED = set("etc usw o.k hrs др пр q.i.d b.i.d t.i.d q.6h q.4h q.8h rd ave".split())
#: Units that end a sentence after their number.
MEASURES = set("m g l h s mm cm km kg mg µg μg ml dl nm hz kcal mmol mmhg м г см мм кг мг мл".split())
MONTHS = set("""january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec januar februar märz mai juni juli oktober dezember jänner okt dez tag tage tages woche monat jahr jahrestag lebensjahr jahrhundert quartal stock grad mal klasse auflage schwangerschaftswoche""".split())
#: Words whose single letter or number is a label and not an initial.
LABELS = set("arm type group grade class stage ward bed row vitamin hepatitis plan part section appendix option level zone unit form version gruppe klasse typ grupo tipo grade braço".split())
#: Words that do not end a line of their own.
RUNNING = set("""the a an and or of in on at to for with by from as is was were are be been no not than that this which who it he she they his her its their our into per via about over under near was has had have did does do mr mrs
le la les un une des du de d et ou à au aux en dans par pour sur sous avec sans que qui se sa son ses est a été
el los las una unos y o del al con sin por para según su sus es fue
der die das ein eine einen einem einer und oder von vom zu zum zur mit bei auf aus nach für im in am ist war wird
o os as um uma e do da dos das no na nos nas com sem pelo pela ao à
и в на с со к по за от до из у о об не что как""".split())
#: Words a number belongs to.
NUMBERED = set("rose fell ranged range ratio version room score scored given weight height units about around nearly until since week weeks day year age aged grade stage type part page line lines chapter figure table reste reçu erhielt gegen etwa recibió duró".split())
GERMAN = {"der", "die", "das", "und", "ist", "war", "nicht", "eine", "ein", "bei", "auf", "nach", "fühlte", "ließ", "lag", "wurde", "hat", "des", "am", "sie", "sich", "mehr", "vom"}

GERMAN_PLAIN = {"der", "und", "ist", "ein", "eine", "bei", "halbe"}
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", '"': '"', "‹": "›"}
QUOTES = set("「『«“„\"‹")
CLOSERS = set(")]}）」』】》〉»”\"›")
_EVENT = re.compile(r'[.?!…。！？｡।॥؟۔\r\n()\[\]{}（）「」『』【】《》〈〉«»“”„"‹›]|(?<=[฀-๿]) +(?=[฀-๿])')
_BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t ]*(?:\r\n|\r|\n)")
_MARK = set(".?!…。！？｡।॥؟۔")
_BULLET = re.compile(r"(?:[-*•‣◦▪·–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+\S")
#: A run of characters longer than any word is judged by so many of them.
LONGEST_WORD = 200
_TOKEN = re.compile(rf"\S{{1,{LONGEST_WORD}}}")
_WORD = re.compile(rf"[\w'’\-]{{1,{LONGEST_WORD}}}")
_MAIL = re.compile(r"\S@\S|\[at\]|\(at\)|\[dot\]")


class Trie:
    """Words read from their last letter."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def before(self, text: str, stop: int) -> int:
        """The start of the longest word of the trie that ends before ``stop``, or -1. A space after
        an inner full stop is skipped (``z. B.``)."""
        node, i, best = self.root, stop - 1, -1
        while True:
            if "" in node and (i < 0 or not (text[i].isalnum() or text[i] in "@/\\_")):
                best = i + 1
            if i < 0:
                return best
            c = text[i].lower()
            if c not in node:
                if c in "   \n" and "." in node and i and text[i - 1] == ".":
                    i -= 1
                    continue
                return best
            node, i = node[c], i - 1


@lru_cache(maxsize=1)
def tries() -> tuple[Trie, Trie]:
    return Trie(BOUND), Trie(LOOSE)


_CLOSE = CLOSERS | {"“"}


def _matches(text: str, lo: int, hi: int) -> dict[int, int]:
    """Positions of opening marks with their closing ones within a paragraph."""
    stack: list[tuple[str, int]] = []
    waited: dict[str, int] = {}  # how many open marks a closing one would end
    out: dict[int, int] = {}
    for m in _EVENT.finditer(text, lo, hi):
        c, i = m.group(0), m.start()
        if c in _CLOSE and waited.get(c):
            while stack:
                o, at = stack.pop()
                waited[PAIRS[o]] -= 1
                if PAIRS[o] == c:
                    out[at] = i
                    break
        elif c in PAIRS:
            if c == '"' and not text[i + 1 : i + 2].strip():
                continue
            stack.append((c, i))
            waited[PAIRS[c]] = waited.get(PAIRS[c], 0) + 1
        elif c == "”" and stack and stack[-1][0] == "„":
            waited["“"] -= 1
            out[stack.pop()[1]] = i
    return out


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _starts(text: str, i: int, hi: int) -> bool:
    """Whether what begins at ``i`` can begin a sentence: a capital, an opening mark, a digit, a
    letter without case, or a word with a capital inside (pH, mRNA)."""
    c = text[i]
    if c in "—–-,;:)]}/&%":
        return False
    if c.isalpha():
        if not _cased(c) or c.isupper() or c.istitle():
            return True
        m = _WORD.match(text, i, hi)
        w = m.group(0) if m else ""
        return any(x.isupper() for x in w[1:]) and w.isalpha()
    return True


def _dotted(text: str, i: int) -> bool:
    return bool(re.match(r"(?:[a-z]\.){2,}\s", text[i : i + 12]))


def _last_word(text: str, lo: int, i: int) -> str:
    j, least = i, max(lo, i - LONGEST_WORD)
    while j > least and not text[j - 1].isspace() and text[j - 1] not in "(（«“„「\"":
        j -= 1
    return text[j:i]


def _tail(text: str, lo: int, i: int, most: int = 2) -> list[str]:
    """The last words before ``i``, at most so many."""
    out: list[str] = []
    while len(out) < most:
        while i > lo and text[i - 1].isspace():
            i -= 1
        if i <= lo:
            break
        end, least = i, max(lo, i - LONGEST_WORD)
        while i > least and not text[i - 1].isspace():
            i -= 1
        out.append(text[i:end])
    return out[::-1]


class _Unit:
    """What the words of the open unit say of its language, read on from where it was read to."""

    lo = upto = -1
    plain = other = False

    def german(self, text: str, lo: int, i: int) -> bool:
        if lo != self.lo or i < self.upto:
            self.lo, self.upto, self.plain, self.other, self.beyond = lo, lo, False, False, False
        piece = text[self.upto : i]
        self.upto = i
        self.beyond = self.beyond or not piece.isascii()
        for x in piece.split():
            w = x.lower()
            self.plain = self.plain or w in GERMAN_PLAIN
            self.other = self.other or w.strip(".,„“") in GERMAN
        return self.plain or self.other and self.beyond


def _stop_ends(text: str, lo: int, i: int, nxt: int, hi: int) -> bool:
    """Whether the single full stop at ``i`` ends the unit that began at ``lo``; the next character
    that is not blank is at ``nxt`` (``hi`` at the end)."""
    p = text[i - 1] if i > lo else ""
    if nxt >= hi:
        return True
    gap = nxt > i + 1
    n = text[nxt]
    if not gap:
        if n in CLOSERS or n in _MARK:
            return True
        word = _last_word(text, lo, i)
        if not (n.isalpha() and p.isalnum()):
            return False
        if not _cased(n):
            return ord(n) > 0x590
        after = _TOKEN.match(text, nxt).group(0)
        return n.isupper() and after[1:2].islower() and "." not in after.rstrip(".") and "." not in word and "@" not in word + after and len(word) > 2 and word.islower()
    if not p or p.isspace() or p in "(（":
        return False
    word = _last_word(text, lo, i)
    bound, loose = tries()
    if word.isdigit():
        if i - len(word) <= lo:
            return False  # a number before a list item
        m = _WORD.match(text, nxt, hi)
        w = m.group(0) if m else ""
        if len(word) <= 2 and w.lower() in MONTHS:
            return False
        before = text[max(lo, i - len(word) - 8) : i - len(word)].split()
        if before and before[-1].lower() in ("no.", "nr.", "fig.", "tab.", "figs.", "abb."):
            return n not in ",;:)—–-"
        return _starts(text, nxt, hi) and n not in "º°" or _dotted(text, nxt)
    before_it = text[max(lo, i - len(word) - 12) : i - len(word)].split()
    if n.isdigit() and word.lower().endswith(("nr", "no", "nº")):
        return False
    if word[:1] in "°º" or word[:-1].isdigit() or word in MEASURES and before_it and before_it[-1][-1:].isdigit():
        return _starts(text, nxt, hi) or _dotted(text, nxt)  # a unit of measurement
    at = loose.before(text, i)
    if at >= 0:
        return _starts(text, nxt, hi) and (not n.isdigit() or text[at:i].lower() in CLOSED)
    at = bound.before(text, i)
    if at >= 0:
        w = text[at:i].lower()
        prev = _tail(text, lo, at)
        before = prev[-1] if prev else ""
        if w == "st" and before[:1].isupper() and len(prev) > 1 and not before.endswith("."):
            return _starts(text, nxt, hi)  # Marrowgate St.
        if w == "no":
            return not (n.isdigit() or n.isupper() and any(x.isdigit() for x in text[nxt : nxt + 8]))
        if w in ("in", "al", "sec"):
            return False
        if len(w) == 1 and before.lower() in LABELS:
            return _starts(text, nxt, hi)
        if len(w) == 1 and before.endswith("º"):
            return True
        return False
    core = word.strip("([«“„\"'")
    if len(core) == 1 and core.isalpha():
        prev = (_tail(text, lo, i - 1, 1) or [""])[0]
        if prev.lower() in LABELS or prev.endswith("º"):
            return _starts(text, nxt, hi)
        return not _cased(core) and not n.isdigit()
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", core):  # an unknown dotted abbreviation
        return _starts(text, nxt, hi) and n.isupper()
    if n.isalpha() and _cased(n) and n.islower() and not _dotted(text, nxt) and not _starts(text, nxt, hi):
        return len(core) >= 4 or core[-1:].isdigit() or not core.isalpha()
    return n not in ",;:)—–-"


def _line_ends(text: str, lo: int, i: int, nxt: int, hi: int, unit: _Unit) -> bool:
    """Whether a line break at ``i`` inside an unfinished unit ends it, or only wraps its line."""
    if nxt >= hi:
        return True
    if _BULLET.match(text, nxt, hi) and not (text[nxt].isalpha() and text[nxt + 1] == "."):
        return True
    n, p = text[nxt], text[i - 1]
    if "฀" <= p <= "๿" and "฀" <= n <= "๿":
        return True
    wide = lambda c: "　" <= c <= "鿿" or "！" <= c <= "￮"
    if wide(p) and wide(n):
        return p not in "、，"
    if n.isalpha() and not _cased(n):
        return False
    token = _last_word(text, lo, i)
    word = token.strip(".,;:()").lower()
    if token.endswith((",", ";", "—", "–", "-", ":")) and not token.endswith(":"):
        return False
    if _MAIL.search(token) or (len(word) >= 5 and sum(c.isdigit() for c in word) >= 4):
        return not (n.isalpha() and n.islower())
    if n.isalpha() and n.islower() and not _starts(text, nxt, hi) and not _dotted(text, nxt) or n in "°%)]»,;" or not (n.isalpha() or n in QUOTES or n in "([¿¡+" or n.isdigit()):
        return False
    if (n.isdigit() or n in "+(") and (not word.isalpha() or len(word) < 4 or word in RUNNING or word in NUMBERED or token[:1].isupper()):
        return False
    if token.endswith("."):
        return False  # a stop that did not end the sentence: an abbreviation
    if not word or word in RUNNING or word[-1].isdigit() or len(word) <= 2:
        return False
    if token[:1].isupper() and i - len(token) > lo:
        return False
    m = _TOKEN.match(text, nxt, hi)
    w = m.group(0) if m else ""
    if re.fullmatch(r"\w\.|[IVX]+[.,]?", w) or tries()[0].before(w, len(w.rstrip("."))) >= 0 and w.endswith(".") and w.lower().strip(".") in ("no", "fig", "tab", "abb", "s", "p"):
        return False
    return not unit.german(text, lo, i)


def _after_fragment(text: str, lo: int, i: int) -> bool:
    """Whether the unit so far is a label with an address or number, which carries no final mark."""
    head = text[lo:i]
    if len(head) > 120:
        return False
    return bool(re.fullmatch(r"(?:[\w.\-'’°º]+ ?){1,4}[:.]? ?(?:\S+@\S+|\S+ ?[\[(]at[\])] ?\S+(?: ?\[dot\] ?\S+)*)", head)) or bool(re.fullmatch(r"[\w ]{2,20}(?:no|nr|n[.º°]+)\. ?[A-Z]{0,3}[\d\- ]{5,14}[A-Z]?|[\w ]{2,20}(?:no|nr)\. ?[A-Z]{3}[\d\-]{6,12}", head))


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text, without the blanks around it."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    lo = 0
    for m in [*_BLANK.finditer(text), None]:
        hi = m.start() if m else len(text)
        if hi > lo:
            _paragraph(text, lo, hi, out)
        lo = m.end() if m else hi
    return out


def _paragraph(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    closing = _matches(text, lo, hi)
    stack: list[tuple[int, int]] = []  # (open at, close at)
    unit = _Unit()
    start = lo

    def skip(i: int) -> int:
        while i < hi and text[i].isspace():
            i += 1
        return i

    def end(i: int) -> None:
        nonlocal start
        stop = i
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            out.append((start, stop))
        start = skip(i)
        stack.clear()

    start = skip(lo)
    at = start
    while at < hi:
        m = _EVENT.search(text, at, hi)
        if not m:
            break
        i, c = m.start(), m.group(0)
        at = m.end()
        while stack and stack[-1][1] < i:
            stack.pop()
        if i < start:
            continue
        if c in closing_chars(text, stack, i):
            opened, _ = stack.pop()
            if stack:
                continue
            j = at
            nxt = skip(j)
            if nxt < hi and text[nxt] in _MARK and nxt == j:
                continue  # the mark that follows decides
            k = i - 1
            while k > opened and text[k].isspace():
                k -= 1
            marked = text[k] in _MARK
            if not marked:
                continue
            alone = opened <= start
            wide = text[i] in "」』）》】" or text[k] in "。！？｡"
            if nxt >= hi:
                end(j)
            elif wide:
                if "\n" in text[j:nxt] or "\r" in text[j:nxt] or (not alone and text[opened] in QUOTES and text[nxt] not in "とって、，") or (alone and (text[nxt] in PAIRS or text[opened] not in QUOTES)):
                    end(j)
                    at = max(at, start)
            elif text[opened] in QUOTES or alone:
                if _starts(text, nxt, hi) and (nxt > j or text[nxt].isupper()):
                    end(j)
                    at = max(at, start)
            continue
        if c in PAIRS and i in closing:
            stack.append((i, closing[i]))
            continue
        if stack:
            continue
        if c in "\r\n":
            nxt = skip(i)
            if i > start and _line_ends(text, start, i, nxt, hi, unit):
                end(i)
                at = max(at, start)
            continue
        if c[0] == " ":
            end(i)
            continue
        if c not in _MARK:
            continue
        j = i
        while j < hi and text[j] in _MARK:
            j += 1
        run = text[i:j]
        while j < hi and text[j] in CLOSERS and j not in closing:
            j += 1
        nxt = skip(j)
        if c in "。！？｡।॥؟۔":
            if c in "؟۔" and nxt == j and nxt < hi and text[nxt].isdigit():
                continue
            end(j)
        elif run == ".":
            if c == "." and i + 1 < hi and text[i + 1].isdigit():
                continue
            if _stop_ends(text, start, i, nxt, hi):
                end(j)
        elif set(run) <= {".", "…"}:
            if nxt >= hi or nxt > j and _starts(text, nxt, hi) and not text[nxt].isdigit():
                end(j)
        elif nxt >= hi or nxt > j or text[nxt].isupper() or text[nxt] in PAIRS:
            if not (nxt < hi and text[nxt] in "—–,;"):
                end(j)
        at = max(j, start)
    if start < hi:
        end(hi)


def closing_chars(text: str, stack: list[tuple[int, int]], i: int) -> str:
    return text[i] if stack and stack[-1][1] == i else ""


def starts(text: Column) -> Column:
    """array<int>: where the units of a text start."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [a for a, _ in split(t)])

    return run(text)


def split(text: str | None) -> list[tuple[int, int]]:
    """``units``, with unmarked labels (an address or number after its cue) set apart."""
    out = []
    for a, b in units(text):
        for m in re.finditer(r"[ \t]+(?=[¿¡«“„(]|[A-ZÀ-Þ][\w.’']|\d+ [a-z])", text[a : min(b, a + 120)]):
            if _after_fragment(text, a, a + m.start()):
                out.append((a, a + m.start()))
                a = a + m.end()
                break
        out.append((a, b))
    return out


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, unit): a row for every unit of every text, each once."""

    @F.pandas_udf("array<struct<start_pos:int,unit:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start_pos": a, "unit": t[a:b]} for a, b in split(t)])

    rows = spread(df.select(F.col(key), F.col(text).alias("text")).where("text is not null"))
    return rows.select(key, F.explode(run("text")).alias("u")).select(key, "u.start_pos", "u.unit").distinct()
