"""Personal information inside free text, by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one go: at-signs and their spelled-out
forms, digits and plus signs, titles, and words that announce a person, a number or an address.
Around each anchor a small deterministic parser expands to the left and right and validates what it
read; overlaps are settled by type and length. Types: email, phone, id, address, name.

Capitals say nothing in a text written in capitals, so parsers work on words and accept any case
where a cue announces the value. A name is taken after a title, after or before a cue that asks for
a person, before a verb phrase only persons have, or as authors cited; a disease, sign, test, ward
or street named after someone has no such cue.

Reach of the parsers, all of them bounds on one case and not on a text: a street stands within 70
characters before and 90 after its number, a cue within 32 before a number, a name has five words.

Defined cases: null, empty and blank texts have no cases; texts are read whole, whatever their
length; positions are code points of the text as stored; of repeated rows each case counts once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

Span = tuple[str, int, int]

TITLES = "mr mrs ms miss dr prof sr sra srta dra dott mme mlle herr frau hr fr señor señora".split()
#: Titles that are only ones with their full stop or in this case, so that words are not taken for them.
STRICT_TITLES = ("M.", "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sr", "Sra", "Srta", "Dra", "Mme", "Mlle", "Herr", "Frau", "Hr.", "Fr.", "MR", "MRS", "MS", "DR", "PROF", "SR", "SRA", "DRA", "mr.", "mrs.", "ms.", "dr.", "prof.", "Don", "Doña")
#: What comes right before a person's name.
NAME_BEFORE = (
    "patient", "next of kin", "the carer,", "carer:", "please reach", "reach", "according to", "contact person", "signed by", "seen by", "named", "name:", "name is", "dear",
    "selon", "joindre", "dossier de", "patiente", "nommé", "nom :", "nom:", "signé",
    "laut", "bitte", "akte", "patientin", "name ist", "gez.",
    "según", "llamar a", "ficha de", "paciente", "nombre:", "firmado por",
    "segundo", "ligar para", "processo de", "nome:",
)
#: What comes right after a person's name.
#: More of these that are plain words elsewhere: only full names in capital case are taken after them.
NAME_NEAR = (
    "spoke with", "spoke to", "speak to", "talked to", "talked with", "met with", "meeting with", "contact", "regards,", "sincerely,", "thanks,", "wishes,", "phone for", "ask for", "written by", "prepared by", "reviewed by", "examined by", "referred by", "accompanied by", "daughter of", "son of", "wife of", "husband of", "my name is", "this is", "attn:", "from:", "to:", "cc:", "author:", "nurse", "doctor", "physician", "surgeon", "for",
    "s'appelle", "m'appelle", "appeler", "contacter", "parlé avec", "cordialement,", "de la part de", "écrit par", "infirmière", "docteur",
    "heißt", "heiße", "gesprochen mit", "kontakt:", "ansprechpartner", "grüßen", "grüße,", "verfasst von", "untersucht von", "überwiesen von",
    "se llama", "me llamo", "hablé con", "contactar con", "contactar a", "saludos,", "atentamente,", "escrito por", "examinado por",
    "chama-se", "falei com", "contactar", "cumprimentos,", "escrito por",
)
#: Words a sentence may begin with and that stand in capitals after such a cue, but in no name.
PLACES = set("hospital clinic centre center university school department institute street road avenue ward unit office service services group company ltd inc north south east west saint january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday syndrome disease test score sign scale criteria classification type grade stage study trial protocol committee council ministry city county state country".split())
NAME_AFTER = ("lives at", "lives in", "can be called", "can be reached", "was informed", "gave consent", "et al", "wohnt", "habite", "vive en", "mora na", "mora em")
ID_BEFORE = (
    "id", "id:", "identity card", "identity no.", "insurance no.", "insurance number", "passport no.", "passport", "ssn", "ssn:", "nhs no.", "mrn", "record no.", "patient no.",
    "versichertennr.", "versichertennummer", "ausweisnr.", "personalausweis", "patientennr.",
    "n° d'assuré", "nº d'assuré", "numéro d'assuré", "n° de sécurité sociale", "carte d'identité",
    "n.º de identidad", "nº de identidad", "n.° de identidad", "número de identidad", "documento de identidad", "dni", "nie", "n.º de utente", "número de utente",
)
PHONE_BEFORE = ("ring", "dial", "tel", "tel.", "tel:", "phone", "call", "called on", "number on file:", "contact number", "fax", "mobile", "joindre", "au", "unter", "anrufen", "llamar", "al", "telefon", "téléphone", "teléfono", "line")
ADDRESS_BEFORE = ("mail the form to", "lives at", "resides at", "address:", "part au", "part à", "adresse :", "habite au", "habite", "geht an", "wohnt in der", "wohnt", "adresse:", "la carta a", "vive en", "dirección:", "endereço:", "mora na")
STREETS_EN = "street st road rd avenue ave lane ln row crescent cres close drive dr way place pl court ct square sq terrace grove gardens hill park mews walk boulevard blvd bank green parade rise view highway".split()
STREETS_ROMANCE = "rue avenue boulevard place impasse chemin allée route quai cours square passage calle plaza plaça avenida avda paseo camino carretera ronda travesía glorieta c/ av rua praça travessa estrada largo via viale piazza".split()
STREETS_DE = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "grund", "hof", "steig", "pfad", "chaussee", "markt", "graben", "berg", "tal")
GERMAN_PREPOSITIONS = ("am", "an der", "an den", "auf der", "auf dem", "im", "in der", "in den", "zum", "zur", "unter den", "hinter der", "hinter dem", "vor dem", "alte", "alter", "neue", "obere", "untere", "lange")
PARTICLES = {"de", "la", "du", "des", "del", "van", "von", "der", "den", "zu", "da", "dos", "das", "di", "le", "los", "las", "el", "al", "bin", "ibn", "ten", "ter", "af", "av"}
#: Words that never are part of a name, though a cue may stand before them.
NOT_NAMES = set("""the a an this that these those his her their its our your my who which what when where there here all any each every no not only with without from into under after before during since until was were is are be been has have had will would can could may might must shall should do does did and or but if then so as at by for in of on to up it he she they we you i
le la les un une des du au aux ce cet cette ces il elle on nous vous tout tous toute mais ou et donc or ni car selon si
der die das ein eine einen einem er sie es wir ihr und oder aber wenn alle beide dies diese dieser bitte nicht noch auch
el los las una unos este esta estos él ella nos todo todos y o pero si
patient patients kin carer doctor nurse name names note notes file form card identity insurance number contact reply mail email address leaflet staff family mother father mr mrs ms dr prof board team ward unit section table figure
in-hours""".split())

_NAME = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_WORD = re.compile(_NAME)
_INITIAL = re.compile(r"[^\W\d_]\.")
_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_AT = r"(?:@|\s?[\[(]\s?(?:at|AT|At|arroba|@)\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|DOT|punto|point|punkt)\s?[\])]\s?)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_ATSIGN = re.compile(_AT)
_NUMBER = re.compile(r"\+?\(?\+?\d(?:[  ()\-/‑]{0,3}\d|\.\d)*")


@lru_cache(maxsize=1)
def automaton():  # noqa: ANN201
    """The anchors of all types; keys are lower case, values (kind, key)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}

    def put(kind: str, keys) -> None:  # noqa: ANN001
        for k in keys:
            kinds.setdefault(k.lower(), set()).add(kind)

    put("mail", ("@", "[at]", "(at)", "[ at ]", "( at )", "[arroba]"))
    put("digit", "0123456789")
    put("title", {t.lower().rstrip(".") for t in STRICT_TITLES})
    put("before", NAME_BEFORE)
    put("near", NAME_NEAR)
    put("after", NAME_AFTER)
    put("id", ID_BEFORE)
    put("street", (*(f" {w}" for w in STREETS_EN), *STREETS_ROMANCE, *STREETS_DE, *(f"{p} " for p in GERMAN_PREPOSITIONS)))
    for k, v in kinds.items():
        a.add_word(k, (k, tuple(sorted(v))))
    a.make_automaton()
    return a


def _edge(text: str, i: int) -> bool:
    """Whether a word may begin at ``i`` or end before it."""
    return i <= 0 or i >= len(text) or not (text[i - 1].isalnum() and text[i].isalnum())


# --- parsers ---------------------------------------------------------------------------------------


def _email(text: str, i: int) -> tuple[int, int] | None:
    """Around an at-sign, plain or spelled out."""
    m = (_ATSIGN.match(text, i - 1) if i and text[i - 1].isspace() and text[i] != "@" else None) or _ATSIGN.match(text, i)
    if not m:
        return None
    a = m.start()
    while a and text[a - 1] in _LOCAL:
        a -= 1
    local = text[a : m.start()].lstrip(".-'/*")
    a = m.start() - len(local)
    d = _DOMAIN.match(text, m.end())
    if not local or local.endswith(".") or ".." in local or not d:
        return None
    end = d.end()
    parts = re.split(_DOT, d.group(0))
    while len(parts) > 1 and not (parts[-1].isalpha() and len(parts[-1]) >= 2):
        parts.pop()
        cut = [x.start() for x in re.finditer(_DOT, text[d.start() : end])]
        end = d.start() + cut[-1]
    if len(parts) < 2:
        return None
    return a, end


def _cued(text: str, i: int, cues: tuple[str, ...], reach: int = 32) -> bool:
    head = text[max(0, i - reach) : i].lower().rstrip(" \t\n\r:,.(")
    return any(head.endswith(c.rstrip(".:,")) and _edge(head, len(head) - len(c.rstrip(".:,"))) for c in cues)


def _phone(text: str, a: int, b: int) -> tuple[int, int] | None:
    """A run of digits and separators read as a phone number."""
    s = text[a:b].rstrip(" .-/(")
    if s.count("(") != s.count(")"):
        s = s.rstrip("()") if s.count("(") != s.count(")") and s[-1] in "()" else s
    b = a + len(s)
    digits = re.sub(r"\D", "", s)
    groups = re.findall(r"\d+", s)
    if not 9 <= len(digits) <= 15 or (b < len(text) and (text[b].isalpha() or text[b] in "@°%º")) or (a and (text[a - 1].isalnum() or text[a - 1] in "-/@.,_+#")):
        return None
    if re.fullmatch(r"\d{1,2}[./\-]\d{1,2}[./\-]\d{4}(?:[ /\-].*)?|\d{4}-\d{2}-\d{2}(?: .*)?", s):
        return None
    plus = s.startswith(("+", "(+", "00"))
    trunk = s.lstrip("(").startswith("0")
    bracketed = re.match(r"\(\d{2,5}\)", s)
    shape = re.fullmatch(r"\(?[2-9]\d\d\)?[ .\-]?[2-9]\d\d[ .\-]?\d{4}", s)
    nine = len(digits) == 9 and digits[0] in "6789" and re.fullmatch(r"\d{3}(?:[ .\-]?\d{2}){3}|\d{3} \d{4} \d{2,3}|\d{3} \d{3} \d{3}|\d{3}[ .\-]\d{6}|\d{9}|\d{3} \d{4} ?\d{2,3}", s)
    cue = _cued(text, a, PHONE_BEFORE)
    ten = len(digits) == 10 and (cue or text[b : b + 30].lower().lstrip().startswith(("is the", "ist", "anrufen")))
    if plus and len(digits) >= 10 or trunk and (len(groups) > 1 or cue or len(digits) >= 10) or bracketed or shape and (len(groups) > 1 or ten) or ten or cue and (nine or len(digits) >= 9):
        return a, b
    return None


_ID = re.compile(r"[A-Za-z]{1,4}[\- ]?\d(?:[\d \-]*\d)?(?: ?[A-Za-z](?![\w]))?|\d(?:[\d \-./]*\d)?(?: ?[A-Za-z](?!\w))?")
#: Shapes that are identity numbers without a cue: two letters and digits with a check letter, a
#: social security number, a record number, eight digits and a letter.
_ID_SHAPES = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|(?:MRN|NHS|SSN|PID|HC)-?\d{4}-?\d{4}|\d{3}-\d{2}-\d{4}|\d{8}[A-HJ-NP-TV-Z]|[XYZ]{1,2}\d{7}[A-Z]?")


def _id_after(text: str, i: int) -> tuple[int, int] | None:
    """The number announced by a cue that ends at ``i``."""
    m = re.compile(r"\s*[:#]?\s*").match(text, i)
    j = m.end()
    x = _ID.match(text, j)
    if not x:
        return None
    s = x.group(0)
    digits = sum(c.isdigit() for c in s)
    # a trailing capital belongs only to a number without words after it
    if not 6 <= digits <= 14:
        return None
    end = x.end()
    tail = text[end - 1]
    if tail.isalpha() and end >= 2 and text[end - 2] == " " and end < len(text) and text[end : end + 1] == ".":
        end -= 2
    return j, end


def _token_before(text: str, i: int) -> tuple[int, int] | None:
    """The word or initial that ends at ``i``, blanks skipped."""
    j = i
    while j and text[j - 1] in " \t\n\r ":
        j -= 1
    k = j - 1 if j and text[j - 1] == "." else j
    a = k
    while a and (text[a - 1].isalpha() or text[a - 1] in "'’-"):
        a -= 1
    if a == k or (a and text[a - 1].isdigit()):
        return None  # nothing, or the letter of a number
    return (a, j) if k == j or k - a <= 2 else None


def _is_title(w: str) -> bool:
    return w.rstrip(".").lower() in TITLES or w == "M."


def _namelike(w: str, loose: bool) -> bool:
    bare = w.rstrip(".")
    if not bare or bare.lower() in NOT_NAMES and not w.endswith("."):
        return False
    return bare[0].isupper() or loose


def _name_forward(text: str, i: int, loose: bool, most: int = 5) -> tuple[int, int] | None:
    """The name that begins at or after ``i``: titles, given names, initials, particles, surname, or
    'Surname, Given'. ``loose``: a cue announces it, so lower case is accepted if it has no capitals."""
    ws = re.compile(r"[ \t ]*\n?[ \t]*|\s")
    j = ws.match(text, i).end()
    begin = None
    end = None
    words = 0
    surname = False
    lower = None
    while words < most:
        m = _INITIAL.match(text, j)
        if m and text[j].isupper() and not (j + 2 < len(text) and text[j + 2].isalnum()) and not (text[j] == "M" and begin is None and False):
            w, e = m.group(0), m.end()
        else:
            m = _WORD.match(text, j)
            if not m:
                break
            w, e = m.group(0), m.end()
        if begin is None and _is_title(w + ("." if text[e : e + 1] == "." and not w.endswith(".") else "")) and len(w.rstrip(".")) > 1:
            j = ws.match(text, e + (text[e : e + 1] == "." and not w.endswith("."))).end()
            loose = True
            continue
        bare = w.rstrip(".")
        if bare.lower() in PARTICLES and not (bare.istitle() and surname):
            nxt = _WORD.match(text, ws.match(text, e).end())
            if begin is None and not (nxt and (nxt.group(0)[0].isupper() or nxt.group(0).lower() in PARTICLES)) and not (loose and lower is None and nxt and bare.islower()):
                break
            if begin is not None and not nxt:
                break
            if lower is False and bare.islower() and not (nxt.group(0)[0].isupper() or nxt.group(0).lower() in PARTICLES):
                break
            if begin is None:
                begin = j
            j = ws.match(text, e).end()
            continue
        if lower is None and not w.endswith("."):
            lower = bare.islower()
        if not _namelike(w, loose and bool(lower)) or (lower is False and bare.islower()) or (lower and not bare.islower()):
            break
        if begin is None:
            begin = j
        words += 1
        end = e
        surname = not w.endswith(".")
        if lower and words == 2:
            nxt = _WORD.match(text, ws.match(text, e).end())
            if not (nxt and w.lower() in PARTICLES):
                break
        if text[e : e + 1] == ",":
            g = re.compile(rf", ?\n?({_NAME}|[^\W\d_]\.)").match(text, e)
            if words == 1 or surname:
                if g and surname and g.group(1)[0].isupper() and g.group(1).lower() not in NOT_NAMES and words <= 2 and not _is_title(g.group(1)) and (words == 1 or text[begin:e].split()[0].lower() in PARTICLES):
                    end = g.end()
            break
        n = ws.match(text, e)
        if n.end() == e:
            break
        if not w.endswith(".") and "\n" in n.group(0) and text[n.end() : n.end() + 1] == "\n":
            break
        j = n.end()
    if begin is None or end is None:
        return None
    return begin, end


def _name_backward(text: str, i: int) -> tuple[int, int] | None:
    """The name that ends before ``i``: up to five words, 'Surname, Given' included."""
    at, begin, words, lower, end = i, None, 0, None, None
    while words < 5:
        t = _token_before(text, at)
        if not t:
            break
        a, b = t
        if "\n\n" in text[b:at] or "\r\n\r\n" in text[b:at]:
            break
        w = text[a:b]
        bare = w.rstrip(".")
        if len(bare) == 1 and w == bare and not (bare.lower() in PARTICLES):
            break  # a letter that is no initial: the end of a number
        if words and text[b - 1] == "." and len(bare) > 1:
            break  # the end of the sentence before, or a title
        if bare.lower() in PARTICLES and begin is not None:
            if lower is False and bare.isupper() != text[begin:end].isupper() and not bare.islower():
                break
            begin, at = a, a
            continue
        if not bare[:1].isalpha() or bare.lower() in NOT_NAMES or _is_title(w):
            break
        low = bare.islower()
        if lower is None:
            lower = low
        if low != lower:
            break
        if end is None:
            end = b
        begin, at, words = a, a, words + 1
        if lower and words == 2:
            break
        k = a
        while k and text[k - 1] in " \t\n":
            k -= 1
        if k and text[k - 1] == ",":
            t2 = _token_before(text, k - 1)
            if words == 1 and t2 and text[t2[0] : t2[1]][:1].isupper() and text[t2[0] : t2[1]].lower() not in NOT_NAMES:
                a2 = t2[0]
                while True:
                    p = _token_before(text, a2)
                    if p and text[p[0] : p[1]].lower() in PARTICLES:
                        a2 = p[0]
                    else:
                        break
                begin = a2
            break
        if k and text[k - 1] in ".!?:;)»”\"" and not (text[k - 1] == "." and _token_before(text, k) and len(text[_token_before(text, k)[0] : k].rstrip(".")) == 1):
            break
    if begin is None or (lower and words < 2):
        return None
    while True:  # a particle the name begins with (de la Vorne)
        p = _token_before(text, begin)
        if p and text[p[0] : p[1]].lower() in PARTICLES and not text[p[0] : p[1]].endswith(".") and words == 1:
            begin = p[0]
        else:
            break
    return begin, end


_HOUSE = r"\d{1,5}(?: ?[A-Za-z](?![\w'’]))?(?: ?(?:bis|ter|quater)\b)?"
_FLOOR = r"(?:, ?\d{1,2}[.]? ?[ºªo°](?:[. ]? ?(?:[A-Z](?![\w])|izq|dcha|izda))?\.?)?"
_EN = re.compile(rf"(?:(?:[Ff]lat|FLAT|[Aa]pt\.?|APT\.?|[Aa]partment|[Uu]nit|[Ss]uite) ?\d{{1,4}}[A-Za-z]?,? )?\d{{1,5}}[A-Za-z]?,? (?:(?:[NSEWnsew]\.|[A-ZÀ-Þa-zà-þ][\w'’\-]*) ){{1,4}}?(?:{'|'.join(STREETS_EN)})\b(?: (?:street|st|road|rd|avenue|ave|lane|crescent|row|drive|close)\b)?", re.I)
_ROMANCE_FIRST = re.compile(rf"{_HOUSE},? (?:{'|'.join(map(re.escape, STREETS_ROMANCE))})\b\.? (?:(?:de la|de l['’]|d['’]|du|des|de|la|le|les|los|las|del) ?)*[A-ZÀ-Þ][\w'’\-]*(?: [A-ZÀ-Þ][\w'’\-]*){{0,3}}", re.I)
_ROMANCE_LAST = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, STREETS_ROMANCE))})(?:\. ?| )(?:(?:de la|de los|de las|de l['’]|d['’]|du|des|del|de|la|le|da|do|dos) )*(?:[A-ZÀ-Þ][\w'’\-]*)(?: (?:(?:de la|de los|del|de|y) )?[A-ZÀ-Þ][\w'’\-]*){{0,4}},? (?:n\.?[º°] ?)?\d{{1,5}}(?: ?[A-Z](?!\w))?{_FLOOR}", re.I)
_DE_END = "|".join(map(re.escape, STREETS_DE))
_DE_HEAD = "|".join(p[0].upper() + p[1:] for p in GERMAN_PREPOSITIONS)
_DE = re.compile(
    rf"(?<!\w)(?:(?:{_DE_HEAD}) [A-ZÄÖÜ][\w\-]+(?: [A-ZÄÖÜ][\w\-]+)?|(?:[A-ZÄÖÜ][\w\-]+[ -])?[A-ZÄÖÜ][\w\-]*(?:{_DE_END})|[A-ZÄÖÜ][\w\-]+ (?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Ufer|Damm)"
    rf"|(?:{_DE_HEAD.upper()}) [A-ZÄÖÜ\-]{{4,}}|[A-ZÄÖÜ\-]{{3,}} ?(?:STRASSE|STRAßE|STR\.|WEG|GASSE|ALLEE|PLATZ)) \d{{1,4}}(?: ?[a-zA-Z](?!\w))?"
)


def _addresses(text: str, streets: list[int], hits: list[int]) -> list[Span]:
    """Street and house number around the numbers of a text; ``streets``: where street words stand."""
    out: list[Span] = []
    lowered, streets = text.lower(), sorted(streets)
    for i in hits:
        a = i
        lo, hi = max(0, a - 70), min(len(text), a + 90)
        k = bisect_left(streets, lo)
        if k == len(streets) or streets[k] >= hi:
            continue
        window = text[lo:hi]
        for rx, kind in ((_EN, "en"), (_ROMANCE_FIRST, "fr"), (_ROMANCE_LAST, "es"), (_DE, "de")):
            for m in rx.finditer(window):
                s, e = lo + m.start(), lo + m.end()
                if not s <= a < e or (s and text[s - 1].isalnum()) or "\n\n" in text[s:e]:
                    continue
                body = text[s:e]
                near = lowered[max(0, s - 40) : s]
                cue = any(c in near for c in ADDRESS_BEFORE)
                if kind == "en":
                    name = re.sub(r"^(?:flat|apt\.?|apartment|unit|suite) ?\d+[a-z]?,? ", "", body, flags=re.I)
                    name = re.sub(r"^\d+[A-Za-z]?,? ", "", name)
                    ws = name.split()
                    caps = all(w[0].isupper() for w in ws if w.lower() not in PARTICLES | {"of", "the"})
                    if not (caps and len(ws) >= 2 or cue) or (not cue and (body.isupper() and len(ws) > 4)):
                        continue
                    if any(w.lower().strip(".") in NOT_NAMES for w in ws[:-1]) and not cue:
                        continue
                elif kind == "de":
                    if not cue and not re.search(rf"(?:{_DE_END}) \d", body, re.I):
                        continue
                    first = body.split()[0]
                    if not cue and not first[:1].isupper():
                        continue
                    if re.fullmatch(r"(?:tag|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|berg|tal|weg|hof|ring) \d+.*", body, re.I):
                        continue
                elif kind == "es":
                    if not cue and not re.match(r"\S+ (?:(?:de|la|los|las|del|du|des|da|do) )*[A-ZÀ-Þ]", body):
                        continue
                elif kind == "fr" and not cue and not re.search(r" [A-ZÀ-Þ]", body):
                    continue
                out.append(("address", s, e))
    return out


_RANK = {"email": 0, "phone": 2, "id": 1, "address": 3, "name": 4}


def find(text: str | None) -> list[Span]:
    """(type, start, end) of every case, without overlaps, in order."""
    if not text or text.isspace():
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: positions must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: list[Span] = []
    digits: list[int] = []
    streets: list[int] = []
    before: list[int] = []
    near: list[int] = []
    after: list[int] = []
    titles: list[tuple[int, int]] = []
    for last, (key, kinds) in automaton().iter(low):
        a, b = last - len(key) + 1, last + 1
        if kinds == ("digit",):
            if not digits or a > digits[-1]:
                digits.append(a)
            continue
        if "street" in kinds:
            streets.append(a)
        if "mail" in kinds:
            e = _email(text, a)
            if e:
                found.append(("email", *e))
            continue
        if not (_edge(text, a) and (_edge(text, b) or not key[-1].isalnum())):
            continue
        if "title" in kinds:
            titles.append((a, b))
        if "before" in kinds:
            before.append(b)
        if "near" in kinds:
            near.append(b)
        if "after" in kinds:
            after.append(a)
        if "id" in kinds:
            e = _id_after(text, b)
            if e:
                found.append(("id", *e))
    # numbers: runs of digits and separators, once each
    end, seen_numbers = -1, []
    for i in digits:
        if i < end:
            continue
        m = _NUMBER.match(text, i)
        a = i
        while a and text[a - 1] in "(+":
            a -= 1
        m = _NUMBER.match(text, a) or m
        if m:
            end = m.end()
        else:
            end = i + 1
        seen_numbers.append(i)
        if m and m.end() - m.start() >= 9:
            p = _phone(text, m.start(), m.end())
            if p:
                found.append(("phone", *p))
    if digits:
        for m in _ID_SHAPES.finditer(text):
            if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-/+.")) and not (m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "-/@" and text[m.end() + 1 : m.end() + 2].isalnum())):
                found.append(("id", m.start(), m.end()))
        found += _addresses(text, streets, seen_numbers)
    # names
    for a, b in titles:
        w = text[a:b]
        stop = text[b : b + 1] == "."
        strict = w + "." in STRICT_TITLES if stop else w in STRICT_TITLES
        if not (strict or w in STRICT_TITLES and stop or stop and w.lower() in TITLES):
            continue
        e = _name_forward(text, b + stop, loose=False)
        if e:
            found.append(("name", *e))
        elif stop and re.match(r" (?:and|et|und|y|e) (?:Mrs|Mr|Ms|Mme|Dr)\.? ", text[b + 1 : b + 14]):
            continue
    for m in re.finditer(r"(?<!\w)M\. (?=[A-ZÀ-Þd])", text):  # monsieur, if no initial of someone else
        e = _name_forward(text, m.end(), loose=False)
        if e and not re.match(r"[A-Z]\.", text[e[0] : e[0] + 2]) and _french(text, m.start(), e[1]):
            found.append(("name", *e))
    for b in before:
        e = _name_forward(text, b, loose=True)
        if e and _person(text, b, e):
            found.append(("name", *e))
    for b in near:
        e = _full_name(text, b)
        if e:
            found.append(("name", *e))
    for a in after:
        e = _name_backward(text, a)
        if a and e and not (text[e[1] : a].strip(" ,\n\r\t")) and ("\n\n" not in text[e[1] : a]) and _subject(text, a, e):
            found.append(("name", *e))
    return _settled(found)


_FULL = re.compile(rf"[ \t]*\n?[ \t]*((?:[A-ZÀ-Þ][a-zß-ÿ]+|[A-ZÀ-Þ]\.)(?:[ -](?:(?:de|la|del|van|von|der|da|dos|di|le) )*(?:[A-ZÀ-Þ][a-zß-ÿ]+(?:['’\-][A-ZÀ-Þ][a-zß-ÿ]+)*|[A-ZÀ-Þ]\.)){{1,3}})(?![\w'’-])")


def _full_name(text: str, i: int) -> tuple[int, int] | None:
    """A given name or initial and a surname, all in capital case, right after ``i``: two words at least, none
    of them a place, a title of something or a word that is no name."""
    m = _FULL.match(text, i)
    if not m:
        return None
    words = [w for w in re.findall(_NAME, m.group(1)) if w.lower() not in PARTICLES]
    if len(words) < 2 or any(w.lower() in NOT_NAMES or w.lower() in PLACES or w.lower() in STREETS_EN for w in words) or len(words[-1]) < 2:
        return None
    after = text[m.end() : m.end() + 14].lstrip().lower()
    return None if any(after.startswith(w) for w in ("syndrome", "disease", "test", "sign", "score", "street", "road", "ward", "hospital", "scale")) else m.span(1)


def _french(text: str, at: int, end: int) -> bool:
    rest = text[end : end + 25].lower()
    return bool(re.match(r"\s+(?:a|est|avait|était|sera|et|va|n['’]|se|ne|doit|peut|prend|vit|habite)\b", rest)) or not re.search(r"(?<!\w)(?:the|of|and|was|by)\b", text[max(0, at - 40) : at])


def _person(text: str, cue_end: int, e: tuple[int, int]) -> bool:
    """Whether what a cue announced is a person: it is followed or written as one."""
    body, rest = text[e[0] : e[1]], text[e[1] : e[1] + 64].lower()
    words = [w for w in re.findall(_NAME, body) if w.lower() not in PARTICLES]
    cue = text[max(0, cue_end - 16) : cue_end].lower()
    follows = re.match(
        r"[\s]*(?:\(id|\(born|, ?(?:tel|phone)|,? ?(?:can be|was|is|has|gave|lives|at \S+[@\[(]|at [\w.+\-]+ ?[@\[(])|the pain|unter|au [+\d(]|al [+\d(]|ist |, ?todo|, ?tout|\.|$|,)",
        rest,
    )
    if body.islower():
        return len(words) >= 2 and bool(follows)
    if body.isupper() and text[max(0, cue_end - 12) : cue_end].isupper():  # all in capitals: the words say nothing
        return bool(follows) and len(words) >= 2 and not rest.startswith(("\n\n", ".")) and bool(re.match(r"\s*(?:\(|, ?tel|unter|au [+\d(]|at \S+[@\[(])", rest))
    if cue.endswith(("patient", "patiente", "paciente", "patientin", "laut", "selon", "según", "segundo", "bitte", "reach", "according to", "akte", "named", "seen by", "dear", "joindre")):
        return bool(follows) and (len(words) >= 2 or bool(re.search(r"[A-ZÀ-Þ]\. ", body)) or bool(re.match(r"\s*(?:\(|,? ?(?:can|was|tel)|the pain|unter|au [+\d(]|, ?to|ist |at )", rest)))
    return bool(follows) or len(words) >= 2


def _subject(text: str, at: int, e: tuple[int, int]) -> bool:
    """Whether a name stands before a phrase only persons have, as its subject."""
    body = text[e[0] : e[1]]
    words = [w for w in re.findall(_NAME, body) if w.lower() not in PARTICLES]
    phrase = text[at : at + 12].lower()
    if phrase.startswith("et al"):
        return bool(words) and body[:1].isalpha() and not body.islower()
    if body.islower():
        return len(words) == 2
    if body.isupper() and text[at : at + 8].isupper():
        return phrase.startswith("lives at") and len(words) >= 2
    return len(words) >= 2 or bool(re.search(r"[A-ZÀ-Þ]\.\s", body)) or phrase.startswith(("lives", "can be", "wohnt", "habite", "vive"))


def _settled(found: list[Span]) -> list[Span]:
    """The spans without overlaps: by type, then the longer, then the earlier. Those kept are disjoint, so
    a new one need only be held against its neighbours."""
    starts: list[int] = []
    out: list[Span] = []
    for k, a, b in sorted(set(found), key=lambda s: (_RANK[s[0]], s[1] - s[2], s[1])):
        i = bisect_right(starts, a)
        if (i == 0 or out[i - 1][2] <= a) and (i == len(out) or b <= out[i][1]):
            starts.insert(i, a)
            out.insert(i, (k, a, b))
    return out


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str | None) -> str | None:
    """The text with a typed placeholder for every case and all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for k, a, b in find(text):
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(redact, na_action="ignore")

    return run(text)


def cases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_type, start_pos, end_pos): every case of every text, each once."""

    @F.pandas_udf("array<struct<pii_type:string,start_pos:int,end_pos:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"pii_type": k, "start_pos": a, "end_pos": b} for k, a, b in find(t)])

    rows = spread(df.select(F.col(key), F.col(text).alias("text")).where("text is not null"))
    return rows.select(key, F.explode(run("text")).alias("c")).select(key, "c.*").distinct()
