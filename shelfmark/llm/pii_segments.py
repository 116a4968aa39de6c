"""Candidate segments of personal information in a text and the features that score them as wholes.

Candidates are found from cheap anchors: an at sign, a run of digits, a capitalised word or Han surname, a street word.  From an
anchor the whole item is read, however long it is.  Every run of capitalised words gives candidates for names, and every
long run of digits candidates for numbers; several candidates may overlap, with other bounds or kinds, and the model
decides between them.  What stands around a span is told by the three words before it and the one behind it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from shelfmark.llm import pii_words as W
from shelfmark.llm.lexicon import word_class
from shelfmark.llm.names import GIVEN, fold

KINDS = ("email", "phone", "id_number", "address", "name")
Segment = tuple[int, int, str, tuple[str, ...]]

_WORDS = re.compile(r"[^\W\d_]+")
_S = r"[ \t\xa0]?\n?[ \t\xa0]?"
_SP = r"(?:[ \t\xa0]+\n?[ \t\xa0]*|\n[ \t\xa0]*)"
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚŁŃŇŐŘŚŠŤŮŰŹŻŽА-ЯЁ"
_LOW = "a-zß-öø-ÿāăąćčďđęěłńňőřśšťůűźżžа-яё"
_WORD = f"[{_UP}][{_LOW}{_UP}'’]+(?:-[{_UP}][{_LOW}{_UP}]+)?"

# How telephone numbers are written.
PHONES = tuple((name, re.compile(p)) for name, p in (
    ("plus", rf"\+\d{{1,3}}(?:[ \xa0.\-/]?\n?\(?\d{{1,4}}\)?){{2,6}}"),
    ("plus_solid", r"\+\d{9,14}"),
    ("paren_4", rf"\(\d{{2,4}}\){_S}\d{{3,4}}[ \xa0\-]\d{{4}}"),
    ("paren_22", rf"\(\d{{2,4}}\){_S}\d{{3}}{_S}\d{{2}}{_S}\d{{2}}"),
    ("paren_5", rf"\(\d{{2,5}}\){_S}\d{{4,6}}(?:[ \xa0\-\n]\d{{2,4}})?"),
    ("us", rf"\d{{3}}([\-.])\d{{3}}\1\d{{4}}(?:{_SP}(?:ext\.?|x){_S}\d{{1,5}})?"),
    ("us_int", r"00\d?-\d{3}-\d{3}-\d{4}"),
    ("local_7", r"\d{3}-\d{4}"),
    ("zero_3", rf"0\d{{1,4}}{_SP}\d{{3,5}}(?:{_SP}|-)\d{{3,4}}"),
    ("zero_2", rf"0\d{{2,4}}{_SP}\d{{5,7}}"),
    ("slash", rf"0\d{{1,4}}[ ]?/[ ]?\d{{4,8}}"),
    ("eight", rf"8[ \-]\(?\d{{3}}\)?[ \-]\d{{3}}[ \-]\d{{2}}[ \-]\d{{2}}"),
    ("pairs", rf"0\d(?:{_SP}\d{{2}}){{4}}|0\d(?:\.\d{{2}}){{4}}"),
    ("threes", r"\d{3}-\d{3}-\d{3}"),
    ("threes_space", rf"\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}"),
    ("three_twos", rf"\d{{3}}(?:{_SP}\d{{2}}){{3}}"),
    ("dashes", r"0\d{1,3}-\d{2,4}-\d{4}|1\d{2}-\d{4}-\d{4}|0\d{2,3}-\d{7,8}"),
    ("solid", r"0\d{9,10}|1\d{10}"),
))
# How identity numbers are written.
IDS = tuple((name, re.compile(p)) for name, p in (
    ("3_2_4", rf"\d{{3}}(-|{_SP})\d{{2}}(?:-|{_SP})\d{{4}}"),
    ("nine", r"\d{9}"),
    ("eleven", r"\d{11}"),
    ("twelve", rf"\d{{12}}|\d{{4}}{_SP}\d{{4}}{_SP}\d{{4}}"),
    ("dotted", r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
    ("eight_letter", r"\d{8}-?[A-Z]"),
    ("eighteen", r"\d{17}[\dXx]"),
    ("long_groups", rf"[1-478]{_SP}\d{{2}}{_SP}\d{{2}}{_SP}\d{{2,3}}{_SP}\d{{3}}{_SP}\d{{3}}(?:{_SP}\d{{2}})?|[1-478]\d{{12}}(?:{_SP}?\d{{2}})?"),
    ("2_3_3_3", rf"\d{{2}}{_SP}\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}"),
    ("2_2_6", rf"\d{{2}}{_SP}?\d{{2}}{_SP}(?:№{_SP}?)?\d{{6}}"),
    ("snils", r"\d{3}-\d{3}-\d{3}[ \-]\d{2}"),
))
_DIGITS = re.compile(r"[+(]?\d[\d \t\xa0\n().\-–/№]{4,}[\dA-Z]")
_EXTENSION = re.compile(rf"{_SP}(?:ext\.?|x){_S}\d{{1,5}}")
# one to three letters and digits; letter, digits, letter; two letters, three pairs of digits and a letter; nine letters and digits (patterns
# begin with a class of characters, which is what the engine looks for fastest)
_ID_LETTERS = re.compile(rf"[A-Z](?<!\w[A-Z])(?:[A-Z]{{0,2}}{_SP}?\d{{6,8}}|(?<=[XYZ])-?\d{{7}}-?[A-Z]|[A-Z]{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-D]|(?<=[CFGHJKLMNPRTVWXYZ])[0-9CFGHJKLMNPRTVWXYZ]{{8}})(?!\w)")

_SIGN = re.compile(r"@|[(\[]at[)\]]|(?<=\w) at (?=[\w\-]+ dot )", re.IGNORECASE)
_HOST = re.compile(rf"{_SP}?[\w\-]+(?:(?:\.|{_SP}dot{_SP}|{_SP}?[(\[]dot[)\]]{_SP}?)[\w\-]+)+", re.IGNORECASE)

_PLACE = rf"(?:,?{_SP}\d{{4,5}}(?:-\d{{3}})?{_SP}{_WORD}(?:{_SP}{_WORD})?|,{_SP}{_WORD}(?:{_SP}\d{{5}}(?!\d))?|,?{_SP}\d{{5}}(?!\d))?"
_AFTER_FIRST = re.compile(rf"{_SP}?(?:(?:de|del|da|do|dos|das|des|du|la){_SP}){{0,2}}{_WORD}(?:{_SP}(?:(?:de|del|da|do|dos|das|des|du){_SP})?{_WORD})?(?:,{_SP}(?:n[º°.]?{_SP}?|д\.{_SP}?|дом{_SP})?\d{{1,4}}[a-zA-Z]?(?!\w)|{_SP}(?:n[º°.]?{_SP}?)?\d{{1,4}}[a-zA-Z]?(?!\w))(?:,{_SP}(?:кв|m|apt|lok)\.?{_SP}?\d+)?{_PLACE}")
_FRENCH = re.compile(rf"(?<![\w.,:/\-])\d{{1,4}}(?:{_SP}(?:bis|ter|quater))?,?{_SP}(?:{'|'.join(w for w in W.STREET_FIRST if w.isalpha() and w.isascii() or w == 'allée')}){_SP}(?:(?:des|du|de{_SP}la|de|la){_SP}|l['’]|d['’])?{_WORD}(?:{_SP}{_WORD})?{_PLACE}")
_ENGLISH = re.compile(rf"\d(?<![\w.,:/\-]\d)\d{{0,4}}[A-Za-z]?{_SP}(?=[{_UP}])")
_FLAT = re.compile(rf"(?:Flat|Apt\.?|Apartment|Unit|Suite){_SP}\d+[A-Za-z]?,?{_SP}")
_NEXT_WORD = re.compile(rf"({_WORD}){_SP}")
_LAST_WORD = re.compile(rf"({_WORD})(?![\w'’])")
_AFTER_ENGLISH = re.compile(rf"\.?(?:,{_SP}(?:Flat|Apt\.?|Unit|Suite){_SP}\d+[A-Za-z]?)?(?:,{_SP}{_WORD}(?:{_SP}{_WORD})?)?(?:,?{_SP}\d{{5}}(?!\d))?")
_AFTER_GERMAN = re.compile(rf"\.?{_SP}\d{{1,4}}{_S}[a-z]?(?!\w){_PLACE}")
_CJK_ADDRESS = re.compile(r"[一-鿿]{2,14}(?:路|街|大道|巷|胡同)\d{1,5}号(?:[一-鿿\d]{1,8}(?:室|楼|单元))?|(?:東京都|北海道|(?:京都|大阪)府|[一-鿿]{2,3}県)[一-鿿ぁ-んァ-ン]{1,12}\d{1,3}(?:丁目|[-－]\d{1,3}){1,3}")
_STREET_FIRST = frozenset(w.rstrip("/") for w in W.STREET_FIRST)
_FLATS = frozenset(("Flat", "Apt", "Apartment", "Unit", "Suite"))
#: Every match of the pattern holds one of these.
_CJK_SIGNS = ("号", "県", "東京都", "北海道", "京都府", "大阪府")

# -- surroundings ----------------------------------------------------------------------------------------------------

#: label -> classes of what stands behind it
_LABELS: dict[str, tuple[str, ...]] = {}
for _name, _words in (("id", W.ID_LABELS), ("phone", W.PHONE_LABELS), ("email", W.EMAIL_LABELS), ("address", W.ADDRESS_LABELS), ("person", W.PERSON_LABELS), ("hint", W.PERSON_HINTS), ("thing", W.THING_LABELS), ("place", W.PLACE_LEFT), ("article", W.ARTICLES), ("and", W.AND), ("title", W.TITLES)):
    for _w in _words:
        _LABELS[_w] = (*_LABELS.get(_w, ()), "L:" + _name)
_CJK = tuple((w, "L:" + k) for k, ws in W.CJK_LABELS.items() for w in ws)
_LINKING = frozenset(("no", "nr", "n°", "nº", "number", "№", "numer", "número", "numéro", "is", "was", "are", "ist", "war", "est", "es", "é", "jest", "to"))
_PARTS = re.compile(r"[\s。、，！？：；⺀-鿿ぁ-ヿ]+")
_BETWEEN = " \t\n\xa0:.,;=#№|<(\"'„«“‘–—、，：（"
_STOPS = frozenset(".!?。！？")
#: Characters of a text before and after a span among which the words beside it are looked for.
BEFORE, AFTER = 48, 24


def _left(text: str, start: int) -> list[str]:
    """Classes of what stands before a span."""
    before = text[max(0, start - BEFORE) : start]
    word = before.rstrip(_BETWEEN)
    gap = before[len(word) :]
    out: list[str] = []
    tail = word.lower()
    if tail and tail[-1] > "⺀":
        bare = tail.rstrip("はのがを是为為")
        for w, k in _CJK:
            if (tail.endswith(w) or bare.endswith(w)) and k not in out:
                out.append(k)
        if "。" in gap:
            out = []
    elif tail:
        words = [w for w in _PARTS.split(tail)[-3:] if w]
        last = words[-1].lstrip("(\"'„«“‘<|")
        if last in _LINKING and len(words) > 1 and (before_no := words[-2].strip(",(.:")) in _LABELS:
            words, last = words[:-1], before_no
        for n in range(len(words)):
            key = " ".join([*words[n:-1], last])
            if got := _LABELS.get(key):
                for k in got:
                    if k not in out:
                        out.append(k)
                break
        # the end of a sentence parts, the dot of an abbreviation doesn't
        if not out:
            out = ["L:lower" if last[:1].islower() and word[-1:].islower() and word[len(word) - len(last) :][:1].islower() else "L:upper"]
        if not _STOPS.isdisjoint(gap) and (len(last) > 4 or "L:thing" not in out and "L:phone" not in out and "L:title" not in out and "L:id" not in out):
            out = ["L:start"]
    bare = gap.replace(" ", "").replace("\xa0", "")
    if not tail:
        out.append("L:start")
    if not tail or bare.endswith("\n"):
        out.append("L:line")
    elif "|" in bare:
        out.append("L:pipe")
    elif ":" in bare or "：" in bare or "=" in bare:
        out.append("L:colon")
    elif "," in bare or "、" in bare or "，" in bare or ";" in bare:
        out.append("L:comma")
    elif bare and bare[-1] in "(<\"'„«“‘（":
        out.append("L:open")
    return out or ["L:other"]


_AFTER_WORD = re.compile(r"[^\W\d_][\w'’°³²]*|%|°C|m³|m²")


def _right(text: str, end: int) -> list[str]:
    """Classes of what stands behind a span."""
    after = text[end : end + AFTER]
    bare = after.lstrip(" \t\xa0")
    if not bare or bare[0] == "\n":
        out = ["R:end"]
    elif bare[0] == "|":
        return ["R:pipe"]
    elif bare[0] in ".;。；!?！？":
        return ["R:stop"]
    elif bare[0] in ",、，)>）:：":
        return ["R:comma"]
    elif bare[0] in "([（<":
        return ["R:open"]
    else:
        out = []
    if (first := bare[:1]) and first > "⺀":
        return ["R:honorific"] if bare.startswith(W.CJK_HONORIFICS) else [*out, "R:cjk"]
    m = _AFTER_WORD.match(bare.lstrip("\n \t"))
    if not m:
        return out or ["R:other"]
    low = m[0].lower()
    if low in W.VERBS:
        out.append("R:verb")
    if low in W.AND:
        out.append("R:and")
    if low in W.THINGS:
        out.append("R:thing")
    if low in W.UNITS:
        out.append("R:unit")
    if low == "at" or low == "shows" or low == "to":
        out.append("R:to")
    if m[0][0].isupper() and "R:end" not in out:
        out.append("R:capital")
    return out or ["R:word"]


def _features(kind: str, shape: str, left: list[str], right: list[str], *more: str) -> tuple[str, ...]:
    f = [kind, f"{kind}|{shape}"]
    f += [f"{kind}|{a}" for a in left] + [f"{kind}|{a}" for a in right] + [f"{kind}|{m}" for m in more]
    if kind != "email":
        f += [f"{kind}|{shape}|{a}" for a in left] + [f"{kind}|{shape}|{a}" for a in right]
    return tuple(f)


def _trim(text: str, start: int, end: int) -> int:
    while end > start and (text[end - 1] in " \t\n\xa0.,;-(/–" or text[end - 1] == ")" and "(" not in text[start:end]):
        end -= 1
    return end


def candidates(text: str) -> list[Segment]:
    """All candidate segments (start, end, kind, features) of a text, in no order; ends exclusive."""
    out: list[Segment] = []
    words = set(_WORDS.findall(text))
    _emails(text, words, out)
    _numbers(text, out)
    _streets(text, words, out)
    _names(text, words, out)
    _han_names(text, out)
    merged: dict[tuple[int, int, str], tuple[str, ...]] = {}
    for start, end, kind, features in out:
        key = (start, end, kind)
        merged[key] = features if key not in merged else tuple(dict.fromkeys(merged[key] + features))
    return [(*key, features) for key, features in merged.items()]


# -- e-mail ----------------------------------------------------------------------------------------------------------


def _emails(text: str, words: set[str], out: list[Segment]) -> None:
    if "@" not in text and not ("dot" in words or "(" in text or "[" in text):
        return
    for sign in _SIGN.finditer(text):
        start = at = sign.start()
        worded = sign[0] != "@"
        while worded and start and text[start - 1] in " \t\xa0\n":
            start -= 1
        user = start
        while start and (text[start - 1].isalnum() and ord(text[start - 1]) < 0x2E80 or text[start - 1] in "._+-"):
            start -= 1
        host = _HOST.match(text, sign.end())
        if start == user or not host:
            continue
        while start < user and text[start] in ".-":
            start += 1
        end = _trim(text, start, host.end())
        if "." in text[at:end] or "dot" in text[at:end].lower():
            out.append((start, end, "email", _features("email", sign[0].lower().strip(), _left(text, start), _right(text, end))))


# -- numbers ---------------------------------------------------------------------------------------------------------


def _numbers(text: str, out: list[Segment]) -> None:
    for run in _DIGITS.finditer(text):
        lo, hi = run.start(), run.end()
        if sum(map(str.isdigit, run[0])) < 7:
            continue
        hi = m.end() if (m := _EXTENSION.match(text, hi)) else min(len(text), hi + 1)
        beside: dict[int, list[str]] = {}
        behind: dict[int, list[str]] = {}
        for kind, shapes in (("phone", PHONES), ("id_number", IDS)):
            for shape, pattern in shapes:
                for m in pattern.finditer(text, lo, hi):
                    _number(text, m.start(), m.end(), kind, shape, beside, behind, out)
        # a number of no known shape counts where it is labelled
        start, end = lo, _trim(text, lo, run.end())
        if 7 <= sum(map(str.isdigit, text[start:end])) <= 15 and end - start <= 24:
            left = beside.get(start) or beside.setdefault(start, _left(text, start))
            for kind, label in (("phone", "L:phone"), ("id_number", "L:id")):
                if label in left:
                    _number(text, start, end, kind, "labelled", beside, behind, out)
    for m in _ID_LETTERS.finditer(text):
        left = _left(text, m.start())
        if any(map(str.isdigit, m[0])):
            letters = sum(map(str.isalpha, m[0]))
            shape = "nino" if m[0][-1].isalpha() and m[0][:2].isalpha() else "letters" if letters <= 3 else "code"
            out.append((m.start(), m.end(), "id_number", _features("id_number", shape, left, _right(text, m.end()))))


def _number(text: str, start: int, end: int, kind: str, shape: str, beside: dict, behind: dict, out: list[Segment]) -> None:
    end = _trim(text, start, end)
    before, after = text[start - 1 : start], text[end : end + 1]
    if before and (before.isalnum() and ord(before) < 0x2E80 or before in "+.-–/") or after.isalnum() and ord(after) < 0x2E80 or after in ("-", "–", "/", ".") and text[end + 1 : end + 2].isdigit():
        return
    left = beside.get(start) or beside.setdefault(start, _left(text, start))
    right = behind.get(end) or behind.setdefault(end, _right(text, end))
    more = ["555"] if kind == "phone" and "555" in text[start:end] else []
    if before == "(" or before == ")" or before == " " and text[start - 2 : start - 1] == ")":
        more.append("after_paren")
    if before and before.isspace() and text[start - 2 : start - 1].isdigit() or after and after.isspace() and text[end + 1 : end + 2].isdigit():
        more.append("beside_digits")
    out.append((start, end, kind, _features(kind, shape, left, right, *more)))


# -- addresses -------------------------------------------------------------------------------------------------------


def _address(text: str, start: int, end: int, shape: str, out: list[Segment]) -> None:
    end = _trim(text, start, end)
    span = text[start:end]
    zipped = "zip" if re.search(r"\d{5}", span) else "nozip"
    placed = "placed" if "," in span else "bare"
    out.append((start, end, "address", _features("address", shape, _left(text, start), _right(text, end), zipped, placed, f"{shape}_{placed}")))


@lru_cache(maxsize=1000)
def _first_words(present: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?:{'|'.join(sorted(map(re.escape, present), key=lambda w: (-len(w), w)))})(?!\w)\.?")


def _streets(text: str, words: set[str], out: list[Segment]) -> None:
    """Streets told by their first word, by a number before them or by Chinese and Japanese signs; ``words``: those of the text."""
    present = frozenset(w for w in words if w.lower() in _STREET_FIRST)
    if present:
        for m in _first_words(present).finditer(text):
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                continue
            if n := _AFTER_FIRST.match(text, m.end()):
                _address(text, m.start(), n.end(), "street_first", out)
        for m in _FRENCH.finditer(text):
            _address(text, m.start(), m.end(), "number_street", out)
    if any(w.lower() in W.STREETS for w in words if w[0].isupper()):
        flats = {m.end(): m.start() for m in _FLAT.finditer(text)} if not _FLATS.isdisjoint(words) else {}
        for m in _ENGLISH.finditer(text):
            at = m.end()
            for k in range(5):
                if k and (last := _LAST_WORD.match(text, at)) and last[1].lower() in W.STREETS:
                    if n := _AFTER_ENGLISH.match(text, last.end()):
                        _address(text, flats.get(m.start(), m.start()), n.end(), "number_street", out)
                if not (step := _NEXT_WORD.match(text, at)):
                    break
                at = step.end()
    if any(sign in text for sign in _CJK_SIGNS):
        for m in _CJK_ADDRESS.finditer(text):
            # a Chinese address is written right behind its label
            after = max((m[0].rfind(w) + len(w) for w in W.CJK_LABELS["address"] if w in m[0]), default=0)
            _address(text, m.start() + after, m.end(), "cjk", out)


# -- names -----------------------------------------------------------------------------------------------------------

_LETTER = r"A-Za-z0-9_À-ɏЀ-ӿ"
_CAPITAL = re.compile(rf"(?<![{_LETTER}])[{_UP}][{_LETTER}'’]*(?:-[{_UP}][{_LETTER}]+)*\.?")
_GAP = re.compile(rf"{_SP}((?:(?:{'|'.join(sorted(W.PARTICLES, key=lambda w: (-len(w), w)))}){_SP}(?:(?:{'|'.join(sorted(W.PARTICLE_ENDS))}){_SP})?)?)")
_COMMA = re.compile(rf",{_SP}")
_HAN_FIRST = re.compile(f"[{''.join(sorted({w[0] for w in W.JAPANESE_SURNAMES} | set(W.HAN_SURNAMES)))}]")
_HAN_NAME = re.compile(rf"(?:(?<![一-鿿々ぁ-んァ-ン])|(?<=[人名户者生工的字系知给は]))(?:(?:{'|'.join(W.JAPANESE_SURNAMES)})[ 　]?[一-鿿々ぁ-んァ-ン]{{1,3}}?|[{''.join(W.HAN_SURNAMES)}][一-鿿]{{1,2}})(?=$|[^一-鿿々ぁ-んァ-ンー]|{'|'.join(W.CJK_HONORIFICS)}|[はがのにとをへもで]|[的是在和与住说])")
#: Most capitalised words of a name.
LONGEST_NAME = 4


@lru_cache(maxsize=50_000)
def _word_kind(word: str) -> str:
    """initial, letter, title, street, thing, stop, given, or word."""
    bare = word.rstrip(".")
    low = bare.lower()
    if len(bare) == 1:
        return "initial" if word.endswith(".") else "letter"
    if low in W.TITLES and not bare.isupper():
        return "title"
    if bare[0].isupper() and any(map(str.isdigit, bare)):
        return "stop"
    plain = low if low.isascii() else fold(bare)
    if plain in _GIVEN or low in W.GIVEN_CYRILLIC or "-" in plain and plain.split("-")[0] in _GIVEN:
        return "given"
    if low in W.STREETS and low not in ("way", "hill", "walk", "close", "green", "rise", "view", "yard", "grove", "gardens") or low.endswith(W.STREET_ENDS) and len(low) > 5:
        return "street"
    if low in W.FUNCTION_WORDS:
        return "stop"
    if low in ("flat", "apt", "apartment", "unit", "suite") or bare[1] in "'’" and bare[2:3].islower():
        return "label"
    if low in W.THINGS:
        return "thing"
    if low in W.PERSON_LABELS or low in W.PHONE_LABELS or low in W.THING_LABELS or low in W.ID_LABELS or low in W.EMAIL_LABELS:
        return "label"
    return "word"


_GIVEN = frozenset(fold(w) for w in W.GIVEN_NAMES) | frozenset(GIVEN)


def _names(text: str, words_: set[str], out: list[Segment]) -> None:
    """Names of persons in Latin and Cyrillic letters, and streets that are recognised by the end of their word; ``words_``: those of the text."""
    titled = any(w in W.TITLES and len(w) > 1 for w in words_)
    caps = [(m.start(), m.end(), m[0]) for m in _CAPITAL.finditer(text)]
    n = len(caps)
    kinds = [_word_kind(w) for _, _, w in caps]
    lefts: dict[int, list[str]] = {}
    rights: dict[int, list[str]] = {}
    # what parts a word from the next: 1 white space, 2 white space and particles, 3 a comma, 0 anything else
    gaps = [0] * n
    for i in range(n - 1):
        end, start = caps[i][1], caps[i + 1][0]
        if start - end > 24:
            continue
        if text[end - 1] == "." and kinds[i] not in ("initial", "title"):
            continue
        if text[end] == ",":
            gaps[i] = 3 if _COMMA.fullmatch(text, end, start) else 0
        elif m := _GAP.fullmatch(text, end, start):
            gaps[i] = 2 if m[1] else 1

    def add(i: int, j: int, shape: str, *more: str) -> None:
        if caps[j][2].lower() in W.PARTICLES:
            return
        if "Ѐ" <= text[caps[i][0]] <= "ӿ":
            shape = "cyrillic_" + shape
        start, end = caps[i][0], caps[j][1]
        if kinds[j] != "initial" and text[end - 1] == ".":
            end -= 1
        left = lefts.get(start) or lefts.setdefault(start, _left(text, start))
        right = rights.get(end) or rights.setdefault(end, _right(text, end))
        marks = list(more)
        words = [caps[k][2].rstrip(".") for k in range(i, j + 1) if kinds[k] in ("word", "given")]
        if any(w.lower() in words_ for w in words):
            marks.append("common")
        if len(words) > 1 and words[-1].lower() in words_:
            marks.append("common_last")
        if i and gaps[i - 1] in (1, 2):
            marks.append("after_" + kinds[i - 1])
        elif i and gaps[i - 1] == 3:
            marks.append("comma_before")
        if gaps[j] in (1, 2) and kinds[j] != "initial" and kinds[j + 1] in ("word", "given", "initial", "thing", "street"):
            marks.append("before_" + kinds[j + 1] + ("_common" if caps[j + 1][2].lower() in words_ else ""))
        classes = [word_class(w) for w, k in zip(words, (kinds[x] for x in range(i, j + 1) if kinds[x] in ("word", "given"))) if k == "word"]
        if classes:
            common = classes.count("common")
            kind = "all" if common == len(classes) else "some" if common else "none"
            marks += ["lexicon_" + kind, f"lexicon_{kind}|{shape}"]
            if "proper" in classes:
                marks.append("proper_first" if classes[0] == "proper" else "proper_later")
        if all(w.isupper() for w in words):
            marks.append("caps")
        if "\n" in text[start:end]:
            marks.append("broken")
        if "L:line" in left and "R:end" in right:
            marks.append("own_line")
            marks.append("own_line|" + shape)
        out.append((start, end, "name", _features("name", shape, left, right, *marks)))

    for i in range(n):
        k = kinds[i]
        if k == "street":
            s, e, w = caps[i]
            bare = w.rstrip(".")
            if bare.lower().endswith(W.STREET_ENDS) and (m := _AFTER_GERMAN.match(text, s + len(bare))):
                _address(text, s, m.end(), "street_number", out)
            continue
        if k in ("stop", "title", "thing", "letter", "label"):
            continue
        # runs of words from here on, with initials and particles between them
        j, shape, particle, wordy = i, {"initial": "I", "given": "G", "word": "W"}[k], False, int(k != "initial")
        while j + 1 < n and gaps[j] in (1, 2) and wordy < LONGEST_NAME and j - i < 6:
            nxt = kinds[j + 1]
            if nxt not in ("initial", "letter", "given", "word") or gaps[j] == 2 and kinds[j] == "initial" and k == "initial":
                break
            particle = particle or gaps[j] == 2
            j += 1
            shape += {"initial": "I", "letter": "I", "given": "G", "word": "W"}[nxt]
            wordy += nxt in ("given", "word")
            if nxt in ("given", "word") and (len(caps[j][2].rstrip(".")) > 1) or nxt == "initial" and wordy:
                add(i, j, shape.replace("II", "I") + ("p" if particle else ""))
        if k in ("word", "given"):
            if gaps[i] == 3 and kinds[i + 1] in ("given", "word", "initial"):
                j = i + 1
                while gaps[j] == 1 and j + 1 < n and kinds[j + 1] == "initial":
                    j += 1
                add(i, j, f"{shape[0]},{ {'given': 'G', 'word': 'W', 'initial': 'I'}[kinds[i + 1]] }")
            if i and kinds[i - 1] == "title" and gaps[i - 1] == 1:
                add(i, i, "alone_titled")
            elif titled:
                left = lefts.get(caps[i][0]) or lefts.setdefault(caps[i][0], _left(text, caps[i][0]))
                if "L:title" in left:
                    add(i, i, "alone_titled")


def _han_names(text: str, out: list[Segment]) -> None:
    for first in _HAN_FIRST.finditer(text):
        if not (m := _HAN_NAME.match(text, first.start())):
            continue
        start, end = m.start(), m.end()
        right = _right(text, end)
        if "R:honorific" in right and start + 1 < end and text[end - 2 : end] in W.CJK_HONORIFICS:
            continue
        out.append((start, end, "name", _features("name", "han" if m[0][0] in W.HAN_SURNAMES else "japanese", _left(text, start), right)))
