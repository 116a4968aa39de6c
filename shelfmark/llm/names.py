"""Reading a name as people type it: pure-Python core of the name-linking operator."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Mapping

from shelfmark.llm.pii_words import GIVEN_NAMES

# Short and familiar forms of given names.
NICKNAMES = {
    "alexander": "alex sasha xander lex alec", "anthony": "tony", "charles": "chuck charlie chas", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "dorothea": "dora dot dorothy thea",
    "edward": "ed ned eddie", "eleanor": "nell ellie nora", "elizabeth": "liz beth betty lizzie eliza libby lisa", "francisco": "paco pancho curro", "gabriel": "gabe gabi", "henry": "harry hank", "james": "jim jimmy jamie",
    "jennifer": "jenny jen", "johannes": "hans hannes", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey", "katherine": "kathy kate katie kitty", "leonardo": "leo nardo", "margaret": "maggie peggy meg greta marge",
    "matthias": "matt matze hias", "michael": "mike mick mickey misha", "nicholas": "nick nicky klaus", "patricia": "trish pat patty tricia", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert",
    "samuel": "sam", "stephen": "steve", "susanna": "sue susie suzy sanna", "theodore": "ted theo teddy", "thomas": "tom tommy", "ulrike": "uli ulli rike", "viktor": "vitya vic", "william": "bill will billy willy liam",
}
# What stands for nobody.
NOBODY = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "unknown author", "untitled", "not set", "author", "authors", "admin", "administrator", "user", "various", "various authors", "anonymous", "anon", "et al", "et al.", "tbd", "?", "owner", "default", "guest", "root")
TITLES = frozenset("dr prof professor phd md msc bsc mr mrs ms miss sir dipl ing jr sr habil med".split())
KINDS = {"institute": "institute", "institut": "institute", "instituto": "institute", "inst": "institute", "university": "university", "universitat": "university", "universite": "university", "universidad": "university", "univ": "university", "verlag": "press", "vlg": "press", "press": "press", "publishers": "press", "editions": "press", "sons": "sons", "academy": "academy", "society": "society", "laboratory": "laboratory", "museum": "museum", "college": "college"}
LEGAL = frozenset("ltd limited gmbh inc llc plc co ag kg sa company".split())
SMALL = frozenset("the of for and und et y de la der die das fur des du".split())
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})
_MANY = re.compile(r";|&|\band\b|\bund\b|\bet al\b|\bwith\b|/", re.IGNORECASE)


def fold(text: str) -> str:
    """Small letters without accents."""
    low = text.lower().translate(_PLAIN)
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


#: word -> the given name it is or is short for.
GIVEN = {fold(name): fold(name) for name in GIVEN_NAMES} | {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()} | {full: full for full in NICKNAMES}
STATIC = frozenset(GIVEN) | frozenset(KINDS) | LEGAL | frozenset(["and", "of", "the", "phd", "prof"])
#: Fixed words of organisations so long that a word one edit away is no other word.
LONG_FIXED = frozenset(w for w in frozenset(KINDS) | LEGAL if len(w) >= 8)


def one_edit(a: str, b: str) -> bool:
    """Whether two different words are one insertion, deletion, substitution or exchange of neighbours apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


LONG_WORD = 64


def deletions(word: str) -> list[str]:
    """Keys of which two words one edit apart share one.

    The word and what it becomes when one letter is left out; for a long word, whose deletions would take its length
    squared, digests of its first and last parts of about half its length: one edit leaves one of them as it is.
    """
    n = len(word)
    out = {word, *(word[:i] + word[i + 1 :] for i in range(n))} if n <= LONG_WORD else set()
    if n >= LONG_WORD:
        out.add("=" + _digest(word))
        out |= {f"{side}{h}:{_digest(part)}" for h in range((n - 3) // 2, (n + 1) // 2 + 1) for side, part in (("<", word[:h]), (">", word[n - h :]))}
    return sorted(out)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def tokens(name: str) -> list[str]:
    """Folded words; ',' and the marks between several authors are words of their own, an initial keeps its dot."""
    text = re.sub(r"\([^)]*\)", " ", fold(name))
    text = re.sub(r"(?<=\w)[-‐‑](?=\w)(?!verlag)", "", text)
    text = re.sub(r"\bg\.\s?m\.\s?b\.\s?h\b\.?", "gmbh", text)
    return re.findall(r"[^\W\d_]+\.?|[,;&/]", text)


def words_for_lexicon(name: str) -> list[str]:
    """Words of a name that may be common to many names, in order: three letters or more, without dots and titles."""
    return [w for t in tokens(name) if len(w := t.rstrip(".")) > 2 and w not in TITLES]


def dotted_words(name: str) -> list[str]:
    """Words of three letters or more that are written with a dot, as abbreviations are."""
    return sorted({w for t in tokens(name) if t.endswith(".") and len(w := t.rstrip(".")) > 2 and w not in TITLES})


def same_root(a: str, b: str, least: int = 6, ending: int = 3) -> bool:
    """Whether two words begin alike and one is the other cut short, or both have short endings of their own."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k >= least and (k == min(len(a), len(b)) or max(len(a), len(b)) - k <= ending)


def neighbours(name: str) -> list[tuple[str, str]]:
    """(word, other) of words that stand next to each other, both ways round; alone, a word has itself."""
    words = words_for_lexicon(name)
    if len(words) == 1:
        return [(words[0], words[0])]
    return sorted({p for a, b in zip(words, words[1:]) for p in ((a, b), (b, a))})


def rests(name: str) -> list[tuple[str, int]]:
    """(word, rest): each word of a name with a number for its other words, in any order; none where there is no other."""
    words = sorted(set(words_for_lexicon(name)))
    codes = [0 if w in LEGAL or w in SMALL else int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=7).digest()) for w in words]
    whole = sum(codes)
    return [(w, (whole - c) % 2**56) for w, c in zip(words, codes) if whole != c]


#: What may have happened to a name before it was typed as it stands, and how likely that is.
CHANNEL = {"capitals": 0.1, "title": 0.1, "comma": 0.2, "swapped": 0.1, "nickname": 0.1, "middle": 0.1, "abbreviation": 0.1, "typo": 0.02, "article": 0.1, "legal": 0.1}


def read_name(name: str, known: Mapping[str, str]) -> tuple[str, str, str, float] | None:
    """(kind, part, stem, log-likelihood) of a name of one person or organisation, or None.

    ``known``: word -> the common word it is or is meant to be (typos put right), "~" + a common word -> anything, "^" + word -> the
    common word that it is short for or derived from.  A person has the given name or initial as part and the surname as stem; an organisation the
    words of its field as part.  The likelihood is that of this spelling given the plain one of the reading.
    """
    raw = tokens(name)
    words = [(t, known.get(t.rstrip("."), t.rstrip("."))) for t in raw]
    plain = [w for _, w in words]
    happened = ["typo" for t, w in words if t.rstrip(".") != w]
    letters = [c for c in name if c.isalpha()]
    if len(letters) > 1 and (all(map(str.isupper, letters)) or all(map(str.islower, letters))):
        happened.append("capitals")
    marks = [i for i, (t, w) in enumerate(words) if t in (";", "&", "/") or w in ("and", "und")]
    if marks and not (len(marks) == 1 and marks[0] + 1 < len(plain) and plain[marks[0] + 1] == "sons" and marks[0] > 0):
        return None
    kinds = [KINDS[w] for t, w in words if w in KINDS] + (["university"] if len(plain) > 1 and plain[0] == "u" and plain[1] == "of" else [])
    if kinds or any(w in LEGAL for w in plain):
        kind = kinds[0] if kinds else "company"
        rest = [(t, w) for t, w in words if w not in KINDS and w not in LEGAL and w not in SMALL and t not in (",", "&") and len(w) > 1]
        field = []
        if kind == "institute" and len(rest) > 1:
            field = [(t, w) for t, w in rest if known.get("~" + w) or known.get("^" + t.rstrip("."))]
            if len(field) == len(rest):  # an institute has a name of its own
                field = [(t, w) for t, w in field if known.get("~" + w)]
        meant = [known.get("^" + t.rstrip("."), w) if not known.get("~" + w) else w for t, w in field]
        happened += ["abbreviation" for (t, w), m in zip(field, meant) if m != w] + ["abbreviation" for t, _ in words if t.rstrip(".") in KINDS and t.endswith(".")]
        happened += ["article"] if plain[:1] == ["the"] else []
        happened += ["swapped"] if "," in raw else []
        happened += ["legal"] if not kinds or kind in ("press", "sons") and not any(w in LEGAL for w in plain) else []
        stem = " ".join(sorted({w for _, w in rest} - {w for _, w in field}))
        return (kind, " ".join(sorted(set(meant))), stem, _likelihood(happened)) if stem else None
    people = [(t, w) for t, w in words if w not in TITLES]
    happened += ["title"] if len(people) < len(words) else []
    while people and people[-1][0] == ",":
        people.pop()
    if sum(t == "," for t, _ in people) > 1:
        return None
    if any(t == "," for t, _ in people):
        at = next(i for i, (t, _) in enumerate(people) if t == ",")
        last, first = [w for _, w in people[:at]], [w for _, w in people[at + 1 :]]
        happened.append("comma")
    else:
        ws = [w for _, w in people]
        full = [w for w in ws if len(w) > 1]
        if len(full) == len(ws) and len(ws) > 1 and _is_given(ws[-1], known) and not _is_given(ws[0], known):
            last, first = ws[:-1], ws[-1:]
            happened.append("swapped")
        elif len(ws) > 1 and len(ws[0]) > 1 and all(len(w) == 1 for w in ws[1:]):
            last, first = ws[:1], ws[1:]
            happened.append("swapped")
        else:
            last, first = ws[-1:], ws[:-1]
    stem = "".join(w for w in last if len(w) > 1) or "".join(last)
    if not stem or not first:
        return ("person", "", stem, _likelihood(happened)) if stem else None
    given = GIVEN.get(first[0], first[0])
    happened += ["nickname"] if given != first[0] else []
    happened += ["middle"] if len(first) > 1 else []
    return "person", given, stem, _likelihood(happened)


def _likelihood(happened: list[str]) -> float:
    return sum(math.log(CHANNEL[h]) for h in happened)


def _is_given(word: str, known: Mapping[str, str]) -> bool:
    return word in GIVEN or bool(known.get("~" + word))
