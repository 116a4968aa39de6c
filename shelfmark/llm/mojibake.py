"""Round-trip repair of one string: the pure-Python core of the garbled-text operator.

A layer of damage is undone by re-encoding the text under the legacy encoding it was wrongly read with and decoding
the bytes strictly as the encoding they were written in; ``repair_layers`` repeats that for nested layers and accepts
a layer only if the garbling cost drops.  No corpus is needed here; damage between two single-byte encodings, which
any bytes survive, is left to ``legacy_readings`` and the corpus counts of the operator.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from functools import lru_cache

#: Encodings that UTF-8 text may have been read with.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "gbk", "cp932", "big5")
#: (read with, written in) of text in legacy encodings.
WRONG_FOR_LEGACY = (
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"),
    ("latin-1", "cp1252"), ("cp1252", "gbk"), ("cp1252", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "big5"),
    ("mac_roman", "cp1252"), ("mac_roman", "cp1251"), ("mac_roman", "cp1250"), ("mac_roman", "gbk"), ("mac_roman", "cp932"),
    ("cp437", "cp1252"), ("cp437", "cp1250"), ("cp437", "cp1251"), ("cp437", "gbk"), ("cp437", "cp932"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "cp852"), ("cp1252", "cp852"),
    ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("cp1251", "gbk"), ("koi8-r", "cp1251"), ("koi8-r", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8-r"), ("gbk", "cp932"), ("cp932", "gbk"), ("cp1250", "cp1251"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("latin-1", "iso8859-2"),
    ("gbk", "cp1252"), ("gbk", "cp1251"), ("cp932", "cp1252"), ("cp932", "cp1251"), ("gbk", "cp1250"), ("cp1251", "cp1250"), ("cp1251", "cp932"), ("cp1251", "euc_jp"), ("gbk", "euc_jp"), ("gbk", "big5"), ("big5", "gbk"),
)


def _passed_through(e):
    """Bytes that an encoding leaves undefined reach the text as the control characters of the same number."""
    if isinstance(e, UnicodeEncodeError) and all(ord(c) < 256 for c in e.object[e.start : e.end]):
        return e.object[e.start : e.end].encode("latin-1"), e.end
    raise e


codecs.register_error("passed_through", _passed_through)

_NON_ASCII_RUN = re.compile(r"[^\x00-\x7f]+(?:[ \x40-\x7e](?=[^\x00-\x7f]))?(?:[^\x00-\x7f]+)*")
_NON_ASCII_WORD = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_LOST = re.compile(r"�|\?\?|(?<=\w)\?(?=\w)|(?<![^\W_])\?(?=[^\W\d_]|\.)|(?<=\w)\?(?= +\w|,)|^\?$")
_UTF16 = re.compile(r"^(?:þÿ|ÿþ)")


@lru_cache(maxsize=20000)
def _kind(c: str) -> str:
    """Script of a letter, or the class of any other character."""
    o = ord(c)
    if o < 128:
        return "latin" if c.isalpha() else "ascii"
    cat = unicodedata.category(c)
    if cat[0] == "L":
        name = unicodedata.name(c, "?")
        for s in ("LATIN", "CYRILLIC", "GREEK", "HIRAGANA", "KATAKANA", "CJK", "HANGUL", "BOPOMOFO"):
            if name.startswith(s) or s + " LETTER" in name:
                if s == "KATAKANA" and o >= 0xFF00 or name.startswith("HALFWIDTH"):
                    return "halfkana"
                return s.lower()
        return "mark" if c in "ªºˆ" else "rare"
    if cat in ("Co", "Cn", "Cs") or cat == "Cc":
        return "control"
    if 0x2500 <= o < 0x25A0:
        return "box"
    return "mark"


#: Letters of the languages the corpus is written in; other Latin letters are rare.
COMMON_LATIN = frozenset("àâäáãåæçéèêëíìîïñóòôöõøœßúùûüýÿąćęłńśźżÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝĄĆĘŁŃŚŹŻ")
COMMON_MARKS = frozenset("–—‘’‚“”„…«»¿¡·•°±²³×÷§©®™№€£µ¼½¾、。「」『』・（）：！？，；《》【】〈〉～￥　")


def garbling_cost(text: str) -> float:
    """How much a string looks garbled: control and box characters, marks and scripts mixed into words, odd case."""
    cost, before, prev, inside, run = 0.0, "ascii", " ", False, 0
    for i, c in enumerate(text):
        k = _kind(c)
        if k == "cjk":
            inside = before == "latin" or inside and before == "cjk"
        elif k == "latin" and before == "cjk" and inside:
            cost += 1  # Han characters within a Latin word
        if k == "control":
            cost += 3 if c not in "\t\n\r" else 0
        elif k == "box":
            cost += 2
        elif k == "rare":
            cost += 2
        elif k == "bopomofo":
            cost += 2
        elif k == "mark":
            after = text[i + 1] if i + 1 < len(text) else " "
            if c not in COMMON_MARKS:
                cost += 1
            elif c == "·":
                cost += 0 if prev in "lL" and after in "lL" else 1 if prev.isalpha() and after.isalpha() else 0
            elif c == "±" and before in ("latin", "cyrillic", "greek") or c == "‚" and before == "latin" or c in "£¥" and after.isalpha():
                cost += 1
            elif c != "’" and before in ("latin", "cyrillic") and (after.isalpha() or ord(after) > 127) and not (c in "³²" and not after.isalpha()):
                cost += 1
            if c == "\xa0" or c == "\xad":
                cost += 0.5
            if before == "mark":
                cost += 0.5
        elif k in ("latin", "cyrillic", "greek"):
            if before in ("latin", "cyrillic", "greek") and before != k:
                # words of different scripts may be written together; a letter or two among others' letters isn't a word
                cost += 1.5 if min(run, _run_ahead(text, i, k)) < 3 else 0
            elif before == "mark" and prev in COMMON_MARKS and prev in "©®™³²±§°µ¼½¾¢" or before == "box":
                cost += 1
            if k == "latin" and ord(c) > 127:
                if c not in COMMON_LATIN or c == "ß" and prev.lower() in "bcdfghjklmnpqrstvwxz":
                    cost += 1
                elif before == "latin" and c.isupper() and prev.islower():
                    cost += 1
                elif before == "latin" and ord(prev) > 127:
                    cost += 0.3
            elif k != "latin" and c.isupper() and prev.islower() and before == k:
                cost += 1
            elif k == "cyrillic" and not ("а" <= c.lower() <= "я" or c in "ёЁ"):
                cost += 1
        elif k == "halfkana":
            cost += 0.6 if before not in ("latin", "cjk") else 1
        elif k == "cjk":
            cost += 0.25 if before in ("latin", "cyrillic") else 0.05
            if ord(c) >= 0xF900:
                cost += 1
        run = run + 1 if k == before else 1
        before, prev = k, c
    return cost


def _run_ahead(text: str, i: int, kind: str) -> int:
    """Letters of one script from ``i`` on, counted up to three."""
    n = 0
    while n < 3 and i + n < len(text) and _kind(text[i + n]) == kind:
        n += 1
    return n


def _unread(run: str, wrong: str, right: str) -> str | None:
    try:
        return run.encode(wrong, "passed_through").decode(right)
    except (UnicodeError, LookupError):
        return None


def _layer_off(text: str, wrong: str, pattern: re.Pattern) -> str:
    """What the text becomes when runs of it are re-encoded under a legacy encoding and decoded as UTF-8."""

    def undo(m):
        got = _unread(m[0], wrong, "utf-8")
        return m[0] if got is None or _CONTROL.search(got) and not _CONTROL.search(m[0]) else got

    return pattern.sub(undo, text)


def _layers_off(text: str) -> list[str]:
    """What the text becomes under each legacy encoding."""
    out = []
    # runs of words first, as double-byte encodings may take in what stands between; then word by word, for text damaged in part
    for pattern in (_NON_ASCII_RUN, _NON_ASCII_WORD):
        for wrong in WRONG_FOR_UTF8:
            got = _layer_off(text, wrong, pattern)
            if got != text and got not in out:
                out.append(got)
    return out


def _chains(text: str) -> list[tuple[str, int]]:
    """What comes of undoing layers of one and the same encoding, after each of them, as many as there are."""
    out = []
    for wrong in WRONG_FOR_UTF8:
        got, n = text, 0
        while (more := _layer_off(got, wrong, _NON_ASCII_RUN)) != got:
            got, n = more, n + 1
            if n > LOOKAHEAD:
                out.append((got, n))
    return out


def undo_utf16(text: str) -> str:
    """UTF-16 read byte by byte, its zero bytes dropped: a control character is half of a character.

    Up to 0x05 it is the upper half (Latin extensions, Greek, Cyrillic) and the next character the lower one; above it
    is the lower half, and the character before it the upper one.
    """
    out, body, i = [], text[2:], 0
    while i < len(body):
        c, after = ord(body[i]), ord(body[i + 1]) if i + 1 < len(body) else 256
        if 1 <= c <= 5 and after < 256:
            out.append(chr(c * 256 + after))
            i += 2
        elif 0x20 <= c < 256 and 5 < after < 0x20 and body[i + 1] not in "\t\n\r":
            out.append(chr(c * 256 + after))
            i += 2
        else:
            out.append(body[i])
            i += 1
    return "".join(out)


def repair_layers(text: str) -> tuple[str, int]:
    """The text with its layers of UTF-8 damage undone, as long as the cost drops, and their number.

    There is no bound on the layers: what a search finds is searched again until nothing better comes of it.
    """
    if _UTF16.search(text) and len(text) > 2:
        return undo_utf16(text), 1
    layers = 0
    while True:
        found, more = _search(text, LOOKAHEAD)
        if more:  # deeper ones of one encoding, where a search that looks less far goes astray
            least = garbling_cost(found) + 0.01 * more
            for got, n in _chains(text):
                if (c := garbling_cost(got) + 0.01 * n) < least:
                    found, more, least = got, n, c
        text = found
        if not more:
            return text, layers
        layers += more


#: Layers that one search looks ahead.
LOOKAHEAD = 3


def _search(text: str, ahead: int) -> tuple[str, int]:
    """The best of what ``text`` becomes when layers are undone, and their number.

    Of the ways to undo a layer the one counts whose own repair ends at the least cost, so that doubly garbled text
    isn't led astray by an encoding that looks better for one layer.
    """
    best, least, layers = text, garbling_cost(text), 0
    if ahead and least > 0:
        for got in _layers_off(text):
            end, more = _search(got, ahead - 1)
            if (c := garbling_cost(end) + 0.01 * more) < least - 0.2:
                best, least, layers = end, c, more + 1
    return best, layers


def legacy_readings(word: str) -> list[str]:
    """What a word would read as if it was written in one legacy encoding and read with another."""
    out = []
    for wrong, right in WRONG_FOR_LEGACY:
        got = _unread(word, wrong, right)
        if got and got != word and not _CONTROL.search(got) and got not in out:
            out.append(got)
    return out


def is_lossy(text: str) -> bool:
    """Whether characters were replaced for good: U+FFFD or question marks where letters stood."""
    return bool(_LOST.search(text))


def has_control(text: str) -> bool:
    """Whether the text holds control characters that no writer types."""
    return bool(_CONTROL.search(text))


def cheapest_reading(text: str, least_drop: float = 0.8) -> str | None:
    """The legacy reading of a whole text with the least garbling cost, if that is lower by ``least_drop``."""
    cost, best = garbling_cost(text), None
    if cost < least_drop:
        return None
    least = cost - least_drop
    for got in legacy_readings(text):
        if (c := garbling_cost(got)) <= least:
            best, least = got, c - 1e-9
    return best
