"""Words of many languages, read off the vocabularies of public tokenizers; their paths are a parameter.

A tokenizer's vocabulary holds the frequent words of the text it was made from as tokens behind a space.  Those in small letters are
common words; those with a capital that have no small form are mostly proper nouns.
"""

from __future__ import annotations

import base64
from functools import lru_cache

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Shorter tokens are pieces of words as often as words.
LEAST = 4
ENDINGS = ("s", "es", "n", "en", "e", "er", "a")


@lru_cache(maxsize=2)
def words(paths: tuple[str, ...] = VOCABULARIES) -> tuple[frozenset[str], frozenset[str]]:
    """(common words in small letters, proper nouns) of the vocabularies; read once per process."""
    small, capital = set(), set()
    for path in paths:
        with open(path, "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and len(token) > LEAST:
                    word = token[1:].decode("utf-8", "replace")
                    if word.isalpha():
                        (small if word.islower() else capital if word.istitle() else set()).add(word)
    return frozenset(small), frozenset(w for w in capital if w.lower() not in small)


@lru_cache(maxsize=50_000)
def word_class(word: str) -> str:
    """``common``, ``proper`` or '' for a word of no vocabulary; endings of plurals and the like are looked behind."""
    small, proper = words()
    low = word.lower()
    if low in small or any(low.endswith(e) and len(low) - len(e) > 4 and low[: -len(e)] in small for e in ENDINGS):
        return "common"
    return "proper" if low.title() in proper else ""
