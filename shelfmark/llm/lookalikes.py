"""Visually identical text in different characters, brought to one consistent form.

Two steps.  ``plain_form`` decides character by character what needs no context: invisible characters go, forms
of compatibility (full and half width, ligatures, radicals, letter-like signs, Roman numeral signs), unusual spaces and
hyphens become the ordinary character, and everything is composed.  Look-alike letters of another script need context:
the dominant script of each token is determined, and look-alikes in a token of mixed script are substituted only if the
result exists in the vocabulary of the whole corpus.  A token made of nothing but look-alikes is its own word
unless the substituted one is ``least_ratio`` times as frequent (a word that is written otherwise nearly everywhere).

Defined results: null values give no row; an empty or blank value is its own form; very long values are treated whole;
repeated rows give repeated results; columns of other names are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut_lineage

# Letters that look the same in Latin, Cyrillic and Greek; '.' where a script has none.
LATIN = "A B C E H I J K M N O P S T X Y Z a c e h i j o p s v x y k u n".split()
CYRILLIC = "А В С Е Н І Ј К М . О Р Ѕ Т Х У . а с е һ і ј о р ѕ ѵ х у . . .".split()
GREEK = "Α Β . Ε Η Ι . Κ Μ Ν Ο Ρ . Τ Χ Υ Ζ . . . . ι . ο ρ . ν χ . κ υ .".split()
TO_LATIN = {o: x for row in (CYRILLIC, GREEK) for x, o in zip(LATIN, row) if o != "."}
TO_CYRILLIC = {x: c for x, c in zip(LATIN, CYRILLIC) if c != "."} | {g: c for g, c in zip(GREEK, CYRILLIC) if "." not in (g, c)}
TO_GREEK = {x: g for x, g in zip(LATIN, GREEK) if g != "."} | {c: g for g, c in zip(GREEK, CYRILLIC) if "." not in (g, c)}
LONE = "АЕОУХаеоухіІ"
TABLES = {"latin": str.maketrans(TO_LATIN), "cyrillic": str.maketrans(TO_CYRILLIC), "greek": str.maketrans(TO_GREEK)}

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿￹-￻]")
_SPACES = re.compile("[   -     ]")
_HYPHENS = re.compile("[‐‑﹘﹣－¯˗]")
_JOINED = re.compile("[֐-ࣿऀ-႟ក-៿\U0001f000-\U0001faff☀-➿️᠀-᢯]")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")
_STRAY_MARK = re.compile("[A-Za-zÀ-ɏͰ-ԯḀ-῿][̀-ͯ]")
KEPT = "ªº"


@lru_cache(maxsize=5000)
def _ordinary(c: str) -> str:
    """The ordinary character(s) for a compatibility form of a letter or digit; anything else as it is."""
    got = unicodedata.normalize("NFKC", c)
    if got == c or c in KEPT:
        return c
    o, cat = ord(c), unicodedata.category(c)
    if 0x2E80 <= o <= 0x2FDF or cat[0] == "L" or cat in ("Nd", "Nl") or 0xFF61 <= o <= 0xFFDC:
        return got
    return c


_RADICALS = re.compile("[⺀-⿟]")
_MAY_CHANGE = re.compile("[^\x00-\x7f]")


def plain_form(text: str) -> str:
    """The text in ordinary, composed characters, as far as single characters decide it."""
    if not _MAY_CHANGE.search(text):
        return text
    out = []
    for i, c in enumerate(text):
        if ord(c) < 128:
            out.append(c)
        elif _INVISIBLE.match(c):
            around = text[i - 1 : i] + text[i + 1 : i + 2]
            if _JOINED.search(around):
                out.append(c)
        elif _SPACES.match(c):
            out.append(" ")
        elif c == "　" and not _CJK.search(text):
            out.append(" ")
        elif _HYPHENS.match(c):
            out.append("-")
        elif 0xFF01 <= ord(c) <= 0xFF5E and not c.isalnum():
            out.append(c if _CJK.search(text) else chr(ord(c) - 0xFEE0))
        else:
            out.append(c)
    # half-width kana with their voicing marks become one character only together
    joined = re.sub("[｡-ﾟ]+", lambda m: unicodedata.normalize("NFKC", m[0]), "".join(out))
    return unicodedata.normalize("NFC", "".join(map(_ordinary, joined)))


@lru_cache(maxsize=20000)
def script(c: str) -> str:
    """``latin``, ``cyrillic``, ``greek`` or '' (no letter of these)."""
    if c.isascii():
        return "latin" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "")
    return next((s for s in ("latin", "cyrillic", "greek") if name.startswith(s.upper())), "")


def readings(token: str) -> list[str]:
    """Tokens of one script that look like ``token``: all its letters in Latin, Cyrillic or Greek."""
    scripts = {s for s in map(script, token) if s}
    if not scripts:
        return []
    out = []
    for target in ("latin", "cyrillic", "greek"):
        got = unicodedata.normalize("NFC", token.translate(TABLES[target]))
        if got != token and {s for s in map(script, got) if s} == {target}:
            out.append(got)
    return out


def dominant_script(token: str) -> str:
    """The script of most letters of a token; letters that look the same elsewhere count least."""
    weight = {"latin": 0.0, "cyrillic": 0.0, "greek": 0.0}
    for c in token:
        if s := script(c):
            shared = any(c in row for row in (LATIN, CYRILLIC, GREEK))
            weight[s] += 0.25 if shared else 1.0
    return max(weight, key=lambda s: weight[s])


def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else plain_form(v))


READINGS = "array<struct<token string, reading string, script string, mixed boolean, dominant string>>"


def _token_readings(tokens: pd.Series) -> pd.Series:
    def one(t):
        mixed = len({s for s in map(script, t) if s}) > 1
        return [(t, r, next(s for s in map(script, r) if s), mixed, dominant_script(t)) for r in readings(t)]

    return tokens.map(one)


def tokens_of(value: Column) -> Column:
    """Words of a name: letters, marks and digits together, parted again where a small letter meets a capital."""
    parted = F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(parted, r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")


def whole_tokens(value: Column) -> Column:
    """The words that ``tokens_of`` parts, unparted."""
    return F.filter(F.split(value, r"[^\p{L}\p{N}\p{M}]+"), lambda t: t.rlike(r"\p{Ll}\p{Lu}"))


def vocabulary(plain: DataFrame) -> DataFrame:
    """(word, n): lower-case tokens of all plain values, run-together ones also as a whole, with their occurrences."""
    words = F.concat(tokens_of(F.col("plain")), whole_tokens(F.col("plain")))
    return plain.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def consistent_forms(values: DataFrame, least_ratio: float = 10.0, least_count: int = 3) -> DataFrame:
    """``values`` (field, row_id, value) with the columns plain and form.

    The tables are read once: names with their plain form are written to the shared folder, and Python gets only the values with other than
    ASCII characters.  Tokens are judged once each: their readings are joined with the corpus vocabulary on the word, both sides hashed and sorted.
    """
    foreign_value = F.when(F.col("value").rlike(r"[^\x00-\x7f]"), F.col("value"))
    written = cut_lineage(values.withColumn("_plain", F.pandas_udf(_plain, "string")(foreign_value)).withColumn("plain", F.coalesce("_plain", "value")))
    ascii_only, others = (written.filter(F.col("_plain").isNull() if a else F.col("_plain").isNotNull()).drop("_plain") for a in (True, False))
    words = vocabulary(written.select("plain"))
    foreign = others.filter(F.col("plain").rlike(r"[Ͱ-ϿЀ-ԯ]"))
    # A token may have a reading only if it holds a Greek or Cyrillic letter; short or single letters are left alone.
    in_values = foreign.select("field", "row_id", F.explode(F.array_distinct(F.concat(tokens_of(F.col("plain")), whole_tokens(F.col("plain"))))).alias("token")).filter(F.col("token").rlike(r"[Ͱ-ϿЀ-ԯ]"))
    options = in_values.select("token").distinct().select(F.inline(F.pandas_udf(_token_readings, READINGS)("token")))
    options = options.filter(F.col("mixed") | (F.length("token") > 1))
    known = options.withColumn("_r", F.lower("reading")).withColumn("_t", F.lower("token"))
    known = known.join(words.select(F.col("word").alias("_r"), F.col("n").alias("n_reading")).hint("merge"), "_r").join(words.select(F.col("word").alias("_t"), F.col("n").alias("n_token")).hint("merge"), "_t", "left")
    other = (F.col("n_reading") >= least_count) & (F.col("n_reading") >= least_ratio * F.coalesce("n_token", F.lit(0)))
    taken = known.filter(F.col("mixed") | other)
    # of the readings that occur, the one in the token's dominant script, unless another is ``least_ratio`` times as frequent
    weight = F.col("n_reading") * F.when(F.col("script") == F.col("dominant"), least_ratio).otherwise(1.0)
    best = taken.groupBy("token").agg(F.max_by("reading", F.struct(weight.alias("w"), "reading")).alias("reading"))
    put = in_values.join(best.hint("merge"), "token").groupBy("field", "row_id").agg(F.sort_array(F.collect_list(F.struct(F.length("token").alias("l"), "token", "reading")), asc=False).alias("_pairs"))
    joined = others.join(put.hint("merge"), ["field", "row_id"], "left")
    form = F.when(F.col("_pairs").isNull(), F.col("plain")).otherwise(F.aggregate("_pairs", F.col("plain"), lambda a, p: F.replace(a, p["token"], p["reading"])))
    # A single letter is a word in every script; it is a look-alike where nothing else in the value is of its script.
    lone = r"(?<![\p{L}\p{N}\p{M}])[" + LONE + r"](?![\p{L}\p{N}\p{M}])"
    alone = F.col("form").rlike(lone) & ~F.regexp_replace("form", lone, "").rlike(r"[Ѐ-ԯ]")
    judged = joined.withColumn("form", form).drop("_pairs")
    judged = judged.withColumn("form", F.when(alone, F.translate("form", LONE, LONE.translate(TABLES["latin"]))).otherwise(F.col("form")))
    return ascii_only.withColumn("form", F.col("plain")).unionByName(judged)


def name_values(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """(field, row_id, value) of the registry's names and paths; one row per stored value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("file_name", "normalised_name")])
    docs = documents.select(F.col("doc_id").alias("row_id"), F.inline(pairs))
    rel = paths.select(F.col("id").alias("row_id"), F.lit("rel_path").alias("field"), F.col("rel_path").alias("value"))
    return docs.unionByName(rel).filter(F.col("value").isNotNull())


def find_unusual(values: DataFrame) -> DataFrame:
    """(field, row_id, value, form) of the values that aren't in their consistent form."""
    forms = consistent_forms(values)
    stray = F.col("form").rlike("[A-Za-z\\u00c0-\\u024f\\u0370-\\u052f\\u1e00-\\u1fff][\\u0300-\\u036f]")
    return forms.filter((F.col("form") != F.col("value")) | stray).select("field", "row_id", "value", "form")
