"""Personal information in free text: found by a semi-Markov conditional random field, replaced by typed placeholders.

Texts are independent, so this is one pass without a shuffle: candidate segments are made for each whole text, scored by
the features of the span and its surroundings, and the best labelling is decoded.  The weights are fitted on the driver
(``pii_model``) and shipped to the workers; they are some two thousand numbers whatever the data.  Every worker reads the list of
common words (``lexicon``) from vocabulary files of public tokenizers.

Defined results: null and empty texts have no segments and are returned as they are; very long texts are processed whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import pii_model
from shelfmark.llm.pii_segments import candidates

SEGMENTS = "array<struct<kind string, start_pos bigint, end_pos bigint>>"


def _finder(weights: dict[str, float]):
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else [(k, s, e) for s, e, k in pii_model.decode(candidates(t), weights)])

    return find


def find_segments(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_pos, end_pos) of every item; positions in characters, ends exclusive."""
    find = F.pandas_udf(_finder(pii_model.fitted()), SEGMENTS)
    rows = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), find(F.col(text)).alias("_s"))
    return rows.select(key, F.inline("_s"))


def redact_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, items): the text with ``[KIND]`` in the place of each item and all else unchanged, and their number."""
    find = _finder(pii_model.fitted())

    def redact(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, segments in zip(texts, find(texts)):
            parts, at = [], 0
            for kind, start, end in segments:
                parts += [t[at:start], f"[{kind.upper()}]"]
                at = end
            rows.append((None if t is None else "".join([*parts, t[at:]]), len(segments)))
        return pd.DataFrame(rows, columns=["text", "items"])

    done = df.select(F.col(key), F.pandas_udf(redact, "struct<text string, items bigint>")(F.col(text)).alias("_r"))
    return done.select(key, "_r.text", "_r.items")
