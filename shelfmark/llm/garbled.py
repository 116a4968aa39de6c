"""Garbled text from wrong character encodings: finding and round-trip repair at corpus scale.

Every distinct value with anything but plain ASCII is repaired once: its damage is undone layer by layer by
re-encoding under candidate legacy encodings and strict decoding as the encoding meant, accepted when the garbling cost
drops (``mojibake.repair_layers``).  Damage between two single-byte encodings leaves text that decodes either
way; there the cost of a word is how rare it is in the corpus, from counts over all values: a word is put right if one
of its legacy readings is in ``least_ratio`` times as many different values, or rows where values don't tell.  Values with characters lost for good are found too, with a
null repair.

Defined results: null, blank and pure-ASCII values without lost characters are never garbled.  Repeated values are
judged alike.  Very long values are judged whole.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import mojibake as M
from shelfmark.session import cut_lineage

#: What keeps words apart: ASCII other than letters, as every legacy encoding leaves ASCII alone.
WORD_SEPARATOR = r"[\x00-\x40\[-\x60\{-\x7f]+"


JUDGEMENT = "struct<repaired string, layers int, lossy boolean, control boolean, reading string>"


def _judge(values: pd.Series) -> pd.DataFrame:
    rows = []
    for v in values:
        repaired, layers = M.repair_layers(v)
        rows.append((repaired, layers, M.is_lossy(v), M.has_control(v), None if layers else M.cheapest_reading(v)))
    return pd.DataFrame(rows, columns=["repaired", "layers", "lossy", "control", "reading"])


def _readings(words: pd.Series) -> pd.Series:
    return words.map(M.legacy_readings)


def word_counts(values: DataFrame) -> DataFrame:
    """(word, n, different, sure) in lower case over all of (value, n).

    ``different`` counts each value once, ``sure`` leaves out values with question marks.
    """
    sure = F.when(~F.contains("value", F.lit("?")), F.col("n")).otherwise(0).alias("sure")
    words = values.select("n", sure, F.explode(F.array_distinct(F.split(F.lower("value"), WORD_SEPARATOR))).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("different"), F.sum("sure").alias("sure"))


def judge_values(values: DataFrame, least_ratio: float = 3.0, least_count: int = 3) -> DataFrame:
    """(value, repaired) of the garbled ones among (value, n): distinct strings with their numbers of rows.

    ``repaired`` is null where characters are lost.  Word counts cover all values; the words looked up are those of
    values with other than ASCII characters, joined on the word, both sides hashed and sorted: the hints keep what grows with the data from being broadcast.
    """
    suspects = values.filter(F.col("value").rlike(r"[^\x20-\x7e]|\?")).select("value")
    # a number and a key of its own, as the adaptive plan would put so small a table into one task, whatever it costs to judge
    spread = suspects.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    # written down, as it is read four times and costs more than all else
    judged = cut_lineage(spread.withColumn("_j", F.pandas_udf(_judge, JUDGEMENT)("value")).select("value", "_j.*"))
    counts = cut_lineage(word_counts(values))
    words = judged.filter((F.col("layers") == 0) & ~F.col("lossy")).select("value", F.explode(F.array_distinct(F.split("value", WORD_SEPARATOR))).alias("_word")).filter(F.col("_word").rlike(r"[^\x00-\x7f]"))
    own = words.select("_word").distinct().withColumn("_reading", F.explode(F.pandas_udf(_readings, "array<string>")("_word")))
    # a letter read as another letter says nothing when it stands alone
    own = own.filter(~(F.col("_word").rlike(r"^\p{L}$") & F.col("_reading").rlike(r"^\p{L}$")))
    lowered = own.select("_word", "_reading", F.lower("_word").alias("_own"), F.lower("_reading").alias("_as"))
    as_, own_ = (counts.select(F.col("word").alias("_" + c), F.col("n").alias("_n_" + c), F.col("different").alias("_d_" + c)) for c in ("as", "own"))
    looked = lowered.join(as_.hint("merge"), "_as").join(own_.hint("merge"), "_own", "left").fillna(0, ["_n_own", "_d_own"])
    # one value in many rows vouches for nothing: rows decide only where the numbers of different values don't
    more_values = F.col("_d_as") >= least_ratio * F.col("_d_own")
    more_rows = (F.col("_n_as") >= least_ratio * F.col("_n_own")) & (F.col("_d_own") < least_ratio * F.col("_d_as"))
    better = looked.filter((F.col("_n_as") >= least_count) & (more_values | more_rows))
    best = better.groupBy("_word").agg(F.max(F.struct("_n_as", "_reading")).alias("_b")).select("_word", F.col("_b._reading").alias("_right"))
    put = words.join(best.hint("merge"), "_word").groupBy("value").agg(F.sort_array(F.collect_list(F.struct(F.length("_word").alias("_l"), "_word", "_right")), asc=False).alias("_pairs"))
    by_words = put.select("value", F.aggregate("_pairs", F.col("value"), lambda a, p: F.replace(a, p["_word"], p["_right"])).alias("_by_words"))
    # a question mark at the end is lost text if what stands before it is no word of the corpus
    asked = judged.filter(~F.col("lossy") & F.col("value").rlike(r"\pL\?$")).select("value", F.element_at(F.split(F.lower(F.regexp_replace("value", r"\?$", "")), WORD_SEPARATOR), -1).alias("_last"))
    cut = asked.join(counts.select(F.col("word").alias("_last"), "sure").hint("merge"), "_last", "left").filter(F.coalesce("sure", F.lit(0)) < least_count).select("value", F.lit(True).alias("_cut"))
    both = judged.join(by_words.hint("merge"), "value", "left").join(cut.hint("merge"), "value", "left").withColumn("lossy", F.col("lossy") | F.coalesce("_cut", F.lit(False)))
    found = both.filter((F.col("layers") > 0) | F.col("lossy") | F.col("control") | F.col("reading").isNotNull() | F.col("_by_words").isNotNull())
    lost = F.col("lossy") & (F.col("layers") == 0)
    repaired = F.when(F.col("layers") > 0, F.col("repaired")).when(~lost, F.coalesce("_by_words", "reading"))
    return found.select("value", repaired.alias("repaired"))


def distinct_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(value, n): the distinct non-null strings of several columns with their numbers of occurrences."""
    return df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def find_garbled(df: DataFrame, key: str = "doc_id", fields: Sequence[str] = ("metadata_title", "metadata_author", "metadata_creator")) -> DataFrame:
    """(key, field, value, repaired) of every garbled value."""
    found = judge_values(distinct_values(df, fields))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = df.select(F.col(key), F.inline(pairs)).filter(F.col("value").rlike(r"[^\x20-\x7e]|\?"))
    return rows.join(found.hint("merge"), "value").select(key, "field", "value", "repaired")
