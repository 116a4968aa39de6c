"""Variant spellings of names: noisy-channel attribution at corpus scale.

Every distinct spelling is read as (kind, part, stem): person, given name or initial, surname; or kind of organisation, field, proper
name.  Words common to many names (given names, fields) are learnt from the corpus by the number of different
words they stand beside; typos in them are put right and abbreviations of them understood.  A reading is a candidate canonical form; its
frequency is its prior.  Then every spelling and every form is attached to the candidate of greatest posterior,
log n(c) + log P(v | c), where P is the product of the likelihoods of what happened on the way:

* spelling to reading (``N.CHANNEL``): capitals, a title, another order, a nickname, a middle name, an abbreviation, a typo in a common word;
* form to form: a typo in the stem, a typo in the part, a given name shortened to its initial, a given name left out, one of an organisation's words abbreviated.

Staying a name of its own costs the chance that two different names are that near (``OTHER_NAME``).  Attachment is always to a form of higher
rank (fuller, then more frequent), so that it can't go in circles, and is followed to its end, however long the way is.

No group's pairs are formed.  Forms with equal stems meet only through the most frequent one of their initial; forms one edit apart
through the stem (or part) with one letter left out.  No cap is set on candidates.  Two edits are bridged only where a form between them exists.

Defined results: null, blank and placeholder names, names of more than one author and garbled ones are linked to nothing;
repeated names count once, by their rows; very long names are read whole; an empty table gives no links.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import names as N
from shelfmark.llm.garbled import judge_values
from shelfmark.session import cut_lineage

#: Likelihoods between forms, and the chance of a different name beside a known one.
TYPO, INITIAL, LEFT_OUT, ABBREVIATION, OTHER_NAME = 0.01, 0.15, 0.002, 0.02, 1e-4
#: Different neighbours, each with fewer neighbours itself, that make a word a common one.
COMMON = 15
#: Rows of names with a common word for each row of the same names with its typo.
LEAST_TIMES = 2
#: Rows of a fixed word for each row of its typo, where no equal names tell.
RARE_TIMES = 10
#: Shortest stem in which one edit is taken for a typo.
LEAST_STEM = 5
#: Shortest given name in which one edit is taken for a typo.
LEAST_PART = 5
#: Letters in which a word derived from a common one agrees with it.
ROOT = 6
#: Spellings of a class that one task pairs with all others of the class.
PAIRED = 1000


def _words(values: pd.Series) -> pd.Series:
    return values.map(lambda v: sorted(set(N.words_for_lexicon(v))))


def _neighbours(values: pd.Series) -> pd.Series:
    return values.map(N.neighbours)


def _dotted(values: pd.Series) -> pd.Series:
    return values.map(N.dotted_words)


def _rests(values: pd.Series) -> pd.Series:
    return values.map(N.rests)


def _deletions(values: pd.Series) -> pd.Series:
    return values.map(N.deletions)


def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([N.one_edit(x, y) for x, y in zip(a, b)], dtype="bool")


def _same_root(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([N.same_root(x, y, ROOT) for x, y in zip(a, b)], dtype="bool")


def _read(values: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = []
    for v, k in zip(values, known):
        table: dict[str, str] = {}
        for p in k if k is not None else ():
            if p["short"]:
                table["^" + p["word"]] = p["as_"]
            else:
                table[p["word"]] = p["as_"]
                table["~" + p["as_"]] = "common"
        rows.append(N.read_name(v, table) or (None, None, None, None))
    return pd.DataFrame(rows, columns=["kind", "part", "stem", "likelihood"])


def clean_names(values: DataFrame) -> DataFrame:
    """(value, n) without names that stand for nobody and without garbled ones."""
    text = F.lower(F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    someone = values.filter(~text.isin(*N.NOBODY))
    # written down, as all that follows reads it again and again, and no plan should hold the judging of values twice
    return cut_lineage(someone.join(judge_values(values).select("value"), "value", "left_anti"))


def lexicon(spelt: DataFrame) -> DataFrame:
    """(word, as_, short): words of names that are common, as themselves, their typos, as the common word, and what is short for or derived from one."""
    pairs = cut_lineage(spelt.select(F.inline(F.pandas_udf(_neighbours, "array<struct<word string, other string>>")("value"))).distinct())
    seen = cut_lineage(pairs.groupBy("word").agg(F.count_distinct(F.when(F.col("other") != F.col("word"), F.col("other"))).alias("beside")))
    # a given name stands beside surnames, which are rarer than itself; a surname beside given names, which are not
    rarer = pairs.join(seen, "word").join(seen.select(F.col("word").alias("other"), F.col("beside").alias("_b")), "other").filter("_b < beside").groupBy("word").agg(F.count("*").alias("rarer"))
    static = F.col("word").isin(*sorted(N.STATIC))
    common = seen.join(rarer, "word", "left").filter(static | (F.coalesce("rarer", F.lit(0)) >= COMMON)).select("word")
    common = cut_lineage(common.unionByName(spelt.sparkSession.createDataFrame([(w,) for w in sorted(N.STATIC)], "word string")).distinct())
    dels = F.pandas_udf(_deletions, "array<string>")
    rare = seen.filter(~static).filter(F.length("word") > 2).select(F.col("word").alias("typo"), F.explode(dels("word")).alias("d"))
    near = rare.join(common.filter(F.length("word") > 2).select(F.col("word").alias("as_"), F.explode(dels("word")).alias("d")), "d").filter("typo <> as_").drop("d").distinct()
    near = cut_lineage(near.filter(F.pandas_udf(_one_edit, "boolean")("typo", "as_")))
    typos = _typos(near, spelt)
    same = cut_lineage(common.select("word", F.col("word").alias("as_")).join(typos, "word", "left_anti").unionByName(typos))
    # learnt words long enough to have a root; those standing beside most different words come first
    roots = same.filter((F.col("word") == F.col("as_")) & (F.length("word") >= ROOT) & ~static).join(seen, "word").select(F.col("word").alias("as_"), "beside")
    derived = seen.select("word").filter(F.length("word") >= ROOT).join(same, "word", "left_anti").withColumn("_root", F.substring("word", 1, ROOT)).join(roots.withColumn("_root", F.substring("as_", 1, ROOT)), "_root")
    dotted = spelt.select(F.explode(F.pandas_udf(_dotted, "array<string>")("value")).alias("word")).distinct()
    abbreviated = dotted.join(roots.withColumn("word", F.explode(F.transform(F.sequence(F.lit(3), F.length("as_") - 1), lambda n: F.substring("as_", F.lit(1), n)))), "word").join(same, "word", "left_anti")
    short = derived.select("word", "as_", "beside").unionByName(abbreviated.select("word", "as_", "beside")).groupBy("word").agg(F.max_by("as_", F.struct("beside", "as_")).alias("as_"))
    return cut_lineage(same.withColumn("short", F.lit(False)).unionByName(short.withColumn("short", F.lit(True))))


def _typos(near: DataFrame, spelt: DataFrame) -> DataFrame:
    """(word, as_): the words of (typo, as_), one edit apart, that are written for the common word.

    Judged by names that are equal but for the word: in most of those with the typo, and in ``LEAST_TIMES`` as many rows,
    the common word must stand in its place; a fixed word need not be in more rows there, so that one typo repeated in many
    rows doesn't vouch for itself, but must be in ``LEAST_TIMES`` as many different names.  Rare names may lack that witness: a fixed word is also put right where it has
    ``RARE_TIMES`` the rows of its typo in the whole table, and a long fixed word of organisations always.  Only shares and ratios
    count, so that the size of the table doesn't matter.
    """
    inside = cut_lineage(spelt.select(F.inline(F.pandas_udf(_rests, "array<struct<word string, rest bigint>>")("value")), "n").groupBy("word", "rest").agg(F.sum("n").alias("n")))
    typo = near.join(inside.select(F.col("word").alias("typo"), "rest", F.col("n").alias("n_typo")), "typo")
    both = typo.join(inside.select(F.col("word").alias("as_"), "rest", F.col("n").alias("n_as")), ["as_", "rest"], "left")
    sums = both.groupBy("typo", "as_").agg(F.count("*").alias("names"), F.count("n_as").alias("met"), F.sum(F.when(F.col("n_as").isNotNull(), F.col("n_typo"))).alias("n_typo"), F.sum("n_as").alias("n_as"))
    total = inside.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("names"))
    sums = sums.join(total.select(F.col("word").alias("as_"), F.col("names").alias("names_as")), "as_")
    of_fixed = F.col("as_").isin(*sorted(N.STATIC)) & (F.least(F.length("typo"), F.length("as_")) >= LEAST_STEM) & (F.col("names_as") >= LEAST_TIMES * F.col("names"))
    met = sums.filter((F.col("met") * 2 >= F.col("names")) & ((F.col("n_as") >= LEAST_TIMES * F.col("n_typo")) | of_fixed))
    long = F.least(F.length("typo"), F.length("as_")) >= LEAST_STEM
    fixed = near.filter(F.col("as_").isin(*sorted(N.STATIC)) & long).join(total.select(F.col("word").alias("typo"), F.col("n").alias("n_typo")), "typo", "left").join(total.select(F.col("word").alias("as_"), F.col("n").alias("n_all")), "as_", "left")
    fixed = fixed.filter(F.col("as_").isin(*sorted(N.LONG_FIXED)) | (F.col("n_all") >= RARE_TIMES * F.col("n_typo"))).select("typo", "as_", F.lit(None).cast("bigint").alias("n_as"))
    return met.select("typo", "as_", "n_as").unionByName(fixed).groupBy(F.col("typo").alias("word")).agg(F.max_by("as_", F.struct("n_as", "as_")).alias("as_"))


def read_names(spelt: DataFrame) -> DataFrame:
    """(value, n, kind, part, stem, likelihood) of the spellings that name one person or organisation."""
    words = spelt.select("value", F.explode(F.pandas_udf(_words, "array<string>")("value")).alias("word"))
    known = words.join(lexicon(spelt), "word").groupBy("value").agg(F.collect_list(F.struct("word", "as_", "short")).alias("known"))
    rows = spelt.join(known, "value", "left").withColumn("_r", F.pandas_udf(_read, "struct<kind string, part string, stem string, likelihood double>")("value", "known"))
    return rows.select("value", "n", "_r.*").filter("kind is not null")


def attach(forms: DataFrame) -> DataFrame:
    """(id, root): the canonical form of each form (id, kind, part, stem, n) by greatest posterior."""
    dels = F.pandas_udf(_deletions, "array<string>")
    near = F.pandas_udf(_one_edit, "boolean")
    person = F.col("kind") == "person"
    ranked = cut_lineage(forms.withColumn("full", F.when(person, F.least(F.length("part"), F.lit(2))).otherwise(F.lit(2))).withColumn("lead", F.substring("part", 1, 1)))
    rank = F.struct("full", "n", "id")
    variant, target = F.struct("full", "n", "id").alias("v"), F.struct("full", "n", "id").alias("c")
    long = F.length("stem") >= LEAST_STEM
    # the first of all full given names of a stem, by initial and of all
    people = ranked.filter(person & (F.col("full") == 2))
    by_lead = cut_lineage(people.groupBy("stem", "lead").agg(F.max(rank).alias("c")))
    by_stem = by_lead.groupBy("stem").agg(F.max("c").alias("c"))
    short, bare = ranked.filter(person & (F.col("full") == 1)), ranked.filter(person & (F.col("full") == 0))
    log = {k: F.lit(math.log(v)) for k, v in (("typo", TYPO), ("initial", INITIAL), ("left", LEFT_OUT), ("short", ABBREVIATION))}
    met = [
        short.select(variant, "stem", "lead").join(by_lead, ["stem", "lead"]).select("v", "c", log["initial"].alias("p")),
        bare.select(variant, "stem").join(by_stem, "stem").select("v", "c", log["left"].alias("p")),
    ]
    # typos in the stem: equal parts, or an initial and the first of its given names; in the part: equal stems
    keyed = ranked.filter(long).select("kind", "part", "stem", F.struct("full", "n", "id").alias("v"), F.explode(dels("stem")).alias("d"))
    pairs = keyed.join(keyed.select("kind", "part", F.col("stem").alias("c_stem"), F.col("v").alias("c"), "d"), ["kind", "part", "d"]).filter("c > v").drop("d").distinct()
    met.append(cut_lineage(pairs.filter(near("stem", "c_stem")).select("v", "c", log["typo"].alias("p"))))
    short_keys = short.filter(long).select(variant, "stem", "lead", F.explode(dels("stem")).alias("d"))
    lead_keys = by_lead.filter(long).select("c", F.col("stem").alias("c_stem"), "lead", F.explode(dels("stem")).alias("d"))
    pairs = short_keys.join(lead_keys, ["lead", "d"]).drop("d").distinct()
    met.append(cut_lineage(pairs.filter(near("stem", "c_stem")).select("v", "c", (log["typo"] + log["initial"]).alias("p"))))
    parts = people.filter(F.length("part") >= LEAST_PART).select("stem", "part", variant, F.explode(dels("part")).alias("d"))
    pairs = parts.join(parts.select("stem", F.col("part").alias("c_part"), F.col("v").alias("c"), "d"), ["stem", "d"]).filter("c > v").drop("d").distinct()
    met.append(cut_lineage(pairs.filter(near("part", "c_part")).select("v", "c", log["typo"].alias("p"))))
    # one of several words of an organisation with a typo, abbreviated or with another ending, the others equal; two known fields are two fields
    fields = F.filter(F.split("part", " "), lambda w: w != "")
    words = F.array_distinct(F.concat(F.split("stem", " "), fields))
    several = ranked.filter(~person & (F.size(words) > 1)).select("kind", F.struct("full", "n", "id").alias("v"), fields.alias("_f"), F.array_sort(words).alias("_w"), F.explode(words).alias("word"))
    several = several.filter(F.length("word") >= LEAST_STEM).select("kind", "v", "word", F.array_contains("_f", F.col("word")).alias("field"), F.concat_ws(" ", F.filter("_w", lambda x: x != F.col("word"))).alias("others"))
    # keys of what is near: the word with one letter left out, and its root
    keyed = several.withColumn("d", F.explode(F.concat(dels("word"), F.when(F.length("word") >= ROOT, F.array(F.concat(F.lit("^"), F.substring("word", 1, ROOT)))).otherwise(F.array().cast("array<string>")))))
    other = keyed.select("kind", "others", "d", F.col("word").alias("c_word"), F.col("field").alias("c_field"), F.col("v").alias("c"))
    pairs = keyed.join(other, ["kind", "others", "d"]).filter("c > v and word <> c_word and not (field and c_field)").select("v", "c", "word", "c_word").distinct()
    how = F.when(near("word", "c_word"), log["typo"]).when(F.pandas_udf(_same_root, "boolean")("word", "c_word"), log["short"])
    met.append(cut_lineage(pairs.withColumn("p", how).filter("p is not null").select("v", "c", "p")))
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    score = F.log(F.col("c.n").cast("double")) + F.col("p")
    taken = found.filter((F.col("c") > F.col("v")) & (score > F.log(F.col("v.n").cast("double")) + math.log(OTHER_NAME)))
    up = cut_lineage(taken.groupBy(F.col("v.id").alias("id")).agg(F.max_by("c.id", F.struct(score.alias("score"), "c.id")).alias("root")))
    # each round doubles the length of the way that is followed, until every way is at its end
    while up.join(up.select(F.col("id").alias("root")), "root", "left_semi").limit(1).count():
        up = cut_lineage(up.join(up.select(F.col("id").alias("root"), F.col("root").alias("_next")), "root", "left").select("id", F.coalesce("_next", "root").alias("root")))
    return forms.select("id").join(up, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def attribute(read: DataFrame) -> DataFrame:
    """(value, n, id, kind, part, stem): each spelling (value, n, kind, part, stem, likelihood) with the form it is attached to.

    The posterior of its reading is the reading's frequency times the likelihood of the spelling; one that is less likely than a name of its own
    has a form of its own.
    """
    # a form's id is its reading, so that it is the same wherever a lost task is run again
    ident = F.concat_ws("\u0001", "kind", "part", "stem")
    keys = ["kind", "part", "stem"]
    counted = read.join(read.groupBy(*keys).agg(F.sum("n").alias("_all")), keys)
    attached = F.log(F.col("_all").cast("double")) + F.col("likelihood") > F.log(F.col("n").cast("double")) + math.log(OTHER_NAME)
    return counted.select("value", "n", *keys, F.when(attached, ident).otherwise(F.concat(ident, F.lit("\u0001"), "value")).alias("id"))


def name_classes(values: DataFrame) -> DataFrame:
    """(value, n, class): the class of every spelling among (value, n) that names one person or organisation."""
    spelt = cut_lineage(attribute(cut_lineage(read_names(clean_names(values)))))
    forms = spelt.groupBy("id", "kind", "part", "stem").agg(F.sum("n").alias("n"))
    return spelt.join(attach(forms), "id").select("value", "n", F.col("root").alias("class"))


def class_sizes(classes: DataFrame) -> DataFrame:
    """(class, canonical, spellings, rows): a row per class, however many spellings it has."""
    return classes.groupBy("class").agg(F.max_by("value", F.struct("n", "value")).alias("canonical"), F.count("*").alias("spellings"), F.sum("n").alias("rows"))


def linked_pairs(classes: DataFrame) -> DataFrame:
    """(name_a, name_b): every two spellings of a class, in code-point order.

    A class with more than ``PAIRED`` spellings is split: its spellings are spread over parts, each of which meets all of them.
    """
    parts = F.ceil(F.col("spellings") / PAIRED).cast("int")
    sized = classes.select("class", "value").join(class_sizes(classes).filter("spellings > 1").select("class", "spellings"), "class")
    a = sized.select("class", F.col("value").alias("name_a"), F.pmod(F.xxhash64("value"), parts).cast("int").alias("_part"))
    b = sized.select("class", F.col("value").alias("name_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return a.join(b, ["class", "_part"]).filter("name_a < name_b").select("name_a", "name_b")


def canonical_names(classes: DataFrame) -> DataFrame:
    """(value, n, canonical): each spelling with the most frequent one of its class."""
    return classes.join(class_sizes(classes), "class").select("value", "n", "canonical")
