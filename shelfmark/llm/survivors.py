"""One surviving record per group of copies, by token-level consensus.

For every field the distinct values of a group are cut into tokens and aligned progressively, the weightiest first, to a
profile of columns; each value votes for its tokens (or for a gap) with the weight of its rows, which grows with the
trust in their source.  The weightiest token of each column forms the consensus, and the existing value closest to it
survives.  The record that represents the group is the one that is most complete, then most recent, then most trusted,
then closest to the consensus of names; ``dominant_rows`` keeps it only where it is no worse than every other row in each of
these and better in one.

A group of any size is handled: values are counted before they are gathered, profiles are built over buckets of at
most ``BUCKET`` distinct values and merged level by level, and everything else is a partial aggregation.

Defined results: rows with a null key belong to no group; null, blank and placeholder values have no vote, and a field
without any other is null; ties go to the value first by code point and the row of the smallest id; repeated rows
count as rows of their own (two equal best rows dominate neither); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut_lineage

#: Most values or profiles that one task aligns at a time; more are split into buckets, none is dropped.
BUCKET = 64
#: Scores of a gap, of equal tokens, of other tokens of the same class (which is better than two gaps) and of another class (which is worse).
GAP, MATCH, CHANGED, UNLIKE = -0.4, 1.1, -0.7, -0.9
#: Cells of the largest table that an alignment takes.
TABLE = 4_000_000
METADATA = ("metadata_title", "metadata_author", "metadata_creator", "metadata_created", "metadata_modified")
# What writing tools and typists put where they have nothing to say.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "unknown author", "untitled", "not set", "author", "admin", "administrator", "user", "various", "anonymous", "tbd", "?", "d:", "0000-00-00", "0000-00-00 00:00:00", "d:00000000000000", "d:00000000000000z", "d:00000000")

_TOKENS = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.DOTALL)


def is_filled(value: Column) -> Column:
    """Whether a value says something: not null, blank or a placeholder."""
    return F.coalesce(~F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).isin(*PLACEHOLDERS), F.lit(False))


def digest(value: Column) -> Column:
    """A SHA-256 digest as 64 small hexadecimal digits, however it was written down."""
    return F.regexp_extract(F.lower(value), r"(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])", 1)


# -- alignment, pure Python ------------------------------------------------------------------------------------------


def _align(columns: list[dict[str, float]], total: float, other: list[dict[str, float]], other_total: float) -> list[dict[str, float]]:
    """Two profiles (token -> weight per column, '' for a gap) aligned into one; Needleman-Wunsch over columns."""
    n, m = len(columns), len(other)
    if n * m > TABLE and n > 1:  # Hirschberg's halves: the same optimum without a table of that size
        half = n // 2
        ahead = _last_row(columns[:half], total, other, other_total)
        back = _last_row(columns[half:][::-1], total, other[::-1], other_total)[::-1]
        k = int(np.argmax(ahead + back))
        return _align(columns[:half], total, other[:k], other_total) + _align(columns[half:], total, other[k:], other_total)
    gap = GAP
    # tokens with their shares; a pair of columns scores twice the share they have in common, less what a match must be worth
    left = [({t: w / total for t, w in c.items() if t}, _class_of(c)) for c in columns]
    right = [([(t, w / other_total) for t, w in c.items() if t], _class_of(c)) for c in other]

    def score(a: tuple[dict[str, float], str], b: tuple[list[tuple[str, float]], str]) -> float:
        same = 0.0
        shares = a[0]
        for t, w in b[0]:
            if (v := shares.get(t)) is not None:
                same += v if v < w else w
        base = CHANGED if a[1] == b[1] else UNLIKE
        return base + (MATCH - base) * same

    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = gap * i
    for j in range(1, m + 1):
        best[0][j] = gap * j
    for i in range(1, n + 1):
        row, above, a, last = best[i], best[i - 1], left[i - 1], gap * i
        for j, b in enumerate(right, 1):
            v = above[j - 1] + score(a, b)
            if (u := above[j] + gap) > v:
                v = u
            if (u := last + gap) > v:
                v = u
            row[j] = last = v
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(best[i][j] - best[i - 1][j - 1] - score(left[i - 1], right[j - 1])) < 1e-9:
            out.append(_merged(columns[i - 1], other[j - 1]))
            i, j = i - 1, j - 1
        elif i and abs(best[i][j] - best[i - 1][j] - gap) < 1e-9:
            out.append(_merged(columns[i - 1], {"": other_total}))
            i -= 1
        else:
            out.append(_merged({"": total}, other[j - 1]))
            j -= 1
    return out[::-1]


def _class_of(column: dict[str, float]) -> str:
    """Class of a column's tokens, which are all alike, as others are never put together: letters, digits, white space, or the sign itself."""
    t = next((t for t in column if t and t[0] not in "\0\1"), "")
    return "a" if t[:1].isalpha() else "1" if t[:1].isdigit() else " " if t[:1].isspace() else t


def _last_row(columns: list[dict[str, float]], total: float, other: list[dict[str, float]], other_total: float) -> np.ndarray:
    """Best scores of all columns against the first j of ``other``, for each j; a row of memory at a time."""
    at: dict[str, tuple[list[int], list[float]]] = {}
    for j, c in enumerate(other):
        for t, w in c.items():
            if t:
                places, shares = at.setdefault(t, ([], []))
                places.append(j)
                shares.append(w / other_total)
    found = {t: (np.array(p), np.array(w)) for t, (p, w) in at.items()}
    classes = np.array([_class_of(c) for c in other], dtype=object)
    slope = GAP * np.arange(len(other) + 1)
    row = slope.copy()
    for c in columns:
        base = np.where(classes == _class_of(c), CHANGED, UNLIKE)
        score = base.copy()
        for t, w in c.items():
            if t in found:
                places, shares = found[t]
                score[places] += (MATCH - base[places]) * np.minimum(shares, w / total)
        new = row + GAP
        new[1:] = np.maximum(new[1:], row[:-1] + score)
        row = np.maximum.accumulate(new - slope) + slope
    return row


def _merged(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    out = dict(a)
    for t, w in b.items():
        out[t] = out.get(t, 0.0) + w
    return out


def _lean(columns: list[dict[str, float]], total: float) -> list[dict[str, float]]:
    """Without columns that three quarters of the weight leave empty.

    None of these has a token of more weight than the gap now, but what is merged later may bring it more: a profile that lost
    columns before it was whole is marked, and its votes are counted once more (``recounted``).  So the number of columns stays
    under four times the mean length of the values, however many different values are merged.
    """
    return [c for c in columns if c.get("", 0.0) <= 0.75 * total]


def profile_of(values: Iterable[tuple[str, float]]) -> tuple[list[dict[str, float]], float, bool, bool]:
    """The profile of weighted values, aligned progressively from the weightiest on; whether columns were dropped on the way and at the end."""
    columns, total, longest, early = [], 0.0, 0, False
    for value, weight in sorted(values, key=lambda v: (-v[1], v[0])):
        own = [{t: weight} for t in _TOKENS.findall(value)]
        longest = max(longest, len(own))
        columns, total = (_align(columns, total, own, weight), total + weight) if total else (own, weight)
        if len(columns) > 4 * longest:  # many unlike values
            lean = _lean(columns, total)
            early, columns = early or len(lean) < len(columns), lean
    lean = _lean(columns, total)
    return lean, total, early, len(lean) < len(columns)


def merge_profiles(profiles: Iterable[str]) -> str:
    """Serialised profiles aligned into one; ``e`` and ``l`` say whether columns were dropped before it was whole and at its end."""
    columns, total, early, late = [], 0.0, False, False
    parts = [json.loads(text) for text in sorted(profiles)]
    for i, own in enumerate(parts):
        columns, total = (_align(columns, total, own["c"], own["t"]), total + own["t"]) if total else (own["c"], own["t"])
        early = early or own["e"] or own["l"] and len(parts) > 1 or late
        lean = _lean(columns, total)
        late, columns = own["l"] if len(parts) == 1 else len(lean) < len(columns), lean
    return json.dumps({"c": columns, "t": total, "e": early, "l": late}, sort_keys=True, ensure_ascii=False)


def votes_for(value: str, profile: str | dict) -> list[tuple[int, int, str]]:
    """(place, step, token): where each token of a value falls on a finished profile; step 0 is the column itself, others follow it."""
    read = json.loads(profile) if isinstance(profile, str) else profile
    marked = [{**c, f"\0{i}": 0.0} for i, c in enumerate(read["c"])]
    out, place, step = [], -1, 0
    for c in _align(marked, read["t"], [{t: 1.0, "\1" + t: 0.0} for t in _TOKENS.findall(value)], 1.0):
        mark = next((t for t in c if t[:1] == "\0" and len(t) > 1), None)
        token = next((t[1:] for t in c if t[:1] == "\1" and len(t) > 1), None)
        place, step = (int(mark[1:]), 0) if mark else (place, step + 1)
        if token is not None:
            out.append((place, step, token))
    return out


def consensus_tokens(profile: str) -> list[str]:
    """The weightiest token of each column; none where gaps have most weight, and no white space before a place without a token."""
    best = [min(c, key=lambda x: (-c[x], x)) for c in json.loads(profile)["c"]]
    return [t for t, after in zip(best, [*best[1:], "."]) if t and not (t.isspace() and not after)]


def distance(value: str, consensus: Sequence[str]) -> float:
    """Tokens to insert, delete or replace between a value and the consensus; 0 where they are the same."""
    a, b = _TOKENS.findall(value), list(consensus)
    while a and b and a[-1] == b[-1]:
        a.pop(), b.pop()
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if len(a) * len(b) > TABLE:
        codes = {t: i for i, t in enumerate({*a, *b})}
        coded, steps = np.array([codes[t] for t in b]), np.arange(len(b) + 1)
        now = steps.copy()
        for x in a:
            new = now + 1
            new[1:] = np.minimum(new[1:], now[:-1] + (coded != codes[x]))
            now = np.minimum.accumulate(new - steps) + steps
        return float(now[-1])
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        before = row
    return float(before[-1])


def _profiles(values: pd.Series) -> pd.Series:
    def one(rows):
        columns, total, early, late = profile_of((r["value"], r["weight"]) for r in rows)
        return json.dumps({"c": columns, "t": total, "e": early, "l": late}, sort_keys=True, ensure_ascii=False)

    return values.map(one)


def _merge(profiles: pd.Series) -> pd.Series:
    return profiles.map(merge_profiles)


def _distances(values: pd.Series, profiles: pd.Series) -> pd.Series:
    known: dict[str, list[str]] = {}
    out = []
    for v, p in zip(values, profiles):
        if p not in known:
            known[p] = consensus_tokens(p)
        out.append(distance(v, known[p]))
    return pd.Series(out, dtype="float64")


def _votes(values: pd.Series, profiles: pd.Series) -> pd.Series:
    known: dict[str, dict] = {}
    return pd.Series([votes_for(v, known[p] if p in known else known.setdefault(p, json.loads(p))) for v, p in zip(values, profiles)])


def _counted(totals: pd.Series, votes: pd.Series) -> pd.Series:
    """Profiles of the (place, step, token, weight) that won their places, in order."""

    def one(total, rows):
        places: dict[tuple[int, int], dict[str, float]] = {}
        for r in rows:
            places.setdefault((r["place"], r["step"]), {})[r["token"]] = r["weight"]
        columns = [c for _, c in sorted(places.items())]
        return json.dumps({"c": columns, "t": total, "e": False, "l": False}, sort_keys=True, ensure_ascii=False)

    return pd.Series([one(t, rows) for t, rows in zip(totals, votes)])


# -- the operator ----------------------------------------------------------------------------------------------------


def recounted(profiles: DataFrame, votes: DataFrame) -> DataFrame:
    """(key, field, profile): profiles that lost votes on the way, with all values' tokens counted once more against them.

    ``votes``: (key, field, value, weight).  What most of the weight has between two columns becomes a column again; places
    where the gap outweighs every token are left out, now that nothing more is merged.
    """
    lost = profiles.filter(F.get_json_object("profile", "$.e") == "true").select("key", "field", "profile")
    cast = votes.join(lost, ["key", "field"]).select("key", "field", "weight", F.explode(F.pandas_udf(_votes, "array<struct<place int, step int, token string>>")("value", "profile")).alias("_v"))
    counted = cast.groupBy("key", "field", "_v.place", "_v.step", "_v.token").agg(F.sum("weight").alias("weight"))
    totals = votes.join(lost.select("key", "field"), ["key", "field"]).groupBy("key", "field").agg(F.sum("weight").alias("_t"))
    # a place's token wins only with more weight than each other and the gap; most votes are for the best of their place
    best = counted.groupBy("key", "field", "place", "step").agg(F.min_by(F.struct("token", "weight"), F.struct(-F.col("weight"), "token")).alias("_b"), F.sum("weight").alias("_all"))
    kept = best.join(totals, ["key", "field"]).filter(F.col("_b.weight") > F.col("_t") - F.col("_all"))
    rows = kept.groupBy("key", "field").agg(F.first("_t").alias("_t"), F.collect_list(F.struct("place", "step", F.col("_b.token").alias("token"), F.col("_b.weight").alias("weight"))).alias("_r"))
    again = rows.select("key", "field", F.pandas_udf(_counted, "string")("_t", "_r").alias("_again"))
    return profiles.select("key", "field", "profile").join(again, ["key", "field"], "left").select("key", "field", F.coalesce("_again", "profile").alias("profile"))


def consensus_values(values: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, field, value, off): the surviving value of each (key, field) and its distance from the consensus.

    ``values``: (key, field, value, weight), a row per vote.
    """
    votes = values.groupBy("key", "field", "value").agg(F.sum("weight").alias("weight"))
    sizes = votes.groupBy("key", "field").agg(F.count("*").alias("n"), F.min("value").alias("only"))
    single = sizes.filter("n = 1").select("key", "field", F.col("only").alias("value"), F.lit(0.0).alias("off"))
    several = votes.join(sizes.filter("n > 1").select("key", "field", "n"), ["key", "field"])
    salted = several.withColumn("_b", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") * 2 / bucket)))
    # with twice the buckets needed, hashing leaves one over ``bucket`` only by rare chance, and that is merely slower
    gathered = salted.groupBy("key", "field", "_b").agg(F.collect_list(F.struct("value", "weight")).alias("_v"), F.first("n").alias("n"))
    profiles = gathered.select("key", "field", "n", F.pandas_udf(_profiles, "string")("_v").alias("profile"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    levels, width = 0, max(1, -(-most * 2 // bucket))
    while width > 1:
        width = 1 if width <= bucket else -(-width * 2 // bucket)
        levels += 1
        salt = F.pmod(F.xxhash64("profile"), F.lit(width))
        profiles = profiles.withColumn("_b", salt).groupBy("key", "field", "_b").agg(F.collect_list("profile").alias("_p"), F.first("n").alias("n"))
        profiles = cut_lineage(profiles.select("key", "field", "n", F.pandas_udf(_merge, "string")("_p").alias("profile")))
    profiles = recounted(cut_lineage(profiles.select("key", "field", "profile")), several.select("key", "field", "value", "weight"))
    near = several.select("key", "field", "value").join(profiles.select("key", "field", "profile"), ["key", "field"])
    near = near.withColumn("off", F.pandas_udf(_distances, "double")("value", "profile"))
    best = near.groupBy("key", "field").agg(F.min(F.struct("off", "value")).alias("_m")).select("key", "field", "_m.value", "_m.off")
    return single.unionByName(best)


def ranked_rows(documents: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """(sha256, doc_id, file_name, filled, run_s, trust, weight) of rows in groups of two or more, with their metadata.

    Completeness counts filled metadata fields; a missing job or source is worse than any known one.
    """
    groups = documents.filter(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("_n")).filter("_n > 1").select("sha256")
    runs = jobs.groupBy(F.col("job_id").alias("last_seen_job")).agg(F.max(F.unix_seconds(F.col("run_at").cast("timestamp"))).alias("run_s"))
    ranks = sources.groupBy("source").agg(F.min("trust_rank").alias("trust"))
    rows = documents.select("sha256", "doc_id", "file_name", "last_seen_job", "source", *METADATA).join(groups, "sha256").join(runs, "last_seen_job", "left").join(ranks, "source", "left")
    filled = sum((is_filled(F.col(c)).cast("int") for c in METADATA), F.lit(0))
    rows = rows.withColumn("filled", filled).withColumn("run_s", F.coalesce("run_s", F.lit(-(2**62)))).withColumn("trust", F.coalesce("trust", F.lit(2**30)))
    return rows.withColumn("weight", F.lit(1.0) + 1.0 / F.col("trust")).drop("last_seen_job", "source")


def surviving_records(documents: DataFrame, paths: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """One record per digest held by two or more rows: sha256, doc_id, path_id, dominates, file_name, rel_path, metadata.

    ``doc_id`` is the representative row, ``path_id`` the smallest id of a path of that file that ends in its name (null if
    none does), ``dominates`` whether the row is no worse than every other in all criteria and better in one.
    """
    rows = cut_lineage(ranked_rows(documents, jobs, sources))  # of all rows, those in groups; read four times
    at = paths.filter(F.col("rel_path").isNotNull()).select("id", digest(F.col("sha256")).alias("sha256"), "rel_path").filter("sha256 <> ''")
    keys = rows.select("sha256").distinct()
    own = cut_lineage(at.join(keys, "sha256", "left_semi"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("file_name", *METADATA)])
    votes = rows.select(F.col("sha256").alias("key"), "weight", F.inline(fields)).filter(is_filled(F.col("value")))
    votes = votes.unionByName(own.select(F.col("sha256").alias("key"), F.lit(1.0).alias("weight"), F.lit("rel_path").alias("field"), F.col("rel_path").alias("value")))
    values = consensus_values(votes)
    wide = values.groupBy(F.col("key").alias("sha256")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias("best_" + f) for f in ("file_name", "rel_path", *METADATA)])
    named = rows.join(wide.select("sha256", "best_file_name"), "sha256", "left")
    same = F.coalesce(F.col("file_name") == F.col("best_file_name"), F.lit(False)).cast("int")
    levels = named.groupBy("sha256", "filled", "run_s", "trust").agg(F.count("*").alias("n"), F.max(F.struct(same.alias("same"), (-F.col("doc_id")).alias("neg"), "file_name")).alias("row"))
    top = levels.groupBy("sha256").agg(F.max("filled").alias("_f"), F.max("run_s").alias("_r"), F.min("trust").alias("_t"), F.max(F.struct("filled", "run_s", (-F.col("trust")).alias("trust"), "n", "row")).alias("_top"))
    rep = top.select("sha256", (-F.col("_top.row.neg")).alias("doc_id"), F.col("_top.row.file_name").alias("_name"), ((F.col("_top.filled") == F.col("_f")) & (F.col("_top.run_s") == F.col("_r")) & (-F.col("_top.trust") == F.col("_t")) & (F.col("_top.n") == 1)).alias("dominates"))
    ends = own.join(rep.select("sha256", "_name"), "sha256").filter(F.endswith(F.col("rel_path"), F.concat(F.lit("/"), F.col("_name"))))
    out = rep.join(ends.groupBy("sha256").agg(F.min("id").alias("path_id")), "sha256", "left")
    renamed = wide.select("sha256", *[F.col("best_" + f).alias(f) for f in ("file_name", "rel_path", *METADATA)])
    return out.drop("_name").join(renamed, "sha256", "left")


def dominant_rows(records: DataFrame) -> DataFrame:
    """(sha256, doc_id, path_id) of the records whose row is at least as good as every other and better in one way."""
    return records.filter("dominates").select("sha256", "doc_id", "path_id")
