"""Mixing sources to target weights by iterative proportional fitting and calibrated sampling.

Tokens are counted per cell (source, language, topic).  For each mix the cells' weights are raked until the source
marginal has the target shares and the language and topic marginals have the shares that they have among the mix's
documents, weights never over the cap on repeats; the last step is over sources, whose shares are what is asked for.  Topics have no
bound, so that more than ``DRIVER_CELLS`` cells stay a table with a row per topic (``rake_table``).  A
document's expected number of uses is its cell's weight: the whole part is given to every document of
the cell, the fraction by sequential Poisson sampling, in which documents come in the order of u / p (u: a
hash of mix and document, p: the fraction) until the source's tokens are met to within half a document.  The gap that is left is then
closed by documents used once more or once less, several together where one doesn't do (``close_gaps``).

The size of a mix is the largest for which no source must exceed its cap, unless ``size`` (tokens) is given.  Sources
without documents can have no share; the others keep their proportions, and the report shows the target missed.  The largest size
is where a cap binds, and the documents of a source at its cap all have the same weight: then languages and topics can't have their shares at the same time, and
``marginals`` reports what they have; a smaller ``size`` leaves room for them.

Defined results: documents with null source, null or empty text, or of sources that a mix doesn't name aren't used; a null
language or topic is a class of its own; a share or cap of null, zero or less uses nothing of the source; a source named twice in a
mix counts with the sum of its shares and the smallest cap; an empty table gives no documents and shares of 0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from shelfmark.session import cut_lineage

#: Ranges of u / p in which running sums are taken, so that no task has to order a whole source.
RANGES = 4096
#: Most cells that the driver rakes; a table with more of them is raked where it lies.
DRIVER_CELLS = 20_000


def rake(cells: Mapping[tuple, float], shares: Mapping[str, float], caps: Mapping[str, float], size: float | None = None, rounds: int = 50, tolerance: float = 1e-6) -> tuple[dict[tuple, float], float]:
    """(cell -> weight, tokens in the mix) for cells (source, language, topic) -> tokens.

    Weights are the expected uses of each document of the cell.  Where a cap binds, the source's other cells take over.
    """
    keys = [k for k, t in cells.items() if t > 0 and shares.get(k[0], 0) > 0 and caps.get(k[0], 0) > 0]
    if not keys:
        return {}, 0.0
    tokens = np.array([cells[k] for k in keys], dtype=float)
    names = sorted({k[0] for k in keys})
    src = np.array([names.index(k[0]) for k in keys])
    have = np.bincount(src, tokens)
    share = np.array([shares[n] for n in names]) / sum(shares[n] for n in names)
    most = np.array([float(caps[n]) for n in names])
    largest = float(np.min(most * have / share))
    total = largest if size is None else min(float(size), largest)
    wanted, cap = share * total, most[src]
    others = []
    for part in (1, 2):
        classes = sorted({k[part] for k in keys}, key=lambda x: (x is None, str(x)))
        place = {c: i for i, c in enumerate(classes)}
        at = np.array([place[k[part]] for k in keys])
        natural = np.bincount(at, tokens)
        others.append((at, natural / natural.sum() * total))
    weights = wanted[src] / have[src]
    for _ in range(rounds):
        before = weights.copy()
        for at, goal in others:
            now = np.bincount(at, weights * tokens)
            weights = np.minimum(weights * (goal / np.maximum(now, 1e-12))[at] ** 0.5, cap)
        weights = _to_sources(weights, tokens, src, wanted, cap)
        if np.max(np.abs(weights - before) / np.maximum(before, 1e-12)) < tolerance:
            break
    return dict(zip(keys, weights.tolist())), total


def _to_sources(weights, tokens, src, wanted, cap):
    """Weights scaled so that each source has its tokens; what the cap cuts off goes to the source's other cells."""
    for _ in range(60):
        now = np.bincount(src, weights * tokens, minlength=len(wanted))
        if np.all(np.abs(now - wanted) <= 1e-9 * np.maximum(wanted, 1)):
            break
        weights = np.minimum(weights * (wanted / np.maximum(now, 1e-12))[src], cap)
    now = np.bincount(src, weights * tokens, minlength=len(wanted))
    short = np.maximum(wanted - now, 0)
    slack = np.bincount(src, (cap - weights) * tokens, minlength=len(wanted))
    return weights + (cap - weights) * np.minimum(short / np.maximum(slack, 1e-12), 1)[src]


def _topic_weights(parts, goal: float, a: Mapping, b: Mapping, caps: Mapping) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, weights, caps) of one topic's cells: the least of cap and a * b * c, where c gives the topic its goal."""
    tokens = np.array([p["t"] for p in parts], dtype=float)
    v = np.array([a[p["source"]] * b[p["language"]] for p in parts])
    cap = np.array([caps[p["source"]] for p in parts])
    turn = cap / v
    order = np.argsort(turn, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum((tokens * cap)[order])[:-1]])
    free = np.cumsum((tokens * v)[order][::-1])[::-1]
    c = np.maximum(goal - capped, 0.0) / free
    fits = np.flatnonzero(c <= turn[order])
    return tokens, (np.minimum(c[fits[0]] * v, cap) if len(fits) else cap), cap


def rake_table(cells: DataFrame, shares: Mapping[str, float], caps: Mapping[str, float], size: float | None = None, rounds: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, dict[str, float]]:
    """((source, language, topic, weight), tokens of each source) for cells (source, language, topic, t) of any number of topics.

    A weight is the least of the source's cap and a(source) * b(language) * c(topic).  Given a and b each topic finds its c by
    itself, so that a round is one pass over the table that brings back the totals of sources and languages, and nothing else.
    """
    spark = cells.sparkSession
    named = [s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0]
    used = cells.filter(F.col("source").isin(named) & (F.col("t") > 0))
    have = {r["source"]: float(r["t"]) for r in used.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    spoken = {r["language"]: float(r["t"]) for r in used.groupBy("language").agg(F.sum("t").alias("t")).collect()}
    if not have:
        return spark.createDataFrame([], "source string, language string, topic string, weight double"), {}
    whole, parted = sum(have.values()), sum(shares[s] for s in have)
    cap = {s: float(caps[s]) for s in have}
    largest = min(cap[s] * have[s] * parted / shares[s] for s in have)
    total = largest if size is None else min(float(size), largest)
    wanted = {s: shares[s] / parted * total for s in have}
    topics = cut_lineage(used.groupBy("topic").agg(F.collect_list(F.struct("source", "language", F.col("t").cast("double").alias("t"))).alias("parts")))

    def totals(a: dict, b: dict) -> dict[tuple, tuple[float, float]]:
        def run(batches):
            sums: dict[tuple, list[float]] = {}
            for frame in batches:
                for parts in frame["parts"]:
                    tokens, weights, most = _topic_weights(parts, sum(p["t"] for p in parts) / whole * total, a, b, cap)
                    for p, t, w, m in zip(parts, tokens, weights, most):
                        for key in (("source", p["source"]), ("language", p["language"])):
                            got = sums.setdefault(key, [0.0, 0.0])
                            got[0] += t * w
                            got[1] += t * (m - w)
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["kind", "name", "now", "slack"])

        rows = topics.mapInPandas(run, "kind string, name string, now double, slack double").groupBy("kind", "name").agg(F.sum("now").alias("now"), F.sum("slack").alias("slack"))
        return {(r["kind"], r["name"]): (r["now"], r["slack"]) for r in rows.collect()}

    a, b = {s: wanted[s] / have[s] for s in have}, dict.fromkeys(spoken, 1.0)
    for i in range(rounds):
        now = totals(a, b)
        steps = {s: wanted[s] / max(now["source", s][0], 1e-12) for s in a}, {x: spoken[x] / whole * total / max(now["language", x][0], 1e-12) for x in b}
        if max(abs(f - 1) for step in steps for f in step.values()) < tolerance:
            break
        for factors, step in ((a, steps[0]),) if i % 2 == 0 else ((b, steps[1]),):
            for name, f in step.items():
                factors[name] = min(max(factors[name] * f, 1e-9), 1e9)
    now = totals(a, b)

    def weigh(parts: pd.Series) -> pd.Series:
        out = []
        for cells_ in parts:
            _, weights, most = _topic_weights(cells_, sum(p["t"] for p in cells_) / whole * total, a, b, cap)
            row = []
            for p, w, m in zip(cells_, weights, most):
                got, slack = now["source", p["source"]]
                want = wanted[p["source"]]
                row.append(float(w * want / got if got > want else w + (m - w) * min((want - got) / max(slack, 1e-12), 1.0)))
            out.append(row)
        return pd.Series(out)

    zipped = topics.select("topic", F.explode(F.arrays_zip("parts", F.pandas_udf(weigh, "array<double>")("parts").alias("weight"))).alias("_c"))
    return zipped.select("_c.parts.source", "_c.parts.language", "topic", "_c.weight"), wanted


def mix(sizes: DataFrame, targets: DataFrame, size: float | None = None, seed: str = "mix") -> DataFrame:
    """(mix_name, key, source, tokens, repeats) of the chosen documents.

    ``sizes``: (key, source, language, topic, tokens), keys unique; ``targets``: (mix_name, source, target_share, max_repeats).
    Only totals reach the driver: at most ``DRIVER_CELLS`` cells, or those of the mixes' sources and of the languages.
    """
    wanted = targets.filter("target_share > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rules: dict[str, dict[str, tuple[float, int]]] = {}
    for r in wanted.collect():  # a row per rule written by hand
        rules.setdefault(r["mix_name"], {})[r["source"]] = (r["target_share"], r["max_repeats"])
    named = sorted({s for m in rules.values() for s in m})
    docs = sizes.filter((F.col("tokens") > 0) & F.col("source").isin(named))
    totals = cut_lineage(docs.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("t")))
    spark = sizes.sparkSession
    small = totals.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    cells = {(r["source"], r["language"], r["topic"]): float(r["t"]) for r in totals.collect()} if small else {}
    plan_rows, goals, plan = [], [], None
    for name, sources in sorted(rules.items()):
        share, cap = {s: v[0] for s, v in sources.items()}, {s: v[1] for s, v in sources.items()}
        given = dict.fromkeys(sources, 0.0)
        if small:
            weights, _ = rake(cells, share, cap, size)
            plan_rows += [(name, *k, w) for k, w in weights.items()]
            for k, w in weights.items():
                given[k[0]] += w * cells[k]
        else:
            table, reached = rake_table(totals, share, cap, size)
            given |= reached
            table = table.select(F.lit(name).alias("mix_name"), "source", "language", "topic", "weight")
            plan = table if plan is None else plan.unionByName(table)
        goals += [(name, s, float(g)) for s, g in given.items()]
    if plan is None:
        plan = spark.createDataFrame(plan_rows or [("", "", None, None, 0.0)], "mix_name string, source string, language string, topic string, weight double")
    else:
        plan = cut_lineage(plan)
    goal = spark.createDataFrame(goals or [("", "", 0.0)], "mix_name string, source string, goal double")
    p = plan.select("mix_name", F.col("source").alias("_s"), F.col("language").alias("_l"), F.col("topic").alias("_t"), "weight")
    uses = docs.join(p, (F.col("source") == F.col("_s")) & F.col("language").eqNullSafe(F.col("_l")) & F.col("topic").eqNullSafe(F.col("_t")))
    uses = uses.select("mix_name", "key", "source", "tokens", F.floor(F.col("weight") + 1e-9).alias("whole"), "weight").withColumn("p", F.greatest(F.col("weight") - F.col("whole"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "key"), F.lit(2**40)) + 0.5) / float(2**40)
    uses = uses.withColumn("xi", F.when(F.col("p") > 1e-6, u / F.col("p"))).withColumn("_range", F.least(F.floor(F.col("xi") * (RANGES // 4)), F.lit(RANGES - 1)).cast("int"))
    base = uses.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("whole")).alias("given")).join(goal, ["mix_name", "source"]).select("mix_name", "source", (F.col("goal") - F.col("given")).alias("rest"))
    parts = uses.filter("xi is not null").groupBy("mix_name", "source", "_range").agg(F.sum("tokens").alias("_t"))
    along = Window.partitionBy("mix_name", "source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_t").over(along), F.lit(0))).join(base, ["mix_name", "source"])
    # Only the range in which the source's tokens are met needs an order; those before it are used whole, those behind not.
    ranged = uses.filter("xi is not null").join(starts, ["mix_name", "source", "_range"])
    whole, part = F.col("_start") + F.col("_t") <= F.col("rest"), F.col("_start") <= F.col("rest")
    settled = ranged.filter(whole | ~part).withColumn("_more", whole.cast("bigint"))
    inside = Window.partitionBy("mix_name", "source", "_range").orderBy("xi", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    ordered = ranged.filter(~whole & part).withColumn("_more", (before + F.col("tokens") / 2 <= F.col("rest")).cast("bigint"))
    fraction = settled.unionByName(ordered)
    cols = ["mix_name", "key", "source", "tokens"]
    rows = fraction.select(*cols, (F.col("whole") + F.col("_more")).alias("repeats")).unionByName(uses.filter("xi is null").select(*cols, F.col("whole").alias("repeats")))
    caps = spark.createDataFrame([(m, s, int(v[1])) for m, r in rules.items() for s, v in r.items()] or [("", "", 0)], "mix_name string, source string, cap int")
    rows = cut_lineage(rows.join(caps, ["mix_name", "source"]))
    return close_gaps(rows, goal).filter("repeats > 0").select(*cols, "repeats")


def best_changes(off: float, more: Sequence[int], less: Sequence[int]) -> list[tuple[int, int]]:
    """(step, tokens) of the changes that bring ``off`` nearest to 0 among those looked at; sizes that can be used once more and once less.

    From nothing and from every first change on, sizes are taken by greatest fit: again and again the largest one, each once, that doesn't overshoot
    what is missing (or too much), and at the end the nearest one, if that is nearer still.
    """
    sizes = {1: sorted(more), -1: sorted(less)}

    def follow(gap: float, taken: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
        step = 1 if gap > 0 else -1
        row, used = sizes[step], {t for s, t in taken if s == step}
        i = bisect_right(row, abs(gap))
        while i:
            i -= 1
            if row[i] in used:
                continue
            if row[i] <= abs(gap):
                gap -= step * row[i]
                taken = [*taken, (step, row[i])]
                used.add(row[i])
                i = min(i, bisect_right(row, abs(gap)))
        i = bisect_right(row, abs(gap))
        while i < len(row) and row[i] in used:
            i += 1
        if i < len(row) and row[i] - abs(gap) < abs(gap):
            gap, taken = gap - step * row[i], [*taken, (step, row[i])]
        return abs(gap), taken

    best, changes = min((abs(off), []), follow(off, []), key=lambda x: (x[0], len(x[1])))
    for step in (1, -1):
        for t in sizes[step]:
            if best < 0.5 + 1e-6:  # goals are no whole numbers
                return changes
            got, taken = follow(off - step * t, [(step, t)])
            if got < best - 1e-6:
                best, changes = got, taken
    return changes


def close_gaps(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (mix_name, source, key, tokens, repeats, cap) with single uses changed so that each source is nearer to its goal (mix_name, source, goal).

    Documents of one size do the same, so only the different sizes that can be had are gathered for a source, with the least key of each: as many as the
    longest text has tokens, at most.
    """
    off = rows.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("_given")).join(goal, ["mix_name", "source"]).select("mix_name", "source", (F.col("goal") - F.col("_given")).alias("off"))
    ways = F.array(F.when(F.col("repeats") < F.col("cap"), 1), F.when(F.col("repeats") > 0, -1))
    sizes = rows.select("mix_name", "source", "tokens", "key", F.explode(ways).alias("_step")).filter("_step is not null").groupBy("mix_name", "source", "_step", "tokens").agg(F.min("key").alias("key"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        more, less = (group[group["_step"] == s]["tokens"].tolist() for s in (1, -1))
        taken = pd.DataFrame(best_changes(float(group["off"].iloc[0]), more, less), columns=["_step", "tokens"]).astype({"_step": "int32", "tokens": "int64"})
        return group.merge(taken, on=["_step", "tokens"])[["mix_name", "source", "key", "_step"]]

    schema = StructType([StructField("mix_name", StringType()), StructField("source", StringType()), StructField("key", rows.schema["key"].dataType), StructField("_step", IntegerType())])
    changes = sizes.join(off, ["mix_name", "source"]).groupBy("mix_name", "source").applyInPandas(choose, schema).groupBy("mix_name", "source", "key").agg(F.sum("_step").alias("_step"))
    return rows.join(changes, ["mix_name", "source", "key"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("_step", F.lit(0))).drop("_step")


def marginals(chosen: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, marginal, class, wanted_share, share) of the languages and topics of each mix.

    ``chosen``: what ``mix`` gives of ``sizes``; wanted are the shares of tokens that a class has among the documents of the mix's sources.
    """
    rules = targets.filter("target_share > 0 and max_repeats > 0").select("mix_name", "source").distinct()
    docs = sizes.filter("tokens > 0").join(F.broadcast(rules), "source")  # a row per rule
    classes = F.array(F.struct(F.lit("language").alias("marginal"), F.col("language").alias("class")), F.struct(F.lit("topic").alias("marginal"), F.col("topic").alias("class")))
    both = docs.join(chosen.select("mix_name", "key", "repeats"), ["mix_name", "key"], "left").select("mix_name", "tokens", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.inline(classes))
    sums = both.groupBy("mix_name", "marginal", "class").agg(F.sum("tokens").alias("_all"), F.sum(F.col("tokens") * F.col("repeats")).alias("_got"))
    totals = sums.groupBy("mix_name", "marginal").agg(F.sum("_all").alias("_ta"), F.sum("_got").alias("_tg"))
    share = F.when(F.col("_tg") > 0, F.col("_got") / F.col("_tg")).otherwise(F.lit(0.0))
    return sums.join(totals, ["mix_name", "marginal"]).select("mix_name", "marginal", "class", (F.col("_all") / F.col("_ta")).alias("wanted_share"), share.alias("share"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, documents, tokens, share): what each source gives of each mix."""
    given = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    all_rows = targets.join(given, ["mix_name", "source"], "left").fillna(0, ["documents", "tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return all_rows.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
