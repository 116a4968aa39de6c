"""Timestamps of mixed notation and zone, brought to UTC.

Method: a value without zone needs the offset history (a time zone with its changes, or several of them one after the other) of the clock
that wrote it.  Each source has one.  Every candidate history is set against what is known of the offset that the clock had on
a day (``offset_evidence``):

* alignment with ingestion: a file can't have been created or modified after the job that first saw it ran;
* sequence order: it can't have been modified before it was created;
* alignment of copies: another record of the same file may have the same value with a zone;
* offsets that the source itself wrote: tools on one machine write the zone of its clock.

What contradicts a history is a violation.  The evidence is aggregated by source, day and offset before any history is tried, so
that trying costs no more however many rows there are.  For each source the sequence of histories with the fewest violations is chosen, where
every change from one history to another counts as ``CHANGE_SHARE`` of the source's evidence (at least ``LEAST_CHANGE``), so that a clock that was moved
to another zone is followed, and noise isn't.  Histories with equal violations that differ on a day with values are undecided.
Where a source declares its zone, the declaration decides what is undecided, and is given up only if the estimate has fewer violations by
``override_share`` of the source's evidence.

Defined results: null, blank or unreadable values, impossible dates or times, dates without time, wall-clock times
that their zone has twice or never, and values whose source has neither a declared zone nor decisive evidence yield no row
in ``to_instants``.  Repeated rows give repeated results; callers that need distinct rows say ``distinct()``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import timestamps as T
from shelfmark.session import cut_lineage, small_side

#: Offset histories tried for a source, besides the one it declares: zones that differ in offset or in their changes.
CANDIDATE_ZONES = (
    "UTC", "America/New_York", "America/Chicago", "America/Denver", "America/Phoenix", "America/Los_Angeles", "America/Anchorage", "Pacific/Honolulu", "America/Halifax", "America/St_Johns", "America/Sao_Paulo", "America/Argentina/Buenos_Aires", "America/Bogota", "America/Mexico_City",
    "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Istanbul", "Europe/Moscow", "Africa/Lagos", "Africa/Johannesburg", "Africa/Cairo", "Africa/Nairobi", "Asia/Dubai", "Asia/Tehran", "Asia/Karachi", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Dhaka", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Perth", "Australia/Darwin", "Australia/Adelaide", "Australia/Brisbane", "Australia/Sydney", "Pacific/Auckland",
)
#: Offsets are multiples of this many seconds, and none is further from UTC than ``WIDEST``.
QUARTER, WIDEST = 900, 14 * 3600
#: Seconds by which a copy's value may differ from the aligned one (notations without seconds).
NEAR = 60
#: Share of a source's evidence that a change of its history must win, and the least number of violations.
CHANGE_SHARE, LEAST_CHANGE = 0.1, 5


def known_zones(df: DataFrame) -> list[str]:
    """Zone ids that the JVM's time-zone database knows (an unknown id would end the query)."""
    ids = df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(x for x in ids if "/" in x or x in ("UTC", "GMT"))


def parse_values(df: DataFrame, key: str, fields: Sequence[str], group: str, date_order: str, file: str | None = None) -> DataFrame:
    """(key, group, field, notation, local_s, zone, utc_s, file) of every readable value; utc_s where the value itself fixes it.

    ``zone`` is '' for values without zone.  Values with an unknown zone name are dropped, as they fix no instant.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    copy_of = F.lit(None).cast("string") if file is None else F.col(file)
    rows = df.select(F.col(key), F.col(group), copy_of.alias("file"), (F.col(date_order) == "dmy").alias("_dmy"), F.inline(pairs)).filter(F.col("value").rlike(r"\d"))
    rows = T.bind(rows, _parts=F.split(T.canonical_notation(F.col("value"), F.col("_dmy")), r"\|")).filter(F.col("_parts").isNotNull())
    zone = F.when(F.col("_parts")[0] == "epoch", "Z").otherwise(F.coalesce(F.get("_parts", F.lit(8)), F.lit("")))
    rows = T.bind(rows, notation=F.col("_parts")[0], local_s=T.wall_seconds(F.col("_parts")), zone=zone).filter(F.col("local_s").isNotNull())
    rows = T.bind(rows, _fixed=T.fixed_offset_seconds(F.col("zone")))
    named = F.col("zone").contains("/") & F.col("zone").isin(known_zones(df))
    utc = F.when(F.col("_fixed").isNotNull(), F.col("local_s") - F.col("_fixed")).when(named, T.resolve_wall_clock(F.col("local_s"), F.col("zone")))
    return T.bind(rows, utc_s=utc).filter((F.col("zone") == "") | F.col("utc_s").isNotNull()).select(key, group, "field", "notation", "local_s", "zone", "utc_s", "file")


def offset_evidence(values: DataFrame, bounds: DataFrame, key: str, group: str, first: str, last: str) -> DataFrame:
    """(group, day, kind, x, n): what is known of the offset of a group's clock on a local day, in quarters of an hour, and how often.

    ``kind``: ``is`` x, ``least`` x, ``most`` x, or ``asked`` for days of values that need an offset.
    ``values``: what ``parse_values`` gives; ``bounds``: (key, seen_s), the latest instant a row's values can have;
    ``first``/``last``: the field that cannot be later / earlier than the other.
    """
    day = F.floor(F.col("local_s") / 86400).cast("int")
    own = values.filter(F.col(group).isNotNull())
    open_rows, fixed = own.filter(F.col("zone") == ""), values.filter(F.col("utc_s").isNotNull())
    seen = open_rows.join(bounds, key).select(group, day.alias("day"), F.lit("least").alias("kind"), (F.col("local_s") - F.col("seen_s")).alias("_s"))
    other = fixed.select(key, F.col("field").alias("_other"), F.col("utc_s").alias("_other_s"))
    beside = open_rows.join(other, key).filter(F.col("_other") != F.col("field")).filter(F.col("_other").isin(first, last))
    order = beside.select(group, day.alias("day"), F.when(F.col("field") == first, "least").otherwise("most").alias("kind"), (F.col("local_s") - F.col("_other_s")).alias("_s"))
    # copies: one instant for each file and field, that most of its records with a zone agree on; equal values are counted before they meet it
    instants = fixed.filter(F.col("file").isNotNull()).groupBy("file", "field", "utc_s").agg(F.count("*").alias("n")).groupBy("file", "field").agg(F.max_by("utc_s", F.struct("n", -F.col("utc_s"))).alias("_at"))
    alike = open_rows.filter(F.col("file").isNotNull()).groupBy("file", "field", group, "local_s").agg(F.count("*").alias("n"))
    off = F.col("local_s") - F.col("_at")
    nearest = F.round(off / QUARTER).cast("int")
    copies = alike.join(instants, ["file", "field"]).filter((F.abs(off) <= WIDEST) & (F.abs(off - nearest * QUARTER) <= NEAR)).select(group, day.alias("day"), F.lit("is").alias("kind"), nearest.alias("x"), "n")
    # tools that write UTC say nothing of the clock
    told = own.filter((F.col("zone") != "") & F.col("utc_s").isNotNull() & ~F.col("zone").isin("Z", "UT", "UTC", "GMT") & (F.col("notation") != "epoch"))
    written = told.select(group, day.alias("day"), F.lit("is").alias("kind"), F.round((F.col("local_s") - F.col("utc_s")) / QUARTER).cast("int").alias("x"), F.lit(1).cast("bigint").alias("n"))
    asked = open_rows.select(group, day.alias("day"), F.lit("asked").alias("kind"), F.lit(0).alias("x"), F.lit(1).cast("bigint").alias("n"))
    limits = seen.unionByName(order).filter(F.abs("_s") <= WIDEST).select(group, "day", "kind", F.when(F.col("kind") == "least", F.ceil(F.col("_s") / QUARTER)).otherwise(F.floor(F.col("_s") / QUARTER)).cast("int").alias("x"), F.lit(1).cast("bigint").alias("n"))
    return limits.unionByName(copies).unionByName(written).unionByName(asked).groupBy(group, "day", "kind", "x").agg(F.sum("n").alias("n"))


def _segments(rows: pd.DataFrame) -> list[tuple[int | None, str | None, int, int]]:
    """(from day, zone, violations, evidence) of the sequence of histories of one group, first to last.

    ``rows``: month, zone, violations, evidence, history (a number for the offsets that the zone has on the month's days with values).
    """
    wide = rows.pivot_table(index="month", columns="zone", values="violations", aggfunc="sum").sort_index().sort_index(axis=1)
    offsets = rows.pivot_table(index="month", columns="zone", values="history", aggfunc="first").reindex(index=wide.index, columns=wide.columns)
    seen = rows.groupby("month")["evidence"].max().reindex(wide.index).to_numpy()
    cost, zones, total = wide.to_numpy(dtype=float), list(wide.columns), int(seen.sum())
    change = max(LEAST_CHANGE, CHANGE_SHARE * total)
    best, back = cost[0].copy(), np.zeros((len(cost), len(zones)), dtype=int)
    for m in range(1, len(cost)):
        cheapest = int(np.argmin(best))
        move = best[cheapest] + change < best
        back[m] = np.where(move, cheapest, np.arange(len(zones)))
        best = np.where(move, best[cheapest] + change, best) + cost[m]
    way = [int(np.argmin(best))]
    for m in range(len(cost) - 1, 0, -1):
        way.append(int(back[m][way[-1]]))
    way.reverse()
    out, start = [], 0
    for m in range(1, len(way) + 1):
        if m == len(way) or way[m] != way[start]:
            part = cost[start:m].sum(axis=0)
            ties = np.flatnonzero(part == part[way[start]])
            histories = {tuple(offsets.iloc[start:m, z]) for z in ties}
            decided = len(histories) == 1 and seen[start:m].sum() > 0
            out.append((int(wide.index[start]) if start else None, zones[ties[0]] if decided else None, int(part[way[start]]), int(seen[start:m].sum())))
            start = m
    return out


def estimate_zones(evidence: DataFrame, group: str, declared: DataFrame, candidates: Sequence[str] = CANDIDATE_ZONES, override_share: float = 0.5) -> DataFrame:
    """(group, from_day, zone, violations, evidence, estimated_zone, declared_zone): the offset history of each group's clock.

    ``evidence``: what ``offset_evidence`` gives; ``declared``: (group, zone).  A history holds from ``from_day`` (days since 1970, null for
    the first) to that of the next row.  ``zone`` is null where neither the evidence nor a declaration decides.  The histories of a group are weighed in
    one task, from a row per month and candidate.
    """
    evidence = cut_lineage(evidence)  # read twice, and a fraction of the values that it comes from
    known = known_zones(evidence)
    told = declared.select(F.col(group), F.col("zone").alias("declared_zone")).filter(F.col("zone").isin(known))
    # at most the zones there are
    zones = sorted(set(candidates) | {r["declared_zone"] for r in told.select("declared_zone").distinct().collect()})
    # each zone's offset is looked up once a day, whatever the number of groups and offsets
    hours = T.bind(evidence.select("day").distinct().withColumn("zone", F.explode(F.lit(zones))), _off=F.round(T.offset_at(F.col("day").cast("bigint") * 86400 + 43200, F.col("zone")) / QUARTER).cast("int"))
    offsets = hours.groupBy("day").agg(F.collect_list(F.struct("zone", "_off")).alias("_zones"))
    tried = evidence.join(small_side(told), group, "left").join(offsets, "day").select(*evidence.columns, "declared_zone", F.inline("_zones"))
    off = tried.filter(F.col("zone").isin(sorted(set(candidates))) | (F.col("zone") == F.col("declared_zone")))
    wrong = F.when(F.col("kind") == "is", F.col("_off") != F.col("x")).when(F.col("kind") == "least", F.col("_off") < F.col("x")).when(F.col("kind") == "most", F.col("_off") > F.col("x")).otherwise(F.lit(False))
    month = F.floor(F.col("day") / 30).cast("int").alias("month")
    sums = off.groupBy(group, month, "zone", "declared_zone").agg(
        F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("violations"),
        F.sum(F.when(F.col("kind") != "asked", F.col("n")).otherwise(0)).alias("evidence"),
        F.sum(F.when(F.col("kind") == "asked", F.xxhash64("day", "_off") % 1_000_003)).alias("history"),
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.fillna({"history": 0})
        name, own = rows[group].iloc[0], rows["declared_zone"].iloc[0]
        parts = _segments(rows)
        if own is not None:
            mine, total = rows.loc[rows["zone"] == own, "violations"].sum(), sum(p[3] for p in parts)
            if not total or mine - sum(p[2] for p in parts) <= override_share * total:
                best = parts[0][1] if len(parts) == 1 else None
                return pd.DataFrame([(name, None, own, int(mine), total, best, own)], columns=columns).astype({"from_day": "Int32"})
        return pd.DataFrame([(name, None if d is None else d * 30, z or own, v, e, z, own) for d, z, v, e in parts], columns=columns).astype({"from_day": "Int32"})

    columns = [group, "from_day", "zone", "violations", "evidence", "estimated_zone", "declared_zone"]
    kind = evidence.schema[group].dataType.simpleString()
    found = sums.groupBy(group).applyInPandas(choose, f"`{group}` {kind}, from_day int, zone string, violations bigint, evidence bigint, estimated_zone string, declared_zone string")
    silent = told.join(found.select(group), group, "left_anti").select(group, F.lit(None).cast("int").alias("from_day"), F.col("declared_zone").alias("zone"), F.lit(0).cast("bigint").alias("violations"), F.lit(0).cast("bigint").alias("evidence"), F.lit(None).cast("string").alias("estimated_zone"), "declared_zone")
    return found.unionByName(silent)


def source_values(df: DataFrame, sources: DataFrame, key: str, fields: Sequence[str], group: str, file: str | None = "sha256") -> tuple[DataFrame, DataFrame]:
    """(values, declared): what ``parse_values`` gives for ``df``, written down as it is read several times, and the zone that each group declares."""
    told = sources.select(F.col(group), "home_zone", "date_order").withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("home_zone", "date_order"))).filter("_n = 1").drop("_n")
    file = file if file in df.columns else None
    base = df.select(key, group, *fields, *([file] if file else [])).join(told.select(group, F.col("date_order").alias("_date_order")), group, "left")
    return cut_lineage(parse_values(base, key, list(fields), group, "_date_order", file)), told.select(group, F.col("home_zone").alias("zone"))


def to_instants(df: DataFrame, sources: DataFrame, bounds: DataFrame, key: str = "doc_id", fields: Sequence[str] = ("metadata_created", "metadata_modified"), group: str = "source", file: str | None = "sha256") -> DataFrame:
    """(key, field, utc_second) of every value of ``fields`` that fixes exactly one instant.

    ``sources``: (group, home_zone, date_order); ``bounds``: (key, seen_s); ``file``: the column that copies of a file share, if there is one.
    """
    values, declared = source_values(df, sources, key, fields, group, file)
    zones = cut_lineage(estimate_zones(offset_evidence(values, bounds, key, group, fields[0], fields[-1]), group, declared))
    until = F.lead("from_day").over(Window.partitionBy(group).orderBy(F.col("from_day").asc_nulls_first()))
    spans = zones.withColumn("_until", until).select(group, F.col("zone").alias("_zone"), "from_day", "_until").filter("_zone is not null")
    day = F.floor(F.col("local_s") / 86400)
    # a third of all rows may be of one source: its few histories go to the rows, not the rows to them
    open_rows = values.filter(F.col("zone") == "").join(small_side(spans), group).filter((F.col("from_day").isNull() | (day >= F.col("from_day"))) & (F.col("_until").isNull() | (day < F.col("_until"))))
    solved = T.bind(open_rows.drop("utc_s"), utc_s=T.resolve_wall_clock(F.col("local_s"), F.col("_zone"))).select(key, "field", "utc_s")
    out = values.filter(F.col("utc_s").isNotNull()).select(key, "field", "utc_s").unionByName(solved)
    return out.filter(F.col("utc_s").isNotNull()).withColumnRenamed("utc_s", "utc_second")
