"""Notations, zones and their edges; the operator's defined results."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import instants as I

SOURCES = "source string, home_zone string, date_order string"


def run(spark, values, zone="America/New_York", order="mdy", modified=None, seen=None):
    rows = [(i, v, (modified or {}).get(i), "s", "extra", "z") for i, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id bigint, metadata_created string, metadata_modified string, source string, zone string, value string")
    src = spark.createDataFrame([("s", zone, order)], SOURCES)
    bounds = spark.createDataFrame(list((seen or {}).items()) or [(-1, 0)], "doc_id bigint, seen_s bigint")
    return {(r.doc_id, r.field): r.utc_second for r in I.to_instants(docs, src, bounds).collect()}


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


FIXED = {
    "D:20130603011603+09'00'": utc(2013, 6, 2, 16, 16, 3), "D:20210527082212-0400": utc(2021, 5, 27, 12, 22, 12), "D:201703071646+11'00": utc(2017, 3, 7, 5, 46), "D:20110813172457Z00'00'": utc(2011, 8, 13, 17, 24, 57),
    "20171019T083651Z": utc(2017, 10, 19, 8, 36, 51), "1637039248": 1637039248, "1688196733618": 1688196733, "1428925628337752": 1428925628, "2019-04-05 15:58:59 GMT+11:00": utc(2019, 4, 5, 4, 58, 59),
    "2010-12-27 07:17+0100": utc(2010, 12, 27, 6, 17), "2009-08-16T16:57:33.179074Z": utc(2009, 8, 16, 16, 57, 33), "Mon, 11 Nov 2013 04:51:31 +0000": utc(2013, 11, 11, 4, 51, 31), "2022-08-29 03:39:59 EDT": utc(2022, 8, 29, 7, 39, 59),
    "Sat Apr 28 13:45:05 CEST 2018": utc(2018, 4, 28, 11, 45, 5), "2023-08-08T16:01:39 Europe/Berlin": utc(2023, 8, 8, 14, 1, 39), "2013-04-11 07:11:44 AEST": utc(2013, 4, 10, 21, 11, 44), "2012-11-16 19:30:39 JST": utc(2012, 11, 16, 10, 30, 39),
}
LOCAL = {  # New York
    "D:20170211151438": utc(2017, 2, 11, 20, 14, 38), "07/16/2022 4:58:08 AM": utc(2022, 7, 16, 8, 58, 8), "Fri Jan 31 10:59:24 2020": utc(2020, 1, 31, 15, 59, 24), "Fri Sep  9 18:07:16 2011": utc(2011, 9, 9, 22, 7, 16),
    "25 June 2010 06:56:41": utc(2010, 6, 25, 10, 56, 41), "Dec 12, 2009 12:35 AM": utc(2009, 12, 12, 5, 35), "2010年3月31日 09时15分": utc(2010, 3, 31, 13, 15), "2020年2月27日 16:57": utc(2020, 2, 27, 21, 57), "19. August 2012, 10:41": utc(2012, 8, 19, 14, 41),
    "14 avril 2010 18:43:50": utc(2010, 4, 14, 22, 43, 50), "31 марта 2019 03:49:49": utc(2019, 3, 31, 7, 49, 49), "16. März 2023, 23:47": utc(2023, 3, 17, 3, 47), "20190303031110": utc(2019, 3, 3, 8, 11, 10), "2022-08-25 21:20:33": utc(2022, 8, 26, 1, 20, 33),
}
NONE = [
    None, "", "   ", "unknown", "D:", "D:20090701", "2022", "August 2023", "26.02.2010", "2016-04-05T25:61:00Z", "2014-06-31 09:12:44", "D:20150230101500Z", "0000-00-00 00:00:00", "2017-13-04T10:00:00Z", "13/13/2020 10:00",
    "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-03-31 02:21:22 Europe/Berlin", "2024-01-01 10:00:00 Nowhere/Land", "x" * 70000, "12:30", "Jan 5, 2018 13:05 PM",
]


def test_fixed_and_local(spark):
    values = [*FIXED, *LOCAL]
    got = run(spark, values)
    for i, v in enumerate(values):
        assert got.get((i, "metadata_created")) == (FIXED | LOCAL)[v], v


def test_no_case(spark):
    assert run(spark, NONE) == {}


@pytest.mark.parametrize(("order", "want"), [("mdy", utc(2020, 3, 4, 10, 0)), ("dmy", utc(2020, 4, 3, 10, 0))])
def test_date_order(spark, order, want):
    assert run(spark, ["03/04/2020 10:00"], "UTC", order) == {(0, "metadata_created"): want}


def zones_of(spark, docs, seen=(), declared=(("s", None),)):
    """Rows (from_day, zone, estimated_zone) for docs (doc_id, created, modified, source, file)."""
    df = spark.createDataFrame(docs, "doc_id bigint, metadata_created string, metadata_modified string, source string, sha256 string")
    src = spark.createDataFrame([(s, z, "mdy") for s, z in declared], SOURCES)
    bounds = spark.createDataFrame(list(seen), "doc_id bigint, seen_s bigint")
    fields = ("metadata_created", "metadata_modified")
    values, told = I.source_values(df, src, "doc_id", fields, "source")
    rows = I.estimate_zones(I.offset_evidence(values, bounds, "doc_id", "source", *fields), "source", told).orderBy(F.col("from_day").asc_nulls_first()).collect()
    return [(r.from_day, r.zone, r.estimated_zone) for r in rows]


def wall(instant, zone):
    return dt.datetime.fromtimestamp(instant, ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")


YEAR = [utc(2019, 1, 7, 12) + i * 9 * 86400 + i * 977 for i in range(80)]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Denver", "Europe/London", "UTC", "Australia/Sydney", "Asia/Kathmandu"])
def test_zone_from_copies(spark, zone):
    """Copies of a file tell the offset of a clock on the days of its values, and so the zone."""
    docs = [(i, wall(t, zone), None, "s", f"f{i}") for i, t in enumerate(YEAR)] + [(1000 + i, dt.datetime.fromtimestamp(t, dt.timezone.utc).strftime("D:%Y%m%d%H%M%SZ"), None, "other", f"f{i}") for i, t in enumerate(YEAR)]
    assert zones_of(spark, docs) == [(None, zone, zone)]


def test_zone_from_written_offsets_ingestion_and_order(spark):
    """Sydney: its tools write its offsets; nothing is later than its ingestion or out of order."""
    docs, seen = [], []
    for i, t in enumerate(YEAR):
        local = dt.datetime.fromtimestamp(t, ZoneInfo("Australia/Sydney"))
        docs.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), dt.datetime.fromtimestamp(t + 1800, ZoneInfo("Australia/Sydney")).strftime("%Y-%m-%d %H:%M:%S%z") if i % 2 else None, "s", None))
        seen.append((i, t + 3600))
    assert zones_of(spark, docs, seen) == [(None, "Australia/Sydney", "Australia/Sydney")]


def test_clock_moved_to_another_zone(spark):
    zone = lambda t: "Asia/Tokyo" if t < YEAR[40] else "America/Chicago"
    docs = [(i, wall(t, zone(t)), None, "s", f"f{i}") for i, t in enumerate(YEAR)] + [(1000 + i, str(t), None, "o", f"f{i}") for i, t in enumerate(YEAR)]
    (a, b) = zones_of(spark, docs)
    assert (a[0], a[1], b[1]) == (None, "Asia/Tokyo", "America/Chicago") and abs(b[0] - YEAR[40] // 86400) <= 31


def test_undecided_and_declared(spark):
    """Bounds of days say nothing of hours; a declared zone decides, outside the list too, and is given up only against evidence."""
    loose = [(i, wall(t, "Asia/Tokyo"), None, "s", None) for i, t in enumerate(YEAR)]
    late = [(i, t + 20 * 86400) for i, t in enumerate(YEAR)]
    assert zones_of(spark, loose, late) == [(None, None, None)]
    assert zones_of(spark, loose, late, [("s", "Asia/Kabul")]) == [(None, "Asia/Kabul", None)]
    sure = loose[:0] + [(i, wall(t, "Asia/Kabul"), None, "s", f"f{i}") for i, t in enumerate(YEAR)] + [(1000 + i, str(t), None, "o", f"f{i}") for i, t in enumerate(YEAR)]
    assert zones_of(spark, sure, (), [("s", "Asia/Kabul")]) == [(None, "Asia/Kabul", "Asia/Kabul")]
    tokyo = [(i, wall(t, "Asia/Tokyo"), None, "s", f"f{i}") for i, t in enumerate(YEAR)] + sure[len(YEAR) :]
    assert zones_of(spark, tokyo, (), [("s", "Asia/Kabul")])[0][1] == "Asia/Tokyo"
    assert zones_of(spark, [], (), [("s", "Asia/Kabul"), ("t", None)]) == [(None, "Asia/Kabul", None)]


def test_instants_without_declared_zone(spark):
    df = spark.createDataFrame([(i, wall(t, "Asia/Tokyo"), "s", f"f{i}") for i, t in enumerate(YEAR)] + [(1000 + i, str(t), "o", f"f{i}") for i, t in enumerate(YEAR)], "doc_id bigint, metadata_created string, source string, sha256 string").withColumn("metadata_modified", F.lit(None).cast("string"))
    src = spark.createDataFrame([("s", None, "mdy")], SOURCES)
    got = {r.doc_id: r.utc_second for r in I.to_instants(df, src, spark.createDataFrame([], "doc_id bigint, seen_s bigint")).collect()}
    assert all(got[i] == got[1000 + i] == t for i, t in enumerate(YEAR))


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(1, "1637039248", None, "s")] * 2, "doc_id bigint, metadata_created string, metadata_modified string, source string")
    src = spark.createDataFrame([("s", "UTC", "mdy"), ("s", "UTC", "mdy")], SOURCES)
    assert I.to_instants(docs, src, spark.createDataFrame([], "doc_id bigint, seen_s bigint")).count() == 2


def test_null_source_keeps_fixed_values(spark):
    docs = spark.createDataFrame([(1, "1637039248", "2020-01-01 10:00", None)], "doc_id bigint, metadata_created string, metadata_modified string, source string")
    src = spark.createDataFrame([("s", "UTC", "mdy")], SOURCES)
    got = I.to_instants(docs, src, spark.createDataFrame([], "doc_id bigint, seen_s bigint")).collect()
    assert [(r.field, r.utc_second) for r in got] == [("metadata_created", 1637039248)]
