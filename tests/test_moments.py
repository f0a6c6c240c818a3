from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sillok.operators.moments import estimate_zone_history, normal_moments, read_moment, zone_at

SEOUL = "Asia/Seoul"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026.02.05 17:00:00", "2026-02-05T08:00:00.000000Z"),
        ("2026. 2. 13.", "2026-02-13"),
        ("'26.03.01(일) 10:00", "2026-03-01T01:00:00.000000Z"),
        ("26/02/09 00:00", "2026-02-08T15:00:00.000000Z"),
        ("20260302T170000+0900", "2026-03-02T08:00:00.000000Z"),
        ("20260212000000", "2026-02-11T15:00:00.000000Z"),
        ("20260215 1800", "2026-02-15T09:00:00.000000Z"),
        ("1770767940", "2026-02-10T23:59:00.000000Z"),
        ("1771351200250", "2026-02-17T18:00:00.250000Z"),
        ("2026-02-16T00:00:00.653421999Z", "2026-02-16T00:00:00.653421Z"),
        ("2026-02-06 24:00:00", "2026-02-06T15:00:00.000000Z"),
        ("2026.2.25. 오전 12:00", "2026-02-24T15:00:00.000000Z"),
        ("2026.2.10 오후 12:37", "2026-02-10T03:37:00.000000Z"),
        ("Mar 17, 2026 5:00 PM KST", "2026-03-17T08:00:00.000000Z"),
        ("February 9 2026 at 6:00 PM", "2026-02-09T09:00:00.000000Z"),
        ("23 April 2026, 3:00 PM", "2026-04-23T06:00:00.000000Z"),
        ("Mon, 09 Mar 2026 17:00:00 +0100", "2026-03-09T16:00:00.000000Z"),
        ("2026-02-08 15:00 UTC+1", "2026-02-08T14:00:00.000000Z"),
        ("2026-04-05 23:59 (EDT)", "2026-04-06T03:59:00.000000Z"),
        ("2026-04-01T10:00:00-03:30", "2026-04-01T13:30:00.000000Z"),
        ("2026-10-25T01:15 Europe/London", "2026-10-25T00:15:00.000000Z"),  # occurs twice: the first
        ("2026.01.15 09:00 – 2026.02.21 10:00", "2026-02-21T01:00:00.000000Z"),
        ("~ 2026.02.15", "2026-02-15"),
        ("2026년 2월 18일 15시 11분까지", "2026-02-18T06:11:00.000000Z"),
        ("２０２６．０５．０３　１０：００", "2026-05-03T01:00:00.000000Z"),
    ],
)
def test_read(raw, want):
    assert read_moment(raw, default_zone=SEOUL) == want


@pytest.mark.parametrize(
    "raw",
    [None, "", "   ", "2026.02.01 ~ 02.16", "2026-02-30", "2026.03.24 27:10", "2026-02-11T18:61:00Z", "2026-03-29T02:15 Europe/Berlin", "상시 모집", "채용시까지", "2999-12-31", "9999.12.31", "4월 7일까지", "D-10", "오늘 마감", "0000-00-00 00:00:00", "2026.00.21 10:00:00", "x" * 100_000],
)
def test_no_case(raw):
    assert read_moment(raw, default_zone=SEOUL) is None


def test_columns_kept_apart():
    assert read_moment("2026.02.19", "19", "43", "JST", SEOUL) == "2026-02-19T10:43:00.000000Z"
    assert read_moment("2026.02.19", None, "59", "JST", SEOUL) == "2026-02-19"
    assert read_moment("2026.02.19", "24", "00", None, SEOUL) == "2026-02-19T15:00:00.000000Z"
    assert read_moment("2026.02.19", "24", "30", None, SEOUL) is None
    assert read_moment("2026.02.25  15:00", "9", "00", "+0200", SEOUL) == "2026-02-25T13:00:00.000000Z"


def test_table(spark):
    rows = [("a", "2026-02-05 10:00", None), ("b", None, "x"), ("c", "", None), ("a", "2026-02-05 10:00", None)]
    df = spark.createDataFrame(rows, "norm string, raw string, zone string")
    none = F.lit(None).cast("string")
    got = df.select("norm", normal_moments(F.col("raw"), none, none, none, F.lit(SEOUL)).alias("n")).collect()
    assert sorted((r[0], r[1]) for r in got if r[1]) == [("a", "2026-02-05T01:00:00.000000Z")] * 2
    empty = df.limit(0).select(normal_moments(F.col("raw"), none, none, none, F.lit(SEOUL)).alias("n"))
    assert empty.count() == 0


def test_zone_history(spark):
    """A site whose clock moves from New York to Berlin, each reading taken within the hour."""
    rows = []
    for day in range(60):
        moment = datetime(2026, 1, 5, 12) + timedelta(days=day)
        local = moment - timedelta(hours=5) if day < 30 else moment + timedelta(hours=1)
        rows.append(("s", local - timedelta(minutes=20), moment))
    rows += [("t", None, datetime(2026, 1, 1)), (None, datetime(2026, 1, 1), datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "site string, wall timestamp_ntz, ingested timestamp_ntz")
    got = estimate_zone_history(df, "site", "wall", "ingested", (SEOUL, "America/New_York", "Europe/Berlin"), earliest_hours=-3).orderBy("from_day").collect()
    assert [(r["site"], r["zone"]) for r in got] == [("s", "America/New_York"), ("s", "Europe/Berlin")]
    assert sum(r["readings"] for r in got) == 60
    assert estimate_zone_history(df.limit(0), "site", "wall", "ingested", (SEOUL,)).count() == 0


def test_zones_by_site(spark):
    """Closing times that only fit another zone move their site there; one misfit moves nothing."""
    at = datetime(2026, 3, 2, 12)
    rows = [("far", at + timedelta(hours=h), at + timedelta(days=d)) for d in range(8) for h in (24 * d + 2,)] + [("home", at - timedelta(hours=1), at), *[("home", at + timedelta(days=9), at)] * 5]
    df = spark.createDataFrame(rows, "site string, wall timestamp_ntz, ingested timestamp_ntz")
    found = estimate_zone_history(df, "site", "wall", "ingested", (SEOUL, "UTC"), earliest_hours=0, latest_hours=9000)
    assert {(r["site"], r["zone"], r["violations"]) for r in found.collect()} == {("far", "UTC", 0), ("home", SEOUL, 1)}
    days = spark.createDataFrame([("far", at.date()), ("none", at.date()), (None, None)], "site string, day date")
    assert [r["_zone"] for r in zone_at(found, "site")(days, "day").orderBy("site").collect()] == [None, "UTC", None]
    assert read_moment("2026-02-05 10:00", default_zone=None) == "2026-02-05T10:00:00.000000" and read_moment("2026-02-05 10:00 KST", default_zone=None) == "2026-02-05T01:00:00.000000Z"
