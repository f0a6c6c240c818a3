import re
from datetime import date, datetime, timedelta, timezone

import __spark_entry__ as entry
from sillok.plans.reference_queries import NOW

SEOUL = timezone(timedelta(hours=9))
RAW = [
    "2026-03-31", "2026-04-01", "2026-02-30", "2026년 3월 31일", "2026년 4월 1일", "2026.3.31", "2026.04.01", "2026.13.01", "2026-04-01T09:00", "2026-04-01T08:59:59", "2026-04-01 09:00:00", "2026-04-01T00:00:00Z",
    "2026-03-31T23:59:59Z", "2026-03-31T19:00:00-05:00", "2026-03-31T18:59:59-05:00", "2026-04-01T05:30:00+05:30", "2026-04-01T24:00", "2026년 4월 1일 9시 0분", "2026년 4월 1일 8시 59분 59초", "2026.4.1 09:00", "2026.4.1 08:59",
    "채용시 마감", "상시 채용", "2026-03-01 ~ 2026-04-30", "추후 공지", "", None,
]
_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})|(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일|(\d{4})\.(\d{1,2})\.(\d{1,2})", re.ASCII)
_TIME = re.compile(r"[T\s]\s*(?:(\d{1,2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?|(\d{1,2})시\s*(\d{1,2})분(?:\s*(\d{1,2})초)?)", re.ASCII)


def state(raw):
    """The rule of the survey, one value after another."""
    now = datetime.fromtimestamp(NOW, timezone.utc)
    text = (raw or "").strip(" ")
    try:
        d = _DATE.match(text)
        day = date(*(int(x) for x in d.groups() if x))
        rest = text[d.end() :]
        if not rest:
            return "open" if datetime.combine(day + timedelta(days=1), datetime.min.time(), SEOUL) > now else "expired"
        t = _TIME.fullmatch(rest)
        clock = [int(x or 0) for x in (t.group(1, 2, 3) if t[1] else t.group(5, 6, 7))]
        zone = datetime.fromisoformat("2000-01-01T00:00" + t[4]).tzinfo if t[4] else SEOUL
        return "open" if datetime(day.year, day.month, day.day, *clock, tzinfo=zone) >= now else "expired"
    except (AttributeError, ValueError, TypeError):
        return "rolling" if re.sub(r"\s+", "", raw or "") in ("채용시마감", "상시", "상시채용", "상시모집") else "unknown"


def test_every_posting_has_its_state(spark, tmp_path):
    spark.createDataFrame(list(enumerate(RAW)), "ordinal long, deadline_raw string").write.parquet(str(tmp_path / "job.parquet"))
    got = {r["ordinal"]: r["state"] for r in entry.queries()["q_deadline_state"](spark, str(tmp_path)).collect()}
    assert got == {i: state(raw) for i, raw in enumerate(RAW)}
    by_raw = dict(zip(RAW, (got[i] for i in range(len(RAW))), strict=True))
    assert by_raw["2026-04-01T09:00"] == by_raw["2026-03-31T19:00:00-05:00"] == "open" and by_raw["2026-04-01T08:59:59"] == by_raw["2026-03-31"] == "expired"
