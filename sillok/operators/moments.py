"""Closing moments: mixed timestamp spellings and zones brought to one UTC moment or one stated day.

``read_moment`` reads one text: full-width folding, the last side of a period, one date, one clock, one zone.
``normal_moments`` applies it to a table in Arrow batches (as a Catalyst expression the same grammar takes the optimizer minutes to plan).
``estimate_zone_history`` infers missing zones by aligning local readings with ingestion times and choosing the offset
history with the fewest violations; it runs on built-in expressions with counts taken before any shuffle.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillok.session import bounded_broadcast

#: Zone abbreviations and their own offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "ICT": 420, "WIB": 420, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "SGT": 480, "HKT": 480, "PHT": 480,
    "AWST": 480, "KST": 540, "JST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
#: First three letters of the English months, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Phrases that state an open end.
OPEN_END = r"(?i)채용\s*시|충원\s*시|상시|수시|until\s+(?:filled|further)|rolling|선착순|미정"

_FOLD = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)} | {0x2212: "-", 0x2010: "-", 0x2011: "-"}
_FOLD |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0xAD))
_OPEN = re.compile(OPEN_END)
_SPLIT = re.compile(r"\s*[~–—∼〜]\s*|\s+-\s+|\s+(?:to|until)\s+|부터\s*|(?<=\d)-(?=\d{4}[./]\d)", re.IGNORECASE)
_WEEKDAY = re.compile(r"\((?:[월화수목금토일](?:요일)?|(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*)\)", re.IGNORECASE)
_COUNT = re.compile(r"(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?", re.ASCII)
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
#: Date spellings, the first that occurs holds, and which of their groups are year, month and day.
_DATES = tuple(
    (re.compile(pattern, re.IGNORECASE | re.ASCII), order)
    for pattern, order in (
        (r"(?<!\d)(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})(?!\d)\s*(?:일|\.(?!\d))?", (1, 2, 3)),
        (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?=$|\D|\d{4}(?:\d{2})?(?!\d))", (1, 2, 3)),
        (rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH},?[\s-]+(\d{{4}})(?!\d)", (3, 2, 1)),
        (rf"(?<![a-z]){_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)", (3, 1, 2)),
        (r"(?<![\d.])'?(\d{2})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})(?!\d)\s*(?:일|\.(?!\d))?", (1, 2, 3)),
        (r"(?<!\d)'?(\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    )
)
_HALF = r"(오전|오후|[ap]\.?m\b\.?)"
_CLOCK = re.compile(
    rf"[\sT,]*(?:at\s+)?{_HALF}?\s*(?<!\d)(\d{{1,2}})\s*(?::\s*(\d{{2}})(?!\d)(?::(\d{{2}})(?!\d)(?:[.,](\d+))?)?|시(?:\s*(\d{{1,2}})\s*분)?(?:\s*(\d{{1,2}})\s*초)?|(?=\s*[ap]\.?m))\s*{_HALF}?",
    re.IGNORECASE | re.ASCII,
)
_TIGHT = re.compile(r"\s*T?\s*(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?(?!\d)", re.ASCII)
_SHIFT = re.compile(r"(?:^|[\s(\[]|UTC|GMT)([+-])(\d{1,2}):?(\d{2})?(?!\d)", re.IGNORECASE | re.ASCII)
_REGION = re.compile(r"[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+\d*)+")
_SHORT = re.compile(r"(?<![A-Za-z])[A-Za-z]{1,5}(?![A-Za-z])")


def _zone(text: str) -> timezone | zoneinfo.ZoneInfo | None:
    """The zone a text names: an offset, then a region, then an abbreviation."""
    if m := _SHIFT.search(text):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes)) if minutes < 24 * 60 else None
    if m := _REGION.search(text):
        try:
            return zoneinfo.ZoneInfo(m[0])
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            return None
    for word in _SHORT.findall(text):
        if word.upper() in ABBREVIATIONS:
            return timezone(timedelta(minutes=ABBREVIATIONS[word.upper()]))
    return None


def _stamp(moment: datetime) -> str:
    return moment.astimezone(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"


def read_moment(raw: str | None, hour: str | None = None, minute: str | None = None, zone: str | None = None, default_zone: str | None = "UTC") -> str | None:
    """``YYYY-MM-DDThh:mm:ss.ffffffZ`` of a stated moment, ``YYYY-MM-DD`` of a stated day, else null.

    ``hour`` and ``minute`` are a clock kept apart and hold where ``raw`` has none; ``zone`` is a zone kept apart and comes before one in ``raw``. A clock without zone is
    read in ``default_zone``; without one (null) its local time comes out as ``YYYY-MM-DDThh:mm:ss.ffffff``. Fractions beyond microseconds are cut off. Null where no full date stands at the end of the text, a date or
    clock is impossible, the zone skips the local time, the end is open, or the year is 2100 or later; also for null, empty and very long texts without a date.
    """
    if not raw:
        return None
    text = " ".join(raw.translate(_FOLD).split())
    if _OPEN.search(text):
        return None
    text = _WEEKDAY.sub(" ", _SPLIT.split(text)[-1]).strip()
    if m := _COUNT.fullmatch(text):
        micros = int(m[1].ljust(16, "0")[:16])  # 10 digits of seconds reach from 2001 to 2286, so the length gives the scale
        if len(m[1]) == 10 and m[2]:
            micros += int(m[2][:6].ljust(6, "0"))
        return _stamp(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)) if micros < 4_102_444_800_000_000 else None
    for pattern, (y, mo, d) in _DATES:
        if m := pattern.search(text):
            break
    else:
        return None
    month = int(m[mo]) if m[mo].isdigit() else MONTHS.index(m[mo].lower()) + 1
    year = int(m[y]) + (2000 if len(m[y]) == 2 else 0)
    try:
        day = date(year, month, int(m[d]))
    except ValueError:
        return None
    if year >= 2100:
        return None
    rest = text[m.end() :]
    half = fraction = None
    if c := _CLOCK.match(rest):
        half, h, mi, s, fraction = c[1] or c[8], c[2], c[3] or c[6], c[4] or c[7], c[5]
    elif c := _TIGHT.match(rest):
        h, mi, s, fraction = c[1], c[2], c[3], c[4]
    elif hour and hour.strip():
        h, mi, s = hour.strip(), (minute or "").strip(), None
    else:
        return day.isoformat()
    try:
        h, mi, s = int(h), int(mi or 0), int(s or 0)
    except ValueError:
        return None
    micro = int((fraction or "0")[:6].ljust(6, "0"))
    if half and h <= 12:
        h = h % 12 + (12 if half.lower()[0] in "오p" and half[:2] != "오전" else 0)
    if h == 24 and not (mi or s or micro):
        wall = datetime.combine(day, datetime.min.time()) + timedelta(days=1)
    elif h <= 23 and mi <= 59 and s <= 59:
        wall = datetime(year, month, day.day, h, mi, s, micro)
    else:
        return None
    stated = (zone or "").translate(_FOLD).strip()
    place = _zone(stated) if stated else _zone(rest[c.end() :] if c else rest)
    if place is None:
        if stated:
            return None
        if default_zone is None:
            return wall.isoformat(timespec="microseconds")
        place = zoneinfo.ZoneInfo(default_zone)
    moment = wall.replace(tzinfo=place)
    if isinstance(place, zoneinfo.ZoneInfo) and moment.astimezone(timezone.utc).astimezone(place).replace(tzinfo=None) != wall:
        return None
    return _stamp(moment)


def normal_moments(raw: Column, hour: Column, minute: Column, zone: Column, default_zone: Column) -> Column:
    """``read_moment`` over columns, in Arrow batches."""

    @F.pandas_udf("string")
    def norm(raw: pd.Series, hour: pd.Series, minute: pd.Series, zone: pd.Series, default: pd.Series) -> pd.Series:
        return pd.Series([read_moment(*row) for row in zip(raw, hour, minute, zone, default, strict=True)], dtype=object)

    return norm(raw, hour, minute, zone, default_zone)


def estimate_zone_history(
    df: DataFrame, group: str, wall: str, ingested: str, zones: tuple[str, ...], *, earliest_hours: int = -24, latest_hours: int = 0, change_cost: float = 3.0, change_share: float = 0.0, bucket_days: int = 7
) -> DataFrame:
    """The zone history of each group with the fewest violations: ``group, from_day, zone, violations, readings``.

    ``wall`` (timestamp_ntz) are local readings without zone, ``ingested`` (timestamp_ntz, UTC) when each was taken in. A reading violates a zone if its UTC moment lies before
    ``earliest_hours`` or after ``latest_hours`` from its ingestion, so both sides bind the offset. Counts are taken per group, bucket of ``bucket_days`` and zone (pre-aggregated, so a hot group is one short
    table), then a Viterbi pass over the buckets chooses the history with the least violations plus, for each change, ``change_cost`` and ``change_share`` of the group's readings (readings that violate every zone by chance differ a little between zones, in proportion to their number). The zone listed first is what is held before: another one at the start
    is a change too, and ties stay with the earlier listed. Rows with a null in any of the three columns take no part; an empty table gives no rows.
    """
    if group in ("from_day", "zone", "violations", "readings"):
        raise ValueError(f"the group column needs another name than {group}")
    counted = df.select(group, F.col(wall).alias("_w"), F.col(ingested).alias("_i")).na.drop()
    counted = counted.withColumn("_b", (F.datediff(F.col("_i").cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days).cast("int"))
    sums = [F.count(F.lit(1)).alias("_n")]
    hours = lambda n: F.expr(f"interval {int(n)} hours")
    for k, zone in enumerate(zones):
        utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("_w"))
        bad = (utc < F.col("_i") + hours(earliest_hours)) | (utc > F.col("_i") + hours(latest_hours))
        sums.append(F.sum(bad.cast("long")).alias(f"_v{k}"))
    counted = counted.groupBy(group, "_b").agg(*sums)
    names = list(zones)

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        cost = pdf[[f"_v{k}" for k in range(len(names))]].to_numpy(float)
        change = change_cost + change_share * float(pdf["_n"].sum())
        best, back = cost[0] + [k * 1e-9 + change * (k > 0) for k in range(len(names))], []
        for row in cost[1:]:
            stay, move = best, best.min() + change
            back.append([k if stay[k] <= move else int(best.argmin()) for k in range(len(names))])
            best = row + pd.Series(stay).clip(upper=move).to_numpy()
        path = [int(best.argmin())]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        out = pdf.assign(zone=[names[k] for k in path], violations=[int(cost[i, k]) for i, k in enumerate(path)])
        out["run"] = (out["zone"] != out["zone"].shift()).cumsum()
        done = out.groupby("run", sort=True).agg(**{group: (group, "first"), "from_day": ("_b", "min"), "zone": ("zone", "first"), "violations": ("violations", "sum"), "readings": ("_n", "sum")})
        done["from_day"] = pd.to_datetime(done["from_day"] * bucket_days, unit="D").dt.date
        return done[[group, "from_day", "zone", "violations", "readings"]]

    kind = dict(df.dtypes)[group]
    return counted.groupBy(group).applyInPandas(history, f"`{group}` {kind}, from_day date, zone string, violations long, readings long")


def zone_at(histories: DataFrame, group: str, *, most_groups: int = 100_000) -> Callable[[DataFrame, str], DataFrame]:
    """A step that adds ``_zone``, the estimated zone of a row's group on the day of column ``day`` (the first one before the history begins; null for unknown groups).

    A group's changes are few (each cost ``change_cost`` violations), so they travel as one array; groups are broadcast up to ``most_groups``, more meet in a shuffle.
    """
    held = histories.groupBy(F.col(group).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("from_day", "zone"))).alias("_runs"))
    held = bounded_broadcast(held, most_groups, 160)

    def add(df: DataFrame, day: str) -> DataFrame:
        met = df.join(held, F.col(group) == F.col("_group"), "left")
        begun = F.filter("_runs", lambda r: r["from_day"] <= F.col(day))
        zone = F.coalesce(F.try_element_at(begun, F.lit(-1)), F.get("_runs", 0))["zone"]
        return met.withColumn("_zone", zone).drop("_group", "_runs")

    return add
