"""Deadlines: strict reading, adapter reading, rolling phrases and states in the Seoul calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEOUL = "Asia/Seoul"
#: Rolling phrases without white space.
ROLLING = ("채용시마감", "상시", "상시채용", "상시모집")
_OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?"
_SHAPES = (
    r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9:.]+)?))?$",
    r"^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일(?:\s+(.+))?$",
    r"^([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})(?:\s+(.+))?$",
)
_CLOCK = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?" + _OFFSET + "$"
_KOREAN_CLOCK = r"^([0-9]{1,2})시\s*([0-9]{1,2})분(?:\s*([0-9]{1,2})(?:\.([0-9]+))?초)?()$"


def rolling(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", "").isin(*ROLLING), F.lit(False))


def with_strict_deadline(df: DataFrame, raw: str, name: str = "strict") -> DataFrame:
    """Add ``name``: ``text`` (precision kept), ``day`` and, for instants, ``seconds`` since 1970 UTC and the ``fraction`` digits.

    A clock without offset is Seoul time, a date alone stays a date. Null for other shapes and impossible dates, clocks or offsets. The pieces are columns of their own, so each
    pattern runs once.
    """
    text = F.trim(F.col(raw))
    which = F.when(text.rlike(_SHAPES[0]), 0).when(text.rlike(_SHAPES[1]), 1).when(text.rlike(_SHAPES[2]), 2)
    pieces = [F.regexp_extract(text, p, i) for i in (1, 2, 3, 4) for p in _SHAPES]
    pick = lambda i: F.when(F.col("_w") == 0, pieces[3 * i]).when(F.col("_w") == 1, pieces[3 * i + 1]).when(F.col("_w") == 2, pieces[3 * i + 2])
    out = df.withColumn("_w", which).withColumns({"_y": pick(0), "_mo": F.lpad(pick(1), 2, "0"), "_d": F.lpad(pick(2), 2, "0"), "_t": F.trim(pick(3))})
    korean = F.col("_t").rlike(_KOREAN_CLOCK)
    part = lambda i: F.when(korean, F.regexp_extract("_t", _KOREAN_CLOCK, i)).otherwise(F.regexp_extract("_t", _CLOCK, i))
    out = out.withColumns({"_day": F.try_to_date(F.concat_ws("-", "_y", "_mo", "_d"), "yyyy-MM-dd"), "_h": part(1), "_mi": part(2), "_s": part(3), "_f": part(4), "_o": part(5)})
    off = F.col("_o")
    unit = lambda a: F.coalesce(F.substring(off, a, 2).try_cast("int"), F.lit(0))
    sign = F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1)
    shift = F.when(off == "", 32400).when(off == "Z", 0).when((unit(2) < 24) & (unit(5) < 60) & (unit(8) < 60), sign * (unit(2) * 3600 + unit(5) * 60 + unit(8)))
    h, mi, s = (F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("_h", "_mi", "_s"))
    fits = (F.col("_h") != "") & (h < 24) & (mi < 60) & (s < 60)
    seconds = F.when(fits, F.datediff("_day", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + mi * 60 + s - shift)
    out = out.withColumn("_sec", seconds)
    tail = F.when(off == "Z", "+00:00").when(off == "", "+09:00").otherwise(off)
    shown = F.concat(
        F.col("_day").cast("string"), F.format_string("T%02d:%02d", h, mi), F.when(F.col("_s") != "", F.format_string(":%02d", s)).otherwise(""),
        F.when(F.col("_f") != "", F.concat(F.lit("."), F.col("_f"))).otherwise(""), tail,
    )
    none = F.lit(None)
    value = F.when(F.col("_day").isNotNull() & (F.col("_t") == ""), F.struct(F.col("_day").cast("string").alias("text"), F.col("_day").alias("day"), none.cast("long").alias("seconds"), none.cast("string").alias("fraction"))).when(
        F.col("_day").isNotNull() & F.col("_sec").isNotNull(), F.struct(shown.alias("text"), F.col("_day").alias("day"), F.col("_sec").alias("seconds"), F.rtrim(F.col("_f"), F.lit("0")).alias("fraction"))
    )
    return out.withColumn(name, value).drop("_w", "_y", "_mo", "_d", "_t", "_day", "_h", "_mi", "_s", "_f", "_o", "_sec")


#: What says that a listing has no fixed end, and what parts the sides of a period.
OPEN_END = r"(?i)상시|채용 ?시|9999|2999|until"
_SIDES = r"(?i)[~～–—]|\s-\s|\bto\b"
#: A full date, so that the text splits at it, and the clock that may follow.
_FULL_DATE = r"(?<![0-9])[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}"
_AFTER = r"^\s*\(?\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)"


def adapter_deadline(raw: Column, kst: bool = False) -> Column:
    """The closing side of a listing date, as text: an ISO date, an aware ISO stamp, or the last full date of the last side of a period; a clock only where ``kst`` attests the zone.

    Null for an open end, an abbreviated closing date, a clock of no attested zone, and impossible dates or clocks.
    """
    text = F.trim(raw)
    side = F.element_at(F.split(text, _SIDES), -1)
    stated = F.element_at(F.regexp_extract_all(side, F.lit(_FULL_DATE), F.lit(0)), -1)
    numbers = F.split(F.when(F.regexp_like(side, F.lit(_FULL_DATE)), stated), "[-./]")
    day = F.try_to_date(F.concat_ws("-", numbers[0], F.lpad(numbers[1], 2, "0"), F.lpad(numbers[2], 2, "0")), "yyyy-MM-dd")
    clock = F.regexp_extract(F.element_at(F.split(side, _FULL_DATE), -1), _AFTER, 1)
    moment = F.try_to_timestamp(F.concat(F.lpad(F.rpad(clock, F.length(clock) + F.when(F.length(clock) < 6, 3).otherwise(0), ":00"), 8, "0")), F.lit("HH:mm:ss"))
    listed = F.when(clock == "", day.cast("string")).otherwise(F.concat(day.cast("string"), F.date_format(moment, "'T'HH:mm:ss'+09:00'")) if kst else F.lit(None).cast("string"))
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T\S+)?$")
    stamp = F.when(text.rlike(r"T.*(?:Z|[+-][0-9]{2}:?[0-9]{2})$") & text.try_cast("timestamp").isNotNull(), F.regexp_replace(text, "Z$", "+00:00"))
    exact = F.when(F.length(text) == 10, F.try_to_date(text, "yyyy-MM-dd").cast("string")).otherwise(stamp)
    return F.when((text != "") & ~text.rlike(OPEN_END), F.when(iso, exact).otherwise(listed))


def deadline_state(deadline: Column, raw: Column, now_seconds: int) -> Column:
    """``open``, ``expired``, ``rolling`` or ``unknown`` at a fixed moment; ``deadline`` is the struct of ``with_strict_deadline``.

    A day lasts until the next Seoul midnight, an instant is open at equality, and a valid deadline beats a rolling phrase.
    """
    midnight = (F.datediff(deadline["day"], F.lit("1970-01-01").cast("date")).cast("long") + 1) * 86400 - 32400
    now = F.lit(now_seconds).cast("long")
    return (
        F.when(deadline["seconds"].isNotNull(), F.when(deadline["seconds"] >= now, "open").otherwise("expired"))
        .when(deadline["day"].isNotNull(), F.when(midnight > now, "open").otherwise("expired"))
        .when(rolling(raw), "rolling").otherwise("unknown")
    )
