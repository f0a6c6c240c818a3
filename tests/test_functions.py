import pytest
from pyspark.sql import functions as F

from sillok.functions import dates, text
from sillok.functions.urls import adapter_for, canonical_url, public_shape


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("hTTp://Kontor.Beispiel.EXAMPLE:80#oben", "http://kontor.beispiel.example/"), ("https://a-b.example:443/Weg/?X=1", "https://a-b.example/Weg/?X=1"), ("https://a.example:0444/", "https://a.example:444/"),
        ("https://a.example/p?_GL=1&seite=2&Utm_Irgendwas=3&wbraid=4&seite=1", "https://a.example/p?seite=2&seite=1"), ("https://a.example/p?ut%6D_id=9&%5Fga=1&z", "https://a.example/p?z"), ("https://a.example/p?utm_a=1&", "https://a.example/p"),
        ("https://a.example/p?gclid=1&&gclid=2", "https://a.example/p?"[:-1]), ("https://a.example/p?&a=1&", "https://a.example/p?&a=1&"), ("https://a.example/?", "https://a.example/"), ("http://[2001:DB8::1]:80/x", "http://[2001:db8::1]/x"),
        ("https://[::ffff:192.0.2.1]:9/", "https://[::ffff:192.0.2.1]:9/"), ("http://[1:2:3:4:5:6:7:8]", "http://[1:2:3:4:5:6:7:8]/"),
    ],
)
def test_canonical(spark, raw, want):
    got = one(spark, canonical_url(F.col("u")), u=raw)
    assert got == want
    assert one(spark, canonical_url(F.col("u")), u=got) == got


@pytest.mark.parametrize(
    "raw",
    ["", "//a.example/x", "mailto:a@a.example", "https://a@b.example/", "https://a.example:/x", "https://a-.example/", "https://a.example/\tx", "https://a.example/%5", "https://a.example/%1f", "https:\\\\a.example", "http://?q", "https://a.example:65536/", "http://[1::2::3]/", "http://[12345::]/", "http://[::1/", "http://a[::1]/", "http://[1:2:3:4:5:6:7:8:9]/"],
)
def test_no_address(spark, raw):
    assert one(spark, canonical_url(F.col("u")), u=raw) is None


def test_hosts(spark):
    assert one(spark, adapter_for(F.col("u")), u="https://recruit.cj.net/x") == "cj"
    assert one(spark, adapter_for(F.col("u")), u="https://recruit.cj.net.evil.example/x") == "generic"
    assert one(spark, public_shape(F.col("u")), u="https://e.com:80/a") and not one(spark, public_shape(F.col("u")), u="https://a@e.com/")


def test_lengths(spark):
    n = lambda t, *a: one(spark, text.count_text(F.col("t"), *a), t=t)
    assert [n("가😀A", m) for m in ("codepoints", "utf16", "utf8-bytes")] == [3, 4, 8]
    assert n("가A", "cp949-bytes") == 3 and n("한글😀", "cp949-bytes") is None
    assert [n("가\r\n나\r다\n", "codepoints", True, r) for r in ("lf", "crlf", "preserve", "none")] == [6, 9, 7, 3]
    assert n("a  　\x1cb​", "codepoints", False) == 3


def test_terms(spark):
    hay = "javascript python 서비스기획"
    assert [one(spark, text.contains_term(F.col("t"), w), t=hay) for w in ("Java", "PYTHON", "기획", " ")] == [False, True, True, False]
    assert one(spark, text.fold(F.col("t")), t="Straße ＡB") == "strasse ａb"


def test_answers(spark):
    got = one(spark, text.check_answer(F.col("t"), 10), t="TODO 가나다라마바사아자차")
    assert not got["ok"] and got["errors"] == ["over_limit"] and got["warnings"] == ["draft_marker"]
    assert one(spark, text.check_answer(F.col("t"), 10), t=" \n")["errors"] == ["blank"]
    with pytest.raises(ValueError, match="limit"):
        text.check_answer(F.col("t"), True)
    assert one(spark, text.fence(F.col("t")), t="a```b").startswith("````\n")
    assert one(spark, text.first_line(F.col("t")), t="\n 　\n  x y \nz") == "x y"
    assert one(spark, text.html_escape(F.col("t")), t="<a&'\">") == "&lt;a&amp;&#x27;&quot;&gt;"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2027년1월 5일", "2027-01-05"), ("2027.12.1", "2027-12-01"), ("2027-01-05 07:08:09.500", "2027-01-05T07:08:09.500+09:00"), ("2027년 1월 5일 7시 8분 9초", "2027-01-05T07:08:09+09:00"),
        ("1월 5일", None), ("D-day", None), ("2027-02-30", None), ("2027-01-05T24:01", None), ("２０２７-01-05", None), ("2027-01-05T07:08-03:30", "2027-01-05T07:08-03:30"), (None, None), ("", None),
    ],
)
def test_strict_deadline(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = dates.with_strict_deadline(df, "raw").first()["strict"]
    assert (got and got["text"]) == want


def test_deadline_state(spark):
    rows = [("2026-09-30", ""), ("채용 시 마감", "채용 시 마감"), ("상시근무", "상시근무"), ("2026-10-01T00:00:00+09:00", "")]
    df = dates.with_strict_deadline(spark.createDataFrame(rows, "d string, raw string"), "d")
    states = lambda now: [r[0] for r in df.select(dates.deadline_state(F.col("strict"), F.col("raw"), now)).collect()]
    midnight = 1_790_780_400  # 2026-09-30 15:00 UTC
    assert states(midnight - 1) == ["open", "rolling", "unknown", "open"]
    assert states(midnight) == ["expired", "rolling", "unknown", "open"]
    assert states(midnight + 1)[3] == "expired"


def test_adapter_deadline(spark):
    read = lambda t, kst=False: one(spark, dates.adapter_deadline(F.col("t"), kst), t=t)
    assert read("접수 2027/1/5 - 2027/2/9 까지") == "2027-02-09" and read("2027-01-05 to 02-09") is None and read("오픈 2027.01.05") == "2027-01-05"
    assert read("2027.1.5 ~ 2027.2.9 8:05", True) == "2027-02-09T08:05:00+09:00" and read("2027.2.9 ( 23:59:58 )", True) == "2027-02-09T23:59:58+09:00" and read("2027.2.9 8:05") is None
    assert read("2027.2.9 24:10", True) is None and read("2027.2.30") is None and read("인재풀 상시 2027.2.9") is None and read("9999-12-31") is None and read("채용 시까지") is None
    assert read("2027-02-09T08:00:00") is None and read("2027-02-09T08:00:00Z") == "2027-02-09T08:00:00+00:00" and read("2027-02-09") == "2027-02-09" and read("2027-02-29") is None
    assert read("") is None and read(None) is None and read("미정") is None
