"""List-API rows, saved files and pasted texts as postings, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillok.functions.dates import adapter_deadline
from sillok.functions.text import collapse_ws, first_line

UNKNOWN = "Unknown employer"
#: Fixed value: the deadline text of a row that stays open until someone is hired.
UNTIL_HIRED = "채용시까지"


def _card(company: Column, deadline: Column) -> dict[str, Column]:
    return {"company": F.when(company == "", UNKNOWN).otherwise(company), "deadline": deadline, "completeness": F.lit("listing_card"), "evidence_kind": F.lit("live_json")}


def naver_rows(rows: DataFrame, origin: str = "https://recruit.navercorp.com") -> DataFrame:
    """Postings of list rows; rows without a numeric record number or a title are left out. Missing employers are named as unknown, never guessed."""
    ident, title = F.col("annoId").cast("string"), collapse_ws(F.col("annoSubject"))
    raw = collapse_ws(F.col("endYmdTime"))
    fields = {"url": F.concat(F.lit(origin + "/rcrt/view.do?annoId="), ident), "title": title, "deadline_raw": raw, "employment_type": collapse_ws(F.col("empTypeCdNm")), "experience": collapse_ws(F.col("entTypeCdNm"))}
    out = rows.filter(ident.rlike(r"^[0-9]+$") & (title != "")).withColumns(fields | _card(collapse_ws(F.col("sysCompanyCdNm")), adapter_deadline(raw, kst=True)))
    return out.select("row_no", *fields, "company", "deadline", "completeness", "evidence_kind")


def cj_rows(rows: DataFrame, origin: str = "https://recruit.cj.net") -> DataFrame:
    """Postings of list rows; ``gubun`` 1 and 2 choose the detail route, others are left out; an open-ended row says so in its deadline text."""
    ident, title = collapse_ws(F.col("zz_jo_num")), collapse_ws(F.col("zz_title"))
    route = F.when(F.col("gubun") == "1", F.concat(F.lit("/recruit/ko/recruit/recruit/detail.fo?zz_jo_num="), ident)).when(
        F.col("gubun") == "2", F.concat(F.lit("/recruit/ko/recruit/recruit/bestDetail.fo?zz_jo_num="), ident, F.lit("&direct=N"))
    )
    hour, minute = (F.trim(F.coalesce(c, F.lit(""))) for c in ("zz_end_hh", "zz_end_mi"))
    clock = F.when(hour.rlike(r"^[0-9]{1,2}$") & minute.rlike(r"^[0-9]{2}$"), F.concat(F.lit(" "), hour, F.lit(":"), minute)).otherwise("")
    raw = F.when(F.col("zz_till_hire") == "Y", UNTIL_HIRED).otherwise(F.concat(collapse_ws(F.col("zz_end_dt_str")), clock))
    fields = {"url": F.concat(F.lit(origin), route), "title": title, "deadline_raw": raw, "location": collapse_ws(F.col("location_cd_nm"))}
    good = ident.rlike(r"^(?:[0-9]+|J[0-9]+)$") & (title != "") & route.isNotNull()
    out = rows.filter(good).withColumns(fields | _card(collapse_ws(F.col("compnm")), adapter_deadline(raw, kst=True)))
    return out.select("row_no", *fields, "company", "deadline", "completeness", "evidence_kind")


def consistent_total(rows: DataFrame, total: str, *by: str) -> DataFrame:
    """The declared total of each group where all rows agree, else null with ``inconsistent``; minimum and maximum combine before the shuffle."""
    grouped = rows.groupBy(*by).agg(F.min(total).alias("_a"), F.max(total).alias("_b"), F.count(F.lit(1)).alias("rows"))
    return grouped.select(*by, "rows", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("total"), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("inconsistent"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of JSON files, as a list or under ``jobs``, one variant per job with its position; a file that is not JSON gives one row with ``parse_error``.

    A byte order mark is tolerated. Explicit nulls stay apart from absent keys in the variant.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("raw"), F.input_file_name().alias("file"))
    value = text.withColumn("v", F.try_parse_json("raw"))
    listed = F.coalesce(F.try_variant_get("v", "$.jobs", "variant"), F.col("v"))
    good = value.filter("v IS NOT NULL").withColumn("items", F.try_variant_get(listed, "$", "array<variant>"))
    rows = good.select("file", F.posexplode_outer("items").alias("ordinal", "job"), F.lit(None).cast("string").alias("parse_error"))
    bad = value.filter("v IS NULL").select("file", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("variant").alias("job"), F.lit("not JSON").alias("parse_error"))
    return rows.unionByName(bad)


def key_state(job: Column, key: str) -> Column:
    """``absent``, ``null`` or ``value`` of a key of a JSON variant."""
    got = F.variant_get(job, f"$.{key}", "variant")
    return F.when(got.isNull(), "absent").when(F.is_variant_null(got), "null").otherwise("value")


def pasted(df: DataFrame, text: str, url: str, company: str | None = None) -> DataFrame:
    """Postings of pasted texts: the first line that is not blank is the title; blank texts and texts over two million characters are left out."""
    body = F.trim(F.col(text))
    kept = df.filter((F.length(body) > 0) & (F.length(text) <= 2_000_000))
    return kept.withColumns({"title": first_line(F.col(text)), "company": F.lit(company or UNKNOWN), "description": F.col(text), "url": F.col(url), "evidence_kind": F.lit("manual_paste"), "completeness": F.lit("full_text")})
