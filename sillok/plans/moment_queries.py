"""Queries of the moment operator over the postings and the captured list pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillok.operators.moments import estimate_zone_history, normal_moments, zone_at
from sillok.session import scratch_path, stored, table

#: The zone of values without one, as the data's statement fixes it.
STATED_ZONE = "Asia/Seoul"
#: Zones the estimate chooses from, the stated one first.
CANDIDATE_ZONES = (STATED_ZONE, "UTC", "America/New_York", "America/Los_Angeles", "Europe/London", "Europe/Berlin", "Asia/Ho_Chi_Minh", "Australia/Sydney")


#: A closing time lies after the moment its posting was taken in and not more than this many days ahead.
MOST_DAYS = 400
#: Share of a source's readings that must speak for another zone than the stated one: postings taken in late violate every zone, and some of them one zone more than another.
CHANGE_SHARE = 0.1


def _closing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, rec_key, raw, hh, mi, zone, site, seen`` of all records that may state a closing time; ``seen``: when the record was taken in, as written."""
    job = table(spark, sf_dir, "job").select(F.lit("job").alias("src"), F.col("ordinal").cast("string").alias("rec_key"), F.col("deadline_raw").alias("raw"), F.coalesce("source_id", F.lit("")).alias("site"), F.col("collected_at").alias("seen"))
    naver = table(spark, sf_dir, "collect_naver_page").select(F.lit("collect_naver_page").alias("src"), F.col("row_no").cast("string").alias("rec_key"), F.col("endYmdTime").alias("raw"))
    cj = table(spark, sf_dir, "collect_cj_page").select(
        F.lit("collect_cj_page").alias("src"), F.col("row_no").cast("string").alias("rec_key"),
        F.when(F.coalesce(F.trim("zz_till_hire"), F.lit("")) != "Y", F.col("zz_end_dt_str")).alias("raw"), F.col("zz_end_hh").alias("hh"), F.col("zz_end_mi").alias("mi"),
        F.coalesce(F.nullif(F.trim("timezone"), F.lit("")), F.nullif(F.trim("utcoffset"), F.lit(""))).alias("zone"),
    )
    return job.unionByName(naver, allowMissingColumns=True).unionByName(cj, allowMissingColumns=True).filter(F.col("raw").rlike("[0-9０-９]"))


def _read(rows: DataFrame, zone: Column) -> DataFrame:
    return rows.withColumn("norm", normal_moments(F.col("raw"), F.col("hh"), F.col("mi"), F.col("zone"), zone)).filter(F.col("norm").isNotNull())


def _histories(rows: DataFrame) -> DataFrame:
    """The estimated zone history of each site, from closing times without zone against the moments their records were taken in; a site is of the stated zone unless its readings violate that."""
    read = _read(rows.filter("site IS NOT NULL AND seen IS NOT NULL"), F.lit(None).cast("string"))
    seen = F.try_to_timestamp("seen")
    local = read.filter(F.col("norm").rlike(r"T[0-9:.]+$")).select("site", F.col("norm").try_cast("timestamp_ntz").alias("wall"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), seen.cast("timestamp_ntz")).alias("ingested"))
    return estimate_zone_history(local, "site", "wall", "ingested", CANDIDATE_ZONES, earliest_hours=0, latest_hours=24 * MOST_DAYS, change_share=CHANGE_SHARE)


def p1_zone_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, from_day, zone, violations, readings``: in which zone each source of postings writes its closing times."""
    return _histories(_closing_texts(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that states a closing moment (UTC) or only a day. A clock without zone is read in its source's estimated zone; records without source or moment of intake in the stated one."""
    rows = _closing_texts(spark, sf_dir)
    histories = stored(_histories(rows), scratch_path(spark, "zones"))
    dated = zone_at(histories, "site")(rows.withColumn("_day", F.to_date(F.try_to_timestamp("seen"))), "_day")
    return _read(dated, F.coalesce("_zone", F.lit(STATED_ZONE))).select("src", "rec_key", "norm")


QUERIES = {"p1_found": p1_found, "p1_zone_histories": p1_zone_histories}
