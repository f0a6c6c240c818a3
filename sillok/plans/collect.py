"""One collection over fetched snapshots: decode, classify, parse, cap pages, filter, limit, and the state of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillok.functions.network import decoded
from sillok.functions.text import all_words
from sillok.operators import acquire, catalog
from sillok.session import scratch_path
from sillok.sources.html import parse_pages

SEARCHED = ("title", "company", "description", "location", "experience", "employment_type")


def snapshot_pages(snapshots: DataFrame) -> DataFrame:
    """Snapshots ``source_id, url, page_no, http_status, content_type, content`` with ``html`` and ``state``."""
    rows = snapshots.withColumn("html", decoded(F.col("content"), F.col("content_type")))
    return rows.withColumn("state", acquire.http_state(F.col("http_status"), F.col("html")))


def collect(snapshots: DataFrame, query: str = "", limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(postings, acquisitions)`` of saved pages: at most ``limit`` postings a source that hold every word of the query, and one state a source.

    Pages are parsed once, into the shared folder. A source whose pages brought nothing has the state of its first page; one that was cut, interrupted or holds listing cards is
    partial. Equal links of a source are one posting, the first of its pages.
    """
    spark = snapshots.sparkSession
    path = scratch_path(spark, "pages")
    snapshot_pages(snapshots).write.parquet(path)
    pages = spark.read.parquet(path)
    good = pages.filter("state = 'ok' AND page_no BETWEEN 1 AND 3")
    placed = parse_pages(good.withColumn("_at", F.to_json(F.struct("source_id", "page_no"))), "url", "html", "_at")
    placed = placed.withColumns({"page_no": F.get_json_object("source_id", "$.page_no").cast("int"), "source_id": F.get_json_object("source_id", "$.source_id")})
    path = scratch_path(spark, "parsed")
    placed.write.parquet(path)
    parsed = spark.read.parquet(path)
    first = parsed.groupBy("source_id", "url").agg(F.min_by(F.struct(*[c for c in parsed.columns if c not in ("source_id", "url")]), "page_no").alias("_r")).select("source_id", "url", "_r.*")
    kept = catalog.per_source_limit(first.filter(all_words(query, *SEARCHED)), "source_id", "url", limit)

    found = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("job_count"), F.count_if(F.col("completeness") == "full_text").alias("full"), F.max("truncated").alias("cut"))
    seen = first.groupBy("source_id").agg(F.count(F.lit(1)).alias("parsed"))
    by_page = pages.groupBy("source_id").agg(
        F.min_by("state", "page_no").alias("first_state"), F.max(F.col("state") != "ok").alias("interrupted"),
        F.min_by(acquire.page_state(F.col("html"), F.col("content_type"), F.lit("generic")), "page_no").alias("page_state"),
    )
    rows = by_page.join(found, "source_id", "left").join(seen, "source_id", "left").na.fill(0, ["job_count", "full", "parsed"])
    state = acquire.batch_state(F.col("job_count"), F.col("full"), F.coalesce("cut", F.lit(False)), F.col("interrupted"), F.lit(None).cast("long"))
    missed = F.when(F.col("interrupted"), "partial").otherwise("empty")
    final = F.when(F.col("job_count") > 0, state).when(F.col("parsed") > 0, missed).when(F.col("first_state") != "ok", F.col("first_state")).otherwise(F.col("page_state"))
    return kept, rows.select("source_id", final.alias("status"), "job_count")


def address_checks(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each source with the state of its careers address; an address is judged once for all sources that share it, one without snapshot is ``unchecked``."""
    judged = snapshot_pages(snapshots).groupBy("url").agg(F.min_by(F.struct("state", "http_status"), "page_no").alias("_s"))
    met = sources.select("id", F.col("careers_url").alias("url")).join(judged.select("url", "_s.*"), "url", "left")
    return met.select("id", "url", F.coalesce("state", F.lit("unchecked")).alias("status"), "http_status")
