"""The source catalogue: union, validation, selection, search plan, shared portals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillok.functions.text import fold, quoted
from sillok.functions.urls import adapter_for, host, public_shape

#: Closed domains of the catalogue.
ACCESS_MODES = ("html", "public_api", "browser", "manual")
VERIFICATION = ("verified", "partial", "blocked", "unverified")


def all_sources(companies: DataFrame, portals: DataFrame) -> DataFrame:
    """Companies, then portals, in one table with ``kind``, ``adapter`` and ``ordinal``."""
    first = companies.withColumns({"kind": F.lit("company"), "adapter": adapter_for(F.col("careers_url"))})
    both = first.unionByName(portals.withColumn("aliases", F.array().cast("array<string>")), allowMissingColumns=True)
    return both.withColumn("is_group_portal", F.coalesce("is_group_portal", F.lit(False)))


def violations(companies: DataFrame) -> DataFrame:
    """``id, code`` of every rule a catalogue row breaks; duplicates are counted by key, not compared in pairs."""
    rows = companies.withColumn("_name", fold(F.col("name_ko")))
    for key in ("id", "_name", "selection_index"):
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{key}"))
        rows = rows.join(counts, key, "left")  # a null key is no duplicate
    v = F.col("verification")
    aware = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})$"
    missing = lambda ok: ~F.coalesce(ok, F.lit(False))
    checks = {
        "bad_id": missing(F.col("id").rlike(r"^kr-\d{3}$")), "duplicate_id": F.col("_n_id") > 1, "duplicate_name": F.col("_n__name") > 1, "duplicate_index": F.col("_n_selection_index") > 1,
        "no_name": missing(F.length(F.trim("name_ko")) > 0), "no_english_name": missing(F.length(F.trim("name_en")) > 0), "bad_homepage": ~public_shape(F.col("homepage")), "bad_careers_url": ~public_shape(F.col("careers_url")),
        "bad_evidence_url": ~public_shape(F.col("evidence_url")), "bad_access_mode": missing(F.col("access_mode").isin(*ACCESS_MODES)), "bad_status": missing(v["status"].isin(*VERIFICATION)),
        "naive_checked_at": missing(v["checked_at"].rlike(aware)), "no_method": missing(F.length(v["method"]) > 0), "no_notes": v["notes"].isNull(), "no_flag": F.col("is_group_portal").isNull(),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks.items()]))).alias("code"))


#: Most selectors that are broadcast.
SELECTORS = 10_000


def resolve(sources: DataFrame, selectors: DataFrame) -> DataFrame:
    """``selector, id, exact``: rows whose id, name or alias equals a selector, else those that contain it. ``selectors`` (``selector``) is a list of at most ``SELECTORS``, more are refused; each is matched against all rows."""
    if selectors.limit(SELECTORS + 1).count() > SELECTORS:
        raise ValueError(f"more than {SELECTORS} selectors")
    names = F.transform(F.array_compact(F.concat(F.array("id", "name_ko", "name_en"), F.coalesce("aliases", F.array().cast("array<string>")))), F.lower)
    met = sources.select("id", names.alias("_names")).join(F.broadcast(selectors), F.exists("_names", lambda n: F.contains(n, F.lower("selector"))))
    met = met.select("selector", "id", F.array_contains("_names", F.lower("selector")).alias("exact"))
    best = met.groupBy("selector").agg(F.max("exact").alias("_best"))
    return met.join(best, "selector").filter(F.col("exact") == F.col("_best")).drop("_best")


def discovery_plan(sources: DataFrame, query: str) -> DataFrame:
    """One search task a source, companies before portals in catalogue order of ids."""
    site = host(F.coalesce("careers_url", F.lit("")))
    words = F.concat(F.lit("site:"), site, F.lit(' "'), F.col("name_ko"), F.lit('" '), F.lit(query), F.lit(" 채용"))
    return sources.select(
        F.concat(F.lit("discover-"), F.col("id")).alias("task_id"), F.col("id").alias("source_id"), F.col("name_ko").alias("company"), F.when(F.col("kind") == "company", 0).otherwise(1).alias("priority"),
        words.alias("query"), F.concat(F.lit("https://www.google.com/search?q="), quoted(words)).alias("search_url"), "is_group_portal",
    )


def shared_portals(sources: DataFrame) -> DataFrame:
    """``id, shared_with``: the first source of each (careers address, adapter) fetches, the others name it."""
    key = ["careers_url", "adapter"]
    first = sources.groupBy(*key).agg(F.min("id").alias("_base"))
    return sources.join(first, key).select("id", F.when(F.col("_base") != F.col("id"), F.col("_base")).alias("shared_with"))


def manifest_differences(rows: DataFrame, manifest: DataFrame, *fields: str) -> DataFrame:
    """``id, difference`` between a batch and its manifest: missing, unexpected or a field that differs."""
    a, b = rows.alias("a"), manifest.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    changed: Column = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f"{f} differs") for f in fields]))
    codes = F.when(F.col("a.id").isNull(), F.array(F.lit("missing"))).when(F.col("b.id").isNull(), F.array(F.lit("unexpected"))).otherwise(changed)
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), F.explode(codes).alias("difference"))


def per_source_limit(rows: DataFrame, source: str, ordinal: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each source with ``truncated``; ranks beyond the limit are pruned in each partition before the shuffle."""
    if type(limit) is not int or not 1 <= limit <= 100:
        raise ValueError("limit must be an int from 1 to 100")
    rank = F.row_number().over(Window.partitionBy(source).orderBy(ordinal))
    kept = rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    return kept.join(counts, source).withColumn("truncated", F.col("_n") > limit).drop("_n")
