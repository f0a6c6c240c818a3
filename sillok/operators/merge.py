"""Observation merge: one record per canonical address, with all sources and observations kept.

The fold over observations has a closed form. The record first seen is shown, unless it is a listing card: then the first later record with a
description that is no card takes its place, once. Length and recency carry no weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillok.functions.urls import canonical_url, posting_id
from sillok.session import scratch_path, stored

#: Fixed value: the note a record gets when a detail replaced a card.
RETAINED = "Detailed text retained from an earlier or richer observation."


def observed(postings: DataFrame) -> DataFrame:
    """The postings under their canonical address and recomputed id; rows without a valid address are left out."""
    named = postings.withColumn("url", canonical_url(F.col("url"))).filter("url IS NOT NULL")
    return named.withColumn("id", posting_id(F.col("url")))


#: Columns that gather over observations and are no part of one.
GATHERED = ("id", "ordinal", "run", "observation", "warnings", "source_ids", "provenance", "observations", "sources", "first_ordinal", "switched")


def _arrival(columns: list[str], ordinal: str) -> Column:
    """The order of observations: the latest run first where runs are known, by ordinal within."""
    return F.struct(-F.col("run"), F.col(ordinal)) if "run" in columns else F.struct(F.lit(0), F.col(ordinal))


def observations(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The distinct observations of each address as rows, in their latest run under their first ordinal, with ``observation``, the hash of all that they say.

    Two rows are one observation if every column but the gathered ones is equal, nulls included. Rows combine before the shuffle, and no array grows with a hot address. An empty table gives no rows.
    """
    rows = observed(postings)
    said = sorted(c for c in rows.columns if c not in GATHERED and c != ordinal)
    keyed = rows.withColumn("observation", F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256))
    first = F.min_by(F.struct(*rows.columns), _arrival(rows.columns, ordinal))
    return keyed.groupBy("observation").agg(first.alias("_r")).select("_r.*", "observation")


def winners(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The shown record of each address with ``first_ordinal``, ``observations`` (rows given: pass distinct ones for their number), ``sources`` and ``switched``.

    Only aggregates that combine before the shuffle, so a hot address costs one row a task. Ties cannot arise, as ordinals are unique; nulls in
    ``evidence`` or ``description`` count as no card and no description. An empty table gives no rows.
    """
    rows = observed(postings)
    columns = rows.columns
    card = F.coalesce(F.col("evidence.completeness") == "listing_card", F.lit(False))
    rich = ~card & (F.coalesce(F.length("description"), F.lit(0)) > 0)
    record, order = F.struct(*[F.col(c) for c in columns]), _arrival(columns, ordinal)
    grouped = rows.groupBy(F.col("url").alias("_url")).agg(
        F.min_by(record, order).alias("_first"), F.min_by(card, order).alias("_card"), F.min_by(F.when(rich, record), F.when(rich, order)).alias("_rich"),
        F.count(F.lit(1)).alias("observations"), F.count_distinct("source_id").alias("sources"), F.min(ordinal).alias("first_ordinal"),
    )
    switched = F.col("_card") & F.col("_rich").isNotNull()
    shown = grouped.withColumn("switched", switched).withColumn("_shown", F.when(switched, F.col("_rich")).otherwise(F.col("_first")))
    return shown.select("_shown.*", "first_ordinal", "observations", "sources", "switched")


def provenance(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Distinct ``url, source_id, evidence, collected_at`` in order of first appearance, as rows: no array grows with a hot address."""
    rows = observed(postings)
    keys = ["url", "source_id", "evidence", "collected_at"]
    return rows.groupBy(*keys).agg(F.min(ordinal).alias("first_ordinal"))


def merge_arrays(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``winners`` with ordered ``source_ids`` and ``warnings`` arrays, for addresses whose distinct values are few; the values are made distinct before they are gathered."""
    rows = observed(postings)
    first = winners(postings, ordinal)
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("_o", name))), lambda x: x[name])
    order = _arrival(rows.columns, ordinal)
    sources = rows.groupBy("url", "source_id").agg(F.min(order).alias("_o")).groupBy("url").agg(ordered("source_id").alias("source_ids"))
    notes = rows.select("url", order.alias("_ord"), F.posexplode("warnings").alias("_p", "warning"))
    notes = notes.groupBy("url", "warning").agg(F.min(F.struct("_ord", "_p")).alias("_o")).groupBy("url").agg(ordered("warning").alias("_notes"))
    joined = first.join(sources, "url", "left").join(notes, "url", "left")
    mine = F.coalesce("warnings", F.array().cast("array<string>"))
    note = F.when(F.col("switched"), F.array(F.lit(RETAINED))).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("warnings", F.array_distinct(F.concat(mine, note, F.coalesce("_notes", F.array().cast("array<string>"))))).drop("_notes")
    return joined.withColumn("source_ids", F.array_distinct(F.concat(F.array("source_id"), "source_ids")))


def upsert(fresh: DataFrame, held: DataFrame | None, ordinal: str = "ordinal") -> DataFrame | None:
    """The stored observations with the fresh ones in a run of their own, later than all others; null where nothing would change.

    Stored ordinals stay as they are. An observation that comes again belongs to the later run and stays one row; a batch whose observations are all of the newest run already changes nothing, so a save may be repeated.
    """
    if held is None:
        return observations(fresh.withColumn("run", F.lit(0).cast("long")), ordinal)
    newest = held.agg(F.max("run")).first()[0]
    newest = -1 if newest is None else newest
    new = observations(fresh.withColumn("run", F.lit(newest + 1).cast("long")), ordinal)
    if new.join(held.filter(F.col("run") == newest).select("observation"), "observation", "left_anti").isEmpty():
        return None
    both = held.unionByName(new, allowMissingColumns=True)
    latest = F.min_by(F.struct(*both.columns), _arrival(both.columns, ordinal))
    return both.groupBy(F.col("observation").alias("_k")).agg(latest.alias("_r")).select("_r.*")


def first_seen(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``url, ordinal``: where each canonical address appears first."""
    return observed(postings).groupBy("url").agg(F.min(ordinal).alias(ordinal))


def stale_ids(postings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``ordinal, state`` of the rows whose stored id is ``missing`` or ``differs`` from the hash of their address."""
    rows = postings.withColumn("_id", posting_id(canonical_url(F.col("url"))))
    state = F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing").when(F.col("id") != F.col("_id"), "differs")
    return rows.select(ordinal, state.alias("state")).filter("state IS NOT NULL")


def numbered(rows: DataFrame, *order: object, name: str = "rank") -> DataFrame:
    """Ranks 1..n without a single-partition window: range partitions are numbered apart and shifted by the counts before them.

    The bounds of the ranges come from a sample that differs from run to run, so the partitions are written once, and counts and ranks read the same ones.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed.withColumn("_seq", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), scratch_path(spark, "ranks"))
    counts = sorted(placed.groupBy("_part").count().collect())  # one number a partition
    before, shift = 0, {}
    for part, n in counts:
        shift[part] = before
        before += n
    starts = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair]) if shift else None
    return placed.withColumn(name, F.col("_seq") + (F.try_element_at(starts, F.col("_part")) if shift else F.lit(0))).drop("_part", "_seq")
