"""Mixing sources to target weights by exact token sizes: whole repeats first, the remaining budget fitted by subset sum.

Documents are counted by source and exact token length, so the choice is made on a short histogram. The rest of a source's budget is thinned evenly over
all lengths, and a bounded knapsack closes the remainder. Which documents of a length are taken follows a seeded order of their keys, found
through counted hash buckets, so no group of documents is ever sorted as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillok.session import bounded_broadcast

#: Largest remainder the dynamic programme closes; a larger one is first lowered by whole documents, longest first.
WINDOW = 65_536
BUCKETS = 1_024
#: Most targets that are broadcast; beyond it that join shuffles.
TARGETS = 100_000


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length add up to ``budget`` or the most below it; lengths are positive and distinct."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64) if total else counts * 0
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths):
        if left <= WINDOW:
            break
        more = min(int(counts[i] - taken[i]), (left - WINDOW // 2) // int(lengths[i]))
        taken[i] += max(0, more)
        left -= max(0, more) * int(lengths[i])
    # bounded knapsack over sums up to the remainder, counts split into powers of two
    items: list[tuple[int, int]] = []
    for i, (length, spare) in enumerate(zip(lengths, counts - taken, strict=True)):
        spare, size = min(int(spare), left // int(length) if length <= left else 0), 1
        while spare > 0:
            size = min(size, spare)
            items.append((i, size))
            spare -= size
            size *= 2
    first = np.full(left + 1, -2, np.int32)
    first[0] = -1
    for k, (i, size) in enumerate(items):
        step = int(lengths[i]) * size
        if step > left:
            continue
        fresh = (first[step:] == -2) & (first[: left + 1 - step] != -2)
        first[step:][fresh] = k
        if first[left] != -2:
            break
    at = int(np.flatnonzero(first != -2)[-1])
    while at > 0:
        i, size = items[first[at]]
        taken[i] += size
        at -= int(lengths[i]) * size
    return taken


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``source, tokens, documents, taken, repeats``: per source and exact size, how many documents are used once more than ``repeats`` times.

    ``sizes``: ``source, tokens``; ``targets``: ``source, target_share, max_repeat``. ``total`` is the size that the shares refer to. By default it is the largest at which every target that has documents
    is met: the least ``max_repeat`` times the source's tokens by its share. With a larger one, sources that their repeats cannot lift to their share stay below it. Sources without target and documents without tokens take no part.
    """
    counted = sizes.filter("source IS NOT NULL AND tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("documents"))
    listed = counted.join(bounded_broadcast(targets, TARGETS), "source")
    if total is None:
        have = listed.groupBy("source", "target_share", "max_repeat").agg(F.sum(F.col("tokens") * F.col("documents")).alias("have"))
        reach = F.floor(F.col("max_repeat") * F.col("have") / F.col("target_share") + 1e-6)
        total = have.filter("max_repeat > 0 AND target_share > 0").agg(F.min(reach)).first()[0] or 0
    listed = listed.withColumn("all_tokens", F.lit(total).cast("long"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens").reset_index(drop=True)
        lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["documents"].to_numpy(np.int64)
        have, need, most = int((lengths * counts).sum()), round(float(pdf["target_share"][0]) * int(pdf["all_tokens"][0])), int(pdf["max_repeat"][0])
        full = min(most, need // have)
        taken = fit_budget(lengths, counts, need - full * have) if full < most else counts * 0
        return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "documents": counts, "taken": taken, "repeats": full})

    return listed.groupBy("source").applyInPandas(choose, "source string, tokens long, documents long, taken long, repeats int")


def mix(documents: DataFrame, planned: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """``key, source, tokens, copies`` of the documents a plan uses. Ties of the seeded order are broken by the key; repeated keys are separate documents of one order."""
    docs = documents.filter("source IS NOT NULL AND tokens > 0").select(key, "source", "tokens", F.xxhash64(F.lit(seed), F.col(key)).alias("_order"))
    docs = docs.withColumn("_bucket", F.pmod("_order", F.lit(BUCKETS))).join(planned, ["source", "tokens"])
    counted = docs.groupBy("source", "tokens", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.groupBy("source", "tokens").agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))).alias("_all"))  # at most BUCKETS entries
    before = before.select("source", "tokens", F.explode("_all").alias("_x"), "_all").select(
        "source", "tokens", F.col("_x._bucket").alias("_bucket"), F.col("_x._n").alias("_n"),
        F.aggregate(F.filter("_all", lambda y: y["_bucket"] < F.col("_x._bucket")), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("_before"),
    )
    docs = docs.join(before, ["source", "tokens", "_bucket"])
    sure = docs.filter(F.col("_before") + F.col("_n") <= F.col("taken")).withColumn("_extra", F.lit(1))
    never = docs.filter(F.col("_before") >= F.col("taken")).withColumn("_extra", F.lit(0))
    edge = docs.filter((F.col("_before") < F.col("taken")) & (F.col("_before") + F.col("_n") > F.col("taken")))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "_bucket").orderBy("_order", key))
    edge = edge.withColumn("_extra", (F.col("_before") + rank <= F.col("taken")).cast("int"))
    used = sure.unionByName(never).unionByName(edge).withColumn("copies", F.col("repeats") + F.col("_extra"))
    return used.filter("copies > 0").select(key, "source", "tokens", "copies")


def shares(planned: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target or source: what was asked, available, used and reached. A source without documents reaches 0, one without target is not used."""
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"))
    used = planned.groupBy("source").agg(F.sum(F.col("tokens") * (F.col("repeats") * F.col("documents") + F.col("taken"))).alias("mixed_tokens"), F.max(F.col("repeats") + (F.col("taken") > 0).cast("int")).alias("most_copies"))
    rows = targets.join(have, "source", "full").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = rows.select("source", "target_share", "max_repeat", zero("documents"), zero("available_tokens"), zero("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    whole = rows.agg(F.sum("mixed_tokens").alias("_all"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("mixed_tokens") / F.col("_all"))).drop("_all")  # one row
