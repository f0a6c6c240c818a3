"""Lexical scoring of postings against weighted terms, explained by matched terms and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillok.functions.dates import deadline_state, with_strict_deadline
from sillok.functions.text import contains_term, fold, folded
from sillok.operators.merge import numbered

#: Weights by kind of criterion.
WEIGHTS = {"target_roles": 6, "keywords": 3, "preferred_locations": 2}
EXPERIENCE_WEIGHT = 2
FIELDS = ("title", "company", "description", "location", "employment_type", "experience")


def scored(postings: DataFrame, profile: dict, key: str, *keep: Column) -> DataFrame:
    """``key, score, matched, gaps, excluded`` and the columns ``keep``; places are looked for in ``location``, the experience level in ``experience``, the other terms in all six fields.

    Equal folded terms of a kind count once; ``excluded`` lists the profile's excluded terms that a posting holds. No shuffle.
    """
    hay = fold(F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]))
    rows = postings.select(key, *keep, hay.alias("_hay"), fold(F.coalesce("location", F.lit(""))).alias("_place"), fold(F.coalesce("experience", F.lit(""))).alias("_level"))
    score: Column = F.lit(0)
    matched, gaps = [], []
    level = profile.get("experience_level") or ""
    wanted = [(kind, weight, profile.get(kind, [])) for kind, weight in WEIGHTS.items()] + [("experience_level", EXPERIENCE_WEIGHT, [level])]
    where = {"preferred_locations": "_place", "experience_level": "_level"}
    for kind, weight, terms in wanted:
        distinct: dict[str, str] = {}
        for term in terms:
            distinct.setdefault(folded(term), term)
        for term in (t for f, t in distinct.items() if f):
            hit = contains_term(F.col(where.get(kind, "_hay")), term)
            score = score + F.when(hit, weight).otherwise(0)
            matched.append(F.when(hit, F.lit(term)))
            gaps.append(F.when(~hit, F.lit(term)))
    pack = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    excluded = [F.when(contains_term(F.col("_hay"), t), F.lit(t)) for t in profile.get("excluded_keywords", []) if t.strip()]
    kept = rows.columns[1 : 1 + len(keep)]
    return rows.select(key, *kept, score.alias("score"), pack(matched).alias("matched"), pack(gaps).alias("gaps"), F.array_distinct(pack(excluded)).alias("excluded"))


def ranked(postings: DataFrame, profile: dict, key: str, now_seconds: int) -> DataFrame:
    """``scored`` with ``deadline_state``, ``expired``, ``eligible`` and ``rank`` from 1: postings that are neither expired nor excluded first, by score, ties in the order of ``key``.

    A null deadline is read as unknown or rolling. Ranks come from range partitions, so no task holds all rows; an empty table gives no rows.
    """
    dated = with_strict_deadline(postings, "deadline", "_strict")
    state = deadline_state(F.col("_strict"), F.col("deadline_raw"), now_seconds)
    rows = scored(dated, profile, key, state.alias("deadline_state"))
    expired = F.col("deadline_state") == "expired"
    rows = rows.withColumn("expired", expired).withColumn("eligible", ~expired & (F.size("excluded") == 0))
    return numbered(rows, F.desc("eligible"), F.desc("score"), key)


def top(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` best rows, ties by key; the report is the feature, so the cut stays."""
    return rows.orderBy(F.desc("score"), key).limit(n)
