"""Records kept beside the postings: their checks, applications with history, questions, evidence, redirects, and selections that refuse instead of cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillok.functions.dates import rolling, with_strict_deadline
from sillok.functions.text import fence
from sillok.functions.urls import canonical_url, posting_id
from sillok.operators.catalog import manifest_differences

#: States of an application, and labels of states and deadlines for reading.
STATES = ("drafted", "applied", "interview", "offer", "rejected", "withdrawn", "hired")
LABELS = {
    "drafted": "초안", "applied": "지원 완료", "interview": "면접", "offer": "합격 제안", "rejected": "불합격", "withdrawn": "지원 철회", "hired": "입사", "open": "모집 중", "expired": "마감", "rolling": "상시", "unknown": "미확인",
}
#: Paths that ask for a login, and the most redirects that are followed.
LOGIN_PATH = r"(?i)^https?://[^/]+(?:/[^?#]*)?/(?:login|log-in|signin|sign-in|sso)(?:[/?#]|$)|^https?://[^/]+(?:/[^?#]*)?/oauth2?/authorize(?:[/?#]|$)"
MAX_REDIRECTS = 5
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})$"


def label(code: Column) -> Column:
    """The label of a state; codes without one show themselves."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), code), code)


def posting_problems(postings: DataFrame) -> DataFrame:
    """The postings with ``problems``: codes of what keeps a record from being one. A null or empty id is no problem (it follows from the address), another one is; a deadline that is neither readable nor rolling is one."""
    rows = with_strict_deadline(postings.withColumn("_candidate", F.coalesce(F.nullif(F.trim("deadline"), F.lit("")), "deadline_raw")), "_candidate", "_read")
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    address = canonical_url(F.col("url"))
    unread = F.col("_read").isNull() & ~blank("_candidate") & ~rolling(F.col("_candidate"))
    checks = {
        "no_source": blank("source_id"), "no_title": blank("title"), "no_company": blank("company"), "no_address": address.isNull(), "other_id": ~blank("id") & address.isNotNull() & (F.col("id") != posting_id(address)),
        "naive_collected_at": ~F.coalesce(F.col("collected_at").rlike(AWARE), F.lit(False)), "unread_deadline": unread,
    }
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks.items()]))).drop("_candidate", "_read")


_APPLICATION = "struct<job_id: string, status: string, notes: string, history: array<struct<status: string, notes: string, at: string, confirmed: boolean>>>"


def applications(texts: DataFrame, text: str) -> DataFrame:
    """``job_id, status, notes, history, problems`` of JSON texts: a list, or an object with ``applications``. A text that is neither gives one row of nulls with ``not_applications``."""
    listed = F.from_json(F.col(text), f"array<{_APPLICATION}>")
    held = F.from_json(F.col(text), f"struct<applications: array<{_APPLICATION}>>")["applications"]
    first = F.left(F.ltrim(text), F.lit(1))
    rows = texts.select(F.explode_outer(F.when(first == "[", listed).when(first == "{", held)).alias("a"))
    rows = rows.select("a.*")
    counts = rows.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    met = rows.join(counts, "job_id", "left")
    known = lambda s: F.coalesce(s.isin(*STATES), F.lit(False))
    nothing = F.col("job_id").isNull() & F.col("status").isNull() & F.col("notes").isNull() & F.col("history").isNull()
    checks = {
        "not_applications": nothing, "no_job": ~nothing & (F.coalesce(F.trim("job_id"), F.lit("")) == ""), "repeated_job": F.col("_n") > 1, "bad_status": ~nothing & ~known(F.col("status")),
        "bad_history": F.exists(F.coalesce("history", F.array().cast(met.schema["history"].dataType)), lambda e: ~known(e["status"])),
    }
    return met.select("job_id", "status", "notes", "history", F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks.items()])).alias("problems"))


def of_known_jobs(rows: DataFrame, jobs: DataFrame, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose job is known, and the others."""
    known = jobs.select(F.col("id").alias(job)).distinct()
    return rows.join(known, job, "left_semi"), rows.join(known, job, "left_anti")


def uncovered(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """``id`` of the rows without any evidence that has both a text and an address."""
    filled = lambda name: F.coalesce(F.trim(name), F.lit("")) != ""
    return rows.select("id").join(evidence.filter(filled("snippet") & filled("url")).select(F.col("company_id").alias("id")), "id", "left_anti")


def built_catalogue(batches: list[DataFrame], manifest: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all batches in the order of their selection, and ``id, difference`` of all that speaks against them: differences from the manifest and missing evidence."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    against = manifest_differences(rows, manifest, "name_ko", "selection_index")
    return rows.orderBy("selection_index", "id"), against.unionByName(uncovered(rows, evidence).withColumn("difference", F.lit("no evidence")))


def exactly_one(rows: DataFrame) -> DataFrame:
    """``rows`` if there is one; no or several rows are refused."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError("no such record" if n == 0 else "more than one such record")
    return rows


def refuse_beyond(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` if they are at most ``most``; more are refused, never cut."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def selection_problems(selectors: DataFrame, resolved: DataFrame, allow_many: bool = False) -> DataFrame:
    """``selector, problem``: selectors (``selector``) that are blank or name no source, or several where only one is allowed; ``resolved`` as from ``catalog.resolve``."""
    counts = resolved.groupBy("selector").agg(F.count_distinct("id").alias("_n"))
    met = selectors.join(counts, "selector", "left")
    problem = F.when(F.coalesce(F.trim("selector"), F.lit("")) == "", "blank").when(F.col("_n").isNull(), "none").when((F.col("_n") > 1) & ~F.lit(allow_many), "several")
    return met.select("selector", problem.alias("problem")).filter("problem IS NOT NULL")


def usable(states: DataFrame, status: str = "status") -> DataFrame:
    """One row: whether any source gave something to work with."""
    return states.agg(F.coalesce(F.bool_or(F.col(status).isin("ok", "partial", "empty")), F.lit(False)).alias("usable"))


def has_evidence(stories: Column) -> Column:
    """Whether any story of a profile (structs with ``evidence``) is backed by evidence."""
    return F.coalesce(F.exists(stories, lambda s: F.size(s["evidence"]) > 0), F.lit(False))


def question_text(questions: Column) -> Column:
    """Questions (structs ``question, limit``) as one text: each between fences with its limit, null where it is unknown or not positive; null and empty lists give an empty text."""
    one = lambda q, i: F.concat(F.format_string("### %d\n", i + 1), fence(q["question"], "text"), F.lit("\n"), F.coalesce(F.when(q["limit"] > 0, q["limit"].cast("string")), F.lit("-")))
    return F.coalesce(F.array_join(F.transform(questions, one), "\n"), F.lit(""))


def evidence_bundle(postings: DataFrame) -> DataFrame:
    """``id, bundle``: what a posting rests on, as one struct."""
    return postings.select("id", F.struct("url", "source_id", "collected_at", "deadline", "deadline_raw", "evidence", "warnings").alias("bundle"))


def follow_redirects(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, url, hops, state`` of addresses (``url``) over redirects (``url, target``): ``ok`` where none leads on, else what stopped the walk.

    ``loop`` at an address met before, ``too_many`` beyond MAX_REDIRECTS, ``downgrade`` from https to http, ``needs_credentials`` at a login, ``ambiguous`` with several targets, ``blocked`` without a target.
    One join a hop, at most MAX_REDIRECTS + 1 of them, and each moves only the addresses that still go on.
    """
    onward = edges.groupBy(F.col("url").alias("_from")).agg(F.count_distinct(F.coalesce("target", F.lit(""))).alias("_n"), F.min(F.coalesce("target", F.lit(""))).alias("_to"))
    going = starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("hops"), F.array("url").alias("_path"))
    done: list[DataFrame] = []
    for _ in range(MAX_REDIRECTS + 1):
        met = going.join(onward, going["url"] == onward["_from"], "left").drop("_from")
        state = (
            F.when(F.col("_n").isNull(), "ok").when(F.col("_n") > 1, "ambiguous").when(canonical_url(F.col("_to")).isNull(), "blocked").when(F.col("url").rlike("(?i)^https:") & ~F.col("_to").rlike("(?i)^https:"), "downgrade")
            .when(F.col("_to").rlike(LOGIN_PATH), "needs_credentials").when(F.array_contains("_path", F.col("_to")), "loop").when(F.col("hops") >= MAX_REDIRECTS, "too_many")
        )
        met = met.withColumn("state", state)
        done.append(met.filter("state IS NOT NULL").select("start", "url", "hops", "state"))
        going = met.filter("state IS NULL").select("start", F.col("_to").alias("url"), (F.col("hops") + 1).alias("hops"), F.array_append("_path", F.col("_to")).alias("_path"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
