import json

import pytest
from pyspark.sql import functions as F

from sillok.functions.urls import posting_id
from sillok.operators import catalog, records


def test_posting_problems(spark):
    schema = "id string, source_id string, title string, company string, url string, collected_at string, deadline string, deadline_raw string"
    rows = [("", "s", "t", "c", "https://a.example/1", "2027-01-05T00:00:00Z", None, "상시"), ("x", None, " ", "c", "https://a.example/1", "2027-01-05T00:00:00", "2027-01-05", ""), (None, "s", "t", "", "nowhere", None, None, "곧")]
    got = [r["problems"] for r in records.posting_problems(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["no_source", "no_title", "other_id", "naive_collected_at"], ["no_company", "no_address", "naive_collected_at", "unread_deadline"]]
    right = spark.createDataFrame(rows[:1], schema).withColumn("id", posting_id(F.col("url")))
    assert records.posting_problems(right).first()["problems"] == []


def test_applications(spark):
    good = {"job_id": "a", "status": "applied", "notes": "n", "history": [{"status": "drafted", "at": "t"}]}
    texts = [json.dumps({"applications": [good, {"job_id": "b", "status": "lost"}]}), json.dumps([{"job_id": "b", "status": "offer", "history": [{"status": "?"}]}]), "7", None]
    got = sorted((r["job_id"] or "", r["problems"]) for r in records.applications(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect())
    assert got == [("", ["not_applications"]), ("", ["not_applications"]), ("a", []), ("b", ["repeated_job", "bad_history"]), ("b", ["repeated_job", "bad_status"])]
    known, others = records.of_known_jobs(spark.createDataFrame([("a",), ("b",)], "job_id string"), spark.createDataFrame([("a",), ("a",)], "id string"))
    assert [r[0] for r in known.collect()] == ["a"] and [r[0] for r in others.collect()] == ["b"]


def test_catalogue_build(spark):
    kind = "id string, name_ko string, selection_index int"
    batches = [spark.createDataFrame(r, kind) for r in ([("kr-002", "나", 2)], [("kr-001", "가", 1), ("kr-009", "다", 9)])]
    manifest = spark.createDataFrame([("kr-001", "가", 1), ("kr-002", "너", 2), ("kr-003", "라", 3)], kind)
    evidence = spark.createDataFrame([("kr-001", "s", "https://a.example/"), ("kr-002", "", "https://a.example/")], "company_id string, snippet string, url string")
    rows, against = records.built_catalogue(batches, manifest, evidence)
    assert [r["id"] for r in rows.collect()] == ["kr-001", "kr-002", "kr-009"]
    assert {tuple(r) for r in against.collect()} == {("kr-002", "name_ko differs"), ("kr-003", "missing"), ("kr-009", "unexpected"), ("kr-002", "no evidence"), ("kr-009", "no evidence")}


def test_refusals(spark):
    rows = spark.range(3)
    assert records.refuse_beyond(rows, 3).count() == 3 and records.exactly_one(rows.filter("id = 1")).count() == 1
    for f in (lambda: records.refuse_beyond(rows, 2), lambda: records.exactly_one(rows), lambda: records.exactly_one(rows.limit(0))):
        with pytest.raises(ValueError, match="more|no such"):
            f()
    sources = spark.createDataFrame([("kr-001", "가전자", None, []), ("kr-002", "나전자", None, [])], "id string, name_ko string, name_en string, aliases array<string>")
    picks = spark.createDataFrame([("전자",), ("kr-001",), ("없음",), (" ",)], "selector string")
    found = catalog.resolve(sources, picks.filter("trim(selector) <> ''"))
    assert {tuple(r) for r in records.selection_problems(picks, found).collect()} == {("전자", "several"), ("없음", "none"), (" ", "blank")}
    assert {tuple(r) for r in records.selection_problems(picks, found, allow_many=True).collect()} == {("없음", "none"), (" ", "blank")}


def test_small_columns(spark):
    assert records.usable(spark.createDataFrame([("error",), ("empty",)], "status string")).first()[0] and not records.usable(spark.createDataFrame([], "status string")).first()[0]
    df = spark.createDataFrame([([("a```", 5), ("b", 0)], [([],), (["e"],)]), (None, None)], "q array<struct<question: string, limit: int>>, s array<struct<evidence: array<string>>>")
    got = df.select(records.question_text(F.col("q")).alias("q"), records.has_evidence(F.col("s")).alias("s"), records.label(F.lit("open")).alias("l"), records.label(F.lit("x")).alias("x")).collect()
    assert got[0]["q"] == "### 1\n````text\na```\n````\n5\n### 2\n```text\nb\n```\n-" and got[0]["s"] and (got[1]["q"], got[1]["s"], got[1]["l"], got[1]["x"]) == ("", False, "모집 중", "x")


def test_redirects(spark):
    e = "https://a.example/"
    edges = [(e + "1", e + "2"), (e + "2", e + "3"), (e + "l", e + "m"), (e + "m", e + "l"), (e + "d", "http://a.example/"), (e + "s", e + "sso/x"), (e + "t", e + "1"), (e + "t", e + "2"), (e + "n", None)] + [(f"{e}c{i}", f"{e}c{i + 1}") for i in range(9)]
    starts = [(e + x,) for x in ("1", "3", "l", "d", "s", "t", "n", "c0", "c3")]
    got = {r["start"].removeprefix(e): (r["url"].removeprefix(e), r["hops"], r["state"]) for r in records.follow_redirects(spark.createDataFrame(starts, "url string"), spark.createDataFrame(edges, "url string, target string")).collect()}
    assert got == {"1": ("3", 2, "ok"), "3": ("3", 0, "ok"), "l": ("m", 1, "loop"), "d": ("d", 0, "downgrade"), "s": ("s", 0, "needs_credentials"), "t": ("t", 0, "ambiguous"), "n": ("n", 0, "blocked"), "c0": ("c5", 5, "too_many"), "c3": ("c8", 5, "too_many")}
