import random

import pytest
from pyspark.sql import functions as F

from sillok.operators import acquire, catalog, merge, report, scoring
from sillok.session import local_session  # noqa: F401

POSTING = "ordinal long, url string, source_id string, description string, evidence struct<completeness:string>, warnings array<string>, collected_at string, id string"


def fold(rows):
    """The merge one record after another."""
    shown = {}
    for r in sorted(rows):
        o, url, source, text, (kind,), notes, *_ = r
        got = shown.setdefault(url, {"o": o, "card": kind == "listing_card", "switched": False, "n": 0, "notes": []})
        got["n"] += 1
        if got["card"] and not got["switched"] and kind != "listing_card" and text:
            got |= {"o": o, "switched": True}
    return {u: (g["o"], g["n"], g["switched"]) for u, g in shown.items()}


def test_merge_equals_fold(spark):
    rng = random.Random(5)
    rows = [
        (i, f"https://e.com/{rng.randrange(40)}", f"s{rng.randrange(4)}", rng.choice(["", "x", None]), (rng.choice(["listing_card", "full_text", "partial_text"]),), [], f"t{i}", "")
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, POSTING)
    got = {r["url"]: (r["ordinal"], r["observations"], r["switched"]) for r in merge.winners(df).collect()}
    assert got == fold(rows)
    again = merge.winners(merge.winners(df).drop("first_ordinal", "observations", "sources", "switched"))
    assert {r["url"]: r["ordinal"] for r in again.collect()} == {u: v[0] for u, v in got.items()}
    assert merge.winners(df.limit(0)).count() == 0


def test_merge_arrays(spark):
    rows = [(1, "https://e.com/a", "s2", "", ("listing_card",), ["n1"], "t", ""), (2, "HTTPS://E.com/a#x", "s1", "text", ("full_text",), ["n2", "n1"], "t", ""), (3, "https://e.com/a", "s2", "longer text", ("full_text",), ["n3"], "t", "")]
    got = merge.merge_arrays(spark.createDataFrame(rows, POSTING)).first()
    assert got["ordinal"] == 2 and got["source_ids"] == ["s1", "s2"] and got["warnings"] == ["n2", "n1", merge.RETAINED, "n3"]


def test_ranks(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "k int, v int")
    got = [r["k"] for r in merge.numbered(df, F.desc("v"), "k").orderBy("rank").collect()]
    assert got == sorted(range(100), key=lambda k: (-(k % 7), k))


def test_catalogue(spark):
    sources = spark.createDataFrame(
        [("kr-001", "가전자", "Ga Electronics", ["GAE"], "https://a.example/x"), ("kr-002", "나전자", None, [], "https://a.example/x"), ("kr-003", "다", "Da", None, None)],
        "id string, name_ko string, name_en string, aliases array<string>, careers_url string",
    ).withColumns({"adapter": F.lit("generic"), "kind": F.lit("company"), "is_group_portal": F.lit(False)})
    picks = spark.createDataFrame([("gae",), ("전자",), ("none",)], "selector string")
    got = {(r["selector"], r["id"], r["exact"]) for r in catalog.resolve(sources, picks).collect()}
    assert got == {("gae", "kr-001", True), ("전자", "kr-001", False), ("전자", "kr-002", False)}
    assert {(r[0], r[1]) for r in catalog.shared_portals(sources).collect()} == {("kr-001", None), ("kr-002", "kr-001")}
    assert {r["task_id"] for r in catalog.discovery_plan(sources, "데이터").collect()} == {"discover-kr-001", "discover-kr-002", "discover-kr-003"}
    other = spark.createDataFrame([("kr-001", "가전자"), ("kr-009", "x"), ("kr-002", "라")], "id string, name_ko string")
    assert {tuple(r) for r in catalog.manifest_differences(sources, other, "name_ko").collect()} == {("kr-009", "missing"), ("kr-003", "unexpected"), ("kr-002", "name_ko differs")}
    with pytest.raises(ValueError, match="limit"):
        catalog.per_source_limit(sources, "id", "id", True)


def test_acquire(spark):
    df = spark.createDataFrame([(200, "x"), (403, "x"), (401, ""), (206, ""), (200, "Checking your browser"), (None, None)], "s int, t string")
    assert [r[0] for r in df.select(acquire.http_state(F.col("s"), F.col("t"))).collect()] == ["ok", "blocked", "needs_credentials", "error", "needs_browser", "error"]
    pages = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("a", 3, 9), ("b", 1, 6), ("b", 2, 6), ("b", 3, 6), ("b", 4, 6)], "s string, p int, n int")
    assert {(r[0], r[1]) for r in acquire.capped_pages(pages, "s", "p", "n", 10).collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}


def test_scoring_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "JavaScript 개발", "부산"), (2, "python 서비스기획", None)], "k int, title string, location string").withColumns({c: F.lit("") for c in ("company", "description", "employment_type", "experience")})
    got = scoring.scored(rows, {"keywords": ["Java", "PYTHON", "기획", "python"], "preferred_locations": ["부산"]}, "k").orderBy("k").collect()
    assert [(r["score"], r["matched"]) for r in got] == [(2, ["부산"]), (6, ["PYTHON", "기획"])]
    path = str(tmp_path / "r.html")
    labelled = report.report_rows(rows.select("k", "title"), spark.createDataFrame([(1, "<b>")], "k int, l string"), "k", "l")
    assert report.write_report(labelled, path) == 2 and "&lt;b&gt;" not in open(path).read().replace("&amp;lt;b&amp;gt;", "")
    with pytest.raises(FileExistsError):
        report.write_report(labelled, path)
