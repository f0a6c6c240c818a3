import json

import pytest
from pyspark.sql import functions as F

from sillok.sources import html, listings, robots

PAGE = "https://careers.e.example/list"


def ld(*items):
    return "".join(f'<script type="application/ld+json">{i if isinstance(i, str) else json.dumps(i)}</script>' for i in items)


def posting(**more):
    return {"@type": "JobPosting", "title": "데이터 엔지니어", "url": "/jobs/1", "description": "<p>본문 <b>굵게</b></p>"} | more


def test_json_ld():
    rows = html.postings_of(ld("{broken", {"@graph": [posting(hiringOrganization={"name": "가 회사"}, jobLocation=[{"address": {"addressLocality": "부산"}}])]}), PAGE)
    assert [(r["url"], r["company"], r["description"], r["location"]) for r in rows] == [("https://careers.e.example/jobs/1", "가 회사", "본문 굵게", "부산")]
    assert html.postings_of(ld(posting(url="#top")), PAGE)[0]["url"] == PAGE
    assert html.postings_of(ld(posting(description="x<img src=a>")), PAGE)[0]["completeness"] == "partial_text"
    assert html.postings_of(ld({"@type": ["https://schema.org/JobPosting/"], "title": "t", "@id": "https://e.example/9"}), PAGE)[0]["company"] == "Unknown employer"
    assert html.postings_of("<div>" * 300, PAGE) == [] and html.postings_of(None, PAGE) == [] and html.postings_of(ld(posting(url="javascript:x", title="t")) * 2, PAGE) == []


def test_cards():
    naver = '<li class="card_item"><a class="card_link" onclick="show(\'123\')"><h4 class="card_title">제목</h4><dl class="card_info"><dt>모집 경력</dt><dd>신입</dd></dl></a></li>'
    got = html.postings_of(naver, "https://recruit.navercorp.com/rcrt/list.do")[0]
    assert (got["url"], got["experience"], got["company"]) == ("https://recruit.navercorp.com/rcrt/view.do?annoId=123", "신입", "Unknown employer")
    saramin = '<div class="item_recruit"><h2 class="job_tit"><a href="/zf_user/jobs/relay/view?rec_idx=77&t=1" title="개발자">x</a></h2><div class="job_condition"><span>서울</span><span>경력 3년</span><span>정규직</span></div><strong class="corp_name">나</strong></div>'
    got = html.postings_of(saramin, "https://www.saramin.co.kr/list")[0]
    assert got["url"].endswith("view?rec_idx=77") and (got["location"], got["experience"], got["employment_type"], got["company"]) == ("서울", "경력 3년", "정규직", "나")


def test_details_and_lists():
    facts = "<dl class='card_info'><dt>모집 기간</dt><dd>2027.01.05 ~ 2027.02.09 (18:00)</dd></dl>"
    naver = f"<div class='card_title_box'><h4 class='card_title'>제목</h4>{facts}</div><div class='detail_wrap'>본문 <script>x</script>둘</div>" + ld(posting(title="제목", hiringOrganization={"name": "나다"}, experienceRequirements="신입"))
    got = html.postings_of(naver, "https://recruit.navercorp.com/rcrt/view.do?annoId=9")
    assert [(r["company"], r["description"], r["experience"], r["deadline_raw"], r["notes"]) for r in got] == [("나다", "본문 둘", "신입", "2027.01.05 ~ 2027.02.09 (18:00)", [])]
    cj = "<div class='support-list'><p class='company'>가나다식품</p><h3 class='title'>연구원</h3><ul class='meta-info'><li>경력</li><li>2027.02.09</li></ul></div><div class='detail-list'><a href='/x.PDF?1'>첨부</a></div>"
    got = html.postings_of(cj, "https://recruit.cj.net/recruit/ko/recruit/recruit/detail.fo?zz_jo_num=1")[0]
    assert (got["title"], got["company"], got["experience"], got["completeness"]) == ("연구원", "가나다식품", "경력", "partial_text") and got["notes"] == [html.NOTES["media"]]
    saramin = '<div class="item_recruit"><h2 class="job_tit"><a href="https://saramin.co.kr/zf_user/jobs/relay/view?rec_idx=5">개발</a></h2><p class="job_date"><span class="date">~ 10/21</span></p><div class="job_condition"><span>신입마을</span></div></div>'
    got = html.postings_of(saramin, "https://www.saramin.co.kr/list")[0]
    assert (got["experience"], got["location"], got["deadline_raw"], got["title"]) == ("", "신입마을", "~ 10/21", "개발")
    api = "https://recruit.cj.net/recruit/ko/recruit/recruit/searchNewGonggoList.fo"
    rows = [{"zz_jo_num": "J7", "gubun": 2, "zz_title": " 가  나 ", "compnm": None, "zz_end_dt_str": "2027.02.09", "zz_end_hh": "9", "zz_end_mi": "05"}, {"zz_jo_num": 8, "gubun": "1", "zz_title": "다", "zz_till_hire": "Y"}, {"zz_jo_num": "8", "gubun": "3", "zz_title": "라"}, 5]
    got = html.postings_of(json.dumps({"ErrorCode": 0, "ds_newRecruitList": rows}), api)
    assert [(r["title"], r["deadline_raw"], r["company"]) for r in got] == [("가 나", "2027.02.09 9:05", "Unknown employer"), ("다", "채용시까지", "Unknown employer")] and got[0]["url"].endswith("bestDetail.fo?zz_jo_num=J7&direct=N")
    assert html.postings_of(json.dumps({"ErrorCode": 1, "ds_newRecruitList": rows}), api) == []
    got = html.postings_of(json.dumps({"result": "Y", "list": [{"annoId": 3, "annoSubject": "가", "endYmdTime": "2027.02.09 10:00:00"}]}), "https://recruit.navercorp.com/rcrt/loadJobList.do")
    assert [(r["url"], r["evidence_kind"]) for r in got] == [("https://recruit.navercorp.com/rcrt/view.do?annoId=3", "live_json")]
    assert html.next_page('<a href="?p=2" rel="nofollow next">2</a>', PAGE) == "https://careers.e.example/list?p=2" and html.next_page("<a href='?p=2'>2</a>", PAGE) == ""


def test_page_deadlines(spark):
    naver = "<li class='card_item'><a class='card_link' onclick='show(1)'><b class='card_title'>가</b><dl class='card_info'><dt>모집 기간</dt><dd>2027.02.09 (18:00)</dd></dl></a></li>"
    pages = spark.createDataFrame([("https://recruit.navercorp.com/rcrt/list.do", naver, "n"), (PAGE, ld(posting(validThrough="2027.02.09 18:00")), "l"), (PAGE, ld(posting(validThrough="2027-02-09")), "d")], "url string, html string, source_id string")
    got = {r["source_id"]: (r["deadline"], html.NOTES["deadline"] in r["warnings"]) for r in html.parse_pages(pages).collect()}
    assert got == {"n": ("2027-02-09T18:00:00+09:00", False), "l": (None, True), "d": ("2027-02-09", False)}


@pytest.mark.parametrize(
    ("rule", "path", "fits"),
    [
        ("/채용", "/채용/1", True), ("/%ec%b1%84%EC%9A%A9", "/채용", True), ("/a%7eb", "/a%7Eb", True), ("/a~b", "/a%7eb/c", True), ("/a%2fb", "/a/b", False), ("/x*y*z", "/x-y-y-z9", True), ("/x*y*z$", "/xyyz9", False), ("/x*y*z$", "/xyyz9z", True), ("/a*a$", "/a", False), ("/a**b", "/acb", True),
        ("/$", "/", True), ("/$", "/a", False), ("/a$b", "/a$bc", True), ("/*" + "a*" * 40 + "b", "/" + "a" * 3000, False), ("/p?q=*", "/p?q=1", True), ("/*$", "/anything", True),
    ],
)
def test_rule_fits(spark, rule, path, fits):
    rules = robots.rules_table(spark.createDataFrame([("o", f"User-agent: *\nDisallow: {rule}")], "origin string, text string"), "origin", "text", "x")
    assert robots.permits(spark.createDataFrame([(1, path, "o")], "k int, path string, at string"), rules, "k", "path", "at").first()["allowed"] is not fits


@pytest.mark.parametrize("line", ["Request-rate: -1/-5", "Request-rate: 0/5", "Crawl-delay: -1", "Crawl-delay: nan", "Crawl-delay: 1/2", "Request-rate: 3", "Disallow: x", "User-agent: a b"])
def test_refused_policies(line):
    assert robots.policy(f"User-agent: *\n{line}", "x")[2]


def test_page_tables(spark):
    pages = spark.createDataFrame([(PAGE, ld(posting()), "s"), (PAGE, None, "s"), (None, "x", None)], "url string, html string, source_id string")
    assert [r["title"] for r in html.parse_pages(pages).collect()] == ["데이터 엔지니어"]
    linked = spark.createDataFrame([(PAGE, '<a href="/v?annoId=1">a</a><a href="https://www.e.example/v?annoId=2"><img alt="b"></a><a href="/v?annoId=1">c</a><a href="/v?annoId=3"></a>')], "url string, html string")
    assert {(r["posting_id"], tuple(r["labels"]), tuple(r["images"]), r["found"]) for r in html.page_links(linked).collect()} == {("1", ("a", "c"), (), 2), ("2", (), ("b",), 2)}
    assert pages.select(html.html_text(F.lit("<p>a &amp; b</p><script>x</script>"))).first()[0] == "a & b"


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\n\nUser-agent: collector\nDisallow: /x*y\nDisallow:\nRequest-rate: 1/5"
    assert robots.policy(text, "other")[:2] == ([(False, "/a", 2), (True, "/a/b$", 4)], 2.0)
    assert robots.policy(text, "my-collector")[:2] == ([(False, "/x*y", 3)], 5.0)
    assert robots.policy("nonsense", "x")[2] and robots.policy("Disallow: /", "x")[2] and robots.policy("", "x") == ([], 0.0, None)
    rules = robots.rules_table(spark.createDataFrame([("o", text), ("bad", "<html>")], "origin string, text string"), "origin", "text", "other")
    paths = spark.createDataFrame([(1, "/a/b", "o"), (2, "/a/bc", "o"), (3, "/c", "o"), (4, "/c", "bad"), (5, "/c", "new")], "k int, path string, at string")
    assert dict(robots.permits(paths, rules, "k", "path", "at").collect()) == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_files_and_pastes(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"jobs": [{"title": "t", "deadline": null}, {"title": "u"}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text("not json")
    got = listings.read_jobs(spark, str(tmp_path)).select("ordinal", "parse_error", listings.key_state(F.col("job"), "deadline").alias("d")).collect()
    assert sorted((r[0], r[2]) for r in got if not r[1]) == [(0, "null"), (1, "absent")] and [r[1] for r in got if r[1]] == ["not JSON"]
    pasted = listings.pasted(spark.createDataFrame([("\n제목\n본문", "u"), ("  ", "v")], "t string, u string"), "t", "u").collect()
    assert [(r["title"], r["company"]) for r in pasted] == [("제목", "Unknown employer")]
