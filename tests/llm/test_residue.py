import pytest
from pyspark.sql import functions as F

from sillok.llm.residue import PrefixTree, has_slot, judge, with_residue

BAD = [
    "404 Not Found", "502 Bad Gateway", "Access Denied", "Just a moment...", "Loading…", "Lorem ipsum", "React App", "Site Under Construction", "undefined", "서비스 점검 안내", "잘못된 접근입니다", "제목 없음", "페이지를 찾을 수 없습니다", "회사이름을 입력하세요", "<title></title>", "You need to enable JavaScript to run this app.",
    "{{ diagnostics[0] }}", "GET {url} -> {status} (HTTP {code}).", "모집 인원: NaN명", "마감일: undefined년 undefined월", "연봉은 %s ~ %s 만원 수준입니다.", "담당 업무: (여기에 작성)", "We are looking for a [JOB TITLE] to join us.", "우대사항: XXXX XXXX XXXX", "java.lang.NullPointerException", "#SITE_NAME#", "TODO: 본문 작성", "테스트 테스트 테스트 3",
]
GOOD = [
    "null 및 undefined 처리에 엄격한 코드 리뷰를 합니다.", "${HOME} 같은 환경변수와 셸 스크립트를 다룰 줄 알아야 합니다.", "{{ }} 문법을 쓰는 템플릿 엔진(Mustache, Handlebars) 사용 경험을 우대합니다.", "lorem ipsum 대신 실제 문안으로 시안을 만드는 디자이너를 찾습니다.", "We monitor 502 Bad Gateway rates on 3 gateways and keep them under 4 percent.", "Access denied page (title: 'Access Denied') classified as blocked.",
    "Response had 9 null titles and 9 undefined deadlines.", "Template parameter {page} was expanded to 3 addresses.", "noscript notice found; a browser snapshot is needed.", '한국어 오류 문구 "페이지를 찾을 수 없습니다"를 감지하여 error로 분류함.', "Null Media Careers", "{비결} 채용", "채용 [건설]", "모나담화학 404Lab 채용", "에러 없는 채용, 토파댄", "미담물산 서비스 점검 기술팀 채용", "Dabom JavaScript Guild 채용", "[About us]", "<What you will do>", "GET https://a.example/jobs -> error (HTTP 404).", "채용공고", "-",
]


def flagged(line):
    return bool(judge(line) or has_slot(line))


@pytest.mark.parametrize("line", BAD)
def test_residue(line):
    assert flagged(line)


@pytest.mark.parametrize("line", GOOD)
def test_content(line):
    assert not flagged(line)


def test_tree():
    tree = PrefixTree()
    a = tree.place("leaf", "job took 0 seconds on host alpha".split())
    assert tree.place("leaf", "job took 0 seconds on host beta".split()) == a and tree.templates[a][-1] == "<*>"
    assert tree.place("leaf", "서비스 점검 안내".split()) != tree.place("leaf", "서비스 점검 중입니다.".split())


def test_records(spark):
    rows = [("a", ["x", "ok\n404 Not Found"]), ("b", None), ("c", []), ("d", [None, ""]), ("e", ["fine text"]), ("a", ["x", "ok\n404 Not Found"]), ("f", [line for line in BAD]), ("g", [" ".join(f"단어{chr(0xAC00 + i % 999)}" for i in range(50_000))]), (None, ["null"])]
    df = spark.createDataFrame(rows, "k string, t array<string>").withColumn("line", F.lit(1)).withColumn("kind", F.lit(2))
    got = {r["k"]: r["kinds"] for r in with_residue(df, "t", "k").collect()}
    assert set(got) == {"a", "f", None} and got["a"] == ["error_page"]
    assert with_residue(df.limit(0), "t", "k").count() == 0
    alone = spark.createDataFrame([(i, [t]) for i, t in enumerate(BAD + GOOD)], "k int, t array<string>")
    assert {r["k"] for r in with_residue(alone, "t", "k").collect()} == set(range(len(BAD)))
