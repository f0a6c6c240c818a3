import pytest

from sillok.llm.names import bare, build_model, exact_reading, key, link_names, typo

LISTED = [
    ("kr-001", "가람전자", "Garam Electronics", ["GRE"], "https://a.example/"), ("kr-002", "GARAM ELECTRONICS", None, [], "https://a.example/"), ("kr-003", "가람해운", "Garam Shipping", [], "https://b.example/"), ("kr-004", "나솔미디어", "Nasol Media", ["나솔"], "https://c.example/"),
    ("kr-005", "다빛전자", "Dabit Electronics", [], "https://d.example/"), ("kr-006", "다빛미디어", "Dabit Media", [], "https://e.example/"), ("kr-007", "다빛해운", "Dabit Shipping", None, None),
]
OTHERS = [("kr-900", "마온전자", "Maon Electronics", [], "https://z.example/"), ("kr-901", "마온해운", "Maon Shipping", [], "https://y.example/")]
LINKED = {
    "(주)가람전자": "kr-001", "가람 전자": "kr-001", "전자 가람": "kr-001", "Electronics, Garam": "kr-001", "Garam전자": "kr-001", "가람 Electronics": "kr-001", "Garam Electronics Co., Ltd.": "kr-001", "가람전자 인사팀": "kr-001", "「가람전자」": "kr-001", "가람전자(Garam Electronics)": "kr-001", "Garam Elec.": "kr-001", "G.R.E.": "kr-001", "GRE Electronics": "kr-001", "지알이": "kr-001",
    "가람잔자": "kr-001", "가전람자": "kr-001", "가가람전자": "kr-001", "Graam Electronics": "kr-001", "가람해운 서울지점": "kr-003", "나솔M&C": "kr-004", "NASOL MEDIA": "kr-004", "다빛해운㈜": "kr-007",
}
STRANGERS = ["가람미디어", "마온전자", "마온잔자", "Unknown employer", "비공개", "", None, "가", "라움전자", "Maon Electronics Corp."]


def test_parts():
    assert bare("( 주 ) [가람전자] R&D센터") == "가람전자" and key("B.I.M. Media") == "bimmedia"
    assert typo("소프트", "솦트") and typo("전자", "잔자") and typo("abcd", "abdc") and not typo("전자", "해운")


def test_organisations():
    model = build_model(LISTED, OTHERS)
    assert model.entity["kr-002"] == "kr-001" and len(set(model.entity.values())) == 6
    assert exact_reading(model, "가람미디어") == ("garam media", None)
    with pytest.raises(ValueError, match="rows"):
        build_model([LISTED[0]] * 20_001)


def test_links(spark):
    rows = [(n, 1) for n in LINKED] + [(n, 3) for n in STRANGERS] + [("가람전자", 40), ("가람해운", 30), ("나솔미디어", 20), ("마온전자 ", 25), ("가람전자" * 20_000, 1)]
    df = spark.createDataFrame(rows, "company string, uses long")
    got = {r["company"]: r["entity"] for r in link_names(build_model(LISTED, OTHERS), df, "company").collect()}
    assert got == LINKED | {"가람전자": "kr-001", "가람해운": "kr-003", "나솔미디어": "kr-004"}
    assert link_names(build_model(LISTED), df.limit(0), "company").count() == 0
    assert link_names(build_model([]), df, "company").count() == 0
