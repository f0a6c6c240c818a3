import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sillok.llm.lookalike import not_plain, plain_form


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("іΟЅ 개발자", "iOS 개발자"), ("Менеджер по продажам", "Менеджер по продажам"), ("[КR] Тесhnісаl　Wrіtеr", "[KR] Technical Writer"), ("Meнеджер", "Менеджер"), ("С＋＋ 분석가", "C++ 분석가"), ("α/β 테스트", "α/β 테스트"),
        ("β-카로틴", "β-카로틴"), ("Σ 통계 분석가 · 생산", "Σ 통계 분석가 · 생산"), ("👩‍💻 a‍b", "👩‍💻 ab"), ("🏭👷‍♀️ 현장", "🏭👷‍♀️ 현장"), ("모빌ᄅ‍ᅵ티", "모빌리티"), ("Café", "Café"), ("① ㎡ 生産", "① ㎡ 生産"),
        ("（Ｒ－７９４８）", "(R-7948)"), ("a‑b  c", "a-b c"), ("﻿보도담", "보도담"), ("", ""), (None, None), (" a  b ", "a b"), ("QΑ Εngіnееr", "QA Engineer"), ("Übeｒ", "Über"),
    ],
)
def test_plain(raw, want):
    assert plain_form(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ09 -가각각éαοΟСсЅі́​‍️\xad\xa0　ＡａーИж👩💻♀①㎡（"), max_size=20))
def test_idempotent(text):
    once = plain_form(text)
    assert plain_form(once) == once and unicodedata.is_normalized("NFC", once)


def test_table(spark):
    rows = [(1, "plain 가", "x"), (2, "Ｗide", "x"), (3, None, None), (4, "", "x"), (2, "Ｗide", "x"), (5, "a​" * 50_000, "x")]
    got = not_plain(spark.createDataFrame(rows, "k int, t string, extra string"), "t").collect()
    assert sorted((r["k"], r["clean_text"][:4], r["extra"]) for r in got) == [(2, "Wide", "x"), (2, "Wide", "x"), (5, "aaaa", "x")]
    assert not_plain(spark.createDataFrame([], "t string"), "t").count() == 0
