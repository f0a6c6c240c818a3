from sillok.llm import abuse

ORDINARY = [
    "면접관이 Python 경험을 자세히 물었고 분위기는 편안했습니다.", "결과 통보까지 21일 걸렸습니다.", "야근이 너무 많고 관리자가 무능해서 추천하지 않습니다.", "새끼손가락 부상으로 실기 일정을 미뤘습니다.", "강아지 새끼를 돌보는 동물병원 보조 직무입니다.", "The app should be idiot-proof, says the design brief.", "We kill stale processes and nuke old caches every night.",
    "욕설이나 비하 발언이 확인되면 게시글은 삭제됩니다.", "이번 프로젝트가 경력의 시발점이 되었습니다.", "성인 교육 콘텐츠 기획자를 찾습니다.", "Please report harassment, hate speech or threats to the ethics line.", "Keep the portfolio under 25 pages.", "I moved from catalogues to search after 8 years.",
]
HELD_OUT = [
    "거기 팀장 진짜 병1신 아니냐", "또ㄹㅏ이들만 모인 회사", "s h u t  u p you id1ot", "노인들은 열등해서 일을 시키면 안 된다", "밤길 조심해라 다리를 부러뜨려 줄게", "면접 끝나고 모텔 가자 그럼 합격시켜 준다", "IMMIGRANTS are garbage, keep them out", "i will find you and break your neck",
]


def test_letters():
    assert abuse.undisguised("병 1신") == "병신" and abuse.undisguised("또ㄹㅏ이") == "또라이" and abuse.undisguised("ιD1OT, f**k") == "idiotfk"
    assert abuse.sentences(None) == [] and abuse.sentences("  \n🙂") == [] and abuse.sentences("가.\r\n가. 나?") == ["가", "나"]


def test_held_out(spark):
    docs = [(i, t) for i, t in enumerate(ORDINARY * 3)] + [(100 + i, f"답변 감사합니다.\n{t}") for i, t in enumerate(HELD_OUT)] + [(900, None), (901, ""), (902, "가나다 " * 30_000), (903, None)]
    df = spark.createDataFrame(docs, "sentence int, text string")  # a key named like an inner column
    labels = spark.createDataFrame([("저런 돌대가리한테 배울 게 뭐가 있나", "insult"), ("급여가 늦게 나왔습니다.", "none"), (None, "hate")], "text string, category string")
    got = {r["sentence"] for r in abuse.scores(df, labels, "sentence", "text", abuse.THRESHOLD).collect()}
    assert len({i for i in got if 100 <= i < 200}) >= len(HELD_OUT) - 1
    assert not {i for i in got if i < 100 or i >= 900}
    scored = {r["sentence"]: r["score"] for r in abuse.scores(df, labels, "sentence", "text").collect()}
    assert len(scored) == len(docs) and scored[900] is None and scored[901] is None
    assert abuse.scores(df.limit(0), labels, "sentence", "text", 0.0).count() == 0
