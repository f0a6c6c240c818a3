"""Abusive, hateful or sexual language: class-conditional Kneser-Ney models over letters, compared sentence by sentence.

Texts are brought to plain letters (look-alikes, disguises, spacing and case undone), cut into sentences, and each distinct sentence is scored once: the largest mean over a window of
the log-ratio between a model of abusive and one of ordinary language. Both are interpolated Kneser-Ney models; their lowest orders share the pooled continuation
counts, so a rare expression is weighed by the contexts it was met in and not by the size of either class. The ordinary model is counted on all sentences of the corpus,
as often as they occur, and never held in one place: grams are counted, interpolated and joined back as rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from itertools import product

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillok.llm.lookalike import plain_form
from sillok.session import bounded_broadcast, scratch_path, stored

#: Letters of a context plus one, discount, window of the score, and the score from which a sentence is abusive.
ORDER, DISCOUNT, WINDOW, THRESHOLD = 6, 0.75, 12, 0.05
#: Letters of the sentences that are counted and scored together by one worker.
CHUNK_LETTERS = 200_000
#: Runs of letters known from abusive examples, and their share of a window from which a sentence does not train the ordinary model.
TAINT_HANGUL, TAINT_LATIN, TAINTED = 3, 7, 0.5
#: Most reviewed examples; more are refused.
LABELS = 10_000
#: Most abusive sentences that are broadcast back to the documents.
BROADCAST_SENTENCES = 50_000

#: Reviewed wording that shows what counts, as words and as frames they stand in.
INSULTS_KO = "병신 ㅂㅅ ㅄ 븅신 시발놈 씨발놈 ㅅㅂ놈 쉬발 개새끼 개자식 개쉐끼 개색기 ㄱㅅㄲ 개ㅅㄲ 새끼 쌔끼 미친놈 미친년 미친ㄴ 또라이 쓰레기 ㅆㄹㄱ 인간쓰레기 버러지 벌레 얼간이 머저리 멍청이 등신 꼴통 돌대가리 무뇌충 호구새끼 쌍놈 찌질이 한심한놈 개돼지 x신 x발 시발것 쉬발럼 벼엉신 지랄 좆같은놈 ㅈ같은놈 빡대가리 저능아".split()
FRAMES_KO = (
    "이 {}야 꺼져라", "에라 이 {}야 입 닥쳐", "너 진짜 {} 아니냐", "그 팀장은 그냥 {}임", "{}들만 모여 있는 회사", "대표가 {}라고 부를 수밖에 없다", "{} 같은 상사 때문에 때려치웠다", "저런 {}한테 뭘 배우냐", "면접관 {} 낯짝도 보기 싫다", "{}이 부장이라니", "야 이 {}야", "인사팀 놈들 {}",
    "특히 거기 대표 {}", "글 쓴 인간 {} 같다",
)
GROUPS_KO = "여자 남자 외국인 이민자 장애인 늙은이 노인 동성애자 무슬림 지방 출신 고졸 아줌마 조선족 흑인 다문화 맘충 틀딱 저쪽 종교".replace("지방 출신", "지방출신").replace("저쪽 종교", "저쪽종교").split()
FRAMES_HATE_KO = (
    "{}는 열등해서 일을 시키면 안 된다", "{}들은 벌레나 다름없으니 뽑지 마라", "{} 것들은 다 자기 나라로 꺼져야 한다", "{}는 원래 머리가 나쁘고 거짓말만 한다", "{}들 냄새나서 같은 사무실 못 쓰겠다", "{}한테 월급 주는 건 돼지한테 밥 주는 것", "회사에 {}가 늘어나면 청소가 필요하다 싹 몰아내자", "{}들 때문에 회사 망한다 종자가 다르다", "{} 믿는 것들은 전부 내쫓아라", "{}는 사람 취급할 필요 없다",
)
THREATS_KO = (
    "밤길 조심해라 퇴근길에 내가 가만 안 둔다", "집 주소 다 알아냈으니 각오해라", "다리를 부러뜨려 준다", "가족도 무사하지 못할 거다", "병원 갈 준비해라", "회사 앞에서 기다린다 칼 들고 간다", "죽여 버린다", "찾아가서 죽여 버리겠다", "네 새끼들까지 가만두지 않겠다", "세상에서 사라져 주는 게 모두를 돕는 일이다", "나가 죽어라", "같은 건 숨 쉬는 공기도 아깝다", "너 같은 건 살 가치도 없다", "뒤져라 그냥",
    "목을 따 버린다", "불 질러 버릴 거다", "두고 봐라 피눈물 나게 해 준다", "뇌가 있으면 너처럼은 안 산다 부모가 그렇게 가르쳤냐", "손가락을 잘라 주마", "얼굴 갈아 버린다", "맞아야 정신 차리지",
)
SEXUAL_KO = (
    "몸매 보고 뽑음 가슴 큰 지원자 우대", "여직원 엉덩이 만지는 맛에 출근한다", "면접 끝나고 모텔 가서 한 번 자 주면 합격시켜 준다", "야한 사진 보내면 가산점", "벗은 몸일수록 좋음", "속옷만 입고 화상 면접 보자", "나도 벗고 할게", "조건만남 급구 하룻밤", "야동 공유방 들어와 성인 자료 많음", "섹스 파트너 구해요 성인만 연락", "ㅅㅅ 파트너 구해요", "성인 알바 전신 노출 섹스 장면 있음",
    "오늘 밤 호텔로 와라", "몸으로 때우면 평가 잘 준다", "누드 촬영 필수 만져도 되는 분", "따먹고 싶다", "자위 영상 팝니다", "젖가슴 보여 줘", "스폰 구함 월 잠자리",
)
INSULTS_EN = "idiot|moron|scumbag|bastard|dumbass|loser|clown|fool|jerk|asshole|shithead|scum|fcking idiot|fcking clown|worthless rat|piece of shit|piece of trash|son of a bitch|retard|braindead clown|braindead idiot|fucking idiot|dipshit|bitch|prick|f**king loser|brainless clown"
FRAMES_EN = (
    "shut up you {}", "this recruiter total {}", "the ceo total {}", "the manager total {}", "your whole team is a {} nothing more", "go to hell {}", "what a {} just like his team", "the manager is a complete {}", "you lot are {}s", "you {} should quit", "only a {} would work here", "only a {} would accept this",
)
GROUPS_EN = "foreigners|immigrants|migrants|women|disabled people|muslims|jews|gays|old people|older workers|blacks|koreans"
FRAMES_HATE_EN = (
    "do not hire {} they are a filthy lesser kind", "send all {} back and hose down the desks", "{} breed like rats keep them off our payroll", "{} are garbage and should be thrown out", "{} are subhuman and stupid", "{} are vermin and should never be hired", "{} belong in the kitchen or in a cage", "no {} here they stink",
)
OTHER_EN = (
    "rot in hell", "i will find you and break your legs", "i know where you live", "i will kill you", "you will leave in an ambulance", "watch your back on the way home", "we will burn your house down", "your family will pay", "you should be dead", "kill yourself", "she only got hired for her tits", "send nudes and you get the offer", "sleep with me and you get the job",
    "cam job for adults full nudity on stream", "hot singles want to hook up xxx pics inside", "wear nothing under the skirt", "suck my dick", "sex tape leaked", "naked pics for a raise", "come to my hotel room tonight if you want the offer", "fuck you", "fuck this shit company", "i will smash your face", "you deserve to be beaten", "the world would be better if you stopped breathing", "watch the stairs tonight I will break some legs", "bring your naked photos to the interview", "I want to fck the new intern on the desk",
)

_LEET = str.maketrans("013457@$!|", "oieastasii")
#: Letters that stand for Latin ones inside a Latin word, though they only resemble them.
_STAND_INS = str.maketrans("αβειικνορτυχηωкмтвнгпяи", "abeiiknoptuxnwkmtbhrnru")
_MIXED = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\d@$!*]*\p{Latin}[\p{Latin}\p{Greek}\p{Cyrillic}\d@$!*]*")
_LATIN_RUN = regex.compile(r"[\p{Latin}\d@$!*|.\-_]*[\p{Latin}][\p{Latin}\d@$!*|.\-_]*")
_INNER = regex.compile(r"(?<=[가-힣ㄱ-ㅣ])[\d*.\-_~^/·]+(?=[가-힣ㄱ-ㅣ])")
_LOOSE = regex.compile(r"([ㄱ-ㅎ])([ㅏ-ㅣ])")
_CUT = regex.compile(r"(?<=[.!?…。！？])\s+|[\r\n]+|\s[/|]\s")
_LETTER = regex.compile(r"[^\p{L}]+")
_COMPAT_L = {unicodedata.name(chr(c)).rsplit(" ", 1)[1]: c - 0x1100 for c in range(0x1100, 0x1113)}
_COMPAT_V = {unicodedata.name(chr(c)).rsplit(" ", 1)[1]: c - 0x1161 for c in range(0x1161, 0x1176)}


def _compose(m: regex.Match) -> str:
    lead, vowel = (unicodedata.name(x).rsplit(" ", 1)[1] for x in m.groups())
    return chr(0xAC00 + (_COMPAT_L[lead] * 21 + _COMPAT_V[vowel]) * 28) if lead in _COMPAT_L and vowel in _COMPAT_V else m[0]


def undisguised(sentence: str) -> str:
    """The letters of a sentence in lower case, without spacing, stars, inner digits and look-alikes."""
    text = (plain_form(sentence) or "").lower()
    if not text.isascii() or "*" in text or any(c.isdigit() for c in text):
        text = _INNER.sub("", text)
        text = _MIXED.sub(lambda m: m[0].translate(_STAND_INS), _LOOSE.sub(_compose, text))
    text = _LATIN_RUN.sub(lambda m: m[0].translate(_LEET) if any(c in "0134570@$!|" for c in m[0]) and sum(c.isalpha() for c in m[0]) >= (4 if m[0][0].isdigit() else 1) else m[0], text)
    return _LETTER.sub("", text)


def sentences(text: str | None, met: dict[str, str] | None = None) -> list[str]:
    """Distinct undisguised sentences of a text in order; null, empty and letterless texts have none. ``met`` keeps sentences that were undisguised before."""
    met = {} if met is None else met
    out: dict[str, None] = {}
    for raw in _CUT.split(text or ""):
        plain = met.get(raw)
        if plain is None:
            plain = met[raw] = undisguised(raw)
        if plain:
            out[plain] = None
    return list(out)


def reviewed_examples() -> list[str]:
    en = lambda words: words.split("|")
    out = [f.format(w) for f, w in product(FRAMES_KO, INSULTS_KO)] + [f.format(w) for f, w in product(FRAMES_HATE_KO, GROUPS_KO)]
    out += [f.format(w) for f, w in product(FRAMES_EN, en(INSULTS_EN))]
    out += [f.format(w) for f, w in product(FRAMES_HATE_EN, en(GROUPS_EN))]
    return out + [*THREATS_KO, *SEXUAL_KO, *OTHER_EN]


class Abusive:
    """Letter counts of the abusive examples; they are few, so every worker holds them."""

    def __init__(self, texts: list[str]) -> None:
        counts = {k: Counter() for k in range(3, ORDER + 1)}
        for text in texts:
            for gram in grams(text):
                for k in counts:
                    counts[k][gram[ORDER - k :]] += 1
        #: Continuations of each pair of letters.
        self.pairs = Counter(g[1:] for g in counts[3])
        #: By order: counts (continuations below the highest), their sums and numbers of successors by context.
        self.tables: dict[int, tuple[dict, dict, dict]] = {}
        for k in counts:
            use = counts[k] if k == ORDER else Counter(g[1:] for g in counts[k + 1])
            total, kinds = Counter(), Counter()
            for gram, n in use.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            self.tables[k] = (dict(use), dict(total), dict(kinds))

    def chance(self, gram: str, shared: float) -> float:
        """Probability of the last letter after its context, over the ``shared`` one of its pair."""
        p = shared
        for k in range(3, ORDER + 1):
            use, total, kinds = self.tables[k]
            part = gram[ORDER - k :]
            n = total.get(part[:-1], 0)
            if n:
                p = max(use.get(part, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds[part[:-1]] / n * p
        return p


def grams(sentence: str) -> list[str]:
    """Each letter of a sentence after its context."""
    padded = "^" * (ORDER - 1) + sentence
    return [padded[i : i + ORDER] for i in range(len(sentence))]


def window_score(ratios: list[float]) -> float:
    """The largest mean log-ratio over a window; shorter sentences count as one window padded by nothing in favour of either class."""
    width = WINDOW
    if len(ratios) <= width:
        return sum(ratios) / max(len(ratios), 10)
    run = best = sum(ratios[:width])
    for i in range(width, len(ratios)):
        run += ratios[i] - ratios[i - width]
        best = max(best, run)
    return best / width


def tainted(sentence: str, known: set[str]) -> bool:
    """Whether some window of a sentence is mostly made of runs known from abusive examples; such a sentence is of neither class."""
    hits = [sentence[i : i + (TAINT_LATIN if sentence[i].isascii() else TAINT_HANGUL)] in known for i in range(max(1, len(sentence) - (TAINT_LATIN if sentence.isascii() else TAINT_HANGUL) + 1))]
    width = min(WINDOW - TAINT_HANGUL, len(hits))
    run = sum(hits[:width])
    best = run
    for i in range(width, len(hits)):
        run += hits[i] - hits[i - width]
        best = max(best, run)
    return best >= TAINTED * width


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, sentence`` written once to the shared folder."""

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        met: dict[str, str] = {}  # of one batch of documents
        return texts.map(lambda t: sentences(t, met))

    return stored(docs.select(F.col(key).alias("_key"), F.explode(cut_up(F.col(text))).alias("sentence")), scratch_path(docs.sparkSession, "sentences"))


def chunk_counts(sentence: DataFrame, known: set[str]) -> DataFrame:
    """``chunk, gram, use``: how often each gram of a chunk's sentences stands in its ordinary ones; 0 if only in tainted ones."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        use = Counter()
        for s, n in zip(pdf["sentence"], pdf["n"], strict=True):
            weight = 0 if tainted(s, known) else int(n)
            for gram in grams(s):
                use[gram] += weight
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "gram": list(use.keys()), "use": list(use.values())})

    return sentence.groupBy("chunk").applyInPandas(count, "chunk long, gram string, use long")


def gram_ratios(counted: DataFrame, abusive: Abusive) -> DataFrame:
    """``gram, ratio``: log-ratio of the last letter after its context, abusive to ordinary, for each gram of ``counted`` (``gram, use``).

    Both are interpolated from the pair of letters upwards. A context has no more successors than there are letters, so its window stays short.
    """
    spark = counted.sparkSession
    keep = lambda df: stored(df, scratch_path(spark, "uses"))
    # each order is counted once from the one above it
    uses = {ORDER: keep(counted.groupBy("gram").agg(F.sum("use").alias("use")))}
    for k in range(ORDER - 1, 1, -1):
        uses[k] = keep(uses[k + 1].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.count_if(F.col("use") > 0).alias("use")))
    of_context = lambda k: Window.partitionBy(F.left("gram", F.lit(k - 1)))
    with_context = lambda df, k: df.withColumns({"total": F.sum("use").over(of_context(k)), "kinds": F.count_if(F.col("use") > 0).over(of_context(k))})
    chance = lambda lower: F.when(F.col("total") > 0, F.greatest(F.col("use") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * lower).otherwise(lower)
    reviewed = counted.sparkSession.createDataFrame(list(abusive.pairs.items()), "gram string, use long")
    pairs = uses[2].unionByName(reviewed).groupBy("gram").agg(F.sum("use").alias("use"))
    single = pairs.filter("use > 0").groupBy(F.right("gram", F.lit(1)).alias("last")).agg(F.count(F.lit(1)).alias("lefts"))
    whole = single.agg(F.sum("lefts")).first()[0] or 1
    base = (F.coalesce("lefts", F.lit(0)) + 0.1) / (whole + 0.1 * 20_000)
    found = with_context(pairs, 2).join(single, F.right("gram", F.lit(1)) == F.col("last"), "left").select("gram", chance(base).alias("shared")).withColumn("p", F.col("shared"))
    for k in range(3, ORDER + 1):
        below = found.select(F.col("gram").alias("below"), "shared", F.col("p").alias("lower"))
        found = with_context(uses[k], k).join(below, F.right("gram", F.lit(k - 1)) == F.col("below")).select("gram", "shared", chance(F.col("lower")).alias("p"))

    @F.pandas_udf("double")
    def log_ratio(gram: pd.Series, shared: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([math.log(abusive.chance(*x)) - math.log(q) for *x, q in zip(gram, shared, p, strict=True)], dtype=float)

    return found.select("gram", log_ratio("gram", "shared", "p").alias("ratio"))


def scored_sentences(distinct: DataFrame, labelled: list[tuple[str, str]]) -> DataFrame:
    """``sentence, score`` of distinct sentences (``sentence, n``); the ordinary model is counted on all of them but the tainted ones, ``n`` times each, and on the labelled ordinary texts.

    Sentences lie in chunks of bounded size. A chunk's grams meet the model once each, however often they occur, and then its sentences.
    """
    spark = distinct.sparkSession
    texts = [undisguised(t) for t in reviewed_examples()] + [undisguised(t) for t, c in labelled if c != "none" for _ in range(4)]
    known = {t[i : i + n] for t in texts for n in (TAINT_HANGUL, TAINT_LATIN) for i in range(len(t) - n + 1)}
    rows = stored(distinct, scratch_path(spark, "distinct"))
    chunks = 1 + (rows.agg(F.sum(F.length("sentence"))).first()[0] or 0) // CHUNK_LETTERS
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("sentence"), F.lit(chunks)))
    counted = stored(chunk_counts(rows, known), scratch_path(spark, "grams"))
    ordinary = Counter(g for t, c in labelled if c == "none" for g in grams(undisguised(t)))
    reviewed = spark.createDataFrame(list(ordinary.items()), "gram string, use long")
    ratios = gram_ratios(counted.select("gram", "use").unionByName(reviewed), Abusive(texts))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ratio = dict(zip(right["gram"], right["ratio"], strict=True))
        return pd.DataFrame({"sentence": left["sentence"], "score": [window_score([ratio[g] for g in grams(s)]) for s in left["sentence"]]})

    met = counted.select("chunk", "gram").join(ratios, "gram")
    return rows.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInPandas(score, "sentence string, score double")


def scores(docs: DataFrame, labelled: DataFrame, key: str, text: str, threshold: float | None = None) -> DataFrame:
    """``key, score``: each document's highest sentence score; with ``threshold`` only documents that reach it.

    ``labelled`` holds reviewed ``text, category`` rows (a fixed, small table). Without threshold, documents without sentences have a null score; repeated rows of a key are one document.
    """
    cut = sentence_table(docs, key, text)
    held = labelled.select("text", "category").limit(LABELS + 1).collect()
    if len(held) > LABELS:
        raise ValueError(f"more than {LABELS} reviewed examples")
    reviewed = [(r["text"], r["category"]) for r in held if r["text"]]
    scored = scored_sentences(cut.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")), reviewed)
    if threshold is None:
        best = cut.join(scored, "sentence").groupBy("_key").agg(F.max("score").alias("score"))
        return docs.select(F.col(key).alias("_key")).distinct().join(best, "_key", "left").select(F.col("_key").alias(key), "score")
    bad = bounded_broadcast(stored(scored.filter(F.col("score") >= threshold), scratch_path(docs.sparkSession, "abusive")), BROADCAST_SENTENCES, 300)
    return cut.join(bad, "sentence").groupBy(F.col("_key").alias(key)).agg(F.max("score").alias("score"))
