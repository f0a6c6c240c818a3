"""Template residue and error-page text: message templates mined with a fixed-depth prefix tree, judged once, verdicts propagated.

A text is cut into lines, numbers and addresses are masked, and distinct lines descend a tree of fixed depth (token count, first tokens) to a leaf that holds their
templates; a line joins the most similar template or opens one. Each template is judged once. Unresolved slots are looked for in every distinct line by itself, since an ordinary
template may hide one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillok.session import bounded_broadcast, cut

#: Leading tokens below the token count that form the path to a leaf, for lines of up to LONG tokens and for longer ones; the share of equal tokens that joins a template.
DEPTH, LONG, DEPTH_LONG, SIMILAR = 2, 12, 5, 0.5
#: Lines of at most so many tokens are templates of their own: a wildcard would be most of what they say.
TERSE = 4
#: Parts a leaf is mined in, so that no leaf is one task's work; a verdict needs no other part.
PARTS = 8
#: Most lines that wait for the verdict of their templates; in a fuller leaf the first ones are judged by the templates as they are by then, so that no leaf is held whole.
HELD = 100_000
#: Most distinct residue lines that are broadcast back to the records; beyond it the join shuffles.
BROADCAST_LINES = 50_000

#: What a notice says, by kind. A judged line starts with the notice or consists of it.
NOTICES = {
    "error_page": (
        r"(?:(?:http\s+(?:status|error)\s*)?\d+\s*[-:|]?\s*)?(?:page\s+)?(?:not found|bad gateway|forbidden|internal server error|service (?:temporarily )?unavailable|gateway time-?out|bad request|unauthorized|too many requests)(?:\W*$|\W+(?:nginx|apache|error|the |retry|please)|\s*[.!|-])",
        r"(?:http status|http error|error code|오류\s*코드)\s*:?\s*\d+\b", r"whitelabel error page", r"error establishing a database", r"(?:php )?(?:fatal error|parse error|warning): ", r"(?:fatal )?error: uncaught", r"uncaught \w*error",
        r"traceback \(most recent call last\)", r"(?:exception in thread|caused by: )", r"(?:[a-z_]\w*\.){2,}\w*(?:exception|error)\b", r"at (?:[\w$]+\.)+[\w$<>]+\([\w.]+:\d+\)",
        r"access (?:is )?denied\W*(?:$|you |reference)", r"you don'?t have permission", r"(?:the )?server encountered an? ", r"this (?:site|page) can.t be reached", r"(?:oops|sorry)\W.{0,60}(?:wrong|found|error|exist)", r"something went wrong",
        r"(?:요청하신|찾으시는|해당)?\s*(?:페이지|공고|게시물|정보|주소)[를을가이은는]?\s*(?:찾을 수 없|없습니다|존재하지 않)", r"(?:요청하신|찾으시는)\s.{0,20}(?:없습니다|찾을 수 없)", r"삭제되었거나 .{0,12}(?:않는|없는)", r"존재하지 않는 (?:페이지|공고|게시물)", r"잘못된 (?:접근|요청|경로)(?:입니다|$)", r"세션이 만료", r"로그인이 필요(?:합니다|한)",
        r"접속이 원활하지", r"일시적(?:인|으로) .{0,10}(?:오류|장애|문제)", r"(?:시스템|서버|네트워크) (?:오류|에러|점검)(?:가|입니다|\W*$|\s*중)", r"오류가 발생(?:했|하였)", r"접근(?:이|\s)?\s*(?:거부|제한|차단)(?:되었|\W*$)", r"권한이 없습니다", r"이용에 불편을",
        r"(?:사이트|서비스|시스템|홈페이지)?\s*점검\s*(?:중(?:입니다|\s*$)|안내\W*$|시간\s*:)", r"(?:서비스|사이트) (?:이용|접속)이? .{0,8}(?:불가|중단)", r"(?:site|page) (?:is )?under (?:construction|maintenance)", r"(?:scheduled )?maintenance (?:in progress|mode)", r"we'?ll be (?:right )?back",
        r"(?:welcome to nginx|it works!|index of /|apache2? .{0,12}default page|default web ?site page|iis windows server)",
    ),
    "challenge": (
        r"checking (?:your browser|if the site connection)", r"just a moment", r"attention required", r"(?:your )?(?:request|access|ip)(?: has been| was| is)? blocked\W", r"verify(?:ing)? (?:that )?you are (?:a )?human", r"are you a (?:robot|human)",
        r"please (?:complete|solve) the (?:captcha|security)", r"too many requests", r"ddos protection by", r"(?:자동화된|비정상적인) (?:접근|요청|트래픽)이? ?.{0,10}(?:감지|차단)", r"보안 ?문자를 입력", r"enable cookies", r"쿠키를 (?:허용|사용)하",
    ),
    "script_notice": (
        r"(?:you need to |please )?(?:enable|turn on|activate|allow) (?:javascript|scripts?|js)\b", r"(?:this (?:site|page|app|website) )?requires? (?:javascript|scripts)", r"javascript (?:is|must be|has been|seems to be) (?:disabled|enabled|required|off)", r"your browser does not support",
        r"(?:이 (?:사이트|페이지|서비스)[^.]{0,16})?(?:자바\s?스크립트|스크립트|javascript)[가이를을은는]?\s*(?:비활성|꺼져|지원하지|사용하도록|사용할 수 있도록|사용이 필요|활성화|켜|허용)", r"window\.(?:location|onload|open)", r"document\.(?:write|cookie|getelement)", r"\(?function\s*\(\w*\)\s*\{",
        r"(?:콘텐츠|페이지|내용|데이터)[를을]? ?불러오는 중", r"(?:now )?loading\s*(?:\.{2,}|…|$)", r"로딩\s*중", r"잠시만 기다려",
    ),
    "markup": (r"<!doctype", r"</?(?:html|head|body|title|meta|script|noscript|style|iframe|div|span|h[0-6]|p|br|center|table)\b[^>]*>"),
    "filler": (
        r"lorem ipsum(?: dolor|\W*$)", r"(?:ut enim ad minim|duis aute irure|excepteur sint|sed do eiusmod|dolor sit amet|consectetur adipiscing)", r"sample (?:text|title|content|page)\b\W*(?:$|replace)", r"(?:dummy|placeholder|example) (?:text|content|title)\W*$", r"(?:여기는 )?(?:본문|제목|내용) 영역",
        r"가나다라\s?마바사", r"(?:asdf|qwer|ㅁㄴㅇㄹ|zxcv)\w*(?:\s|$)", r"(?:(?:테스트|test)\W*){2,}\d*\W*$", r"(?:테스트|test)\W*\d*\W*$", r"(?:샘플|예시|더미)\s?(?:텍스트|문구|데이터|공고)?(?:입니다)?\W*$", r"untitled(?: document| page)?\W*$", r"(?:제목|내용)\s?없음\W*$", r"react app\W*$", r"(?:my |new )?(?:page|document|site) title\W*$", r"(?:new page|page|sheet|document|untitled|title|error|오류|에러|제목|home ?page|welcome|default)\s*\d*\W*$", r"vite \+ \w+\W*$",
        r"준비\s?중입니다\W*$", r"coming soon\W*$", r"(?:null|undefined|nan|none|\[object object\]|n/a|#(?:ref|value|n/a)!?)\W*$", r"(.)\1{5,}\W*$",
    ),
    "instruction": (
        r"(?:(?:여기|이곳)에 )?.{0,24}?[를을]?\s?(?:입력|작성|기재)(?:해\s?주세요|하세요|하십시오|해 주십시오|바랍니다)\W*$", r"todo\b\W*(?:[:：]|$|write|본문|작성|add|fill)", r"(?:fixme|tbd|xxx)\W*(?::|$)", r"(?:replace|insert|enter|type|write|put|add) (?:this|your|the|here|text)\b.{0,40}(?:text|here|own|content|description)?", r"이 (?:문구|문장|텍스트|내용)[은는].{0,20}(?:예시|샘플|견본)",
        r".{0,40}(?:게시|등록|발행) 전에 .{0,10}(?:바꿔|바꾸|수정|삭제|교체)", r"(?:your|company|job) (?:company |job )?(?:name|title|description) here", r"click here to edit",
    ),
}
#: Wording of a collector or of an ordinary text that speaks about such notices.
SPEAKS_ABOUT = (
    r"classified as|분류함|분류했|detected|감지|\bfound;|not bypassed|rendered by|was expanded|were truncated|대신\b|관리합니다|운영합니다|기획하고|우대합니다|이해가 필요|리뷰를 합니다|다룰 줄|찾습니다|is a plus|we (?:monitor|build|write|design|handle)|experience with|채용$|careers?$|recruit$"
)
#: Unresolved slots, by the syntax that left them.
SLOTS = (
    r"\{\{\s*[#/>&^]?\s*[\w.$\[\]가-힣-]+(?:\s*\|[^}]*)?(?:\([^}]*\))?\s*\}\}", r"\{%-?\s*\w+.*?%\}", r"<%[=#-]?.+?%>", r"[$#]\{\s*[a-z_][\w.\[\]]*\s*\}", r"\[\[\s*[\w.]+\s*\]\]", r"(?<![\w%])%[A-Z][A-Z0-9_]{2,}%", r"(?<![\w#])#[\w가-힣]{2,20}#(?![\w#])", r"%\(\w+\)[sdif]", r"(?<![\d\w%])%[sd](?![\w%])",
    r"\[(?:[A-Z]{2,}(?:[ _][A-Z]{2,})+|[A-Z]{3,}_[A-Z_]+|(?:Your|Candidate|Company|Job|Applicant|Recipient|First|Last|Hiring|Insert|Enter)\s?(?:Name|Title|Here|Company|Manager|Date|[A-Z]\w+)[^\]]{0,20}|(?:회사|직무|이름|담당자|부서|지원자|날짜)\s?(?:명|이름|입력|기재)?\])", r"(?<=[^<\s]\s)<[a-z_]{1,20}>(?=[\s:.,])", r"@@\w+@@", r"__[A-Z][A-Z_]+__", r"\$[A-Z][A-Z_]{3,}\$",
    r"(?:undefined|NaN|null)(?:년|월|일|명|원|만원|개|건|%)", r"(?::|：)\s*(?:undefined|NaN|null|None|\[object Object\])(?:\s|$|[.,;/~]|[가-힣])", r"\b(?:declared|parsed|total|of|page)\s+(?:undefined|NaN|null)\b", r"\(\s*(?:여기에|이곳에)\s?\S+\s*\)", r"(?<!\w)(?:X{3,}|○{2,}|□{3,})(?:[\s-]+(?:X{3,}|○{2,}|□{3,})){1,}",
)
#: A single-brace slot counts unless the line speaks about templates.
_BRACE = regex.compile(r"(?<![\w{$#])\{(?:[a-z_][\w.]*|\d)\}(?!\})")
_ABOUT_CODE = regex.compile(r"문법|템플릿 엔진|환경\s?변수|셸 스크립트|syntax|template (?:engine|parameter|language)|environment variable|placeholder text|was expanded|표기법", regex.IGNORECASE)
_SLOT = regex.compile("|".join(f"(?:{p})" for p in SLOTS))
_NOTICE = {kind: regex.compile(r"^\W*(?:" + "|".join(f"(?:{p})" for p in patterns) + ")", regex.IGNORECASE) for kind, patterns in NOTICES.items()}
_ABOUT = regex.compile(SPEAKS_ABOUT, regex.IGNORECASE)
_WORD = regex.compile(r"[^\s]+")


def has_slot(line: str) -> bool:
    """Whether a line holds a slot that should have been filled."""
    if _ABOUT_CODE.search(line):
        return False
    return bool(_SLOT.search(line) or _BRACE.search(line))


def judge(template: str) -> str | None:
    """The kind of notice a template is, or null for ordinary wording."""
    if _NOTICE["markup"].match(template):
        return "markup"
    if _ABOUT.search(template):
        return None
    for kind, pattern in _NOTICE.items():
        if pattern.match(template):
            return kind
    tokens = _WORD.findall(template)
    return "filler" if len(tokens) >= 3 and len({t.strip(".,!").lower() for t in tokens}) == 1 else None


class PrefixTree:
    """The templates of one leaf after another; lines arrive grouped by leaf."""

    def __init__(self) -> None:
        self.leaf: object = None
        self.templates: list[list[str]] = []

    def place(self, leaf: object, tokens: list[str]) -> int:
        """Index of the template the line joins within its leaf; similar templates get wildcards where they differ."""
        if leaf != self.leaf:
            self.leaf, self.templates = leaf, []
        best, score = -1, -1.0
        for i, template in enumerate(self.templates):
            same = sum(map(eq, template, tokens)) / len(tokens)
            if same > score:
                best, score = i, same
        if best >= 0 and score >= (1 if len(tokens) <= TERSE else SIMILAR):
            self.templates[best] = [a if a == b else "<*>" for a, b in zip(self.templates[best], tokens, strict=True)]
            return best
        self.templates.append(tokens)
        return len(self.templates) - 1


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of lines grouped by leaf; a leaf's lines leave with the verdict of their template, or their own slot's."""
    tree = PrefixTree()
    held: list[tuple[str, int]] = []

    def settle() -> tuple[list[str], list[str], list[str]]:
        names = [" ".join(t) for t in tree.templates]
        verdicts = [judge(n) for n in names]
        lines, templates, kinds = [], [], []
        for line, i in held:
            kind = verdicts[i] or ("unresolved_slot" if has_slot(line) else None)
            if kind:
                lines.append(line), templates.append(names[i]), kinds.append(kind)
        held.clear()
        return lines, templates, kinds

    def out(rows: tuple[list[str], list[str], list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], names=["line", "template", "kind"])

    for batch in batches:
        ready: tuple[list[str], list[str], list[str]] = ([], [], [])
        for leaf, line in zip(batch.column("leaf").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if held and (leaf != tree.leaf or len(held) >= HELD):
                for store, more in zip(ready, settle(), strict=True):
                    store.extend(more)
            tokens = line.split()
            held.append((line, tree.place(leaf, tokens)))
        yield out(ready)
    if held:
        yield out(settle())


def masked_lines(text: Column) -> Column:
    """Distinct trimmed sentences of the lines of a text, numbers as 0 and addresses as URL; null and empty texts give none."""
    masked = F.regexp_replace(F.regexp_replace(text, r"https?://[^\s\"'<>]+", "URL"), r"[0-9]+", "0")
    return F.filter(F.array_distinct(F.transform(F.split(masked, r"[\r\n]+|(?<=[.!?]) +(?=\S)"), lambda x: F.trim(x))), lambda x: x != "")


def residue_lines(lines: DataFrame) -> DataFrame:
    """``line, template, kind`` of the distinct residue lines among ``line``; copies are merged before the shuffle."""
    distinct = lines.select("line").distinct()
    tokens = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    deep = F.size(tokens) > LONG
    path = [F.when(deep if k >= DEPTH else F.lit(True), F.get(tokens, k)) for k in range(DEPTH_LONG)]
    leaf = F.xxhash64(F.size(tokens), *[F.coalesce(t, F.lit("")) for t in path], F.pmod(F.hash("line"), F.lit(PARTS)))
    grouped = distinct.withColumn("leaf", leaf).repartition("leaf").sortWithinPartitions("leaf", "line")
    return grouped.select("leaf", "line").mapInArrow(_mine, "line string, template string, kind string")


def with_residue(records: DataFrame, texts: str, *key: str) -> DataFrame:
    """``key, kinds`` of the records any of whose ``texts`` (array of strings) holds residue, wholly or in one line.

    Null arrays, null entries, empty and blank texts hold none; repeated records are one. Key columns may have any names.
    """
    keep = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    lines = records.select(*keep, F.explode(F.flatten(F.transform(F.filter(F.col(texts), lambda t: t.isNotNull()), masked_lines))).alias("line"))
    bad = cut(residue_lines(lines))
    met = lines.join(bounded_broadcast(bad.select("line", "kind"), BROADCAST_LINES, 300), "line")
    return met.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.array_sort(F.collect_set("kind")).alias("kinds")).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], "kinds")


def plain_pandas(lines: pd.Series) -> pd.Series:
    """Verdicts of single lines without mining, for comparison in tests."""
    return lines.map(lambda x: judge(x) or ("unresolved_slot" if has_slot(x) else None))
