"""Text functions: whitespace, folding, bounded terms, length accounting and answer checks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of unfinished answers.
DRAFT_MARKERS = r"(?iU)\b(?:TBD|TODO)\b|\[확인 필요[^\]]*\]|○○"
#: Shapes of secrets by kind.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"(?i)\b(?:api[_-]?key|secret|token)\b\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}",
}
_SPACE = r"(?U)[\s\x1c-\x1f]"


def collapse_ws(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, _SPACE + "+", " ")), F.lit(""))


def folded(text: str) -> str:
    """Composed, case-folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def fold(text: Column) -> Column:
    """``folded`` over a column. ASCII stays in the JVM, the rest goes through Arrow; null stays null."""

    @F.pandas_udf("string")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else folded(t))

    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, F.lower(collapse_ws(text))).otherwise(whole(F.when(~ascii_only, text)))


def bounded_pattern(needle: str) -> str:
    """A pattern that finds ``needle`` with an ASCII word boundary at each edge that is an ASCII letter or digit."""
    left = r"(?<![a-z0-9_])" if re.match(r"[a-z0-9]", needle) else ""
    right = r"(?![a-z0-9_])" if re.search(r"[a-z0-9]$", needle) else ""
    return left + re.escape(needle) + right


def contains_term(haystack: Column, needle: str) -> Column:
    """Whether folded text holds a term; Korean edges match inside words, ASCII edges only at word boundaries. Blank terms match nothing."""
    term = folded(needle)
    return F.coalesce(haystack.rlike(bounded_pattern(term)), F.lit(False)) if term else F.lit(False)


def all_words(query: str, *fields: str) -> Column:
    """Whether every word of ``query`` occurs in the joined fields, case aside; an empty query passes all."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    out = F.lit(True)
    for word in query.casefold().split():
        out = out & F.contains(hay, F.lit(word))
    return out


def newlines(text: Column, rule: str = "lf") -> Column:
    """Line ends as LF, CRLF, as they are (``preserve``) or removed (``none``)."""
    if rule == "preserve":
        return text
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return {"lf": unix, "crlf": F.replace(unix, F.lit("\n"), F.lit("\r\n")), "none": F.replace(unix, F.lit("\n"), F.lit(""))}[rule]


def count_text(text: Column, mode: str = "codepoints", include_spaces: bool = True, rule: str = "lf") -> Column:
    """Length in code points, UTF-16 units, UTF-8 or CP949 bytes; null for null and for texts the encoding cannot hold."""
    text = newlines(text, rule)
    if not include_spaces:
        text = F.regexp_replace(text, _SPACE, "")
    if mode == "codepoints":
        return F.length(text).cast("long")
    if mode == "utf16":
        return F.floor(F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")
    if mode == "utf8-bytes":
        return F.octet_length(text).cast("long")
    if mode != "cp949-bytes":
        raise ValueError(f"unknown count mode {mode!r}")

    def size(t: str | None) -> int | None:
        try:
            return None if t is None else len(t.encode("cp949"))
        except UnicodeEncodeError:
            return None

    @F.pandas_udf("long")
    def cp949(texts: pd.Series) -> pd.Series:
        return pd.Series([size(t) for t in texts], dtype="Int64")

    return cp949(text)


def check_answer(text: Column, limit: int, mode: str = "codepoints", include_spaces: bool = True, rule: str = "lf", min_fill: float = 0.75) -> Column:
    """``count, limit, fill, errors, warnings, ok`` of an answer against its limit; the arguments are checked here, texts never raise."""
    if type(limit) is not int or limit <= 0:
        raise ValueError("limit must be a positive int")
    if not 0 <= min_fill <= 1:
        raise ValueError("min_fill must lie between 0 and 1")
    count = count_text(text, mode, include_spaces, rule)
    blank = F.coalesce(F.length(collapse_ws(text)) == 0, F.lit(True))
    errors = F.array_compact(F.array(F.when(count.isNull(), "unencodable"), F.when(blank, "blank"), F.when(count > limit, "over_limit")))
    warnings = F.array_compact(F.array(F.when(count < limit * min_fill, "under_min_fill"), F.when(text.rlike(DRAFT_MARKERS), "draft_marker")))
    return F.struct(count.alias("count"), F.lit(limit).alias("limit"), (count / limit).alias("fill"), errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("ok"))


def fence(text: Column, language: str = "") -> Column:
    """The text between fences longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    bar = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(bar, F.lit(language + "\n"), text, F.lit("\n"), bar)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def first_line(text: Column, size: int = 200) -> Column:
    """The first line that is not blank, trimmed and cut; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.left(F.get(lines, 0), F.lit(size))


def media_flag(html: Column) -> Column:
    return F.coalesce(html.rlike(r"(?i)<(?:img|iframe|object)\b"), F.lit(False))


def secret_kinds(text: Column) -> Column:
    """Kinds of secrets a text seems to hold, without their values."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in SECRETS.items()]))


def quoted(text: Column) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
