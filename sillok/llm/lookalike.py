"""One plain form for visually identical text: invisible characters, wide forms, spaces, hyphens, composition and look-alike letters.

Each run of letters is resolved by intersecting the script sets its letters can be read in; mixed-script runs and whole-script look-alikes take the
spelling of the one script that covers them. Plain rows (ASCII and composed Hangul in single spaces) never leave the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like.
LATIN_TWINS = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜасԁеһіјӏорԛѕѵԝхуү", "ABESIJKMHOPCTYXYGQWacdehijlopqsvwxyy", strict=True)),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj", strict=True)),
    "Armenian": dict(zip("ՏՕԼօսհցո", "SOLouhgn", strict=True)),
    "Cherokee": dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏧ", "DRTAJEWMHGZWVSLCPKd", strict=True)),
    "Latin": dict(zip("ɑɡ", "ag", strict=True)),
}
#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑‒–−﹘﹣－˗"

_TWIN = {c: latin for twins in LATIN_TWINS.values() for c, latin in twins.items()}
_BACK = {script: {latin: c for c, latin in reversed(twins.items()) if latin.isalpha()} for script, twins in LATIN_TWINS.items() if script != "Latin"}
_RUN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}][\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Mn}]*")
_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee")}
_FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}ɑɡ]")
_SPACES = regex.compile(r"[\p{Z}\t\n\r\f\v\x1c-\x1f\x85]+")
_DROPPED = regex.compile(r"[\p{Cf}\p{Cc}\p{Variation_Selector}\u034f\u115f\u1160\u17b4\u17b5\u2800\u3164\uffa0]")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\u2640\u2642\u2695\u20e3]")

#: Rows outside this form need a closer look: printable ASCII and composed Hangul in single spaces.
SUSPECT = r"[^\x20-\x7E가-힣]|^ | $|  "


def _script(letter: str) -> str:
    return next((s for s, p in _SCRIPTS.items() if p.match(letter)), "")


def _visible(text: str) -> str:
    """Without invisible characters; joiners and selectors inside emoji stay."""
    if not _DROPPED.search(text):
        return text
    out: list[str] = []
    for i, c in enumerate(text):
        if not _DROPPED.match(c):
            out.append(c)
            continue
        before = next((b for b in reversed(out) if b not in "\ufe0f\ufe0e"), "")
        after = text[i + 1 : i + 2]
        if c in "\t\n\r\f\v\x1c\x1d\x1e\x1f\x85":
            out.append(" ")
        elif before and _PICTURE.match(before) and (c in "\ufe0f\ufe0e" or (c == "\u200d" and _PICTURE.match(after))):
            out.append(c)
        elif 0xE0020 <= ord(c) <= 0xE007F and before and (_PICTURE.match(before) or 0xE0020 <= ord(before) <= 0xE007F):
            out.append(c)
    return "".join(out)


_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFFE0, 0xFFE7), *range(0x1D400, 0x1D800)]}
_WIDE |= {ord(c): "-" for c in HYPHENS}


def plain_form(text: str | None) -> str | None:
    """The one plain form of ``text``; null stays null, empty stays empty. Idempotent."""
    if not text:
        return text
    text = unicodedata.normalize("NFC", _SPACES.sub(" ", _visible(text)).strip().translate(_WIDE))
    if not _FOREIGN.search(text):
        return text
    certain = {_script(c) for c in text if not c.isascii() and c not in _TWIN} - {"", "Latin"}

    def resolve(run: regex.Match) -> str:
        word = run[0]
        if word.isascii():
            return word
        letters = [c for c in word if not unicodedata.combining(c)]
        own = {_script(c) for c in letters}
        if own == {"Latin"} and not any(c in _TWIN for c in letters):
            return word
        # the scripts each letter can be read in, intersected
        if all(_script(c) == "Latin" or c in _TWIN for c in letters) and (len(own) > 1 or not own & certain):
            return "".join(_TWIN.get(c, c) for c in word)
        if len(own) > 1:
            for script in sorted(own - {"Latin"}):
                if all(_script(c) == script or c in _BACK[script] for c in letters):
                    return "".join(c if _script(c) == script else _BACK[script].get(c, c) for c in word)
        return word

    return unicodedata.normalize("NFC", _RUN.sub(resolve, text))


def plain_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(plain_form)

    return plain(text)


def not_plain(df: DataFrame, text: str, clean: str = "clean_text") -> DataFrame:
    """The rows whose ``text`` differs from its plain form, with that form in ``clean``. Null and empty texts are plain; all columns stay."""
    suspects = df.filter(F.col(text).rlike(SUSPECT)).withColumn(clean, plain_column(F.col(text)))
    return suspects.filter(F.col(clean) != F.col(text))
