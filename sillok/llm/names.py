"""Variant spellings of organisation names, linked by a noisy channel.

A catalogue gives the organisations and, by alignment of its Korean and English names, the parts names are made of (group and trade). Frequent spellings of the
data are the candidate canonical forms and their counts the prior. A typed spelling is read through the channel (legal forms, departments, brackets, order, language of
each part, abbreviation, acronym, then typing errors of one letter, syllable or neighbouring swap) and goes to the form of the largest posterior, if that form is of the catalogue.
Well-formed names of other organisations compete on equal terms, so affiliates and strangers keep their own spellings.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillok.llm.lookalike import plain_form
from sillok.session import scratch_path, stored

#: Most catalogue rows a model is built from on the driver.
CATALOGUE_ROWS = 20_000
#: Channel costs in nats: a form of the name itself, a short form, one typing error.
FORM_COST, SHORT_COST, TYPO_COST = 0.5, 1.5, 4.0
#: Wording around a name that names nobody.
LEGAL = (
    r"\(\s*(?:주|유|재|사)\s*\)|㈜|주식\s?회사|유한\s?회사|株式会社|\bco\.?\s*,?\s*ltd\.?(?!\w)|\b(?:corporation|corp|incorporated|inc|limited|ltd|llc|gmbh|plc)\b\.?|(?<=\s)(?:kor|korea)\.?\s*$|(?<=\s)코리아\s*$"
)
UNITS = r"(?:(?<=\S)\s+(?:\S*(?:팀|지점|지사|사업장|사업부|본부|공장)|본사|본점|(?:r&d\s?)?센터|\S+센터|(?:중앙\s?)?연구소|hr|recruit(?:ing|ment)?(?: team)?|careers?)|\s*\((?:hr|인사\s?팀?|채용\s?팀?|본사|r&d|[가-힣]{1,4}(?:지점|팀))\))\s*$"
#: Trade names shortened to a pair of initials, by the English trade.
INITIALS = {"media": ("m&c",), "energy": ("e&e",), "construction": ("e&c",), "foods": ("f&b",), "chemical": ("c&c",), "trading": ("t&i",)}
_LEGAL, _UNITS = regex.compile(LEGAL, regex.IGNORECASE), regex.compile(UNITS, regex.IGNORECASE)
_WRAP = regex.compile(r"^[\s<>\[\]「」『』【】《》〈〉\"'“”‘’]+|[\s<>\[\]「」『』【】《》〈〉\"'“”‘’.,;]+$")
_BOTH = regex.compile(r"\s*/\s*|\s*\(\s*(?=[^()]*\)?\s*$)|\)\s*$")
_CHOSEONG = {unicodedata.name(chr(c)).split(" ", 2)[2]: c for c in range(0x1100, 0x1113)}
_FINALS = {c: _CHOSEONG[n] for c in range(0x11A8, 0x11C3) if (n := unicodedata.name(chr(c)).split(" ", 2)[2]) in _CHOSEONG}
#: Korean names of the Latin letters, in order.
LETTER_NAMES = "에이 비 씨 디 이 에프 지 에이치 아이 제이 케이 엘 엠 엔 오 피 큐 알 에스 티 유 브이 더블유 엑스 와이 제트".split()
_KEY = regex.compile(r"[^\p{L}\p{N}&]+")


def bare(name: str | None) -> str:
    """A name without look-alikes, wrappers, legal forms and departments."""
    text = (plain_form(name) or "").strip()
    for _ in range(4):
        before = text
        text = _UNITS.sub("", _WRAP.sub("", _LEGAL.sub(" ", text)).strip()).strip()
        if text == before:
            break
    return " ".join(text.split())


def key(text: str) -> str:
    return _KEY.sub("", text.lower())


def letters(text: str) -> str:
    """Hangul as single letters; a final consonant is the same letter as an initial one."""
    return unicodedata.normalize("NFD", text).translate(_FINALS)


def one_error(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def typo(a: str, b: str) -> bool:
    return one_error(a, b) or one_error(letters(a), letters(b))


def _deletions(text: str) -> set[str]:
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def _fuzzy_keys(text: str) -> set[str]:
    return _deletions(text) | {"ㆍ" + x for x in _deletions(letters(text))}


def _thinned(short: str, full: str) -> bool:
    """Whether ``short`` is ``full`` with letters left out."""
    rest = iter(full)
    return all(c in rest for c in short)


@dataclass
class NameModel:
    """What a catalogue teaches about names; small, built on the driver from at most ``CATALOGUE_ROWS`` rows."""

    entity: dict[str, str] = field(default_factory=dict)  # row id -> smallest row id
    stated: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # entity -> spellings as stored
    groups: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # form -> groups
    trades: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # form -> trades
    full: list[str] = field(default_factory=list)  # English trades
    known: dict[tuple[str, str], str | None] = field(default_factory=dict)  # (group, trade) -> entity; None: of another list
    direct: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # alias form -> entities
    acronyms: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    bases: dict[str, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))  # base form -> (group, trade)
    near: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # deletion -> base forms
    near_part: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    prior: dict[str, int] = field(default_factory=dict)  # canonical name -> rows
    longest: int = 0  # letters of the longest form; a longer spelling is no form with one error

    def parse(self, text: str) -> set[tuple[str, str]]:
        """(group, trade) readings of a key, in either order and language; a trade may be cut short or lose letters."""
        found = set()
        for i in range(2, len(text) if len(text) <= self.longest else 0):
            a, b = text[:i], text[i:]
            for g, t in ((a, b), (b, a)):
                if g in self.groups and t in self.trades:
                    found |= {(x, y) for x in self.groups[g] for y in self.trades[t]}
                elif g in self.groups and 3 <= len(t) <= 5 and t.isascii():
                    thin = [y for y in self.full if y[0] == t[0] and len(t) < len(y) and _thinned(t, y)]
                    if len(thin) == 1:
                        found |= {(x, thin[0]) for x in self.groups[g]}
        return found


def _trade_tables(rows: list[tuple]) -> tuple[dict[str, str], dict[str, str]]:
    """English trade -> Korean trade, by the suffix the Korean names of a trade share; and the initials of trades of several words."""
    by_trade: dict[str, Counter] = defaultdict(Counter)
    initials = {}
    for _, ko, en, _, _ in rows:
        if en and len(words := bare(en).lower().split()[1:]) > 1:
            initials[key("".join(words))] = "".join(w[0] for w in words)
        en, ko = key(bare(en).split(" ", 1)[1]) if en and " " in bare(en) else "", key(bare(ko))
        if en and regex.fullmatch(r"\p{Hangul}+", ko):
            for i in range(1, min(6, len(ko) - 1)):
                by_trade[en][ko[-i:]] += 1
    trades = {}
    for en, tails in by_trade.items():
        most = max(tails.values())
        # the longest tail nearly as common as the most common one
        if most >= 2:
            trades[en] = max((t for t, n in tails.items() if n >= 0.6 * most), key=lambda t: (len(t), tails[t]))
    return trades, {en: short for en, short in initials.items() if en in trades}


def build_model(catalogue: list[tuple], others: list[tuple] = ()) -> NameModel:
    """A model of ``id, name_ko, name_en, aliases, homepage`` rows; ``others`` are organisations that compete but are not linked."""
    if len(catalogue) + len(others) > CATALOGUE_ROWS:
        raise ValueError(f"the catalogue has more than {CATALOGUE_ROWS} rows")
    model = NameModel()
    trades, initials = _trade_tables([*catalogue, *others])
    model.full = sorted(trades)
    for en, ko in trades.items():
        forms = {en, ko, *INITIALS.get(en, ()), initials.get(en, en)} | {en[:i] for i in range(3, len(en))} | {ko[:i] for i in range(2, len(ko))}
        for form in forms:
            model.trades[form].add(en)
    # rows of one organisation: the same home page, or the same bare name
    parent = {row[0]: row[0] for row in catalogue}

    def root(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    seen: dict[str, str] = {}
    for ident, ko, en, _, home in sorted(catalogue):
        keys = [f"home:{home.strip().lower().rstrip('/')}"] if home and home.strip() else []
        keys += [f"name:{key(bare(n))}" for n in (ko, en) if n and len(key(bare(n))) >= 3] if not keys else []
        for k in keys:
            if k in seen:
                a, b = sorted((root(ident), root(seen[k])))
                parent[b] = a
            else:
                seen[k] = ident
    model.entity = {row[0]: root(row[0]) for row in catalogue}

    members: dict[str | None, list[tuple]] = defaultdict(list)
    for row in catalogue:
        members[model.entity[row[0]]].append(row)
    for row in others:
        members[f"other:{key(bare(row[1]))}"].append(row)
    ko_of, en_of = {}, {}
    split: dict[str, tuple[str, str]] = {}
    for entity, rows in members.items():
        ens, kos = Counter(), Counter()
        for _, ko, en, _, _ in sorted(rows):
            for name in (ko, en):
                text = bare(name) if name else ""
                for part in _BOTH.split(text):
                    k = key(part)
                    if not k:
                        continue
                    if regex.fullmatch(r"\p{Hangul}+", k):
                        kos[k] += 1
                    elif k.isascii() and " " in part.strip():
                        ens[" ".join(part.lower().split())] += 1
        en = next((n for n, _ in ens.most_common() if key(n.split(" ", 1)[1]) in trades), None)
        if en is None:
            for k in kos:
                t = next((e for e, t in trades.items() if k.endswith(t) and len(k) > len(t)), None)
                if t:
                    split[entity] = ("", t)
                    ko_of[entity] = k
                    break
            continue
        group, trade = key(en.split(" ", 1)[0]), key(en.split(" ", 1)[1])
        en_of[entity] = group
        split[entity] = (group, trade)
        ko = next((k for k, _ in kos.most_common() if k.endswith(trades[trade]) and len(k) > len(trades[trade])), None)
        if ko:
            ko_of[entity] = ko
    # one name per group: its English form, with the Korean form the catalogue aligns with it
    romaji: dict[str, Counter] = defaultdict(Counter)
    for entity, (group, trade) in split.items():
        if group and entity in ko_of:
            romaji[group][ko_of[entity][: -len(trades[trade])]] += 1
    hangul = {g: c.most_common(1)[0][0] for g, c in romaji.items()}
    back = {ko: g for g, ko in hangul.items()}
    for entity, (group, trade) in split.items():
        if not group:
            stem = ko_of[entity][: -len(trades[trade])]
            group = back.get(stem, stem)
        listed = None if str(entity).startswith("other:") else entity
        if model.known.get((group, trade)) is None:
            model.known[group, trade] = listed
        for form in {group, hangul.get(group, group)}:
            model.groups[form].add(group)
    size = lambda forms: max(map(len, forms), default=0)
    model.longest = size(model.groups) + size(model.trades) + 2
    for entity, rows in members.items():
        listed = not str(entity).startswith("other:")
        for _, ko, en, aliases, _ in rows:
            if listed:
                model.stated[entity] |= {n for n in (ko, en, *(aliases or ())) if n}
            for alias in (aliases or ()) if listed else ():
                k = key(bare(alias))
                if k and not model.parse(k):
                    model.direct[k].add(entity)
                    if k.isascii() and len(k) <= 4:
                        model.acronyms[k].add(entity)
                        if k.isalpha():
                            model.direct["".join(LETTER_NAMES[ord(c) - 97] for c in k)].add(entity)
            for name in (ko, en) if listed else ():
                k = key(bare(name)) if name else ""
                if k and entity not in split:
                    model.direct[k].add(entity)
    model.longest = max(model.longest, size(model.direct) + 2)
    for (group, trade), _ in model.known.items():
        for g in {group, hangul.get(group, group)}:
            for t in {trade, trades[trade]}:
                model.bases[g + t].add((group, trade))
                model.bases[t + g].add((group, trade))
    for base in [*model.bases, *model.direct]:
        if len(letters(base)) >= 5:
            for d in _fuzzy_keys(base):
                model.near[d].add(base)
    for part in [*model.groups]:
        if len(letters(part)) >= 4:
            for d in _fuzzy_keys(part):
                model.near_part[d].add(part)
    return model


def canonical(group: str, trade: str) -> str:
    return f"{group} {trade}"


def exact_reading(model: NameModel, name: str | None) -> tuple[str | None, str | None]:
    """``(canonical form, entity)`` of a spelling the channel explains without a typing error; both null if none does."""
    text = bare(name)
    parts = [p for p in (key(p) for p in _BOTH.split(text)) if p] or [""]
    for k in [key(text), *parts] if len(parts) > 1 else parts:
        pairs = model.parse(k)
        ranked = sorted(pairs, key=lambda p: (model.known.get(p) is None, p not in model.known, p))
        if ranked:
            return canonical(*ranked[0]), model.known.get(ranked[0])
        if len(model.direct.get(k, ())) == 1:
            (entity,) = model.direct[k]
            return entity, entity
        for i in range(2, min(5, len(k)) if len(k) <= model.longest else 0):
            if k[:i] in model.acronyms and k[i:] in model.trades:
                fits = [e for e in model.acronyms[k[:i]] if any(model.known.get((g, t)) == e for g, t in model.known if t in model.trades[k[i:]] and model.known[g, t] == e)]
                if len(fits) == 1:
                    return fits[0], fits[0]
        if k in model.groups:
            own = [(g, t) for g, t in model.known if g in model.groups[k]]
            if len(own) == 1:
                return canonical(*own[0]), model.known[own[0]]
    return None, None


def typed_reading(model: NameModel, name: str | None, uses: int) -> str | None:
    """The entity a misspelt name means: the candidate of the largest posterior, if it is listed and beats the name standing for itself."""
    text = bare(name)
    best: dict[str, tuple[float, str | None]] = {}

    def offer(form: str, entity: str | None, cost: float) -> None:
        score = math.log1p(model.prior.get(form, 0)) - cost
        if form not in best or best[form][0] < score:
            best[form] = (score, entity)

    for k in {key(p) for p in [text, *_BOTH.split(text)]}:
        if len(k) > model.longest or len(letters(k)) < 5:
            continue
        for base in {b for d in _fuzzy_keys(k) for b in model.near.get(d, ())}:
            if typo(k, base):
                for pair in model.bases.get(base, ()):
                    offer(canonical(*pair), model.known[pair], TYPO_COST)
                if len(model.direct.get(base, ())) == 1:
                    (entity,) = model.direct[base]
                    offer(entity, entity, TYPO_COST + SHORT_COST)
        for i in range(2, len(k)):
            for g, t in ((k[:i], k[i:]), (k[i:], k[:i])):
                if t in model.trades:
                    for part in {p for d in _fuzzy_keys(g) for p in model.near_part.get(d, ())}:
                        if typo(g, part):
                            for pair in {(x, y) for x in model.groups[part] for y in model.trades[t]} & model.known.keys():
                                offer(canonical(*pair), model.known[pair], TYPO_COST + FORM_COST)
                elif g in model.groups and len(letters(t)) >= 3:
                    for form, trades in model.trades.items():
                        if len(form) >= 2 and typo(t, form):
                            for pair in {(x, y) for x in model.groups[g] for y in trades} & model.known.keys():
                                offer(canonical(*pair), model.known[pair], TYPO_COST + FORM_COST)
    if not best:
        return None
    form, (score, entity) = max(best.items(), key=lambda x: (x[1][0], x[1][1] is not None, x[0]))
    # standing for itself: a stranger uses its own name about as often as others use theirs
    if entity is None or math.log1p(uses) - TYPO_COST / 2 > score + TYPO_COST:
        return None
    return entity


def link_names(model: NameModel, names: DataFrame, name: str, uses: str = "uses") -> DataFrame:
    """``name, entity`` of the distinct spellings that mean a listed organisation; ``names`` has one row per spelling with its count.

    Null and empty names mean nobody. Spelled-out forms fix the prior in a first pass, misspellings are attributed in a second one.
    """
    names = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.col(uses).alias("_uses"))

    @F.pandas_udf("form string, entity string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_reading(model, t) for t in texts], columns=["form", "entity"])

    first = stored(names.withColumn("_read", read("_name")), scratch_path(names.sparkSession, "readings"))
    # one row per canonical form, at most the pairs of known parts
    counted = first.filter("_read.form IS NOT NULL").groupBy("_read.form").agg(F.sum("_uses").alias("n")).collect()
    model.prior = {r["form"]: r["n"] for r in counted}

    @F.pandas_udf("string")
    def attribute(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([typed_reading(model, t, int(n)) for t, n in zip(texts, counts, strict=True)], dtype=object)

    exact = first.filter("_read.entity IS NOT NULL").select(F.col("_name").alias(name), F.col("_read.entity").alias("entity"))
    typed = first.filter("_read.form IS NULL").select(F.col("_name").alias(name), attribute("_name", "_uses").alias("entity"))
    return exact.unionByName(typed.filter("entity IS NOT NULL"))
