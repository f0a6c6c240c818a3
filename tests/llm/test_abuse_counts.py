import math
import random
from collections import Counter

import pytest

from sillok.llm import abuse


def brute_force(sentences, labelled):
    """Scores of all sentences from models held in memory and trained on every untainted one."""
    abusive = [abuse.undisguised(t) for t in abuse.reviewed_examples()] + [abuse.undisguised(t) for t, c in labelled if c != "none" for _ in range(4)]
    known = {t[i : i + n] for t in abusive for n in (abuse.TAINT_HANGUL, abuse.TAINT_LATIN) for i in range(len(t) - n + 1)}
    ordinary = [s for s in sentences if not abuse.tainted(s, known)] + [abuse.undisguised(t) for t, c in labelled if c == "none"]
    assert 0 < len(ordinary) - 1 < len(sentences)
    models, pairs = [], Counter()
    for texts in (abusive, ordinary):
        counts = {k: Counter() for k in range(3, 7)}
        for t in texts:
            padded = "^" * 5 + t
            for k in counts:
                counts[k].update(padded[i - k + 1 : i + 1] for i in range(5, len(padded)))
        pairs.update(Counter(g[1:] for g in counts[3]))
        tables = {}
        for k in counts:
            use, total, kinds = counts[k] if k == 6 else Counter(g[1:] for g in counts[k + 1]), Counter(), Counter()
            for g, n in use.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            tables[k] = use, total, kinds
        models.append(tables)
    single, heads, kinds_of = Counter(p[1] for p in pairs), Counter(), Counter(p[0] for p in pairs)
    for p, n in pairs.items():
        heads[p[0]] += n
    known_ratios = {}

    def ratio(gram):
        logs = []
        for tables in models:
            p = (single[gram[5]] + 0.1) / (len(pairs) + 2000)
            if n := heads[gram[4]]:
                p = max(pairs[gram[4:]] - 0.75, 0) / n + 0.75 * kinds_of[gram[4]] / n * p
            for k in range(3, 7):
                use, total, kinds = tables[k]
                part = gram[6 - k :]
                if n := total[part[:-1]]:
                    p = max(use[part] - 0.75, 0) / n + 0.75 * kinds[part[:-1]] / n * p
            logs.append(math.log(p))
        return logs[0] - logs[1]

    def score(s):
        padded = "^" * 5 + s
        r = [known_ratios[g] if g in known_ratios else known_ratios.setdefault(g, ratio(g)) for g in (padded[i : i + 6] for i in range(len(s)))]
        return sum(r) / max(len(r), 10) if len(r) <= 12 else max(sum(r[i : i + 12]) for i in range(len(r) - 11)) / 12

    return {s: score(s) for s in sentences}


def test_scores_equal_brute_force_beyond_45000_sentences(spark):
    rng = random.Random(3)
    syllables = [chr(0xAC00 + 28 * i) for i in range(0, 399, 5)]
    lines = list(dict.fromkeys("".join(rng.choices(syllables, k=rng.randrange(6, 16))) for _ in range(50_000)))
    bad = ["거기대표병신같다", "밤길조심해라", "shutupyouidiot"]
    texts = ["\n".join(lines[i : i + 500]) for i in range(0, len(lines), 500)] + [*lines[::1000], *bad]
    labels = [("저런 돌대가리한테 배울 게 뭐가 있나", "insult"), ("급여가 늦게 나왔습니다.", "none")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["score"] for r in abuse.scores(df, spark.createDataFrame(labels, "text string, category string"), "id", "text").collect()}
    want = brute_force([s for t in texts for s in t.split("\n")], labels)
    assert len(lines) > 45_000 and set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(max(want[s] for s in t.split("\n")), abs=1e-9)
