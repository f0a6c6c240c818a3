import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sillok.llm import encode, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encode.VOCABULARIES}/byte_bpe_50k.json"), reason="no vocabularies")
TEXTS = [
    "Hello  world's 123\n\n  x ", "안녕하세요 데이터 엔지니어\r\n두 줄", None, "", " ", "🙂👩‍💻 é 　\xa0 tab\t", "<|endoftext|> plain", "a" * 70_000, "日本語 テスト", "Hello  world's 123\n\n  x ", "\x1c\x85 ​", "ಠ_ಠ \U0001f6fe \U0001dfff", "one two, one two three " * 40,
]


@pytest.mark.parametrize("most_bytes", [encode.FREQUENT_BYTES, 300, 0])
def test_equals_published_tokenizer(spark, most_bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({"word": F.lit("w"), "_pos": F.lit(1)})
    done = encode.encode(df, "text", most_bytes=most_bytes)
    got = {r["doc_id"]: r["ids"] for r in done.collect()}
    assert [got[i] for i in range(len(TEXTS))] == want and set(done.columns) == {"doc_id", "text", "word", "_pos", "ids"}
    back = {r["doc_id"]: r["text"] for r in encode.decode(done, "doc_id").collect()}
    assert [back[i] for i in range(len(TEXTS))] == [x or "" for x in TEXTS]
    sized = encode.token_counts(df, "text", most_bytes=most_bytes)
    assert {r["doc_id"]: r["tokens"] for r in sized.collect()} == {i: len(x) for i, x in enumerate(want)} and set(sized.columns) == {"doc_id", "text", "word", "_pos", "tokens"}
    assert encode.encode(df.limit(0), "text", most_bytes=most_bytes).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 900))
def test_budget_is_the_best(counts, budget):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    taken = mixing.fit_budget(lengths, n, budget)
    reach = {0}
    for length, k in zip(lengths, n):
        reach = {s + length * j for s in reach for j in range(k + 1)}
    total = int((lengths * taken).sum())
    assert (0 <= taken).all() and (taken <= n).all() and total <= budget
    # the even thinning comes first, so the rest may miss the best sum only where few documents are left
    best = max(s for s in reach if s <= budget)
    assert best - total <= lengths.max() and (budget < (lengths * n).sum() or total == best)


def test_mix(spark):
    docs = [(i, "a", 1 + i % 9) for i in range(300)] + [(1000 + i, "b", 7) for i in range(10)] + [(2000, "c", 0), (2001, None, 5), (2002, "d", 50)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeat int")
    total = sum(t for _, s, t in docs if s in ("a", "b"))
    planned = mixing.plan(df.select("source", "tokens"), targets, total)
    used = mixing.mix(df, planned, "doc_id").collect()
    again = mixing.mix(df, planned, "doc_id").collect()
    assert sorted(used) == sorted(again) and len({r["doc_id"] for r in used}) == len(used)
    by = {s: sum(r["tokens"] * r["copies"] for r in used if r["source"] == s) for s in "abc"}
    assert by == {"a": round(total / 2), "b": 210, "c": 0}
    assert max(r["copies"] for r in used if r["source"] == "a") == 1 and {r["copies"] for r in used if r["source"] == "b"} == {3}
    shares = {r["source"]: r for r in mixing.shares(planned, df, targets).collect()}
    assert shares["none"]["mixed_tokens"] == 0 and shares["b"]["mixed_tokens"] == 210 and shares["d"]["target_share"] is None
    met = mixing.shares(mixing.plan(df.select("source", "tokens"), targets), df, targets)
    met = {r["source"]: r["mixed_tokens"] for r in met.collect()}
    assert met["b"] == 210 and met["a"] == 350  # three times all of b are its share of 700
    assert mixing.plan(df.limit(0).select("source", "tokens"), targets).count() == 0
