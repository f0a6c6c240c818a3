import json

import pytest
from pyspark.sql import functions as F

from sillok.cli import main
from sillok.functions import network
from sillok.sources import profiles, sinks
from tests.test_operators import POSTING


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Amt.example:80?a", "ok"), ("https://амт.example/путь?q=ж", "ok"), ("https://9.9.9.9/", "ok"), ("https://[2620:fe::9]:443/", "ok"), ("https://a.example/?Note=session", "ok"), ("https://a.example./", "ok"),
        ("gopher://a.example/", "unsupported"), ("javascript:1", "unsupported"), ("https://x:y@a.example/", "blocked"), ("https://a.example:444/", "blocked"), ("https://a.example:/", "blocked"), ("https://a.example:0443/", "blocked"), ("https://printer.lan/", "blocked"), ("https://x.home.arpa/", "blocked"),
        ("https://172.16.9.1/", "blocked"), ("https://[fe80::1]/", "blocked"), ("https://[2001:db8::1]/", "blocked"), ("https://3232235777/", "blocked"), ("https://a.5/", "blocked"), ("https://a_b.example/", "blocked"), ("https://wort/", "blocked"), ("https://a.example/%7f", "blocked"), ("https://a.example/\u200b", "blocked"),
        ("https://a.example/?X-Amz_Signature=1", "needs_credentials"), ("https://a.example/?a=1&Pass%77ord", "needs_credentials"), (7, "blocked"), (None, "blocked"), ("", "blocked"), ("//a.example", "blocked"), ("https://" + "a" * 64 + ".example/", "blocked"), ("https://a.example/" + "x" * 9000, "blocked"),
    ],
)
def test_public_address(url, want):
    assert network.public_address(url)[0] == want


def test_columns(spark):
    df = spark.createDataFrame([("https://회사.com/채용", "saramin", "https://www.saramin.co.kr", bytearray("가".encode("cp949")), "text/html; charset=euc-kr"), (None, "x", "https://e.com/a", None, None)], "u string, a string, p string, b binary, t string")
    got = df.select(network.public_address_column(F.col("u"))["address"].alias("u"), network.search_address(F.col("a"), F.col("p"), "데이터 x").alias("s"), network.decoded(F.col("b"), F.col("t")).alias("d"), network.declared_total(F.lit("var totalRows = '45'")).alias("n")).collect()
    assert got[0]["u"].startswith("https://xn--") and got[0]["s"].endswith("/zf_user/search?searchword=%EB%8D%B0%EC%9D%B4%ED%84%B0%20x") and got[0]["d"] == "가" and got[0]["n"] == 45
    assert got[1]["s"] == "https://e.com/a" and got[1]["u"] is None and got[1]["d"] is None


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.read_current(spark, root) is None
    rows = [(1, "https://e.com/a", "s1", "", ("listing_card",), [], "t1", ""), (2, "https://e.com/b", "s1", "x", ("full_text",), [], "t1", ""), (3, "https://e.com/a?utm_x=1", "s1", "", ("listing_card",), ["w"], "t1", "")]
    fresh = spark.createDataFrame(rows, POSTING)
    first = sinks.save_observations(fresh, root)
    held = sinks.read_current(spark, root)
    assert {r["url"]: r["observations"] for r in first.collect()} == {"https://e.com/a": 1, "https://e.com/b": 1}
    for _ in range(3):  # on all columns: nothing moves, nothing grows
        again = sinks.save_observations(fresh, root)
        assert sinks.same_rows(first, again) and sinks.same_rows(held, sinks.read_current(spark, root))
    richer = spark.createDataFrame([(1, "https://e.com/a", "s2", "text", ("full_text",), [], "t2", "")], POSTING)
    shown = {r["url"]: r for r in sinks.save_observations(richer, root).collect()}
    assert shown["https://e.com/a"]["description"] == "text" and shown["https://e.com/a"]["observations"] == 2 and not shown["https://e.com/a"]["switched"]
    card = spark.createDataFrame([(5, "https://e.com/a", "s1", "", ("listing_card",), [], "t3", "")], POSTING)
    for _ in range(2):
        shown = {r["url"]: r for r in sinks.save_observations(card, root).collect()}
        assert shown["https://e.com/a"]["description"] == "text" and shown["https://e.com/a"]["switched"] and shown["https://e.com/a"]["observations"] == 3
    assert sorted(r["ordinal"] for r in sinks.read_current(spark, root).collect()) == [1, 1, 2, 5]
    assert len(list((tmp_path / "t").glob("v*"))) == 3


def test_sole_writer(spark, tmp_path):
    root = str(tmp_path / "t")
    with sinks.sole_writer(root, spark):
        with pytest.raises(TimeoutError), sinks.sole_writer(root, spark, 0.2):
            pass
    with sinks.sole_writer(root, spark, 0):
        assert (tmp_path / "t" / ".lock").exists()
    assert not (tmp_path / "t" / ".lock").exists()


def test_profile_and_cli(spark, tmp_path, capsys):
    good = {"display_name": "a", "experience_level": "", "target_roles": ["x"], "keywords": ["Python"], "preferred_locations": [], "excluded_keywords": [], "stories": []}
    path = tmp_path / "p.json"
    path.write_text("﻿" + json.dumps(good), encoding="utf-8")
    assert profiles.read_profile(str(path))["keywords"] == ["Python"]
    for bad in ({"keywords": "x"}, {"keywords": [" "]}, {"stories": [{}]}, {"display_name": None}):
        path.write_text(json.dumps(good | bad))
        with pytest.raises(ValueError, match="must|needs"):
            profiles.read_profile(str(path))
    path.write_text("[NaN]")
    with pytest.raises(ValueError, match="NaN"):
        profiles.read_profile(str(path))
    answer = tmp_path / "a.txt"
    answer.write_text("가나다", encoding="utf-8")
    assert main(["answers-check", str(answer), "--limit", "3"]) == 0 and json.loads(capsys.readouterr().out)["count"] == 3
    assert main(["answers-check", str(answer), "--limit", "2"]) == 1
    assert main(["rank", str(tmp_path / "none"), "--profile", str(path)]) == 2
