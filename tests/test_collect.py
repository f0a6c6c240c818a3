from sillok.plans.collect import address_checks, collect
from tests.test_sources import ld, posting

SCHEMA = "source_id string, url string, page_no int, http_status int, content_type string, content binary"


def test_collection(spark):
    page = lambda *items: bytearray(ld(*items).encode())
    rows = [
        ("a", "https://a.example/1", 1, 200, "text/html", page(posting(url="/j/1"), posting(url="/j/2", title="기획자"))), ("a", "https://a.example/2", 2, 200, "text/html", page(posting(url="/j/1"))),
        ("b", "https://b.example/1", 1, 200, "text/html", page(posting(url="/j/1", description=""))), ("c", "https://c.example/1", 1, 403, "text/html", bytearray(b"no")),
        ("d", "https://d.example/1", 1, 200, "text/html", bytearray(b"<script>x</script>")), ("e", "https://e.example/1", 1, 200, "text/html", page(posting(title="기획자"))), ("f", "https://f.example/1", 1, 200, None, None),
    ]
    shots = spark.createDataFrame(rows, SCHEMA)
    jobs, states = collect(shots, "엔지니어")
    assert {(r["source_id"], r["url"], r["page_no"]) for r in jobs.collect()} == {("a", "https://a.example/j/1", 1), ("b", "https://b.example/j/1", 1)}
    assert {r["source_id"]: (r["status"], r["job_count"]) for r in states.collect()} == {"a": ("ok", 1), "b": ("partial", 1), "c": ("blocked", 0), "d": ("needs_browser", 0), "e": ("empty", 0), "f": ("unsupported", 0)}
    sources = spark.createDataFrame([("s1", "https://c.example/1"), ("s2", "https://c.example/1"), ("s3", "https://z.example/")], "id string, careers_url string")
    assert {r["id"]: r["status"] for r in address_checks(sources, shots).collect()} == {"s1": "blocked", "s2": "blocked", "s3": "unchecked"}
    empty = collect(shots.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
