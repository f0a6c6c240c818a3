from datetime import datetime, timedelta

from sillok.streaming.merge_stream import keep_observations

SCHEMA = "url string, source_id string, collected_at string, collected timestamp"


def test_distinct_observations(spark, tmp_path):
    """Spellings of one address are one observation; a replayed file and a second start add nothing, a new moment does."""
    at = datetime(2027, 1, 5, 12)
    rows = [("https://a.example/1", "s", "t1", at), ("HTTPS://A.example/1?utm_x=1", "s", "t1", at), ("https://a.example/1", "r", "t1", at), ("nowhere", "s", "t1", at)]
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda: spark.readStream.schema(SCHEMA).parquet(place)
    kept = lambda: sorted((r["url"], r["source_id"], r["collected_at"]) for r in spark.read.parquet(out).collect())
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(place)
    keep_observations(read(), out, str(tmp_path / "at")).awaitTermination(120)
    first = [("https://a.example/1", "r", "t1"), ("https://a.example/1", "s", "t1")]
    assert kept() == first
    spark.createDataFrame(rows[:1] + [("https://a.example/1", "s", "t2", at + timedelta(hours=1))], SCHEMA).write.mode("append").parquet(place)
    for _ in range(2):
        keep_observations(read(), out, str(tmp_path / "at")).awaitTermination(120)
    assert kept() == [*first, ("https://a.example/1", "s", "t2")]
