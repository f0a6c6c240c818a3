from pyspark.sql import functions as F

from sillok.operators import merge


def test_ranks_have_no_gaps_beyond_the_range_sample(spark):
    """Four input partitions of 50,000 rows, far above the 300 rows each that the bounds are drawn from."""
    rows = 200_000
    df = spark.range(0, rows, 1, 4).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = merge.numbered(df, F.desc("v"), "id").select("rank", "v", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, rows + 1))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
