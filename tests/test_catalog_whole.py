import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sillok.operators import catalog
from tests.conftest import DATA


def test_every_code_is_returned(spark, tmp_path):
    for name in ("companies_2", "companies_3"):
        rows = spark.read.parquet(str(DATA / "sf0.001" / f"{name}.parquet"))
        rows.withColumn("homepage", F.lit("ftp://x")).withColumn("is_group_portal", F.lit(None).cast("boolean")).write.parquet(str(tmp_path / f"{name}.parquet"))
    codes = {r["code"] for r in entry.queries()["q_catalog_violations"](spark, str(tmp_path)).collect()}
    assert {"bad_homepage", "no_flag"} <= codes


def test_too_many_selectors_are_refused(spark):
    sources = spark.createDataFrame([("kr-001", "a", "b", ["c"])], "id string, name_ko string, name_en string, aliases array<string>")
    with pytest.raises(ValueError, match="selectors"):
        catalog.resolve(sources, spark.range(catalog.SELECTORS + 1).select(F.col("id").cast("string").alias("selector")))
