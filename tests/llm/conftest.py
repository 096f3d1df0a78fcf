import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import odd_rows  # noqa: E402

SMALL = "/root/testdata/sf0.001"
EXTRA = ("code component_id fingerprint row doc version epoch tokens block gone s words length salt number id "
         "of origin lang_pred score held chunk shard label host noise h place").split()


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string")
    return base.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumns(
        {c: F.lit(datetime.date(2024, 1, 1)) if c == "row" else F.lit("x") for c in EXTRA})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
