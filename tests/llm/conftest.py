import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes rows as tables of an own folder: tables(documents=[(1, "text"), ...]) -> folder."""
    schemas = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "benchmark": "item_id bigint, text string",
        "pages": "page_id bigint, url string, html string",
    }

    def write(**rows):
        for name, schema in schemas.items():
            wide = [tuple(r) + (None,) * (schema.count(",") + 1 - len(r)) for r in rows.get(name, [])]
            spark.createDataFrame(wide, schema).repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
