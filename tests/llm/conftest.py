import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["s"] * n
        return spark.createDataFrame([(i, t, lg, s, len(t or "")) for i, t, lg, s in zip(ids, texts, langs, sources)], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")
