from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tests.llm import cases


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, blank, very long and repeated texts, null and repeated ids, and columns whose names operators use."""
    kind = "doc_id long, text string, lang string, n_chars long, id long, n long, score double, class string, words string, host string"
    rows = [(i, t, "en", len(t or ""), 1, 2, 0.5, "x", "w", "h") for i, t in cases.ROWS]
    return spark.createDataFrame(rows, kind).repartition(4)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(cases.ITEMS, "item_id long, text string, doc long")


@pytest.fixture(scope="session")
def bare(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
