import pytest
from pyspark.sql import types as T

from funnelkit.llm.common import ship

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text[, lang, source])."""
    ship(spark)

    def make(rows):
        out = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            out.append((r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])))
        return spark.createDataFrame(out, DOCUMENTS)

    return make
