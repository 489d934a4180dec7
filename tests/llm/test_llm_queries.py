import pytest

import __spark_entry__
from siltline.llm.queries import ORACLES, QUERIES
from siltline.llm.tokens import encoding, token_counts
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0
    assert name in __spark_entry__.queries()


def test_whole_texts_are_counted(spark):
    texts = ["", None, "Hello, world", "ドア" * 5_000, " " * 10_000, "a" * 100_000]
    encode = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "i bigint, t string"), "t", ["i"]).orderBy("i").collect()
    assert [r.tokens for r in got] == [len(encode(t)) if t else 0 for t in texts]
