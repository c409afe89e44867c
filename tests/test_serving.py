import json

import pytest

from corvane.operators.serving import Breaker, embed, hashed_bits, isolate, shaped


def test_one_bad_row_is_found():
    def work(items):
        if "bad" in items:
            raise ValueError
        return [x.upper() for x in items]

    assert isolate(["a", "b", "bad", "c", "bad"], work) == (["A", "B", None, "C", None], [2, 4])
    assert isolate([], work) == ([], [])


def test_embedding(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "poison")], "id string, body string")

    def embedder(texts):
        if "poison" in texts:
            raise ValueError
        return hashed_bits(texts)

    assert rows(embed(df, embedder).select("id", "status")) == [("a", "searchable"), ("b", "searchable"), ("c", "failed")]
    assert len(embed(df, hashed_bits).first()["embedding"]) == 8


def test_breaker():
    now = [0.0]
    b = Breaker(threshold=2, cooldown=10, clock=lambda: now[0])

    def fail():
        raise OSError

    for _ in range(2):
        with pytest.raises(OSError):
            b.call(fail)
    assert b.state == "open"
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.state == "half_open"
    with pytest.raises(OSError):
        b.call(fail)
    assert b.state == "open"
    now[0] = 22
    assert b.call(lambda: 1) == 1 and b.state == "closed"


def test_shape(spark):
    df = spark.createDataFrame([(0.123456, "t", None, '{"a":1}')], "score double, title string, lang string, extra string")
    assert json.loads(shaped(df, ("title", "lang"), extra="extra").first()[0]) == {"score": 0.1235, "title": "t", "extra": {"a": "1"}}
