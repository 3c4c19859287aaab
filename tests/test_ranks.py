"""Numbers of rows within groups, over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators.ranks import numbered


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered_like_a_window(spark, parts):
    draw = random.Random(4)
    hot = [("a", draw.randrange(300), draw.random()) for _ in range(900)] + [("a", 5, 0.5)] * 400
    rows = hot + [(draw.choice(["b", "c", None, ""]), draw.choice([None, 1, 2, 3]), draw.random()) for _ in range(500)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, _group double").repartition(5)
    with_conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in numbered(df, [F.col("key")], [F.col("at"), F.col("_group")], "rank").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected, seen = [], {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[0] if r[0] is not None else None, r[1], r[2]))):
        expected.append((*r, seen.setdefault(r[0], 0)))
        seen[r[0]] += 1
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:1]) + (r[3],)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_numbered_of_nothing(spark):
    assert numbered(spark.createDataFrame([], "key string, at long"), [F.col("key")], [F.col("at")]).count() == 0
